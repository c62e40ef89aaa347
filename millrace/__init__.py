"""Millrace: event analytics on PySpark, the same queries over files and over live streams."""
