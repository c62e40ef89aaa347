"""All registered queries: name to function, and to SQL that gives the same rows."""

from millrace.plans import operation, relational, streams, windows  # noqa: F401  (they register their queries)
from millrace.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
