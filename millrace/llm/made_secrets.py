"""Labelled findings for the secret scan: documents are written with secrets in known places and with what is taken for
secrets, and every candidate that the scan's own extraction finds in them is labelled by whether it is part of a placed one.

No table here has findings labelled by people. Where there is one, secret_forest.train takes it instead.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the texts around the findings.
WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
SYLLABLES = "sch ung keit ver ein gen tion ment eau oux ation ado ción mente ing ness ther ou re li na to ka mer ber fe sta".split()
NAMES = "token api_key apikey secret password access_key auth_token client_secret DB_PASSWORD AWS_SECRET_ACCESS_KEY private_key session_key webhook_secret".split()
PLAIN_NAMES = "title version color path checksum build id filename user theme label digest revision next".split()
LOW, UP, DIGIT, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
PATHS = ("src1", "app/main.py", "config/prod.yml", "tests/test_login.py", "docs/example.md", None)


def document(rng: random.Random) -> tuple[str, list[str], str | None]:
    """A text, the secrets in it, and its path."""
    pick = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    word = lambda: rng.choice(WORDS)
    long = lambda a, b: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(a, b)))
    name = lambda of: rng.choice((str, str, str.upper))(rng.choice(of)) + rng.choice(("", "", f"_{long(1, 2)}"))

    def key() -> str:
        return rng.choice((pick(HEX, 32, 64), pick(HEX, 40, 40), pick(LOW + UP + DIGIT, 20, 48), "AKIA" + pick(UP + DIGIT, 16, 16), "ghp_" + pick(LOW + UP + DIGIT, 36, 36), "xoxb-" + pick(DIGIT, 11, 12) + "-" + pick(LOW + UP + DIGIT, 24, 24), pick(LOW + UP + DIGIT + "+/", 30, 60) + "=", "eyJ" + pick(LOW + UP + DIGIT, 20, 40) + "." + pick(LOW + UP + DIGIT + "-_", 30, 60)))

    def other() -> str:
        return rng.choice((long(5, 11), long(5, 9).title(), long(4, 8).upper(), pick(DIGIT, 12, 20), "/".join(["", *(long(1, 3) for _ in range(rng.randint(3, 6)))]), "_".join(long(1, 2) for _ in range(rng.randint(3, 6))), rng.choice("-=_") * rng.randint(12, 60), "-".join(pick(HEX, n, n) for n in (8, 4, 4, 4, 12)), "https://" + long(2, 3) + ".example.com/" + long(3, 6)))

    def dummy() -> str:
        return rng.choice(("your_" + name(NAMES).lower() + "_here", "changeme" * rng.randint(2, 3), "example" * rng.randint(2, 4), "x" * rng.randint(16, 40), "0" * rng.randint(16, 40), "test_" + long(3, 5), "1234567890abcdef" * rng.randint(1, 2)))

    parts, secrets = [], []
    for _ in range(rng.randint(2, 5)):
        parts += [rng.choice((word, word, word, lambda: long(1, 4)))() for _ in range(rng.randint(2, 12))]
        quote, kind = rng.choice(('"', "'", "")), rng.randint(0, 9)
        if kind < 4:
            k = key()
            secrets.append(k)
            form = rng.randint(0, 4)
            if form == 0:
                parts.append(f"{name(NAMES)} = {quote}{k}{quote}{rng.choice(('', ',', ';', '.'))}")
            elif form == 1:
                parts.append(f"{name(NAMES)}{rng.choice('=:')}{quote}{k}{quote}")
            elif form == 2:
                parts.append(f"Authorization: Bearer {k}")
            elif form == 3:
                parts.append(f'{{"{name(NAMES)}": "{k}", "{rng.choice(PLAIN_NAMES)}": "{other()}"}}')
            else:
                parts.append(f'{{"{name(NAMES)}":"{k}"}}')
        elif kind < 6:
            parts.append(f"{name(NAMES)}{rng.choice((' = ', '=', ': '))}{quote}{dummy()}{quote}")
        elif kind == 6:
            parts.append(f"{rng.choice(('commit', 'sha1', 'integrity', 'checksum', 'revision'))} {pick(HEX, 40, 40)}")
        elif kind == 7:
            parts.append(f"{rng.choice(PLAIN_NAMES)}{rng.choice((' = ', '=', ': '))}{quote}{other()}{quote}")
        else:
            parts.append(other() + rng.choice(("", ".", ",")))
        parts += [word() for _ in range(rng.randint(0, 6))]
    return rng.choice((" ", " ", "\n")).join(parts), secrets, rng.choice(PATHS)


def documents(spark, n: int, seed: int) -> DataFrame:
    """n documents: doc_id, text, source (path), placed (the secrets)."""
    rng = random.Random(seed)
    rows = [(i, text, path, secrets) for i in range(n) for text, secrets, path in (document(rng),)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, placed array<string>")


def labelled(candidates: DataFrame, written: DataFrame) -> DataFrame:
    """candidates (of `written`) with label: 1 if the candidate is part of a secret that was placed in its document."""
    known = written.select(F.col("doc_id").alias("id"), "placed")
    return candidates.join(known, "id").withColumn("label", F.exists("placed", lambda p: F.contains(p, F.col("candidate"))).cast("int")).drop("placed")
