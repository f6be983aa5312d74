import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("key", "keys", "part", "src", "size", "target", "start", "label", "score", "id", "bucket", "docs", "root", "shard", "slot", "base", "added", "loose", "rep", "a", "b", "x", "did", "taken", "seq", "ids")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, copies, near copies, repeated rows and ids, shared passages."""
    rng = random.Random(5)
    base = prose(rng, 120, 5000)
    passage = prose(rng, 60, 5000)
    rows = [(None, "no id at all " + prose(rng, 20), "en", "s1", 5), (1, None, "en", "s1", None), (2, "", None, None, 0), (3, " \t\n\x0b\x0c\r ", "de", "s2", 7)]
    rows += [(10 + i, base, "en", "hot", 1) for i in range(12)]
    for i in range(12):
        w = base.split()
        w[(7 * i) % 110] = f"changed{i}"
        rows.append((30 + i, " ".join(w).upper() if i % 2 else "  ".join(w), "en", "hot", 1))
    rows += [(50 + i, prose(rng, 40 + i, 3000) + " " + passage + "\n" + prose(rng, 30, 3000), "fr", f"s{i % 4}", 1) for i in range(10)]
    rows += [(70 + i, prose(rng, 200, 3000) + " É ñ 漢字 🎈 é", "es", "s3", 1) for i in range(25)]
    rows += [(100, "one two three", "en", "s1", 1), (101, "one two three", "en", "s1", 1), (102, "one two three four five", "en", "s1", 1), (103, "a " * 400, "en", "s1", 1)]
    rows += [(200, prose(rng, 40_000, 100_000), "en", "s2", 1), (201, "x" * 30_000, "en", "s2", 1), (202, "9" * 4000 + " " + "1.2." * 3000 + "a@b." * 3000 + "- " * 3000, "en", "s2", 1)]
    return [*rows, rows[-4], (70, base, "en", "s9", 1)]


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("extra") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
