import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and to model data river stone cloud garden signal bright copper winter engine paper silver forest little river's naïve straße".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, near copies, shared passages, repeated rows, clashing names."""
    base, shared = prose(1, 300), prose(2, 60)
    near = base.split(" ")
    near[7] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 80) + " " + shared + "\n" + prose(4, 30)), (5, shared + " tail é"),
        (6, ""), (7, None), (8, "   \n\t "), (9, "word"), (10, "Word"), (11, "WORD word"), (12, prose(5, 12_000)),
        (None, base), (None, None), (13, "a b c d e f g h i j a b c d e f g h i j"), (13, "a b c d e f g h i j a b c d e f g h i j"),
        (14, "é" * 60), (15, "x" + "é" * 60), (16, "one\none\ntwo one\n\none"), (17, "***" + prose(6, 40)), (18, "under the MIT license"), (18, "other text under one id"),
    ]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(n) for n, c in enumerate(["id", "key", "row", "digest", "block", "bucket", "word", "count", "open", "part"])})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
