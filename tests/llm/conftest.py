import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "Of", "and", "ärmel", "zug", "x1"]) + rng.choice(["", "ing", "ed", "s"]) * rng.randrange(3) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Nulls, empty and blank texts, blanks of all kinds, copies, near copies, one very long text."""
    rng = random.Random(7)
    base = [words(rng, n) for n in (1, 2, 3, 9, 10, 11, 40, 200)]
    near = base[-1].split()
    near[50] = "changed"
    return [
        None, None, "", "", " ", "\n\t ", "a", "A", "  lead and  double space \n\n lines\r\n", "tail ", "　wide gap", "x" * 5000, "é" * 50, "it's <|endoftext|> here",
        *base, *base, base[-1] + " more", " ".join(near), base[-1].upper(), words(rng, 20_000),
    ]


@pytest.fixture(scope="session")
def odd_rows():
    rows = [(i, t, "en", ["a", "b", None, "é"][i % 4], len(t or "")) for i, t in enumerate(odd_texts())]
    return rows + [rows[20], rows[20], (None, None, None, None, None), (None, "no id", None, None, None), (None, rows[21][1], None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = ["words", "hits", "items", "__score", "key", "copy", "row", "low", "bucket", "cut", "rest", "whole", "size", "h", "target", "slot", "shard", "bin", "rank", "score", "label", "x", "digest", "group_size", "keep_id", "cls", "comp", "node", "sig", "__words", "__hits", "__items", "__source", "start", "part", "payload", "chunk_no", "ids", "a", "b", "n"]


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(1).alias(c) for c in CLASHING])
