from __future__ import annotations

import pyarrow as pa
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text) pairs, with other columns that some operator might clash with."""
    from pyspark.sql import functions as F

    def make(rows):
        d = spark.createDataFrame([(i, t, None if t is None else "en", "s0", None if t is None else len(t)) for i, t in rows], DOCS)
        for c in ("block", "key", "score", "n_tokens", "start", "h", "position", "w"):
            d = d.withColumn(c, F.lit(1))
        return d

    return make


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    """doc_id -> text of the smallest documents."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"])
    assert isinstance(t, pa.Table)
    return dict(sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))


#: Texts that every operator must take: null, empty, white space, marks, one word, repeated, very long, a run of one byte.
ODD = [
    (1, None), (2, ""), (3, "  \n "), (4, "!!! ??"), (5, "Word"), (6, "the same text here, twice over and long enough to be more than fifty bytes"),
    (7, "the same text here, twice over and long enough to be more than fifty bytes"), (8, "ab " * 40_000), (9, "x" * 70_000), (10, "é\0ü 日本 😀 \x1c\x85"), (10, "another text of doc ten"),
    (None, "a text without an id"), (6, "the same text here, twice over and long enough to be more than fifty bytes"),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([(0, "x")]).where("false")
