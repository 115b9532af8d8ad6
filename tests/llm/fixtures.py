"""Small documents with the awkward cases every operator must stand."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
CLASHING = (
    "digest row node size keep_id kept _digest _gone _turn _place bits key u v part at number place tie turn slot "
    "shard position block score held_out terms times label slots n_words _keep_id _doc _source first_id component component_id"
).split()


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    words = "alpha beta gamma Delta naïve straße 漢字 don't 12 ½ ² foo,bar x".split()
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [None, "", " ", "\n\t ", "One two", "ONE TWO", "one two", "É", "é", "a b\x1cc", "  two  spaces \n and\nlines", long, long]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += ["same text in many rows, of five words or more"] * 30
    rows = [(i, x, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None]), None if x is None else len(x)) for i, x in enumerate(texts)]
    rows += [rows[7], rows[7], rows[40], (None, "one two", "en", None, None), (None, None, None, None, None), (20, "same doc_id, other text", "en", "a", 3)]
    return rows


def awkward(spark, rows=None):
    """With extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


def texts_of(folder: str, table: str = "documents", columns: str = "*") -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{table}.parquet'").fetchall()
