import pytest
from pyspark.sql import functions as F

from lakeworks.operators import distinct as D

SETS = [["a", "b"], ["a"], ["b"], []]


def brute(rows):
    want = {}
    for a, b, key in rows:
        for i, (x, y) in enumerate(((a, b), (a, None), (None, b), (None, None))):
            if key is not None:
                want.setdefault((i, x, y), set()).add(key)
    return {k: len(v) for k, v in want.items()}


def found(df):
    return {(r["grouping"], r["a"], r["b"]): r["distinct_keys"] for r in df.collect()}


ROWS = [(f"a{i % 3}" if i % 11 else None, i % 4, (i * 7919) % 90_000 - 45_000) for i in range(3000)] + [("a0", 1, None), ("only null", 9, None)]


def test_rollups_equal_count_distinct(spark):
    df = spark.createDataFrame(ROWS * 2, "a string, b long, key long")
    bitmaps = D.key_bitmaps(df, "key", ["a", "b"])
    assert found(D.rolled_up(bitmaps, SETS)) == brute(ROWS)
    halves = [D.key_bitmaps(df.filter(F.col("b") % 2 == i), "key", ["a", "b"]) for i in range(2)]
    assert found(D.rolled_up(halves[0].unionByName(halves[1]), SETS)) == brute(ROWS)  # of two runs
    plan = D.rolled_up(bitmaps, SETS)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 3 and not any("key#" in x for x in exchanges)


@pytest.mark.parametrize("scale", [1, 10**14])
def test_dense_and_scattered_keys(spark, scale):
    rows = [(a, b, None if k is None else k * scale // 10) for a, b, k in ROWS] + [("a1", b, k) for b in range(3) for k in range(20_000)]
    df = spark.createDataFrame(rows, "a string, b long, key long")
    assert D.pays_off(df, "key", ["a", "b"]) == (scale == 1)
    assert found(D.distinct_rollup(df, "key", SETS)) == brute(rows)


def test_no_rows(spark):
    assert D.distinct_rollup(spark.createDataFrame([], "a string, b long, key long"), "key", SETS).collect() == []
