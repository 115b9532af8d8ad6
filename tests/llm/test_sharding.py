import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeworks.llm import sharding as X

from .fixtures import SCHEMA, awkward, awkward_rows


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4999])
def test_permutation_and_its_inverse(n):
    p = X.Permutation(n)
    assert p.height * p.width - n == p.spare < max(2, p.height)
    places = [p.place(i) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [p.number(x) for x in places] == list(range(n))


def test_walks_are_followed_and_bounded(spark):
    p = X.Permutation(1000)
    p.height, p.width = 33, 37  # many spare cells, so that walks are long
    p.spare = p.height * p.width - p.n
    got = spark.range(p.n).select("id", p.place_column(F.col("id")).alias("place")).collect()
    assert {r["id"]: r["place"] for r in got} == {i: p.place(i) for i in range(p.n)}
    assert any(p._once(i) >= p.n for i in range(p.n))


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = X.shards(awkward(spark), 7).collect()
    known = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == known
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sorted(r["number"] for r in got) == list(range(len(rows)))
    p = X.Permutation(len(rows))
    assert all(p.number(r["slot"] * 7 + r["shard"]) == r["number"] for r in got)
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["number"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_the_same_again_however_partitioned(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    one = {tuple(r) for r in X.shards(docs.repartition(1)).collect()}
    assert one == {tuple(r) for r in X.shards(docs.repartition(9)).collect()}
    other = X.shards(docs, keys=tuple(k + 1 for k in X.KEYS)).collect()
    assert one != {tuple(r) for r in other}


def test_no_python_in_the_plan(spark):
    plan = X.shards(spark.range(9).selectExpr("id AS doc_id", "'x' AS text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert X.shards(spark.createDataFrame([], SCHEMA)).collect() == []
