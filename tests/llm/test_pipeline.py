import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lakeworks.llm import fertility, mixing

from .fixtures import awkward, awkward_rows, texts_of
from .test_bpe import library  # noqa: F401
from .test_simhash import expected as near_expected


def brute(rows):
    """doc_ids after the first four stages, by plain loops."""
    tokenisers = fertility.Fertility(P.RANKS, P.PATTERN, P.PIECES)
    rows = [r for r, k in zip(rows, fertility.judge([r[1] or "" for r in rows], tokenisers)["kept"]) if k]
    best = {}
    for r in rows:
        key = (r[1] or "").encode().lower()
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    rows = list(best.values())
    first = {i for i, _, c in near_expected(rows) if i is None or i == c}
    return [r for r in rows if r[0] in first]


def varied(rows):
    """Awkward rows, and prose long enough for the base rules with exact and near copies."""
    prose = [(1000 + i, t, "en", s, len(t)) for i, (t, s) in enumerate(rows)]
    near = [(2000 + i, t + " end", "en", s, len(t)) for i, (t, s) in enumerate(rows[:20])]
    upper = [(3000 + i, t.upper(), "en", s, len(t)) for i, (t, s) in enumerate(rows[:20])]
    return awkward_rows() + prose + near + upper


@pytest.mark.parametrize("table", ["given", "awkward"])
def test_as_brute_force(spark, sf, library, table, folder):  # noqa: F811
    given = texts_of(sf, columns="doc_id, text, lang, source, n_chars")
    rows = given if table == "given" else varied([(r[1], r[3]) for r in given[:60]])
    docs = awkward(spark, rows)
    names = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(P.STAGES):
            assert out.columns == names
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    got = {r["doc_id"]: r for r in docs.collect()}
    want = {r[0]: r for r in brute(rows)}
    assert set(got) == set(want) and docs.count() == len(want) > 20
    for i, r in want.items():
        ids = library.encode_ordinary(r[1])
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256(r[1].encode()).hexdigest()
    mixed = spark.read.parquet(f"{folder}/3").withColumn("file", F.input_file_name()).withColumn("row_at", F.monotonically_increasing_id())
    order = [r["doc_id"] for r in mixed.orderBy("file", "row_at").collect()]
    place = {r["doc_id"]: r["position"] for r in mixing.mixed(spark.read.parquet(f"{folder}/2")).collect()}
    assert [place[i] for i in order] == sorted(place.values())


def test_run_is_the_stages_in_turn(spark, sf):
    got = {r["doc_id"] for r in P.run(spark, sf).select("doc_id").collect()}
    assert got == {r[0] for r in brute(texts_of(sf, columns="doc_id, text, lang, source, n_chars"))}
    assert [n for n, _ in P.STAGES] == ["quality_rules", "exact_duplicates", "near_duplicates", "mix", "encode"]


def test_empty_table(spark, sf):
    docs = awkward(spark, [])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []


def test_positions_are_those_of_the_mix(spark, sf):
    """The mix lies in many files of unequal size, which Spark reads in another order."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        docs = mixing.in_mixed_order(P.Tables(spark, sf).documents.repartition(7)).withColumn("text", F.expr("repeat(text, 1 + cast(doc_id % 5 as int))"))
        docs = P.written(docs, "mix")
        rows = P.encode(spark, docs, sf).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    place = {r["doc_id"]: r["position"] for r in mixing.mixed(P.Tables(spark, sf).documents).collect()}
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["position"])]
    assert order == sorted(place, key=place.get)
    assert sorted(r["position"] for r in rows) == list(range(len(place)))


def test_run_carries_the_order_of_the_mix(spark, sf):
    rows = P.run(spark, sf).select("doc_id", "position").collect()
    docs = P.Tables(spark, sf).documents
    for _, stage in P.STAGES[:3]:
        docs = P.written(stage(spark, docs, sf), "stage")
    place = {r["doc_id"]: r["position"] for r in mixing.mixed(docs).collect()}
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(place, key=place.get)
    assert len({r["position"] for r in rows}) == len(rows) == len(place)
