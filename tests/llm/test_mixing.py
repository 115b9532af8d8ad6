from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lakeworks.llm import mixing as X

from .fixtures import SCHEMA, awkward, awkward_rows


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 500, "b": 3, "c": 497}, {"a": 7, "b": 5, "c": 3, None: 2, "e": 1}, {str(i): i % 13 + 1 for i in range(40)}])
def test_every_prefix_stays_within_a_block(weights):
    slots, total = X.period(weights), sum(weights.values())
    ran = Counter()
    for t, s in enumerate(slots, 1):
        ran[s] += 1
        assert all(abs(ran[k] - Fraction(w * t, total)) < 1 for k, w in weights.items())
    assert ran == Counter(weights)


def test_phases_place_every_block_once():
    blocks, weights = {"a": 100, "b": 7, "c": 33, "d": 1}, {"a": 2, "b": 5, "c": 3, "d": 1}
    plan = X.phases(blocks, weights)
    assert sum(p["length"] for p in plan) == sum(blocks.values()) and [set(p["weights"]) for p in plan][-1] == {"a"}
    assert [p["start"] for p in plan] == [sum(q["length"] for q in plan[:i]) for i in range(len(plan))]


def check(rows, sources, block_rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    assert {s: len(v) for s, v in by_source.items()} == Counter(sources)
    slots = {}
    for s, own in by_source.items():
        sizes = Counter(r["block"] for r in own)
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(n == block_rows for b, n in sizes.items() if b + 1 < len(sizes))
        for r in own:
            assert slots.setdefault(r["slot"], (s, r["block"], r["phase"], r["weight"])) == (s, r["block"], r["phase"], r["weight"])
            assert r["release"] <= r["slot"] < r["deadline"]
    assert sorted(slots) == list(range(len(slots)))
    assert len({r["position"] for r in rows}) == len(rows)
    # Less than one block off the target at every slot, within each phase.
    for phase in {x[2] for x in slots.values()}:
        run = [slots[t] for t in sorted(slots) if slots[t][2] == phase]
        # A source of small weight need not run in a short phase.
        weights = {s: own[0]["weight"] for s, own in by_source.items() if any(r["phase"] >= phase for r in own)}
        ran = Counter()
        for t, x in enumerate(run, 1):
            ran[x[0]] += 1
            assert all(abs(ran[s] - Fraction(w * t, sum(weights.values()))) < 1 for s, w in weights.items())


def test_awkward_rows(spark):
    rows = X.mixed(awkward(spark), block_rows=3).collect()
    check(rows, [r[3] for r in awkward_rows()], 3)
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in awkward_rows())


def test_given_weights_and_a_hot_source(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'x' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 11) END AS source")
    weights = {"hot": 1, **{f"s{i}": i + 1 for i in range(11)}}
    rows = X.mixed(docs, weights, block_rows=4).collect()
    check(rows, ["hot" if i % 3 == 0 else f"s{i % 11}" for i in range(2000)], 4)
    assert {r["source"]: r["weight"] for r in rows} == weights
    with pytest.raises(ValueError):
        X.mixed(docs, {"hot": 1})


def test_stage_is_ordered_and_whole(spark, folder):
    rows = [r for r in awkward_rows()]
    docs = awkward(spark, rows)
    X.in_mixed_order(docs, block_rows=3).write.parquet(folder)
    back = spark.read.parquet(folder).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    assert spark.read.parquet(folder).columns == docs.columns
    got = [(r["doc_id"], r["source"]) for r in back.orderBy("file", "at").collect()]
    assert Counter(got) == Counter((r[0], r[3]) for r in rows)
    # Every source is less than a block off its target at every slot, however many rows share a doc_id.
    weights = {r["source"]: r["weight"] for r in X.mixed(docs, block_rows=3).collect()}
    ran, total = Counter(), sum(weights.values())
    first_to_end = min(-(-n // 3) * total // weights[s] for s, n in Counter(s for _, s in got).items())
    for t in range(first_to_end // 2):
        ran[got[3 * t][1]] += 1
        assert len({s for _, s in got[3 * t : 3 * t + 3]}) == 1
        assert all(abs(ran[s] - Fraction(w * (t + 1), total)) < 1 for s, w in weights.items())


def test_rows_without_a_doc_id_are_mixed(spark, folder):
    rows = [(None, "x", "en", "ab"[i % 2], i) for i in range(4000)] + [(7, "x", "en", "a", 1)] * 80
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/in")
    X.in_mixed_order(spark.read.parquet(f"{folder}/in")).write.parquet(f"{folder}/out")
    back = spark.read.parquet(f"{folder}/out").withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    got = [r["source"] for r in back.orderBy("file", "at").collect()]
    assert Counter(got) == Counter(r[3] for r in rows)
    blocks = [got[i : i + 8] for i in range(0, 3200, 8)]
    assert all(len(set(b)) == 1 for b in blocks)
    weights = X.tempered({"a": 2080, "b": 2000})
    share = Fraction(weights["a"], sum(weights.values()))
    assert all(abs(sum(b[0] == "a" for b in blocks[:t]) - t * share) < 1 for t in range(1, len(blocks)))
    # Copies of one doc_id are spread over the mix, too.
    assert max(i for i, r in enumerate(back.orderBy("file", "at").collect()) if r["doc_id"] == 7) < len(got)


def test_no_python_in_the_plan(spark):
    plan = X.mixed(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert X.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert X.in_mixed_order(spark.createDataFrame([], SCHEMA)).collect() == []
