import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeworks.operators import pairing
from lakeworks.operators import quality as Q
from lakeworks.queries import QUERIES


def passed(df):
    return {r["metric"]: r["passed"] for r in df.collect()}


def test_column_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "z"), (None, "z")], "k long, v string")
    assert [tuple(r) for r in Q.duplicated(df, ["k"]).collect()] == [(1, 2)]
    assert {r["column"]: r["failures"] for r in Q.nulls(df, ["k", "v"]).collect()} == {"k": 2, "v": 1}
    assert Q.unaccepted(df, {"v": ["a", "b"]}).first()["failures"] == 2
    rows = {(r["assertion"], r["column"]): r["failures"] for r in Q.assertions(df, ["k"], ["v"]).collect()}
    assert rows == {("unique", "k"): 2, ("not_null", "v"): 1}


def test_counts_and_tolerance(spark):
    base = spark.range(10000)
    assert passed(Q.row_count(base, spark.range(9990))) == {"rows": True}
    assert passed(Q.row_count(base, spark.range(9989))) == {"rows": False}
    assert passed(Q.row_count(spark.range(0), spark.range(0))) == {"rows": True}
    row = Q.row_count(spark.range(0), spark.range(5)).first()
    assert row["diff"] == 1.0 and not row["passed"]
    assert Q.key_duplicates(base.withColumn("g", F.col("id") % 10), ["g"]).first()["duplicates"] == 9990


def test_metric_sums_with_a_zero_base(spark):
    zero = spark.createDataFrame([(0.0, 5.0)], "a double, b double")
    other = spark.createDataFrame([(1.0, 5.0)], "a double, b double")
    rows = {r["metric"]: (r["diff"], r["passed"]) for r in Q.metric_sums(zero, other, ["a", "b"]).collect()}
    assert rows == {"a": (1.0, False), "b": (0.0, True)}


def test_null_rates_and_ranges(spark):
    base = spark.createDataFrame([(i, None if i < 2 else "x") for i in range(100)], "i long, v string")
    near = spark.createDataFrame([(i, None if i < 6 else "x") for i in range(100)], "i long, v string")
    far = spark.createDataFrame([(i, None if i < 9 else "x") for i in range(100)], "i long, v string")
    assert passed(Q.null_rates(base, near)) == {"i": True, "v": True}
    assert passed(Q.null_rates(base, far))["v"] is False
    assert passed(Q.date_ranges(base, far.filter("i < 99"), ["i"])) == {"i.min": True, "i.max": False}


def test_distribution_sees_values_of_either_side(spark):
    base = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, "v string")
    other = spark.createDataFrame([("a",)] * 50 + [("c",)] * 50, "v string")
    assert passed(Q.distribution(base, other, "v")) == {"a": False, "b": False, "c": False}


def test_many_tests_read_each_side_twice(spark, folder):
    rows = [(i, f"v{i % 7}", None if i % 5 == 0 else float(i), datetime(2024, 1 + i % 12, 1)) for i in range(200)]
    schema = "k long, v string, x double, at timestamp"
    for name, kept in (("a", rows), ("b", rows[:190])):
        spark.createDataFrame(kept, schema).write.parquet(f"{folder}/{name}")
    a, b = (spark.read.parquet(f"{folder}/{n}") for n in "ab")
    aggregates = [Q.rows_check(), Q.distinct_check(["k", "v"]), Q.sums_check(["x"]), Q.stats_check(["x"]), Q.null_rates_check(["k", "x"]), Q.null_counts_check(["x"]), Q.ranges_check(["at"])]
    by_value = [Q.temporal_check("at"), Q.partitions_check("v")]
    fused = Q.parity(a, b, [(c, "HIGH") for c in aggregates + by_value])
    assert str(fused._jdf.queryExecution().optimizedPlan()).count("Relation [") == 4
    top = Q.distribution_check("v", 3)
    every = Q.parity(a, b, [(c, "LOW") for c in [*aggregates, top, *by_value]])
    assert str(every._jdf.queryExecution().optimizedPlan()).count(f"Relation [k") == 2  # counts of values are settled before
    single = [
        Q.row_count(a, b), Q.distinct_count(a, b, ["k", "v"]), Q.metric_sums(a, b, ["x"]), Q.metric_stats(a, b, ["x"]), Q.null_rates(a, b, ["k", "x"]),
        Q.null_counts(a, b, ["x"]), Q.temporal(a, b, "at"), Q.partition_counts(a, b, "v"), Q.distribution(a, b, "v", 3),
    ]
    want = sorted(str(tuple(r)) for df in single for r in df.collect())
    got = every.filter("test <> 'date_range'").select(*Q.PARITY)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    ranges = {r["metric"]: (r["base_text"], r["other_text"], r["passed"], r["priority"]) for r in every.filter("test = 'date_range'").collect()}
    assert ranges == {m: (d, d, True, "LOW") for m, d in (("at.min", "2024-01-01 00:00:00"), ("at.max", "2024-12-01 00:00:00"))}


def test_values_that_are_null_or_missing_on_a_side(spark):
    base = spark.createDataFrame([("a",), (None,), (None,)], "v string")
    other = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    rows = {r["metric"]: (r["base"], r["other"]) for r in Q.partition_counts(base, other, "v").collect()}
    assert rows == {"a": (1.0, 1.0), "b": (0.0, 1.0), None: (2.0, 1.0)}
    assert {r["metric"] for r in Q.distribution(base, other, "v").collect()} == {"a", "b", None}
    assert Q.distribution(base.limit(0), other.limit(0), "v").count() == 0


def test_decision(spark):
    schema = "priority string, passed boolean"
    ten = [("HIGH", True)] * 10

    def decide(rows):
        return Q.decision(spark.createDataFrame(rows, schema)).first()["decision"]

    assert decide([("CRITICAL", True), *ten]) == "APPROVED"
    assert decide([("CRITICAL", False), *ten]) == "NOT READY"
    assert decide([("CRITICAL", True), *ten[:9], ("HIGH", False)]) == "NOT READY"  # nine tenths is not above
    assert decide([("CRITICAL", True)]) == "APPROVED"


@pytest.mark.parametrize("copies", [0, 3, 500])
def test_result_compare(spark, copies):
    rows = [(i % 7, float(i), f"t{i % 3}") for i in range(40)] + [(1, 1.0, "same")] * copies
    a = spark.createDataFrame(rows, "k long, x double, t string")
    shuffled = spark.createDataFrame(rows[::-1], "k long, x double, t string")
    assert Q.result_compare(a, shuffled).first()["equal"]
    assert Q.result_compare(a, shuffled.withColumn("x", F.col("x") * (1 + 1e-9))).first()["equal"]
    off = Q.result_compare(a, shuffled.withColumn("x", F.col("x") + 0.5)).first()
    assert not off["equal"] and off["different"] == len(rows)
    fewer = Q.result_compare(a, spark.createDataFrame(rows[:-1], a.schema)).first()
    assert fewer["base_only"] == 1 and fewer["other_only"] == 0 and not fewer["equal"]
    nulls = spark.createDataFrame([(None, None, None)], a.schema)
    assert Q.result_compare(nulls, nulls).first()["equal"]
    assert not Q.result_compare(nulls, spark.createDataFrame([(None, 1.0, None)], a.schema)).first()["equal"]


def test_equal_rows_pair_first(spark):
    a = spark.createDataFrame([("k", 1.0, 5.0), ("k", 1.0, 3.0)], "k string, x double, y double")
    b = spark.createDataFrame([("k", 1.0, 5.0), ("k", 1.0000001, 3.0)], "k string, x double, y double")
    assert Q.result_compare(a, b).first()[:] == (2, 0, 0, 0, True)
    c = b.unionByName(spark.createDataFrame([("k", 2.0, 9.0), ("z", 1.0, 1.0)], b.schema))
    assert Q.result_compare(a, c).first()[:] == (2, 0, 0, 2, False)


def test_as_many_rows_pair_as_can(spark):
    """Each row has a partner, but not the one that sorting by the first number would give it."""
    schema = "x double, y double"
    a = spark.createDataFrame([(1.0, 5.0), (1.0000001, 3.0)], schema)
    b = spark.createDataFrame([(1.0000001, 5.0), (1.0, 3.0)], schema)
    assert Q.result_compare(a, b).first()[:] == (2, 0, 0, 0, True)
    c = spark.createDataFrame([(1.0, 5.0), (1.0000001, 4.0)], schema)
    assert Q.result_compare(a, c).first()[:] == (2, 1, 0, 0, False)
    inf, nan = float("inf"), float("nan")
    odd = [(inf, 1.0), (-inf, 1.0), (nan, 1.0), (None, 1.0), (0.0, 1.0), (-0.0, 1.0)]
    mixed = spark.createDataFrame(odd, schema)
    assert Q.result_compare(mixed, spark.createDataFrame(odd[::-1], schema)).first()[:] == (6, 0, 0, 0, True)
    assert Q.result_compare(mixed, mixed.fillna(0.0)).first()[:] == (4, 0, 2, 2, False)


def test_a_value_repeated_very_often_stays_one_row(spark):
    many = spark.range(200_000).select(F.lit(1.0).alias("x"), F.lit("k").alias("k"))
    near = many.select(F.when(F.rand(1) < 0.5, 1.0).otherwise(1.0 + 1e-9).alias("x"), "k").unionByName(spark.createDataFrame([(3.0, "k")], "x double, k string"))
    assert Q.result_compare(many, near).first()[:] == (200_000, 0, 0, 1, False)


def test_the_compared_facts_share_their_shuffles(spark, folder, monkeypatch):
    """Each table is shuffled once for both sides, and the fact once on its way to the customers."""
    n = spark.range(700)
    n.selectExpr("id % 50 AS c_custkey", "'Customer#1' AS c_name", "1 AS c_nationkey").distinct().write.parquet(f"{folder}/customer.parquet")
    n.selectExpr(
        "id AS o_orderkey", "id % 60 AS o_custkey", "'F' AS o_orderstatus", "id * 1.5D AS o_totalprice", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority"
    ).write.parquet(f"{folder}/orders.parquet")
    lines = n.selectExpr("id % 350 AS l_orderkey", "1 AS l_linenumber", "id % 9 AS l_partkey", "id % 5 AS l_quantity", "id * 0.01D AS l_extendedprice")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    assert QUERIES["result_compare"](spark, folder).first()[:] == (690, 12, 10, 8, False)
    monkeypatch.setattr(Q, "result_compare", lambda a, b: a.unionByName(b))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = QUERIES["result_compare"](spark, folder)
        assert both.count() == 700 + 690 + 8
        both.collect()
        final = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    made = [x for x in final.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert len(made) == 4, final


def brute_pairs(a, b, relative, absolute):
    """Largest matching by trying every partner."""
    def fits(x, y):
        return all(abs(p - q) <= max(relative * max(abs(p), abs(q)), absolute) for p, q in zip(x, y))

    def best(rest, free):
        if not rest:
            return 0
        most = best(rest[1:], free)
        for j in free:
            if fits(rest[0], b[j]):
                most = max(most, 1 + best(rest[1:], free - {j}))
        return most

    return best(a, frozenset(range(len(b))))


def test_most_pairs_by_brute_force():
    rng = random.Random(8)
    for trial in range(400):
        k = rng.choice([1, 2, 3])
        scale, relative, absolute = rng.choice([(1, 0.0, 1.0), (1, 0.3, 0.1), (-1, 0.3, 0.1)])
        make = lambda n: [tuple(float(scale * rng.randrange(0, 5)) for _ in range(k)) for _ in range(n)]
        a, b = make(rng.randrange(0, 6)), make(rng.randrange(0, 6))
        sides = []
        for rows in (a, b):
            counts = sorted(Counter(rows).items())
            sides += [[v for v, _ in counts], [n for _, n in counts]]
        assert pairing.most_pairs(*sides, relative, absolute) == brute_pairs(a, b, relative, absolute), (a, b, relative, absolute)


def test_compare_by_brute_force_in_ranges(spark):
    rng = random.Random(9)
    make = lambda n: [(rng.choice("pq"), float(rng.randrange(30)), float(rng.randrange(3))) for _ in range(n)]
    a, b = make(60), make(55)
    got = Q.result_compare(spark.createDataFrame(a, "k string, x double, y double"), spark.createDataFrame(b, "k string, x double, y double"), 0.0, 1.0).first()
    paired = matched = 0
    for k in "pq":
        sides = []
        for rows in (a, b):
            counts = sorted(Counter(r[1:] for r in rows if r[0] == k).items())
            sides += [[v for v, _ in counts], [n for _, n in counts]]
        paired += min(sum(sides[1]), sum(sides[3]))
        matched += pairing.most_pairs(*sides, 0.0, 1.0)
    assert (got["compared"], got["different"]) == (paired, paired - matched)


def test_ordered_compare_pairs_in_the_given_order(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 6.0)], "rank long, x double")
    b = spark.createDataFrame([(1, 6.0), (2, 5.0)], "rank long, x double")
    assert Q.result_compare(a, b, order=["rank"]).first()["different"] == 2


def test_ns_fidelity(spark):
    exact = spark.createDataFrame([(1, 1_700_000_000_123_456_789), (2, 1_700_000_000_000_000_000)], "k long, ns long")
    cut = exact.withColumn("ns", F.col("ns") - F.col("ns") % 1000)
    assert tuple(Q.ns_fidelity(exact, exact, "k", "ns").first()) == (2, 0, 1, 1)
    assert tuple(Q.ns_fidelity(exact, cut, "k", "ns").first()) == (2, 1, 1, 0)


def test_profile_of_every_type_in_one_pass(spark, folder):
    day, at = date(2024, 1, 1), datetime(2024, 1, 1, 12)
    rows = [(i, Decimal(i) / 4, day + timedelta(i), at + timedelta(hours=i), i % 3 == 0, f"v{i % 4}" * (1 + i % 2), bytes(i % 5), [i], {"a": i}, None) for i in range(41)]
    schema = "n int, d decimal(9,2), day date, at timestamp, b boolean, s string, raw binary, list array<int>, m map<string, int>, none string"
    spark.createDataFrame(rows, schema).write.parquet(folder)
    df = Q.table_profile(spark.read.parquet(folder))
    assert str(df._jdf.queryExecution().optimizedPlan()).count("Relation [") == 1
    got = {r["column"]: r for r in df.collect()}
    assert list(got) == [f.split()[0] for f in schema.split(", ") if not f.startswith("int>")]
    assert got["d"]["mean"] == 5.0 and got["d"]["greatest"] == "10.00" and got["n"]["quartiles"] == ["10", "20", "30"]
    assert got["day"]["quartiles"] == ["2024-01-11", "2024-01-21", "2024-01-31"] and got["at"]["quartiles"][1] == "2024-01-02 08:00:00"
    assert got["b"]["frequent"] == [("false", 27), ("true", 14)] and (got["s"]["shortest"], got["s"]["longest"]) == (2, 4) and got["raw"]["longest"] == 4
    assert got["m"]["rows"] == 41 and got["m"]["least"] is None and got["none"]["null_ratio"] == 1.0 and got["none"]["frequent"] == []


def test_profile_and_descriptions(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "x") for i in range(100)], "n long, s string")
    rows = {r["column"]: r for r in Q.table_profile(df).collect()}
    assert rows["s"]["null_ratio"] == 0.25 and rows["s"]["mean"] is None and rows["n"]["quartiles"][1] in ("49", "50")
    assert rows["s"]["frequent"] == [("x", 75)] and (rows["s"]["shortest"], rows["s"]["longest"]) == (1, 1) and rows["n"]["longest"] is None
    assert 0 < Q.table_profile(df, sample=50, columns=["n"]).first()["rows"] < 100
    described = Q.merge_descriptions(df, {"n": "number"})
    again = Q.merge_descriptions(described, {"n": "changed", "s": "text"})
    assert Q.descriptions_of(again) == {"n": "number", "s": "text"}
    assert Q.descriptions_of(Q.merge_descriptions(described, {"n": "changed"}, overwrite=True))["n"] == "changed"
    problems = Q.schema_problems(df, df.withColumn("n", F.col("n").cast("string")).drop("s").withColumn("z", F.lit(1)))
    assert {(r["column"], r["problem"]) for r in problems.collect()} == {("n", "type"), ("s", "missing"), ("z", "extra")}
    assert Q.width(df, ["n", "s"]) == (2, 2, True) and Q.width(df, ["n"])[2] is False
