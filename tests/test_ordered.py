import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeworks.operators import ordered as O
from lakeworks.operators.skew import hot_keys, spread_join


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds a third of the rows and many equal values; some groups and values are NULL."""
    return spark.range(600).select(
        "id",
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 17 > 0, F.col("id") % 17).alias("g"),
        F.nullif(F.col("id") * 7919 % 23, F.lit(4)).alias("v"),
    )


@pytest.mark.parametrize("tiles", [1, 7, 10, 599, 600, 1000])
def test_ntile(rows, tiles):
    for ranges in (5, None):
        got = O.ntile(rows, tiles, ["v", "id"], "t", ranges=ranges).select("id", F.col("t").cast("int"))
        assert same(got, rows.select("id", F.ntile(tiles).over(Window.orderBy("v", "id")).alias("t")))


@pytest.mark.parametrize("ranges", [None, 1, 4, 7])
def test_group_order(rows, ranges):
    w = Window.partitionBy("g").orderBy("v", "id")
    order = O.GroupOrder(rows, ["g"], ["v", "id"], ranges=ranges)
    got = order.with_next(["id", "v"], number="seq")
    expected = rows.select(
        "*", F.row_number().over(w).cast("long").alias("seq"), F.lead("id").over(w).alias("next_id"), F.lead("v").over(w).alias("next_v")
    )
    assert same(got.select("id", "g", "v", "seq", "next_id", "next_v"), expected)
    assert same(order.numbered("seq").select("id", "seq"), expected)
    before = order.sum_before(got, "v", "b").select("id", "b")
    running = F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    assert same(before, rows.select("id", running.alias("b")))


def test_funnel_keeps_events_without_user_or_time(spark):
    from lakeworks.operators import events as E

    rows = [(None, 1, "2024-01-01 00:00:00", "a"), (None, 2, "2024-01-01 00:00:05", "b"), (7, 3, "2024-01-01 00:00:00", "a"),
            (7, 4, "2024-01-02 00:00:01", "b"), (8, 5, None, "a"), (8, 6, "2024-01-01 00:00:00", "b"), (9, 7, None, "b")]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_name string")
    events = events.withColumn("ts", F.to_timestamp("ts"))
    lead = F.lead("event_name").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    plain = events.withColumn("n", lead).selectExpr("count_if(event_name = 'a')", "count_if(event_name = 'a' AND n = 'b')").first()
    assert E.funnel(events, "a", "b").first()[:] == plain[:] == (3, 3)
    day = F.expr("INTERVAL 1 DAY")
    assert E.funnel(events, "a", "b", within=day).first()[:] == (3, 1)


def test_lists_come_in_bounded_parts(rows):
    numbered = O.GroupOrder(rows, ["g"], ["v", "id"]).numbered("seq")
    lists = O.ordered_lists(numbered, ["g"], "seq", F.col("id"), 50)
    assert lists.agg(F.max(F.size("items"))).first()[0] == 50
    parts = lists.filter("g = -1").orderBy("part").collect()
    joined = [x for p in parts for x in p["items"]]
    assert joined == [r["id"] for r in rows.filter("g = -1").orderBy("v", "id").collect()]


def test_spread_join(rows, spark):
    rows = rows.filter("g is not null")
    names = rows.select("g").distinct().withColumn("name", F.concat(F.lit("n"), "g"))
    got = spread_join(rows, names, ["g"], ["id"])
    assert same(got, rows.join(names, "g"))
    many = rows.unionByName(spark.range(600, 3000).select("id", F.col("id").alias("g"), F.lit(0).cast("long").alias("v")))
    hot = hot_keys(many.groupBy("g").agg(F.count("*").alias("n")), ["g"], "n")
    assert -1 in {r["g"] for r in hot.collect()} and hot.count() == 17
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert same(spread_join(many, names, ["g"], ["id"], how, hot=hot), many.join(names, "g", how))
    assert same(spread_join(rows, names.filter("g > 3"), ["g"], ["id"], "left_anti"), rows.join(names.filter("g > 3"), "g", "left_anti"))
    with pytest.raises(ValueError):
        spread_join(rows, names, ["g"], ["id"], "right")


def test_copies_of_one_row_spread_over_ranges(spark):
    same = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("v"))
    ranged = O.into_ranges(same, ["v"], ranges=4)
    sizes = [r["count"] for r in ranged.groupBy(O.PART).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 3000
    ranks = O.with_global_rank(same, ["v"], "rank", ranges=4)
    assert ranks.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()[:] == (4000, 1, 4000)
