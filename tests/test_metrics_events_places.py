import json
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeworks.operators import events as E
from lakeworks.operators import places as P
from lakeworks.operators import workload as W
from lakeworks.plans import metrics as MT
from lakeworks.plans.metrics import Filter
from lakeworks.queries.metrics_q import INVENTORY, ORDERS
from lakeworks.streaming import generator as G


@pytest.fixture(scope="module")
def shop(spark):
    return {
        "users": spark.createDataFrame([(1, "FR"), (2, "FR"), (3, "JP")], "id long, country string"),
        "orders": spark.createDataFrame(
            [(10, 1, "Complete"), (11, 2, "Complete"), (12, 3, "Shipped"), (13, 3, "Complete")], "order_id long, user_id long, status string"
        ),
        "order_items": spark.createDataFrame(
            [(1, 10, "Complete", 5.0), (2, 10, "Complete", 7.5), (3, 11, "Complete", 1.25), (4, 12, "Shipped", 9.0), (5, 13, "Complete", 2.0)],
            "id long, order_id long, status string, sale_price double",
        ),
    }


def metric(shop, name, dims=(), filters=()):
    return {tuple(r)[:-1]: r[-1] for r in MT.evaluate(ORDERS, shop, name, dims, filters).collect()}


def test_metrics(shop):
    assert metric(shop, "completed_orders") == {(): 3}
    assert metric(shop, "completed_orders", ["country"]) == {("FR",): 2, ("JP",): 1}
    assert metric(shop, "completed_revenue", ["country"]) == {("FR",): 13.75, ("JP",): 2.0}
    assert metric(shop, "average_order_value", ["country"]) == {("FR",): 6.875, ("JP",): 2.0}
    assert metric(shop, "completed_revenue", filters=[Filter("country", "IN", ["JP", "DE"])]) == {(): 2.0}
    assert list(metric(shop, "top_users", ["user_id"])) == [(1,), (3,), (2,)]


@pytest.mark.parametrize(
    "name, dims, filters",
    [
        ("unknown", [], []),
        ("top_users", [], []),
        ("completed_orders", ["user_id"], []),
        ("completed_orders", [], [Filter("user_id", "=", 1)]),
        ("completed_orders", [], [Filter("country", "IS NULL")]),
    ],
)
def test_requests_outside_the_contract_raise(shop, name, dims, filters):
    with pytest.raises(MT.ContractError):
        MT.evaluate(ORDERS, shop, name, dims, filters)


def test_contract_checks():
    MT.validate(ORDERS)
    MT.validate(INVENTORY)
    orders = ORDERS.tables["orders"]
    broken = [
        replace(ORDERS, tables={**ORDERS.tables, "orders": replace(orders, foreign_keys={"user_id": "users.email"})}),
        replace(ORDERS, tables={**ORDERS.tables, "orders": replace(orders, foreign_keys={"user_id": "people.id"})}),
        replace(ORDERS, joins={**ORDERS.joins, "x": MT.Join("users", "id", "nowhere", "id")}),
        replace(ORDERS, joins={**ORDERS.joins, "x": MT.Join("users", "id", "orders", "user_id", "many_to_many")}),
        replace(ORDERS, dimensions={**ORDERS.dimensions, "x": MT.Dimension("nowhere", "c")}),
        replace(ORDERS, metrics={"x": MT.Metric("sum", "orders", "c", allowed_dimensions=["nowhere"])}),
        replace(ORDERS, metrics={"x": MT.Metric("median", "orders", "c")}),
        replace(ORDERS, metrics={"x": MT.Metric("sum", "orders", "c", join_path=["nowhere"])}),
    ]
    for contract in broken:
        with pytest.raises(MT.ContractError):
            MT.validate(contract)


def test_relationship_closure():
    assert MT.relationship_closure(ORDERS, "order_items", ["users"]) == ("orders__order_items", "users__orders")
    assert MT.relationship_closure(ORDERS, "users", ["users"]) == ()
    assert MT.relationship_closure(ORDERS, "users", []) == ()
    assert MT.relationship_closure(ORDERS, "orders", ["users", "order_items"]) == ("orders__order_items", "users__orders")
    with pytest.raises(MT.ContractError):
        MT.relationship_closure(ORDERS, "order_items", ["users"], usable=["users__orders"])


def test_join_tree_takes_the_shortest_way_and_the_first_name():
    def join(left, right):
        return MT.Join(left, "k", right, "k", "many_to_one")

    joins = {"a": join("t1", "t2"), "b": join("t2", "t3"), "c": join("t1", "t3"), "d": join("t3", "t4"), "e": join("t1", "t3"), "f": join("t8", "t9")}
    tree = MT.join_tree(MT.Contract("x", {}, joins, {}, {}), "t1")
    assert tree == {"t1": None, "t2": ("a", "t1"), "t3": ("c", "t1"), "t4": ("d", "t3")}


START = datetime(2024, 1, 1, 22)


def stream(spark, rows):
    full = [(i, u, START + timedelta(hours=h), name) for i, (u, h, name) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, user_id long, ts timestamp, event_name string")


def test_funnel_crosses_midnight_and_keeps_users_apart(spark):
    rows = [(1, 0, "a"), (1, 30, "b"), (1, 31, "a"), (1, 31.5, "x"), (1, 32, "b"), (2, 1, "a"), (3, 2, "b"), (2, 60, "a"), (2, 61, "b")]
    events = stream(spark, rows)
    assert tuple(E.funnel(events, "a", "b").first()) == (4, 3)
    assert tuple(E.funnel(events, "a", "b", F.expr("INTERVAL 1 HOUR")).first()) == (4, 0)
    assert tuple(E.funnel(events, "a", "b", F.expr("INTERVAL 61 MINUTE")).first()) == (4, 2)


def test_retention_counts_whole_days(spark):
    events = stream(spark, [(1, 0, "a"), (1, 23.9, "a"), (1, 24, "a"), (2, 5, "a"), (2, 5 + 24 * 7, "a"), (3, 1, "a"), (3, 1 + 24 * 31, "a")])
    curve = E.retention_curve(events)
    assert {r["days_since_first"]: r["active_users"] for r in curve.collect()} == {0: 3, 1: 1, 7: 1}
    assert tuple(E.retention_rates(curve).first()) == (pytest.approx(33.3333), pytest.approx(33.3333), 0.0)


def test_sessions(spark):
    events = stream(spark, [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "a")])
    events = events.withColumn("session_id", F.when(F.col("event_id") < 2, 7).when(F.col("user_id") == 2, None).otherwise(8))
    row = E.engagement(events).collect()
    assert len(row) == 1 and row[0]["total_sessions"] == 2 and row[0]["avg_session_duration_sec"] == 1800.0
    assert row[0]["engagement_score"] == 2 * 1.5 * 1800
    assert tuple(E.session_conversion(events, "a", "b").first()) == (2, 1, 0.5)
    scores = spark.createDataFrame([(0.0,), (0.1,), (1e4,), (5e4,), (1e5,), (1e5 + 1,), (None,)], "s double")
    levels = [r[0] for r in scores.select(E.engagement_level(F.col("s"))).collect()]
    assert levels == [None, "Low", "Low", "Medium", "High", "Very High", None]


def test_small_groups_are_hidden(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)] * 4, "g string, v int")
    assert [tuple(r) for r in P.thresholded(df, ["g"], n=F.count("*")).collect()] == [("a", 5)]
    assert P.thresholded(df.filter("g = 'b'"), [], n=F.count("*")).isEmpty()


def test_places(spark):
    slot = [("08:00:00", "17:00:00")]
    rows = [(["bank"], 4.5, {"monday": slot, "saturday": [], "sunday": None})] * 5 + [(["bank", "atm"], 3.4, {"monday": [("08:00:01", "16:59:59")], "saturday": slot, "sunday": [(None, None)]})] * 5
    slots = "array<struct<start_time string, end_time string>>"
    df = spark.createDataFrame(rows, f"types array<string>, rating double, hours struct<monday {slots}, saturday {slots}, sunday {slots}>")
    row = P.opening_hours(df).first()
    assert (row["total_places"], row["saturday_service"], row["sunday_service"], row["early_opening"], row["late_closing"]) == (10, 5, 0, 5, 5)
    assert row["open_business_hours"] == 5 and row["saturday_pct"] == 50.0
    assert df.agg(P.count_kind("atm"), P.excellent()).first()[:] == (5, 5)
    grid = P.with_cell(spark.createDataFrame([(-6.2049, 106.805)], "lat double, lon double")).first()
    assert (grid["cell_lat"], grid["cell_lon"]) == (-620, 10680)


def test_workload_guards(spark):
    hours = spark.createDataFrame([(0.0,)] * 3 + [(2.0,)], "slots double")
    row = W.variability(W.slot_distribution(hours)).first()
    assert row["burst_ratio"] is None and row["burst_class"] == "Undefined" and row["cv_class"] == "Highly variable"
    timeline = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), 3_600_000), (datetime(2024, 1, 1, 3), 7_200_000)], "second timestamp, slot_ms long")
    assert [r["slots"] for r in W.hourly_slots(timeline).orderBy("hour").collect()] == [1.0, 0.0, 0.0, 2.0]


def test_generated_rows(spark):
    rows = G.transactions(spark.range(3).select(F.col("id").alias("value"), F.current_timestamp().alias("timestamp")))
    assert len(rows.columns) == 14
    first = rows.orderBy("transaction_id").first()
    assert first["transaction_id"] == "000000000000-00000000-0000-0000-0000-000000000000"
    assert 4000 < len(rows.filter("customer_id = 2").first()["shipping_address"])  # grows to about five with longer numbers
    assert G.rate_stream(spark, 5).isStreaming and G.transactions(G.rate_stream(spark, 5)).isStreaming


def test_wide_rows_fill_only_their_own_group(spark):
    source = spark.range(120).select("id", F.lit(datetime(2024, 1, 1)).alias("at"))
    wide = G.wide_messages(source, "id", "at")
    assert wide.columns == G.wide_columns() and len(wide.columns) == 428
    rows = [r.asDict() for r in wide.collect()]
    fields = G.message_fields()
    for r in rows:
        filled = {c.split("__")[0] for c, v in r.items() if "__" in c and v is not None}
        assert filled <= {r["message_type"]}
        if int(r["message_type"][2:]) % 3 == 0:
            assert all(r[f"{r['message_type']}__{f}"] is not None for f in fields if f != G.TIME_FIELD)
    # Time columns are the sparsest: about four in ten of every third group, hardly any elsewhere.
    timed = {k: [r[f"{r['message_type']}__{G.TIME_FIELD}"] is not None for r in rows if (int(r["message_type"][2:]) % 3 == 0) == k] for k in (True, False)}
    assert 0.2 < sum(timed[True]) / len(timed[True]) < 0.6 and sum(timed[False]) / len(timed[False]) < 0.1
    assert any(r["timestamp_nanos"] % 1000 for r in rows)


def test_address_metadata_is_joined_from_constant_pieces(spark):
    rows = spark.createDataFrame([(0,), (-7,), (123456789012,), (None,)], "n long").select("n", G.address_blob("n").alias("blob"))
    for r in rows.collect():
        value = (lambda i: None) if r["n"] is None else (lambda i: f"value_{r['n']}_{i}" * 20)
        metadata = {f"field_{i}": value(i) for i in range(50)}
        assert r["blob"].endswith(',"metadata":' + json.dumps(metadata, separators=(",", ":")) + "}")
        assert list(json.loads(r["blob"]))[-2:] == ["delivery_instructions", "metadata"]
    # The long text neither goes through a function per field nor through the JSON writer.
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
