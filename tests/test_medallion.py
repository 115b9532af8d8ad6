from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakeworks.operators import quality
from lakeworks.plans import medallion as M


def at(text):
    return datetime.fromisoformat(text)


CUSTOMERS = [
    (1, "John", "Doe", "john.doe@example.com", "US"),
    (2, "Jane", "Smith", "jane.smith@example.com", "UK"),
    (3, "Bob", "Johnson", "bob.johnson@example.com", "CA"),
    (4, "Alice", "Williams", "alice.w@example.com", "AU"),
    (5, "Charlie", "Brown", "charlie.b@example.com", "DE"),
]
ORDERS = [
    (1001, 1, "2024-01-10 09:30:00", "completed", 150.0, "USD", "2024-01-10 09:30:00"),
    (1001, 1, "2024-01-10 09:30:00", "completed", 150.0, "USD", "2024-01-10 09:31:00"),
    (1002, 2, "2024-02-15 14:45:00", "pending", 275.5, "GBP", "2024-02-15 14:45:00"),
    (1003, 1, "2024-03-20 11:00:00", "shipped", 89.99, "USD", "2024-03-20 11:00:00"),
    (1004, 3, "2024-04-05 16:30:00", "cancelled", 420.0, "CAD", "2024-04-05 16:30:00"),
    (1005, 4, "2024-05-12 08:15:00", "completed", 199.0, "AUD", "2024-05-12 08:15:00"),
    (1005, 4, "2024-05-12 08:15:00", "completed", 199.0, "AUD", "2024-05-12 08:16:00"),
    (1006, 5, "2024-06-18 10:00:00", "processing", 550.75, "EUR", "2024-06-18 10:00:00"),
    (1007, 2, "2024-07-22 13:30:00", "completed", 325.0, "GBP", "2024-07-22 13:30:00"),
]
PRODUCTS = [
    ("PROD-001", "Wireless Headphones", "ELECTRONICS", 79.99, 150, True),
    ("PROD-002", "USB-C Cable", "ELECTRONICS", 12.99, 500, True),
    ("PROD-003", "Laptop Stand", "OFFICE", 45.0, 75, True),
    ("PROD-004", "Ergonomic Mouse", "OFFICE", 35.0, 200, True),
    ("PROD-005", "Coffee Mug", "HOME", 15.0, 1000, True),
    ("PROD-006", "Desk Lamp", "HOME", 55.0, 80, False),
    ("PROD-007", "Notebook Set", "OFFICE", 22.0, 300, True),
]
ITEMS = [
    (1, 1001, "PROD-001", 1, 79.99), (2, 1001, "PROD-002", 2, 12.99), (3, 1002, "PROD-003", 1, 45.0),
    (4, 1002, "PROD-004", 2, 35.0), (5, 1002, "PROD-005", 3, 15.0), (6, 1003, "PROD-002", 3, 12.99),
    (7, 1003, "PROD-007", 2, 22.0), (8, 1004, "PROD-001", 2, 79.99), (9, 1004, "PROD-003", 3, 45.0),
    (10, 1004, "PROD-006", 1, 55.0), (11, 1005, "PROD-004", 2, 35.0), (12, 1005, "PROD-005", 5, 15.0),
    (13, 1006, "PROD-001", 3, 79.99), (14, 1006, "PROD-003", 2, 45.0), (15, 1006, "PROD-004", 2, 35.0),
    (16, 1007, "PROD-002", 5, 12.99), (17, 1007, "PROD-007", 4, 22.0), (18, 1007, "PROD-005", 6, 15.0),
]


@pytest.fixture(scope="module")
def sources(spark):
    customers = [(*c, at("2023-01-15 10:30:00"), at("2024-06-20 14:45:00")) for c in CUSTOMERS]
    orders = [(a, b, at(c), d, e, f, at(g)) for a, b, c, d, e, f, g in ORDERS]
    products = [(*p, at("2023-01-01 00:00:00")) for p in PRODUCTS]
    return {
        "raw_customers": spark.createDataFrame(
            customers,
            "customer_id long, first_name string, last_name string, email string, country_code string, created_at timestamp, updated_at timestamp",
        ),
        "raw_orders": spark.createDataFrame(
            orders,
            "order_id long, customer_id long, order_date timestamp, status string, total_amount double, currency string, created_at timestamp",
        ),
        "raw_products": spark.createDataFrame(
            products,
            "product_id string, product_name string, category_code string, price double, stock_quantity long, is_active boolean, created_at timestamp",
        ),
        "raw_items": spark.createDataFrame(ITEMS, "line_id long, order_id long, product_id string, quantity long, unit_price double"),
    }


@pytest.fixture(scope="module")
def fact(sources):
    return M.fct_orders(
        M.stg_orders(sources["raw_orders"]),
        M.stg_customers(sources["raw_customers"]),
        M.with_line_totals(sources["raw_items"]),
    )


def test_orders_keep_the_earliest_copy(sources):
    rows = {r["order_id"]: r for r in M.stg_orders(sources["raw_orders"]).collect()}
    assert len(rows) == 7
    assert rows[1001]["created_at"] == at("2024-01-10 09:30:00")
    assert rows[1005]["created_at"] == at("2024-05-12 08:15:00")
    assert rows[1005]["order_size_category"] == "MEDIUM"
    assert rows[1006]["order_size_category"] == "ENTERPRISE"
    assert rows[1006]["total_amount_usd"] == pytest.approx(594.81)
    assert rows[1004]["status_category"] == "CANCELLED"


def test_band_edges_and_missing_values(spark):
    df = spark.createDataFrame([(50.0,), (200.0,), (500.0,), (500.01,), (None,), (49.99,)], "total_amount double")
    bands = [r[0] for r in df.select(M.order_size()).collect()]
    assert bands == ["MEDIUM", "MEDIUM", "LARGE", "ENTERPRISE", "ENTERPRISE", "SMALL"]
    prices = spark.createDataFrame([(22.0,), (35.0,), (12.99,), (15.0,), (50.0,), (100.0,)], "price double")
    assert [r[0] for r in prices.select(M.price_tier()).collect()] == ["MID_RANGE", "MID_RANGE", "BUDGET", "BUDGET", "MID_RANGE", "PREMIUM"]
    unknown = spark.createDataFrame([("lost",), (None,)], "status string")
    assert [tuple(r) for r in unknown.select(M.order_status(), M.status_category()).collect()] == [("UNKNOWN", "OTHER")] * 2


def test_fact_has_27_columns_and_7_rows(fact):
    assert len(fact.columns) == 27
    rows = {r["order_id"]: r for r in fact.collect()}
    assert len(rows) == 7
    order = rows[1002]
    assert order["total_line_items"] == 3 and order["total_units"] == 6 and order["unique_products"] == 3
    assert order["line_items_subtotal"] == pytest.approx(160.0)
    assert order["line_items_after_discount"] == pytest.approx(155.5)
    assert order["total_discount_amount"] == pytest.approx(4.5)
    assert order["discount_rate"] == pytest.approx(4.5 / 160)
    assert order["has_discount"] and not order["is_completed"]
    assert not rows[1001]["has_discount"] and rows[1001]["is_completed"]
    assert rows[1004]["is_cancelled"]


def test_order_without_items_has_zeros_and_false(sources, spark):
    orders = M.stg_orders(sources["raw_orders"])
    none = M.with_line_totals(sources["raw_items"].filter("order_id <> 1001"))
    row = M.fct_orders(orders, M.stg_customers(sources["raw_customers"]), none).filter("order_id = 1001").first()
    assert row["total_units"] == 0 and row["avg_unit_price_usd"] == 0 and row["has_discount"] is False


def test_chain_gives_the_same_fact(sources, fact):
    chain = M.fct_orders_chain(
        sources["raw_orders"], M.stg_customers(sources["raw_customers"]), M.with_line_totals(sources["raw_items"])
    )
    a, b = fact.drop("gold_loaded_at"), chain.drop("gold_loaded_at")
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    sums = quality.metric_sums(a, b, ["order_total_usd", "line_items_subtotal"])
    assert all(r["passed"] for r in sums.collect())


def test_customer_dimension(sources):
    rows = {
        r["customer_id"]: r
        for r in M.dim_customers(M.stg_customers(sources["raw_customers"]), M.stg_orders(sources["raw_orders"])).collect()
    }
    assert rows[1]["total_orders"] == 2 and rows[1]["customer_segment"] == "ACTIVE"
    assert rows[1]["lifetime_value_usd"] == pytest.approx(239.99)
    assert rows[1]["avg_order_value_usd"] == pytest.approx(119.995)
    assert rows[2]["value_tier"] == "HIGH_VALUE" and rows[2]["completed_orders"] == 1
    assert rows[4]["customer_segment"] == "NEW" and rows[4]["value_tier"] == "MEDIUM_VALUE"
    assert rows[5]["first_name"] == "CHARLIE" and rows[5]["full_name"] == "Charlie Brown" and rows[5]["country_name"] == "Germany"


def test_customer_without_orders_is_a_prospect(sources):
    orders = M.stg_orders(sources["raw_orders"]).filter("customer_id <> 3")
    row = M.dim_customers(M.stg_customers(sources["raw_customers"]), orders).filter("customer_id = 3").first()
    assert row["customer_segment"] == "PROSPECT" and row["value_tier"] == "NO_PURCHASE" and row["first_order_date"] is None


def test_product_dimension(sources):
    rows = {r["product_id"]: r for r in M.dim_products(M.stg_products(sources["raw_products"])).collect()}
    assert rows["PROD-006"]["availability_status"] == "DISCONTINUED"
    assert rows["PROD-004"]["stock_status"] == "WELL_STOCKED" and rows["PROD-003"]["stock_status"] == "IN_STOCK"
    assert rows["PROD-005"]["category_name"] == "Home & Living"


def test_models_run_in_reference_order(spark, sources, folder, fact):
    order = M.model_order(M.MODELS)
    assert order.index("stg_orders") < order.index("stg_order_items") < order.index("fct_orders")
    built = M.run_models(spark, sources, folder)
    assert built["fct_orders"].count() == 7
    assert spark.table("dim_customers").count() == 5
    assert built["stg_order_items"].filter(F.col("product_name").isNull()).isEmpty()
    with pytest.raises(KeyError):
        M.run_models(spark, {}, folder)


def test_lines_of_an_order_are_shuffled_once(spark):
    schema = "order_id long, line_id long, product_id long, quantity long, unit_price double"
    rows = [(1, 11, 5, 1, 2.0), (1, 11, 5, 1, 2.0), (1, 12, 5, 4, 1.0), (1, None, None, 1, 1.0), (1, 13, 6, None, 3.0), (None, 1, 1, 1, 1.0), (None, 2, 1, 1, 1.0), (2, None, None, 2, None)]
    found = M.order_item_summary(M.with_line_totals(spark.createDataFrame(rows, schema)))
    counts = {r["order_id"]: (r["total_line_items"], r["total_units"], r["unique_products"]) for r in found.collect()}
    assert counts == {1: (3, 7, 2), None: (2, 2, 1), 2: (0, 2, 0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == plan.count("Exchange hashpartitioning(order_id")


def test_lines_without_totals_get_them(spark):
    rows = [(1, 10, 7, 1, 2.5), (1, 11, 7, 3, 10.01), (1, 11, 8, 4, 0.3), (2, 20, None, None, 4.0), (2, None, 9, 3, None), (None, 30, 9, 3, 1.0)]
    lines = spark.createDataFrame(rows, "order_id long, line_id long, product_id long, quantity long, unit_price double")
    found = M.order_item_summary(lines)
    assert sorted(map(str, found.collect())) == sorted(map(str, M.order_item_summary(M.with_line_totals(lines)).collect()))
    first = found.filter("order_id = 1").first()
    assert (first["total_line_items"], first["unique_products"], first["subtotal"]) == (2, 2, 33.73)
