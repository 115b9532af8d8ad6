"""Contract metrics and the twelve gold questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distinct
from ..plans import metrics as MT
from ..plans.metrics import Contract, Dimension, Filter, Join, Metric, Table
from . import mapping as S
from .models_q import fsum
from .registry import Tables, query, with_sql

ANY = ("=", "IN")
ORDERS = Contract(
    "shop_orders",
    tables={
        "users": Table("id"),
        "orders": Table("order_id", {"user_id": "users.id"}),
        "order_items": Table("id", {"order_id": "orders.order_id"}),
    },
    joins={
        "users__orders": Join("users", "id", "orders", "user_id"),
        "orders__order_items": Join("orders", "order_id", "order_items", "order_id"),
    },
    dimensions={
        "user_id": Dimension("users", "id"),
        "order_status": Dimension("orders", "status"),
        "country": Dimension("users", "country"),
    },
    metrics={
        "completed_orders": Metric(
            "count_distinct",
            "orders",
            "order_id",
            required_filters=[Filter("orders.status", "=", "Complete")],
            allowed_dimensions=["order_status", "country"],
            allowed_filters={"order_status": ANY, "country": ANY},
            join_path=["users__orders"],
        ),
        "completed_revenue": Metric(
            "sum",
            "order_items",
            "sale_price",
            required_filters=[Filter("order_items.status", "=", "Complete")],
            allowed_dimensions=["user_id", "country"],
            allowed_filters={"user_id": ANY, "country": ANY},
            join_path=["orders__order_items", "users__orders"],
        ),
        "average_order_value": Metric(
            "ratio",
            "order_items",
            "sale_price",
            per="order_id",
            required_filters=[Filter("order_items.status", "=", "Complete")],
            allowed_dimensions=["country"],
            allowed_filters={"country": ANY},
            join_path=["orders__order_items", "users__orders"],
        ),
        "top_users": Metric(
            "sum",
            "order_items",
            "sale_price",
            required_filters=[Filter("order_items.status", "=", "Complete")],
            required_dimensions=["user_id"],
            allowed_dimensions=["user_id", "country"],
            allowed_filters={"user_id": ANY, "country": ANY},
            join_path=["orders__order_items", "users__orders"],
            descending=True,
            limit=10,
        ),
    },
)
STOCK_DIMENSIONS = ["product_category", "product_brand", "distribution_center"]
INVENTORY = Contract(
    "shop_inventory",
    tables={
        "centers": Table("id"),
        "products": Table("id", {"distribution_center_id": "centers.id"}),
        "inventory_items": Table("id", {"product_id": "products.id"}),
    },
    joins={
        "centers__products": Join("centers", "id", "products", "distribution_center_id"),
        "products__inventory_items": Join("products", "id", "inventory_items", "product_id"),
    },
    dimensions={
        "product_category": Dimension("products", "category"),
        "product_brand": Dimension("products", "brand"),
        "distribution_center": Dimension("centers", "name"),
    },
    metrics={
        "product_count": Metric(
            "count_distinct",
            "products",
            "id",
            allowed_dimensions=STOCK_DIMENSIONS,
            allowed_filters={d: ANY for d in STOCK_DIMENSIONS},
            join_path=["centers__products"],
        ),
        "available_items": Metric(
            "count_distinct",
            "inventory_items",
            "id",
            required_filters=[Filter("inventory_items.sold_at", "IS NULL")],
            allowed_dimensions=STOCK_DIMENSIONS,
            allowed_filters={d: ANY for d in STOCK_DIMENSIONS},
            join_path=["products__inventory_items", "centers__products"],
        ),
    },
)


def order_tables(t: Tables):
    return {"users": S.users(t), "orders": S.shop_orders(t), "order_items": S.order_items(t)}


def stock_tables(t: Tables):
    return {"centers": S.centers(t), "products": S.products(t), "inventory_items": S.order_items(t)}


def orders_metric(t, name, dims=(), filters=()):
    return MT.evaluate(ORDERS, order_tables(t), name, dims, filters)


def stock_metric(t, name, dims=(), filters=()):
    return MT.evaluate(INVENTORY, stock_tables(t), name, dims, filters)


U, O, I, P, C = ("users", S.USERS), ("o", S.SHOP_ORDERS), ("i", S.ORDER_ITEMS), ("p", S.PRODUCTS), ("dc", S.CENTERS)
OU = "FROM o JOIN users u ON o.user_id = u.id"
IOU = "FROM i JOIN o ON i.order_id = o.order_id JOIN users u ON o.user_id = u.id"
DONE = "i.status = 'Complete'"
AOV = f"SELECT country, {fsum('sale_price')} / COUNT(DISTINCT i.order_id) AS average_order_value {IOU} WHERE {DONE} GROUP BY ALL"
TOP_USERS = f"SELECT u.id AS user_id, {fsum('sale_price')} AS top_users {IOU} WHERE {DONE} GROUP BY ALL ORDER BY top_users DESC, user_id LIMIT 10"
BY_COUNTRY = f"SELECT country, COUNT(DISTINCT order_id) AS completed_orders {OU} WHERE o.status = 'Complete' GROUP BY ALL"
BY_CENTER = """SELECT dc.name AS distribution_center, COUNT(DISTINCT i.id) AS available_items FROM i JOIN p ON i.product_id = p.id
JOIN dc ON p.distribution_center_id = dc.id WHERE sold_at IS NULL GROUP BY ALL"""


@query("gold_completed_orders_total", with_sql(O, body="SELECT COUNT(DISTINCT order_id) AS completed_orders FROM o WHERE status = 'Complete'"))
def _(t):
    return orders_metric(t, "completed_orders")


@query("gold_completed_orders_by_country", with_sql(O, U, body=BY_COUNTRY))
def _(t):
    return orders_metric(t, "completed_orders", ["country"])


@query(
    "gold_completed_orders_in_country",
    with_sql(O, U, body=f"SELECT COUNT(DISTINCT order_id) AS completed_orders {OU} WHERE o.status = 'Complete' AND country = 'NATION_3'"),
)
def _(t):
    return orders_metric(t, "completed_orders", filters=[Filter("country", "=", "NATION_3")])


@query("gold_completed_revenue_total", with_sql(I, body=f"SELECT {fsum('sale_price')} AS completed_revenue FROM i WHERE {DONE}"))
def _(t):
    return orders_metric(t, "completed_revenue")


@query("gold_aov_by_country", with_sql(I, O, U, body=AOV))
def _(t):
    return orders_metric(t, "average_order_value", ["country"])


@query("gold_top_users_by_revenue", with_sql(I, O, U, body=TOP_USERS))
def _(t):
    return orders_metric(t, "top_users", ["user_id"])


@query("gold_product_count_total", with_sql(P, body="SELECT COUNT(DISTINCT id) AS product_count FROM p"))
def _(t):
    return stock_metric(t, "product_count")


@query("gold_products_by_category", with_sql(P, body="SELECT category AS product_category, COUNT(DISTINCT id) AS product_count FROM p GROUP BY ALL"))
def _(t):
    return stock_metric(t, "product_count", ["product_category"])


@query("gold_category_product_count", with_sql(P, body="SELECT COUNT(DISTINCT id) AS product_count FROM p WHERE category = 'PROMO'"))
def _(t):
    return stock_metric(t, "product_count", filters=[Filter("product_category", "=", "PROMO")])


@query("gold_available_inventory_total", with_sql(I, body="SELECT COUNT(DISTINCT id) AS available_items FROM i WHERE sold_at IS NULL"))
def _(t):
    return stock_metric(t, "available_items")


@query(
    "gold_available_inventory_by_brand",
    with_sql(
        I,
        P,
        body="""SELECT brand AS product_brand, COUNT(DISTINCT i.id) AS available_items FROM i JOIN p ON i.product_id = p.id
WHERE sold_at IS NULL GROUP BY ALL ORDER BY available_items DESC, product_brand LIMIT 10""",
    ),
)
def _(t):
    rows = stock_metric(t, "available_items", ["product_brand"])
    return rows.orderBy(F.col("available_items").desc(), "product_brand").limit(10)


@query("gold_available_inventory_by_center", with_sql(I, P, C, body=BY_CENTER))
def _(t):
    return stock_metric(t, "available_items", ["distribution_center"])


@query("metric_count_distinct", with_sql(O, U, body=f"SELECT status AS order_status, country, COUNT(DISTINCT order_id) AS completed_orders {OU} WHERE o.status = 'Complete' GROUP BY ALL"))
def _(t):
    return orders_metric(t, "completed_orders", ["order_status", "country"])


@query(
    "distinct_rollup",
    """SELECT CASE WHEN GROUPING(o_orderstatus) + GROUPING(o_orderpriority) = 0 THEN 0 WHEN GROUPING(o_orderstatus) = 0 THEN 1
  WHEN GROUPING(o_orderpriority) = 0 THEN 2 ELSE 3 END AS grouping, o_orderstatus, o_orderpriority, COUNT(DISTINCT o_custkey) AS buyers
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())""",
)
def _(t):
    sets = [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], ["o_orderpriority"], []]
    return distinct.distinct_rollup(t.orders, "o_custkey", sets, "buyers")


@query("metric_sum", with_sql(I, O, U, body=f"SELECT country, {fsum('sale_price')} AS completed_revenue {IOU} WHERE {DONE} GROUP BY ALL"))
def _(t):
    return orders_metric(t, "completed_revenue", ["country"])


@query("metric_ratio", with_sql(I, body=f"SELECT {fsum('sale_price')} / COUNT(DISTINCT order_id) AS average_order_value FROM i WHERE {DONE}"))
def _(t):
    return orders_metric(t, "average_order_value")


@query(
    "metric_topn",
    with_sql(
        I,
        O,
        U,
        body=f"""SELECT u.id AS user_id, country, {fsum('sale_price')} AS top_users {IOU} WHERE {DONE} GROUP BY ALL
ORDER BY top_users DESC, user_id, country LIMIT 10""",
    ),
)
def _(t):
    return orders_metric(t, "top_users", ["user_id", "country"])


@query(
    "metric_filters",
    with_sql(
        I,
        O,
        U,
        body=f"""SELECT country, {fsum('sale_price')} AS completed_revenue {IOU} WHERE {DONE}
  AND country IN ('NATION_1', 'NATION_8', 'NATION_20') GROUP BY ALL""",
    ),
)
def _(t):
    return orders_metric(t, "completed_revenue", ["country"], [Filter("country", "IN", ["NATION_1", "NATION_8", "NATION_20"])])


@query(
    "metric_inventory",
    with_sql(
        I,
        P,
        C,
        body="""SELECT category AS product_category, brand AS product_brand, dc.name AS distribution_center,
  COUNT(DISTINCT i.id) AS available_items FROM i JOIN p ON i.product_id = p.id JOIN dc ON p.distribution_center_id = dc.id
WHERE sold_at IS NULL GROUP BY ALL""",
    ),
)
def _(t):
    return stock_metric(t, "available_items", STOCK_DIMENSIONS)


@query("metric_join_path", with_sql(I, P, C, body=BY_CENTER))
def _(t):
    # Only the ends are asked for; the product table in between comes from the relationship graph.
    return stock_metric(t, "available_items", ["distribution_center"])


@query(
    "relationship_closure",
    with_sql(
        I,
        O,
        U,
        body="SELECT 'orders__order_items,users__orders' AS joins, country, COUNT(*) AS n FROM i JOIN o ON i.order_id = o.order_id JOIN users u ON o.user_id = u.id GROUP BY country",
    ),
)
def _(t):
    path = MT.relationship_closure(ORDERS, "order_items", ["users"])
    tables, joined = order_tables(t), None
    per_order = tables["order_items"].groupBy("order_id").agg(F.count("*").alias("n"))
    sides = {"order_items": per_order, "orders": tables["orders"], "users": tables["users"]}
    for name in path:
        join = ORDERS.joins[name]
        left = sides[join.right] if joined is None else joined
        joined = left.withColumnRenamed(join.right_key, "_k").join(
            sides[join.left].withColumnRenamed(join.left_key, "_k").drop("status", "created_at"), "_k"
        ).drop("_k")
    return joined.groupBy(F.lit(",".join(path)).alias("joins"), "country").agg(F.sum("n").alias("n"))


@query("contract_validate", "SELECT 'shop_orders' AS contract, 3 AS tables, COUNT(*) AS base_rows FROM lineitem UNION ALL SELECT 'shop_inventory', 3, COUNT(*) FROM lineitem")
def _(t):
    rows = None
    for contract, tables, base in ((ORDERS, order_tables(t), "order_items"), (INVENTORY, stock_tables(t), "inventory_items")):
        MT.validate(contract)
        part = tables[base].agg(
            F.lit(contract.id).alias("contract"), F.lit(len(contract.tables)).alias("tables"), F.count("*").alias("base_rows")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows
