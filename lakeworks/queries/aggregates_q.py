"""Shop reports, top-k results and analyst features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import commerce as C
from ..operators import dedup
from . import mapping as S
from .models_q import fsum
from .registry import Tables, query, with_sql

AS_OF = "2001-12-31 00:00:00"
ITEMS = ("items", S.ORDER_ITEMS)
PRODUCTS = ("products", S.PRODUCTS)
ORDERS = ("shop_orders", S.SHOP_ORDERS)
USERS = ("users", S.USERS)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


DAILY_REVENUE = """
WITH per_order AS (
  SELECT l_orderkey AS order_id, CAST(l_shipdate AS DATE) AS order_date,
    SUM(CAST(l_extendedprice * 100 AS BIGINT)) AS cents, COUNT(*) AS item_count
  FROM lineitem GROUP BY ALL)
SELECT CAST(order_date AS VARCHAR) AS order_date, n_name AS country, c_mktsegment AS gender,
  CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'O' THEN 'Shipped' ELSE 'Cancelled' END AS order_status,
  COUNT(DISTINCT order_id) AS total_orders, CAST(SUM(item_count) AS BIGINT) AS total_items,
  ROUND(SUM(cents) / 100, 2) AS total_revenue, ROUND(SUM(cents) / COUNT(*) / 100, 4) AS avg_order_value
FROM per_order JOIN orders ON order_id = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
GROUP BY per_order.order_date, n_name, c_mktsegment, o_orderstatus"""


def daily_revenue(t: Tables):
    users = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("gender")
    )
    return C.daily_revenue(S.order_items(t), S.shop_orders(t), users)


@query("daily_revenue", DAILY_REVENUE)
def _(t):
    return daily_revenue(t)


@query(
    "join_inner_using",
    """SELECT n_name AS country, o_orderstatus AS status, COUNT(*) AS items,
  SUM(CAST(l_extendedprice * 100 AS BIGINT)) / 100 AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def _(t):
    # Sum per order, then per customer, so each join moves pre-aggregated rows.
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("items"), F.sum(V.fixed_units("l_extendedprice")).alias("cents")
    )
    per_customer = (
        per_order.join(t.orders, "o_orderkey")
        .groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
        .agg(F.sum("items").alias("items"), F.sum("cents").alias("cents"))
    )
    return (
        per_customer.join(t.customer, "c_custkey")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("country"), "status")
        .agg(F.sum("items").alias("items"), (V.total_units(F.col("cents")) / 100).alias("revenue"))
    )


@query(
    "monthly_revenue",
    with_sql(
        ITEMS,
        body=f"""SELECT strftime(date_trunc('month', created_at), '%Y-%m-%d %H:%M:%S') AS month,
  COUNT(DISTINCT order_id) AS orders, {fsum('sale_price')} AS revenue FROM items GROUP BY ALL""",
    ),
)
def _(t):
    return C.monthly_revenue(S.order_items(t))


@query(
    "return_rate",
    with_sql(
        ITEMS,
        PRODUCTS,
        body="""SELECT category, ROUND(COUNT(returned_at) / COUNT(*), 4) AS return_rate
FROM items JOIN products p ON product_id = p.id GROUP BY ALL""",
    ),
)
def _(t):
    return C.return_rate(S.order_items(t), S.products(t))


@query(
    "stock_by_center",
    with_sql(
        ITEMS,
        body="""SELECT s_name AS center, COUNT(*) AS units_in_stock FROM items JOIN supplier ON center_id = s_suppkey
WHERE sold_at IS NULL GROUP BY ALL""",
    ),
)
def _(t):
    return C.stock_by_center(
        S.order_items(t), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    )


@query(
    "top_products",
    with_sql(
        ITEMS,
        PRODUCTS,
        body=f"""SELECT name, brand, category, {fsum('sale_price')} AS revenue
FROM items JOIN products p ON product_id = p.id WHERE returned_at IS NULL
GROUP BY ALL ORDER BY revenue DESC, name, brand, category LIMIT 10""",
    ),
)
def _(t):
    return C.top_products(S.order_items(t).filter(F.col("returned_at").isNull()), S.products(t))


@query(
    "top_categories",
    with_sql(
        ITEMS,
        PRODUCTS,
        body=f"""SELECT category, {fsum('sale_price')} AS revenue FROM items JOIN products p ON product_id = p.id
GROUP BY ALL ORDER BY revenue DESC, category LIMIT 5""",
    ),
)
def _(t):
    return C.top_categories(S.order_items(t), S.products(t))


@query(
    "users_by_country",
    with_sql(USERS, body="SELECT country, COUNT(*) AS users FROM users GROUP BY ALL ORDER BY users DESC, country LIMIT 10"),
)
def _(t):
    return C.users_by_country(S.users(t))


@query(
    "recent_window_filter",
    with_sql(
        ("raw_customers", S.RAW_CUSTOMERS),
        body="""SELECT country_code, COUNT(*) AS new_users FROM raw_customers
WHERE created_at >= TIMESTAMP '2023-12-31' - INTERVAL 30 DAY GROUP BY ALL""",
    ),
)
def _(t):
    newest = C.recent(S.raw_customers(t), "created_at", F.lit("2023-12-31 00:00:00").cast("timestamp_ntz"), 30)
    return newest.groupBy("country_code").agg(F.count("*").alias("new_users"))


@query(
    "longest_unsold",
    with_sql(
        ITEMS,
        body=f"""SELECT id, product_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  datediff('day', created_at, TIMESTAMP '{AS_OF}') AS age_days
FROM items WHERE sold_at IS NULL ORDER BY items.created_at, id, product_id LIMIT 5""",
    ),
)
def _(t):
    return C.longest_unsold(S.order_items(t), as_of())


@query(
    "rfm_features",
    with_sql(
        ORDERS,
        USERS,
        ("per_order", "SELECT l_orderkey, SUM(CAST(l_extendedprice * 100 AS BIGINT)) AS cents FROM lineitem GROUP BY ALL"),
        (
            "spend",
            """SELECT user_id, MAX(created_at) AS last_order, COUNT(DISTINCT order_id) AS frequency,
  COALESCE(SUM(cents), 0) / 100 AS monetary
FROM shop_orders LEFT JOIN per_order ON order_id = l_orderkey GROUP BY ALL""",
        ),
        body=f"""SELECT id AS user_id, datediff('day', last_order, TIMESTAMP '{AS_OF}') AS recency,
  COALESCE(frequency, 0) AS frequency, COALESCE(monetary, 0) AS monetary, traffic_source
FROM users LEFT JOIN spend ON id = user_id""",
    ),
)
def _(t):
    return C.rfm_features(S.users(t), S.shop_orders(t), S.order_items(t), as_of())


@query(
    "clv_top100",
    with_sql(
        ORDERS,
        ITEMS,
        body=f"""SELECT user_id, COALESCE({fsum('sale_price')}, 0) AS clv
FROM shop_orders o LEFT JOIN items i ON o.order_id = i.order_id GROUP BY ALL ORDER BY clv DESC, user_id LIMIT 100""",
    ),
)
def _(t):
    return C.customer_value(S.order_items(t), S.shop_orders(t), 100)


@query(
    "age_histogram",
    with_sql(USERS, body="SELECT CAST(floor((age - 18) / 5) + 1 AS BIGINT) AS bin, COUNT(*) AS n FROM users GROUP BY ALL"),
)
def _(t):
    return C.histogram(S.users(t), "age", 18, 78, 12)


@query("state_count", "SELECT COUNT(*) AS users FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
def _(t):
    return S.users(t).filter(F.col("country") == "NATION_7").agg(F.count("*").alias("users"))


@query(
    "order_products",
    with_sql(ITEMS, PRODUCTS, body="SELECT order_id, name AS product_name FROM items JOIN products p ON product_id = p.id"),
)
def _(t):
    return C.order_products(S.order_items(t), S.products(t))


@query(
    "fn_shipping_days",
    """WITH d AS (SELECT o_orderstatus AS status,
  CAST(trunc((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS days
FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT status, ROUND(SUM(days) / COUNT(days), 4) AS avg_shipping_days, COUNT(days) AS shipped FROM d GROUP BY ALL""",
)
def _(t):
    shipped = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return C.shipping_days(shipped.withColumnRenamed("o_orderstatus", "status"), "o_orderdate", "l_shipdate", "status")


@query(
    "topk_tiebreak",
    """SELECT o_custkey AS user_id, COUNT(*) AS orders FROM orders GROUP BY ALL ORDER BY orders DESC, user_id LIMIT 25""",
)
def _(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"))
    return dedup.top_k(counts, 25, F.col("orders").desc(), "user_id")


@query("head_n", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5")
def _(t):
    return dedup.top_k(t.customer.select("c_custkey", "c_name", "c_mktsegment"), 5, "c_custkey")


@query(
    "nulls_order",
    """SELECT p_brand, ROUND(SUM(p_size) / NULLIF(COUNT(*) FILTER (WHERE p_size > 49 AND p_type = 'PROMO'), 0), 4) AS ratio
FROM part GROUP BY ALL ORDER BY ratio DESC NULLS LAST, p_brand LIMIT 20""",
)
def _(t):
    rare = F.count_if((F.col("p_size") > 49) & (F.col("p_type") == "PROMO"))
    ratios = t.part.groupBy("p_brand").agg(F.round(V.safe_divide(F.sum("p_size"), rare), 4).alias("ratio"))
    return dedup.top_k(ratios, 20, F.col("ratio").desc_nulls_last(), "p_brand")


@query(
    "result_bound",
    """SELECT o_orderkey, o_totalprice, TRUE AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def _(t):
    rows, truncated = dedup.bounded(
        t.orders.select("o_orderkey", "o_totalprice"), 50, F.col("o_totalprice").desc(), "o_orderkey"
    )
    return rows.withColumn("truncated", F.lit(truncated))
