"""The driver tables seen through the schemas the operators expect.

Each source has a Spark form and the same rule as SQL text for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import case_map
from .registry import Tables

CURRENCIES = ["USD", "GBP", "EUR", "CAD", "AUD", "JPY"]
COUNTRIES = ["US", "UK", "CA", "AU", "DE", "FR", "JP", "BR", "MX", "IN", "ZZ"]


def _pick(values: list[str], index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- medallion sources -------------------------------------------------------------------


def raw_orders(t: Tables) -> DataFrame:
    """Orders delivered twice, the second copy a minute later."""
    pending = case_map(
        "o_orderpriority",
        {"1-URGENT": "processing", "2-HIGH": "cancelled", "3-MEDIUM": "refunded", "5-LOW": "pending"},
        "on_hold",
    )
    first = t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        case_map("o_orderstatus", {"F": "completed", "O": "shipped"}, pending).alias("status"),
        (F.floor(F.col("o_totalprice") * 100).cast("long") % 70000 / F.lit(100.0)).alias("total_amount"),
        _pick(CURRENCIES, F.col("o_custkey") % 6).alias("currency"),
        F.col("o_orderdate").alias("created_at"),
    )
    again = first.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 MINUTE"))
    return first.unionByName(again)


RAW_ORDERS = f"""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'shipped' ELSE
    CASE o_orderpriority WHEN '1-URGENT' THEN 'processing' WHEN '2-HIGH' THEN 'cancelled'
      WHEN '3-MEDIUM' THEN 'refunded' WHEN '5-LOW' THEN 'pending' ELSE 'on_hold' END END AS status,
  (CAST(floor(o_totalprice * 100) AS BIGINT) % 70000) / 100 AS total_amount,
  {_sql_list(CURRENCIES)}[o_custkey % 6 + 1] AS currency,
  o_orderdate + m * INTERVAL 1 MINUTE AS created_at
FROM orders, (SELECT unnest([0, 1]) AS m)"""


def raw_customers(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit(" "), F.substring_index("c_name", "#", 1)).alias("first_name"),
        F.concat(F.substring_index("c_name", "#", -1), F.lit(" ")).alias("last_name"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.com")).alias("email"),
        _pick(COUNTRIES, F.col("c_nationkey") % 11).alias("country_code"),
        (F.lit("2023-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 365).cast("int"))).alias(
            "created_at"
        ),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 200).cast("int"))).alias(
            "updated_at"
        ),
    )


RAW_CUSTOMERS = f"""
SELECT c_custkey AS customer_id, ' ' || split_part(c_name, '#', 1) AS first_name,
  split_part(c_name, '#', 2) || ' ' AS last_name, ' ' || c_name || '@Example.com' AS email,
  {_sql_list(COUNTRIES)}[c_nationkey % 11 + 1] AS country_code,
  TIMESTAMP '2023-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
  TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 200 AS INTEGER)) AS updated_at
FROM customer"""


def raw_products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        case_map("p_type", {"ECONOMY": "ELECTRONICS", "SMALL": "OFFICE", "LARGE": "HOME"}, F.col("p_type")).alias(
            "category_code"
        ),
        (F.floor(F.col("p_retailprice") * 100).cast("long") % 12000 / F.lit(100.0)).alias("price"),
        ((F.col("p_size") - 1) * 6).cast("long").alias("stock_quantity"),
        (F.col("p_size") % 7 != 0).alias("is_active"),
        F.lit("2023-01-01").cast("timestamp_ntz").alias("created_at"),
    )


RAW_PRODUCTS = """
SELECT p_partkey AS product_id, p_name AS product_name,
  CASE p_type WHEN 'ECONOMY' THEN 'ELECTRONICS' WHEN 'SMALL' THEN 'OFFICE' WHEN 'LARGE' THEN 'HOME' ELSE p_type END
    AS category_code,
  (CAST(floor(p_retailprice * 100) AS BIGINT) % 12000) / 100 AS price,
  CAST((p_size - 1) * 6 AS BIGINT) AS stock_quantity, p_size % 7 <> 0 AS is_active,
  TIMESTAMP '2023-01-01' AS created_at
FROM part"""


def raw_items(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_extendedprice").alias("unit_price"),
    )


RAW_ITEMS = """
SELECT l_orderkey * 10 + l_linenumber AS line_id, l_orderkey AS order_id, l_partkey AS product_id,
  CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS unit_price
FROM lineitem"""

# --- shop tables -------------------------------------------------------------------------


def users(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", F.col("n_name").alias("country"))
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        "country",
        F.col("c_mktsegment").alias("traffic_source"),
        (F.lit(18) + F.col("c_custkey") % 60).cast("int").alias("age"),
    )


USERS = """
SELECT c_custkey AS id, n_name AS country, c_mktsegment AS traffic_source, CAST(18 + c_custkey % 60 AS INTEGER) AS age
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def shop_orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        case_map("o_orderstatus", {"F": "Complete", "O": "Shipped"}, "Cancelled").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


SHOP_ORDERS = """
SELECT o_orderkey AS order_id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'O' THEN 'Shipped' ELSE 'Cancelled' END AS status,
  o_orderdate AS created_at
FROM orders"""


def order_items(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("center_id"),
        case_map("l_linestatus", {"F": "Complete"}, "Shipped").alias("status"),
        F.col("l_extendedprice").alias("sale_price"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("returned_at"),
        F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("sold_at"),
    )


ORDER_ITEMS = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS center_id,
  CASE l_linestatus WHEN 'F' THEN 'Complete' ELSE 'Shipped' END AS status, l_extendedprice AS sale_price,
  l_shipdate AS created_at, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS returned_at,
  CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS sold_at
FROM lineitem"""


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        (F.col("p_partkey") % 25).cast("int").alias("distribution_center_id"),
    )


PRODUCTS = """
SELECT p_partkey AS id, p_type AS category, p_brand AS brand, p_name AS name,
  CAST(p_partkey % 25 AS INTEGER) AS distribution_center_id
FROM part"""


def centers(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


CENTERS = "SELECT n_nationkey AS id, n_name AS name FROM nation"

# --- points ------------------------------------------------------------------------------


def lat_of(key):
    return F.lit(-6.4) + (key * 7919 % 100003) / F.lit(200006.0)


def lon_of(key):
    return F.lit(106.65) + (key * 15485863 % 100003) / F.lit(200006.0)


LAT = "(-6.4::DOUBLE + ({k} * 7919 % 100003) / 200006::DOUBLE)"
LON = "(106.65::DOUBLE + ({k} * 15485863 % 100003) / 200006::DOUBLE)"
