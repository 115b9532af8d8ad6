"""Medallion models, projections and enriching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import dedup
from ..plans import medallion as M
from ..session import scratch_path
from . import mapping as S
from .registry import Tables, query, with_sql


def fsum(x: str, places: int = 2) -> str:
    """SQL of an exact sum of decimal amounts."""
    return f"SUM(CAST({x} * {10**places} AS BIGINT)) / {10**places}"


def favg(x: str, places: int = 2) -> str:
    return f"SUM(CAST({x} * {10**places} AS BIGINT)) / COUNT({x}) / {10**places}"


DEDUP = "SELECT * FROM raw_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created_at) = 1"
# Labels, rates and band edges below are fixed values.
STATUS_CASE = """CASE status WHEN 'completed' THEN 'COMPLETED' WHEN 'shipped' THEN 'IN_TRANSIT'
    WHEN 'processing' THEN 'PROCESSING' WHEN 'pending' THEN 'PENDING' WHEN 'cancelled' THEN 'CANCELLED'
    WHEN 'refunded' THEN 'REFUNDED' ELSE 'UNKNOWN' END"""
GROUP_CASE = """CASE WHEN status IN ('completed', 'shipped') THEN 'FULFILLED'
    WHEN status IN ('processing', 'pending') THEN 'IN_PROGRESS'
    WHEN status IN ('cancelled', 'refunded') THEN 'CANCELLED' ELSE 'OTHER' END"""
USD_CASE = """total_amount * CASE currency WHEN 'GBP' THEN 1.27::DOUBLE WHEN 'EUR' THEN 1.08::DOUBLE
    WHEN 'CAD' THEN 0.74::DOUBLE WHEN 'AUD' THEN 0.65::DOUBLE ELSE 1::DOUBLE END"""
SIZE_CASE = """CASE WHEN total_amount < 50 THEN 'SMALL' WHEN total_amount <= 200 THEN 'MEDIUM'
    WHEN total_amount <= 500 THEN 'LARGE' ELSE 'ENTERPRISE' END"""
STG_ORDERS = f"""SELECT order_id, customer_id, order_date, CAST(order_date AS DATE) AS order_date_key,
  status AS raw_status, {STATUS_CASE} AS order_status, {GROUP_CASE} AS status_category, total_amount, currency,
  {USD_CASE} AS total_amount_usd, {SIZE_CASE} AS order_size_category, created_at
FROM deduped"""
STG_CUSTOMERS = """SELECT customer_id, trim(upper(first_name)) AS first_name, trim(upper(last_name)) AS last_name,
  lower(trim(email)) AS email, country_code, created_at, updated_at,
  trim(first_name) || ' ' || trim(last_name) AS full_name FROM raw_customers"""
STOCK_CASE = """CASE WHEN stock_quantity = 0 THEN 'OUT_OF_STOCK' WHEN stock_quantity < 50 THEN 'LOW_STOCK'
    WHEN stock_quantity < 200 THEN 'IN_STOCK' ELSE 'WELL_STOCKED' END"""
TIER_CASE = """CASE WHEN price < 20 THEN 'BUDGET' WHEN price <= 50 THEN 'MID_RANGE'
    WHEN price <= 100 THEN 'PREMIUM' ELSE 'LUXURY' END"""
STG_PRODUCTS = f"""SELECT product_id, product_name, category_code, CASE category_code
    WHEN 'ELECTRONICS' THEN 'Electronics & Gadgets' WHEN 'OFFICE' THEN 'Office Supplies'
    WHEN 'HOME' THEN 'Home & Living' ELSE 'Other' END AS category_name, price, stock_quantity, is_active,
  {STOCK_CASE} AS stock_status, {TIER_CASE} AS price_tier, created_at FROM raw_products"""
LINES = """SELECT *, quantity * unit_price AS line_total,
  CASE WHEN quantity >= 3 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS discount_rate,
  CASE WHEN quantity >= 3 THEN quantity * unit_price * 0.9::DOUBLE ELSE quantity * unit_price END
    AS line_total_after_discount FROM raw_items"""
SUMMARY = f"""SELECT order_id, COUNT(DISTINCT line_id) AS total_line_items,
  CAST(SUM(quantity) AS BIGINT) AS total_units, COUNT(DISTINCT product_id) AS unique_products,
  {fsum('line_total', 4)} AS subtotal, {fsum('line_total_after_discount', 4)} AS subtotal_after_discount,
  {fsum('(line_total - line_total_after_discount)', 4)} AS total_discount_amount
FROM lines GROUP BY order_id"""
CUSTOMER_ORDERS = f"""SELECT customer_id, COUNT(DISTINCT order_id) AS total_orders,
  {fsum('total_amount_usd', 4)} AS total_revenue_usd, {favg('total_amount_usd', 4)} AS avg_order_value_usd,
  MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
  COUNT(DISTINCT CASE WHEN order_status = 'COMPLETED' THEN order_id END) AS completed_orders
FROM stg_orders GROUP BY customer_id"""
ORDER_PARTS = [("raw_orders", S.RAW_ORDERS), ("deduped", DEDUP), ("stg_orders", STG_ORDERS)]
CUSTOMER_PARTS = [("raw_customers", S.RAW_CUSTOMERS), ("stg_customers", STG_CUSTOMERS)]
PRODUCT_PARTS = [("raw_products", S.RAW_PRODUCTS), ("stg_products", STG_PRODUCTS)]
ITEM_PARTS = [("raw_items", S.RAW_ITEMS), ("lines", LINES)]
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def ts(*cols: str) -> str:
    return ", ".join(TS.format(c) for c in cols)


def stg_orders(t: Tables):
    return M.stg_orders(S.raw_orders(t))


def order_lines(t: Tables):
    return M.with_line_totals(S.raw_items(t))


STG_ORDERS_OUT = f"""SELECT * EXCLUDE (order_date, created_at, order_date_key), CAST(order_date_key AS VARCHAR)
  AS order_date_key, {ts('order_date', 'created_at')} FROM stg_orders"""


@query("stg_orders", with_sql(*ORDER_PARTS, body=STG_ORDERS_OUT))
def _(t):
    return stg_orders(t)


@query(
    "stg_customers",
    with_sql(
        *CUSTOMER_PARTS,
        body=f"SELECT * EXCLUDE (created_at, updated_at), {ts('created_at', 'updated_at')} FROM stg_customers",
    ),
)
def _(t):
    return M.stg_customers(S.raw_customers(t))


@query(
    "stg_products",
    with_sql(*PRODUCT_PARTS, body=f"SELECT * EXCLUDE (created_at), {ts('created_at')} FROM stg_products"),
)
def _(t):
    return M.stg_products(S.raw_products(t))


STG_ITEMS = """SELECT line_id, l.order_id, customer_id, strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date,
  order_status, l.product_id, product_name, category_name, quantity, unit_price, line_total, discount_rate,
  line_total_after_discount
FROM lines l LEFT JOIN stg_orders o ON l.order_id = o.order_id
LEFT JOIN stg_products p ON l.product_id = p.product_id"""


def stg_items(t: Tables):
    return M.stg_order_items(S.raw_items(t), stg_orders(t), M.stg_products(S.raw_products(t)))


@query("stg_order_items", with_sql(*ITEM_PARTS, *ORDER_PARTS, *PRODUCT_PARTS, body=STG_ITEMS))
def _(t):
    return stg_items(t)


@query(
    "join_left_enrich",
    with_sql(
        *ITEM_PARTS,
        *ORDER_PARTS,
        *PRODUCT_PARTS,
        body=f"""SELECT category_name, order_status, COUNT(*) AS n, {fsum('line_total', 4)} AS total
FROM lines l LEFT JOIN stg_orders o ON l.order_id = o.order_id LEFT JOIN stg_products p ON l.product_id = p.product_id
GROUP BY ALL""",
    ),
)
def _(t):
    return stg_items(t).groupBy("category_name", "order_status").agg(
        F.count("*").alias("n"), V.fixed_sum("line_total", 4).alias("total")
    )


@query(
    "order_item_summary",
    with_sql(*ITEM_PARTS, body=SUMMARY),
)
def _(t):
    return M.order_item_summary(order_lines(t))


@query("customer_orders", with_sql(*ORDER_PARTS, body=f"SELECT * REPLACE (strftime(first_order_date, '%Y-%m-%d %H:%M:%S') AS first_order_date, strftime(last_order_date, '%Y-%m-%d %H:%M:%S') AS last_order_date) FROM ({CUSTOMER_ORDERS})"))
def _(t):
    return M.customer_orders(stg_orders(t))


DIM_CUSTOMERS = f"""SELECT c.customer_id, first_name, last_name, full_name, email, country_code,
  CASE country_code WHEN 'US' THEN 'United States' WHEN 'UK' THEN 'United Kingdom' WHEN 'CA' THEN 'Canada'
    WHEN 'AU' THEN 'Australia' WHEN 'DE' THEN 'Germany' ELSE 'Other' END AS country_name,
  COALESCE(total_orders, 0) AS total_orders, COALESCE(total_revenue_usd, 0) AS lifetime_value_usd,
  COALESCE(avg_order_value_usd, 0) AS avg_order_value_usd, COALESCE(completed_orders, 0) AS completed_orders,
  {ts('first_order_date', 'last_order_date')},
  CASE WHEN total_orders IS NULL THEN 'PROSPECT' WHEN total_orders = 1 THEN 'NEW'
    WHEN total_orders BETWEEN 2 AND 5 THEN 'ACTIVE' ELSE 'LOYAL' END AS customer_segment,
  CASE WHEN COALESCE(total_revenue_usd, 0) = 0 THEN 'NO_PURCHASE' WHEN total_revenue_usd < 100 THEN 'LOW_VALUE'
    WHEN total_revenue_usd <= 500 THEN 'MEDIUM_VALUE' ELSE 'HIGH_VALUE' END AS value_tier,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS customer_created_at,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS customer_updated_at, 'sample_project' AS gold_source_system
FROM stg_customers c LEFT JOIN customer_orders co ON c.customer_id = co.customer_id"""


@query("dim_customers", with_sql(*ORDER_PARTS, *CUSTOMER_PARTS, ("customer_orders", CUSTOMER_ORDERS), body=DIM_CUSTOMERS))
def _(t):
    return M.dim_customers(M.stg_customers(S.raw_customers(t)), stg_orders(t)).drop("gold_loaded_at")


DIM_PRODUCTS = """SELECT product_id, product_name, category_code, category_name, price, price_tier, stock_quantity,
  stock_status, is_active, CASE WHEN NOT is_active THEN 'DISCONTINUED' WHEN stock_quantity = 0 THEN 'OUT_OF_STOCK'
    ELSE 'AVAILABLE' END AS availability_status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS product_created_at,
  'sample_project' AS gold_source_system FROM stg_products"""


@query("dim_products", with_sql(*PRODUCT_PARTS, body=DIM_PRODUCTS))
def _(t):
    return M.dim_products(M.stg_products(S.raw_products(t))).drop("gold_loaded_at")


FCT_ORDERS = """SELECT o.order_id, o.customer_id, CAST(order_date_key AS VARCHAR) AS order_date_key,
  full_name AS customer_name, country_code AS customer_country,
  strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date, raw_status, order_status, status_category,
  total_amount AS order_total_original, currency AS original_currency, total_amount_usd AS order_total_usd,
  order_size_category, COALESCE(total_line_items, 0) AS total_line_items, COALESCE(total_units, 0) AS total_units,
  COALESCE(unique_products, 0) AS unique_products, COALESCE(subtotal, 0) AS line_items_subtotal,
  COALESCE(subtotal_after_discount, 0) AS line_items_after_discount,
  COALESCE(total_discount_amount, 0) AS total_discount_amount,
  CASE WHEN total_units > 0 THEN total_amount_usd / total_units ELSE 0 END AS avg_unit_price_usd,
  CASE WHEN subtotal > 0 THEN total_discount_amount / subtotal ELSE 0 END AS discount_rate,
  order_status = 'COMPLETED' AS is_completed, order_status = 'CANCELLED' AS is_cancelled,
  COALESCE(total_discount_amount > 0, FALSE) AS has_discount,
  strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS order_created_at, 'sample_project' AS gold_source_system
FROM stg_orders o LEFT JOIN stg_customers c ON o.customer_id = c.customer_id
LEFT JOIN summary s ON o.order_id = s.order_id"""
FCT_PARTS = [*ORDER_PARTS, *CUSTOMER_PARTS, *ITEM_PARTS, ("summary", SUMMARY)]
FCT_SQL = with_sql(*FCT_PARTS, body=FCT_ORDERS)


def fct_orders(t: Tables):
    return M.fct_orders(stg_orders(t), M.stg_customers(S.raw_customers(t)), S.raw_items(t))


def fct_chain(t: Tables):
    return M.fct_orders_chain(S.raw_orders(t), M.stg_customers(S.raw_customers(t)), S.raw_items(t))


@query("fct_orders", FCT_SQL)
def _(t):
    return fct_orders(t).drop("gold_loaded_at")


@query("fct_orders_chain", FCT_SQL)
def _(t):
    return fct_chain(t).drop("gold_loaded_at")


@query(
    "join_left_agg",
    with_sql(
        ("fct", FCT_SQL),
        body=f"""SELECT customer_country, status_category, COUNT(*) AS orders,
  CAST(SUM(total_units) AS BIGINT) AS units, {fsum('line_items_subtotal', 4)} AS subtotal,
  COUNT(*) FILTER (WHERE has_discount) AS discounted FROM fct GROUP BY ALL""",
    ),
)
def _(t):
    return fct_orders(t).groupBy("customer_country", "status_category").agg(
        F.count("*").alias("orders"),
        F.sum("total_units").alias("units"),
        V.fixed_sum("line_items_subtotal", 4).alias("subtotal"),
        F.count_if("has_discount").alias("discounted"),
    )


@query(
    "model_run_order",
    with_sql(
        ("fct", FCT_SQL),
        body="""SELECT 'fct_orders' AS model, COUNT(*) AS n FROM fct
UNION ALL SELECT 'dim_customers', COUNT(*) FROM customer UNION ALL SELECT 'dim_products', COUNT(*) FROM part""",
    ),
)
def _(t):
    built = M.run_models(
        t.spark,
        {
            "raw_orders": S.raw_orders(t),
            "raw_customers": S.raw_customers(t),
            "raw_products": S.raw_products(t),
            "raw_items": S.raw_items(t),
        },
        scratch_path(t.spark, "models"),
    )
    counts = [
        built[m].agg(F.lit(m).alias("model"), F.count("*").alias("n"))
        for m in ("fct_orders", "dim_customers", "dim_products")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- projections -------------------------------------------------------------------------


@query(
    "case_map",
    with_sql(
        ("raw_orders", S.RAW_ORDERS),
        body=f"SELECT {STATUS_CASE} AS order_status, COUNT(*) AS n FROM raw_orders GROUP BY ALL",
    ),
)
def _(t):
    return S.raw_orders(t).groupBy(M.order_status().alias("order_status")).agg(F.count("*").alias("n"))


@query(
    "case_group",
    with_sql(
        ("raw_orders", S.RAW_ORDERS),
        body=f"SELECT {GROUP_CASE} AS status_category, COUNT(*) AS n FROM raw_orders GROUP BY ALL",
    ),
)
def _(t):
    return S.raw_orders(t).groupBy(M.status_category().alias("status_category")).agg(F.count("*").alias("n"))


@query(
    "currency_normalize",
    with_sql(
        ("raw_orders", S.RAW_ORDERS),
        ("usd", f"SELECT currency, total_amount, {USD_CASE} AS usd FROM raw_orders"),
        body=f"SELECT currency, {fsum('total_amount')} AS original, {fsum('usd', 4)} AS usd FROM usd GROUP BY ALL",
    ),
)
def _(t):
    usd = V.convert_currency("total_amount", "currency", M.USD_RATES)
    return (
        S.raw_orders(t)
        .groupBy("currency")
        .agg(V.fixed_sum("total_amount").alias("original"), V.fixed_sum(usd, 4).alias("usd"))
    )


@query(
    "bucketize_first_match",
    with_sql(
        ("raw_orders", S.RAW_ORDERS),
        ("raw_products", S.RAW_PRODUCTS),
        body=f"""SELECT 'order' AS kind, {SIZE_CASE} AS band, COUNT(*) AS n FROM raw_orders GROUP BY ALL
UNION ALL SELECT 'price', {TIER_CASE}, COUNT(*) FROM raw_products GROUP BY ALL
UNION ALL SELECT 'stock', {STOCK_CASE}, COUNT(*) FROM raw_products GROUP BY ALL""",
    ),
)
def _(t):
    def count_by(df, kind, band):
        return df.groupBy(F.lit(kind).alias("kind"), band.alias("band")).agg(F.count("*").alias("n"))

    products = S.raw_products(t)
    return (
        count_by(S.raw_orders(t), "order", M.order_size())
        .unionByName(count_by(products, "price", M.price_tier()))
        .unionByName(count_by(products, "stock", M.stock_status()))
    )


@query(
    "clean_strings",
    with_sql(*CUSTOMER_PARTS, body="SELECT customer_id, first_name, last_name, email, full_name FROM stg_customers"),
)
def _(t):
    return M.stg_customers(S.raw_customers(t)).select("customer_id", "first_name", "last_name", "email", "full_name")


@query("audit_columns", "SELECT p_partkey, 'shop' AS gold_source_system, TRUE AS is_loaded FROM part")
def _(t):
    return M.with_audit(t.part.select("p_partkey"), "shop").select(
        "p_partkey", "gold_source_system", F.col("gold_loaded_at").isNotNull().alias("is_loaded")
    )


@query(
    "flag_columns",
    with_sql(
        *FCT_PARTS,
        body="""SELECT o.order_id, order_status = 'COMPLETED' AS is_completed, order_status = 'CANCELLED' AS is_cancelled,
  COALESCE(total_discount_amount > 0, FALSE) AS has_discount
FROM stg_orders o LEFT JOIN summary s ON o.order_id = s.order_id""",
    ),
)
def _(t):
    return fct_orders(t).select("order_id", "is_completed", "is_cancelled", "has_discount")


@query(
    "dedup_first",
    with_sql(
        ("raw_orders", S.RAW_ORDERS),
        ("deduped", DEDUP),
        body=f"SELECT order_id, customer_id, status, total_amount, {ts('created_at')} FROM deduped",
    ),
)
def _(t):
    return M.deduplicated_orders(S.raw_orders(t)).select("order_id", "customer_id", "status", "total_amount", "created_at")


LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_TIES = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(
    "dedup_latest",
    f"""SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {', '.join(LINE_TIES)}) = 1""",
)
def _(t):
    return dedup.keep_first(t.lineitem, LINE_KEYS, [F.col("l_shipdate").desc(), *LINE_TIES])
