"""Row filters and masks: customers stand for sales, nations carry the ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges as RG
from ..operators import security as SEC
from .registry import Tables, query, with_sql

ANALYST = "user3@example.com"


def sales(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("txn_id"),
        F.col("c_name").alias("store_code"),
        F.col("c_mktsegment").alias("region"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("amount"),
    )


def _code(number):
    return F.concat(F.lit("Customer#"), F.lpad(number.cast("string"), 9, "0"))


def access_map(t: Tables):
    n = F.col("n_nationkey")
    return t.nation.select(
        F.concat(F.lit("User"), (n % 5).cast("string"), F.lit("@Example.com")).alias("email"),
        F.lit("store_code").alias("column_name"),
        _code(n * 50).alias("low_value"),
        _code(n * 50 + 70).alias("high_value"),
    )


def access_list(t: Tables):
    s = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("User"), (s % 5).cast("string"), F.lit("@Example.com")).alias("email"),
        _code(s * 7).alias("store_code"),
    )


SALES = (
    "sales",
    """SELECT c_custkey AS txn_id, c_name AS store_code, c_mktsegment AS region, c_nationkey AS nation,
  c_acctbal AS amount FROM customer""",
)
MAP = (
    "access_map",
    """SELECT 'User' || n_nationkey % 5 || '@Example.com' AS email, 'store_code' AS column_name,
  'Customer#' || lpad(CAST(n_nationkey * 50 AS VARCHAR), 9, '0') AS low_value,
  'Customer#' || lpad(CAST(n_nationkey * 50 + 70 AS VARCHAR), 9, '0') AS high_value FROM nation""",
)
LIST = (
    "access_list",
    """SELECT 'User' || s_suppkey % 5 || '@Example.com' AS email,
  'Customer#' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0') AS store_code FROM supplier""",
)
COVERED = f"""EXISTS (SELECT 1 FROM access_map m WHERE lower(email) = '{ANALYST}' AND column_name = 'store_code'
  AND s.store_code BETWEEN low_value AND high_value)"""


@query(
    "rls_discrete",
    with_sql(
        SALES,
        LIST,
        body=f"SELECT * FROM sales WHERE store_code IN (SELECT store_code FROM access_list WHERE lower(email) = '{ANALYST}')",
    ),
)
def _(t):
    return SEC.allow_listed(sales(t), access_list(t), ANALYST.upper(), "store_code")


@query(
    "semi_in_subquery",
    with_sql(
        SALES,
        LIST,
        body="SELECT region, COUNT(*) AS n FROM sales WHERE store_code IN (SELECT store_code FROM access_list) GROUP BY ALL",
    ),
)
def _(t):
    listed = sales(t).join(access_list(t).select("store_code"), "store_code", "left_semi")
    return listed.groupBy("region").agg(F.count("*").alias("n"))


@query("rls_range", with_sql(SALES, MAP, body=f"SELECT * FROM sales s WHERE {COVERED}"))
def _(t):
    return SEC.range_listed(sales(t), access_map(t), ANALYST, "store_code", keys=sales(t))


@query("semi_range_exists", with_sql(SALES, MAP, body=f"SELECT txn_id, store_code FROM sales s WHERE {COVERED}"))
def _(t):
    kept = RG.keep_in_ranges(sales(t), "store_code", SEC.grants_of(access_map(t), ANALYST, "store_code"))
    return kept.select("txn_id", "store_code")


@query(
    "range_expand",
    """SELECT DISTINCT l_partkey AS part FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier
  WHERE l_partkey BETWEEN s_suppkey * 13 AND s_suppkey * 13 + s_suppkey % 9)""",
)
def _(t):
    s = F.col("s_suppkey")
    wide = t.supplier.select((s * 13).alias("low_value"), (s * 13 + s % 9).alias("high_value"))
    keys = t.lineitem.select(F.col("l_partkey").alias("part")).distinct()
    return RG.range_expand(keys, wide, "part")


@query(
    "rls_two_range",
    with_sql(
        SALES,
        MAP,
        ("two", f"SELECT * FROM access_map WHERE lower(email) = '{ANALYST}' ORDER BY low_value, high_value LIMIT 2"),
        body="SELECT * FROM sales s WHERE EXISTS (SELECT 1 FROM two WHERE s.store_code BETWEEN low_value AND high_value)",
    ),
)
def _(t):
    return SEC.first_two_ranges(sales(t), access_map(t), ANALYST, "store_code")


@query(
    "secure_view_join",
    with_sql(SALES, MAP, body=f"SELECT region, COUNT(*) AS n FROM sales s WHERE {COVERED} GROUP BY ALL"),
)
def _(t):
    kept = SEC.range_listed(sales(t), access_map(t), ANALYST, "store_code")
    return kept.groupBy("region").agg(F.count("*").alias("n"))


@query("visible_rows", with_sql(SALES, MAP, body=f"SELECT COUNT(*) AS visible_rows FROM sales s WHERE {COVERED}"))
def _(t):
    return SEC.visible_rows(SEC.range_listed(sales(t), access_map(t), ANALYST, "store_code"))


ROW_POLICIES = [("admin", "TRUE"), ("household", "region = 'HOUSEHOLD'"), ("south", "nation < 5")]
COLUMN_POLICIES = {
    "store_code": SEC.ColumnPolicy(frozenset({"admin"}), {"south": "SHA256", "household": "SHA256"}),
    "amount": SEC.ColumnPolicy(frozenset({"admin"}), {"south": "ALWAYS_NULL", "household": "ALWAYS_NULL"}),
    "region": SEC.ColumnPolicy(frozenset({"admin"}), {"south": "DEFAULT_MASKING_VALUE"}),
    "nation": SEC.ColumnPolicy(frozenset({"admin"})),
}


def row_policies():
    return [SEC.RowPolicy(g, F.expr(p)) for g, p in ROW_POLICIES]


@query("rls_predicate", with_sql(SALES, body="SELECT * FROM sales WHERE region = 'HOUSEHOLD' OR nation < 5"))
def _(t):
    return SEC.rows_for(sales(t), row_policies(), ["household", "south"])


MASKED = "txn_id, sha256(store_code) AS store_code, '' AS region, CAST(NULL AS DOUBLE) AS amount"


@query("cls_mask", with_sql(SALES, body=f"SELECT {MASKED} FROM sales"))
def _(t):
    return SEC.columns_for(sales(t), COLUMN_POLICIES, ["south"], ["txn_id", "store_code", "region", "amount"])


@query("secure_view", with_sql(SALES, body=f"SELECT {MASKED} FROM sales WHERE nation < 5"))
def _(t):
    columns = ["txn_id", "store_code", "region", "amount"]
    return SEC.secure_view(sales(t), row_policies(), COLUMN_POLICIES, ["south"], columns)


@query(
    "fn_mask",
    with_sql(
        SALES,
        body="""SELECT txn_id, sha256(store_code) AS hashed, right(store_code, 4) AS tail, '' AS text_default,
  CAST(0 AS DOUBLE) AS number_default, CAST(NULL AS DOUBLE) AS nothing FROM sales""",
    ),
)
def _(t):
    from ..functions.values import mask

    rows = sales(t)
    number, text = rows.schema["amount"].dataType, rows.schema["store_code"].dataType
    return rows.select(
        "txn_id",
        mask("store_code", "SHA256").alias("hashed"),
        mask("store_code", "LAST_FOUR_CHARACTERS").alias("tail"),
        mask("store_code", "DEFAULT_MASKING_VALUE", text).alias("text_default"),
        mask("amount", "DEFAULT_MASKING_VALUE", number).alias("number_default"),
        mask("amount", "ALWAYS_NULL", number).alias("nothing"),
    )
