"""Data tests, parity and profiles: orders against a copy that differs a little."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from ..operators import quality as Q
from ..session import settle
from . import models_q
from .models_q import FCT_SQL, fsum
from .places_q import PLACES, places
from .registry import TABLES, Tables, query, with_sql


def base(t: Tables):
    return t.orders


def other(t: Tables):
    """Orders as a migration might leave them: some lost, some prices off, some status missing."""
    k = F.col("o_orderkey")
    return t.orders.filter(k % 4000 != 7).select(
        "o_orderkey",
        "o_custkey",
        F.when(k % 50 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 300 == 0, F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


OTHER = (
    "other",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 300 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 4000 <> 7""",
)


def judged(test: str, tolerance: float, rel: bool = True) -> str:
    """SQL over a ``v`` table with metric, base and other."""
    none = "CASE WHEN other = 0 THEN 0::DOUBLE ELSE 1::DOUBLE END"
    diff = f"CASE WHEN base = 0 THEN {none} ELSE abs(base - other) / abs(base) END" if rel else "abs(base - other)"
    return f"""SELECT '{test}' AS test, metric, CAST(base AS DOUBLE) AS base, CAST(other AS DOUBLE) AS other,
  CAST({diff} AS DOUBLE) AS diff, {diff} <= {tolerance} AS passed FROM v"""


def sides(*metrics: tuple[str, str]) -> tuple[str, str]:
    """The same aggregates over both tables as metric rows."""
    rows = [f"SELECT '{m}' AS metric, (SELECT {x} FROM orders) AS base, (SELECT {x} FROM other) AS other" for m, x in metrics]
    return "v", " UNION ALL ".join(rows)


@query(
    "dq_unique",
    """SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1""",
)
def _(t):
    return Q.duplicated(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "dq_not_null",
    with_sql(
        PLACES,
        body="""SELECT 'rating' AS column, COUNT(*) FILTER (WHERE rating IS NULL) AS failures FROM places
UNION ALL SELECT 'price_level', COUNT(*) FILTER (WHERE price_level IS NULL) FROM places
UNION ALL SELECT 'district', COUNT(*) FILTER (WHERE district IS NULL) FROM places""",
    ),
)
def _(t):
    return Q.nulls(places(t), ["rating", "price_level", "district"])


@query(
    "dq_accepted_values",
    """SELECT 'o_orderstatus' AS column, COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS failures FROM orders
UNION ALL SELECT 'o_orderpriority', COUNT(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) FROM orders""",
)
def _(t):
    return Q.unaccepted(t.orders, {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query(
    "dq_assertions",
    with_sql(
        OTHER,
        body="""SELECT 'unique' AS assertion, 'o_custkey' AS column, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS failures
FROM (SELECT COUNT(*) AS n FROM other GROUP BY o_custkey HAVING COUNT(*) > 1)
UNION ALL SELECT 'not_null', 'o_orderstatus', COUNT(*) FILTER (WHERE o_orderstatus IS NULL) FROM other
UNION ALL SELECT 'not_null', 'o_totalprice', COUNT(*) FILTER (WHERE o_totalprice IS NULL) FROM other""",
    ),
)
def _(t):
    return Q.assertions(other(t), ["o_custkey"], ["o_orderstatus", "o_totalprice"])


@query("parity_row_count", with_sql(OTHER, sides(("rows", "COUNT(*)")), body=judged("row_count", 0.001)))
def _(t):
    return Q.row_count(base(t), other(t))


@query(
    "parity_distinct_count",
    with_sql(OTHER, sides(("o_custkey", "COUNT(DISTINCT o_custkey)")), body=judged("distinct_count", 0)),
)
def _(t):
    return Q.distinct_count(base(t), other(t), ["o_custkey"])


@query(
    "parity_pk",
    """SELECT COUNT(*) AS rows, COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS duplicates,
  COUNT(*) = COUNT(DISTINCT (l_orderkey, l_linenumber)) AS passed FROM lineitem""",
)
def _(t):
    return Q.key_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("parity_metric_sum", with_sql(OTHER, sides(("o_totalprice", fsum("o_totalprice"))), body=judged("metric_sum", 0.001)))
def _(t):
    return Q.metric_sums(base(t), other(t), ["o_totalprice"])


@query(
    "parity_metric_stats",
    with_sql(
        OTHER,
        sides(
            ("o_totalprice.sum", fsum("o_totalprice")),
            ("o_totalprice.avg", f"{fsum('o_totalprice')} / COUNT(o_totalprice)"),
            ("o_totalprice.min", "MIN(o_totalprice)"),
            ("o_totalprice.max", "MAX(o_totalprice)"),
        ),
        body=judged("metric_stats", 0.001),
    ),
)
def _(t):
    return Q.metric_stats(base(t), other(t), ["o_totalprice"])


COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "parity_null_rate",
    with_sql(
        OTHER,
        sides(*[(c, f"COUNT(*) FILTER (WHERE {c} IS NULL)::DOUBLE / COUNT(*)") for c in COLUMNS]),
        body=judged("null_rate", 0.05, rel=False),
    ),
)
def _(t):
    return Q.null_rates(base(t), other(t))


@query(
    "null_parity",
    with_sql(
        OTHER,
        sides(*[(c, f"COUNT(*) FILTER (WHERE {c} IS NULL)") for c in ("o_orderstatus", "o_custkey")]),
        body=judged("null_count", 0, rel=False),
    ),
)
def _(t):
    return Q.null_counts(base(t), other(t), ["o_orderstatus", "o_custkey"])


DATE = "strftime({}(o_orderdate), '%Y-%m-%d %H:%M:%S')"


@query(
    "parity_date_range",
    with_sql(
        OTHER,
        sides(("o_orderdate.min", DATE.format("MIN")), ("o_orderdate.max", DATE.format("MAX"))),
        body="SELECT 'date_range' AS test, metric, base, other, base = other AS passed FROM v",
    ),
)
def _(t):
    return Q.date_ranges(base(t), other(t), ["o_orderdate"])


def _shares(table: str) -> str:
    return f"""SELECT o_custkey AS metric, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM {table}) AS s FROM {table} GROUP BY ALL"""


@query(
    "parity_distribution",
    with_sql(
        OTHER,
        ("a", _shares("orders").replace("o_custkey AS metric", "CAST(o_custkey AS VARCHAR) AS metric")),
        ("b", _shares("other").replace("o_custkey AS metric", "CAST(o_custkey AS VARCHAR) AS metric")),
        (
            "names",
            """(SELECT metric FROM a ORDER BY s DESC, metric LIMIT 10) UNION (SELECT metric FROM b ORDER BY s DESC, metric LIMIT 10)""",
        ),
        ("v", "SELECT metric, COALESCE(a.s, 0) AS base, COALESCE(b.s, 0) AS other FROM names LEFT JOIN a USING (metric) LEFT JOIN b USING (metric)"),
        body=judged("distribution", 0.05, rel=False),
    ),
)
def _(t):
    return Q.distribution(base(t), other(t), "o_custkey")


@query(
    "parity_temporal",
    with_sql(
        OTHER,
        ("a", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS metric, COUNT(*) AS n FROM orders GROUP BY ALL"),
        ("b", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS metric, COUNT(*) AS n FROM other GROUP BY ALL"),
        ("v", "SELECT metric, COALESCE(a.n, 0) AS base, COALESCE(b.n, 0) AS other FROM a FULL JOIN b USING (metric)"),
        body=judged("temporal", 0.001),
    ),
)
def _(t):
    return Q.temporal(base(t), other(t), "o_orderdate")


@query(
    "partition_parity",
    with_sql(
        OTHER,
        ("a", "SELECT o_orderpriority AS metric, COUNT(*) AS n FROM orders GROUP BY ALL"),
        ("b", "SELECT o_orderpriority AS metric, COUNT(*) AS n FROM other GROUP BY ALL"),
        ("v", "SELECT metric, COALESCE(a.n, 0) AS base, COALESCE(b.n, 0) AS other FROM a FULL JOIN b USING (metric)"),
        body=judged("partition_count", 0, rel=False),
    ),
)
def _(t):
    return Q.partition_counts(base(t), other(t), "o_orderpriority")


SCHEMA_SQL = """SELECT 'o_totalprice' AS column, 'type' AS problem, 'double' AS base_type, 'string' AS other_type, {n} AS rows
UNION ALL SELECT 'o_orderpriority', 'missing', 'string', NULL, {n} UNION ALL SELECT 'note', 'extra', NULL, 'string', {n}"""


def retyped(t: Tables):
    changed = other(t).withColumn("o_totalprice", F.col("o_totalprice").cast("string")).drop("o_orderpriority")
    return changed.withColumn("note", F.lit(""))


@query("parity_schema", with_sql(OTHER, body=SCHEMA_SQL.format(n="(SELECT COUNT(*) FROM other)")))
def _(t):
    changed = retyped(t)
    return Q.schema_problems(base(t), changed).withColumn("rows", changed.agg(F.count("*")).scalar())


@query("schema_set_diff", SCHEMA_SQL.format(n="(SELECT COUNT(*) FROM orders)"))
def _(t):
    found = dedup.schema_diff(base(t), retyped(t))
    rows = t.spark.createDataFrame(found, "column string, problem string, base_type string, other_type string")
    return rows.withColumn("rows", base(t).agg(F.count("*")).scalar())


@query("width_parity", "SELECT 6 AS found, 6 AS expected, TRUE AS equal, COUNT(*) AS rows FROM orders")
def _(t):
    found, expected, equal = Q.width(t.orders, COLUMNS)
    return t.orders.agg(
        F.lit(found).alias("found"), F.lit(expected).alias("expected"), F.lit(equal).alias("equal"), F.count("*").alias("rows")
    )


@query(
    "ns_fidelity",
    """SELECT COUNT(*) AS compared, COUNT(*) FILTER (WHERE event_id % 700 = 3) AS changed,
  COUNT(*) FILTER (WHERE event_id % 1000 <> 0) AS with_sub_micro,
  COUNT(*) FILTER (WHERE event_id % 1000 <> 0 AND event_id % 700 <> 3) AS sub_micro_kept FROM events""",
)
def _(t):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    exact = t.events.select("event_id", ns.alias("ns"))
    lossy = exact.withColumn("ns", F.when(F.col("event_id") % 700 == 3, F.col("ns") - F.col("ns") % 1000 + (F.col("ns") + 1) % 1000).otherwise(F.col("ns")))
    return Q.ns_fidelity(exact, lossy, "event_id", "ns")


def _rel(x: str, tolerance: float) -> str:
    return f"(SELECT abs(a.x - b.x) <= {tolerance} * abs(a.x) FROM (SELECT {x} AS x FROM orders) a, (SELECT {x} AS x FROM other) b)"


def _null_share(c: str, tolerance: float, of: str = "1") -> str:
    x = f"COUNT(*) FILTER (WHERE {c} IS NULL)::DOUBLE / {of}"
    return f"(SELECT abs(a.x - b.x) <= {tolerance} FROM (SELECT {x} AS x FROM orders) a, (SELECT {x} AS x FROM other) b)"


DECISION_ROWS = [
    ("CRITICAL", _rel("COUNT(*)", 0.001)),
    ("CRITICAL", _rel("SUM(o_totalprice)", 0.001)),
    ("HIGH", _rel("COUNT(DISTINCT o_custkey)", 0)),
    ("HIGH", _null_share("o_custkey", 0)),
    ("HIGH", _null_share("o_orderstatus", 0)),
    *[("HIGH", _null_share(c, 0.05, "COUNT(*)")) for c in ("o_orderstatus", "o_custkey", "o_orderdate")],
]


@query(
    "parity_decision",
    with_sql(
        OTHER,
        ("r", " UNION ALL ".join(f"SELECT '{p}' AS priority, {x} AS passed" for p, x in DECISION_ROWS)),
        (
            "d",
            """SELECT COUNT(*) FILTER (WHERE priority = 'CRITICAL' AND NOT passed) AS critical_failed,
  ROUND(COUNT(*) FILTER (WHERE priority = 'HIGH' AND passed)::DOUBLE / COUNT(*) FILTER (WHERE priority = 'HIGH'), 4) AS high_share FROM r""",
        ),
        body="SELECT *, CASE WHEN critical_failed = 0 AND high_share > 0.9 THEN 'APPROVED' ELSE 'NOT READY' END AS decision FROM d",
    ),
)
def _(t):
    checks = [
        (Q.rows_check(), "CRITICAL"),
        (Q.sums_check(["o_totalprice"]), "CRITICAL"),
        (Q.distinct_check(["o_custkey"]), "HIGH"),
        (Q.null_counts_check(["o_custkey", "o_orderstatus"]), "HIGH"),
        (Q.null_rates_check(["o_orderstatus", "o_custkey", "o_orderdate"]), "HIGH"),
    ]
    rows = Q.parity(base(t), other(t), checks)
    return Q.decision(rows)


def _counts_sql(value: str, side: str) -> str:
    return f"SELECT CAST({value} AS VARCHAR) AS metric, COUNT(*)::DOUBLE AS n FROM {side} GROUP BY ALL"


def _by_value_sql(test: str, value: str, tolerance: float, rel: bool = True) -> str:
    both = f"({_counts_sql(value, 'orders')}) a FULL JOIN ({_counts_sql(value, 'other')}) b USING (metric)"
    return judged(test, tolerance, rel).replace("FROM v", f"FROM (SELECT metric, COALESCE(a.n, 0) AS base, COALESCE(b.n, 0) AS other FROM {both})")


@query(
    "parity_report",
    with_sql(
        OTHER,
        (
            "r",
            " UNION ALL ".join(
                [
                    judged("row_count", 0.001).replace("FROM v", "FROM (SELECT 'rows' AS metric, (SELECT COUNT(*) FROM orders) AS base, (SELECT COUNT(*) FROM other) AS other)"),
                    judged("null_count", 0, rel=False).replace(
                        "FROM v",
                        "FROM (SELECT 'o_orderstatus' AS metric, (SELECT COUNT(*) - COUNT(o_orderstatus) FROM orders) AS base, (SELECT COUNT(*) - COUNT(o_orderstatus) FROM other) AS other)",
                    ),
                    _by_value_sql("partition_count", "o_orderpriority", 0, rel=False),
                    _by_value_sql("temporal", "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')", 0.001),
                    f"""SELECT 'date_range', 'o_orderdate.' || e, NULL, NULL, NULL, a = b FROM (
  SELECT 'min' AS e, (SELECT {DATE.format("MIN")} FROM orders) AS a, (SELECT {DATE.format("MIN")} FROM other) AS b
  UNION ALL SELECT 'max', (SELECT {DATE.format("MAX")} FROM orders), (SELECT {DATE.format("MAX")} FROM other))""",
                ]
            ),
        ),
        body="SELECT * FROM r",
    ),
)
def _(t):
    checks = [Q.rows_check(), Q.null_counts_check(["o_orderstatus"]), Q.partitions_check("o_orderpriority"), Q.temporal_check("o_orderdate"), Q.ranges_check(["o_orderdate"])]
    return Q.parity(base(t), other(t), [(c, "HIGH") for c in checks]).select(*Q.PARITY)


@query(
    "result_compare",
    with_sql(
        ("fct", FCT_SQL),
        # Every 50th order is one cent off, every 70th is missing and every 90th is one too many; ids are unique.
        body="""SELECT COUNT(*) FILTER (WHERE order_id % 70 <> 0) AS compared,
  COUNT(*) FILTER (WHERE order_id % 70 <> 0 AND order_id % 50 = 0) AS different,
  COUNT(*) FILTER (WHERE order_id % 70 = 0) AS base_only, COUNT(*) FILTER (WHERE order_id % 90 = 0) AS other_only,
  COUNT(*) FILTER (WHERE order_id % 50 = 0 OR order_id % 70 = 0 OR order_id % 90 = 0) = 0 AS equal FROM fct""",
    ),
)
def _(t):
    left = models_q.fct_orders(t).drop("gold_loaded_at")
    right = models_q.fct_chain(t).drop("gold_loaded_at")
    cent = F.when(F.col("order_id") % 50 == 0, 0.01).otherwise(0.0)
    # The other side is read once, a row giving none to two; filters of two readings would go below the shuffles, which both
    # sides then could not share.
    nudged = F.when(F.col("order_id") % 70 != 0, F.struct(F.col("order_id").alias("id"), (F.col("order_total_usd") * (1 + 1e-9) + cent).alias("usd")))
    extra = F.when(F.col("order_id") % 90 == 0, F.struct((-1 - F.col("order_id")).alias("id"), F.col("order_total_usd").alias("usd")))
    given = right.withColumn("_given", F.explode(F.array_compact(F.array(nudged, extra))))
    given = given.withColumns({"order_id": F.col("_given.id"), "order_total_usd": F.col("_given.usd")})
    return Q.result_compare(left, given.drop("_given"))


PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
FEW = ("o_orderstatus", "o_orderpriority")


def _profile_sql(c: str, kind: str) -> str:
    text = f"strftime({{}}({c}), '%Y-%m-%d %H:%M:%S')" if kind == "timestamp_ntz" else f"CAST({{}}({c}) AS VARCHAR)"
    numeric, words = kind in ("bigint", "double"), kind == "string"
    most = f"(SELECT {c} FROM other WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC LIMIT 1)" if c in FEW else "CAST(NULL AS VARCHAR)"
    times = f"(SELECT COUNT(*) FROM other WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC LIMIT 1)" if c in FEW else "CAST(NULL AS BIGINT)"
    return f"""SELECT '{c}' AS column, '{kind}' AS type, COUNT(*) AS rows, COUNT(*) FILTER (WHERE {c} IS NULL)::DOUBLE / COUNT(*)
  AS null_ratio, {text.format("MIN")} AS least, {text.format("MAX")} AS greatest, {f"ROUND(AVG({c}), 4)" if numeric else "CAST(NULL AS DOUBLE)"} AS mean,
  {f"ROUND(STDDEV_SAMP({c}), 4)" if numeric else "CAST(NULL AS DOUBLE)"} AS deviation, {f"MIN(length({c}))" if words else "CAST(NULL AS BIGINT)"} AS shortest,
  {f"MAX(length({c}))" if words else "CAST(NULL AS BIGINT)"} AS longest, {most} AS most_frequent, {times} AS times, TRUE AS distinct_close,
  {"CAST(NULL AS BOOLEAN)" if words else "TRUE"} AS quartiles_close FROM other"""


@query("table_profile", with_sql(OTHER, body=" UNION ALL ".join(_profile_sql(c, kind) for c, kind in PROFILED.items())))
def _(t):
    rows = other(t)
    # Share of rows up to each quartile, which must be near the quartile's own.
    found = settle(Q.table_profile(rows), "profile")
    marks = found.select("column", "quartiles").filter("quartiles IS NOT NULL")
    ordered = {r["column"]: r["quartiles"] for r in marks.collect()}  # one row per column
    shares = [F.avg((F.col(c) <= F.lit(q).cast(PROFILED[c])).cast("double")).alias(f"{c}_{i}") for c, qs in ordered.items() for i, q in enumerate(qs)]
    row = rows.agg(*shares, *[F.count_distinct(c).alias(c) for c in PROFILED])
    near = {c: (F.abs(F.col(f"{c}_0") - 0.25) < 0.02) & (F.abs(F.col(f"{c}_1") - 0.5) < 0.02) & (F.abs(F.col(f"{c}_2") - 0.75) < 0.02) for c in ordered}
    near |= {c: F.lit(None).cast("boolean") for c in PROFILED if c not in ordered}
    exact = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n"), near[c].alias("quartiles_close")) for c in PROFILED]
    profile = found.join(row.select(F.inline(F.array(*exact))), "column")
    few = F.col("column").isin(*FEW)
    return profile.select(
        "column",
        "type",
        "rows",
        "null_ratio",
        "least",
        "greatest",
        F.round("mean", 4).alias("mean"),
        F.round("deviation", 4).alias("deviation"),
        "shortest",
        "longest",
        F.when(few, F.get("frequent", F.lit(0))["value"]).alias("most_frequent"),
        F.when(few, F.get("frequent", F.lit(0))["count"]).alias("times"),
        (F.abs(F.col("approx_distinct") - F.col("n")) <= F.col("n") * 0.15).alias("distinct_close"),
        "quartiles_close",
    )


@query(
    "table_analysis",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table, (SELECT COUNT(*) FROM (DESCRIBE {n}))::INTEGER AS columns, COUNT(*) AS rows FROM {n}"""
        for n in TABLES
    ),
)
def _(t):
    return Q.table_analysis({n: getattr(t, n) for n in TABLES}).drop("schema")


@query(
    "merge_descriptions",
    """SELECT 'o_orderkey' AS column, 'Order number' AS description, COUNT(o_orderkey) AS filled FROM orders
UNION ALL SELECT 'o_custkey', 'Buyer', COUNT(o_custkey) FROM orders""",
)
def _(t):
    first = Q.merge_descriptions(t.orders, {"o_orderkey": "Order number"})
    both = Q.merge_descriptions(first, {"o_orderkey": "ignored", "o_custkey": "Buyer"})
    known = {c: d for c, d in Q.descriptions_of(both).items() if d}
    counts = both.agg(*[F.count(c).alias(c) for c in known])
    packed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(d).alias("description"), F.col(c).alias("filled")) for c, d in known.items()])
    return counts.select(F.inline(packed))
