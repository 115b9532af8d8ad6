"""Ingest, load modes, exports and typed conversions over the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..plans import ingest
from ..session import scratch_path
from ..sources import jdbc, state
from ..sources import tables as TB
from ..sources.registry import get_extractor
from . import mapping as S
from .models_q import fsum
from .registry import Tables, query, with_sql

ORDER_COUNTS = "SELECT o_orderstatus, COUNT(*) AS n, {s} AS total FROM {t} GROUP BY ALL"


def order_counts(df):
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), V.fixed_sum("o_totalprice").alias("total"))


def _counts(table: str) -> str:
    return ORDER_COUNTS.format(s=fsum("o_totalprice"), t=table)


# --- extraction ------------------------------------------------------------------------------
# No database may run here, so the catalog and file readers stand in for the JDBC one; its
# options and strides are tested on their own.


@query("jdbc_extract_full", _counts("orders"))
def _(t):
    t.orders.createOrReplaceTempView("src_orders")
    return order_counts(get_extractor("catalog")(t.spark, "", "src_orders"))


@query(
    "jdbc_extract_parallel",
    """WITH b AS (SELECT MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders)
SELECT CAST(greatest(0, least(7, (o_orderkey - lo) // greatest((hi - lo) // 8, 1))) AS INTEGER) AS stride, COUNT(*) AS n,
  MIN(o_orderkey) AS least, MAX(o_orderkey) AS greatest FROM orders, b GROUP BY ALL""",
)
def _(t):
    low, high = jdbc.bounds(t.orders, "o_orderkey")
    stride = jdbc.stride_of(F.col("o_orderkey"), low, high, 8)
    return t.orders.groupBy(stride.alias("stride")).agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("greatest")
    )


@query(
    "jdbc_stride_balance",
    "SELECT 9 AS reads, COUNT(*) AS rows, COUNT(*) FILTER (WHERE o_orderkey % 10 = 0) AS without_key, TRUE AS balanced FROM orders",
)
def _(t):
    """Strides of a key most of whose values lie close together; Spark SQL answers in place of a database."""
    k = F.col("o_orderkey")
    key = F.when(k % 10 != 0, F.when(k % 3 == 0, k * k * 1000).otherwise(k))
    t.orders.select(key.alias("key")).createOrReplaceTempView("src_skewed")
    low, high = jdbc.bounds(t.spark.table("src_skewed"), "key")
    cells = jdbc.even_cells(lambda sql: [tuple(r) for r in t.spark.sql(sql).collect()], "src_skewed", "key", low, high, 8)
    parts = jdbc.stride_predicates("key", jdbc.uneven_bounds(cells, 8))
    counts = [F.count_if(F.expr(p)).alias(f"n{i}") for i, p in enumerate(parts)]
    row = t.spark.table("src_skewed").agg(*counts, F.count("*").alias("rows"))
    strides = F.array_sort(F.array(*[F.col(f"n{i}") for i in range(len(parts) - 1)]))
    balanced = F.element_at(strides, -1) <= 2 * F.element_at(strides, len(parts) // 2)
    return row.select(F.lit(len(parts)).alias("reads"), "rows", F.col(f"n{len(parts) - 1}").alias("without_key"), balanced.alias("balanced"))


@query("incremental_extract", _counts("(SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-30')"))
def _(t):
    newer = get_extractor("parquet")(t.spark, t.folder, "orders", newer_than=("o_orderdate", "1999-06-30 00:00:00"))
    return order_counts(newer)


@query(
    "extractor_registry",
    """SELECT kind, COUNT(*) AS n, SUM(c_custkey)::BIGINT AS keys FROM customer,
  (SELECT unnest(['catalog', 'csv', 'json', 'orc', 'parquet']) AS kind) GROUP BY ALL""",
)
def _(t):
    folder = scratch_path(t.spark, "formats")
    rows = t.customer
    rows.createOrReplaceTempView("src_customer")
    rows.write.parquet(f"{folder}/customer.parquet")
    rows.write.orc(f"{folder}/customer.orc")
    rows.write.json(f"{folder}/customer.json")
    rows.write.option("header", True).csv(f"{folder}/customer.csv")
    out = None
    for kind in ("catalog", "csv", "json", "orc", "parquet"):
        at, name = ("", "src_customer") if kind == "catalog" else (folder, "customer")
        read = get_extractor(kind)(t.spark, at, name)
        part = read.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.col("c_custkey").cast("long")).alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out


# --- watermarks ------------------------------------------------------------------------------


def _marked(t: Tables):
    path = scratch_path(t.spark, "state")
    for before in ("1997-01-01", "1999-01-01"):
        batch = t.orders.filter(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
        value = state.batch_watermark(batch, "o_orderdate")
        state.update_watermark(t.spark, path, "src", "shop", "orders", value, "timestamp_ntz")
    state.update_watermark(t.spark, path, "src", "shop", "empty", None, "timestamp_ntz")
    state.update_watermark(t.spark, path, "src", "shop", "customer", state.batch_watermark(t.customer, "c_custkey"), "bigint")
    return path


@query(
    "watermark_update",
    """SELECT 'src' AS source_name, 'shop' AS db_name, 'orders' AS tbl_name,
  strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') AS watermark_value, 'timestamp_ntz' AS value_type
FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
UNION ALL SELECT 'src', 'shop', 'customer', CAST(MAX(c_custkey) AS VARCHAR), 'bigint' FROM customer""",
)
def _(t):
    return state.read_state(t.spark, _marked(t)).drop("updated_at")


@query(
    "watermark_read",
    """SELECT strftime(MAX(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last, CAST(NULL AS VARCHAR) AS never, COUNT(*) AS loaded
FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'""",
)
def _(t):
    path = _marked(t)
    last = state.read_watermark(t.spark, path, "src", "shop", "orders")
    never = state.read_watermark(t.spark, path, "src", "shop", "unknown")
    loaded = t.orders.filter(F.col("o_orderdate") <= F.lit(last).cast("timestamp_ntz"))
    return loaded.agg(F.lit(last).alias("last"), F.lit(never).cast("string").alias("never"), F.count("*").alias("loaded"))


# --- load modes ------------------------------------------------------------------------------


@query("load_overwrite", _counts("(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"))
def _(t):
    table = TB.ParquetTable(t.spark, scratch_path(t.spark, "overwrite"), "o_orderpriority", ["o_custkey"])
    table.overwrite(t.orders)
    table.overwrite(table.read().filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    return order_counts(table.read())


@query("load_append", _counts("(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F')"))
def _(t):
    table = TB.ParquetTable(t.spark, scratch_path(t.spark, "append"))
    table.append(t.orders)
    table.append(t.orders.filter("o_orderstatus = 'F'"))
    return order_counts(table.read())


MERGED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders
UNION ALL SELECT -1 - o_orderkey, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'O'"""


def _merge(t: Tables, partition_by: str | None):
    table = TB.ParquetTable(t.spark, scratch_path(t.spark, "merge"), partition_by)
    table.merge(t.orders, ["o_orderkey"])
    changed = t.orders.filter("o_orderstatus = 'P'").withColumns(
        {"o_orderstatus": F.lit("F"), "o_totalprice": F.col("o_totalprice") + 1}
    )
    added = t.orders.filter("o_orderstatus = 'O'").withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("N")})
    table.merge(changed.unionByName(added), ["o_orderkey"])
    return table.read()


@query("load_merge", _counts(f"({MERGED})"))
def _(t):
    return order_counts(_merge(t, None))


@query("load_merge_partitioned", _counts(f"({MERGED})"))
def _(t):
    return order_counts(_merge(t, "o_orderstatus"))


CLUSTER = {
    "source_name": "shop",
    "source_type": "parquet",
    "data_config": {
        "sf-data": {
            "tables": {
                "customer": {"etl_mode": "INCREMENTAL", "backfill_filters": [{"backfill_id": "c_custkey"}], "upsert_key": ["c_custkey"]},
                "orders": {"backfill_filters": [{"backfill_id": "o_orderdate"}], "partition_keys": [{"col_name": "o_orderpriority"}]},
                '"part"': {"etl_mode": "FULL_RELOAD", "tbl_name_alias": "products", "is_paginated": True, "pagination_key": "p_partkey", "pagination_size": 1000},
            }
        }
    },
}


@query(
    "load_config_plan",
    """SELECT 'customer' AS tbl_name, 'incremental' AS extraction, 'merge' AS write_mode, 'c_custkey' AS watermark, 'customer' AS target,
  10 AS partitions, COUNT(*) AS rows FROM customer
UNION ALL SELECT 'orders', 'incremental', 'append', 'o_orderdate', 'orders', 10, COUNT(*) FROM orders
UNION ALL SELECT 'part', 'full', 'overwrite', NULL, 'products', 200, COUNT(*) FROM part""",
)
def _(t):
    out = None
    for name in ("customer", "orders", "part"):
        plan = ingest.load_plan(CLUSTER, "sf-data", name)
        rows = ingest.extract(t.spark, plan, t.folder, scratch_path(t.spark, "none"))
        part = rows.agg(
            F.lit(plan.tbl_name).alias("tbl_name"),
            F.lit(plan.extraction).alias("extraction"),
            F.lit(plan.write_mode).alias("write_mode"),
            F.lit(plan.watermark_column).cast("string").alias("watermark"),
            F.lit(plan.table).alias("target"),
            F.lit(plan.partitions).alias("partitions"),
            F.count("*").alias("rows"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("ingest_run", "SELECT 'customer' AS tbl, COUNT(*) AS n FROM customer UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'part', COUNT(*) FROM part")
def _(t):
    warehouse, early = scratch_path(t.spark, "warehouse"), scratch_path(t.spark, "early")
    t.orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).write.parquet(f"{early}/orders.parquet")
    half = t.customer.agg(F.max("c_custkey") / 2).scalar()
    t.customer.filter(F.col("c_custkey") < half).withColumn("c_mktsegment", F.lit("OLD")).write.parquet(f"{early}/customer.parquet")
    t.part.write.parquet(f"{early}/part.parquet")
    out = None
    for name in ("customer", "orders", "part"):
        plan = ingest.load_plan(CLUSTER, "sf-data", name)
        for location in (early, t.folder, t.folder):
            table = ingest.run_table(t.spark, plan, location, warehouse)
        part = table.read().agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("stored_procedure_entry", "SELECT COUNT(*) AS loaded, COUNT(*) AS rows FROM part")
def _(t):
    config = scratch_path(t.spark, "config")
    t.spark.createDataFrame([(json.dumps(CLUSTER),)], "value string").coalesce(1).write.text(config)
    warehouse = scratch_path(t.spark, "warehouse")
    args = {"config": config, "db_name": "sf-data", "tbl_name": "part", "location": t.folder, "warehouse": warehouse, "run_id": ""}
    loaded = ingest.main([x for k, v in args.items() for x in (f"--{k}", v)], t.spark)
    return t.part.agg(F.lit(loaded).cast("long").alias("loaded"), F.count("*").alias("rows"))


@query("table_copy_out", "SELECT COUNT(*) AS copied, COUNT(DISTINCT s_nationkey) AS nations FROM supplier")
def _(t):
    table = TB.ParquetTable(t.spark, scratch_path(t.spark, "copy"))
    copied = TB.copy_out(t.supplier, table)
    return table.read().agg(F.lit(copied).cast("long").alias("copied"), F.count_distinct("s_nationkey").alias("nations"))


def dated_events(t: Tables):
    return t.events.withColumn("event_date", F.to_date("ts"))


DAYS = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, COUNT(*) AS rows FROM events{} GROUP BY ALL"


@query("parquet_export_partition", DAYS.format(""))
def _(t):
    return TB.export_days(dated_events(t), scratch_path(t.spark, "days"), "event_date")


@query(
    "parquet_load_partitioned",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, COUNT(*) AS rows, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY ALL""",
)
def _(t):
    source = scratch_path(t.spark, "source")
    dated_events(t).write.parquet(source)
    table = TB.load_days(t.spark, [source], scratch_path(t.spark, "loaded"), "event_date", ["event_type", "user_id"])
    return table.read().groupBy("event_date").agg(F.count("*").alias("rows"), F.count_distinct("event_type").alias("kinds"))


@query("shard_range_scan", DAYS.format(" WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'"))
def _(t):
    path = scratch_path(t.spark, "shards")
    TB.by_partition(dated_events(t), "event_date").write.partitionBy("event_date").parquet(path)
    shards = TB.day_shards(t.spark, path, "event_date", "2024-01-05", "2024-01-19")
    return shards.groupBy("event_date").agg(F.count("*").alias("rows"))


@query("seed_csv", "SELECT n_name AS country, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "seed")
    t.nation.coalesce(1).write.option("header", True).csv(path)
    lookup = TB.seed(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    joined = counts.join(lookup, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("n_name").alias("country"), "customers")


@query(
    "inline_values",
    """SELECT label, COUNT(*) AS n FROM orders JOIN (VALUES ('F', 'done'), ('O', 'moving'), ('P', 'waiting')) v(code, label)
ON o_orderstatus = code GROUP BY ALL""",
)
def _(t):
    labels = TB.inline_values(t.spark, "code string, label string", [("F", "done"), ("O", "moving"), ("P", "waiting")])
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return counts.join(labels, "code").select("label", "n")


@query(
    "fk_closed_sample",
    "SELECT 0::BIGINT AS orphans, 0::BIGINT AS unused_parents, COUNT(*) AS facts, TRUE AS share_close FROM orders",
)
def _(t):
    chosen, (buyers,) = TB.closed_sample(t.orders, 0.3, ["o_orderkey"], [(t.customer, "o_custkey", "c_custkey")])
    keys = chosen.select(F.col("o_custkey").alias("c_custkey"))
    orphans = keys.join(buyers, "c_custkey", "left_anti").agg(F.count("*")).scalar()
    unused = buyers.join(keys, "c_custkey", "left_anti").agg(F.count("*")).scalar()
    sampled = chosen.agg(F.count("*")).scalar()
    facts = F.count("*")
    return t.orders.agg(facts.alias("facts")).select(
        orphans.alias("orphans"),
        unused.alias("unused_parents"),
        "facts",
        (F.abs(sampled / F.col("facts") - 0.3) < 0.05).alias("share_close"),
    )


@query("authorized_view", "SELECT c_mktsegment AS segment, COUNT(*) AS n, MIN(c_name) AS first_name FROM customer GROUP BY ALL")
def _(t):
    TB.authorized_view(t.customer, "shared_customers", ["c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")])
    return t.spark.table("shared_customers").groupBy("segment").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


# --- typed conversions -------------------------------------------------------------------------


@query("fn_date_key", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_key FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date_key"))


RAW_Q = "(epoch_us(ts) - 946684800000000) * 1000 + event_id % 1000"


@query(
    "fn_q_epoch_to_unix",
    f"SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN {RAW_Q} + 946684800000000000 END AS unix_ns FROM events",
)
def _(t):
    raw = (F.unix_micros(F.col("ts").cast("timestamp")) - 946684800000000) * 1000 + F.col("event_id") % 1000
    raw = F.when(F.col("event_id") % 97 == 0, F.lit(V.Q_NULL)).otherwise(raw)
    return t.events.select("event_id", V.q_ns_to_unix_ns(raw).alias("unix_ns"))


@query(
    "fn_ns_to_us_trunc",
    """SELECT event_id, CAST(trunc((CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * event_id * 1777) / 1000) AS BIGINT) + 946684800000000
  AS unix_us FROM events""",
)
def _(t):
    raw = F.when(F.col("event_id") % 2 == 0, -1).otherwise(1) * F.col("event_id") * 1777
    return t.events.select("event_id", V.q_ns_to_unix_us(raw).alias("unix_us"))


@query("fn_empty_to_null", "SELECT p_partkey, NULLIF(CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END, '') AS brand FROM part")
def _(t):
    blank = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", V.empty_to_null(blank).alias("brand"))


@query(
    "fn_align_schema",
    """SELECT CAST(p_size AS BIGINT) AS p_size, NULLIF(CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END, '') AS p_brand,
  CAST(p_partkey AS VARCHAR) AS p_partkey, p_retailprice FROM part""",
)
def _(t):
    target = T.StructType(
        [
            T.StructField("p_size", T.LongType()),
            T.StructField("p_brand", T.StringType()),
            T.StructField("p_partkey", T.StringType()),
            T.StructField("p_retailprice", T.DoubleType()),
        ]
    )
    blank = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand"))
    return TB.align_schema(t.part.withColumn("p_brand", blank), target)


@query(
    "fn_uuid_from_int",
    """SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
  || substr(h, 21, 12) AS id FROM (SELECT o_orderkey, lpad(lower(to_hex(o_orderkey)), 32, '0') AS h FROM orders)""",
)
def _(t):
    return t.orders.select("o_orderkey", V.uuid_of("o_orderkey").alias("id"))
