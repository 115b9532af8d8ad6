"""Change data and generated rows driven by the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..streaming import cdc
from ..streaming import generator as G
from ..streaming import rates
from .registry import Tables, query, with_sql


def spread(numbers, by: str):
    """Numbers that grow to rows of kilobytes, in as many parts as a shuffle has; a named number is not merged again."""
    return numbers.repartition(int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def changes(t: Tables):
    """Events as changes of a user row: an error deletes it, anything else sets it."""
    return t.events.select(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("name"),
        "value",
        F.when(F.col("event_type") == "error", cdc.DELETE).otherwise(cdc.UPSERT).alias(cdc.TYPE),
        F.col("event_id").alias(cdc.SEQUENCE),
    )


LIVE = """SELECT user_id AS id, event_type AS name, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
CURRENT = f"SELECT * FROM ({LIVE}) WHERE name <> 'error'"


@query("cdc_apply_batch", CURRENT)
def _(t):
    return cdc.apply_batch(changes(t), ["id"])


def streamed(t: Tables) -> cdc.ChangeTable:
    """The changes in shuffled files, read as a stream of several batches."""
    source = scratch_path(t.spark, "changes")
    rows = changes(t)
    rows.repartition(F.xxhash64("id", cdc.SEQUENCE)).write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    table = cdc.ChangeTable(t.spark, scratch_path(t.spark, "users"), ["id"])
    table.start(stream, scratch_path(t.spark, "checkpoint"), available_now=True).awaitTermination()
    return table


@query("cdc_apply_stream", CURRENT)
def _(t):
    return streamed(t).snapshot()


@query("cdc_snapshot", f"{CURRENT} ORDER BY id")
def _(t):
    table = streamed(t)
    table.compact()
    return table.snapshot().orderBy("id")


@query("cdc_unknown_field", f"SELECT id, name, CAST(NULL AS VARCHAR) AS note, 1 AS ignored FROM ({CURRENT})")
def _(t):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType())])
    known, extra = cdc.known_fields(changes(t), schema)
    return cdc.apply_batch(known, ["id"]).withColumn("ignored", F.lit(len(extra)))


# --- transactions --------------------------------------------------------------------------------


def orders_as_transactions(t: Tables):
    return G.transactions(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate")


def _choose(values, n="n"):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"


TXN = f"""SELECT lpad(CAST(n AS VARCHAR), 12, '0') || '-' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4)
    || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS transaction_id, n % 1000000 AS customer_id,
  'user' || n % 1000000 || '@example.com' AS customer_email, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_timestamp,
  'PROD-' || lpad(CAST(n % 10 AS VARCHAR), 6, '0') AS product_id, {_choose(G.PRODUCTS)} AS product_name,
  {_choose(G.CATEGORIES)} AS product_category, n % 5 + 1 AS quantity, 10::DOUBLE + n % 500 AS unit_price,
  (n % 5 + 1) * (10::DOUBLE + n % 500) AS total_amount, 'USD' AS currency, {_choose(G.PAYMENT_METHODS)} AS payment_method,
  'confirmed' AS order_status
FROM (SELECT o_orderkey AS n, o_orderdate, lpad(lower(to_hex(o_orderkey)), 32, '0') AS h FROM orders)"""


@query("txn_generate", TXN)
def _(t):
    return orders_as_transactions(t).drop("shipping_address")


META_LENGTH = """list_sum(list_transform(range(50), lambda i: 20 * length('value_' || n || '_' || i)))"""


@query(
    "address_blob",
    f"""SELECT n, (n % 9999 + 1) || ' ' || {_choose(G.STREETS)} AS street, {_choose(G.CITIES)} AS city,
  lpad(CAST(n % 999999 AS VARCHAR), 6, '0') AS postal_code, '#' || lpad(CAST(n % 99 + 1 AS VARCHAR), 2, '0') || '-'
    || lpad(CAST(n % 999 + 1 AS VARCHAR), 3, '0') AS unit, 1.3521::DOUBLE + (n % 1000) / 10000::DOUBLE AS latitude,
  repeat('value_' || n || '_49', 20) AS last_field, {META_LENGTH}::BIGINT AS metadata_chars
FROM (SELECT o_orderkey AS n FROM orders)""",
)
def _(t):
    # Each number grows to kilobytes, so the few input files are spread over all cores first.
    numbers = spread(t.orders.select(F.col("o_orderkey").alias("n")), "n")
    schema = """street_address string, city string, postal_code string, unit string,
      coordinates struct<latitude: double>, metadata map<string, string>"""
    parsed = numbers.select("n", F.from_json(G.address_blob("n"), schema).alias("j"))
    chars = F.aggregate(F.map_values("j.metadata"), F.lit(0).cast("long"), lambda a, v: a + F.length(v))
    return parsed.select(
        "n",
        F.col("j.street_address").alias("street"),
        "j.city",
        "j.postal_code",
        "j.unit",
        F.col("j.coordinates.latitude").alias("latitude"),
        F.col("j.metadata")["field_49"].alias("last_field"),
        chars.alias("metadata_chars"),
    )


def numbers_stream(t: Tables):
    """The orders in shuffled files as a stream of several batches. A batch has two files, so its numbers are spread over all cores."""
    numbers = scratch_path(t.spark, "numbers")
    rows = t.orders.select("o_orderkey", "o_orderdate")
    rows.repartition("o_orderkey").write.parquet(numbers)
    return spread(t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(numbers), "o_orderkey")


@query("stream_append", "SELECT payment_method, COUNT(*) AS n, CAST(SUM(quantity) AS BIGINT) AS units FROM (" + TXN + ") GROUP BY ALL")
def _(t):
    sink = scratch_path(t.spark, "sink")
    made = G.transactions(numbers_stream(t), "o_orderkey", "o_orderdate")
    G.append_stream(made, sink, scratch_path(t.spark, "checkpoint"), available_now=True).awaitTermination()
    back = t.spark.read.schema(made.schema).parquet(sink)
    return back.groupBy("payment_method").agg(F.count("*").alias("n"), F.sum("quantity").alias("units"))


@query(
    "stream_rates",
    "SELECT COUNT(*) AS rows, CAST(SUM(strlen(transaction_id) + strlen(customer_email)) AS BIGINT) AS bytes, COUNT(*) AS in_sink, TRUE AS peak_above_mean FROM (" + TXN + ")",
)
def _(t):
    """What the stream measured of itself, batch by batch, beside a count of what it wrote."""
    sink = scratch_path(t.spark, "rated")
    made = G.transactions(numbers_stream(t), "o_orderkey", "o_orderdate")
    size = F.octet_length("transaction_id") + F.octet_length("customer_email")
    rates.append_with_rates(made, sink, scratch_path(t.spark, "checkpoint"), size, available_now=True).awaitTermination()
    found = rates.report(rates.batch_rates(t.spark, sink))
    arrived = rates.written(t.spark, sink).agg(F.count("*")).scalar()
    return found.select("rows", "bytes", arrived.alias("in_sink"), (F.col("peak_bytes_per_second") >= F.col("avg_bytes_per_second")).alias("peak_above_mean"))


@query("stress_verify", "SELECT COUNT(*) AS rows, SUM(strlen(text)) / 1e9 AS gigabytes FROM documents")
def _(t):
    return G.verify(t.documents, "text")


@query(
    "throughput_report",
    with_sql(
        ("s", "SELECT date_trunc('second', ts) AS second, COUNT(*) AS n, SUM(strlen(props) * 100) AS b FROM events GROUP BY ALL"),
        ("r", "SELECT *, (epoch_us(MAX(second) OVER ()) - epoch_us(MIN(second) OVER ())) // 1000000 + 1 AS secs FROM s"),
        body="""SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(b) AS BIGINT) AS bytes, SUM(b)::DOUBLE / SUM(n) AS avg_row_bytes,
  CAST(MAX(b) AS BIGINT) AS peak_bytes_per_second, MAX(secs) AS seconds, SUM(b)::DOUBLE / MAX(secs) AS avg_bytes_per_second FROM r""",
    ),
)
def _(t):
    return G.throughput(t.events, "ts", F.octet_length("props") * 100)


N_FIELDS = len(G.message_fields())


@query(
    "wide_sparse_generate",
    f"""WITH cells AS (SELECT event_id AS n, event_id % {G.GROUPS} + 1 AS g, f, (event_id % {G.GROUPS}) * {N_FIELDS} + f AS idx
  FROM events, (SELECT unnest(range({N_FIELDS})) AS f)),
v AS (SELECT *, (n * (7919 + 2 * idx) + 104729 * (idx + 1)) % 1000003 AS h FROM cells),
k AS (SELECT *, CASE WHEN f = {N_FIELDS - 1} THEN h % 10000 < CASE WHEN g % 3 = 0 THEN 4000 ELSE 12 END
  ELSE g % 3 = 0 OR h % 10000 < 4000 END AS present FROM v)
SELECT 'mt' || lpad(CAST(g AS VARCHAR), 2, '0') AS message_type, COUNT(DISTINCT n) AS rows,
  COUNT(*) FILTER (WHERE present AND f < {len(G.INT_FIELDS)}) AS filled_ints,
  COALESCE(SUM(h % 1000000) FILTER (WHERE present AND f < {len(G.INT_FIELDS)}), 0)::BIGINT AS int_total,
  COUNT(*) FILTER (WHERE present AND f >= {len(G.INT_FIELDS)}) AS filled_others, 428 AS width FROM k GROUP BY g""",
)
def _(t):
    numbers = spread(t.events.select("event_id", "ts"), "event_id")
    wide = G.wide_messages(numbers, "event_id", "ts")
    groups = range(1, G.GROUPS + 1)
    ints = ", ".join(f"mt{g:02d}__{f}" for g in groups for f in G.INT_FIELDS)
    others = ", ".join(f"CAST(mt{g:02d}__{f} AS STRING)" for g in groups for f in [*G.STR_FIELDS, G.TIME_FIELD])
    # Every column of every group is read, so a value in a foreign group would show.
    return (
        wide.selectExpr("message_type", f"array_compact(array({ints})) AS i", f"array_compact(array({others})) AS o")
        .groupBy("message_type")
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.size("i").cast("long")).alias("filled_ints"),
            F.sum(F.aggregate("i", F.lit(0).cast("long"), lambda a, x: a + x)).alias("int_total"),
            F.sum(F.size("o").cast("long")).alias("filled_others"),
        )
        .withColumn("width", F.lit(len(wide.columns)))
    )
