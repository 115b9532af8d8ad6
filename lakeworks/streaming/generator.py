"""Deterministic transactions and wide sparse messages from sequence numbers.

Everything is a column expression over one number per row, so a rate stream, a range or any
key column can drive it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import col, safe_divide, uuid_of, zero_padded

# Fixed values.
PRODUCTS = [
    "Wireless Bluetooth Headphones",
    "USB-C Charging Cable",
    "Laptop Stand Aluminum",
    "Mechanical Keyboard RGB",
    "Ergonomic Mouse Wireless",
    "4K Webcam Pro",
    "Portable SSD 1TB",
    "Phone Case Protective",
    "Screen Protector Tempered Glass",
    "Power Bank 20000mAh",
]
CATEGORIES = ["Electronics", "Accessories", "Computing", "Peripherals", "Storage", "Mobile", "Audio"]
PAYMENT_METHODS = ["credit_card", "debit_card", "paypal", "apple_pay", "google_pay"]
STREETS = [
    "Main Street",
    "Oak Avenue",
    "Maple Drive",
    "Cedar Lane",
    "Pine Road",
    "Elm Boulevard",
    "Washington Street",
    "Park Avenue",
]
CITIES = ["Singapore", "Kuala Lumpur", "Jakarta", "Bangkok", "Manila", "Ho Chi Minh City"]
INSTRUCTIONS = (
    "Please call upon arrival. Leave package with security if no answer. "
    "Building has restricted access after 10 PM. Contact number: +65-%s. "
    "Additional notes: This is a residential unit. Please ring doorbell twice. "
    "If delivering during office hours, recipient may be at work. "
    "Alternative contact available upon request."
)
METADATA_FIELDS, METADATA_REPEATS = 50, 20


def pick(values: list[str], n: Column) -> Column:
    """Value number ``n`` modulo the list length."""
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def _text(n: Column) -> Column:
    return n.cast("string")


def _metadata(n: Column) -> Column:
    """The JSON object of the repeated fields: constant pieces joined by the number's text, which needs no escapes."""
    field = lambda i: f'"field_{i}":"' + f"value_#_{i}" * METADATA_REPEATS + '"'
    pieces = F.split(F.lit("{" + ",".join(field(i) for i in range(METADATA_FIELDS)) + "}"), "#")
    empty = "{" + ",".join(f'"field_{i}":null' for i in range(METADATA_FIELDS)) + "}"
    return F.when(n.isNull(), F.lit(empty)).otherwise(F.call_function("concat_ws", _text(n), pieces))


def address_blob(n: Column | str) -> Column:
    """Nested address JSON of several kilobytes for one sequence number. Field names, texts and numbers are fixed values."""
    n = col(n)
    offset = (n % 1000) / F.lit(10000.0)
    unit = F.concat(F.lit("#"), zero_padded(n % 99 + 1, 2), F.lit("-"), zero_padded(n % 999 + 1, 3))
    address = F.to_json(
        F.struct(
            F.concat_ws(" ", _text(n % 9999 + 1), pick(STREETS, n)).alias("street_address"),
            unit.alias("unit"),
            F.concat(F.lit("Block "), _text(n % 50 + 1)).alias("building"),
            pick(CITIES, n).alias("city"),
            F.lit("Southeast Asia").alias("state"),
            zero_padded(n % 999999, 6).alias("postal_code"),
            F.lit("SG").alias("country"),
            F.struct((F.lit(1.3521) + offset).alias("latitude"), (F.lit(103.8198) + offset).alias("longitude")).alias("coordinates"),
            F.format_string(INSTRUCTIONS, zero_padded(n % 90000000 + 10000000, 8)).alias("delivery_instructions"),
        )
    )
    # Nearly all of the text is metadata, which the JSON writer would take character by character.
    return F.concat(F.substring(address, F.lit(1), F.length(address) - 1), F.lit(',"metadata":'), _metadata(n), F.lit("}"))


def transactions(numbers: DataFrame, number: str = "value", at: str = "timestamp") -> DataFrame:
    """Fourteen-column transactions from a sequence number and a time per row. Literals are fixed values."""
    n = F.col(number)
    customer = n % 1_000_000
    quantity = n % 5 + 1
    price = F.lit(10.0) + n % 500
    return numbers.select(
        F.concat_ws("-", zero_padded(n, 12), uuid_of(n)).alias("transaction_id"),
        customer.alias("customer_id"),
        F.concat(F.lit("user"), _text(customer), F.lit("@example.com")).alias("customer_email"),
        F.col(at).alias("order_timestamp"),
        F.concat(F.lit("PROD-"), zero_padded(n % len(PRODUCTS), 6)).alias("product_id"),
        pick(PRODUCTS, n).alias("product_name"),
        pick(CATEGORIES, n).alias("product_category"),
        quantity.alias("quantity"),
        price.alias("unit_price"),
        (quantity * price).alias("total_amount"),
        F.lit("USD").alias("currency"),
        pick(PAYMENT_METHODS, n).alias("payment_method"),
        address_blob(n).alias("shipping_address"),
        F.lit("confirmed").alias("order_status"),
    )


def rate_stream(spark: SparkSession, rows_per_second: int, partitions: int | None = None) -> DataFrame:
    """Unbounded sequence numbers."""
    reader = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    if partitions:
        reader = reader.option("numPartitions", partitions)
    return reader.load()


def append_stream(
    rows: DataFrame, path: str, checkpoint: str, partitions: int | None = None, available_now: bool = False
) -> StreamingQuery:
    """Spread rows over the cluster and append them, committing every second. Zstandard, since payloads repeat themselves over kilobytes."""
    spread = rows.repartition(partitions) if partitions else rows
    writer = spread.writeStream.format("parquet").option("compression", "zstd").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def verify(rows: DataFrame, text: str = "shipping_address") -> DataFrame:
    """Rows and gigabytes that arrived."""
    size = F.sum(F.octet_length(text)).cast("double")
    return rows.agg(F.count("*").alias("rows"), (F.coalesce(size, F.lit(0.0)) / F.lit(1e9)).alias("gigabytes"))


def throughput(rows: DataFrame, at: str, size: Column) -> DataFrame:
    """Rows, bytes, mean row size, and the peak and mean bytes per second."""
    per_second = rows.groupBy(F.date_trunc("second", at).alias("second")).agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    seconds = F.unix_seconds(F.max("second").cast("timestamp")) - F.unix_seconds(F.min("second").cast("timestamp")) + 1
    return per_second.agg(
        F.sum("n").alias("rows"),
        F.sum("b").alias("bytes"),
        safe_divide(F.sum("b"), F.sum("n")).alias("avg_row_bytes"),
        F.max("b").alias("peak_bytes_per_second"),
        seconds.alias("seconds"),
        safe_divide(F.sum("b"), seconds).alias("avg_bytes_per_second"),
    )


# --- wide sparse messages ----------------------------------------------------------------

GROUPS = 12
# Fixed values.
INT_FIELDS = [
    "country",
    "market",
    "instrument_group",
    "modifier",
    "commodity",
    "expiration_date",
    "strike_price",
    "order_number",
    "mp_quantity",
    "premium",
    "block",
    "time_validity",
    "exch_order_type",
    "open_close_req",
    "bid_or_ask",
    "order_type",
    "stop_condition",
    "total_volume",
    "delta_quantity",
    "balance_quantity",
    "display_quantity",
    "trade_price",
    "trade_quantity",
    "item_number",
    "deal_source",
]
STR_FIELDS = [
    "country_id",
    "ex_customer",
    "user_id",
    "ex_client",
    "customer_info",
    "exchange_info",
    "otri_reserved",
    "give_up_country",
    "give_up_customer",
]
TIME_FIELD = "exec_timestamp_nanos"
SYMBOLS = ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF", "GGG", "HHH"]


# Of an active group's rows, how many in ten thousand carry a value (fixed values): first in every
# third group, then in the others; time columns are the sparsest.
FILLED = {"value": (10_000, 4_000), "time": (4_000, 12)}


def filled(group: int, field: str) -> int:
    every_third, other = FILLED["time" if field == TIME_FIELD else "value"]
    return every_third if group % 3 == 0 else other


def _spread(index: int, modulus: int) -> str:
    """Pseudo-random number below ``modulus`` from the sequence number and a column index."""
    return f"((_n * {7919 + 2 * index} + {104729 * (index + 1)}) % 1000003 % {modulus})"


def message_fields() -> list[str]:
    return [*INT_FIELDS, *STR_FIELDS, TIME_FIELD]


def wide_columns() -> list[str]:
    """All 428 column names in order."""
    messages = [f"mt{g:02d}__{f}" for g in range(1, GROUPS + 1) for f in message_fields()]
    footer = ["seq_no", "timestamp_nanos", "receipt_timestamp_nanos", "file_name", "inserted_ts"]
    return ["date", "sym", "message_type", *messages, *footer]


def wide_messages(numbers: DataFrame, number: str, at: str) -> DataFrame:
    """428 columns; a row fills only the columns of its own message type.

    One select builds them all, as SQL text: some hundred columns are quicker to declare that
    way than call by call. Times are nanoseconds since 1970 in a long.
    """
    n, ts = F.col(number), F.col(at)
    symbols = "array(" + ", ".join(f"'{x}'" for x in SYMBOLS) + ")"
    seeds = numbers.select(
        n.cast("long").alias("_n"),
        ts.alias("_at"),
        (n % GROUPS + 1).cast("int").alias("_group"),
        (F.unix_micros(ts.cast("timestamp")) * 1000 + n % 1000).alias("_nanos"),
    )
    cols = [
        "to_date(_at) AS date",
        f"get({symbols}, CAST(_n % {len(SYMBOLS)} AS INT)) AS sym",
        "concat('mt', lpad(CAST(_group AS STRING), 2, '0')) AS message_type",
    ]
    index = 0
    for g in range(1, GROUPS + 1):
        for f in message_fields():
            present = f"_group = {g}"
            if filled(g, f) < 10_000:
                present += f" AND {_spread(index, 10_000)} < {filled(g, f)}"
            if f in INT_FIELDS:
                value = _spread(index, 1_000_000)
            elif f in STR_FIELDS:
                value = f"get({symbols}, CAST({_spread(index, 1_000_000)} % {len(SYMBOLS)} AS INT))"
            else:
                value = f"_nanos + {_spread(index, 1_000_000)}"
            cols.append(f"CASE WHEN {present} THEN {value} END AS mt{g:02d}__{f}")
            index += 1
    cols += [
        "_n AS seq_no",
        "_nanos AS timestamp_nanos",
        "_nanos + 1500 AS receipt_timestamp_nanos",
        "concat('file_', CAST(_n % 100 AS STRING)) AS file_name",
        "_at AS inserted_ts",
    ]
    return seeds.selectExpr(*cols)
