"""Bronze to silver to gold: cleaned sources, facts and dimensions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import (
    case_group,
    case_map,
    convert_currency,
    first_match,
    fixed_sum,
    fixed_units,
    flag,
    safe_divide,
    total_units,
)
from ..operators.dedup import keep_first

# Fixed values.
ORDER_STATUS = {
    "completed": "COMPLETED",
    "shipped": "IN_TRANSIT",
    "processing": "PROCESSING",
    "pending": "PENDING",
    "cancelled": "CANCELLED",
    "refunded": "REFUNDED",
}
STATUS_GROUPS = {
    "FULFILLED": ["completed", "shipped"],
    "IN_PROGRESS": ["processing", "pending"],
    "CANCELLED": ["cancelled", "refunded"],
}
USD_RATES = {"USD": 1.0, "GBP": 1.27, "EUR": 1.08, "CAD": 0.74, "AUD": 0.65}
CATEGORY_NAMES = {
    "ELECTRONICS": "Electronics & Gadgets",
    "OFFICE": "Office Supplies",
    "HOME": "Home & Living",
}
COUNTRY_NAMES = {
    "US": "United States",
    "UK": "United Kingdom",
    "CA": "Canada",
    "AU": "Australia",
    "DE": "Germany",
}
SOURCE_SYSTEM = "sample_project"
BULK_QUANTITY = 3
BULK_DISCOUNT = 0.10


def order_status(status: str = "status") -> Column:
    return case_map(status, ORDER_STATUS, "UNKNOWN")


def status_category(status: str = "status") -> Column:
    return case_group(status, STATUS_GROUPS, "OTHER")


# Band edges and labels of the next three functions: fixed values.
def order_size(amount: str = "total_amount") -> Column:
    a = F.col(amount)
    return first_match([(a < 50, "SMALL"), (a.between(50, 200), "MEDIUM"), (a.between(200, 500), "LARGE")], "ENTERPRISE")


def stock_status(stock: str = "stock_quantity") -> Column:
    s = F.col(stock)
    return first_match([(s == 0, "OUT_OF_STOCK"), (s < 50, "LOW_STOCK"), (s < 200, "IN_STOCK")], "WELL_STOCKED")


def price_tier(price: str = "price") -> Column:
    p = F.col(price)
    return first_match([(p < 20, "BUDGET"), (p.between(20, 50), "MID_RANGE"), (p.between(50, 100), "PREMIUM")], "LUXURY")


def with_audit(df: DataFrame, source: str = SOURCE_SYSTEM) -> DataFrame:
    """Load time and source system."""
    return df.withColumns({"gold_loaded_at": F.current_timestamp(), "gold_source_system": F.lit(source)})


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        F.trim(F.upper("first_name")).alias("first_name"),
        F.trim(F.upper("last_name")).alias("last_name"),
        F.lower(F.trim("email")).alias("email"),
        "country_code",
        "created_at",
        "updated_at",
        F.concat(F.trim("first_name"), F.lit(" "), F.trim("last_name")).alias("full_name"),
    )


def deduplicated_orders(raw: DataFrame) -> DataFrame:
    # Rows of one time are told apart by all their columns, so the choice does not depend on row order.
    return keep_first(raw, ["order_id"], ["created_at", F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])])


def with_status(orders: DataFrame) -> DataFrame:
    return orders.withColumns({"order_status": order_status(), "status_category": status_category()}).withColumnRenamed(
        "status", "raw_status"
    )


def with_amounts(orders: DataFrame) -> DataFrame:
    return orders.withColumns(
        {
            "order_date_key": F.to_date("order_date"),
            "total_amount_usd": convert_currency("total_amount", "currency", USD_RATES),
            "order_size_category": order_size(),
        }
    )


STG_ORDER_COLUMNS = [
    "order_id",
    "customer_id",
    "order_date",
    "order_date_key",
    "raw_status",
    "order_status",
    "status_category",
    "total_amount",
    "currency",
    "total_amount_usd",
    "order_size_category",
    "created_at",
]


def stg_orders(raw: DataFrame) -> DataFrame:
    return with_amounts(with_status(deduplicated_orders(raw))).select(*STG_ORDER_COLUMNS)


def stg_products(raw: DataFrame) -> DataFrame:
    return raw.select(
        "product_id",
        "product_name",
        "category_code",
        case_map("category_code", CATEGORY_NAMES, "Other").alias("category_name"),
        "price",
        "stock_quantity",
        "is_active",
        stock_status().alias("stock_status"),
        price_tier().alias("price_tier"),
        "created_at",
    )


def with_line_totals(items: DataFrame) -> DataFrame:
    """Line totals; three or more units earn ten percent off."""
    bulk = F.col("quantity") >= BULK_QUANTITY
    total = F.col("quantity") * F.col("unit_price")
    return items.withColumns(
        {
            "line_total": total,
            "discount_rate": F.when(bulk, F.lit(BULK_DISCOUNT)).otherwise(F.lit(0.0)),
            "line_total_after_discount": F.when(bulk, total * F.lit(1 - BULK_DISCOUNT)).otherwise(total),
        }
    )


def stg_order_items(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    o = orders.select("order_id", "customer_id", "order_date", "order_status")
    p = products.select("product_id", "product_name", "category_name")
    return (
        with_line_totals(items)
        .join(o, "order_id", "left")
        .join(p, "product_id", "left")
        .select(
            "line_id",
            "order_id",
            "customer_id",
            "order_date",
            "order_status",
            "product_id",
            "product_name",
            "category_name",
            "quantity",
            "unit_price",
            "line_total",
            "discount_rate",
            "line_total_after_discount",
        )
    )


def order_item_summary(items: DataFrame) -> DataFrame:
    """Per order: distinct lines and products, units, totals. Lines without totals get them by ``with_line_totals``.

    The lines of an order are brought together once and put in order, where a value that differs from the one before
    is a new one; two distinct counts in one grouping would shuffle every line three times over, and then again.
    """

    def first_seen(c: str) -> Column:
        before = F.lag(c).over(Window.partitionBy("order_id").orderBy(c))
        return F.col(c).isNotNull() & ~F.col(c).eqNullSafe(before)

    # A price and a quantity are shuffled in less room than two totals.
    totals = ["line_total", "line_total_after_discount"]
    given = all(c in items.columns for c in totals)
    seen = items.select("order_id", "line_id", "product_id", "quantity", *(totals if given else ["unit_price"]))
    seen = seen.withColumn("_line", first_seen("line_id")).withColumn("_product", first_seen("product_id"))
    seen = seen if given else with_line_totals(seen)
    return seen.groupBy("order_id").agg(
        F.count_if("_line").alias("total_line_items"),
        F.sum("quantity").alias("total_units"),
        F.count_if("_product").alias("unique_products"),
        fixed_sum("line_total", 4).alias("subtotal"),
        fixed_sum("line_total_after_discount", 4).alias("subtotal_after_discount"),
        fixed_sum(F.col("line_total") - F.col("line_total_after_discount"), 4).alias("total_discount_amount"),
    )


def customer_orders(orders: DataFrame) -> DataFrame:
    """Per customer: orders, completed orders, revenue, first and last date.

    One row per order comes first (no further shuffle after the deduplication by order), so
    the distinct order counts are plain counts.
    """
    usd = F.col("total_amount_usd")
    per_order = orders.groupBy("customer_id", "order_id").agg(
        F.sum(fixed_units(usd, 4)).alias("units"),
        F.count(usd).alias("valued"),
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
        F.max(F.col("order_status") == "COMPLETED").alias("completed"),
    )
    revenue = total_units(F.col("units")) / 1e4
    return per_order.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        revenue.alias("total_revenue_usd"),
        (safe_divide(total_units(F.col("units")), F.sum("valued")) / 1e4).alias("avg_order_value_usd"),
        F.min("first_date").alias("first_order_date"),
        F.max("last_date").alias("last_order_date"),
        F.count_if("completed").alias("completed_orders"),
    )


def dim_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    n, revenue = F.col("total_orders"), F.col("total_revenue_usd")
    segment = first_match(
        [(n.isNull(), "PROSPECT"), (n == 1, "NEW"), (n.between(2, 5), "ACTIVE"), (n > 5, "LOYAL")], "UNKNOWN"
    )
    tier = first_match(
        [
            (F.coalesce(revenue, F.lit(0.0)) == 0, "NO_PURCHASE"),
            (revenue < 100, "LOW_VALUE"),
            (revenue.between(100, 500), "MEDIUM_VALUE"),
            (revenue > 500, "HIGH_VALUE"),
        ],
        "UNKNOWN",
    )
    joined = customers.join(customer_orders(orders), "customer_id", "left")
    return with_audit(
        joined.select(
            "customer_id",
            "first_name",
            "last_name",
            "full_name",
            "email",
            "country_code",
            case_map("country_code", COUNTRY_NAMES, "Other").alias("country_name"),
            F.coalesce(n, F.lit(0)).alias("total_orders"),
            F.coalesce(revenue, F.lit(0.0)).alias("lifetime_value_usd"),
            F.coalesce("avg_order_value_usd", F.lit(0.0)).alias("avg_order_value_usd"),
            F.coalesce("completed_orders", F.lit(0)).alias("completed_orders"),
            "first_order_date",
            "last_order_date",
            segment.alias("customer_segment"),
            tier.alias("value_tier"),
            F.col("created_at").alias("customer_created_at"),
            F.col("updated_at").alias("customer_updated_at"),
        )
    )


def dim_products(products: DataFrame) -> DataFrame:
    status = first_match(
        [(~F.col("is_active"), "DISCONTINUED"), (F.col("stock_quantity") == 0, "OUT_OF_STOCK")], "AVAILABLE"
    )
    return with_audit(
        products.select(
            "product_id",
            "product_name",
            "category_code",
            "category_name",
            "price",
            "price_tier",
            "stock_quantity",
            "stock_status",
            "is_active",
            status.alias("availability_status"),
            F.col("created_at").alias("product_created_at"),
        )
    )


def fct_orders(orders: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    """Order fact: 27 columns, one row per order. Items are summed before they are joined."""
    c = customers.select(
        "customer_id", F.col("full_name").alias("customer_name"), F.col("country_code").alias("customer_country")
    )
    units, subtotal, discount = F.col("total_units"), F.col("subtotal"), F.col("total_discount_amount")
    # The same columns in the same order, so that a plan with the fact twice shuffles its parts once.
    joined = orders.select(*STG_ORDER_COLUMNS).join(order_item_summary(items), "order_id", "left").join(c, "customer_id", "left")
    zero, none = F.lit(0.0), F.lit(0)
    return with_audit(
        joined.select(
            "order_id",
            "customer_id",
            "order_date_key",
            "customer_name",
            "customer_country",
            "order_date",
            "raw_status",
            "order_status",
            "status_category",
            F.col("total_amount").alias("order_total_original"),
            F.col("currency").alias("original_currency"),
            F.col("total_amount_usd").alias("order_total_usd"),
            "order_size_category",
            F.coalesce("total_line_items", none).alias("total_line_items"),
            F.coalesce(units, none).alias("total_units"),
            F.coalesce("unique_products", none).alias("unique_products"),
            F.coalesce(subtotal, zero).alias("line_items_subtotal"),
            F.coalesce("subtotal_after_discount", zero).alias("line_items_after_discount"),
            F.coalesce(discount, zero).alias("total_discount_amount"),
            F.when(units > 0, safe_divide(F.col("total_amount_usd"), units)).otherwise(zero).alias("avg_unit_price_usd"),
            F.when(subtotal > 0, safe_divide(discount, subtotal)).otherwise(zero).alias("discount_rate"),
            flag(F.col("order_status") == "COMPLETED").alias("is_completed"),
            flag(F.col("order_status") == "CANCELLED").alias("is_cancelled"),
            flag(discount > 0).alias("has_discount"),
            F.col("created_at").alias("order_created_at"),
        )
    )


def fct_orders_chain(raw_orders: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    """The same fact through three intermediate models; Catalyst folds their projections."""
    cleaned = deduplicated_orders(raw_orders)
    enriched = with_status(cleaned)
    final = with_amounts(enriched)
    return fct_orders(final, customers, items)


@dataclass
class Model:
    """A model function, the models it reads and how it is kept."""

    build: Callable[..., DataFrame]
    refs: Sequence[str] = field(default_factory=list)
    kept: str = "view"  # "view" stays lazy, "table" is written as Parquet


MODELS: dict[str, Model] = {
    "stg_customers": Model(stg_customers, ["raw_customers"]),
    "stg_orders": Model(stg_orders, ["raw_orders"]),
    "stg_products": Model(stg_products, ["raw_products"]),
    "stg_order_items": Model(stg_order_items, ["raw_items", "stg_orders", "stg_products"]),
    "dim_customers": Model(dim_customers, ["stg_customers", "stg_orders"], "table"),
    "dim_products": Model(dim_products, ["stg_products"], "table"),
    "fct_orders": Model(fct_orders, ["stg_orders", "stg_customers", "stg_order_items"], "table"),
}


def model_order(models: Mapping[str, Model]) -> list[str]:
    """Models after everything they read; a cycle raises."""
    return [m for m in TopologicalSorter({k: list(m.refs) for k, m in models.items()}).static_order() if m in models]


def run_models(
    spark: SparkSession, sources: Mapping[str, DataFrame], folder: str, models: Mapping[str, Model] | None = None
) -> dict[str, DataFrame]:
    """Build every model in reference order; tables are written under ``folder`` and read back."""
    models = MODELS if models is None else models
    built: dict[str, DataFrame] = dict(sources)
    for name in model_order(models):
        model = models[name]
        missing = [r for r in model.refs if r not in built]
        if missing:
            raise KeyError(f"model {name} reads unknown sources {missing}")
        df = model.build(*[built[r] for r in model.refs])
        if model.kept == "table":
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            df = spark.read.parquet(f"{folder}/{name}")
        df.createOrReplaceTempView(name)
        built[name] = df
    return built
