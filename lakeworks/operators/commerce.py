"""Shop reports over orders, order items, users, products and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fixed_sum, fixed_units, safe_divide, total_units
from .dedup import top_k


def daily_revenue(items: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders, items and revenue by day, country, gender and status, over one row per order-day."""
    cents = F.col("cents")
    per_order = items.groupBy("order_id", F.to_date("created_at").alias("order_date")).agg(
        F.sum(fixed_units("sale_price")).alias("cents"), F.count("*").alias("item_count")
    )
    return (
        per_order.join(orders.select("order_id", "user_id", F.col("status").alias("order_status")), "order_id")
        .join(users, F.col("user_id") == F.col("id"))
        .groupBy("order_date", "country", "gender", "order_status")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.sum("item_count").alias("total_items"),
            F.round(total_units(cents) / 100, 2).alias("total_revenue"),
            F.round(total_units(cents) / F.count("*") / 100, 4).alias("avg_order_value"),
        )
    )


def monthly_revenue(items: DataFrame) -> DataFrame:
    return items.groupBy(F.date_trunc("month", "created_at").alias("month")).agg(
        F.count_distinct("order_id").alias("orders"), fixed_sum("sale_price").alias("revenue")
    )


def return_rate(items: DataFrame, products: DataFrame) -> DataFrame:
    """Share of returned items per category; items are counted per product before the join."""
    per_product = items.groupBy("product_id").agg(
        F.count("*").alias("n"), F.count("returned_at").alias("returned")
    )
    return (
        per_product.join(products, F.col("product_id") == F.col("id"))
        .groupBy("category")
        .agg(F.round(safe_divide(F.sum("returned"), F.sum("n")), 4).alias("return_rate"))
    )


def stock_by_center(items: DataFrame, centers: DataFrame) -> DataFrame:
    unsold = items.filter(F.col("sold_at").isNull()).groupBy("center_id").agg(F.count("*").alias("units"))
    return (
        unsold.join(centers, F.col("center_id") == F.col("id"))
        .groupBy(F.col("name").alias("center"))
        .agg(F.sum("units").alias("units_in_stock"))
    )


def product_revenue(items: DataFrame, products: DataFrame, *by: str) -> DataFrame:
    """Revenue by product attributes; items are summed per product before the join."""
    per_product = items.groupBy("product_id").agg(F.sum(fixed_units("sale_price")).alias("cents"))
    return (
        per_product.join(products, F.col("product_id") == F.col("id"))
        .groupBy(*by)
        .agg((total_units(F.col("cents")) / 100).alias("revenue"))
    )


def top_products(items: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    revenue = product_revenue(items, products, "name", "brand", "category")
    return top_k(revenue, k, F.col("revenue").desc(), "name", "brand", "category")


def top_categories(items: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    return top_k(product_revenue(items, products, "category"), k, F.col("revenue").desc(), "category")


def users_by_country(users: DataFrame, k: int = 10) -> DataFrame:
    return top_k(users.groupBy("country").agg(F.count("*").alias("users")), k, F.col("users").desc(), "country")


def recent(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; pass the time, never read the clock."""
    return df.filter(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def longest_unsold(items: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    ages = items.filter(F.col("sold_at").isNull()).select(
        "id", "product_id", "created_at", F.timestamp_diff("DAY", F.col("created_at"), as_of).alias("age_days")
    )
    return top_k(ages, k, "created_at", "id", "product_id")


def user_revenue(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Spend and orders per user; items are summed per order before orders are joined."""
    per_order = items.groupBy("order_id").agg(F.sum(fixed_units("sale_price")).alias("cents"))
    return (
        orders.select("order_id", "user_id", "created_at")
        .join(per_order, "order_id", "left")
        .groupBy("user_id")
        .agg(
            F.max("created_at").alias("last_order"),
            F.count_distinct("order_id").alias("frequency"),
            (F.coalesce(total_units(F.col("cents")), F.lit(0.0)) / 100).alias("monetary"),
        )
    )


def rfm_features(users: DataFrame, orders: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """Recency, frequency, monetary value and traffic source of every user."""
    spend = user_revenue(items, orders)
    return users.join(spend, users["id"] == spend["user_id"], "left").select(
        F.col("id").alias("user_id"),
        F.timestamp_diff("DAY", F.col("last_order"), as_of).alias("recency"),
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
        F.coalesce("monetary", F.lit(0.0)).alias("monetary"),
        "traffic_source",
    )


def customer_value(items: DataFrame, orders: DataFrame, k: int = 100) -> DataFrame:
    spend = user_revenue(items, orders).select("user_id", F.col("monetary").alias("clv"))
    return top_k(spend, k, F.col("clv").desc(), "user_id")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    bucket = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))


def order_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Product names per order; filter on ``order_id`` for one order."""
    return items.join(products, F.col("product_id") == products["id"]).select("order_id", F.col("name").alias("product_name"))


def shipping_days(orders: DataFrame, created: str, shipped: str, *by: str) -> DataFrame:
    """Mean whole days from order to shipment, per group."""
    days = F.timestamp_diff("DAY", F.col(created), F.col(shipped))
    return orders.groupBy(*by).agg(
        F.round(safe_divide(F.sum(days), F.count(days)), 4).alias("avg_shipping_days"), F.count(days).alias("shipped")
    )
