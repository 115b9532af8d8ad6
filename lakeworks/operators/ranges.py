"""Keys covered by any of a set of ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import any_of
from .ordered import AT, PART, into_ranges


def in_any(column: Column, pairs: Sequence[tuple]) -> Column:
    """True when one of a few known ranges holds the value. Plain comparisons, so a scan can skip row groups."""
    return any_of([column.between(F.lit(lo), F.lit(hi)) for lo, hi in pairs])


def range_expand(keys: DataFrame, ranges: DataFrame, key: str, low: str = "low_value", high: str = "high_value") -> DataFrame:
    """Distinct keys covered by at least one range, bounds included.

    Keys and lower bounds are swept in one order: a key is covered when the highest upper bound so
    far reaches it. No range is joined to all keys, and the plan is the same for any number of ranges.
    """
    return _sweep(_within(keys, key, ranges, low, high).select(key).distinct(), ranges, key, low, high)


def _within(df: DataFrame, key: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Rows between the least and the greatest bound, so that a scan can skip the others."""
    ends = ranges.agg(F.min(low).alias("low"), F.max(high).alias("high")).first()
    if ends["low"] is None or ends["high"] is None:
        return df.limit(0)
    return df.filter(in_any(F.col(key), [(ends["low"], ends["high"])]))


def _sweep(distinct: DataFrame, ranges: DataFrame, key: str, low: str, high: str) -> DataFrame:
    points = distinct.select(F.col(key).alias("_v"), F.lit(1).alias("_is_key"), F.lit(None).alias("_high"))
    # One lower bound keeps its highest upper bound, so the order below is unique.
    starts = ranges.groupBy(F.col(low).alias("_v")).agg(F.lit(0).alias("_is_key"), F.max(high).alias("_high"))
    order = ["_v", "_is_key"]
    ranged = into_ranges(starts.unionByName(points.withColumn("_high", F.col("_high").cast(starts.schema["_high"].dataType))), order)
    # One row per range of the order; the highest bound of all earlier ones is carried into each.
    tops = ranged.groupBy(PART).agg(F.max("_high").alias("_top"))
    rows, best = [], None
    for part, top in sorted(tuple(r) for r in tops.select(PART, "_top").collect()):
        rows.append((part, best))
        best = top if best is None or (top is not None and top > best) else best
    kind = starts.schema["_high"].dataType.simpleString()
    carry = distinct.sparkSession.createDataFrame(rows, f"{PART} int, _carry {kind}")
    local = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("_local", F.max("_high").over(local)).join(F.broadcast(carry), PART)
    # greatest() skips NULL, which is what is wanted here.
    reached = F.greatest("_local", "_carry") >= F.col("_v")
    return swept.filter((F.col("_is_key") == 1) & reached).select(F.col("_v").alias(key))


def keep_in_ranges(df: DataFrame, key: str, ranges: DataFrame, low: str = "low_value", high: str = "high_value") -> DataFrame:
    """Rows whose key lies in any range, each once."""
    near = _within(df, key, ranges, low, high)
    return near.join(range_expand(near, ranges, key, low, high), key, "left_semi")
