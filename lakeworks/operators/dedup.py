"""One row per key, bounded results and set differences of schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order.

    Spark limits each key to one row before the shuffle, so a very frequent key does not
    travel whole. Give an order that ends in a unique column.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The k leading rows of a report; the order must end in a unique column."""
    return df.orderBy(*order).limit(k)


def bounded(df: DataFrame, limit: int, *order: Column | str) -> tuple[DataFrame, bool]:
    """At most ``limit`` rows and whether more existed. Reads ``limit + 1`` rows once."""
    probe = settle((df.orderBy(*order) if order else df).limit(limit + 1), "probe")
    return probe.limit(limit), probe.count() > limit


def schema_diff(base: DataFrame, other: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """(column, problem, base type, other type) for missing, extra and retyped columns."""
    a, b = dict(base.dtypes), dict(other.dtypes)
    found = [(c, "missing", a[c], None) for c in a if c not in b]
    found += [(c, "extra", None, b[c]) for c in b if c not in a]
    found += [(c, "type", a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return sorted(found)
