"""Exact distinct counts of whole-number keys that can be added up again, as bitmaps.

Counts of distinct keys do not add up from groups to totals, bitmaps of the keys do. A bitmap holds 32,768
neighbouring keys in 4 KB, so one pass over the table makes the bitmaps of its finest groups, and every
rollup, the grand total included, comes from joining those. Keys are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import div

BITS = 32_768
BITMAP_BYTES = 4096
KEY_BYTES = 24  # a key and its share of a row, shuffled
BUCKET, BITMAP = "_bucket", "_bitmap"


def key_bitmaps(df: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    """Per group and 32,768 neighbouring keys, a bitmap of the keys found. NULL keys are not counted."""
    known = df.filter(F.col(key).isNotNull())
    number = F.col(key).cast("long")
    made = known.groupBy(*groups, F.bitmap_bucket_number(number).alias(BUCKET))
    return made.agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITMAP))


def rolled_up(bitmaps: DataFrame, sets: Sequence[Sequence[str]], name: str = "distinct_keys") -> DataFrame:
    """Distinct keys per group of every set of columns, from the bitmaps of finer groups.

    Columns that a set leaves out are NULL; ``grouping`` is the place of the set. Bitmaps of several runs
    or days can be united before.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    wanted = [[*s, BUCKET] for s in sets]
    number = F.grouping_id()
    united = bitmaps.groupingSets(wanted, *columns, BUCKET).agg(number.alias("_set"), F.bitmap_or_agg(BITMAP).alias(BITMAP))
    # Bits of the grouping id are set for columns left out; the bucket, last, is in every set.
    codes = [sum(1 << (len(columns) - i) for i, c in enumerate(columns) if c not in s) for s in sets]
    place = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, i)]), F.col("_set").cast("int"))
    counted = united.groupBy(*columns, place.alias("grouping")).agg(F.sum(F.bitmap_count(BITMAP)).alias(name))
    return counted.select("grouping", *columns, name)


def pays_off(df: DataFrame, key: str, groups: Sequence[str]) -> bool:
    """Whether bitmaps of the keys are smaller than the keys: not for few keys spread over a wide range.

    One pass with an estimate of the pairs of group and key.
    """
    known = df.filter(F.col(key).isNotNull())
    number = F.col(key).cast("long")
    pairs = F.approx_count_distinct(F.struct(*groups, number)) if groups else F.approx_count_distinct(number)
    maps = F.approx_count_distinct(F.struct(*groups, div(number, BITS)))
    row = known.agg(pairs.alias("pairs"), maps.alias("maps")).first()
    return row["maps"] * BITMAP_BYTES <= row["pairs"] * KEY_BYTES


def distinct_rollup(df: DataFrame, key: str, sets: Sequence[Sequence[str]], name: str = "distinct_keys") -> DataFrame:
    """``COUNT(DISTINCT key)`` over GROUPING SETS, from one pass.

    Keys too scattered for bitmaps go as distinct pairs of finest group and key instead, which gives the same counts.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    if pays_off(df, key, columns):
        return rolled_up(key_bitmaps(df, key, columns), sets, name)
    pairs = df.filter(F.col(key).isNotNull()).select(*columns, F.col(key).alias("_key")).distinct()
    codes = [sum(1 << (len(columns) - i) for i, c in enumerate(columns) if c not in s) for s in sets]
    place = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, i)]), F.col("_set").cast("int"))
    keys = pairs.groupingSets([[*s, "_key"] for s in sets], *columns, "_key").agg(F.grouping_id().alias("_set"))
    return keys.groupBy(*columns, place.alias("grouping")).agg(F.count("*").alias(name)).select("grouping", *columns, name)
