"""Order-dependent results that no single task has to sort.

A window over everything, or over one very large group, runs in one task. Here rows are
range-partitioned on the order instead, numbered inside each range, and tied together by a
small table with one row per range (or per range and group). The same path serves any size;
only the number of ranges follows the data. A NULL in a group column is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import div
from ..session import settle

PART, AT = "_part", "_at"
RANGE_BYTES = 128 * 2**20
_AT_BITS = 33  # monotonically_increasing_id() keeps the partition above them


def _scanned_bytes(df: DataFrame) -> int:
    """Bytes of the tables a frame reads; unknown sizes count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 2**60)


def into_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add ``_part``, the number of the range a row falls in, and ``_at``, its place there from 0.

    The rows are settled in the shared folder: bounds come from samples and must read back the
    same in every later pass. Rows of equal ``order`` come in any order, so give one that is
    unique wherever they differ. Large inputs get a range per ``RANGE_BYTES`` scanned; otherwise
    the shuffle partitions, merged where they are small.
    """
    wanted = -(-_scanned_bytes(df) // RANGE_BYTES)
    if ranges is None and wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ranges = wanted
    # Copies of one row spread by the partition they come from, which a retry does not change.
    tied = df.withColumn("_tie", F.spark_partition_id())
    keys = [*order, "_tie"]
    ranged = tied.repartitionByRange(*keys) if ranges is None else tied.repartitionByRange(ranges, *keys)
    placed = ranged.drop("_tie").sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    place = F.col("_place")
    return settle(placed, "ranges").select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.shiftright(place, _AT_BITS).cast("int").alias(PART),
        place.bitwiseAND(F.lit((1 << _AT_BITS) - 1)).alias(AT),
    )


def _range_sizes(ranged: DataFrame) -> DataFrame:
    """One row per range: rows before it and rows in all."""
    sizes = ranged.groupBy(PART).agg(F.count("*").alias("_n"))
    w = Window.orderBy(PART)
    return sizes.select(
        PART,
        (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )


def with_global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """Row number over the whole order, with ``_total`` rows alongside."""
    ranged = into_ranges(df, order, ranges)
    # One row per range.
    placed = ranged.join(F.broadcast(_range_sizes(ranged)), PART)
    return placed.withColumn(name, F.col("_before") + F.col(AT) + 1).drop("_before", AT, PART)


def tile_of(rank: Column, total: Column, tiles: int) -> Column:
    """Bucket 1..tiles of a row number; the first ``total mod tiles`` buckets get one row more."""
    small = div(total, tiles)
    extra = total % F.lit(tiles)
    edge = extra * (small + 1)
    late = extra + div(rank - edge - 1, F.greatest(small, F.lit(1))) + 1
    return F.when(rank <= edge, div(rank - 1, small + 1) + 1).otherwise(late)


def ntile(df: DataFrame, tiles: int, order: Sequence[str], name: str = "tile", ranges: int | None = None) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY order)`` without a single-task sort."""
    ranked = with_global_rank(df, order, "_rank", ranges)
    return ranked.withColumn(name, tile_of(F.col("_rank"), F.col("_total"), tiles)).drop("_rank", "_total")


class GroupOrder:
    """Rows of any group size in group order, for row numbers, next rows and running sums.

    Rows made here keep ``_part`` and ``_at``.
    """

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[str], ranges: int | None = None):
        self.group, self.order = list(group), list(order)
        self.columns = list(df.columns)
        self.df = into_ranges(df, self.group + self.order, ranges)
        self._local = Window.partitionBy(PART, *self.group).orderBy(AT)
        self._earlier = Window.partitionBy(*self.group).orderBy(PART)

    def _with_run(self, rows: DataFrame, runs: DataFrame) -> DataFrame:
        """Join the columns of a table with one row per range and group.

        A group reaches into many ranges only by filling the ones between, so such a table is
        about as long as ranges plus groups.
        """
        keys = [PART, *self.group]
        named = runs.select(*[F.col(k).alias(f"_run_{i}") for i, k in enumerate(keys)], *[c for c in runs.columns if c not in keys])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_run_{i}")) for i, k in enumerate(keys)])
        return rows.join(named, same).drop(*[f"_run_{i}" for i in range(len(keys))])

    def _numbered(self, rows: DataFrame, name: str) -> DataFrame:
        runs = self.df.groupBy(PART, *self.group).agg(F.count("*").alias("_n"), F.min(AT).alias("_first_at"))
        before = F.coalesce(F.sum("_n").over(self._earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bases = runs.select(PART, *self.group, (before - F.col("_first_at") + 1).alias("_base"))
        return self._with_run(rows, bases).withColumn(name, (F.col("_base") + F.col(AT)).cast("long")).drop("_base")

    def numbered(self, name: str = "seq") -> DataFrame:
        """``ROW_NUMBER() OVER (PARTITION BY group ORDER BY order)``."""
        return self._numbered(self.df, name)

    def with_next(self, values: Sequence[str], prefix: str = "next_", number: str | None = None) -> DataFrame:
        """``LEAD`` of the named columns, NULL on the last row of a group; ``number`` adds the row number."""
        packed = F.struct(*values)
        counted = [F.count("*").alias("_n"), F.min(AT).alias("_first_at")]
        runs = self.df.groupBy(PART, *self.group).agg(F.min_by(packed, AT).alias("_first"), *counted)
        before = F.coalesce(F.sum("_n").over(self._earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # One table of runs ties the ranges together, for the next rows and for the numbers.
        bases = [(before - F.col("_first_at") + 1).alias("_base")] if number else []
        edges = runs.select(PART, *self.group, F.lead("_first").over(self._earlier).alias("_edge"), *bases)
        rows = self._with_run(self.df.withColumn("_lead", F.lead(packed).over(self._local)), edges)
        kept = [F.col(f"`{c}`") for c in (*self.columns, PART, AT)]
        if number:
            kept.append((F.col("_base") + F.col(AT)).cast("long").alias(number))
        nxt = F.coalesce(F.col("_lead"), F.col("_edge"))
        return rows.select(*kept, *[nxt[v].alias(prefix + v) for v in values])

    def sum_before(self, rows: DataFrame, value: str, name: str) -> DataFrame:
        """Sum of ``value`` over the earlier rows of the group, for rows made by this object."""
        past = Window.unboundedPreceding, -1
        inner = F.coalesce(F.sum(value).over(self._local.rowsBetween(*past)), F.lit(0))
        totals = rows.groupBy(PART, *self.group).agg(F.sum(value).alias("_sum"))
        carry = totals.select(PART, *self.group, F.coalesce(F.sum("_sum").over(self._earlier.rowsBetween(*past)), F.lit(0)).alias("_carry"))
        summed = self._with_run(rows.withColumn("_inner", inner), carry)
        return summed.withColumn(name, F.col("_carry") + F.col("_inner")).drop("_carry", "_inner")


def ordered_lists(
    numbered: DataFrame, group: Sequence[str], number: str, value: Column, size: int, name: str = "items"
) -> DataFrame:
    """``ARRAY_AGG(value ORDER BY number)`` in parts of at most ``size`` elements.

    ``part`` counts from 0; a group no larger than ``size`` has one part. No array can outgrow
    a task, whatever the group size.
    """
    part = div(F.col(number) - 1, size)
    lists = numbered.groupBy(*group, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(number).alias("_n"), value.alias("v")))).alias("_sorted")
    )
    return lists.select(*group, "part", F.transform("_sorted", lambda x: x["v"]).alias(name))
