"""Row numbers over a whole table, and within groups of any size, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

_LOCAL = (1 << 33) - 1  # monotonically_increasing_id() keeps the partition above 33 bits


def sorted_rows(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows in range partitions, written, with ``part`` and ``at``: a row's range and place in it.

    Copies of one row are dealt out by the partition they come from, so they need not share a range.
    """
    tied = df.withColumn("tie", F.spark_partition_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    kept = written(tied.drop("tie").withColumn("place", place), "sorted")
    part = F.shiftright("place", 33).cast("int").alias("part")
    return kept.select(*df.columns, part, F.col("place").bitwiseAND(F.lit(_LOCAL)).alias("at"))


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """Add the row number from 0 in the given order. Rows equal in it are numbered in any order."""
    rows = sorted_rows(df, order)
    # One row per range.
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part", before.alias("start")))
    return rows.join(starts, "part").withColumn(name, F.col("start") + F.col("at")).drop("part", "at", "start")


def number_as_stored(df: DataFrame, columns: Sequence[str], name: str = "number") -> DataFrame:
    """Some columns, and each row's number from 0 in the order of the files that ``df`` was read from.

    Reading does not keep that order: Spark packs the parts of files into tasks by their size. A ``df``
    that is not just a read table is written first, so its order is that of its partitions.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        df = written(df.select(*columns), "stored")
    stored = df.metadataColumn("_metadata")
    of_file, at, file, start = (free_name(df, x) for x in ("of_file", "at", "file", "start"))
    path, row = stored.getField("file_path"), stored.getField("row_index").alias(at)
    # One row per file. Spark numbers the files it writes, with five digits or more.
    sizes = df.select(path.alias(of_file), row).groupBy(of_file).agg((F.max(at) + 1).alias("n"))
    part = F.regexp_extract(of_file, r"part-(\d+)[^/]*$", 1).try_cast("long")
    earlier = Window.orderBy(part.asc_nulls_first(), of_file).rowsBetween(Window.unboundedPreceding, -1)
    # Sixteen bytes per file: 64 bits of its path and its first number, so a million files are a broadcast of 16 MB.
    starts = F.broadcast(sizes.select(F.xxhash64(of_file).alias(file), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start)))
    kept = [F.col(f"`{c}`") for c in columns]
    rows = df.select(*kept, F.xxhash64(path).alias(of_file), row).join(starts, F.col(of_file) == F.col(file))
    return rows.select(*kept, (F.col(start) + F.col(at)).alias(name))


def number_in_groups(df: DataFrame, group: str, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """Add the row number from 0 within each group, null being a group too."""
    rows = sorted_rows(df, [group, *order])
    # A row per range and group in it: about as many as ranges plus groups.
    runs = rows.groupBy("part", group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("part").alias("of_part"), F.col(group).alias("of_group"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start"),
    )
    same = (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group"))
    numbered = rows.join(starts, same).withColumn(name, F.col("start") + F.col("at"))
    return numbered.drop("part", "at", "start", "of_part", "of_group")
