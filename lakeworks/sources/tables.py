"""Parquet tables with overwrite, append and merge.

A version of a table is a numbered list of immutable data files. Every load writes new files to a folder of
its own and then commits a list that has them; so a reader sees the old or the new version, a job that stops
half way leaves the old one as it was, and a merge rewrites only files that hold a matching key.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Sequence
from hashlib import md5
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .snapshots import Snapshots

CELLS_PER_FILE = 12_000_000
DAY = "_day"
LOAD = "_load"
ATTEMPTS = 50
WAIT = 0.01  # seconds more after each lost attempt, at most


class DuplicateKeys(ValueError):
    """A merge source holds a key more than once."""


class TableChanged(RuntimeError):
    """Another writer committed a version while a merge was reading the one before."""


def file_rows(df: DataFrame) -> int:
    """Rows of one file: fewer for wide tables, so that a file is a fair share of work."""
    return max(1, CELLS_PER_FILE // len(df.columns))


def by_partition(df: DataFrame, column: str, rows_per_file: int | None = None, spread_by: Sequence[str] | None = None) -> DataFrame:
    """Shuffle for a partitioned write: one file per partition value, more for a large one.

    Rows of a large value are split by a hash over as many tasks as it has files. The counts
    have one row per partition value.
    """
    rows_per_file = rows_per_file or file_rows(df)
    sizes = df.groupBy(column).agg(F.ceil(F.count("*") / F.lit(rows_per_file)).cast("int").alias("_files"))
    # The source partition goes into the hash, so that copies of one row spread out too.
    marked = df.withColumn("_spread", F.xxhash64(F.spark_partition_id(), *(spread_by or _hashable(df))))
    # A left join: a source that changes between the two passes loses no row.
    sized = marked.join(sizes.withColumnRenamed(column, "_value"), F.col(column).eqNullSafe(F.col("_value")), "left")
    filed = sized.withColumn("_file", F.pmod("_spread", F.coalesce("_files", F.lit(1))))
    return filed.repartition(column, "_file").drop("_file", "_files", "_value", "_spread")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


class ParquetTable:
    """One table folder; optionally partitioned by a column and sorted inside files."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        partition_by: str | None = None,
        sort_by: Sequence[str] = (),
        rows_per_file: int | None = None,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.partition_by, self.sort_by, self.rows_per_file = partition_by, list(sort_by), rows_per_file
        self._lists = Snapshots(spark, f"{self.root}/versions")

    def versions(self) -> list[int]:
        return self._lists.numbers()

    def exists(self) -> bool:
        return bool(self.versions())

    def _newest(self) -> tuple[int, dict]:
        number, listed = self._lists.newest()
        if listed is None:
            raise FileNotFoundError(f"no table at {self.root}")
        return number, listed

    def files(self, version: int | None = None) -> list[str]:
        """Data files of a version, the newest by default, below the table's folder."""
        return (self._newest()[1] if version is None else self._lists.read(version))["files"]

    def read(self, version: int | None = None) -> DataFrame:
        listed = self._newest()[1] if version is None else self._lists.read(version)
        return self._of_files(listed, listed["files"])

    def _of_files(self, listed: dict, names: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(listed["schema"])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self._stored(schema, names).select(*[F.col(f"`{f.name}`") for f in schema.fields])

    def _stored(self, schema: T.StructType, names: Sequence[str]) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/data")
        return reader.parquet(*[f"{self.root}/{n}" for n in names])

    @staticmethod
    def _below(path: str) -> str:
        """The part below the table's folder of a file's path as Spark reports it, with URL escapes."""
        text = unquote(path)
        return text[text.rindex(f"/data/{LOAD}=") + 1 :]

    def _folder_column(self, df: DataFrame) -> str:
        """Timestamps are partitioned by their day, other columns by value."""
        stamped = isinstance(df.schema[self.partition_by].dataType, (T.TimestampType, T.TimestampNTZType))
        return self.partition_by + DAY if stamped else self.partition_by

    def _laid_out(self, df: DataFrame) -> DataFrame:
        if not self.partition_by:
            return df
        name = self._folder_column(df)
        return df if name == self.partition_by else df.withColumn(name, F.to_date(self.partition_by))

    def _write(self, df: DataFrame, load: str) -> list[str]:
        """Write a load and return its files."""
        df = self._laid_out(df)
        lead = [self._folder_column(df)] if self.partition_by else []
        if lead:
            df = by_partition(df, lead[0], self.rows_per_file)
        if self.sort_by:
            df = df.sortWithinPartitions(*lead, *self.sort_by)
        writer = df.write.option("compression", "snappy").option("maxRecordsPerFile", self.rows_per_file or file_rows(df))
        path = f"{self.root}/data/{load}"
        (writer.partitionBy(*lead) if lead else writer).parquet(path)
        return [self._below(f) for f in self.spark.read.schema(df.schema).parquet(path).inputFiles()]

    def _load_name(self, load_id: str | None = None) -> str:
        """``_load=<id>-<attempt>``: every attempt has a folder of its own."""
        name = "" if load_id is None else md5(load_id.encode()).hexdigest()
        return f"{LOAD}={name}-{uuid.uuid4().hex}"

    def _commit(self, change: Callable[[dict | None], dict]) -> None:
        """Commit what ``change`` makes of the newest list; again if another writer was faster."""
        for attempt in range(ATTEMPTS):
            time.sleep(random.uniform(0, WAIT * attempt))
            number, listed = self._lists.newest()
            if self._lists.commit(number + 1, change(listed)):
                return
        raise TableChanged(f"other writers keep changing {self.root}")

    def overwrite(self, df: DataFrame) -> str:
        """Replace the table by a new version; returns the folder written."""
        load = self._load_name()
        written = self._write(df, load)
        schema = _nullable(df.schema)
        self._commit(lambda _: {"schema": schema, "files": written})
        return f"{self.root}/data/{load}"

    def append(self, df: DataFrame, load_id: str | None = None) -> str:
        """Add rows and return the folder written. The same ``load_id`` again replaces what it added.

        Columns that are not sent are NULL; a column the table does not have raises.
        """
        _, listed = self._lists.newest()
        if listed is not None:
            _refuse_unknown(df, [f["name"] for f in listed["schema"]["fields"]])
            df = _completed(df, T.StructType.fromJson(listed["schema"]))
        load = self._load_name(load_id)
        written = self._write(df, load)
        schema = _nullable(df.schema)
        before = load.rpartition("-")[0] + "-" if load_id is not None else None

        def added(now: dict | None) -> dict:
            if now is None:
                return {"schema": schema, "files": written}
            kept = [f for f in now["files"] if before is None or not f.startswith(f"data/{before}")]
            return {**now, "files": kept + written}

        self._commit(added)
        return f"{self.root}/data/{load}"

    def merge(self, source: DataFrame, keys: Sequence[str]) -> None:
        """Upsert by key: matching rows take the columns sent, others are added; a missing table is created.

        Only files that hold a matching key are read whole and rewritten; of the others the keys are read. Columns
        that the source does not send keep their values, and are NULL in new rows. A column that the table does not
        have raises, and so does a repeated key, as in MERGE. Rows with a missing key match nothing. If
        another writer commits meanwhile, the merge raises ``TableChanged`` and changes nothing.
        """
        keys = list(keys)
        repeated = source.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").limit(1)
        if not repeated.isEmpty():
            raise DuplicateKeys(f"merge source repeats a key of {keys}")
        if not self.exists():
            self.overwrite(source)
            return
        number, listed = self._newest()
        schema = T.StructType.fromJson(listed["schema"])
        _refuse_unknown(source, schema.names)
        if set(source.columns) == set(keys):
            # Nothing to update.
            here = self._of_files(listed, listed["files"]).select(*keys)
            rows, touched = _completed(source.join(here, keys, "left_anti"), schema), set()
        else:
            touched = self._holding(listed, schema, source.select(*keys), keys)
            rows = _upserted(self._of_files(listed, sorted(touched)), source, keys)
        written = self._write(rows, self._load_name())
        kept = [f for f in listed["files"] if f not in touched]
        if not self._lists.commit(number + 1, {**listed, "files": kept + written}):
            raise TableChanged(f"{self.root} got another version while merging into version {number}")

    def _holding(self, listed: dict, schema: T.StructType, wanted: DataFrame, keys: list[str]) -> set[str]:
        """Files that hold one of the wanted keys; there are no more of them than the list has."""
        if not listed["files"]:
            return set()
        stored = self._stored(schema, listed["files"])
        where = stored.metadataColumn("_metadata").getField("file_path").alias("_in_file")
        found = stored.select(*keys, where).join(wanted, keys, "left_semi").select("_in_file").distinct()
        return {self._below(r["_in_file"]) for r in found.collect()}

    def prune(self, keep: int = 2) -> None:
        """Delete all but the newest versions, and files that none of those lists; call it when no
        reader uses the old ones and no writer is at work."""
        used = {f.split("/")[1] for n in self._lists.prune(keep) for f in self.files(n)}
        for load in files.names(self.spark, f"{self.root}/data", f"{LOAD}="):
            if load not in used:
                files.delete(self.spark, f"{self.root}/data/{load}")


def _nullable(schema: T.StructType) -> dict:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]).jsonValue()


def _refuse_unknown(df: DataFrame, columns: Sequence[str]) -> None:
    unknown = [c for c in df.columns if c not in columns]
    if unknown:
        raise ValueError(f"the source has columns the table does not have: {unknown}")


def _completed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of the schema in its types; those the frame does not have are NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def _upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows with the source's columns where the keys match, and the source rows that match none."""
    sent = [c for c in source.columns if c not in keys]
    marked = source.select(*keys, F.lit(True).alias("_hit"), *[F.col(f"`{c}`").alias(f"_new_{c}") for c in sent])
    joined = target.join(marked, keys, "left")
    kept = joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"`_new_{f.name}`").cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
            if f.name in sent
            else F.col(f"`{f.name}`")
            for f in target.schema.fields
        ]
    )
    added = source.join(target.select(*keys), keys, "left_anti")
    return kept.unionByName(_completed(added, target.schema))


def export_days(
    df: DataFrame, path: str, day: str, rows_per_file: int | None = None, spread_by: Sequence[str] | None = None
) -> DataFrame:
    """Write one folder per day, snappy, files of bounded length; then compare row counts per day.

    ``spread_by`` names a few columns that tell rows of one day apart; by default all do.

    Returns (day, rows). Raises when a day read back differs from the source.
    """
    rows_per_file = rows_per_file or file_rows(df)
    by_partition(df, day, rows_per_file, spread_by).write.mode("overwrite").option("compression", "snappy").option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy(day).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    sides = df.groupBy(day).agg(F.count("*").alias("n")).unionByName(back.groupBy(day).agg((-F.count("*")).alias("n")))
    changed = sides.groupBy(day).agg(F.sum("n").alias("n")).filter("n <> 0").limit(1)
    if not changed.isEmpty():
        raise RuntimeError(f"rows changed while exporting to {path}")
    return back.groupBy(day).agg(F.count("*").alias("rows"))


def load_days(spark: SparkSession, sources: Sequence[str], root: str, day: str, cluster_by: Sequence[str]) -> ParquetTable:
    """Replace a table by Parquet sources, partitioned by day and clustered; a missing source fails."""
    missing = [s for s in sources if not files.exists(spark, s)]
    if missing:
        raise FileNotFoundError(f"missing Parquet sources: {missing}")
    table = ParquetTable(spark, root, day, cluster_by)
    table.overwrite(spark.read.parquet(*sources))
    return table


def day_shards(spark: SparkSession, path: str, day: str, first: str, last: str) -> DataFrame:
    """Days ``first`` to ``last`` of a table partitioned by day; other folders are not opened."""
    return spark.read.parquet(path).filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def copy_out(source: DataFrame, table: ParquetTable) -> int:
    """Replace a table by a copy and return the rows read back."""
    table.overwrite(source)
    return table.read().count()


def seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small lookup file: CSV with a header and a declared schema."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def closed_sample(
    facts: DataFrame, share: float, by: Sequence[str], parents: Sequence[tuple[DataFrame, str, str]]
) -> tuple[DataFrame, list[DataFrame]]:
    """A stable share of the facts and exactly the parent rows they refer to.

    ``parents`` holds (table, fact column, parent key). The share is taken by a hash of ``by``,
    so the same rows come out on every run and after a lost task.
    """
    buckets = 1_000_000
    chosen = facts.filter(F.pmod(F.xxhash64(*by), F.lit(buckets)) < F.lit(int(share * buckets)))
    matching = []
    for table, fact_column, key in parents:
        used = chosen.select(F.col(fact_column).alias(key)).distinct()
        matching.append(table.join(used, key, "left_semi"))
    return chosen, matching


def authorized_view(df: DataFrame, name: str, columns: Sequence[str | Column]) -> DataFrame:
    """A stable projection under a view name; existing views are replaced."""
    view = df.select(*columns)
    view.createOrReplaceTempView(name)
    return view


def inline_values(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A few literal rows."""
    return spark.createDataFrame(list(rows), schema)


def align_schema(df: DataFrame, schema: T.StructType, empty_as_null: bool = True) -> DataFrame:
    """Columns in the target order and type; empty text becomes NULL. A missing column raises."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").cast(f.dataType)
        if empty_as_null and isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        cols.append(c.alias(f.name))
    return df.select(*cols)
