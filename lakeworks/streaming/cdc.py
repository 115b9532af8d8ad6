"""Keyed upserts and deletes ordered by a sequence number, in batch and as a stream.

Rows carry ``_CHANGE_TYPE`` (UPSERT or DELETE) and ``_CHANGE_SEQUENCE_NUMBER``. The row with the
highest sequence decides a key's state; on equal sequences a delete wins. Deleted keys stay in
the state as tombstones, so an older upsert that arrives late cannot bring one back.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..sources.snapshots import Snapshots

logger = logging.getLogger(__name__)
TYPE, SEQUENCE = "_CHANGE_TYPE", "_CHANGE_SEQUENCE_NUMBER"
UPSERT, DELETE = "UPSERT", "DELETE"
DELETED = "_deleted"
BUCKET = "_bucket"
BUCKET_ROWS = 1_000_000


def latest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The deciding row per key with its sequence and a deleted mark.

    Taking a maximum is the same in any order, any split and when repeated, and it is summed up
    before the shuffle, so a key with very many changes is no hot task.
    """
    rows = changes if DELETED in changes.columns else changes.withColumn(DELETED, F.col(TYPE) == DELETE).drop(TYPE)
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(SEQUENCE, DELETED)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_last")).select(*keys, "_last.*")


def live(state: DataFrame) -> DataFrame:
    """Current rows: the state without tombstones and bookkeeping."""
    return state.filter(~F.col(DELETED)).drop(DELETED, SEQUENCE)


def apply_batch(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return live(latest(changes, keys))


def known_fields(changes: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """Changes cut to the target schema; other payload fields are dropped with a warning.

    Fields the changes lack become NULL.
    """
    control = [TYPE, SEQUENCE]
    names = [f.name for f in schema.fields]
    extra = [c for c in changes.columns if c not in names and c not in control]
    if extra:
        logger.warning("ignoring unknown fields %s", extra)
    cols = [
        (F.col(f"`{f.name}`") if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return changes.select(*cols, *control), extra


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Linear hashing: with one bucket more, only the keys of one bucket move, and only into the new one."""
    low = 1 << (buckets.bit_length() - 1)
    hashed = F.xxhash64(*keys)
    wide = F.pmod(hashed, F.lit(2 * low))
    return F.when(wide < buckets, wide).otherwise(F.pmod(hashed, F.lit(low))).cast("int")


def split_by(before: int, after: int) -> set[int]:
    """Buckets, of ``before``, whose keys move when there are ``after``."""
    split = set()
    for bucket in range(before, after):
        while bucket >= before:
            bucket -= 1 << (bucket.bit_length() - 1)
        split.add(bucket)
    return split


class ChangeTable:
    """A keyed table fed by micro-batches.

    Each batch adds one folder of at most one row per key, named by its batch number, so a batch
    that is delivered again replaces itself. ``compact`` folds finished batches into the base, which
    lies in buckets by a hash of the keys. Buckets split as the table grows, so that one holds about
    ``bucket_rows`` and a task that folds one has bounded work. A numbered list names the files of every bucket:
    a fold opens and rewrites only buckets that may hold a changed key or that split, and counts once
    the next list is committed. A read takes the base as it is but for the buckets of keys that the batches since hold.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.keys, self.bucket_rows = spark, root.rstrip("/"), list(keys), bucket_rows
        self._lists = Snapshots(spark, f"{self.root}/folds")

    def apply(self, changes: DataFrame, batch: int) -> None:
        latest(changes, self.keys).write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")

    def _listed(self) -> tuple[int, dict]:
        """Number and content of the newest list: ``upto`` (last batch folded), ``buckets``, ``files`` and ``rows`` by bucket."""
        number, listed = self._lists.newest()
        return number, listed or {"upto": -1, "buckets": 1, "files": {}, "rows": {}, "schema": None}

    def _deltas(self, listed: dict) -> DataFrame | None:
        """Rows of the batches that are not in the base."""
        if not files.exists(self.spark, f"{self.root}/deltas"):
            return None
        return self.spark.read.parquet(f"{self.root}/deltas").filter(F.col("batch") > listed["upto"]).drop("batch")

    def _base(self, listed: dict, buckets: Iterable[int]) -> DataFrame | None:
        names = [f"{self.root}/{f}" for b in buckets for f in listed["files"].get(str(b), [])]
        return self.spark.read.schema(T.StructType.fromJson(listed["schema"])).parquet(*names) if names else None

    def _changed(self, listed: dict, deltas: DataFrame) -> dict[int, int]:
        """Rows of the batches since by bucket; there are no more entries than buckets."""
        found = deltas.groupBy(bucket_of(self.keys, listed["buckets"]).alias(BUCKET)).count()
        return {r[BUCKET]: r["count"] for r in found.collect()}

    def _merged(self, base: DataFrame | None, deltas: DataFrame) -> DataFrame:
        """Base rows of keys without later changes, and the deciding rows of the others."""
        if base is None:
            return latest(deltas, self.keys)
        named = {k: f"_key_{i}" for i, k in enumerate(self.keys)}
        changed = deltas.select(*[F.col(k).alias(n) for k, n in named.items()]).distinct()
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
        met = base.join(changed, same, "left_semi").unionByName(deltas)
        return base.join(changed, same, "left_anti").unionByName(latest(met, self.keys))

    def state(self) -> DataFrame:
        """Deciding row of every key seen, tombstones included."""
        _, listed = self._listed()
        deltas = self._deltas(listed)
        if listed["schema"] is None and deltas is None:
            raise FileNotFoundError(f"no changes at {self.root}")
        every = range(listed["buckets"])
        if deltas is None:
            return self._base(listed, every)
        changed = self._changed(listed, deltas)
        quiet = self._base(listed, [b for b in every if b not in changed])
        if not changed and quiet is not None:
            return quiet
        merged = self._merged(self._base(listed, changed), deltas)
        return merged if quiet is None else quiet.unionByName(merged)

    def snapshot(self) -> DataFrame:
        return live(self.state())

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Current rows of some keys; only their buckets are opened."""
        _, listed = self._listed()
        wanted, deltas = wanted.select(*self.keys).distinct(), self._deltas(listed)
        if listed["schema"] is None and deltas is None:
            raise FileNotFoundError(f"no changes at {self.root}")
        base = self._base(listed, sorted(self._changed(listed, wanted)))
        named = wanted.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(self.keys)])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(self.keys)])
        parts = [x.join(named, same, "left_semi") for x in (base, deltas) if x is not None]
        if not parts:
            return live(self.spark.createDataFrame([], T.StructType.fromJson(listed["schema"])))
        return live(latest(reduce(DataFrame.unionByName, parts), self.keys))

    def compact(self) -> list[str]:
        """Fold the batches since into their buckets; returns the files it opened. Run it while no batch is being written."""
        number, listed = self._listed()
        folders = files.names(self.spark, f"{self.root}/deltas", "batch=")
        batches = sorted(int(f.partition("=")[2]) for f in folders)
        batches = [b for b in batches if b > listed["upto"] and files.exists(self.spark, f"{self.root}/deltas/batch={b}/_SUCCESS")]
        if not batches:
            return []
        stored = self.spark.read.parquet(*[f"{self.root}/deltas/batch={b}" for b in batches])
        changed = self._changed(listed, stored)
        # No more rows than these; so the number of buckets is known before they are written.
        most = sum(listed["rows"].values()) + sum(changed.values())
        buckets = max(listed["buckets"], -(-most // self.bucket_rows))
        touched = sorted(set(changed) | split_by(listed["buckets"], buckets))
        opened = [f for b in touched for f in listed["files"].get(str(b), [])]
        rows = self._merged(self._base(listed, touched), stored).withColumn(BUCKET, bucket_of(self.keys, buckets))
        folder = f"base/{uuid.uuid4().hex}"
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        back = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")
        found = back.groupBy(BUCKET, back.metadataColumn("_metadata").getField("file_path").alias("_in_file")).count().collect()
        kept = {k: v for k, v in listed["files"].items() if int(k) not in touched}
        counts = {k: v for k, v in listed["rows"].items() if int(k) not in touched}
        for r in found:
            name = f"{folder}/{unquote(r['_in_file']).rpartition(folder + '/')[2]}"
            kept.setdefault(str(r[BUCKET]), []).append(name)
            counts[str(r[BUCKET])] = counts.get(str(r[BUCKET]), 0) + r["count"]
        schema = T.StructType([f for f in rows.schema.fields if f.name != BUCKET]).jsonValue()
        if not self._lists.commit(number + 1, {"upto": batches[-1], "buckets": buckets, "files": kept, "rows": counts, "schema": schema}):
            raise RuntimeError(f"{self.root} was folded by another writer meanwhile")
        return opened

    def bucket_sizes(self) -> dict[int, int]:
        """Rows of the base by bucket."""
        return {int(k): v for k, v in self._listed()[1]["rows"].items()}

    def prune(self) -> None:
        """Delete what newer files replace; call it when no reader uses the older state."""
        number, listed = self._listed()
        if not number:
            return
        self._lists.prune(1)
        used = {f for names in listed["files"].values() for f in names}
        folders = {f.split("/")[1] for f in used}
        for name in files.names(self.spark, f"{self.root}/base", ""):
            if name not in folders:
                files.delete(self.spark, f"{self.root}/base/{name}")
            else:
                for bucket in files.names(self.spark, f"{self.root}/base/{name}", f"{BUCKET}="):
                    if not any(f.startswith(f"base/{name}/{bucket}/") for f in listed["files"].get(bucket.partition("=")[2], [])):
                        files.delete(self.spark, f"{self.root}/base/{name}/{bucket}")
        for folder in files.names(self.spark, f"{self.root}/deltas", "batch="):
            # The newest folded batch stays, so a repeated delivery finds its folder.
            if int(folder.partition("=")[2]) < listed["upto"]:
                files.delete(self.spark, f"{self.root}/deltas/{folder}")

    def start(
        self,
        changes: DataFrame,
        checkpoint: str,
        available_now: bool = False,
        every: str = "1 minute",
        compact_every: int | None = None,
    ) -> StreamingQuery:
        """Feed the table from a streaming DataFrame; any order and any split of batches will do.

        Batches come one after the other, so with ``compact_every`` each n-th one also folds the
        batches before it, and deletes what the fold before replaced.
        """

        def feed(rows: DataFrame, batch: int) -> None:
            if compact_every and batch and batch % compact_every == 0:
                self.prune()
                self.compact()
            self.apply(rows, batch)

        writer = changes.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
        return writer.start()
