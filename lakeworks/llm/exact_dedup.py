"""Exact duplicates by a tree merge of sorted digest runs.

Every text, lower-cased in A-Z only, becomes its SHA-256. Each partition sorts its digests into
a run and folds equal ones: the winner stays, the sizes add up. Then nodes exchange runs in
rounds. In round r a node keeps the digests whose r-th digit is its own and hands the others to
the nodes that differ from it in this digit alone; what arrives is merged and folded again. With
two values per digit these are the rounds of a binomial tree; sixteen (``DIGIT_BITS`` = 4) take
four of its steps at a time. After the last round all runs of a digest have met in one node, as
one row from each of sixteen, however many copies there were.

A digest is verified in full wherever two rows fold, never by its leading bits. Runs are sorted
by Spark and so may spill; folding holds a batch and one row.

Null text counts as empty. Of equal texts the largest doc_id stays; a null doc_id stays only if
there is no other. Of rows that repeat a whole document exactly one stays. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bytes_of, free_name, ids_and_texts, written

DIGIT_BITS = 4
# The letters that are lower-cased.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own for every row) and the SHA-256 of the lower-cased text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = [hashlib.sha256(x.lower()).digest() for x in bytes_of(block.column(1))]
            columns = [block.column(0), block.column(2), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = ids_and_texts(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, f"doc_id {kind}, row long, digest binary")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and digest, winner first: the first of each digest, with all sizes added."""
    held, held_key, held_size = None, None, 0

    def finished() -> pa.RecordBatch:
        return held.set_column(4, "size", pa.array([held_size], pa.int64()))

    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy(zero_copy_only=False)
        digest = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, 4)
        new = np.ones(len(node), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        sizes = np.add.reduceat(batch.column(4).to_numpy(zero_copy_only=False), heads)
        first_key = (int(node[0]), digest[0].tobytes())
        if held is not None and first_key == held_key:
            held_size += int(sizes[0])
            heads, sizes = heads[1:], sizes[1:]
            if not len(heads):
                continue
        if held is not None:
            yield finished()
        out = batch.take(pa.array(heads[:-1])).set_column(4, "size", pa.array(sizes[:-1], pa.int64()))
        if out.num_rows:
            yield out
        last = int(heads[-1])
        held, held_key, held_size = batch.slice(last, 1), (int(node[last]), digest[last].tobytes()), int(sizes[-1])
    if held is not None:
        yield finished()


def _merged(runs: DataFrame) -> DataFrame:
    order = ["node", "digest", F.col("doc_id").desc_nulls_last(), F.col("row").desc()]
    return runs.sortWithinPartitions(*order).mapInArrow(_fold, runs.schema)


def groups(found: DataFrame, digit_bits: int = DIGIT_BITS, nodes: int | None = None) -> DataFrame:
    """One row per digest of ``digests``: the doc_id and row that stay, and the number of rows."""
    n = nodes or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, -(-(max(n, 2) - 1).bit_length() // digit_bits))
    last_node = (1 << rounds * digit_bits) - 1
    if last_node >= 1 << 31:
        raise ValueError("more nodes than the leading digest bits can tell apart")
    start = F.spark_partition_id().bitwiseAND(F.lit(last_node))
    runs = _merged(found.select(start.alias("node"), "digest", "doc_id", "row", F.lit(1).cast("long").alias("size")))
    goal = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(last_node)).cast("int")
    for r in range(rounds):
        digit = ((1 << digit_bits) - 1) << (r * digit_bits)
        node = F.col("node").bitwiseAND(F.lit(last_node & ~digit)).bitwiseOR(goal.bitwiseAND(F.lit(digit)))
        runs = _merged(runs.withColumn("node", node).repartition("node"))
    return runs.select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size")
    )


def exact_duplicates(docs: DataFrame, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    found = written(digests(docs), "digests")
    # Texts that occur once are not joined; rows of a very frequent text are dealt out by adaptive skew joins.
    repeated = groups(found, digit_bits).filter("group_size > 1")
    alone = F.col("group_size").isNull()
    return found.join(repeated, "digest", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    digest, turn, keep_digest, keep_id = (free_name(docs, x) for x in ("digest", "turn", "keep_digest", "keep_id"))
    kept = exact_duplicates(docs).filter("kept")
    stay = kept.select(F.unhex("text_sha256").alias(keep_digest), F.col("doc_id").alias(keep_id))
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    marked = docs.withColumn(digest, F.unhex(F.sha2(lowered, 256)))
    same = (F.col(digest) == F.col(keep_digest)) & F.col("doc_id").eqNullSafe(F.col(keep_id))
    once = F.row_number().over(Window.partitionBy(digest).orderBy(F.lit(0)))
    winners = marked.join(stay, same, "left_semi").withColumn(turn, once).filter(F.col(turn) == 1)
    return winners.select(*[F.col(f"`{c}`") for c in docs.columns])
