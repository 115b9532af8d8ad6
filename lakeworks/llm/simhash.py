"""SimHash near-duplicates, found by pigeonring filtering.

Two fingerprints that differ in at most t bits, cut into t + 1 segments on a ring, have a segment
from which on every chain of l segments differs in at most l * t / (t + 1) bits: none in the first
segment, one in the first two, and so on. The first two steps are the key under which fingerprints
meet: segment i as it is, segment i + 1 as it is or with one of its set bits cleared, so a pair
that differs there in one bit meets once. Rows of a key are sorted together; the longer chains prune
its pairs before the full bit distance is taken.

No group emits all its pairs: the rows of a key give a spanning forest of their links. A group
larger than ``GROUP_ROWS`` leaves its task unprocessed, in chunks; a second pass compares every two
chunks of it. Components are settled over distinct fingerprints, so exact copies cost nothing.

Null and empty texts and texts without words have fingerprint zero. Memory does not grow with the
length of a text. Null doc_ids are never a component's id unless there is no other. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bytes_of, free_name, ids_and_texts, written
from .components import components

SEED = 42
GROUP_ROWS = 4096
_PART = 1 << 16  # shingles hashed at a time


def fingerprint(text: bytes, size: int) -> bytes:
    """Eight bytes, most significant bit first."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    n = max(1, len(words) - size + 1)
    begin, end = starts[:n], starts[-n:] - 1
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _PART):
        spans = zip(begin[i : i + _PART].tolist(), end[i : i + _PART].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and ``bits``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = b"".join(fingerprint(x, shingle) for x in bytes_of(block.column(1)))
            bits = pa.array(np.frombuffer(found, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([block.column(0), bits], names=["doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ids_and_texts(docs).mapInArrow(run, f"doc_id {kind}, bits long")


class Ring:
    """The segments of 64 bits for links of at most ``most`` differing bits."""

    def __init__(self, most: int):
        if not 1 <= most < 32:
            raise ValueError("a bit distance from 1 to 31 is needed")
        self.most, self.segments = most, most + 1
        edges = np.linspace(0, 64, self.segments + 1).round().astype(int)
        self.low = edges[:-1].tolist()
        self.width = np.diff(edges).tolist()
        mask = [((1 << w) - 1) << a for a, w in zip(self.low, self.width)]
        #: chains[i][l - 1]: the bits of l segments from segment i on
        self.chains = [
            np.array([sum(mask[(i + k) % self.segments] for k in range(n + 1)) for n in range(self.segments)], dtype=np.uint64)
            for i in range(self.segments)
        ]

    def keys(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys under which fingerprints meet, and the fingerprint of each. A key begins with its segment."""
        keys, owners = [], []
        for i in range(self.segments):
            j = (i + 1) % self.segments
            mine = (bits >> np.uint64(self.low[i])) & np.uint64((1 << self.width[i]) - 1)
            next_ = (bits >> np.uint64(self.low[j])) & np.uint64((1 << self.width[j]) - 1)
            head = mine << np.uint64(self.width[j])
            own = [head | next_]
            owners.append(bits)
            for b in range(self.width[j]):
                bit = np.uint64(1 << b)
                has = (next_ & bit) != 0
                own.append((head | next_ ^ bit)[has])
                owners.append(bits[has])
            # Two segments of a small distance may take more than the 56 bits left; more pairs meet then.
            keys += [np.uint64(i << 56) | k & np.uint64((1 << 56) - 1) for k in own]
        return np.concatenate(keys), np.concatenate(owners)

    def linked(self, segment: int, difference: np.ndarray) -> np.ndarray:
        """Positions of the differences that pass every chain from a segment on, the whole ring last."""
        at = np.arange(len(difference))
        for n in range(1, self.segments):  # n + 1 segments: the largest whole number within their share is n
            at = at[np.bitwise_count(difference[at] & self.chains[segment][n]) <= n]
        return at

    def forest(self, segment: int, bits: np.ndarray) -> tuple[list[int], list[int]]:
        """Links that connect whatever the links between these fingerprints connect."""
        left, right = [], []
        rest = np.unique(bits)
        while len(rest) > 1:
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                x = reached.pop()
                at = self.linked(segment, rest ^ x)
                if len(at):
                    near = rest[at]
                    left += [int(x)] * len(near)
                    right += near.tolist()
                    reached += list(near)
                    rest = np.delete(rest, at)
        return left, right


_LINKS = "key long, u long, v long"  # a link has no key; a row of a large group has its key and chunk


def _link_batch(keys: list[int], left: list[int], right: list[int], chunks: bool) -> pa.RecordBatch:
    u = pa.array(np.array(left, dtype=np.uint64).astype(np.int64))
    v = pa.array(np.array(right, dtype=np.uint64).astype(np.int64))
    k = pa.array(np.array(keys, dtype=np.int64)) if chunks else pa.nulls(len(left), pa.int64())
    return pa.RecordBatch.from_arrays([k, u, v], names=["key", "u", "v"])


def _linker(ring: Ring, group_rows: int):
    """Links of sorted rows (key, bits); rows of a larger group come back with key, bits and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_bits, gone = None, np.empty(0, np.uint64), 0

        def close() -> Iterator[pa.RecordBatch]:
            if gone:
                yield from spill(open_bits)
            elif len(open_bits) > 1:
                a, b = ring.forest(open_key >> 56, open_bits)
                if a:
                    yield _link_batch([], a, b, False)

        def spill(bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(bits):
                chunk = (gone + np.arange(len(bits))) // group_rows
                yield _link_batch([open_key] * len(bits), bits, chunk, True)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            bits = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            stops = np.append(starts[1:], len(keys))
            # The first run may go on from the last batch, the last one into the next.
            if open_key is not None and open_key == int(keys[0]):
                open_bits = np.concatenate([open_bits, bits[: stops[0]]])
                starts, stops = starts[1:], stops[1:]
            if len(starts):
                yield from close()
                size = stops - starts
                inner = np.arange(len(starts)) < len(starts) - 1
                two = np.flatnonzero((size == 2) & inner)
                a, b = bits[starts[two]], bits[starts[two] + 1]
                segment = keys[starts[two]] >> 56
                for i in range(ring.segments):
                    of = np.flatnonzero(segment == i)
                    at = of[ring.linked(i, a[of] ^ b[of])]
                    if len(at):
                        yield _link_batch([], a[at], b[at], False)
                left, right = [], []
                for g in np.flatnonzero((size > 2) & inner).tolist():
                    if size[g] > group_rows:
                        chunk = np.arange(size[g]) // group_rows
                        yield _link_batch([int(keys[starts[g]])] * int(size[g]), bits[starts[g] : stops[g]], chunk, True)
                    else:
                        x, y = ring.forest(int(keys[starts[g]]) >> 56, bits[starts[g] : stops[g]])
                        left += x
                        right += y
                if left:
                    yield _link_batch([], left, right, False)
                open_key, open_bits, gone = int(keys[starts[-1]]), bits[starts[-1] : stops[-1]].copy(), 0
            if len(open_bits) > group_rows:
                yield from spill(open_bits)
                gone, open_bits = gone + len(open_bits), open_bits[:0]
        if open_key is not None:
            yield from close()

    return run


def _chunk_linker(ring: Ring):
    """Links of sorted rows (key, low, high, bits): the rows of two chunks of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            bits = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(bits)]])
            for a, b in zip(starts[:-1], starts[1:]):
                if tuple(at[a]) != now:
                    if parts:
                        x, y = ring.forest(int(now[0]) >> 56, np.concatenate(parts))
                        yield _link_batch([], x, y, False)
                    now, parts = tuple(at[a]), []
                parts.append(bits[a:b].copy())
        if parts:
            x, y = ring.forest(int(now[0]) >> 56, np.concatenate(parts))
            yield _link_batch([], x, y, False)

    return run


def links(bits: DataFrame, most: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``u``, ``v``: links of at most ``most`` differing bits between the distinct longs of ``bits``.

    They connect exactly what all such links connect.
    """
    ring = Ring(most)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                keys, owners = ring.keys(batch.column(0)[i : i + 4096].to_numpy(zero_copy_only=False).view(np.uint64))
                columns = [pa.array(keys.astype(np.int64)), pa.array(owners.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "bits"])

    rows = bits.select("bits").mapInArrow(keyed, "key long, bits long").repartition("key").sortWithinPartitions("key")
    found = written(rows.mapInArrow(_linker(ring, group_rows), _LINKS), "pairs")
    large = found.filter("key is not null").select("key", F.col("u").alias("bits"), F.col("v").alias("chunk"))
    last = large.groupBy("key").agg(F.max("chunk").alias("last"))
    pairs = large.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = pairs.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "bits")
    met = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    more = met.mapInArrow(_chunk_linker(ring), _LINKS)
    return found.filter("key is null").select("u", "v").unionByName(more.select("u", "v"))


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    found = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(found.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "classes")
    joined = components(links(classes, most)).select(F.col("node").alias("bits"), "component")
    placed = written(classes.join(joined, "bits", "left"), "placed")
    # Only classes with links have a component to look up; without them no key is hot.
    linked, alone = placed.filter("component is not null"), placed.filter("component is null")
    firsts = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = linked.join(firsts, "component").select("bits", "component_id").unionByName(
        alone.select("bits", F.col("first_id").alias("component_id"))
    )
    digits = F.lpad(F.lower(F.hex("bits")), 16, "0")
    return found.join(placed, "bits").select("doc_id", digits.alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """The rows whose doc_id is the smallest of its component, with all their columns.

    Rows without a doc_id stay. Rows that share a doc_id stay or go together.
    """
    first = F.bool_or(F.col("doc_id") == F.col("component_id"))
    lost = near_duplicates(docs, shingle, most).filter("doc_id is not null").groupBy("doc_id").agg(first.alias("first"))
    gone = free_name(docs, "gone")
    return docs.join(lost.filter("not first").select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone), "left_anti")
