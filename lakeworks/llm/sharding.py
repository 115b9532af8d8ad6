"""A reproducible shuffle into shards by a Feistel permutation of the row numbers.

Rows are numbered from 0 in the order of doc_id. The permutation works on pairs (left, right) from a
grid of height x width cells, the smallest found that holds all numbers; a number that leaves the
range walks on along its cycle until it is back, which takes no more steps than the grid has spare
cells. The place in the shuffle gives the shard (place mod shards) and the slot in it (place div
shards), and both lead back to the row number, so any row can be found without a scan.

Law: ``rows``. Shard sizes differ by one at most whatever the texts are, so copies are dealt out like
any other rows; groups of equal texts are not kept together, nor could they be under this law.

Rows equal in doc_id are told apart by their texts; whole copies of a row are interchangeable. A null
doc_id comes first. Null text has size 1 and the checksum of no bytes, 0. An empty table gives an empty
result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import div
from .numbering import number_rows

# The round function: squares modulo a prime, with a multiplier and one key a round.
PRIME = 2147483647
FACTOR = 48271
KEYS = (1202843, 77345113, 2029341, 981273645, 1500450271, 31415927, 271828183, 1618033989)
GRIDS_TRIED = 1_000_000


class Permutation:
    """Of the numbers from 0 to ``n`` - 1."""

    def __init__(self, n: int, keys: tuple[int, ...] = KEYS):
        self.n, self.keys = n, keys
        root = max(1, isqrt(max(n, 1) - 1) + 1)
        tried = range(root, min(2 * root, root + GRIDS_TRIED) + 1)
        self.height = min(tried, key=lambda h: -n % h)
        self.width = max(1, -(-n // self.height))
        self.spare = self.height * self.width - n
        if self.height > PRIME:
            raise ValueError("too many rows for the round function")

    @staticmethod
    def _mixed(key: int, half):
        y = (half + key) % PRIME
        z = (y * y % PRIME * FACTOR + y) % PRIME
        return z * z % PRIME

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.width)
        for i, key in enumerate(self.keys):
            if i % 2:
                right = (right + self._mixed(key, left)) % self.width
            else:
                left = (left + self._mixed(key, right)) % self.height
        return left * self.width + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.width)
        for i in reversed(range(len(self.keys))):
            if i % 2:
                right = (right - self._mixed(self.keys[i], left)) % self.width
            else:
                left = (left - self._mixed(self.keys[i], right)) % self.height
        return left * self.width + right

    def place(self, x: int) -> int:
        while (x := self._once(x)) >= self.n:
            pass
        return x

    def number(self, place: int) -> int:
        """The inverse of ``place``."""
        while (place := self._back(place)) >= self.n:
            pass
        return place

    def _step(self, x: Column) -> Column:
        """``_once`` as an expression; ``aggregate`` binds the halves, so nothing is written out twice."""

        def mixed(key: Column, half: Column) -> Column:
            y = F.transform(F.array((half + key) % PRIME), lambda y: (y * y % PRIME * FACTOR + y) % PRIME)
            return F.transform(y, lambda z: z * z % PRIME)[0]

        def round_(state: Column, step: Column) -> Column:
            left, right = state["left"], state["right"]
            moved = mixed(step["key"], F.when(step["odd"], left).otherwise(right))
            return F.struct(
                F.when(step["odd"], left).otherwise((left + moved) % self.height).alias("left"),
                F.when(step["odd"], (right + moved) % self.width).otherwise(right).alias("right"),
            )

        steps = F.array(
            *(F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 1).alias("odd")) for i, k in enumerate(self.keys))
        )
        width = F.lit(self.width).cast("long")
        start = F.struct(div(x, width).alias("left"), (x % width).alias("right"))
        return F.aggregate(steps, start, round_, lambda s: s["left"] * width + s["right"])

    def place_column(self, number: Column) -> Column:
        """``place`` of a column of longs. No walk is longer than the spare cells, since it meets each once at most."""
        first = self._step(number)
        if not self.spare:
            return first
        walk = F.sequence(F.lit(1), F.lit(self.spare))
        return F.aggregate(walk, first, lambda x, _: F.when(x < self.n, x).otherwise(self._step(x)))


def shards(docs: DataFrame, shards: int = 16, keys: tuple[int, ...] = KEYS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, number, shard, slot, grown_shard (always null)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    numbered = number_rows(rows, ["doc_id", "text_hash"])
    # The number of rows is known once the sorted rows are written.
    place = Permutation(numbered.count(), keys).place_column(F.col("number"))
    placed = numbered.withColumn("place", place)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "number",
        (F.col("place") % shards).cast("int").alias("shard"),
        div(F.col("place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
