"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a shuffled order, make blocks of equal size. With integer weights w that
add up to W, block j of a source is released at slot floor(j * W / w) and due before slot
ceil((j + 1) * W / w); each slot takes the released block that is due first. Every block then runs in
its window, so after any number of slots each source is less than one block from its target share.

The windows repeat every W slots, so the slots of one period give those of all blocks. When a source
has no blocks left, a new phase begins for the rest with the weights they have. All rows are placed,
none twice.

Default weights are the square roots of the sources' row counts (temperature 2), as whole numbers that
add up to about ``PERIOD``. Only row counts per source reach the driver.

A null source is a source of its own. Ties and repeated rows are placed one by one; a null doc_id is
hashed like an empty one. Texts are not read, so their length does not matter, and extra columns only go along with
their rows. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .numbering import number_as_stored, number_in_groups

BLOCK_ROWS = 8
PERIOD = 1000
TEMPERATURE = 2.0


def period(weights: Mapping[str | None, int]) -> list[str | None]:
    """The source of each slot of one period, by earliest deadline among released blocks."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is not None, s))
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    slots = []
    for now in range(total):
        while waiting and waiting[0][0] <= now:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[names[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        slots.append(names[i])
        if j + 1 < weights[names[i]]:
            heapq.heappush(waiting, ((j + 1) * total // weights[names[i]], i, j + 1))
    return slots


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, int]) -> list[dict]:
    """Phases in turn: its first slot, its length, the weights, the blocks each source had before, and a period."""
    left, done, start, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    left = {s: n for s, n in left.items() if n}
    while left:
        own = {s: weights[s] for s in left}
        slots = period(own)
        turns: dict[str | None, list[int]] = {s: [] for s in own}
        for t, s in enumerate(slots):
            turns[s].append(t)
        # The phase ends with the first source whose last block has run.
        length = 1 + min((n - 1) // own[s] * len(slots) + turns[s][(n - 1) % own[s]] for s, n in left.items())
        out.append({"start": start, "length": length, "weights": own, "done": {s: done[s] for s in own}, "turns": turns})
        whole, rest = divmod(length, len(slots))
        for s in list(left):
            ran = whole * own[s] + sum(t < rest for t in turns[s])
            done[s] += ran
            left[s] -= ran
            if not left[s]:
                del left[s]
        start += length
    return out


def tempered(rows: Mapping[str | None, int], temperature: float = TEMPERATURE, total: int = PERIOD) -> dict[str | None, int]:
    """Whole weights in proportion to rows ** (1 / temperature), 1 at least."""
    raw = {s: n ** (1 / temperature) for s, n in rows.items()}
    return {s: max(1, round(total * x / sum(raw.values()))) for s, x in raw.items()}


def mixed(
    docs: DataFrame, weights: Mapping[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, seed: str = "17", more: Sequence[str] = ()
) -> DataFrame:
    """Per row: doc_id, source, ``more``, weight, block, phase, release, deadline, slot and position.

    ``block`` counts within the source, ``slot`` is where the block runs; ``release`` and ``deadline``
    bound that slot. ``position`` orders the rows of the whole mix. ``weights`` names every source. ``more`` names
    columns to carry along, by which rows of one doc_id are told apart.
    """
    spark = docs.sparkSession
    turn = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = docs.select("doc_id", "source", *more, turn.alias("turn"))
    numbered = written(number_in_groups(rows, "source", ["turn", "doc_id", *more]), "numbered")
    # One row per source.
    counts = {r["source"]: r["n"] for r in numbered.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if weights is None:
        weights = tempered(counts)
    missing = [s for s in counts if weights.get(s, 0) < 1]
    if missing:
        raise ValueError(f"sources without a weight of 1 or more: {missing[:5]}")
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, weights)
    # One row per phase, source and slot of a period: no more than sources times the sum of the weights.
    table = [
        {"phase": k, "name": s, "start": p["start"], "total": sum(p["weights"].values()), "w": w, "done": p["done"][s], "turns": p["turns"][s]}
        for k, p in enumerate(plan)
        for s, w in p["weights"].items()
    ]
    shape = "array<struct<phase:int,name:string,start:long,total:long,w:long,done:long,turns:array<long>>>"
    steps = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(table)), shape)).alias("p")).select("p.*")
    # Per source: its phases in order; a block belongs to the last one that began before it.
    of_source = steps.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("done", "phase", "start", "total", "w", "turns"))).alias("steps"))
    block = F.expr(f"number div {int(block_rows)}")
    joined = numbered.withColumn("block", block).join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("name")))
    own = joined.withColumn("p", F.element_at(F.filter("steps", lambda s: s["done"] <= F.col("block")), -1))
    placed = own.withColumn("j", F.expr("block - p.done")).selectExpr(
        "doc_id",
        "source",
        *more,
        "p.w as weight",
        "block",
        "p.phase as phase",
        "p.start + j * p.total div p.w as release",
        "p.start + ((j + 1) * p.total + p.w - 1) div p.w as deadline",
        "p.start + (j div p.w) * p.total + element_at(p.turns, cast(j % p.w as int) + 1) as slot",
        "number",
    )
    return placed.withColumn("position", F.expr(f"slot * {int(block_rows)} + number % {int(block_rows)}")).drop("number")


def in_mixed_order(docs: DataFrame, weights: Mapping[str | None, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows with their columns, range-partitioned and sorted in the order of the mix.

    Every row has a place of its own, by its number in the stored table; so copies of one row, and rows
    without a doc_id, are mixed like any others.
    """
    place, row, of_row = (free_name(docs, x) for x in ("place", "row", "of_row"))
    numbered = number_as_stored(docs, docs.columns, row)
    placed = mixed(numbered.select("doc_id", "source", row), weights, block_rows, more=[row])
    placed = placed.select(F.col(row).alias(of_row), F.col("position").alias(place))
    ordered = numbered.join(placed, F.col(row) == F.col(of_row)).repartitionByRange(place).sortWithinPartitions(place)
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])
