"""Conversations with broken roles, repaired at least cost and rendered.

A legal conversation may begin with a system turn; then user and assistant take turns, user first,
assistant last. The automaton's state is the role of the last message. Each turn of the input either

* begins a message with its own role, or with another at the cost of a relabel,
* goes to the last message (merge; with a relabel if the roles differ),

and one empty message may be put in before it. At the end an open user or system turn is answered with
empty messages. Dynamic programming finds the cheapest sequence; of equal costs the first option in
the order above wins, and user before assistant before system.

A turn is a small matrix of costs from state to state, and a stretch of turns the min-plus product of
its matrices. So a long conversation is cut into chunks that are reduced apart; chunks of chunks are
reduced until each conversation is one, and the states at the cuts are handed down the same way. No task
holds more than ``CHUNK`` turns, or chunks, of a conversation.

Roles are compared after lower-casing and trimming; unknown and null roles are relabelled at a lower
cost. Null texts count as empty. Turns are ordered by turn number, nulls first, then by role and text;
repeated rows are turns of their own. Rows with a null conv_id form one conversation. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import div
from .common import written
from .numbering import number_in_groups

CHUNK = 1024
NONE = 1 << 40  # cost of what cannot be

USER, ASSISTANT, SYSTEM = "user", "assistant", "system"
ROLES = (USER, ASSISTANT, SYSTEM)
START = 3  # state before the first message; states 0 to 2 are the roles
STATES = 4
AFTER = {START: (0, 2), 2: (0,), 0: (1,), 1: (0,)}  # which role may follow
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
OPEN_AT_END = {0: (1,), 1: (), 2: (0, 1), START: ()}  # empty messages that end a conversation

# Rendering.
BEGIN, END, JOIN = "<|im_start|>", "<|im_end|>\n", "\n\n"


def role_number(role: str | None) -> int:
    """Place in ``ROLES``, or 3 for any other."""
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 3


def _options(role: int) -> list[tuple[int, int, int, int, bool, int]]:
    """All (cost, rank, from, to, merged, inserted role or -1) of a turn with this role."""
    relabel = [0 if r == role else (RELABEL_UNKNOWN if role == 3 else RELABEL) for r in range(3)]
    out = []
    for state in range(STATES):
        out += [(relabel[r], r, state, r, False, -1) for r in AFTER[state]]
        if state != START:
            out.append((MERGE + relabel[state], 10, state, state, True, -1))
        for put in AFTER[state]:
            out += [(INSERT + relabel[r], 20 + 3 * put + r, state, r, False, put) for r in AFTER[put]]
    return out


def _best() -> tuple[np.ndarray, dict]:
    """Per role a matrix of costs, and the option behind each finite entry."""
    costs, choice = np.full((4, STATES, STATES), NONE), {}
    for role in range(4):
        for option in sorted(_options(role), reverse=True):
            cost, _, a, b, merged, put = option
            costs[role, a, b] = cost
            choice[role, a, b] = (merged, put)
    return costs, choice


COSTS, CHOICE = _best()


def product(matrices: np.ndarray) -> np.ndarray:
    """Min-plus product of a stack of matrices, halving the stack each time."""
    while len(matrices) > 1:
        odd = matrices[-1:] if len(matrices) % 2 else matrices[:0]
        left, right = matrices[: len(matrices) // 2 * 2 : 2], matrices[1 : len(matrices) // 2 * 2 : 2]
        joined = np.minimum((left[:, :, :, None] + right[:, None, :, :]).min(axis=2), NONE)
        matrices = np.concatenate([joined, odd])
    return matrices[0]


def best_path(matrices: np.ndarray, first: int, last: int) -> list[int]:
    """States before, between and after a stack of matrices on the cheapest way; on ties the lowest state."""
    cost = np.full(STATES, NONE)
    cost[first] = 0
    came = np.empty((len(matrices), STATES), dtype=np.int8)
    for i, m in enumerate(matrices):
        ways = cost[:, None] + m
        came[i] = ways.argmin(axis=0)
        cost = np.minimum(ways.min(axis=0), NONE)
    path = [last]
    for i in range(len(matrices) - 1, -1, -1):
        path.append(int(came[i][path[-1]]))
    return path[::-1]


def last_state(total: np.ndarray) -> int:
    """The cheapest state to end in, closing messages included."""
    return int(np.argmin([total[START, s] + INSERT * len(OPEN_AT_END[s]) for s in range(STATES)]))


def _matrices(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, STATES, STATES)


def _reduce_turns(table: pa.Table) -> pa.Table:
    """Turns of a chunk to its matrix."""
    table = table.sort_by("number")
    total = product(COSTS[table["role"].to_numpy()])
    return pa.table({"conv": table["conv"][:1], "place": table["chunk"][:1], "costs": pa.array([total.ravel().tolist()], pa.list_(pa.int64()))})


def _reduce_chunks(table: pa.Table) -> pa.Table:
    """Chunks of a group to the group's matrix."""
    table = table.sort_by("place")
    total = product(_matrices(table["costs"]))
    return pa.table({"conv": table["conv"][:1], "place": table["parent"][:1], "costs": pa.array([total.ravel().tolist()], pa.list_(pa.int64()))})


def _hand_down(table: pa.Table) -> pa.Table:
    """Entry and exit state of each chunk, from those of its group."""
    table = table.sort_by("place")
    path = best_path(_matrices(table["costs"]), table["entry"][0].as_py(), table["exit"][0].as_py())
    return pa.table({"conv": table["conv"], "place": table["place"], "entry": pa.array(path[:-1], pa.int32()), "exit": pa.array(path[1:], pa.int32())})


def _decide(table: pa.Table) -> pa.Table:
    """New role and action of each turn of a chunk."""
    table = table.sort_by("number")
    roles = table["role"].to_numpy()
    path = best_path(COSTS[roles], table["entry"][0].as_py(), table["exit"][0].as_py())
    picked = [CHOICE[int(r), a, b] for r, a, b in zip(roles, path, path[1:])]
    return pa.table(
        {
            "conv": table["conv"],
            "number": table["number"],
            "before": pa.array(path[:-1], pa.int32()),
            "state": pa.array(path[1:], pa.int32()),
            "merged": pa.array([m for m, _ in picked]),
            "put": pa.array([p for _, p in picked], pa.int32()),
            "step_cost": pa.array([int(COSTS[r, a, b]) for r, a, b in zip(roles, path, path[1:])], pa.int64()),
        }
    )


def _decisions(turns: DataFrame, chunk: int) -> DataFrame:
    """From (conv, number, role as a place in ``ROLES``): what is done with each turn."""
    kind = turns.schema["conv"].dataType.simpleString()
    rows = turns.withColumn("chunk", div(F.col("number"), chunk))
    # A named number of partitions: rows are narrow but costly, and would be merged by their bytes.
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = rows.repartition(tasks, "conv", "chunk").groupBy("conv", "chunk").applyInArrow(_reduce_turns, f"conv {kind}, place long, costs array<bigint>")
    levels = [written(level, "chunks")]
    most = levels[0].agg(F.max("place")).first()[0] or 0
    while most > 0:
        parent = levels[-1].withColumn("parent", div(F.col("place"), chunk))
        up = parent.groupBy("conv", "parent").applyInArrow(_reduce_chunks, f"conv {kind}, place long, costs array<bigint>")
        levels.append(written(up, "chunks"))
        most //= chunk

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = np.array(batch.column(2).to_pylist(), dtype=np.int64).reshape(-1, STATES, STATES)
            columns = [batch.column(0), batch.column(1), pa.array([START] * len(totals), pa.int32()), pa.array([last_state(m) for m in totals], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "place", "entry", "exit"])

    states = levels[-1].mapInArrow(ends, f"conv {kind}, place long, entry int, exit int")
    for below in levels[-2::-1]:
        above = states.select(F.col("conv").alias("up_conv"), F.col("place").alias("up"), "entry", "exit")
        same = F.col("conv").eqNullSafe(F.col("up_conv")) & (div(F.col("place"), chunk) == F.col("up"))
        met = below.join(above, same).select("conv", "up", "place", "costs", "entry", "exit")
        states = met.groupBy("conv", "up").applyInArrow(_hand_down, f"conv {kind}, place long, entry int, exit int")
    states = states.select(F.col("conv").alias("up_conv"), "place", "entry", "exit")
    same = F.col("conv").eqNullSafe(F.col("up_conv")) & (F.col("chunk") == F.col("place"))
    met = rows.join(states, same).select("conv", "chunk", "number", "role", "entry", "exit")
    schema = f"conv {kind}, number long, before int, state int, merged boolean, put int, step_cost long"
    return met.repartition(tasks, "conv", "chunk").groupBy("conv", "chunk").applyInArrow(_decide, schema)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per turn: conv_id, turn, role, number, repaired_role, action, inserted, cost, piece.

    ``number`` counts the turns of a conversation from 0 in order. ``action`` is keep, relabel, merge or
    relabel_merge; ``inserted`` is the role of an empty message before the turn. ``cost`` is the turn's
    own; the last turn bears that of closing messages too. The ``piece`` strings of a conversation, one
    after another, are the rendered conversation.
    """
    named = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("text_hash"))
    numbered = written(number_in_groups(named, "conv_id", ["turn", "role", "text_hash"]).drop("text_hash"), "turns")
    name = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    known = F.array_position(F.array(*map(F.lit, ROLES)), name)
    slim = numbered.select(
        F.col("conv_id").alias("conv"), "number", F.when(known > 0, known - 1).otherwise(3).cast("int").alias("role")
    )
    decided = _decisions(slim, chunk)
    last = slim.groupBy("conv").agg(F.max("number").alias("last")).withColumnRenamed("conv", "last_conv")
    decided = decided.join(last, F.col("conv").eqNullSafe(F.col("last_conv"))).withColumnRenamed("number", "at")
    rows = numbered.join(decided, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("number") == F.col("at")))

    def role_of(state: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, ROLES)), state + 1)

    new = role_of(F.col("state"))
    same = F.coalesce(name == new, F.lit(False))
    put = F.when(F.col("put") >= 0, role_of(F.col("put")))
    ended = F.col("number") == F.col("last")
    closing = F.when(F.col("state") == 0, F.lit(BEGIN + ASSISTANT + "\n" + END)).when(
        F.col("state") == 2, F.lit(BEGIN + USER + "\n" + END + BEGIN + ASSISTANT + "\n" + END)
    )
    empty = F.when(put.isNotNull(), F.concat(F.lit(BEGIN), put, F.lit("\n" + END))).otherwise("")
    close = F.when(F.col("before") == START, "").otherwise(F.lit(END))
    head = F.when(F.col("merged"), F.lit(JOIN)).otherwise(F.concat(close, empty, F.lit(BEGIN), new, F.lit("\n")))
    tail = F.when(ended, F.concat(F.lit(END), F.coalesce(closing, F.lit("")))).otherwise("")
    more = F.when(ended & (F.col("state") == 0), INSERT).when(ended & (F.col("state") == 2), 2 * INSERT).otherwise(0)
    return rows.select(
        "conv_id",
        "turn",
        "role",
        "number",
        new.alias("repaired_role"),
        F.when(F.col("merged"), F.when(same, "merge").otherwise("relabel_merge")).otherwise(F.when(same, "keep").otherwise("relabel")).alias("action"),
        put.alias("inserted"),
        (F.col("step_cost") + more).cast("long").alias("cost"),
        F.concat(head, F.coalesce("text", F.lit("")), tail).alias("piece"),
    )
