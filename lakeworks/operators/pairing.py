"""The most pairs of rows within a tolerance that two multisets of numbers allow."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import AT, PART, GroupOrder

Values = Sequence[tuple[float, ...]]


def near(a: Column, b: Column, relative: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def _near(a, b, relative: float, absolute: float):
    return np.abs(a - b) <= np.maximum(relative * np.maximum(np.abs(a), np.abs(b)), absolute)


def along_one(a: Values, a_counts: Sequence[int], b: Values, b_counts: Sequence[int], relative: float, absolute: float) -> int:
    """Most pairs of single numbers, both sides ascending.

    What a number may pair with is an interval that moves up with the number, so taking the
    lowest two that fit is never worse than another choice.
    """
    total, i, j = 0, 0, 0
    left, right = list(a_counts), list(b_counts)
    while i < len(a) and j < len(b):
        x, y = a[i][0], b[j][0]
        if abs(x - y) <= max(relative * max(abs(x), abs(y)), absolute):
            n = min(left[i], right[j])
            total += n
            left[i] -= n
            right[j] -= n
            i, j = i + (not left[i]), j + (not right[j])
        elif x < y:
            i += 1
        else:
            j += 1
    return total


def most_pairs(a: Values, a_counts: Sequence[int], b: Values, b_counts: Sequence[int], relative: float, absolute: float) -> int:
    """Most pairs of rows near each other in every number, both sides in ascending order.

    Rows are paired as they come, then along augmenting paths until there is none; equal rows move together.
    """
    if not a or not b:
        return 0
    if len(a[0]) == 1:
        return along_one(a, a_counts, b, b_counts, relative, absolute)
    theirs, first = np.array(b), [y[0] for y in b]
    fits: list[list[int]] = []
    for x in a:
        reach = max(relative * abs(x[0]) / max(1 - relative, 1e-3), absolute) * (1 + 1e-9)
        begin = bisect_left(first, x[0] - reach)
        end = bisect_left(first, np.nextafter(x[0] + reach, np.inf))
        close = _near(np.array(x), theirs[begin:end], relative, absolute).all(axis=1)
        fits.append((begin + np.flatnonzero(close)).tolist())
    left, right, pairs = list(a_counts), list(b_counts), [defaultdict(int) for _ in b]
    total = 0

    def pair(i: int, j: int, n: int) -> None:
        pairs[j][i] += n

    for i, some in enumerate(fits):
        for j in some:
            n = min(left[i], right[j])
            if n:
                pair(i, j, n)
                left[i], right[j], total = left[i] - n, right[j] - n, total + n
            if not left[i]:
                break
    for start in range(len(a)):
        while left[start]:
            came: dict[int, int] = {}  # right place: the left place it is reached from
            back: dict[int, int] = {start: -1}  # left place: the right place whose pair it gives up
            queue, goal = deque([start]), -1
            while queue and goal < 0:
                i = queue.popleft()
                for j in fits[i]:
                    if j in came:
                        continue
                    came[j] = i
                    if right[j]:
                        goal = j
                        break
                    for other, n in pairs[j].items():
                        if n and other not in back:
                            back[other] = j
                            queue.append(other)
            if goal < 0:
                break
            n, j = min(left[start], right[goal]), goal
            while came[j] != start:
                i = came[j]
                n, j = min(n, pairs[back[i]][i]), back[i]
            j, right[goal], left[start], total = goal, right[goal] - n, left[start] - n, total + n
            while True:
                i = came[j]
                pair(i, j, n)
                if i == start:
                    break
                pairs[back[i]][i] -= n
                j = back[i]
    return total


def _paired(rows: pa.Table, names: Sequence[str], relative: float, absolute: float) -> pa.Table:
    rows = rows.sort_by([(n, "ascending") for n in names])
    values = list(zip(*(rows[n].to_pylist() for n in names)))
    sides = []
    for count in ("na", "nb"):
        n = rows[count].to_pylist()
        sides += [[v for v, k in zip(values, n) if k], [k for k in n if k]]
    return pa.table({"matched": pa.array([most_pairs(*sides, relative, absolute)], pa.int64())})


def pairs_within(times: DataFrame, groups: Sequence[str], names: Sequence[str], relative: float, absolute: float) -> DataFrame:
    """``matched``, the most pairs, in rows to be added up, from distinct rows with their counts ``na`` and ``nb``.

    Rows whose first number lies too far from the next one's cannot pair across the gap, so a group is cut
    there, in ranges, and each piece is one task's work.
    """
    ordered = GroupOrder(times, groups, names)
    ahead = ordered.with_next([names[0]])
    gap = F.col(f"next_{names[0]}").isNotNull() & ~near(F.col(names[0]), F.col(f"next_{names[0]}"), relative, absolute)
    pieces = ordered.sum_before(ahead.withColumn("_gap", gap.cast("long")), "_gap", "_piece")
    work = partial(_paired, names=list(names), relative=relative, absolute=absolute)
    rows = pieces.drop(AT, PART).select(*groups, "_piece", *names, "na", "nb")
    return rows.groupBy(*groups, "_piece").applyInArrow(lambda table: work(table), "matched long")
