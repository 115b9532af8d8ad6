"""Runs of repeated words in texts, found online by catchers over completed power-of-two blocks.

A text is read word by word. Whenever a block of 2, 4, 8, ... words that starts at a multiple of
its size is complete, a catcher watches for it: the catcher of a block of m words fires when the
last m words read equal the block at a distance q of 2m to 4m - 1 words (below 8 for m = 2). The
left half of every square, that is of every passage of 2q words whose halves are the same,
holds such a block, so each square is caught. Blocks have names made of the names of their halves,
and a window is only looked up while both of its halves are known: text without repetition costs
about one lookup per word, and names are exact, not hashes.

A catcher that fires compares backwards once for the start the repetition would have; at the word
that completes the square the rest is compared. Squares caught more than once, by several blocks or
at multiples of a period, merge into one run, which then grows with each word appended until one
differs from the word a period before.

A run here is a stretch with smallest period q that no neighbouring word extends, of ``least``
words and two periods at least. Runs shorter than 12 words are not looked for.

Null texts have no words. Texts of any length are read whole; names take about 150 bytes a word of
the longest text a task holds. Repeated rows and null doc_ids need no special care, since each row is judged by its own
text; of equally long runs all are returned. Extra columns are not read. An empty table gives an
empty result. Nothing is shuffled, so a lost task is run again on its own input.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heappop, heappush
from itertools import accumulate, chain, count, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bytes_of, ids_and_texts

LEAST = 12
_SHIFT = 32
_REACH = 10  # pairs of words are caught at distances below 8
Run = tuple[int, int, int]  # start, length, period


class Catchers:
    """Reads codes of words and keeps the runs found so far. Equal words have equal codes, below 2 ** 32."""

    def __init__(self, least: int = LEAST):
        self.least = max(least, LEAST)
        self.words: list[int] = []
        # By level: names of pairs of halves; start of the last block of a name; names of the blocks; names of windows by their end.
        self._names: list[dict[int, int]] = []
        self._seen: list[list[int]] = []
        self._blocks: list[list[int]] = []
        self._windows: list[dict[int, int]] = []
        self._growing: dict[int, int] = {}  # period: start
        self._ended: dict[int, list[tuple[int, int]]] = {}  # period: starts and last words, in order
        self._waiting: dict[int, tuple[int, int]] = {}  # period: start, a word at which to look first
        self._due: list[tuple[int, int]] = []
        self._add_level()

    def _add_level(self) -> None:
        self._names.append({})
        self._seen.append([-1])
        self._blocks.append([])
        self._windows.append({})

    def extend(self, codes: Sequence[int]) -> None:
        growing, due, names, windows, seen = self._growing, self._due, self._names, self._windows, self._seen
        pairs, starts, row = names[0], seen[0], self._blocks[0]
        begin, words = len(self.words), self.words
        words.extend(codes)
        befores = islice(words, begin - 1, None) if begin else chain([-1], words)
        for i, before, code in zip(range(begin, len(words)), befores, codes):
            if growing:
                for q in [q for q in growing if words[i - q] != code]:
                    self._end(q, i)
            if due and due[0][0] <= i:
                self._look(i)
            pair = before << _SHIFT | code
            name = pairs.get(pair, 0)
            if name and i + 1 - starts[name] < _REACH:
                self._fire(0, 2, name, i - 1, i)
            if name and i > 2:
                windows[0][i] = name
                left, level, size = windows[0].get(i - 2, 0), 1, 4
                while left and level < len(names):
                    name = names[level].get(left << _SHIFT | name, 0)
                    if not name:
                        break
                    start, here = i + 1 - size, windows[level]
                    if start - seen[level][name] < 4 * size:
                        self._fire(level, size, name, start, i)
                    here[i] = name
                    if len(here) > 64 + 4 * size:
                        windows[level] = {j: x for j, x in here.items() if j > i - size}
                    left = here.get(i - size, 0)
                    level += 1
                    size *= 2
            if i & 1:
                # A block of two words is complete, and with every second one a larger block.
                name = pairs.setdefault(pair, len(pairs) + 1)
                if name == len(starts):
                    starts.append(i - 1)
                else:
                    starts[name] = i - 1
                row.append(name)
                if i & 2:
                    self._complete(i, row[-2], name)

    def _complete(self, i: int, left: int, right: int) -> None:
        """Register the blocks of four words and more whose last word is ``i``."""
        level, size = 1, 4
        while True:
            if level == len(self._names):
                self._add_level()
            known, seen, row = self._names[level], self._seen[level], self._blocks[level]
            name = known.setdefault(left << _SHIFT | right, len(known) + 1)
            if name == len(seen):
                seen.append(0)
            seen[name] = i + 1 - size
            row.append(name)
            size *= 2
            if (i + 1) % size:
                return
            level += 1
            left, right = row[-2], name

    def _fire(self, level: int, size: int, name: int, start: int, i: int) -> None:
        """Catch the blocks that equal the window from ``start`` to ``i``, at the distances of their level."""
        near = 2 * size if level else 1
        row = self._blocks[level]
        first, last = max(0, -(-(start - 4 * size + 1) // size)), min((start - near) // size, len(row) - 1)
        for p, begun in self._growing.items():
            if begun <= start and 2 * p <= size:
                # Blocks in the run that holds the window lie multiples of its period away: nothing new.
                last = min(last, (begun - 1) // size)
        for j in range(first, last + 1):
            if row[j] == name:
                self._catch(j * size, start - j * size, size, i)

    def _catch(self, x: int, q: int, size: int, i: int) -> None:
        if q in self._growing or q in self._waiting:
            return
        start = probe = None
        for p, begun in self._growing.items():
            if begun <= x and q % p == 0:
                return  # the same run, whose period is p
            if begun <= x + q and 2 * p <= size:
                # The window lies in a run of period p. Where the block lies in an earlier one, comparing words is
                # needed only if both begin at the same word; otherwise the later start of the two bounds the match.
                earlier = self._ended.get(p, [])
                at = bisect_right(earlier, (x, len(self.words))) - 1
                if at >= 0 and x + size - 1 <= earlier[at][1]:
                    probe = earlier[at][1] + 1
                    if earlier[at][0] != begun - q:
                        start = max(earlier[at][0], begun - q)
        if start is None:
            start = x - self._equal_before(x, x + q)
        self._wait(q, start, x if probe is None else probe, i)

    def _wait(self, q: int, start: int, probe: int, i: int) -> None:
        self._waiting[q] = start, probe
        heappush(self._due, (start + 2 * q - 1, q))
        self._look(i)

    def _look(self, i: int) -> None:
        """Compare the squares that should be complete by word ``i``."""
        words = self.words
        while self._due and self._due[0][0] <= i:
            _, q = heappop(self._due)
            start, probe = self._waiting.pop(q)
            if (probe + q > i or words[probe] == words[probe + q]) and words[start : i + 1 - q] == words[start + q : i + 1]:
                self._growing[q] = start
                continue
            # Blocks met since, while this period was waited for, are matched again up to here.
            tail = self._equal_before(i + 1 - q, i + 1)
            if tail >= (2 if q < 8 else 1 << (q.bit_length() - 2)):
                first = i + 1 - q - tail
                if not any(begun <= first and q % p == 0 for p, begun in self._growing.items()):
                    self._wait(q, first, first, i)

    def _equal_before(self, a: int, b: int) -> int:
        """How many words before ``a`` equal those before ``b``, which is further on."""
        words, n, step = self.words, 0, 1
        while step <= a - n and words[a - n - step : a - n] == words[b - n - step : b - n]:
            n += step
            step *= 2
        while step > 1:
            step //= 2
            if step <= a - n and words[a - n - step : a - n] == words[b - n - step : b - n]:
                n += step
        return n

    def _end(self, q: int, i: int) -> None:
        self._ended.setdefault(q, []).append((self._growing.pop(q), i - 1))

    def runs(self) -> list[Run]:
        """The runs in the words so far, by start and then period."""
        found: dict[tuple[int, int], int] = {}
        last = len(self.words) - 1
        stretches = [(q, a, b) for q, rows in self._ended.items() for a, b in rows]
        for q, a, b in sorted(stretches + [(q, a, last) for q, a in self._growing.items()]):
            if b - a + 1 >= self.least:
                found.setdefault((a, b), q)
        return sorted((a, b - a + 1, q) for (a, b), q in found.items())


def runs_of(words: Iterable[bytes], least: int = LEAST) -> list[Run]:
    codes: dict[bytes, int] = defaultdict(count().__next__)
    catchers = Catchers(least)
    catchers.extend(list(map(codes.__getitem__, words)))
    return catchers.runs()


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words left when every run keeps its first period only."""
    if not runs:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, accumulate(change)) if not inside]


def find_runs(docs: DataFrame, least: int = LEAST, alter: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period, in that order) and ``collapsed``, the text without repetitions.

    ``alter`` may change the words of a text, given its doc_id, before they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sizes, found, texts = [], [], []
            for doc_id, text in zip(block.column(0).to_pylist(), bytes_of(block.column(1))):
                words = text.split()
                if alter is not None:
                    words = alter(doc_id, words)
                runs = runs_of(words, least)
                sizes.append(len(words))
                found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                texts.append(b" ".join(collapse(words, runs)))
            columns = [block.column(0), pa.array(sizes, pa.int64()), pa.array(found, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    rows = ids_and_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, schema)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and its exponent in thousandths, digests of all runs and of the collapsed text."""
    # Structs compare field by field, so the longest run of smallest start and period has the largest of these.
    ranked = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    best = F.when(F.size("runs") > 0, F.array_max(ranked))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("best.length * 1000 div -best.col3").alias("exponent_milli"),
        F.sha2(listing.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
