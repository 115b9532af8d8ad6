"""Quality classifier: a factorisation machine over hashed words, structure and length.

score = sigmoid(bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise sum over all features is half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2), so a text
is scored in time linear in its features. Features are hashed lower-cased words, statistics of the
text's structure (each as a number and as one of sixteen steps), and ``n_chars`` of the table as
metadata. Labels, language, source and doc_id are not among them.

The machine is fitted on a bounded sample of labelled rows: up to ``PER_CLASS`` of each label, those of
the smallest hash of doc_id, weighted to the shares that the labels have in all training rows.

Null text counts as empty, null n_chars as unknown; both have features of their own. A null label is no
label; of several labels of one doc_id the largest counts, and of several rows the one of the smallest hash of its
text, so a repeated row enters the fit once. Every row is scored by its own text. With no labels at all every score is 0.5.
Very long texts are read whole, an empty table gives an empty result, and extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ids_and_texts, one_each, texts_of

PER_CLASS = 3000
WORD_SLOTS = 1 << 15
STEPS = 16
RANK = 8
EPOCHS = 6
BATCH = 64
RATE = 0.05
DECAY = 1e-5
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_MARKS = "#*$%&|<>!?@~^=_{}[]\\/"

STATISTICS = (
    "length", "word_length", "distinct_words", "neighbours_equal", "top_word", "upper_case", "digits",
    "symbols", "exclamations", "bars", "line_length", "repeated_lines", "ends_of_sentences", "known_length",
)
SLOTS = WORD_SLOTS + len(STATISTICS) * (STEPS + 1)


def statistics(text: str, words: list[str], times: list[int], n_chars: int | None) -> list[float]:
    """Each between 0 and 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    raw = text.encode()
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words)) / n
    marks = sum(map(text.count, _MARKS)) / chars
    out = [
        np.log1p(len(words)) / 14,
        chars / n / 24,
        len(times) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(times, default=0) / n,
        upper,
        sum(raw.count(b) for b in b"0123456789") / chars * 4,
        marks * 4,
        text.count("!") / n,
        text.count("|") / n,
        np.log1p(len(words) / max(1, len(lines))) / 8,
        1 - len(set(lines)) / max(1, len(lines)),
        (text.count(".") + text.count("?")) / n * 4,
        0.0 if n_chars is None else np.log1p(max(0, n_chars)) / 18,
    ]
    return [min(1.0, float(x)) for x in out]


def features(texts: list[str], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values, and where the features of each text begin. Every text has some."""
    slots, values, sizes = [], [], []
    base = WORD_SLOTS + np.arange(len(STATISTICS)) * (STEPS + 1)
    for text, known in zip(texts, n_chars):
        words = _WORDS(text)
        times: dict[str, int] = {}
        for w in map(str.lower, words):
            times[w] = times.get(w, 0) + 1
        stats = np.array(statistics(text, words, list(times.values()), known))
        own = [crc32(w.encode()) % WORD_SLOTS for w in times]
        weight = np.sqrt(np.fromiter(times.values(), float, len(times)))
        weight /= max(1e-9, np.sqrt((weight**2).sum()))
        step = np.minimum((stats * STEPS).astype(int), STEPS - 1)
        slots.append(np.concatenate([base, base + 1 + step, np.array(own, dtype=np.int64)]).astype(np.int32))
        values.append(np.concatenate([stats, np.full(len(stats), 0.5), weight]).astype(np.float32))
        sizes.append(len(slots[-1]))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.concatenate(slots), np.concatenate(values), starts


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The pairwise part by the sum-of-squares identity."""
        vx = self.v[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[slots] * values, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(slots: np.ndarray, values: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Machine:
    """Weighted logistic loss by AdaGrad over small batches in a fixed shuffled order."""
    rng = np.random.default_rng(seed)
    prior = np.clip((weights * labels).sum() / weights.sum(), 1e-3, 1 - 1e-3)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(SLOTS, np.float32), rng.normal(0, 0.05, (SLOTS, RANK)).astype(np.float32))
    sum_b, sum_w, sum_v = 1.0, np.ones(SLOTS, np.float32), np.ones((SLOTS, RANK), np.float32)
    stops = np.append(starts[1:], len(slots))
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for rows in np.array_split(order, max(1, len(order) // BATCH)):
            size = stops[rows] - starts[rows]
            begin = np.cumsum(size) - size
            at = np.repeat(starts[rows] - begin, size) + np.arange(size.sum())
            s, x = slots[at], values[at]
            vx = m.v[s] * x[:, None]
            sums = np.add.reduceat(vx, begin, axis=0)
            z = m.bias + np.add.reduceat(m.w[s] * x, begin)
            z = z + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), begin))
            error = ((sigmoid(z) - labels[rows]) * weights[rows]).astype(np.float32)
            each = np.repeat(error, size)
            touched, place = np.unique(s, return_inverse=True)
            grad_w = np.bincount(place, each * x, len(touched)) + DECAY * m.w[touched]
            pull = (each * x)[:, None] * (np.repeat(sums, size, axis=0) - vx)
            grad_v = np.stack([np.bincount(place, pull[:, f], len(touched)) for f in range(RANK)], axis=1) + DECAY * m.v[touched]
            sum_b += float(error.sum()) ** 2
            sum_w[touched] += grad_w**2
            sum_v[touched] += grad_v**2
            m.bias -= RATE * float(error.sum()) / sum_b**0.5
            m.w[touched] -= RATE * grad_w / np.sqrt(sum_w[touched])
            m.v[touched] -= RATE * grad_v / np.sqrt(sum_v[touched])
    return m


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | None:
    """Fit on the documents that ``labels`` (doc_id, label) names; None if there are none."""
    ids = labels.filter("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # A few thousand ids: small enough to broadcast whatever the corpus.
    turn = F.xxhash64("doc_id")
    picked = [ids.filter(F.col("label") == k).orderBy(turn, "doc_id").limit(per_class) for k in sorted(counts)]
    sample = picked[0]
    for other in picked[1:]:
        sample = sample.unionByName(other)
    texts = one_each(docs, sample, "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            slots, values, starts = features(texts_of(block.column(1)), block.column(2).to_pylist())
            offsets = pa.array(np.append(starts, len(slots)).astype(np.int32))
            columns = [block.column(0), block.column(3), pa.ListArray.from_arrays(offsets, pa.array(slots)), pa.ListArray.from_arrays(offsets, pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "slots", "amounts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    label_kind = labels.schema["label"].dataType.simpleString()
    rows = texts.select("doc_id", "text", "n_chars", "label").mapInArrow(run, f"doc_id {kind}, label {label_kind}, slots array<int>, amounts array<float>")
    table = rows.toArrow().sort_by("doc_id").combine_chunks()
    if not table.num_rows:
        return None
    labels = table["label"].to_numpy().astype(float)
    slots, amounts = table["slots"].combine_chunks(), table["amounts"].combine_chunks()
    sizes = np.fromiter(map(len, slots), np.int64, len(labels))
    weights = np.ones(len(labels))
    for k, n in counts.items():
        weights[labels == k] = n / max(1, (labels == k).sum())
    weights /= weights.mean()
    return fit(slots.flatten().to_numpy(), amounts.flatten().to_numpy(), np.cumsum(sizes) - sizes, labels, weights)


def score(docs: DataFrame, machine: Machine | None, *more: str) -> DataFrame:
    """Per row: doc_id and score, the chance of label 1; ``more`` names columns to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in blocks(batches):
            if m is None:
                found = np.full(block.num_rows, 0.5)
            else:
                found = sigmoid(m.margins(*features(texts_of(block.column(1)), block.column(2).to_pylist())))
            columns = [block.column(0), *block.columns[3:], pa.array(found.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *more, "score"])

    rows = ids_and_texts(docs, "n_chars", *more)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return rows.mapInArrow(run, f"{kept}, score double")
