"""Language identification that allows for documents in several languages.

Each language has a model of hashed character n-grams of its words, counted over all training
documents. A word's likelihood in a language is the product over its n-grams, and a document is a
mixture: expectation-maximisation estimates which share of its words each language has written. The
set of languages is chosen by penalised likelihood: single languages, then the two, three and more with the
largest shares, each further one costing ``PENALTY`` times the logarithm of the number of words. A set
grows while the likelihood gains more than that; the third is tried in any case. ``languages`` and
``shares`` name the set, from the largest share down.

Words repeat, so n-grams are counted and scored once per distinct word of a block. Training documents
without a language are left out. Text that is null or has no letter is ``und`` with score 0, as is
everything if there is nothing to learn from. On a tie the language that sorts first is predicted.
Rows are judged one by one: repeated rows, empty tables, very long texts and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ids_and_texts, texts_of

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15  # per order
SMOOTHING = 0.5
PENALTY = 4.0
LANGUAGES_TRIED = 3  # whether or not the second gains
ROUNDS = 12
STRAY = 1e-5  # likelihood, relative to a word's best language, below which none falls
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+").findall
_CELLS = 2_000_000  # word and language pairs estimated at a time
_HELD_LANGUAGES = 64  # of which a task counts n-grams before it hands them on


def words_of(text: str) -> list[str]:
    return _LETTERS(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words with a mark at either end, and the place of the word of each."""
    line = "\x02" + "\x02".join(words) + "\x02"
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    mark = codes == 2
    owner = np.cumsum(mark) - 1
    buckets, owners = [], []
    for n in ORDERS:
        size = len(codes) - n + 1
        hashed = np.full(size, np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        inside = np.ones(size, dtype=bool)
        for k in range(n):
            hashed = (hashed ^ codes[k : k + size]) * np.uint64(0x100000001B3)
            hashed ^= hashed >> np.uint64(29)
            if 0 < k < n - 1 or n == 1:
                inside &= ~mark[k : k + size]
        if n == 2:
            inside &= ~(mark[:size] & mark[1:])
        at = np.flatnonzero(inside)
        buckets.append((hashed[at] % np.uint64(BUCKETS)).astype(np.int64) + (n - 1) * BUCKETS)
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order], owners[order]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # n-gram buckets x languages

    def word_likelihoods(self, words: list[str]) -> np.ndarray:
        """Relative likelihood of each word in each language; the best has 1."""
        buckets, owners = ngrams(words)
        starts = np.searchsorted(owners, np.arange(len(words)))
        total = np.add.reduceat(self.log_p[buckets], starts, axis=0) / len(ORDERS)
        return np.maximum(np.exp(total - total.max(axis=1, keepdims=True)), STRAY)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores, _, _ = self.mixtures(texts)
        return names, scores

    def mixtures(self, texts: list[str]) -> tuple[list[str], list[float], list[list[str]], list[list[float]]]:
        """Per text: the main language, its share, and all languages of its set with their shares."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        sets: list[list[str]] = [[] for _ in texts]
        parts: list[list[float]] = [[] for _ in texts]
        own = [words_of(x) for x in texts]
        judged = [i for i, w in enumerate(own) if w and has_letter(w)] if self.languages else []
        if not judged:
            return names, scores, sets, parts
        number = {w: k for k, w in enumerate(dict.fromkeys(w for i in judged for w in own[i]))}
        likely = self.word_likelihoods(list(number))
        entries = []
        for i in judged:
            entries.append(np.unique(np.fromiter(map(number.__getitem__, own[i]), np.int64, len(own[i])), return_counts=True))
        sizes = np.array([len(w) for w, _ in entries])
        step, first = max(1, _CELLS // len(self.languages)), 0
        while first < len(judged):
            last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), step, side="right")) + first)
            part = entries[first:last]
            shares = selected(likely[np.concatenate([w for w, _ in part])], np.concatenate([c for _, c in part]), sizes[first:last])
            for i, own_shares in zip(judged[first:last], shares):
                found = [k for k in np.argsort(-own_shares, kind="stable").tolist() if own_shares[k] > 0]
                sets[i], parts[i] = [self.languages[k] for k in found], own_shares[found].tolist()
                names[i], scores[i] = sets[i][0], parts[i][0]
            first = last
        return names, scores, sets, parts


def estimate(likely: np.ndarray, times: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document's languages after some rounds, and the log-likelihood. Shares of 0 stay 0."""
    sizes = np.diff(np.append(starts, len(likely)))
    total = np.add.reduceat(times, starts)[:, None]
    for _ in range(rounds):
        joint = likely * np.repeat(share, sizes, axis=0)
        joint *= (times / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total
    fit = times * np.log((likely * np.repeat(share, sizes, axis=0)).sum(axis=1))
    return share, np.add.reduceat(fit, starts)


def selected(likely: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shares of all languages in each document, 0 for those outside its best set."""
    starts = np.cumsum(sizes) - sizes
    times = times.astype(float)
    n_docs, n_languages = len(sizes), likely.shape[1]
    alone = np.add.reduceat(np.log(likely) * times[:, None], starts, axis=0)
    best = alone.argmax(axis=1)
    fit, out = alone[np.arange(n_docs), best], np.zeros((n_docs, n_languages))
    out[np.arange(n_docs), best] = 1
    all_, _ = estimate(likely, times, starts, np.full((n_docs, n_languages), 1 / n_languages), ROUNDS)
    order = np.argsort(-all_, axis=1, kind="stable")
    price = PENALTY * np.log(1 + np.add.reduceat(times, starts))
    row_of = np.repeat(np.arange(n_docs), sizes)
    growing = np.arange(n_docs)  # documents whose set may still gain
    for m in range(2, n_languages + 1):
        rows = np.isin(row_of, growing)
        begin = np.zeros((len(growing), n_languages))
        np.put_along_axis(begin, order[growing, :m], 1 / m, axis=1)
        own = np.cumsum(sizes[growing]) - sizes[growing]
        shares, fits = estimate(likely[rows], times[rows], own, begin, ROUNDS)
        better = fits - (m - 1) * price[growing] > fit[growing]
        fit[growing[better]] = (fits - (m - 1) * price[growing])[better]
        out[growing[better]] = shares[better]
        if m >= LANGUAGES_TRIED:
            growing = growing[better]
        if not len(growing):
            break
    return np.clip(out, 0.0, 1.0)


def chosen(likely: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The main language of the best set of each document, and its share there."""
    shares = selected(likely, times, sizes)
    return shares.argmax(axis=1), shares.max(axis=1)


def learn(training: DataFrame) -> Model:
    """Count n-grams per language over all rows (``text``, ``lang``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                columns = [pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])
            held.clear()

        for block in blocks(batches):
            words: dict[str, list[str]] = {}
            for text, lang in zip(texts_of(block.column(0)), block.column(1).to_pylist()):
                words.setdefault(lang, []).extend(words_of(text))
            for lang, own in words.items():
                if not own:
                    continue
                times: dict[str, int] = {}
                for w in own:
                    times[w] = times.get(w, 0) + 1
                buckets, owners = ngrams(list(times))
                weights = np.fromiter(times.values(), np.int64, len(times))[owners]
                counts = np.bincount(buckets, weights=weights, minlength=len(ORDERS) * BUCKETS).astype(np.int64)
                held[lang] = held[lang] + counts if lang in held else counts
            if len(held) > _HELD_LANGUAGES:
                yield from flush()
        yield from flush()

    rows = training.filter("lang is not null and text is not null").select("text", "lang")
    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # Languages times buckets rows at most.
    table = found.toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((len(ORDERS) * BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[table["bucket"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    total = counts.reshape(len(ORDERS), BUCKETS, -1).sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS
    log_p = np.log((counts.reshape(len(ORDERS), BUCKETS, -1) + SMOOTHING) / total)
    return Model(languages, log_p.reshape(counts.shape).astype(np.float32))


def predict(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """Per row: doc_id, lang_pred, score, languages, shares; ``more`` names columns to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            names, scores, sets, parts = shared.value.mixtures(texts_of(block.column(1)))
            columns = [block.column(0), *block.columns[2:], pa.array(names), pa.array(scores, pa.float64())]
            columns += [pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *more, "lang_pred", "score", "languages", "shares"])

    rows = ids_and_texts(docs, *more)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, languages array<string>, shares array<double>")
