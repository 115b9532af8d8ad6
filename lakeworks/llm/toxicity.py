"""Toxicity by the nearest labelled examples, with exact cosines of all words from a block-max index.

A text is a vector of its lower-cased words, each weighted (1 + log tf) * idf * lean. idf is counted over
all documents, for words of no example too: those meet no example, but belong to the length of the text.
``lean`` is ``FLOOR`` for every word and grows with the square of the z value by which the word tells toxic
examples from others; so no word is left out. The examples lie in blocks of ``BLOCK``; the index keeps per
word and block the postings and the largest weight. What the ``FREQUENT`` words with the most postings add to
the cosines comes from one product of matrices for ``TOGETHER`` queries. A query adds to the most of that in a block the
block maxima of its other words, and opens only blocks whose bound reaches what ``NEAREST`` examples have by
the frequent words alone: the ``FIRST_BLOCKS`` of the largest bounds, then those that reach the cosines found there,
or in one scan of the other postings if they are many. So the neighbours are exact.

Neighbours vote with the square of their cosine, each label weighted to its share in all labelled rows,
against a prior of fixed weight. The votes of the examples among each other, each left out of its own
search, fit the two numbers of a logistic calibration. ``evidence`` names the nearest examples.

The order of a text's neighbours does not depend on its length, and its vote only by one division. So the
search runs over the words of examples, and the rest of the length, whose frequencies take a join, comes after.

Examples are a bounded sample of the labelled rows: up to ``PER_CLASS`` of each label, those of the
smallest hash of doc_id. A null label is no label; of several labels of a doc_id the largest counts, and of several
rows the one of the smallest hash of its text, so a repeated row is one example. Every row is scored by its own text, and
counts in the frequencies of words. A text without a word of any example, a null or empty one included, gets the
calibrated prior; with no toxic example every score is 0. Neighbours at equal cosine count in the order of the sample.
Very long texts are read whole, an empty table gives an empty result, and extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bytes_of, ids_and_texts, one_each, written

PER_CLASS = 2000
FLOOR = 0.2  # of a word that leans nowhere
SURE_LEAN = 3.0  # z value that adds 1 to the floor
BLOCK = 64
FIRST_BLOCKS = 6
MANY_BLOCKS = 16  # beyond those, from which on one scan of all is cheaper
FREQUENT = 256
TOGETHER = 64
NEAREST = 32
PRIOR_WEIGHT = 0.5
EVIDENCE = 3
_LETTERS = re.compile(r"[^\W\d_]+").findall
_SIGMA = "\u03a3".encode()
# Of ASCII, letters in lower case; all else between words is a space. Other bytes stay.
_ASCII = bytes(x if x > 127 else ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in range(256))
_SLACK = 1e-8  # bounds and cosines add the same numbers in another order


def lean(with_term: Sequence[np.ndarray], examples: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a term between toxic and other examples, and their z value."""
    other, toxic = (np.asarray(x, float) for x in with_term)
    a, b = toxic + 0.5, examples[1] - toxic + 0.5
    c, d = other + 0.5, examples[0] - other + 0.5
    log_odds = np.log(a * d / (b * c))
    return log_odds, log_odds / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def leaning(other: np.ndarray, toxic: np.ndarray, examples: Sequence[int]) -> np.ndarray:
    """Factor of each word's weight, ``FLOOR`` at least."""
    _, z = lean([other, toxic], examples)
    return FLOOR + np.where(toxic > 0, np.maximum(z, 0) / SURE_LEAN, 0.0) ** 2


@lru_cache(100_000)
def _parts(stretch: bytes) -> tuple[bytes, ...]:
    """Words in a stretch without ASCII other than small letters."""
    return tuple(w.encode() for w in _LETTERS(stretch.decode().lower()))


def _stretches(text: bytes) -> list[bytes]:
    if _SIGMA in text:
        # Its small form depends on the letters around it.
        return [w.encode() for w in _LETTERS(text.decode().lower())]
    return text.translate(_ASCII).split()


def word_counts(texts: Sequence[bytes], number: Mapping[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Place of the text, number of the word and times, ascending, of the words in some texts.

    Words are runs of letters in lower case. Those that ``number``, whose keys are such words, has not got are numbered on
    from it, in the order of the list returned. Stretches between ASCII other than letters are counted first; most are words.
    """
    words, times, sizes, odd = array("q"), array("q"), [], []
    rest: dict[bytes, int] = {}
    for place, text in enumerate(texts):
        found = Counter(_stretches(text))
        begin = len(words)
        words.extend(map(number.get, found, repeat(-1)))
        times.extend(found.values())
        sizes.append(len(found))
        for at, stretch in enumerate(found):
            if words[begin + at] < 0:
                if stretch.isascii():
                    words[begin + at] = len(number) + rest.setdefault(stretch, len(rest))
                else:
                    odd.extend((place, w, times[begin + at]) for w in _parts(stretch))
    place, word, n = np.repeat(np.arange(len(texts)), sizes), np.asarray(words), np.asarray(times)
    if odd:
        whole = word >= 0
        more = [number[w] if w in number else len(number) + rest.setdefault(w, len(rest)) for _, w, _ in odd]
        place = np.append(place[whole], [p for p, _, _ in odd])
        word, n = np.append(word[whole], more), np.append(n[whole], [k for _, _, k in odd])
    width = max(1, len(number) + len(rest))
    pairs = place * width + word
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    n = np.add.reduceat(n[order], first) if len(first) else n
    return pairs[first] // width, pairs[first] % width, n, list(rest)


class Vectors:
    """Counts of each text's words: by ascending number where an example has the word, else by the word itself."""

    def __init__(self, terms: list[str]):
        self.number = {t.encode(): i for i, t in enumerate(terms)}

    def counts(self, texts: Sequence[bytes]) -> list[pa.Array]:
        """Lists per text: numbers, their counts, other words, and theirs."""
        text, word, times, rest = word_counts(texts, self.number)
        times = pa.array(times, pa.int32())
        known = word < len(self.number)
        lists = []
        for picked in (known, ~known):
            ends = pa.array(np.append(0, np.cumsum(np.bincount(text[picked], minlength=len(texts)))), pa.int32())
            values = pa.array(word[picked], pa.int32())
            if picked is not known:
                values = pa.array(rest, pa.binary()).cast(pa.string()).take(pa.array(word[picked] - len(self.number)))
            lists += [pa.ListArray.from_arrays(ends, x) for x in (values, times.filter(pa.array(picked)))]
        return lists


def weighted(terms: np.ndarray, times: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The vector scaled to length one, and the square of its length before."""
    w = (1 + np.log(times)) * weight[terms]
    square = float((w * w).sum())
    return w / np.sqrt(square), square


def spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for sizes[0] numbers, then on from begin[1], and so forth."""
    upto = np.cumsum(sizes)
    return np.repeat(begin - upto + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Index:
    """Examples in blocks: postings sorted by term and block, and the largest weight per term and block."""

    postings: np.ndarray  # place of the example in its block
    places: np.ndarray  # and among all
    weights: np.ndarray
    first: np.ndarray  # terms x (blocks + 1): where the postings of a term in a block begin
    most: np.ndarray  # terms x blocks
    column: np.ndarray  # row of ``dense`` that a frequent term has, else -1
    dense: np.ndarray  # frequent terms x examples: weights
    labels: np.ndarray
    votes: np.ndarray  # weight of each example's vote
    ids: np.ndarray
    prior: float

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, shares: dict[int, float], n_terms: int) -> Index:
        # Examples with the same strongest term share blocks, so that bounds differ between blocks.
        strongest = np.array([t[w.argmax()] if len(t) else n_terms for t, w in vectors])
        order = np.argsort(strongest, kind="stable")
        vectors, labels, ids = [vectors[i] for i in order], labels[order], ids[order]
        n_blocks = max(1, -(-len(vectors) // BLOCK))
        term = np.concatenate([t for t, _ in vectors]).astype(np.int64)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors])
        sort = np.lexsort((example, term))
        term, example, weight = term[sort], example[sort], weight[sort]
        upto = np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int32)
        votes = np.array([shares[int(x)] / max(1, (labels == x).sum()) for x in labels])
        votes /= votes.mean()
        prior = float((votes * labels).sum() / votes.sum())
        return Index.blocked(upto, example.astype(np.int32), weight, labels, votes, ids, prior)

    @staticmethod
    def blocked(upto: np.ndarray, example: np.ndarray, weight: np.ndarray, *rest) -> Index:
        """From the postings of each term, in the order of the examples."""
        n_terms, n_blocks = len(upto) - 1, max(1, -(-len(rest[0]) // BLOCK))
        term = np.repeat(np.arange(n_terms), np.diff(upto))
        cell = term * n_blocks + example // BLOCK
        ends = np.cumsum(np.bincount(cell, minlength=n_terms * n_blocks)).astype(np.int32).reshape(n_terms, n_blocks)
        first = np.concatenate([np.append(0, ends[:-1, -1])[:n_terms, None].astype(np.int32), ends], axis=1)
        # Bounds are rounded up.
        most = np.zeros(n_terms * n_blocks, np.float32)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        if len(starts):
            most[cell[starts]] = np.nextafter(np.maximum.reduceat(weight, starts).astype(np.float32), np.float32(np.inf))
        sizes = np.diff(upto)
        frequent = np.argsort(-sizes, kind="stable")[:FREQUENT]
        frequent = frequent[sizes[frequent] > 0]
        column = np.full(n_terms, -1)
        column[frequent] = np.arange(len(frequent))
        dense = np.zeros((len(frequent), len(rest[0])))
        mine = column[term] >= 0
        dense[column[term[mine]], example[mine]] = weight[mine]
        return Index((example % BLOCK).astype(np.uint8), example, weight, first, most.reshape(n_terms, n_blocks), column, dense, *rest)

    def __reduce__(self):
        # What is kept per block and of frequent words follows from the postings and is far larger, so it is not sent.
        upto = np.append(self.first[:, 0], len(self.places)).astype(np.int32)
        return Index.blocked, (upto, self.places, self.weights, self.labels, self.votes, self.ids, self.prior)

    def _add(self, cosines: np.ndarray, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Places of the examples in some blocks, and the cosines with what the terms add there."""
        begin, end = self.first[terms[:, None], blocks].ravel(), self.first[terms[:, None], blocks + 1].ravel()
        sizes = end - begin
        at = spans(begin, sizes)
        block = np.repeat(np.tile(np.arange(len(blocks)), len(terms)), sizes)
        parts = np.repeat(np.repeat(weights, len(blocks)), sizes) * self.weights[at]
        sums = np.bincount(block * BLOCK + self.postings[at], parts, len(blocks) * BLOCK)
        places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        inside = places < len(cosines)
        return places[inside], cosines[places[inside]] + sums[inside]

    def _add_all(self, cosines: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The cosines with what the terms add."""
        begin = self.first[terms, 0].astype(np.int64)
        sizes = self.first[terms, -1] - begin
        at = spans(begin, sizes)
        return cosines + np.bincount(self.places[at], np.repeat(weights, sizes) * self.weights[at], len(cosines))

    def by_frequent(self, queries: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Queries x examples: what frequent words add to the cosines."""
        terms = np.concatenate([t for t, _ in queries])
        weights = np.concatenate([w for _, w in queries])
        query = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        column = self.column[terms]
        mine = column >= 0
        wanted = np.zeros((len(queries), len(self.dense)))
        wanted[query[mine], column[mine]] = weights[mine]
        return wanted @ self.dense

    def nearest_each(self, queries: Sequence[tuple[np.ndarray, np.ndarray]], k: int, without: Sequence[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of every query, each with terms."""
        for start in range(0, len(queries), TOGETHER):
            some = queries[start : start + TOGETHER]
            for i, ((terms, weights), cosines) in enumerate(zip(some, self.by_frequent(some))):
                yield self._nearest(terms, weights, cosines, k, -1 if without is None else without[start + i])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k examples with the largest cosine above 0; ties by doc_id."""
        return next(self.nearest_each([(terms, weights)], k, [without]))

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, cosines: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """``cosines`` are those by frequent words.

        k examples have the k-th largest of them at least, so a block whose bound is below holds no nearer example.
        """

        def reached(cosines: np.ndarray) -> float:
            return np.partition(cosines, -k)[-k] - _SLACK if len(cosines) > k else 0.0

        places = np.arange(len(cosines))
        rare = self.column[terms] < 0
        terms, weights = terms[rare], weights[rare]
        if without >= 0:
            cosines[without] = 0.0
        reach = reached(cosines)
        if len(terms):
            bounds = np.maximum.reduceat(cosines, places[::BLOCK]) + weights @ self.most[terms]
            opened = np.flatnonzero((bounds >= reach) & (bounds > 0))
            if len(opened) > FIRST_BLOCKS + MANY_BLOCKS:
                cosines = self._add_all(cosines, terms, weights)
            else:
                by_frequent, opened = cosines, opened[np.argsort(-bounds[opened], kind="stable")]
                places, cosines = self._add(by_frequent, terms, weights, opened[:FIRST_BLOCKS])
                cosines[places == without] = 0.0
                reach = max(reach, reached(cosines))
                more = opened[FIRST_BLOCKS:]
                more = more[bounds[more] >= reach]
                if len(more):
                    places, cosines = (np.concatenate(x) for x in zip((places, cosines), self._add(by_frequent, terms, weights, more)))
        near = (cosines > max(reach, 0.0)) & (places != without)
        found, cosines = places[near], cosines[near]
        if len(found) > k:
            near = cosines + _SLACK >= np.partition(cosines, -k)[-k]
            found, cosines = found[near], cosines[near]
        keep = np.lexsort((self.ids[found], -cosines.round(9)))[:k]
        return found[keep], cosines[keep]

    def forces(self, found: np.ndarray, cosines: np.ndarray) -> tuple[float, float]:
        """Of the toxic neighbours, and of all."""
        force = self.votes[found] * cosines**2
        return float((force * self.labels[found]).sum()), float(force.sum())

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        toxic, total = self.forces(found, cosines)
        return (toxic + PRIOR_WEIGHT * self.prior) / (total + PRIOR_WEIGHT)


@dataclass
class Model:
    weight: np.ndarray  # idf * lean
    n_docs: int
    index: Index
    slope: float
    offset: float


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit on the log odds of the votes, by Newton steps with a slight pull to (1, 0)."""
    x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], axis=1)
    beta, pull = np.array([1.0, 0.0]), np.eye(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - pull @ (beta - [1.0, 0.0])
        beta = beta + np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + pull, gradient)
    return float(beta[0]), float(beta[1])


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``per_class`` ids of each label (doc_id, label), and how many ids of ``docs`` have it."""
    ids = labels.filter("label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = ids.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = ids.limit(0)
    for k in sorted(counts):
        picked = picked.unionByName(ids.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    return picked, counts


def example_words(examples: DataFrame, sizes: dict[int, int]) -> tuple[list[str], np.ndarray]:
    """All words of a bounded sample with rows ``text``, ``label``, and their ``leaning``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            text, word, _, names = word_counts(bytes_of(block.column(0)), {})
            label = block.column(1).to_numpy()[text]
            counts = (np.bincount(word[label == k], minlength=len(names)) for k in range(2))
            columns = [pa.array(names, pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "other", "toxic"])

    found = examples.select("text", "label").mapInArrow(count, "term string, other long, toxic long")
    totals = found.groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    # The words of at most twice ``PER_CLASS`` texts.
    table = totals.toArrow().sort_by("term")
    return table["term"].to_pylist(), leaning(table["other"].to_numpy(), table["toxic"].to_numpy(), [sizes.get(0, 0), sizes.get(1, 0)])


def vectors(docs: DataFrame, terms: list[str], *more: str) -> DataFrame:
    """Per row: doc_id, ``more``, a number, the counts of example words, and the other words with theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Vectors(shared.value)
        for block in blocks(batches):
            lists = counter.counts(bytes_of(block.column(1)))
            yield pa.RecordBatch.from_arrays([block.column(0), *block.columns[2:], *lists], names=["doc_id", *more, "terms", "times", "rest", "rest_times"])

    rows = ids_and_texts(docs, *more)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    found = rows.mapInArrow(run, f"{kept}, terms array<int>, times array<int>, rest array<string>, rest_times array<int>")
    return found.withColumn("row", F.monotonically_increasing_id())


def lists_of(column: pa.Array, kind: type) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


def learn(counted: DataFrame, examples: DataFrame, counts: dict[int, int], terms: list[str], leans: np.ndarray) -> Model | None:
    """Index and calibration from the ``vectors`` of all documents and the examples, one row per id."""
    n_docs = counted.count()
    # A row per word of the examples.
    found = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()
    df = np.zeros(len(terms))
    df[found["t"].to_numpy()] = found["n"].to_numpy()
    weight = (np.log((1 + n_docs) / (1 + df)) + 1) * leans
    table = vectors(examples, terms, "label").select("doc_id", "label", "terms", "times").toArrow().sort_by("doc_id")
    labels = table["label"].to_numpy()
    if not len(labels) or not (labels == 1).any() or not terms:
        return None
    own = []
    for t, n in zip(*(lists_of(table[c].combine_chunks(), k) for c, k in (("terms", np.int64), ("times", float)))):
        own.append((t, weighted(t, n, weight)[0] if len(t) else n))
    shares = {k: n / sum(counts.values()) for k, n in counts.items()}
    index = Index.build(own, labels, table["doc_id"].to_numpy(), shares, len(terms))
    where = {int(d): i for i, d in enumerate(index.ids)}
    votes = np.full(len(own), index.prior)
    worded = [i for i, (t, _) in enumerate(own) if len(t)]
    mine = [where[int(d)] for d in table["doc_id"].to_numpy()[worded]]
    votes[worded] = [index.vote(*found) for found in index.nearest_each([own[i] for i in worded], NEAREST, mine)]
    each = np.array([shares[int(x)] / (labels == x).sum() for x in labels]) * len(labels)
    return Model(weight, n_docs, index, *calibration(votes, labels, each))


def rest_squares(counted: DataFrame, n_docs: int) -> DataFrame:
    """Per ``row`` that has words of no example: ``square``, what those add to the square of its length."""
    rest = counted.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("w")).select("row", F.col("w.rest").alias("word"), F.col("w.rest_times").alias("n"))
    # Most of these words are in one document only, and need not be brought back.
    known = rest.groupBy("word").agg(F.count("*").alias("df")).filter("df > 1")
    idf = F.log((1.0 + n_docs) / (1.0 + F.coalesce("df", F.lit(1)))) + 1
    part = ((1 + F.log("n")) * idf * FLOOR) ** 2
    # Whole units, so that the order of the sum does not matter.
    return rest.join(known, "word", "left").groupBy("row").agg((F.sum(F.round(part * 1e9).cast("long")) / 1e9).alias("square"))


def score(counted: DataFrame, model: Model, *more: str) -> DataFrame:
    """Per row of ``vectors``: doc_id, ``more``, score, and evidence (doc_ids of the nearest examples)."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[bytes, tuple[float, float, float, list[int]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(known) > 50_000:
                known = {}
            k = len(more) + 2
            keys, new = [], {}
            for t, n in zip(lists_of(batch.column(k), np.int64), lists_of(batch.column(k + 1), float)):
                keys.append(hashlib.blake2b(t.tobytes() + n.tobytes(), digest_size=16).digest() if len(t) else b"")
                if len(t) and keys[-1] not in known:
                    new[keys[-1]] = (t, n)
            queries = [weighted(t, n, m.weight) for t, n in new.values()]
            search = m.index.nearest_each([(t, w) for (t, _), (w, _) in zip(new.values(), queries)], NEAREST)
            for key, (_, square), (at, cosines) in zip(new, queries, search):
                # Forces at the length the text would have by these words alone.
                toxic, total = m.index.forces(at, cosines)
                known[key] = (toxic * square, total * square, square, m.index.ids[at[:EVIDENCE]].tolist())
            rows = [known[key] if key else (0.0, 0.0, 0.0, []) for key in keys]
            made = [pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]
            columns = [*batch.columns[:k], *made, pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *more, "row", "toxic_force", "force", "known_square", "evidence"])

    rows = counted.select("doc_id", *more, "row", "terms", "times")
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    found = rows.mapInArrow(run, f"{kept}, row long, toxic_force double, force double, known_square double, evidence array<long>")
    found = found.join(rest_squares(counted, model.n_docs), "row", "left")
    square = F.col("known_square") + F.coalesce("square", F.lit(0.0))
    vote = (F.col("toxic_force") + PRIOR_WEIGHT * model.index.prior * square) / (F.col("force") + PRIOR_WEIGHT * square)
    vote = F.when(F.col("force") > 0, vote).otherwise(model.index.prior)
    vote = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), vote))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slope * F.log(vote / (1 - vote)) + model.offset))
    return found.select("doc_id", *more, (1 / (1 + F.exp(-z))).alias("score"), "evidence")


def toxicity(docs: DataFrame, labels: DataFrame, *more: str, per_class: int = PER_CLASS) -> DataFrame:
    """Score all rows of ``docs`` by those that ``labels`` (doc_id, label: 1 toxic, 0 not) names."""
    picked, counts = sample(docs, labels, per_class)
    none = docs.select("doc_id", *more, F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("evidence"))
    if not counts.get(1):
        return none
    sizes = {k: min(n, per_class) for k, n in counts.items()}
    # At most twice ``per_class`` rows.
    examples = written(one_each(docs, written(picked, "picked")), "examples")
    terms, leans = example_words(examples, sizes)
    counted = written(vectors(docs, terms, *more), "terms")
    model = learn(counted, examples, counts, terms, leans)
    return none if model is None else score(counted, model, *more)
