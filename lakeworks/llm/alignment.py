"""Two tokenizers aligned byte by byte, and how often their tokens meet over a whole corpus.

Text is read with a space in front. The two tokenizers' tokens are laid over its bytes. Where tokens of both end at the same
byte the text is cut into groups; two tokens whose bytes overlap are linked.

Everything between the tokenizers and Spark works on Arrow arrays. A task takes documents in blocks of a
few megabytes. Neither tokenizer joins bytes on both sides of a single space between other
characters (its pattern, or its pieces, rule that out: checked when they are loaded), so the stretches between such spaces are tokenized and aligned once per
block: lists of tokens are flattened with the index of their stretch, byte lengths are summed up
within each stretch, and a full outer Acero hash join on (stretch, end) brings both sides together. Every end
is one link, and an end known to both closes a group. ``Table.group_by`` counts in how many documents of the block a pair occurs.

Spark adds these partial counts up per pair and joins the totals back to the pairs of each block; a block's documents then
meet its few thousand totals, not each document its own pairs. The work per task stays bounded by a block, whatever
pair is frequent; a pair found in all blocks is one row per block, which adaptive joins can split.

Texts that are null, empty, or not rebuilt exactly by both tokenizers have no tokens, and all figures are zero.
Texts of any length are read whole; a text larger than a block is a block of its own. Repeated rows count as documents of their own;
null doc_ids are kept. On ties for the highest count of a token every pair that has it counts. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ids_and_texts, written

BLOCK = 1 << 20  # bytes of text aligned together
AT_ONCE = 10_000  # stretches whose ids are lists of numbers at one time
_SPACE = "▁"  # how a piece writes a space
_ODD = re.compile(r"\s | \s|^ | $")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_LOCAL = 33  # bits of a block's number within its task
_PAIR = 16  # bits of a token id of the second tokenizer


class Tokenizers:
    """A byte-level BPE file, the pattern that cuts text for it, and a piece model, with the bytes of every token."""

    def __init__(self, byte_path: str, pattern: str, piece_path: str):
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, encoding="utf-8") as file:
            data = json.load(file)
        cut, vocab, merges = data["pre_tokenizer"], data["model"]["vocab"], data["model"]["merges"]
        if data["normalizer"] or cut["type"] != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"]:
            raise ValueError("the byte-level vocabulary must cut text by the usual pattern, and not change it")
        made = [vocab["".join(x if isinstance(x, list) else x.split(" "))] for x in merges]
        if made != sorted(made) or any(i < 256 for i in made):
            raise ValueError("tokens are not numbered in the order of their merges")
        byte_of = _bytes_of_letters()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        # Ids in the order of merges are ranks, so this gives the same ids as the file's own library, in a third of the time.
        self._ranked = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        raw = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            raw[i] = token
        self.raw_a = pa.array(raw, pa.binary())
        self.raw_b = pa.array([self._piece_bytes(i) for i in range(self._pieces.get_piece_size())], pa.binary())
        if len(self.raw_b) > 1 << _PAIR:
            raise ValueError("the piece model has too many pieces")
        if any(re.search(f"[^{_SPACE}]{_SPACE}", self._pieces.id_to_piece(i)) for i in range(len(self.raw_b))):
            raise ValueError("a piece reaches across a space between words")

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._pieces.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def encode(self, stretches: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both tokenizers for each stretch, with a space in front."""
        parts = [stretches[i : i + AT_ONCE] for i in range(0, len(stretches), AT_ONCE)]
        encode = self._ranked.encode_ordinary
        a = [_flat([encode(" " + x) for x in part]) for part in parts]
        b = [_flat(self._pieces.encode(part, num_threads=1)) for part in parts]
        return _lists(a), _lists(b)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return lengths, np.fromiter(chain.from_iterable(rows), np.int32, lengths.sum())


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    upto = np.cumsum(np.concatenate([[0], *(lengths for lengths, _ in parts)]))
    flat = np.concatenate([np.empty(0, np.int32), *(ids for _, ids in parts)])
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat))


def _bytes_of_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=1)
def tokenizers(byte_path: str, pattern: str, piece_path: str) -> Tokenizers:
    """One pair per worker process."""
    pa.set_cpu_count(1)  # tasks already use all cores
    return Tokenizers(byte_path, pattern, piece_path)


def _stretches(text: str) -> list[str]:
    return _BETWEEN.split(text) if _ODD.search(text) else text.split(" ")


def _exact(ids: pa.ListArray, raw: pa.Array, wanted: pa.Array) -> np.ndarray:
    """Whether the bytes of each list of tokens, one after another, are the wanted ones."""
    tokens = raw.take(ids.flatten())
    starts = np.frombuffer(tokens.buffers()[1], np.int32)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
    joined = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(starts[ids.offsets.to_numpy()]), tokens.buffers()[2]])
    return pc.equal(joined, wanted).to_numpy(zero_copy_only=False)


def _ends(ids: pa.ListArray, raw: pa.Array, name: str) -> pa.Table:
    """A row per token: its list, the byte where it ends, and its id."""
    flat, parent = ids.flatten(), pc.list_parent_indices(ids)
    sums = pc.cumulative_sum(pc.cast(pc.binary_length(raw.take(flat)), pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums]).take(ids.offsets.slice(0, len(ids)))
    return pa.table({"stretch": parent, "end": pc.subtract(sums, before.take(parent)), name: flat})


class Aligned:
    """The distinct stretches of a block: their links, and their groups as text. Stretches that are not exact have none."""

    def __init__(self, own: Tokenizers, stretches: pa.Array):
        a, b = own.encode(stretches.to_pylist())
        wanted = pc.binary_join_element_wise("", stretches, " ").cast(pa.binary())
        self.exact = _exact(a, own.raw_a, wanted) & _exact(b, own.raw_b, wanted)
        n = len(stretches)
        self.n_a, self.n_b = (np.where(self.exact, pc.list_value_length(x).to_numpy(), 0) for x in (a, b))
        kept = pa.array(self.exact)
        a, b = (pc.if_else(kept, x, pa.scalar([], x.type)) for x in (a, b))
        a_rows, b_rows = _ends(a, own.raw_a, "a"), _ends(b, own.raw_b, "b")
        ends = a_rows.join(b_rows, keys=["stretch", "end"], join_type="full outer", use_threads=False)
        ends = ends.sort_by([("stretch", "ascending"), ("end", "ascending")]).combine_chunks()
        stretch = ends["stretch"].to_numpy()
        closes = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"])).to_numpy()
        # A token goes on to its end, so an end that only one side has lies in the other side's next token.
        full_a, full_b = (pc.fill_null_backward(ends[x]).cast(pa.int64()) for x in "ab")
        pairs = pc.bit_wise_or(pc.shift_left(full_a, pa.scalar(_PAIR, pa.int64())), full_b)
        self.pairs = pairs.to_numpy()
        self.n_links = np.bincount(stretch, minlength=n)
        self.n_groups = np.bincount(stretch[closes], minlength=n)
        self.groups = self._written(ends, stretch, closes, n)

    @staticmethod
    def _written(ends: pa.Table, stretch: np.ndarray, closes: np.ndarray, n: int) -> pa.Array:
        last = np.flatnonzero(closes) + 1
        sides = []
        for name in "ab":
            column = ends[name].combine_chunks()
            held = np.concatenate([[0], np.cumsum(column.is_valid().to_numpy(zero_copy_only=False))]).astype(np.int32)
            tokens = column.drop_null().cast(pa.string())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(held[np.concatenate([[0], last])]), tokens), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        upto = np.concatenate([[0], np.cumsum(np.bincount(stretch[closes], minlength=n))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), groups), ";")


class Block:
    """The documents of a block by their stretches."""

    def __init__(self, own: Tokenizers, texts: pa.Array):
        rows = [_stretches(x) if x else [] for x in texts.to_pylist()]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        coded = pa.array([x for row in rows for x in row], pa.string()).dictionary_encode()
        self.aligned = Aligned(own, coded.dictionary)
        self.stretch = coded.indices.to_numpy()
        self.doc = np.repeat(np.arange(len(rows)), lengths)
        wrong = np.zeros(len(rows), dtype=bool)
        wrong[self.doc[~self.aligned.exact[self.stretch]]] = True
        keep = ~wrong[self.doc]
        self.stretch, self.doc, self.n = self.stretch[keep], self.doc[keep], len(rows)

    def total(self, per_stretch: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=per_stretch[self.stretch], minlength=self.n).astype(np.int64)

    def groups(self) -> pa.Array:
        upto = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.n))]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(upto), self.aligned.groups.take(pa.array(self.stretch)))
        return pc.binary_join(listed, ";")

    def pairs(self) -> pa.Table:
        """doc, pair and how often the document links it, by doc."""
        once = pa.table({"doc": self.doc, "stretch": self.stretch}).group_by(["doc", "stretch"], use_threads=False).aggregate([([], "count_all")])
        stretch, n = once["stretch"].to_numpy(), self.aligned.n_links
        taken, starts = n[stretch], (np.cumsum(n) - n)[stretch]
        ends = np.cumsum(taken)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - taken), taken)
        links = pa.table({
            "doc": np.repeat(once["doc"].to_numpy(), taken),
            "pair": self.aligned.pairs[at],
            "times": np.repeat(once["count_all"].to_numpy(), taken),
        })
        return links.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).sort_by("doc")


def groups(docs: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """doc_id and ``groups``: ids of both tokenizers between common ends, as ``a1,a2|b1;a3|b2,b3``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(byte_path, pattern, piece_path)
        for block in blocks(batches, size=BLOCK):
            yield pa.RecordBatch.from_arrays([block.column(0), Block(own, block.column(1)).groups()], names=["doc_id", "groups"])

    rows = ids_and_texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, groups string")


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def _read(docs: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """Rows of documents, with the places of their pairs in the list of the block, and one row per block with that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(byte_path, pattern, piece_path)
        for number, block in enumerate(blocks(batches, size=BLOCK)):
            held = Block(own, block.column(1))
            name = TaskContext.get().partitionId() << _LOCAL | number
            links = held.pairs()
            coded = links["pair"].combine_chunks().dictionary_encode()
            table = pa.table({"slot": coded.indices}).group_by("slot", use_threads=False).aggregate([([], "count_all")]).sort_by("slot")
            upto = np.concatenate([[0], np.cumsum(np.bincount(links["doc"].to_numpy(), minlength=held.n))]).astype(np.int32)
            stretch = held.aligned
            hashed = [hashlib.sha256(x.encode()).hexdigest() if n else "" for x, n in zip(held.groups().to_pylist(), held.total(stretch.n_a))]
            none = pa.nulls(held.n, pa.list_(pa.int64()))
            columns = [
                pa.array(np.full(held.n, name)),
                block.column(0),
                *(pa.array(held.total(getattr(stretch, x))) for x in _FIGURES),
                pa.array(hashed, pa.string()),
                pa.ListArray.from_arrays(pa.array(upto), coded.indices),
                pa.ListArray.from_arrays(pa.array(upto), links["times_sum"].combine_chunks().cast(pa.int32())),
                none,
                none,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            one = [pa.array([name]), *(pa.nulls(1, x.type) for x in columns[1:-2])]
            pairs = pa.array([coded.dictionary.to_numpy()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*one, pairs, pa.array([table["count_all"].to_numpy()], pa.list_(pa.int64()))], names=names)
            del held, links, coded, table, stretch, hashed, none, columns, one, pairs
            pa.default_memory_pool().release_unused()

    rows = ids_and_texts(docs)
    names = ["block", "doc_id", *_FIGURES, "groups_sha256", "slots", "times", "pairs", "n_docs"]
    longs = ", ".join(f"{x} long" for x in _FIGURES)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_id {kind}, {longs}, groups_sha256 string, slots array<int>, times array<int>, pairs array<long>, n_docs array<long>"
    return rows.mapInArrow(run, schema)


def _scored(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Documents of a block with the totals of its pairs: links to a token's most frequent partner, and the sum of counts."""
    count, best = np.zeros(totals.num_rows, np.int64), np.zeros(totals.num_rows, bool)
    slot = totals["slot"].to_numpy()
    count[slot], best[slot] = totals["count"].to_numpy(), totals["best"].to_numpy()
    lists, times = docs["slots"].combine_chunks(), docs["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    slots, lengths = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
    owner = np.repeat(np.arange(len(lists)), lengths)
    n_best, count_sum = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    np.add.at(n_best, owner, times * best[slots])
    np.add.at(count_sum, owner, times * count[slots])
    kept = docs.select(["doc_id", *_FIGURES, "groups_sha256"])
    return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def pair_counts(partial: DataFrame) -> DataFrame:
    """pair, a, count and whether the count is the highest of ``a``, from rows of pair and n_docs."""
    counts = partial.groupBy("pair").agg(F.sum("n_docs").alias("count")).withColumn("a", F.shiftright("pair", _PAIR))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "a", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Both paths must exist on every executor.

    A pair of ids counts the documents that link it anywhere. ``n_best`` is how many links have the highest
    count of their first id, ``count_sum`` the sum over all links. ``groups_sha256`` is of the text that ``groups`` returns, '' without tokens.
    """
    held = written(_read(docs, byte_path, pattern, piece_path), "aligned")
    partial = held.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("slot", "pair"))
    partial = partial.select("block", "slot", "pair.pairs", "pair.n_docs").withColumnRenamed("pairs", "pair")
    totals = partial.join(pair_counts(partial).select("pair", "count", "best"), "pair").select(F.col("block").alias("of_block"), "slot", "count", "best")
    rows = held.filter("pairs IS NULL").drop("pairs", "n_docs")
    kind = rows.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{x} long" for x in _FIGURES)
    schema = f"doc_id {kind}, {longs}, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(totals.groupBy("of_block")).applyInArrow(_scored, schema)
