"""Byte-level BPE: encode by replaying the merges over a block of the corpus, decode by table.

A task takes its documents in blocks of a few megabytes, cuts them with the vocabulary's
pattern and gathers the distinct pieces of the block. The pieces lie one after another in flat
arrays. An inverted index leads from a merge rank to the positions of the pairs it joins. Ranks
are taken in ascending order; each merge touches its two neighbours only and enters the new pairs
in the index. So a piece is merged once however often it occurs, and a document needs one lookup
per word. Words met before come from a table of bounded size.

A document is encoded from its own text alone: nothing is shuffled, and a lost task is run again
on its own input. Null text counts as empty; an empty text has no ids; texts of any length, ties
and repeated rows need no special care.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blocks, ids_and_texts, texts_of

BLOCK = 8 << 20  # bytes of text merged together
KNOWN = 100_000  # entries after which a worker's table of finished words or pieces begins anew
_SHIFT = 20
_NO_PAIR = -1
_SPACES = re.compile(r"\s | \s")
_FEW = 24  # positions up to which single merges are quicker than arrays


class Recent:
    """A bounded table: what was not used since the last but one renewal is forgotten."""

    def __init__(self, bound: int = KNOWN):
        self.bound, self.now, self._before = bound, {}, {}

    def forget(self) -> None:
        self.now, self._before = {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys without an entry; all others are in ``now`` until the next call."""
        if len(self.now) > self.bound:
            self._before, self.now = self.now, {}
        unknown = keys - self.now.keys()
        found = unknown & self._before.keys()
        self.now.update((x, self._before[x]) for x in found)
        return unknown - found


class Vocabulary:
    """Ranks of a rank file. ``pattern`` cuts the text; merges never cross a cut."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pieces = regex.compile(pattern).findall
        self.token: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        joins: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    joins[left << _SHIFT | right] = rank
        self.joins = joins
        self._keys = np.array(sorted(joins), dtype=np.int64)
        self._values = np.array([joins[k] for k in self._keys.tolist()], dtype=np.int64)
        self.known_words, self.known_pieces = Recent(), Recent()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._values[at], _NO_PAIR)

    def one_by_one(self, piece: bytes) -> list[int]:
        """Merge a single piece; the slow form, for pieces whose merges do not come in rank order."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        while len(ids) > 1:
            ranked = [(self.joins.get(a << _SHIFT | b, 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            ids[i : i + 2] = [rank]
        return ids

    def replay(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of each piece (none empty), as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        token = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        piece_of = np.repeat(np.arange(len(pieces)), lengths)
        # Linked lists of the tokens left; a pair is known by the position of its left token.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = -1, -1
        pair = np.full(n, _NO_PAIR)
        pair[:-1] = self.pair_ranks(token[:-1], token[1:])
        pair[ends - 1] = _NO_PAIR
        alive = np.ones(n, dtype=bool)

        index: list[list[int] | None] = [None] * len(self.token)
        _enter(index, pair, np.arange(n))
        disordered: set[int] = set()
        one = _single_merges(self.joins, index, disordered, token, after, before, pair, alive)
        for rank in range(len(index)):
            where = index[rank]
            if where is None:
                continue
            index[rank] = None
            if len(where) <= _FEW:
                where.sort()
                one(rank, where)
                continue
            at = np.sort(np.array(where))
            at = at[pair[at] == rank]
            # Two pairs of one piece may touch each other, so they go from left to right, one by one.
            same = piece_of[at[1:]] == piece_of[at[:-1]]
            alone = np.ones(len(at), dtype=bool)
            alone[1:] &= ~same
            alone[:-1] &= ~same
            one(rank, at[~alone].tolist())
            p = at[alone]
            q = after[p]
            right, left = after[q], before[p]
            token[p], pair[q], alive[q], after[p] = rank, _NO_PAIR, False, right
            inner, left = right >= 0, left[left >= 0]
            before[right[inner]] = p[inner]
            pair[p] = _NO_PAIR
            pair[p[inner]] = self.pair_ranks(np.int64(rank), token[right[inner]])
            pair[left] = self.pair_ranks(token[left], np.int64(rank))
            spots = np.concatenate([p, left])
            made = pair[spots]
            disordered.update(spots[(made >= 0) & (made < rank)].tolist())
            _enter(index, made, spots)

        ids = token[alive].astype("<u4").tobytes()
        upto = (np.cumsum(alive)[ends - 1] * 4).tolist()
        out = [ids[a:b] for a, b in zip([0, *upto[:-1]], upto)]
        for i in {int(piece_of[p]) for p in disordered}:
            out[i] = np.array(self.one_by_one(pieces[i]), dtype="<u4").tobytes()
        return out

    def _learn(self, pieces: set[str]) -> None:
        raw = []
        for x in self.known_pieces.missing(pieces):
            rank = self.ranks.get(x.encode())
            if rank is None:
                raw.append(x)
            else:
                self.known_pieces.now[x] = rank.to_bytes(4, "little")
        if raw:
            self.known_pieces.now.update(zip(raw, self.replay([x.encode() for x in raw])))

    def encode_block(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers.

        No match of the pattern runs over a single space between two other characters. So words
        between such spaces are cut once each; a text with other white space beside a space is cut whole.
        """
        split = [[x] if _SPACES.search(x) else x.split(" ") for x in texts]
        cut_first = {x[0]: self.pieces(x[0]) for x in split}
        cut_rest = {x: self.pieces(" " + x) for x in self.known_words.missing(set().union(*(x[1:] for x in split)))}
        self._learn(set().union(*cut_first.values(), *cut_rest.values()))
        ids, rest = self.known_pieces.now.__getitem__, self.known_words.now.__getitem__
        self.known_words.now.update((x, b"".join(map(ids, c))) for x, c in cut_rest.items())
        return [b"".join((*map(ids, cut_first[x[0]]), *map(rest, x[1:]))) for x in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _enter(index: list[list[int] | None], ranks: np.ndarray, spots: np.ndarray) -> None:
    """Add positions to the lists of the ranks of their pairs."""
    order = np.argsort(ranks, kind="stable")
    order = order[np.searchsorted(ranks[order], 0) :]
    if not len(order):
        return
    ranks, where = ranks[order], spots[order].tolist()
    cuts = np.flatnonzero(np.diff(ranks)) + 1
    starts = [0, *cuts.tolist()]
    for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(where)]):
        held = index[rank]
        if held is None:
            index[rank] = where[a:b]
        else:
            held += where[a:b]


def _single_merges(joins: dict[int, int], index: list[list[int] | None], disordered: set[int], *state: np.ndarray):
    """Merging one pair at a time, in the order of the positions given."""
    token, after, before, pair, alive = map(memoryview, state)

    def enter(rank: int, made: int, at: int) -> None:
        if made < rank:
            disordered.add(at)
        elif index[made] is None:
            index[made] = [at]
        else:
            index[made].append(at)

    def run(rank: int, spots: list[int]) -> None:
        for p in spots:
            if pair[p] != rank:
                continue
            q = after[p]
            token[p], alive[q], pair[q] = rank, False, _NO_PAIR
            right, left = after[q], before[p]
            after[p], pair[p] = right, _NO_PAIR
            if right >= 0:
                before[right] = p
                made = joins.get(rank << _SHIFT | token[right], _NO_PAIR)
                if made >= 0:
                    pair[p] = made
                    enter(rank, made, p)
            if left >= 0:
                made = joins.get(token[left] << _SHIFT | rank, _NO_PAIR)
                pair[left] = made
                if made >= 0:
                    enter(rank, made, left)

    return run


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process; it takes about 60 MB."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, more: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids.

    ``decoded_sha256`` is of the bytes the ids decode to. ``path`` must exist on every executor. ``more``
    names columns to carry along, after doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        # A worker serves other operators too, so it keeps no words from task to task.
        words.known_words.forget()
        words.known_pieces.forget()
        for block in blocks(batches, size=BLOCK):
            ids = words.encode_block(texts_of(block.column(1)))
            lengths = np.fromiter((len(x) >> 2 for x in ids), np.int64, len(ids))
            columns = [
                block.column(0),
                *block.columns[2:],
                pa.array(lengths),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(words.decode(x)).hexdigest() for x in ids]),
            ]
            names = ["doc_id", *more, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        words.known_words.forget()
        words.known_pieces.forget()

    rows = ids_and_texts(docs, *more)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    schema = f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """doc_id and ``decoded``, the bytes that an ``ids`` column of ``encode`` stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(path, pattern).token
        for batch in batches:
            found = [b"".join(token[i] for i in x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", ids).mapInArrow(run, f"doc_id {kind}, decoded binary")
