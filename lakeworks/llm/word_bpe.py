"""BPE with word ends: the words of many texts are merged together, in rounds over one flat array.

A task takes its documents in blocks and gathers the distinct words between white space. The
vocabulary's own normaliser and pattern cut them into pieces. The symbols of all distinct
pieces lie in one array; a binary search over the sorted keys of all known pairs gives each pair of
neighbours its rank. A round merges, in every piece, the pairs of its lowest rank, from left to right where they
overlap, and looks up again only the pairs beside a merge; pieces without a known pair leave the
array. This equals merging one pair at a time, because no token is part of a merge that ranks
before its own; vocabularies where that fails are refused, as are those with unknown-word tokens, added
tokens that take white space along, or other settings that change the result.

Null text counts as empty; an empty text has no ids and decodes to an empty text. Texts of any length
are read whole, and a long word takes as many rounds as it has merges of different rank. Ties,
repeated rows and null doc_ids need no special care, since each row is encoded by its own text.
Extra columns are not read. An empty table gives an empty result. Nothing is shuffled, so a lost
task is run again on its own input.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, ids_and_texts

BLOCK = 8 << 20  # bytes of text whose words are merged together
_SHIFT = 20
_NONE = np.iinfo(np.int64).max
_WHITE = re.compile(r"\s")


class WordVocabulary:
    """A vocabulary file of the tokenizers library: BPE over bytes, with a suffix on the last symbol of a piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, added = data["model"], data.get("added_tokens") or []
        _refuse(model, data, added)
        library = Tokenizer.from_file(path)
        # White space between words never gets into a piece, and a letter alone is a piece: both are checked.
        self._normalized, self._cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        if [x for x, _ in self._cut(self._normalized("Ab\n\t \x0b\x0c\rab"))] != ["ab", "ab"]:
            raise ValueError("the vocabulary's pattern does not cut at white space alone, or keeps capitals")
        self.added = {x["content"]: x["id"] for x in added}
        self._added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: x for x, i in [*vocab.items(), *self.added.items()]}
        singles = {ord(x): i for x, i in vocab.items() if len(x) == 1}
        lasts = {ord(x[0]): i for x, i in vocab.items() if len(x) == 1 + len(suffix) and x.endswith(suffix)}
        self._inner, self._last = _table(singles), _table(lasts)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        _refuse_disorder(merges)
        keys = np.array([a << _SHIFT | b for a, b, _ in merges], dtype=np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._made = np.array([x for _, _, x in merges], dtype=np.int64)
        # The same pattern for texts of ASCII letters, with the space as a piece of its own.
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._simple = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9") + "| ", re.ASCII).findall

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NONE)

    def merge(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has. A piece is in the vocabulary's letters for bytes, never empty."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        ends = np.cumsum(lengths)
        symbols = self._inner[points]
        symbols[ends - 1] = self._last[points[ends - 1]]
        if len(symbols) and symbols.min() < 0:
            raise ValueError("a byte is not in the vocabulary")
        done, done_of = [], []
        which = np.arange(len(pieces))  # pieces still in the array
        owner = np.repeat(which, lengths)  # by symbol: place of its piece in ``which``
        ranks = np.full(len(symbols), _NONE)  # of the pair that begins here
        stale = np.flatnonzero(owner[1:] == owner[:-1])
        while len(which):
            ranks[stale] = self._pair_ranks(symbols[stale], symbols[stale + 1])
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(ranks, starts)
            left = best != _NONE
            if not left.all():
                leaves = ~left[owner]
                done.append(symbols[leaves])
                done_of.append(which[owner[leaves]])
                symbols, ranks, owner = symbols[~leaves], ranks[~leaves], (np.cumsum(left) - 1)[owner[~leaves]]
                which, best = which[left], best[left]
                if not len(which):
                    break
            at = np.flatnonzero(ranks == best[owner])
            # Neighbouring pairs of one rank overlap (aaa): every second one of such a row is taken.
            row = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(row, np.diff(np.append(row, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = self._made[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            at = moved[at]
            ranks[at] = _NONE
            changed = np.zeros(len(symbols), dtype=bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            changed[-1:] = False
            stale = np.flatnonzero(changed)
            stale = stale[owner[stale] == owner[stale + 1]]
        of = np.concatenate([np.empty(0, np.int64), *done_of])
        order = np.argsort(of, kind="stable")
        return np.concatenate([np.empty(0, np.int64), *done])[order], np.bincount(of, minlength=len(pieces))

    def _cut_apart(self, word: str) -> list[str]:
        """Pieces of one word. An added token is a piece that begins with a zero, which no letter of the vocabulary is."""
        out, start = [], 0
        for found in self._added.finditer(word):
            out += [x for x, _ in self._cut(self._normalized(word[start : found.start()]))]
            out.append("\0" + found[0])
            start = found.end()
        return out + [x for x, _ in self._cut(self._normalized(word[start:]))]

    def _cut_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces; of each word's pieces, word by word, the places in that list; how many a word has."""
        plain = pc.and_(pc.string_is_ascii(words), pc.ascii_is_printable(words)).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(words), dtype=bool)
        for x in self.added:
            odd |= pc.match_substring(words, x).to_numpy(zero_copy_only=False)
        simple, other, apart = np.flatnonzero(plain & ~odd), np.flatnonzero(~plain & ~odd), np.flatnonzero(odd).tolist()
        others = words.take(other).to_pylist()
        if _WHITE.search("".join(others)):
            keep = np.array([not _WHITE.search(x) for x in others])
            apart += other[~keep].tolist()
            other, others = other[keep], [x for x, k in zip(others, keep) if k]
        found = self._simple(" ".join(words.take(simple).to_pylist()).lower())
        pieces = pa.array(found, pa.string())
        space = pc.equal(pieces, " ").to_numpy(zero_copy_only=False)
        of = [simple[np.cumsum(space)[~space]]]
        more: list[str] = []
        if others:
            # Normalising never reaches across a space, and a space is no part of a piece.
            text = self._normalized(" ".join(others))
            cut = self._cut(text)
            ends = np.cumsum([len(x) + 1 for x in text.split(" ")])
            starts = np.fromiter((a for _, (a, _) in cut), np.int64, len(cut))
            of.append(other[np.searchsorted(ends, starts, "right")])
            more += [x for x, _ in cut]
        for i in apart:
            cut = self._cut_apart(words[i].as_py())
            of.append(np.full(len(cut), i))
            more += cut
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        coded = pa.concat_arrays([pieces.filter(pa.array(~space)), pa.array(more, pa.string())]).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy()[order], np.bincount(of, minlength=len(words))

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        rows = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words, text = rows.flatten(), pc.list_parent_indices(rows).to_numpy()
        filled = pc.greater(pc.binary_length(words), 0)
        words, text = words.filter(filled), text[filled.to_numpy(zero_copy_only=False)]
        coded = words.dictionary_encode()
        distinct, words = coded.dictionary, coded.indices.to_numpy()
        pieces, cut, n_cut = self._cut_words(distinct)
        fixed = pc.starts_with(pieces, "\0").to_numpy(zero_copy_only=False)
        ids, n_ids = self.merge(pieces.filter(pa.array(~fixed)).to_pylist())
        if fixed.any():
            place = np.empty(len(pieces), np.int64)
            place[np.concatenate([np.flatnonzero(~fixed), np.flatnonzero(fixed)])] = np.arange(len(pieces))
            ids = np.concatenate([ids, [self.added[x[1:]] for x in pieces.filter(pa.array(fixed)).to_pylist()]])
            n_ids, cut = np.concatenate([n_ids, np.ones(int(fixed.sum()), np.int64)]), place[cut]
        ids, n_ids = _ragged(ids, n_ids, cut)  # by piece of a word
        owner = np.repeat(np.arange(len(distinct)), n_cut)
        n_ids = np.bincount(owner, weights=n_ids, minlength=len(distinct)).astype(np.int64)
        ids, n_ids = _ragged(ids, n_ids, words)
        return ids, np.bincount(text, weights=n_ids, minlength=len(rows)).astype(np.int64)

    def decode(self, ids: Sequence[int]) -> str:
        """Without a decoder, tokens are written one after another with a space between."""
        return " ".join(map(self.token.__getitem__, ids))


def _ragged(values: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a list of lists (all values, and the length of each) the given lists, in the same form."""
    starts, taken = np.cumsum(lengths) - lengths, lengths[rows]
    ends = np.cumsum(taken)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - (ends - taken), taken)
    return values[at], taken


def _refuse(model: dict, data: dict, added: list[dict]) -> None:
    plain = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(x) for x in plain) or data.get("decoder") is not None:
        raise ValueError("only byte-level BPE without unknown tokens, prefixes, dropout and decoder is supported")
    for x in added:
        if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or _WHITE.search(x["content"]):
            raise ValueError(f"added token {x['content']!r} depends on the text around it")


def _refuse_disorder(merges: list[tuple[int, int, int]]) -> None:
    made: dict[int, int] = {}
    for rank, (_, _, token) in enumerate(merges):
        if token in made:
            raise ValueError("a token is made by two merges")
        made[token] = rank
    if any(made.get(a, -1) >= rank or made.get(b, -1) >= rank for rank, (a, b, _) in enumerate(merges)):
        raise ValueError("a token is part of a merge that ranks before its own")


def _table(ids: dict[int, int]) -> np.ndarray:
    table = np.full(max(ids, default=0) + 1, -1, dtype=np.int64)
    table[list(ids)] = list(ids.values())
    return table


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    """One per worker process."""
    return WordVocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids, decoded. ``path`` must exist on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for block in blocks(batches, size=BLOCK):
            ids, lengths = words.encode_block(block.column(1))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            tokens = list(map(words.token.__getitem__, ids.tolist()))
            texts = pa.array([" ".join(tokens[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.string())
            listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column(0), listed, texts], names=["doc_id", "ids", "decoded"])

    rows = ids_and_texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and ``decoded``, the text that an ``ids`` column stands for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            found = [words.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", ids).mapInArrow(run, f"doc_id {kind}, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids and of the decoded text."""
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
