"""Quality rules: plain counts, and how public tokenisers take to a text.

A text in a language its tokeniser knows takes few tokens per word, hardly any byte fallback, and
its tokens spread as in prose. Junk shows in one of the three: symbols and capitals cost many
tokens, bytes that are no text fall back, repetition leaves few distinct tokens. Each script has its
own bands, since a tokeniser cuts Han, Thai or Cyrillic finer than Latin. Latin text in which many words
have letters beyond Latin-1 or combining marks (Yoruba, Vietnamese) has one of its own, and so have
scripts that are not listed, most of whose letters fall back to bytes. The edges hold samples of
the Human Rights declaration in such languages, composed and decomposed, besides the given tables.

The distinct words of a block of texts are cut into tokens once; all measures are then sums over arrays of the block's
words, by text. Null text counts as empty, which fails the base rule for want of words. A script without a
band is judged by the band of ``other``. Rows are judged one by one: ties, repeated rows, empty
tables and extra columns change nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame

from .common import WHITE, blocks, ids_and_texts

SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50
AT_ONCE = 20_000  # words whose pieces are lists of numbers at one time

# First and last code points of the letters by which a word is given a script; all else is "latin"
# or "latin_marked" if it has a Latin letter, "unlisted" if it has another and "other" if it has none.
SCRIPTS = (
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("indic", 0x900, 0xDFF),
    ("thai", 0xE00, 0xE7F),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = ("other", "latin", *(name for name, _, _ in SCRIPTS), "latin_marked", "unlisted")
LATIN, MARKED, UNLISTED = (NAMES.index(x) for x in ("latin", "latin_marked", "unlisted"))
MARKED_PERCENT = 20  # of the Latin words of a text, from which on it is "latin_marked"


@dataclass(frozen=True)
class Band:
    """What a kept text may have: characters per token from the merge vocabulary, the share of byte
    fallback among the tokens of the piece vocabulary, and the tokens' entropy as a share of the most
    that a text of its length can have."""

    fewest_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


BANDS = {
    "latin": Band(1.2, 8.0, 0.10, 0.71),
    "latin_marked": Band(0.6, 8.0, 0.35, 0.45),
    "greek": Band(0.7, 8.0, 0.10, 0.55),
    "cyrillic": Band(0.9, 8.0, 0.10, 0.55),
    "hebrew": Band(0.6, 8.0, 0.20, 0.55),
    "arabic": Band(0.7, 8.0, 0.20, 0.55),
    "indic": Band(0.4, 8.0, 0.60, 0.50),
    "thai": Band(0.4, 8.0, 0.60, 0.50),
    "kana": Band(0.4, 8.0, 0.40, 0.50),
    "han": Band(0.4, 8.0, 0.60, 0.50),
    "hangul": Band(0.4, 8.0, 0.60, 0.50),
    "unlisted": Band(0.2, 8.0, 0.97, 0.35),
    "other": Band(0.3, 12.0, 0.70, 0.45),
}
LENGTH_FOR_ENTROPY = 256  # distinct tokens beyond which a longer text need not be more varied


def script_of(word: str) -> int:
    """Place in ``NAMES`` of the script of the first letter that has one."""
    if word.isascii():
        return int(word.lower() != word.upper())
    latin = marked = unlisted = False
    for c in word:
        code = ord(c)
        if code < 0x370 or 0x1E00 <= code < 0x1F00:
            latin = latin or code < 0x300 and c.isalpha() or code >= 0x1E00
            marked = marked or code >= 0x300 or code >= 0x100 and c.isalpha()
        else:
            for i, (_, low, high) in enumerate(SCRIPTS):
                if low <= code <= high:
                    return i + 2
            unlisted = unlisted or c.isalpha()
    if latin:
        return MARKED if marked else LATIN
    return UNLISTED if unlisted else 0


def main_script(words: np.ndarray) -> str:
    """Name of the script that most words have, from the number of words of each."""
    words = np.pad(words, (0, len(NAMES) - len(words)))
    latin, marked = words[LATIN] + words[MARKED], words[MARKED]
    words[LATIN], words[MARKED] = latin, 0
    name = NAMES[int(words.argmax())]
    return "latin_marked" if name == "latin" and 100 * marked >= MARKED_PERCENT * latin else name


class Fertility:
    """Both vocabularies of a worker."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.begins = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, each after a space, one after another, and how many each has.

        One call cuts all: only a word's first token begins with a space."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids = np.array(self.merges.encode_ordinary(" " + " ".join(words)), np.int64)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) == len(words):
            return ids, np.diff(np.append(starts, len(ids)))
        apart = [self.merges.encode_ordinary(" " + w) for w in words]
        return np.fromiter((i for x in apart for i in x), np.int64), np.fromiter(map(len, apart), np.int64)

    def pieced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word, and how many of them are bytes."""
        sizes, raw = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(words), AT_ONCE):
            found = self.pieces.encode(words[at : at + AT_ONCE], num_threads=1)
            n = np.fromiter(map(len, found), np.int64, len(found))
            is_raw = self.fallback[np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))]
            sizes.append(n)
            raw.append(np.bincount(np.repeat(np.arange(len(n)), n)[is_raw], minlength=len(n)))
        return np.concatenate(sizes), np.concatenate(raw)


@lru_cache(maxsize=2)
def _fertility(ranks_path: str, pattern: str, pieces_path: str) -> Fertility:
    return Fertility(ranks_path, pattern, pieces_path)


def _codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for whole numbers, equal for equal ones, and the number each stands for."""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def repeated_words(text: np.ndarray, words: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text, its words that lie in a window of three found twice or more in it."""
    begin = np.flatnonzero(text[:-2] == text[2:]) if len(text) > 2 else np.empty(0, np.int64)
    distinct = int(words.max()) + 1 if len(words) else 1
    window = words[begin]
    for k in (1, 2):
        # Numbered anew at each step, so that the keys stay small.
        window, _ = _codes(window * distinct + words[begin + k])
    window, _ = _codes(text[begin] * (int(window.max(initial=0)) + 1) + window)
    again = begin[np.bincount(window)[window] > 1] if len(window) else begin
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[again + k] = True
    return np.bincount(text[inside], minlength=n_texts)


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            n += line in seen
            seen.add(line)
    return n


def entropies(text: np.ndarray, words: np.ndarray, tokens: np.ndarray, n_tokens: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text, the entropy of its tokens as a share of the most that so many can have."""
    n_words = len(n_tokens) or 1
    code, key = _codes(text * n_words + words)
    times, word = np.bincount(code, minlength=len(key)), key % n_words
    taken = n_tokens[word] if len(word) else np.empty(0, np.int64)
    ends = np.cumsum(taken)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(n_tokens) - n_tokens)[word] - (ends - taken) if len(word) else taken, taken)
    most = int(tokens.max(initial=0)) + 1
    code, pair = _codes(np.repeat(key // n_words, taken) * most + tokens[at])
    counts = np.bincount(code, weights=np.repeat(times, taken), minlength=len(pair))
    of = pair // most
    total = np.bincount(of, weights=counts, minlength=n_texts)
    inner = np.bincount(of, weights=counts * np.log2(np.maximum(counts, 1)), minlength=n_texts)
    several = np.maximum(total, 2)
    spread = (np.log2(several) - inner / several) / np.log2(np.minimum(several, LENGTH_FOR_ENTROPY))
    return np.where(total < 2, 0.0, np.maximum(spread, 0.0))


COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "script": "string",
    "chars_per_token": "double",
    "fallback_share": "double",
    "token_entropy": "double",
}


def judge(texts: pa.Array | list[str], vocabularies: Fertility, bands: dict[str, Band] = BANDS) -> dict[str, list]:
    """The ``COLUMNS`` of each text; measures of a text without tokens are 0."""
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    flat, text = split.flatten(), pc.list_parent_indices(split).to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(filled).dictionary_encode()
    text, words, distinct = text[filled.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64), coded.dictionary
    listed = distinct.to_pylist()

    def summed(per_word: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=per_word[words], minlength=n).astype(np.int64)

    # ASCII words have a script if they have a letter; the others are looked at letter by letter.
    scripts = pc.match_substring_regex(distinct, "[A-Za-z]").to_numpy(zero_copy_only=False).astype(np.int64)
    for i in np.flatnonzero(~pc.string_is_ascii(distinct).to_numpy(zero_copy_only=False)).tolist():
        scripts[i] = script_of(listed[i])
    tokens, n_tokens = vocabularies.merged(listed)
    pieces, raw = (summed(x) for x in vocabularies.pieced(listed))
    n_words = np.bincount(text, minlength=n)
    chars = summed(pc.utf8_length(distinct).to_numpy().astype(np.int64))
    symbols = summed(pc.count_substring_regex(distinct, "[" + re.escape(SYMBOLS) + "]").to_numpy().astype(np.int64))
    again = repeated_words(text, words, n)
    failed = (n_words < FEWEST_WORDS) | (100 * again > MOST_REPEATED_PERCENT * n_words)
    of_script = np.bincount(text * len(NAMES) + scripts[words], minlength=n * len(NAMES)).reshape(n, len(NAMES))
    names = [main_script(row) if k else "other" for row, k in zip(of_script, n_words)]
    per_token = chars / np.maximum(summed(n_tokens), 1)
    fallback = raw / np.maximum(pieces, 1)
    spread = entropies(text, words, tokens, n_tokens, n)
    own = [bands.get(name, bands["other"]) for name in names]
    least, most, most_raw, even = (np.array([getattr(b, f) for b in own]) for f in ("fewest_chars", "most_chars", "most_fallback", "least_entropy"))
    kept = ~failed & (least <= per_token) & (per_token <= most) & (fallback <= most_raw) & (spread >= even)
    lines = [repeated_lines(x) for x in texts.to_pylist()]
    values = n_words, chars, symbols, lines, again, failed, kept, names, per_token, fallback, spread
    return {c: v if isinstance(v, list) else v.tolist() for c, v in zip(COLUMNS, values)}


def measures(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """doc_id and the ``COLUMNS`` of every row. The vocabulary files must exist on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _fertility(ranks_path, pattern, pieces_path)
        for block in blocks(batches):
            found = judge(block.column(1), vocabularies, bands)
            arrays = [block.column(0), *map(pa.array, found.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return ids_and_texts(docs).mapInArrow(run, schema)


def passing(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows that are kept, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _fertility(ranks_path, pattern, pieces_path)
        for batch in batches:
            for block in blocks(iter([batch]), batch.schema.names[at]):
                kept = judge(block.column(at), vocabularies, bands)["kept"]
                yield block.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
