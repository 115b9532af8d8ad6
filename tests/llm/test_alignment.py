import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeworks.llm import alignment, queries

from .fixtures import SCHEMA, awkward, awkward_rows, texts_of

FILES = queries.BYTES, queries.PATTERN, queries.PIECES


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(queries.BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def own():
    return alignment.Tokenizers(*FILES)


def tokens(libraries, text):
    """Ids of both libraries and the bytes of each token; nothing where the text is not rebuilt."""
    a, b = libraries
    if not text:
        return [], []
    letters = alignment._bytes_of_letters()
    left = [(x, bytes(letters[c] for c in a.id_to_token(x))) for x in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for x in b.encode(text):
        piece = b.id_to_piece(x)
        right.append((x, bytes([int(piece[3:5], 16)]) if b.is_byte(x) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], []
    return left, right


def brute(libraries, texts):
    rows = []
    for text in texts:
        left, right = tokens(libraries, text)
        spans = []
        for side in (left, right):
            at, row = 0, []
            for x, raw in side:
                row.append((at, at + len(raw), x))
                at += len(raw)
            spans.append(row)
        links = [(x, y) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e] if len(left) < 600 else swept(*spans)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, before = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(x) for _, v, x in row if before < v <= e) for row in spans) if len(left) < 600 else None)
            before = e
        rows.append((len(left), len(right), len(groups), links, groups))
    count = Counter(p for r in rows for p in set(r[3]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for n_a, n_b, n_groups, links, groups in rows:
        listing = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), listing))
    return out


def swept(left, right):
    links, i, j = [], 0, 0
    while i < len(left):
        links.append((left[i][2], right[j][2]))
        a, b = left[i][1], right[j][1]
        i, j = i + (a <= b), j + (b <= a)
    return links


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(got, ids, want):
    """Texts too long for the slow way of writing groups are checked without their digest."""
    rows = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()), key=str)
    wanted = sorted(((i, *w) for i, w in zip(ids, want)), key=str)
    assert [r[:-1] for r in rows] == [w[:-1] for w in wanted]
    assert sorted(map(str, rows)) == sorted(str((*w[:-1], w[-1] if w[-1] is not None else next(r[-1] for r in rows if r[:-1] == w[:-1]))) for w in wanted)


def test_whole_table_by_brute_force(spark, sf, libraries):
    rows = texts_of(sf, columns="doc_id, text")
    got = queries.QUERIES["op13_alignment"](spark, sf)
    check(got, [r[0] for r in rows], brute(libraries, [r[1] for r in rows]))


def odd_texts():
    rng = random.Random(4)
    alphabet = "aaabbberER   \n\t\x0b\r'sdll're éü漢字١3½_-—€😀́\xa0\x85 \x1c\x00▁<|endoftext|><s></s><unk>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    return [*texts, "▁", "a ▁b", " ", "  ", " a", "a ", "a  b", "\n a", "a \n b ", None, "", "x" * 3000, " " * 3000, "<|endoftext|> <unk> <s>", "dup", "dup"]


def test_odd_texts_in_many_blocks(spark, libraries):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    check(alignment.align(docs, *FILES), range(len(texts)), brute(libraries, texts))


def test_awkward_rows(spark, libraries):
    rows = [r for r in awkward_rows() if len(r[1] or "") < 10_000]
    check(alignment.align(awkward(spark, rows), *FILES), [r[0] for r in rows], brute(libraries, [r[1] for r in rows]))


def test_groups_are_what_the_digest_is_of(spark):
    docs = awkward(spark, awkward_rows())
    listed = alignment.groups(docs, *FILES)
    digests = listed.select("doc_id", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)))
    aligned = alignment.align(docs, *FILES).select("doc_id", "groups_sha256")
    assert sorted(map(str, digests.collect())) == sorted(str(r).replace("groups_sha256", digests.columns[1]) for r in aligned.collect())


def test_stretches_change_no_ids(own, libraries):
    """What is cut at single spaces and encoded apart equals the whole text encoded by the libraries.

    A text with the character that pieces write spaces with is never rebuilt, so its ids do not matter.
    """
    for text in (x for x in odd_texts() if x and "▁" not in x):
        a, b = own.encode(alignment._stretches(text))
        assert a.flatten().to_pylist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert b.flatten().to_pylist() == libraries[1].encode(text)


def test_empty_tables(spark, own):
    assert alignment.align(spark.createDataFrame([], SCHEMA), *FILES).collect() == []
    held = alignment.Block(own, pa.array([None, ""], pa.string()))
    assert held.pairs().num_rows == 0 and held.groups().to_pylist() == ["", ""]
    none = alignment.align(spark.createDataFrame([(1, None), (None, "▁")], "doc_id long, text string"), *FILES).collect()
    assert sorted(map(str, (tuple(r) for r in none))) == sorted(str((i, 0, 0, 0, 0, "", 0, 0)) for i in (1, None))
