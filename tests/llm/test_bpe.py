import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lakeworks.llm import bpe, queries

from .fixtures import SCHEMA, awkward, awkward_rows, texts_of


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(queries.RANKS, queries.PATTERN)


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        out.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table_as_the_library(spark, sf, library):
    got = queries.QUERIES["op3_bpe"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, texts_of(sf, columns="doc_id, text"))


def test_awkward_rows_and_round_trip(spark, library):
    encoded = bpe.encode(awkward(spark), queries.RANKS, queries.PATTERN)
    assert sorted((tuple(r)[:4] for r in encoded.collect()), key=str) == expected(library, [r[:2] for r in awkward_rows()])
    back = bpe.decode(encoded, queries.RANKS, queries.PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back) == sorted((str(r[0]), (r[1] or "").encode()) for r in awkward_rows())


def test_random_texts_as_the_library(vocabulary, library):
    rng = random.Random(3)
    alphabet = "aaabbberer  \n\t'sdll're éü漢字١٢3½ⅷ_-—€😀́‍\xa0\x85\x1c\x00"
    texts = []
    for _ in range(4000):
        pick = lambda: rng.choice(alphabet) if rng.random() < 0.8 else chr(rng.randrange(32, 0x2FFF))
        texts.append("".join(pick() for _ in range(rng.randrange(0, 30))))
    texts += ["er" * 5000, "a" * 20_000, "x" * 7 + " " * 9 + "\n" * 3]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.encode_block(texts)] == [library.encode_ordinary(x) for x in texts]
    again = vocabulary.encode_block(texts[::-1])[::-1]
    assert [vocabulary.decode(x) for x in again] == [x.encode() for x in texts]


def test_merges_out_of_rank_order_fall_back(tmp_path):
    """Joining ab makes the earlier rank abc possible, which must then come before the next ab."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"abab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = bpe.Vocabulary(str(path), r"\S+|\s+")
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(random.Random(i).choice("abc") for _ in range(12)) for i in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_block(texts)] == [library.encode_ordinary(x) for x in texts]


def test_bounded_table_forgets_and_relearns():
    table = bpe.Recent(3)
    for keys in ({"a", "b"}, {"c", "d"}, {"a", "e"}, {"f", "g", "h"}, {"a", "b"}):
        for k in table.missing(keys):
            table.now[k] = k.upper()
        assert {k: table.now[k] for k in keys} == {k: k.upper() for k in keys}
        assert len(table.now) <= 7


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), queries.RANKS, queries.PATTERN).collect() == []
