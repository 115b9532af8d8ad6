import hashlib
import json
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lakeworks.llm import queries, word_bpe

from .fixtures import SCHEMA, awkward, awkward_rows, texts_of


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORDS)


@pytest.fixture(scope="module")
def vocabulary():
    return word_bpe.WordVocabulary(queries.WORDS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_whole_table_as_the_library(spark, sf, library):
    got = queries.QUERIES["op12_word_bpe"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, texts_of(sf, columns="doc_id, text"))


def test_awkward_rows_and_decoding(spark, library):
    encoded = word_bpe.encode(awkward(spark), queries.WORDS)
    assert sorted(map(tuple, word_bpe.digests(encoded).collect()), key=str) == expected(library, [r[:2] for r in awkward_rows()])
    back = word_bpe.decode(encoded, queries.WORDS).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((r["doc_id"], r["decoded"])) for r in encoded.collect())


def ids_of(vocabulary, texts):
    ids, lengths = vocabulary.encode_block(pa.array(texts, pa.string()))
    out, at = [], 0
    for n in lengths.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    assert at == len(ids)
    return out


def test_random_texts_as_the_library(vocabulary, library):
    rng = random.Random(3)
    alphabet = "aaabbberER  \n\t\x0b\x0c\r'sdll're éüÉ漢字١٢3½ⅷ_-—€😀́‍\xa0\x85 \x1c\x00ΣΑİǅ<|startoftext|>"
    texts = []
    for _ in range(4000):
        pick = lambda: rng.choice(alphabet) if rng.random() < 0.8 else chr(rng.randrange(32, 0x2FFF))
        texts.append("".join(pick() for _ in range(rng.randrange(0, 30))))
    texts += [x + rng.choice(["<|endoftext|>", "<|startoftext|><|ENDOFTEXT|>", " <|endoftext|> x"]) for x in texts[:500]]
    texts += ["er" * 5000, "a" * 20_001, "ab" * 3000 + "ba" * 100, "".join(rng.choice("abcdefgh") for _ in range(3000)), "", " "]
    got = ids_of(vocabulary, [*texts, None])
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert got == [*want, []]
    assert [vocabulary.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_no_texts(vocabulary, spark):
    assert ids_of(vocabulary, []) == [] and ids_of(vocabulary, [None, "", "\n"]) == [[], [], []]
    assert word_bpe.digests(word_bpe.encode(spark.createDataFrame([], SCHEMA), queries.WORDS)).collect() == []


@pytest.mark.parametrize("change", ["decoder", "added", "order", "twice"])
def test_vocabularies_that_need_more_are_refused(tmp_path, change):
    with open(queries.WORDS, encoding="utf-8") as file:
        data = json.load(file)
    merges = data["model"]["merges"]
    if change == "decoder":
        data["decoder"] = {"type": "BPEDecoder", "suffix": "</w>"}
    elif change == "added":
        data["added_tokens"][0]["lstrip"] = True
    elif change == "order":
        merges.append(merges.pop(0))
    else:
        merges.append(merges[0])
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    with pytest.raises(ValueError):
        word_bpe.WordVocabulary(str(path))
