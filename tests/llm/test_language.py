import zlib

import numpy as np
import pytest

from lakeworks.llm import language as X
from lakeworks.llm import queries

from .fixtures import SCHEMA, awkward, texts_of


def slow_log_likelihood(likely, times, share):
    return sum(n * np.log(sum(s * p for s, p in zip(share, row))) for row, n in zip(likely, times))


def test_estimate_climbs_to_the_best_mixture():
    rng = np.random.default_rng(1)
    likely, times = rng.uniform(0.01, 1, (60, 2)), rng.integers(1, 5, 60)
    share, fit = X.estimate(likely, times.astype(float), np.array([0]), np.array([[0.5, 0.5]]), 400)
    grid = [(slow_log_likelihood(likely, times, (a, 1 - a)), a) for a in np.linspace(0.001, 0.999, 999)]
    best, at = max(grid)
    assert fit[0] == pytest.approx(best, abs=1e-3) and share[0][0] == pytest.approx(at, abs=0.02)


def test_documents_of_a_block_do_not_touch_each_other():
    rng = np.random.default_rng(2)
    parts = [(rng.uniform(0.01, 1, (n, 3)), rng.integers(1, 4, n)) for n in (1, 5, 40, 2)]
    together = X.chosen(np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts]), np.array([1, 5, 40, 2]))
    for i, (p, t) in enumerate(parts):
        best, share = X.chosen(p, t, np.array([len(p)]))
        assert best[0] == together[0][i] and share[0] == pytest.approx(together[1][i])


def test_ngrams_as_plain_slices():
    words = ["ab", "x", "naïve", "漢字かな"]
    buckets, owners = X.ngrams(words)
    assert [int((owners == i).sum()) for i in range(len(words))] == [len(w) + (len(w) + 1) + len(w) for w in words]
    alone = np.concatenate([X.ngrams([w])[0] for w in words])
    assert sorted(buckets.tolist()) == sorted(alone.tolist())
    assert buckets.max() < len(X.ORDERS) * X.BUCKETS


@pytest.fixture(scope="module")
def predicted(spark, sf):
    return queries.QUERIES["op6_language"](spark, sf.replace("0.001", "0.01")).collect()


def test_held_out_accuracy(predicted, sf):
    truth = dict(texts_of(sf.replace("0.001", "0.01"), columns="doc_id, lang"))
    assert {r["doc_id"] for r in predicted} == set(truth) and len(predicted) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in predicted)
    held = [r for r in predicted if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in predicted)


def test_mixture_and_undetermined(spark):
    rows = [(1, "the cat and the dog " * 30, "en"), (2, "der Hund und die Katze " * 30, "de"), (3, "le chien et la souris " * 30, "fr"), (4, None, "xx"), (5, "la", None)]
    model = X.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    names, scores = model.predict(["the dog and the cat " * 20 + "der Hund " * 10, "und die Katze", "", "12 ²½ !", "chien et"])
    assert names == ["en", "de", X.UNKNOWN, X.UNKNOWN, "fr"]
    assert 0.6 < scores[0] < 0.95 and scores[2:4] == [0, 0]


def test_awkward_rows_and_nothing_to_learn(spark):
    docs = awkward(spark)
    model = X.learn(docs)
    got = X.predict(docs, model, "held_out").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == "clash" for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert X.predict(empty, model).collect() == []
    assert {r["lang_pred"] for r in X.predict(docs, X.learn(empty)).collect()} == {X.UNKNOWN}


def test_four_languages_and_their_shares(spark):
    words = {"de": "der Hund und die Katze", "en": "the dog with this cat", "fr": "le chien avec une souris", "it": "gli uccelli sono nella gabbia", "pl": "szczur zjada świeży chrząszcz"}
    rows = [(i, (t + " ") * 30, lang) for i, (lang, t) in enumerate(words.items())]
    docs = spark.createDataFrame(rows + [(9, " ".join((words[x] + " ") * n for x, n in (("de", 40), ("en", 30), ("fr", 20), ("it", 10))), None), (10, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in X.predict(docs, X.learn(docs)).collect()}
    assert got[9]["languages"] == ["de", "en", "fr", "it"] and got[9]["lang_pred"] == "de"
    assert got[9]["shares"] == pytest.approx([0.4, 0.3, 0.2, 0.1], abs=0.03)
    assert got[9]["score"] == got[9]["shares"][0] and sum(got[9]["shares"]) == pytest.approx(1)
    assert got[0]["languages"] == ["de"] and got[0]["shares"] == [1.0]
    assert got[10]["languages"] == [] == got[10]["shares"]
