import zlib

import numpy as np
import pytest

from lakeworks.llm import quality_fm as X
from lakeworks.llm import queries

from .fixtures import SCHEMA, awkward, texts_of


def test_margin_as_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = X.Machine(0.3, rng.normal(size=X.SLOTS), rng.normal(size=(X.SLOTS, X.RANK)))
    texts = ["one two two three!", "", "a | b"]
    slots, values, starts = X.features(texts, [4, None, 5])
    got = m.margins(slots, values, starts)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(slots)])):
        s, x = slots[a:b], values[a:b].astype(float)
        want = m.bias + sum(m.w[i] * y for i, y in zip(s, x))
        want += sum(m.v[s[i]] @ m.v[s[j]] * x[i] * x[j] for i in range(len(s)) for j in range(i))
        assert got[k] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_learns_an_interaction():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (2000, 2))
    slots = np.where(bits, [[10, 20]], [[11, 21]]).ravel()
    labels = (bits[:, 0] ^ bits[:, 1]).astype(float)
    starts = np.arange(2000) * 2
    m = None
    for seed in range(3):  # two of three features alone tell nothing
        m = X.fit(slots, np.ones(4000, np.float32) * 3, starts, labels, np.ones(2000), seed)
        if np.mean((m.margins(slots, np.ones(4000) * 3, starts) > 0) == labels) > 0.95:
            break
    assert np.mean((m.margins(slots, np.ones(4000) * 3, starts) > 0) == labels) > 0.95


def test_held_out_rows(spark, sf):
    folder = sf.replace("0.001", "0.01")
    quality = dict(texts_of(folder, "labels", "doc_id, quality"))
    got = queries.QUERIES["op8_quality_fm"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], quality[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in quality]
    good, junk = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in junk]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_awkward_rows_and_few_labels(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(13, 40)] + [(13, 1), (14, None), (9999, 1)], "doc_id long, label int")
    machine = X.learn(docs, labels, per_class=5)
    got = X.score(docs, machine, "held_out").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] == "clash" for r in got)
    assert X.learn(docs, labels.limit(0)) is None
    assert {r["score"] for r in X.score(docs, None).collect()} == {0.5}
    assert X.score(spark.createDataFrame([], SCHEMA), machine).collect() == []


def test_copies_of_labelled_rows_enter_the_fit_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    labels = spark.createDataFrame([(r["doc_id"], r["doc_id"] % 2) for r in docs.collect()], "doc_id long, label long")
    once, often = X.learn(docs, labels), X.learn(docs.unionByName(docs.limit(20)).unionByName(docs.limit(20)), labels)
    assert once.bias == often.bias and np.array_equal(once.w, often.w) and np.array_equal(once.v, often.v)
