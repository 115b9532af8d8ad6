import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeworks.llm import periodic, queries

from .fixtures import SCHEMA, awkward, awkward_rows, texts_of


def brute_runs(words, least=12):
    """Every stretch with a period, by comparing all words at all distances."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, length, q) for (a, length), q in found.items())


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else zlib.crc32(b"")
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {i for a, length, q in runs for i in range(a + q, a + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        listing = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        row = (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        out.append((*row, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_whole_table_by_brute_force(spark, sf):
    rows = [r for r in texts_of(sf, columns="doc_id, text") if len((r[1] or "").split()) < 1500]
    long = {r[0] for r in texts_of(sf, columns="doc_id, text")} - {r[0] for r in rows}
    got = [tuple(r) for r in queries.QUERIES["op11_periodic"](spark, sf).collect()]
    want = expected(rows)
    assert sorted((r for r in got if r[0] not in long), key=str) == want
    assert len(got) == len(want) + len(long) and sum(r[1] > 0 for r in want) >= 10


def test_awkward_rows(spark):
    rows = [r for r in awkward_rows() if len((r[1] or "")) < 10_000]
    got = periodic.digests(periodic.find_runs(awkward(spark, rows), alter=queries.repeated_tail))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected([r[:2] for r in rows])


def test_empty_table(spark):
    assert periodic.digests(periodic.find_runs(spark.createDataFrame([], SCHEMA))).collect() == []


def test_runs_and_collapsed_text_of_a_long_document(spark):
    head = [f"w{i}" for i in range(50_000)]
    text = " ".join(head + ["x", "y", "z"] * 7000 + head[:10])
    row = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["runs"] == [(50_000, 21_000, 3)] and row["n_words"] == 71_010
    assert row["collapsed"] == " ".join(head + ["x", "y", "z"] + head[:10])


def units():
    """Passages made of a few units, each repeated, so that runs nest, touch and come again."""
    unit = st.lists(st.integers(0, 2), min_size=1, max_size=9)
    parts = st.lists(st.tuples(unit, st.integers(1, 12)), max_size=8)
    return parts.map(lambda p: [w for u, n in p for w in u * n])


@settings(max_examples=400, deadline=None)
@given(units(), st.integers(1, 3))
def test_any_words_by_brute_force(words, times):
    words = words * times
    assert periodic.runs_of(words) == brute_runs(words)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words_read_in_parts(letters):
    rng = random.Random(letters)
    for _ in range(60):
        words = [rng.randrange(letters) for _ in range(rng.randrange(300))]
        words += words[: rng.randrange(100)] * rng.randrange(4)
        catchers, at = periodic.Catchers(), 0
        while at < len(words):
            step = rng.randrange(1, 40)
            catchers.extend(words[at : at + step])
            at += step
            if rng.random() < 0.1:
                assert catchers.runs() == brute_runs(words[:at])
        assert catchers.runs() == brute_runs(words)


def test_large_clusters_take_no_quadratic_time():
    """Two long stretches of one word: nearly every distance is caught, and none may be compared word by word."""
    words = [0] * 20_000 + [1] + [0] * 20_000
    assert periodic.runs_of(words) == [(0, 20_000, 1), (20_001, 20_000, 1)]
    assert periodic.runs_of(words * 2)[-1] == (60_002, 20_000, 1)
