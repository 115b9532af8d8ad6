import random

import numpy as np
import pytest
import xxhash

from lakeworks.llm import queries, simhash
from lakeworks.llm.components import components

from .fixtures import SCHEMA, awkward, awkward_rows, texts_of


def slow_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids_and_bits, most=4):
    """Label by smallest id, by flooding."""
    bits = sorted({b for _, b in ids_and_bits})
    all_bits = np.array(bits, dtype=np.uint64)
    seen, out = {}, {}
    for b in bits:
        if b in seen:
            continue
        seen[b], todo, group = b, [b], [b]
        while todo:
            x = np.uint64(todo.pop())
            for y in all_bits[np.bitwise_count(all_bits ^ x) <= most].tolist():
                if y not in seen:
                    seen[y] = b
                    todo.append(y)
                    group.append(y)
        members = set(group)
        first = min((i for i, c in ids_and_bits if c in members and i is not None), default=None)
        out |= dict.fromkeys(members, first)
    return out


def expected(rows):
    found = [(r[0], slow_fingerprint(r[1])) for r in rows]
    label = slow_components(found)
    return sorted(((i, f"{b:016x}", label[b]) for i, b in found), key=str)


def test_awkward_rows_as_brute_force(spark):
    got = simhash.near_duplicates(awkward(spark))
    assert sorted(map(tuple, got.collect()), key=str) == expected(awkward_rows())


def test_whole_table_as_brute_force(spark, sf):
    got = queries.QUERIES["op2_simhash"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == expected(texts_of(sf, columns="doc_id, text"))


@pytest.mark.parametrize("most, group_rows", [(1, 3), (4, 3), (4, 4096), (7, 4096)])
def test_dense_clusters_lose_no_component(spark, most, group_rows):
    rng = random.Random(most)
    bits = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(60):
            x = center
            for _ in range(rng.randrange(0, 7)):
                x ^= 1 << rng.randrange(64)
            bits.add(x)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    table = spark.createDataFrame([(b,) for b in signed], "bits long")
    labels = {r["node"]: r["component"] for r in components(simhash.links(table, most, group_rows)).collect()}
    got = {}
    for b, s in zip(bits, signed):
        got.setdefault(labels.get(s, s), set()).add(b)
    want = {}
    for b, first in slow_components([(i, b) for i, b in enumerate(sorted(bits))], most).items():
        want.setdefault(first, set()).add(b)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_group_of_many_near_copies_gives_a_forest(spark):
    rng = random.Random(1)
    near = {(1 << rng.randrange(64)) | (1 << rng.randrange(64)) for _ in range(1500)}
    table = spark.createDataFrame([(b - (1 << 64) if b >> 63 else b,) for b in near], "bits long")
    keys = 5 * (1 + 13) * len(near)
    assert simhash.links(table).count() < keys  # all links would be over a million


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("(id * 8) % 301 AS u", "((id + 1) * 8) % 301 AS v")
    got = components(links.unionByName(links).unionByName(spark.sql("SELECT 5000L AS u, 5000L AS v"))).collect()
    assert {r["component"] for r in got} == {0} and len(got) == 301


def test_stage_keeps_the_smallest_of_each_component(spark):
    rows = [r for r in awkward_rows() if r[0] is not None]
    docs = awkward(spark, rows)
    got = simhash.without_near_duplicates(docs)
    assert got.columns == docs.columns
    stays = {i for i, _, c in expected(rows) if i == c}
    assert {r["doc_id"] for r in got.collect()} == stays


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
