import hashlib
from collections import defaultdict

import pytest

from lakeworks.llm import exact_dedup as X

from .fixtures import SCHEMA, awkward, awkward_rows


def lowered(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(lowered(r[1])).hexdigest()].append(r[0])
    out = []
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and stays, digest))
            stays = stays and i != keep
    return sorted(out, key=str)


@pytest.mark.parametrize("digit_bits", [1, 2, 4])
def test_awkward_rows_as_brute_force(spark, digit_bits):
    got = X.exact_duplicates(awkward(spark), digit_bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(awkward_rows())


def test_binomial_rounds_over_many_nodes(spark):
    found = X.digests(spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 700 AS string) END AS text"))
    got = X.groups(found, digit_bits=1, nodes=32).collect()
    assert len(got) == 701
    assert max(r["group_size"] for r in got) == 1000 and {r["keep_id"] for r in got if r["group_size"] == 1000} == {2997}
    assert sum(r["group_size"] for r in got) == 3000


def test_stage_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = awkward(spark)
    got = X.without_duplicates(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    expected = {(r[4], r[0]) for r in brute(awkward_rows()) if r[3]}
    assert sorted((hashlib.sha256(lowered(r["text"])).hexdigest(), str(r["doc_id"])) for r in rows) == sorted((d, str(i)) for d, i in expected)


def test_empty_table(spark):
    assert X.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert X.without_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
