import random

import pytest
from pyspark.sql import functions as F

from lakeworks.operators import audit as A
from lakeworks.operators import graph as G

EDGES = [("t", "a"), ("t", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("x", "y")]
FOREIGN = {"c", "e", "f", "g", "h"}


def walk(start, limit=None, max_depth=0):
    """Plain breadth-first walk with a foreign counter; the smallest counter of a level wins."""
    level, frontier, seen = 0, {start: 0}, {}
    while frontier and (max_depth <= 0 or level < max_depth):
        seen.update({n: (level, c) for n, c in frontier.items()})
        ahead = {}
        for n, c in frontier.items():
            for a, b in EDGES:
                if a == n and b not in seen:
                    count = c + 1 if b in FOREIGN else c
                    if limit is None or max_depth > 0 or count <= limit:
                        ahead[b] = min(count, ahead.get(b, count))
        frontier, level = ahead, level + 1
    return seen


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "node string, upstream string")


@pytest.fixture(scope="module")
def projects(spark):
    nodes = {n for e in EDGES for n in e}
    return spark.createDataFrame([(n, "away" if n in FOREIGN else "home") for n in nodes], "node string, project string")


def test_levels_with_cycle_and_diamond(edges):
    got = {r["node"]: r["level"] for r in G.lineage_levels(edges, "t").collect()}
    assert got == {n: level for n, (level, _) in walk("t").items()}
    assert "x" not in got and got["c"] == 2
    assert {r["node"] for r in G.lineage_levels(edges, "t", max_depth=1).collect()} == {"t", "a", "b"}
    assert [r["node"] for r in G.lineage_levels(edges, "nowhere").collect()] == ["nowhere"]


def test_many_walks_equal_single_ones(spark):
    rng = random.Random(3)
    links = sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(260)})
    edges = spark.createDataFrame(links, "node long, upstream long")
    starts = list(range(70)) + [149, 999]  # more than one word of bits
    ahead = {}
    for a, b in links:
        ahead.setdefault(a, []).append(b)
    want = set()
    for s in starts:
        level, frontier, seen = 0, {s}, set()
        while frontier:
            want |= {(s, n, level) for n in frontier}
            seen |= frontier
            frontier, level = {b for n in frontier for b in ahead.get(n, [])} - seen, level + 1
    got = {tuple(r) for r in G.lineage_of_many(edges, starts).collect()}
    assert got == want
    assert {tuple(r) for r in G.lineage_of_many(edges, [0, 0, 1], max_depth=2).collect()} == {x for x in want if x[0] < 2 and x[2] <= 2}


def test_edges_are_read_once(spark, folder):
    spark.createDataFrame(EDGES, "node string, upstream string").write.parquet(f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    before = G.settle
    plans = []
    try:
        G.settle = lambda df, *name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or before(df, *name)
        G.lineage_levels(raw, "t").collect()
    finally:
        G.settle = before
    assert len(plans) > 5
    raw_ids = raw._jdf.queryExecution().analyzed().toString()
    named = raw_ids[raw_ids.index("[") + 1 : raw_ids.index("]")].split(",")[0]
    assert sum(named in p for p in plans) == 1


@pytest.mark.parametrize("limit, depth", [(0, 0), (1, 0), (2, 0), (9, 0), (0, 3), (1, 1)])
def test_foreign_limit(edges, projects, limit, depth):
    got = {r["node"]: (r["level"], r["levels_since_foreign"]) for r in G.limited_lineage(edges, projects, "t", "home", limit, depth).collect()}
    assert got == walk("t", limit, depth)


def test_summary_and_roots(edges, projects, spark):
    levels = G.lineage_levels(edges, "t")
    row = G.lineage_summary(levels, projects, edges, "home").first()
    assert tuple(row) == (9, 4, 5, 8, 10)
    nodes = spark.createDataFrame([("h", "source"), ("e", "seed"), ("a", "model"), ("y", "source")], "id string, type string")
    assert {(r["node"], r["type"]) for r in G.lineage_roots(levels, nodes).collect()} == {("h", "source"), ("e", "seed")}


def test_manifests_merge(spark):
    nodes = spark.createDataFrame(
        [
            (1, "m.orders", "orders", "model", "db", "core"),
            (1, "m.old", "old", "model", "db", "core"),
            (2, "m.old", "renamed", "model", "db", "core"),
            (2, "m.report", "report", "model", "db", "mart"),
            (2, "s.orders", "orders", "source", "db", "core"),
            (2, "s.raw", "raw", "source", "db", "land"),
        ],
        "manifest int, id string, name string, type string, database string, schema string",
    )
    edges = spark.createDataFrame(
        [(1, "m.old", "m.orders"), (2, "m.old", "s.raw"), (2, "m.report", "s.orders"), (2, "m.report", "m.old")],
        "manifest int, node string, upstream string",
    )
    kept, links = G.merge_manifests(nodes, edges)
    assert {(r["id"], r["name"]) for r in kept.collect()} == {
        ("m.orders", "orders"), ("m.old", "renamed"), ("m.report", "report"), ("s.raw", "raw"),
    }
    assert {tuple(r) for r in links.collect()} == {("m.old", "s.raw"), ("m.report", "m.orders"), ("m.report", "m.old")}


def test_group_closure_with_a_cycle(spark):
    rows = [("a", "b", True), ("b", "c", True), ("c", "a", True), ("a", "u1", False), ("c", "u2", False), ("d", "u1", False), ("d", "d", True)]
    got = G.group_closure(spark.createDataFrame(rows, "group_email string, member_email string, is_group boolean"))
    assert {tuple(r) for r in got.collect()} == {(g, u) for g in "abc" for u in ("u1", "u2")} | {("d", "u1")}


POLICIES = [
    ("cloudresourcemanager.googleapis.com/Folder", "//x/folders/9", [("r", ["user:a"])]),
    ("cloudresourcemanager.googleapis.com/Folder", "//x/none", [("r", ["user:a"])]),
    ("cloudresourcemanager.googleapis.com/Project", "//x/projects/p", [("r", ["group:g", "allUsers"])]),
    ("bigquery.googleapis.com/Dataset", "//x/projects/p/datasets/d", [("r", ["odd"]), ("s", [])]),
    ("bigquery.googleapis.com/Table", "//x/projects/q/datasets/d/tables/t", [("r", ["user:b"])]),
    ("storage.googleapis.com/Bucket", "//x/b", [("r", ["user:c"])]),
]


@pytest.fixture(scope="module")
def policies(spark):
    return spark.createDataFrame(POLICIES, "asset_type string, resource string, bindings array<struct<role string, members array<string>>>")


def test_policies_flatten(policies):
    rows = {(r["resource_type"], r["project_id"], r["dataset_id"], r["resource_id"], r["member_type"]) for r in A.iam_flatten(policies).collect()}
    assert rows == {
        ("FOLDER", "", "", "9", "user"),
        ("PROJECT", "p", "", None, "group"),
        ("PROJECT", "p", "", None, "specialGroup"),
        ("DATASET", "p", "d", None, "unknown"),
        ("TABLE", "q", "d", "t", "user"),
    }
    assert {r["resource_type"] for r in A.iam_flatten(policies, projects=["p"]).collect()} == {"FOLDER", "PROJECT", "DATASET"}
    assert {r["resource_type"] for r in A.iam_flatten(policies, ["VIEW"]).collect()} == {"TABLE"}
    assert A.iam_flatten(policies).columns == A.ENTRY


def test_a_group_large_on_both_sides_is_cut(spark):
    """5,000 members times 200 entries: no task may yield much more than the others."""
    entries = spark.range(201).select(
        *[F.lit("p").alias(c) for c in ("project_id", "dataset_id")], F.col("id").cast("string").alias("resource_id"), *[F.lit("x").alias(c) for c in ("resource_type", "role", "source")],
        F.when(F.col("id") == 200, "group:small").otherwise("group:big").alias("member"), F.lit("group").alias("member_type"), F.lit(None).cast("string").alias("inherited_from_group"),
    )
    entries = entries.unionByName(entries.limit(3))  # copies stay copies
    members = spark.range(5000).select(F.lit("big").alias("group_email"), F.format_string("u%d@x", "id").alias("member_email"))
    members = members.unionByName(spark.createDataFrame([("small", "s@x"), ("none", "n@x")], members.schema))
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        made = A.group_entries(entries, members, rows_per_task=2500)
        per_task = sorted(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 203 * 5000 + 1 and len(per_task) == 16
    assert per_task[-1] <= 3 * per_task[len(per_task) // 2]
    assert made.filter("inherited_from_group = 'big'").distinct().count() == 200 * 5000


def test_scan_and_group_expansion(spark, policies, folder):
    acl = spark.createDataFrame([("p", "d", None, "groupByEmail", "g"), ("z", "d", "OWNER", None, "e")], "project string, dataset string, role string, entity_type string, entity_id string")
    entries = A.scan_union(A.iam_flatten(policies), A.acl_flatten(acl))
    assert tuple(A.scan_stats(entries).first()) == (3, 5, 2, 7)
    assert {(r["role"], r["member"]) for r in A.acl_flatten(acl).collect()} == {("NONE", "group:g"), ("OWNER", "unknown:e")}
    members = spark.createDataFrame([("g", "u@x"), ("g", "s@p.iam.gserviceaccount.com"), ("other", "w")], "group_email string, member_email string")
    expanded = A.group_expand(entries, members)
    added = expanded.filter("inherited_from_group = 'g'")
    assert expanded.count() == entries.count() + 4
    assert {r["member"] for r in added.collect()} == {"user:u@x", "serviceAccount:s@p.iam.gserviceaccount.com"}
    for kind in ("json", "csv"):
        A.export(A.with_scan(expanded, org="1"), f"{folder}/{kind}", kind)
    back = spark.read.option("header", True).csv(f"{folder}/csv")
    assert back.count() == expanded.count() and back.select(F.first("scan_org")).first()[0] == "1"
    with pytest.raises(ValueError):
        A.export(entries, folder, "xml")
