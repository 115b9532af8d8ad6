from itertools import permutations

import pytest
from pyspark.sql import types as T

from lakeworks.streaming import cdc

SCHEMA = f"id long, name string, {cdc.TYPE} string, {cdc.SEQUENCE} long"
EVENTS = [(1, "Alice", "UPSERT", 1), (1, "Alice", "DELETE", 2), (1, "Alice Restored", "UPSERT", 3), (2, "Bob", "UPSERT", 4)]
EXPECTED = {(1, "Alice Restored"), (2, "Bob")}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_batch_in_any_order(spark):
    for order in permutations(EVENTS):
        assert rows(cdc.apply_batch(spark.createDataFrame(list(order), SCHEMA), ["id"])) == EXPECTED


def test_delete_wins_a_tie(spark):
    tied = [(1, "a", "UPSERT", 5), (1, "a", "DELETE", 5)]
    for order in (tied, tied[::-1]):
        assert rows(cdc.apply_batch(spark.createDataFrame(order, SCHEMA), ["id"])) == set()


@pytest.mark.parametrize("split", [[[3], [1], [0], [2]], [[2, 3], [0, 1]], [[1], [0], [2, 3]], [[0, 1, 2, 3]]])
def test_any_split_and_repetition(spark, folder, split):
    table = cdc.ChangeTable(spark, folder, ["id"])
    for number, part in enumerate(split):
        batch = spark.createDataFrame([EVENTS[i] for i in part], SCHEMA)
        table.apply(batch, number)
        table.apply(batch, number)  # delivered again
        if number == 1:
            table.compact()
    assert rows(table.snapshot()) == EXPECTED
    table.compact()
    assert rows(table.snapshot()) == EXPECTED


def test_a_late_upsert_does_not_revive_a_deleted_key(spark, folder):
    table = cdc.ChangeTable(spark, folder, ["id"])
    table.apply(spark.createDataFrame([(1, "a", "DELETE", 10)], SCHEMA), 0)
    table.compact()
    table.apply(spark.createDataFrame([(1, "late", "UPSERT", 9)], SCHEMA), 1)
    assert rows(table.snapshot()) == set()
    table.compact()
    table.compact()
    assert table.state().count() == 1


def test_linear_hashing_moves_one_bucket_at_a_time(spark):
    placed = spark.range(2000).select("id", *[cdc.bucket_of(["id"], n).alias(f"b{n}") for n in range(1, 20)]).collect()
    for n in range(1, 19):
        moved = [r for r in placed if r[f"b{n}"] != r[f"b{n + 1}"]]
        assert moved and {r[f"b{n + 1}"] for r in moved} == {n}
        assert {r[f"b{n}"] for r in moved} == cdc.split_by(n, n + 1)
        assert {r[f"b{n}"] for r in placed if r[f"b{n}"] != r["b19"]} == cdc.split_by(n, 19)
        assert {r[f"b{n}"] for r in placed} == set(range(n))


def test_folds_open_only_buckets_with_changes(spark, folder):
    table = cdc.ChangeTable(spark, folder, ["id"], bucket_rows=8)
    table.apply(spark.createDataFrame([(i, "a", "UPSERT", 1) for i in range(60)] + [(None, "none", "UPSERT", 1)], SCHEMA), 0)
    assert table.compact() == []
    _, before = table._listed()
    assert before["buckets"] == 8 and len(before["files"]) == 8 and sum(table.bucket_sizes().values()) == 61
    table.apply(spark.createDataFrame([(5, "b", "UPSERT", 2), (None, "late", "UPSERT", 0)], SCHEMA), 1)
    expected = {(i, "b" if i == 5 else "a") for i in range(60)} | {(None, "none")}
    assert rows(table.snapshot()) == expected
    opened = table.compact()
    _, after = table._listed()
    changed = {k for k in before["files"] if after["files"][k] != before["files"][k]}
    assert after["buckets"] == 8 and 1 <= len(changed) <= 2 and opened == [f for k in sorted(changed, key=int) for f in before["files"][k]]
    assert rows(table.snapshot()) == expected
    table.prune()
    assert rows(table.snapshot()) == expected and table._listed()[1] == after
    assert table._lists.numbers() == [2]


def test_buckets_stay_bounded_while_the_table_grows(spark, folder):
    table = cdc.ChangeTable(spark, folder, ["id"], bucket_rows=50)
    expected = {}
    for fold in range(10):
        changes = [(i, f"v{fold}", "DELETE" if i % 7 == fold else "UPSERT", fold * 10) for i in range(fold * 40, fold * 100 + 60)]
        table.apply(spark.createDataFrame(changes, SCHEMA), fold)
        for i, name, kind, _ in changes:
            expected[i] = None if kind == "DELETE" else name
        table.compact()
        sizes = table.bucket_sizes()
        # Buckets not yet split in a round are twice as large as the others, and keys scatter by chance.
        assert max(sizes.values()) <= 2 * 50 + 40 and sum(sizes.values()) == len(expected)
    assert table._listed()[1]["buckets"] >= 18
    assert rows(table.snapshot()) == {(i, n) for i, n in expected.items() if n is not None}
    table.apply(spark.createDataFrame([(0, "old", "UPSERT", -1), (5000, "new", "UPSERT", 1)], SCHEMA), 10)
    wanted = spark.createDataFrame([(0,), (1,), (5000,), (999_999,), (None,)], "id long")
    assert rows(table.lookup(wanted)) == {(i, expected[i]) for i in (0, 1) if expected[i]} | {(5000, "new")}
    opened = table.lookup(wanted).inputFiles()
    assert len([f for f in opened if "/base/" in f]) <= 5


def test_a_fold_that_stops_half_way_changes_nothing(spark, folder, monkeypatch):
    table = cdc.ChangeTable(spark, folder, ["id"], bucket_rows=2)
    for number, part in enumerate((EVENTS[:2], EVENTS[2:])):
        table.apply(spark.createDataFrame(part, SCHEMA), number)
    with monkeypatch.context() as m:
        m.setattr(cdc.Snapshots, "commit", lambda *_: False)
        with pytest.raises(RuntimeError):
            table.compact()
    assert rows(table.snapshot()) == EXPECTED and table._listed()[0] == 0
    table.compact()
    table.prune()
    assert rows(table.snapshot()) == EXPECTED


def test_stream(spark, folder):
    source = f"{folder}/source"
    spark.createDataFrame(EVENTS, SCHEMA).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    table = cdc.ChangeTable(spark, f"{folder}/table", ["id"])
    for _ in range(2):  # the second run finds nothing new
        table.start(stream, f"{folder}/checkpoint", available_now=True, compact_every=2).awaitTermination()
        assert rows(table.snapshot()) == EXPECTED
    assert table._listed()[0] > 0
    table.compact()
    table.prune()
    assert rows(table.snapshot()) == EXPECTED


def test_unknown_fields_are_dropped(spark):
    changes = spark.createDataFrame([(1, "x", 9, "UPSERT", 1)], f"id int, other string, extra int, {cdc.TYPE} string, {cdc.SEQUENCE} long")
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    known, extra = cdc.known_fields(changes, target)
    assert extra == ["other", "extra"] and known.schema["id"].dataType == T.LongType()
    assert rows(cdc.apply_batch(known, ["id"])) == {(1, None)}


def test_empty_table_has_no_snapshot(spark, folder):
    with pytest.raises(FileNotFoundError):
        cdc.ChangeTable(spark, folder, ["id"]).snapshot()
