import json
import threading
from datetime import date, datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeworks.plans import ingest
from lakeworks.sources import files, jdbc, state
from lakeworks.sources import registry as R
from lakeworks.sources import tables as TB
from lakeworks.sources.snapshots import Snapshots

CLUSTER = {
    "source_name": "my_cluster",
    "source_type": "postgres",
    "data_config": {
        "my-db": {
            "tables": {
                "products": {"etl_mode": "FULL_RELOAD"},
                "customers": {
                    "etl_mode": "INCREMENTAL",
                    "backfill_filters": [{"backfill_id": "updated_at"}],
                    "upsert_key": ["id"],
                    "partition_keys": [{"col_name": "created_at", "col_type": "timestamp"}],
                    "z_order_by": ["country", "status"],
                },
                "events": {"etl_mode": "INCREMENTAL", "backfill_filters": [{"backfill_id": "event_time"}]},
                "audit_log": {"backfill_filters": [{"backfill_id": "created_at"}]},
                "plain": None,
                '"ApprovalWorkflows"': {"tbl_name_alias": "approval_workflows", "etl_mode": "FULL_RELOAD"},
                "saas.tenant_lookups": {"backfill_filters": [{"backfill_id": "updated_at"}], "upsert_key": ["id"]},
                "large": {"is_paginated": True, "pagination_key": "id", "pagination_size": 20},
                "huge": {"is_paginated": True, "pagination_key": "id", "pagination_size": 1_000_000},
                "odd": {"etl_mode": "SOMETIMES"},
            }
        }
    },
}


def plan(name):
    return ingest.load_plan(CLUSTER, "my-db", name)


def test_plans():
    modes = {n: (plan(n).extraction, plan(n).write_mode) for n in ("products", "customers", "events", "audit_log", "plain")}
    assert modes == {
        "products": ("full", "overwrite"),
        "customers": ("incremental", "merge"),
        "events": ("incremental", "append"),
        "audit_log": ("incremental", "append"),
        "plain": ("full", "overwrite"),
    }
    c = plan("customers")
    assert (c.dataset, c.source_table, c.table) == ("raw_my_db", "public.customers", "customers")
    assert (c.watermark_column, c.partition_field, list(c.cluster_by), list(c.merge_keys)) == ("updated_at", "created_at", ["country", "status"], ["id"])
    a = plan("ApprovalWorkflows")
    assert (a.source_table, a.table) == ("public.ApprovalWorkflows", "approval_workflows") and plan('"ApprovalWorkflows"') == a
    d = plan("saas.tenant_lookups")
    assert (d.source_table, d.table) == ("saas.tenant_lookups", "saas_tenant_lookups")
    assert (plan("large").partition_column, plan("large").partitions) == ("id", 20) and plan("huge").partitions == 200


def test_plan_errors():
    with pytest.raises(KeyError, match="my-db"):
        ingest.load_plan(CLUSTER, "none", "products")
    with pytest.raises(KeyError, match="customers"):
        plan("none")
    with pytest.raises(ValueError, match="SOMETIMES"):
        plan("odd")
    with pytest.raises(KeyError, match="parquet"):
        R.get_extractor("mainframe")


def test_jdbc_options_carry_both_bounds(spark):
    options = jdbc.read_options("jdbc:x", "public.t", driver="d")
    assert options["dbtable"] == "(SELECT * FROM public.t) AS _subq" and options["fetchsize"] == "10000"
    split = jdbc.parallel_options(options, "id", 1000, 5, 99)
    assert (split["numPartitions"], split["lowerBound"], split["upperBound"]) == ("1000", "5", "99")
    newer = ("at", "2024-01-01 o'clock")
    where = "WHERE at > '2024-01-01 o''clock'"
    assert jdbc.read_options("jdbc:x", "t", newer_than=newer)["dbtable"] == f"(SELECT * FROM t {where}) AS _subq"
    asked = jdbc.bounds_options(options, "t", "id", newer)
    assert asked["dbtable"] == f"(SELECT MIN(id) AS low, MAX(id) AS high FROM t {where}) AS _b" and asked["driver"] == "d"
    assert jdbc.bounds_options(options, "t", "id")["dbtable"] == "(SELECT MIN(id) AS low, MAX(id) AS high FROM t) AS _b"
    assert jdbc.newer_clause(("n", 5)) == " WHERE n > 5" and jdbc.newer_clause(("n", None)) == ""
    assert jdbc.bounds(spark.range(3, 9), "id") == (3, 8) and jdbc.bounds(spark.range(0), "id") is None
    strides = spark.range(10, 111).withColumn("s", jdbc.stride_of(F.col("id"), 10, 110, 4)).groupBy("s").count()
    assert {r["s"]: r["count"] for r in strides.collect()} == {0: 25, 1: 25, 2: 25, 3: 26}


@pytest.mark.parametrize("keys", ["uniform", "skewed", "one", "few", "negative"])
def test_strides_hold_as_many_rows(keys):
    """The generated SQL, run by a library in this process."""
    n = 20_000
    table = {  # noqa: F841 (DuckDB reads the variable)
        "uniform": range(n), "skewed": [i**3 for i in range(n // 2)] + [5] * 50 + list(range(n // 2)), "one": [7] * n,
        "few": [i % 12 * 10**12 for i in range(n)], "negative": [-(i * i) for i in range(n)],
    }[keys]
    con = duckdb.connect()
    con.register("rows_of", pa.table({"k": pa.array([*table, None, None, None], pa.int64()), "seen": pa.array(range(len(table) + 3))}))
    asked = []

    def ask(sql):
        asked.append(sql)
        return con.execute(sql).fetchall()

    for newer_than in (None, ("seen", 999)):
        where = jdbc.newer_clause(newer_than)
        low, high = con.execute(f"SELECT MIN(k), MAX(k) FROM rows_of{where}").fetchone()
        starts = jdbc.uneven_bounds(jdbc.even_cells(ask, "rows_of", "k", low, high, 6, newer_than), 6)
        assert starts == sorted(set(starts)) and len(starts) <= 5
        sizes = [con.execute(f"SELECT COUNT(*) FROM (SELECT * FROM rows_of{where}) WHERE {p}").fetchone()[0] for p in jdbc.stride_predicates("k", starts)]
        assert sizes[-1] == 3 and sum(sizes) == con.execute(f"SELECT COUNT(*) FROM rows_of{where}").fetchone()[0]
        if keys != "one":
            own = sorted(sizes[:-1])
            assert len(own) == 6 and own[-1] <= 2 * own[3] and own[0] > 0
    assert len(asked) < 200


def test_watermark_is_typed_and_missing_column_raises(spark):
    df = spark.createDataFrame([(9,), (10,), (100,)], "n long")
    assert [r["n"] for r in jdbc.newer(df, "n", "10").collect()] == [100]  # as text, "9" would be above "10"
    assert jdbc.newer(df, "n", None).count() == 3
    with pytest.raises(ValueError):
        jdbc.newer(df, "missing", "1")


def test_watermark_state(spark, folder, monkeypatch):
    args = (spark, folder, "s", "d", "t")
    assert state.read_watermark(*args) is None
    assert state.update_watermark(*args, "2024-01-01", "date")
    assert state.update_watermark(*args, "2024-03-01", "date")
    assert not state.update_watermark(*args, None, "date")
    assert state.read_watermark(*args) == "2024-03-01" and state.read_watermark(spark, folder, "s", "d", "u") is None
    assert state.read_state(spark, folder).count() == 1
    monkeypatch.setattr(state.Snapshots, "commit", lambda *_: 1 / 0)
    assert not state.update_watermark(*args, "2024-04-01", "date")  # a failure is only logged


def test_of_two_runs_from_one_watermark_one_is_recorded(spark, folder):
    args = (spark, folder, "s", "d", "t")
    assert state.update_watermark(*args, "5", "int", previous=None)
    assert not state.update_watermark(*args, "4", "int", previous=None)  # began before the first load, too
    assert state.update_watermark(spark, folder, "s", "d", "u", "9", "int", previous=None)  # another table
    assert state.update_watermark(*args, "7", "int", previous="5") and not state.update_watermark(*args, "6", "int", previous="5")
    assert {r["tbl_name"]: r["watermark_value"] for r in state.read_state(spark, folder).collect()} == {"t": "7", "u": "9"}


def test_writers_at_the_same_time(spark, folder):
    """Every thread records a table of its own, and all try for one; the state keeps a few files over 100 runs."""
    won = []

    def runs(me):
        for i in range(12):
            assert state.update_watermark(spark, folder, "s", "d", f"own {me}", str(i), "int")
        won.append(state.update_watermark(spark, folder, "s", "d", "shared", str(me), "int", previous=None))

    threads = [threading.Thread(target=runs, args=(me,)) for me in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = {r["tbl_name"]: r["watermark_value"] for r in state.read_state(spark, folder).collect()}
    assert {k: v for k, v in found.items() if k != "shared"} == {f"own {me}": "11" for me in range(8)}
    assert sum(won) == 1
    numbers = Snapshots(spark, folder).numbers()
    assert numbers[-1] == 8 * 12 + 1 and len(files.names(spark, folder, "")) <= 2 * state.KEPT + 8


def test_a_number_is_taken_once(spark, folder):
    one, two = Snapshots(spark, folder), Snapshots(spark, folder)
    assert one.newest() == (0, None) and one.commit(1, {"a": 1}) and not two.commit(1, {"a": 2})
    assert two.newest() == (1, {"a": 1}) and two.commit(2, {"ü": "\n"}) and one.newest() == (2, {"ü": "\n"})
    assert one.prune(1) == [2] and one.numbers() == [2]


def as_dict(table):
    return {r["id"]: r["v"] for r in table.read().collect()}


@pytest.mark.parametrize("partition_by", [None, "p"])
def test_merge(spark, folder, partition_by):
    table = TB.ParquetTable(spark, folder, partition_by, ["id"])
    schema = "id long, v string, p int"
    table.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2), (None, "n", 3)], schema), ["id"])
    # 3 moves to another partition and leaves its own empty; 4 is new; a missing key never matches.
    table.merge(spark.createDataFrame([(2, "B", 1), (3, "C", 5), (4, "d", 2 if partition_by is None else 4), (None, "m", 3)], schema), ["id"])
    rows = sorted(((r["id"] or 0, r["v"]) for r in table.read().collect()))
    assert rows == [(0, "m"), (0, "n"), (1, "a"), (2, "B"), (3, "C"), (4, "d")]
    assert table.read().columns == ["id", "v", "p"]
    with pytest.raises(TB.DuplicateKeys):
        table.merge(spark.createDataFrame([(9, "x", 1), (9, "y", 1)], schema), ["id"])
    assert len(table.read().collect()) == 6


def contents(spark, table, names):
    """Digest of each file's bytes."""
    paths = [f"{table.root}/{n}" for n in names]
    rows = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha")).collect() if paths else []
    return {r["path"]: r["sha"] for r in rows}


@pytest.mark.parametrize("partition_by", [None, "p"])
def test_merge_rewrites_only_files_with_a_key(spark, folder, partition_by):
    table = TB.ParquetTable(spark, folder, partition_by, ["id"], rows_per_file=100)
    rows = spark.range(0, 4000, 1, 40).select("id", F.lit("a").alias("v"), F.floor(F.col("id") / 1000).cast("int").alias("p"))
    table.overwrite(rows if partition_by is None else rows.repartitionByRange(40, "id"))
    before, old = table.files(), table.read(1)
    assert len(before) >= 40
    first = contents(spark, table, before)
    changed = spark.createDataFrame([(i * 40, "B", 0) for i in range(9)] + [(9999, "new", 7)], "id long, v string, p int")
    table.merge(changed, ["id"])
    after = table.files()
    gone = set(before) - set(after)
    assert 1 <= len(gone) <= 10 and len(set(after) & set(before)) >= 30
    assert contents(spark, table, before) == first  # nothing that version 1 lists was touched
    assert old.count() == 4000 and old.filter("v = 'a'").count() == 4000
    got = as_dict(table)
    assert len(got) == 4001 and {i for i, v in got.items() if v != "a"} == {*range(0, 360, 40), 9999}
    table.prune(1)
    left = {f.removeprefix("data/").split("/")[0] for f in table.files()}
    assert set(files.names(spark, f"{folder}/data", "_load=")) == left and as_dict(table) == got


def test_a_merge_that_stops_half_way_changes_nothing(spark, folder, monkeypatch):
    table = TB.ParquetTable(spark, folder, "p")
    table.overwrite(spark.range(40).select("id", F.lit("a").alias("v"), (F.col("id") % 4).cast("int").alias("p")))
    batch = spark.createDataFrame([(1, "B", 1), (50, "n", 2)], "id long, v string, p int")
    with monkeypatch.context() as m:
        m.setattr(TB.Snapshots, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(batch, ["id"])
    assert set(as_dict(table).values()) == {"a"} and table.read().count() == 40
    table.merge(batch, ["id"])
    assert as_dict(table)[1] == "B" and table.read().count() == 41


def test_a_merge_does_not_undo_what_was_committed_meanwhile(spark, folder, monkeypatch):
    table, other = TB.ParquetTable(spark, folder), TB.ParquetTable(spark, folder)
    schema = "id long, v string"
    table.overwrite(spark.createDataFrame([(1, "a")], schema))
    write = TB.ParquetTable._write

    def write_late(self, df, load):
        found = write(self, df, load)
        if self is table:
            other.append(spark.createDataFrame([(2, "b")], schema))
        return found

    monkeypatch.setattr(TB.ParquetTable, "_write", write_late)
    with pytest.raises(TB.TableChanged):
        table.merge(spark.createDataFrame([(1, "A")], schema), ["id"])
    assert as_dict(other) == {1: "a", 2: "b"}
    table.append(spark.createDataFrame([(3, "c")], schema))  # appends do not depend on what they are added to
    assert sorted(as_dict(other).items()) == [(1, "a"), (2, "b"), (3, "c")]


def test_partition_values_keep_their_type(spark, folder):
    table = TB.ParquetTable(spark, folder, "code")
    rows = [(1, "007", 1.5), (2, "a/b =%", 2.5), (3, None, 3.5)]
    table.overwrite(spark.createDataFrame(rows, "id long, code string, w double"))
    table.merge(spark.createDataFrame([(2, "a/b =%", 9.0)], "id long, code string, w double"), ["id"])
    assert sorted(map(tuple, table.read().collect())) == [(1, "007", 1.5), (2, "a/b =%", 9.0), (3, None, 3.5)]


@pytest.mark.parametrize("partition_by", [None, "p"])
def test_merge_keeps_columns_that_are_not_sent(spark, folder, partition_by):
    table = TB.ParquetTable(spark, folder, partition_by)
    table.merge(spark.createDataFrame([(1, "a", 1.5, 1), (2, "b", 2.5, 2)], "id long, v string, w double, p int"), ["id"])
    table.merge(spark.createDataFrame([(1, "A", 1), (3, "c", 2)], "id int, v string, p int"), ["id"])
    assert sorted(map(tuple, table.read().select("id", "v", "w", "p").collect())) == [(1, "A", 1.5, 1), (2, "b", 2.5, 2), (3, "c", None, 2)]
    table.merge(spark.createDataFrame([(2, "B")], "id long, v string"), ["id"])
    assert sorted(map(tuple, table.read().select("id", "v", "w", "p").collect())) == [(1, "A", 1.5, 1), (2, "B", 2.5, 2), (3, "c", None, 2)]
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(2, "x")], "id long, unheard string"), ["id"])


def test_a_repeated_append_replaces_itself(spark, folder):
    table = TB.ParquetTable(spark, folder, rows_per_file=10)
    for load in ("one", "two", "one"):
        table.append(spark.range(25 if load == "one" else 5), load_id=load)
    assert table.read().count() == 30
    table.append(spark.range(3))
    assert table.read().count() == 33 and len({f.split("/")[1] for f in table.files()}) == 3
    with pytest.raises(ValueError):
        table.append(spark.range(3).withColumn("unheard", F.lit(1)))
    table.overwrite(table.read())
    assert table.read().count() == 33 and len({f.split("/")[1] for f in table.files()}) == 1


def test_merge_of_keys_only_inserts(spark, folder):
    table = TB.ParquetTable(spark, folder)
    table.merge(spark.createDataFrame([(1,), (2,)], "id long"), ["id"])
    table.merge(spark.createDataFrame([(2,), (3,)], "id long"), ["id"])
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2, 3]


def test_timestamps_partition_by_day(spark, folder):
    table = TB.ParquetTable(spark, folder, "at")
    rows = [(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 1, 1, 9)), (3, datetime(2024, 1, 2))]
    table.overwrite(spark.createDataFrame(rows, "id long, at timestamp"))
    assert any("/at_day=2024-01-01/" in f for f in table.files()) and table.read().columns == ["id", "at"]
    table.merge(spark.createDataFrame([(1, datetime(2024, 1, 2, 1))], "id long, at timestamp"), ["id"])
    assert sorted((r["id"], r["at"].day) for r in table.read().collect()) == [(1, 2), (2, 1), (3, 2)]


def test_overwrite_keeps_the_old_version_until_done(spark, folder):
    table = TB.ParquetTable(spark, folder)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.overwrite(spark.range(5))
    old = table.read()
    table.overwrite(old.filter("id > 2"))  # reads the version it replaces
    assert table.versions() == [1, 2] and old.count() == 5 and table.read().count() == 2
    table.overwrite(spark.range(1))
    table.prune(1)
    assert table.versions() == [3]


def test_large_days_get_several_files(spark, folder):
    days = spark.range(1000).select("id", F.when(F.col("id") < 900, date(2024, 1, 1)).otherwise(date(2024, 1, 2)).alias("day"))
    counts = TB.export_days(days, folder, "day", rows_per_file=300)
    assert {r["day"]: r["rows"] for r in counts.collect()} == {date(2024, 1, 1): 900, date(2024, 1, 2): 100}
    per_day = spark.read.parquet(folder).select("day", "_metadata.file_path").distinct().groupBy("day").count()
    found = {r["day"]: r["count"] for r in per_day.collect()}
    assert found[date(2024, 1, 2)] == 1 and found[date(2024, 1, 1)] >= 3
    with pytest.raises(FileNotFoundError):
        TB.load_days(spark, [folder, f"{folder}/none"], f"{folder}/t", "day", ["id"])
    assert TB.day_shards(spark, folder, "day", "2024-01-02", "2024-01-09").count() == 100


def test_copies_of_one_row_spread_over_files(spark, folder):
    same = spark.range(0, 4000, 1, 8).select(F.lit("x").alias("v"), F.lit(1).alias("day"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join these few rows again
    try:
        TB.by_partition(same, "day", 1000).write.partitionBy("day").parquet(folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 2 and max(sizes) < 4000


def test_runs_load_only_new_rows(spark, folder):
    cluster = {
        "source_name": "s",
        "source_type": "parquet",
        "data_config": {
            "d": {
                "tables": {
                    "users": {"backfill_filters": [{"backfill_id": "at"}], "upsert_key": ["id"]},
                    "log": {"backfill_filters": [{"backfill_id": "at"}]},
                    "ref": {},
                }
            }
        },
    }
    schema = "id long, v string, at long"
    first, second = [(1, "a", 1), (2, "b", 2)], [(1, "a", 1), (2, "B", 3), (3, "c", 4)]
    for step, rows in (("one", first), ("two", second), ("two", second)):
        for name in ("users", "log", "ref"):
            source = f"{folder}/{step}/{name}.parquet"
            if not files.exists(spark, source):
                spark.createDataFrame(rows, schema).write.parquet(source)
            plan = ingest.load_plan(cluster, "d", name)
            table = ingest.run_table(spark, plan, f"{folder}/{step}", f"{folder}/warehouse")
            if step == "two":
                found = sorted(tuple(r) for r in table.read().collect())
                if name == "log":
                    assert found == [(1, "a", 1), (2, "B", 3), (2, "b", 2), (3, "c", 4)]
                else:
                    assert found == second
    assert state.read_watermark(spark, f"{folder}/warehouse/raw_d/_watermarks", "s", "d", "users") == "4"
    config = f"{folder}/config"
    spark.createDataFrame([(json.dumps(cluster),)], "value string").write.text(config)
    argv = ["--config", config, "--db_name", "d", "--tbl_name", "ref", "--location", f"{folder}/one", "--warehouse", f"{folder}/w2", "--run_id", ""]
    assert ingest.main(argv, spark) == 2 and ingest.given("") is None


def test_closed_sample_and_alignment(spark):
    facts = spark.range(3000).select("id", (F.col("id") % 50).alias("user"))
    users = spark.range(80).withColumnRenamed("id", "uid")
    chosen, (mine,) = TB.closed_sample(facts, 0.005, ["id"], [(users, "user", "uid")])
    used = {r["user"] for r in chosen.collect()}
    assert 0 < len(used) < 50 and {r["uid"] for r in mine.collect()} == used
    target = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])
    df = spark.createDataFrame([("", 1), ("x", 2)], "a string, b int")
    aligned = TB.align_schema(df, target)
    assert aligned.schema == target and [tuple(r) for r in aligned.collect()] == [(1, None), (2, "x")]
    with pytest.raises(ValueError):
        TB.align_schema(df.drop("a"), target)
    view = TB.authorized_view(df, "shared", ["b"])
    assert spark.table("shared").columns == view.columns == ["b"]
