"""A spread of registered queries against their check SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lakeworks.queries import ORACLES, QUERIES
from lakeworks.queries.registry import TABLES

PICKED = [
    "daily_revenue", "fct_orders", "dim_customers", "stg_order_items", "funnel_timed", "retention_rate", "engagement_score",
    "weekday_pattern", "market_overview", "opening_hours", "uncovered_cells", "radius_benchmark", "ntile_zones", "geo_routes",
    "nearest_neighbor_route", "rls_range", "secure_view", "range_expand", "result_compare", "parity_decision", "group_expand",
    "lineage_merge", "lineage_levels", "error_breakdown", "slot_distribution", "metric_topn", "gold_aov_by_country", "load_merge",
    "load_merge_partitioned", "cdc_apply_stream", "txn_generate", "fn_geohash", "fn_array_agg_ordered", "parity_report", "distinct_rollup", "parity_distribution",
]


@pytest.fixture(scope="module")
def database(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_its_check(spark, sf, database, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = database.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected


def test_entry(spark, sf):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:2] == ["order_date", "country"] and not df.isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("package", ["tiktoken", "public_tokenizers", "sentencepiece", "lakeworks.llm", "corpus_pipeline"])
def test_entry_without_an_optional_package(package):
    code = f"import sys; sys.modules[{package!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parent.parent, check=True)
    number, has_operators = found.stdout.split()
    assert int(number) == len(QUERIES) and has_operators == "False"
