"""Headline queries on one machine; prints one JSON line.

Each query runs once to warm up and then up to three times; the median counts. Results go to the
noop sink, so every row and column is computed. ``workloads`` repeats the published
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from lakeworks.queries import QUERIES
from lakeworks.queries.registry import Tables
from lakeworks.session import build_session, scratch_path

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
LONG = 8.0  # seconds; a longer query is repeated once

HEADLINE = [
    "daily_revenue",
    "join_inner_using",
    "monthly_revenue",
    "return_rate",
    "rfm_features",
    "clv_top100",
    "stg_orders",
    "stg_order_items",
    "fct_orders",
    "fct_orders_chain",
    "dim_customers",
    "dedup_latest",
    "funnel_2step",
    "retention_curve",
    "engagement_score",
    "multi_day_trend",
    "market_overview",
    "white_space",
    "radius_join",
    "ntile_zones",
    "geo_combined",
    "nearest_neighbor_route",
    "kmeans_assign",
    "rls_range",
    "secure_view",
    "parity_metric_stats",
    "parity_distribution",
    "result_compare",
    "table_profile",
    "group_expand",
    "lineage_levels",
    "slot_distribution",
    "error_breakdown",
    "metric_topn",
    "gold_available_inventory_by_center",
    "load_merge",
    "cdc_apply_batch",
    "cdc_apply_stream",
    "txn_generate",
    "wide_sparse_generate",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def measure(run) -> float:
    first = seconds(run)
    repeats = 1 if first > LONG else REPEATS
    return statistics.median(seconds(run) for _ in range(repeats))


def stream_throughput(spark) -> dict:
    """Generated transactions through a stream into Parquet: megabytes of row text per second."""
    from lakeworks.streaming import generator as G

    t = Tables(spark, FOLDER)
    source = scratch_path(spark, "bench-numbers")
    numbers = t.orders.select("o_orderkey", "o_orderdate")
    numbers.repartition(16).write.parquet(source)
    stream = spark.readStream.schema(numbers.schema).option("maxFilesPerTrigger", 8).parquet(source)
    sink = scratch_path(spark, "bench-sink")
    made = G.transactions(stream, "o_orderkey", "o_orderdate")
    took = seconds(lambda: G.append_stream(made, sink, scratch_path(spark, "bench-ck"), available_now=True).awaitTermination())
    back = spark.read.schema(made.schema).parquet(sink)
    rows, size = back.agg(F.count("*"), F.sum(F.octet_length("shipping_address"))).first()
    fs = spark._jvm.org.apache.hadoop.fs.Path(sink)
    written = fs.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs).getLength()
    return {
        "sec": round(took, 2),
        "rows": rows,
        "mb_per_sec": round(size / 1e6 / took, 1),
        "written_mb_per_sec": round(written / 1e6 / took, 1),
        "published_mb_per_sec": 83,
    }


def wide_export(spark) -> dict:
    """200,000 rows of 428 columns to a Parquet day partition."""
    from lakeworks.sources import tables as TB
    from lakeworks.streaming import generator as G

    start = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    numbers = spark.range(200_000).select("id", start.alias("at"))
    wide = G.wide_messages(numbers, "id", "at")
    took = measure(lambda: TB.export_days(wide, scratch_path(spark, "bench-wide"), "date", spread_by=["seq_no"]).collect())
    return {"sec": round(took, 2), "rows": 200_000, "published_sec": 22}


def small_geo(spark) -> dict:
    """The published stop counts: 20 stops greedy, 500 stops in layers, 10 clusters."""
    from lakeworks.operators import clusters, routing
    from lakeworks.queries import geo_q

    stops = geo_q.stops(Tables(spark, FOLDER))
    twenty = stops.orderBy("stop_id").limit(20).withColumn("zone_id", F.lit(1)).cache()
    some = stops.orderBy("stop_id").limit(500).cache()
    some.count(), twenty.count()
    return {
        "greedy_20_sec": round(measure(lambda: noop(routing.greedy_routes(twenty))), 2),
        "greedy_20_published_sec": 10,
        "layers_500_sec": round(measure(lambda: noop(routing.combined_layers(routing.Routes(routing.geohash_zones(some))))), 2),
        "layers_500_published_sec": 1,
        "kmeans_fit_all_sec": round(measure(lambda: clusters.fit(stops)), 2),
        "kmeans_fit_published_sec": 60,
    }


def main() -> None:
    spark = build_session(
        "lakeworks-bench",
        f"local[{CPUS}]",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lakeworks-bench-"), "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: round(measure(lambda n=name: noop(QUERIES[n](spark, FOLDER))), 3) for name in HEADLINE}
    workloads = {"stream_append": stream_throughput(spark), "wide_export": wide_export(spark), "geo": small_geo(spark)}
    sf = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "workloads": workloads,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
