import time

import pytest
from pyspark.sql import functions as F

from lakeworks.streaming import generator as G
from lakeworks.streaming import rates as R


def test_rates_of_an_unbounded_stream_agree_with_the_sink(spark, folder):
    made = G.transactions(G.rate_stream(spark, 400, 2), "value", "timestamp")
    size = F.octet_length("transaction_id") + F.octet_length("shipping_address")
    query = R.append_with_rates(made, folder, f"{folder}-checkpoint", size)
    deadline = time.time() + 60
    while time.time() < deadline and R.batch_rates(spark, folder).filter("rows > 0").count() < 2:
        time.sleep(0.5)
    query.stop()
    query.awaitTermination(30)
    per_batch = {r["batch"]: (r["rows"], r["bytes"]) for r in R.batch_rates(spark, folder).collect()}
    sink = spark.read.parquet(f"{folder}/rows").groupBy("batch").agg(F.count("*").alias("n"), F.sum(size).alias("b")).collect()
    assert {r["batch"]: (r["n"], r["b"]) for r in sink} == {b: x for b, x in per_batch.items() if x[0]}
    row = R.report(R.batch_rates(spark, folder)).first()
    assert row["rows"] == R.written(spark, folder).count() > 0 and row["bytes"] == sum(b for _, b in per_batch.values())
    assert row["peak_bytes_per_second"] >= max(b for _, b in per_batch.values()) / row["seconds"]
    assert row["avg_bytes_per_second"] == pytest.approx(row["bytes"] / row["seconds"]) and row["avg_row_bytes"] == pytest.approx(row["bytes"] / row["rows"])


def test_a_batch_delivered_again_counts_once(spark, folder):
    feed = R.recorded_append(folder, F.octet_length("v"))
    for batch, n in ((0, 5), (1, 7), (1, 6), (2, 0)):
        feed(spark.range(n).select(F.lit("abc").alias("v")), batch)
    row = R.report(R.batch_rates(spark, folder)).first()
    assert (row["rows"], row["bytes"]) == (11, 33) and R.written(spark, folder).count() == 11
    none = R.report(R.batch_rates(spark, f"{folder}-none")).first()
    assert (none["rows"], none["bytes"], none["avg_row_bytes"]) == (0, 0, None)


def test_a_batch_of_few_files_is_spread_before_its_rows_grow(spark, sf):
    from lakeworks.queries import streaming_q
    from lakeworks.queries.registry import Tables

    plan = streaming_q.numbers_stream(Tables(spark, sf))._jdf.queryExecution().logical().toString()
    assert "RepartitionByExpression" in plan.splitlines()[0]
