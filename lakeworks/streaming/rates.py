"""How fast a running stream writes: rows, bytes and time of every micro-batch, taken while it is written."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files

SCHEMA = "batch long, rows long, bytes long, began double, ended double"


def recorded_append(path: str, size: Column) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that appends a batch to ``path``, and records what it measured beside it.

    Batch and record are named by the batch number, so a batch that is delivered again replaces itself and counts once.
    ``size`` is the bytes of a row. Rows and bytes are observed in the pass that writes them.
    """

    def feed(rows: DataFrame, batch: int) -> None:
        measured = Observation()
        counted = rows.observe(measured, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
        began = time.time()
        counted.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows/batch={batch}")
        record = {"batch": batch, **measured.get, "began": began, "ended": time.time()}
        spark, name = rows.sparkSession, f"{path}/rates/{batch:012d}.json"
        files.delete(spark, name)
        files.write_text(spark, name, json.dumps(record) + "\n")

    return feed


def append_with_rates(rows: DataFrame, path: str, checkpoint: str, size: Column, available_now: bool = False, every: str = "1 second") -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(recorded_append(path, size)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def written(spark: SparkSession, path: str) -> DataFrame:
    """The rows of finished batches."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


def batch_rates(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, bytes, began, ended) of every batch recorded."""
    if not files.names(spark, f"{path}/rates", ""):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(f"{path}/rates")


def report(rates: DataFrame) -> DataFrame:
    """Rows, bytes, mean row size, the peak of a batch and the mean of the whole run in bytes per second."""
    took = F.greatest(F.col("ended") - F.col("began"), F.lit(1e-3))
    lasted = F.greatest(F.max("ended") - F.min("began"), F.lit(1e-3))
    return rates.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.try_divide(F.sum("bytes").cast("double"), F.sum("rows")).alias("avg_row_bytes"),
        F.max(F.col("bytes") / took).alias("peak_bytes_per_second"),
        (F.sum("bytes") / lasted).alias("avg_bytes_per_second"),
        lasted.alias("seconds"),
    )
