"""Source types and the functions that read them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jdbc

Extractor = Callable[..., DataFrame]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(*names: str):
    def add(fn: Extractor) -> Extractor:
        for name in names:
            EXTRACTORS[name] = fn
        return fn

    return add


def get_extractor(source_type: str) -> Extractor:
    try:
        return EXTRACTORS[source_type]
    except KeyError:
        raise KeyError(f"no extractor for source type {source_type!r}; known: {sorted(EXTRACTORS)}") from None


@extractor("jdbc", "postgres")
def _jdbc(spark: SparkSession, location: str, table: str, **options) -> DataFrame:
    return jdbc.extract(spark, location, table, **options)


def _plain(reader: Callable[[SparkSession, str, str], DataFrame]) -> Extractor:
    def read(
        spark: SparkSession,
        location: str,
        table: str,
        newer_than: tuple[str, object] | None = None,
        partition_column: str | None = None,
        partitions: int = 1,
    ) -> DataFrame:
        # Files are split by Spark itself; the partition column only matters over JDBC.
        df = reader(spark, location, table)
        return df if newer_than is None else jdbc.newer(df, *newer_than)

    return read


EXTRACTORS["parquet"] = _plain(lambda spark, at, table: spark.read.parquet(f"{at}/{table}.parquet"))
EXTRACTORS["orc"] = _plain(lambda spark, at, table: spark.read.orc(f"{at}/{table}.orc"))
EXTRACTORS["csv"] = _plain(lambda spark, at, table: spark.read.csv(f"{at}/{table}.csv", header=True, inferSchema=True))
EXTRACTORS["json"] = _plain(lambda spark, at, table: spark.read.json(f"{at}/{table}.json"))
EXTRACTORS["catalog"] = _plain(lambda spark, at, table: spark.table(f"{at}.{table}" if at else table))
