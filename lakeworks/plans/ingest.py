"""Config-driven ingest: read a table, write it by its mode, record the watermark."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from ..sources import state
from ..sources.registry import get_extractor
from ..sources.tables import ParquetTable

logger = logging.getLogger(__name__)
FULL, INCREMENTAL = "FULL_RELOAD", "INCREMENTAL"
DEFAULT_PARTITIONS = 10
MOST_PARTITIONS = 200  # parallel reads of one table, unless the caller allows more


@dataclass(frozen=True)
class LoadPlan:
    """Everything one table load needs."""

    source_name: str
    source_type: str
    db_name: str
    tbl_name: str
    source_table: str
    dataset: str
    table: str
    extraction: str  # full or incremental
    write_mode: str  # overwrite, append or merge
    merge_keys: Sequence[str] = field(default_factory=list)
    watermark_column: str | None = None
    partition_field: str | None = None
    cluster_by: Sequence[str] = field(default_factory=list)
    partition_column: str | None = None
    partitions: int = DEFAULT_PARTITIONS


def load_plan(cluster: Mapping, db_name: str, tbl_name: str, most_partitions: int = MOST_PARTITIONS) -> LoadPlan:
    """Plan for one table of a cluster configuration (the parsed file as a mapping).

    ``most_partitions`` is what the source database stands at once; a configuration that asks for
    more is cut to it with a warning.
    """
    databases = cluster["data_config"]
    if db_name not in databases:
        raise KeyError(f"no database {db_name!r} in {cluster['source_name']}; known: {sorted(databases)}")
    tables = {name.strip("\"'"): config or {} for name, config in databases[db_name]["tables"].items()}
    name = tbl_name.strip("\"'")
    if name not in tables:
        raise KeyError(f"no table {name!r} in {db_name}; known: {sorted(tables)}")
    config = tables[name]

    filters = config.get("backfill_filters") or []
    mode = config.get("etl_mode") or (INCREMENTAL if filters else FULL)
    if mode not in (FULL, INCREMENTAL):
        raise ValueError(f"unknown etl_mode {mode!r} for {name}")
    keys = list(config.get("upsert_key") or [])
    write_mode = "overwrite" if mode == FULL else ("merge" if keys else "append")
    paginated = bool(config.get("is_paginated"))
    wanted = int(config.get("pagination_size") or DEFAULT_PARTITIONS)
    if wanted > most_partitions:
        logger.warning("%s asks for %d parallel reads, using %d", name, wanted, most_partitions)
    partition_keys = config.get("partition_keys") or []
    dotted = "." in name
    return LoadPlan(
        source_name=cluster["source_name"],
        source_type=cluster["source_type"],
        db_name=db_name,
        tbl_name=name,
        source_table=name if dotted else f"public.{name}",
        dataset="raw_" + db_name.replace("-", "_"),
        table=config.get("tbl_name_alias") or (name.replace(".", "_", 1) if dotted else name),
        extraction="incremental" if mode == INCREMENTAL else "full",
        write_mode=write_mode,
        merge_keys=keys,
        watermark_column=filters[0]["backfill_id"] if filters else None,
        partition_field=partition_keys[0]["col_name"] if partition_keys else None,
        cluster_by=list(config.get("z_order_by") or []),
        partition_column=config.get("pagination_key") if paginated else None,
        partitions=min(wanted, most_partitions) if paginated else DEFAULT_PARTITIONS,
    )


def target(spark: SparkSession, plan: LoadPlan, warehouse: str) -> ParquetTable:
    return ParquetTable(spark, f"{warehouse}/{plan.dataset}/{plan.table}", plan.partition_field, plan.cluster_by)


def extract(spark: SparkSession, plan: LoadPlan, location: str, state_path: str) -> DataFrame:
    """The rows to load: everything, or what lies above the last watermark."""
    options = {}
    if plan.extraction == "incremental":
        if not plan.watermark_column:
            raise ValueError("an incremental load needs a watermark column")
        last = state.read_watermark(spark, state_path, plan.source_name, plan.db_name, plan.tbl_name)
        options["newer_than"] = (plan.watermark_column, last)
    if plan.partition_column:
        options.update(partition_column=plan.partition_column, partitions=plan.partitions)
    table = plan.source_table if plan.source_type in ("jdbc", "postgres") else plan.tbl_name
    return get_extractor(plan.source_type)(spark, location, table, **options)


def run_table(spark: SparkSession, plan: LoadPlan, location: str, warehouse: str) -> ParquetTable:
    """Load one table.

    The watermark comes from exactly the rows that were loaded: from the files just written or,
    for a merge, from the batch, which is settled because a merge reads it several times. An
    append carries the old watermark as its load id, so a load that is run again after its
    watermark got lost replaces what it wrote.
    """
    state_path = f"{warehouse}/{plan.dataset}/_watermarks"
    last = state.read_watermark(spark, state_path, plan.source_name, plan.db_name, plan.tbl_name)
    batch = extract(spark, plan, location, state_path)
    table = target(spark, plan, warehouse)
    if plan.write_mode == "overwrite":
        loaded = spark.read.schema(batch.schema).parquet(table.overwrite(batch))
    elif plan.write_mode == "append":
        loaded = spark.read.schema(batch.schema).parquet(table.append(batch, load_id=f"after {last}"))
    else:
        loaded = settle(batch, "batch")
        table.merge(loaded, plan.merge_keys)
    if plan.watermark_column:
        value = state.batch_watermark(loaded, plan.watermark_column)
        kind = batch.schema[plan.watermark_column].dataType.simpleString()
        state.update_watermark(spark, state_path, plan.source_name, plan.db_name, plan.tbl_name, value, kind, previous=last)
    return table


def given(value: str | None) -> str | None:
    """Callers pass '' for a parameter they leave out."""
    return value or None


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Entry for spark-submit or a stored procedure wrapper. Returns the rows of the table."""
    parser = argparse.ArgumentParser(description="Load one table by its configuration")
    for name in ("config", "db_name", "tbl_name", "location", "warehouse"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--run_id", type=given, default=None)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lakeworks-ingest").getOrCreate()
    text = "\n".join(r["value"] for r in spark.read.text(args.config, wholetext=True).collect())
    plan = load_plan(json.loads(text), args.db_name, args.tbl_name)
    logger.info("loading %s.%s, run %s", plan.db_name, plan.tbl_name, args.run_id or "unnamed")
    table = run_table(spark, plan, args.location, args.warehouse)
    return table.read().agg(F.count("*")).first()[0]


if __name__ == "__main__":
    main()
