"""Load watermarks: one numbered snapshot of all tables' watermarks after the other, the newest counts."""

from __future__ import annotations

import logging
import random
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Snapshots

logger = logging.getLogger(__name__)
KEY = ["source_name", "db_name", "tbl_name"]
SCHEMA = (
    "source_name string, db_name string, tbl_name string, watermark_value string, "
    "value_type string, updated_at timestamp"
)
KEPT = 10  # snapshots
ATTEMPTS = 50
WAIT = 0.01  # seconds more after each lost attempt, at most
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class _Any:
    """Whatever the watermark was."""


ANY = _Any()


def _rows(document: dict | None) -> list[list]:
    return (document or {"rows": []})["rows"]


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """Latest watermark per table, None before the first load."""
    number, document = Snapshots(spark, path).newest()
    if not number:
        return None
    rows = [(*r[:-1], datetime.fromisoformat(r[-1])) for r in _rows(document)]
    return spark.createDataFrame(rows, SCHEMA)


def read_watermark(spark: SparkSession, path: str, source: str, db: str, table: str) -> str | None:
    _, document = Snapshots(spark, path).newest()
    return next((r[3] for r in _rows(document) if r[:3] == [source, db, table]), None)


def batch_watermark(batch: DataFrame, column: str) -> str | None:
    """Greatest value of the batch as text, by the column's own order."""
    return batch.agg(F.max(column).cast("string").alias("w")).first()["w"]


def update_watermark(
    spark: SparkSession, path: str, source: str, db: str, table: str, value: str | None, value_type: str, previous: str | None | _Any = ANY
) -> bool:
    """Record a watermark. No value is skipped; a failure is logged and never fails the load,
    because the next run then reads some rows again, which a merge absorbs.

    With ``previous``, the watermark a run began from, only the first of several runs that began there is
    recorded. Runs of other tables at the same time do not disturb each other.
    """
    if value is None:
        logger.warning("no watermark in the batch of %s.%s, keeping the old one", db, table)
        return False
    try:
        snapshots = Snapshots(spark, path)
        for attempt in range(ATTEMPTS):
            time.sleep(random.uniform(0, WAIT * attempt))
            number, document = snapshots.newest()
            rows = _rows(document)
            now = next((r[3] for r in rows if r[:3] == [source, db, table]), None)
            if previous is not ANY and now != previous:
                logger.warning("the watermark of %s.%s moved from %s to %s meanwhile, not recording %s", db, table, previous, now, value)
                return False
            row = [source, db, table, value, value_type, datetime.now(UTC).isoformat()]
            if snapshots.commit(number + 1, {"rows": [r for r in rows if r[:3] != row[:3]] + [row]}):
                snapshots.prune(KEPT)
                return True
        logger.error("other runs keep recording, the watermark of %s.%s is not", db, table)
    except Exception:
        logger.exception("could not record the watermark of %s.%s", db, table)
    return False
