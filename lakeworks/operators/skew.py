"""Joins where one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
SALTS = "_salts"
BLOCK_PAIRS = 4_000_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Keys with more than a thousandth of all rows, from a table of rows per key, and ``_salts``.

    There cannot be more than a thousand of them, which is what makes them safe to broadcast. A key
    gets as many salts as it has thousandths, so no piece is larger than that, whatever the size.
    """
    total = counts.agg(F.sum(n)).scalar()
    salts = F.ceil(F.col(n) * HOT_SHARE / total).cast("int").alias(SALTS)
    return counts.filter(F.col(n) * HOT_SHARE > total).select(*keys, salts)


def blocked_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: Sequence[str], right_by: Sequence[str], rows: int = BLOCK_PAIRS
) -> DataFrame:
    """Inner join where a key may have very many rows on both sides.

    A key that yields more than ``rows`` result rows is cut on both sides, into blocks of about the square
    root of that, and each pair of blocks is joined by itself: no task yields more than a few times ``rows`` of
    one key. A row is repeated once per block of the other side. ``left_by`` and ``right_by`` tell rows apart.
    """
    side = max(1, int(rows**0.5))
    counts = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "_nl"), (right, "_nr"))]
    # One row per key that is cut; a sum of the two sides' rows for none of them.
    large = counts[0].join(counts[1], list(keys)).filter(F.col("_nl").cast("double") * F.col("_nr") > rows)
    cuts = large.select(*keys, *[F.ceil(F.col(n) / side).cast("int").alias(c) for n, c in (("_nl", "_cl"), ("_nr", "_cr"))])

    def blocks(df: DataFrame, own: str, by: Sequence[str], mine: str, others: str, across: str) -> DataFrame:
        marked = df.join(cuts, list(keys), "left")
        # The partition a row comes from tells copies of it apart, and is the same when a task runs again.
        salt = F.pmod(F.xxhash64(F.spark_partition_id(), *by), F.coalesce(F.col(mine), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(others), F.lit(1)) - 1))
        return marked.withColumn(own, salt).withColumn(across, every).drop("_cl", "_cr")

    cut_left = blocks(left, "_bl", left_by, "_cl", "_cr", "_br")
    cut_right = blocks(right, "_br", right_by, "_cr", "_cl", "_bl")
    return cut_left.join(cut_right, [*keys, "_bl", "_br"]).drop("_bl", "_br")


def spread_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Join rows of ``many`` to at most a few rows per key of ``one``.

    ``many`` is split over salts by a hash of ``spread_by`` (stable under retries), ``one`` is
    repeated per salt, so no task receives more than a share of a frequent key. With ``hot`` (see
    ``hot_keys``) only those keys are split and repeated, each as often as its share asks for;
    without it all are, into as many pieces as there are shuffle partitions unless ``spread`` says
    otherwise, which suits a short ``one``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the repeated side cannot be kept by an outer join")
    if hot is not None:
        marked = F.broadcast(hot)
        many, one = many.join(marked, list(keys), "left"), one.join(marked, list(keys), "left")
        salts = F.coalesce(F.col(SALTS), F.lit(1))
    else:
        salts = F.lit(spread or int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop(SALTS)
    repeated = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(SALTS)
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
