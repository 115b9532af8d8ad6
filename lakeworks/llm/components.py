"""Connected components of links between longs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 60  # rounds grow with the logarithm of the longest chain


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _nearest(links: DataFrame) -> DataFrame:
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the links ``u``, ``v``.

    Each round hangs the larger neighbours of every node on the smallest (large star), then the
    smaller ones (small star); it ends when nothing changes. Minima are taken before they are
    joined, so a node of many links is split by adaptive skew joins. Links may repeat, point either
    way or from a node to itself; an empty table gives an empty result.
    """
    down = (F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = written(links.filter("u <> v").select(*down).distinct(), "links")
    before = _signature(links)
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _nearest(both)
        large = near.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        near = _nearest(large.filter("u <> v").distinct())
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = near.select("u", F.col("m").alias("v")).unionByName(small).distinct()
        links = written(stars, "links")
        now = _signature(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
