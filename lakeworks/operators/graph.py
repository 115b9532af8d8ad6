"""Upstream levels, project-limited traversal and group closure over edge tables.

Every loop joins a frontier to the edges and settles the result in the shared folder, so plans
stay short and a lost executor does not restart the walk. Cycles end because a node is only
taken once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

MERGE_EVERY = 10


class _Parts:
    """Settled pieces of one growing table, merged now and then to keep plans short."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > MERGE_EVERY:
            self.parts = [settle(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


TARGETS = 64  # walks that go on side by side, one bit each


def lineage_levels(edges: DataFrame, start, max_depth: int | None = None) -> DataFrame:
    """(node, level): every node upstream of ``start`` at its shortest distance.

    ``edges`` holds (node, upstream).
    """
    return lineage_of_many(edges, [start], max_depth).select("node", "level")


def lineage_of_many(edges: DataFrame, starts: Sequence, max_depth: int | None = None) -> DataFrame:
    """(start, node, level): every node upstream of each of ``starts`` at its shortest distance.

    Up to 64 walks share a round: a node carries one bit per walk that has reached it, so there are as many rounds as the
    deepest walk has levels. The edges are written once; a round reads them and the newest nodes.
    """
    node_type = edges.schema["node"].dataType
    steps = settle(edges.select("node", "upstream"), "steps")
    found = [_marked_levels(steps, starts[i : i + TARGETS], node_type, max_depth) for i in range(0, len(starts), TARGETS)]
    return reduce(DataFrame.unionByName, found)


def _marked_levels(steps: DataFrame, starts: Sequence, node_type, max_depth: int | None) -> DataFrame:
    spark = steps.sparkSession
    bits = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(len(starts))]
    first = [F.struct(F.lit(x).cast(node_type).alias("node"), b.alias("walks"), F.lit(0).alias("level")) for x, b in zip(starts, bits)]
    begun = spark.range(1).select(F.explode(F.array(*first)).alias("s")).select("s.*")
    frontier = settle(begun.groupBy("node", "level").agg(F.bit_or("walks").alias("walks")), "frontier")
    seen = _Parts(frontier)
    level = 0
    while max_depth is None or level < max_depth:
        level += 1
        none = F.lit(0).cast("long")
        ahead = frontier.select("node", "walks").join(steps, "node").select(F.col("upstream").alias("node"), "walks", none.alias("_known"))
        known = seen.all().select("node", none.alias("walks"), F.col("walks").alias("_known"))
        # One grouping tells which walks are new at a node.
        met = ahead.unionByName(known).groupBy("node").agg(*[F.bit_or(c).alias(c) for c in ("walks", "_known")])
        new = met.withColumn("walks", F.col("walks").bitwiseAND(F.bitwise_not("_known"))).filter("walks <> 0")
        frontier = settle(new.select("node", F.lit(level).alias("level"), "walks"), "frontier")
        if frontier.isEmpty():
            break
        seen.add(frontier)
    named = F.array(*[F.struct(F.lit(x).cast(node_type).alias("start"), b.alias("bit")) for x, b in zip(starts, bits)])
    rows = seen.all().withColumn("w", F.explode(named)).filter(F.col("walks").bitwiseAND(F.col("w.bit")) != 0)
    return rows.select("w.start", "node", "level")


def limited_lineage(
    edges: DataFrame, projects: DataFrame, start, home: str, foreign_limit: int, max_depth: int = 0
) -> DataFrame:
    """(node, level, levels_since_foreign): unlimited at home, a number of levels beyond.

    The counter starts at the first foreign node, grows with every foreign level and stays
    when the walk comes back home. ``max_depth`` above 0 replaces the foreign limit. A node met
    with several counters on one level takes the smallest.
    ``projects`` holds (node, project).
    """
    spark = edges.sparkSession
    node_type = edges.schema["node"].dataType
    away = projects.select(F.col("node").alias("upstream"), (F.col("project") != home).alias("_foreign"))
    marked = edges.join(away, "upstream", "left").select("node", "upstream", F.coalesce("_foreign", F.lit(True)).alias("_foreign"))
    steps = settle(marked, "steps")  # joined and written once; a level reads them and the newest nodes
    count = F.col("levels_since_foreign")
    frontier = settle(
        spark.range(1).select(
            F.lit(start).cast(node_type).alias("node"), F.lit(0).alias("level"), F.lit(0).alias("levels_since_foreign")
        )
    )
    seen = _Parts(frontier)
    level = 0
    while max_depth <= 0 or level + 1 < max_depth:
        level += 1
        ahead = (
            frontier.select("node", "levels_since_foreign")
            .join(steps, "node")
            .select(F.col("upstream").alias("node"), F.when(F.col("_foreign"), count + 1).otherwise(count).alias("levels_since_foreign"))
            .groupBy("node")
            .agg(F.min("levels_since_foreign").alias("levels_since_foreign"))
        )
        if max_depth <= 0:
            ahead = ahead.filter(count <= foreign_limit)
        fresh = ahead.join(seen.all().select("node"), "node", "left_anti")
        frontier = settle(fresh.select("node", F.lit(level).alias("level"), "levels_since_foreign"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()


def merge_manifests(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph of several manifests.

    ``nodes`` holds (manifest, id, name, type, database, schema), ``edges`` (manifest, node,
    upstream). The highest manifest number wins a repeated id, with its edges. A source whose
    database, schema and name match a model stands for that model: edges are rewired and the
    source is dropped.
    """
    winner = nodes.groupBy("id").agg(
        F.max_by(F.struct("manifest", "name", "type", "database", "schema"), "manifest").alias("_w")
    )
    merged = winner.select("id", "_w.*")
    place = ["database", "schema", "name"]
    models = merged.filter(F.col("type") == "model").groupBy(*place).agg(F.max("id").alias("model_id"))
    resolved = merged.filter(F.col("type") == "source").join(models, place).select("id", "model_id")
    own = edges.join(merged.select(F.col("id").alias("node"), "manifest"), ["node", "manifest"], "left_semi")
    rewired = (
        own.join(resolved.withColumnRenamed("id", "upstream"), "upstream", "left")
        .select("node", F.coalesce("model_id", "upstream").alias("upstream"))
        .distinct()
    )
    kept = merged.join(resolved.select("id"), "id", "left_anti").drop("manifest")
    return kept, rewired


def lineage_roots(levels: DataFrame, nodes: DataFrame, types: Sequence[str] = ("source", "seed")) -> DataFrame:
    """Sources and seeds that were reached."""
    roots = nodes.filter(F.col("type").isin(list(types))).select(F.col("id").alias("node"), "type")
    return levels.join(roots, "node")


def lineage_summary(levels: DataFrame, projects: DataFrame, edges: DataFrame, home: str) -> DataFrame:
    """Nodes, home and foreign nodes, levels and upstream links of a traversal."""
    ups = edges.groupBy("node").agg(F.count_distinct("upstream").alias("upstreams"))
    rows = levels.join(projects, "node", "left").join(ups, "node", "left")
    at_home = F.coalesce(F.col("project") == home, F.lit(False))
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(at_home).alias("home"),
        F.count_if(~at_home).alias("foreign"),
        (F.max("level") + 1).alias("levels"),
        F.coalesce(F.sum("upstreams"), F.lit(0)).alias("upstream_links"),
    )


def group_closure(memberships: DataFrame) -> DataFrame:
    """(group_email, member_email): all members that are no groups, through any nesting.

    ``memberships`` holds (group_email, member_email, is_group). Groups are resolved first; the
    much longer list of people is joined once at the end.
    """
    nested = memberships.filter("is_group").select("group_email", F.col("member_email").alias("sub")).distinct()
    frontier = settle(nested.filter("group_email <> sub"))
    reach = _Parts(frontier)
    # The newest pairs are extended by all pairs known, so path lengths double every round.
    while not frontier.isEmpty():
        known = reach.all()
        ahead = (
            frontier.select("group_email", F.col("sub").alias("_via"))
            .join(known.withColumnRenamed("group_email", "_via"), "_via")
            .select("group_email", "sub")
            .filter("group_email <> sub")
            .distinct()
        )
        frontier = settle(ahead.join(known, ["group_email", "sub"], "left_anti"))
        reach.add(frontier)
    people = memberships.filter("NOT is_group").select("group_email", "member_email").distinct()
    inherited = reach.all().join(people.withColumnRenamed("group_email", "sub"), "sub").select("group_email", "member_email")
    return people.unionByName(inherited).distinct()
