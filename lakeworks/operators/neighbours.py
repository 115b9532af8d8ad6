"""Nearest neighbours on the sphere: a graph for all points at once, and walks from one to the next.

The graph comes from one join over a grid of cells in space, so neither the poles nor the date line
are special. Its lists hold what is certain only: the neighbours within a cell's width, the nearest first.
A walk follows them, and asks a tree over the points still open when a list is used up.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, distance_m, unit_vector
from ..session import settle
from .ordered import GroupOrder

NEIGHBOURS = 8
FULLEST = 48  # points of a cell; points in or beside a fuller one have no list and are left to the tree
LISTED = 10_000  # places of a zone up to which a walk of under a second needs no lists
AT_ONCE = 500_000  # points of a zone that one task walks among
_SAME_M = 1e-7  # distances this close are computed again before the smaller id wins
_SAME_CHORD = 1e-14
_EDGE_M = 1e-6
_SLICES, _SLICINGS = 1024, 5
_AXES = ("cx", "cy", "cz")


def _in_cells(points: DataFrame) -> DataFrame:
    """Points with their cell. A cell's width gives a few points per cell if the zone is spread over a surface."""
    placed = points.withColumns(dict(zip("xyz", unit_vector(F.col("lat"), F.col("lon")))))
    extents = [F.max(a) - F.min(a) for a in "xyz"]
    sizes = placed.groupBy("zone_id").agg(F.count("*").alias("n"), F.greatest(*extents).alias("extent"))
    width = F.when(F.col("extent") > 0, 1.5 * F.col("extent") / F.sqrt("n")).otherwise(1.0)
    cells = {c: F.floor(F.col(a) / F.col("width")).cast("long") for c, a in zip(_AXES, "xyz")}
    return placed.join(sizes.select("zone_id", width.alias("width")), "zone_id").withColumns(cells)


def _beside() -> list[Column]:
    """The 27 cells around a cell, for ``side`` from 0 to 26."""
    shift = [F.col("side") % 3, F.floor(F.col("side") / 3) % 3, F.floor(F.col("side") / 9)]
    return [(F.col(c) + s - 1).cast("long").alias(c) for c, s in zip(_AXES, shift)]


def _with_sides(df: DataFrame, *kept: str) -> DataFrame:
    sides = df.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(26))))
    return sides.select("zone_id", *kept, *_beside())


def nearest_graph(points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Per point (``zone_id``, ``stop_id``, ``lat``, ``lon``; places differ within a zone) its nearest others.

    ``near`` lists up to ``k`` of them with ``m``, their distance, ties by id. All points closer than
    ``reach_m`` are in it. Rows joined per point are bounded by 27 times ``FULLEST``, whatever the density.
    """
    cells = settle(_in_cells(points), "cells")
    full = cells.groupBy("zone_id", *_AXES).count().filter(F.col("count") > FULLEST)
    around = _with_sides(full).distinct()
    light = cells.join(full, ["zone_id", *_AXES], "left_anti")
    asking = light.join(around, ["zone_id", *_AXES], "left_anti")
    there = light.select("zone_id", *_AXES, F.col("stop_id").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("lat", "lon", "x", "y", "z")))
    pairs = _with_sides(asking, "stop_id", "lat", "lon", "x", "y", "z", "width").join(there, ["zone_id", *_AXES]).filter("other <> stop_id")
    chord2 = sum(((F.col(a) - F.col(f"o_{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    found = pairs.filter(chord2 < F.col("width") ** 2 * (1 - 1e-9)).select(
        "zone_id", "stop_id", F.struct(distance_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")).alias("m"), F.col("other").alias("id")).alias("n")
    )
    lists = found.groupBy("zone_id", "stop_id").agg(F.array_sort(F.collect_list("n")).alias("all"))
    known = asking.select("zone_id", "stop_id", "width").join(lists, ["zone_id", "stop_id"], "left")
    certain = 2 * EARTH_RADIUS_M * F.asin(F.least(F.col("width") / 2, F.lit(1.0))) - _EDGE_M
    near = F.coalesce(F.slice("all", 1, k), F.array().cast("array<struct<m: double, id: bigint>>"))
    reach = F.when(F.size("all") > k, F.element_at("near", -1)["m"]).otherwise(certain)
    known = known.withColumn("near", near).select("zone_id", "stop_id", "near", reach.alias("reach_m"))
    none = F.array().cast("array<struct<m: double, id: bigint>>")
    rest = points.join(known, ["zone_id", "stop_id"], "left")
    return rest.select("zone_id", "stop_id", "lat", "lon", F.coalesce("near", none).alias("near"), F.coalesce("reach_m", F.lit(0.0)).alias("reach_m"))


def metres(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def on_sphere(lat, lon) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=-1)


class OpenPoints:
    """Points in a balanced tree of boxes; closed ones are no longer found."""

    LEAF = 16

    def __init__(self, xyz: np.ndarray):
        order = np.arange(len(xyz))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.parent: list[int] = []
        self.boxes: list[tuple[list[float], list[float]]] = []
        todo = [(0, len(xyz), -1)]
        while todo:
            a, b, above = todo.pop()
            node, inside = len(self.spans), xyz[order[a:b]]
            low, high = inside.min(axis=0), inside.max(axis=0)
            self.spans.append((a, b))
            self.children.append(None)
            self.parent.append(above)
            self.boxes.append((low.tolist(), high.tolist()))
            if above >= 0:
                first = self.children[above]
                self.children[above] = (first[0], node) if first else (node, -1)
            if b - a > self.LEAF:
                half = (b - a) // 2
                by = np.argpartition(inside[:, (high - low).argmax()], half)
                order[a:b] = order[a:b][by]
                todo += [(a, a + half, node), (a + half, b, node)]
        self.order, self.at = order, xyz[order]
        self.open = [b - a for a, b in self.spans]
        self.alive = np.ones(len(xyz), dtype=bool)
        self.place = np.empty(len(xyz), np.int64)
        self.place[order] = np.arange(len(xyz))
        self.leaf = np.empty(len(xyz), np.int64)
        for node, (a, b) in enumerate(self.spans):
            if self.children[node] is None:
                self.leaf[order[a:b]] = node

    def close(self, i: int) -> None:
        self.alive[self.place[i]] = False
        node = int(self.leaf[i])
        while node >= 0:
            self.open[node] -= 1
            node = self.parent[node]

    def _gap(self, node: int, p: list[float]) -> float:
        total = 0.0
        for low, high, x in zip(*self.boxes[node], p):
            d = low - x if x < low else x - high if x > high else 0.0
            total += d * d
        return total

    def nearest(self, p: np.ndarray) -> list[int]:
        """Open points at the smallest distance from ``p``, and those too close to it to tell."""
        here, best, limit = p.tolist(), np.inf, np.inf
        found: list[tuple[float, int]] = []
        stack = [(0.0, 0)]
        while stack:
            gap, node = stack.pop()
            if gap > limit or not self.open[node]:
                continue
            pair = self.children[node]
            if pair is not None:
                stack += sorted(((self._gap(c, here), c) for c in pair), reverse=True)
                continue
            a, b = self.spans[node]
            away = np.sqrt(((self.at[a:b] - p) ** 2).sum(axis=1))
            away[~self.alive[a:b]] = np.inf
            nearest = float(away.min())
            if nearest < best:
                best = nearest
                limit = (best + _SAME_CHORD) ** 2
            found += [(float(away[j]), a + int(j)) for j in np.flatnonzero(away <= best + _SAME_CHORD)]
        return [int(self.order[at]) for d, at in found if d <= best + _SAME_CHORD]


WALKED = "zone_id long, stop_id long, first_number long, lat double, lon double, leg_m double, stops long"


def walk(rows: pa.Table) -> pa.Table:
    """Go to the closest open place as long as it is surely among the given rows.

    ``rows`` are the open places of a zone no further than ``horizon_m`` from where it begins.
    """
    rows = rows.sort_by("stop_id").combine_chunks()
    ids, lat, lon, stops = (rows[c].to_numpy() for c in ("stop_id", "lat", "lon", "stops"))
    lists = rows["near"].combine_chunks()
    upto, flat = lists.offsets.to_numpy().tolist(), lists.flatten()
    wanted = flat.field("id").to_numpy()
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    # Places walked before, or beyond the horizon, are not here.
    near = np.where(ids[at] == wanted, at, -1).tolist() if len(wanted) else []
    away, reach = flat.field("m").to_numpy().tolist(), rows["reach_m"].to_numpy().tolist()
    xyz, offset = on_sphere(lat, lon), lists.offsets[0].as_py()
    from_lat, from_lon, number, horizon = (rows[c][0].as_py() for c in ("from_lat", "from_lon", "from_number", "horizon_m"))
    from_start = metres(from_lat, from_lon, lat, lon)
    tree = OpenPoints(xyz)
    is_open = [True] * len(ids)
    here, cur, order = on_sphere(from_lat, from_lon), -1, []
    while len(order) < len(ids):
        options: list[int] = []
        if cur >= 0:
            first = None
            for j in range(upto[cur] - offset, upto[cur + 1] - offset):
                i = near[j]
                if i >= 0 and is_open[i]:
                    if first is None:
                        if away[j] + _SAME_M >= reach[cur]:
                            break
                        first = away[j]
                    elif away[j] > first + _SAME_M:
                        break
                    options.append(i)
        if not options:
            options = tree.nearest(here)
        lat_now, lon_now = (lat[cur], lon[cur]) if cur >= 0 else (from_lat, from_lon)
        legs = metres(lat_now, lon_now, lat[options], lon[options])
        leg, pick = min(zip(legs.tolist(), options))  # places are in the order of their ids
        if order and leg >= horizon - from_start[cur] - _EDGE_M:
            break
        order.append((pick, leg))
        is_open[pick] = False
        tree.close(pick)
        cur, here = pick, xyz[pick]
    picks = np.array([i for i, _ in order])
    before = np.cumsum(stops[picks]) - stops[picks]
    columns = [rows["zone_id"].combine_chunks().slice(0, len(picks)), ids[picks], number + 1 + before, lat[picks], lon[picks]]
    return pa.table(dict(zip((c.split()[0] for c in WALKED.split(", ")), [*columns, np.array([m for _, m in order]), stops[picks]])))


def _horizons(away: DataFrame, at_once: int) -> DataFrame:
    """Per zone a distance within which lie some, but not more than ``at_once``, of the places ``from_m`` away.

    Places are counted in slices of distance. Where the nearest slice holds too many, it is sliced again.
    """
    ranges = settle(away.groupBy("zone_id").agg(F.lit(0.0).alias("low"), F.max("from_m").alias("high")), "slices")
    done = []
    for turn in range(_SLICINGS):
        width = (F.col("high") - F.col("low")) / _SLICES
        slot = F.when(width > 0, F.least(F.floor((F.col("from_m") - F.col("low")) / width), F.lit(_SLICES - 1))).otherwise(0)
        inside = away.join(ranges, "zone_id").filter("from_m BETWEEN low AND high").groupBy("zone_id", slot.alias("slot"))
        counts = inside.agg(F.count("*").alias("n"), F.min("from_m").alias("bottom"), F.max("from_m").alias("top"))
        summed = counts.withColumn("sum", F.sum("n").over(Window.partitionBy("zone_id").orderBy("slot")))
        fits = F.max(F.when(F.col("sum") <= at_once, F.col("top"))).alias("fits")
        first = F.min(F.struct("slot", "bottom", "top")).alias("first")
        chosen = settle(summed.groupBy("zone_id").agg(fits, first), "slices")
        # Places all at one distance cannot be told apart by it.
        last = F.col("fits") if turn < _SLICINGS - 1 else F.coalesce("fits", "first.top")
        done.append(chosen.filter(last.isNotNull()).select("zone_id", last.alias("horizon_m")))
        ranges = chosen.filter(last.isNull()).select("zone_id", F.col("first.bottom").alias("low"), F.col("first.top").alias("high"))
        if ranges.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _largest(places: DataFrame) -> int:
    return places.groupBy("zone_id").count().agg(F.max("count")).first()[0] or 0


def _reached(left: DataFrame, heads: DataFrame, at_once: int, largest: int) -> DataFrame:
    """Open places with where their zone's walk stands; of zones with more than ``at_once``, those around it only."""
    endless = F.lit(float("inf"))
    rows = left.join(heads, "zone_id")
    if largest <= at_once:
        return rows.withColumn("horizon_m", endless)
    counts = left.groupBy("zone_id").agg(F.count("*").alias("n"))
    from_m = distance_m(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon"))
    away = rows.join(counts.filter(F.col("n") > at_once), "zone_id").select("zone_id", from_m.alias("from_m"))
    horizon = F.coalesce("horizon_m", endless)
    return rows.join(_horizons(away, at_once), "zone_id", "left").withColumn("horizon_m", horizon).filter(from_m <= F.col("horizon_m"))


def _numbered(stops: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """Stops with ``at``, their number within their place, by stop id; ``most`` is how many a place holds."""
    lone = places.filter("stops = 1").select("zone_id", "lat", "lon", "stop_id", F.lit(1).cast("long").alias("at"))
    if most <= 1:
        return lone
    shared = places.filter("stops > 1")
    # One place may hold any share of the stops.
    inside = stops.join(shared.select("zone_id", "lat", "lon"), ["zone_id", "lat", "lon"], "left_semi")
    several = GroupOrder(inside, ["zone_id", "lat", "lon"], ["stop_id"]).numbered("at")
    return lone.unionByName(several.select("zone_id", "lat", "lon", "stop_id", "at"))


def _listed(places: DataFrame, listed: int) -> DataFrame:
    """Places with the lists of the graph, in zones of more than ``listed``."""
    sizes = places.groupBy("zone_id").count().filter(F.col("count") > listed).select("zone_id")
    large = places.join(sizes, "zone_id", "left_semi")
    lists = nearest_graph(large).select("zone_id", "stop_id", "near", "reach_m")
    found = large.join(lists, ["zone_id", "stop_id"])
    return settle(found.unionByName(_unlisted(places.join(sizes, "zone_id", "left_anti"))), "listed")


def _unlisted(places: DataFrame) -> DataFrame:
    return places.withColumns({"near": F.array().cast("array<struct<m: double, id: bigint>>"), "reach_m": F.lit(0.0)})


def nearest_walks(zoned: DataFrame, at_once: int = AT_ONCE, listed: int = LISTED) -> DataFrame:
    """Always go to the closest stop left, per zone, from the lowest stop id; ties by id.

    ``zoned`` has ``zone_id``, ``stop_id``, ``lat``, ``lon``; the result adds ``stop_number`` and ``leg_m``. Stops at one place
    follow one another, so the walk is one of places. A zone of up to ``at_once`` places is one walk of one task; of more than
    ``listed``, the graph finds most next places beforehand, in many tasks. A larger zone takes rounds: each reads the places around
    the walk and goes on until one further off could be closer. Stops without coordinates are on no walk.
    """
    spark = zoned.sparkSession
    kinds = {"zone_id": "long", "stop_id": "long", "lat": "double", "lon": "double"}
    stops = settle(zoned.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)"), "stops")
    places = stops.groupBy("zone_id", "lat", "lon").agg(F.min("stop_id").alias("stop_id"), F.count("*").alias("stops"))
    places = settle(places, "places")
    largest, most = places.groupBy("zone_id").agg(F.count("*").alias("n"), F.max("stops").alias("most")).agg(F.max("n"), F.max("most")).first()
    left = _listed(places, listed) if (largest or 0) > listed else _unlisted(places)
    heads = places.groupBy("zone_id").agg(
        F.min_by("lat", "stop_id").alias("from_lat"), F.min_by("lon", "stop_id").alias("from_lon"), F.lit(0).cast("long").alias("from_number")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done: list[DataFrame] = []
    while largest:
        # Small zones side by side: a named number of partitions is not merged into one task.
        near = _reached(left, heads, at_once, largest).repartition(parts, "zone_id")
        done.append(settle(near.groupBy("zone_id").applyInArrow(walk, WALKED), "walked"))
        if largest <= at_once:
            break
        walked = done[-1]
        if len(done) >= 20:
            done = [settle(reduce(DataFrame.unionByName, done))]
        ends = walked.groupBy("zone_id").agg(F.count("*").alias("n"), F.max_by(F.struct("lat", "lon", "first_number", "stops"), "first_number").alias("last"))
        more = left.groupBy("zone_id").count().join(ends, "zone_id").filter("count > n")
        heads = settle(
            more.select("zone_id", F.col("last.lat").alias("from_lat"), F.col("last.lon").alias("from_lon"), F.expr("last.first_number + last.stops - 1").alias("from_number")),
            "heads",
        )
        going = left.join(heads.select("zone_id"), "zone_id", "left_semi")
        left = settle(going.join(walked.select("zone_id", "stop_id"), ["zone_id", "stop_id"], "left_anti"), "left")
        largest = _largest(left)
    if not done:
        return spark.createDataFrame([], "zone_id long, stop_id long, stop_number long, lat double, lon double, leg_m double")
    walked = reduce(DataFrame.unionByName, done).select("zone_id", "lat", "lon", "first_number", "leg_m")
    rows = _numbered(stops, places, most).join(walked, ["zone_id", "lat", "lon"])
    leg = F.when(F.col("at") == 1, F.col("leg_m")).otherwise(0.0)
    return rows.select("zone_id", "stop_id", (F.col("first_number") + F.col("at") - 1).alias("stop_number"), "lat", "lon", leg.alias("leg_m"))
