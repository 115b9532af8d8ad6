"""Zones of stops, stop order, route lines and greedy routes.

Input columns: ``stop_id`` (unique), ``name``, ``lat``, ``lon``, ``capacity``; zoned rows add
``zone_id``. Leg lengths are kept in whole millimetres, so route lengths do not depend on
the order of additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_m, geohash, unit_vector, vector_lat, vector_lon, wkt_line, wkt_point
from ..functions.values import safe_divide
from ..session import settle
from .neighbours import AT_ONCE, LISTED, nearest_walks
from .ordered import GroupOrder, ntile, ordered_lists

ZONES = 10
ZONE_PRECISION, ROUTE_PRECISION = 10, 15
LINE_POINTS = 500


def geohash_zones(stops: DataFrame, zones: int = ZONES) -> DataFrame:
    """Equal-count zones along the geohash order."""
    hashed = stops.withColumn("geohash", geohash("lat", "lon", ZONE_PRECISION))
    return ntile(hashed, zones, ["geohash", "stop_id"], "zone_id")


def zone_stats(zoned: DataFrame) -> DataFrame:
    """Stops, capacity and centroid (normalised mean of unit vectors) per zone."""
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    sums = zoned.groupBy("zone_id").agg(
        F.count("*").alias("stop_count"),
        F.sum("capacity").alias("total_capacity"),
        F.sum(x).alias("_x"),
        F.sum(y).alias("_y"),
        F.sum(z).alias("_z"),
    )
    return sums.select(
        "zone_id",
        "stop_count",
        "total_capacity",
        vector_lat(F.col("_x"), F.col("_y"), F.col("_z")).alias("center_lat"),
        vector_lon(F.col("_x"), F.col("_y")).alias("center_lon"),
    )


class Routes:
    """Stops of each zone in geohash order, with legs; built once, read by every layer."""

    def __init__(self, zoned: DataFrame):
        rows = zoned.withColumn("route_hash", geohash("lat", "lon", ROUTE_PRECISION))
        self._order = GroupOrder(rows, ["zone_id"], ["route_hash", "stop_id"])
        legs = self._order.with_next(["lat", "lon"], number="stop_sequence")
        metres = distance_m(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"))
        legs = legs.withColumn("leg_mm", F.rint(metres * 1000).cast("long"))
        # Every layer reads the legs; settled, their windows and joins run once.
        self.legs = settle(legs, "legs")

    def stops(self) -> DataFrame:
        return self.legs.select("zone_id", "stop_id", "name", "lat", "lon", "capacity", "stop_sequence")

    def cumulative(self) -> DataFrame:
        """Kilometres travelled on arrival at each stop."""
        rows = self._order.sum_before(self.legs, "leg_mm", "before_mm")
        return rows.select(
            "zone_id", "stop_id", "stop_sequence", F.round(F.col("before_mm") / F.lit(1e6), 3).alias("cumulative_km")
        )

    def lengths(self) -> DataFrame:
        return self.legs.groupBy("zone_id").agg(
            F.count("*").alias("stop_count"),
            F.sum("capacity").alias("total_capacity"),
            F.round(F.coalesce(F.sum("leg_mm"), F.lit(0)) / F.lit(1e6), 2).alias("route_km"),
        )

    def lines(self, points: int = LINE_POINTS) -> DataFrame:
        """Route points in parts; each part ends on the first point of the next."""
        here = F.struct("lat", "lon")
        ahead = F.when(
            F.col("stop_sequence") % points == 0, F.struct(F.col("next_lat").alias("lat"), F.col("next_lon").alias("lon"))
        )
        pair = F.struct(here.alias("here"), ahead.alias("ahead"))
        lists = ordered_lists(self.legs, ["zone_id"], "stop_sequence", pair, points)
        last = F.element_at("items", -1)["ahead"]
        line = F.transform("items", lambda p: p["here"])
        full = F.when(last["lat"].isNotNull(), F.concat(line, F.array(last))).otherwise(line)
        return lists.select("zone_id", "part", full.alias("points"))


def _layer(df: DataFrame, kind: str, geometry: Column, label: Column, **extra: Column) -> DataFrame:
    return df.select(
        "zone_id",
        geometry.alias("geometry"),
        F.lit(kind).alias("layer_type"),
        label.alias("label"),
        *[c.alias(n) for n, c in extra.items()],
    )


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def _stop_label() -> Column:
    return F.concat("name", F.lit(" (#"), _text("stop_sequence"), F.lit(")"))


def _path_label() -> Column:
    return F.format_string("Zone %d: %d stops, %.2f km", "zone_id", "stop_count", "route_km")


def _paths(routes: Routes, points: int) -> DataFrame:
    return routes.lines(points).join(routes.lengths(), "zone_id")


def zone_layers(zoned: DataFrame) -> DataFrame:
    """Stations and zone centers in one table."""
    point = wkt_point(F.col("lat"), F.col("lon"))
    center = wkt_point(F.col("center_lat"), F.col("center_lon"))
    label = F.format_string("Zone %d (%d stops)", "zone_id", "stop_count")
    stations = _layer(zoned, "Station", point, F.col("name"), metric=_number("capacity"))
    centers = _layer(zone_stats(zoned), "Zone Center", center, label, metric=_number("stop_count"))
    return stations.unionByName(centers)


def route_layers(routes: Routes, points: int = LINE_POINTS) -> DataFrame:
    """Numbered stops and route lines in one table."""
    point = wkt_point(F.col("lat"), F.col("lon"))
    stops = _layer(routes.stops(), "Stop", point, _stop_label(), metric=_number("stop_sequence"))
    paths = _layer(_paths(routes, points), "Route Path", wkt_line("points"), _path_label(), metric=_number("route_km"))
    return stops.unionByName(paths)


def combined_layers(routes: Routes, points: int = LINE_POINTS) -> DataFrame:
    """Stops, route lines and zone centers in one table."""
    point = wkt_point(F.col("lat"), F.col("lon"))
    none = F.lit(None).cast("long")
    stops = _layer(
        routes.stops(), "Stop", point, _stop_label(), sequence_number=F.col("stop_sequence"), value=_number("capacity")
    )
    paths = _layer(
        _paths(routes, points), "Route Path", wkt_line("points"), _path_label(), sequence_number=none, value=_number("route_km")
    )
    label = F.format_string("Zone %d Center (%d stops, %d capacity)", "zone_id", "stop_count", "total_capacity")
    centers = _layer(
        zone_stats(routes.stops()),
        "Zone Center",
        wkt_point(F.col("center_lat"), F.col("center_lon")),
        label,
        sequence_number=none,
        value=_number("total_capacity"),
    )
    return stops.unionByName(paths).unionByName(centers)


def summary(routes: Routes) -> DataFrame:
    """Kilometres and capacity per stop and zone."""
    return routes.lengths().select(
        "zone_id",
        "stop_count",
        "route_km",
        F.round(safe_divide(F.col("route_km"), F.col("stop_count")), 4).alias("km_per_stop"),
        "total_capacity",
        F.round(safe_divide(F.col("total_capacity"), F.col("stop_count")), 4).alias("capacity_per_stop"),
    )


def compare_routes(routes: Routes, responses: DataFrame) -> DataFrame:
    """Straight-line length beside the length a routing service reported (``12.3 km`` text)."""
    from ..functions.geo import route_number

    straight = routes.lengths().select(
        "zone_id",
        F.lit("straight line").alias("approach"),
        F.col("route_km").alias("distance_km"),
        F.lit(None).cast("string").alias("duration"),
    )
    supplied = responses.select(
        "zone_id",
        F.lit("road network").alias("approach"),
        route_number(F.get_json_object("response", "$.distance")).alias("distance_km"),
        F.get_json_object("response", "$.duration").alias("duration"),
    )
    return straight.unionByName(supplied)


def greedy_routes(zoned: DataFrame, at_once: int = AT_ONCE, listed: int = LISTED) -> DataFrame:
    """Always go to the closest stop left, per zone, from the lowest stop id; ties by id.

    ``stop_number`` counts from 1, ``leg_m`` is the way to a stop. See ``neighbours.nearest_walks``.
    """
    return nearest_walks(zoned, at_once, listed)
