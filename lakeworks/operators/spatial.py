"""Points within a distance, without a cross join."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, distance_m
from ..session import settle
from .skew import hot_keys, spread_join

STEPS = 4  # grid steps per radius
MAX_LATITUDE = 80.0  # circles that reach beyond are searched by latitude alone


class _Grid:
    """Square-ish cells of radius / STEPS; longitude cells wrap around the globe."""

    def __init__(self, radius_m: float, highest_lat: float):
        step = radius_m / STEPS / METRES_PER_DEGREE
        self.lat = step
        # Cells narrow toward the poles, so size them where the data reaches highest. Around the
        # poles a cell is a whole band, of which no circle is sure to hold everything.
        reach = highest_lat + radius_m / METRES_PER_DEGREE
        self.polar = reach > MAX_LATITUDE
        self.around = 1 if self.polar else max(1, math.floor(360.0 / (step / math.cos(math.radians(reach)))))
        self.lon = 360.0 / self.around
        self.radius = radius_m

    def keys(self, lat: Column, lon: Column) -> list[Column]:
        i = F.floor((lat + 90.0) / self.lat).cast("long")
        j = F.pmod(F.floor((lon + 180.0) / self.lon).cast("long"), F.lit(self.around))
        return [i.alias("_ci"), j.alias("_cj")]

    def near(self, centers: DataFrame, id_col: str) -> DataFrame:
        """Cells a center may reach, marked ``_inside`` when every point of one must be in."""
        reach = STEPS + 1
        wide = min(reach, (self.around - 1) // 2)
        lat_steps = F.sequence(F.lit(-reach), F.lit(reach))
        lon_steps = F.sequence(F.lit(-wide), F.lit(wide))
        base = centers.select(
            id_col,
            F.col("lat").alias("_lat"),
            F.col("lon").alias("_lon"),
            F.floor((F.col("lat") + 90.0) / self.lat).cast("long").alias("_i"),
            F.floor((F.col("lon") + 180.0) / self.lon).cast("long").alias("_j"),
        )
        cells = base.withColumn("_di", F.explode(lat_steps)).withColumn("_dj", F.explode(lon_steps))
        i, j = F.col("_i") + F.col("_di"), F.col("_j") + F.col("_dj")
        south, west = i * self.lat - 90.0, j * self.lon - 180.0
        north, east = south + self.lat, west + self.lon
        la, lo = F.col("_lat"), F.col("_lon")
        corners = [distance_m(la, lo, y, x) for y in (south, north) for x in (west, east)]
        nearest = distance_m(la, lo, F.greatest(south, F.least(la, north)), F.greatest(west, F.least(lo, east)))
        # Margins keep the shortcuts safe; cells in between are tested point by point.
        return (
            cells.withColumn("_far", F.greatest(*corners))
            .filter(nearest <= F.lit(self.radius * 1.02))
            .select(
                id_col,
                "_lat",
                "_lon",
                i.alias("_ci"),
                F.pmod(j, F.lit(self.around)).alias("_cj"),
                (F.col("_far") <= F.lit(0.0 if self.polar else self.radius * 0.98)).alias("_inside"),
            )
        )


def radius_totals(
    centers: DataFrame, points: DataFrame, radius_m: float, totals: Mapping[str, Column], id_col: str = "branch_id"
) -> DataFrame:
    """Sums over the points within ``radius_m`` of each center (``lat``/``lon`` on both sides).

    ``totals`` are additive per point. Points on one coordinate collapse first. A grid cell
    lying wholly inside the circle adds its own total; only cells on the rim compare points,
    so a crowded cell costs most centers one row. Centers without points are left out; circles
    near a pole are searched by bands of latitude.
    """
    names = list(totals)
    per_spot = settle(points.groupBy("lat", "lon").agg(*[F.sum(c).alias(n) for n, c in totals.items()]), "spots")
    limit = MAX_LATITUDE - radius_m / METRES_PER_DEGREE
    polar = F.abs("lat") > limit
    ends = centers.agg(F.max(F.when(~polar, F.abs("lat"))).alias("low"), F.max(F.when(polar, F.abs("lat"))).alias("high")).first()
    found = _grid_totals(centers.filter(~polar), per_spot, _Grid(radius_m, float(ends["low"] or 0.0)), names, radius_m, id_col)
    if ends["high"] is not None:
        found = found.unionByName(_grid_totals(centers.filter(polar), per_spot, _Grid(radius_m, 90.0), names, radius_m, id_col))
    return found


def _grid_totals(centers: DataFrame, per_spot: DataFrame, grid: _Grid, names: Sequence[str], radius_m: float, id_col: str) -> DataFrame:
    per_spot = per_spot.select("*", *grid.keys(F.col("lat"), F.col("lon")))
    near = grid.near(centers, id_col)
    cell = ["_ci", "_cj"]
    per_cell = per_spot.groupBy(*cell).agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("_spots"))
    hot = hot_keys(per_cell, cell, "_spots")
    whole = near.filter("_inside").select(id_col, *cell).join(per_cell, cell).select(id_col, *names)
    rim = spread_join(per_spot, near.filter("NOT _inside"), cell, ["lat", "lon"], hot=hot)
    rim = rim.filter(distance_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= radius_m)
    both = whole.unionByName(rim.select(id_col, *names))
    return both.groupBy(id_col).agg(*[F.sum(n).alias(n) for n in names])


def competitors_within(branches: DataFrame, places: DataFrame, radius_m: float, keep: Sequence[str], threshold: int = 5) -> DataFrame:
    """Competitor counts by kind and mean rating and reviews around each branch."""
    has = {k: F.array_contains("types", k).cast("long") for k in ("atm", "bank")}
    totals = {
        "competitors": F.lit(1),
        "competitor_atms": has["atm"],
        "competitor_banks": has["bank"],
        "_tenths": F.coalesce(F.rint(F.col("rating") * 10).cast("long"), F.lit(0)),
        "_rated": F.col("rating").isNotNull().cast("long"),
        "_reviews": F.coalesce(F.col("user_rating_count").cast("long"), F.lit(0)),
        "_reviewed": F.col("user_rating_count").isNotNull().cast("long"),
    }
    near = radius_totals(branches, places, radius_m, totals)

    def mean(total: str, n: str) -> Column:
        return F.try_divide(F.col(total).cast("double"), F.col(n).cast("double"))

    found = near.filter(F.col("competitors") >= threshold).select(
        "branch_id",
        "competitors",
        "competitor_atms",
        "competitor_banks",
        F.round(mean("_tenths", "_rated") / 10, 2).alias("avg_competitor_rating"),
        F.round(mean("_reviews", "_reviewed"), 1).alias("avg_competitor_reviews"),
    )
    return found.join(branches.select("branch_id", *keep), "branch_id")


def branch_benchmark(branches: DataFrame, places: DataFrame, radius_m: float, threshold: int = 5) -> DataFrame:
    """Own rating against the mean rating of rated neighbours."""
    rated = places.filter(F.col("rating").isNotNull())
    near = competitors_within(branches, rated, radius_m, ["branch_name", "own_rating"], threshold)
    own, other = F.col("own_rating"), F.col("avg_competitor_rating")
    status = (
        F.when(own > other + 0.3, F.lit("Outperforming"))
        .when(own < other - 0.3, F.lit("Underperforming"))
        .otherwise(F.lit("Competitive"))
    )
    return near.select(
        "branch_id",
        "branch_name",
        "own_rating",
        "avg_competitor_rating",
        F.col("competitors").alias("nearby_competitors"),
        F.round(own - other, 2).alias("rating_advantage"),
        status.alias("performance_status"),
    )
