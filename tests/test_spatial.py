import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeworks.functions.geo import EARTH_RADIUS_M
from lakeworks.operators import neighbours, routing, spatial


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def cloud(n, lat, lon, spread, seed):
    rng = np.random.default_rng(seed)
    points = [(float(lat + x), float(lon + y)) for x, y in rng.uniform(-spread, spread, (n, 2))]
    return [(max(-90.0, min(90.0, a)), (b + 180) % 360 - 180) for a, b in points]


@pytest.mark.parametrize("lat, lon", [(-6.2, 106.8), (70.0, 10.0), (1.0, 180.0), (-45.0, -179.99)])
@pytest.mark.parametrize("radius", [800.0, 5000.0])
def test_radius_totals_equal_brute_force(spark, lat, lon, radius):
    points = cloud(400, lat, lon, 0.1, 1)
    points += [points[0]] * 200 + cloud(300, lat, lon, 0.004, 2)  # one coordinate and one cell hold most
    centers = cloud(25, lat, lon, 0.1, 3) + [points[0]]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id long, lat double, lon double")
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(centers)], "branch_id long, lat double, lon double")
    got = spatial.radius_totals(c, p, radius, {"n": F.lit(1), "s": F.col("id")})
    expected = {}
    for i, center in enumerate(centers):
        near = [j for j, x in enumerate(points) if metres(center, x) <= radius]
        if near:
            expected[i] = (len(near), sum(near))
    assert {r["branch_id"]: (r["n"], r["s"]) for r in got.collect()} == expected


@pytest.mark.parametrize("lat, lon", [(89.995, 10.0), (-89.97, -170.0), (79.99, 20.0), (84.0, 179.99)])
def test_circles_near_a_pole(spark, lat, lon):
    test_radius_totals_equal_brute_force(spark, lat, lon, 5000.0)


def test_polar_and_other_centers_together(spark):
    p = spark.createDataFrame([(1, 90.0, 0.0), (2, 89.99, 180.0), (3, 10.0, 10.0)], "id long, lat double, lon double")
    c = spark.createDataFrame([(1, 89.995, 90.0), (2, 10.0, 10.001)], "branch_id long, lat double, lon double")
    got = spatial.radius_totals(c, p, 5000.0, {"n": F.lit(1)}).collect()
    assert {r["branch_id"]: r["n"] for r in got} == {1: 2, 2: 1}


def plain_walk(stops):
    stops = dict(stops)
    at = min(stops)
    order = [at]
    here = stops.pop(at)
    while stops:
        at = min(stops, key=lambda i: (metres(here, stops[i]), i))
        here = stops.pop(at)
        order.append(at)
    return order


def routes_of(df, *limits):
    got = sorted(routing.greedy_routes(df, *limits).collect(), key=lambda r: (r["zone_id"], r["stop_number"]))
    return {z: [(r["stop_id"], r["leg_m"]) for r in got if r["zone_id"] == z] for z in {r["zone_id"] for r in got}}


ZONED = "zone_id long, stop_id long, lat double, lon double"


@pytest.mark.parametrize("limits", [(60, 0), (1000, 0), (1000, 1000)])
def test_greedy_route_does_not_depend_on_its_limits(spark, limits):
    """Rounds of a few places or one walk, by lists of neighbours or by the tree."""
    zones = {1: cloud(50, 40.75, -74.0, 0.05, 5), 2: cloud(15, 40.75, -74.0, 0.01, 6), 3: [(40.7, -74.0)]}
    zones[1] += zones[1][:3] * 2  # equal places
    zones[4] = [(90.0, 5.0), (89.99, -170.0), (89.99, 10.0), (-89.0, 0.0), (0.0, 179.99), (0.0, -179.99), (0.01, 180.0), (0.0, 0.0)]
    zones[5] = [(x * 0.25, y * 0.25) for x in range(-4, 5) for y in range(-4, 5)]  # many equal distances
    rows = [(z, z * 1000 + i, *p) for z, points in zones.items() for i, p in enumerate(points)]
    rows += [(1, 900, None, 3.0), (6, 901, float("nan"), 3.0), (None, 902, 1.0, 1.0)]
    got = routes_of(spark.createDataFrame(rows[:-1], ZONED), *limits)
    assert set(got) == set(zones)
    for z, points in zones.items():
        route, at = [i for i, _ in got[z]], {z * 1000 + i: p for i, p in enumerate(points)}
        if z == 5:
            # On a grid whose distances differ by rounding only, every step must be as short as any other.
            left = set(at) - {route[0]}
            for a, b in zip(route, route[1:]):
                assert metres(at[a], at[b]) <= min(metres(at[a], at[i]) for i in left) + 1e-6
                left.remove(b)
        else:
            assert route == plain_walk(at.items())
        assert [m for _, m in got[z]] == pytest.approx([0.0] + [metres(at[a], at[b]) for a, b in zip(route, route[1:])], abs=1e-6)


def test_rounds_of_four_places(spark):
    points = cloud(7, 40.75, -74.0, 0.05, 5) + [(10.0, 10.0)] * 2
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(points)], ZONED)
    assert [i for i, _ in routes_of(df, 4, 100)[1]] == plain_walk(enumerate(points))


def test_large_zones_in_one_walk(spark):
    """6,000 stops, half of them in one small spot, against distances to all that are left."""
    stops = cloud(3000, 40.75, -74.0, 0.4, 7) + cloud(2900, 40.8, -74.1, 0.0005, 8) + [(40.9, -74.2)] * 100
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(stops)], ZONED)
    lat, lon = (np.array(x) for x in zip(*stops))
    order, here, left = [0], 0, np.ones(len(stops), dtype=bool)
    left[0] = False
    while left.any():
        away = np.where(left, neighbours.metres(lat[here], lon[here], lat, lon), np.inf)
        here = int(away.argmin())
        left[here] = False
        order.append(here)
    for limits in ((10_000, 10_000), (10_000, 100)):
        assert [i for i, _ in routes_of(df, *limits)[1]] == order


def test_rounds_read_the_places_around_the_walk(spark):
    """Of a zone larger than a task may hold, a round reads no more places than that."""
    places = spark.createDataFrame([(z, i, *p) for z in (1, 2) for i, p in enumerate(cloud(4000 if z == 1 else 50, 10.0, 10.0, 0.3, z))], ZONED)
    heads = places.groupBy("zone_id").agg(F.min_by("lat", "stop_id").alias("from_lat"), F.min_by("lon", "stop_id").alias("from_lon"))
    read = {r["zone_id"]: r for r in neighbours._reached(places, heads, 200, 4000).groupBy("zone_id").agg(F.count("*").alias("n"), F.max("horizon_m").alias("h")).collect()}
    assert 100 <= read[1]["n"] <= 200 and read[2]["n"] == 50 and read[2]["h"] == float("inf")
    far = spark.createDataFrame([(1, i, 10.0 + i * 1e-9, 10.0) for i in range(1000)] + [(1, 2000, -60.0, 100.0)], ZONED)
    heads = far.filter("stop_id = 2000").select("zone_id", F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    assert 1 <= neighbours._reached(far, heads, 100, 1001).count() <= 100  # all but one in the same small spot, sliced again and again


def test_no_stops(spark):
    assert routes_of(spark.createDataFrame([], ZONED)) == {}
    assert routes_of(spark.createDataFrame([(None, 1, 1.0, 1.0), (1, 2, None, None)], ZONED)) == {}


def test_nearest_graph_by_brute_force(spark):
    zones = {1: cloud(300, 40.0, -74.0, 0.2, 9), 2: cloud(40, -89.99, 0.0, 5.0, 10), 3: [(0.0, 179.9 + i / 100) for i in range(9)] + [(0.0, -179.95 + i / 100) for i in range(9)]}
    zones[4] = cloud(100, 0.0, 0.0, 1.0, 11) + cloud(100, 0.5, 0.5, 1e-6, 12)  # a spot too full for lists
    rows = [(z, i, *p) for z, points in zones.items() for i, p in enumerate(points)]
    got = neighbours.nearest_graph(spark.createDataFrame(rows, ZONED), 5).collect()
    assert len(got) == len(rows)
    full = 0
    for r in got:
        points = zones[r["zone_id"]]
        near = sorted((metres(points[r["stop_id"]], p), i) for i, p in enumerate(points) if i != r["stop_id"])
        assert [n["m"] for n in r["near"]] == pytest.approx([m for m, _ in near[: len(r["near"])]], abs=1e-5)
        assert len(r["near"]) == 5 or all(m >= r["reach_m"] for m, _ in near[len(r["near"]) :])
        full += len(r["near"]) == 5
    assert full > 250 and any(not r["near"] for r in got if r["zone_id"] == 4)


def test_route_layers(spark):
    rows = [(i, f"s{i}", 40.7 + i * 0.001, -74.0, 10 + i) for i in range(25)]
    stops = spark.createDataFrame(rows, "stop_id long, name string, lat double, lon double, capacity long")
    zoned = routing.geohash_zones(stops, 3)
    assert sorted(r["count"] for r in zoned.groupBy("zone_id").count().collect()) == [8, 8, 9]
    routes = routing.Routes(zoned)
    km = {r["zone_id"]: r["route_km"] for r in routes.lengths().collect()}
    last = {z: 0.0 for z in km}
    for r in routes.cumulative().collect():
        last[r["zone_id"]] = max(last[r["zone_id"]], r["cumulative_km"])
    assert km == pytest.approx(last, abs=0.01)
    lines = routes.lines(4).orderBy("zone_id", "part").collect()
    assert max(len(r["points"]) for r in lines) == 5  # four points and the first of the next part
    assert sum(len(r["points"]) for r in lines) == 25 + len(lines) - 3
    layers = routing.combined_layers(routes)
    assert {r["layer_type"]: r["count"] for r in layers.groupBy("layer_type").count().collect()} == {
        "Stop": 25, "Route Path": 3, "Zone Center": 3,
    }
