"""Zones, routes and k-means: customers stand for stops."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import values as V
from ..operators import clusters as K
from ..operators import remote
from ..operators import routing as R
from ..operators.ordered import GroupOrder, ordered_lists
from .mapping import LAT, LON, lat_of, lon_of
from .places_q import dist
from .registry import Tables, query, with_sql

PART_POINTS = 100


def stops(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("stop_id"),
        F.col("c_name").alias("name"),
        lat_of(k).alias("lat"),
        lon_of(k).alias("lon"),
        (k % 40 + 5).alias("capacity"),
    )


def geohash_sql(lat: str, lon: str, p: int) -> str:
    total = 5 * p
    xb, yb = (total + 1) // 2, total // 2
    x = f"CAST(floor(({lon} + 180) / 360 * {2**xb}) AS BIGINT)"
    y = f"CAST(floor(({lat} + 90) / 180 * {2**yb}) AS BIGINT)"
    bit = f"CASE WHEN (5 * i + b) % 2 = 0 THEN ({x} >> ({xb - 1} - (5 * i + b) // 2)) & 1 ELSE ({y} >> ({yb - 1} - (5 * i + b) // 2)) & 1 END"
    index = f"list_sum(list_transform(range(5), lambda b: ({bit}) << (4 - b)))"
    return f"array_to_string(list_transform(range({p}), lambda i: substr('{G.BASE32}', CAST({index} AS INTEGER) + 1, 1)), '')"


STOPS = (
    "stops",
    f"""SELECT c_custkey AS stop_id, c_name AS name, {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} AS lon,
  c_custkey % 40 + 5 AS capacity FROM customer""",
)
HASHED = ("hashed", f"SELECT *, {geohash_sql('lat', 'lon', 10)} AS gh10, {geohash_sql('lat', 'lon', 15)} AS gh15 FROM stops")
ZONED = ("zoned", "SELECT *, ntile(10) OVER (ORDER BY gh10, stop_id) AS zone_id FROM hashed")
SEQ = (
    "seq",
    """SELECT *, row_number() OVER w AS stop_sequence, lead(lat) OVER w AS next_lat, lead(lon) OVER w AS next_lon
FROM zoned WINDOW w AS (PARTITION BY zone_id ORDER BY gh15, stop_id)""",
)
LEGS = (
    "legs",
    f"""SELECT *, CAST(round_even(1000 * {dist('a', 'b')}, 0) AS BIGINT) AS leg_mm
FROM (SELECT *, struct_pack(lat := lat, lon := lon) AS a, struct_pack(lat := next_lat, lon := next_lon) AS b FROM seq)""",
)
LENGTHS = (
    "lengths",
    """SELECT zone_id, COUNT(*) AS stop_count, CAST(SUM(capacity) AS BIGINT) AS total_capacity,
  ROUND(COALESCE(SUM(leg_mm), 0) / 1000000, 2) AS route_km FROM legs GROUP BY zone_id""",
)
CENTERS = (
    "centers",
    """SELECT zone_id, COUNT(*) AS stop_count, CAST(SUM(capacity) AS BIGINT) AS total_capacity,
  SUM(cos(radians(lat)) * cos(radians(lon))) AS x, SUM(cos(radians(lat)) * sin(radians(lon))) AS y,
  SUM(sin(radians(lat))) AS z, degrees(atan2(z, sqrt(x * x + y * y))) AS center_lat, degrees(atan2(y, x)) AS center_lon
FROM zoned GROUP BY zone_id""",
)
LINES = (
    "lines",
    f"""SELECT zone_id, (stop_sequence - 1) // {PART_POINTS} AS part, COUNT(*) + (MAX(stop_sequence) % {PART_POINTS} = 0
    AND arg_max(next_lat, stop_sequence) IS NOT NULL)::INT AS n,
  'LINESTRING(' || string_agg(printf('%.6f %.6f', lon, lat) || CASE WHEN stop_sequence % {PART_POINTS} = 0
    AND next_lat IS NOT NULL THEN printf(', %.6f %.6f', next_lon, next_lat) ELSE '' END, ', ' ORDER BY stop_sequence)
    || ')' AS geometry
FROM seq GROUP BY 1, 2""",
)
ROUTE_PARTS = [STOPS, HASHED, ZONED, SEQ, LEGS, LENGTHS]
POINT = "printf('POINT(%.6f %.6f)', lon, lat)"
CENTER = "printf('POINT(%.6f %.6f)', center_lon, center_lat)"


def zoned(t: Tables):
    return R.geohash_zones(stops(t))


def routes(t: Tables) -> R.Routes:
    return R.Routes(zoned(t))


@query("fn_geohash", with_sql(STOPS, HASHED, body="SELECT stop_id, gh10, gh15 FROM hashed"))
def _(t):
    return stops(t).select("stop_id", G.geohash("lat", "lon", 10).alias("gh10"), G.geohash("lat", "lon", 15).alias("gh15"))


@query(
    "fn_distance",
    with_sql(
        STOPS,
        ("p", "SELECT stop_id, struct_pack(lat := lat, lon := lon) AS a, struct_pack(lat := -6.2::DOUBLE, lon := 106.85::DOUBLE) AS b FROM stops"),
        body=f"SELECT stop_id, ROUND({dist('a', 'b')}, 3) AS metres FROM p",
    ),
)
def _(t):
    here = G.distance_m(F.col("lat"), F.col("lon"), F.lit(-6.2), F.lit(106.85))
    return stops(t).select("stop_id", F.round(here, 3).alias("metres"))


@query("ntile_zones", with_sql(STOPS, HASHED, ZONED, body="SELECT stop_id, gh10 AS geohash, zone_id FROM zoned"))
def _(t):
    return zoned(t).select("stop_id", "geohash", "zone_id")


@query(
    "zone_stats",
    with_sql(
        STOPS,
        HASHED,
        ZONED,
        CENTERS,
        body="""SELECT zone_id, stop_count, total_capacity, ROUND(center_lat, 8) AS center_lat,
  ROUND(center_lon, 8) AS center_lon FROM centers""",
    ),
)
def _(t):
    return R.zone_stats(zoned(t)).withColumns(
        {"center_lat": F.round("center_lat", 8), "center_lon": F.round("center_lon", 8)}
    )


@query("stop_sequence", with_sql(STOPS, HASHED, ZONED, SEQ, body="SELECT zone_id, stop_id, stop_sequence FROM seq"))
def _(t):
    return routes(t).stops().select("zone_id", "stop_id", "stop_sequence")


@query(
    "cumulative_distance",
    with_sql(
        *ROUTE_PARTS,
        body="""SELECT zone_id, stop_id, stop_sequence, ROUND(COALESCE(SUM(leg_mm) OVER (PARTITION BY zone_id
  ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000000, 3) AS cumulative_km FROM legs""",
    ),
)
def _(t):
    return routes(t).cumulative()


@query("fn_line_length", with_sql(*ROUTE_PARTS, body="SELECT zone_id, stop_count, route_km FROM lengths"))
def _(t):
    return routes(t).lengths().select("zone_id", "stop_count", "route_km")


@query("fn_makeline", with_sql(STOPS, HASHED, ZONED, SEQ, LINES, body="SELECT zone_id, part, geometry FROM lines"))
def _(t):
    return routes(t).lines(PART_POINTS).select("zone_id", "part", G.wkt_line("points").alias("geometry"))


@query(
    "fn_geojson_line",
    with_sql(
        STOPS,
        HASHED,
        ZONED,
        SEQ,
        LINES,
        body=f"""SELECT l.zone_id, part, CAST(n AS INTEGER) AS points, s.lon AS first_lon, s.lat AS first_lat, TRUE AS lon_first
FROM lines l JOIN seq s ON l.zone_id = s.zone_id AND s.stop_sequence = part * {PART_POINTS} + 1""",
    ),
)
def _(t):
    texts = routes(t).lines(PART_POINTS).select("zone_id", "part", G.geojson_line("points").alias("geojson"))
    back = texts.withColumn("points", G.parse_geojson_line("geojson"))
    return back.select(
        "zone_id",
        "part",
        F.size("points").alias("points"),
        F.get("points", F.lit(0))["lon"].alias("first_lon"),
        F.get("points", F.lit(0))["lat"].alias("first_lat"),
        F.col("geojson").startswith('{"type":"LineString","coordinates":[[10').alias("lon_first"),
    )


@query(
    "fn_waypoints_json",
    with_sql(
        STOPS,
        HASHED,
        ZONED,
        SEQ,
        body=f"""SELECT zone_id, (stop_sequence - 1) // {PART_POINTS} AS part, CAST(COUNT(*) AS INTEGER) AS waypoints,
  arg_min(lat, stop_sequence) AS first_lat, arg_max(lon, stop_sequence) AS last_lng FROM seq GROUP BY 1, 2""",
    ),
)
def _(t):
    point = F.struct(F.col("lat"), F.col("lon").alias("lng"))
    lists = ordered_lists(routes(t).legs, ["zone_id"], "stop_sequence", point, PART_POINTS)
    parsed = F.from_json(F.to_json("items"), remote.STOPS_TYPE)
    return lists.select(
        "zone_id",
        "part",
        F.size(parsed).alias("waypoints"),
        F.element_at(parsed, 1)["lat"].alias("first_lat"),
        F.element_at(parsed, -1)["lng"].alias("last_lng"),
    )


@query(
    "fn_array_agg_ordered",
    """WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)
SELECT l_orderkey, (seq - 1) // 4 AS part, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY seq) AS lines
FROM n GROUP BY 1, 2""",
)
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = GroupOrder(t.lineitem.select("l_orderkey", *order), ["l_orderkey"], order).numbered("seq")
    lists = ordered_lists(rows, ["l_orderkey"], "seq", F.col("l_linenumber").cast("string"), 4)
    return lists.select("l_orderkey", "part", F.array_join("items", ",").alias("lines"))


RESPONSE = ("%d mins", "%.2f km")


def responses(df, key, km):
    """Texts as a routing service would answer them."""
    return df.select(
        key,
        F.to_json(
            F.struct(
                F.format_string(RESPONSE[0], (km * 2).cast("long")).alias("duration"),
                F.format_string(RESPONSE[1], km).alias("distance"),
            )
        ).alias("response"),
    )


@query(
    "fn_route_response",
    """SELECT c_custkey AS stop_id, CAST(CAST(trunc((c_custkey % 977) / 10::DOUBLE * 2) AS BIGINT) AS VARCHAR) || ' mins'
  AS duration, CAST(printf('%.2f', (c_custkey % 977) / 10::DOUBLE) AS DOUBLE) AS distance_km FROM customer""",
)
def _(t):
    texts = responses(stops(t), "stop_id", F.col("stop_id") % 977 / F.lit(10.0))
    return texts.select(
        "stop_id",
        F.get_json_object("response", "$.duration").alias("duration"),
        G.route_number(F.get_json_object("response", "$.distance")).alias("distance_km"),
    )


# --- layers ------------------------------------------------------------------------------

ZONE_LAYERS = f"""SELECT zone_id, {POINT} AS geometry, 'Station' AS layer_type, name AS label, CAST(capacity AS DOUBLE) AS metric
FROM zoned UNION ALL SELECT zone_id, {CENTER}, 'Zone Center', printf('Zone %d (%d stops)', zone_id, stop_count),
  CAST(stop_count AS DOUBLE) FROM centers"""
ROUTE_LAYERS = f"""SELECT zone_id, {POINT} AS geometry, 'Stop' AS layer_type, name || ' (#' || stop_sequence || ')' AS label,
  CAST(stop_sequence AS DOUBLE) AS metric FROM seq
UNION ALL SELECT l.zone_id, geometry, 'Route Path', printf('Zone %d: %d stops, %.2f km', l.zone_id, stop_count, route_km),
  route_km FROM lines l JOIN lengths g ON l.zone_id = g.zone_id"""
COMBINED = f"""SELECT zone_id, {POINT} AS geometry, 'Stop' AS layer_type, name || ' (#' || stop_sequence || ')' AS label,
  stop_sequence AS sequence_number, CAST(capacity AS DOUBLE) AS value FROM seq
UNION ALL SELECT l.zone_id, geometry, 'Route Path', printf('Zone %d: %d stops, %.2f km', l.zone_id, stop_count, route_km),
  NULL, route_km FROM lines l JOIN lengths g ON l.zone_id = g.zone_id
UNION ALL SELECT zone_id, {CENTER}, 'Zone Center',
  printf('Zone %d Center (%d stops, %d capacity)', zone_id, stop_count, total_capacity), NULL,
  CAST(total_capacity AS DOUBLE) FROM centers"""


@query("geo_zones", with_sql(STOPS, HASHED, ZONED, CENTERS, body=ZONE_LAYERS))
def _(t):
    return R.zone_layers(zoned(t))


@query("geo_routes", with_sql(*ROUTE_PARTS, LINES, body=ROUTE_LAYERS))
def _(t):
    return R.route_layers(routes(t), PART_POINTS)


@query("geo_combined", with_sql(*ROUTE_PARTS, LINES, CENTERS, body=COMBINED))
def _(t):
    return R.combined_layers(routes(t), PART_POINTS)


@query(
    "layer_union",
    with_sql(
        *ROUTE_PARTS,
        LINES,
        CENTERS,
        ("u", COMBINED),
        body="""SELECT layer_type, zone_id, COUNT(*) AS n, COUNT(sequence_number) AS numbered, ROUND(SUM(value), 2) AS total
FROM u GROUP BY ALL""",
    ),
)
def _(t):
    layers = R.combined_layers(routes(t), PART_POINTS)
    return layers.groupBy("layer_type", "zone_id").agg(
        F.count("*").alias("n"), F.count("sequence_number").alias("numbered"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "layer_union_two",
    with_sql(
        *ROUTE_PARTS,
        LINES,
        CENTERS,
        ("u", f"{ZONE_LAYERS} UNION ALL {ROUTE_LAYERS}"),
        body="SELECT layer_type, zone_id, COUNT(*) AS n, ROUND(SUM(metric), 2) AS total FROM u GROUP BY ALL",
    ),
)
def _(t):
    z = zoned(t)
    both = R.zone_layers(z).unionByName(R.route_layers(R.Routes(z), PART_POINTS))
    return both.groupBy("layer_type", "zone_id").agg(F.count("*").alias("n"), F.round(F.sum("metric"), 2).alias("total"))


@query(
    "geo_summary",
    with_sql(
        *ROUTE_PARTS,
        body="""SELECT zone_id, stop_count, route_km, ROUND(route_km / stop_count, 4) AS km_per_stop, total_capacity,
  ROUND(total_capacity / stop_count, 4) AS capacity_per_stop FROM lengths""",
    ),
)
def _(t):
    return R.summary(routes(t))


def supplied(r: R.Routes):
    return responses(r.lengths(), "zone_id", F.col("route_km") * 2.0)


COMPARED = """SELECT zone_id, 'straight line' AS approach, route_km AS distance_km, NULL AS duration FROM lengths
UNION ALL SELECT zone_id, 'road network', CAST(printf('%.2f', route_km * 2::DOUBLE) AS DOUBLE),
  CAST(CAST(trunc(route_km * 2::DOUBLE * 2) AS BIGINT) AS VARCHAR) || ' mins' FROM lengths"""


@query("route_compare", with_sql(*ROUTE_PARTS, body=COMPARED))
def _(t):
    r = routes(t)
    return R.compare_routes(r, supplied(r))


def nearest_sql(stops_part: tuple[str, str], zoned_part: tuple[str, str]) -> str:
    return f"""WITH RECURSIVE stops AS ({stops_part[1]}), {HASHED[0]} AS ({HASHED[1]}), zoned AS MATERIALIZED ({zoned_part[1]}),
sets AS MATERIALIZED (SELECT zone_id, list(struct_pack(stop_id := stop_id, lat := lat, lon := lon) ORDER BY stop_id) AS open
  FROM zoned GROUP BY zone_id),
walk AS (
  SELECT zone_id, open[1] AS here, 1::BIGINT AS stop_number, 0::DOUBLE AS leg_m, open[2:] AS open FROM sets
  UNION ALL
  SELECT zone_id, nxt, stop_number + 1, m, list_filter(open, lambda o: o.stop_id <> nxt.stop_id) FROM (
    SELECT zone_id, stop_number, open, best.s AS nxt, best.m AS m FROM (
      SELECT zone_id, stop_number, open, list_min(list_transform(open, lambda o: struct_pack(m := {dist('here', 'o')},
        id := o.stop_id, s := o))) AS best FROM walk WHERE len(open) > 0)))
SELECT zone_id, here.stop_id AS stop_id, stop_number, ROUND(leg_m / 1000, 4) AS leg_km FROM walk"""


@query("nearest_neighbor_route", nearest_sql(STOPS, ZONED))
def _(t):
    return R.greedy_routes(zoned(t)).select(
        "zone_id", "stop_id", "stop_number", F.round(F.col("leg_m") / 1000, 4).alias("leg_km")
    )


# --- k-means ---------------------------------------------------------------------------------
# Stops in ten groups that lie far apart, so that the least cost is known: SQL computes groups,
# centers and all that follows directly. Zones are numbered by their centers, which here rise with
# the group.


def grouped_stops(t: Tables):
    k = F.col("c_custkey")
    g = k % 10
    lat = (g * 9 - 40).cast("double") + (k * 7919 % 1000).cast("double") / 2000
    lon = (g * 3 % 10 * 33 - 150).cast("double") + (k * 104729 % 1000).cast("double") / 2000
    return t.customer.select(
        k.alias("stop_id"), F.col("c_name").alias("name"), lat.alias("lat"), lon.alias("lon"), (k % 40 + 5).alias("capacity")
    )


KSTOPS = (
    "stops",
    """SELECT c_custkey AS stop_id, c_name AS name,
  CAST(c_custkey % 10 * 9 - 40 AS DOUBLE) + CAST(c_custkey * 7919 % 1000 AS DOUBLE) / 2000 AS lat,
  CAST(c_custkey % 10 * 3 % 10 * 33 - 150 AS DOUBLE) + CAST(c_custkey * 104729 % 1000 AS DOUBLE) / 2000 AS lon,
  c_custkey % 40 + 5 AS capacity FROM customer""",
)
KZONED = ("zoned", "SELECT *, stop_id % 10 + 1 AS zone_id FROM hashed")
K_PARTS = [KSTOPS, HASHED, KZONED]
K_ROUTES = [*K_PARTS, SEQ, LEGS, LENGTHS]
SCALED = (
    "scaled",
    """SELECT zone_id, (lat - avg(lat) OVER ()) / stddev_samp(lat) OVER () AS y, (lon - avg(lon) OVER ()) / stddev_samp(lon) OVER () AS x
FROM zoned""",
)
COST = """(SELECT ROUND(avg((y - cy) * (y - cy) + (x - cx) * (x - cx)), 6)
  FROM (SELECT *, avg(y) OVER (PARTITION BY zone_id) AS cy, avg(x) OVER (PARTITION BY zone_id) AS cx FROM scaled))"""
# Mean squared distances to the own and to the nearest other group, from sums per group.
SILHOUETTE = """(SELECT ROUND(avg(CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) FROM (
  SELECT i, max(d / (n - 1)) FILTER (WHERE own) AS a, min(d / n) FILTER (WHERE NOT own) AS b FROM (
    SELECT i, s.zone_id = g.zone_id AS own, n, n * (x * x + y * y) + q - 2 * (x * sx + y * sy) AS d
    FROM (SELECT *, row_number() OVER () AS i FROM scaled) s,
      (SELECT zone_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS q FROM scaled GROUP BY zone_id) g)
  GROUP BY i))"""


def kmeans_zoned(t: Tables):
    rows = grouped_stops(t)
    return K.assign(K.fit(rows, restarts=3), rows)


def kmeans_quality(t: Tables):
    rows = grouped_stops(t)
    measured = K.evaluate(K.fit(rows, restarts=3), rows)
    return measured.select("clusters", *[F.round(c, 6).alias(c) for c in ("mean_squared_distance", "silhouette")])


@query("kmeans_fit", with_sql(*K_PARTS, SCALED, body=f"SELECT 10 AS clusters, {COST} AS mean_squared_distance"))
def _(t):
    return kmeans_quality(t).select("clusters", "mean_squared_distance")


@query("kmeans_assign", with_sql(*K_PARTS, body="SELECT stop_id, zone_id, lat, lon FROM zoned"))
def _(t):
    return kmeans_zoned(t).select("stop_id", "zone_id", "lat", "lon")


@query(
    "join_model_predict",
    with_sql(*K_PARTS, body="SELECT zone_id, COUNT(*) AS stops, CAST(SUM(capacity) AS BIGINT) AS capacity FROM zoned GROUP BY zone_id"),
)
def _(t):
    zones = kmeans_zoned(t)
    return zones.groupBy("zone_id").agg(F.count("*").alias("stops"), F.sum("capacity").alias("capacity"))


@query(
    "kmeans_balance",
    with_sql(*K_PARTS, body="SELECT zone_id, COUNT(*) AS stop_count, ROUND(AVG(lat), 4) AS avg_lat, ROUND(AVG(lon), 4) AS avg_lon FROM zoned GROUP BY zone_id"),
)
def _(t):
    return K.balance(kmeans_zoned(t))


@query(
    "kmeans_evaluate",
    with_sql(*K_PARTS, SCALED, body=f"SELECT 10 AS clusters, {COST} AS mean_squared_distance, {SILHOUETTE} AS silhouette"),
)
def _(t):
    return kmeans_quality(t)


@query("kmeans_zones", with_sql(*K_PARTS, CENTERS, body=ZONE_LAYERS))
def _(t):
    return R.zone_layers(kmeans_zoned(t))


@query("kmeans_routes", with_sql(*K_ROUTES, LINES, body=ROUTE_LAYERS))
def _(t):
    return R.route_layers(R.Routes(kmeans_zoned(t)), PART_POINTS)


@query("kmeans_combined", with_sql(*K_ROUTES, LINES, CENTERS, body=COMBINED))
def _(t):
    return R.combined_layers(R.Routes(kmeans_zoned(t)), PART_POINTS)


@query("kmeans_route_compare", with_sql(*K_ROUTES, body=COMPARED))
def _(t):
    r = R.Routes(kmeans_zoned(t))
    return R.compare_routes(r, supplied(r))


@query("nearest_neighbor_route_kmeans", nearest_sql(KSTOPS, KZONED))
def _(t):
    return R.greedy_routes(kmeans_zoned(t)).select(
        "zone_id", "stop_id", "stop_number", F.round(F.col("leg_m") / 1000, 4).alias("leg_km")
    )


# --- remote function -----------------------------------------------------------------------


def stop_texts(t: Tables):
    """Stop lists as JSON, some of them broken, empty or too short."""
    k = F.col("stop_id")
    one = F.format_string('{"lat": %.3f, "lng": %.3f}', "lat", "lon")
    text = (
        F.when(k % 5 == 0, "not json")
        .when(k % 5 == 1, "[]")
        .when(k % 5 == 2, F.concat(F.lit("["), one, F.lit("]")))
        .when(k % 5 == 3, F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]")))
        .otherwise(F.concat(F.lit("["), one, F.lit(", "), one, F.lit(", "), one, F.lit("]")))
    )
    return stops(t).select("stop_id", text.alias("stops_json"))


ERROR_SQL = """CASE WHEN c_custkey % 5 = 0 THEN '{"error":"Invalid JSON format"}'
  WHEN c_custkey % 5 IN (1, 2) THEN '{"error":"Need at least 2 stops to create a route"}' END"""


@query("route_input_check", f"SELECT c_custkey AS stop_id, {ERROR_SQL} AS error FROM customer")
def _(t):
    return stop_texts(t).select("stop_id", remote.input_error("stops_json").alias("error"))


def _count_stops(texts: list[str]) -> list[str]:
    return [json.dumps({"distance": f"{len(json.loads(x)) - 1}.00 km"}) for x in texts]


@query(
    "remote_route_fn",
    f"""SELECT c_custkey AS stop_id, CASE c_custkey % 5 WHEN 3 THEN 1::DOUBLE WHEN 4 THEN 2::DOUBLE END AS distance_km,
  {ERROR_SQL} IS NOT NULL AS failed FROM customer""",
)
def _(t):
    answered = remote.call_remote(stop_texts(t), "stops_json", _count_stops)
    return answered.select(
        "stop_id",
        G.route_number(F.get_json_object("response", "$.distance")).alias("distance_km"),
        F.get_json_object("response", "$.error").isNotNull().alias("failed"),
    )


@query(
    "procedural_loop",
    f"SELECT zone_id, COUNT(*) AS stops, MAX(stop_number) AS last_number, ROUND(SUM(leg_km), 2) AS km FROM ({nearest_sql(STOPS, ZONED)}) GROUP BY ALL",
)
def _(t):
    walked = R.greedy_routes(zoned(t))
    km = F.round(F.col("leg_m") / 1000, 4)
    return walked.groupBy("zone_id").agg(
        F.count("*").alias("stops"), F.max("stop_number").alias("last_number"), F.round(F.sum(km), 2).alias("km")
    )
