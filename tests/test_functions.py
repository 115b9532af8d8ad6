import json
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeworks.functions import geo as G
from lakeworks.functions import principals as PR
from lakeworks.functions import values as V


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_q_timestamps(spark):
    rows = spark.createDataFrame([(0,), (1,), (V.Q_NULL,), (None,), (-1500,), (1999,)], "q long")
    ns = [r[0] for r in rows.select(V.q_ns_to_unix_ns("q")).collect()]
    assert ns == [V.Q_EPOCH_SHIFT_NS, V.Q_EPOCH_SHIFT_NS + 1, None, None, V.Q_EPOCH_SHIFT_NS - 1500, V.Q_EPOCH_SHIFT_NS + 1999]
    us = [r[0] for r in rows.select(V.q_ns_to_unix_us("q")).collect()]
    base = V.Q_EPOCH_SHIFT_NS // 1000
    assert us == [base, base, None, None, base - 1, base + 1]


@pytest.mark.parametrize("value", [V.Q_POS_INF, V.Q_NEG_INF, V.Q_POS_INF - V.Q_EPOCH_SHIFT_NS + 1])
def test_q_timestamps_out_of_range_raise(spark, value):
    rows = spark.createDataFrame([(value,)], "q long")
    with pytest.raises(PySparkException):
        rows.select(V.q_ns_to_unix_ns("q")).collect()


def test_largest_q_timestamp_fits(spark):
    value = V.Q_POS_INF - V.Q_EPOCH_SHIFT_NS
    assert spark.createDataFrame([(value,)], "q long").select(V.q_ns_to_unix_ns("q")).first()[0] == V.Q_POS_INF


def test_uuid_matches_the_standard_library(spark):
    for n in (0, 1, 255, 2**40 + 17):
        assert one(spark, V.uuid_of(F.lit(n)))[0] == str(uuid.UUID(int=n))


def test_exact_sums(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(-0.3,), (None,)], "x double")
    row = df.agg(V.fixed_sum("x").alias("s"), V.fixed_avg("x").alias("a")).first()
    assert row["s"] == 0.7 and row["a"] == pytest.approx(0.7 / 11)
    none = df.filter("x is null").agg(V.fixed_sum("x").alias("s"), V.fixed_avg("x").alias("a")).first()
    assert none["s"] is None and none["a"] is None


def test_guards_and_masks(spark):
    assert one(spark, V.safe_divide(F.lit(1), F.lit(0)), V.flag(F.lit(None).cast("boolean"))) == (None, False)
    row = one(
        spark,
        V.mask(F.lit("123-45"), "SHA256"),
        V.mask(F.lit("123-45-6789"), "LAST_FOUR_CHARACTERS"),
        V.mask(F.lit("a"), "DEFAULT_MASKING_VALUE", T.StringType()),
        V.mask(F.lit(5.0), "ALWAYS_NULL", T.DoubleType()),
        V.mask(F.lit(5), "DEFAULT_MASKING_VALUE", T.IntegerType()),
    )
    assert len(row[0]) == 64 and row[1:] == ("6789", "", None, 0)
    with pytest.raises(ValueError):
        V.mask(F.lit("a"), "ROT13")


def test_params(spark):
    schema = "p array<struct<key string, value struct<int_value long, string_value string>>>"
    df = spark.createDataFrame([([("k", (5, None)), ("s", (None, "x"))],), ([],)], schema)
    rows = df.select(V.param_get("p", "k", "int_value"), V.param_get("p", "s", "string_value")).collect()
    assert [tuple(r) for r in rows] == [(5, "x"), (None, None)]


def test_geohash_known_values(spark):
    df = spark.createDataFrame([(57.64911, 10.40744), (40.7128, -74.006), (90.0, 180.0)], "lat double, lon double")
    rows = [r[0] for r in df.select(G.geohash("lat", "lon", 11)).collect()]
    assert rows[0] == "u4pruydqqvj" and rows[1].startswith("dr5reg") and rows[2] == "z" * 11


def bisect_geohash(lat, lon, precision):
    box, bits, even = {"lat": [-90.0, 90.0], "lon": [-180.0, 180.0]}, [], True
    while len(bits) < precision * 5:
        axis, value = ("lon", lon) if even else ("lat", lat)
        mid = sum(box[axis]) / 2
        bits.append(int(value >= mid))
        box[axis][0 if value >= mid else 1] = mid
        even = not even
    return "".join(G.BASE32[int("".join(map(str, bits[i : i + 5])), 2)] for i in range(0, len(bits), 5))


def test_geohash_against_bisection(spark):
    points = [((i * 37 % 1800) / 10 - 90 + 0.0137, (i * 91 % 3600) / 10 - 180 + 0.0219) for i in range(300)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for r in df.select("lat", "lon", G.geohash("lat", "lon", 10).alias("a"), G.geohash("lat", "lon", 15).alias("b")).collect():
        assert r["a"] == bisect_geohash(r["lat"], r["lon"], 10)
        assert r["b"] == bisect_geohash(r["lat"], r["lon"], 15)


def test_distance(spark):
    d = one(spark, G.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), G.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert d[0] == pytest.approx(G.METRES_PER_DEGREE) and d[1] == pytest.approx(G.METRES_PER_DEGREE * 180)
    missing = one(spark, G.distance_m(F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(1.0)))
    assert missing == (None,)


def test_texts_of_points_and_lines(spark):
    text, back = one(spark, G.wkt_point(F.lit(-6.2), F.lit(106.8)), G.parse_wkt_point(F.lit("POINT(106.8 -6.2)")))
    assert text == "POINT(106.800000 -6.200000)" and tuple(back) == (-6.2, 106.8)
    points = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((1.5, 2.5), (3.0, 4.0))])
    line, parsed, wkt = one(spark, G.geojson_line(points), G.parse_geojson_line(G.geojson_line(points)), G.wkt_line(points, 1))
    assert json.loads(line) == {"type": "LineString", "coordinates": [[2.5, 1.5], [4.0, 3.0]]}
    assert [tuple(p) for p in parsed] == [(1.5, 2.5), (3.0, 4.0)] and wkt == "LINESTRING(2.5 1.5, 4.0 3.0)"
    assert one(spark, G.route_number(F.lit("12.5 km")), G.route_number(F.lit("none"))) == (12.5, None)


def test_principals(spark):
    members = ["user:a@x", "allUsers", "bare", "group:a:b"]
    df = spark.createDataFrame([(m,) for m in members], "m string")
    assert [r[0] for r in df.select(PR.member_type("m")).collect()] == ["user", "specialGroup", "unknown", "group"]
    path = F.lit("//bigquery.googleapis.com/projects/p/datasets/d/tables/t")
    assert one(spark, *[PR.path_part(path, s) for s in ("projects", "datasets", "tables", "folders")]) == ("p", "d", "t", None)
    acl = [("userByEmail", "a@x"), ("iamMember", "serviceAccount:s@x"), ("view", "p.d.v"), ("odd", "o")]
    df = spark.createDataFrame(acl, "t string, i string")
    rows = [tuple(r) for r in df.select(PR.acl_member("t", "i"), PR.acl_member_type("t", "i")).collect()]
    assert rows == [("user:a@x", "user"), ("serviceAccount:s@x", "serviceAccount"), ("view:p.d.v", "authorizedView"), ("odd:o", "odd")]


def test_sql_scores(spark):
    simple = "SELECT a FROM t WHERE b = 1"
    heavy = "SELECT CASE WHEN a THEN 1 END, ROW_NUMBER() OVER (PARTITION BY b), SUM(c) FROM t JOIN u JOIN v WHERE x"
    df = spark.createDataFrame([(simple,), (heavy,)], "s string").select(PR.pattern_score("s").alias("n"))
    rows = [tuple(r) for r in df.select("n", PR.complexity(F.col("n"))).collect()]
    assert rows == [(1, "LOW"), (1 + 2 + 3 + 4 + 5 + 8, "MEDIUM")]
