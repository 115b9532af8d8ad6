"""Place analytics: customers stand for places, suppliers for our own branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import values as V
from ..operators import places as P
from ..operators import spatial as SP
from .mapping import LAT, LON, lat_of, lon_of
from .registry import Tables, query, with_sql

KINDS = ["bank", "atm", "restaurant", "cafe", "store", "shopping_mall", "finance"]
SECOND = ["finance", "store", "point_of_interest", "atm"]
CITIES = ["Jakarta Selatan", "Surabaya", "Bandung", "Medan", "Denpasar", "Makassar"]
LEVELS = list(P.PRICE_RANK)
REGION = "Jakarta"


def _pick(values, i):
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# name -> (divisor: true when k % divisor == 0, divisor of missing values)
FLAGS = {
    "wheelchair_entrance": (3, 5),
    "wheelchair_parking": (4, 7),
    "wheelchair_restroom": (5, 6),
    "accepts_credit_cards": (2, 9),
    "accepts_debit_cards": (3, 8),
    "accepts_nfc": (4, 5),
    "accepts_cash_only": (9, 4),
    "delivery": (2, 7),
    "takeout": (3, 11),
    "dine_in": (4, 9),
    "outdoor_seating": (6, 5),
    "reservable": (7, 3),
}


def places(t: Tables):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    flags = {f: F.when(k % gap != 1, k % div == 0) for f, (div, gap) in FLAGS.items()}

    def time(hour):
        return F.format_string("%02d:00:00", hour.cast("int"))

    def slot(start, end):
        return F.array(F.struct(start.alias("start_time"), end.alias("end_time")))

    empty = F.array().cast("array<struct<start_time:string,end_time:string>>")
    monday = F.when(k % 8 != 0, slot(time(F.lit(6) + k % 5), time(F.lit(14) + k % 7)))
    return t.customer.select(
        k.alias("id"),
        _pick(KINDS, k % 7).alias("primary_type"),
        F.array(_pick(KINDS, k % 7), _pick(SECOND, V.div(k, 7) % 4)).alias("types"),
        F.when(k % 11 != 0, F.lit(2.0) + k * 13 % 31 / F.lit(10.0)).alias("rating"),
        (k * 17 % 500).alias("user_rating_count"),
        _pick(LEVELS + [None], k % 6).alias("price_level"),
        F.when(k % 13 == 0, "CLOSED_TEMPORARILY").otherwise("OPERATIONAL").alias("business_status"),
        F.when(n % 5 == 0, "Jawa Barat").otherwise("DKI Jakarta").alias("admin1"),
        F.when(n != 24, F.concat(F.lit("Kecamatan "), n.cast("string"))).alias("district"),
        F.array(_pick(CITIES, n % 6), F.lit("Indonesia")).alias("locality_names"),
        F.array((F.lit(10000) + n * 4 + k % 4).cast("string")).alias("postal_code_names"),
        lat_of(k).alias("lat"),
        lon_of(k).alias("lon"),
        F.struct(
            monday.alias("monday"),
            F.when(k % 3 == 0, slot(time(F.lit(9)), time(F.lit(13)))).otherwise(empty).alias("saturday"),
            F.when(k % 6 == 0, slot(time(F.lit(10)), time(F.lit(12)))).otherwise(empty).alias("sunday"),
        ).alias("hours"),
        *[c.alias(f) for f, c in flags.items()],
    )


def branches(t: Tables):
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("branch_id"),
        F.col("s_name").alias("branch_name"),
        (F.lit(10000) + F.col("s_nationkey") * 4 + k % 4).cast("string").alias("postal_code"),
        (F.lit(3.0) + k % 20 / F.lit(10.0)).alias("own_rating"),
        lat_of(k * 31).alias("lat"),
        lon_of(k * 31).alias("lon"),
    )


PLACES = (
    "places",
    f"""SELECT c_custkey AS k, c_nationkey AS n, {_list(KINDS)}[k % 7 + 1] AS primary_type,
  [{_list(KINDS)}[k % 7 + 1], {_list(SECOND)}[k // 7 % 4 + 1]] AS types,
  CASE WHEN k % 11 <> 0 THEN 2::DOUBLE + k * 13 % 31 / 10::DOUBLE END AS rating, k * 17 % 500 AS user_rating_count,
  {_list(LEVELS)}[k % 6 + 1] AS price_level,
  CASE WHEN k % 13 = 0 THEN 'CLOSED_TEMPORARILY' ELSE 'OPERATIONAL' END AS business_status,
  CASE WHEN n % 5 = 0 THEN 'Jawa Barat' ELSE 'DKI Jakarta' END AS admin1,
  CASE WHEN n <> 24 THEN 'Kecamatan ' || n END AS district, {_list(CITIES)}[n % 6 + 1] AS locality,
  CAST(10000 + n * 4 + k % 4 AS VARCHAR) AS postal_code, {LAT.format(k='k')} AS lat, {LON.format(k='k')} AS lon,
  list_contains(types, 'bank') AS is_bank, list_contains(types, 'atm') AS is_atm,
  list_contains(types, 'finance') AS is_finance, """
    + ", ".join(f"CASE WHEN k % {gap} <> 1 THEN k % {div} = 0 END AS {f}" for f, (div, gap) in FLAGS.items())
    + " FROM customer",
)
BRANCHES = (
    "branches",
    f"""SELECT s_suppkey AS branch_id, s_name AS branch_name, CAST(10000 + s_nationkey * 4 + s_suppkey % 4 AS VARCHAR)
  AS postal_code, 3::DOUBLE + s_suppkey % 20 / 10::DOUBLE AS own_rating, {LAT.format(k='(s_suppkey * 31)')} AS lat,
  {LON.format(k='(s_suppkey * 31)')} AS lon FROM supplier""",
)
OPEN = "business_status = 'OPERATIONAL'"
LOCAL = f"{OPEN} AND admin1 LIKE '%{REGION}%'"
FIN = "(is_bank OR is_atm OR is_finance)"
RATING = "SUM(CAST(rating * 10 AS BIGINT)) / COUNT(rating) / 10"
AVG_RATING = f"ROUND({RATING}, 2) AS avg_rating"
AVG_REVIEWS = "ROUND(SUM(user_rating_count) / COUNT(*), 1) AS avg_reviews"


def n_if(cond: str, name: str) -> str:
    return f"COUNT(*) FILTER (WHERE {cond}) AS {name}"


def pct(cond: str, name: str) -> str:
    return f"ROUND(COUNT(*) FILTER (WHERE {cond})::DOUBLE / COUNT(*) * 100, 1) AS {name}"


def local(t: Tables, *kinds: str):
    return P.operational(places(t), REGION, kinds or None)


@query(
    "market_overview",
    with_sql(
        PLACES,
        body=f"""SELECT primary_type, COUNT(*) AS location_count, {AVG_RATING}, {AVG_REVIEWS},
  {n_if('rating >= 4.5', 'excellent_rated')}, {pct('rating >= 4.5', 'excellent_pct')}
FROM places WHERE {LOCAL} AND {FIN} GROUP BY primary_type HAVING COUNT(*) >= 5""",
    ),
)
def _(t):
    return P.market_overview(local(t, "bank", "atm", "finance"))


BAND = """CASE WHEN rating >= 4.5 THEN 'Excellent (4.5+)' WHEN rating >= 4 THEN 'Good (4.0-4.5)'
    WHEN rating >= 3.5 THEN 'Average (3.5-4.0)' ELSE 'Below Average (<3.5)' END"""


@query(
    "rating_bands",
    with_sql(
        PLACES,
        body=f"""SELECT {BAND} AS rating_category, COUNT(*) AS place_count, {AVG_REVIEWS},
  {n_if('wheelchair_entrance', 'accessible_locations')}, {pct('wheelchair_entrance', 'accessibility_pct')},
  {n_if('accepts_credit_cards', 'card_payment_locations')}, {n_if('accepts_nfc', 'nfc_payment_locations')}
FROM places WHERE {LOCAL} AND is_bank AND rating IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 5""",
    ),
)
def _(t):
    return P.rating_bands(local(t, "bank"))


@query(
    "regional_benchmark",
    with_sql(
        PLACES,
        body=f"""SELECT district, COUNT(*) AS place_count, {AVG_RATING}, {AVG_REVIEWS},
  {n_if('rating >= 4.5', 'excellent_count')}, {pct('rating >= 4.5', 'excellent_pct')},
  {n_if('wheelchair_entrance', 'accessible_count')}
FROM places WHERE {LOCAL} AND is_bank AND district IS NOT NULL AND rating IS NOT NULL GROUP BY district
HAVING COUNT(*) >= 5 ORDER BY avg_rating DESC, district LIMIT 15""",
    ),
)
def _(t):
    return P.regional_benchmark(local(t, "bank"))


@query(
    "competitor_by_district",
    with_sql(
        PLACES,
        body=f"""SELECT district, COUNT(*) AS total_places, {n_if('rating >= 4.5', 'excellent_places')}, {AVG_RATING},
  {AVG_REVIEWS} FROM places WHERE {LOCAL} AND list_contains(types, 'cafe') AND district IS NOT NULL GROUP BY district
HAVING COUNT(*) >= 5 ORDER BY total_places DESC, district LIMIT 20""",
    ),
)
def _(t):
    return P.competitor_by_district(local(t, "cafe"))


@query(
    "premium_by_district",
    with_sql(
        PLACES,
        body=f"""SELECT district, COUNT(*) AS place_count, {AVG_RATING}, {AVG_REVIEWS},
  {n_if("price_level IN ('PRICE_LEVEL_EXPENSIVE', 'PRICE_LEVEL_VERY_EXPENSIVE')", 'premium_count')},
  {pct('rating >= 4.5', 'excellent_pct')}
FROM places WHERE {LOCAL} AND district IS NOT NULL AND rating IS NOT NULL GROUP BY district
HAVING COUNT(*) >= 10 ORDER BY avg_rating DESC, district LIMIT 15""",
    ),
)
def _(t):
    return P.premium_by_district(local(t))


def _access(by: str, least: int, cond: str) -> str:
    return f"""SELECT {by}, COUNT(*) AS total_count, {n_if('wheelchair_entrance', 'accessible_entrance')},
  {n_if('wheelchair_parking', 'accessible_parking')}, {n_if('wheelchair_restroom', 'accessible_restroom')},
  {pct('wheelchair_entrance', 'entrance_pct')}
FROM places WHERE {cond} AND {by} IS NOT NULL GROUP BY {by} HAVING COUNT(*) >= {least}
ORDER BY total_count DESC, {by} LIMIT 15"""


@query("accessibility", with_sql(PLACES, body=_access("primary_type", 10, LOCAL)))
def _(t):
    return P.accessibility(local(t), "primary_type", 10)


@query("accessibility_by_district", with_sql(PLACES, body=_access("district", 5, f"{LOCAL} AND is_bank")))
def _(t):
    return P.accessibility(local(t, "bank"), "district", 5)


@query(
    "place_type_distribution",
    with_sql(
        PLACES,
        body=f"""SELECT primary_type, COUNT(*) AS count, {AVG_RATING}, {n_if('rating >= 4.5', 'excellent_count')}
FROM places WHERE {LOCAL} GROUP BY primary_type HAVING COUNT(*) >= 5 ORDER BY count DESC, primary_type LIMIT 20""",
    ),
)
def _(t):
    return P.place_type_distribution(local(t))


@query(
    "price_level",
    with_sql(
        PLACES,
        body=f"""SELECT price_level, COUNT(*) AS place_count, {AVG_RATING}, {AVG_REVIEWS} FROM places
WHERE {LOCAL} AND list_contains(types, 'restaurant') AND price_level IS NOT NULL GROUP BY price_level
HAVING COUNT(*) >= 5""",
    ),
)
def _(t):
    return P.price_level(local(t, "restaurant"))


@query(
    "satisfaction",
    with_sql(
        PLACES,
        body=f"""SELECT primary_type, COUNT(*) AS location_count, {AVG_RATING}, {AVG_REVIEWS},
  {n_if('rating >= 4.5', 'excellent_count')}, {n_if('rating < 3.5', 'poor_count')},
  {pct('rating >= 4.5', 'excellent_pct')}, {pct('rating < 3.5', 'poor_pct')}
FROM places WHERE {LOCAL} AND {FIN} AND rating IS NOT NULL GROUP BY primary_type HAVING COUNT(*) >= 5""",
    ),
)
def _(t):
    return P.satisfaction(local(t, "bank", "atm", "finance"))


def _adopt(flags: dict, shares: list[str], cond: str) -> str:
    cols = [n_if(c, n) for n, c in flags.items()] + [pct(flags[n], f"{n}_pct") for n in shares]
    return f"SELECT COUNT(*) AS total_locations, {', '.join(cols)} FROM places WHERE {cond} HAVING COUNT(*) >= 5"


@query(
    "payment_adoption",
    with_sql(
        PLACES,
        body=_adopt(P.PAYMENT_FLAGS, ["nfc_payment", "credit_cards", "debit_cards"], f"{LOCAL} AND (is_bank OR is_atm)"),
    ),
)
def _(t):
    return P.payment_adoption(local(t, "bank", "atm"))


@query(
    "service_features",
    with_sql(
        PLACES,
        body=_adopt(P.SERVICE_FLAGS, ["delivery", "takeout"], f"{LOCAL} AND list_contains(types, 'restaurant')"),
    ),
)
def _(t):
    return P.service_features(local(t, "restaurant"))


HOURS = f"""SELECT COUNT(*) AS total_places, {n_if('k % 3 = 0', 'saturday_service')}, {n_if('k % 6 = 0', 'sunday_service')},
  {n_if('k % 8 <> 0 AND 6 + k % 5 <= 8', 'early_opening')}, {n_if('k % 8 <> 0 AND 14 + k % 7 >= 17', 'late_closing')},
  {n_if('k % 8 <> 0 AND 6 + k % 5 <= 9 AND 14 + k % 7 >= 17', 'open_business_hours')},
  {pct('k % 3 = 0', 'saturday_pct')}, {pct('k % 6 = 0', 'sunday_pct')}
FROM places WHERE {LOCAL} AND is_bank HAVING COUNT(*) >= 5"""


@query("opening_hours", with_sql(PLACES, body=HOURS))
def _(t):
    return P.opening_hours(local(t, "bank"))


@query(
    "fn_exists_array",
    with_sql(
        PLACES,
        body="SELECT k AS id, k % 3 = 0 AS saturday, k % 6 = 0 AS sunday FROM places",
    ),
)
def _(t):
    return places(t).select("id", P.open_on("saturday").alias("saturday"), P.open_on("sunday").alias("sunday"))


@query(
    "city_compare",
    with_sql(
        PLACES,
        body=f"""SELECT locality, COUNT(*) AS total_places, {AVG_RATING}, {AVG_REVIEWS}, {n_if('is_bank', 'bank_count')},
  {n_if('is_atm', 'atm_count')}, {pct('rating >= 4.5', 'excellent_pct')},
  ROUND(COUNT(*) FILTER (WHERE is_atm)::DOUBLE / NULLIF(COUNT(*) FILTER (WHERE is_bank), 0), 2) AS atm_per_bank
FROM places WHERE {OPEN} AND (is_bank OR is_atm)
  AND locality IN ('Jakarta Selatan', 'Surabaya', 'Bandung', 'Medan', 'Makassar') GROUP BY locality
HAVING COUNT(*) >= 5""",
    ),
)
def _(t):
    cities = ["Jakarta Selatan", "Surabaya", "Bandung", "Medan", "Makassar"]
    return P.city_compare(P.operational(places(t), None, ["bank", "atm"]), cities)


POSTAL = f"""SELECT postal_code, COUNT(*) AS total_financial, {n_if('is_bank', 'banks')}, {n_if('is_atm', 'atms')},
  {n_if('is_finance', 'finance_companies')}, {AVG_RATING}, {AVG_REVIEWS}
FROM places WHERE {LOCAL} AND {FIN} GROUP BY postal_code HAVING COUNT(*) >= 5"""


@query(
    "postal_market",
    with_sql(PLACES, body=f"{POSTAL} ORDER BY total_financial DESC, postal_code LIMIT 20"),
)
def _(t):
    return P.postal_market(local(t, "bank", "atm", "finance"))


@query(
    "postal_share",
    with_sql(
        PLACES,
        BRANCHES,
        ("market", POSTAL),
        ("own", "SELECT postal_code, COUNT(*) AS c FROM branches GROUP BY ALL"),
        (
            "j",
            """SELECT m.postal_code, COALESCE(c, 0) AS own_count, total_financial, banks, atms,
  COALESCE(c, 0)::DOUBLE / total_financial AS r FROM market m LEFT JOIN own o ON m.postal_code = o.postal_code""",
        ),
        body="""SELECT postal_code, own_count, total_financial, banks, atms, ROUND(r * 100, 2) AS market_share_pct,
  CASE WHEN own_count = 0 THEN 'No Presence' WHEN r < 0.05 THEN 'Low (<5%)' WHEN r < 0.15 THEN 'Medium (5-15%)'
    ELSE 'High (>15%)' END AS market_position FROM j""",
    ),
)
def _(t):
    return P.postal_share(local(t, "bank", "atm", "finance"), branches(t))


# --- predicates --------------------------------------------------------------------------


@query("bbox_filter", with_sql(PLACES, body=f"SELECT k AS id, lat, lon FROM places WHERE lat BETWEEN -6.3 AND -6.1 AND lon BETWEEN 106.7 AND 107.0 AND {OPEN}"))
def _(t):
    inside = F.col("lat").between(-6.3, -6.1) & F.col("lon").between(106.7, 107.0)
    return P.operational(places(t)).filter(inside).select("id", "lat", "lon")


@query(
    "array_membership",
    with_sql(PLACES, body=f"SELECT k AS id, primary_type FROM places WHERE {FIN} AND NOT list_contains(types, 'store')"),
)
def _(t):
    kept = places(t).filter(V.has_any("types", ["bank", "atm", "finance"]) & ~F.array_contains("types", "store"))
    return kept.select("id", "primary_type")


@query(
    "like_region_filter",
    with_sql(PLACES, body="SELECT admin1, district, COUNT(*) AS n FROM places WHERE admin1 LIKE '%Jakarta%' GROUP BY ALL"),
)
def _(t):
    return places(t).filter(F.col("admin1").like("%Jakarta%")).groupBy("admin1", "district").agg(F.count("*").alias("n"))


@query(
    "null_guard_ratio",
    with_sql(
        PLACES,
        body="""SELECT postal_code, ROUND(COUNT(*) FILTER (WHERE is_atm)::DOUBLE
    / NULLIF(COUNT(*) FILTER (WHERE is_bank AND rating > 4.5), 0), 4) AS ratio FROM places GROUP BY ALL""",
    ),
)
def _(t):
    exploded = places(t).withColumn("postal_code", F.explode("postal_code_names"))
    banks = F.count_if(P.is_kind("bank") & (F.col("rating") > 4.5))
    return exploded.groupBy("postal_code").agg(F.round(V.safe_divide(P.count_kind("atm"), banks), 4).alias("ratio"))


@query("fn_safe_divide", "SELECT p_partkey, p_retailprice / NULLIF(p_size - 25, 0) AS ratio FROM part")
def _(t):
    return t.part.select("p_partkey", V.safe_divide(F.col("p_retailprice"), F.col("p_size") - 25).alias("ratio"))


@query(
    "thresholded_agg",
    with_sql(
        PLACES,
        body="""SELECT locality, primary_type, COUNT(*) AS n FROM places GROUP BY ALL HAVING COUNT(*) >= 40""",
    ),
)
def _(t):
    exploded = places(t).withColumn("locality", F.get("locality_names", F.lit(0)))
    return P.thresholded(exploded, ["locality", "primary_type"], 40, n=F.count("*"))


# --- grid --------------------------------------------------------------------------------

GRID = 0.05
CELLS = (
    "cells",
    f"""SELECT CAST(round_even(lat / {GRID}::DOUBLE, 0) AS BIGINT) AS cell_lat,
  CAST(round_even(lon / {GRID}::DOUBLE, 0) AS BIGINT) AS cell_lon, * FROM places WHERE {LOCAL}""",
)
LABEL = f"printf('POINT(%.2f %.2f)', cell_lon * {GRID}::DOUBLE, cell_lat * {GRID}::DOUBLE)"
ACTIVITY = (
    "activity",
    f"""SELECT cell_lat, cell_lon, {LABEL} AS geo_txt, COUNT(*) AS total_businesses,
  {n_if("list_has_any(types, ['shopping_mall', 'store', 'restaurant', 'cafe'])", 'commercial_count')},
  {n_if('is_bank OR is_atm', 'financial_count')}, {n_if('is_bank', 'bank_count')}, {n_if('is_atm', 'atm_count')}
FROM cells GROUP BY cell_lat, cell_lon HAVING COUNT(*) >= 5""",
)
WHITE = (
    "white",
    """SELECT geo_txt, cell_lat, cell_lon, commercial_count, financial_count,
  ROUND(commercial_count::DOUBLE / NULLIF(financial_count, 0), 2) AS opportunity_score
FROM activity WHERE financial_count < 10 AND commercial_count > 3""",
)
TOP = "ORDER BY opportunity_score DESC NULLS LAST, cell_lat, cell_lon LIMIT 20"


@query(
    "density_grid",
    with_sql(
        PLACES,
        CELLS,
        body=f"""SELECT cell_lat, cell_lon, {LABEL} AS geo_txt, COUNT(*) AS total_count, {n_if('is_bank', 'bank_count')},
  {n_if('is_atm', 'atm_count')}, {n_if('is_finance', 'finance_count')}, {AVG_RATING}
FROM cells GROUP BY cell_lat, cell_lon HAVING COUNT(*) >= 5""",
    ),
)
def _(t):
    return P.density_grid(local(t), GRID)


@query("fn_snap_grid", with_sql(PLACES, CELLS, body=f"SELECT k AS id, cell_lat, cell_lon, {LABEL} AS label FROM cells"))
def _(t):
    return P.with_cell(local(t), GRID).select("id", "cell_lat", "cell_lon", G.cell_label("cell_lat", "cell_lon", GRID).alias("label"))


@query("white_space", with_sql(PLACES, CELLS, ACTIVITY, WHITE, body=f"SELECT * FROM white {TOP}"))
def _(t):
    return P.white_space(P.activity(local(t), GRID), more_than=3)


@query(
    "white_space_level",
    with_sql(
        PLACES,
        CELLS,
        ACTIVITY,
        body="""SELECT geo_txt, commercial_count, bank_count, atm_count,
  ROUND(commercial_count::DOUBLE / NULLIF(bank_count, 0), 2) AS opportunity_score,
  CASE WHEN bank_count = 0 THEN 'No Banks' WHEN bank_count < 3 THEN 'Low Competition'
    WHEN bank_count < 10 THEN 'Moderate Competition' ELSE 'High Competition' END AS competition_level
FROM activity WHERE commercial_count > 4 AND bank_count < 10
ORDER BY opportunity_score DESC NULLS LAST, geo_txt LIMIT 20""",
    ),
)
def _(t):
    return P.white_space_level(P.activity(local(t), GRID), more_than=4)


COVERED = (
    "covered",
    f"""SELECT DISTINCT CAST(round_even(lat / {GRID}::DOUBLE, 0) AS BIGINT) AS cell_lat,
  CAST(round_even(lon / {GRID}::DOUBLE, 0) AS BIGINT) AS cell_lon FROM branches""",
)


@query(
    "uncovered_cells",
    with_sql(
        PLACES,
        BRANCHES,
        CELLS,
        ACTIVITY,
        WHITE,
        COVERED,
        body=f"SELECT white.* FROM white ANTI JOIN covered USING (cell_lat, cell_lon) {TOP}",
    ),
)
def _(t):
    white = P.white_space(P.activity(local(t), GRID), more_than=3, k=None)
    return P.uncovered_cells(white, branches(t), GRID)


@query(
    "anti_left_isnull",
    with_sql(
        PLACES,
        BRANCHES,
        CELLS,
        COVERED,
        body="""SELECT c.cell_lat, c.cell_lon, COUNT(*) AS n FROM cells c LEFT JOIN covered v
  ON c.cell_lat = v.cell_lat AND c.cell_lon = v.cell_lon WHERE v.cell_lat IS NULL GROUP BY ALL""",
    ),
)
def _(t):
    covered = P.with_cell(branches(t), GRID).select("cell_lat", "cell_lon").distinct()
    counts = P.with_cell(local(t), GRID).groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("n"))
    return counts.join(covered, ["cell_lat", "cell_lon"], "left_anti")


# --- distance ----------------------------------------------------------------------------


def dist(a: str, b: str) -> str:
    return f"""2 * {G.EARTH_RADIUS_M} * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2)
    + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"""


NEAR = (
    "near",
    f"""SELECT b.branch_id, b.branch_name, b.own_rating, p.* FROM branches b JOIN places p
  ON {dist('b', 'p')} <= 5000 WHERE {OPEN}""",
)


@query(
    "radius_join",
    with_sql(
        PLACES,
        BRANCHES,
        NEAR,
        body=f"""SELECT branch_id, branch_name, COUNT(*) AS competitors, {n_if('is_atm', 'competitor_atms')},
  {n_if('is_bank', 'competitor_banks')}, ROUND({RATING}, 2) AS avg_competitor_rating,
  ROUND(SUM(user_rating_count) / COUNT(*), 1) AS avg_competitor_reviews
FROM near WHERE is_bank OR is_atm GROUP BY branch_id, branch_name HAVING COUNT(*) >= 5""",
    ),
)
def _(t):
    rivals = P.operational(places(t), None, ["bank", "atm"])
    return SP.competitors_within(branches(t), rivals, 5000, ["branch_name"])


@query(
    "radius_benchmark",
    with_sql(
        PLACES,
        BRANCHES,
        NEAR,
        (
            "m",
            f"""SELECT branch_id, branch_name, own_rating, ROUND({RATING}, 2) AS avg_competitor_rating,
  COUNT(*) AS nearby_competitors FROM near WHERE is_bank AND rating IS NOT NULL
GROUP BY branch_id, branch_name, own_rating HAVING COUNT(*) >= 5""",
        ),
        body="""SELECT *, ROUND(own_rating - avg_competitor_rating, 2) AS rating_advantage,
  CASE WHEN own_rating > avg_competitor_rating + 0.3::DOUBLE THEN 'Outperforming'
    WHEN own_rating < avg_competitor_rating - 0.3::DOUBLE THEN 'Underperforming' ELSE 'Competitive' END
    AS performance_status FROM m""",
    ),
)
def _(t):
    return SP.branch_benchmark(branches(t), P.operational(places(t), None, ["bank"]), 5000)


@query(
    "fn_wkt_point",
    with_sql(
        PLACES,
        body="""SELECT k AS id, printf('POINT(%.6f %.6f)', lon, lat) AS wkt, CAST(printf('%.6f', lat) AS DOUBLE) AS lat,
  CAST(printf('%.6f', lon) AS DOUBLE) AS lon FROM places""",
    ),
)
def _(t):
    texts = places(t).select("id", G.wkt_point(F.col("lat"), F.col("lon")).alias("wkt"))
    parsed = G.parse_wkt_point("wkt")
    return texts.select("id", "wkt", parsed["lat"].alias("lat"), parsed["lon"].alias("lon"))


@query(
    "geo_distribution",
    with_sql(
        PLACES,
        BRANCHES,
        body="""SELECT 'customer' AS kind, k AS id, lat, lon FROM places
UNION ALL SELECT 'center', branch_id, lat, lon FROM branches""",
    ),
)
def _(t):
    people = places(t).select(F.lit("customer").alias("kind"), "id", "lat", "lon")
    own = branches(t).select(F.lit("center").alias("kind"), F.col("branch_id").alias("id"), "lat", "lon")
    return people.unionByName(own)
