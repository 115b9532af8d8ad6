"""Place statistics with a privacy threshold, by type, district, postal code and grid cell.

Input columns follow the place record: ``types``, ``primary_type``, ``rating``,
``user_rating_count``, ``locality_names``, ``postal_code_names`` and so on, with
``district`` for the third administrative level and ``lat``/``lon`` in degrees.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_label, snap
from ..functions.values import any_of, first_match, fixed_avg, has_any, pct, safe_divide
from .dedup import top_k

# Fixed values.
THRESHOLD = 5
EXCELLENT, POOR = 4.5, 3.5
COMMERCIAL = ["shopping_mall", "store", "restaurant", "cafe"]
FINANCIAL = ["bank", "atm"]
PRICE_RANK = {
    "PRICE_LEVEL_FREE": 1,
    "PRICE_LEVEL_INEXPENSIVE": 2,
    "PRICE_LEVEL_MODERATE": 3,
    "PRICE_LEVEL_EXPENSIVE": 4,
    "PRICE_LEVEL_VERY_EXPENSIVE": 5,
}
PREMIUM_LEVELS = ["PRICE_LEVEL_EXPENSIVE", "PRICE_LEVEL_VERY_EXPENSIVE"]
CELL = 0.01


def thresholded(df: DataFrame, by: Sequence[Column | str], threshold: int = THRESHOLD, **aggs: Column) -> DataFrame:
    """Group and keep only groups with at least ``threshold`` contributing rows.

    Apply it to the rows themselves, before any ordering or limit, and not again to its own
    results.
    """
    grouped = df.groupBy(*by) if by else df.groupBy()
    named = [c.alias(n) for n, c in aggs.items()]
    return grouped.agg(*named, F.count("*").alias("_rows")).filter(F.col("_rows") >= threshold).drop("_rows")


def operational(places: DataFrame, region: str | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """Open places, optionally of a region (part of its name) and of some types."""
    out = places.filter(F.col("business_status") == "OPERATIONAL")
    if region is not None:
        out = out.filter(F.col("admin1").contains(region))
    if kinds is not None:
        out = out.filter(has_any("types", kinds))
    return out


def avg_rating(digits: int = 2) -> Column:
    return F.round(fixed_avg("rating", 1), digits)


def avg_reviews(digits: int = 1) -> Column:
    return F.round(fixed_avg("user_rating_count", 0), digits)


def excellent() -> Column:
    return F.count_if(F.col("rating") >= EXCELLENT)


def is_kind(*kinds: str) -> Column:
    return any_of([F.array_contains("types", k) for k in kinds])


def count_kind(*kinds: str) -> Column:
    return F.count_if(is_kind(*kinds))


def share(part: Column) -> Column:
    return pct(part, F.count("*"))


def yes(column: str) -> Column:
    return F.count_if(F.col(column))


def rating_category() -> Column:
    r = F.col("rating")
    return first_match(
        [(r >= 4.5, "Excellent (4.5+)"), (r >= 4.0, "Good (4.0-4.5)"), (r >= 3.5, "Average (3.5-4.0)")],
        "Below Average (<3.5)",
    )


def market_overview(places: DataFrame) -> DataFrame:
    return thresholded(
        places,
        ["primary_type"],
        location_count=F.count("*"),
        avg_rating=avg_rating(),
        avg_reviews=avg_reviews(),
        excellent_rated=excellent(),
        excellent_pct=share(excellent()),
    ).orderBy(F.col("location_count").desc(), "primary_type")


def rating_bands(places: DataFrame) -> DataFrame:
    return thresholded(
        places.filter(F.col("rating").isNotNull()),
        [rating_category().alias("rating_category")],
        place_count=F.count("*"),
        avg_reviews=avg_reviews(),
        accessible_locations=yes("wheelchair_entrance"),
        accessibility_pct=share(yes("wheelchair_entrance")),
        card_payment_locations=yes("accepts_credit_cards"),
        nfc_payment_locations=yes("accepts_nfc"),
    ).orderBy(F.col("rating_category").desc())


def by_district(places: DataFrame, least: int, **aggs: Column) -> DataFrame:
    return thresholded(places.filter(F.col("district").isNotNull()), ["district"], max(least, THRESHOLD), **aggs)


def regional_benchmark(places: DataFrame, least: int = 5, k: int = 15) -> DataFrame:
    rows = by_district(
        places.filter(F.col("rating").isNotNull()),
        least,
        place_count=F.count("*"),
        avg_rating=avg_rating(),
        avg_reviews=avg_reviews(),
        excellent_count=excellent(),
        excellent_pct=share(excellent()),
        accessible_count=yes("wheelchair_entrance"),
    )
    return top_k(rows, k, F.col("avg_rating").desc(), "district")


def competitor_by_district(places: DataFrame, least: int = 5, k: int = 20) -> DataFrame:
    rows = by_district(
        places,
        least,
        total_places=F.count("*"),
        excellent_places=excellent(),
        avg_rating=avg_rating(),
        avg_reviews=avg_reviews(),
    )
    return top_k(rows, k, F.col("total_places").desc(), "district")


def premium_by_district(places: DataFrame, least: int = 10, k: int = 15) -> DataFrame:
    rows = by_district(
        places.filter(F.col("rating").isNotNull()),
        least,
        place_count=F.count("*"),
        avg_rating=avg_rating(),
        avg_reviews=avg_reviews(),
        premium_count=F.count_if(F.col("price_level").isin(PREMIUM_LEVELS)),
        excellent_pct=share(excellent()),
    )
    return top_k(rows, k, F.col("avg_rating").desc(), "district")


def accessibility(places: DataFrame, by: str, least: int, k: int = 15) -> DataFrame:
    rows = thresholded(
        places.filter(F.col(by).isNotNull()),
        [by],
        max(least, THRESHOLD),
        total_count=F.count("*"),
        accessible_entrance=yes("wheelchair_entrance"),
        accessible_parking=yes("wheelchair_parking"),
        accessible_restroom=yes("wheelchair_restroom"),
        entrance_pct=share(yes("wheelchair_entrance")),
    )
    return top_k(rows, k, F.col("total_count").desc(), by)


def place_type_distribution(places: DataFrame, k: int = 20) -> DataFrame:
    rows = thresholded(
        places.filter(F.col("primary_type").isNotNull()),
        ["primary_type"],
        count=F.count("*"),
        avg_rating=avg_rating(),
        excellent_count=excellent(),
    )
    return top_k(rows, k, F.col("count").desc(), "primary_type")


def price_level(places: DataFrame) -> DataFrame:
    rank = F.col("price_level")
    order = F.coalesce(*[F.when(rank == n, F.lit(r)) for n, r in PRICE_RANK.items()])
    return thresholded(
        places.filter(F.col("price_level").isNotNull()),
        ["price_level"],
        place_count=F.count("*"),
        avg_rating=avg_rating(),
        avg_reviews=avg_reviews(),
    ).orderBy(order)


def satisfaction(places: DataFrame) -> DataFrame:
    poor = F.count_if(F.col("rating") < POOR)
    return thresholded(
        places.filter(F.col("rating").isNotNull()),
        ["primary_type"],
        location_count=F.count("*"),
        avg_rating=avg_rating(),
        avg_reviews=avg_reviews(),
        excellent_count=excellent(),
        poor_count=poor,
        excellent_pct=share(excellent()),
        poor_pct=share(poor),
    ).orderBy(F.col("location_count").desc(), "primary_type")


def adoption(places: DataFrame, flags: Mapping[str, str], shares: Sequence[str]) -> DataFrame:
    """Counts of boolean columns over all rows (result name -> column) and shares of some."""
    counts = {name: yes(column) for name, column in flags.items()}
    rates = {f"{name}_pct": share(yes(flags[name])) for name in shares}
    return thresholded(places, [], total_locations=F.count("*"), **counts, **rates)


PAYMENT_FLAGS = {
    "credit_cards": "accepts_credit_cards",
    "debit_cards": "accepts_debit_cards",
    "nfc_payment": "accepts_nfc",
    "cash_only": "accepts_cash_only",
}
SERVICE_FLAGS = {
    "delivery": "delivery",
    "takeout": "takeout",
    "dine_in": "dine_in",
    "outdoor_seating": "outdoor_seating",
    "reservable": "reservable",
}


def payment_adoption(places: DataFrame) -> DataFrame:
    return adoption(places, PAYMENT_FLAGS, ["nfc_payment", "credit_cards", "debit_cards"])


def service_features(places: DataFrame) -> DataFrame:
    return adoption(places, SERVICE_FLAGS, ["delivery", "takeout"])


def open_on(day: str) -> Column:
    return F.exists(F.col("hours")[day], lambda h: h["start_time"].isNotNull())


def opening_hours(places: DataFrame) -> DataFrame:
    """Weekend, early and late service and a full office day on Monday.

    Times are ``HH:mm:ss`` text, which compares in time order (the TIME type is off by default).
    """
    monday = F.col("hours")["monday"]
    early = F.exists(monday, lambda h: h["start_time"] <= F.lit("08:00:00"))
    late = F.exists(monday, lambda h: h["end_time"] >= F.lit("17:00:00"))
    office = F.exists(monday, lambda h: (h["start_time"] <= F.lit("09:00:00")) & (h["end_time"] >= F.lit("17:00:00")))
    return thresholded(
        places,
        [],
        total_places=F.count("*"),
        saturday_service=F.count_if(open_on("saturday")),
        sunday_service=F.count_if(open_on("sunday")),
        early_opening=F.count_if(early),
        late_closing=F.count_if(late),
        open_business_hours=F.count_if(office),
        saturday_pct=share(F.count_if(open_on("saturday"))),
        sunday_pct=share(F.count_if(open_on("sunday"))),
    )


def city_compare(places: DataFrame, cities: Sequence[str]) -> DataFrame:
    """Totals, ratings, excellent share and ATMs per bank for the named localities."""
    per_city = places.withColumn("locality", F.explode("locality_names")).filter(F.col("locality").isin(list(cities)))
    return (
        thresholded(
            per_city,
            ["locality"],
            total_places=F.count("*"),
            avg_rating=avg_rating(),
            avg_reviews=avg_reviews(),
            bank_count=count_kind("bank"),
            atm_count=count_kind("atm"),
            excellent_pct=share(excellent()),
        )
        .withColumn("atm_per_bank", F.round(safe_divide(F.col("atm_count"), F.col("bank_count")), 2))
        .orderBy(F.col("total_places").desc(), "locality")
    )


def postal_market(places: DataFrame, least: int = 5, k: int | None = 20) -> DataFrame:
    rows = thresholded(
        places.withColumn("postal_code", F.explode("postal_code_names")),
        ["postal_code"],
        max(least, THRESHOLD),
        total_financial=F.count("*"),
        banks=count_kind("bank"),
        atms=count_kind("atm"),
        finance_companies=count_kind("finance"),
        avg_rating=avg_rating(),
        avg_reviews=avg_reviews(),
    )
    return rows if k is None else top_k(rows, k, F.col("total_financial").desc(), "postal_code")


def postal_share(places: DataFrame, branches: DataFrame, least: int = 5) -> DataFrame:
    """Own branches against the market per postal code, with a position label."""
    market = postal_market(places, least, None).select("postal_code", "total_financial", "banks", "atms")
    own = branches.groupBy("postal_code").agg(F.count("*").alias("own_locations"))
    ratio = F.col("own_count") / F.col("total_financial")
    position = first_match(
        [(F.col("own_count") == 0, "No Presence"), (ratio < 0.05, "Low (<5%)"), (ratio < 0.15, "Medium (5-15%)")],
        "High (>15%)",
    )
    joined = market.join(own, "postal_code", "left").withColumn("own_count", F.coalesce("own_locations", F.lit(0)))
    return joined.select(
        "postal_code",
        "own_count",
        "total_financial",
        "banks",
        "atms",
        F.round(ratio * 100, 2).alias("market_share_pct"),
        position.alias("market_position"),
    )


# --- grid cells --------------------------------------------------------------------------


def with_cell(df: DataFrame, size: float = CELL) -> DataFrame:
    return df.withColumns({"cell_lat": snap("lat", size), "cell_lon": snap("lon", size)})


def cells(places: DataFrame, size: float = CELL, threshold: int = THRESHOLD, **aggs: Column) -> DataFrame:
    """Thresholded figures per grid cell; cells stay integer keys and get their text last."""
    rows = thresholded(with_cell(places, size), ["cell_lat", "cell_lon"], threshold, **aggs)
    return rows.withColumn("geo_txt", cell_label("cell_lat", "cell_lon", size))


def density_grid(places: DataFrame, size: float = CELL, threshold: int = THRESHOLD) -> DataFrame:
    return cells(
        places,
        size,
        threshold,
        total_count=F.count("*"),
        bank_count=count_kind("bank"),
        atm_count=count_kind("atm"),
        finance_count=count_kind("finance"),
        avg_rating=avg_rating(),
    )


def activity(places: DataFrame, size: float = CELL, threshold: int = THRESHOLD) -> DataFrame:
    """Commercial and financial places per cell."""
    return cells(
        places,
        size,
        threshold,
        total_businesses=F.count("*"),
        commercial_count=count_kind(*COMMERCIAL),
        financial_count=count_kind(*FINANCIAL),
        bank_count=count_kind("bank"),
        atm_count=count_kind("atm"),
    )


def _opportunity(rival: str) -> Column:
    return F.round(safe_divide(F.col("commercial_count"), F.col(rival)), 2)


def white_space(cell_activity: DataFrame, more_than: int = 50, fewer_than: int = 10, k: int | None = 20) -> DataFrame:
    """Busy cells with little financial presence, best score first."""
    rows = cell_activity.filter((F.col("financial_count") < fewer_than) & (F.col("commercial_count") > more_than))
    rows = rows.select(
        "geo_txt", "cell_lat", "cell_lon", "commercial_count", "financial_count", _opportunity("financial_count").alias("opportunity_score")
    )
    if k is None:
        return rows
    return top_k(rows, k, F.col("opportunity_score").desc_nulls_last(), "cell_lat", "cell_lon")


def white_space_level(cell_activity: DataFrame, more_than: int = 100, fewer_than: int = 10, k: int = 20) -> DataFrame:
    banks = F.col("bank_count")
    level = first_match(
        [(banks == 0, "No Banks"), (banks < 3, "Low Competition"), (banks < 10, "Moderate Competition")],
        "High Competition",
    )
    rows = cell_activity.filter((F.col("commercial_count") > more_than) & (banks < fewer_than)).select(
        "geo_txt",
        "commercial_count",
        "bank_count",
        "atm_count",
        _opportunity("bank_count").alias("opportunity_score"),
        level.alias("competition_level"),
    )
    return top_k(rows, k, F.col("opportunity_score").desc_nulls_last(), "geo_txt")


def uncovered_cells(white_cells: DataFrame, branches: DataFrame, size: float = CELL, k: int = 20) -> DataFrame:
    """White-space cells without a branch of our own."""
    covered = with_cell(branches, size).select("cell_lat", "cell_lon").distinct()
    free = white_cells.join(covered, ["cell_lat", "cell_lon"], "left_anti")
    return top_k(free, k, F.col("opportunity_score").desc_nulls_last(), "cell_lat", "cell_lon")
