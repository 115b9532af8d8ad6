"""Funnels, retention, sessions and daily trends over event streams.

Input columns: ``user_id``, ``event_id``, ``ts``, ``event_name`` and, where sessions are
asked for, ``session_id``. Event ids are unique and break ties in time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fixed_units, pct, safe_divide, total_units
from .dedup import top_k
from .ordered import GroupOrder

# Upper edges of the engagement bands, right edge included (fixed values).
ENGAGEMENT_BANDS = [(10_000, "Low"), (50_000, "Medium"), (100_000, "High")]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def overview(events: DataFrame, approximate: bool = False) -> DataFrame:
    if approximate:
        return events.agg(
            F.count("*").alias("total_events"),
            F.approx_count_distinct("user_id").alias("unique_users"),
            F.approx_count_distinct("event_name").alias("unique_event_types"),
        )
    # One row per user and kind first: the distinct counts then run over far fewer rows.
    pairs = events.groupBy("user_id", "event_name").agg(F.count("*").alias("_n"))
    return pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_events"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("event_name").alias("unique_event_types"),
    )


def users_by(events: DataFrame, field: Column, name: str, k: int | None = None) -> DataFrame:
    """Distinct users per value of a field, most used first; NULL values are left out."""
    counts = (
        events.select(field.alias(name), "user_id")
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count_distinct("user_id").alias("users"))
    )
    return counts if k is None else top_k(counts, k, F.col("users").desc(), name)


def top_events(events: DataFrame, k: int | None = 20) -> DataFrame:
    counts = events.groupBy("event_name").agg(
        F.count("*").alias("event_count"), F.count_distinct("user_id").alias("unique_users")
    )
    return counts if k is None else top_k(counts, k, F.col("event_count").desc(), "event_name")


def funnel(events: DataFrame, first: str, second: str, within: Column | None = None) -> DataFrame:
    """Users' first-step events and those followed directly by the second step.

    Only the two event kinds take part. ``within`` is a day-time interval the follow-up must
    stay under. Users are split by ranges of their times, so one busy user is no single task;
    events without a user count as one user's, events without a time come first.
    """
    steps = events.filter(F.col("event_name").isin(first, second)).select("user_id", "event_id", "ts", "event_name")
    follow = GroupOrder(steps, ["user_id"], ["ts", "event_id"]).with_next(["event_name", "ts"])
    step_1 = F.col("event_name") == first
    step_2 = step_1 & (F.col("next_event_name") == second)
    if within is not None:
        step_2 = step_2 & (F.col("next_ts") - F.col("ts") < within)
    return follow.agg(F.count_if(step_1).alias("step_1"), F.count_if(step_2).alias("step_2"))


def first_touch(events: DataFrame) -> DataFrame:
    """Every event with its user's first time and the whole days since."""
    firsts = events.groupBy("user_id").agg(F.min("ts").alias("first_touch"))
    # Two scans; a busy user's events are split by the adaptive skew join.
    return events.join(firsts, "user_id").withColumn(
        "days_since_first", F.timestamp_diff("DAY", F.col("first_touch"), F.col("ts"))
    )


def retention_curve(events: DataFrame, last_day: int = 30) -> DataFrame:
    """Distinct users active a number of whole 24 hour periods after their first event."""
    return (
        first_touch(events.select("user_id", "event_id", "ts"))
        .filter(F.col("days_since_first").between(0, last_day))
        .groupBy("days_since_first")
        .agg(F.count_distinct("user_id").alias("active_users"))
    )


def retention_rates(curve: DataFrame, days: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """Active share of day 0 for the named days, 0 where nobody was active."""

    def active(day: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("days_since_first") == day, F.col("active_users"))), F.lit(0))

    return curve.agg(*[pct(active(d), active(0), 4).alias(f"day_{d}_pct") for d in days])


def session_metrics(events: DataFrame) -> DataFrame:
    """Start, end, events and distinct event names per user and session."""
    return events.groupBy("user_id", "session_id").agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("session_end"),
        F.count("*").alias("events_in_session"),
        F.count_distinct("event_name").alias("unique_events"),
    )


def engagement(events: DataFrame, k: int | None = 1000) -> DataFrame:
    """Sessions, mean duration, mean events and their product per user; events outside a
    session are left out."""
    sessions = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("user_id", "session_id")
        .agg(
            (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"),
            F.count("*").alias("events_in_session"),
        )
    )
    n = F.count("*").cast("double")
    per_user = sessions.groupBy("user_id").agg(
        F.count("*").alias("total_sessions"),
        (total_units(F.col("micros")) / n / F.lit(1e6)).alias("avg_session_duration_sec"),
        (F.sum("events_in_session").cast("double") / n).alias("avg_events_per_session"),
        F.sum("events_in_session").alias("total_events"),
    )
    score = F.col("total_sessions") * F.col("avg_events_per_session") * F.col("avg_session_duration_sec")
    scored = per_user.withColumn("engagement_score", score)
    return scored if k is None else top_k(scored, k, F.col("engagement_score").desc(), "user_id")


def engagement_level(score: Column) -> Column:
    """Band of a score; a band holds its upper edge, zero and less have none."""
    out = F.when(score <= 0, F.lit(None).cast("string"))
    for edge, name in ENGAGEMENT_BANDS:
        out = out.when(score <= edge, F.lit(name))
    return out.when(score.isNotNull(), F.lit("Very High"))


def daily_trend(events: DataFrame, engaged: str, new: str, purchase: str, value: str) -> DataFrame:
    """Active, engaged and new users, events, purchases and mean engagement per day.

    One row per day and user comes first, so every distinct user count is a plain count after.
    """
    name = F.col("event_name")
    engaged_value = F.when(name == engaged, F.col(value))
    per_user = events.groupBy(F.to_date("ts").alias("event_date"), "user_id").agg(
        F.count("*").alias("events"),
        F.max(name == engaged).alias("is_engaged"),
        F.max(name == new).alias("is_new"),
        F.count_if(name == purchase).alias("purchases"),
        F.sum(fixed_units(engaged_value)).alias("units"),
        F.count(engaged_value).alias("valued"),
    )
    known = F.col("user_id").isNotNull()
    return per_user.groupBy("event_date").agg(
        F.count("user_id").alias("daily_active_users"),
        F.sum("events").alias("total_events"),
        F.count_if(known & F.col("is_engaged")).alias("engaged_users"),
        F.count_if(known & F.col("is_new")).alias("new_users"),
        F.sum("purchases").alias("purchases"),
        safe_divide(total_units(F.col("units")) / 100, F.sum("valued")).alias("avg_engagement"),
    )


def weekday_pattern(trend: DataFrame) -> DataFrame:
    """Mean daily figures per weekday, Monday first."""
    day = F.weekday("event_date")
    means = [
        safe_divide(F.sum(c), F.count("*")).alias(f"avg_{c}")
        for c in ("daily_active_users", "engaged_users", "new_users", "purchases")
    ]
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return (
        trend.groupBy(day.alias("weekday_no"))
        .agg(*means)
        .withColumn("weekday", F.get(names, F.col("weekday_no")))
        .orderBy("weekday_no")
    )


def session_conversion(events: DataFrame, viewed: str, carted: str) -> DataFrame:
    """Sessions with each step and the conversion between them."""
    in_session = events.filter(F.col("session_id").isNotNull())
    sessions = in_session.groupBy("user_id", "session_id").agg(
        F.max(F.col("event_name") == viewed).alias("viewed"), F.max(F.col("event_name") == carted).alias("carted")
    )
    return sessions.agg(
        F.count_if("viewed").alias("view_sessions"), F.count_if("carted").alias("cart_sessions")
    ).withColumn("conversion_rate", F.round(safe_divide(F.col("cart_sessions"), F.col("view_sessions")), 6))


def param_counts(events: DataFrame, event_name: str, key: str, k: int | None = 20) -> DataFrame:
    """Frequencies of one integer parameter of one event kind."""
    hits = (
        events.filter(F.col("event_name") == event_name)
        .select(F.inline("event_params"))
        .filter((F.col("key") == key) & F.col("value.int_value").isNotNull())
        .groupBy(F.col("value.int_value").alias("param_value"))
        .agg(F.count("*").alias("n"))
    )
    return hits if k is None else top_k(hits, k, F.col("n").desc(), "param_value")
