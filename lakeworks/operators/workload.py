"""Workload, queue and storage reports.

``jobs``: job_id, project_id, principal, query_hash, created, started, ended, cache_hit,
reservation_id, slot_ms, bytes_processed, bytes_billed, error_reason, contention.
``timeline``: job_id, second, state, slot_ms, principal.
``storage``: table, created, active_bytes, long_term_bytes, physical_bytes, fail_safe_bytes.

Band edges and formulas that the reports do not state are chosen here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import first_match, pct, safe_divide, total_units
from .dedup import top_k

MS_PER_HOUR = 3_600_000.0
GIB, TIB = float(2**30), float(2**40)
CV_BANDS = [(0.5, "Stable"), (1.0, "Moderately variable")]
BURST_BANDS = [(1.5, "Low burst"), (3.0, "Medium burst")]
STALE_DAYS = 90


def slot_hours(slot_ms: Column) -> Column:
    return total_units(slot_ms) / F.lit(MS_PER_HOUR)


def fingerprint(value: Column | str, salt: str, length: int = 16) -> Column:
    """Salted hash prefix, stable within one report."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.col(value) if isinstance(value, str) else value), 256), 1, length)


def daily_job_class(jobs: DataFrame) -> DataFrame:
    """Per day: jobs, cached, positive and zero compute, and compute without a reservation."""
    cached = F.coalesce("cache_hit", F.lit(False))
    positive = ~cached & (F.coalesce("slot_ms", F.lit(0)) > 0)
    unreserved = positive & F.col("reservation_id").isNull()
    rows = jobs.groupBy(F.to_date("created").alias("day")).agg(
        F.count("*").alias("jobs"),
        F.count_if(cached).alias("cached"),
        F.count_if(positive).alias("positive_compute"),
        F.count_if(~cached & ~positive).alias("zero_compute"),
        F.count_if(unreserved).alias("null_reservation"),
        F.count_if(positive & ~unreserved).alias("reserved"),
    )
    return rows.withColumn("null_reservation_pct", pct(F.col("null_reservation"), F.col("positive_compute"), 4))


def hourly_slots(timeline: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Mean slots of every hour, idle hours included.

    The hour spine covers ``start`` to ``end`` (by default the first to the last active hour).
    It has one row per hour of the window, so it stays small.
    """
    used = timeline.groupBy(F.date_trunc("hour", "second").alias("hour")).agg(slot_hours(F.col("slot_ms")).alias("slots"))
    ends = used.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    first = F.date_trunc("hour", start) if start is not None else F.col("a")
    last = F.date_trunc("hour", end) if end is not None else F.col("b")
    spine = ends.select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return spine.join(used, "hour", "left").select("hour", F.coalesce("slots", F.lit(0.0)).alias("slots"))


def slot_distribution(hours: DataFrame) -> DataFrame:
    """Percentiles over all hours and over active hours, with mean and deviation."""
    slots = F.col("slots")
    busy = F.when(slots > 0, slots)

    def p(share: float, of: Column = slots) -> Column:
        return F.percentile(of, F.lit(share))

    shares = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return hours.agg(
        *[p(s).alias(n) for n, s in shares.items()],
        F.max("slots").alias("max"),
        pct(F.count_if(slots == 0), F.count("*"), 4).alias("zero_hours_pct"),
        F.count("*").alias("hours"),
        F.count(busy).alias("active_hours"),
        *[p(shares[n], busy).alias(f"active_{n}") for n in ("p50", "p95", "p99")],
        F.avg(busy).alias("active_mean"),
        F.avg("slots").alias("mean"),
        F.stddev_samp("slots").alias("deviation"),
    )


def variability(distribution: DataFrame) -> DataFrame:
    """Coefficient of variation and burst ratio with a class each; a zero median has no ratio."""
    cv = safe_divide(F.col("deviation"), F.col("mean"))
    burst = safe_divide(F.col("p95"), F.col("p50"))
    rows = distribution.select(cv.alias("cv"), burst.alias("burst_ratio"))
    cv_class = first_match([(F.col("cv") < e, n) for e, n in CV_BANDS], "Highly variable")
    burst_class = first_match(
        [(F.col("burst_ratio").isNull(), "Undefined"), *[(F.col("burst_ratio") < e, n) for e, n in BURST_BANDS]], "High burst"
    )
    return rows.withColumns({"cv_class": cv_class, "burst_class": burst_class})


def project_consumption(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("project_id").agg(slot_hours(F.col("slot_ms")).alias("slot_hours"), F.count("*").alias("jobs"))


def usage_heatmap(timeline: DataFrame, salt: str) -> DataFrame:
    """Highest hourly slots per weekday and hour, with the fingerprint of its main principal."""
    per_principal = timeline.groupBy(F.date_trunc("hour", "second").alias("at"), "principal").agg(
        F.sum("slot_ms").alias("ms")
    )
    lead = F.max_by("principal", F.struct("ms", "principal")).alias("principal")
    hours = per_principal.groupBy("at").agg(F.sum("ms").alias("ms"), lead)
    peak = F.struct("ms", "at")
    return hours.groupBy(F.weekday("at").alias("weekday"), F.hour("at").alias("hour")).agg(
        (F.max("ms") / F.lit(MS_PER_HOUR)).alias("peak_slots"),
        fingerprint(F.max_by("principal", peak), salt).alias("principal_fingerprint"),
    )


def weekly_trend(timeline: DataFrame) -> DataFrame:
    """Slot-hours and covered days per week and the direction against the week before."""
    days = timeline.groupBy(F.to_date("second").alias("day")).agg(F.sum("slot_ms").alias("ms"))
    weeks = days.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week_start")).agg(
        F.weekofyear(F.min("day")).alias("week"), F.sum("ms").alias("ms"), F.count("*").alias("days")
    )
    # One row per week: the ordering window is as long as the calendar, not the workload.
    before = F.lag("ms").over(Window.orderBy("week_start"))
    trend = F.when(before.isNull(), "-").when(F.col("ms") > before, "Up").when(F.col("ms") < before, "Down").otherwise("Flat")
    return weeks.select("week_start", "week", (F.col("ms") / F.lit(MS_PER_HOUR)).alias("slot_hours"), "days", trend.alias("trend"))


def error_breakdown(jobs: DataFrame, salt: str, handles: int = 3) -> DataFrame:
    """Errors by reason with their share, failed compute and the newest job fingerprints."""
    failed = jobs.filter(F.col("error_reason").isNotNull())
    positive = F.coalesce("slot_ms", F.lit(0)) > 0
    counts = failed.groupBy("error_reason").agg(
        F.count("*").alias("errors"),
        F.count_if(positive).alias("failed_compute"),
        slot_hours(F.coalesce("slot_ms", F.lit(0))).alias("failed_slot_hours"),
    )
    total = failed.agg(F.count("*").cast("double")).scalar()
    newest = Window.partitionBy("error_reason").orderBy(F.col("created").desc(), F.col("job_id").desc())
    recent = (
        failed.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= handles)
        .groupBy("error_reason")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", fingerprint(F.col("job_id").cast("string"), salt, 4).alias("f")))).alias("_h"))
        .select("error_reason", F.array_join(F.transform("_h", lambda h: h["f"]), ",").alias("recent_jobs"))
    )
    return counts.withColumn("error_pct", F.round(safe_divide(F.col("errors"), total) * 100, 4)).join(recent, "error_reason")


def queue_pressure(timeline: DataFrame) -> DataFrame:
    """Most jobs waiting in one second, when, and the mean per observed second."""
    per_second = timeline.groupBy("second").agg(F.count_if(F.col("state") == "PENDING").alias("pending"))
    return per_second.agg(
        F.max("pending").alias("peak_pending"),
        # Earliest second of the peak.
        F.min_by("second", F.struct((-F.col("pending")).alias("p"), "second")).alias("peak_at"),
        F.round(safe_divide(F.sum("pending"), F.count("*")), 6).alias("avg_pending"),
        F.count("*").alias("observed_seconds"),
    )


def successful_compute(jobs: DataFrame) -> DataFrame:
    """Finished, uncached jobs with compute and a duration, and their mean slots."""
    ms = F.unix_millis(F.col("ended").cast("timestamp")) - F.unix_millis(F.col("started").cast("timestamp"))
    good = F.col("error_reason").isNull() & ~F.coalesce("cache_hit", F.lit(False)) & (F.col("slot_ms") > 0)
    return (
        jobs.filter(good)
        .withColumn("duration_ms", ms)
        .filter(F.col("duration_ms") > 0)
        .withColumn("avg_slots", safe_divide(F.col("slot_ms"), F.col("duration_ms")))
    )


def _per_threshold(row: DataFrame, thresholds: Sequence[float], fields: Sequence[str]) -> DataFrame:
    packed = [
        F.struct(F.lit(float(x)).alias("threshold"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, x in enumerate(thresholds)
    ]
    return row.select(F.inline(F.array(*packed)))


def threshold_impact(jobs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Jobs whose mean slots lie above each threshold. All thresholds share one pass."""
    rows = successful_compute(jobs)
    aggs = []
    for i, x in enumerate(thresholds):
        above = F.col("avg_slots") > x
        aggs += [
            F.count("*").alias(f"jobs_{i}"),
            F.count_if(above).alias(f"above_{i}"),
            pct(F.count_if(above), F.count("*"), 4).alias(f"above_pct_{i}"),
            slot_hours(F.when(above, F.col("slot_ms")).otherwise(F.lit(0))).alias(f"slot_hours_above_{i}"),
        ]
    return _per_threshold(rows.agg(*aggs), thresholds, ["jobs", "above", "above_pct", "slot_hours_above"])


def demand_sensitivity(hours: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Hours at or below and above each threshold and how far the mean fills it."""
    aggs = []
    for i, x in enumerate(thresholds):
        aggs += [
            F.count_if(F.col("slots") <= x).alias(f"hours_within_{i}"),
            F.count_if(F.col("slots") > x).alias(f"hours_above_{i}"),
            F.round(safe_divide(F.avg("slots"), F.lit(float(x))) * 100, 4).alias(f"utilization_pct_{i}"),
        ]
    return _per_threshold(hours.agg(*aggs), thresholds, ["hours_within", "hours_above", "utilization_pct"])


def expensive_workloads(jobs: DataFrame, salt: str, k: int = 10) -> DataFrame:
    """Bytes by principal and workload."""
    sums = jobs.groupBy("principal", "query_hash").agg(
        F.count("*").alias("queries"), F.sum("bytes_processed").alias("bytes_processed"), F.sum("bytes_billed").alias("bytes_billed")
    )
    leading = top_k(sums, k, F.col("bytes_processed").desc(), "principal", "query_hash")
    return leading.select(
        fingerprint("principal", salt).alias("principal_fingerprint"),
        fingerprint("query_hash", salt).alias("workload_fingerprint"),
        "queries",
        (F.col("bytes_processed") / F.lit(TIB)).alias("tib_processed"),
        (F.col("bytes_billed") / F.lit(TIB)).alias("tib_billed"),
    )


def slow_jobs(jobs: DataFrame, salt: str, k: int = 10) -> DataFrame:
    ms = F.unix_millis(F.col("ended").cast("timestamp")) - F.unix_millis(F.col("started").cast("timestamp"))
    leading = top_k(jobs.withColumn("_ms", ms), k, F.col("_ms").desc(), "job_id")
    return leading.select(
        fingerprint(F.col("job_id").cast("string"), salt).alias("job_fingerprint"),
        fingerprint("principal", salt).alias("principal_fingerprint"),
        (F.col("_ms") / 1000).alias("duration_s"),
        (F.col("bytes_processed") / F.lit(GIB)).alias("gib_processed"),
        (F.col("slot_ms") / F.lit(MS_PER_HOUR)).alias("slot_hours"),
    )


def contention_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if("contention").alias("contention_jobs"), F.count("*").alias("jobs"))


def storage_top(storage: DataFrame, k: int = 10) -> DataFrame:
    total = F.col("active_bytes") + F.col("long_term_bytes")
    leading = top_k(storage.withColumn("_total", total), k, F.col("_total").desc(), "table")
    return leading.select(
        "table",
        (F.col("_total") / F.lit(GIB)).alias("total_gib"),
        (F.col("active_bytes") / F.lit(GIB)).alias("active_gib"),
        (F.col("long_term_bytes") / F.lit(GIB)).alias("long_term_gib"),
        pct(F.col("long_term_bytes"), F.col("_total"), 4).alias("long_term_pct"),
    )


def stale_tables(storage: DataFrame, as_of: Column, days: int = STALE_DAYS, k: int = 10) -> DataFrame:
    """Largest tables created more than ``days`` days before ``as_of``."""
    old = storage.filter(F.col("created") < as_of - F.make_dt_interval(F.lit(days)))
    sized = old.withColumn("_total", F.col("active_bytes") + F.col("long_term_bytes"))
    return top_k(sized, k, F.col("_total").desc(), "table").select(
        "table", F.to_date("created").alias("created"), (F.col("_total") / F.lit(GIB)).alias("size_gib")
    )


def ingest_activity(requests: DataFrame, salt: str) -> DataFrame:
    """Requests, rows, bytes and errors per table (table, rows, input_bytes, error_code)."""
    sums = requests.groupBy("table").agg(
        F.count("*").alias("requests"),
        F.sum("rows").alias("rows"),
        F.sum("input_bytes").alias("input_bytes"),
        F.count("error_code").alias("errors"),
    )
    return sums.select(
        fingerprint("table", salt).alias("table_fingerprint"),
        "requests",
        "rows",
        "input_bytes",
        "errors",
        pct(F.col("errors"), F.col("requests"), 4).alias("error_pct"),
    )
