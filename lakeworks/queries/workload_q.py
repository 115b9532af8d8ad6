"""Workload reports: events stand for jobs, parts for stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workload as W
from .registry import Tables, query, with_sql

SALT = "report"
ERRORS = ["invalidQuery", "stopped", "resourcesExceeded"]


def _cat(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


def jobs(t: Tables):
    e = F.col("event_id")
    ms = F.rint(F.col("value") * 100).cast("long")
    started = F.col("ts") + F.make_dt_interval(secs=(e % 20).cast("decimal(18,6)"))
    return t.events.select(
        e.alias("job_id"),
        _cat("p", F.col("user_id") % 7).alias("project_id"),
        _cat("u", F.col("user_id")).alias("principal"),
        _cat("q", e % 50).alias("query_hash"),
        F.col("ts").alias("created"),
        started.alias("started"),
        (started + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))).alias("ended"),
        ((F.col("event_type") == "view") & (e % 4 == 0)).alias("cache_hit"),
        F.when(F.col("user_id") % 3 == 0, _cat("r", F.col("user_id") % 2)).alias("reservation_id"),
        F.when(F.col("event_type") == "signup", 0).otherwise(ms * (e % 9 + 1)).alias("slot_ms"),
        (e * 7919 % 1000003 * 1000).alias("bytes_processed"),
        (e * 7919 % 1000003 * 1024).alias("bytes_billed"),
        F.when(F.col("event_type") == "error", F.get(F.array(*[F.lit(x) for x in ERRORS]), (e % 3).cast("int"))).alias("error_reason"),
        (e % 11 == 0).alias("contention"),
    )


JOBS = (
    "jobs",
    """SELECT event_id AS job_id, 'p' || user_id % 7 AS project_id, 'u' || user_id AS principal, 'q' || event_id % 50 AS query_hash,
  ts AS created, ts + to_seconds(event_id % 20) AS started, CAST(value * 100 AS BIGINT) AS ms,
  event_type = 'view' AND event_id % 4 = 0 AS cache_hit, CASE WHEN user_id % 3 = 0 THEN 'r' || user_id % 2 END AS reservation_id,
  CASE WHEN event_type = 'signup' THEN 0 ELSE ms * (event_id % 9 + 1) END AS slot_ms,
  event_id * 7919 % 1000003 * 1000 AS bytes_processed, event_id * 7919 % 1000003 * 1024 AS bytes_billed,
  CASE WHEN event_type = 'error' THEN ['invalidQuery', 'stopped', 'resourcesExceeded'][event_id % 3 + 1] END AS error_reason,
  event_id % 11 = 0 AS contention FROM events""",
)


def timeline(t: Tables):
    """One row per job and second: waiting until it starts, then running on even shares of its slots."""
    created, started = F.unix_seconds(F.col("created").cast("timestamp")), F.unix_seconds(F.col("started").cast("timestamp"))
    run = F.ceil((F.unix_millis(F.col("ended").cast("timestamp")) - F.unix_millis(F.col("started").cast("timestamp"))) / 1000)
    rows = jobs(t).select("job_id", "principal", "slot_ms", created.alias("a"), started.alias("b"), F.greatest(run.cast("long"), F.lit(1)).alias("n"))
    seconds = rows.select("*", F.explode(F.sequence(F.col("a"), F.col("b") + F.col("n") - 1)).alias("s"))
    running = F.col("s") >= F.col("b")
    return seconds.select(
        "job_id",
        "principal",
        F.timestamp_seconds("s").alias("second"),
        F.when(running, "RUNNING").otherwise("PENDING").alias("state"),
        F.when(running, F.floor(F.col("slot_ms") / F.col("n"))).otherwise(F.lit(0)).cast("long").alias("slot_ms"),
    )


TIMELINE = (
    "timeline",
    """SELECT job_id, principal, to_timestamp(s)::TIMESTAMP AS second, CASE WHEN s >= b THEN 'RUNNING' ELSE 'PENDING' END AS state,
  CASE WHEN s >= b THEN CAST(floor(slot_ms / n) AS BIGINT) ELSE 0 END AS slot_ms
FROM (SELECT *, unnest(range(a, b + n)) AS s FROM (SELECT job_id, principal, slot_ms, CAST(floor(epoch_us(created) / 1000000) AS BIGINT) AS a,
  CAST(floor(epoch_us(started) / 1000000) AS BIGINT) AS b, greatest(CAST(ceil(ms / 1000) AS BIGINT), 1) AS n FROM jobs))""",
)
HOURS = (
    "hours",
    """SELECT h.hour, COALESCE(slots, 0) AS slots FROM (SELECT unnest(generate_series(MIN(date_trunc('hour', second)),
  MAX(date_trunc('hour', second)), INTERVAL 1 HOUR)) AS hour FROM timeline) h
LEFT JOIN (SELECT date_trunc('hour', second) AS hour, SUM(slot_ms) / 3600000 AS slots FROM timeline GROUP BY 1) u ON h.hour = u.hour""",
)
DIST = (
    "dist",
    """SELECT quantile_cont(slots, 0.10) AS p10, quantile_cont(slots, 0.25) AS p25, quantile_cont(slots, 0.50) AS p50,
  quantile_cont(slots, 0.75) AS p75, quantile_cont(slots, 0.95) AS p95, quantile_cont(slots, 0.99) AS p99, MAX(slots) AS max,
  ROUND(COUNT(*) FILTER (WHERE slots = 0)::DOUBLE / COUNT(*) * 100, 4) AS zero_hours_pct, COUNT(*) AS hours,
  COUNT(*) FILTER (WHERE slots > 0) AS active_hours, quantile_cont(slots, 0.50) FILTER (WHERE slots > 0) AS active_p50,
  quantile_cont(slots, 0.95) FILTER (WHERE slots > 0) AS active_p95, quantile_cont(slots, 0.99) FILTER (WHERE slots > 0) AS active_p99,
  AVG(slots) FILTER (WHERE slots > 0) AS active_mean, AVG(slots) AS mean, STDDEV_SAMP(slots) AS deviation FROM hours""",
)


def fp(x: str, n: int = 16) -> str:
    return f"substr(sha256('{SALT}' || {x}), 1, {n})"


HOUR_MS = "3600000"


@query(
    "daily_job_class",
    with_sql(
        JOBS,
        body="""SELECT CAST(CAST(created AS DATE) AS VARCHAR) AS day, COUNT(*) AS jobs, COUNT(*) FILTER (WHERE cache_hit) AS cached,
  COUNT(*) FILTER (WHERE NOT cache_hit AND slot_ms > 0) AS positive_compute,
  COUNT(*) FILTER (WHERE NOT cache_hit AND slot_ms = 0) AS zero_compute,
  COUNT(*) FILTER (WHERE NOT cache_hit AND slot_ms > 0 AND reservation_id IS NULL) AS null_reservation,
  COUNT(*) FILTER (WHERE NOT cache_hit AND slot_ms > 0 AND reservation_id IS NOT NULL) AS reserved,
  ROUND(null_reservation::DOUBLE / positive_compute * 100, 4) AS null_reservation_pct
FROM jobs GROUP BY CAST(created AS DATE)""",
    ),
)
def _(t):
    return W.daily_job_class(jobs(t))


def _rounded(df):
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(c, 6).alias(c) if c in floats else F.col(c) for c in df.columns])


@query(
    "slot_distribution",
    with_sql(
        JOBS,
        TIMELINE,
        HOURS,
        DIST,
        body="SELECT zero_hours_pct, hours, active_hours, "
        + ", ".join(
            f"ROUND({c}, 6) AS {c}"
            for c in "p10 p25 p50 p75 p95 p99 max active_p50 active_p95 active_p99 active_mean mean deviation".split()
        )
        + " FROM dist",
    ),
)
def _(t):
    return _rounded(W.slot_distribution(W.hourly_slots(timeline(t))))


@query(
    "variability_class",
    with_sql(
        JOBS,
        TIMELINE,
        HOURS,
        DIST,
        ("v", "SELECT deviation / NULLIF(mean, 0) AS cv, p95 / NULLIF(p50, 0) AS burst_ratio FROM dist"),
        body="""SELECT ROUND(cv, 6) AS cv, ROUND(burst_ratio, 6) AS burst_ratio, CASE WHEN cv < 0.5 THEN 'Stable'
    WHEN cv < 1 THEN 'Moderately variable' ELSE 'Highly variable' END AS cv_class,
  CASE WHEN burst_ratio IS NULL THEN 'Undefined' WHEN burst_ratio < 1.5 THEN 'Low burst'
    WHEN burst_ratio < 3 THEN 'Medium burst' ELSE 'High burst' END AS burst_class FROM v""",
    ),
)
def _(t):
    return _rounded(W.variability(W.slot_distribution(W.hourly_slots(timeline(t)))))


@query(
    "project_consumption",
    with_sql(JOBS, body=f"SELECT project_id, SUM(slot_ms) / {HOUR_MS} AS slot_hours, COUNT(*) AS jobs FROM jobs GROUP BY ALL"),
)
def _(t):
    return W.project_consumption(jobs(t))


@query(
    "usage_heatmap",
    with_sql(
        JOBS,
        TIMELINE,
        ("per", "SELECT date_trunc('hour', second) AS slot_hour, principal, SUM(slot_ms) AS ms FROM timeline GROUP BY ALL"),
        (
            "h",
            """SELECT slot_hour, SUM(ms) OVER (PARTITION BY slot_hour) AS total, principal FROM per
QUALIFY row_number() OVER (PARTITION BY slot_hour ORDER BY ms DESC, principal DESC) = 1""",
        ),
        body=f"""SELECT CAST(isodow(slot_hour) - 1 AS INTEGER) AS weekday, CAST(hour(slot_hour) AS INTEGER) AS hour,
  total / {HOUR_MS} AS peak_slots, {fp('principal')} AS principal_fingerprint FROM h
QUALIFY row_number() OVER (PARTITION BY isodow(slot_hour), hour(slot_hour) ORDER BY total DESC, slot_hour DESC) = 1""",
    ),
)
def _(t):
    return W.usage_heatmap(timeline(t), SALT)


@query(
    "weekly_trend",
    with_sql(
        JOBS,
        TIMELINE,
        (
            "w",
            """SELECT CAST(date_trunc('week', second) AS DATE) AS week_start, CAST(weekofyear(MIN(second)) AS INTEGER) AS week,
  SUM(slot_ms) AS ms, COUNT(DISTINCT CAST(second AS DATE)) AS days FROM timeline GROUP BY 1""",
        ),
        ("l", "SELECT *, LAG(ms) OVER (ORDER BY week_start) AS before FROM w"),
        body=f"""SELECT CAST(week_start AS VARCHAR) AS week_start, week, ms / {HOUR_MS} AS slot_hours, days,
  CASE WHEN before IS NULL THEN '-' WHEN ms > before THEN 'Up' WHEN ms < before THEN 'Down' ELSE 'Flat' END AS trend FROM l""",
    ),
)
def _(t):
    return W.weekly_trend(timeline(t))


@query(
    "error_breakdown",
    with_sql(
        JOBS,
        ("f", "SELECT *, row_number() OVER (PARTITION BY error_reason ORDER BY created DESC, job_id DESC) AS rn FROM jobs WHERE error_reason IS NOT NULL"),
        body=f"""SELECT error_reason, COUNT(*) AS errors, COUNT(*) FILTER (WHERE slot_ms > 0) AS failed_compute,
  SUM(slot_ms) / {HOUR_MS} AS failed_slot_hours, ROUND(COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM f) * 100, 4) AS error_pct,
  string_agg({fp('job_id', 4)}, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS recent_jobs FROM f GROUP BY error_reason""",
    ),
)
def _(t):
    return W.error_breakdown(jobs(t), SALT)


@query(
    "queue_pressure",
    with_sql(
        JOBS,
        TIMELINE,
        ("s", "SELECT second, COUNT(*) FILTER (WHERE state = 'PENDING') AS pending FROM timeline GROUP BY ALL"),
        body="""SELECT MAX(pending) AS peak_pending, ROUND(SUM(pending)::DOUBLE / COUNT(*), 6) AS avg_pending, COUNT(*) AS observed_seconds,
  (SELECT strftime(second, '%Y-%m-%d %H:%M:%S') FROM s ORDER BY pending DESC, second LIMIT 1) AS peak_at FROM s""",
    ),
)
def _(t):
    return W.queue_pressure(timeline(t))


THRESHOLDS = [2.0, 5.0, 8.5]
GOOD = ("good", "SELECT slot_ms, slot_ms::DOUBLE / ms AS avg_slots FROM jobs WHERE error_reason IS NULL AND NOT cache_hit AND slot_ms > 0 AND ms > 0")


@query(
    "job_threshold_impact",
    with_sql(
        JOBS,
        GOOD,
        body=f"""SELECT x AS threshold, COUNT(*) AS jobs, COUNT(*) FILTER (WHERE avg_slots > x) AS above,
  ROUND(above::DOUBLE / COUNT(*) * 100, 4) AS above_pct,
  COALESCE(SUM(slot_ms) FILTER (WHERE avg_slots > x), 0) / {HOUR_MS} AS slot_hours_above
FROM good, (SELECT unnest([2.0, 5.0, 8.5]::DOUBLE[]) AS x) GROUP BY x""",
    ),
)
def _(t):
    return W.threshold_impact(jobs(t), THRESHOLDS)


@query(
    "demand_sensitivity",
    with_sql(
        JOBS,
        TIMELINE,
        HOURS,
        body="""SELECT x AS threshold, COUNT(*) FILTER (WHERE slots <= x) AS hours_within, COUNT(*) FILTER (WHERE slots > x) AS hours_above,
  ROUND(AVG(slots) / x * 100, 4) AS utilization_pct FROM hours, (SELECT unnest([0.01, 0.1, 50]::DOUBLE[]) AS x) GROUP BY x""",
    ),
)
def _(t):
    return W.demand_sensitivity(W.hourly_slots(timeline(t)), [0.01, 0.1, 50.0])


@query(
    "expensive_workloads",
    with_sql(
        JOBS,
        (
            "s",
            """SELECT principal, query_hash, COUNT(*) AS queries, SUM(bytes_processed) AS p, SUM(bytes_billed) AS b FROM jobs
GROUP BY ALL ORDER BY p DESC, principal, query_hash LIMIT 10""",
        ),
        body=f"""SELECT {fp('principal')} AS principal_fingerprint, {fp('query_hash')} AS workload_fingerprint, queries,
  p / 1099511627776 AS tib_processed, b / 1099511627776 AS tib_billed FROM s""",
    ),
)
def _(t):
    return W.expensive_workloads(jobs(t), SALT)


@query(
    "slow_jobs",
    with_sql(
        JOBS,
        ("s", "SELECT * FROM jobs ORDER BY ms DESC, job_id LIMIT 10"),
        body=f"""SELECT {fp('job_id')} AS job_fingerprint, {fp('principal')} AS principal_fingerprint, ms / 1000 AS duration_s,
  bytes_processed / 1073741824 AS gib_processed, slot_ms / {HOUR_MS} AS slot_hours FROM s""",
    ),
)
def _(t):
    return W.slow_jobs(jobs(t), SALT)


@query("contention_jobs", with_sql(JOBS, body="SELECT COUNT(*) FILTER (WHERE contention) AS contention_jobs, COUNT(*) AS jobs FROM jobs"))
def _(t):
    return W.contention_jobs(jobs(t))


def storage(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(
        F.concat(F.col("p_brand"), F.lit("."), k.cast("string")).alias("table"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 300).cast("int"))).alias("created"),
        F.when(k % 3 == 0, 0).otherwise(k * 31 % 977 * 1000003).alias("active_bytes"),
        (k * 17 % 1009 * 1000033).alias("long_term_bytes"),
        (k * 13 % 991 * 100019).alias("physical_bytes"),
        (k * 7 % 983 * 10007).alias("fail_safe_bytes"),
    )


STORAGE = (
    "storage",
    """SELECT p_brand || '.' || p_partkey AS name, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 300 AS INTEGER)) AS created,
  CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey * 31 % 977 * 1000003 END AS active, p_partkey * 17 % 1009 * 1000033 AS long_term,
  active + long_term AS total FROM part""",
)


@query(
    "storage_top",
    with_sql(
        STORAGE,
        body="""SELECT name AS table, total / 1073741824 AS total_gib, active / 1073741824 AS active_gib,
  long_term / 1073741824 AS long_term_gib, ROUND(long_term::DOUBLE / NULLIF(total, 0) * 100, 4) AS long_term_pct
FROM storage ORDER BY total DESC, name LIMIT 10""",
    ),
)
def _(t):
    return W.storage_top(storage(t))


@query(
    "stale_tables",
    with_sql(
        STORAGE,
        body="""SELECT name AS table, CAST(CAST(created AS DATE) AS VARCHAR) AS created, total / 1073741824 AS size_gib FROM storage
WHERE storage.created < TIMESTAMP '2024-09-01' - INTERVAL 90 DAY ORDER BY total DESC, name LIMIT 10""",
    ),
)
def _(t):
    return W.stale_tables(storage(t), F.lit("2024-09-01").cast("timestamp_ntz"))


@query(
    "ingest_activity",
    f"""SELECT {fp("'t' || user_id")} AS table_fingerprint, COUNT(*) AS requests, CAST(SUM(event_id % 100) AS BIGINT) AS rows,
  CAST(SUM(length(props) * (event_id % 100)) AS BIGINT) AS input_bytes, COUNT(*) FILTER (WHERE event_type = 'error') AS errors,
  ROUND(errors::DOUBLE / COUNT(*) * 100, 4) AS error_pct FROM events GROUP BY user_id""",
)
def _(t):
    rows = F.col("event_id") % 100
    requests = t.events.select(
        _cat("t", F.col("user_id")).alias("table"),
        rows.alias("rows"),
        (F.length("props") * rows).alias("input_bytes"),
        F.when(F.col("event_type") == "error", "FAILED").alias("error_code"),
    )
    return W.ingest_activity(requests, SALT)
