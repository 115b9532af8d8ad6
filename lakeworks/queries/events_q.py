"""Event analytics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import events as E
from .registry import Tables, query, with_sql


def event_rows(t: Tables):
    """Events with device fields, parameter structs and a session id (missing for small k)."""
    k = F.get_json_object("props", "$.k").cast("long")
    params = F.array(
        F.struct(
            F.lit("k").alias("key"),
            F.struct(k.alias("int_value"), F.lit(None).cast("string").alias("string_value")).alias("value"),
        ),
        F.struct(
            F.lit("kind").alias("key"),
            F.struct(F.lit(None).cast("long").alias("int_value"), F.col("event_type").alias("string_value")).alias("value"),
        ),
    )
    categories = F.array(F.lit("mobile"), F.lit("tablet"), F.lit(None).cast("string"), F.lit("desktop"))
    device = F.struct(
        F.get(categories, (F.col("user_id") % 4).cast("int")).alias("category"),
        F.concat(F.lit("lang_"), (F.col("user_id") % 23).cast("string")).alias("language"),
    )
    return t.events.select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("event_name"),
        "value",
        device.alias("device"),
        params.alias("event_params"),
        F.when(k >= 5, V.div(k, 25)).alias("session_id"),
    )


EVENTS = (
    "ev",
    """SELECT event_id, ts, user_id, event_type AS event_name, value,
  ['mobile', 'tablet', NULL, 'desktop'][user_id % 4 + 1] AS category, 'lang_' || (user_id % 23) AS language,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CASE WHEN k >= 5 THEN k // 25 END AS session_id FROM events""",
)
FIRST = (
    "touched",
    """SELECT ev.*, f.first_touch, (epoch_us(ts) - epoch_us(f.first_touch)) // 86400000000 AS days_since_first
FROM ev JOIN (SELECT user_id, MIN(ts) AS first_touch FROM ev GROUP BY user_id) f USING (user_id)""",
)
CURVE = (
    "curve",
    """SELECT days_since_first, COUNT(DISTINCT user_id) AS active_users FROM touched
WHERE days_since_first BETWEEN 0 AND 30 GROUP BY ALL""",
)


@query(
    "dataset_overview",
    """SELECT COUNT(*) AS total_events, COUNT(DISTINCT user_id) AS unique_users,
  COUNT(DISTINCT event_type) AS unique_event_types FROM events""",
)
def _(t):
    return E.overview(event_rows(t))


@query(
    "device_breakdown",
    with_sql(
        EVENTS,
        body="SELECT category AS device_type, COUNT(DISTINCT user_id) AS users FROM ev WHERE category IS NOT NULL GROUP BY ALL",
    ),
)
def _(t):
    return E.users_by(event_rows(t), F.col("device.category"), "device_type").orderBy(F.col("users").desc(), "device_type")


@query(
    "top_languages",
    with_sql(
        EVENTS,
        body="""SELECT language, COUNT(DISTINCT user_id) AS users FROM ev GROUP BY ALL
ORDER BY users DESC, language LIMIT 15""",
    ),
)
def _(t):
    return E.users_by(event_rows(t), F.col("device.language"), "language", 15)


@query(
    "top_events",
    with_sql(
        EVENTS,
        body="""SELECT event_name, COUNT(*) AS event_count, COUNT(DISTINCT user_id) AS unique_users FROM ev
GROUP BY ALL ORDER BY event_count DESC, event_name LIMIT 20""",
    ),
)
def _(t):
    return E.top_events(event_rows(t))


@query(
    "event_funnel_counts",
    with_sql(
        EVENTS,
        body="SELECT event_name, COUNT(*) AS event_count, COUNT(DISTINCT user_id) AS unique_users FROM ev GROUP BY ALL",
    ),
)
def _(t):
    return E.top_events(event_rows(t), None)


STEPS = (
    "steps",
    """SELECT *, LEAD(event_name) OVER w AS next_event, LEAD(ts) OVER w AS next_ts FROM ev
WHERE event_name IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)


@query(
    "funnel_2step",
    with_sql(
        EVENTS,
        STEPS,
        body="""SELECT COUNT(*) FILTER (WHERE event_name = 'view') AS step_1,
  COUNT(*) FILTER (WHERE event_name = 'view' AND next_event = 'purchase') AS step_2 FROM steps""",
    ),
)
def _(t):
    return E.funnel(event_rows(t), "view", "purchase")


@query(
    "funnel_timed",
    with_sql(
        EVENTS,
        STEPS,
        body="""SELECT COUNT(*) FILTER (WHERE event_name = 'view') AS step_1,
  COUNT(*) FILTER (WHERE event_name = 'view' AND next_event = 'purchase' AND next_ts - ts < INTERVAL 12 HOUR)
    AS step_2 FROM steps""",
    ),
)
def _(t):
    return E.funnel(event_rows(t), "view", "purchase", F.expr("INTERVAL 12 HOUR"))


@query(
    "self_first_touch_join",
    with_sql(
        EVENTS,
        FIRST,
        body="""SELECT event_id, user_id, strftime(first_touch, '%Y-%m-%d %H:%M:%S') AS first_touch, days_since_first
FROM touched""",
    ),
)
def _(t):
    return E.first_touch(event_rows(t)).select("event_id", "user_id", "first_touch", "days_since_first")


@query("retention_curve", with_sql(EVENTS, FIRST, CURVE, body="SELECT * FROM curve"))
def _(t):
    return E.retention_curve(event_rows(t))


@query(
    "retention_rate",
    with_sql(
        EVENTS,
        FIRST,
        CURVE,
        ("base", "SELECT active_users AS n FROM curve WHERE days_since_first = 0"),
        body="SELECT "
        + ", ".join(
            f"ROUND(COALESCE((SELECT active_users FROM curve WHERE days_since_first = {d}), 0)::DOUBLE / n * 100, 4) "
            f"AS day_{d}_pct"
            for d in (1, 7, 30)
        )
        + " FROM base",
    ),
)
def _(t):
    return E.retention_rates(E.retention_curve(event_rows(t)))


SESSIONS = (
    "sessions",
    """SELECT user_id, session_id, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS events_in_session,
  COUNT(DISTINCT event_name) AS unique_events FROM ev GROUP BY user_id, session_id""",
)
ENGAGEMENT = (
    "scored",
    """SELECT user_id, COUNT(*) AS total_sessions,
  SUM(epoch_us(session_end) - epoch_us(session_start))::DOUBLE / COUNT(*) / 1e6 AS avg_session_duration_sec,
  SUM(events_in_session)::DOUBLE / COUNT(*) AS avg_events_per_session,
  CAST(SUM(events_in_session) AS BIGINT) AS total_events,
  total_sessions * avg_events_per_session * avg_session_duration_sec AS engagement_score
FROM sessions WHERE session_id IS NOT NULL GROUP BY user_id""",
)


@query(
    "session_metrics",
    with_sql(
        EVENTS,
        SESSIONS,
        body="""SELECT * REPLACE (strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(session_end, '%Y-%m-%d %H:%M:%S') AS session_end) FROM sessions""",
    ),
)
def _(t):
    return E.session_metrics(event_rows(t))


@query(
    "engagement_score",
    with_sql(EVENTS, SESSIONS, ENGAGEMENT, body="SELECT * FROM scored ORDER BY engagement_score DESC, user_id LIMIT 1000"),
)
def _(t):
    return E.engagement(event_rows(t))


@query(
    "engagement_level",
    with_sql(
        EVENTS,
        SESSIONS,
        ENGAGEMENT,
        body="""SELECT user_id, CASE WHEN s <= 0 THEN NULL WHEN s <= 10000 THEN 'Low' WHEN s <= 50000 THEN 'Medium'
  WHEN s <= 100000 THEN 'High' ELSE 'Very High' END AS level
FROM (SELECT user_id, engagement_score / 1000 AS s FROM scored)""",
    ),
)
def _(t):
    scored = E.engagement(event_rows(t), None)
    return scored.select("user_id", E.engagement_level(F.col("engagement_score") / 1000).alias("level"))


TREND = (
    "trend",
    """SELECT CAST(ts AS DATE) AS event_date, COUNT(DISTINCT user_id) AS daily_active_users, COUNT(*) AS total_events,
  COUNT(DISTINCT CASE WHEN event_name = 'click' THEN user_id END) AS engaged_users,
  COUNT(DISTINCT CASE WHEN event_name = 'signup' THEN user_id END) AS new_users,
  COUNT(*) FILTER (WHERE event_name = 'purchase') AS purchases,
  SUM(CASE WHEN event_name = 'click' THEN CAST(value * 100 AS BIGINT) END) / 100
    / COUNT(*) FILTER (WHERE event_name = 'click') AS avg_engagement
FROM ev GROUP BY ALL""",
)


def trend(t: Tables):
    return E.daily_trend(event_rows(t), "click", "signup", "purchase", "value")


@query(
    "multi_day_trend",
    with_sql(EVENTS, TREND, body="SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM trend"),
)
def _(t):
    return trend(t).orderBy("event_date")


@query(
    "weekday_pattern",
    with_sql(
        EVENTS,
        TREND,
        body="""SELECT CAST(isodow(event_date) - 1 AS INTEGER) AS weekday_no, dayname(event_date) AS weekday,
  SUM(daily_active_users)::DOUBLE / COUNT(*) AS avg_daily_active_users,
  SUM(engaged_users)::DOUBLE / COUNT(*) AS avg_engaged_users,
  SUM(new_users)::DOUBLE / COUNT(*) AS avg_new_users, SUM(purchases)::DOUBLE / COUNT(*) AS avg_purchases
FROM trend GROUP BY isodow(event_date), dayname(event_date)""",
    ),
)
def _(t):
    return E.weekday_pattern(trend(t))


@query(
    "session_conversion",
    with_sql(
        EVENTS,
        (
            "s",
            """SELECT user_id, session_id, bool_or(event_name = 'view') AS viewed, bool_or(event_name = 'purchase') AS carted
FROM ev WHERE session_id IS NOT NULL GROUP BY ALL""",
        ),
        body="""SELECT COUNT(*) FILTER (WHERE viewed) AS view_sessions, COUNT(*) FILTER (WHERE carted) AS cart_sessions,
  ROUND(COUNT(*) FILTER (WHERE carted)::DOUBLE / COUNT(*) FILTER (WHERE viewed), 6) AS conversion_rate FROM s""",
    ),
)
def _(t):
    return E.session_conversion(event_rows(t), "view", "purchase")


@query("fn_param_get", with_sql(EVENTS, body="SELECT event_id, k, event_name AS kind FROM ev"))
def _(t):
    return event_rows(t).select(
        "event_id",
        V.param_get("event_params", "k", "int_value").alias("k"),
        V.param_get("event_params", "kind", "string_value").alias("kind"),
    )


@query(
    "fn_param_explode",
    with_sql(
        EVENTS,
        body="""SELECT k AS param_value, COUNT(*) AS n FROM ev WHERE event_name = 'purchase' GROUP BY ALL
ORDER BY n DESC, param_value LIMIT 20""",
    ),
)
def _(t):
    return E.param_counts(event_rows(t), "purchase", "k")


@query(
    "fn_ts_micros",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS hours_in FROM events""",
)
def _(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t.events.select("event_id", micros.alias("us")).select(
        "event_id",
        V.micros_to_ts("us").alias("at"),
        F.timestamp_diff("HOUR", start, V.micros_to_ts("us")).alias("hours_in"),
    )
