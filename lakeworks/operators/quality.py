"""Data tests, table-against-table parity, result comparison and profiles.

Parity functions return rows (test, metric, base, other, diff, passed). Tests say what they need of a side;
``parity`` takes all aggregates from one pass over it, and all counts of values from one more. The two
sides are brought together by one union and a grouping, never by a join of every row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import fixed_sum, safe_divide
from ..session import settle
from .dedup import schema_diff
from .ordered import with_global_rank
from .pairing import near, pairs_within

# Fixed thresholds.
ROW_TOLERANCE = 0.001
METRIC_TOLERANCE = 0.001
NULL_TOLERANCE = 0.05
HIGH_SHARE = 0.9
PARITY = ["test", "metric", "base", "other", "diff", "passed"]


# --- column tests ------------------------------------------------------------------------


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values on more than one row. NULL keys are not counted."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(known).groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a value per column, in one pass."""
    return _tall(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]), columns, "column", "failures")


def unaccepted(df: DataFrame, accepted: Mapping[str, Sequence]) -> DataFrame:
    """Values outside the accepted list per column; NULL passes."""
    bad = [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(v))).alias(c) for c, v in accepted.items()]
    return _tall(df.agg(*bad), list(accepted), "column", "failures")


def assertions(df: DataFrame, unique_key: Sequence[str], not_null: Sequence[str]) -> DataFrame:
    """Failing rows per assertion: one unique key and a list of required columns."""
    dup = duplicated(df, unique_key).agg(
        F.lit("unique").alias("assertion"), F.lit(",".join(unique_key)).alias("column"), F.coalesce(F.sum("rows"), F.lit(0)).alias("failures")
    )
    required = nulls(df, not_null).select(F.lit("not_null").alias("assertion"), "column", "failures")
    return dup.unionByName(required)


def _tall(row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """One row with a column per metric to one row per metric."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns])
    return row.select(F.inline(pairs))


# --- parity ------------------------------------------------------------------------------


def relative_diff(base: Column, other: Column) -> Column:
    """Difference relative to the base; a zero base differs by 0 or by 1."""
    none = F.when(other == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(base == 0, none).otherwise(safe_divide(F.abs(base - other), F.abs(base)))


@dataclass(frozen=True)
class Check:
    """What one parity test asks of both sides: aggregates of the whole table, or rows per value of a column.

    ``relative`` differences are measured against the base. ``top`` keeps the most frequent values of either
    side and compares their shares. Text aggregates must be equal.
    """

    test: str
    tolerance: float = 0.0
    relative: bool = True
    aggs: Mapping[str, Column] | None = None
    text: Mapping[str, Column] | None = None
    value: Column | None = None
    top: int | None = None


def rows_check(tolerance: float = ROW_TOLERANCE) -> Check:
    return Check("row_count", tolerance, aggs={"rows": F.count("*")})


def distinct_check(keys: Sequence[str]) -> Check:
    return Check("distinct_count", aggs={"+".join(keys): F.count_distinct(*keys)})


def sums_check(columns: Sequence[str], tolerance: float = METRIC_TOLERANCE, places: int = 2) -> Check:
    return Check("metric_sum", tolerance, aggs={c: fixed_sum(c, places) for c in columns})


def stats_check(columns: Sequence[str], tolerance: float = METRIC_TOLERANCE, places: int = 2) -> Check:
    aggs: dict[str, Column] = {}
    for c in columns:
        aggs[f"{c}.sum"] = fixed_sum(c, places)
        aggs[f"{c}.avg"] = safe_divide(fixed_sum(c, places), F.count(c))
        aggs[f"{c}.min"] = F.min(c)
        aggs[f"{c}.max"] = F.max(c)
    return Check("metric_stats", tolerance, aggs=aggs)


def null_rates_check(columns: Sequence[str], tolerance: float = NULL_TOLERANCE) -> Check:
    rates = {c: safe_divide(F.count_if(F.col(c).isNull()), F.count("*")) for c in columns}
    return Check("null_rate", tolerance, relative=False, aggs=rates)


def null_counts_check(columns: Sequence[str]) -> Check:
    return Check("null_count", relative=False, aggs={c: F.count_if(F.col(c).isNull()) for c in columns})


def ranges_check(columns: Sequence[str]) -> Check:
    return Check("date_range", text={f"{c}.{n}": f(c).cast("string") for c in columns for n, f in (("min", F.min), ("max", F.max))})


def distribution_check(column: str, top: int = 10, tolerance: float = 0.05) -> Check:
    return Check("distribution", tolerance, relative=False, value=F.col(column).cast("string"), top=top)


def temporal_check(column: str, grain: str = "month", tolerance: float = ROW_TOLERANCE) -> Check:
    return Check("temporal", tolerance, value=F.date_format(F.date_trunc(grain, F.col(column)), "yyyy-MM-dd"))


def partitions_check(column: str) -> Check:
    return Check("partition_count", relative=False, value=F.col(column).cast("string"))


def _aggregated(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(place, metric, value, text) of all aggregates, from one pass over the table."""
    packed = []
    for i, check in enumerate(checks):
        for name, c in (check.aggs or {}).items():
            value = F.coalesce(c.cast("double"), F.lit(0.0))
            packed.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("metric"), value.alias("value"), F.lit(None).cast("string").alias("text")))
        for name, c in (check.text or {}).items():
            packed.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("metric"), F.lit(None).cast("double").alias("value"), c.alias("text")))
    return df.agg(F.array(*packed).alias("_all")).select(F.inline("_all"))


def _counted(df: DataFrame, values: Mapping[int, Column]) -> DataFrame:
    """(place, metric, value) with the rows per value of several columns, from one pass; ``place`` -1 has all rows."""
    names = {place: f"_v{place}" for place in values}
    rows = df.select(*[c.alias(names[place]) for place, c in values.items()])
    sets = [[n] for n in names.values()] + [[]]
    counts = rows.groupingSets(sets, *names.values()).agg(F.grouping_id().alias("_set"), F.count("*").cast("double").alias("value"))
    full = (1 << len(names)) - 1
    place, metric = F.lit(-1), F.lit(None).cast("string")
    for i, (number, name) in enumerate(names.items()):
        mine = F.col("_set") == full - (1 << (len(names) - 1 - i))
        place, metric = F.when(mine, number).otherwise(place), F.when(mine, F.col(name)).otherwise(metric)
    return counts.select(place.alias("place"), metric.alias("metric"), "value")


def _judge(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Rows of place, metric, base, other and their texts, with the tests' names and verdicts."""
    known = [F.struct(F.lit(c.test).alias("test"), F.lit(float(c.tolerance)).alias("tolerance"), F.lit(c.relative).alias("relative")) for c in checks]
    found = F.element_at(F.array(*known), F.col("place") + 1)
    away = F.abs(F.col("base") - F.col("other"))
    diff = F.when(F.col("_check.relative"), relative_diff(F.col("base"), F.col("other"))).otherwise(away)
    near = F.coalesce(F.col("diff") <= F.col("_check.tolerance"), F.lit(False))
    same = F.col("base_text").eqNullSafe(F.col("other_text"))
    judged = rows.withColumn("_check", found).withColumn("diff", diff)
    is_text = F.col("base").isNull() & F.col("other").isNull()
    return judged.select(
        F.col("_check.test").alias("test"), "metric", "base", "other", "diff", F.when(is_text, same).otherwise(near).alias("passed"), "place", "base_text", "other_text"
    )


def _parity(base: DataFrame, other: DataFrame, checks: Sequence[Check]) -> DataFrame:
    sides = (base, other)
    parts = []
    if any(c.aggs or c.text for c in checks):
        tall = [_aggregated(df, checks).withColumn("_side", F.lit(i)) for i, df in enumerate(sides)]
        mine = [F.col("_side") == i for i in range(2)]
        picked = [F.max(F.when(m, F.col(v))).alias(n) for v, names in (("value", ("base", "other")), ("text", ("base_text", "other_text"))) for m, n in zip(mine, names)]
        parts.append(tall[0].unionByName(tall[1]).groupBy("place", "metric").agg(*picked))
    values = {i: c.value for i, c in enumerate(checks) if c.value is not None}
    if values:
        tall = [_counted(df, values).withColumn("_side", F.lit(i)) for i, df in enumerate(sides)]
        picked = [F.coalesce(F.max(F.when(F.col("_side") == i, F.col("value"))), F.lit(0.0)).alias(n) for i, n in enumerate(("base", "other"))]
        counts = tall[0].unionByName(tall[1]).groupBy("place", "metric").agg(*picked)
        none = {n: F.lit(None).cast("string") for n in ("base_text", "other_text")}
        shared = {i: c.top for i, c in enumerate(checks) if c.top is not None}
        if shared:
            # Read several times: one row per value.
            counts = settle(counts, "counts")
            totals = counts.filter("place = -1").select(F.col("base").alias("_base_rows"), F.col("other").alias("_other_rows")).first() or (0.0, 0.0)
            of = {n: F.lit(total) for n, total in zip(("base", "other"), totals)}
            for place, top in shared.items():
                shares = counts.filter(F.col("place") == place).withColumns({n: F.coalesce(safe_divide(F.col(n), of[n]), F.lit(0.0)) for n in of})
                leaders = [shares.filter(F.col(n) > 0).orderBy(F.col(n).desc(), "metric").limit(top).select("place", "metric") for n in of]
                kept = leaders[0].union(leaders[1]).distinct().withColumnRenamed("metric", "_named")
                parts.append(shares.join(kept.select("_named"), F.col("metric").eqNullSafe(F.col("_named")), "left_semi").withColumns(none))
        whole = [i for i in values if i not in shared]
        if whole:
            parts.append(counts.filter(F.col("place").isin(whole)).withColumns(none))
    columns = ["place", "metric", "base", "other", "base_text", "other_text"]
    return _judge(reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]), checks)


def parity(base: DataFrame, other: DataFrame, checks: Sequence[tuple[Check, str]]) -> DataFrame:
    """Many tests at once: (test, metric, base, other, diff, passed, priority, base_text, other_text).

    ``checks`` pairs tests with priorities. All aggregates come from one pass over each side, and all counts of
    values from one more, whatever the number of tests.
    """
    rows = _parity(base, other, [c for c, _ in checks])
    priority = F.element_at(F.array(*[F.lit(p) for _, p in checks]), F.col("place") + 1)
    return rows.withColumn("priority", priority).select(*PARITY, "priority", "base_text", "other_text")


def row_count(base: DataFrame, other: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    return _parity(base, other, [rows_check(tolerance)]).select(*PARITY)


def distinct_count(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _parity(base, other, [distinct_check(keys)]).select(*PARITY)


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the distinct keys."""
    extra = F.count("*") - F.count_distinct(*keys)
    return df.agg(F.count("*").alias("rows"), extra.alias("duplicates")).withColumn("passed", F.col("duplicates") == 0)


def metric_sums(base: DataFrame, other: DataFrame, columns: Sequence[str], tolerance: float = METRIC_TOLERANCE, places: int = 2) -> DataFrame:
    return _parity(base, other, [sums_check(columns, tolerance, places)]).select(*PARITY)


def metric_stats(base: DataFrame, other: DataFrame, columns: Sequence[str], tolerance: float = METRIC_TOLERANCE, places: int = 2) -> DataFrame:
    """Sum, mean, least and greatest value per column."""
    return _parity(base, other, [stats_check(columns, tolerance, places)]).select(*PARITY)


def null_rates(base: DataFrame, other: DataFrame, columns: Sequence[str] | None = None, tolerance: float = NULL_TOLERANCE) -> DataFrame:
    """Difference of the null share of every column."""
    names = list(columns or [c for c in base.columns if c in other.columns])
    return _parity(base, other, [null_rates_check(names, tolerance)]).select(*PARITY)


def null_counts(base: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _parity(base, other, [null_counts_check(columns)]).select(*PARITY)


def date_ranges(base: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First and last value per column must be the same."""
    rows = _parity(base, other, [ranges_check(columns)])
    return rows.select("test", "metric", F.col("base_text").alias("base"), F.col("other_text").alias("other"), "passed")


def distribution(base: DataFrame, other: DataFrame, column: str, top: int = 10, tolerance: float = 0.05) -> DataFrame:
    """Shares of the most frequent values; the top values of either side are compared."""
    return _parity(base, other, [distribution_check(column, top, tolerance)]).select(*PARITY)


def temporal(base: DataFrame, other: DataFrame, column: str, grain: str = "month", tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Rows per period on both sides."""
    return _parity(base, other, [temporal_check(column, grain, tolerance)]).select(*PARITY)


def partition_counts(base: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Rows per partition must be equal."""
    return _parity(base, other, [partitions_check(column)]).select(*PARITY)


def width(df: DataFrame, schema: T.StructType | Sequence[str]) -> tuple[int, int, bool]:
    """(columns found, columns expected, equal)."""
    expected = len(schema.fields) if isinstance(schema, T.StructType) else len(schema)
    return len(df.columns), expected, len(df.columns) == expected


def schema_problems(base: DataFrame, other: DataFrame) -> DataFrame:
    """Missing, extra and retyped columns as rows."""
    return base.sparkSession.createDataFrame(
        schema_diff(base, other), "column string, problem string, base_type string, other_type string"
    )


def ns_fidelity(base: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Nanosecond longs: rows that changed, and rows whose digits below a microsecond survive."""
    both = base.select(key, F.col(column).alias("_a")).join(other.select(key, F.col(column).alias("_b")), key)
    below = F.col("_a") % 1000 != 0
    return both.agg(
        F.count("*").alias("compared"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
        F.count_if(below).alias("with_sub_micro"),
        F.count_if(below & (F.col("_a") % 1000 == F.col("_b") % 1000)).alias("sub_micro_kept"),
    )


def decision(results: DataFrame) -> DataFrame:
    """Approved when every CRITICAL row and over nine tenths of the HIGH rows passed."""
    level = F.col("priority")
    failed = F.count_if((level == "CRITICAL") & ~F.col("passed"))
    high = F.count_if(level == "HIGH")
    share = F.coalesce(safe_divide(F.count_if((level == "HIGH") & F.col("passed")), high), F.lit(1.0))
    row = results.agg(failed.alias("critical_failed"), F.round(share, 4).alias("high_share"))
    good = (F.col("critical_failed") == 0) & (F.col("high_share") > HIGH_SHARE)
    return row.withColumn("decision", F.when(good, "APPROVED").otherwise("NOT READY"))


# --- result comparison -------------------------------------------------------------------

_FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
_HASH = ["_h1", "_h2"]
_COUNTS = ["compared", "different", "base_only", "other_only"]


def result_compare(
    base: DataFrame, other: DataFrame, relative: float = 1e-6, absolute: float = 1e-9, order: Sequence[str] | None = None
) -> DataFrame:
    """Rows compared, rows that differ beyond the tolerance and rows only on one side.

    Without ``order`` the rows are multisets: of rows that agree in every exact column as many as can be
    are paired within the tolerance, and the rest that have a counterpart differ. With ``order`` (a unique one) rows pair by
    position. Columns pair by position too.
    """
    names = [f"c{i}" for i in range(len(base.columns))]
    fractions = [
        n
        for n, f, g in zip(names, base.schema.fields, other.schema.fields, strict=True)
        if isinstance(f.dataType, _FRACTIONS) or isinstance(g.dataType, _FRACTIONS)
    ]
    exact = [n for n in names if n not in fractions]

    def plain(df: DataFrame) -> DataFrame:
        cols = [F.col(f"`{c}`").cast("double" if n in fractions else "string").alias(n) for n, c in zip(names, df.columns)]
        return df.select(*cols)

    def same(n: str) -> Column:
        a, b = F.col(f"a.{n}"), F.col(f"b.{n}")
        if n not in fractions:
            return a.eqNullSafe(b)
        return F.coalesce(near(a, b, relative, absolute), F.lit(False)) | a.eqNullSafe(b)

    def counts(pairs: DataFrame, compared: Sequence[str]) -> DataFrame:
        """Counts of pairs ``a``, ``b``, where a missing side is NULL."""
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        equal = reduce(lambda x, y: x & y, [same(n) for n in compared], F.lit(True))
        found = [both, both & ~equal, F.col("a").isNotNull() & F.col("b").isNull(), F.col("a").isNull() & F.col("b").isNotNull()]
        return pairs.agg(*[F.count_if(c).alias(n) for n, c in zip(_COUNTS, found)])

    if order is None:
        found = _multiset_counts(plain(base), plain(other), exact, fractions, relative, absolute)
    else:
        by_name = dict(zip(base.columns, names))
        sort = [by_name[c] for c in order]
        left, right = (
            with_global_rank(plain(df), sort, "_rank").select("_rank", F.struct(*names).alias(tag)) for df, tag in ((base, "a"), (other, "b"))
        )
        found = counts(left.join(right, "_rank", "full"), names)
    return found.withColumn("equal", (F.col("different") == 0) & (F.col("base_only") == 0) & (F.col("other_only") == 0))


def _multiset_counts(base: DataFrame, other: DataFrame, exact: Sequence[str], fractions: Sequence[str], relative: float, absolute: float) -> DataFrame:
    # 128 bits stand for the exact columns; a marker per column keeps a NULL apart from a value moved to its neighbour.
    # A fraction that is NULL, NaN or infinite pairs with its like only, so its kind is exact too.
    marked = [x for n in exact for x in (F.col(n).isNull(), F.col(n))]
    kinds = [F.when(F.isnan(n), 1).when(F.abs(n) == float("inf"), F.signum(n) + 3) for n in fractions]
    numbers = [F.when(F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(F.coalesce(n, F.lit(0.0))) for n in fractions]
    kinds = [F.when(F.col(n).isNull(), 0).otherwise(F.coalesce(k, F.lit(9))).cast("int") for n, k in zip(fractions, kinds)]
    hashes = [F.xxhash64(F.lit(i + 1), *marked, *kinds).alias(h) for i, h in enumerate(_HASH)]
    # -0.0 equals 0.0.
    plain = [(F.when(x == 0, 0.0).otherwise(x)).alias(n) for n, x in zip(fractions, numbers)]
    sides = [df.select(*hashes, F.lit(tag).alias("_side"), *plain) for df, tag in ((base, "a"), (other, "b"))]
    rows = sides[0].unionByName(sides[1])
    mine = {tag: F.col("_side") == tag for tag in "ab"}
    # Sums of the halves of a hash tell whether both sides hold the same rows, whatever their order. They are shuffled with
    # every row, which a second hash would make a tenth longer.
    value = F.xxhash64(F.lit(7), *fractions)
    halves = [F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit((1 << 32) - 1))]
    balance = [F.sum(F.when(mine["a"], h).otherwise(-h)).alias(f"_s{i}") for i, h in enumerate(halves)]
    groups = rows.groupBy(*_HASH).agg(
        *[F.count_if(m).alias(f"n{tag}") for tag, m in mine.items()],
        *balance,
        *[F.max(F.when(m, F.struct(F.lit(True).alias("here"), *fractions))).alias(tag) for tag, m in mine.items()],
    )
    both = F.least("na", "nb")
    equal = reduce(lambda x, y: x & y, [F.col(f"_s{i}") == 0 for i in range(len(halves))])
    single = (F.col("na") == 1) & (F.col("nb") == 1)
    close = reduce(lambda x, y: x & y, [near(F.col(f"a.{n}"), F.col(f"b.{n}"), relative, absolute) for n in fractions], F.lit(True))
    crowded = F.lit(False) if not fractions else (both > 0) & ~single & ~(equal & (F.col("na") == F.col("nb")))
    matched = F.when(single, close.cast("long")).otherwise(both)
    marked_groups = groups.select(*_HASH, "na", "nb", crowded.alias("_crowded"), matched.alias("matched"))
    # Written are the groups that need a closer look, and one row per task for all others.
    keys = [F.when(F.col("_crowded"), F.col(h)).otherwise(F.spark_partition_id()).alias(h) for h in _HASH]
    sums = [F.sum(F.when(F.col("_crowded"), 0).otherwise(F.col("matched"))).alias("matched")]
    sums += [F.sum(x).alias(n) for n, x in (("paired", both), ("base_only", F.col("na") - both), ("other_only", F.col("nb") - both))]
    summed = settle(marked_groups.groupBy("_crowded", *keys).agg(*sums), "compared")
    totals = summed.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("matched", "paired", "base_only", "other_only")])
    looked_at = summed.filter("_crowded").select(*_HASH)
    if fractions and not looked_at.isEmpty():
        # Equal rows are counted before they are brought together.
        times = rows.join(looked_at, _HASH, "left_semi").groupBy(*_HASH, *fractions).agg(*[F.count_if(m).alias(f"n{tag}") for tag, m in mine.items()])
        found = pairs_within(times, _HASH, fractions, relative, absolute)
        zeros = [F.lit(0).cast("long").alias(n) for n in ("paired", "base_only", "other_only")]
        parts = totals.unionByName(found.select("matched", *zeros))
        totals = parts.agg(*[F.sum(n).alias(n) for n in ("matched", "paired", "base_only", "other_only")])
    return totals.select(F.col("paired").alias("compared"), (F.col("paired") - F.col("matched")).alias("different"), "base_only", "other_only")


# --- profiles ----------------------------------------------------------------------------


TOP_VALUES = 5
TRACKED = 10_000  # values that a column's sketch of frequent values holds; counts are exact below three quarters of it
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _as_number(c: Column, kind: T.DataType) -> Column | None:
    """Numbers as they are, times as microseconds; what quartiles are taken of."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    return F.unix_micros(c.cast("timestamp")).cast("double") if isinstance(kind, _TIMES) else None


def _as_text(kind: T.DataType) -> Callable[[Column], Column]:
    if isinstance(kind, _TIMES):
        return lambda c: F.timestamp_micros(c.cast("long")).cast(kind).cast("string")
    return lambda c: c.cast(kind).cast("string")


def table_profile(df: DataFrame, sample: float | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column of any type: rows, null share, approximate distinct values, range, quartiles, frequent values.

    Numbers have a mean and a deviation, text and binary columns have lengths. Columns that cannot be ordered, such as maps,
    have the counts only. One pass over the table: quartiles, distinct and frequent values come from sketches of
    bounded size that tasks make and merge. ``sample`` is a percentage for a quick look.
    """
    if sample is not None:
        df = df.sample(fraction=sample / 100.0, seed=42)
    none = F.lit(None)
    packed = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c, kind = F.col(f"`{f.name}`"), f.dataType
        plain = isinstance(kind, (T.NumericType, *_TIMES, T.StringType, T.BooleanType, T.BinaryType))
        number = _as_number(c, kind)
        value = number if isinstance(kind, T.NumericType) else none.cast("double")
        length = F.length(c).cast("double") if isinstance(kind, (T.StringType, T.BinaryType)) else none.cast("double")
        quartiles = none.cast("array<string>")
        if number is not None:
            quartiles = F.transform(F.percentile_approx(number, [0.25, 0.5, 0.75]), _as_text(kind))
        frequent = none.cast("array<struct<value: string, count: bigint>>")
        if plain and not isinstance(kind, T.BinaryType):
            # The sketch keeps text; a column of all values NULL has no frequent ones.
            found = F.call_function("approx_top_k", c.cast("string"), F.lit(TOP_VALUES), F.lit(TRACKED))
            frequent = F.transform(F.filter(found, lambda x: x["item"].isNotNull()), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("count")))
        packed.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(kind.simpleString()).alias("type"),
                F.count("*").alias("rows"),
                safe_divide(F.count_if(c.isNull()), F.count("*")).alias("null_ratio"),
                (F.approx_count_distinct(c) if plain else none.cast("long")).alias("approx_distinct"),
                (F.min(c) if plain else none).cast("string").alias("least"),
                (F.max(c) if plain else none).cast("string").alias("greatest"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("deviation"),
                quartiles.alias("quartiles"),
                F.min(length).cast("long").alias("shortest"),
                F.max(length).cast("long").alias("longest"),
                frequent.alias("frequent"),
            )
        )
    return df.agg(F.array(*packed).alias("_p")).select(F.inline("_p"))


def table_analysis(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, column count, schema and rows of every table."""
    rows = [
        df.agg(F.lit(name).alias("table"), F.lit(len(df.columns)).alias("columns"), F.lit(df.schema.json()).alias("schema"), F.count("*").alias("rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def merge_descriptions(df: DataFrame, descriptions: Mapping[str, str], overwrite: bool = False) -> DataFrame:
    """Add column descriptions; other metadata, and existing descriptions, stay."""
    cols = []
    for f in df.schema.fields:
        extra = dict(f.metadata)
        if f.name in descriptions and (overwrite or not extra.get("comment")):
            extra["comment"] = descriptions[f.name]
        cols.append(F.col(f"`{f.name}`").alias(f.name, metadata=extra))
    return df.select(*cols)


def descriptions_of(df: DataFrame) -> dict[str, str | None]:
    return {f.name: f.metadata.get("comment") for f in df.schema.fields}


