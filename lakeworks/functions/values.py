"""Mapping, banding, guards, exact sums, masks and time conversions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q_NULL = -(2**63)
Q_NEG_INF = Q_NULL + 1
Q_POS_INF = 2**63 - 1
# Nanoseconds from 1970-01-01 to 2000-01-01.
Q_EPOCH_SHIFT_NS = 946_684_800_000_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case_map(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Map values; anything unlisted, NULL included, becomes ``default``."""
    c = col(c)
    out = None
    for key, value in mapping.items():
        cond = c == F.lit(key)
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def case_group(c: Column | str, groups: Mapping[str, Sequence], default: str) -> Column:
    """Name the first group whose value list holds the column."""
    c = col(c)
    out = None
    for name, values in groups.items():
        cond = c.isin(list(values))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default))


def first_match(bands: Sequence[tuple[Column, object]], default) -> Column:
    """Ordered bands: the first true condition names the row, NULL falls to ``default``."""
    out = None
    for cond, name in bands:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default))


def convert_currency(amount: Column | str, currency: Column | str, rates: Mapping[str, float]) -> Column:
    """Amount times its currency's rate; an unknown currency keeps the amount."""
    amount = col(amount)
    return case_map(currency, {k: (amount if r == 1 else amount * F.lit(float(r))) for k, r in rates.items()}, amount)


def flag(cond: Column) -> Column:
    """A predicate as a flag that is never NULL."""
    return F.coalesce(cond, F.lit(False))


def safe_divide(a: Column, b: Column) -> Column:
    """``a / b``, NULL on a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded percentage, NULL when the whole is zero."""
    return F.round(safe_divide(part, whole) * 100, digits)


def fixed_units(c: Column | str, places: int = 2) -> Column:
    """A decimal amount as a whole number of its smallest unit."""
    return F.rint(col(c) * F.lit(float(10**places))).cast("long")


def total_units(units: Column) -> Column:
    """Exact total of longs as a double. High and low parts are added apart, so a sum over
    hundreds of billions of rows stays inside a long and off the slow decimal path."""
    high = F.sum(F.shiftright(units, 20)).cast("double") * F.lit(1048576.0)
    return high + F.sum(units.bitwiseAND(F.lit(1048575))).cast("double")


def fixed_sum(c: Column | str, places: int = 2) -> Column:
    """Sum that does not depend on row order: adds whole units, divides once."""
    return total_units(fixed_units(c, places)) / F.lit(float(10**places))


def fixed_avg(c: Column | str, places: int = 2) -> Column:
    """Mean over the exact sum, NULL without values."""
    c = col(c)
    return F.try_divide(total_units(fixed_units(c, places)), F.count(c).cast("double")) / F.lit(float(10**places))


def mask(c: Column | str, rule: str, data_type: T.DataType | None = None) -> Column:
    """Masked value of a column under a named rule."""
    c = col(c)
    if rule == "SHA256":
        return F.sha2(c.cast("string"), 256)
    if rule == "ALWAYS_NULL":
        return F.lit(None).cast(data_type) if data_type is not None else F.when(F.lit(False), c)
    if rule == "DEFAULT_MASKING_VALUE":
        return _default_value(data_type or T.StringType())
    if rule == "LAST_FOUR_CHARACTERS":
        return F.right(c.cast("string"), F.lit(4))
    raise ValueError(f"unknown masking rule {rule!r}")


def _default_value(data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.lit("")
    if isinstance(data_type, T.NumericType):
        return F.lit(0).cast(data_type)
    if isinstance(data_type, T.BooleanType):
        return F.lit(False)
    if isinstance(data_type, T.DateType):
        return F.lit("1970-01-01").cast(data_type)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(data_type)
    return F.lit(None).cast(data_type)


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def _finite_q(raw: Column) -> Column:
    bad = (raw == F.lit(Q_NEG_INF)) | (raw == F.lit(Q_POS_INF))
    checked = F.when(bad, F.raise_error(F.lit("infinite timestamp")).cast("long")).otherwise(raw)
    return F.when(raw == F.lit(Q_NULL), F.lit(None).cast("long")).otherwise(checked)


def q_ns_to_unix_ns(c: Column | str) -> Column:
    """Nanoseconds since 2000 to nanoseconds since 1970, kept as a long.

    The null sentinel becomes NULL; infinities and values beyond the range raise.
    """
    raw = _finite_q(col(c))
    too_big = raw > F.lit(Q_POS_INF - Q_EPOCH_SHIFT_NS)
    shift = F.lit(Q_EPOCH_SHIFT_NS)
    return F.when(too_big, F.raise_error(F.lit("timestamp out of range")).cast("long")).otherwise(
        F.when(~too_big, raw) + shift
    )


def q_ns_to_unix_us(c: Column | str) -> Column:
    """Nanoseconds since 2000 to microseconds since 1970, truncated toward zero."""
    return div(_finite_q(col(c)), 1000) + F.lit(Q_EPOCH_SHIFT_NS // 1000)


def div(a: Column, b: Column | int) -> Column:
    """Integer division, truncating toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def micros_to_ts(c: Column | str) -> Column:
    return F.timestamp_micros(col(c))


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def has_any(arr: Column | str, values: Sequence[str]) -> Column:
    """True when the array holds one of the values."""
    return F.arrays_overlap(col(arr), F.array(*[F.lit(v) for v in values]))


def param_get(params: Column | str, key: str, field: str) -> Column:
    """Value field of the first parameter struct with this key, else NULL."""
    hits = F.filter(col(params), lambda p: p["key"] == F.lit(key))
    return F.get(hits, F.lit(0))["value"][field]


def zero_padded(c: Column | str, width: int) -> Column:
    """Decimal text padded to a least width; longer numbers stay whole."""
    text = col(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def uuid_of(n: Column | str) -> Column:
    """The UUID text of a non-negative 64 bit number."""
    h = F.lower(F.lpad(F.hex(col(n).cast("long")), 32, "0"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in cuts])
