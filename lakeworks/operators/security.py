"""Row filters and column masks as DataFrame functions.

They shape what a caller of this library sees. They are no enforcement: whoever can read the
files can bypass them, so grants belong in the catalog.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import any_of, mask
from .ranges import in_any, keep_in_ranges, range_expand


class AccessDenied(PermissionError):
    """A column was asked for that the principal may not see, masked or raw."""


def grants_of(access: DataFrame, principal: str, column: str | None = None) -> DataFrame:
    """Grant rows of a principal; emails compare without case."""
    mine = access.filter(F.lower("email") == principal.lower())
    return mine if column is None else mine.filter(F.col("column_name") == column)


def allow_listed(df: DataFrame, access: DataFrame, principal: str, key: str, admins: Iterable[str] = ()) -> DataFrame:
    """Rows whose key is listed for the principal; administrators see every row."""
    if principal.lower() in {a.lower() for a in admins}:
        return df
    return df.join(grants_of(access, principal).select(key).distinct(), key, "left_semi")


def range_listed(
    df: DataFrame, access: DataFrame, principal: str, key: str, keys: DataFrame | None = None, admins: Iterable[str] = ()
) -> DataFrame:
    """Rows whose key lies in any of the principal's ranges, each once.

    ``keys`` is a dimension of all keys; given one, the ranges turn into a key list first.
    """
    if principal.lower() in {a.lower() for a in admins}:
        return df
    ranges = grants_of(access, principal, key)
    if keys is None:
        return keep_in_ranges(df, key, ranges)
    return df.join(range_expand(keys, ranges, key), key, "left_semi")


def first_two_ranges(df: DataFrame, access: DataFrame, principal: str, key: str, admins: Iterable[str] = ()) -> DataFrame:
    """The old rule: only the two ranges with the lowest bounds count."""
    if principal.lower() in {a.lower() for a in admins}:
        return df
    two = grants_of(access, principal, key).orderBy("low_value", "high_value").limit(2)
    return df.filter(in_any(F.col(key), [(r["low_value"], r["high_value"]) for r in two.collect()]))


@dataclass(frozen=True)
class RowPolicy:
    """Members of a group see the rows a predicate selects."""

    group: str
    predicate: Column


def rows_for(df: DataFrame, policies: Sequence[RowPolicy], groups: Iterable[str]) -> DataFrame:
    """Rows any granted policy selects; without a grant there are none."""
    mine = set(groups)
    return df.filter(F.coalesce(any_of([p.predicate for p in policies if p.group in mine]), F.lit(False)))


@dataclass(frozen=True)
class ColumnPolicy:
    """Who sees a column raw and who sees it under a masking rule."""

    raw: frozenset[str] = field(default_factory=frozenset)
    masked: Mapping[str, str] = field(default_factory=dict)  # group -> rule


def columns_for(
    df: DataFrame, policies: Mapping[str, ColumnPolicy], groups: Iterable[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Selected columns, raw or masked; a raw grant wins, no grant on a protected column raises."""
    return df.select(*_views(df, policies, groups, columns or df.columns))


def _views(df, policies, groups, columns) -> list[Column]:
    mine = set(groups)
    out = []
    for name in columns:
        policy = policies.get(name)
        if policy is None or policy.raw & mine:
            out.append(F.col(name))
            continue
        rules = sorted({rule for group, rule in policy.masked.items() if group in mine})
        if not rules:
            raise AccessDenied(f"no access to column {name}")
        if len(rules) > 1:
            raise AccessDenied(f"groups give column {name} different masks: {rules}")
        out.append(mask(name, rules[0], df.schema[name].dataType).alias(name))
    return out


def secure_view(
    df: DataFrame,
    row_policies: Sequence[RowPolicy],
    column_policies: Mapping[str, ColumnPolicy],
    groups: Iterable[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Column access is checked first, then rows are filtered, then values are masked."""
    groups = set(groups)
    views = _views(df, column_policies, groups, columns or df.columns)
    return rows_for(df, row_policies, groups).select(*views)


def visible_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("visible_rows"))
