"""Joins with their contracts: uniqueness checks, unmatched rows, dimensions taken from facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """``df``, once no key occurs twice (one aggregation of the keys alone; the first offender stops it)."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: key {tuple(keys)} is not unique, for example {twice[0].asDict()}")
    return df


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
    return df


def join_n1(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Many-to-one join: the right key must be unique. Catalyst picks the strategy from the right side's size."""
    return left.join(assert_unique(right, keys, "right side"), list(keys), how)


def join_11(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    return join_n1(assert_unique(left, keys, "left side"), right, keys, how)


def full_outer_filled(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: dict[str, object]) -> DataFrame:
    return left.join(right, list(keys), "full").na.fill(fill)


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of small axes (counties, months, tiers): the result is the panel's size by definition."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    return out


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def dimension(fact: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fact.select(*columns).distinct()


def first_and_last(df: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """Per key its first and last version's fields side by side, in one aggregation."""
    by = F.struct(*order)
    aggs = [f(F.struct(*fields), by).alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last"))]
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("versions"), *aggs)
    return g.select(key, "versions", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("first", "last") for f in fields])
