"""Aggregations: order statistics, quantifiers, weighted means, pivots, histograms, reconciliations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(c: Column, scale: int = 4) -> Column:
    """Sum of a double by decimal arithmetic: the same whatever the order of rows."""
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def for_all(c: Column, when_none: bool) -> Column:
    """Whether all non-null values hold; ``when_none`` where there is no such value."""
    return F.coalesce(F.bool_and(c), F.lit(when_none))


def joined_distinct(c: Column, sep: str = ";") -> Column:
    """Sorted distinct values in one string."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def first_valid(value: Column, *order: Column) -> Column:
    """The non-null value that comes first in the order."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def quantile(c: Column, p: float) -> Column:
    """Exact quantile with linear interpolation (type 7) as one aggregate. It holds a group's distinct values in one
    task: for groups of bounded size; `quantiles` has no such bound."""
    return F.percentile(c, F.lit(p))


#: Cells that an order statistic's values are dealt into.
CELLS = 2048


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column], size: str | None = None) -> DataFrame:
    """Values at 0-based ranks of the sorted non-null values; a pick is an expression over the group's size ``n``, which
    comes out as column ``size`` if that is given.

    No group is sorted or gathered: a sketch cuts the values' range into CELLS cells of about equal counts, a second pass
    counts rows by group and cell, and only the cells that hold a wanted rank are looked at value by value. The sketch
    decides how even the cells are, never the result."""
    keys = list(keys)
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = v.agg(F.percentile_approx("_v", [i / CELLS for i in range(1, CELLS)], 10_000)).first()[0] or []  # one array
    splits = [-float("inf"), *sorted({float(c) for c in cuts if c is not None and abs(float(c)) != float("inf") and c == c} or {0.0}), float("inf")]
    celled = Bucketizer(splits=splits, inputCol="_d", outputCol="_cell", handleInvalid="keep").transform(v.withColumn("_d", F.col("_v").cast("double"))).drop("_d")
    counts = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*keys)
    n = F.sum("_c").over(by).alias("n")
    before = (F.sum("_c").over(by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before")
    wanted = counts.select(*keys, "_cell", "_c", n, before).select(*keys, "_cell", "_c", "_before", F.col("n").alias("_n"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), p.cast("long").alias("at")) for k, p in picks.items()])).alias("_p"))
    wanted = wanted.where((F.col("_p.at") >= F.col("_before")) & (F.col("_p.at") < F.col("_before") + F.col("_c"))).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cell").alias("_in"), "_before", "_n", F.col("_p.name").alias("_name"), F.col("_p.at").alias("_at"))
    same = F.col("_cell") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    cells = wanted.select(*[f"_k_{k}" for k in keys], "_in").distinct()
    held = celled.join(cells, same, "left_semi").groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("_upto", upto).join(wanted, same)
    hit = (F.col("_at") - F.col("_before")).between(F.col("_upto") - F.col("_c"), F.col("_upto") - 1)
    sizes = [] if size is None else [F.max("_n").alias(size)]
    return found.where(hit).groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in picks], *sizes)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (type 7) per group, by `order_statistic`: name -> probability."""
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ends = order_statistic(df, keys, value, {f"_{side}_{name}": f(place(p)) for name, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}, "_size")
    at_end = lambda p: (F.col("_size") - 1) * F.lit(float(p))
    mixed = lambda name, p: F.when(F.floor(at_end(p)) == F.ceil(at_end(p)), F.col(f"_lo_{name}").cast("double")).otherwise((F.ceil(at_end(p)) - at_end(p)) * F.col(f"_lo_{name}") + (at_end(p) - F.floor(at_end(p))) * F.col(f"_hi_{name}"))
    return ends.select(*keys, *[mixed(name, p).alias(name) for name, p in at.items()])


def higher(p: float) -> Column:
    """Rank of the order statistic at or above the quantile."""
    return F.ceil((F.col("n") - 1) * F.lit(p))


def lower_median() -> Column:
    return F.floor((F.col("n") - 1) / 2)


def capped(p: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows with a finite value and a positive weight; null where there is none."""
    good = value.isNotNull() & ~F.isnan(value) & (weight > 0)
    return exact_sum(F.when(good, value * weight)) / F.nullif(exact_sum(F.when(good, weight)), F.lit(0.0))


def arg_max(label: Column, by: Column) -> Column:
    """The label with the largest value, ties to the smallest label."""
    return F.min_by(label, F.struct((-by).alias("by"), label.alias("label")))


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key, ties to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(arg_max(F.col(value), F.col("n")).alias("mode"), F.max("n").alias("n"))


def share_percent(cond: Column) -> Column:
    return F.avg(cond.cast("double")) * 100


def pivot_counts(df: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], prefix: str) -> DataFrame:
    """One count column per value (absent combinations are 0), by conditional counts in one pass."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(on) == v).alias(f"{prefix}{i}") for i, v in enumerate(values, 1)])


def unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def exploded_counts(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """How often each code occurs in a joined list of codes."""
    return df.where(F.col(column) != "").select(F.explode(F.split(column, sep)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the count outside them."""
    q = quantiles(df, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    j = df.select(*keys, value).join(q, list(keys))
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return j.groupBy(*keys, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"))


def ordered_hash(values: Column, order: Column) -> Column:
    """SHA-256 of the values in order, joined by line ends. For groups of bounded size (cohorts, archive lists)."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x["v"]), "\n"), 256)


def reconcile(parts: DataFrame, keys: Sequence[str], total: str, pieces: Sequence[str]) -> DataFrame:
    """Adds ``balanced``: whether the pieces sum to the total."""
    s = F.lit(0)
    for p in pieces:
        s = s + F.coalesce(F.col(p), F.lit(0))
    return parts.withColumn("balanced", F.col(total) == s)


def standard_error(c: Column) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))
