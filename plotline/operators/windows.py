"""Window and time-series operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.operators.aggs import quantiles


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in a total order (latest wins with descending orders)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def classify_repeats(df: DataFrame, key: str, content: str, order: Sequence[Column]) -> DataFrame:
    """Adds ``change``: first_seen, repeat_identical or repeat_revised against the key's previous row."""
    w = Window.partitionBy(key).orderBy(*order)
    n, before = F.row_number().over(w), F.lag(content).over(w)
    return df.withColumn("change", F.when(n == 1, "first_seen").when(before.eqNullSafe(F.col(content)), "repeat_identical").otherwise("repeat_revised"))


def classify_gaps(days: DataFrame, day: str, late: int = 7, missing: int = 10) -> DataFrame:
    """Gap in days to the previous distinct extract and its class. One row per extract: a registry's size."""
    gap = F.datediff(day, F.lag(day).over(Window.orderBy(day)))
    kind = F.when(gap.isNull(), "first").when(gap == 0, "same_day").when(gap > missing, "probable_missing").when(gap > late, "delayed").otherwise("normal")
    return days.withColumn("gap_days", gap).withColumn("gap_class", kind)


def rolling_median(df: DataFrame, keys: Sequence[str], order: str, value: str, reach: int, least: int, name: str) -> DataFrame:
    """Centred median over 2 * reach + 1 rows, null with fewer than ``least`` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    a = F.array_sort(F.collect_list(value).over(w))
    n = F.size(a)
    lo, hi = F.element_at(a, F.floor((n + 1) / 2).cast("int")), F.element_at(a, F.floor(n / 2).cast("int") + 1)
    return df.withColumn(name, F.when(n >= least, (lo + hi) / 2))


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Centred mean of three rows, null at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)
    return df.withColumn(name, F.when(F.count(value).over(w) == 3, F.avg(value).over(w)))


def lags(df: DataFrame, keys: Sequence[str], order: str, value: str, steps: Sequence[int]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in steps})


def month_spine(spark, first: Column, last: Column, bounds: DataFrame) -> DataFrame:
    """One row per month from the first to the last of a one-row frame."""
    return bounds.select(F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias("month_start"))


def interpolate(df: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Fills interior gaps on a line between neighbours by position; adds ``imputed``. Edge gaps stay null."""
    base = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_p", F.row_number().over(base))
    back, ahead = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v")))
    d = d.withColumn("_a", F.last(at, True).over(back)).withColumn("_b", F.first(at, True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_p") - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
    out = F.coalesce(F.col(value), line)
    return d.withColumn("imputed", F.col(value).isNull() & line.isNotNull()).withColumn(value, out).drop("_p", "_a", "_b")


def index_to_base(df: DataFrame, keys: Sequence[str], value: str, is_base: Column, name: str) -> DataFrame:
    """value / (mean of the base rows' values in the group) * 100."""
    return df.withColumn(name, F.col(value) / F.avg(F.when(is_base, F.col(value))).over(Window.partitionBy(*keys)) * 100)


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ids from 1 in alphabetical order, by ranking the distinct values alone."""
    ids = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)))
    return df.join(ids, column, "left")


def impute_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    m = quantiles(df, keys, value, {"_m": 0.5})
    return df.join(m, list(keys), "left").withColumn(name, F.coalesce(value, "_m")).drop("_m")


def clamp(c: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))
