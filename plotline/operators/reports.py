"""Listing-source filters, the bridge into the established contract, panel diagnostics, reconciliation checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.joins import assert_unique


def listings_by_region_text(df: DataFrame, state: str, region: str, states: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of the states whose region text contains one of the names."""
    return df.where(F.col(state).isin(list(states)) & F.col(region).rlike("|".join(names)))


def listings_complete(df: DataFrame, region: str, regions: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rows of the regions with every metric present; overlapping periods are not told apart."""
    return df.where(F.col(region).isin(list(regions))).na.drop(subset=list(metrics))


def listings_monthly(df: DataFrame, *, kind: Column, period: Column, dimension: DataFrame, on: str, keys: Sequence[str]) -> DataFrame:
    """Rows of one region kind and period length, joined with the dimension by its derived region name; the key must
    be unique afterwards."""
    return assert_unique(df.where(kind & period).join(dimension, on), keys, "listings")


def bridge(sales: DataFrame, valid: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, audit): the audit counts the rows left after each rule in turn."""
    keep, steps = F.lit(True), [F.count(F.lit(1)).alias("rows")]
    for name, rule in valid.items():
        keep = keep & F.coalesce(rule, F.lit(False))
        steps.append(F.count_if(keep).alias(f"after_{name}"))
    return sales.where(keep), sales.agg(*steps)


def panel_balance(panel: DataFrame, keys: Sequence[str], months: str, expected: int) -> DataFrame:
    """Cells, distinct months and completeness per panel unit."""
    g = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(months).alias("months"))
    return g.withColumn("balanced", (F.col("cells") == expected) & (F.col("months") == expected))


def join_diagnostics(panel: DataFrame, sources: Mapping[str, str]) -> DataFrame:
    """(source, matched, unmatched): rows with and without a value of each joined source, in one pass."""
    one = panel.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"m_{s}") for s, c in sources.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"m_{s}").alias("matched"), (F.col("n") - F.col(f"m_{s}")).alias("unmatched")) for s in sources])))


def strict_availability(flags: Sequence[str]) -> Column:
    """Whether every flag is known."""
    out = F.lit(True)
    for f in flags:
        out = out & F.col(f).isNotNull()
    return out


def store_bridge(store: DataFrame, funnel: DataFrame, key: str) -> DataFrame:
    """Counts of the store beside those of the funnel, absent ones 0, and whether they agree."""
    j = store.join(funnel, key, "full").na.fill(0, ["store_rows", "funnel_rows"])
    return j.withColumn("equal", F.col("store_rows") == F.col("funnel_rows"))


def checks(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, passed, rows): whether a boolean column holds in every row of each frame (an empty one passes)."""
    out = None
    for name, (df, column) in frames.items():
        one = df.agg(F.coalesce(F.bool_and(column), F.lit(True)).alias("passed"), F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "passed", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def regime_index(df: DataFrame, keys: Sequence[str], regime: str, value: str, base: str) -> DataFrame:
    """Mean per regime and its index to the base regime's mean (100)."""
    from plotline.operators.windows import index_to_base

    g = df.where(F.col(regime).isNotNull()).groupBy(*keys, regime).agg(F.avg(value).alias("mean"))
    return index_to_base(g, keys, "mean", F.col(regime) == base, "index")
