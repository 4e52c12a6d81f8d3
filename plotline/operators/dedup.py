"""Disposition of repeated transaction keys, and the funnel that accounts for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.operators.aggs import reconcile


def dispositions(df: DataFrame, *, key: str, core: Sequence[str], status: Sequence[str], prefer: Sequence, scope: Sequence[str] = ()) -> DataFrame:
    """Adds ``disposition`` and ``kept`` to every row, and ``conflict`` to the kept ones.

    invalid_key: null key, dropped; such rows are no group, and are never brought together. unique: the only row of its key. exact: all rows agree on core and status columns;
    one is kept. status_variant: they agree on the core columns only; one is kept, its disagreeing status columns are
    null and ``conflict`` is true. conflict: the core columns disagree; all rows are quarantined. ``prefer`` must order
    a key's rows totally, best first. With ``scope``, keys are told apart by those columns too (one source, say); they
    must not be null.
    """
    nul = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))
    d = df.withColumn("_core", F.xxhash64(*[nul(c) for c in core])).withColumn("_all", F.xxhash64(*[nul(c) for c in [*core, *status]]))
    by = [*scope, key]
    groups = d.where(F.col(key).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_distinct("_core").alias("_cores"), F.count_distinct("_all").alias("_alls"),
        *[F.count_distinct(nul(s)).alias(f"_s_{s}") for s in status],
    )
    # rows without a key join nothing and take part in no window
    lost = d.where(F.col(key).isNull())
    d = d.where(F.col(key).isNotNull()).join(groups, by, "left")
    kind = (
        F.when(F.col("_rows") == 1, "unique").when(F.col("_alls") == 1, "exact").when(F.col("_cores") == 1, "status_variant").otherwise("conflict")
    )
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*prefer))
    d = d.withColumn("disposition", kind).withColumn("kept", F.col("disposition").isin("unique", "exact", "status_variant") & (nth == 1))
    d = d.withColumn("conflict", F.col("disposition") == "status_variant")
    d = d.withColumns({s: F.when(~F.col("conflict") | (F.col(f"_s_{s}") == 1), F.col(s)) for s in status})
    lost = lost.select(*df.columns, F.lit("invalid_key").alias("disposition"), F.lit(False).alias("kept"), F.lit(False).alias("conflict"))
    return d.select(*df.columns, "disposition", "kept", "conflict").unionByName(lost)


def funnel(disposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: raw = invalid + exact copies + variant copies + conflicting + kept rows, and whether that holds."""
    gone = lambda k: F.count_if((F.col("disposition") == k) & ~F.col("kept"))
    f = disposed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw"), gone("invalid_key").alias("invalid"), gone("exact").alias("exact"), gone("status_variant").alias("variant"), gone("conflict").alias("conflicting"), F.count_if("kept").alias("kept"),
    )
    return reconcile(f, keys, "raw", ["invalid", "exact", "variant", "conflicting", "kept"])


def quality_events(disposed: DataFrame, key: str) -> DataFrame:
    """(key, issue_code, severity, rows) per collapsed or quarantined key."""
    code = {"invalid_key": ("invalid_transaction_key", "error"), "exact": ("exact_duplicate_collapsed", "info"), "status_variant": ("status_variant_collapsed", "warning"), "conflict": ("conflicting_duplicate", "error")}
    d = disposed.where(F.col("disposition").isin(list(code)) & ~F.col("kept"))
    pick = lambda i: F.coalesce(*[F.when(F.col("disposition") == k, v[i]) for k, v in code.items()])
    return d.groupBy(key, "disposition").agg(F.count(F.lit(1)).alias("rows")).select(key, pick(0).alias("issue_code"), pick(1).alias("severity"), "rows")
