"""Version store of weekly extracts: current view, revisions, accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_view(obs: DataFrame, *, key: str, extract: str, content: str, order: Sequence) -> DataFrame:
    """Latest row per key, with its first extract and whether one extract holds different contents of the key."""
    conflicts = obs.groupBy(key, extract).agg(F.count_distinct(content).alias("_k")).where("_k > 1").select(key, extract).withColumn("_c", F.lit(True))
    w = Window.partitionBy(key)
    top = obs.withColumn("first_extract", F.min(extract).over(w)).withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_n")
    return top.join(conflicts, [key, extract], "left").withColumn("revision_conflict", F.coalesce("_c", F.lit(False))).drop("_c")


def revised_fields(pairs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field) for each field whose first and last values differ (null-safely), and any_revision, or unexplained
    where a key has several versions but no differing field. Input as first_and_last gives it."""
    differ = F.filter(F.array(*[F.when(~F.col(f"first_{f}").eqNullSafe(F.col(f"last_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    d = pairs.where("versions > 1").select(key, differ.alias("f"))
    named = F.when(F.size("f") == 0, F.array(F.lit("unexplained"))).otherwise(F.concat("f", F.array(F.lit("any_revision"))))
    return d.select(key, F.explode(named).alias("field"))


def accounting(members: DataFrame, observations: DataFrame, errors: DataFrame, by: str, *, valid: str) -> DataFrame:
    """Per period the members of the registry, valid and quarantined ones among them, the stored observations and the
    error events, each counted in its own table; whether members = valid + quarantined, observations = valid and error
    events = quarantined; ``balanced`` if all three hold. A member whose ``valid`` is null is neither. A period of one
    table alone counts 0 in the others."""
    rows = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    a = members.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col(valid)).alias("valid"), F.count_if(~F.col(valid)).alias("quarantined"))
    names = ["members", "valid", "quarantined", "observations", "error_events"]
    parts = [a, rows(observations, "observations"), rows(errors, "error_events")]
    # the full outer join as a union, in which periods that are null meet too
    full = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    t = full.groupBy(by).agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in names])
    checks = {
        "members_balance": F.col("members") == F.col("valid") + F.col("quarantined"),
        "observations_match_valid": F.col("observations") == F.col("valid"),
        "quarantine_events_match": F.col("error_events") == F.col("quarantined"),
    }
    return t.withColumns(checks).withColumn("balanced", F.col("members_balance") & F.col("observations_match_valid") & F.col("quarantine_events_match"))


def snapshot_hash(registry: DataFrame, column: str, parser_version: str) -> DataFrame:
    """One row: hash of the parser version and the sorted distinct archive hashes (one short string per archive)."""
    return registry.select(column).distinct().agg(F.sha2(F.concat(F.lit(parser_version + "\n"), F.array_join(F.array_sort(F.collect_list(column)), "\n")), 256).alias("snapshot"))


def insert_or_ignore(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the existing table lacks, one per key."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def revised_child_tables(children: DataFrame, key: str, child: str, version: str, ordinal: str, row: Column, first: object, current: object) -> DataFrame:
    """(key, field): ``child_<table>`` for each key and child table (named in column ``child``) whose rows, in ordinal order,
    differ between the versions ``first`` and ``current``; a version without rows has an empty list. All tables in one
    aggregation; rows of one key, table and version are few (a record's)."""
    c = children.where(F.col(version).isin(first, current)).select(key, child, version, F.struct(F.col(ordinal).alias("o"), row.alias("r")).alias("x"))
    lists = c.groupBy(key, child).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col(version) == v, F.col("x")))), lambda x: x["r"]).alias(n) for n, v in (("a", first), ("b", current))])
    return lists.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.concat(F.lit("child_"), child).alias("field"))


def revised_children(children: DataFrame, key: str, version: str, ordinal: str, row: Column, first: object, current: object, name: str) -> DataFrame:
    """`revised_child_tables` of one table named ``name``."""
    return revised_child_tables(children.withColumn("_child", F.lit(name)), key, "_child", version, ordinal, row, first, current)
