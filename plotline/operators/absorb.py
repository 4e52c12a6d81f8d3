"""Fixed effects taken out by alternating projection, and many fits from two passes over one panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators import stats as S
from plotline.sources.scratch import cut

#: Sweeps over all factors between two tests of convergence (and two written tables).
SWEEPS = 3


def _less(x: str, others: Sequence[str], w: Column | None = None) -> Column:
    """Array ``x`` less the other factors' effects, these times ``w``."""
    out = F.col(x)
    for o in others:
        out = F.zip_with(out, f"_e_{o}", (lambda v, e: v - e) if w is None else (lambda v, e: v - w * e))
    return out


def _effects(cells: DataFrame, factor: str, others: Mapping[str, DataFrame]) -> DataFrame:
    """Weighted means of the cells by ``factor`` less the other factors' effects: (factor, e)."""
    left = cells
    for other, e in others.items():
        left = left.join(e.select(other, F.col("e").alias(f"_e_{other}")), other)
    # entries are summed one by one, so that the plan does not grow with their number
    each = left.select(factor, "w", F.posexplode(_less("s", list(others), F.col("w"))).alias("i", "v"))
    means = each.groupBy(factor, "i").agg((F.sum("v") / F.sum("w")).alias("e"))
    return means.groupBy(factor).agg(F.array_sort(F.collect_list(F.struct("i", "e"))).alias("x")).select(factor, F.transform("x", lambda x: x["e"]).alias("e"))


def absorb(df: DataFrame, columns: Mapping[str, Column], factors: Sequence[str], weight: Column | None = None, *, tolerance: float = 1e-11, rounds: int = 2000) -> tuple[DataFrame, int]:
    """(rows, levels): the complete rows of ``df`` with ``columns`` replaced by what is left of them after the (weighted) means
    of all ``factors`` are taken out, their other columns, and ``_w``; and how many coefficients that took away.

    Rows are first summed up to cells of the factors. A sweep takes the mean of each factor's levels less the other factors'
    effects, in turn, until no effect moves by ``tolerance`` of its column's spread; only tables of effects (a row for each
    level) are written on the way, and a number for each column reaches the driver. With one factor one sweep is exact.
    Weights of 0 leave a row out; a null in a column, factor or weight does too."""
    names, k = list(columns), len(columns)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    d = df.select("*", w.alias("_w"), F.array(*[c.cast("double") for c in columns.values()]).alias("_x"))
    good = (F.col("_w") > 0) & F.forall("_x", lambda v: v.isNotNull())
    for f in factors:
        good &= F.col(f).isNotNull()
    d = d.where(good)
    sums = d.select(*factors, "_w", F.posexplode("_x").alias("i", "v")).groupBy(*factors, "i").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("v")).alias("s"), F.sum(F.col("_w") * F.col("v") * F.col("v")).alias("q"))
    cells = sums.groupBy(*factors).agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("i", "s", "q"))).alias("x"))
    cells = cut(cells.select(*factors, "w", F.transform("x", lambda x: x["s"]).alias("s"), F.transform("x", lambda x: x["q"]).alias("q")), "cells")
    spread = {r.i: float(r.v) or 1.0 for r in cells.select("w", F.posexplode("q").alias("i", "v")).groupBy("i").agg(F.sqrt(F.sum("v") / F.sum("w")).alias("v")).collect()}
    zero = F.array_repeat(F.lit(0.0), k)
    effects = {f: cells.select(f).distinct().withColumn("e", zero) for f in factors}
    last = factors[-1]
    for _ in range(max(1, rounds // SWEEPS)):
        before = effects[last]
        for _ in range(1 if len(factors) == 1 else SWEEPS):
            for f in factors:
                effects[f] = _effects(cells, f, {o: e for o, e in effects.items() if o != f})
        effects[last] = cut(effects[last], "effects")
        if len(factors) == 1:
            break
        if len(factors) > 2:
            effects = {f: e if f == last else cut(e, "effects") for f, e in effects.items()}
        moved = effects[last].join(before.select(last, F.col("e").alias("o")), last).select(F.posexplode(F.zip_with("e", "o", lambda e, o: F.abs(e - o))).alias("i", "v")).groupBy("i").agg(F.max("v").alias("v")).collect()
        if all(r.v <= tolerance * spread[r.i] for r in moved):
            break
    else:
        raise RuntimeError(f"effects still move after {rounds} sweeps")
    if len(factors) == 2:  # the first factor's effects follow from the last one's
        effects[factors[0]] = cut(_effects(cells, factors[0], {last: effects[last]}), "effects")
    for f, e in effects.items():
        d = d.join(e.select(f, F.col("e").alias(f"_e_{f}")), f)
    d = d.withColumn("_x", _less("_x", factors))
    # what is only rounding is nothing: such a column is a combination of levels
    left = [F.when(F.abs(F.col("_x")[i]) <= F.lit(1e-9 * spread.get(i, 1.0)), F.lit(0.0)).otherwise(F.col("_x")[i]).alias(n) for i, n in enumerate(names)]
    return d.select(*[c for c in df.columns if c not in names], "_w", *left), _rank(cells, factors)


def _rank(cells: DataFrame, factors: Sequence[str]) -> int:
    """Independent columns among the dummies of the factors: all levels of the first, and of each further one all but as many
    as there are connected groups (exact for two factors, an upper bound for more)."""
    levels = [cells.select(f).distinct().count() for f in factors]
    if len(factors) == 1:
        return levels[0]
    pairs = cells.select(*factors[:2]).distinct()
    # a level that meets every level of the other factor leaves one group
    met = pairs.groupBy(factors[1]).count().agg(F.max("count")).first()[0]
    if met == levels[0]:
        return levels[0] + sum(n - 1 for n in levels[1:])
    return levels[0] + levels[1] - _groups(cells, factors[0], factors[1]) + sum(n - 1 for n in levels[2:])


def _groups(cells: DataFrame, a: str, b: str) -> int:
    """Connected groups of two factors' levels, by passing on the smallest label along the cells until none changes."""
    pairs = cut(cells.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct(), "pairs")
    label = cut(pairs.groupBy("a").agg(F.min("b").alias("l")), "labels")
    while True:
        by_b = pairs.join(label, "a").groupBy("b").agg(F.min("l").alias("l"))
        new = cut(pairs.join(by_b, "b").groupBy("a").agg(F.min("l").alias("l")), "labels")
        if new.join(label.withColumnRenamed("l", "o"), "a").where("l <> o").limit(1).count() == 0:
            return label.select("l").distinct().count()
        label = new


def fit_absorbed_many(df: DataFrame, outcomes: Sequence[str], columns: Mapping[str, Column], factors: Sequence[str], weight: Column | None = None) -> dict[str, tuple[DataFrame, S.Fit]]:
    """`fit_absorbed` of several outcome columns. Those without nulls lose their effects in one go, each other one over the
    rows where it is known."""
    known = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(y).alias(y) for y in outcomes]).first()
    full = [y for y in outcomes if known[y] == known["n"]]
    terms = {n: c for n, c in columns.items() if n != "(Intercept)"}
    own = {n: F.col(f"_d{i}") for i, n in enumerate(terms)}
    out: dict[str, tuple[DataFrame, S.Fit]] = {}
    for group in [*([full] if full else []), *([y] for y in outcomes if y not in full)]:
        given = {f"_y{j}": F.col(y) for j, y in enumerate(group)} | {f"_d{i}": c for i, c in enumerate(terms.values())}
        rows, levels = absorb(df, given, factors, weight)
        rows = cut(rows, "absorbed")
        for j, y in enumerate(group):
            fit = S.wls(rows, F.col(f"_y{j}"), own, F.col("_w"))
            fit.absorbed = levels
            out[y] = rows, fit
    return {y: out[y] for y in outcomes}


def fit_absorbed(df: DataFrame, y: str, columns: Mapping[str, Column], factors: Sequence[str], weight: Column | None = None) -> tuple[DataFrame, S.Fit]:
    """(rows, fit) of least squares of column ``y`` on ``columns`` with a fixed effect for each level of ``factors``: the same
    coefficients, residuals and degrees of freedom as with a dummy for each level. Columns that the effects absorb are
    dropped. Standard errors come from `stats` with the rows returned here."""
    return fit_absorbed_many(df, [y], columns, factors, weight)[y]


def fit_many(df: DataFrame, y: Mapping[str, Column], columns: Mapping[str, Column], models: Mapping[str, tuple[Column, str, Sequence[str]]], weight: Column | None = None, *, cluster: str | None = None) -> tuple[dict[str, S.Fit], dict[str, np.ndarray]]:
    """(fits, covariances) of many models on one panel: name -> (rows that it takes, outcome among ``y``, columns that it takes).

    One pass sums the cross products of the union of all columns and outcomes by the set of models that a row belongs to; a
    model adds up the sets that hold it and cuts out its own columns. With ``cluster`` a second pass sums the scores of all
    models by cluster and their outer products over clusters, on the executors; else covariances are classical. Rows with a
    null in any column, or in an outcome that one of their models takes, are left out of that model. What reaches the driver
    does not grow with rows or clusters: a matrix for each set of models that occurs, and one for each model."""
    names, outs = list(columns), list(y)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    every = F.lit(True)
    for c in columns.values():
        every &= c.isNotNull()
    d = df.where(every & w.isNotNull()).select("*", w.alias("_w"))
    member = {m: F.coalesce(keep & y[out].isNotNull(), F.lit(False)) for m, (keep, out, _) in models.items()}
    bits = F.concat(*[F.when(c, "1").otherwise("0") for c in member.values()])
    whole = [*columns.values(), *[F.coalesce(c.cast("double"), F.lit(0.0)) for c in y.values()]]
    d = d.withColumn("_set", bits)
    cross = S._cross(d, F.col("_w"), whole, ["_set"])
    counts = {r["_set"]: r["count"] for r in d.groupBy("_set").count().collect()}
    fits: dict[str, S.Fit] = {}
    for i, (m, (_, out, own)) in enumerate(models.items()):
        mine = [s for (s,) in cross if s[i] == "1"]
        total = sum((cross[(s,)] for s in mine), np.zeros((len(whole), len(whole))))
        at, o = [names.index(c) for c in own], len(names) + outs.index(out)
        xx, xy, yy = total[np.ix_(at, at)], total[at, o], total[o, o]
        keep = S.retained(xx)
        bread = np.linalg.inv(xx[np.ix_(keep, keep)])
        beta = bread @ xy[keep]
        kept = [own[j] for j in keep]
        fitted = sum((F.lit(float(b)) * columns[c] for b, c in zip(beta, kept)), F.lit(0.0))
        fits[m] = S.Fit(kept, beta, bread, sum(counts[s] for s in mine), [c for c in own if c not in kept], float(yy - beta @ xy[keep]), {c: columns[c] for c in kept}, F.when(member[m], y[out] - fitted), w)
    if cluster is None:
        return fits, {m: S.classical_vcov(f) for m, f in fits.items()}
    meats = S.meats(d, fits, cluster)
    return fits, {m: S.sandwich(f, *meats[m]) for m, f in fits.items()}
