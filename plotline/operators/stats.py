"""Estimators whose sums are Spark aggregations; only k x k matrices reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.functions import special


def products(terms: Sequence[str], factors: Mapping[str, Sequence[str]], numeric: Sequence[str]) -> dict[str, list[tuple[str, object]]]:
    """What each design column of formula terms multiplies, by its name: numeric names (with None) and factors' levels."""
    wanted: list[tuple[str, ...]] = []
    for t in terms:
        names = t.split("*")
        if len(names) == 1:
            wanted.append(tuple(t.split(":")))
            continue
        for size in range(1, len(names) + 1):
            wanted += list(combinations(names, size))
    out: dict[str, list[tuple[str, object]]] = {"(Intercept)": []}
    for names in sorted(dict.fromkeys(wanted), key=len):
        cells: list[tuple[str, list[tuple[str, object]]]] = [("", [])]
        for n in names:
            own = [(n, (n, None))] if n in numeric else [(f"{n}={v}", (n, v)) for v in factors[n][1:]]
            cells = [(f"{a}:{b}" if a else b, [*x, y]) for a, x in cells for b, y in own]
        out |= dict(cells)
    return out


def design(df: DataFrame, terms: Sequence[str], factors: Mapping[str, Sequence[str]], numeric: Sequence[str]) -> dict[str, Column]:
    """Design columns of formula terms: a name, or names joined by ':' for an interaction; 'a*b' expands to all of
    'a', 'b', 'a:b'. A factor gives one dummy per level but the first."""
    one = lambda n, v: F.col(n).cast("double") if v is None else (F.col(n) == v).cast("double")
    return {name: reduce(lambda a, b: a * b, [one(*p) for p in parts], F.lit(1.0)) for name, parts in products(terms, factors, numeric).items()}


def _cells(columns: Sequence[Column]) -> Column:
    """The non-zero design values of a row as (index, value): dummies make rows sparse."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(columns)])
    return F.filter(cells, lambda x: x["v"] != 0)


def _cross(df: DataFrame, weight: Column, columns: Sequence[Column], keys: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """Weighted cross products of the columns by key, as full matrices. Rows give only the pairs of their non-zero
    values, which are summed before they are shuffled: at most columns squared rows a key reach the driver."""
    k = len(columns)
    pairs = F.flatten(F.transform("_x", lambda a: F.transform(F.filter("_x", lambda b: b["i"] >= a["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (F.col("_w") * a["v"] * b["v"]).alias("v")))))
    d = df.select(*keys, weight.alias("_w"), _cells(columns).alias("_x")).select(*keys, F.inline(pairs))
    out: dict[tuple, np.ndarray] = {}
    for r in d.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v")).collect():
        m = out.setdefault(tuple(r[x] for x in keys), np.zeros((k, k)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return out


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    bread: np.ndarray
    n: int
    dropped: list[str]
    rss: float
    columns: dict[str, Column]
    residual: Column
    weight: Column
    #: Coefficients of fixed effects that were taken out before.
    absorbed: int = 0

    @property
    def k(self) -> int:
        return len(self.names) + self.absorbed


def retained(xx: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns that are no linear combination of earlier ones, left to right (aliased ones are dropped)."""
    keep: list[int] = []
    for j in range(len(xx)):
        if xx[j, j] <= 0:
            continue
        rest = xx[j, j]
        if keep:
            a = xx[np.ix_(keep, keep)]
            rest -= xx[j, keep] @ np.linalg.solve(a, xx[keep, j])
        if rest > tolerance * xx[j, j]:
            keep.append(j)
    return keep


def wls(df: DataFrame, y: Column, columns: Mapping[str, Column], weight: Column | None = None) -> Fit:
    """(Weighted) least squares. Rows with a null in any column are left out; one pass gathers all cross products."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    names, cols = list(columns), list(columns.values())
    good = y.isNotNull() & w.isNotNull()
    for c in cols:
        good &= c.isNotNull()
    d = df.where(good)
    k = len(cols)
    m = _cross(d, w, [*cols, y]).get((), np.zeros((k + 1, k + 1)))
    xx, xy, yy, n = m[:k, :k], m[:k, k], m[k, k], d.count()
    keep = retained(xx)
    bread = np.linalg.inv(xx[np.ix_(keep, keep)])
    beta = bread @ xy[keep]
    fitted = F.lit(0.0)
    for b, i in zip(beta, keep):
        fitted = fitted + F.lit(float(b)) * cols[i]
    return Fit([names[i] for i in keep], beta, bread, n, [names[i] for i in range(k) if i not in keep], float(yy - beta @ xy[keep]), {names[i]: cols[i] for i in keep}, F.when(good, y - fitted), w)


def classical_vcov(fit: Fit) -> np.ndarray:
    return fit.bread * fit.rss / (fit.n - fit.k)


def hc1_vcov(df: DataFrame, fit: Fit) -> np.ndarray:
    cols = list(fit.columns.values())
    e2 = (fit.weight * fit.residual) * (fit.weight * fit.residual)
    meat = _cross(df.where(fit.residual.isNotNull()), e2, cols)[()]
    return fit.bread @ meat @ fit.bread * fit.n / (fit.n - fit.k)


def cluster_scores(df: DataFrame, fit: Fit, cluster: str) -> DataFrame:
    """(cluster, i, v): the clusters' score sums by number of coefficient, zeros left out."""
    d = df.where(fit.residual.isNotNull()).select(F.col(cluster).alias("cluster"), (fit.weight * fit.residual).alias("_w"), _cells(list(fit.columns.values())).alias("_x"))
    return d.select("cluster", "_w", F.inline("_x")).groupBy("cluster", "i").agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def meats(df: DataFrame, fits: Mapping[str, Fit], cluster: str) -> dict[str, tuple[np.ndarray, int]]:
    """For each fit the sum over clusters of the outer products of their score sums, and the number of clusters: one pass
    for all fits; scores stay on the executors, k x k numbers a fit reach the driver."""

    def scored(f: Fit) -> Column:
        cells = F.transform(_cells(list(f.columns.values())), lambda x: F.struct(x["i"].alias("i"), (f.weight * f.residual * x["v"]).alias("v")))
        return F.when(f.residual.isNotNull(), cells)

    per = [F.struct(F.lit(m).alias("m"), scored(f).alias("x")) for m, f in fits.items()]
    rows = df.select(F.col(cluster).alias("c"), F.explode(F.array(*per)).alias("p")).where(F.col("p.x").isNotNull())
    sums = rows.select("c", F.col("p.m").alias("m"), F.inline_outer("p.x")).groupBy("m", "c", "i").agg(F.sum("v").alias("v"))
    # a row a cluster with its at most k sums, then their pairs; one without any value still counts as a cluster
    lists = sums.groupBy("m", "c").agg(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "v"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["v"]).alias("v")))))
    out = {m: [np.zeros((len(f.names), len(f.names))), 0] for m, f in fits.items()}
    for r in lists.select("m", F.inline(pairs)).groupBy("m", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.m][0][r.i, r.j] = r.v
    for r in lists.groupBy("m").count().collect():
        out[r.m][1] = r["count"]
    return {m: (a, g) for m, (a, g) in out.items()}


def sandwich(fit: Fit, meat: np.ndarray, g: int) -> np.ndarray:
    """Cluster-robust covariance with the small-sample factor of ``g`` clusters."""
    return fit.bread @ meat @ fit.bread * g / (g - 1) * (fit.n - 1) / (fit.n - fit.k)


def cluster_vcov(df: DataFrame, fit: Fit, cluster: str) -> np.ndarray:
    return sandwich(fit, *meats(df, {"": fit}, cluster)[""])


def poisson(df: DataFrame, y: Column, columns: Mapping[str, Column], offset: Column | None = None, rounds: int = 25, tolerance: float = 1e-9) -> Fit:
    """Poisson regression with log link by iteratively reweighted least squares; each round is one aggregation."""
    off = F.lit(0.0) if offset is None else offset
    eta = F.log(y + F.lit(0.5))
    old = None
    for _ in range(rounds):
        mu = F.exp(eta)
        fit = wls(df, eta - off + (y - mu) / mu, columns, mu)
        eta = off
        for b, n in zip(fit.beta, fit.names):
            eta = eta + F.lit(float(b)) * columns[n]
        if old is not None and len(old) == len(fit.beta) and np.abs(old - fit.beta).max() < tolerance:
            break
        old = fit.beta
    fit.residual, fit.weight = y - F.exp(eta), F.lit(1.0)
    return fit


def tidy(spark: SparkSession, fit: Fit, vcov: np.ndarray, log_outcome: bool = False) -> DataFrame:
    """term, estimate, std_error, z, p_value (normal), low, high (95 %), percent_effect for log outcomes."""
    rows = [(name, b, math.sqrt(max(v, 0.0))) for name, b, v in zip(fit.names, fit.beta.tolist(), np.diag(vcov).tolist())]
    t = spark.createDataFrame(rows, "term string, estimate double, std_error double")
    z, half = F.col("estimate") / F.nullif("std_error", F.lit(0.0)), F.lit(1.959963984540054) * F.col("std_error")
    percent = F.expm1("estimate") * 100 if log_outcome else F.lit(None).cast("double")
    return t.select("*", z.alias("z"), special.normal_p(z).alias("p_value"), (F.col("estimate") - half).alias("low"), (F.col("estimate") + half).alias("high"), percent.alias("percent_effect"))


def select_term(names: Sequence[str], with_: Sequence[str], without: Sequence[str] = ()) -> str:
    """The one coefficient that holds all tokens and none of the forbidden ones."""
    found = [n for n in names if all(t in n for t in with_) and not any(t in n for t in without)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} terms match {with_} without {without}")
    return found[0]


def wald(beta: np.ndarray, vcov: np.ndarray, tolerance: float = 1e-10) -> tuple[float, int]:
    """(statistic, degrees of freedom) of beta = 0 with the pseudo-inverse of the rank that vcov has; `special.chi2_p` has
    the p-value."""
    values, vectors = np.linalg.eigh(vcov)
    keep = values > tolerance * max(values.max(initial=0), 0)
    part = vectors[:, keep].T @ beta
    return float((part**2 / values[keep]).sum()), int(keep.sum())


def linear_combination(beta: np.ndarray, vcov: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    return float(w @ beta), float(math.sqrt(max(w @ vcov @ w, 0.0)))


#: The six points of the wild weights.
POINTS = (-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5))


def wild_bootstrap(fit: Fit, scores: DataFrame, terms: Sequence[int], reps: int = 9999, seed: int = 42, least: int = 99, share: float = 0.8) -> DataFrame:
    """(term, estimate, low, high, p_value, draws) of coefficients by the wild cluster bootstrap with six-point weights on
    unrestricted residuals. ``scores`` are `cluster_scores`.

    A draw moves a coefficient by the sum over clusters of a weight times the cluster's share in it, a number for each
    cluster and term. A cluster's weights in all draws follow from its name and ``seed``, so that tasks draw for their own
    clusters, add up, and Spark adds the tasks' draws: results do not hang on the partitioning. Draws that give no finite
    number do not count; a term with fewer than ``least`` others, or than ``share`` of all, raises."""
    k = len(terms)
    bread = [F.array(*[F.lit(float(x)) for x in fit.bread[:, t]]) for t in terms]
    shares = scores.groupBy("cluster").agg(*[F.sum(F.when(F.col("i").isNotNull(), F.col("v") * b[F.col("i")])).alias(f"t{j}") for j, b in enumerate(bread)])
    keyed = shares.select(F.xxhash64(F.col("cluster").cast("string"), F.lit(seed)).alias("key"), *[f"t{j}" for j in range(k)])
    points = np.array(POINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((reps, k))
        for batch in batches:
            t = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            for key, own in zip(batch.column(0).to_pylist(), t):
                rng = np.random.Generator(np.random.Philox(key=key & (1 << 64) - 1))
                total += points[rng.integers(0, len(points), reps)][:, None] * own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), *[pa.array(total[:, j].copy()) for j in range(k)]], names=["draw", *(f"t{j}" for j in range(k))])

    moved = keyed.mapInArrow(run, "draw long, " + ", ".join(f"t{j} double" for j in range(k))).groupBy("draw").agg(*[F.sum(f"t{j}").alias(f"t{j}") for j in range(k)])
    named = F.array(*[F.struct(F.lit(fit.names[t]).alias("term"), F.lit(float(fit.beta[t])).alias("estimate"), F.col(f"t{j}").alias("shift")) for j, t in enumerate(terms)])
    d = moved.select(F.inline(named)).where(~F.isnan("shift") & (F.abs("shift") < float("inf")))
    value = F.col("estimate") + F.col("shift")
    out = d.groupBy("term", "estimate").agg(
        F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"),
        ((F.lit(1) + F.count_if(F.abs("shift") >= F.abs("estimate"))) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("draws"),
    )
    enough = F.col("draws") >= max(least, share * reps)
    return out.withColumn("draws", F.when(enough, F.col("draws")).otherwise(F.raise_error(F.concat(F.lit("too few draws succeeded: "), F.col("draws").cast("string"))).cast("long")))


def pairs_bootstrap(df: DataFrame, y: Column, columns: Mapping[str, Column], cluster: str, weight: Column | None = None, reps: int = 999, seed: int = 42, strata: str | None = None) -> DataFrame:
    """(draw, beta): coefficients in ``columns``' order (nan where aliased) of ``reps`` samples of whole clusters, drawn with
    replacement, as many as there are. With ``strata``, each stratum's clusters are drawn among themselves; a cluster lies
    in one stratum.

    Cross products are summed by cluster once. How often each cluster of a stratum occurs in a draw is drawn from ``seed``,
    stratum and draw alone, alike in every task; a task multiplies what its clusters have by it, Spark deals the partial
    sums out by draw, and each draw is solved where its sums meet. The driver sees none of it."""
    w = F.lit(1.0) if weight is None else weight
    cols = [*columns.values(), y]
    k = len(cols)
    stratum = F.lit("") if strata is None else F.col(strata).cast("string")
    d = df.select(stratum.alias("stratum"), F.col(cluster).alias("cluster"), w.alias("_w"), _cells(cols).alias("_x"))
    pairs = F.flatten(F.transform("_x", lambda a: F.transform(F.filter("_x", lambda b: b["i"] >= a["i"]), lambda b: F.struct((a["i"] * k + b["i"]).alias("at"), (F.col("_w") * a["v"] * b["v"]).alias("v")))))
    sums = d.select("stratum", "cluster", F.inline(pairs)).groupBy("stratum", "cluster", "at").agg(F.sum("v").alias("v"))
    whole = sums.groupBy("stratum", "cluster").agg(F.collect_list(F.struct("at", "v")).alias("x"))
    sizes = whole.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    number = F.row_number().over(Window.partitionBy("stratum").orderBy("cluster")) - 1
    numbered = whole.withColumn("number", number).join(sizes, "stratum").select(F.xxhash64("stratum", F.lit(seed)).alias("key"), "size", "number", F.transform("x", lambda s: s["at"]).alias("at"), F.transform("x", lambda s: s["v"]).alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size, number = (c.to_numpy() for c in batch.columns[:3])
            full = np.zeros((batch.num_rows, k * k))
            for r, (at, v) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                full[r, at] = v
            for one in np.unique(key):
                mine = np.flatnonzero(key == one)
                n = int(size[mine[0]])
                step = max(1, min(reps, (1 << 22) // n))
                # draws come in blocks whose size the stratum alone decides, so that all tasks see the same ones
                for block, first in enumerate(range(0, reps, step)):
                    rng = np.random.Generator(np.random.Philox(key=[int(one) & (1 << 64) - 1, block]))
                    times = rng.multinomial(n, np.full(n, 1 / n), size=min(step, reps - first))[:, number[mine]]
                    got = times @ full[mine]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(got))), pa.array([row.tobytes() for row in got], pa.binary())], names=["draw", "sums"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(k * k)

        def beta() -> list[float]:
            m = total.reshape(k, k)
            m = np.triu(m) + np.triu(m, 1).T
            out = np.full(k - 1, np.nan)
            keep = retained(m[:-1, :-1])
            if keep:
                out[keep] = np.linalg.solve(m[np.ix_(keep, keep)], m[keep, -1])
            return out.tolist()

        for batch in batches:
            draws, found = [], []
            for draw, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                if draw != now:
                    if now is not None:
                        draws.append(now)
                        found.append(beta())
                    now, total = draw, np.zeros(k * k)
                total += np.frombuffer(sums.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["draw", "beta"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([beta()], pa.list_(pa.float64()))], names=["draw", "beta"])

    return numbered.mapInArrow(partial, "draw long, sums binary").repartition("draw").sortWithinPartitions("draw").mapInArrow(solve, "draw long, beta array<double>")


#: The ratio that the slopes' ratio is held against.
BENCHMARK_RATIO = 4.5


def slope_ratio(draws: DataFrame, above: Sequence[int], below: Sequence[int], observed: float, *, reps: int, benchmark: float = BENCHMARK_RATIO, share: float = 0.8) -> DataFrame:
    """One row: interval and median of |sum of the coefficients ``above``| / |sum of those ``below``| over the draws of
    `pairs_bootstrap`, and how often a draw is as far from the observed ratio as that is from ``benchmark``. Draws without
    a finite ratio do not count; fewer than ``share`` of ``reps`` others raise."""
    size = lambda at: F.abs(sum((F.col("beta")[i] for i in at), F.lit(0.0)))
    d = draws.select(F.try_divide(size(above), size(below)).alias("ratio")).where(F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.col("ratio") < float("inf")))
    far = F.abs(F.col("ratio") - observed) >= abs(observed - benchmark)
    out = d.agg(
        F.lit(float(observed)).alias("observed"), *[F.percentile("ratio", F.lit(q)).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))], F.lit(float(benchmark)).alias("benchmark"),
        ((F.lit(1) + F.count_if(far)) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("draws"),
    )
    return out.withColumn("draws", F.when(F.col("draws") >= math.ceil(share * reps), F.col("draws")).otherwise(F.raise_error(F.concat(F.lit("too few draws succeeded: "), F.col("draws").cast("string"))).cast("long")))


def welch(df: DataFrame, keys: Sequence[str], value: str, group: Column) -> DataFrame:
    """Per key: means, Welch's t, Satterthwaite's degrees of freedom and the two-sided p of group true against false."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    g = df.groupBy(*keys).agg(*[f(x).alias(f"{n}_{s}") for s, x in (("a", a), ("b", b)) for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb)
    g = g.select(*keys, "mean_a", "mean_b", "n_a", "n_b", t.alias("t"), ((va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))).alias("df"))
    return g.withColumn("p_value", special.student_p(F.col("t"), F.col("df")))


def welch_table(df: DataFrame, value: str, before: Column, groupings: Mapping[str, Column]) -> DataFrame:
    """(grouping, level, n_before, n_after, mean_before, mean_after, percent_change, t, df, p_value, decision): Welch's test of a
    logarithm before against after, for each level of each grouping in one aggregation; rows whose level is null are in
    none. Means are back in units, the change is that of the geometric means; decision marks 0.001, 0.01 and 0.05."""
    sets = F.array(*[F.struct(F.lit(name).alias("grouping"), level.cast("string").alias("level")) for name, level in groupings.items()])
    d = df.select(F.col(value).alias("_v"), before.alias("_before"), F.explode(sets).alias("_s")).select("_v", "_before", "_s.*").where("level is not null")
    w = welch(d, ["grouping", "level"], "_v", F.col("_before"))
    p = F.col("p_value")
    decision = F.when(p < 0.001, "reject ***").when(p < 0.01, "reject **").when(p < 0.05, "reject *").when(p.isNotNull(), "fail to reject")
    return w.select(
        "grouping", "level", F.col("n_a").alias("n_before"), F.col("n_b").alias("n_after"), F.exp("mean_a").alias("mean_before"), F.exp("mean_b").alias("mean_after"),
        ((F.exp(F.col("mean_b") - F.col("mean_a")) - 1) * 100).alias("percent_change"), "t", "df", "p_value", decision.alias("decision"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson's matrix over complete rows, one row per pair, in one pass."""
    d = df.select(*columns).na.drop()
    pairs = [(a, b) for a in columns for b in columns]
    one = d.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def predict(spark: SparkSession, fit: Fit, vcov: np.ndarray, grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """Prediction and 95 % interval of the mean at each design row (name -> value, absent names 0)."""
    rows = []
    for g in grid:
        x = np.array([1.0 if n == "(Intercept)" else float(g.get(n, 0.0)) for n in fit.names])
        at, se = linear_combination(fit.beta, vcov, x)
        rows.append((at, se, at - 1.959963984540054 * se, at + 1.959963984540054 * se))
    return spark.createDataFrame(rows, "fitted double, std_error double, low double, high double")
