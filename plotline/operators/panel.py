"""Price adjustment, tiers, and balanced panels."""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.operators.aggs import exact_sum, ordered_hash, quantiles
from plotline.operators.joins import grid
from plotline.operators.windows import interpolate


def monthly_index(series: DataFrame, month: str, value: str, *, last_by: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """A monthly series without gaps between its first and last month, or between ``first`` and ``last`` (dates as text):
    (month_start, value, imputed). Of repeated months the row that is last by ``last_by`` holds; without it they raise.
    Edge months without a value raise."""
    rows = series.where(F.col(month).isNotNull()).groupBy(F.trunc(month, "month").alias("month_start"))
    s = rows.agg((F.max(value) if last_by is None else F.max_by(value, last_by)).alias(value), F.count(F.lit(1)).alias("_n"))
    edges = s.agg(F.coalesce(F.lit(first).cast("date"), F.min("month_start")).alias("a"), F.coalesce(F.lit(last).cast("date"), F.max("month_start")).alias("b"))
    spine = edges.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month_start"))
    out = interpolate(spine.join(s, "month_start", "left"), "month_start", value)
    bad = out.agg(F.count_if(F.col(value).isNull()).alias("gaps"), F.count_if(F.col("_n") > 1).alias("twice")).first()
    if bad["gaps"]:
        raise ValueError("unresolved edge gaps")
    if last_by is None and bad["twice"]:
        raise ValueError("repeated months and no order among them")
    return out.drop("_n")


def real_price(sales: DataFrame, index: DataFrame, *, price: str, month: str, value: str, base_year: int, name: str = "real_price") -> DataFrame:
    """price * (mean index of the base year) / (index of the month). The index has one row per month; sales of a month
    that it lacks, and a base year without values, raise when the result is read."""
    base = index.where(F.year("month_start") == base_year).agg(F.avg(value).alias("_base"))
    i = index.select(F.col("month_start").alias(month), F.col(value).alias("_index")).crossJoin(base)  # base is one row
    given = F.coalesce("_index", F.raise_error(F.concat(F.lit("no index for the month "), F.coalesce(F.col(month).cast("string"), F.lit("null")))).cast("double"))
    base_given = F.coalesce("_base", F.raise_error(F.lit(f"no index in the base year {base_year}")).cast("double"))
    return sales.join(i, month, "left").withColumn(name, F.col(price) * base_given / given).drop("_base", "_index")


def tier(price: Column, breaks: Sequence[float], names: Sequence[str]) -> Column:
    """Right-closed intervals: (.., b0] (b0, b1] (b1, ..); null prices get the last name."""
    out = F.lit(names[-1])
    for b, n in reversed(list(zip(breaks, names))):
        out = F.when(price <= b, F.lit(n)).otherwise(out)
    return out


def best_split(n: np.ndarray, s: np.ndarray, k: int) -> list[float]:
    """Centres of the exact one-dimensional k-means of sorted cells with ``n`` values of sum ``s`` each."""
    m = s / n
    cn, cs, cq = (np.concatenate([[0], np.cumsum(a)]) for a in (n, s, n * m * m))

    def cost(i: np.ndarray, j: int) -> np.ndarray:  # cells i .. j - 1 as one cluster
        return cq[j] - cq[i] - (cs[j] - cs[i]) ** 2 / np.maximum(cn[j] - cn[i], 1e-300)

    size = len(n)
    best = np.array([cost(np.array([0]), j)[0] if j else 0.0 for j in range(size + 1)])
    backs = []
    for _ in range(1, k):
        nxt, back = np.full(size + 1, np.inf), np.zeros(size + 1, int)
        for j in range(1, size + 1):
            i = np.arange(j)
            c = best[:j] + cost(i, j)
            back[j] = int(c.argmin())
            nxt[j] = c[back[j]]
        backs.append(back)
        best = nxt
    cuts, j = [size], size
    for back in reversed(backs):
        j = int(back[j])
        cuts.append(j)
    cuts = sorted({0, *cuts})
    return [float((cs[b] - cs[a]) / (cn[b] - cn[a])) for a, b in zip(cuts, cuts[1:])]


def tier_centres(sales: DataFrame, value: str, k: int, *, by: Sequence[str] = (), log: bool = True, bins: int = 4096) -> DataFrame:
    """(by..., n, centres): per group the centres of the exact k-means of the (logarithms of) positive values.

    Spark bins each group's values into ``bins`` equal cells, with count and sum; the optimal split of a group's sorted
    cells, ``bins`` rows at most, is found by dynamic programming. Groups with one distinct value raise."""
    x = F.log(value) if log else F.col(value).cast("double")
    rows = sales.where(F.col(value) > 0).select(*by, x.alias("_x"))
    edges = rows.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    j = rows.join(edges, list(by)) if by else rows.crossJoin(edges)  # one row
    cell = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    cells = j.groupBy(*by, cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n"), exact_sum(F.col("_x"), 9).alias("_s"))

    def split(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_c")
        if len(g) < k:
            raise ValueError(f"{k} tiers need more different prices, group {key}")
        return pd.DataFrame([[*key[: len(by)], int(g["_n"].sum()), best_split(g["_n"].to_numpy(float), g["_s"].to_numpy(float), k)]], columns=[*by, "n", "centres"])

    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("n", T.LongType()), T.StructField("centres", T.ArrayType(T.DoubleType()))])
    if by:
        return cells.groupBy(*by).applyInPandas(split, schema)
    return cells.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(split, schema)


def tier_breaks(sales: DataFrame, value: str, k: int = 3, bins: int = 4096) -> list[float]:
    """Midpoints between the centres of the exact k-means of log prices, in prices."""
    rows = tier_centres(sales, value, k, bins=bins).collect()  # one row
    if not rows:
        raise ValueError("tiers need positive prices")
    c = rows[0]["centres"]
    return [float(np.exp((a + b) / 2)) for a, b in zip(c, c[1:])]


def tier_breaks_by(sales: DataFrame, value: str, by: str, *, key: str, least: int = 1000, bins: int = 4096) -> DataFrame:
    """One row per group, from its own baseline sales: by, n, entry_boundary, high_end_boundary (midpoints of log centres,
    in prices), lower_tertile, upper_tertile and cohort (a digest of the group's keys and prices). Groups of fewer than
    ``least`` sales raise when the result is read."""
    c = tier_centres(sales, value, 3, by=[by], bins=bins)
    cut = lambda i: F.exp((F.col("centres")[i] + F.col("centres")[i + 1]) / 2)
    n = F.when(F.col("n") >= least, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("too few baseline sales in "), F.col(by).cast("string"))).cast("long"))
    fits = c.select(by, n.alias("n"), cut(0).alias("entry_boundary"), cut(1).alias("high_end_boundary"))
    thirds = quantiles(sales.where(F.col(value) > 0), [by], value, {"lower_tertile": 1 / 3, "upper_tertile": 2 / 3})
    return fits.join(thirds, by).join(cohort_hash(sales.where(F.col(value) > 0), by, key, value), by)


def cohort_hash(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """(by, cohort): SHA-256 over keys and values (ten decimals), whatever the order of rows. Rows are hashed in 4096
    buckets by their key's MD5 first, then the buckets' digests in order, so that no group is gathered."""
    line = F.concat_ws("|", F.col(key).cast("string"), F.format_string("%.10f", F.col(value).cast("double")))
    parts = df.groupBy(by, F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 3).alias("_b")).agg(ordered_hash(line, F.struct(F.col(key), line)).alias("_h"))
    return parts.groupBy(by).agg(ordered_hash(F.col("_h"), F.col("_b")).alias("cohort"))


def raw_tier_breaks(sales: DataFrame, price: str, *, cap: float = 15_000_000, expected: Sequence[float] = (), tolerance: float = 50_000, bins: int = 4096) -> list[float]:
    """Two boundaries from k-means with four centres over raw prices up to ``cap``: midpoints of the three lowest, the two
    highest clusters being one tier. A boundary further than ``tolerance`` from the expected one raises."""
    rows = tier_centres(sales.where(F.col(price) <= cap), price, 4, log=False, bins=bins).collect()  # one row
    if not rows:
        raise ValueError("tiers need positive prices")
    c = rows[0]["centres"]
    breaks = [(c[0] + c[1]) / 2, (c[1] + c[2]) / 2]
    for got, want in zip(breaks, expected):
        if abs(got - want) > tolerance:
            raise ValueError(f"boundary {got:,.0f} is more than {tolerance:,.0f} from {want:,.0f}")
    return breaks


def balanced_panel(facts: DataFrame, axes: Sequence[DataFrame], keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """The full grid of the axes with the facts joined on; counts of unobserved cells are 0, everything else null."""
    return grid(*axes).join(facts, list(keys), "left").na.fill(0, list(counts))


def carry_vintage(df: DataFrame, year: str, to: int, units: int) -> DataFrame:
    """The rows of year ``to`` hold only if there are ``units`` of them; else those of the year before stand for all of
    them, with the year changed and ``carried`` true."""
    full = df.agg((F.count_if(F.col(year) == to) == units).alias("_full"))  # one row
    d = df.crossJoin(F.broadcast(full))
    copy = d.where((F.col(year) == to - 1) & ~F.col("_full")).withColumn(year, F.lit(to).cast(dict(df.dtypes)[year]))
    kept = d.where((F.col(year) != to) | F.col("_full")).withColumn("carried", F.lit(False))
    return kept.unionByName(copy.withColumn("carried", F.lit(True))).drop("_full")


def coverage(df: DataFrame, by: str, unit: str, least: int) -> DataFrame:
    """Distinct units per period and whether there are enough of them."""
    return df.groupBy(by).agg(F.count_distinct(unit).alias("units")).withColumn("covered", F.col("units") >= least)


def transaction_panel(sales: DataFrame, keys: Sequence[str], eligible: Column, *, price: str, bound: str, lower: float, upper: float, tier: str, schema: str, first: Sequence[str], households: str | None = None) -> DataFrame:
    """Cells of the eligible sales whose ``bound`` price is above ``lower`` and up to ``upper``, and whose tier is known: by
    ``keys`` and ``tier`` the number of transactions, the median of ``price``, log_price, the columns ``first`` (alike in a
    cell by contract; the smallest stands for it), dominant_schema (the most frequent, the first by name at a tie) and
    log_households. A null ``eligible`` or bound leaves a sale out, a null price only the median."""
    good = F.coalesce(eligible, F.lit(False)) & (F.col(bound) > lower) & (F.col(bound) <= upper) & F.col(tier).isNotNull()
    by = [*keys, tier]
    d = sales.where(good)
    cells = d.groupBy(*by).agg(F.count(F.lit(1)).alias("transactions"), F.percentile(price, F.lit(0.5)).alias("median_price"), *[F.min(c).alias(c) for c in first])
    # schemas are counted first, so that no cell's rows meet in one list
    counts = d.groupBy(*by, schema).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.where(F.col(schema).isNotNull()).groupBy(*by).agg(F.min(F.struct(F.negative("_n"), schema)).alias("_m")).select(*by, F.col(f"_m.{schema}").alias("dominant_schema"))
    null_safe = [cells[c].eqNullSafe(most[c]) for c in by]
    out = cells.join(most, reduce(lambda a, b: a & b, null_safe), "left").select(cells["*"], "dominant_schema").withColumn("log_price", F.log("median_price"))
    return out if households is None else out.withColumn("log_households", F.log(households))
