"""Queries of the estimators, over panels that Spark derives from the tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.special import chi2_p, normal_p
from plotline.operators import aggs as A
from plotline.operators import panel as PN
from plotline.operators import stats as S
from plotline.operators.absorb import fit_absorbed, fit_absorbed_many, fit_many
from plotline.plans import oracles as O
from plotline.plans.registry import Tables, query

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TIERS = ("entry", "mid", "luxury")


def panel(spark, sf) -> DataFrame:
    """County x month x tier cells of the orders: price, transactions, a rate and its gap, treatment."""
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    tier = F.when(F.col("o_totalprice") <= 200_000, "entry").when(F.col("o_totalprice") <= 400_000, "mid").otherwise("luxury")
    cells = j.groupBy(F.col("n_name").alias("county"), F.col("r_name").alias("region"), F.trunc("o_orderdate", "month").alias("m"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("transactions"), F.percentile("o_totalprice", F.lit(0.5)).alias("price"), F.avg("c_acctbal").alias("income"))
    rate = 3.0 + F.month("m") / 4.0 + (F.year("m") - 1995) / 2.0
    # one row per county, month and tier: small, and read once per pass of an estimator
    return cells.select("*", F.log("price").alias("log_price"), (rate - 3.0).alias("rate_gap"), (F.col("region") == "AMERICA").cast("double").alias("treated"), (F.year("m") >= 1998).cast("double").alias("post"), F.year("m").cast("string").alias("year")).cache()


def _columns(df: DataFrame, terms) -> dict:
    factors = {"tier": TIERS, "region": REGIONS, "year": [str(y) for y in range(1995, 2002)], "county": [f"NATION_{i}" for i in sorted(range(25), key=str)]}
    return S.design(df, terms, factors, ("rate_gap", "treated", "post", "income"))


@query("""select 'slope' as term, regr_slope(o_totalprice, year(o_orderdate)) as estimate from orders union all select 'intercept', regr_intercept(o_totalprice, year(o_orderdate)) from orders""")
def ols_single(spark, sf):
    o = Tables(spark, sf).orders.withColumn("y0", F.year("o_orderdate").cast("double"))
    one = o.agg(F.regr_slope("o_totalprice", "y0").alias("slope"), F.regr_intercept("o_totalprice", "y0").alias("intercept"))
    return one.unpivot([], ["slope", "intercept"], "term", "estimate")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 8 decimals: two ways to solve the same equations agree so far."""
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rounding(doubles: str, sql: str):
    """`query` of SQL whose columns ``doubles`` are rounded as `_rounded` does."""
    return query(f"select * replace ({', '.join(f'round({c}, 8) as {c}' for c in doubles.split())}) from ({sql})")


_GAP = list(O.GAP.values())
_RSS = f"x as (select any_value(s.beta) as beta, any_value(s.inv) as inv, any_value(s.n) as n, sum((log_price - {O.fitted(_GAP)}) ** 2) as rss from panel, solved s)"


@_rounding("estimate std_error z p_value low high percent_effect", f"with recursive {O.PANEL}, {O.solved('panel', _GAP, 'log_price')}, {_RSS}, {O.tidy(list(O.GAP), 'inv[i][i] * rss / (n - 7)', 'x', True)}")
def ols_interact(spark, sf):
    p = panel(spark, sf)
    fit = S.wls(p, F.col("log_price"), _columns(p, ["rate_gap*tier", "treated"]))
    return _rounded(S.tidy(spark, fit, S.classical_vcov(fit), True))


#: treated * post * tier + income, by term.
_DID = {"(Intercept)": "1.0", "treated": "treated", "post": "post", "tier=mid": "mid", "tier=luxury": "lux", "income": "income", "treated:post": "treated * post", "treated:tier=mid": "treated * mid", "treated:tier=luxury": "treated * lux", "post:tier=mid": "post * mid", "post:tier=luxury": "post * lux", "treated:post:tier=mid": "treated * post * mid", "treated:post:tier=luxury": "treated * post * lux"}


def _robust(columns) -> str:
    """Fit and meat of squared residuals."""
    columns = list(columns)
    return f"{O.solved('panel', columns, 'log_price')}, x as (select any_value(s.beta) as beta, any_value(s.inv) as inv, any_value(s.n) as n, any_value(s.kept) as kept, {O.matrix(columns, f'(log_price - {O.fitted(columns)}) ** 2')} as meat from panel, solved s)"


@_rounding("estimate std_error z p_value low high percent_effect", f"with recursive {O.PANEL}, {_robust(_DID.values())}, {O.tidy(list(_DID), O.quadratic(13, 'inv', 'meat') + ' * n / (n - kept)', 'x', True)}")
def ols_hc1(spark, sf):
    p = panel(spark, sf)
    fit = S.wls(p, F.col("log_price"), _columns(p, ["treated*post*tier", "income"]))
    return _rounded(S.tidy(spark, fit, S.hc1_vcov(p, fit), True))


@query()
def cluster_se(spark, sf):
    p = panel(spark, sf)
    fit = S.wls(p, F.col("log_price"), _columns(p, ["rate_gap*tier*treated", "income", "county", "year"]), F.col("transactions"))
    return S.tidy(spark, fit, S.cluster_vcov(p, fit, "county"), True)


@query()
def poisson_fe(spark, sf):
    p = panel(spark, sf)
    fit = S.poisson(p, F.col("transactions").cast("double"), _columns(p, ["rate_gap*tier", "region"]))
    return S.tidy(spark, fit, S.cluster_vcov(p, fit, "county"), True)


@query()
def wild_bootstrap(spark, sf):
    p = panel(spark, sf)
    fit = S.wls(p, F.col("log_price"), _columns(p, ["rate_gap*tier", "treated"]), F.col("transactions"))
    at = fit.names.index(S.select_term(fit.names, ["rate_gap", "tier=mid"]))
    return S.wild_bootstrap(fit, S.cluster_scores(p, fit, "county"), [at], 9999)


@query()
def pairs_bootstrap(spark, sf):
    """The mid tier's slope over the entry tier's, against the ratio of earlier findings."""
    p = panel(spark, sf)
    columns = _columns(p, ["rate_gap*tier"])
    names, weight = list(columns), F.col("transactions").cast("double")
    below = [names.index("rate_gap")]
    above = [*below, names.index("rate_gap:tier=mid")]
    draws = S.pairs_bootstrap(p, F.col("log_price"), columns, "county", weight, 9999, strata="region")
    seen = dict(zip((fit := S.wls(p, F.col("log_price"), columns, weight)).names, fit.beta))
    observed = abs(sum(seen[names[i]] for i in above)) / abs(seen["rate_gap"])
    return S.slope_ratio(draws, above, below, observed, reps=9999)


_SALES = """sales as (select o_orderkey, o_orderpriority, o_orderstatus, n_name as county, date_trunc('month', o_orderdate)::date as m, o_totalprice as price, ln(o_totalprice) as y, c_acctbal / 1000 as hhi, (r_name = 'AMERICA')::int::double as treated, (o_orderdate >= timestamp '1998-01-01')::int::double as post,
 month(o_orderdate) / 4.0 + (year(o_orderdate) - 1995) / 2.0 as rate_gap, (o_totalprice > 200000 and o_totalprice <= 400000)::int::double as mid, (o_totalprice > 400000)::int::double as lux, c_mktsegment from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def sales(spark, sf) -> DataFrame:
    """A row for each order with what the models of single sales take."""
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    p = F.col("o_totalprice")
    return j.select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "c_mktsegment", F.col("n_name").alias("county"), F.trunc("o_orderdate", "month").alias("m"), p.alias("price"), F.log(p).alias("log_price"), (F.col("c_acctbal") / 1000).alias("hhi"), (F.col("r_name") == "AMERICA").cast("double").alias("treated"),
        (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("double").alias("post"), (F.month("o_orderdate") / 4.0 + (F.year("o_orderdate") - 1995) / 2.0).alias("rate_gap"), F.when(p <= 200_000, "entry").when(p <= 400_000, "mid").otherwise("luxury").alias("tier"),
    )


#: The models of single sales by their terms, and the terms' SQL.
SALE_MODELS = {"base": ["rate_gap", "tier", "treated", "hhi"], "interact": ["rate_gap*tier", "treated", "hhi"], "did_simple": ["treated*post"], "did": ["treated*post", "hhi"], "did_triple": ["treated*post*tier", "hhi"]}
_TERM = {"(Intercept)": "1.0", "tier=mid": "mid", "tier=luxury": "lux"}


def _terms(model: str) -> dict[str, str]:
    names = list(S.products(SALE_MODELS[model], {"tier": TIERS}, ("rate_gap", "treated", "post", "hhi")))
    return {n: " * ".join(_TERM.get(x, x) for x in n.split(":")) for n in names}


def _sale_model_sql(model: str) -> str:
    terms = _terms(model)
    c, k = list(terms.values()), len(terms)
    return f"""select '{model}' as model, * from (with recursive {_SALES}, {O.solved('sales', c, 'y')}, x as (select any_value(s.beta) as beta, any_value(s.inv) as inv, any_value(s.n) as n, sum((y - {O.fitted(c)}) ** 2) as rss from sales, solved s), {O.tidy(list(terms), f'inv[i][i] * rss / (n - {k})', 'x', True)})"""


@_rounding("estimate std_error z p_value low high percent_effect", " union all ".join(_sale_model_sql(m) for m in SALE_MODELS))
def sale_models(spark, sf):
    """Five models of single sales' log prices from one pass over the sales."""
    d = sales(spark, sf)
    terms = {m: S.design(d, t, {"tier": TIERS}, ("rate_gap", "treated", "post", "hhi")) for m, t in SALE_MODELS.items()}
    union = reduce(lambda a, b: a | b, terms.values())
    fits, v = fit_many(d, {"y": F.col("log_price")}, union, {m: (F.lit(True), "y", list(t)) for m, t in terms.items()})
    return _rounded(reduce(DataFrame.unionByName, [S.tidy(spark, f, v[m], True).withColumn("model", F.lit(m)) for m, f in fits.items()]))


@query(f"""with {_SALES}, e as (select *, case when price <= 200000 then 'entry' when price <= 400000 then 'mid' else 'luxury' end as tier from sales where o_orderstatus <> 'P' and price > 75000 and price <= 450000),
 s as (select county, m, tier, arg_min(o_orderpriority, (-n, o_orderpriority)) as dominant_schema from (select county, m, tier, o_orderpriority, count(*) as n from e group by all) group by all)
 select county, m::varchar as m, tier, count(*) as transactions, quantile_cont(price, 0.5) as median_price, min(rate_gap) as rate_gap, any_value(dominant_schema) as dominant_schema, ln(quantile_cont(price, 0.5)) as log_price from e join s using (county, m, tier) group by county, m, tier""")
def transaction_panel(spark, sf):
    """Cells of the eligible sales inside other price bounds."""
    p = PN.transaction_panel(sales(spark, sf), ["county", "m"], F.col("o_orderstatus") != "P", price="price", bound="price", lower=75_000, upper=450_000, tier="tier", schema="o_orderpriority", first=["rate_gap"])
    return p.withColumn("m", F.col("m").cast("string"))


#: Eligible sales of each specification, as SQL: rows, tier, exposure and price.
_TIER = "case when price <= 200000 then 'entry' when price <= 400000 then 'mid' else 'luxury' end"
_OPEN = "o_orderstatus <> 'P' and price > 50000 and price <= 15000000"
_ADJUSTED = "case when o_orderkey % 4 <> 0 then price * (1 - 0.05 * (o_orderkey % 3)) end"
_SPEC_SQL = {
    "quantile_tiers": (_OPEN, "case when price <= t1 then 'entry' when price <= t2 then 'mid' else 'luxury' end", "rate_gap", "price"),
    "lag_3_months": (_OPEN, _TIER, "lag3", "price"), "lag_6_months": (_OPEN, _TIER, "lag6", "price"),
    "strict_cohort": (f"{_OPEN} and o_orderstatus = 'F'", _TIER, "rate_gap", "price"), "exclude_recovered": (f"{_OPEN} and o_orderkey % 11 <> 0", _TIER, "rate_gap", "price"),
    "exclude_recent": (f"{_OPEN} and m < date '2001-02-01'", _TIER, "rate_gap", "price"), "alternative_bounds": ("o_orderstatus <> 'P' and price > 75000 and price <= 450000", _TIER, "rate_gap", "price"),
    "adjusted_price": (f"{_OPEN} and {_ADJUSTED} is not null", _TIER, "rate_gap", _ADJUSTED),
}
_X = ["1.0", "x", "mid", "lux", "treated", "x * mid", "x * lux"]


@_rounding("estimate std_error", f"""with recursive {_SALES}, r as (select distinct m, rate_gap from sales), q as (select treated as tt, quantile_cont(price, 1/3) as t1, quantile_cont(price, 2/3) as t2 from sales where {_OPEN} group by 1),
 s as (select sales.*, t1, t2, a.rate_gap as lag3, b.rate_gap as lag6 from sales left join q on treated = tt left join r a on a.m = (sales.m - interval 3 month)::date left join r b on b.m = (sales.m - interval 6 month)::date),
 rows as ({' union all '.join(f"select '{n}' as spec, county, m, treated, {tier} as tier, {x} as x, {p} as p from s where {keep}" for n, (keep, tier, x, p) in _SPEC_SQL.items())}),
 sets as (select spec, county, m, x, treated, (tier = 'mid')::int::double as mid, (tier = 'luxury')::int::double as lux, count(*)::double as transactions, ln(quantile_cont(p, 0.5)) as y from rows where x is not null group by spec, county, m, tier, x, treated),
 {O.solved('sets', _X, 'y', 'transactions', 'spec')}, sc as (select spec, county, {'[' + ', '.join(f"sum(transactions * (y - {O.fitted(_X)}) * ({c}))" for c in _X) + ']'} as sc from sets join solved on g = spec group by all),
 u as (select g, n, kept, beta, list_sum(list_transform(range(1, 8), lambda a: inv[2][a] * sc[a])) as u from sc join solved on g = spec)
 select g as specification, any_value(n) as n, any_value(beta)[2] as estimate, sqrt(sum(u * u) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - any_value(kept))) as std_error from u group by 1""")
def sensitivity_panels(spark, sf):
    """The slope on panels built anew from single sales: other tiers, lagged exposures, a stricter cohort, without recovered
    or recent rows, other bounds, another price. All panels are fitted from two passes over their union."""
    d = sales(spark, sf)
    months = d.select("m", "rate_gap").distinct()
    later = lambda k: months.select(F.add_months("m", k).alias("m"), F.col("rate_gap").alias(f"lag{k}"))
    opened = F.col("o_orderstatus") != "P"
    inside = opened & F.col("price").between(50_000.005, 15_000_000)
    cuts = A.quantiles(d.where(inside), ["treated"], "price", {"t1": 1 / 3, "t2": 2 / 3})
    key = F.col("o_orderkey")
    d = d.join(later(3), "m", "left").join(later(6), "m", "left").join(cuts, "treated", "left").withColumns({
        "thirds": F.when(F.col("price") <= F.col("t1"), "entry").when(F.col("price") <= F.col("t2"), "mid").otherwise("luxury"), "adjusted": F.when(key % 4 != 0, F.col("price") * (1 - F.lit(0.05) * (key % 3))),
    })

    def cells(name: str, eligible=opened, *, x="rate_gap", tier="tier", price="price", lower=50_000, upper=15_000_000) -> DataFrame:
        p = PN.transaction_panel(d, ["county", "m"], eligible, price=price, bound="price", lower=lower, upper=upper, tier=tier, schema="o_orderpriority", first=[x, "treated"])
        return p.select(F.lit(name).alias("spec"), "county", F.col(tier).alias("tier"), F.col(x).alias("rate_gap"), "treated", "transactions", "log_price")

    panels = [
        cells("quantile_tiers", tier="thirds"), cells("lag_3_months", x="lag3"), cells("lag_6_months", x="lag6"), cells("strict_cohort", F.col("o_orderstatus") == "F"), cells("exclude_recovered", opened & (key % 11 != 0)),
        cells("exclude_recent", opened & (F.col("m") < "2001-02-01")), cells("alternative_bounds", lower=75_000, upper=450_000), cells("adjusted_price", opened & F.col("adjusted").isNotNull(), price="adjusted"),
    ]
    p = reduce(DataFrame.unionByName, panels).cache()
    columns = _columns(p, ["rate_gap*tier", "treated"])
    fits, v = fit_many(p, {"y": F.col("log_price")}, columns, {n: (F.col("spec") == n, "y", list(columns)) for n in _SPEC_SQL}, F.col("transactions"), cluster="county")
    rows = [(n, f.n, float(f.beta[at]), float(np.sqrt(v[n][at, at]))) for n, f in fits.items() for at in [f.names.index("rate_gap")]]
    return _rounded(spark.createDataFrame(rows, "specification string, n long, estimate double, std_error double"))


@query()
def schema_era(spark, sf):
    """The triple effect with controls for the schema that most of a cell's sales came in, alone and by tier and treatment."""
    p = PN.transaction_panel(sales(spark, sf), ["county", "m"], F.col("o_orderstatus") != "P", price="price", bound="price", lower=50_000, upper=15_000_000, tier="tier", schema="o_orderpriority", first=["rate_gap", "treated", "hhi"]).cache()
    eras = [r.dominant_schema for r in p.select("dominant_schema").distinct().orderBy("dominant_schema").collect()]  # a handful of forms
    columns = S.design(p, ["rate_gap*tier*treated", "dominant_schema*tier*treated", "hhi"], {"tier": TIERS, "dominant_schema": eras}, ("rate_gap", "treated", "hhi"))
    rows, fit = fit_absorbed(p, "log_price", columns, ["county", "m"], F.col("transactions"))
    terms = S.tidy(spark, fit, S.cluster_vcov(rows, fit, "county"), True)
    return terms.where(F.col("term") == S.select_term(fit.names, ["rate_gap", "tier=mid", "treated"]))


#: Quarters from the shock are clamped to this range, and the one before it is the reference.
QUARTERS, REFERENCE_QUARTER = (-28, 15), -1


def event_panel(p: DataFrame, year: int, least_gap: float) -> tuple[DataFrame, int, list[int]]:
    """(panel with event_quarter, the shock's quarter, quarters that occur). The shock is the first month of ``year`` whose
    rate gap reaches ``least_gap``; a year without one raises."""
    index = lambda m: F.year(m) * 4 + F.quarter(m)
    shock = p.where((F.year("m") == year) & (F.col("rate_gap") >= least_gap)).agg(F.min("m").alias("m")).select(index("m").alias("q")).first()["q"]
    if shock is None:
        raise ValueError(f"no month of {year} with a rate gap of {least_gap}")
    q = F.greatest(F.lit(QUARTERS[0]), F.least(F.lit(QUARTERS[1]), index("m") - shock))
    d = p.withColumns({"event_quarter": q, "calendar_quarter": F.concat(F.year("m").cast("string"), F.lit("Q"), F.quarter("m").cast("string"))})
    first, last = d.agg(F.min("event_quarter"), F.max("event_quarter")).first()
    return d, shock, list(range(first, last + 1))


def event_fit(spark, sf) -> tuple[DataFrame, S.Fit, int]:
    """(rows, fit, shock): log prices on event quarter x treated x tier with income and effects of county and quarter."""
    d, shock, quarters = event_panel(panel(spark, sf), 1998, 2.5)
    d = d.withColumn("quarter", F.concat(F.lit("q"), F.col("event_quarter").cast("string")))
    levels = [f"q{REFERENCE_QUARTER}", *(f"q{q}" for q in quarters if q != REFERENCE_QUARTER)]
    columns = S.design(d, ["quarter*treated*tier", "income"], {"quarter": levels, "tier": TIERS}, ("treated", "income"))
    rows, fit = fit_absorbed(d, "log_price", columns, ["county", "calendar_quarter"], F.col("transactions"))
    return rows, fit, shock


@query()
def event_study(spark, sf):
    """By quarter from the shock: the treated against the others, and how the higher tiers differ from the entry tier in it,
    with wild bootstrap intervals; the reference quarter is 0 by definition."""
    rows, fit, _ = event_fit(spark, sf)
    terms = [i for i, n in enumerate(fit.names) if n.startswith("quarter=") and "treated" in n]
    boot = S.wild_bootstrap(fit, S.cluster_scores(rows, fit, "county"), terms, 999, seed=421)
    comparison = F.when(F.col("term").contains("tier=mid"), "mid minus entry").when(F.col("term").contains("tier=luxury"), "luxury minus entry").otherwise("entry treated minus others")
    out = boot.select(F.regexp_extract("term", "quarter=q(-?[0-9]+)", 1).cast("int").alias("event_quarter"), comparison.alias("comparison"), "estimate", "low", "high", "p_value")
    reference = [(REFERENCE_QUARTER, c, 0.0, 0.0, 0.0, None) for c in ("mid minus entry", "luxury minus entry", "entry treated minus others")]
    return out.unionByName(spark.createDataFrame(reference, "event_quarter int, comparison string, estimate double, low double, high double, p_value double"))


#: Lead scopes by the years that their quarters lie in.
LEADS = {"all": (0, 9999), "baseline": (0, 1996), "transition": (1997, 9999)}


@query()
def wald_pretrend(spark, sf):
    """Joint tests that the treated mid tier did not move differently from the entry tier before the shock, by scope: all
    leads, those of the baseline years and those of the transition."""
    rows, fit, shock = event_fit(spark, sf)
    v, found = S.cluster_vcov(rows, fit, "county"), []
    lead = {i: int(n.split(":")[0].removeprefix("quarter=q")) for i, n in enumerate(fit.names) if n.startswith("quarter=") and "treated" in n and n.endswith("tier=mid")}
    for scope, (first, last) in LEADS.items():
        at = [i for i, q in lead.items() if q < REFERENCE_QUARTER and first <= (shock + q - 1) // 4 <= last]
        found.append((scope, len(at), *S.wald(fit.beta[at], v[np.ix_(at, at)])))
    return spark.createDataFrame(found, "scope string, leads int, statistic double, df int").withColumn("p_value", chi2_p(F.col("statistic"), F.col("df")))


def market_panel(spark, sf) -> DataFrame:
    """County x month outcomes of the listings that line items stand for: days to ship, open lines, months of supply, price
    kept of the list price, share of lines with a large discount."""
    t = Tables(spark, sf)
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    g = li.groupBy(F.col("n_name").alias("county"), F.col("r_name").alias("region"), F.trunc("o_orderdate", "month").alias("m")).agg(
        F.percentile(F.datediff("l_shipdate", "o_orderdate"), F.lit(0.5)).alias("median_dom"), F.count_if(F.col("l_linestatus") == "O").cast("double").alias("inventory"),
        F.try_divide(F.count_if(F.col("l_linestatus") == "O").cast("double"), F.count_if(F.col("l_returnflag") == "R")).alias("months_of_supply"), F.avg(1 - F.col("l_discount")).alias("avg_sale_to_list"),
        F.avg((F.col("l_discount") >= 0.08).cast("double")).alias("price_drops"), F.avg("c_acctbal").alias("income"),
    )
    return g.select("*", (F.month("m") / 4.0 + (F.year("m") - 1995) / 2.0).alias("rate_gap"), (F.col("region") == "AMERICA").cast("double").alias("treated")).cache()


OUTCOMES = ("median_dom", "inventory", "months_of_supply", "avg_sale_to_list", "price_drops")


@query()
def listing_outcomes(spark, sf):
    """The rate gap's effect on five market outcomes where treated, with county and month effects. Outcomes are known for
    different cells, so that each is absorbed over its own; clusters are counties."""
    m, parts = market_panel(spark, sf), []
    columns = S.design(m, ["rate_gap*treated", "income"], {}, ("rate_gap", "treated", "income"))
    for y, (rows, fit) in fit_absorbed_many(m, OUTCOMES, columns, ["county", "m"]).items():
        terms = S.tidy(spark, fit, S.cluster_vcov(rows, fit, "county")).where(F.col("term") == "rate_gap:treated")
        parts.append(terms.select(F.lit(y).alias("outcome"), F.lit(fit.n).alias("n"), "estimate", "std_error", "p_value"))
    return reduce(DataFrame.unionByName, parts)


@query()
def pooled_four_way(spark, sf):
    """One model of two metropolitan areas: the triple effect in each and their difference, as linear combinations of the
    triple and the four-way term, with county and month effects."""
    n = F.regexp_extract("county", "([0-9]+)$", 1).cast("int")
    p = panel(spark, sf).withColumns({"metro": (n % 2).cast("double"), "core": (n % 3 == 0).cast("double")})
    columns = S.design(p, ["metro*rate_gap*tier*core", "income"], {"tier": TIERS}, ("metro", "rate_gap", "core", "income"))
    rows, fit = fit_absorbed(p, "log_price", columns, ["county", "m"], F.col("transactions"))
    v = S.cluster_vcov(rows, fit, "county")
    triple, four = S.select_term(fit.names, ["rate_gap", "tier=mid", "core"], ["metro"]), S.select_term(fit.names, ["metro", "rate_gap", "tier=mid", "core"])
    out = []
    for name, terms in (("first metro", [triple]), ("second metro", [triple, four]), ("second minus first", [four])):
        out.append((name, *S.linear_combination(fit.beta, v, np.array([1.0 if t in terms else 0.0 for t in fit.names]))))
    t = spark.createDataFrame(out, "combination string, estimate double, std_error double")
    return t.withColumn("p_value", normal_p(F.col("estimate") / F.col("std_error")))


_AT = "[1.0, g, (tier = 'mid')::int::double, (tier = 'luxury')::int::double, 1.0, g * (tier = 'mid')::int, g * (tier = 'luxury')::int]"


@_rounding("fitted std_error low high", f"""with recursive {O.PANEL}, {O.solved('panel', _GAP, 'log_price')}, {_RSS}, d as (select *, {_AT} as v from (select unnest(['entry', 'mid', 'luxury']) as tier), (select -0.3 + k * 0.1::double as g from range(50) t(k))),
 f as (select list_sum(list_transform(range(1, 8), lambda i: beta[i] * v[i])) as fitted, sqrt(list_sum(list_transform(range(1, 8), lambda i: v[i] * list_sum(list_transform(range(1, 8), lambda j: inv[i][j] * v[j])))) * rss / (n - 7)) as std_error from d, x)
 select fitted, std_error, fitted - 1.959963984540054 * std_error as low, fitted + 1.959963984540054 * std_error as high from f""")
def prediction_grid(spark, sf):
    p = panel(spark, sf)
    fit = S.wls(p, F.col("log_price"), _columns(p, ["rate_gap*tier", "treated"]))
    grid = [{"rate_gap": g, "treated": 1.0} | ({f"tier={t}": 1.0, f"rate_gap:tier={t}": g} if t != "entry" else {}) for t in TIERS for g in np.arange(-0.3, 4.65, 0.1)]
    return _rounded(S.predict(spark, fit, S.classical_vcov(fit), grid))


@_rounding("slope std_error percent_effect", f"""with recursive {O.PANEL}, {_robust(_GAP)}, c as (select tier, [0.0, 1.0, 0.0, 0.0, 0.0, (tier = 'mid')::int::double, (tier = 'luxury')::int::double] as c from (select unnest(['entry', 'mid', 'luxury']) as tier)),
 h as (select tier, list_sum(list_transform(range(1, 8), lambda i: beta[i] * c[i])) as slope, list_transform(range(1, 8), lambda i: list_sum(list_transform(range(1, 8), lambda j: inv[i][j] * c[j]))) as u, meat, n, kept from c, x),
 s as (select tier, slope, sqrt(list_sum(list_transform(range(1, 8), lambda i: u[i] * list_sum(list_transform(range(1, 8), lambda j: meat[i][j] * u[j])))) * n / (n - kept)) as std_error from h)
 select tier, gap::double as gap, slope, std_error, 100 * (exp(slope * gap) - 1) as percent_effect from s, (select unnest([1, 2, 3, 4]) as gap)""")
def scenario_table(spark, sf):
    """Percent effect of rate gaps by tier: exp(slope x gap) - 1 of linear combinations."""
    p = panel(spark, sf)
    fit = S.wls(p, F.col("log_price"), _columns(p, ["rate_gap*tier", "treated"]))
    v, rows = S.hc1_vcov(p, fit), []
    for t in TIERS:
        w = np.array([1.0 if n in ("rate_gap", f"rate_gap:tier={t}") else 0.0 for n in fit.names])
        b, se = S.linear_combination(fit.beta, v, w)
        rows += [(t, float(g), b, se, 100 * float(np.expm1(b * g))) for g in (1, 2, 3, 4)]
    return _rounded(spark.createDataFrame(rows, "tier string, gap double, slope double, std_error double, percent_effect double"))


_SPECS = {"all": "true", "no_transition": "year(m) not in (1996, 1997)", "min_transactions": "transactions >= 3", "bounds": "price between 75000 and 450000", "no_recent": "m < date '2001-02-01'", "known_income": "income > 0"} | {f"without_{r}": f"region <> '{r}'" for r in REGIONS}


@_rounding("estimate std_error", f"""with recursive {O.PANEL}, sets as ({' union all '.join(f"select '{n}' as spec, * from panel where {c}" for n, c in _SPECS.items())}), {O.solved('sets', _GAP, 'log_price', 'transactions', 'spec')},
 sc as (select spec, county, {'[' + ', '.join(f"sum(transactions * (log_price - {O.fitted(_GAP)}) * ({c}))" for c in _GAP) + ']'} as sc from sets join solved on g = spec group by all),
 u as (select g, n, kept, beta, list_sum(list_transform(range(1, 8), lambda a: inv[2][a] * sc[a])) as u from sc join solved on g = spec)
 select g as specification, any_value(n) as n, any_value(beta)[2] as estimate, sqrt(sum(u * u) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - any_value(kept))) as std_error from u group by 1""")
def sensitivity_matrix(spark, sf):
    """The same slope refitted on filtered panels, and with each region left out: two passes over the panel for all."""
    p = panel(spark, sf)
    specs = {"all": F.lit(True), "no_transition": ~F.col("year").isin("1996", "1997"), "min_transactions": F.col("transactions") >= 3, "bounds": F.col("price").between(75_000, 450_000), "no_recent": F.col("m") < "2001-02-01", "known_income": F.col("income") > 0}
    specs |= {f"without_{r}": F.col("region") != r for r in REGIONS}
    columns = _columns(p, ["rate_gap*tier", "treated"])
    fits, v = fit_many(p, {"y": F.col("log_price")}, columns, {n: (keep, "y", list(columns)) for n, keep in specs.items()}, F.col("transactions"), cluster="county")
    rows = []
    for name, fit in fits.items():
        if "rate_gap" in fit.names:
            at = fit.names.index("rate_gap")
            rows.append((name, fit.n, float(fit.beta[at]), float(np.sqrt(v[name][at, at]))))
    return _rounded(spark.createDataFrame(rows, "specification string, n long, estimate double, std_error double"))
