"""Pieces of DuckDB SQL that the estimators' oracles share: p-values by quadrature, normal equations by elimination, the panel.

They are plain mathematics written a second time, another way than the library's, so that agreement means something."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

#: Nodes of the double-exponential rule on (0, inf): u = exp(pi/2 sinh y).
_NODES = "range(-600, 601)"
_U = "exp(pi() / 4 * (exp(k / 128.0) - exp(-k / 128.0)))"
_DU = f"(pi() / 512 * (exp(k / 128.0) + exp(-k / 128.0)) * {_U})"


def normal_p(z: str) -> str:
    """Two-sided p-value of a normal statistic: the density from |z| on, integrated."""
    return f"(2 / sqrt(2 * pi()) * exp(-({z}) * ({z}) / 2) * list_sum(list_transform({_NODES}, lambda k: {_DU} * exp(-abs({z}) * {_U} - {_U} * {_U} / 2))))"


def student_p(t: str, df: str) -> str:
    """The same of Student's t; the ratio of gammas comes from their asymptotic series, shifted by 40."""
    z = f"(({df}) / 2 + 40)"
    ratio = f"(({z} - 0.5) * ln(1 + 0.5 / {z}) + 0.5 * ln({z} + 0.5) - 0.5 + 1 / (12 * ({z} + 0.5)) - 1 / (12 * {z}) - 1 / (360 * ({z} + 0.5) ** 3) + 1 / (360 * {z} ** 3))"
    shift = f"list_sum(list_transform(range(0, 40), lambda i: ln(1 + 0.5 / (({df}) / 2 + i))))"
    tail = f"list_sum(list_transform({_NODES}, lambda k: {_DU} * exp(-(({df}) + 1) / 2 * ln((1 + (abs({t}) + {_U}) ** 2 / ({df})) / (1 + ({t}) ** 2 / ({df}))))))"
    return f"(2 * exp({ratio} - {shift} - 0.5 * ln(pi() * ({df})) - (({df}) + 1) / 2 * ln(1 + ({t}) ** 2 / ({df}))) * {tail})"


def solved(source: str, columns: Sequence[str], y: str, weight: str = "1", by: str = "1") -> str:
    """CTEs ``gram`` and ``solved(g, beta, inv)``: (weighted) least squares of ``y`` on x1..xk of ``source``, a fit for each
    value of ``by``, by Gauss-Jordan elimination of [X'WX | X'Wy | I]."""
    k = len(columns)
    cell = lambda a, b: f"sum(({weight}) * ({a}) * ({b}))"
    rows = ", ".join("[" + ", ".join([*(cell(a, b) for b in columns), cell(a, y), *("1.0" if i == j else "0.0" for j in range(k))]) + "]" for i, a in enumerate(columns))
    # a column that earlier ones give leaves no pivot: its row becomes zero, and so do its coefficient and its variance
    row = f"case when m[s + 1][s + 1] < 1e-7 then list_transform(m[s + 1], lambda x: 0.0) else list_transform(m[s + 1], lambda x: x / m[s + 1][s + 1]) end"
    other = f"case when m[s + 1][s + 1] < 1e-7 then m[i] else list_transform(range(1, {2 * k + 2}), lambda j: m[i][j] - m[i][s + 1] / m[s + 1][s + 1] * m[s + 1][j]) end"
    step = f"list_transform(range(1, {k + 1}), lambda i: case when i = s + 1 then {row} else {other} end)"
    return f"""gram as (select {by} as g, count(*) as n, [{rows}] as m from {source} group by 1), steps as (select g, n, 0 as s, m from gram union all select g, n, s + 1, {step} from steps where s < {k}),
 solved as (select g, n, list_transform(m, lambda r: r[{k + 1}]) as beta, list_transform(m, lambda r: r[{k + 2}:{2 * k + 1}]) as inv, len(list_filter(range(1, {k + 1}), lambda i: m[i][{k + 1} + i] <> 0)) as kept from steps where s = {k})"""


def fitted(columns: Sequence[str], beta: str = "beta") -> str:
    return "(" + " + ".join(f"{beta}[{i + 1}] * ({c})" for i, c in enumerate(columns)) + ")"


def quadratic(k: int, inv: str, meat: str, i: str = "i") -> str:
    """Entry (i, i) of inv * meat * inv for two lists of rows."""
    inner = f"list_sum(list_transform(range(1, {k + 1}), lambda b: {meat}[a][b] * {inv}[b][{i}]))"
    return f"list_sum(list_transform(range(1, {k + 1}), lambda a: {inv}[{i}][a] * {inner}))"


def matrix(columns: Sequence[str], weight: str) -> str:
    """sum(weight * x x') as a list of rows, an aggregate."""
    return "[" + ", ".join("[" + ", ".join(f"sum(({weight}) * ({a}) * ({b}))" for b in columns) + "]" for a in columns) + "]"


def tidy(names: Sequence[str], variance: str, source: str, log_outcome: bool) -> str:
    """term, estimate, std_error, z, p_value, low, high and percent_effect from ``beta`` and a variance of term i."""
    terms = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    percent = "100 * (exp(b) - 1)" if log_outcome else "cast(null as double)"
    return f"""t as (select {terms}[i] as term, beta[i] as b, sqrt({variance}) as se from (select *, unnest(range(1, {len(names) + 1})) as i from {source}))
 select term, b as estimate, se as std_error, b / se as z, {normal_p('b / se')} as p_value, b - 1.959963984540054 * se as low, b + 1.959963984540054 * se as high, {percent} as percent_effect from t"""


PANEL = """panel as (select *, ln(price) as log_price, rate - 3.0 as rate_gap, (region = 'AMERICA')::int::double as treated, (year(m) >= 1998)::int::double as post, (tier = 'mid')::int::double as mid, (tier = 'luxury')::int::double as lux from (
 select n_name as county, r_name as region, date_trunc('month', o_orderdate)::date as m, case when o_totalprice <= 200000 then 'entry' when o_totalprice <= 400000 then 'mid' else 'luxury' end as tier, count(*)::double as transactions, quantile_cont(o_totalprice, 0.5) as price, avg(c_acctbal) as income,
 3.0 + month(date_trunc('month', o_orderdate)) / 4.0 + (year(date_trunc('month', o_orderdate)) - 1995) / 2.0 as rate from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all))"""
#: The columns of rate_gap * tier + treated, by their terms.
GAP: Mapping[str, str] = {"(Intercept)": "1.0", "rate_gap": "rate_gap", "tier=mid": "mid", "tier=luxury": "lux", "treated": "treated", "rate_gap:tier=mid": "rate_gap * mid", "rate_gap:tier=luxury": "rate_gap * lux"}
