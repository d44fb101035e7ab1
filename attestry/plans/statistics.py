"""Statistical queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from attestry.operators import statistics as st
from attestry.plans.catalogue import query

Z = st.Z95


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5 * ({x})))"
    poly = str(st.ERFC[-1])
    for c in reversed(st.ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def p_sql(z: str) -> str:
    return erfc_sql(f"abs({z}) / {math.sqrt(2)!r}")


def choose_sql(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


@query("wilson_ci", "M81", f"""
with g as (select event_type, count(*) as n, count(*) filter (value > 50) as k, count(*) filter (value > 50) / count(*) as p from events group by 1)
select event_type, n, k, round(p, 6) as rate, round((p + {Z}*{Z} / (2*n) - {Z} * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n))) / (1 + {Z}*{Z}/n), 6) as low,
  round((p + {Z}*{Z} / (2*n) + {Z} * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n))) / (1 + {Z}*{Z}/n), 6) as high from g""")
def _(t):
    return st.wilson_ci(t.events, F.col("value") > 50, ["event_type"])


@query("clopper_pearson_ci", "M82", f"""
with recursive g as (select l_returnflag, l_linestatus, count(*) as n, count(*) filter (l_discount = 0.1) as k from lineitem group by all),
b(l_returnflag, l_linestatus, n, k, i, llo, lhi, hlo, hhi) as (
  select l_returnflag, l_linestatus, n, k, 0, 0.0::double, 1.0::double, 0.0::double, 1.0::double from g
  union all
  select l_returnflag, l_linestatus, n, k, i + 1,
    case when lt < 0.025 then lm else llo end, case when lt < 0.025 then lhi else lm end,
    case when ht > 0.025 then hm else hlo end, case when ht > 0.025 then hhi else hm end
  from (select *, (llo + lhi) / 2 as lm, (hlo + hhi) / 2 as hm,
      list_sum(list_transform(range(k, n + 1), lambda x: exp({choose_sql('n', 'x')} + x * ln((llo + lhi) / 2) + (n - x) * ln(1 - (llo + lhi) / 2)))) as lt,
      list_sum(list_transform(range(0, k + 1), lambda x: exp({choose_sql('n', 'x')} + x * ln((hlo + hhi) / 2) + (n - x) * ln(1 - (hlo + hhi) / 2)))) as ht
    from b where i < 40) s)
select l_returnflag, l_linestatus, n, k, round(k / n, 6) as rate, round((llo + lhi) / 2, 6) as low, round((hlo + hhi) / 2, 6) as high from b where i = 40""")
def _(t):
    return st.clopper_pearson_ci(t.lineitem, F.col("l_discount") == 0.1, ["l_returnflag", "l_linestatus"])


@query("fisher_exact", "M83", f"""
with g as (select count(*) filter (quality = 1 and toxic = 1) as a, count(*) filter (quality = 1 and toxic = 0) as b,
  count(*) filter (quality = 0 and toxic = 1) as c, count(*) filter (quality = 0 and toxic = 0) as d from labels),
t as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from g),
l as (select *, {choose_sql('(a+b)', 'x')} + {choose_sql('(c+d)', '(a+c-x)')} - {choose_sql('(a+b+c+d)', '(a+c)')} as lp from t)
select a, b, c, d, round(least(1, sum(case when lp <= (select lp from l where x = a) + 1e-7 then exp(lp) else 0 end)), 6) as p from l group by a, b, c, d""")
def _(t):
    return st.fisher_exact(t.labels, F.col("quality") == 1, F.col("toxic") == 1)




def mw_sql(a: str, b: str, col: str = "l_returnflag", value: str = "l_extendedprice") -> str:
    return f"""
(with s as (select {value} as v, ({col} = '{a}')::int as f from lineitem where {col} in ('{a}', '{b}')),
c as (select v, count(*) as n, sum(f) as n1 from s group by 1),
k as (select *, sum(n) over (order by v) as n_to from c),
g as (select sum(n1)::bigint as n_a, (sum(n) - sum(n1))::bigint as n_b, sum(n1 * (n_to - (n - 1) / 2))::double as r, sum(n::double*n*n - n) as t from k),
u as (select *, r - n_a::double * (n_a + 1) / 2 as u,
   sqrt(n_a::double * n_b / 12 * (n_a + n_b + 1 - t / ((n_a + n_b)::double * (n_a + n_b - 1)))) as sd from g)
select '{a}-{b}' as contrast, n_a, n_b, u, (u - n_a::double * n_b / 2) / sd as z from u)"""


@query("mann_whitney", "M84", f"select n_a, n_b, round(u, 6) as u, round(z, 6) as z, round({p_sql('z')}, 6) as p from {mw_sql('A', 'R', value='l_discount')}")
def _(t):
    return st.mann_whitney(t.lineitem, "l_discount", F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")


@query("mcnemar_exact", "M85", f"""
with g as (select count(*) filter (quality = 1 and toxic = 0) as b, count(*) filter (quality = 0 and toxic = 1) as c from labels),
t as (select b, c, unnest(range(0, least(b, c) + 1)) as x from g)
select b, c, round(least(1, 2 * sum(exp({choose_sql('(b+c)', 'x')} - (b+c) * ln(2)))), 6) as p from t group by b, c""")
def _(t):
    return st.mcnemar_exact(t.labels, F.col("quality") == 1, F.col("toxic") == 1)


@query("benjamini_hochberg", "M86", f"""
with o as (select avg(l_discount) as m, stddev_samp(l_discount) as s from lineitem),
z as (select l_partkey, round((avg(l_discount) - (select m from o)) / ((select s from o) / sqrt(count(*))), 9) as z from lineitem group by 1),
p as (select l_partkey, round({p_sql('z')}, 9) as p from z),
q as (select *, p * count(*) over () / rank() over (order by p, l_partkey) as q from p)
select l_partkey, round(p, 6) as p, round(least(1, min(q) over (order by p desc, l_partkey desc)), 6) as p_adjusted from q""")
def _(t):
    whole = t.lineitem.select(F.struct(F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"))).scalar()
    z = t.lineitem.groupBy("l_partkey").agg(F.avg("l_discount").alias("a"), F.count(F.lit(1)).alias("n"))
    z = z.withColumn("z", F.round((F.col("a") - whole["m"]) / (whole["s"] / F.sqrt("n")), 9))
    return st.benjamini_hochberg(z.select("l_partkey", F.round(st.two_sided_p(F.col("z")), 9).alias("p")), "l_partkey", "p")


@query("loglog_slope", "M87", f"""
with g as (select l_returnflag, count(*) as n, regr_slope(ln(l_extendedprice), ln(l_quantity)) as slope, regr_r2(ln(l_extendedprice), ln(l_quantity)) as r2,
  regr_sxx(ln(l_extendedprice), ln(l_quantity)) as sxx, regr_syy(ln(l_extendedprice), ln(l_quantity)) as syy,
  regr_slope(ln(l_extendedprice), ln(l_quantity)) filter (l_quantity <= 10) as slope_low, regr_slope(ln(l_extendedprice), ln(l_quantity)) filter (l_quantity >= 10) as slope_high
  from lineitem group by 1)
select l_returnflag, n, round(slope, 6) as slope, round(r2, 6) as r2, round(slope - {Z} * sqrt((syy - slope*slope*sxx) / (n - 2) / sxx), 6) as low,
  round(slope + {Z} * sqrt((syy - slope*slope*sxx) / (n - 2) / sxx), 6) as high, round(slope_low, 6) as slope_low, round(slope_high, 6) as slope_high, round(slope_high - slope_low, 6) as delta from g""")
def _(t):
    return st.loglog_slope(t.lineitem, F.col("l_quantity"), F.col("l_extendedprice"), ["l_returnflag"], knot=10)


@query("loglog_slope_cell_means", "M87", f"""
with c as (select l_quantity as x, avg(l_extendedprice) as y from lineitem group by 1),
g as (select count(*) as n, regr_slope(ln(y), ln(x)) as slope, regr_r2(ln(y), ln(x)) as r2, regr_sxx(ln(y), ln(x)) as sxx, regr_syy(ln(y), ln(x)) as syy from c)
select n, round(slope, 6) as slope, round(r2, 6) as r2, round(slope - {Z} * sqrt((syy - slope*slope*sxx) / (n - 2) / sxx), 6) as low,
  round(slope + {Z} * sqrt((syy - slope*slope*sxx) / (n - 2) / sxx), 6) as high from g""")
def _(t):
    cells = t.lineitem.groupBy(F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    return st.loglog_slope(cells, F.col("x"), F.col("y"))


def bootstrap_sql(clusters: str, key: str, draws: int, seed: str, group: str = "") -> str:
    u = f"('0x' || substr(sha256('{seed}:' || {key} || ':' || (b // 8)), (b % 8) * 8 + 1, 8))::ubigint / 4294967296.0"
    w = " + ".join(f"(u >= {c!r})::int" for c in st.POISSON_CUTS)
    g = f"{group}, " if group else ""
    return f"""(select {g}median(s) as median, quantile_cont(s, 0.025) as low, quantile_cont(s, 0.975) as high from (
  select {g}b, sum(top * w)::double / sum(bottom * w) as s from (select {g}b, top, bottom, {w} as w from (
    select *, {u} as u from ({clusters}) c, range({draws}) r(b))) group by all) {f'group by {group}' if group else ''})"""


@query("cluster_bootstrap", "M88", f"""
select l_linestatus, round(median, 6) as median, round(low, 6) as low, round(high, 6) as high from
{bootstrap_sql("select l_orderkey, l_linestatus, sum(l_quantity)::bigint as top, count(*) as bottom from lineitem group by all", "l_orderkey", 200, "b", "l_linestatus")}""")
def _(t):
    clusters = t.lineitem.groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("top"), F.count(F.lit(1)).alias("bottom"))
    return st.cluster_bootstrap(clusters, "l_orderkey", "top", "bottom", 200, "b", ["l_linestatus"])


def resampled_sql(clusters: str, key: str, draws: int, seed: str, stratum: str) -> str:
    """CTEs up to ``weights(stratum, key, draw, weight)`` over ``clusters``, whose strata are texts."""
    return f"""numbered as (select {stratum} as s, {key}, row_number() over (partition by {stratum} order by {key}) as i, count(*) over (partition by {stratum}) as n from (select distinct {stratum}, {key} from {clusters}) where {key} is not null),
taken as (select s, b, ('0x' || substr(sha256('{seed}' || s || ':' || i || ':' || (b // 4)), (b % 4) * 13 + 1, 13))::ubigint % n + 1 as i from numbered, range({draws}) r(b)),
weights as (select s as stratum, {key}, b as draw, w as weight from (select s, b, i, count(*) as w from taken group by all) join numbered using (s, i))"""


STATISTIC_SQL = """stats as (select statistic, v from {ratios}) select statistic, round(median(v), 6) as median, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high,
  (quantile_cont(v, 0.025) > 0 or quantile_cont(v, 0.975) < 0)::int::bigint as excludes_zero from stats group by 1"""
SUPPLIERS_SQL = "c as (select ':' || s_nationkey as s, l_suppkey, count(*) filter (l_returnflag = 'R') as returned, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey group by all)"


@query("stratified_bootstrap", "M88", f"""
with {SUPPLIERS_SQL}, {resampled_sql("c", "l_suppkey", 120, "s", "s")},
d as (select draw, sum(weight * returned) / sum(weight * n) as v from c join weights w on w.stratum = c.s and w.l_suppkey = c.l_suppkey group by 1),
{STATISTIC_SQL.format(ratios="(select 'returned' as statistic, v from d)")}""")
def _(t):
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey", "l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("n"))
    return st.resampled_ratios(rows, "l_suppkey", {"returned": ("returned", "n")}, 120, "s", ["s_nationkey"])


PAIRED_SQL = "c as (select '' as s, l_partkey, count(*) filter (l_linestatus = 'O' and l_returnflag = 'N') as top_o, count(*) filter (l_linestatus = 'O') as n_o, count(*) filter (l_linestatus = 'F' and l_returnflag = 'N') as top_f, count(*) filter (l_linestatus = 'F') as n_f from lineitem group by l_partkey)"


@query("paired_bootstrap", "M88", f"""
with {PAIRED_SQL}, {resampled_sql("c", "l_partkey", 80, "p", "s")},
d as (select draw, sum(weight * top_o) / sum(weight * n_o) as o, sum(weight * top_f) / sum(weight * n_f) as f from c join weights w using (l_partkey) group by 1),
{STATISTIC_SQL.format(ratios="(select 'open' as statistic, o as v from d union all select 'filled', f from d union all select 'open - filled', o - f from d)")}""")
def _(t):
    is_n = F.col("l_returnflag") == "N"
    rows = t.lineitem.groupBy("l_partkey").agg(*[F.count_if(c & (F.col("l_linestatus") == x)).alias(f"{n}_{x.lower()}") for x in "OF" for n, c in (("top", is_n), ("n", F.lit(True)))])
    return st.resampled_ratios(rows, "l_partkey", {"open": ("top_o", "n_o"), "filled": ("top_f", "n_f")}, 80, "p", pairs=[("open", "filled")])


@query("cohen_kappa", "M91", """
with n as (select count(*)::double as n from labels), o as (select count(*) filter (quality = 1 - toxic) / (select n from n) as po from labels),
e as (select (sum(quality)::double * sum(1 - toxic) + sum(1 - quality)::double * sum(toxic)) / ((select n from n) * (select n from n)) as pe from labels)
select (select n from n)::bigint as n, round(po, 6) as observed, round(pe, 6) as expected, round((po - pe) / (1 - pe), 6) as kappa from o, e""")
def _(t):
    return st.cohen_kappa(t.labels.select("quality", (1 - F.col("toxic")).alias("other")), "quality", "other")


ITEMS_SQL = """select l_orderkey, (sum(c*c) - sum(c))::double / (sum(c) * (sum(c) - 1)) as top, 1 as bottom from (
  select l_orderkey, l_returnflag, count(*) as c from lineitem group by all) group by 1 having sum(c) > 1"""


@query("free_marginal_kappa", "M92", f"""
with i as ({ITEMS_SQL}), c as (select * from {bootstrap_sql(ITEMS_SQL, "l_orderkey", 200, "k")})
select count(*) as items, round(avg(top), 6) as observed, round((avg(top) - 1/3.0::double) / (1 - 1/3.0::double), 6) as kappa,
  round(((select low from c) - 1/3.0::double) / (1 - 1/3.0::double), 6) as low, round(((select high from c) - 1/3.0::double) / (1 - 1/3.0::double), 6) as high from i""")
def _(t):
    return st.free_marginal_kappa(t.lineitem, "l_orderkey", "l_returnflag", 3, 200, "k")


@query("spearman", "M93", """
with r as (select l_returnflag, (rank() over (partition by l_returnflag order by l_quantity) + rank() over (partition by l_returnflag order by l_quantity) + count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as rx,
  (rank() over (partition by l_returnflag order by l_discount) + rank() over (partition by l_returnflag order by l_discount) + count(*) over (partition by l_returnflag, l_discount) - 1) / 2.0 as ry from lineitem)
select l_returnflag, count(*) as n, round(corr(rx, ry), 6) as rho from r group by 1""")
def _(t):
    return st.spearman(t.lineitem, "l_quantity", "l_discount", ["l_returnflag"])


@query("normal_ci", "M94", f"""
with g as (select l_returnflag, count(*) as n, avg(l_discount - l_tax) as m, stddev_samp(l_discount - l_tax) as s from lineitem group by 1)
select l_returnflag, n, round(m, 6) as mean, round(s, 6) as sd, round(m - {Z} * s / sqrt(n), 6) as low, round(m + {Z} * s / sqrt(n), 6) as high from g""")
def _(t):
    return st.normal_ci(t.lineitem, F.col("l_discount") - F.col("l_tax"), ["l_returnflag"])


@query("mape_r2", "M95", """
select l_returnflag, count(*) as n, round(100 * avg(abs(l_quantity * 2000 - l_extendedprice) / l_extendedprice), 6) as mape,
  case when l_returnflag = 'A' then round(1 - sum((l_quantity * 2000 - l_extendedprice) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) end as r2 from lineitem group by 1""")
def _(t):
    return st.mape_r2(t.lineitem, F.col("l_quantity") * 2000, F.col("l_extendedprice"), "l_returnflag", "A")


GRID = [{"A": a, "B": b, "E": e, "alpha": al, "beta": be} for a in (100.0, 400.0) for b in (100.0, 1000.0) for e in (0.5, 1000.0) for al in (0.2, 0.5) for be in (0.2, 0.5)]
GRID_SQL = "(values " + ", ".join(f"({i}, {g['A']}, {g['B']}, {g['E']}, {g['alpha']}, {g['beta']})" for i, g in enumerate(GRID)) + ") v(point, a, b, e, alpha, beta)"


@query("huber_grid_fit", "M96", f"""
with s as (select l_linestatus, point, sum(case when r <= 0.05 then 0.5*r*r else 0.05 * (r - 0.025) end) as loss, count(*) as n from (
  select l_linestatus, point, abs(ln(a / pow(l_quantity, alpha) + b / pow(l_partkey + 1, beta) + e) - ln(l_extendedprice)) as r from lineitem, {GRID_SQL}) group by all)
select l_linestatus, arg_min(point, loss)::bigint as point, round(min(loss), 6) as loss, arg_min(n, loss) as n from s group by 1""")
def _(t):
    runs = t.lineitem.select("l_linestatus", "l_quantity", (F.col("l_partkey") + 1).alias("tokens"), "l_extendedprice")
    return st.huber_grid_fit(runs, "l_quantity", "tokens", "l_extendedprice", GRID, "l_linestatus")


@query("opt_ratio", "M97", """
select p_partkey, round(pow(6, (0.3 - al) / (al + 0.3)) * pow(0.3 * 400 / (al * 300), 2 / (al + 0.3)) * pow(p_retailprice, (al - 0.3) / (al + 0.3)), 6) as ratio
from (select *, p_size / 100.0::double as al from part)""")
def _(t):
    alpha = F.col("p_size") / 100.0
    return t.part.select("p_partkey", st.opt_ratio(F.lit(300.0), F.lit(400.0), alpha, F.lit(0.3), F.col("p_retailprice")).alias("ratio"))


@query("classification_prf", "M98", """
with t as (select o_orderstatus as p, case l_returnflag when 'A' then 'F' when 'N' then 'O' else 'R' end as g from lineitem join orders on o_orderkey = l_orderkey),
k as (select distinct p as label from t union select distinct g from t),
c as (select label, (select count(*) from t where p = label) as np, (select count(*) from t where g = label) as ng, (select count(*) from t where p = label and g = label) as tp from k),
m as (select label, case when np > 0 then tp / np else 0 end as precision, case when ng > 0 then tp / ng else 0 end as recall, case when np + ng > 0 then 2 * tp / (np + ng) else 0 end as f1, tp, ng from c)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round((select avg(f1) from m), 6) as macro_f1, round((select sum(tp)::double / sum(ng) from m), 6) as accuracy from m""")
def _(t):
    gold = F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").otherwise("R")
    d = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderstatus").alias("p"), gold.alias("g"))
    return st.classification_prf(d, "p", "g")


@query("threshold_gates", "M99", """
with g as (select avg(l_discount) as a, count(distinct l_suppkey)::double as b, max(l_quantity) as c from lineitem)
select 'mean discount' as criterion, 0.04::double as threshold, round(a, 6) as observed, (a >= 0.04)::int::bigint as passed from g
union all select 'suppliers', 1000.0::double, b, (b >= 1000)::int::bigint from g union all select 'largest', 50.0::double, c, (c <= 50)::int::bigint from g""")
def _(t):
    return st.threshold_gates(t.lineitem, [("mean discount", F.avg("l_discount"), 0.04, "at_least"), ("suppliers", F.countDistinct("l_suppkey"), 1000, "at_least"), ("largest", F.max("l_quantity"), 50, "at_most")])


@query("chi_square", "M118", """
with c as (select l_returnflag, o_orderstatus, count(*) as n from lineitem join orders on o_orderkey = l_orderkey group by all),
e as (select n, (sum(n) over (partition by l_returnflag))::double * sum(n) over (partition by o_orderstatus) / sum(n) over () as e from c),
x as (select sum((n - e) ** 2 / e) as x, 4 as df from e)
select round(x, 6) as chi2, df::bigint as df, round(exp(-x / 2) * (1 + x / 2), 6) as p from x""")
def _(t):
    d = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_returnflag", "o_orderstatus")
    return st.chi_square(d, "l_returnflag", "o_orderstatus")


# For an even number of degrees of freedom the tail is a finite sum: two give exp(-x / 2), four exp(-x / 2) (1 + x / 2).
@query("chi_square_dependent", "M118", """
with c as (select l_returnflag as a, l_quantity > 25 or l_returnflag = 'R' as b, count(*) as n from lineitem group by all),
x as (select sum((n - e) ** 2 / e) as x from (select coalesce(n, 0) as n, (select sum(n) from c where a = p.a)::double * (select sum(n) from c where b = q.b) / (select sum(n) from c) as e
  from (select distinct a from c) p, (select distinct b from c) q left join c on c.a = p.a and c.b = q.b))
select round(x, 6) as chi2, 2::bigint as df, round(exp(-x / 2), 6) as p from x""")
def _(t):
    d = t.lineitem.select("l_returnflag", ((F.col("l_quantity") > 25) | (F.col("l_returnflag") == "R")).cast("string").alias("large"))
    return st.chi_square(d, "l_returnflag", "large")


@query("kruskal_wallis", "M119", """
with r as (select l_returnflag, l_discount, (2 * rank() over (order by l_discount) + count(*) over (partition by l_discount) - 1) / 2.0 as rk from lineitem),
g as (select count(*)::double as m, sum(rk) as r from r group by l_returnflag), t as (select sum(c::double*c*c - c) as t from (select count(*) as c from lineitem group by l_discount)),
n as (select count(*)::double as n from lineitem)
select (select n from n)::bigint as n, count(*) as "groups", round((12 / ((select n from n) * ((select n from n) + 1)) * sum(r*r/m) - 3 * ((select n from n) + 1)) / (1 - (select t from t) / ((select n from n)**3 - (select n from n))), 6) as h,
  count(*) - 1 as df from g""")
def _(t):
    return st.kruskal_wallis(t.lineitem, "l_discount", "l_returnflag")


@query("pairwise_contrasts", "M119", f"""
select contrast, round(z, 6) as z, round({p_sql('z')}, 6) as p, round(least(1, 3 * {p_sql('z')}), 6) as p_adjusted from (
  select * from {mw_sql('A', 'N')} union all select * from {mw_sql('A', 'R')} union all select * from {mw_sql('N', 'R')})""")
def _(t):
    return st.pairwise_mann_whitney(t.lineitem, "l_extendedprice", "l_returnflag", [("A", "N"), ("A", "R"), ("N", "R")])


@query("paired_t", "M120", """
with s as (select l_suppkey, avg(l_quantity) filter (l_returnflag = 'A') - avg(l_quantity) filter (l_returnflag = 'R') as d from lineitem group by 1)
select count(d) as n, round(avg(d), 6) as mean, round(avg(d) / sqrt(var_samp(d) / count(d)), 6) as t, count(d) - 1 as df from s""")
def _(t):
    d = t.lineitem.groupBy("l_suppkey").agg((F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))) - F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))).alias("d"))
    return st.paired_t(d, F.col("d"))


@query("welch_t", "M120", """
with g as (select l_linestatus, count(*) filter (l_returnflag = 'A') as na, avg(l_quantity) filter (l_returnflag = 'A') as ma, var_samp(l_quantity) filter (l_returnflag = 'A') as va,
  count(*) filter (l_returnflag = 'R') as nb, avg(l_quantity) filter (l_returnflag = 'R') as mb, var_samp(l_quantity) filter (l_returnflag = 'R') as vb from lineitem group by 1)
select l_linestatus, na as n_a, nb as n_b, round((ma - mb) / sqrt(va/na + vb/nb), 6) as t, round((va/na + vb/nb)**2 / ((va/na)**2/(na-1) + (vb/nb)**2/(nb-1)), 6) as df from g""")
def _(t):
    return st.welch_t(t.lineitem, F.col("l_quantity"), F.col("l_returnflag") == "A", F.col("l_returnflag") == "R", ["l_linestatus"])


@query("icc", "M121", """
with p as (select l_orderkey, count(*)::double as k, avg(l_quantity) as m, var_pop(l_quantity) as v from lineitem group by 1),
g as (select count(*)::double as n, sum(k) as t, sum(k*k) as k2, sum(k*m) as s, sum(k*m*m) as q, sum(k*v) as w from p),
m as (select n, (t - k2/t) / (n-1) as k0, (q - s*s/t) / (n-1) as b, w / (t-n) as w from g)
select n::bigint as targets, round(b, 6) as ms_between, round(w, 6) as ms_within, round((b-w) / (b + (k0-1)*w), 6) as icc from m""")
def _(t):
    return st.icc_1_1(t.lineitem, "l_orderkey", "l_quantity")




@query("pair_wins", "M122", """
select case when l_discount > l_tax then l_returnflag else o_orderstatus end as winner, case when l_discount > l_tax then o_orderstatus else l_returnflag end as loser, count(*) as wins
from lineitem join orders on o_orderkey = l_orderkey where l_returnflag <> o_orderstatus group by all""")
def _(t):
    return st.pair_wins(_contests(t), "winner", "loser")


def _contests(t):
    d = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    won = F.col("l_discount") > F.col("l_tax")
    return d.select(F.when(won, F.col("l_returnflag")).otherwise(F.col("o_orderstatus")).alias("winner"), F.when(won, F.col("o_orderstatus")).otherwise(F.col("l_returnflag")).alias("loser"))


@query("pair_precedence", "M122", """
with recursive w as (select case when l_discount > l_tax then l_returnflag else o_orderstatus end as a, case when l_discount > l_tax then o_orderstatus else l_returnflag end as b, count(*)::double as n
  from lineitem join orders on o_orderkey = l_orderkey where l_returnflag <> o_orderstatus group by all),
names as (select distinct a as name from w union select distinct b from w),
cells as (select x.name as a, y.name as b, coalesce(f.n, 0) as w, coalesce(f.n, 0) + coalesce(r.n, 0) as g from names x, names y left join w f on f.a = x.name and f.b = y.name left join w r on r.a = y.name and r.b = x.name),
tot as (select a, sum(w) as w from cells group by 1),
step(i, s) as (
  select 0, map_from_entries(list((name, 1.0::double))) from names
  union all
  select i + 1, (with n as (select tot.a, tot.w / (select sum(g / (s[tot.a] + s[c.b])) from cells c where c.a = tot.a) as v from tot)
     select map_from_entries(list((a, v / (select sum(v) from n)))) from n) from step where i < 30)
select unnest(map_keys(s)) as name, round(unnest(map_values(s)), 6) as strength from step where i = 30""")
def _(t):
    return st.bradley_terry(st.pair_wins(_contests(t), "winner", "loser"), rounds=30)
