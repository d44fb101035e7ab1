"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import evaluation as ev
from attestry.plans.catalogue import query

FUNNEL = [
    ("all", "true"), ("included", "inc"), ("excluded", "inc and exc"), ("kept", "inc and not exc"),
    ("criterion:long", "n_chars > 3000"), ("criterion:english", "lang = 'en'"), ("criterion:table", "contains(text, '|')"),
    ("exclusion:toxic", "inc and coalesce(toxic, 0) = 1"), ("exclusion:poor", "inc and coalesce(quality, 1) = 0"), ("exclusion:tiny", "inc and n_chars < 50"),
    ("category:secret", "inc and not exc and contains(text, 'token')"), ("category:licence", "inc and not exc and contains(text, 'icense')"),
]


@query("literature_funnel", "M03", """
with d as (select d.*, toxic, quality, (n_chars > 3000 or lang = 'en' or contains(text, '|')) as inc, (coalesce(toxic, 0) = 1 or coalesce(quality, 1) = 0 or n_chars < 50) as exc
  from documents d left join labels using (doc_id))
""" + " union all ".join(f"select '{n}' as step, count(*) as n, min(n_chars) as low, max(n_chars) as high from d where {c}" for n, c in FUNNEL))
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    has = lambda w: F.col("text").contains(w)
    include = {"long": F.col("n_chars") > 3000, "english": F.col("lang") == "en", "table": has("|")}
    exclude = {"toxic": F.coalesce("toxic", F.lit(0)) == 1, "poor": F.coalesce("quality", F.lit(1)) == 0, "tiny": F.col("n_chars") < 50}
    return ev.literature_funnel(d, include, exclude, {"secret": has("token"), "licence": has("icense")}, F.col("n_chars"))


RULES = [
    ("correctness", "contains(text, 'token')", 40), ("correctness", "contains(text, '|')", 25), ("correctness", "contains(text, '%%%')", 30), ("correctness", "contains(text, '&&&')", 30),
    ("discoverability", "length(text) < 200", 30), ("discoverability", "length(text) > 5000", 20), ("discoverability", "not contains(text, '.')", 60),
    ("reliability", "contains(text, '@')", 35), ("reliability", "not contains(text, 'icense')", 10), ("reliability", "contains(text, 'idiot')", 70), ("reliability", "contains(text, 'stupid')", 70),
    ("efficiency", "length(text) > 10000", 55), ("efficiency", "length(text) > 2000", 15), ("efficiency", "not contains(text, chr(10))", 5),
]


def _dim(d: str) -> str:
    return "greatest(0, 100 - (" + " + ".join(f"case when {c} then {x} else 0 end" for dd, c, x in RULES if dd == d) + "))::double"


@query("static_score", "M04", f"""
with s as (select doc_id, {', '.join(f'{_dim(d)} as {d}' for d in ev.DIMENSIONS)} from documents)
select *, round({' + '.join(f'{d} * {w}' for d, w in ev.DIMENSIONS.items())}, 6) as score from s""")
def _(t):
    return ev.static_score(t.documents, "doc_id", [(d, F.expr(c), x) for d, c, x in RULES])


@query("pareto_front", "M14", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber::bigint as l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_discount from lineitem a
where not exists (select 1 from lineitem b where b.l_suppkey = a.l_suppkey and b.l_quantity > a.l_quantity and b.l_extendedprice <= a.l_extendedprice and b.l_discount <= a.l_discount
  and (b.l_extendedprice < a.l_extendedprice or b.l_discount < a.l_discount))""")
def _(t):
    f = ev.pareto_front(t.lineitem, "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    return f.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")


PAIR_SQL = """g as (select l_orderkey, avg(l_quantity) filter (l_returnflag = 'A') as with_value, avg(l_quantity) filter (l_returnflag = 'N') as base_value
  from lineitem where l_returnflag in ('A', 'N') group by 1)"""


@query("pair_conditions", "M16", f"""
with {PAIR_SQL} select l_orderkey, round(with_value, 6) as with_value, round(base_value, 6) as base_value,
  case when base_value is null then 'with only' when with_value is null then 'base only' else 'paired' end as status from g""")
def _(t):
    return ev.pair_conditions(t.lineitem, "l_orderkey", "l_returnflag", "A", "N", F.col("l_quantity"))


@query("common_support", "M17", """
with c as (select * from lineitem where l_discount > 0),
k as (select l_orderkey, l_linenumber from c group by all having count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem))
select l_orderkey, l_linenumber::bigint as l_linenumber, l_returnflag, l_partkey, l_suppkey from c semi join k using (l_orderkey, l_linenumber)""")
def _(t):
    return ev.common_support(t.lineitem, ["l_orderkey", "l_linenumber"], "l_returnflag", F.col("l_discount") > 0).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")


@query("effect_retention", "M31", """
with g as (select l_linestatus, l_suppkey, avg(l_discount) filter (l_returnflag = 'A') as base, avg(l_discount) filter (l_returnflag = 'N') as compressed, avg(l_discount) filter (l_returnflag = 'R') as upper from lineitem group by 1, 2)
select l_linestatus, l_suppkey, round(base, 6) as base, round(compressed, 6) as compressed, round(upper, 6) as upper, round((compressed - base) / nullif(upper - base, 0), 6) as retention from g""")
def _(t):
    return ev.effect_retention(t.lineitem, ["l_linestatus", "l_suppkey"], "l_returnflag", "A", "N", "R", F.col("l_discount"))


@query("rate_decomposition", "M32", """
with g as (select l_suppkey, avg((l_discount > 0.05 and l_tax > 0.04)::int) filter (l_returnflag <> 'N') as overall, avg((l_discount > 0.05)::int) filter (l_returnflag <> 'N') as ic,
  avg((l_tax > 0.04)::int) filter (l_returnflag <> 'N' and l_discount > 0.05) as cond, avg((l_discount > 0.05 and l_tax > 0.04)::int) filter (l_returnflag = 'N') as control from lineitem group by 1)
select l_suppkey, round(overall, 6) as overall, round(ic, 6) as in_context_rate, round(cond, 6) as conditional_rate, round(control, 6) as control, round(overall - control, 6) as lift from g""")
def _(t):
    return ev.rate_decomposition(t.lineitem, "l_suppkey", F.col("l_returnflag") != "N", F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)


@query("paired_lift", "M33", """
with p as (select l_orderkey, avg(l_discount) filter (l_returnflag = 'A') as da, avg(l_discount) filter (l_returnflag = 'N') as dn, avg(l_tax) filter (l_returnflag = 'A') as ta, avg(l_tax) filter (l_returnflag = 'N') as tn
  from lineitem where l_returnflag in ('A', 'N') group by 1),
d as (select coalesce(da, 0) - coalesce(dn, 0) as a, coalesce(ta, 0) - coalesce(tn, 0) as b from p),
l as (select 'discount' as metric, round(a, 9) as delta from d union all select 'tax', round(b, 9) from d union all select 'composite', round((a + b) / 2, 9) from d union all select 'outcome', round(b, 9) from d)
select metric, count(*) as n, round(avg(delta), 6) as mean, count(*) filter (delta > 0) as positive, count(*) filter (delta = 0) as zero, count(*) filter (delta < 0) as negative, round(median(delta), 6) as median from l group by 1""")
def _(t):
    two = t.lineitem.filter("l_returnflag in ('A', 'N')").groupBy("l_orderkey").agg(*[F.avg(F.when(F.col("l_returnflag") == f, F.col(c))).alias(n + f) for n, c in (("d", "l_discount"), ("t", "l_tax")) for f in ("A", "N")])
    return ev.paired_lift(two, {"discount": (F.col("dA"), F.col("dN")), "tax": (F.col("tA"), F.col("tN"))}, outcomes=["tax"])


@query("verdict_accuracy", "M34", """
with b as (select l_returnflag || l_linestatus as agent, l_suppkey as item, l_linenumber as rule, (l_discount >= 0.05)::int::double as z, l_linenumber % 2 = 1 as against from lineitem),
d as (select item, rule, min(z) < max(z) as differs from b group by all), acc as (select agent, avg(z) as acc from b group by 1),
r as (select agent, rule, avg(z) as rate from b group by all),
w as (select rule, case when isnan(coalesce(corr(rate, acc), 0)) then 0 else greatest(0, coalesce(corr(rate, acc), 0)) end as w from r join acc using (agent) group by 1),
g as (select agent, avg(z) as acc, avg(z) filter (differs) as f, sum(w * z) / nullif(sum(w), 0) as dw, avg(z) filter (against) as ap from b join d using (item, rule) join w using (rule) group by 1)
select agent, round(acc, 6) as acc, round(f, 6) as f_acc, round(dw, 6) as dw_acc, round(ap, 6) as ap_acc, round(acc - ap, 6) as gap from g""")
def _(t):
    panel = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("agent"), F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("rule"), (F.col("l_discount") >= 0.05).cast("int").alias("z"))
    return ev.verdict_accuracy(panel, "agent", "item", "rule", "z", F.col("rule") % 2 == 1)


@query("majority_vote", "M35", """
with v as (select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'must' when 'N' then 'should' else 'may' end as severity,
  unnest([(l_discount > 0.05)::int, (l_tax > 0.04)::int, (l_quantity > 25)::int]) as vote from lineitem),
m as (select l_orderkey, l_linenumber, severity, 2 * sum(vote) > count(*) as ok from v group by 1, 2, 3)
select l_orderkey, l_linenumber::bigint as l_linenumber, severity, ok::int::bigint as passed, case severity when 'must' then 3 when 'should' then 2 else 1 end::bigint as possible,
  case when ok then case severity when 'must' then 3 when 'should' then 2 else 1 end else 0 end::bigint as earned from m""")
def _(t):
    sev = F.when(F.col("l_returnflag") == "A", "must").when(F.col("l_returnflag") == "N", "should").otherwise("may")
    votes = F.array((F.col("l_discount") > 0.05).cast("int"), (F.col("l_tax") > 0.04).cast("int"), (F.col("l_quantity") > 25).cast("int"))
    return ev.majority_vote(t.lineitem.select("l_orderkey", "l_linenumber", sev.alias("severity"), F.explode(votes).alias("vote")), ["l_orderkey", "l_linenumber"], "vote", "severity")


@query("judge_alignment", "M36", """
with g as (select source, avg((toxic = 1)::int) filter (quality = 0) as sp, avg((toxic = 0)::int) filter (quality = 1) as rc, avg((toxic = 1 and lang = 'en')::int) filter (quality = 0) as ra from labels join documents using (doc_id) group by 1)
select source, round(sp, 6) as specificity, round(rc, 6) as recall, round(ra, 6) as reason_agreement, round(3 * sp + rc + ra, 6) as score from g""")
def _(t):
    d = t.labels.join(t.documents, "doc_id")
    return ev.judge_alignment(d, F.col("toxic") == 0, F.col("quality") == 1, F.col("lang") == "en", ["source"])


@query("drift_band", "M37", """
with j as (select l_linestatus || case when l_shipdate >= timestamp '2000-01-01' then '/new' else '/all' end as metric, avg(l_discount) as judge from lineitem where l_returnflag = 'A' group by 1),
r as (select l_linestatus || case when l_shipdate >= timestamp '2000-01-01' then '/new' else '/all' end as metric, l_suppkey, avg(l_discount) as v from lineitem where l_returnflag <> 'A' group by all),
b as (select metric, avg(v) as mean, stddev_samp(v) as sd from r group by 1)
select metric, round(judge, 6) as judge, round(mean, 6) as mean, round(sd, 6) as sd, (judge < mean - 2 * sd)::int::bigint as alert from j join b using (metric)""")
def _(t):
    m = F.concat("l_linestatus", F.when(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"), "/new").otherwise("/all")).alias("metric")
    judge = t.lineitem.filter("l_returnflag = 'A'").groupBy(m).agg(F.avg("l_discount").alias("v"))
    raters = t.lineitem.filter("l_returnflag <> 'A'").groupBy(m, "l_suppkey").agg(F.avg("l_discount").alias("v"))
    return ev.drift_band(judge, raters, "metric", "v")


@query("set_prf", "M38", """
with f as (select l_orderkey, l_suppkey, max((l_returnflag = 'A')::int) as p, max((l_linestatus = 'F')::int) as g from lineitem group by all),
r as (select l_orderkey, sum(p) as p, sum(g) as g, sum(p * g) as hit from f group by 1 having sum(g) > 0),
m as (select count(*) as records, avg(case when p > 0 then hit / p else 0 end) as precision, avg(hit / g) as recall from r)
select records, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall), 6) as f1 from m""")
def _(t):
    return ev.set_prf(t.lineitem, "l_orderkey", "l_suppkey", F.col("l_returnflag") == "A", F.col("l_linestatus") == "F")


@query("stage_forgetting", "M39", """
with s as (select l_suppkey, l_linenumber, avg(l_quantity) as v from lineitem group by all),
p as (select l_suppkey, arg_max(v, l_linenumber) as final, max(v) as best, min(l_linenumber) as entered from s group by 1)
select count(*) as tasks, round(avg(final), 6) as average, round(avg(best - final) filter (entered < (select max(l_linenumber) from s)), 6) as forgetting from p""")
def _(t):
    s = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("v"))
    return ev.stage_forgetting(s, "l_suppkey", "l_linenumber", "v")


@query("run_variance", "M41", """
with p as (select l_suppkey, l_linenumber, avg((l_discount > 0.05)::int) as r from lineitem group by all)
select l_suppkey, count(*) as repeats, round(avg(r), 6) as mean, round(stddev_samp(r), 6) as std, round(max(r) - min(r), 6) as gap from p group by 1""")
def _(t):
    return ev.run_variance(t.lineitem, "l_suppkey", "l_linenumber", F.col("l_discount") > 0.05)


@query("moving_rate", "M52", """
select event_type, event_id, round(avg((value > 50)::int) over (partition by event_type order by ts, event_id rows between 29 preceding and current row), 6) as moving from events""")
def _(t):
    e = t.events.select("event_type", "event_id", "ts", (F.col("value") > 50).cast("long").alias("hit"))
    return ev.moving_rate(e, ["event_type"], ["ts", "event_id"], "hit", 30).select("event_type", "event_id", "moving")


@query("quantile_strata", "M53", """
with s as (select *, ntile(4) over (order by o_totalprice, o_orderkey) as stratum from orders)
select stratum, count(*) as n, round(avg((o_orderstatus = 'F')::int), 6) as rate, round(min(o_totalprice), 6) as low, round(max(o_totalprice), 6) as high from s group by 1""")
def _(t):
    s = ev.quantile_strata(t.orders, ["o_totalprice", "o_orderkey"], 4)
    return s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("iso_ratio_holdout", "M61", """
with m as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice::decimal(18,2)::varchar as price, round(ln(l_extendedprice / l_quantity))::bigint as slice, round(6 * l_quantity * l_extendedprice, 6) as compute from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber::bigint as l_linenumber, price, slice, compute, (row_number() over (partition by slice order by compute desc, l_orderkey, l_partkey, l_suppkey, l_linenumber, price) <= 8)::int::bigint as held_out from m""")
def _(t):
    m = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"), "l_quantity", "l_extendedprice")
    ratio = F.round(F.ln(F.col("l_extendedprice") / F.col("l_quantity"))).cast("long")
    out = ev.iso_ratio_holdout(m, ratio, F.round(6 * F.col("l_quantity") * F.col("l_extendedprice"), 6), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price"], 8)
    return out.drop("l_quantity", "l_extendedprice")


@query("grid_folds", "M62", """
with q as (select quantile_cont(p_size::double, 0.25) as n1, quantile_cont(p_size::double, 0.8) as n2, quantile_cont(p_retailprice, 0.25) as d1, quantile_cont(p_retailprice, 0.8) as d2 from part),
r as (select part.*, q.*, case when p_size > n2 and p_retailprice > d2 then 'far' when p_size > n2 then 'extrapolation_n' when p_retailprice > d2 then 'extrapolation_d' else 'interpolation' end as regime from part, q)
select p_partkey, regime, (regime = 'interpolation' and substr(sha256('grid:' || p_partkey), 1, 2) < 'cc')::int::bigint as train_random,
  (regime = 'interpolation' and (p_size <= n1 or p_retailprice <= d1))::int::bigint as train_l_shape, (regime = 'interpolation' and p_retailprice <= d1)::int::bigint as train_band from r""")
def _(t):
    return ev.grid_folds(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"], "p_size", "p_retailprice", "grid").drop("p_size", "p_retailprice")


@query("length_batches", "M63", "select doc_id, floor((sum(n_chars) over (order by n_chars, doc_id) - n_chars) / 50000)::bigint as batch from documents")
def _(t):
    return ev.length_batches(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 50000).select("doc_id", "batch")


@query("stratified_sample", "M66", """
select doc_id, quality::bigint as quality, lang from labels join documents using (doc_id)
qualify row_number() over (partition by quality, lang order by (source in ('src1', 'src2', 'src3'))::int desc, sha256('week1:' || doc_id)) <= 12""")
def _(t):
    d = t.labels.join(t.documents, "doc_id").select("doc_id", "quality", "lang", "source")
    return ev.stratified_sample(d, ["quality", "lang"], "doc_id", 12, "week1", F.col("source").isin("src1", "src2", "src3")).drop("source")


@query("cumulative_pass", "M67", """
with p as (select l_orderkey, min(l_linenumber) filter (l_returnflag = 'R' and l_discount > 0.03) as k from lineitem group by 1),
c as (select k, count(*) as c from p where k is not null group by 1)
select k::bigint as k, round(sum(c) over (order by k) / (select count(*) from p), 6) as pass_rate from c""")
def _(t):
    return ev.cumulative_pass(t.lineitem, "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.03))


@query("claim_vs_log", "M79", """
with o as (select o_orderkey, case when o_orderpriority = '1-URGENT' then floor(o_totalprice / 2) else floor(o_totalprice) end as price, o_custkey + 100000 as cust, o_orderstatus, o_totalprice from orders),
c as (select o_orderkey, 0 as place, price as claimed from o union all select o_orderkey, 1, cust from o where cust <> price union all select o_orderkey, case when cust = price then 1 else 2 end, 0.25 from o),
log as (select o_orderkey, o_totalprice as v from o where o_orderstatus <> 'P' union all select o_orderkey, cust + 1 from o where o_orderstatus <> 'F' union all select o_orderkey, 0.25 from o),
n as (select c.o_orderkey, place, claimed, arg_min(v, row(abs(claimed - v), v)) as logged from c left join log on log.o_orderkey = c.o_orderkey group by all)
select o_orderkey, place::bigint as place, round(claimed, 6) as claimed, round(logged, 6) as logged, (not coalesce(abs(claimed - logged) <= 0.5, false))::int::bigint as flagged,
  round(case when coalesce(abs(claimed - logged) <= 0.5, false) then claimed else coalesce(logged, claimed) end, 6) as shown from n""")
def _(t):
    """Three numbers per text; the log holds up to three values per order."""
    said = F.when(F.col("o_orderpriority") == "1-URGENT", F.floor(F.col("o_totalprice") / 2)).otherwise(F.floor("o_totalprice"))
    number = (F.col("o_custkey") + 100_000).cast("string")
    text = F.concat(F.lit("We spent "), said.cast("decimal(18,2)").cast("string"), F.lit(" on account "), number, F.lit(", a share of 25% of all."))
    claims = ev.claims_of(t.orders, ["o_orderkey"], text)
    price = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_totalprice").cast("double").alias("value"))
    account = t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", (F.col("o_custkey") + 100_001).cast("double").alias("value"))
    share = t.orders.select("o_orderkey", F.lit(0.25).alias("value"))
    return ev.claim_vs_log(claims, price.union(account).union(share), ["o_orderkey"], 0.5, ["place"])


@query("failure_classes", "M106", """
with g as (select l_suppkey, l_returnflag, count(*) filter (l_discount < 0.03) as failures, avg((l_discount < 0.03)::int) as fr from lineitem group by all)
select l_suppkey, l_returnflag, failures, round(fr, 6) as fail_rate, round(failures / nullif(sum(failures) over (partition by l_suppkey), 0), 6) as share from g""")
def _(t):
    return ev.failure_classes(t.lineitem, "l_suppkey", "l_returnflag", F.col("l_discount") < 0.03)


THEMES = {"insult": ["idiot", "clown", "loser", "stupid"], "secret": ["token", "password"], "licence": ["license", "copyright"], "table": [" | "]}


@query("theme_prevalence", "M108", " union all ".join(
    f"select lang, '{n}' as theme, round(avg(({' or '.join(f'contains(lower(text), {w!r})' for w in ws)})::int), 6) as share from documents group by 1" for n, ws in THEMES.items()))
def _(t):
    return ev.theme_prevalence(t.documents, "text", "lang", THEMES)


@query("activity_totals", "M109", """
select o_orderpriority, grouping(o_orderpriority)::bigint as overall, count(*) as n, count(distinct o_custkey) as agents, round(avg(o_totalprice), 6) as mean from orders group by rollup(o_orderpriority)""")
def _(t):
    return ev.activity_totals(t.orders, "o_orderpriority", F.col("o_totalprice"), "o_custkey")


@query("default_strategy", "M109", """
with c as (select o_orderpriority, o_orderstatus, count(*) as c from orders group by all), t as (select o_orderpriority, max(c) / sum(c) as s from c group by 1),
l as (select *, lag(o_orderstatus) over (partition by o_orderpriority, o_custkey order by o_orderdate, o_orderkey) as p from orders),
a as (select o_orderpriority, o_custkey, sum((p is not null and p <> o_orderstatus)::int) as c from l group by all)
select o_orderpriority, round(s, 6) as default_share, round((select avg(c) from a where a.o_orderpriority = t.o_orderpriority), 6) as changes_per_agent from t""")
def _(t):
    return ev.default_strategy(t.orders.select("o_orderpriority", "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), "o_orderpriority", "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("token_reduction", "M111", """
with g as (select l_linestatus, l_returnflag, avg(l_discount) as score, avg(l_quantity) as tokens from lineitem group by all)
select l_linestatus, l_returnflag, round(score, 6) as score, round(tokens, 6) as tokens, round((select tokens from g b where b.l_linestatus = g.l_linestatus and b.l_returnflag = 'N') / tokens, 6) as factor from g""")
def _(t):
    return ev.token_reduction(t.lineitem, ["l_linestatus"], "l_returnflag", "N", F.col("l_discount"), F.col("l_quantity"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("pass_at_k", "M112", """
with f as (select l_orderkey, (l_discount > 0.05)::int as p from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= 3),
g as (select l_orderkey, max(p) as a, min(p) as e from f group by 1 having count(*) = 3)
select count(*) as tasks, round(avg(a), 6) as pass_at_k, round(avg(e), 6) as pass_all_k from g""")
def _(t):
    return ev.pass_at_k(t.lineitem, "l_orderkey", LINE_ORDER, F.col("l_discount") > 0.05, 3)


@query("trace_sample", "M114", """
with m as (select l_suppkey, l_orderkey, l_partkey, l_linenumber, l_discount < 0.04 as f from lineitem),
r as (select *, row_number() over (partition by l_suppkey, f order by sha256('trace:' || l_orderkey || ':' || l_partkey || ':' || l_linenumber), l_orderkey, l_partkey, l_linenumber) as rn from m)
select l_suppkey, l_orderkey, l_partkey, l_linenumber::bigint as l_linenumber, f::int::bigint as failed from r where rn <= case when f then 15 else 5 end""")
def _(t):
    d = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    return ev.trace_sample(d, "l_suppkey", ["l_orderkey", "l_partkey", "l_linenumber"], F.col("l_discount") < 0.04, 20, "trace").drop("l_discount")


@query("best_of_k", "M115", """
with f as (select l_linestatus, l_orderkey, l_discount from lineitem qualify row_number() over (partition by l_linestatus, l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= 2),
p as (select l_linestatus, l_orderkey, max(l_discount) as b from f group by all)
select l_linestatus, count(*) as problems, round(avg(b), 6) as best_of_k from p group by 1""")
def _(t):
    return ev.best_of_k(t.lineitem, "l_linestatus", ["l_orderkey"], LINE_ORDER, "l_discount", 2)


@query("ndcg", "M116", """
with a as (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rn from lineitem),
b as (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by l_quantity desc) as rn from lineitem),
d as (select l_suppkey, sum(l_quantity / log2(rn + 1)) as d from a where rn <= 10 group by 1), i as (select l_suppkey, sum(l_quantity / log2(rn + 1)) as i from b where rn <= 10 group by 1)
select l_suppkey, round(d / i, 6) as ndcg from d join i using (l_suppkey)""")
def _(t):
    return ev.ndcg(t.lineitem, "l_suppkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], "l_quantity", 10)


@query("archive_best", "M123", """
with s as (select l_suppkey, l_linenumber, avg(l_discount) as v from lineitem group by all), c as (select l_suppkey, avg(v) as m from s group by 1)
select round((select avg(b) from (select max(v) as b from s group by l_linenumber)), 6) as archive, round((select max(m) from c), 6) as single_chain, (select arg_max(l_suppkey, m) from c) as chain""")
def _(t):
    s = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("v"))
    return ev.archive_best(s, "l_suppkey", "l_linenumber", "v")


