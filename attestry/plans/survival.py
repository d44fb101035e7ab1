"""Survival queries: a user's event types per active day stand for the rules of a file's versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import survival as sv
from attestry.operators.agentlogs import segment_instructions
from attestry.plans.agentlogs import SEGMENT_SQL
from attestry.plans.catalogue import Tables, query
from attestry.plans.statistics import resampled_sql

PRESENCE_SQL = """days as (select user_id, day, row_number() over (partition by user_id order by day) as version from (select distinct user_id, date_trunc('day', ts)::date as day from events)),
pres as (select distinct e.user_id, e.event_type, d.version from events e join days d on d.user_id = e.user_id and d.day = date_trunc('day', e.ts)::date),
isl as (select *, version - row_number() over (partition by user_id, event_type order by version) as g from pres),
spells as (select user_id, event_type, min(version) as birth, max(version) as last, case when max(version) < (select max(version) from days d where d.user_id = isl.user_id) then max(version) + 1 end as death,
  max(version) - min(version) + 1 as age, case when max(version) < (select max(version) from days d where d.user_id = isl.user_id) then 'deleted' else 'censored' end as exit_kind from isl group by user_id, event_type, g)"""


def _presence(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()
    return e.join(sv.number_versions(e, "user_id", "day"), ["user_id", "day"]).select("user_id", "event_type", "version").distinct()


def _spells(t: Tables) -> DataFrame:
    return sv.build_spells(_presence(t), "user_id", "event_type")


@query("build_spells", "M48", f"with {PRESENCE_SQL} select * from spells")
def _(t):
    return _spells(t)


REWRITE_SQL = f"""{PRESENCE_SQL}, live as (select user_id, version + 1 as death, count(distinct event_type) as live from pres group by all),
dead as (select user_id, death, count(*) as dead from spells where death is not null group by all),
rw as (select user_id, death from dead join live using (user_id, death) where live >= 3 and dead >= 0.5 * live)"""


@query("rewrite_censor", "M49", f"""
with {REWRITE_SQL} select user_id, event_type, birth, last, death, age, case when (user_id, death) in (select user_id, death from rw) then 'rewrite' else exit_kind end as exit_kind from spells""")
def _(t):
    return sv.rewrite_censor(_spells(t), _presence(t), "user_id", "event_type", 0.5, 3)


@query("version_match", "M12")
def _(t):
    """Rules of each document against an edited version: commas dropped, some words changed, table lines removed."""
    split = lambda c: F.filter(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\n"), r"\n+"), lambda x: F.length(x) > 1)
    edited = F.regexp_replace(F.regexp_replace("text", " (from|avec|nicht|para|with) ", " "), r"\n[^\n]*\|[^\n]*", "\nA new line of text here.")
    rows = t.documents.select("doc_id", split(F.col("text")).alias("old"), split(edited).alias("new"))
    return sv.version_match(rows, ["doc_id"], "old", "new")


@query("migration_match", "M13", f"""
with {SEGMENT_SQL}, keyed as (select repo, file, regexp_replace(text, '[\\s*_`#>~|.,;:!?()\\[\\]-]+', '', 'g') as text, lang from (select source as repo, doc_id as file, lower(s.text) as text, lang from segments s join documents d using (doc_id) where class = 'instruction')),
k as (select distinct repo, file, text, lang from keyed)
select d.repo, d.file, d.text, exists (select 1 from k b where b.lang <> 'en' and b.repo = d.repo and b.text = d.text and b.file <> d.file)::int::bigint as migrated from k d where d.lang = 'en'""")
def _(t):
    seg = segment_instructions(t.documents, "doc_id", "text").filter("class = 'instruction'").select("doc_id", sv.rule_key(F.col("text")).alias("rule"))
    k = seg.join(t.documents.select("doc_id", "source", "lang"), "doc_id").select(F.col("source").alias("repo"), F.lit(1).alias("commit"), F.col("doc_id").alias("file"), F.col("rule").alias("text"), "lang").distinct()
    return sv.migration_match(k.filter("lang = 'en'"), k.filter("lang <> 'en'")).select("repo", "file", "text", "migrated")


PANEL_SQL = """panel as (select c_nationkey as file, (year(o_orderdate) * 12 + month(o_orderdate))::bigint as version, count(*) as size, sum(o_totalprice::decimal(18,2))::double as payload, count(*) filter (o_orderstatus = 'F') as done
  from orders join customer on c_custkey = o_custkey group by all)"""


def _panel(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    version = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("version")
    return d.groupBy(F.col("c_nationkey").alias("file"), version).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("payload"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("event_study", "M50", f"""
with {PANEL_SQL}, ev as (select file, min(version) as t0 from panel where done >= 5 group by 1),
n as (select p.file, p.version - t0 as offs, size from panel p join ev using (file) where abs(p.version - t0) <= 3),
b as (select file, max(size) filter (offs = -1) as base from n group by 1 having count(*) = 7)
select offs as "offset", count(*) as files, round(median(round(size / base, 9)), 6) as median from n join b using (file) where base > 0 group by 1""")
def _(t):
    return sv.event_study(_panel(t), "file", "version", "size", F.col("done") >= 5, 3)


@query("lifetime_growth", "M51", f"""
with {PANEL_SQL}, r as (select *, row_number() over w as rn, count(*) over (partition by file) as n, first_value(size) over w as s0, first_value(payload) over w as p0 from panel window w as (partition by file order by version))
select round((rn - 1) / (n - 1) * 10)::bigint as cell, count(*) as n, round(avg(size / s0), 6) as size, round(avg(payload / p0), 6) as payload from r where n > 1 group by 1""")
def _(t):
    return sv.lifetime_growth(_panel(t), "file", "version", ["size", "payload"])


NA_SQL = f"""{PRESENCE_SQL}, ex as (select age, count(*) as o, count(*) filter (exit_kind = 'deleted') as events from spells group by 1),
na as (select age, (sum(o) over (order by age desc))::bigint as at_risk, events, events / sum(o) over (order by age desc) as hazard from ex)"""


@query("nelson_aalen", "M89", f"with {NA_SQL} select age, at_risk, events, round(hazard, 6) as hazard, round(sum(hazard) over (order by age), 6) as cumulative from na")
def _(t):
    return sv.nelson_aalen(_spells(t), "age", F.col("exit_kind") == "deleted")


@query("smoothed_hazard", "M89", f"""
with {NA_SQL} select point::bigint as point, round(sum(0.75 * (1 - ((point - age) / 2.0::double) ** 2) * hazard / 2), 6) as rate, sum(events)::bigint as events
from na, range(0, 51) r(point) where abs(point - age) < 2 group by 1 having sum(events) >= 1""")
def _(t):
    return sv.smoothed_hazard(sv.nelson_aalen(_spells(t), "age", F.col("exit_kind") == "deleted"))


BAND_SQL = f"""{PRESENCE_SQL}, c as (select ':' || user_id % 5 as s, user_id, least(age, 52) as age, count(*) as o, count(*) filter (exit_kind = 'deleted' and age < 52) as events from spells group by all),
{resampled_sql("c", "user_id", 60, "h", "s")},
sums as (select draw, age, sum(weight * o) as o, sum(weight * events) as events from c join weights w on w.stratum = c.s and w.user_id = c.user_id group by all),
hz as (select draw, age, events, events / sum(o) over (partition by draw order by age desc) as hazard from sums),
rates as (select draw, point, sum(0.75 * (1 - ((point - age) / 2.0::double) ** 2) * hazard / 2) as rate from hz, range(0, 51) r(point) where age < 52 and abs(point - age) < 2 group by all having sum(events) >= 1)"""


def _rates(t: Tables) -> DataFrame:
    return sv.hazard_draws(_spells(t).withColumn("s", F.col("user_id") % 5), "age", F.col("exit_kind") == "deleted", "user_id", 60, "h", ["s"])


@query("hazard_bands", "M88,M89", f"with {BAND_SQL} select point::bigint as point, count(*) as draws, round(median(rate), 6) as median, round(quantile_cont(rate, 0.025), 6) as low, round(quantile_cont(rate, 0.975), 6) as high from rates group by 1")
def _(t):
    return sv.hazard_bands(_rates(t))


@query("hazard_slope", "M88,M89", f"""
with {BAND_SQL}, sl as (select draw, regr_slope(ln(rate), point) as slope from rates where rate > 0 group by 1)
select count(slope) as draws, round(median(slope), 6) as median, round(quantile_cont(slope, 0.025), 6) as low, round(quantile_cont(slope, 0.975), 6) as high from sl""")
def _(t):
    return sv.hazard_slope(_rates(t))


@query("risk_table", "M90", f"""
with {PRESENCE_SQL}, e as (select event_type, age, exit_kind, unnest(range(1, least(age, 50) + 1)) as interval from spells)
select event_type, interval, count(*) as person_time, count(*) filter (exit_kind = 'deleted' and interval = age) as events from e group by all""")
def _(t):
    return sv.risk_table(_spells(t), "age", F.col("exit_kind") == "deleted", ["event_type"])
