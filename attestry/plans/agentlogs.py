"""Agent-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import agentlogs as al
from attestry.operators.ordering import as_number, exact_quantiles
from attestry.plans.catalogue import Tables, query
from attestry.plans.text import q, sentence_sql, squash_sql

K_SQL = "json_extract(props, '$.k')::bigint"


def _events(t: Tables) -> DataFrame:
    e = t.events
    return e.select("event_id", "user_id", "event_type", "value", as_number(e, "ts").cast("long").alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"), "ts")


SIG = "(1 / (1 + exp(-({x}))))"


@query("utility_reward", "M05", f"""
with z as (select o_orderkey, o_totalprice / (select max(o_totalprice) from orders) as z, case o_orderpriority when '1-URGENT' then 0.2 when '2-HIGH' then 0.4 else 0.6 end::double as m from orders)
select o_orderkey, round(({SIG.format(x='(z-m)/0.2')} - {SIG.format(x='-m/0.2')}) / ({SIG.format(x='(1-m)/0.2')} - {SIG.format(x='-m/0.2')}), 6) as reward from z""")
def _(t):
    top = t.orders.agg(F.max("o_totalprice")).scalar()
    m = F.when(F.col("o_orderpriority") == "1-URGENT", 0.2).when(F.col("o_orderpriority") == "2-HIGH", 0.4).otherwise(0.6)
    return t.orders.select("o_orderkey", al.utility_reward(F.col("o_totalprice") / top, m).alias("reward"))


@query("corridor_share", "M06", """
select l_orderkey, l_partkey, l_suppkey, round(least(1, greatest(0, (l_extendedprice / l_quantity - p_retailprice) / (2 * p_retailprice))), 6) as seller,
  round(least(1, greatest(0, (3 * p_retailprice - l_extendedprice / l_quantity) / (2 * p_retailprice))), 6) as buyer from lineitem join part on p_partkey = l_partkey""")
def _(t):
    price, low = F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice")
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return d.select("l_orderkey", "l_partkey", "l_suppkey", al.corridor_share(price, low, low * 3).alias("seller"), al.corridor_share(price, low, low * 3, "buyer").alias("buyer"))


@query("truncated_weight", "M07", "select l_orderkey, l_partkey, l_suppkey, round(least(exp(l_discount * 20 - l_tax * 10), 2.0), 6) as weight from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", al.truncated_weight(F.col("l_discount") * 20, F.col("l_tax") * 10, 2.0).alias("weight"))


SEGMENT_SQL = f"""
lines as (select doc_id, unnest(string_split(regexp_replace(text, {q(al.FENCE)}, chr(10) || chr(1) || 'code' || chr(10), 'g'), chr(10))) as l,
  generate_subscripts(string_split(regexp_replace(text, {q(al.FENCE)}, chr(10) || chr(1) || 'code' || chr(10), 'g'), chr(10)), 1) - 1 as line from documents),
marked as (select *, regexp_matches(l, '^\\s*#|^\\s*\\||\x01code') or contains(l, ' | ') or regexp_matches(l, '^\\s*\\*\\*[^*]+\\*\\*:?\\s*$') as p from lines where trim(l) <> ''),
split as (select doc_id, line, p, case when p then [l] else string_split(regexp_replace(regexp_replace(l, {q(al.LIST_ITEM)}, '', 'g'), '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)) end as parts from marked),
seg as (select doc_id, line, p, trim(unnest(parts)) as text, generate_subscripts(parts, 1) - 1 as part from split),
segments as (select doc_id, line::bigint as line, part::bigint as part, text, case when p or not regexp_matches(text, '\\S\\s+\\S') then 'payload' else 'instruction' end as class from seg where text <> '')"""


@query("segment_instructions", "M08", f"with {SEGMENT_SQL} select * from segments")
def _(t):
    return al.segment_instructions(t.documents, "doc_id", "text")


# Families that fit the invented words of the test texts (fixed values).
FAMILIES = [("constraint", "(?i)ment|keit"), ("procedural", "(?i)^(the|le|die)"), ("episodic", "(?i)tion,"), ("preference", "(?i)ing|ung")]
KIND_SQL = "case " + " ".join(f"when regexp_matches(text, {q(p)}) then '{n}'" for n, p in FAMILIES) + " else 'belief' end"


@query("type_items", "M09", f"select conv_id as kb, turn as item, {KIND_SQL} as kind from conversations")
def _(t):
    return al.typed_items(t.conversations, FAMILIES).select("kb", "item", "kind")


@query("authority_risk", "M10", """
select conv_id, turn, round(least(1, length(text) / 500.0::double) * case role when 'system' then 1.5 else 1.0 end, 6) as risk from conversations""")
def _(t):
    p = F.least(F.lit(1.0), F.length("text") / F.lit(500.0))
    return t.conversations.select("conv_id", "turn", al.authority_risk(p, F.col("role")).alias("risk"))


INJECT_SQL = """with u as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n,
  row_number() over (partition by conv_id order by sha256('m:' || conv_id || ':' || turn)) as h from conversations where role = 'user')
select c.conv_id, c.turn, c.role, sha256(c.text || case when {cond} then ' [KEEP]' else '' end) as body, coalesce({cond}, false)::int::bigint as injected
from conversations c left join u using (conv_id, turn)"""
for _where, _cond in (("top", "i = 0"), ("middle", "i = (n - 1) // 2"), ("bottom", "i = n - 1"), ("multi", "h <= 2")):

    @query(f"inject_marker_{_where}", "M11", INJECT_SQL.format(cond=_cond))
    def _(t, where=_where):
        out = al.inject_marker(t.conversations, "conv_id", "turn", "text", " [KEEP]", where)
        return out.select("conv_id", "turn", "role", F.sha2("text", 256).alias("body"), "injected")


@query("reuse_share", "M26", f"""
with p as (select event_type || {K_SQL} as k, count(*) as n, count(distinct user_id) as s from events group by 1)
select count(*) as keys, sum(n)::bigint as calls, round(avg((s > 1)::int), 6) as recurring_keys, round(sum(n) filter (s > 1) / sum(n), 6) as recurring_calls from p""")
def _(t):
    return al.reuse_share(_events(t).withColumn("key", F.concat("event_type", "k")), "key", "user_id")


@query("latency_breakdown", "M27", """
with g as (select user_id, event_type, sum(value::decimal(18,2))::double as total, count(*) as n from events group by all)
select user_id, event_type, round(total, 6) as total, n, round(total / sum(total) over (partition by user_id), 6) as share from g""")
def _(t):
    e = t.events.withColumn("v", F.col("value").cast("decimal(18,2)"))
    return al.latency_breakdown(e, "user_id", "event_type", "v")


@query("latency_tail", "M27", """
select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean from events group by 1""")
def _(t):
    return al.latency_tail(t.events.select("event_type", "value"), "event_type", "value")


@query("compaction_ratio", "M28", f"""
with r as (select role, length({sentence_sql('text')}) / length(text) as r from conversations)
select role, count(*) as events, round(avg(r), 6) as ratio, round(avg((r < 0.3)::int), 6) as strong from r group by 1""")
def _(t):
    from attestry.functions.text import short_description

    return al.compaction_ratio(t.conversations, "role", F.length("text"), F.length(short_description(F.col("text"))), 0.7)


@query("context_mix", "M29", """
with c as (select conv_id, turn, sum(case when role = 'system' then length(text) else 0 end) over w as s, sum(case when role = 'user' then length(text) else 0 end) over w as u,
  sum(case when role = 'assistant' then length(text) else 0 end) over w as a from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, round(s / nullif(s+u+a, 0), 6) as system, round(u / nullif(s+u+a, 0), 6) as user, round(a / nullif(s+u+a, 0), 6) as assistant from c""")
def _(t):
    return al.context_mix(t.conversations, "conv_id", "turn", "role", F.length("text"), ["system", "user", "assistant"])


@query("preservation_rate", "M30", f"""
with b as (select conv_id, turn, text, {KIND_SQL} as kind from conversations)
select kind, count(*) as items, count(*) filter (length(text) < 400) as kept, round(avg((length(text) < 400)::int), 6) as rate from b group by 1""")
def _(t):
    before = al.typed_items(t.conversations, FAMILIES)
    return al.preservation_rate(before, before.filter(F.length("text") < 400), ["kb", "item"], "kind")


LOCALITY_SQL = f"""items as (select conv_id as kb, turn as item, role as topic, turn // 3 as chunk, length(text) as len, {KIND_SQL} as kind from conversations),
rules as (select distinct kb, item, case when topic <> 'system' then topic end as scope from items where kind = 'constraint'),
placed as ({{placed}}),
need as (select distinct kb, chunk, r.item as rule from (select distinct kb, chunk, topic from placed) p join rules r using (kb) where r.scope is null or r.scope = p.topic),
lacks as (select kb, count(*) as needed, count(*) filter (not exists (select 1 from placed p where p.kb = need.kb and p.chunk = need.chunk and p.item = need.rule)) as violations from need group by kb),
cost as (select kb, sum(len)::double / sum(len) filter (first) - 1 as overhead from (select *, row_number() over (partition by kb, item order by chunk) = 1 as first from (select distinct kb, chunk, item, len from placed)) group by kb),
per as (select kb, coalesce(violations / needed, 0) as violation, coalesce(violations, 0) as n, coalesce(overhead, 0) as overhead from cost left join lacks using (kb))
select count(*) as configs, round(avg(violation), 6) as violation, round(avg((n > 0)::int), 6) as violated, round(avg(overhead), 6) as overhead,
  round(quantile_cont(round(overhead, 9), 0.5), 6) as median, round(quantile_cont(round(overhead, 9), 0.9), 6) as p90, round(max(overhead), 6) as worst from per"""
PLACED_SQL = {
    "chunked": "select kb, chunk, topic, item, len from items",
    "replicated": "select kb, chunk, topic, item, len from items union select i.kb, i.chunk, i.topic, r.item, x.len from (select distinct kb, chunk, topic from items) i join rules r on r.kb = i.kb and (r.scope is null or r.scope = i.topic) join items x on x.kb = r.kb and x.item = r.item",
}
for _how, _placed in PLACED_SQL.items():

    @query(f"locality_{_how}", "M30", f"with {LOCALITY_SQL.format(placed=_placed)}")
    def _(t, how=_how):
        """Turns in chunks of three, with constraints as they fall or copied to every chunk that their scope meets."""
        items = al.typed_items(t.conversations, FAMILIES).select("kb", "item", F.col("role").alias("topic"), F.floor(F.col("item") / 3).alias("chunk"), F.length("text").cast("long").alias("len"), "kind")
        rules = items.filter("kind = 'constraint'").select("kb", "item", F.when(F.col("topic") != "system", F.col("topic")).alias("scope"), "len")
        placed = items.select("kb", "chunk", "topic", "item", "len")
        if how == "replicated":
            cells = placed.select("kb", "chunk", "topic").distinct()
            near = cells.join(rules.filter("scope is not null").select("kb", F.col("scope").alias("topic"), "item", "len"), ["kb", "topic"]).select(placed.columns)
            far = cells.join(rules.filter("scope is null").select("kb", "item", "len"), "kb").select(placed.columns)
            placed = placed.union(near).union(far).distinct()
        return al.locality_summary(al.locality(placed, rules, "kb", "chunk", "topic", "item", "len"))


STATE_SQL = "s as (select c_mktsegment, o_custkey, o_orderstatus, o_orderdate, o_orderkey from orders join customer on c_custkey = o_custkey)"


def _states(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("c_mktsegment", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")


@query("initial_convergence", "M40", f"""
with {STATE_SQL}, f as (select c_mktsegment, o_custkey, arg_min(o_orderstatus, row(o_orderdate, o_orderkey)) as s from s group by all), c as (select c_mktsegment, s, count(*) as c from f group by all)
select c_mktsegment, sum(c)::bigint as agents, round(max(c) / sum(c), 6) as convergence from c group by 1""")
def _(t):
    return al.initial_convergence(_states(t), "c_mktsegment", "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("strategy_persistence", "M40", f"""
with {STATE_SQL}, l as (select *, lag(o_orderstatus) over (partition by c_mktsegment, o_custkey order by o_orderdate, o_orderkey) as p from s)
select c_mktsegment, count(*) as pairs, round(avg((p <> o_orderstatus)::int), 6) as change, round(1 - avg((p <> o_orderstatus)::int), 6) as persist from l where p is not null group by 1""")
def _(t):
    return al.strategy_persistence(_states(t), "c_mktsegment", "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("loss_normalisations", "M42", """
with s as (select l_orderkey, l_linenumber, sum(l_quantity) as l, sum(l_discount * l_quantity) as s from lineitem group by all),
r as (select l_orderkey, sum(l) as l, sum(s) as s, count(*) as n, sum(s / l) as m from s group by 1)
select count(*) as rollouts, round(sum(s) / sum(l), 6) as token_mean, round(sum(m) / sum(n), 6) as sequence_mean, round(avg(s / l), 6) as rollout_mean from r""")
def _(t):
    return al.loss_normalisations(t.lineitem, "l_orderkey", ["l_linenumber"], F.col("l_quantity"), F.col("l_discount") * F.col("l_quantity"))


ADV_SQL = """with r as (select o_custkey, o_orderkey, o_totalprice / 1000 as r, count(l_orderkey) as n from orders join lineitem on l_orderkey = o_orderkey group by all),
m as (select o_custkey, sum({w} * r) / sum({w}) as m from r group by 1), s as (select o_custkey, m, sqrt(sum({w} * (r - m) ** 2) / sum({w})) as sd from r join m using (o_custkey) group by all)
select o_custkey, o_orderkey, round((r - m) / (sd + 1e-6), 6) as advantage from r join s using (o_custkey)"""


def _rewards(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(n, "o_orderkey").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("r"), "n")


@query("group_advantage_rollout", "M43", ADV_SQL.format(w="1"))
def _(t):
    return al.group_advantage(_rewards(t), "o_custkey", "o_orderkey", "r")


@query("group_advantage_sample", "M43", ADV_SQL.format(w="n"))
def _(t):
    return al.group_advantage(_rewards(t), "o_custkey", "o_orderkey", "r", "n")


@query("b_min", "M44", f"""
with b as (select conv_id as kb, length(text) as l, {KIND_SQL} as kind from conversations)
select kb, sum(case when kind in ('constraint', 'procedural') then l else 0 end)::bigint as b_min, sum(l)::bigint as total from b group by 1""")
def _(t):
    return al.b_min(al.typed_items(t.conversations, FAMILIES), "kb", "kind", F.length("text"))


@query("hop_rate", "M45", "select l_linenumber::bigint as l_linenumber, count(*) as n, round(avg((l_discount > 0.05)::int), 6) as rate from lineitem group by 1")
def _(t):
    return al.hop_rate(t.lineitem, "l_linenumber", F.col("l_discount") > 0.05)


def _short(c: str) -> str:
    return sentence_sql(c).replace("> 220", "> 60").replace(", 219)", ", 59)")


@query("compact_items", "M54", f"""
with b as (select conv_id as kb, turn as item, text, {KIND_SQL} as kind from conversations),
h as (select *, item = min(item) over (partition by kb, text) as first from b where kind in ('constraint', 'procedural')),
need as (select kb, sum(length(text)) filter (first) as need from h group by 1),
s as (select *, case when kind = 'episodic' then '[episode]' else {_short('text')} end as shown from b where kind not in ('constraint', 'procedural')),
c as (select *, sum(length(shown)) over (partition by kb order by item) as cum from s)
select kb, item, kind, 'full' as lane, text as shown, first::int::bigint as kept, (need > 2500)::int::bigint as unsafe from h join need using (kb)
union all select kb, item, kind, case when kind = 'episodic' then 'placeholder' else 'compressed' end, shown,
  (coalesce(need, 0) <= 2500 and coalesce(need, 0) + cum <= 2500)::int::bigint, (coalesce(need, 0) > 2500)::int::bigint from c left join need using (kb)""")
def _(t):
    return al.compact_items(al.typed_items(t.conversations, FAMILIES), "kb", "item", "text", "kind", 2500)


@query("compaction_verifier", "M54", f"""
with b as (select conv_id as kb, turn as item, text, {KIND_SQL} as kind from conversations)
select kb, count(*) as lost from b where kind = 'constraint' and (kb, text) not in (select kb, text from b where length(text) < 400) group by 1""")
def _(t):
    """What the verifier finds in a compaction that looks at length alone."""
    items = al.typed_items(t.conversations, FAMILIES)
    blind = items.select("kb", F.col("text").alias("shown"), (F.length("text") < 400).alias("kept"), F.lit(False).alias("unsafe"))
    return al.lost_constraints(items, blind, "kb", "text", "kind").groupBy("kb").agg(F.count(F.lit(1)).alias("lost"))


@query("decompose", "M55", """
with c as (select doc_id, source, n_chars, floor((sum(n_chars) over (partition by source order by doc_id) - n_chars) / greatest(1, 60000 - (select max(n_chars) from documents)))::bigint as chunk from documents),
cons as (select doc_id, unnest(case when doc_id % 2 = 0 then [source, 'src1'] else ['src2', 'src3'] end) as source from documents where contains(text, 'token')),
p as (select distinct source, chunk from c),
r as (select distinct p.source, p.chunk, cons.doc_id from cons join p using (source))
select source, chunk, doc_id, 0::bigint as replicated from c union all select source, chunk, doc_id, 1 from r anti join c using (source, chunk, doc_id)""")
def _(t):
    scope = F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("src1"))).otherwise(F.array(F.lit("src2"), F.lit("src3")))
    cons = t.documents.filter(F.col("text").contains("token")).select("doc_id", F.explode(scope).alias("scope"))
    return al.decompose(t.documents.select("source", "doc_id", "n_chars"), cons, "source", "doc_id", "n_chars", 60000)


CALLS_SQL = f"calls as (select user_id, event_id, ts, repeat(left(event_type, 1), {K_SQL}::int) as prompt, left(event_type, 1) as reply from events)"


@query("merge_calls", "M58", f"""
with {CALLS_SQL}, p as (select *, lag(prompt || reply) over (partition by user_id order by ts, event_id) as prev from calls)
select user_id, event_id, sum(case when prev is not null and starts_with(prompt, prev) then 0 else 1 end) over (partition by user_id order by ts, event_id)::bigint as sequence from p""")
def _(t):
    e = _events(t).select("user_id", "event_id", "us", F.repeat(F.left("event_type", F.lit(1)), F.col("k").cast("int")).alias("prompt"), F.left("event_type", F.lit(1)).alias("reply"))
    return al.merge_calls(e, "user_id", ["us", "event_id"], "prompt", "reply").select("user_id", "event_id", "sequence")


def _calls(t: Tables) -> DataFrame:
    """A call per order whose messages name its place: status alone, with priority, or with the customer too."""
    depth = F.when(F.col("o_orderpriority") == "5-LOW", 1).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 2).otherwise(3)
    path = F.array("o_orderstatus", F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")), F.col("o_orderkey").cast("string"))
    return t.orders.select((F.col("o_custkey") % 50).alias("rollout"), F.col("o_orderkey").alias("call"), F.slice(path, F.lit(1), depth).alias("messages"))


TREE_SQL = """calls as (select o_custkey % 50 as rollout, o_orderkey as call, case o_orderpriority when '5-LOW' then 1 when '4-NOT SPECIFIED' then 2 else 3 end as depth,
  o_orderstatus as a, o_orderstatus || '/c' || (o_custkey % 10) as b from orders),
own as (select rollout, case depth when 1 then a else b end as path, depth, min(call) as owner from calls where depth < 3 group by all),
tree as (select c.rollout, c.call, c.depth::bigint as depth, coalesce(case when c.depth > 2 then (select owner from own o where o.rollout = c.rollout and o.depth = 2 and o.path = c.b) end,
  case when c.depth > 1 then (select owner from own o where o.rollout = c.rollout and o.depth = 1 and o.path = c.a) end) as parent from calls c)"""


@query("prefix_tree", "M59", f"with {TREE_SQL} select * from tree")
def _(t):
    return al.prefix_tree(_calls(t), "rollout", "call", "messages")


@query("prefix_leaves", "M59", f"with {TREE_SQL} select * from tree where (rollout, call) not in (select rollout, parent from tree where parent is not null)")
def _(t):
    return al.prefix_leaves(al.prefix_tree(_calls(t), "rollout", "call", "messages"), "rollout", "call")


@query("filter_leaves", "M60", f"""
with {TREE_SQL}, l as (select *, coalesce(parent, -1) as segment from tree where (rollout, call) not in (select rollout, parent from tree where parent is not null)),
few as (select rollout from l group by 1 having count(*) <= 300)
select rollout, segment, arg_max(call, row(depth, -call)) as call, max(depth) as depth from l where rollout in (select rollout from few) and depth > 1 group by all""")
def _(t):
    leaves = al.prefix_leaves(al.prefix_tree(_calls(t), "rollout", "call", "messages"), "rollout", "call")
    return al.filter_leaves(leaves.withColumn("segment", F.coalesce("parent", F.lit(-1))), "rollout", "segment", "call", F.col("depth") <= 1, 300)


GAP_SQL = """g as (select user_id, event_id, case when lag(event_id) over w is not null then greatest(0, (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6::double - lag(value) over w) end as gap from events window w as (partition by user_id order by ts, event_id)),
b as (select *, case when gap < 10 then '<10s' when gap < 60 then '<1m' when gap < 600 then '<10m' when gap < 3600 then '<1h' when gap < 36000 then '<10h' else '>=10h' end as bucket from g where gap is not null)"""


@query("idle_intervals", "M64", f"with {GAP_SQL} select user_id, event_id, round(gap, 6) as gap, bucket from b")
def _(t):
    return al.idle_intervals(_events(t), "user_id", "us", "event_id", F.col("value")).select("user_id", "event_id", "gap", "bucket")


@query("idle_quantiles", "M64", f"with {GAP_SQL} select bucket, count(*) as n, round(median(gap), 6) as median from b group by 1")
def _(t):
    gaps = al.idle_intervals(_events(t), "user_id", "us", "event_id", F.col("value")).select("bucket", F.round("gap", 9).alias("gap"))
    return gaps.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(exact_quantiles(gaps, ["bucket"], "gap", {"median": 0.5}), "bucket")


@query("active_share", "M64", """
select user_id, round(sum(value::decimal(18,2))::double, 6) as busy, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::double, 6) as lifetime,
  round(sum(value::decimal(18,2))::double / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::double), 6) as active from events group by 1""")
def _(t):
    return al.active_share(_events(t), "user_id", "us", F.col("value").cast("decimal(18,2)"))


TTL_SQL = f"""c as (select event_id, {K_SQL} as k, value::decimal(18,2) as value, epoch_us(ts) - lag(epoch_us(ts)) over (partition by {K_SQL} order by ts, event_id) as d from events)"""


@query("ttl_hits", "M65", f"with {TTL_SQL} select event_id, k, coalesce(d <= 3600000000, false)::int::bigint as hit, (d is not null)::int::bigint as repeat from c")
def _(t):
    return al.ttl_hits(_events(t), "k", "us", "event_id", 3_600_000_000).select("event_id", "k", "hit", "repeat")


@query("ttl_summary", "M65", f"""
with {TTL_SQL} select count(*) as calls, count(d) as repeats, count(*) filter (d <= 3600000000) as hits, round((sum(value) filter (d <= 3600000000))::double, 6) as saved,
  round((sum(value) filter (d <= 3600000000))::double / sum(value)::double, 6) as saved_share from c""")
def _(t):
    return al.ttl_summary(al.ttl_hits(_events(t), "k", "us", "event_id", 3_600_000_000).withColumn("value", F.col("value").cast("decimal(18,2)")), "value")


@query("evict_plan", "M68", """
with n as (select conv_id, turn, length(text) as l, role = 'assistant' as pay, row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n, sum(length(text)) over (partition by conv_id) as total from conversations),
f as (select *, rn > n - 2 as guard, total > 3000 and not rn > n - 2 and pay and l > 20 as fold from n),
g as (select *, case when fold then 20 else l end as l2 from f), h as (select *, case when guard then 0 else l2 end as take, sum(l2) over (partition by conv_id) - 3000 as excess from g),
k as (select *, sum(take) over (partition by conv_id order by turn) as cum from h)
select conv_id, turn, case when not guard and excess > 0 and cum - take < excess then 'evict' when fold then 'fold' else 'keep' end as action from k""")
def _(t):
    items = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("len"), "role")
    return al.evict_plan(items, "conv_id", "turn", "len", F.col("role") == "assistant", pointer=20, tail=2, budget=3000)


BOTTLE_SQL = """g as (select user_id, date_trunc('day', ts) as day, event_type, sum(value::decimal(18,2))::double as v from events group by all),
b as (select user_id, day, arg_max(event_type, row(v, event_type)) as dominant, max(v) / nullif(sum(v::decimal(18,2))::double, 0) as share, sum(v::decimal(18,2))::double as total from g group by all)"""


def _bottleneck(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.date_trunc("day", "ts").alias("day"), "event_type", F.col("value").cast("decimal(18,2)").alias("v"))
    return al.bottleneck(e, "user_id", "day", "event_type", "v")


@query("bottleneck", "M110", f"with {BOTTLE_SQL} select user_id, dominant, count(*) as requests, round(avg(share), 6) as share from b group by all")
def _(t):
    return _bottleneck(t).groupBy("user_id", "dominant").agg(F.count(F.lit(1)).alias("requests"), F.avg("share").alias("share"))


@query("spread_ratio", "M110", f"""
with {BOTTLE_SQL}, w as (select user_id, max(total) / min(total) as within, avg(total) as mean from b group by 1)
select user_id, round(within, 6) as within, round(mean, 6) as mean, round((select max(mean) / min(mean) from w), 6) as across from w""")
def _(t):
    return al.spread_ratio(_bottleneck(t), "user_id", "total")


@query("offer_curve", "M113", """
with x as (select l_linestatus, l_orderkey, (l_extendedprice / l_quantity - 1000) / nullif(3 * p_retailprice - 1000, 0) as x, row_number() over (partition by l_linestatus, l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn
  from lineitem join part on p_partkey = l_partkey)
select l_linestatus, round(avg(x) filter (rn = 1), 6) as offer_1, round(avg(x) filter (rn = 2), 6) as offer_2, round(avg(x) filter (rn = 3), 6) as offer_3, round(avg(x) filter (rn = 4), 6) as offer_4,
  round(avg((x < 0)::int) filter (rn = 1), 6) as opens_below from x where rn <= 4 group by 1""")
def _(t):
    d = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return al.offer_curve(d, "l_linestatus", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_extendedprice") / F.col("l_quantity"), 3 * F.col("p_retailprice"), F.lit(1000.0))


@query("size_profile", "M25", f"""
with w as (select lang, len(string_split({squash_sql('text')}, ' ')) as w from documents)
select lang, count(*) as n, round(avg(w), 6) as mean, round(median(w), 6) as median, round(quantile_cont(w, 0.9), 6) as p90 from w group by 1""")
def _(t):
    from attestry.functions.text import squash

    w = t.documents.select("lang", F.size(F.split(squash(F.col("text")), " ")).alias("w"))
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean")).join(exact_quantiles(w, ["lang"], "w", {"median": 0.5, "p90": 0.9}), "lang")
