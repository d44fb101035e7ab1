"""Analytics over agent logs: rewards, costs, reuse, context, compaction, calls, idle time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import item_type, short_description
from attestry.operators.evaluation import hash_order
from attestry.operators.ordering import exact_quantiles, once, running, shifted, span_count
from attestry.session import spread, written


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def utility_reward(z: Column, m: Column, temperature: float = 0.2) -> Column:
    """Calibrated utility: 0 at z = 0, 1 at z = 1, steepest at m."""
    low = sigmoid(-m / temperature)
    return (sigmoid((z - m) / temperature) - low) / (sigmoid((1 - m) / temperature) - low)


def corridor_share(price: Column, low: Column, high: Column, side: str = "seller") -> Column:
    """Share of the price corridor a side captured, clipped to [0, 1]; both sides sum to one."""
    top = price - low if side == "seller" else high - price
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), top / (high - low)))


def truncated_weight(log_new: Column, log_old: Column, cap: float) -> Column:
    return F.least(F.exp(log_new - log_old), F.lit(float(cap)))


FENCE = r"(?s)```.*?```"
LIST_ITEM = r"^[ \t]*([-*+]|[0-9]+[.)])[ \t]+"


def segment_instructions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Segments ``(key, line, part, class, text)``: list items and blocks first, then sentences.

    Headings, code, tables, whole-line bold labels and fragments under two words are payload.
    """
    flat = F.regexp_replace(F.col(text), FENCE, "\n\x01code\n")
    lines = spread(docs.select(key, text)).select(key, F.posexplode(F.split(flat, "\n")).alias("line", "l")).filter(F.trim("l") != "")
    payload = F.col("l").rlike(r"^\s*#|^\s*\||\x01code") | F.col("l").contains(" | ") | F.col("l").rlike(r"^\s*\*\*[^*]+\*\*:?\s*$")
    bare = F.regexp_replace("l", LIST_ITEM, "")
    parts = F.when(payload, F.array("l")).otherwise(F.split(F.regexp_replace(bare, r"([.!?])\s+", "$1\x02"), "\x02"))
    seg = lines.select(key, "line", payload.alias("_p"), F.posexplode(parts).alias("part", "t")).select(key, "line", "part", "_p", F.trim("t").alias("text")).filter("text <> ''")
    return seg.select(key, "line", "part", "text", F.when(F.col("_p") | ~F.col("text").rlike(r"\S\s+\S"), "payload").otherwise("instruction").alias("class"))


# Weight of the source of an item (fixed values).
AUTHORITY = {"system": 1.5, "developer": 1.25, "user": 1.0, "assistant": 1.0, "tool": 0.75, "retrieved": 0.6}


def authority_risk(p: Column, source: Column) -> Column:
    weights = F.create_map(*[x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v))])
    return p * F.coalesce(F.try_element_at(weights, source), F.lit(1.0))


def inject_marker(turns: DataFrame, conv: str, turn: str, text: str, marker: str, where: str, k: int = 2, seed: str = "m", parts: int | None = None) -> DataFrame:
    """Append a marker to the first, median or last user turn, or to k seeded user turns of each conversation."""
    users = turns.filter("role = 'user'")
    if where == "multi":
        w = Window.partitionBy(conv).orderBy(hash_order(seed, conv, turn))
        chosen = users.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    elif where == "middle":
        numbered = running(users.select(conv, turn), [conv], [turn], number="_rn", size="_n", parts=parts)
        chosen = numbered.filter(F.col("_rn") - 1 == F.floor((F.col("_n") - 1) / 2))
    else:
        pick = F.min if where == "top" else F.max
        chosen = users.groupBy(conv).agg(pick(turn).alias(turn))
    marked = chosen.select(conv, turn, F.lit(True).alias("_hit"))
    j = turns.join(marked, [conv, turn], "left")
    return j.withColumn(text, F.when(F.col("_hit"), F.concat(text, F.lit(marker))).otherwise(F.col(text))).withColumn("injected", F.coalesce("_hit", F.lit(False))).drop("_hit")


def reuse_share(calls: DataFrame, key: str, session: str) -> DataFrame:
    """Share of distinct keys that recur across sessions and their share of all calls."""
    per = calls.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(session).alias("s"))
    again = F.col("s") > 1
    return per.agg(
        F.count(F.lit(1)).alias("keys"), F.sum("n").alias("calls"), F.avg(again.cast("double")).alias("recurring_keys"), (F.sum(F.when(again, F.col("n")).otherwise(0)) / F.sum("n")).alias("recurring_calls")
    )


def latency_breakdown(spans: DataFrame, session: str, component: str, value: str) -> DataFrame:
    """Sum per session and component and its share of the session."""
    g = spans.groupBy(session, component).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    whole = g.groupBy(session).agg(F.sum("total").alias("_all"))
    return g.join(whole, session).withColumn("share", F.col("total") / F.col("_all")).drop("_all")


def latency_tail(spans: DataFrame, component: str, value: str, parts: int | None = None) -> DataFrame:
    """Mean, median, p95 and p99 per component, exact."""
    q = exact_quantiles(spans, [component], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, parts)
    return q.join(spans.groupBy(component).agg(F.avg(value).alias("mean")), component)


def compaction_ratio(events: DataFrame, by: str, before: Column, after: Column, cut: float = 0.7) -> DataFrame:
    """Mean post/pre length and the share of events that shrink by more than the cut."""
    ratio = after / F.nullif(before, F.lit(0)).cast("double")
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.avg(ratio).alias("ratio"), F.avg((ratio < 1 - cut).cast("double")).alias("strong"))


def context_mix(turns: DataFrame, conv: str, turn: str, role: str, tokens: Column, roles: Sequence[str], parts: int | None = None) -> DataFrame:
    """Share of each role in the context at every step."""
    wide = turns.select(conv, turn, *[F.when(F.col(role) == r, tokens).otherwise(0).cast("long").alias(f"_{r}") for r in roles])
    cum = running(wide, [conv], [turn], {r: f"_{r}" for r in roles}, number="_rn", parts=parts)
    total = sum((F.col(r) for r in roles), F.lit(0))
    return cum.select(conv, turn, *[(F.col(r) / F.nullif(total, F.lit(0))).alias(r) for r in roles])


def preservation_rate(before: DataFrame, after: DataFrame, key: Sequence[str], kind: str) -> DataFrame:
    """Kept share per knowledge type."""
    j = before.join(after.select(*key, F.lit(1).alias("_kept")).distinct(), list(key), "left")
    return j.groupBy(kind).agg(F.count(F.lit(1)).alias("items"), F.count("_kept").alias("kept"), F.avg(F.col("_kept").isNotNull().cast("double")).alias("rate"))


def locality(placed: DataFrame, constraints: DataFrame, config: str, part: str, topic: str, item: str, length: str) -> DataFrame:
    """Per configuration: how many constraints its partitions need and lack, and what copies cost.

    ``placed(config, part, topic, item, length)`` says what stands where; ``constraints(config, item, scope)`` what each
    constraint covers: one topic, or all where the scope is null. A partition needs every constraint whose scope meets one
    of its topics; it is violated where one is missing. ``overhead`` is the length of all copies over that of the items
    once, minus one. Needs are found by equality on configuration and topic, and by configuration alone for global scopes.
    """
    cells = placed.select(config, part, topic).distinct()
    rules = constraints.select(config, F.col(item).alias("_rule"), "scope").distinct()
    scoped = cells.join(rules.filter("scope is not null").withColumnRenamed("scope", topic), [config, topic]).select(config, part, "_rule")
    everywhere = cells.select(config, part).distinct().join(rules.filter("scope is null").drop("scope"), config).select(config, part, "_rule")
    need = scoped.unionByName(everywhere).distinct()
    there = placed.select(config, part, F.col(item).alias("_rule"), F.lit(1).alias("_there")).distinct()
    lacks = need.join(there, [config, part, "_rule"], "left").groupBy(config).agg(F.count(F.lit(1)).alias("needed"), F.count_if(F.col("_there").isNull()).alias("violations"))
    copies = placed.select(config, part, item, length).distinct().groupBy(config, item).agg(F.count(F.lit(1)).alias("_n"), F.max(length).alias("_len"))
    cost = copies.groupBy(config).agg(F.sum(F.col("_n") * F.col("_len")).alias("_all"), F.sum("_len").alias("_once"))
    out = cost.join(lacks, config, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    share = F.coalesce(F.col("violations") / F.col("needed"), F.lit(0.0))
    return out.select(config, zero("needed").alias("needed"), zero("violations").alias("violations"), share.alias("violation"), F.coalesce(F.col("_all") / F.nullif(F.col("_once"), F.lit(0)) - 1, F.lit(0.0)).alias("overhead"))


def locality_summary(per: DataFrame) -> DataFrame:
    """Mean violation, share of configurations with one, and mean, median, 90th percentile and worst overhead."""
    rounded = F.round("overhead", 9)
    return per.agg(
        F.count(F.lit(1)).alias("configs"), F.avg("violation").alias("violation"), F.avg((F.col("violations") > 0).cast("double")).alias("violated"), F.avg("overhead").alias("overhead"),
        F.percentile(rounded, 0.5).alias("median"), F.percentile(rounded, 0.9).alias("p90"), F.max("overhead").alias("worst"),
    )


def initial_convergence(states: DataFrame, group: str, agent: str, order: Sequence[str], state: str) -> DataFrame:
    """Share of agents of a group that begin with its most common first state."""
    first = states.groupBy(group, agent).agg(F.min(F.struct(*order, state)).alias("f"))
    counts = first.groupBy(group, F.col(f"f.{state}").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(group).agg(F.sum("c").alias("agents"), (F.max("c") / F.sum("c")).alias("convergence"))


def strategy_persistence(states: DataFrame, group: str, agent: str, order: Sequence[str], state: str, parts: int | None = None) -> DataFrame:
    """Change and persist rates over neighbouring states of one agent."""
    steps = shifted(states, [group, agent], order, {"_prev": state}, parts=parts).filter("_prev is not null")
    g = steps.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("_prev") != F.col(state)).cast("double")).alias("change"))
    return g.withColumn("persist", 1 - F.col("change"))


def loss_normalisations(tokens: DataFrame, rollout: str, sample: Sequence[str], length: Column, loss: Column) -> DataFrame:
    """Token-mean, sequence-mean and rollout-mean of the same losses."""
    per_sample = tokens.groupBy(rollout, *sample).agg(F.sum(length).alias("l"), F.sum(loss).alias("s"))
    per_rollout = per_sample.groupBy(rollout).agg(F.sum("l").alias("l"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("s") / F.col("l")).alias("m"))
    return per_rollout.agg(
        F.count(F.lit(1)).alias("rollouts"), (F.sum("s") / F.sum("l")).alias("token_mean"), (F.sum("m") / F.sum("n")).alias("sequence_mean"), F.avg(F.col("s") / F.col("l")).alias("rollout_mean")
    )


def group_advantage(rewards: DataFrame, group: str, rollout: str, reward: str, samples: str | None = None, eps: float = 1e-6) -> DataFrame:
    """Reward against the mean and population deviation of its group; with ``samples`` each rollout counts that many times."""
    w = F.col(samples) if samples else F.lit(1)
    r = F.col(reward)
    g = rewards.groupBy(group).agg((F.sum(w * r) / F.sum(w)).alias("_m"))
    j = rewards.join(g, group)
    sd = j.groupBy(group).agg(F.sqrt(F.sum(w * (r - F.col("_m")) ** 2) / F.sum(w)).alias("_sd"))
    return j.join(sd, group).select(group, rollout, ((r - F.col("_m")) / (F.col("_sd") + eps)).alias("advantage"))


def b_min(items: DataFrame, kb: str, kind: str, length: Column) -> DataFrame:
    """Smallest safe budget: what constraints and procedures need in full."""
    return items.groupBy(kb).agg(F.sum(F.when(F.col(kind).isin("constraint", "procedural"), length).otherwise(0)).alias("b_min"), F.sum(length).alias("total"))


def hop_rate(episodes: DataFrame, hop: str, infected: Column) -> DataFrame:
    return episodes.groupBy(hop).agg(F.count(F.lit(1)).alias("n"), F.avg(infected.cast("double")).alias("rate"))


PLACEHOLDER = "[episode]"


def compact_items(items: DataFrame, kb: str, item: str, text: str, kind: str, budget: int, parts: int | None = None) -> DataFrame:
    """Typed lanes under a budget per knowledge base.

    Constraints and procedures stay in full and without repeats; beliefs and preferences are cut to a first sentence,
    episodes to a placeholder, oldest first while the budget lasts. A base whose full lane is over the budget is unsafe.
    """
    hard = F.col(kind).isin("constraint", "procedural")
    soft_text = F.when(F.col(kind) == "episodic", F.lit(PLACEHOLDER)).otherwise(short_description(F.col(text), 60))
    typed = items.withColumns({"_hard": hard, "shown": F.when(hard, F.col(text)).otherwise(soft_text)})
    first = typed.filter("_hard").groupBy(kb, text).agg(F.min(item).alias("_first"))
    full = typed.filter("_hard").join(first, [kb, text]).withColumn("_keep", F.col(item) == F.col("_first"))
    need = first.groupBy(kb).agg(F.sum(F.length(text)).alias("_need"))
    soft = typed.filter("not _hard").withColumn("_len", F.length("shown").cast("long"))
    cum = running(soft, [kb], [item], {"_cum": "_len"}, number="_rn", parts=parts)
    lanes = full.select(kb, item, kind, "shown", F.lit("full").alias("lane"), F.lit(0).cast("long").alias("_cum"), "_keep").unionByName(
        cum.select(kb, item, kind, "shown", F.when(F.col(kind) == "episodic", "placeholder").otherwise("compressed").alias("lane"), "_cum", F.lit(True).alias("_keep"))
    )
    j = lanes.join(need, kb, "left").withColumn("_need", F.coalesce("_need", F.lit(0)))
    unsafe = F.col("_need") > budget
    kept = F.when(F.col("lane") == "full", F.col("_keep")).otherwise(~unsafe & (F.col("_need") + F.col("_cum") <= budget))
    return j.select(kb, item, kind, "lane", "shown", kept.alias("kept"), unsafe.alias("unsafe"))


def lost_constraints(items: DataFrame, compacted: DataFrame, kb: str, text: str, kind: str) -> DataFrame:
    """The verifier: constraints without an identical kept copy in a base that claims to be safe."""
    kept = compacted.filter("kept").select(kb, F.col("shown").alias(text))
    unsafe = compacted.filter("unsafe").select(kb).distinct()
    return items.filter(F.col(kind) == "constraint").join(kept, [kb, text], "left_anti").join(unsafe, kb, "left_anti")


def decompose(items: DataFrame, constraints: DataFrame, topic: str, item: str, length: str, budget: int, parts: int | None = None) -> DataFrame:
    """Partitions ``(topic, chunk, item, replicated)`` of at most ``budget`` each, with every constraint copied to the topics it covers.

    Items are cut where their running length passes a multiple of budget minus the longest item, so each chunk keeps to
    the budget however large the topic is. ``constraints(item, scope)`` has one row per covered topic.
    """
    longest = items.agg(F.max(length)).scalar()
    cum = running(items, [topic], [item], {"_cum": length}, number="_rn", parts=parts)
    chunk = F.floor((F.col("_cum") - F.col(length)) / F.greatest(F.lit(1), budget - longest))
    placed = cum.select(topic, chunk.alias("chunk"), item)
    placed = written(placed, "placed")
    present = written(placed.select(topic, "chunk").distinct(), "present")
    # A constraint lies in one chunk of a topic at most, so that chunk is looked up before its copies are made.
    own = placed.select(topic, item, F.col("chunk").alias("_own"))
    wanted = written(constraints.select(F.col("scope").alias(topic), item).distinct().join(own.hint("merge"), [topic, item], "left"), "wanted")
    # A topic's copies are made by as many tasks as there are spans, whatever share of the rows the topic holds: one side is
    # dealt over them, the one of fewer rows goes to all. Files and plans show far less than that comes to, so neither side
    # may be sent through the driver.
    shares = span_count(placed, parts)
    dealt = lambda d, name: d.withColumn("_share", F.pmod(F.xxhash64(name), F.lit(shares)).cast("int"))
    everywhere = lambda d: d.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    if wanted.count() < present.count():
        present, wanted = dealt(present, "chunk"), everywhere(wanted)
    else:
        present, wanted = everywhere(present), dealt(wanted, item)
    copies = present.join(wanted.hint("merge"), [topic, "_share"]).filter(F.col("_own").isNull() | (F.col("_own") != F.col("chunk")))
    return placed.withColumn("replicated", F.lit(False)).unionByName(copies.select(topic, "chunk", item).withColumn("replicated", F.lit(True)))


def merge_calls(calls: DataFrame, session: str, order: Sequence[str], prompt: str, reply: str, parts: int | None = None) -> DataFrame:
    """Sequence number per session: a call continues the sequence only if the earlier prompt and reply are an exact prefix of its prompt."""
    prev = shifted(calls.withColumn("_both", F.concat(prompt, reply)), [session], order, {"_prev": "_both"}, parts=parts)
    new = F.when(F.col("_prev").isNotNull() & F.startswith(F.col(prompt), F.col("_prev")), 0).otherwise(1).cast("long")
    return running(once(prev.withColumn("_new", new).drop("_both", "_prev")), [session], order, {"sequence": "_new"}, number="_rn", parts=parts).drop("_new", "_rn")


def prefix_tree(calls: DataFrame, rollout: str, call: str, messages: str) -> DataFrame:
    """Parent of each call: the call of the same rollout whose messages are its longest proper prefix.

    Each call meets its ancestors through prefix digests, one row per depth, so calls are never compared pairwise.
    """
    digest = lambda a: F.sha2(F.concat_ws("\x1f", a), 256)
    own = calls.groupBy(rollout, digest(F.col(messages)).alias("_d")).agg(F.min(call).alias("_owner"))
    depths = F.filter(F.sequence(F.lit(1), F.size(messages)), lambda d: d < F.size(messages))
    prefixes = calls.select(rollout, call, F.explode(depths).alias("depth"), messages).select(rollout, call, "depth", digest(F.slice(messages, F.lit(1), F.col("depth"))).alias("_d"))
    best = prefixes.join(own, [rollout, "_d"]).groupBy(rollout, call).agg(F.max(F.struct("depth", "_owner")).alias("b"))
    return calls.join(best, [rollout, call], "left").select(rollout, call, F.size(messages).alias("depth"), F.col("b._owner").alias("parent"))


def prefix_leaves(tree: DataFrame, rollout: str, call: str) -> DataFrame:
    """Calls that no other call extends."""
    parents = tree.filter("parent is not null").select(rollout, F.col("parent").alias(call)).distinct()
    return tree.join(parents, [rollout, call], "left_anti")


def filter_leaves(leaves: DataFrame, rollout: str, segment: str, call: str, auxiliary: Column, max_leaves: int) -> DataFrame:
    """One leaf per segment (the deepest), no auxiliary leaves, and no rollout that branched too often."""
    few = leaves.groupBy(rollout).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= max_leaves).select(rollout)
    main = leaves.filter(~auxiliary).join(few, rollout, "left_semi")
    best = main.groupBy(rollout, segment).agg(F.max(F.struct("depth", (-F.col(call)).alias("_c"))).alias("b"))
    return best.select(rollout, segment, (-F.col("b._c")).alias(call), F.col("b.depth").alias("depth"))


# Upper ends of the idle buckets in seconds (fixed values).
IDLE_BUCKETS = [(10, "<10s"), (60, "<1m"), (600, "<10m"), (3600, "<1h"), (36000, "<10h")]


def idle_intervals(events: DataFrame, session: str, at: str, tie: str, busy: Column, parts: int | None = None) -> DataFrame:
    """Gap before each event in seconds with its bucket; ``at`` is in microseconds, ``busy`` the event's own seconds."""
    steps = shifted(events.withColumn("_busy", busy), [session], [at, tie], {"_pat": at, "_pb": "_busy"}, parts=parts)
    gap = F.greatest(F.lit(0.0), (F.col(at) - F.col("_pat")) / 1e6 - F.col("_pb"))
    bucket = F.when(F.lit(False), "")
    for top, name in IDLE_BUCKETS:
        bucket = bucket.when(F.col("gap") < top, name)
    return steps.filter("_pat is not null").withColumn("gap", gap).withColumn("bucket", bucket.otherwise(">=10h")).drop("_pat", "_pb")


def active_share(events: DataFrame, session: str, at: str, busy: Column) -> DataFrame:
    """Share of a session's lifetime spent in steps."""
    g = events.groupBy(session).agg(F.sum(busy).alias("busy"), ((F.max(at) - F.min(at)) / 1e6).alias("lifetime"))
    return g.withColumn("active", F.col("busy") / F.nullif(F.col("lifetime"), F.lit(0.0)))


def ttl_hits(calls: DataFrame, key: str, at: str, tie: str, ttl_us: int, parts: int | None = None) -> DataFrame:
    """A call is a hit when the same key was called within the ttl before it (sliding expiry)."""
    steps = shifted(calls, [key], [at, tie], {"_pat": at}, parts=parts)
    return steps.withColumn("hit", F.coalesce(F.col(at) - F.col("_pat") <= ttl_us, F.lit(False))).withColumn("repeat", F.col("_pat").isNotNull()).drop("_pat")


def ttl_summary(hits: DataFrame, latency: str) -> DataFrame:
    hit = F.col("hit")
    return hits.agg(F.count(F.lit(1)).alias("calls"), F.count_if("repeat").alias("repeats"), F.count_if("hit").alias("hits"), F.sum(F.when(hit, F.col(latency))).alias("saved"), (F.sum(F.when(hit, F.col(latency))) / F.sum(latency)).alias("saved_share"))


def evict_plan(items: DataFrame, view: str, order: str, length: str, payload: Column, pointer: int, tail: int, budget: int, parts: int | None = None) -> DataFrame:
    """Action per item of a working view: keep, fold (payload to a pointer) or evict.

    The last ``tail`` items are protected. Over budget, payloads outside the tail are folded; what is still too much is
    taken from the oldest unprotected items.
    """
    n = running(items.select(view, order, length, payload.alias("_pay")), [view], [order], {"_cum0": length}, number="_rn", size="_n", parts=parts)
    totals = items.groupBy(view).agg(F.sum(length).alias("_total"))
    j = n.join(totals, view)
    over = F.col("_total") > budget
    guarded = F.col("_rn") > F.col("_n") - tail
    folded = over & ~guarded & F.col("_pay") & (F.col(length) > pointer)
    j = j.withColumns({"_guard": guarded, "_fold": folded, "_len2": F.when(folded, pointer).otherwise(F.col(length)).cast("long")})
    j = once(j.withColumn("_take", F.when(F.col("_guard"), 0).otherwise(F.col("_len2")).cast("long")).drop("_cum0", "_n", "_rn", length))
    after = j.groupBy(view).agg((F.sum("_len2") - budget).alias("_excess"))
    cum = running(j, [view], [order], {"_cum": "_take"}, number="_rn2", parts=parts).join(after, view)
    evicted = ~F.col("_guard") & (F.col("_excess") > 0) & (F.col("_cum") - F.col("_take") < F.col("_excess"))
    action = F.when(evicted, "evict").when(F.col("_fold"), "fold").otherwise("keep")
    return cum.select(view, order, action.alias("action"))


def bottleneck(spans: DataFrame, task: str, request: str, component: str, value: str) -> DataFrame:
    """Dominant component per request with its share."""
    g = spans.groupBy(task, request, component).agg(F.sum(value).alias("v"))
    top = g.groupBy(task, request).agg(F.max(F.struct("v", component)).alias("t"), F.sum("v").alias("all"))
    return top.select(task, request, F.col(f"t.{component}").alias("dominant"), (F.col("t.v") / F.nullif(F.col("all"), F.lit(0)).cast("double")).alias("share"), F.col("all").cast("double").alias("total"))


def _ratio(high: Column, low: Column) -> Column:
    """Division of doubles as IEEE has it: over zero it is infinite, zero over zero not a number."""
    high, low = high.cast("double"), low.cast("double")
    over_zero = F.when(high == 0, F.lit(float("nan"))).when(high > 0, F.lit(float("inf"))).when(high < 0, F.lit(float("-inf")))
    return F.when(low == 0, over_zero).otherwise(high / low)


def spread_ratio(per_request: DataFrame, task: str, total: str) -> DataFrame:
    """Max over min of request totals within each task, and of task means across tasks; infinite where the least is zero."""
    g = per_request.groupBy(task).agg(_ratio(F.max(total), F.min(total)).alias("within"), F.avg(total).alias("mean"))
    across = g.agg(_ratio(F.max("mean"), F.min("mean"))).scalar()
    return g.withColumn("across", across)


def offer_curve(offers: DataFrame, stage: str, game: str, order: Sequence[str], offer: Column, listing: Column, target: Column, upto: int = 4) -> DataFrame:
    """Mean of the first offers scaled so that target is 0 and listing 1, and the share of games that open below target."""
    w = Window.partitionBy(stage, game).orderBy(*order)
    scaled = offers.withColumn("_x", (offer - target) / F.nullif(listing - target, F.lit(0.0)))
    first = scaled.select(stage, game, *order, "_x").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= upto)
    nth = lambda i: F.avg(F.when(F.col("_rn") == i, F.col("_x")))
    return first.groupBy(stage).agg(*[nth(i).alias(f"offer_{i}") for i in range(1, upto + 1)], F.avg(F.when(F.col("_rn") == 1, (F.col("_x") < 0).cast("double"))).alias("opens_below"))


def typed_items(turns: DataFrame, families: list | None = None) -> DataFrame:
    """Turns of conversations as knowledge items with their type."""
    kind = item_type(F.col("text"), families) if families else item_type(F.col("text"))
    return turns.select(F.col("conv_id").alias("kb"), F.col("turn").alias("item"), "text", "role", kind.alias("kind"))

