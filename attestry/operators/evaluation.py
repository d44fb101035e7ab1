"""Evaluation metrics over verdicts, runs, pairs and rankings."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.text import extract_numbers
from attestry.operators.ordering import exact_quantiles, once, running, shifted


def _stack(names: Mapping[str, Column], key: str, value: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias(key), c.alias(value)) for n, c in names.items()])).alias("r")


def literature_funnel(df: DataFrame, include: Mapping[str, Column], exclude: Mapping[str, Column], categories: Mapping[str, Column], value: Column) -> DataFrame:
    """Counts per step and category, with the range of a value where sources disagree; one pass. Categories may overlap."""
    inc, exc = F.lit(False), F.lit(False)
    for c in include.values():
        inc = inc | c
    for c in exclude.values():
        exc = exc | c
    kept = inc & ~exc
    steps = {"all": F.lit(True), "included": inc, "excluded": inc & exc, "kept": kept}
    steps |= {f"criterion:{n}": c for n, c in include.items()} | {f"exclusion:{n}": inc & c for n, c in exclude.items()} | {f"category:{n}": kept & c for n, c in categories.items()}
    names = list(steps)
    g = df.agg(*[f(F.when(steps[n], v)).alias(f"{p}{i}") for i, n in enumerate(names) for p, f, v in (("n", F.count, F.lit(1)), ("lo", F.min, value), ("hi", F.max, value))])
    rows = F.array(*[F.struct(F.lit(n).alias("step"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high")) for i, n in enumerate(names)])
    return g.select(F.explode(rows).alias("r")).select("r.*")


# Weights of the four dimensions (fixed values).
DIMENSIONS = {"correctness": 0.35, "discoverability": 0.25, "reliability": 0.25, "efficiency": 0.15}


def static_score(df: DataFrame, key: str, rules: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """Rules are (dimension, broken, deduction). A dimension starts at 100 and never falls below zero."""
    score = {d: F.greatest(F.lit(0.0), 100.0 - sum((F.when(b, float(x)).otherwise(0.0) for d2, b, x in rules if d2 == d), F.lit(0.0))) for d in DIMENSIONS}
    out = df.select(key, *[c.alias(d) for d, c in score.items()])
    return out.withColumn("score", sum((F.col(d) * w for d, w in DIMENSIONS.items()), F.lit(0.0)))


def _skyline(frames: Iterator[pd.DataFrame], group: str, best: str, cost1: str, cost2: str) -> Iterator[pd.DataFrame]:
    """Undominated points, equal ones once, of rows that come by group, falling ``best`` and rising costs.

    Held is the staircase of the group so far: rising first costs with falling second ones. A point is beaten when a stair
    of more ``best`` lies at or under it in both costs and is not the same place.
    """
    steps1: list = []
    steps2: list = []
    level: list = []
    now = top = last = None
    for frame in frames:
        keep = []
        for i, point in enumerate(zip(*(frame[c].tolist() for c in (group, best, cost1, cost2)))):
            if point == last:
                continue
            last = point
            g, r, x, y = point
            if g != now:
                now, top, steps1, steps2, level = g, r, [], [], []
            elif r != top:
                for u, v in level:
                    at = bisect.bisect_right(steps1, u)
                    if at and steps2[at - 1] <= v:
                        continue
                    start = bisect.bisect_left(steps1, u)
                    end = start
                    while end < len(steps2) and steps2[end] >= v:
                        end += 1
                    steps1[start:end], steps2[start:end] = [u], [v]
                top, level = r, []
            at = bisect.bisect_right(steps1, x) - 1
            if at < 0 or steps2[at] > y or (steps2[at] == y and steps1[at] == x):
                keep.append(i)
                level.append((x, y))
        if keep:
            yield frame.iloc[keep]


def pareto_front(df: DataFrame, group: str, reward: str, latency: str, cost: str) -> DataFrame:
    """Rows no other row of the group beats: more reward, no worse latency and cost, one of them strictly better.

    Dominance is transitive, so points beaten inside one task of the scan go before anything is shuffled, which leaves a
    large group few rows. The rest meets once more by group. Both times a task reads its rows in order and holds one
    staircase. A row with a null beats nothing and is not beaten.
    """
    place = [group, reward, latency, cost]
    whole = F.lit(True)
    for c in place:
        whole = whole & F.col(c).isNotNull()
    ordered = lambda d: d.sortWithinPartitions(group, F.desc(reward), latency, cost)
    thin = lambda d: ordered(d).mapInPandas(lambda it: _skyline(it, group, reward, latency, cost), d.schema)
    front = thin(thin(df.filter(whole).select(*place)).repartition(group))
    return df.filter(whole).join(front, place, "left_semi").unionByName(df.filter(~whole))


def pair_conditions(df: DataFrame, case: str, condition: str, first: str, second: str, value: Column) -> DataFrame:
    """Case-level means under both conditions in one aggregation; one-sided cases are marked."""
    pick = lambda c: F.avg(F.when(F.col(condition) == c, value))
    g = df.filter(F.col(condition).isin(first, second)).groupBy(case).agg(pick(first).alias("with_value"), pick(second).alias("base_value"))
    status = F.when(F.col("base_value").isNull(), "with only").when(F.col("with_value").isNull(), "base only").otherwise("paired")
    return g.withColumn("status", status)


def common_support(panel: DataFrame, key: Sequence[str], agent: str, clean: Column) -> DataFrame:
    """Rows of the keys for which every agent has a clean outcome."""
    n = panel.agg(F.countDistinct(agent)).scalar()
    full = panel.filter(clean).groupBy(*key).agg(F.countDistinct(agent).alias("_n")).filter(F.col("_n") == n)
    return panel.filter(clean).join(full, list(key), "left_semi")


def effect_retention(df: DataFrame, keys: Sequence[str], condition: str, base: str, compressed: str, upper: str, value: Column) -> DataFrame:
    """Compliance per condition and the retained share of the effect.

    Doubles are added in the order of the input, shares of it in theirs, so a run gives what the one before gave. A decimal
    ``value`` gives the same result in any order of rows, and an effect of nothing is exactly zero.
    """
    sides = {"base": base, "compressed": compressed, "upper": upper}
    exact = isinstance(df.select(value).schema[0].dataType, T.DecimalType)
    of = {n: F.when(F.col(condition) == c, value if exact else value.cast("double")) for n, c in sides.items()}
    shares = df.groupBy(*keys, F.spark_partition_id().alias("_part")).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in of.items()], *[F.count(v).alias(f"_n_{n}") for n, v in of.items()])
    in_order = lambda c: F.aggregate(F.sort_array(F.collect_list(F.struct("_part", c))), F.lit(0.0), lambda a, x: a + F.coalesce(x[c], F.lit(0.0)))
    total = F.sum if exact else in_order
    g = shares.groupBy(*keys).agg(*[total(f"_s_{n}").alias(f"_s_{n}") for n in sides], *[F.sum(f"_n_{n}").alias(f"_n_{n}") for n in sides])
    s, n = (lambda side: F.col(f"_s_{side}")), (lambda side: F.col(f"_n_{side}"))
    means = g.select("*", *[(s(side).cast("double") / F.nullif(n(side), F.lit(0))).alias(side) for side in sides])
    if exact:
        above = lambda side: (s(side) * n("base") - s("base") * n(side)).cast("double")
        kept = n("upper") * above("compressed") / F.nullif(n("compressed") * above("upper"), F.lit(0.0))
    else:
        kept = (F.col("compressed") - F.col("base")) / F.nullif(F.col("upper") - F.col("base"), F.lit(0.0))
    return means.select(*keys, *sides, kept.alias("retention"))


def rate_decomposition(tasks: DataFrame, family: str, treated: Column, in_context: Column, success: Column) -> DataFrame:
    """Overall rate = in-context rate x conditional rate for the treated arm, and the lift over the control arm."""
    share = lambda where, c: F.avg(F.when(where, c.cast("double")))
    g = tasks.groupBy(family).agg(
        share(treated, in_context & success).alias("overall"),
        share(treated, in_context).alias("in_context_rate"),
        share(treated & in_context, success).alias("conditional_rate"),
        share(~treated, in_context & success).alias("control"),
    )
    return g.withColumn("lift", F.col("overall") - F.col("control"))


def paired_lift(pairs: DataFrame, metrics: Mapping[str, tuple[Column, Column]], outcomes: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """With-minus-base per metric and composite: mean, median, signs; a missing side counts as failure (zero).

    ``outcomes`` names the metrics that look at the outcome alone; their mean is one more row, ``outcome``.
    """
    deltas = {m: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)) for m, (a, b) in metrics.items()}
    composite = sum(deltas.values(), F.lit(0.0)) / len(deltas)
    views = {"composite": composite}
    if outcomes:
        views["outcome"] = sum((deltas[m] for m in outcomes), F.lit(0.0)) / len(outcomes)
    long = pairs.select(_stack({**deltas, **views}, "metric", "delta")).select("r.metric", F.round("r.delta", 9).alias("delta"))
    d = F.col("delta")
    g = long.groupBy("metric").agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.count_if(d > 0).alias("positive"), F.count_if(d == 0).alias("zero"), F.count_if(d < 0).alias("negative"))
    return g.join(exact_quantiles(long, ["metric"], "delta", {"median": 0.5}, parts), "metric")


def verdict_accuracy(panel: DataFrame, agent: str, item: str, rule: str, z: str, against: Column) -> DataFrame:
    """Accuracy, accuracy on differing item-rule pairs, discrimination-weighted accuracy, against-prior accuracy and the gap."""
    z_ = F.col(z).cast("double")
    base = panel.select(agent, item, rule, z_.alias("z"), against.alias("against"))
    differing = base.groupBy(item, rule).agg((F.min("z") < F.max("z")).alias("differs"))
    acc = base.groupBy(agent).agg(F.avg("z").alias("acc"))
    rates = base.groupBy(agent, rule).agg(F.avg("z").alias("rate")).join(acc, agent)
    corr = F.corr("rate", "acc")
    weights = rates.groupBy(rule).agg(F.greatest(F.lit(0.0), F.coalesce(F.nanvl(corr, F.lit(0.0)), F.lit(0.0))).alias("w"))
    j = base.join(differing, [item, rule]).join(weights, rule)
    g = j.groupBy(agent).agg(
        F.avg("z").alias("acc"),
        F.avg(F.when(F.col("differs"), F.col("z"))).alias("f_acc"),
        (F.sum(F.col("w") * F.col("z")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("dw_acc"),
        F.avg(F.when(F.col("against"), F.col("z"))).alias("ap_acc"),
    )
    return g.withColumn("gap", F.col("acc") - F.col("ap_acc"))


# Severity weights of rules (fixed values).
SEVERITY = {"must": 3, "should": 2, "may": 1}


def majority_vote(votes: DataFrame, case: Sequence[str], vote: str, severity: str) -> DataFrame:
    """Majority over the judgements of a case, with severity-weighted earned and possible points."""
    weight = F.when(F.lit(False), 0)
    for name, w in SEVERITY.items():
        weight = weight.when(F.col(severity) == name, w)
    g = votes.groupBy(*case, severity).agg((2 * F.sum(vote) > F.count(vote)).alias("passed"))
    return g.withColumn("possible", weight).withColumn("earned", F.when(F.col("passed"), weight).otherwise(0))


def judge_alignment(pairs: DataFrame, judge: Column, human: Column, agree: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Flags mean pass. Specificity, recall, agreement on reasons over failed cases, weighted score 3/1/1."""
    share = lambda where, c: F.avg(F.when(where, c.cast("double")))
    g = pairs.groupBy(*keys).agg(share(~human, ~judge).alias("specificity"), share(human, judge).alias("recall"), share(~human, ~judge & agree).alias("reason_agreement"))
    return g.withColumn("score", 3 * F.col("specificity") + F.col("recall") + F.col("reason_agreement"))


def drift_band(judge: DataFrame, raters: DataFrame, metric: str, value: str) -> DataFrame:
    """Alert when the judge falls below the raters' mean minus two deviations, per metric (and slice, if in the key)."""
    band = raters.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    j = judge.select(metric, F.col(value).alias("judge")).join(band, metric)
    return j.withColumn("alert", F.col("judge") < F.col("mean") - 2 * F.col("sd"))


def set_prf(elements: DataFrame, record: str, element: str, predicted: Column, gold: Column) -> DataFrame:
    """Precision and recall per record over distinct sets, macro means, F1 from the means; an empty prediction scores zero.

    Sets stay in rows: flags per (record, element) are combined first, so a huge record is spread over tasks.
    """
    flags = elements.groupBy(record, element).agg(F.max(predicted.cast("int")).alias("p"), F.max(gold.cast("int")).alias("g"))
    per = flags.groupBy(record).agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum(F.col("p") * F.col("g")).alias("hit")).filter("g > 0")
    ratio = lambda d: F.when(F.col(d) > 0, F.col("hit") / F.col(d)).otherwise(0.0)
    g = per.agg(F.count(F.lit(1)).alias("records"), F.avg(ratio("p")).alias("precision"), F.avg(ratio("g")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return g.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def stage_forgetting(scores: DataFrame, task: str, stage: str, score: str) -> DataFrame:
    """Mean final score over tasks and mean drop of the earlier tasks from their best score.

    A task's first stage is where it entered, so the task that entered last is left out of the drop.
    """
    per = scores.groupBy(task).agg(F.max_by(score, stage).alias("final"), F.max(score).alias("best"), F.min(stage).alias("entered"))
    last = scores.agg(F.max(stage)).scalar()
    return per.agg(F.count(F.lit(1)).alias("tasks"), F.avg("final").alias("average"), F.avg(F.when(F.col("entered") < last, F.col("best") - F.col("final"))).alias("forgetting"))


def run_variance(df: DataFrame, model: str, repeat: str, passed: Column) -> DataFrame:
    per = df.groupBy(model, repeat).agg(F.avg(passed.cast("double")).alias("r"))
    return per.groupBy(model).agg(F.count(F.lit(1)).alias("repeats"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), (F.max("r") - F.min("r")).alias("gap"))


def moving_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, parts: int | None = None) -> DataFrame:
    """Mean of the last ``width`` rows at every row: a difference of running sums, joined on the row number."""
    cum = once(running(df, keys, order, {"_sum": value}, number="rn", parts=parts))
    back = cum.select(*keys, (F.col("rn") + width).alias("rn"), F.col("_sum").alias("_old"))
    j = cum.join(back, [*keys, "rn"], "left")
    rate = (F.col("_sum") - F.coalesce("_old", F.lit(0))) / F.least(F.col("rn"), F.lit(width)).cast("double")
    return j.withColumn("moving", rate).drop("_sum", "_old")


def quantile_strata(df: DataFrame, order: Sequence[str], tiles: int, parts: int | None = None) -> DataFrame:
    """Equal-count strata along an order, as ``ntile`` would give, without a global window."""
    r = running(df, [], order, number="_rn", size="_n", parts=parts)
    n = df.agg(F.count(F.lit(1))).scalar()
    q, m = F.floor(n / tiles), n % tiles
    wide = m * (q + 1)
    tile = F.when(F.col("_rn") <= wide, F.floor((F.col("_rn") - 1) / (q + 1))).otherwise(m + F.floor((F.col("_rn") - 1 - wide) / F.greatest(q, F.lit(1)))) + 1
    return r.withColumn("stratum", tile.cast("long")).drop("_rn", "_n")


def iso_ratio_holdout(runs: DataFrame, ratio: Column, compute: Column, tie: Sequence[str], k: int) -> DataFrame:
    """Hold out the k most expensive runs of each constant-ratio slice; the group limit applies before the shuffle."""
    marked = runs.withColumns({"slice": ratio, "compute": compute})
    w = Window.partitionBy("slice").orderBy(F.desc("compute"), *tie)
    top = marked.select("slice", "compute", *tie).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).select("slice", *tie, F.lit(True).alias("_held"))
    return marked.join(top, ["slice", *tie], "left").withColumn("held_out", F.coalesce("_held", F.lit(False))).drop("_held")


def grid_folds(runs: DataFrame, key: Sequence[str], n: str, d: str, seed: str, parts: int | None = None) -> DataFrame:
    """Regime of each run (interpolation, extrapolation in N, in D, far) and its place in random, L-shape and band training sets."""
    qs = lambda c: exact_quantiles(runs, [], c, {"low": 0.25, "high": 0.8}, parts).select(F.struct("low", "high")).scalar()
    qn, qd = qs(n), qs(d)
    N, D = F.col(n), F.col(d)
    regime = F.when((N > qn["high"]) & (D > qd["high"]), "far").when(N > qn["high"], "extrapolation_n").when(D > qd["high"], "extrapolation_d").otherwise("interpolation")
    inside = F.col("regime") == "interpolation"
    draw = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256), 1, 2)
    return runs.withColumn("regime", regime).withColumns(
        {"train_random": inside & (draw < "cc"), "train_l_shape": inside & ((N <= qn["low"]) | (D <= qd["low"])), "train_band": inside & (D <= qd["low"])}
    )


def length_batches(docs: DataFrame, length: str, key: str, budget: int, parts: int | None = None) -> DataFrame:
    """Batches of similar length: cumulative length in length order, cut at multiples of the budget."""
    r = running(docs, [], [length, key], {"_cum": length}, number="_rn", parts=parts)
    return r.withColumn("batch", F.floor((F.col("_cum") - F.col(length)) / budget)).drop("_cum", "_rn")


def hash_order(seed: str, *cols: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]), 256)


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str, fresh: Column | None = None) -> DataFrame:
    """At most n rows per stratum in seeded order, newer items first; the limit applies before the shuffle."""
    first = [F.desc(fresh.cast("int"))] if fresh is not None else []
    w = Window.partitionBy(*strata).orderBy(*first, hash_order(seed, key))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def cumulative_pass(attempts: DataFrame, item: str, k: str, passed: Column, parts: int | None = None) -> DataFrame:
    """Share of items passed after at most k revisions."""
    per = attempts.groupBy(item).agg(F.min(F.when(passed, F.col(k))).alias("first"))
    n = per.agg(F.count(F.lit(1)).cast("double")).scalar()
    counts = once(per.filter("first is not null").groupBy(F.col("first").alias("k")).agg(F.count(F.lit(1)).alias("c")))
    r = running(counts, [], ["k"], {"_cum": "c"}, number="_rn", parts=parts)
    return r.select("k", (F.col("_cum") / n).alias("pass_rate"))


def claims_of(texts: DataFrame, key: Sequence[str], text: Column) -> DataFrame:
    """Every distinct number of a text with its place: ``(key, place, claimed)``; a text without numbers claims nothing.

    Numbers written in two ways, such as 7 and 7.00, are one claim at the first one's place.
    """

    def value(n: Column) -> Column:
        plain = F.translate(n, ",%", "").try_cast("double")
        return F.when(F.endswith(n, F.lit("%")), plain / 100).otherwise(plain)

    return texts.select(*key, F.posexplode(F.array_distinct(F.transform(extract_numbers(text), value))).alias("place", "claimed"))


def claim_vs_log(claims: DataFrame, log: DataFrame, key: Sequence[str], tolerance: float, place: Sequence[str] = ()) -> DataFrame:
    """Claimed numbers against logged ones: unmatched claims are flagged and replaced by the logged value.

    A key may claim several numbers (told apart by ``place``) and log several: each claim meets the logged value nearest to
    it, of equally near ones the smaller. Equal claims and equal logged values of a key are compared once.
    """
    key = list(key)
    pairs = claims.select(*key, "claimed").distinct().join(log.select(*key, F.col("value").alias("logged")).distinct(), key)
    nearest = pairs.groupBy(*key, "claimed").agg(F.min_by("logged", F.struct(F.abs(F.col("claimed") - F.col("logged")), "logged")).alias("logged"))
    j = claims.join(nearest, [*key, "claimed"], "left").select(*key, *place, "claimed", "logged")
    ok = F.coalesce(F.abs(F.col("claimed") - F.col("logged")) <= tolerance, F.lit(False))
    return j.withColumns({"flagged": ~ok, "shown": F.when(ok, F.col("claimed")).otherwise(F.coalesce("logged", "claimed"))})


def failure_classes(panel: DataFrame, family: str, cls: str, failed: Column) -> DataFrame:
    """Share of a family's failures and fail rate per class of violated rule."""
    g = panel.groupBy(family, cls).agg(F.count_if(failed).alias("failures"), F.avg(failed.cast("double")).alias("fail_rate"))
    total = panel.groupBy(family).agg(F.count_if(failed).alias("_t"))
    return g.join(total, family).withColumn("share", F.col("failures") / F.nullif(F.col("_t"), F.lit(0)).cast("double")).drop("_t")


def theme_prevalence(texts: DataFrame, text: str, condition: str, themes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Share of texts per condition that hold any keyword of a theme; the short theme list becomes expressions."""
    low = F.lower(text)
    has = {}
    for theme, words in themes.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w.lower()))
        has[theme] = F.avg(hit.cast("double"))
    g = texts.groupBy(condition).agg(*[c.alias(n) for n, c in has.items()])
    return g.select(condition, _stack({n: F.col(n) for n in has}, "theme", "share")).select(condition, "r.theme", "r.share")


def activity_totals(df: DataFrame, benchmark: str, value: Column, agent: str) -> DataFrame:
    """Counts and means per benchmark with an overall row."""
    return df.rollup(benchmark).agg(F.grouping(benchmark).alias("overall"), F.count(F.lit(1)).alias("n"), F.countDistinct(agent).alias("agents"), F.avg(value).alias("mean"))


def default_strategy(df: DataFrame, benchmark: str, agent: str, order: Sequence[str], strategy: str, parts: int | None = None) -> DataFrame:
    """Share of the most common strategy per benchmark and the mean number of changes per agent."""
    counts = df.groupBy(benchmark, strategy).agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy(benchmark).agg((F.max("c") / F.sum("c")).alias("default_share"))
    steps = shifted(df, [benchmark, agent], order, {"_prev": strategy}, parts=parts)
    changed = (F.col("_prev").isNotNull() & (F.col("_prev") != F.col(strategy))).cast("int")
    per = steps.groupBy(benchmark, agent).agg(F.sum(changed).alias("c"))
    return top.join(per.groupBy(benchmark).agg(F.avg("c").alias("changes_per_agent")), benchmark)


def token_reduction(df: DataFrame, keys: Sequence[str], mode: str, baseline: str, score: Column, tokens: Column) -> DataFrame:
    """Score and mean tokens per mode with the factor against the baseline mode."""
    g = df.groupBy(*keys, mode).agg(F.avg(score).alias("score"), F.avg(tokens).alias("tokens"))
    base = g.filter(F.col(mode) == baseline).select(*keys, F.col("tokens").alias("_b"))
    return g.join(base, list(keys), "left").withColumn("factor", F.col("_b") / F.col("tokens")).drop("_b")


def pass_at_k(attempts: DataFrame, task: str, order: Sequence[str], passed: Column, k: int) -> DataFrame:
    """Any and all of the first k attempts per task, then the mean over tasks that have k attempts."""
    w = Window.partitionBy(task).orderBy(*order)
    first = attempts.select(task, *order, passed.cast("int").alias("_p")).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    per = first.groupBy(task).agg(F.max("_p").alias("any"), F.min("_p").alias("every"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    return per.agg(F.count(F.lit(1)).alias("tasks"), F.avg(F.col("any").cast("double")).alias("pass_at_k"), F.avg(F.col("every").cast("double")).alias("pass_all_k"))


def trace_sample(df: DataFrame, group: str, key: Sequence[str], failed: Column, n: int, seed: str) -> DataFrame:
    """At most n traces per group at three failures to one success, in seeded order."""
    marked = df.withColumn("_f", failed)
    w = Window.partitionBy(group, "_f").orderBy(hash_order(seed, *key), *key)
    top = marked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n * 3 // 4)
    return top.filter(F.col("_f") | (F.col("_rn") <= n // 4)).withColumnRenamed("_f", "failed").drop("_rn")


def best_of_k(samples: DataFrame, condition: str, problem: Sequence[str], order: Sequence[str], score: str, k: int) -> DataFrame:
    """Best score among the first k samples per problem, averaged per condition."""
    w = Window.partitionBy(condition, *problem).orderBy(*order)
    first = samples.select(condition, *dict.fromkeys([*problem, *order, score])).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    per = first.groupBy(condition, *problem).agg(F.max(score).alias("best"))
    return per.groupBy(condition).agg(F.count(F.lit(1)).alias("problems"), F.avg("best").alias("best_of_k"))


def ndcg(ranked: DataFrame, query: str, score: Sequence[Column], gain: str, k: int) -> DataFrame:
    """Discounted gain of the first k by score over that of the first k by gain; both lists are cut before the shuffle."""

    def dcg(order: Sequence[Column], name: str) -> DataFrame:
        w = Window.partitionBy(query).orderBy(*order)
        top = ranked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
        return top.groupBy(query).agg(F.sum(F.col(gain) / F.log2(F.col("_rn") + 1)).alias(name))

    j = dcg(score, "_dcg").join(dcg([F.desc(gain)], "_ideal"), query)
    return j.select(query, F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def archive_best(scores: DataFrame, chain: str, task: str, score: str) -> DataFrame:
    """Mean over tasks of the best score in the archive beside the best single chain."""
    best = scores.groupBy(task).agg(F.max(score).alias("b")).agg(F.avg("b").alias("archive"))
    chains = scores.groupBy(chain).agg(F.avg(score).alias("m"))
    single = chains.agg(F.max(F.struct("m", chain)).alias("s")).scalar()
    return best.select("archive", single["m"].alias("single_chain"), single[chain].alias("chain"))
