"""How text rules are born, live and die across versions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import bind
from attestry.operators.ordering import exact_quantiles, once, running, span_count
from attestry.operators.statistics import resampled, with_weights
from attestry.session import written


def rule_key(col: Column) -> Column:
    """Equality key without case, white space and markdown punctuation."""
    return F.regexp_replace(F.lower(col), r"[\s*_`#>~|.,;:!?()\[\]-]+", "")


def _match_equal(rules: DataFrame, keep: Sequence[str], key: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """Pair the n-th old rule with the n-th new rule of the same key; returns the pairs and what is left over.

    The rows arrive partitioned by file, and every step here groups by the file first, so nothing is shuffled. Both results
    come from one written table, which holds texts only where they are left over.
    """
    nth = Window.partitionBy(*keep, "side", key).orderBy("i")
    numbered = rules.withColumn("_nth", F.row_number().over(nth))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    # Texts that are the key need no aggregation of their own.
    texts = [] if key == "t" else [of("o", "t").alias("_to"), of("n", "t").alias("_tn")]
    g = numbered.groupBy(*keep, key, "_nth").agg(of("o", "i").alias("old_at"), of("n", "i").alias("new_at"), *texts)
    both = F.col("old_at").isNotNull() & F.col("new_at").isNotNull()
    left_text = F.col("t") if key == "t" else F.coalesce("_to", "_tn")
    g = written(g.select(*keep, "old_at", "new_at", F.when(~both, left_text).alias("t")), stage)
    pairs = g.filter(both).select(*keep, "old_at", "new_at", F.lit(stage).alias("stage"), F.lit(100).alias("score"))
    left = g.filter(~both).select(*keep, F.when(F.col("old_at").isNotNull(), "o").otherwise("n").alias("side"), F.coalesce("old_at", "new_at").alias("i"), "t")
    return pairs, _by_file(left, keep).withColumn("k", rule_key(F.col("t")))


def _by_file(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Files dealt over all partitions: matching costs far more than its bytes tell, so small shares are not merged."""
    return df.repartition(span_count(df, None), *keep)


def version_match(pairs: DataFrame, keep: Sequence[str], old: str, new: str, cut: int = 70) -> DataFrame:
    """Rules of two versions of one file, matched by exact text, then by key, then by similarity above ``cut`` percent.

    Rows are spread by file. The first two stages are counts; only the few rules they leave over meet each other,
    inside their own file, where the best pair is taken first and a rule matches once. A file is one row of input, which
    bounds the group. Result rows: ``(old_at, new_at, stage, score)`` with stage exact, normalised, similar, death, birth.
    """
    side = lambda c, s: F.transform(c, lambda x, i: F.struct(F.lit(s).alias("side"), i.alias("i"), x.alias("t")))
    rules = pairs.select(*keep, F.explode(F.concat(side(old, "o"), side(new, "n"))).alias("r")).select(*keep, "r.*")
    rules = _by_file(rules, keep)
    exact, rest = _match_equal(rules, keep, "t", "exact")
    normalised, rest = _match_equal(rest, keep, "k", "normalised")
    held = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("i", "t", F.length("t").alias("len"))))
    left = rest.groupBy(*keep).agg(held("o").alias("o"), held("n").alias("n"))

    def scored(o: Column, n: Column) -> Column:
        longest = F.greatest(o["len"], n["len"], F.lit(1))
        # The distance stops counting once it can no longer reach the cut (-1).
        edits = F.call_function("levenshtein", o["t"], n["t"], F.floor(longest * (100 - cut) / 100).cast("int"))
        score = bind(edits, lambda e: F.when(e < 0, 0).otherwise(100 - F.floor(100 * e / longest)))
        return F.struct((-score).cast("long").alias("s"), o["i"].alias("o"), n["i"].alias("n"))

    # Lengths alone rule most pairs out before any distance is computed.
    near = lambda o, n: F.abs(o["len"] - n["len"]) * 100 <= (100 - cut) * F.greatest(o["len"], n["len"])
    met = F.flatten(F.transform(F.col("o"), lambda o: F.transform(F.filter(F.col("n"), lambda n: near(o, n)), lambda n: scored(o, n))))
    left = left.withColumn("_met", F.array_sort(F.filter(met, lambda p: p["s"] < -cut)))
    start = F.array().cast("array<struct<s:bigint,o:int,n:int>>")
    taken = lambda acc, p: F.exists(acc, lambda a: (a["o"] == p["o"]) | (a["n"] == p["n"]))
    left = left.withColumn("_best", F.aggregate("_met", start, lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.array_append(acc, p))))
    free = lambda items, s: F.filter(items, lambda x: ~F.exists(F.col("_best"), lambda p: p[s] == x["i"]))
    row = lambda o, n, stage, score: F.struct(o.cast("int").alias("old_at"), n.cast("int").alias("new_at"), F.lit(stage).alias("stage"), score.cast("int").alias("score"))
    none = F.lit(None)
    out = F.concat(
        F.transform("_best", lambda p: row(p["o"], p["n"], "similar", -p["s"])),
        F.transform(free(F.col("o"), "o"), lambda x: row(x["i"], none, "death", none)),
        F.transform(free(F.col("n"), "n"), lambda x: row(none, x["i"], "birth", none)),
    )
    fuzzy = left.select(*keep, F.explode(out).alias("m")).select(*keep, "m.*")
    return exact.unionByName(normalised).unionByName(fuzzy)


def migration_match(deaths: DataFrame, births: DataFrame) -> DataFrame:
    """Deaths whose text turns up in another file of the repository at the same commit.

    Births are folded to one row per text first, so a common text never pairs up all its files.
    """
    key = ["repo", "commit", "text"]
    seen = births.groupBy(*key).agg(F.min("file").alias("_lo"), F.max("file").alias("_hi"))
    j = deaths.join(seen, key, "left")
    moved = F.coalesce((F.col("_lo") != F.col("file")) | (F.col("_hi") != F.col("file")), F.lit(False))
    return j.withColumn("migrated", moved).drop("_lo", "_hi")


def number_versions(df: DataFrame, file: str, at: str, parts: int | None = None) -> DataFrame:
    """Dense version numbers from 1 over the distinct moments of each file."""
    return running(once(df.select(file, at).distinct()), [file], [at], number="version", parts=parts)


def build_spells(presence: DataFrame, file: str, item: str, version: str = "version", parts: int | None = None) -> DataFrame:
    """Unbroken runs of presence: birth and last version, the version of death, and whether the end is only the file's end."""
    rows = once(presence.select(file, item, version).distinct())
    numbered = running(rows, [file, item], [version], number="_rn", parts=parts)
    runs = numbered.groupBy(file, item, (F.col(version) - F.col("_rn")).alias("_island")).agg(F.min(version).alias("birth"), F.max(version).alias("last"))
    ends = presence.groupBy(file).agg(F.max(version).alias("_end"))
    j = runs.join(ends, file)
    censored = F.col("last") == F.col("_end")
    return j.select(file, item, "birth", "last", F.when(~censored, F.col("last") + 1).alias("death"), (F.col("last") - F.col("birth") + 1).alias("age"), F.when(censored, "censored").otherwise("deleted").alias("exit_kind"))


def rewrite_censor(spells: DataFrame, presence: DataFrame, file: str, item: str, share: float = 0.5, floor: int = 5, version: str = "version") -> DataFrame:
    """Deaths in a version where at least ``share`` of at least ``floor`` live items die at once become censored rewrites."""
    live = presence.groupBy(file, (F.col(version) + 1).alias("death")).agg(F.countDistinct(item).alias("_live"))
    dead = spells.filter("death is not null").groupBy(file, "death").agg(F.count(F.lit(1)).alias("_dead"))
    rewrites = dead.join(live, [file, "death"]).filter((F.col("_live") >= floor) & (F.col("_dead") >= share * F.col("_live"))).select(file, "death", F.lit(1).alias("_rw"))
    j = spells.join(rewrites, [file, "death"], "left")
    return j.withColumn("exit_kind", F.when(F.col("_rw").isNotNull(), "rewrite").otherwise(F.col("exit_kind"))).drop("_rw")


def event_study(panel: DataFrame, file: str, version: str, size: str, event: Column, w: int, parts: int | None = None) -> DataFrame:
    """Median size around a file's first event, relative to the version before it, over files seen at every offset."""
    first = panel.filter(event).groupBy(file).agg(F.min(version).alias("_at"))
    grid = first.select(file, "_at", F.explode(F.sequence(F.lit(-w), F.lit(w))).alias("offset")).withColumn(version, F.col("_at") + F.col("offset"))
    near = grid.join(panel.select(file, version, size), [file, version])
    whole = near.groupBy(file).agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("offset") == -1, F.col(size))).alias("_base")).filter(F.col("_n") == 2 * w + 1)
    rel = near.join(whole, file).filter("_base > 0").select("offset", F.round(F.col(size) / F.col("_base"), 9).alias("relative"))
    n = rel.groupBy("offset").agg(F.count(F.lit(1)).alias("files"))
    return n.join(exact_quantiles(rel, ["offset"], "relative", {"median": 0.5}, parts), "offset")


def lifetime_growth(panel: DataFrame, file: str, version: str, measures: Sequence[str], cells: int = 10, parts: int | None = None) -> DataFrame:
    """Measures relative to each file's own first version, averaged over cells of normalised lifetime."""
    numbered = running(panel, [file], [version], number="_rn", size="_n", parts=parts).filter("_n > 1")
    first = panel.groupBy(file).agg(F.min(F.struct(version, *measures)).alias("_f"))
    j = numbered.join(first, file)
    cell = F.round((F.col("_rn") - 1) / (F.col("_n") - 1) * cells).cast("long").alias("cell")
    return j.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(m) / F.nullif(F.col(f"_f.{m}"), F.lit(0)).cast("double")).alias(m) for m in measures])


def nelson_aalen(spells: DataFrame, age: str, event: Column, parts: int | None = None) -> DataFrame:
    """Risk set, events, hazard and cumulative hazard per age; spells are counted by exit age before anything is ordered."""
    exits = once(spells.groupBy(F.col(age).alias("age")).agg(F.count(F.lit(1)).alias("_out"), F.count_if(event).alias("events")))
    back = running(exits.withColumn("_neg", -F.col("age")), [], ["_neg"], {"at_risk": "_out"}, number="_rn", parts=parts)
    hazard = once(back.select("age", "at_risk", "events", (F.col("events") / F.col("at_risk")).alias("hazard")))
    return running(hazard, [], ["age"], {"cumulative": "hazard"}, number="_rn", parts=parts).drop("_rn")


def smoothed_hazard(table: DataFrame, bandwidth: float = 2.0, upto: int = 50) -> DataFrame:
    """Epanechnikov-smoothed rate at ages 0 to ``upto``; points with less than one event in reach are dropped."""
    grid = table.select("age", "hazard", "events", F.explode(F.sequence(F.lit(0), F.lit(upto))).alias("point"))
    u = (F.col("point") - F.col("age")) / bandwidth
    near = grid.filter(F.abs(u) < 1)
    g = near.groupBy("point").agg(F.sum(0.75 * (1 - u * u) * F.col("hazard") / bandwidth).alias("rate"), F.sum("events").alias("events"))
    return g.filter("events >= 1")


def hazard_draws(spells: DataFrame, age: str, event: Column, repo: str, draws: int, seed: str, strata: Sequence[str] = (), bandwidth: float = 2.0, upto: int = 50, parts: int | None = None) -> DataFrame:
    """Smoothed hazard ``(draw, point, rate, events)`` in every bootstrap draw of whole repositories inside strata.

    Weights meet the counts of a repository's exits per age, so a draw never meets a spell: rows are repository by age by
    draw, and from the first sum on draw by age. Ages beyond reach of the last point only add to the risk set.
    """
    top = upto + math.ceil(bandwidth)
    seen = F.least(F.col(age), F.lit(top))
    counts = once(spells.groupBy(*strata, repo, seen.alias("age")).agg(F.count(F.lit(1)).alias("out"), F.count_if(event & (F.col(age) < top)).alias("events")))
    drawn = with_weights(counts, resampled(counts, repo, draws, seed, strata, parts), strata, repo)
    sums = drawn.groupBy("draw", "age").agg(F.sum(F.col("weight") * F.col("out")).alias("out"), F.sum(F.col("weight") * F.col("events")).alias("events"))
    # At most ``top`` rows per draw from here on.
    older = Window.partitionBy("draw").orderBy(F.desc("age"))
    hazard = sums.withColumn("hazard", F.col("events") / F.sum("out").over(older)).filter(F.col("age") < top)
    near = hazard.withColumn("point", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("age") - bandwidth)), F.least(F.lit(upto), F.ceil(F.col("age") + bandwidth)))))
    u = (F.col("point") - F.col("age")) / bandwidth
    rates = near.filter(F.abs(u) < 1).groupBy("draw", "point").agg(F.sum(0.75 * (1 - u * u) * F.col("hazard") / bandwidth).alias("rate"), F.sum("events").alias("events"))
    return rates.filter("events >= 1")


def hazard_bands(rates: DataFrame) -> DataFrame:
    """Median and 2.5 / 97.5 percentiles of the rate per age over the draws."""
    return rates.groupBy("point").agg(F.count(F.lit(1)).alias("draws"), F.median("rate").alias("median"), F.percentile("rate", 0.025).alias("low"), F.percentile("rate", 0.975).alias("high"))


def hazard_slope(rates: DataFrame) -> DataFrame:
    """Interval of the slope of the log rate over age."""
    slopes = rates.filter("rate > 0").groupBy("draw").agg(F.regr_slope(F.ln("rate"), F.col("point").cast("double")).alias("slope"))
    return slopes.agg(F.count("slope").alias("draws"), F.median("slope").alias("median"), F.percentile("slope", 0.025).alias("low"), F.percentile("slope", 0.975).alias("high"))


def risk_table(spells: DataFrame, age: str, event: Column, covariates: Sequence[str], upto: int = 50) -> DataFrame:
    """Person-time and events per age interval and covariates, cut off at ``upto``."""
    each = spells.withColumn("_event", event).select(*covariates, age, "_event", F.explode(F.sequence(F.lit(1), F.least(F.col(age), F.lit(upto)))).alias("interval"))
    died = F.col("_event") & (F.col("interval") == F.col(age))
    return each.groupBy(*covariates, "interval").agg(F.count(F.lit(1)).alias("person_time"), F.count_if(died).alias("events"))
