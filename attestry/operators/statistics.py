"""Intervals, tests and agreement measures. Each returns one row per group; big inputs are counted before anything is ranked."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.ordering import once, running, span_count, value_ranks
from attestry.session import written

Z95 = 1.959963984540054


def log_gamma(x: Column) -> Column:
    """Stirling series eight steps up, walked back by the recurrence; good to about 1e-12."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = x
    for i in range(1, 8):
        back = back * (x + float(i))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(back)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


# Chebyshev coefficients of the complementary error function, lowest power first (fixed values, relative error below 1.2e-7).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    return t * F.exp(-x * x + poly)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def wilson_ci(df: DataFrame, success: Column, keys: Sequence[str] = ()) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("k"))
    n, p = F.col("n").cast("double"), F.col("k") / F.col("n")
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n))
    centre, scale = p + Z95**2 / (2 * n), 1 + Z95**2 / n
    return g.select(*keys, "n", "k", p.alias("rate"), ((centre - half) / scale).alias("low"), ((centre + half) / scale).alias("high"))


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, for arrays of counts."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    lg = np.vectorize(math.lgamma)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - (lg(a) + lg(b) - lg(a + b))) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return np.where(swap, 1 - front * f, front * f)


def _beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = _beta_cdf(mid, a, b) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _exact_limits(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    k, n = k.to_numpy(float), n.to_numpy(float)
    low = np.where(k == 0, 0.0, _beta_quantile(0.025, np.maximum(k, 1), n - k + 1))
    high = np.where(k == n, 1.0, _beta_quantile(0.975, k + 1, np.maximum(n - k, 1)))
    return pd.DataFrame({"low": low, "high": high})


def clopper_pearson_ci(df: DataFrame, success: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Exact binomial interval; only the counted rows reach the numpy helper."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("k"))
    out = g.withColumn("l", _exact_limits(F.col("k"), F.col("n")))
    return out.select(*keys, "n", "k", (F.col("k") / F.col("n")).alias("rate"), F.col("l.low").alias("low"), F.col("l.high").alias("high"))


def fisher_exact(df: DataFrame, row: Column, col: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sided exact test of two flags. Terms more than 40 deviations from the mean are zero in double and are not generated."""
    c = F.count_if
    g = df.groupBy(*keys).agg(c(row & col).alias("a"), c(row & ~col).alias("b"), c(~row & col).alias("c"), c(~row & ~col).alias("d"))
    r, s, n = F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    mean = r * s / n
    spread = F.ceil(40 * F.sqrt(mean * (n - r) / n + 1)).cast("long") + F.abs(F.col("a") - F.floor(mean))
    low = F.greatest(F.lit(0), r + s - n, F.floor(mean) - spread)
    high = F.least(r, s, F.ceil(mean) + spread)
    term = lambda x: log_choose(r, x) + log_choose(n - r, s - x) - log_choose(n, s)
    terms = g.withColumns({"_obs": term(F.col("a")), "x": F.explode(F.sequence(low, high))})
    keep = F.when(term(F.col("x")) <= F.col("_obs") + 1e-7, F.exp(term(F.col("x")))).otherwise(0.0)
    return terms.groupBy(*keys, "a", "b", "c", "d").agg(F.least(F.lit(1.0), F.sum(keep)).alias("p"))


def mcnemar_exact(df: DataFrame, first: Column, second: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Exact two-sided test on discordant pairs."""
    g = df.groupBy(*keys).agg(F.count_if(first & ~second).alias("b"), F.count_if(~first & second).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    low = F.greatest(F.lit(0), k - F.ceil(40 * F.sqrt(n / 4 + 1)).cast("long"))
    terms = g.withColumn("x", F.explode(F.sequence(low, k)))
    tail = F.sum(F.exp(log_choose(n, F.col("x")) - n * math.log(2)))
    return terms.groupBy(*keys, "b", "c").agg(F.least(F.lit(1.0), 2 * tail).alias("p"))


def mann_whitney(df: DataFrame, value: str, first: Column, second: Column, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """U, z with tie correction and p for two samples picked by flags. Values are counted first, so ties cost one row."""
    counts = once(df.filter(first | second).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("n1")))
    ranked = running(counts, list(keys), [value], {"n_to": "n"}, parts=parts)
    n = F.col("n").cast("double")
    rank = F.col("n_to") - (F.col("n") - 1) / 2
    g = ranked.groupBy(*keys).agg(
        F.sum("n1").alias("n_a"), (F.sum("n") - F.sum("n1")).alias("n_b"), F.sum(F.col("n1") * rank).alias("_r"), F.sum(n * n * n - n).alias("_t")
    )
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    total = a + b
    u = F.col("_r") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * (total + 1 - F.col("_t") / (total * (total - 1))))
    g = g.withColumns({"u": u, "z": (u - a * b / 2) / sd})
    return g.select(*keys, "n_a", "n_b", "u", "z", two_sided_p(F.col("z")).alias("p"))


def kruskal_wallis(df: DataFrame, value: str, group: str, parts: int | None = None) -> DataFrame:
    """H with tie correction over all groups of a column."""
    counts = df.groupBy(value, group).agg(F.count(F.lit(1)).alias("n_g"))
    ranks = value_ranks(df.select(value), [], value, parts).select(value, "avg_rank", "n")
    sums = counts.join(ranks, value).groupBy(group).agg(F.sum("n_g").alias("m"), F.sum(F.col("n_g") * F.col("avg_rank")).alias("r"))
    head = sums.agg(F.sum("m").cast("double").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"))
    t = F.col("n").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t)).scalar()
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - ties / (n * n * n - n))
    return head.select(n.cast("long").alias("n"), "groups", h.alias("h"), (F.col("groups") - 1).alias("df"))


def pairwise_mann_whitney(df: DataFrame, value: str, group: str, contrasts: Sequence[tuple[str, str]]) -> DataFrame:
    """Named contrasts with Bonferroni-adjusted p."""
    out = None
    for a, b in contrasts:
        one = mann_whitney(df, value, F.col(group) == a, F.col(group) == b).select(F.lit(f"{a}-{b}").alias("contrast"), "z", "p")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * len(contrasts)))


def benjamini_hochberg(df: DataFrame, key: str, p: str, parts: int | None = None) -> DataFrame:
    """Adjusted p: the running minimum from the largest p down of p * n / rank."""
    df = once(df)
    flipped = df.withColumn("_neg", -F.col(p)).withColumn("_nk", -F.col(key))
    n = df.agg(F.count(F.lit(1))).scalar()
    ranked = running(flipped, [], ["_neg", "_nk"], number="_rn", parts=parts).withColumn("_q", F.col(p) * n / (n - F.col("_rn") + 1))
    ranked = once(ranked)
    folded = running(ranked, [], ["_neg", "_nk"], lows={"_low": "_q"}, number="_r2", parts=parts)
    return folded.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("_low"))).drop("_neg", "_nk", "_rn", "_q", "_r2", "_low")


def loglog_slope(df: DataFrame, x: Column, y: Column, keys: Sequence[str] = (), knot: float | None = None) -> DataFrame:
    """Scaling exponent with its interval; with a fixed knot, the slopes on both sides and their difference."""
    lx, ly = F.ln(x), F.ln(y)
    aggs = [F.count(F.lit(1)).alias("n"), F.regr_slope(ly, lx).alias("slope"), F.regr_r2(ly, lx).alias("r2"), F.regr_sxx(ly, lx).alias("_sxx"), F.regr_syy(ly, lx).alias("_syy")]
    if knot is not None:
        low, high = x <= knot, x >= knot
        aggs += [F.regr_slope(F.when(low, ly), F.when(low, lx)).alias("slope_low"), F.regr_slope(F.when(high, ly), F.when(high, lx)).alias("slope_high")]
    g = df.groupBy(*keys).agg(*aggs)
    se = F.sqrt((F.col("_syy") - F.col("slope") ** 2 * F.col("_sxx")) / (F.col("n") - 2) / F.col("_sxx"))
    out = [*keys, "n", "slope", "r2", (F.col("slope") - Z95 * se).alias("low"), (F.col("slope") + Z95 * se).alias("high")]
    if knot is not None:
        out += ["slope_low", "slope_high", (F.col("slope_high") - F.col("slope_low")).alias("delta")]
    return g.select(*out)


POISSON_CUTS = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1)) for i in range(8)]


def poisson_weight(digits: Column) -> Column:
    """How often a unit is drawn, from eight hex digits: inverse of the Poisson distribution with mean one.

    Hex text of one length orders like the number, so nothing is converted.
    """
    return sum(((digits >= f"{math.ceil(c * 2**32):08x}").cast("int") for c in POISSON_CUTS), F.lit(0))


def cluster_bootstrap(clusters: DataFrame, cluster: str, top: str, bottom: str, draws: int, seed: str, keys: Sequence[str] = ()) -> DataFrame:
    """Interval of sum(top) / sum(bottom) over clusters drawn with replacement; one row per cluster comes in.

    Each cluster draws its own weight from a digest of seed, cluster and draw, so a draw needs no shared state and the
    draws add up in partial sums: what is shuffled is one row per task and draw. Eight draws share one digest.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(cluster).cast("string"), F.col("_block").cast("string")), 256)
    # Each small row becomes hundreds of draws, so the rows are spread evenly first.
    clusters = clusters.repartition(span_count(clusters, None), cluster)
    blocks = clusters.select(*keys, cluster, top, bottom, F.explode(F.sequence(F.lit(0), F.lit((draws + 7) // 8 - 1))).alias("_block"))
    hexed = blocks.withColumn("_d", digest).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    draw = (F.col("_block") * 8 + F.col("_i")).alias("draw")
    drawn = hexed.select(*keys, top, bottom, draw, poisson_weight(F.substring("_d", F.col("_i") * 8 + 1, F.lit(8))).alias("_w"))
    sums = drawn.groupBy(*keys, "draw").agg((F.sum(F.col(top) * F.col("_w")) / F.sum(F.col(bottom) * F.col("_w"))).alias("s"))
    stats = sums.filter(F.col("draw") < draws)
    # At most `draws` values per key from here on.
    return stats.groupBy(*keys).agg(F.median("s").alias("median"), F.percentile("s", 0.025).alias("low"), F.percentile("s", 0.975).alias("high"))


def _stratum(strata: Sequence[str]) -> Column:
    """One text per stratum; a null is a stratum of its own."""
    return F.concat_ws(":", F.lit(""), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in strata])


def resampled(clusters: DataFrame, cluster: str, draws: int, seed: str, strata: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Exact draws with replacement inside strata: ``(_stratum, cluster, draw, weight)`` for what each draw holds.

    In every draw each stratum is as large as it is. Slot ``i`` of a stratum takes the cluster whose number is a digest of
    seed, stratum, slot and draw, so a draw needs no shared state; one row per cluster and draw is shuffled, never a
    cluster's own rows. Four draws share one digest. Null clusters are left out.
    Numbers follow the clusters' own order, or that of a hash where they are no numbers.
    """
    named = once(clusters.filter(F.col(cluster).isNotNull()).select(_stratum(strata).alias("_stratum"), cluster).distinct())
    whole = isinstance(clusters.schema[cluster].dataType, T.NumericType)
    named = named if whole else once(named.withColumn("_h", F.xxhash64(F.col(cluster))))
    numbered = once(running(named, ["_stratum"], [cluster if whole else "_h"], number="_i", size="_n", parts=parts))
    digest = F.sha2(F.concat(F.lit(seed), "_stratum", F.lit(":"), F.col("_i").cast("string"), F.lit(":"), F.col("_block").cast("string")), 256)
    slots = numbered.repartition(span_count(numbered, None), "_stratum", cluster).select("_stratum", "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit((draws + 3) // 4 - 1))).alias("_block"))
    picks = slots.withColumn("_d", digest).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    number = F.conv(F.substring("_d", F.col("_j") * 13 + 1, F.lit(13)), 16, 10).cast("long")
    taken = picks.select("_stratum", (F.col("_block") * 4 + F.col("_j")).alias("draw"), (number % F.col("_n") + 1).alias("_i")).filter(F.col("draw") < draws)
    weights = taken.groupBy("_stratum", "draw", "_i").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(numbered.select("_stratum", "_i", cluster), ["_stratum", "_i"]).select("_stratum", cluster, "draw", "weight")


def with_weights(rows: DataFrame, weights: DataFrame, strata: Sequence[str], cluster: str) -> DataFrame:
    """``rows`` once per draw that holds their cluster, with ``draw`` and ``weight``."""
    return rows.withColumn("_stratum", _stratum(strata)).join(weights, ["_stratum", cluster]).drop("_stratum")


def resampled_ratios(rows: DataFrame, cluster: str, measures: Mapping[str, tuple[str, str]], draws: int, seed: str, strata: Sequence[str] = (), pairs: Sequence[tuple[str, str]] = (), parts: int | None = None) -> DataFrame:
    """Intervals ``(statistic, median, low, high, excludes_zero)`` of sum(top) / sum(bottom) per measure, and of differences of ``pairs``.

    ``rows`` holds one row per cluster. All measures of a draw see the same clusters, so a difference is paired by cluster.
    """
    drawn = with_weights(rows, resampled(rows, cluster, draws, seed, strata, parts), strata, cluster)
    ratio = {n: F.sum(F.col(a) * F.col("weight")) / F.sum(F.col(b) * F.col("weight")) for n, (a, b) in measures.items()}
    sums = drawn.groupBy("draw").agg(*[r.alias(f"_m{i}") for i, r in enumerate(ratio.values())])
    at = {n: F.col(f"_m{i}") for i, n in enumerate(measures)}
    every = at | {f"{a} - {b}": at[a] - at[b] for a, b in pairs}
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), v.cast("double").alias("v")) for n, v in every.items()])).alias("r")).select("r.*")
    out = long.groupBy("statistic").agg(F.median("v").alias("median"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def confusion(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance over any set of labels."""
    table = confusion(df, a, b)
    both = table.groupBy("a").agg(F.sum("n").alias("n_a")).join(table.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("n_b")), "a")
    expected = both.agg(F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0))).scalar()
    g = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    n = F.col("n").cast("double")
    po, pe = F.col("agree") / n, expected / (n * n)
    return g.select("n", po.alias("observed"), pe.alias("expected"), ((po - pe) / (1 - pe)).alias("kappa"))


def item_agreement(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """Share of agreeing rater pairs per item with at least two ratings."""
    counts = ratings.groupBy(item, label).agg(F.count(F.lit(1)).alias("c"))
    g = counts.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).filter("n > 1")
    return g.select(item, ((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1)).cast("double")).alias("agreement"), F.lit(1).alias("one"))


def free_marginal_kappa(ratings: DataFrame, item: str, label: str, categories: int, draws: int, seed: str) -> DataFrame:
    """Randolph's multirater kappa with a bootstrap interval over items."""
    per_item = item_agreement(ratings, item, label)
    chance = 1.0 / categories
    ci = cluster_bootstrap(per_item, item, "agreement", "one", draws, seed).select(F.struct("low", "high")).scalar()
    scale = lambda x: (x - chance) / (1 - chance)
    g = per_item.agg(F.count(F.lit(1)).alias("items"), F.avg("agreement").alias("observed"))
    return g.select("items", "observed", scale(F.col("observed")).alias("kappa"), scale(ci["low"]).alias("low"), scale(ci["high"]).alias("high"))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Rank correlation with average ranks; rows with equal (x, y) are counted together before ranks are joined."""
    keys = list(keys)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("c"))
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = value_ranks(both, keys, x, parts).select(*keys, x, F.col("avg_rank").alias("rx"), "n_all")
    ry = value_ranks(both, keys, y, parts).select(*keys, y, F.col("avg_rank").alias("ry"))
    j = pairs.join(rx, [*keys, x]).join(ry, [*keys, y])
    mean = (F.col("n_all") + 1) / 2.0
    dx, dy, c = F.col("rx") - mean, F.col("ry") - mean, F.col("c")
    g = j.groupBy(*keys).agg(F.sum(c).alias("n"), F.sum(c * dx * dy).alias("_xy"), F.sum(c * dx * dx).alias("_xx"), F.sum(c * dy * dy).alias("_yy"))
    return g.select(*keys, "n", (F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"))


def normal_ci(df: DataFrame, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = Z95 * F.col("sd") / F.sqrt("n")
    return g.select(*keys, "n", "mean", "sd", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def mape_r2(df: DataFrame, predicted: Column, actual: Column, regime: str, interpolation: str) -> DataFrame:
    """Mean absolute relative error in percent per evaluation set; R2 only on the interpolation set."""
    g = df.groupBy(regime).agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg(F.abs(predicted - actual) / actual)).alias("mape"),
        F.sum((predicted - actual) ** 2).alias("_sse"),
        (F.var_pop(actual) * F.count(actual)).alias("_sst"),
    )
    return g.select(regime, "n", "mape", F.when(F.col(regime) == interpolation, 1 - F.col("_sse") / F.col("_sst")).alias("r2"))


def huber_grid_fit(runs: DataFrame, n: str, d: str, loss: str, grid: Sequence[Mapping[str, float]], fold: str, delta: float = 0.05) -> DataFrame:
    """Huber loss in log space of every parameter point of a fixed grid, and the best point per fold.

    The grid is a short list of constants, so each run meets it inside its own task and only sums per point are shuffled.
    """
    points = F.array(*[F.struct(F.lit(i).alias("point"), *[F.lit(float(p[k])).alias(k) for k in ("A", "B", "E", "alpha", "beta")]) for i, p in enumerate(grid)])
    each = runs.select(fold, n, d, loss, F.explode(points).alias("g"))
    predicted = F.col("g.A") / F.pow(F.col(n), F.col("g.alpha")) + F.col("g.B") / F.pow(F.col(d), F.col("g.beta")) + F.col("g.E")
    r = F.abs(F.ln(predicted) - F.ln(F.col(loss)))
    huber = F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta))
    scored = each.groupBy(fold, "g.point").agg(F.sum(huber).alias("loss"), F.count(F.lit(1)).alias("n"))
    return scored.groupBy(fold).agg(F.min(F.struct("loss", "point", "n")).alias("b")).select(fold, "b.point", "b.loss", "b.n")


def opt_ratio(a: Column, b: Column, alpha: Column, beta: Column, compute: Column) -> Column:
    """Compute-optimal ratio D/N in closed form."""
    s = alpha + beta
    return F.pow(F.lit(6.0), (beta - alpha) / s) * F.pow(beta * b / (alpha * a), 2 / s) * F.pow(compute, (alpha - beta) / s)


def classification_prf(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Precision, recall and F1 per class, with macro F1 and accuracy of the whole on every row."""
    table = confusion(df, predicted, gold)
    p = table.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("n_p"))
    g = table.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("n_g"))
    hit = table.filter("a = b").select(F.col("a").alias("label"), F.col("n").alias("tp"))
    j = p.join(g, "label", "full_outer").join(hit, "label", "left").na.fill(0, ["n_p", "n_g", "tp"])
    tp = F.col("tp").cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = j.select("label", ratio(tp, F.col("n_p")).alias("precision"), ratio(tp, F.col("n_g")).alias("recall"), ratio(2 * tp, F.col("n_p") + F.col("n_g")).alias("f1"), "tp", "n_g")
    whole = per.select(F.struct(F.avg("f1").alias("macro"), (F.sum("tp") / F.sum("n_g")).alias("accuracy"))).scalar()
    return per.select("label", "precision", "recall", "f1", whole["macro"].alias("macro_f1"), whole["accuracy"].alias("accuracy"))


def threshold_gates(df: DataFrame, criteria: Sequence[tuple[str, Column, float, str]]) -> DataFrame:
    """(criterion, aggregate, threshold, at_least | at_most) to rows with observed value and pass; one pass over the data."""
    g = df.agg(*[c.cast("double").alias(f"c{i}") for i, (_, c, _, _) in enumerate(criteria)])
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("observed"), ((F.col(f"c{i}") >= t) if s == "at_least" else (F.col(f"c{i}") <= t)).alias("passed")) for i, (n, _, t, s) in enumerate(criteria)])
    return g.select(F.explode(rows).alias("r")).select("r.*")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Test of independence: statistic, degrees of freedom and p."""
    table = confusion(df, a, b)
    rows = table.groupBy("a").agg(F.sum("n").alias("n_a"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n_b"))
    total = table.agg(F.sum("n").cast("double")).scalar()
    # Empty cells add their expected count, which sums to total minus the expected counts of the filled cells.
    cells = table.join(rows, "a").join(cols, "b").withColumn("e", F.col("n_a").cast("double") * F.col("n_b") / total)
    g = cells.agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("_x"), F.sum("e").alias("_e"), F.countDistinct("a").alias("_ra"), F.countDistinct("b").alias("_rb"))
    g = g.select((F.col("_x") + total - F.col("_e")).alias("chi2"), ((F.col("_ra") - 1) * (F.col("_rb") - 1)).alias("df"))
    return g.withColumn("p", chi_square_tail(F.col("chi2"), F.col("df")))


def chi_square_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution, by the regularised incomplete gamma function.

    Below ``df / 2 + 1`` the lower part is summed as a series, above it the upper part is a continued fraction, taken from
    its far end. In its own range each settles within a number of steps that grows with the square root of ``df``.
    """
    h, k = x / 2, df / 2.0
    steps = (F.lit(120) + 12 * F.sqrt(k)).cast("int")
    scale = F.exp(k * F.ln(h) - h - log_gamma(k))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), steps), start, lambda acc, i: F.struct((acc["term"] * h / (k + i)).alias("term"), (acc["sum"] + acc["term"] * h / (k + i)).alias("sum")), lambda acc: acc["sum"])
    fraction = F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), h + 2 * steps + 1 - k, lambda acc, i: h + 2 * i - 1 - k + i * (k - i) / acc)
    upper = F.when(h < k + 1, 1 - scale / k * series).otherwise(scale / fraction)
    return F.when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), upper)))


def paired_t(df: DataFrame, delta: Column, keys: Sequence[str] = ()) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean"), F.var_samp(delta).alias("_v"))
    return g.select(*keys, "n", "mean", (F.col("mean") / F.sqrt(F.col("_v") / F.col("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def welch_t(df: DataFrame, value: Column, first: Column, second: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Unequal-variance t with its degrees of freedom."""
    a, b = F.when(first, value), F.when(second, value)
    g = df.groupBy(*keys).agg(*[f(c).alias(f"{n}{s}") for s, c in (("a", a), ("b", b)) for n, f in (("n_", F.count), ("m_", F.avg), ("v_", F.var_samp))])
    qa, qb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    df_ = (qa + qb) ** 2 / (qa**2 / (F.col("n_a") - 1) + qb**2 / (F.col("n_b") - 1))
    return g.select(*keys, "n_a", "n_b", ((F.col("m_a") - F.col("m_b")) / F.sqrt(qa + qb)).alias("t"), df_.alias("df"))


def icc_1_1(df: DataFrame, target: str, value: str) -> DataFrame:
    """One-way intraclass correlation over repeats; unequal repeats use the usual average repeat count."""
    per = df.groupBy(target).agg(F.count(value).alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    k = F.col("k").cast("double")
    g = per.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(k).alias("t"), F.sum(k * k).alias("k2"), F.sum(k * F.col("m")).alias("s"), F.sum(k * F.col("m") * F.col("m")).alias("q"), F.sum(k * F.col("v")).alias("w"))
    k0 = (F.col("t") - F.col("k2") / F.col("t")) / (F.col("n") - 1)
    msb = (F.col("q") - F.col("s") * F.col("s") / F.col("t")) / (F.col("n") - 1)
    msw = F.col("w") / (F.col("t") - F.col("n"))
    return g.select(F.col("n").cast("long").alias("targets"), msb.alias("ms_between"), msw.alias("ms_within"), ((msb - msw) / (msb + (k0 - 1) * msw)).alias("icc"))


def pair_wins(df: DataFrame, winner: str, loser: str) -> DataFrame:
    """Wins per ordered pair."""
    return df.filter(F.col(winner) != F.col(loser)).groupBy(F.col(winner).alias("winner"), F.col(loser).alias("loser")).agg(F.count(F.lit(1)).alias("wins"))


def bradley_terry(wins: DataFrame, rounds: int, per_write: int = 3) -> DataFrame:
    """Strengths from pair wins by minorise-maximise steps, each a join of the pair table with the strengths of both sides.

    The strengths are written every ``per_write`` rounds, which bounds the plan.
    """
    ways = wins.select(F.col("winner").alias("name"), F.col("loser").alias("other"), F.col("wins").alias("won"), F.col("wins").alias("games"))
    ways = ways.union(wins.select("loser", "winner", F.lit(0).cast("long"), "wins"))
    games = written(ways.groupBy("name", "other").agg(F.sum("won").alias("won"), F.sum("games").alias("games")), "games")
    strength = games.select("name").distinct().withColumn("strength", F.lit(1.0))
    for n in range(1, rounds + 1):
        both = games.join(strength, "name").join(strength.toDF("other", "theirs"), "other")
        raw = both.groupBy("name").agg((F.sum("won") / F.sum(F.col("games") / (F.col("strength") + F.col("theirs")))).alias("strength"))
        if n % per_write and n < rounds:
            # The sum of strengths is free until a round that is written.
            strength = raw
        else:
            raw = written(raw, "strengths")
            strength = raw.withColumn("strength", F.col("strength") / raw.agg(F.sum("strength")).scalar())
    return strength
