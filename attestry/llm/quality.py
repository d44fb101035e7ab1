"""Quality rules with adaptive thresholds: quantile sketches per language and source instead of fixed cutoffs.

A sketch is a table of counts per bucket, so that sketches merge by adding. Buckets are log-linear: a value stands in its
bucket with a relative error of at most 1/32, values under 64 exactly. All measures are whole numbers, so results do not
depend on the order in which rows arrive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry.llm.common import SPACE, bound, words
from attestry.session import written

# Fixed value: signs counted as symbols.
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A text fails where ``measure`` is over median + ``width`` * spread (with ``below``: or under median - ``width`` * spread).

    The spread is the median less the lower quartile, at least ``least``: junk stands on the upper side, so up to half of
    a group may be junk without moving the threshold, and a group in which all texts agree still leaves room.
    """

    measure: str
    least: int
    width: int = 6
    below: bool = False


RULES = (Rule("symbol_rate", 50), Rule("dup_line_rate", 750), Rule("repeat_rate", 750), Rule("mean_length", 30, below=True))


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the array ``w``."""
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def again(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | ((k > 0) & F.coalesce(F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False))))
        return bound(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(pairs, again))

    return bound(hashes, counted)


def measured(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """Base counts and the measures of the rules, one row per row of ``docs``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    flat = F.translate(t, SPACE, " " * len(SPACE))
    told = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, SPACE, " " * len(SPACE)))) > 0)
    lines = bound(told, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counts = bound(words(F.col(f"`{text}`")), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
    first = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"),
        counts.alias("_w"), lines.alias("_l"), F.length(F.translate(flat, " ", "")).alias("word_chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
    )
    rows = first.select("key", "lang", "source", F.col("_w.n").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"), F.col("_l.dup").cast("long").alias("n_dup_lines"), F.col("_w.again").cast("long").alias("n_repeat_words"), F.col("_l.n").cast("long").alias("n_lines"))
    share = lambda a, b, unit: F.floor(F.col(a) * unit / F.greatest(F.col(b), F.lit(1))).cast("long")
    return rows.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_rate": share("n_symbols", "word_chars", 10_000), "dup_line_rate": share("n_dup_lines", "n_lines", 10_000),
        "repeat_rate": share("n_repeat_words", "n_words", 10_000), "mean_length": share("word_chars", "n_words", 100),
    })


def bucket(v: Column) -> Column:
    """Bucket of a whole number from 0: itself under 64, then 32 buckets per doubling."""
    e = (F.length(F.bin(v)) - 6).cast("int")
    return F.when(v < 64, v).otherwise(32 * e.cast("long") + F.floor(v / F.pow(F.lit(2.0), e)).cast("long"))


def edge(b: Column) -> Column:
    """Smallest value of a bucket."""
    e = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise(((F.pmod(b, F.lit(32)) + 32) * F.pow(F.lit(2.0), e)).cast("long"))


def sketches(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``keys, measure, bucket, n``: the sketch of every measure in every group."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in measures])
    return rows.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*").groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """``keys, measure, size`` and the asked quantiles (smallest bucket that holds the share). A group has a bounded number of buckets."""
    own = Window.partitionBy(*keys, "measure")
    upto = sketch.withColumn("_to", F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(own))
    return upto.groupBy(*keys, "measure").agg(F.max("_all").alias("size"), *[F.min(F.when(F.col("_to") >= F.ceil(p * F.col("_all")), edge(F.col("bucket")))).alias(name) for name, p in probs.items()])


def thresholds(rows: DataFrame, rules: tuple[Rule, ...] = RULES, enough: int = 100) -> DataFrame:
    """``lang, source`` and per rule ``<measure>_hi`` (and ``_lo``): from the group's own sketch, the language's (its sources merged)
    where the group has fewer than ``enough`` texts, or that of all texts where the language has."""
    names = [r.measure for r in rules]
    fine = written(sketches(rows, ["lang", "source"], names), "sketches")
    wide = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = fine.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    probs = {"q25": 0.25, "q50": 0.5}
    packed = lambda df, keys: df.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.struct("q25", "q50"))).alias(m) for m in names], F.max("size").alias("size"))
    a = packed(quantiles(fine, ["lang", "source"], probs), ["lang", "source"])
    b = packed(quantiles(wide, ["lang"], probs), ["lang"]).select(F.col("lang").alias("_lang"), *[F.col(m).alias(f"b_{m}") for m in names], F.col("size").alias("b_size"))
    c = packed(quantiles(whole.withColumn("_one", F.lit(1)), ["_one"], probs), ["_one"]).select("_one", *[F.col(m).alias(f"c_{m}") for m in names])
    joined = a.join(b, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("_one", F.lit(1)).join(c, "_one")
    out = []
    for r in rules:
        q = F.when(F.col("size") >= enough, F.col(r.measure)).when(F.col("b_size") >= enough, F.col(f"b_{r.measure}")).otherwise(F.col(f"c_{r.measure}"))
        room = r.width * F.greatest(q["q50"] - q["q25"], F.lit(r.least))
        out += [(q["q50"] + room).alias(f"{r.measure}_hi")] + ([(q["q50"] - room).alias(f"{r.measure}_lo")] if r.below else [])
    return joined.select("lang", "source", *out)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", rules: tuple[Rule, ...] = RULES, enough: int = 100) -> DataFrame:
    """One row per row of ``docs``: key, the base counts, ``base_failed``, ``failed`` (names of broken rules), ``kept``.

    Sketches hold the texts that pass the base rule. Null and empty texts have counts of 0 and fail the base rule; texts are
    counted whole; null languages and sources are groups of their own; repeated rows are judged one by one and counted
    as often; a group without a passing text has no threshold and only the base rule; an empty table gives an empty result.
    Other columns are not read.
    """
    rows = written(measured(docs, key, text, lang, source), "measures")
    limits = written(thresholds(rows.filter(~F.col("base_failed")), rules, enough), "thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    met = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    broken = []
    for r in rules:
        bad = F.col(r.measure) > F.col(f"{r.measure}_hi")
        broken.append(F.when(bad | (F.col(r.measure) < F.col(f"{r.measure}_lo")) if r.below else bad, F.lit(r.measure)))
    failed = F.array_compact(F.array(*broken))
    out = met.select(F.col("key").alias(key), *BASE, "base_failed", failed.alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
