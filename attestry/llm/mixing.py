"""Mixing sources to target weights by the cube method.

A source is taken ``ratio = target / size`` times: every text ``floor(ratio)`` times, and once more with the fractional
chance. The cube method settles those chances: three texts at a time move along the one direction in which neither
their words nor their number change, until one of them is settled. Texts are flown in blocks that bound a task; what
few chances stay open in each block are pooled and flown again, and the last two of a source are landed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attestry.llm.common import words
from attestry.session import written

EPS = 1e-9


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Sources (``source, n, source_size``) with ``place`` from 0 by code point, null last; no task sees them all."""
    dealt = written(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_part", F.spark_partition_id()), "sources")
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # a row per partition
    before, at = [], 0
    for part in sorted(counts):
        before += [F.lit(part), F.lit(at)]
        at += counts[part]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").isNull(), "source")) - 1
    offset = F.create_map(*before)[F.col("_part")] if before else F.lit(0)
    return dealt.withColumn("place", (inside + offset).cast("long")).drop("_part")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target``: ``total`` of all words shared by weight, capped at ``most`` times the source's own, the excess reshared."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    known = written(sources.withColumn("weight", weight), "sources")
    share, n_capped = 0.0, -1
    while True:
        # The share of one unit of weight only grows from round to round, so what is capped stays capped.
        above = F.col("weight") * F.lit(share) > most * F.col("source_size")
        r = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, most * F.col("source_size"))).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("free"), F.count(F.when(above, 1)).alias("n")).head()
        if r.n == n_capped or not r.free:
            break
        n_capped, share = r.n, (total * (r["all"] or 0) - (r.capped or 0.0)) / r.free
    return known.withColumn("target", F.least(F.col("weight") * F.lit(share), most * F.col("source_size")).cast("double")).drop("weight")


def flight(size: np.ndarray, chance: np.ndarray, seed: int) -> np.ndarray:
    """Chances after the flight: at most two stay between 0 and 1, and the sums of chance and of size times chance stay."""
    p, draw = chance.astype(float).copy(), np.random.Generator(np.random.PCG64(seed))
    open_, coming = [], iter(range(len(p)))
    while True:
        while len(open_) < 3:
            k = next(coming, None)
            if k is None:
                break
            if EPS < p[k] < 1 - EPS:
                open_.append(k)
        if len(open_) < 3:
            break
        a, b, c = (float(size[k]) for k in open_)
        u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(open_, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(open_, u) if x)
        t = up if draw.random() * (up + down) < down else -down
        for k, x in zip(open_, u):
            p[k] = min(1.0, max(0.0, p[k] + t * x))
            p[k] = 0.0 if p[k] < EPS else 1.0 if p[k] > 1 - EPS else p[k]
        open_ = [k for k in open_ if 0 < p[k] < 1]
    return p


def landing(size: np.ndarray, chance: np.ndarray, want: float) -> np.ndarray:
    """Settle the last open texts so that the words come nearest to ``want``, ties by order.

    All outcomes of the open texts (two at most) are tried; then one taken text may change places with one that is not,
    which keeps the number of texts, if that brings the words nearer.
    """
    at = np.flatnonzero((chance > 0) & (chance < 1))
    out = chance.copy()
    off = lambda x: abs(float((size[at] * np.array(x)).sum()) + float(size[chance == 1].sum()) - want)
    if len(at):
        out[at] = min(itertools.product((0.0, 1.0), repeat=len(at)), key=lambda x: (off(x), x))
    taken, free = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
    missing = want - float(size[taken].sum())
    if len(taken) and len(free):
        after = np.abs(size[free][None, :] - size[taken][:, None] - missing)
        k = int(after.argmin())
        if after.flat[k] < abs(missing):
            out[taken[k // len(free)]], out[free[k % len(free)]] = 0.0, 1.0
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, block: int = 1000) -> DataFrame:
    """One row per row of ``docs``: key, source, ``digest`` (hash of the text), ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` counts words (null and empty texts: 0; such texts are taken 0 times or more without effect). Reruns agree:
    blocks and draws come from hashes, and rows that agree in key, source and text are exchangeable. A null key is a key
    like any other, null is a source of its own (last in order). An empty table gives an empty result. Other columns are
    not read. ``most`` times its size is the most that is taken of a text, since no ratio exceeds it.
    """
    size = F.size(words(F.col(f"`{text}`")))
    each = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("digest"), size.cast("long").alias("size"))
    # Equal rows are one row with a count: however many there are, one fractional chance of them is left.
    rows = written(each.groupBy("key", "source", "digest", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    sources = ranked_sources(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("times")).alias("source_size")))
    goal = written(targets(sources, weights, total, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    lots = goal.select(F.col("source").alias("_s"), "place", "n", "source_size", "target", ratio.alias("ratio"))
    now = rows.join(lots, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("ratio", F.col("ratio") * F.col("times"))
    now = now.withColumns({"whole": F.floor("ratio").cast("long"), "chance": F.col("ratio") - F.floor("ratio")}).drop("ratio")
    schema = T.StructType([*now.drop("n").schema.fields, T.StructField("last", T.BooleanType()), T.StructField("block", T.LongType())])
    turn, settled = 0, []

    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "digest", "key"], kind="stable", na_position="first").reset_index(drop=True)
        size, chance = frame["size"].to_numpy(float), frame["chance"].to_numpy(float)
        place, block_, last = int(frame["place"].iloc[0]), int(frame["block"].iloc[0]), bool(frame["last"].iloc[0])
        # Sizes are met in a mixed order, so that the three open texts differ.
        order = np.random.Generator(np.random.PCG64(len(frame))).permutation(len(frame))
        p = np.empty(len(frame))
        p[order] = flight(size[order], chance[order], abs(hash((place, block_, turn))))
        frame["chance"] = landing(size, p, float((size * chance).sum())) if last and chance.any() else p
        return frame

    while True:
        n_blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
        cut = now.withColumn("last", n_blocks == 1).withColumn("block", F.pmod(F.xxhash64("key", "digest", F.lit(turn)), n_blocks)).drop("n")
        flown = written(cut.groupBy("place", "block").applyInPandas(fly, schema), "flown")
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.filter(~open_))
        rest = flown.filter(open_).drop("last", "block")
        if rest.isEmpty():
            break
        now = rest.join(rest.groupBy("place").agg(F.count(F.lit(1)).alias("n")), "place").select(*cut.drop("last", "block").columns, "n")
        turn += 1
    done = settled[0]
    for more in settled[1:]:
        done = done.union(more)
    # Equal rows share their copies evenly, the first ones take one more.
    done = done.withColumn("all", F.col("whole") + F.col("chance").cast("long")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    copies = (F.floor(F.col("all") / F.col("times")) + (F.col("i") <= F.col("all") % F.col("times")).cast("long")).cast("long").alias("copies")
    return done.select(F.col("key").alias(key), F.col("source").alias(source), "digest", "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its ``copies``; rows equal in key, source and text share theirs. Columns pass through."""
    told = mix(docs, key, text, source, **options).groupBy(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col("digest").alias("_d")).agg(F.sum("copies").alias("_n")).filter("_n > 0")
    told = written(told, "copies").hint("merge")
    # The row travels as one value, so that no column of it can be mistaken for one made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").cast("string").alias("_source"), F.xxhash64(F.col(f"`{text}`")).alias("_digest"))
    once = rows.join(told, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_digest") == F.col("_d"))).dropDuplicates(["_k", "_s", "_d"])
    return once.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
