"""Near copies, shared passages, benchmark leakage, distinctive wording, style, selection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.text import grams, tokens
from attestry.operators.ordering import exact_quantiles, once, running, span_count
from attestry.operators.retrieval import dot, neighbour_join, norm
from attestry.session import shared_folder, spread, written


def exact_dedup(df: DataFrame, key: str, canonical: Column) -> DataFrame:
    """First row per canonical text with the number of copies; digests travel, not texts."""
    return df.groupBy(F.sha2(canonical, 256).alias("digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def gram_set(text: Column, n: int) -> Column:
    """Distinct n-grams of words as 64-bit hashes."""
    return F.array_distinct(F.transform(grams(tokens(text), n), lambda g: F.xxhash64(g)))


def shared_with_seeds(docs: DataFrame, key: str, seeds: DataFrame, seed: str, n: int, marker: Column | None = None) -> DataFrame:
    """Documents sharing an n-gram with a seed, with the number of distinct shared grams; a marker counts on its own.

    Documents meet seeds through grams of seeds alone, so a gram common among documents costs nothing by itself.
    """
    wanted = seeds.select(F.col(seed), F.explode(F.array_distinct(grams(tokens(F.col("text")), n))).alias("gram"))
    have = spread(docs.select(key, "text")).select(F.col(key), F.explode(F.array_distinct(grams(tokens(F.col("text")), n))).alias("gram"))
    out = have.join(wanted, "gram").groupBy(key, seed).agg(F.count(F.lit(1)).alias("shared"))
    if marker is None:
        return out
    kind = out.schema[seed].dataType
    return out.unionByName(docs.filter(marker).select(key, F.lit(None).cast(kind).alias(seed), F.lit(0).cast("long").alias("shared")))


def decontaminate(train: DataFrame, key: str, bench: DataFrame, item: str, n: int) -> DataFrame:
    """Per training text the highest share of a benchmark item's n-grams it holds, zero when none."""
    sizes = bench.select(F.col(item), F.array_distinct(grams(tokens(F.col("text")), n)).alias("g")).filter(F.size("g") > 0)
    wanted = sizes.select(item, F.size("g").alias("_n"), F.explode("g").alias("gram"))
    have = spread(train.select(key, "text")).select(F.col(key), F.explode(F.array_distinct(grams(tokens(F.col("text")), n))).alias("gram"))
    hits = have.join(wanted, "gram").groupBy(key, item, "_n").agg(F.count(F.lit(1)).alias("c"))
    best = hits.groupBy(key).agg(F.max(F.col("c") / F.col("_n")).alias("similarity"))
    return train.select(key).join(best, key, "left").select(key, F.round(F.coalesce("similarity", F.lit(0.0)), 9).alias("similarity"))


def decontaminate_vectors(train: DataFrame, key: str, vector: str, bench: DataFrame, bench_vector: str) -> DataFrame:
    """Per training vector the highest cosine with any benchmark vector, exact: ``(key, similarity)``.

    Vectors without a direction (null or zero) have similarity 0, as has everything where the benchmark is empty. Keys are
    unique. Equal vectors are compared once; pivots and the triangle inequality leave out most of the rest.
    """
    held = written(bench.filter(norm(F.col(bench_vector)) > 0).select(F.xxhash64(bench_vector).alias("id"), F.col(bench_vector).cast("array<double>").alias("v")).distinct(), "bench")
    asked = train.filter(norm(F.col(vector)) > 0).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    out = train.select(key)
    if held.isEmpty() or asked.isEmpty():
        return out.withColumn("similarity", F.lit(0.0))
    best = neighbour_join(held, "id", "v", 1, asked).select(F.col("id").alias(key), "similarity")
    return out.join(best, key, "left").select(key, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


# Similarity levels reported for leakage (fixed values).
LEVELS = [0.7, 0.75, 0.8, 0.9, 0.95]


def leakage_report(best: DataFrame, value: str = "similarity", parts: int | None = None) -> DataFrame:
    """Mean, median, exact matches and the share above each level."""
    best = once(best.select(value))
    shares = [F.avg((F.col(value) > c).cast("double")).alias(f"above_{int(c * 100)}") for c in LEVELS]
    g = best.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.count_if(F.col(value) >= 1).alias("exact"), *shares)
    return g.withColumn("median", exact_quantiles(best, [], value, {"m": 0.5}, parts).scalar())


def near_copies(docs: DataFrame, key: str, text: str, n: int = 3, threshold: float = 0.7) -> DataFrame:
    """Documents whose n-gram Jaccard similarity with any document of smaller key exceeds the threshold: ``(key, near_copy)``.

    Exact for every document. Equal gram sets are settled by grouping. The others use prefix filtering: with grams
    ordered from rare to common, two sets above the threshold share one of their first few. Each document is first
    compared with the smallest key of each of its lists, which settles a crowd of copies in linear work; only documents
    that are still open meet the rest of their lists.
    """
    sets = spread(docs.select(key, text)).select(F.col(key).alias("id"), F.array_sort(gram_set(F.col(text), n)).alias("s")).filter(F.size("s") > 0)
    sets = written(sets.withColumn("d", F.sha2(F.to_json("s"), 256)), "grams")
    lead = sets.groupBy("d").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    copies = written(sets.select("id", "d").join(lead, "d").filter("id <> lead").select("id"), "copies")
    leads = written(sets.join(copies, "id", "left_anti").select("id", "s"), "leads")
    # A gram of one document can join nobody; it still counts for the length of the prefix, where it stands in front. Nearly
    # all grams are such, so they are counted as bare hashes and only those that may be shared travel with their document.
    shared = leads.select(F.explode("s").alias("g")).repartition("g").groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    shared = written(shared, "shared")
    flags = hash_filter(shared, "g")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s")
            g, n = s.flatten(), pc.list_value_length(s)
            at = np.flatnonzero(_passes(flags, g.to_numpy(zero_copy_only=False).view(np.uint64)))
            row = pa.array(np.repeat(np.arange(len(s)), n.to_numpy())[at])
            yield pa.record_batch([batch.column("id").take(row), n.take(row), g.take(pa.array(at))], ["id", "n", "g"])

    long = leads.mapInArrow(passing, T.StructType([leads.schema["id"], T.StructField("n", T.IntegerType()), T.StructField("g", T.LongType())]))
    mine = Window.partitionBy("id")
    prefix = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    ranked = long.join(shared, "g").withColumn("_rn", F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "g")))
    posts = written(ranked.filter(F.col("_rn") <= prefix).select("id", "n", "g"), "posts")

    def similar(pairs: DataFrame) -> DataFrame:
        """Open ids among candidate pairs (id, other) that prove similar."""
        # Once written, few pairs are known to be few, and sets that meet nobody stay where they lie.
        pairs = written(pairs, "pairs")
        met = written(pairs.select(F.explode(F.array("id", "other")).alias("id")).distinct(), "met")
        a = leads.join(met, "id", "left_semi")
        b = a.select(F.col("id").alias("other"), F.col("s").alias("t"))
        both = pairs.join(a, "id").join(b, "other")
        common = F.size(F.array_intersect("s", "t"))
        return both.filter(common / (F.size("s") + F.size("t") - common).cast("double") > threshold).select("id").distinct()

    close = (F.col("m") >= F.col("n") * threshold) & (F.col("m") * threshold <= F.col("n"))
    head = posts.groupBy("g").agg(F.min(F.struct("id", "n")).alias("h"))
    first = posts.join(head, "g").filter(F.col("id") > F.col("h.id")).select("id", "n", F.col("h.id").alias("other"), F.col("h.n").alias("m")).filter(close).select("id", "other").distinct()
    settled = written(similar(first), "settled")
    still = posts.join(settled, "id", "left_anti")
    rest = still.join(posts.select(F.col("id").alias("other"), F.col("n").alias("m"), "g"), "g").filter((F.col("other") < F.col("id")) & close).select("id", "other").distinct()
    found = copies.unionByName(settled).unionByName(similar(rest.join(first, ["id", "other"], "left_anti")))
    return docs.select(key).join(found.select(F.col("id").alias(key), F.lit(True).alias("near_copy")), key, "left").withColumn("near_copy", F.coalesce("near_copy", F.lit(False)))


def diverse_select(items: DataFrame, key: str, text: str, fitness: Column, k: int, weight: float = 0.5, n: int = 3) -> DataFrame:
    """k items in turn: the fittest first, then by fitness and least Jaccard distance to those already chosen.

    One pass per chosen item; the driver sees one row each time, and the running distance is written between passes.
    """
    base = items.select(key, gram_set(F.col(text), n).alias("s"), fitness.cast("double").alias("f"))
    lo_hi = base.select(F.struct(F.min("f").alias("lo"), F.max("f").alias("hi"))).scalar()
    scaled = (F.col("f") - lo_hi["lo"]) / F.nullif(lo_hi["hi"] - lo_hi["lo"], F.lit(0.0))
    state = written(base.select(key, "s", F.coalesce(scaled, F.lit(0.0)).alias("f"), F.lit(1.0).alias("d")), "select")
    chosen = []
    for turn in range(k):
        score = F.col("f") if turn == 0 else F.round(F.col("f") * (1 - weight) + F.col("d") * weight, 9)
        best = state.filter(~F.col(key).isin([c[0] for c in chosen])).orderBy(F.desc(score), key).select(key, score.alias("x"), "s").limit(1).collect()
        if not best:
            break
        chosen.append((best[0][0], turn + 1, float(best[0][1])))
        if turn + 1 < k:
            other = F.lit(list(best[0][2])).cast("array<bigint>")
            common = F.size(F.array_intersect("s", other))
            union = F.size("s") + len(best[0][2]) - common
            distance = F.when(union > 0, 1 - common / union.cast("double")).otherwise(0.0)
            state = written(state.withColumn("d", F.least("d", distance)), "select")
    schema = T.StructType([items.schema[key], T.StructField("turn", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return items.sparkSession.createDataFrame(chosen, schema)


def _lots(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in lots of at most ``words`` words; a text of more is a lot of its own."""
    for batch in batches:
        ends, start, done = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False)), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + words, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def _runs(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length up to ``most``: length, starts of the word runs that stay inside their text, and a 64-bit hash of each."""
    w = batch.column("w")
    flat = w.flatten().dictionary_encode()
    texts = np.repeat(np.arange(len(w)), pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False))
    word = pd.util.hash_array(flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)
    h = word
    for n in range(1, most + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[n - 1 :]
        at = np.flatnonzero(texts[: len(h)] == texts[n - 1 :])
        yield n, at, h[at]


LOG_BITS = 27


def _bits(t: np.ndarray, log_bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << log_bits) - 1)
    return [t & mask, (t >> np.uint64(log_bits)) & mask]


def hash_filter(hashes: DataFrame, h: str, log_bits: int = LOG_BITS) -> np.ndarray:
    """A Bloom filter of 64-bit hashes, of a fixed size (16 MB): it lets every one of them pass, and few others while it is not full."""
    mask = F.lit((1 << log_bits) - 1)
    places = F.array(F.col(h).bitwiseAND(mask), F.shiftrightunsigned(h, log_bits).bitwiseAND(mask))
    words = hashes.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    flags = np.zeros(1 << (log_bits - 6), np.int64)
    flags[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return flags


def _passes(flags: np.ndarray, h: np.ndarray, log_bits: int = LOG_BITS) -> np.ndarray:
    bits, ok = flags.view(np.uint64), np.ones(len(h), bool)
    for p in _bits(h, log_bits):
        ok &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def frequent_grams(marked: DataFrame, group: str, most: int, least: int, log_bits: int = LOG_BITS, lot: int = 1 << 19) -> DataFrame:
    """``(group, gram, y, b)`` with every gram of 1 to ``most`` words that occurs ``least`` times or more; rarer ones may be among them.

    ``marked(group, _bg, w)``. Rare grams are nearly all of the distinct ones, so they travel as counted hashes only: a
    hash seen too rarely belongs to rare grams alone. The frequent hashes set the bits of a filter of a fixed size (16 MB),
    and only grams that pass it are counted as texts. A full filter lets more rare grams through and loses none. A task
    holds the grams of ``lot`` words at once, however long the texts of a batch are.
    """
    kind = marked.schema[group].dataType

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches, lot):
            for _, _, h in _runs(batch, most):
                values, n = np.unique(h, return_counts=True)
                yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    # Tasks have counted already; counting again before the shuffle would find next to nothing to add up.
    often = marked.select("w").mapInArrow(hashes, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    flags = hash_filter(often, "h", log_bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches, lot):
            w, groups = batch.column("w"), batch.column(group)
            flat = w.flatten()
            texts = np.repeat(np.arange(len(w)), pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False))
            word = flat.dictionary_encode().indices.to_numpy()
            code = groups.dictionary_encode(null_encoding="encode").indices.to_numpy()
            back = batch.column("_bg").to_numpy(zero_copy_only=False)
            for n, at, h in _runs(batch, most):
                at = at[_passes(flags, h, log_bits)]
                if not len(at):
                    continue
                same = {"g": code[texts[at]], **{f"w{j}": word[at + j] for j in range(n)}}
                f = pd.DataFrame(same | {"at": at, "b": back[texts[at]].astype(np.int64)}).groupby(list(same), sort=False).agg(at=("at", "first"), y=("at", "size"), b=("b", "sum"))
                first = f["at"].to_numpy()
                parts = [flat.take(pa.array(first + j)) for j in range(n)]
                gram = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                yield pa.record_batch([groups.take(pa.array(texts[first])), gram, pa.array(f["y"].to_numpy(np.int64)), pa.array(f["b"].to_numpy(np.int64))], [group, "gram", "y", "b"])

    schema = T.StructType([T.StructField(group, kind), T.StructField("gram", T.StringType()), T.StructField("y", T.LongType()), T.StructField("b", T.LongType())])
    return marked.mapInArrow(counted, schema).groupBy(group, "gram").agg(F.sum("y").alias("y"), F.sum("b").alias("b"))


def distinctive_ngrams(docs: DataFrame, group: str, text: str, background: Column, least: int = 10, top: int = 40, prior: float = 1000.0) -> DataFrame:
    """The most distinctive 1- to 3-grams of each group: log-odds z against a fixed background with a Dirichlet prior."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    marked = spread(docs.select(F.col(group), F.coalesce(background, F.lit(False)).alias("_bg"), text)).select(group, "_bg", words.alias("w"))
    counts = written(frequent_grams(marked, group, 3, least), "grams")
    pool = counts.groupBy("gram").agg(F.sum("y").alias("all"), F.sum("b").alias("back")).filter(F.col("all") >= least)
    kept = written(counts.join(pool, "gram"), "kept")
    totals = kept.groupBy(group).agg(F.sum("y").alias("n"))
    # The groups' counts of a gram add up to the pool's.
    whole = kept.select(F.struct(F.sum("y").cast("double").alias("all"), F.sum("b").cast("double").alias("back"))).scalar()
    a = F.col("all") / whole["all"] * prior
    odds = lambda y, n: F.ln((y + a) / (n + prior - y - a))
    z = (odds(F.col("y"), F.col("n")) - odds(F.col("back"), whole["back"])) / F.sqrt(1 / (F.col("y") + a) + 1 / (F.col("back") + a))
    scored = kept.join(totals, group).select(group, "gram", "y", F.round(z, 9).alias("z"))
    w = Window.partitionBy(group).orderBy(F.desc("z"), "gram")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def list_overlap(top: DataFrame, group: str) -> DataFrame:
    """Jaccard similarity of the groups' lists; each list is at most ``top`` long, and pairs arise only from shared grams."""
    top = written(top, "lists")
    a, b = top.select(F.col(group).alias("a"), "gram"), top.select(F.col(group).alias("b"), "gram")
    common = a.join(b, "gram").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    size = top.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    j = common.join(size.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common")).cast("double")).alias("jaccard"))


def style_auc(texts: DataFrame, text: str, label: str, problem: str, folds: int = 5, features: int = 1 << 18, steps: int = 8) -> DataFrame:
    """AUC per fold of a logistic regression on hashed character 3- to 5-gram counts of unit length; problems never straddle folds."""
    # Signs are taken apart once: a substring counts its place from the text's start, which makes long texts cost their square.
    d = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism).select(F.col(label).cast("double").alias("label"), F.pmod(F.xxhash64(problem), F.lit(folds)).cast("int").alias("fold"), F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0)).alias("c"))
    starts = lambda n: F.when(F.size("c") >= n, F.sequence(F.lit(0), F.size("c") - n))
    pieces = lambda n: F.coalesce(F.transform(starts(n), lambda i: F.concat(*[F.get("c", i + j) for j in range(n)])), F.array().cast("array<string>"))
    d = d.select("label", "fold", F.concat(*[pieces(n) for n in (3, 4, 5)]).alias("g"))
    hashed = HashingTF(inputCol="g", outputCol="tf", numFeatures=features).transform(d)
    ready = written(Normalizer(inputCol="tf", outputCol="features", p=2.0).transform(hashed).select("label", "fold", "features"), "style", block=1 << 20)
    score = BinaryClassificationEvaluator(metricName="areaUnderROC")
    out = []
    for fold in range(folds):
        model = LogisticRegression(maxIter=steps, regParam=0.01, standardization=False).fit(ready.filter(F.col("fold") != fold))
        held = ready.filter(F.col("fold") == fold)
        n = held.groupBy().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("l")).head()
        if n.l == 2:
            out.append((fold, n.n, float(score.evaluate(model.transform(held)))))
    return texts.sparkSession.createDataFrame(out, "fold int, n long, auc double")


def keyword_candidates(posts: DataFrame, text: str, spam: Column, families: Mapping[str, str]) -> DataFrame:
    """Counts kept at each step: all, without the spam campaign, in any keyword family, and per family. Families are patterns."""
    clean = ~spam
    hit = {n: F.col(text).rlike(p) for n, p in families.items()}
    some = F.lit(False)
    for h in hit.values():
        some = some | h
    steps = {"all": F.lit(True), "without spam": clean, "candidates": clean & some, **{f"family:{n}": clean & h for n, h in hit.items()}}
    g = posts.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(steps.values())])
    return g.select(F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.col(f"c{i}").alias("n")) for i, n in enumerate(steps)])).alias("r")).select("r.*")


def stitch(items: DataFrame, key: str, vector: str, length: str, target: int, k: int = 32, overshoot: float = 1.25, width: int | None = None) -> DataFrame:
    """Chains of similar items up to a target length, over the whole table: ``(chain, place, key, used)``; every item is in one chain.

    The ``width`` smallest unused keys seed chains (by default as many as the unused length fills; with 1 the chains come
    one after the other). In each round every open chain asks for the candidate nearest to its centroid, by cosine, ties to
    the smaller key; candidates are the unused among the ``k`` nearest neighbours of its members. An item that several ask
    for goes to the smallest seed, the others ask again. A chain without candidates gets the ``k`` unused items nearest to
    its centroid for the next round. It closes at the target; its last item is cut where it would pass the overshoot limit.

    A round costs a few joins on what the open chains ask for; the neighbour graph is built once. Items without a
    direction (null or zero vectors) are chains of their own; null lengths count as 0; null keys are left out.
    """
    spark = items.sparkSession
    v, size = F.col(vector).cast("array<double>"), norm(F.col(vector).cast("array<double>"))
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("len"), F.when(size > 0, F.transform(v, lambda x: x / size)).alias("z"))
    rows = written(rows, "items")
    good = rows.filter("z is not null")
    graph = written(neighbour_join(good.select("id", "z"), "id", "z", k).select("id", "neighbour"), "graph") if not good.isEmpty() else None
    out, like = shared_folder(spark, "chains"), f"chain {rows.schema['id'].dataType.simpleString()}, place int, id {rows.schema['id'].dataType.simpleString()}, used long"
    spark.createDataFrame([], like).write.parquet(out)
    placed = lambda: spark.read.schema(like).parquet(out)
    unused = lambda d, c: d.join(placed().select(F.col("id").alias(c)), c, "left_anti")
    cut = lambda total: F.least(F.col("len"), F.greatest(F.lit(0), F.lit(int(overshoot * target)) - total)).cast("long")
    while True:
        left = unused(rows, "id")
        rest = left.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len")).head()
        if not rest.n:
            return placed().select("chain", "place", F.col("id").alias(key), "used")
        seeds = written(left.orderBy("id").limit(width or max(1, -(-rest.len // target))), "seeds")
        seeds.select(F.col("id").alias("chain"), F.lit(1).alias("place"), "id", cut(F.lit(0)).alias("used")).write.mode("append").parquet(out)
        chains = seeds.select(F.col("id").alias("chain"), F.lit(1).alias("place"), F.col("len").alias("total"), F.col("z").alias("sum"))
        fresh, wishes = seeds.select(F.col("id").alias("chain"), "id"), None
        while graph is not None:
            open_ = chains.filter((F.col("total") < target) & F.col("sum").isNotNull())
            # Wishes are kept without their vectors, which would make up nearly all that the rounds write.
            near = unused(fresh.join(graph, "id").select("chain", F.col("neighbour").alias("id")), "id")
            wishes = near if wishes is None else unused(wishes, "id").unionByName(near)
            wishes = written(wishes.join(open_.select("chain"), "chain", "left_semi").dropDuplicates(["chain", "id"]), "wishes")
            score = F.round(dot(F.col("sum"), F.col("z")) / norm(F.col("sum")), 9)
            best = wishes.join(good, "id").join(open_.select("chain", "sum"), "chain").groupBy("chain").agg(F.max_by(F.struct("id", "len", "z"), F.struct(score, -F.col("id"))).alias("b")).select("chain", "b.*")
            won = best.groupBy("id").agg(F.min("chain").alias("chain"))
            picks = best.join(won, ["id", "chain"], "left_semi")
            asked = open_.join(best.select("chain", F.lit(True).alias("_asked")), "chain", "left").join(picks.withColumnRenamed("id", "_pick"), "chain", "left")
            grown = F.when(F.col("_pick").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "z", lambda a, b: a + b))
            turn = written(asked.select("chain", "place", "total", grown.alias("sum"), "_pick", "len", F.coalesce("_asked", F.lit(False)).alias("asked")), "turn")
            told = turn.agg(F.count(F.lit(1)).alias("open"), F.count_if(~F.col("asked")).alias("empty"), F.count("_pick").alias("picked")).head()
            taken = turn.filter("_pick is not null").select("chain", (F.col("place") + 1).alias("place"), F.col("_pick").alias("id"), "len", "total")
            if told.picked:
                taken.select("chain", "place", "id", cut(F.col("total")).alias("used")).write.mode("append").parquet(out)
            fresh = taken.select("chain", "id")
            chains = turn.select("chain", (F.col("place") + F.col("_pick").isNotNull().cast("int")).alias("place"), (F.col("total") + F.coalesce("len", F.lit(0))).alias("total"), "sum")
            if told.empty:
                pool = written(unused(good, "id"), "pool")
                asking = written(turn.filter("not asked").select(F.col("chain").alias("id"), F.col("sum").alias("z")), "asking")
                if not pool.isEmpty():
                    more = neighbour_join(pool.select("id", "z"), "id", "z", k, asking).select(F.col("id").alias("chain"), F.col("neighbour").alias("id"))
                    wishes = wishes.unionByName(more)
                elif not told.picked:
                    break
            if not told.open:
                break


def _over(x: np.ndarray, y: float) -> np.ndarray:
    """``x > y`` in Spark's order, where NaN is the largest value."""
    return (x > y) | (np.isnan(x) & (not np.isnan(y)))


def _leaves_inside(part: pd.DataFrame, most: int, rounds: int, lopsided: float) -> pd.DataFrame:
    """All further splits of one leaf that fits a task, by the rules of ``split_topics``: ``(_h, leaf)``."""
    part = part.sort_values("_h", ignore_index=True)
    z, w = np.stack(part["z"].to_numpy()).astype(float), part["w"].to_numpy()
    out, todo = np.empty(len(part), object), [(part["leaf"][0], np.arange(len(part)))]
    while todo:
        leaf, at = todo.pop()
        if w[at].sum() <= most or len(at) == 1:
            out[at] = leaf
            continue
        v = z[at]
        towards = np.round(v[1:] @ v[0], 9)
        far = 1 + int(np.argmin(np.where(np.isnan(towards), np.inf, towards)))
        ends = centres = v[0], v[far]
        for turn in range(rounds + 1):
            sizes = [np.sqrt(c @ c) for c in centres]
            # Without a direction of a centre nothing leans.
            lean = np.round(v @ centres[1] / sizes[1] - v @ centres[0] / sizes[0], 9) if all(s != 0 for s in sizes) else None
            side = np.zeros(len(at), bool) if lean is None else _over(lean, 0.0)
            if turn < rounds:
                centres = tuple(np.average(v[m], axis=0, weights=w[at][m]) if m.any() else e for m, e in zip((~side, side), ends))
        if lean is not None and not lopsided <= side.mean() <= 1 - lopsided:
            side = _over(lean, np.sort(lean)[(len(at) + 1) // 2 - 1])
        side[0], side[far] = False, True
        todo += [(f"{leaf}0", at[~side]), (f"{leaf}1", at[side])]
    return pd.DataFrame({"_h": part["_h"], "leaf": out})


def split_topics(items: DataFrame, key: str, vector: str, most: int, rounds: int = 3, lopsided: float = 1 / 16, inside: int | None = None) -> DataFrame:
    """Leaves of at most ``most`` items by repeated bisection on embeddings: key, ``topic`` (number of splits), ``leaf`` (its sides).

    All leaves of a level that are too large are split at once, and only these: two far members are the first centres, a
    few rounds of cosine 2-means follow, and a split that leaves a side with less than ``lopsided`` of its leaf is made at
    the median between the centres instead, so that levels grow with the logarithm of the table. Centres are joined by
    leaf and never reach the driver. A leaf of at most ``inside`` classes (by default what 32 MB hold) is split to the end
    inside one task, by the same rules, so that the levels over the whole table end there. Equal vectors are one counted class that stays together, however large; so do
    vectors without a direction (null or zero), as topic -1. Null keys stay; an empty table gives an empty result.
    """
    v = F.col(vector).cast("array<double>")
    size = norm(v)
    rows = items.select(F.col(key).alias("id"), F.when(size > 0, F.transform(v, lambda x: F.round(x / size, 12))).alias("z"))
    rows = written(rows.withColumn("_h", F.sha2(F.to_json(F.struct("z")), 256)), "topics")
    classes = rows.filter("z is not null").groupBy("_h").agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("w"))
    inside = inside or max(most, 2**22 // (rows.agg(F.max(F.size("z"))).head()[0] or 1))
    level, done, small = written(classes.select("_h", "w", array_to_vector("z").alias("z"), F.lit("").alias("leaf")), "level"), [], []
    while True:
        sizes = level.groupBy("leaf").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("classes"))
        open_ = (F.col("n") > most) & (F.col("classes") > 1)
        kind = F.when(~open_, "done").when(F.col("classes") <= inside, "small").otherwise("large")
        marked = written(level.join(sizes.select("leaf", kind.alias("kind")), "leaf"), "level")
        done.append(marked.filter("kind = 'done'").select("_h", "leaf"))
        small.append(marked.filter("kind = 'small'").select("_h", "w", vector_to_array("z").alias("z"), "leaf"))
        large = marked.filter("kind = 'large'").drop("kind")
        if large.isEmpty():
            break
        apart = lambda a, b: dot(vector_to_array(a), vector_to_array(b))
        first = large.groupBy("leaf").agg(F.min_by("z", "_h").alias("a"), F.min("_h").alias("ha"))
        ends = large.join(first, "leaf").filter("_h <> ha").groupBy("leaf").agg(F.min_by(F.struct("z", "_h"), F.struct(F.round(apart("z", "a"), 9), "_h")).alias("b"), F.first("a").alias("a"), F.first("ha").alias("ha"))
        ends = written(ends.select("leaf", "a", "ha", F.col("b.z").alias("b"), F.col("b._h").alias("hb")), "centres")
        centres = ends.select("leaf", "a", "b")
        # A class keeps the side of the nearer centre; the two first members keep theirs, so no side is ever empty.
        lean = lambda c: large.join(c, "leaf").withColumn("lean", F.round(apart("z", "b") / F.nullif(norm(vector_to_array("b")), F.lit(0.0)) - apart("z", "a") / F.nullif(norm(vector_to_array("a")), F.lit(0.0)), 9))
        for _ in range(rounds):
            side = F.coalesce(F.col("lean") > 0, F.lit(False))
            means = lean(centres).groupBy("leaf", side.alias("side")).agg(Summarizer.mean(F.col("z"), F.col("w").cast("double")).alias("m"))
            both = means.groupBy("leaf").agg(F.first(F.when(~F.col("side"), F.col("m")), True).alias("a2"), F.first(F.when(F.col("side"), F.col("m")), True).alias("b2"))
            centres = written(ends.select("leaf", "a", "b").join(both, "leaf", "left").select("leaf", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")), "centres")
        told = written(lean(centres).select("leaf", "_h", "w", "z", "lean"), "lean")
        halves = told.groupBy("leaf").agg(F.avg((F.col("lean") > 0).cast("double")).alias("share"), F.percentile_approx("lean", 0.5, 1000).alias("middle"))
        cut = F.when((F.col("share") < lopsided) | (F.col("share") > 1 - lopsided), F.col("middle")).otherwise(0.0)
        right = F.when(F.col("_h") == F.col("ha"), False).when(F.col("_h") == F.col("hb"), True).otherwise(F.coalesce(F.col("lean") > cut, F.lit(False)))
        split = told.join(halves, "leaf").join(ends.select("leaf", "ha", "hb"), "leaf")
        level = written(split.select("_h", "w", "z", F.concat("leaf", F.when(right, "1").otherwise("0")).alias("leaf")), "level")
    held = reduce(DataFrame.unionByName, small).repartition(span_count(items, None), "leaf")
    split_inside = held.groupBy("leaf").applyInPandas(lambda part: _leaves_inside(part, most, rounds, lopsided), "_h string, leaf string")
    leaves = reduce(DataFrame.unionByName, [written(split_inside, "leaves"), *done])
    out = rows.select("id", "_h").join(leaves, "_h", "left")
    return out.select(F.col("id").alias(key), F.coalesce(F.length("leaf"), F.lit(-1)).alias("topic"), F.coalesce("leaf", F.lit("")).alias("leaf"))


def examined_share(leaves: DataFrame) -> DataFrame:
    """Leaves, largest leaf, and the mean share of items looked at when a search stays in its own leaf."""
    g = leaves.groupBy("topic", "leaf").agg(F.count(F.lit(1)).alias("n"))
    s = g.agg(F.count(F.lit(1)).alias("leaves"), F.max("n").alias("largest"), F.sum("n").alias("items"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return s.select("leaves", "largest", "items", (F.col("q") / (F.col("items") * F.col("items")).cast("double")).alias("examined"))


def leaf_recall(neighbours: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """Share of true neighbours that lie in the asking item's own leaf."""
    own = leaves.select(key, F.struct("topic", "leaf").alias("a"))
    other = leaves.select(F.col(key).alias("neighbour"), F.struct("topic", "leaf").alias("b"))
    j = neighbours.join(own, key).join(other, "neighbour")
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("recall"))

