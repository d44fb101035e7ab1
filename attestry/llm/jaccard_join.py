"""N-gram Jaccard join by a token-group matrix.

Texts are sets of hashed shingles; texts with equal sets are one class. Classes are first partitioned into groups of
similar ones: each is compared with the leader of every bucket of equal minima it falls into, and what reaches the
threshold is one group, connected already. The matrix holds, for each group, the union of its members' index prefixes; a
class asks it with its probe prefix. Both follow one global order with frequent shingles last, and are so long that a
pair at the threshold shares a fortieth of the class's shingles there: a group that holds fewer of them cannot hold a
partner. Nor can it if the class has too many shingles in its prefix that come before one it shares, or before all that
follow a group's index prefixes, and are not held there: they are not in the partner. A class never asks its own group,
so a crowd of near copies costs no more than its size. A group that qualifies is first compared by its leader. It is opened, member by member, only where a part of it is not yet connected with the
asking class. Small bit sets, of which no pair at the threshold may differ too much, pass over most pairs; the rest are
compared exactly on their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import components, mixed, shingles
from attestry.session import written


def needed(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` must share with any partner."""
    return -(-percent * n // 100)


def small(batches: Iterator[pa.RecordBatch], most: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches: a text gives hundreds of hashes, and what goes out at once is held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def cut_texts(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Sets of shingles of the column ``text``, whose bytes are taken as they are."""
    return [shingles(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """An Arrow column of lists; None stays null."""
    ends = np.cumsum([0, *[0 if v is None else len(v) for v in values]]).astype(np.int32)
    found = [v for v in values if v is not None]
    flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64), kind)
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([v is None for v in values], pa.bool_()))


# A shingle's upper half stands for it where only its place in the order is at stake.
HALF = np.uint64(32)


def frequent_shingles(docs: DataFrame, size: int, share: float, over: int, most: int) -> np.ndarray:
    """Sorted upper halves of shingles counted more than ``over`` times, the ``most`` frequent ones.

    Counted are those among the first ``share`` of each text's set, and wherever they stand those that the texts of a
    batch share. Only their place in the global order depends on them: the join is exact with any list, so its bound
    costs time, not pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            first, rest = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for s in cut_texts(batch, size):
                to = int(np.ceil(share * len(s))) + 1
                first.append(s[:to] >> HALF)
                rest.append(s[to:] >> HALF)
            tokens, n = np.unique(np.concatenate(first), return_counts=True)
            further, m = np.unique(np.concatenate(rest), return_counts=True)
            tokens, n = np.concatenate([tokens, further[m > 1]]), np.concatenate([n, m[m > 1]])
            yield pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.uint32).view(np.int32)), pa.array(n.astype(np.int32))], names=["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token int, n int").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") > over).orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().view(np.uint32))


def asked_overlap(n: int) -> int:
    """Shingles that a class of ``n`` must find in a group's part of the matrix."""
    return -(-n // 40)


def probe_length(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + asked_overlap(n))


def index_length(n: int, percent: int) -> int:
    """Long enough for every asking class that is not smaller: it shares at least 2p / (1 + p) of this set, and is at most 1 / p as large."""
    return min(n, n - -(-2 * percent * n // (100 + percent)) + -(-5 * n // (2 * percent)))


def bit_set(s: np.ndarray) -> np.ndarray:
    """A power of two of 64-bit words with two bits or more per shingle."""
    size = 1 << max(0, int(np.ceil(np.log2(2 * len(s) / 64))))
    place = (mixed(s) >> np.uint64(8)) % np.uint64(64 * size)
    flags = np.zeros(64 * size, np.uint8)
    flags[place.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.int64)


# Odd multipliers give each minimum an order of its own.
ORDERS = mixed(np.arange(1, 7, dtype=np.uint64)) | np.uint64(1)


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of a set in each of the orders: near copies share most of them."""
    return np.array([(s * m).min() for m in ORDERS], np.uint64)


def signatures(docs: DataFrame, hot: np.ndarray, size: int, percent: int) -> DataFrame:
    """Per text: ``id, t`` (hash of the text), ``n``, the class ``x``, and at a class's first text in a task its minima, probe
    prefix (``rare`` of it not frequent), the length of its index prefix and its bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small(batches):
            rows = []
            for s in cut_texts(batch, size):
                if not len(s):
                    rows.append((0, None, None, None, 0, 0, None))
                    continue
                x = int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0])
                if x in seen:
                    rows.append((len(s), x, None, None, 0, 0, None))
                    continue
                seen.add(x)
                half = (s >> HALF).astype(np.uint32)
                at = np.minimum(np.searchsorted(hot, half), max(0, len(hot) - 1))
                often = hot[at] == half if len(hot) else np.zeros(len(s), bool)
                probe = np.concatenate([s[~often], s[often]])[: probe_length(len(s), percent)]
                rare = min(len(probe), int(len(s) - often.sum()))
                rows.append((len(s), x, minima(s).view(np.int64), probe.view(np.int64), rare, index_length(len(s), percent), bit_set(s)))
            n, x, keys, probe, rare, short, bits = zip(*rows, strict=True)
            told = [pa.array(n, pa.int64()), pa.array(x, pa.int64()), lists(keys, pa.int64()), lists(probe, pa.int64()), pa.array(rare, pa.int32()), pa.array(short, pa.int32()), lists(bits, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), *told], names=["id", "t", "n", "x", "keys", "probe", "rare", "short", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, t long, n long, x long, keys array<long>, probe array<long>, rare int, short int, bits array<long>")


def near(n: Column, m: Column, percent: int) -> Column:
    """Sizes at which two sets may reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def spared(missed: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether a set of ``n`` that lacks ``missed`` of its shingles in one of ``m`` may still reach the threshold with it."""
    return missed * (100 + percent) <= 100 * n - percent * m


def resembling(percent: int) -> Column:
    """Whether the sizes ``na, nb`` and bit sets ``sa, sb`` of two classes do not rule out the threshold."""
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, (F.size(s) / 2).cast("int")), lambda p, q: p.bitwiseOR(q))
    fold = lambda s, o: F.when(F.size(s) > F.size(o), half(F.col(s))).otherwise(F.col(s))
    apart = F.aggregate(F.zip_with(fold("sa", "sb"), fold("sb", "sa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    return F.when(near(F.col("na"), F.col("nb"), percent), apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).otherwise(False)


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes and bit sets do not rule out the threshold."""
    left, right = (classes.select(F.col("x").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").filter(resembling(percent)).select("a", "b")


def bloom(keys: DataFrame, log_bits: int = 26) -> np.ndarray:
    """A Bloom filter of a fixed size (8 MB) over one column of hashes; with very many it fills up and lets more through, no fewer."""
    mask, t = (1 << log_bits) - 1, F.col(keys.columns[0])
    places = F.array(t.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(t, log_bits).bitwiseAND(F.lit(mask)))
    words = keys.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    flags = np.zeros(1 << (log_bits - 6), np.int64)
    flags[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return flags


def likely(rows: DataFrame, flags: np.ndarray, column: str, wanted: bool = True) -> DataFrame:
    """Rows whose hash in ``column`` may be in the filter, or with ``wanted`` false those that surely are not: most need no shuffle."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = flags.view(np.uint64), np.uint64(64 * len(flags))
        for batch in batches:
            t = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ok = np.ones(len(t), bool)
            for p in (t % size, t // size % size):
                ok &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(ok == wanted))

    return rows.mapInArrow(some, rows.schema)


def class_sets(rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``x, n, s``: the whole sets of the classes in ``pairs``, cut anew from one text of each."""
    active = pairs.select(F.col("a").alias("x")).union(pairs.select(F.col("b").alias("x"))).distinct()
    reps = written(classes.join(active, "x").select("x", F.col("rep.id").alias("_id"), F.col("rep.t").alias("_t")), "active")
    texts = likely(rows, bloom(reps.select("_t")), "t").join(reps, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("x", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = cut_texts(batch, size)
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array([len(s) for s in sets], pa.int64()), lists([s.view(np.int64) for s in sets], pa.int64())], names=["x", "n", "s"])

    return written(texts.mapInArrow(cut, "x long, n long, s array<long>").dropDuplicates(["x"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes whose sets reach the threshold."""
    both = pairs.join(sets.toDF("a", "na", "sa"), "a").join(sets.toDF("b", "nb", "sb"), "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def connected(pairs: DataFrame, sets: DataFrame, percent: int, labels: DataFrame | None = None) -> DataFrame:
    """Components of the pairs that reach the threshold, together with those in ``labels``.

    Sets travel first for one pair of each class, its smallest partner, then for pairs that these links leave apart: in a
    crowd of near copies nearly all pairs join what is joined already.
    """
    chosen = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "chosen")
    labels = joined(verified(chosen, sets, percent), labels)
    rest = pairs.join(chosen, ["a", "b"], "left_anti")
    for c in "ab":
        rest = rest.join(labels.toDF(c, f"c{c}"), c, "left")
    rest = written(rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
    return labels if rest.isEmpty() else joined(verified(rest, sets, percent), labels)


def joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Components of links and of the components in ``labels``."""
    return components(links if labels is None else links.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, over: int = 32, most: int = 200_000) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``digest`` (hash of the text), ``class_id``, ``group_id`` (the smallest
    class reachable), ``component_id`` (smallest key reachable by links).

    Two texts link when ``100 * intersection >= percent * union``. A-Z are lower-cased; fewer than ``size`` words are one
    shingle. Null, empty and wordless texts have an empty set, no class and their own key as component. Null keys take
    part in links and are never the smallest key, unless no other is there. Rows with equal texts are one class however
    many there are. Texts are read whole; other columns are not read; an empty table gives an empty result. ``most``
    bounds the list of frequent shingles that tasks receive (8 bytes each); whatever is not on it is handled exactly.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    # A little more than probe prefixes reach: what is counted only below that meets ever more classes above it.
    hot = frequent_shingles(rows, size, 0.25, over, most)
    told = written(signatures(rows, hot, size, percent), "signatures")
    some = told.filter("n > 0")
    classes = some.groupBy("x").agg(F.min(F.struct("id", "t")).alias("rep"), F.min("id").alias("low"), F.min("n").alias("n"), F.count("probe").alias("copies"), F.max("keys").alias("keys"), F.max("bits").alias("bits"))
    classes = written(classes, "classes")

    buckets = classes.select("x", "n", F.posexplode("keys").alias("i", "key"))
    # Another leader in each order: a class that is too far from one may be near the next.
    leads = buckets.groupBy("i", "key").agg(F.min(F.struct(F.xxhash64("x", "i").alias("o"), "x", "n")).alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    close = buckets.join(leads, ["i", "key"]).filter((F.col("x") != F.col("lead.x")) & near(F.col("n"), F.col("lead.n"), percent))
    close = written(alike(close.select(*ordered("x", "lead.x")).distinct(), classes, percent), "close")
    labels = connected(close, class_sets(rows, classes, close, size), percent)

    # The smallest class of a group names and leads it. Classes that are alone, and stand in one task, need no distinct.
    placed = written(classes.join(labels.toDF("x", "g"), "x", "left").select("x", "n", "copies", F.coalesce("g", "x").alias("g"), F.col("g").isNull().alias("alone")), "placed")
    # Nor do they move before they are taken apart.
    first = some.filter("probe is not null").select("x", "n", "probe", "rare", "short")
    named = placed.filter("not alone or copies > 1").select("x", "g", "alone")
    known = bloom(named.select("x"))
    perhaps, apart = likely(first, known, "x").join(named, "x", "left"), [F.col("x").alias("g"), F.lit(True).alias("alone")]
    lone = likely(first, known, "x", False).select("*", *apart).union(perhaps.filter("g is null").drop("g", "alone").select("*", *apart))
    many = perhaps.filter("g is not null")
    held = lambda d: d.select(F.col("g").alias("h"), F.when(F.col("alone"), F.col("n")).alias("m"), F.explode(F.slice("probe", F.lit(1), F.col("short"))).alias("token"))
    asked_by = lambda d: d.select("x", "g", "n", "rare", F.posexplode("probe").alias("at", "token"))
    matrix = held(lone).union(held(many).distinct())
    asked = asked_by(lone).union(asked_by(many).distinct())
    # The overlap is certain where the larger asks; of equal ones a member of a group is asked by the lone one, else the smaller asks.
    turn = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("g") == F.col("x")) & (F.col("x") < F.col("h")))
    met = asked.join(matrix, "token").filter((F.col("h") != F.col("g")) & (F.col("m").isNull() | (turn & near(F.col("n"), F.col("m"), percent))))
    early = F.count(F.when(F.col("at") < F.col("rare"), 1))
    met = met.groupBy("x", "h").agg(F.min("n").alias("n"), F.min("m").alias("m"), F.count(F.lit(1)).alias("k"), (F.max("at") + 1).alias("last"), (F.min("rare") - early).alias("missed"))
    met = met.filter(F.col("k") >= F.ceil(F.col("n") / 40)).filter(F.col("m").isNull() | spared(F.col("last") - F.col("k"), F.col("n"), F.col("m"), percent))
    met = written(met, "met")
    # What a group says of all its members: the smallest size, and whether all index prefixes hold every rare shingle.
    reach = first.join(placed.filter("not alone").select("x", "g"), "x").groupBy("g").agg(F.min("n").alias("least"), F.min(F.col("short") > F.col("rare")).alias("reach"))
    groups = written(placed.filter("not alone").groupBy("g").agg(F.max(F.when(F.col("x") == F.col("g"), F.col("n"))).alias("nl"), F.count(F.lit(1)).alias("members")).join(reach, "g"), "groups")
    least = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    found = met.filter("m is null").join(groups.withColumnRenamed("g", "h"), "h").filter(~F.col("reach") | spared(F.col("missed"), F.col("n"), least, percent))
    found = written(found.select("x", "h", "n", near(F.col("n"), F.col("nl"), percent).alias("near")), "candidates")

    leads = met.filter("m is not null").select("x", "h").union(found.filter("near").select("x", "h"))
    pairs = written(alike(leads.select(*ordered("x", "h")).distinct(), classes, percent), "pairs")
    labels = connected(pairs, class_sets(rows, classes, pairs, size), percent, labels)

    # Groups of several members: the parts that their leaders have not connected with the asking class. A few members
    # of each group come first, since one link to it is enough; the others only where these have not connected it.
    members = placed.filter("not alone").select(F.col("g").alias("h"), F.col("x").alias("y"), F.col("n").alias("nb"))
    members = members.join(groups.select(F.col("g").alias("h"), "members"), "h").withColumn("few", F.pmod(F.xxhash64("y"), F.col("members")) < 16)
    # Bit sets come along with each side, not with each pair.
    members = members.join(classes.select(F.col("x").alias("y"), F.col("bits").alias("sb")), "y")
    asks = found.select("x", "h", F.col("n").alias("na")).join(classes.select("x", F.col("bits").alias("sa")), "x")
    for few in ("few", "not few"):
        crowd = members.filter(few).join(labels.toDF("y", "cy"), "y", "left").select("h", "y", "nb", "sb", F.coalesce("cy", "y").alias("cy"))
        asking = asks.join(labels.toDF("x", "cx"), "x", "left").withColumn("cx", F.coalesce("cx", "x"))
        opened = written(asking, "asking").join(written(crowd, "crowd"), "h").filter((F.col("cx") != F.col("cy")) & resembling(percent))
        more = written(opened.select(*ordered("x", "y")).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            labels = connected(more, class_sets(rows, classes, more, size), percent, labels)

    placed = classes.join(labels.toDF("x", "c"), "x", "left").select("x", "low", F.coalesce("c", "x").alias("c"))
    lowest = placed.groupBy("c").agg(F.min("low").alias("component_id"))
    named = written(placed.join(written(lowest, "lowest"), "c").select(F.col("x").alias("class_id"), F.col("c").alias("group_id"), "component_id"), "named")
    out = told.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("t").alias("digest"), F.col("x").alias("class_id")).join(named, "class_id", "left")
    return out.select(key, "n_shingles", "digest", "class_id", "group_id", F.coalesce("component_id", key).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` with one row of each linked group: the one with the smallest key, of equal keys the smallest hash of the text.

    All rows without a set stay (null, empty and wordless texts), those equal in key and text once. Columns pass through.
    """
    told = link(docs, key, text, **options)
    lead = told.filter(F.col(key).eqNullSafe(F.col("component_id")))
    kept = lead.groupBy(F.coalesce("group_id", "digest").alias("_g"), F.col(key).alias("_k")).agg(F.min("digest").alias("_d")).select("_k", "_d").distinct()
    kept = written(kept, "kept").hint("merge")
    # The row travels as one value, so that no column of it can be mistaken for one made here.
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_t"))
    stay = named.join(kept, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_d")))
    return stay.dropDuplicates(["_k", "_d"]).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
