"""Personal data: fixed patterns give seed spans, their contexts are scored on a graph of patterns and instances, and good contexts find more.

All of it is DataFrame work. Spans of one text are computed inside its row; only entities and their contexts, never
texts, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import bound
from attestry.session import written

# The base kinds in order, with patterns that find what the plain ones find. A match starts where its first
# class starts or where the last match ended, and classes never give back what they took, so long runs cost one pass.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Runs that may be identifiers: eight signs or more with a digit.
RUN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,64}[0-9])[A-Za-z0-9_+/=-]{8,}+"
KINDS = ("email", "ip", "card", "phone")


def ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: bound(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))


def card_ok(m: Column) -> Column:
    """13 to 19 digits that pass Luhn's sum."""

    def luhn(d: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(d))
        worth = lambda i: bound(F.substring(d, i, F.lit(1)).cast("int") * F.when((F.length(d) - i) % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))
        return F.aggregate(F.transform(at, worth), F.lit(0), lambda a, b: a + b) % 10 == 0

    return bound(F.translate(m, " -", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def phone_ok(m: Column) -> Column:
    return F.length(F.translate(m, "+ ().-", "")).between(9, 15)


def offsets(lengths: Column) -> Column:
    """Sums of all lengths before each place, by blocks of about the square root of their number."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def summed(l: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(l))).cast("int"))
        blocks = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(l) / w).cast("int")), lambda b: total(F.slice(l, b * w + 1, w)))
        at = F.sequence(F.lit(0), F.size(l) - 1)
        place = lambda w, bs: F.transform(at, lambda i: bound(F.floor(i / w).cast("int"), lambda b: total(F.slice(bs, F.lit(1), b)) + total(F.slice(l, b * w + 1, i - b * w))))
        return bound(width, lambda w: bound(blocks(w), lambda bs: place(w, bs)))

    return bound(lengths, summed)


def found(text: Column, pattern: str, hint: str, ok: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a pattern: array of (start, end, value, left), positions in code points, ``left`` up to 64 signs before."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")

    def spans(parts: Column, hits: Column) -> Column:
        lengths = F.transform(hits, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
        made = lambda before: F.transform(hits, lambda m, i: F.struct((F.get(before, i) + F.length(F.get(parts, i))).alias("start"), (F.get(before, i) + F.length(F.get(parts, i)) + F.length(m)).alias("end"), m.alias("value"), F.right(F.get(parts, i), F.lit(64)).alias("left")))
        kept = bound(offsets(lengths), made)
        return F.filter(kept, lambda s: ok(s["value"])) if ok else kept

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = bound(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(bound(F.split(text, pattern, -1), lambda p: spans(p, h))))
    return F.when(F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]"), inner).otherwise(none)


def named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["left"].alias("left")))


def contexts(left: Column, value: Column) -> Column:
    """Lexical patterns of an instance: the word before it, the two words before it, a key and a beginning inside it."""
    one = F.lower(F.regexp_extract(left, r"(\p{L}+)[^\p{L}]*$", 1))
    two = F.lower(F.regexp_extract(left, r"(\p{L}+[^\p{L}]+\p{L}+)[^\p{L}]*$", 1))
    key = F.lower(F.regexp_extract(value, r"^([A-Za-z_-]{2,32})=", 1))
    start = F.regexp_extract(value, r"^([A-Z]{3,8})(?=[A-Z0-9]*[0-9])", 1)
    told = [F.when(c != "", F.concat(F.lit(f"{n}:"), c)) for n, c in (("before", one), ("two before", two), ("key", key), ("start", start))]
    return F.array_compact(F.array(*told))


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 4, support: int = 5, confident: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: key, ``base`` and ``more`` (arrays of kind, start, end; code points, end exclusive).

    ``base`` holds the valid matches of each base kind, leftmost first without overlap; a match that fails its test is
    dropped and not tried again. They are the seeds. Runs of eight signs or more with two digits or more, of any length, are further instances where they meet no seed. Each
    of ``rounds`` scores every context by the mean score of its instances (two are added to their number), and every
    unknown instance by its best context met ``support`` times or more. ``more`` holds instances scored ``confident`` or
    better, kind ``id``; of ``key=value`` only the value.

    Null and empty texts have no spans; whole texts are searched; rows equal in key and text share their instances and
    get equal spans; null keys are kept; an empty table gives an empty result; other columns are not read.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kinds = {"email": found(t, EMAIL, "@"), "ip": found(t, IP, ".", ip_ok), "card": found(t, CARD, "", card_ok), "phone": found(t, PHONE, "+", phone_ok)}
    first = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("digest"), *[c.alias(k) for k, c in kinds.items()], found(t, RUN, "").alias("run"))
    merged = F.flatten(F.array(*[named(k) for k in KINDS]))
    told = written(first.select("key", "digest", merged.alias("base"), "run"), "spans")

    seeds = told.select("key", "digest", F.explode("base").alias("s")).select("key", "digest", "s.start", "s.end", F.lit(1.0).alias("score"), contexts(F.col("s.left"), F.lit("")).alias("at"))
    usable = F.filter("run", lambda s: (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 2) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    other = told.select("key", "digest", F.explode(usable).alias("s")).withColumn("cut", F.length(F.regexp_extract("s.value", r"^([A-Za-z_-]{2,32}=)(?=.)", 1)))
    other = other.select("key", "digest", (F.col("s.start") + F.col("cut")).alias("start"), F.col("s.end").alias("end"), F.lit(0.0).alias("score"), contexts(F.col("s.left"), F.col("s.value")).alias("at"))
    nodes = written(seeds.withColumn("seed", F.lit(True)).union(other.withColumn("seed", F.lit(False))).distinct(), "instances")
    id_ = ["key", "digest", "start", "end"]
    edges = written(nodes.select(F.xxhash64(*id_, "seed").alias("node"), *id_, "seed", F.explode("at").alias("context")), "contexts")
    scored = None
    for _ in range(rounds):
        seen = edges.withColumn("score", F.col("seed").cast("double"))
        if scored is not None:
            known = scored.select("node", F.col("score").alias("given"))
            seen = seen.join(known, "node", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("given", F.lit(0.0))))
        weights = written(seen.groupBy("context").agg((F.sum("score") / (F.count(F.lit(1)) + 2)).alias("w"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support), "contexts")
        best = edges.filter(~F.col("seed")).join(weights, "context").groupBy("node", *id_).agg(F.max("w").alias("score"))
        scored = written(best, "instances")
    more = scored.filter(F.col("score") >= confident).groupBy("key", "digest").agg(F.array_sort(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("more"))
    more = written(more, "instances").withColumnsRenamed({"key": "_key", "digest": "_digest"})
    out = told.join(more, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return out.select(F.col("key").alias(key), plain.alias("base"), F.coalesce("more", none).alias("more"))
