"""What several operators share: words, hashes, tables in the shared folder, and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import written

# Fixed value: the white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(flat, " "), "")


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once however often ``fn`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingles(text: str | bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of the lower-cased text; fewer words count as one shingle."""
    if not text:
        return np.empty(0, np.uint64)
    # Hashing a word costs less than looking it up among very many.
    found = (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if not len(h):
        return h
    width = min(size, len(h))
    step = np.uint64(0x100000001B3 if width == size else 0x1000193 + 2 * width)
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out *= step
        out += h[i : len(h) - width + 1 + i]
        out = mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id in ``edges`` (``a, b`` long).

    Each round takes roots to their smallest neighbouring root and shortens the chains between roots by doubling, so
    the rounds grow with the logarithm of the longest path. Every table goes to the shared folder. Joins meet a hub's
    edges only with one row per id, so that Spark can split them. Null ends and loops are left out; no edges give no rows.
    """
    edges = written(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        at_a, at_b = labels.toDF("a", "x"), labels.toDF("b", "y")
        apart = edges.join(at_a, "a").join(at_b, "b").filter("x <> y")
        links = apart.select("x", "y").union(labels.join(labels.toDF("component", "y"), "component").filter("component <> y").select(F.col("component").alias("x"), "y"))
        moves = links.select(F.greatest("x", "y").alias("root"), F.least("x", "y").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        moves = written(moves, "moves")
        if moves.isEmpty():
            return labels
        while True:
            further = moves.join(moves.toDF("to", "next"), "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            further = written(further, "moves")
            moves = further.select("root", "to")
            if further.filter("moved").isEmpty():
                break
        labels = written(labels.join(moves.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
