"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors again and again by the median of a random projection; a middle band of each split goes to
both sides. Vectors are compared, exactly and in double precision, with those that share a leaf in any tree. A pair is
counted in the first leaf it shares, so that tasks send one row per vector and leaf (its number of links and the
smallest vector it is connected with there) and never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import components
from attestry.session import written


@dataclass
class Tree:
    """Inner nodes split at ``normals``; ``lows`` and ``highs`` bound the band that goes both ways. Children under 0 are leaves.

    A leaf that will hold more rows than wanted is split ``bits`` times more by random planes through its mean.
    """

    normals: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    children: np.ndarray
    bits: np.ndarray
    means: np.ndarray
    spreads: np.ndarray
    seed: int

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf numbers (a row has several where it stood in a band)."""
        rows, ids, todo = [], [], [(0 if len(self.normals) else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node >= 0:
                p = x[at] @ self.normals[node]
                todo += [(int(self.children[node, 0]), at[p <= self.highs[node]]), (int(self.children[node, 1]), at[p > self.lows[node]])]
                continue
            leaf = -node - 1
            parts = [(0, at)]
            for k in range(int(self.bits[leaf])):
                w = np.random.Generator(np.random.PCG64([self.seed, leaf, k])).standard_normal(x.shape[1])
                w /= np.linalg.norm(w)
                band, cut = 0.125 * self.spreads[leaf], float(self.means[leaf] @ w)
                parts = [(2 * code + side, part[keep]) for code, part in parts for p in [x[part] @ w - cut] for side, keep in ((0, p <= band), (1, p > -band))]
            for code, part in parts:
                rows.append(part)
                ids.append(np.full(len(part), (code << 24) | leaf, np.int64))
        return np.concatenate(rows) if rows else np.empty(0, int), np.concatenate(ids) if ids else np.empty(0, np.int64)


def grow(x: np.ndarray, per_row: float, max_leaf: int, tight: float, band: float, seed: int) -> Tree:
    """A tree over sample rows ``x``, each of which stands for ``per_row`` rows.

    A leaf is kept whole where all its sample rows are within ``tight`` (cosine) of their mean: splitting a group of near
    copies only parts links. At least 8 sample rows support a split.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    normals, lows, highs, children, leaves = [], [], [], [], []

    def place(at: np.ndarray, parent: int, side: int) -> None:
        todo = [(at, parent, side)]
        while todo:
            at, parent, side = todo.pop()
            mean = x[at].mean(0) if len(at) else np.zeros(x.shape[1])
            close = bool(len(at)) and float((x[at] @ mean).min()) >= tight * float(np.linalg.norm(mean))
            w = draw.standard_normal(x.shape[1])
            w /= np.linalg.norm(w)
            p = x[at] @ w
            lo, hi = np.quantile(p, [0.5 - band, 0.5 + band]) if len(at) else (0.0, 0.0)
            if close or len(at) * per_row <= max_leaf or len(at) < 16 or not (p <= lo).any() or not (p > hi).any():
                rows = len(at) * per_row
                leaves.append((0 if close or rows <= max_leaf else int(np.ceil(np.log2(rows / max_leaf))), mean, float(np.sqrt(x[at].var(0).mean())) if len(at) else 0.0))
                node = -len(leaves)
            else:
                node = len(normals)
                normals.append(w), lows.append(lo), highs.append(hi), children.append([0, 0])
                todo += [(at[p <= hi], node, 0), (at[p > lo], node, 1)]
            if parent >= 0:
                children[parent][side] = node

    place(np.arange(len(x)), -1, 0)
    d = x.shape[1]
    return Tree(np.array(normals).reshape(-1, d), np.array(lows), np.array(highs), np.array(children, int).reshape(-1, 2), np.array([b for b, *_ in leaves]), np.array([m for _, m, _ in leaves]).reshape(-1, d), np.array([s for *_, s in leaves]), seed)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shared_before(left: list[np.ndarray], right: list[np.ndarray], leaf: int) -> np.ndarray:
    """Which pairs of rows share a leaf with a smaller number than ``leaf``."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    owner, flat = owner[flat < leaf], flat[flat < leaf]
    names, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[at] > 1
    _, at = np.unique(at[keep], return_inverse=True)
    owner = owner[keep]
    out = np.zeros((len(left), len(right)), bool)
    for start in range(0, int(at.max(initial=-1)) + 1, 4096):
        here = (at >= start) & (at < start + 4096)
        m = np.zeros((len(left) + len(right), 4096), np.float32)
        m[owner[here], at[here] - start] = 1
        out |= (m[: len(left)] @ m[len(left) :].T) > 0
    return out


def local_roots(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable inside one symmetric link matrix."""
    low = ids.copy()
    while True:
        now = np.minimum(low, np.where(links, low[None, :], np.iinfo(np.int64).max).min(1))
        if (now == low).all():
            return low
        low = now


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", at_least: float = 0.9, trees: int = 12, max_leaf: int = 512, block: int = 1024, sample_rows: int = 20_000, band: float = 0.05, seed: int = 7) -> DataFrame:
    """One row per row of ``rows``: key, ``n_links`` (other rows found with cosine >= ``at_least``), ``component_id``, ``kept``.

    Every row is indexed and every pair that shares a leaf is compared; links below the threshold never come out, and some
    above it may be missed (tests hold the recall to 0.9 and more). ``sample_rows`` bounds the sample that places the
    splits; leaves larger than ``block`` are compared in pairs of blocks, whole. Equal vectors are compared once and
    counted as often as they stand.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and are their own
    component, as are vectors of different lengths to each other. Rows with a null key take part; a component's id is its smallest key that
    is not null. A key may repeat. Other columns are not read; an empty table gives an empty result.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(v, lambda a: a != 0)
    named = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    named = named.select("key", "v", F.when(F.col("fine"), F.xxhash64("v")).alias("c"))
    good = named.filter("c is not null")
    classes = written(good.groupBy("c").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "vectors")
    n = classes.count()
    part = F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(1, n)) * (1 << 30))
    sample = classes.filter(part).select("v").toArrow().column("v").to_pandas()  # bounded by sample_rows
    forest: dict[int, list[Tree]] = {}
    for d in sorted({len(a) for a in sample}):
        x = unit_rows(sample[[len(a) == d for a in sample]])
        forest[d] = [grow(x, n / max(1, len(sample)), max_leaf, (1 + at_least) / 2, band, seed + t) for t in range(trees)]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            sizes = batch["v"].map(len).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = unit_rows(batch["v"].iloc[at])
                # Vectors of a length the sample does not hold share one leaf.
                for t, tree in enumerate(forest.get(int(d), [])) if int(d) in forest else [(0, None)]:
                    where, ids = tree.leaves(x) if tree else (np.arange(len(at)), np.zeros(len(at), np.int64))
                    order = np.argsort(where, kind="stable")
                    ends = np.searchsorted(where[order], np.arange(len(at) + 1))
                    marked = (np.int64(t) << 56) | (np.int64(int(d) & 0xFFF) << 44) | ids[order]
                    for i, a in enumerate(at):
                        found[a].append(marked[ends[i] : ends[i + 1]])
            yield pd.DataFrame({"c": batch["c"].values, "leaves": [np.unique(np.concatenate(f)) for f in found]})

    indexed = written(classes.select("c", "v").mapInPandas(index, "c long, leaves array<long>"), "leaves")
    members = indexed.select("c", F.explode("leaves").alias("leaf"))
    crowds = written(members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "leaves")
    lots = F.ceil(F.col("n") / block).cast("int")
    dealt = members.join(crowds, "leaf").withColumn("i", F.pmod(F.xxhash64("c", F.lit("lot")), lots).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), lots - 1)))
    dealt = dealt.select("c", "leaf", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i")
    full = dealt.join(classes.select("c", "copies", "v"), "c").join(indexed, "c")

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        leaf, lo, hi = int(unit["leaf"].iloc[0]), int(unit["lo"].iloc[0]), int(unit["hi"].iloc[0])
        unit = unit.sort_values("c")
        out = []
        for d in np.unique(unit["v"].map(len)):
            part = unit[unit["v"].map(len) == d]
            ids, copies, leaves = part["c"].to_numpy(np.int64), part["copies"].to_numpy(np.int64), list(part["leaves"])
            x = unit_rows(part["v"])
            links = x @ x.T >= at_least
            np.fill_diagonal(links, False)
            if lo != hi:
                lot = part["i"].to_numpy()
                links &= lot[:, None] != lot[None, :]
            if links.any():
                links &= ~shared_before(leaves, leaves, leaf)
                some = links.any(1)
                out.append(pd.DataFrame({"c": ids[some], "n": (links @ copies)[some], "root": local_roots(links, ids)[some]}))
        return pd.concat(out) if out else pd.DataFrame({"c": np.empty(0, np.int64), "n": np.empty(0, np.int64), "root": np.empty(0, np.int64)})

    met = written(full.groupBy("leaf", "lo", "hi").applyInPandas(compare, "c long, n long, root long"), "links")
    labels = components(met.select(F.col("c").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("c").agg(F.sum("n").alias("n"))
    placed = classes.select("c", "low", "copies").join(counts, "c", "left").join(labels.toDF("c", "root"), "c", "left")
    placed = placed.select("c", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "c").alias("root"))
    placed = written(placed, "placed")
    lowest = written(placed.groupBy("root").agg(F.min("low").alias("component_id")), "placed")
    told = written(placed.join(lowest, "root").select("c", "n_links", "component_id"), "placed")
    joined = named.select("key", "c").join(told, "c", "left")
    joined = joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return joined.withColumn("kept", F.col(key) == F.col("component_id"))
