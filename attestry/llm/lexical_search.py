"""Ranked lexical search by exact inner products over sparse ball trees.

A document is the sparse vector of what each term would add to a score, a query the set of its terms, so a score is an
inner product. Documents are dealt into subtrees of bounded size, each built and stored in one row. A node of a subtree
has a centroid and two radii: that of its ball, and for each term how far a document rises above the centroid there. Both
bound every document below the node; what is not a whole number is rounded upwards. A query goes down the nodes best
bound first and stops where no bound reaches its k-th score; leaves are scored in whole numbers.

Two rounds go over the subtrees. The first opens one leaf of each per query, which gives every query a score that its
k-th best cannot be under; the second prunes with it.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import written

# Signs of a term: digits, letters and whatever is not ASCII; A-Z become a-z, everything else parts terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes((c,)).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, repeats included; a null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs that ``ends`` (from 0) cut out of ``values``; an empty run gives 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


@dataclass
class Rows:
    """Sparse rows: row ``i`` holds ``terms[ends[i]:ends[i + 1]]`` with ``values``."""

    ends: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def ordered(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.ends)[order]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.ends[:-1][order], sizes)
        return Rows(ends, self.terms[at], self.values[at])


def spans(n: int, leaf: int) -> list[tuple[int, int, int]]:
    """Nodes of a balanced tree over ``n`` rows as (first row, row after the last, left child); the right child follows the left, a leaf has 0."""
    out, at = [(0, n, 0)], 0
    while at < len(out):
        lo, hi, _ = out[at]
        if hi - lo > leaf:
            out[at] = (lo, hi, len(out))
            mid = (lo + hi) // 2
            out += [(lo, mid, 0), (mid, hi, 0)]
        at += 1
    return out


def leaf_order(rows: Rows, n_terms: int, leaf: int, width: int = 24, seed: int = 11) -> np.ndarray:
    """Order of the rows in which every node of ``spans`` is one half of its parent, parted between two rows that lie far apart.

    Distances are those of a random projection; only the shape of the tree depends on it, its bounds come from whole rows.
    """
    plane = np.random.Generator(np.random.PCG64(seed)).standard_normal((n_terms, width), np.float32)
    p = np.empty((len(rows), width))
    for i in range(width):
        p[:, i] = summed(rows.values * plane[rows.terms, i].astype(np.float64), rows.ends)
    order = np.arange(len(rows))
    for lo, hi, left in spans(len(rows), leaf):
        if left:
            x = p[order[lo:hi]]
            far = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
            other = x[np.argmax(((x - far) ** 2).sum(1))]
            order[lo:hi] = order[lo:hi][np.argsort(x @ (other - far), kind="stable")]
    return order


class Queries:
    """A block of queries as sparse rows of term numbers."""

    def __init__(self, found: list[np.ndarray]) -> None:
        self.of = found
        self.ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        self.flat = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)

    def over(self, dense: np.ndarray) -> np.ndarray:
        return summed(dense[self.flat], self.ends)


class Tree:
    """A ball tree over rows in leaf order."""

    def __init__(self, rows: Rows, n_terms: int, leaf: int) -> None:
        self.rows, self.n_terms, self.nodes = rows, n_terms, spans(len(rows), leaf)
        self.squares = summed(rows.values.astype(np.float64) ** 2, rows.ends)
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, queries: Queries) -> np.ndarray:
        """What no row below a node can score over, by node and query.

        From the centroid: the query there, and either the radius times the length of the query inside the node's terms
        or the sum of the rises, whichever is less. Centroids and rises are whole numbers; the radius is taken a little longer.
        """
        rows, out = self.rows, np.empty((len(self.nodes), len(queries.of)), np.int64)
        tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for at in range(len(self.nodes) - 1, -1, -1):
            lo, hi, left = self.nodes[at]
            if left:
                (total, top), (more, high) = tops.pop(left), tops.pop(left + 1)
                total, top = total + more, np.maximum(top, high)
            else:
                own = slice(rows.ends[lo], rows.ends[hi])
                total, top = np.zeros(self.n_terms, np.int64), np.zeros(self.n_terms, np.int64)
                np.add.at(total, rows.terms[own], rows.values[own])
                np.maximum.at(top, rows.terms[own], rows.values[own])
            tops[at] = total, top
            centre = total // (hi - lo)
            c = centre.astype(np.float64)
            cc = float(c @ c)
            inner = summed(rows.values[rows.ends[lo] : rows.ends[hi]] * c[rows.terms[rows.ends[lo] : rows.ends[hi]]], rows.ends[lo : hi + 1] - rows.ends[lo])
            apart = float((self.squares[lo:hi] - 2 * inner).max()) + cc
            radius = math.sqrt(max(0.0, apart) + 1e-9 * (float(self.squares[lo:hi].max()) + cc)) * (1 + 1e-9) + 1
            ball = np.ceil(radius * np.sqrt(queries.over((top > 0).astype(np.int64)))) + 1
            out[at] = queries.over(centre) + np.minimum(queries.over(top - centre), np.minimum(ball, 2.0**62).astype(np.int64))
        return out

    def scored(self, at: int, query: np.ndarray) -> np.ndarray:
        """Scores of the rows of a leaf, in whole numbers."""
        if at not in self.leaves:
            lo, hi, _ = self.nodes[at]
            rows, own = self.rows, slice(self.rows.ends[lo], self.rows.ends[hi])
            names, column = np.unique(rows.terms[own], return_inverse=True)
            table = np.zeros((hi - lo, len(names)), np.int64)
            table[np.repeat(np.arange(hi - lo), np.diff(rows.ends[lo : hi + 1])), column] = rows.values[own]
            self.leaves[at] = names, table
        names, table = self.leaves[at]
        column = np.searchsorted(names, query)
        column = column[(column < len(names)) & (names[np.minimum(column, len(names) - 1)] == query)]
        return table[:, column].sum(1)

    def search(self, queries: Queries, keys: list, best: list[list[tuple]], k: int, least: np.ndarray, most_leaves: int | None = None) -> int:
        """Adds to ``best`` (per query a sorted list of (-score, key is null, key)) what belongs there; the number of leaves opened.

        ``least``: scores under it are of no use. ``most_leaves`` stops a query after so many leaves.
        """
        bounds, opened = self.bounds(queries), 0
        for q, query in enumerate(queries.of):
            found, heap, left_over = best[q], [(-int(bounds[0, q]), 0)], most_leaves
            while heap and left_over != 0:
                bound, at = heapq.heappop(heap)
                want = max(1, int(least[q]), -found[-1][0] if len(found) == k else 0)
                if -bound < want:
                    break
                lo, hi, left = self.nodes[at]
                if left:
                    for child in (left, left + 1):
                        heapq.heappush(heap, (-int(bounds[child, q]), child))
                    continue
                opened += 1
                left_over = left_over - 1 if left_over else None
                scores = self.scored(at, query)
                for i in np.flatnonzero(scores >= want).tolist():
                    entry = (-int(scores[i]), keys[lo + i] is None, keys[lo + i])
                    if len(found) < k or entry < found[-1]:
                        insort(found, entry)
                        del found[k:]
        return opened


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``key, n`` (terms with repeats) and, for the terms in ``numbers``, ``terms`` and ``tfs`` (how often each stands there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.get
        for batch in batches:
            n, found, often, ends = [], [], [], [0]
            for text in batch.column(1):
                every = terms(text.as_py())
                met = Counter(map(number, every))
                met.pop(None, None)
                n.append(len(every))
                found += met.keys()
                often += met.values()
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((found, pa.int32()), (often, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["key", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


def subtrees(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_all: int, rows_each: int, entries_each: int, leaf: int) -> DataFrame:
    """One row per subtree: keys and sparse rows in leaf order (``values``: what a term adds to a score, before its weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(keys: list, sizes: list[np.ndarray], names: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
            rows = Rows(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(names), np.concatenate(values))
            order = leaf_order(Rows(rows.ends, rows.terms, rows.values * weights[rows.terms]), len(weights), leaf)
            rows = rows.ordered(order)
            wrap = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
            own = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), pa.array([keys[i] for i in order], kind))
            return pa.RecordBatch.from_arrays([own, wrap(np.diff(rows.ends), pa.int32()), wrap(rows.terms, pa.int32()), wrap(rows.values, pa.int32())], names=["keys", "sizes", "terms", "values"])

        keys, sizes, names, values, held, kind = [], [], [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            ends = batch.column(2).offsets.to_numpy()
            n, all_terms, tfs = batch.column(1).to_numpy(), batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            m = 50 + (50 * n * n_docs) // n_all
            grow = (1_000_000_000 * tfs) // (1000 * tfs + 20 * np.repeat(m, np.diff(ends)))
            use = (weights[all_terms] > 0) & (grow > 0)
            kept = summed(use.astype(np.int64), ends)
            ids = batch.column(0).to_pylist()
            start = 0
            while start < len(ids):
                # As many further rows as the subtree has room for, one at least.
                room = np.searchsorted(np.cumsum(kept[start:]), entries_each - held, "right")
                stop = min(len(ids), start + max(1 if not keys else 0, min(int(room), rows_each - len(keys))))
                if stop > start:
                    some, own = np.flatnonzero(kept[start:stop]) + start, slice(ends[start], ends[stop])
                    keys += [ids[i] for i in some]
                    sizes.append(kept[some])
                    names.append(all_terms[own][use[own]])
                    values.append(grow[own][use[own]])
                    held += int(kept[start:stop].sum())
                if stop < len(ids) and keys:
                    yield built(keys, sizes, names, values)
                    keys, sizes, names, values, held = [], [], [], [], 0
                start = stop
        if keys:
            yield built(keys, sizes, names, values)

    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.mapInArrow(run, f"keys array<{kind}>, sizes array<int>, terms array<int>, values array<int>")


def searched(trees: DataFrame, weights: np.ndarray, queries: Queries, k: int, least: np.ndarray, leaf: int, most_leaves: int | None = None) -> DataFrame:
    """``q, score, key``: of each query, the best ``k`` rows that a task finds in its subtrees."""
    kind = trees.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries.of]
        own = None
        for batch in batches:
            own = batch.schema.field(0).type.value_type
            for i in range(batch.num_rows):
                keys, sizes, names, values = (batch.column(c)[i].values for c in range(4))
                names = names.to_numpy().astype(np.int64)
                rows = Rows(np.concatenate([[0], np.cumsum(sizes.to_numpy().astype(np.int64))]), names, values.to_numpy() * weights[names])
                Tree(rows, len(weights), leaf).search(queries, keys.to_pylist(), best, k, least, most_leaves)
        if own is not None:
            out = [(q, -entry[0], entry[2]) for q, found in enumerate(best) for entry in found]
            for start in range(0, len(out), 10_000):
                part = out[start : start + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], own)], names=["q", "score", "key"])

    found = trees.mapInArrow(run, f"q int, score long, key {kind}")
    first = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 50, block_terms: int = 500_000, rows_each: int = 4096, entries_each: int = 1_000_000, leaf: int = 64) -> DataFrame:
    """The ``k`` best rows of ``docs`` for each row of ``items``: item, ``rank`` (from 1), key, ``score`` (over 0), best first.

    Terms are runs of digits, letters and signs beyond ASCII; only A-Z are lower-cased. A score adds, over the item's
    distinct terms, ``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and
    ``m = 50 + (50 * n * N) div L``; N counts the texts with a term, L all terms, n those of one text, df the texts with
    the term. Equal scores go by ascending key, a null key last; rows that are equal in both take any order.

    All rows and whole texts are searched and the result is exact. Null, empty and wordless texts are never found, nor do
    such items find anything; repeated rows count as often as they stand. Other columns are not read, whatever their
    names; an empty table gives an empty result. Items go in blocks of about ``block_terms`` terms, whose terms, weights
    and scores to beat are what tasks receive.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    named = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    kind = named.schema["item"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(dict.fromkeys(terms(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["item", "n", "terms"])

    asked = written(named.mapInArrow(split, f"item {kind}, n long, terms array<binary>").filter("n > 0").withColumn("spot", F.rand(5)), "items")
    blocks = max(1, -(-int(asked.agg(F.sum("n")).head()[0] or 0) // block_terms))
    results = [_block(rows, asked.filter((F.col("spot") * blocks).cast("int") == b).select("item", "terms").toArrow(), k, rows_each, entries_each, leaf) for b in range(blocks)]
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _block(rows: DataFrame, asked: pa.Table, k: int, rows_each: int, entries_each: int, leaf: int) -> DataFrame:
    """The search for one block of items, which the driver holds."""
    spark, lists = rows.sparkSession, asked.column("terms").to_pylist()
    numbers: dict[bytes, int] = {}
    queries = Queries([np.sort(np.array([numbers.setdefault(t, len(numbers)) for t in found], np.int64)) for found in lists])
    told = written(counted(rows, numbers).filter("n > 0"), "counts")
    sizes = told.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).head()
    frequent = told.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()  # at most one row per term of the block
    weights = np.zeros(max(1, len(numbers)), np.int64)
    for t, df in zip(frequent.column("t").to_pylist(), frequent.column("df").to_pylist()):
        weights[t] = weight(sizes.docs, df)
    trees = written(subtrees(told.filter(F.size("terms") > 0), weights, sizes.docs, sizes.terms or 1, rows_each, entries_each, leaf), "trees")
    least = np.ones(len(lists), np.int64)
    for r in searched(trees, weights, queries, k, least, leaf, most_leaves=1).filter(F.col("rank") == k).select("q", "score").collect():
        least[r.q] = r.score
    found = written(searched(trees, weights, queries, k, least, leaf), "ranked")
    names = spark.createDataFrame(pa.table({"q": pa.array(range(len(lists)), pa.int32()), "item": asked.column("item")}))
    return found.join(names, "q").select("item", "rank", "key", "score")
