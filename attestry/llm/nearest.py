"""Approximate nearest neighbours by largest inner product: lists by centroids, scanned by adaptive dimensions.

Vectors stand in lists around centroids fitted on a bounded sample, and a list in chunks of bounded size. A chunk holds
its vectors rotated at random and cut into column blocks. A scan adds one block after the other to the squared distance
of query and vector. What a candidate's distance may be at most follows from the score to beat and both lengths; after
each block a hypothesis test on the distance so far (a rotated vector spreads its length evenly) abandons the candidates
that would have to be improbably near in what is left. Survivors are scored exactly on the original vectors.

Two rounds: the first scans the nearest lists of each query and gives it a score to beat. The second takes the other
lists in the order of how many better vectors they are expected to hold, but for a tail that together is expected to
hold fewer than ``misses``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import written


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """``k`` centres of the sample rows ``x``, each the mean of the rows nearest to it."""
    draw = np.random.Generator(np.random.PCG64(seed))
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_list(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest_list(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for start in range(0, len(x), 4096):
        out[start : start + 4096] = np.argmax(x[start : start + 4096] @ centres.T - 0.5 * (centres**2).sum(1), 1)
    return out


@dataclass
class Lists:
    """Centroids of the lists of one dimension, with their sizes and the spread of their vectors along one direction."""

    centres: np.ndarray
    sizes: np.ndarray
    spreads: np.ndarray

    def hits(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many vectors of each list are expected to score over ``least``, if its vectors lie evenly around its centroid."""
        long = np.linalg.norm(queries, axis=1)[:, None] * np.maximum(self.spreads, 1e-300)[None, :]
        z = (least[:, None] - queries @ self.centres.T) / np.maximum(long, 1e-300)
        return self.sizes[None, :] * 0.5 * np.vectorize(math.erfc, otypes=[float])(np.nan_to_num(z, nan=-9.0, posinf=40.0, neginf=-9.0) / math.sqrt(2))


def scan(rotated: list[np.ndarray], squares: np.ndarray, queries: list[np.ndarray], lengths: np.ndarray, least: np.ndarray, risk: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, vector) that no test has abandoned, and how many column values were read for all of them.

    ``rotated`` and ``queries`` are column blocks. A pair is abandoned after ``t`` of ``d`` columns where its distance so
    far, times ``d / t``, is over the square of ``1 + risk / sqrt(t)`` times the distance at which the score is just reached.
    """
    d, n = sum(b.shape[1] for b in queries), len(squares)
    most = lengths[:, None] + squares[None, :] - 2 * least[:, None]
    so_far = np.zeros((len(lengths), n))
    alive: tuple[np.ndarray, np.ndarray] | None = None
    seen = done = 0
    for x, q in zip(rotated, queries):
        seen += q.shape[1]
        if alive is None:
            done += so_far.size * q.shape[1]
            so_far += (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (q @ x.T)
            distance, limit = so_far, most
        else:
            done += len(alive[0]) * q.shape[1]
            distance = distance + ((q[alive[0]] - x[alive[1]]) ** 2).sum(1)
            limit = most[alive]
        share = 1.0 if seen == d else (1 + risk / math.sqrt(seen)) ** 2
        keep = distance * (d / seen) <= share * limit + 1e-6 * (1 + np.abs(limit))
        if alive is not None:
            alive, distance = (alive[0][keep], alive[1][keep]), distance[keep]
        elif seen == d or keep.mean() < 0.3:
            alive = np.nonzero(keep)
            distance = so_far[alive]
        # While most pairs live, all go on: a product of whole blocks is cheaper than picking them.
    return *alive, done


def search(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, own: bool = True, sample_values: int = 4_000_000, list_rows: int = 512, max_lists: int = 2048, chunk_rows: int = 2048, block: int = 512, columns: int = 16, first_lists: int = 3, misses: float = 1.0, risk: float = 1.3, seed: int = 3) -> DataFrame:
    """``query_id, rank, <key>, score``: for each row of ``queries`` the ``k`` rows of ``rows`` found with the largest inner product.

    Best first, ties by smaller key (null last); scores are inner products of the original vectors in double precision.
    With ``own`` queries are rows of ``rows``, and one row equal to the query in key and vector is left out. All rows are
    indexed; centroids are fitted on about ``sample_values`` numbers of a sample; recall is measured in the tests.

    Vectors that are null, empty, zero or hold null or non-finite components take no part on either side, and vectors of
    different lengths do not meet. Equal vectors are indexed and asked once, with the smallest ``k + 1`` keys of each.
    Repeated rows count as often as they stand; a repeated query row is answered each time. Other columns are not read; an empty table gives an empty
    result; fewer than ``k`` candidates give all of them.
    """
    v = F.col(f"`{vector}`")
    kind, key_kind = rows.schema[vector].dataType.elementType.simpleString(), rows.schema[key].dataType.simpleString()
    fine = F.exists(v, lambda a: a != 0) & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) < float("inf")))
    named = rows.filter(fine).select(F.col(f"`{key}`").alias("key"), v.alias("v"))
    lowest = Window.partitionBy("v").orderBy(F.asc_nulls_last("key"))
    few = named.withColumn("r", F.row_number().over(lowest)).filter(F.col("r") <= k + 1)
    classes = written(few.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda s: s["key"]).alias("keys")), "vectors")
    asked = written(queries.filter(fine).select(F.col(f"`{key}`").alias("key"), v.alias("v")).withColumn("row", F.monotonically_increasing_id()), "queries")
    distinct = written(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")

    sizes = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", lambda a: F.abs(a.cast("double"))))).alias("top")).head()
    n, scale = sizes.n, float(sizes.top or 1.0)
    share = min(1.0, sample_values / max(1, n * (sizes.d or 1)))
    sample = classes.filter(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow().column("v").to_pylist()
    lists: dict[int, np.ndarray] = {}
    for d in sorted({len(a) for a in sample}):
        x = np.array([a for a in sample if len(a) == d], np.float64) / scale
        part = len(x) / len(sample)
        lists[d] = centroids(x, max(1, min(max_lists, math.ceil(n * part / list_rows), len(x) // 8)), 8, seed)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            where, apart = np.zeros(len(found), np.int64), np.zeros(len(found))
            dims = np.array([len(a) for a in found])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, centres = np.array([found[i] for i in at], np.float64) / scale, lists.get(int(d), np.zeros((1, d)))
                where[at] = nearest_list(x, centres)
                apart[at] = ((x - centres[where[at]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(where, pa.int32()), pa.array(apart)], names=["v", "keys", "dim", "list", "apart"])

    placed = written(classes.select("v", "keys").mapInArrow(dealt, f"v array<{kind}>, keys array<{key_kind}>, dim int, list int, apart double"), "lists")
    told = placed.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("n"), F.avg("apart").alias("apart")).collect()  # one row per list, a bounded number
    known = {d: Lists(c, np.zeros(len(c)), np.zeros(len(c))) for d, c in lists.items()}
    for r in told:
        own_lists = known.setdefault(r.dim, Lists(np.zeros((1, r.dim)), np.zeros(1), np.zeros(1)))
        own_lists.sizes[r.list], own_lists.spreads[r.list] = r.n, math.sqrt(r.apart / r.dim)

    def chunk(group: pa.Table) -> pa.Table:
        d, where = group.column("dim")[0].as_py(), group.column("list")[0].as_py()
        x = np.array(group.column("v").to_pylist(), np.float64)
        turned = ((x / scale) @ rotation(d, seed)).astype(np.float32)
        cut = b"".join(np.ascontiguousarray(turned[:, c : c + columns]).tobytes() for c in range(0, d, columns))
        keys = group.column("keys").combine_chunks()
        values = [pa.array([d], pa.int32()), pa.array([where], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([cut]), pa.array([x.tobytes()]), pa.array([keys.to_pylist()], pa.list_(keys.type))]
        return pa.table(values, names=["dim", "list", "n", "turned", "original", "keys"])

    # A list larger than a chunk is dealt into lots by a hash, so that no group grows with its list.
    parts = placed.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("lots"))
    lots = placed.join(parts, ["dim", "list"]).withColumn("lot", F.pmod(F.xxhash64("v", F.lit(seed)), "lots"))
    chunks = lots.groupBy("dim", "list", "lot").applyInArrow(chunk, f"dim int, list int, n int, turned binary, original binary, keys array<array<{key_kind}>>")
    chunks = written(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")

    def probe(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(1).to_pylist()
                dims = np.array([len(a) for a in found])
                out: list[list[int]] = [[] for _ in found]
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    own_lists = known.get(int(d))
                    if own_lists is None:
                        continue
                    x = np.array([found[i] for i in at], np.float64) / scale
                    order = np.argsort(-(x @ own_lists.centres.T), axis=1, kind="stable")
                    if first:
                        for i, o in zip(at, order[:, :first_lists]):
                            out[i] = o.tolist()
                        continue
                    least = np.array([-np.inf if s is None else s for s in np.array(batch.column(2).to_pylist(), object)[at]], np.float64) / scale**2
                    hits = own_lists.hits(x, least)
                    np.put_along_axis(hits, order[:, :first_lists], 0.0, 1)
                    rank = np.argsort(hits, axis=1)
                    keep = np.cumsum(np.take_along_axis(hits, rank, 1), 1) > misses
                    for i, r, yes, h in zip(at, rank, keep, np.take_along_axis(hits, rank, 1)):
                        out[i] = r[yes & (h > 0)].tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dims, pa.int32()), pa.array(out, pa.list_(pa.int32()))], names=["q", "v", "least", "dim", "lists"])

        return run

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_type = batch.schema.field("keys").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                d, n_own = row["dim"].as_py(), row["n"].as_py()
                original = np.frombuffer(row["original"].as_py(), np.float64).reshape(n_own, d)
                flat, turned, start = np.frombuffer(row["turned"].as_py(), np.float32), [], 0
                for c in range(0, d, columns):
                    wide = min(columns, d - c)
                    turned.append(flat[start : start + n_own * wide].reshape(n_own, wide))
                    start += n_own * wide
                some = row["asked"].values
                numbers, floors = some.field("q").to_numpy(), np.array([-np.inf if x is None else x for x in some.field("least").to_pylist()])
                own_queries = some.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(numbers), d)
                q = ((own_queries / scale) @ rotation(d, seed)).astype(np.float32)
                at_q, at_x, _ = scan(turned, ((original / scale) ** 2).sum(1), [q[:, c : c + columns] for c in range(0, d, columns)], ((own_queries / scale) ** 2).sum(1), floors / scale**2, risk)
                score = np.einsum("ij,ij->i", original[at_x], own_queries[at_q])
                good = score >= floors[at_q]
                at_q, at_x, score = at_q[good], at_x[good], score[good]
                keys = row["keys"].as_py()
                low = [keys[x][0] for x in at_x]  # the smallest one
                rank = pd.DataFrame({"q": at_q, "s": -score, "none": [x is None for x in low], "low": low, "x": at_x}).sort_values(["q", "s", "none", "low"], kind="stable")
                best = rank[rank.groupby("q").cumcount() <= k]
                at_q, at_x = best["q"].to_numpy(np.int64), best["x"].to_numpy(np.int64)
                same = (original[at_x] == own_queries[at_q]).all(1)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[at_q]), pa.array(-best["s"].to_numpy(np.float64)), pa.array(same), pa.array([keys[x] for x in at_x], keys_type)], names=["q", "score", "same", "keys"])

    def answers(found: DataFrame, purpose: str) -> DataFrame:
        """The best rows of each query from the lists it asks: blocks of queries meet chunks, both dealt by list and lot."""
        wish = written(found.select("q", "v", "least", "dim", F.explode("lists").alias("list")), purpose)
        some = wish.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        held = chunks.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("chunks"))
        lots = some.join(held, ["dim", "list"]).select("dim", "list", "blocks", F.ceil(F.col("blocks") / 16).alias("q_lots"), F.ceil(F.col("chunks") / 16).alias("c_lots"))
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        blocked = wish.join(lots, ["dim", "list"]).withColumn("block", F.pmod(F.xxhash64("q"), "blocks"))
        blocked = blocked.groupBy("dim", "list", "block", "q_lots", "c_lots").agg(F.collect_list(F.struct("q", "least", "v")).alias("asked"))
        left = blocked.select("dim", "list", F.pmod("block", "q_lots").alias("q_lot"), upto("c_lots").alias("c_lot"), "asked")
        right = chunks.join(lots, ["dim", "list"]).select("dim", "list", F.pmod(F.xxhash64("chunk"), "c_lots").alias("c_lot"), upto("q_lots").alias("q_lot"), "n", "turned", "original", "keys")
        met = left.join(right, ["dim", "list", "q_lot", "c_lot"]).select("dim", "n", "turned", "original", "keys", "asked")
        rows_ = met.mapInArrow(scanned, f"q long, score double, same boolean, keys array<{key_kind}>").select("q", "score", "same", F.explode("keys").alias("key"))
        return written(best_of(rows_), purpose)

    def best_of(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)

    schema = f"q long, v array<{kind}>, least double, dim int, lists array<int>"
    one = answers(distinct.select("q", "v", F.lit(None).cast("double").alias("least")).mapInArrow(probe(True), schema), "probes")
    least = one.filter(F.col("r") == k + 1).select("q", F.col("score").alias("least"))
    two = answers(distinct.join(least, "q", "left").select("q", "v", "least").mapInArrow(probe(False), schema), "probes")
    both = written(best_of(one.drop("r").union(two.drop("r"))).drop("r"), "nearest")

    met = asked.withColumnRenamed("key", "query_id").join(distinct, "v").select("row", "query_id", "q").join(both, "q")
    if own:
        itself = F.col("same") & F.col("key").eqNullSafe(F.col("query_id"))
        copies = Window.partitionBy("row", itself).orderBy("key")
        met = met.withColumn("copy", F.row_number().over(copies)).filter(~(itself & (F.col("copy") == 1)))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
