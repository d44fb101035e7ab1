"""Running totals, ranks, neighbours and quantiles that never put one key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, which stops working once one key holds a
third of the table. Here the order column is cut into spans at approximate quantiles of the whole table, so that
(key, span) is the unit of work. What crosses spans is one small row per (key, span). Results are exact: the quantiles
decide only where to cut.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.session import written

SPAN = "_span"


def once(df: DataFrame) -> DataFrame:
    """Write a derived input to the shared folder before it is ordered: ordering reads its input three times."""
    return written(df, "ordered")


def as_number(df: DataFrame, name: str) -> Column:
    """A double that does not decrease along the column's own order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)").cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"{name}: {kind.simpleString()} has no numeric order")


def span_count(df: DataFrame, parts: int | None) -> int:
    return parts or max(2, min(2000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_spans(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Add ``_span``, which never decreases along ``order``.

    A value that fills several quantiles gets a span of its own, cut again by the next order column.
    """
    parts = span_count(df, parts)
    probs = [i / parts for i in range(1, parts)]
    cuts = df.agg(*[F.percentile_approx(as_number(df, c), probs, 20 * parts).alias(f"c{i}") for i, c in enumerate(order)]).head()
    out, span, deeper, scratch = df, F.lit(0).cast("long"), F.lit(True), []
    for i, name in enumerate(order):
        points = [p for p in (cuts[i] or []) if p is not None]
        heavy = sorted({p for p in points if points.count(p) > 1})
        edges = sorted(set(points) | {math.nextafter(p, math.inf) for p in heavy})
        bucket = F.lit(0)
        if edges:
            out = out.withColumn(f"_o{i}", as_number(df, name))
            out = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol=f"_o{i}", outputCol=f"_b{i}", handleInvalid="keep").transform(out)
            scratch += [f"_o{i}", f"_b{i}"]
            bucket = F.col(f"_b{i}").cast("long")
        span = span * (len(edges) + 2) + F.when(deeper, bucket).otherwise(0)
        if not heavy:
            break
        deeper = deeper & bucket.isin([edges.index(p) + 1 for p in heavy])
    return out.withColumn(SPAN, span).drop(*scratch)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    number: str = "rn",
    size: str | None = None,
    parts: int | None = None,
    lows: Mapping[str, str] | None = None,
    highs: Mapping[str, str] | None = None,
) -> DataFrame:
    """Row number, running sums, minima and maxima (output name to column) and the row count per key. ``order`` must be unique."""
    folds = [(o, c, F.sum, lambda a, b: a + b) for o, c in (sums or {}).items()]
    folds += [(o, c, F.min, F.least) for o, c in (lows or {}).items()] + [(o, c, F.max, F.greatest) for o, c in (highs or {}).items()]
    cut = with_spans(df, order, parts)
    inside = Window.partitionBy(*keys, SPAN).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({number: F.row_number().over(inside).cast("long"), **{o: f(c).over(upto) for o, c, f, _ in folds}})
    sizes = cut.groupBy(*keys, SPAN).agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_s_{o}") for o, c, f, _ in folds])
    earlier = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        SPAN,
        F.sum("_n").over(earlier).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"),
        *[f(f"_s_{o}").over(earlier).alias(f"_s_{o}") for o, _, f, _ in folds],
    )
    joined = local.join(offsets, [*keys, SPAN])
    add = {number: F.col(number) + F.coalesce("_before", F.lit(0))}
    add |= {o: F.coalesce(join(F.col(o), F.col(f"_s_{o}")), F.col(o), F.col(f"_s_{o}")) for o, _, _, join in folds}
    if size:
        add[size] = F.col("_size")
    return joined.withColumns(add).drop(SPAN, "_before", "_size", *[f"_s_{o}" for o, *_ in folds])


def shifted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str], ahead: bool = False, parts: int | None = None
) -> DataFrame:
    """Value of the row before (or after) inside each key; ``cols`` maps output name to column. ``order`` must be unique."""
    cut = with_spans(df, order, parts)
    inside = Window.partitionBy(*keys, SPAN).orderBy(*order)
    step = F.lead if ahead else F.lag
    local = cut.withColumns({**{o: step(c).over(inside) for o, c in cols.items()}, "_inner": step(F.lit(1)).over(inside)})
    pick = F.min if ahead else F.max
    held = [*order, *dict.fromkeys(c for c in cols.values() if c not in order)]
    ends = cut.groupBy(*keys, SPAN).agg(pick(F.struct(*held)).alias("_end"))
    ends = ends.withColumn("_next", step("_end").over(Window.partitionBy(*keys).orderBy(SPAN))).drop("_end")
    joined = local.join(ends, [*keys, SPAN])
    add = {o: F.when(F.col("_inner").isNull(), F.col(f"_next.{c}")).otherwise(F.col(o)) for o, c in cols.items()}
    return joined.withColumns(add).drop(SPAN, "_inner", "_next")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Latest non-null ``value`` at or before each row inside its key. ``order`` must be unique."""
    return carried_all(df, keys, order, {out: value}, parts)


def carried_all(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str], parts: int | None = None) -> DataFrame:
    """``carried`` for several columns in one pass; ``cols`` maps output name to column."""
    cut = with_spans(df, order, parts)
    inside = Window.partitionBy(*keys, SPAN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({o: F.last(c, ignorenulls=True).over(inside) for o, c in cols.items()})
    held = lambda c: F.struct(*order, *([c] if c not in order else []))
    ends = cut.groupBy(*keys, SPAN).agg(*[F.max(F.when(F.col(c).isNotNull(), held(c))).alias(f"_end_{o}") for o, c in cols.items()])
    earlier = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, SPAN, *[F.last(f"_end_{o}", ignorenulls=True).over(earlier).alias(f"_prior_{o}") for o in cols])
    joined = local.join(ends, [*keys, SPAN])
    return joined.withColumns({o: F.coalesce(o, f"_prior_{o}.{c}") for o, c in cols.items()}).drop(SPAN, *[f"_prior_{o}" for o in cols])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """One row per (key, distinct value): ``n`` equal rows, ``n_before``, ``n_to``, ``avg_rank`` and the key's ``n_all``."""
    counts = once(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    ranked = running(counts, keys, [value], {"n_to": "n"}, number="_rn", parts=parts).drop("_rn")
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n_all"))
    ranked = ranked.withColumn("n_before", F.col("n_to") - F.col("n"))
    ranked = ranked.withColumn("avg_rank", (F.col("n_before") + 1 + F.col("n_to")) / F.lit(2.0))
    if keys:
        return ranked.join(sizes, list(keys))
    return ranked.withColumn("n_all", sizes.scalar())


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], parts: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per key from value counts; equals ``percentile`` without holding a key in memory."""
    ranked = value_ranks(df, keys, value, parts)
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n_all") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda i: (F.col("n_before") <= i) & (i < F.col("n_to"))
        low_value = F.max(F.when(holds(low), F.col(value).cast("double")))
        high_value = F.max(F.when(holds(high), F.col(value).cast("double")))
        share = F.max(at - low)
        aggs.append((low_value + (high_value - low_value) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
