"""Result registry: exact statistics per run, condition and metric, exclusions and sanity warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.digests import row_digest, set_digest

KEY = ["run", "condition", "metric"]
EXACT = "decimal(38,9)"


def exact(value: str = "value") -> Column:
    """The decimal a text stands for; null for anything that is not a finite number."""
    return F.expr(f"try_cast(`{value}` as {EXACT})")


def entry_id() -> Column:
    return F.concat_ws("/", *KEY)


def registry_values(obs: DataFrame) -> DataFrame:
    """The values behind each entry, one row per seed, text kept as written."""
    return obs.select(entry_id().alias("id"), "seed", "value")


def rebuild_registry(obs: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """``obs(run, condition, seed, metric, value)`` to one row per entry with exact decimal statistics.

    Values are shifted by the entry's minimum before squares are taken, so 29-digit values keep their spread. ``runs``
    gives ``class``; ``metrics`` gives ``unit`` and ``direction``. Only finite values count into ``n``.
    """
    numbers = obs.select(*KEY, exact().alias("x"))
    low = numbers.groupBy(*KEY).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("n"))
    shifted = numbers.join(low.select(*KEY, "min"), KEY).withColumn("d", F.col("x") - F.col("min"))
    spread = shifted.groupBy(*KEY).agg(F.sum("d").alias("_sum"), F.stddev_samp(F.col("d").cast("double")).alias("std"))
    out = low.join(spread, KEY).withColumn("mean", F.col("min") + (F.col("_sum") / F.col("n").cast("decimal(19,0)")))
    out = out.join(runs.select("run", "class"), "run", "left").join(metrics.select("metric", "unit", "direction"), "metric", "left")
    return out.select(entry_id().alias("id"), "n", "mean", "std", "min", "max", "unit", "class", "direction")


def exclude_runs(runs: DataFrame, seal_findings: DataFrame) -> DataFrame:
    """Runs left out of the registry with the reason. ``runs(run, status, sealed)``; findings name the run."""
    broken = seal_findings.select("run", F.lit(1).alias("_broken")).distinct()
    reason = (
        F.when(F.col("status") != "completed", F.concat(F.lit("status is "), "status"))
        .when(~F.col("sealed"), "no seal")
        .when(F.col("_broken").isNotNull(), "seal does not match the files")
    )
    return runs.join(broken, "run", "left").select("run", reason.alias("reason")).filter("reason is not null")


def sanity_warnings(obs: DataFrame, declared: DataFrame, metrics: DataFrame, expected_seeds: DataFrame, min_seeds: int) -> DataFrame:
    """Warnings ``(kind, location)`` over observations.

    ``declared(run, condition)``, ``metrics(metric)``, ``expected_seeds(run, seed)``. Equality is numeric, so "0.5" and
    "0.50" are the same value.
    """
    numbers = obs.withColumn("x", exact())
    per_entry = numbers.withColumn("_digest", row_digest("seed", "x")).groupBy(*KEY).agg(
        set_digest().alias("values"), F.sum("x").alias("_sum"), F.count("x").alias("_n"), F.countDistinct("seed").alias("seeds")
    )
    mean = (F.col("_sum") / F.col("_n")).cast("decimal(38,9)")

    def repeated(by: Column, kind: str) -> DataFrame:
        groups = per_entry.filter("_n > 0").groupBy("run", "metric", by.alias("_by")).agg(F.countDistinct("condition").alias("c")).filter("c > 1")
        return groups.select(F.lit(kind).alias("kind"), F.concat_ws("/", "run", "metric").alias("location")).distinct()

    def rows(df: DataFrame, kind: str, *location: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.concat_ws("/", *location).alias("location")).distinct()

    few = per_entry.filter(F.col("seeds") < min_seeds)
    undefined = obs.join(metrics.select("metric"), "metric", "left_anti")
    absent = declared.join(obs, ["run", "condition"], "left_anti")
    stray = obs.join(expected_seeds, ["run", "seed"], "left_anti")
    parts = [
        repeated(F.col("values"), "identical-values-across-conditions"),
        repeated(mean, "identical-means"),
        rows(few, "too-few-seeds", *KEY),
        rows(undefined, "missing-metric-def", "run", "metric"),
        rows(numbers.filter("x is null"), "non-finite", *KEY),
        rows(absent, "missing-condition", "run", "condition"),
        rows(stray, "unexpected-seeds", "run", "condition", "seed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_results_facts(results: DataFrame, run: str = "run") -> DataFrame:
    """Results records with ``observations`` array to fact rows ``(run, condition, seed, metric, value)``."""
    obs = results.select(run, F.explode("observations").alias("o"))
    return obs.select(run, "o.condition", "o.seed", F.explode("o.metrics").alias("metric", "value"))


def format_stat(value: Column, digits: int) -> Column:
    """Exact half-up rounding to a fixed number of places, as text."""
    return F.round(value.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")
