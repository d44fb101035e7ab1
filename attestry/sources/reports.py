"""Writers and report rows: index, publish, batch outcomes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.functions.text import short_description


def review_status(verified_by: Column, route: Column | None = None) -> Column:
    """human-reviewed / machine-confirmed / unverified, with the route named only for pdf."""
    status = F.when(verified_by.startswith("human:"), "human-reviewed").when(verified_by.isNotNull(), "machine-confirmed").otherwise("unverified")
    return status if route is None else F.concat_ws("; ", status, F.when(route == "pdf", "route:pdf"))


def ordered_index(df: DataFrame, *by: str) -> DataFrame:
    """Deterministic listing, newest first."""
    return df.orderBy(*[F.col(c).desc() for c in by])


def note_line() -> Column:
    return F.concat(F.lit("* ["), "title", F.lit("]("), "id", F.lit(".md) ("), F.concat_ws("; ", review_status(F.col("verified_by")), "status"), F.lit(") - "), short_description(F.col("description")))


def source_line() -> Column:
    tag = F.concat_ws("; ", F.concat(F.lit("arXiv:"), "id", F.lit("v"), "version"), F.col("published"), review_status(F.col("verified_by"), F.col("route")))
    return F.concat(F.lit("* ["), "title", F.lit("](sources/"), "id", F.lit(".md) ("), tag, F.lit(") - "), short_description(F.col("description")))


# Fixed lines of the report; the second names the tool that wrote it.
HEADER = "# Index of Papers"
GENERATED = "<!-- Generated by `{tool}` from frontmatter. Edits here are overwritten; edit the papers instead. -->"
NO_NOTES, NO_SOURCES = "_No notes yet._", "_No sources yet._"


def index_lines(notes: DataFrame, sources: DataFrame, tool: str = "write_index") -> DataFrame:
    """Report lines with their sort key ``(section, published, title)``: notes first, then sources, each newest first."""
    spark = notes.sparkSession
    head = [(0, HEADER), (1, ""), (2, GENERATED.format(tool=tool)), (3, ""), (4, "# Notes"), (5, ""), (8, ""), (9, "# Sources"), (10, "")]
    fixed = spark.createDataFrame(head, "section int, line string").select("section", F.lit("").alias("published"), F.lit("").alias("title"), "line")

    def listed(df: DataFrame, section: int, line: Column, date: Column, empty: str) -> DataFrame:
        rows = df.select(F.lit(section).alias("section"), date.alias("published"), "title", line.alias("line"))
        none = rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
        return rows.unionByName(none.select(F.lit(section).alias("section"), F.lit("").alias("published"), F.lit("").alias("title"), F.lit(empty).alias("line")))

    n = listed(notes, 6, note_line(), F.lit(""), NO_NOTES)
    s = listed(sources, 11, source_line(), F.col("published").cast("string"), NO_SOURCES)
    return fixed.unionByName(n).unionByName(s)


def write_index(lines: DataFrame, path: str) -> None:
    """Replace the report; part files in name order hold the lines in report order."""
    ordered = lines.orderBy("section", F.col("published").desc(), F.col("title").desc())
    ordered.select("line").write.mode("overwrite").text(path)


def _layers(spark: SparkSession, table: str) -> tuple[int, list[str]]:
    """Number of the last publication and the folders it names, oldest first."""
    try:
        rows = spark.read.schema("n long, folders array<string>").parquet(f"{table}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    last = rows.orderBy(F.desc("n")).limit(1).collect()
    return (last[0].n, list(last[0].folders)) if last else (0, [])


def _newest(spark: SparkSession, schema: StructType, folders: Sequence[str], key: str) -> DataFrame:
    """Rows of every key from the last folder that holds it."""
    if not folders:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f).withColumn("_layer", F.lit(i)) for i, f in enumerate(folders)]
    every = reduce(DataFrame.unionByName, parts)
    if len(parts) == 1:
        return every.drop("_layer")
    last = every.groupBy(F.col(key).alias("_key")).agg(F.max("_layer").alias("_last"))
    return every.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_layer") == F.col("_last"))).select(*schema.names)


def publish(df: DataFrame, table: str, key: str, layers: int = 4) -> None:
    """All or nothing: readers (``read_published``) see the table as it was until the new version of all keys at hand stands.

    The rows go to a folder of their own; then one small pointer file, which names the folders in force, is added, and it
    alone makes them visible. A key's rows come from the last folder that holds it. Once more than ``layers`` folders are
    in force they are folded into one, without what newer versions have replaced. One writer at a time; folders no pointer
    names any longer can be cleaned by age.
    """
    spark = df.sparkSession
    fresh = f"{table}/rows-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    n, folders = _layers(spark, table)
    folders = [*folders, fresh]
    if len(folders) > layers:
        whole = f"{table}/rows-{uuid.uuid4().hex}"
        _newest(spark, df.schema, folders, key).write.parquet(whole)
        folders = [whole]
    spark.createDataFrame([(n + 1, folders)], "n long, folders array<string>").coalesce(1).write.mode("append").parquet(f"{table}/pointer")


def read_published(spark: SparkSession, table: str, schema: StructType, key: str) -> DataFrame:
    """The table as its last publication left it; nothing published is an empty table."""
    return _newest(spark, schema, _layers(spark, table)[1], key)


def batch_report(ids: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """One row per asked id; an id without an outcome failed."""
    return ids.join(outcomes, key, "left").withColumn("status", F.coalesce("status", F.lit("failed"))).withColumn("exit", (F.col("status") == "failed").cast("int"))


def status_counts(report: DataFrame, statuses: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return report.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in statuses])


def fill_stats(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Described / failed / skipped counts and cost; failed rows stay in the count."""
    return rows.groupBy(*by).agg(
        F.count_if(F.col("outcome") == "described").alias("count"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.round(F.sum("cost"), 6).alias("cost"),
    )
