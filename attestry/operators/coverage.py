"""Does a derived text still hold its source: blocks, counts, numbers and equations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import evaluated, extract_equations, extract_numbers, normalize


def located(blocks: DataFrame, texts: DataFrame, doc: str, body: str) -> DataFrame:
    """Each block with whether its normalised text occurs in the document's normalised text (equi-join on the document)."""
    whole = texts.select(doc, normalize(F.col(body)).alias("_body"))
    joined = evaluated(blocks, blocks.columns, _norm=normalize(F.col("text"))).filter("_norm <> ''").join(whole, doc, "left")
    return joined.withColumn("found", F.coalesce(F.col("_body").contains(F.col("_norm")), F.lit(False))).drop("_body", "_norm")


def missing_blocks(found: DataFrame, doc: str, width: int = 80) -> DataFrame:
    return found.filter("not found").select(doc, "ord", "kind", F.left("text", F.lit(width)).alias("preview"))


def coverage_report(found: DataFrame, doc: str) -> DataFrame:
    share = F.avg(F.col("found").cast("double"))
    return found.groupBy(doc).agg(F.count(F.lit(1)).alias("total"), F.count_if("found").alias("matched"), share.alias("coverage")).withColumn("passed", F.col("total") == F.col("matched"))


def count_reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Independent counts ``n`` on both sides: unequal warns, a side without a count means no check."""
    j = a.select(key, F.col("n").alias("n_a")).join(b.select(key, F.col("n").alias("n_b")), key, "full_outer")
    status = F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), "unchecked").when(F.col("n_a") == F.col("n_b"), "ok").otherwise("warning")
    return j.withColumn("status", status)


def number_presence(source: DataFrame, derived: DataFrame, key: str, text: str) -> DataFrame:
    """Numbers and equations of the source that the derived text of the same key lacks."""

    def parts(df: DataFrame) -> DataFrame:
        equations = F.transform(extract_equations(F.col(text)), normalize)
        of = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token")))
        return df.select(key, F.inline(F.concat(of("number", extract_numbers(F.col(text))), of("equation", F.array_distinct(equations)))))

    return parts(source).join(parts(derived), [key, "kind", "token"], "left_anti")
