"""A corpus made ready for training: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import jaccard_join, line_dedup, mixing, pieces, toxicity
from attestry.llm.queries import PIECE_MODEL, table
from attestry.session import written

ORACLE_SQL = None  # a learned score, a sampled mix and a piece lattice: tested against brute force instead


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7. Labels are learned from the rows that the operator's own query learns from."""
    labels = table(spark, sf_dir, "labels").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    out = "_score"
    while out in docs.columns:
        out = f"_{out}"
    return toxicity.score(docs, toxicity.fit(docs, labels), out=out).filter(F.col(out) < 0.7).drop(out)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of passages; a document of which nothing is left goes. ``n_chars`` follows the text."""
    cut = line_dedup.drop_repeated_lines(docs).filter("n_removed = 0 or text <> ''")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return jaccard_join.one_of_each(docs)


def in_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: the two best segmentations with their scores."""
    return pieces.encode(docs, PIECE_MODEL, all_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", in_target_weights),
    ("pieces", in_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what one stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
