"""The corpus pipeline: five stages over ``documents``, each on all that the one before has kept.

1. quality_classifier: documents that the classifier rejects go.
2. quality_rules: failed lines go from the texts, documents that the rules reject go.
3. near_dedup: of each group of near copies (Jaccard similarity of 0.8 or more between five-word shingles, joined through
   SimHash segments with one wildcard bit) the row with the smallest id stays.
4. decontamination: documents with a benchmark passage go.
5. packing: what is left becomes sequences of at most 1024 tokens; a row for each piece.

Each stage but the last returns the columns of ``documents`` (``n_chars`` follows the text). A stage's result is written under
the shared folder and read again as the next one's input. Stages 3 and 4 number the rows once in a written table and keep or
drop each row by itself: rows with equal ids or a null id are judged one by one. The row that stays in stage 3 is the one with
the least id (null last), then text hash, then number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontamination, packing, quality_classifier, quality_rules, simhash
from tidewire.llm.common import staged, table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return told.where("predicted = 1").select(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality_rules.quality_rules(docs).where("kept")
    return kept.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a written table with a number for each, and the name of its column."""
    own = "_row"
    while own in docs.columns:
        own += "_"
    return staged(docs.withColumn(own, F.monotonically_increasing_id()), "pipeline-rows"), own


def without(rows: DataFrame, gone: DataFrame, own: str, block: int = 2_000_000) -> DataFrame:
    """The rows but those whose numbers are in ``gone``: up to ``block`` numbers go to the rows, so that no text is shuffled."""
    gone = staged(gone, "pipeline-gone")
    return rows.join(F.broadcast(gone) if gone.count() <= block else gone, own, "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = numbered(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), F.col(own).alias("row"))
    groups = simhash.similar_groups(rows, row=own, shingle=5, similarity=0.8)
    least = groups.join(rows.select(own, rank.alias("rank")), own).groupBy("group").agg(F.min("rank").alias("rank"))
    gone = groups.select(own).join(least.select(F.col("rank.row").alias(own)), own, "left_anti")
    return without(rows, gone, own).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, own = numbered(docs)
    found = decontamination.contamination(rows, table(spark, sf_dir, "benchmark"), key=own, row=own)
    return without(rows, found.where("n_hit > 0").select(own), own).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces_with_digests(packing.pack_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
