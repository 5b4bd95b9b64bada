"""From raw documents to packed training sequences: reject by rules, reject by quality, drop near copies, pack.

Each stage reads what the one before it wrote. All but the last return the columns of ``documents``.

Null texts count as empty. The rules reject empty and blank texts with all that have too few words, so
nothing of them goes further; given to the later stages by themselves they get the score of an empty text,
are linked with nothing, and pack as their closing token. Very long texts are taken whole by every stage.
Ties go as the operators state. A row that repeats another's id and text is kept or rejected like it by the
first two stages and goes in near_dedup, which also keeps one of the near copies among rows without an id.
An empty table passes through as an empty table. Columns beyond id and text are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetlens.llm import neardup, packing, ranking, repetition
from assetlens.llm.queries import model, quality_model, table
from assetlens.llm.staging import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.kept_rows(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose learned score reaches the cut; learned from the labelled rows of the whole table."""
    return ranking.kept_rows(docs, quality_model(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return neardup.kept_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of what is left, with its sequence and place."""
    return packing.pack(packing.pieces(docs, model("BYTE_MODEL")))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("best_fit_packing", pack)]

#: Quality classifier, near-duplicate components and packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each over the whole of what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
