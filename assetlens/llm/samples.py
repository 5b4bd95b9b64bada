"""Bounded, repeatable samples of labelled rows, and the folds that the label contracts name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def training_labels(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of every id of ``documents`` with a label outside the held-out fold, each id once.

    Labels rows that disagree about one id count as label 0; null ids and labels are left out.
    """
    train = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(id_col, folds) != held_out)).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    return train.join(documents.select(F.col(id_col).alias("id")), "id", "left_semi")


def class_share(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int = 0, id_col: str = "doc_id") -> float | None:
    """The share of label 1 among the training labels; None without any."""
    return training_labels(documents, labels, label, folds, held_out, id_col).agg(F.avg("y")).first()[0]


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``per_class`` rows of each class outside the held-out fold.

    The rows are those of ``training_labels``. The choice is by smallest hash of the id, so it does not
    depend on partitions. The chosen ids are at most 2 * ``per_class`` rows of two numbers, which is the
    bound of the broadcast.
    """
    train = training_labels(documents, labels, label, folds, held_out, id_col)
    parts = [train.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id")
