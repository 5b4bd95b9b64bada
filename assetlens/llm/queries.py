"""The registered queries of the text operators and, where SQL can state the result, that SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import chat, codes, imatch, kneserney, licenses, neardup, packing, ranking, repetition, samples, sentencepieces, sql, toxicity, treap, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Vocabulary files, found only when a query asks for one.
MODELS = {"PIECE_MODEL": "piece_bpe_32k.model", "BYTE_MODEL": "byte_bpe_50k.json"}


def __getattr__(name: str) -> str:
    if name not in MODELS:
        raise AttributeError(name)
    return model(name)


def model(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(MODELS[name])


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ids_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        column = batch.column(1)
        bounds = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype("<u4")
        digest = [hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(digest, pa.string()), batch.column(2)], ["doc_id", "n_tokens", "ids_sha256", "decoded"])


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with begin and end ids and decoded again, as digests."""
    both = sentencepieces.encode_decode(table(spark, sf_dir, "documents"), model("PIECE_MODEL"))
    out = both.mapInArrow(_ids_digest, "doc_id long, n_tokens long, ids_sha256 string, decoded string")
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, coverages and the verdict of the rules for every document."""
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


QUALITY_CUT = 0.3


def quality_model(spark: SparkSession, sf_dir: str) -> ranking.Ranking:
    """The ranking learned from the labelled rows outside fold 0."""
    return ranking.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", folds=5, cut_score=QUALITY_CUT)


@query
def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, and whether it lies in the fold that learning left out."""
    scored = ranking.rank(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (samples.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and whether it lies in the fold that learning left out."""
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.rate(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (samples.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows", "toxic_windows", "largest_distance")


@query
def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, and whether it is the one that stays."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), model("BYTE_MODEL")))


@query
def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the license phrases and the labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the model learned from those outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    held_out = samples.fold("doc_id", 7) == 2
    model = kneserney.train(documents.where(~held_out))
    scored = kneserney.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op7_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


@query
def op11_member_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by codebooks learned from all of them."""
    vectors = table(spark, sf_dir, "embeddings")
    books = codes.learn(vectors)
    coded = codes.with_label_errors(codes.encode(vectors, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).alias("codebooks_sha256"))


@query
def op12_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return treap.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose two turns hold the template's own control strings."""
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)


@query
def op13_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests read back from every formatted conversation."""
    return chat.digests(chat.format_conversations(conversations(spark, sf_dir)))


ORACLE_SQL |= {"op11_member_lloyd": sql.member_lloyd(), "op12_k2_treap": sql.ranked_search(), "op13_chat_grammar": sql.chat_digests()}
ORACLE_SQL |= {"op5_quality_rules": sql.quality_rules(), "op9_superminhash": sql.near_duplicates()}
