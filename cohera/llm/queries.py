"""Registered queries ``opN_<name>``: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.llm import (attention_lm, byte_bpe, decontaminate, hard_negatives, html_paths, mixing, pii, quality, spelling, token_counts,
                        toxicity, voronoi_knn)
from cohera.llm.common import fold, table
from cohera.llm.ngram_join import jaccard_components
from cohera.llm.oracle_sql import ORACLE  # noqa: F401  (the driver reads both)

#: public tokenizer files; every worker reads them from its own installation
TOKENIZERS = "/opt/tokenizers"
#: splits a text into words before the merges of the byte-level rank files (a fixed value, published with them)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def q_op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return voronoi_knn.knn_join(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def q_op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def q_op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked benchmark item of each document, its best window."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q_op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability, learnt from the folds other than 1 of 5."""
    return attention_lm.scored_corpus(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def q_op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digests of the spans."""
    docs = table(spark, sf_dir, "documents")
    return pii.digests(docs, pii.fit(docs))


def q_op6_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = html_paths.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def q_op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the weighted mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def q_op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the folds other than 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    index, prior = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), index, prior)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"), "near_ids")


def q_op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the pieces and scores of a public file,
    read as a unigram vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return out.select("doc_id", "n_tokens", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"))


def q_op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard of at least 0.9, one row per document."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, pct=90)


def q_op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives of each of five positives of every vector whose id
    is divisible by 50; every seventh label is wrong on purpose."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


def q_op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among all words of the documents."""
    return spelling.variants(spelling.vocabulary(spelling.noisy_words(table(spark, sf_dir, "documents"))))


def q_op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN)


QUERIES = {
    "op1_voronoi_knn": q_op1_voronoi_knn,
    "op2_quality": q_op2_quality,
    "op3_decontaminate": q_op3_decontaminate,
    "op4_attention_lm": q_op4_attention_lm,
    "op5_pii": q_op5_pii,
    "op6_html_paths": q_op6_html_paths,
    "op7_mixing": q_op7_mixing,
    "op8_toxicity": q_op8_toxicity,
    "op9_token_counts": q_op9_token_counts,
    "op10_ngram_join": q_op10_ngram_join,
    "op11_hard_negatives": q_op11_hard_negatives,
    "op12_spelling": q_op12_spelling,
    "op13_byte_bpe": q_op13_byte_bpe,
}
