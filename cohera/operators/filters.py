"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.functions.text import STOP_WORDS
from cohera.session import materialise


def min_sentences(docs: DataFrame, n: int = 10, sents: str = "sents") -> DataFrame:
    """keep documents with at least ``n`` raw lines (blank lines count)."""
    return docs.filter(F.size(sents) >= n)


def min_grid_columns(grid_lines: DataFrame, n: int = 10, line: str = "line") -> DataFrame:
    """F1, grid variant: keep grid rows with at least ``n`` role fields."""
    return grid_lines.filter(F.size(F.split(F.col(line), " ")) - 1 >= n)


def drop_empty_sentences(sents: Column) -> Column:
    """drop sentences that are empty after cleaning."""
    return F.filter(sents, lambda s: s != "")


def filter_label(df: DataFrame, label_col: str, value, keep: bool = True) -> DataFrame:
    """``LABEL == x`` (keep) or its complement including null labels
    (null-safe, like pandas ``!=``)."""
    eq = F.col(label_col).eqNullSafe(F.lit(value))
    return df.filter(eq if keep else ~eq)


def remove_stopwords(tokens: Column, stop_words=STOP_WORDS) -> Column:
    """F6 array form: drop every stop word, keep order and repeats."""
    words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(words))  # a hash-set lookup, not a scan per token


def remove_stopwords_long(tokens: DataFrame, word: str = "word", stop_words=STOP_WORDS) -> DataFrame:
    """F6 long form: left-anti join with the fixed stop list (broadcast: a
    fixed ~130-row literal table, size bounded by construction)."""
    spark = tokens.sparkSession
    stop = spark.createDataFrame([(w,) for w in stop_words], f"{word} string")
    return tokens.join(F.broadcast(stop), word, "left_anti")


def by_name(docs: DataFrame, key: str = "doc_id", among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` whose name no other row (of ``among``, if given) has, and those that share theirs (a null
    name is one, too). The pairs of the former are known by their names, so what
    belongs to a pair can be worked out in its row, without a join by name."""
    shared = (docs if among is None else among).groupBy(key).count().where("count > 1").select(F.col(key).alias("_shared"))
    shared = materialise(shared, "shared-names")
    same = F.col(key).eqNullSafe(F.col("_shared"))
    return docs.join(shared, same, "left_anti"), docs.join(shared, same, "left_semi")
