"""Loading the driver tables and deriving the operators' input schemas.

The stand-ins only reshape rows into the schema a job expects (FIXTURES.md);
they do none of the job's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.session import table_path
from cohera.sources.corpus import corpus_from_documents


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table. Its partitions follow ``spark.sql.files.*``; a user
    who knows that a table is one small row group can set
    ``cohera.input.partitions`` to deal its rows out by their id."""
    df = spark.read.parquet(table_path(sf_dir, name))
    n = spark.conf.get("cohera.input.partitions", None)
    return df.repartition(int(n), df.columns[0]) if n else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs(doc_id STRING, sents ARRAY<STRING>)``, one line = one sentence."""
    return corpus_from_documents(load(spark, sf_dir, "documents"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 9-column review table from ``documents`` left-joined to
    ``labels`` (LABEL from quality, RATING from toxic, category = source,
    product title = first line, review title = language)."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    first_line = F.element_at(F.split(F.col("text"), "\n"), 1)
    return j.select(
        F.col("doc_id").cast("string").alias("DOC_ID"),
        F.when(F.col("quality").isNull(), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("__label"), (F.col("quality") + 1).cast("string"), F.lit("__")))
         .alias("LABEL"),
        (F.coalesce(F.col("toxic"), F.lit(0)) * 4 + 1).cast("int").alias("RATING"),
        F.when(F.col("toxic") == 1, "N").otherwise("Y").alias("VERIFIED_PURCHASE"),
        F.col("source").alias("PRODUCT_CATEGORY"),
        F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("PRODUCT_ID"),
        first_line.alias("PRODUCT_TITLE"),
        F.col("lang").alias("REVIEW_TITLE"),
        F.col("text").alias("REVIEW_TEXT"),
    )


def grid_lines(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """X6 stand-in: entity-grid text lines ``(doc_id, line)`` derived from
    the corpus -- entity = a capitalised word, role ``X`` where it occurs in
    the sentence, ``-`` elsewhere (the reference reads ready-made grids)."""
    d = docs if docs is not None else corpus(spark, sf_dir)
    ws = F.transform("sents", lambda s: F.array_distinct(
        F.regexp_extract_all(s, F.lit(r"\p{Lu}[\p{L}\p{N}_]*"), 0)))
    d = d.select("doc_id", ws.alias("ws"))
    ents = F.array_sort(F.array_distinct(F.flatten("ws")))
    lines = F.transform(ents, lambda e: F.concat_ws(" ", e, F.array_join(
        F.transform("ws", lambda w: F.when(F.array_contains(w, e), "X").otherwise("-")), " ")))
    return d.select("doc_id", F.explode(lines).alias("line"))


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10 stand-in: training-log rows from ``events`` -- run = user, step =
    event id, epoch from the timestamp, train rows carry ``loss`` (value),
    eval rows (``view`` events) carry ``eval_loss``; tokens and elapsed
    seconds for A8 come from ``props.k`` and ``value``."""
    e = load(spark, sf_dir, "events")
    is_eval = F.col("event_type") == "view"
    return e.select(
        F.col("user_id").cast("string").alias("run"),
        (F.dayofmonth("ts") - 1 + F.hour("ts") / 24.0).alias("epoch"),
        F.col("event_id").alias("step"),
        F.lit(5e-5).alias("learning_rate"),
        F.when(~is_eval, F.col("value")).alias("loss"),
        F.when(is_eval, F.col("value")).alias("eval_loss"),
        F.get_json_object("props", "$.k").cast("long").alias("ntokens"),
        F.col("value").alias("elapsed"))
