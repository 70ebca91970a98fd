"""Structured Streaming variants of the online paths (ST1-ST3).

* ST1 keywords for arriving texts with a fitted idf table: the stream-static
  join is on exploded terms and per-document top-k needs a window function,
  which a streaming plan rejects, so each micro-batch runs the batch K2 job
  in ``foreachBatch``.
* ST2 coherence scores for arriving documents: the array form of M1 is a
  stateless projection (no window functions), so it streams in append mode.
* ST1 with prompts: a stream of the request log (S8) becomes keyword prompts
  (T7); malformed log lines go to a folder of their own.
* ST3 running accuracy over scored pairs: a streaming aggregation in complete
  mode, or over event-time windows in update mode, whose state the watermark
  bounds and whose sink keeps versions (an upsert that a replay leaves alone).

Sinks are Parquet folders and checkpoints live under the shared checkpoint
location, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.operators.keywords import transform_keywords
from cohera.operators.score import coherence_scores, document_score_expr, pair_scores
from cohera.operators.scorers import document_scores
from cohera.operators.text_ops import build_prompt


def _run(writer, available_now: bool = True):
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        q.awaitTermination()
    return q


def stream_keywords(stream: DataFrame, idf: DataFrame, key: str, text: str, sink: str,
                    checkpoint: str, k: int = 10, available_now: bool = True):
    """ST1: top-k keywords of every arriving document. Each micro-batch owns
    the folder ``batch_id=<n>`` of ``sink`` and overwrites it, so a replayed
    batch changes nothing. ``idf`` is a saved table."""
    def batch(df, epoch_id):
        transform_keywords(df, idf, key, text, k).write.mode("overwrite").parquet(f"{sink}/batch_id={epoch_id}")
    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _run(w, available_now)


def append_parquet(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """Append a stateless stream to a Parquet folder, exactly once."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", sink) \
        .option("checkpointLocation", checkpoint)
    return _run(w, available_now)


def request_prompts(requests: DataFrame, idf: DataFrame, k: int = 10) -> DataFrame:
    """``requests`` (S8 columns) with ``prompt``: T7's keyword prompt from the
    title and the text's top-k keywords. A text that several requests repeat is
    read once; a null text counts as empty and has no keywords."""
    text = F.coalesce("review_text", F.lit(""))
    rows = requests.withColumn("_text_key", F.sha2(text, 256))
    texts = rows.select("_text_key", text.alias("_text")).distinct()
    kw = transform_keywords(texts, idf, "_text_key", "_text", k)
    prompt = build_prompt("keywords", title="product_title", keywords="keywords")
    return rows.join(kw.hint("merge"), "_text_key").select(*requests.columns, prompt.alias("prompt"))


def stream_prompts(log: DataFrame, idf: DataFrame, sink: str, checkpoint: str, k: int = 10,
                   available_now: bool = True):
    """ST1 end to end: a request-log stream (S8, with its ``malformed`` column)
    becomes keyword prompts under ``sink/prompts``; malformed lines keep their
    raw text under ``sink/malformed``. A replayed micro-batch overwrites its
    own ``batch_id=<n>`` folders."""
    def batch(df, epoch_id):
        good = df.where(F.col("malformed").isNull()).drop("malformed")
        request_prompts(good, idf, k).write.mode("overwrite").parquet(f"{sink}/prompts/batch_id={epoch_id}")
        df.where(F.col("malformed").isNotNull()).write.mode("overwrite").parquet(f"{sink}/malformed/batch_id={epoch_id}")
    return _run(log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), available_now)


def stream_scores(stream: DataFrame, sink: str, checkpoint: str, key: str = "doc_id",
                  sents: str = "sents", available_now: bool = True, scorer=None):
    """ST2: document score of every arriving document.

    The default and a scorer that keeps to the row (column form, batch model)
    stream in append mode; one that joins or groups runs each micro-batch in
    its own folder ``batch_id=<n>``, which a replay overwrites."""
    if scorer is None:
        out = stream.select(key, document_score_expr(coherence_scores(F.col(sents))).alias("doc_score"),
                            F.size(sents).alias("n_sents"))
    else:
        docs = stream.select(F.col(key).alias("doc_id"), F.col(sents).alias("sents"))
        if not scorer.stateless:
            def batch(df, epoch_id):
                document_scores(df, scorer).withColumnRenamed("doc_id", key).write.mode("overwrite").parquet(f"{sink}/batch_id={epoch_id}")
            return _run(docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), available_now)
        out = document_scores(docs, scorer).withColumnRenamed("doc_id", key)
    return append_parquet(out, sink, checkpoint, available_now)


def accuracy_stream(scored_pairs: DataFrame, by: str = "n_windows", event_time: str | None = None,
                    window: str = "1 hour", watermark: str = "10 minutes",
                    tie_digits: int = 9) -> DataFrame:
    """ST3 plan: running counts per ``by`` value (or per event-time window)."""
    win = (F.round("pos_score", tie_digits) > F.round("neg_score", tie_digits)).cast("long")
    s = scored_pairs.withColumn("_win", win)
    if event_time:
        s = s.withWatermark(event_time, watermark)
        g = s.groupBy(F.window(event_time, window).alias("window"), by)
    else:
        g = s.groupBy(by)
    return g.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("_win").alias("n_correct"))


def _scored(pairs: DataFrame) -> DataFrame:
    """Scores by the sides' overlaps or word sets, where ``pairs`` has them, else by their text."""
    words, sims = ("pos_words", "neg_words"), ("pos_sims", "neg_sims")
    has = lambda names: names if set(names) <= set(pairs.columns) else None
    return pair_scores(pairs, words=has(words), sims=has(sims))


def stream_accuracy(pairs_stream: DataFrame, sink: str, checkpoint: str, by: str = "n_windows",
                    available_now: bool = True):
    """ST3: score streamed pairs (array-form scorer) and keep the running
    accuracy per ``by``. Every micro-batch writes the current totals to its
    own folder, so a reader always finds a whole version
    (:func:`latest_totals`) and a replayed batch changes nothing."""
    agg = accuracy_stream(_scored(pairs_stream), by)

    def batch(df, epoch_id):
        df.withColumn("accuracy", F.col("n_correct") / F.col("n_pairs")) \
          .write.mode("overwrite").parquet(f"{sink}/batch_id={epoch_id}")
    w = agg.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _run(w, available_now)


def stream_window_accuracy(pairs_stream: DataFrame, sink: str, checkpoint: str, event_time: str,
                           by: str = "n_windows", window: str = "1 hour", watermark: str = "1 hour",
                           available_now: bool = True):
    """ST3 in event time: accuracy per tumbling window and ``by`` in update
    mode. State of windows behind the watermark is dropped and rows that arrive
    after that are ignored. A micro-batch writes only the windows it changed,
    as a version (its batch id) that a replay overwrites; read them with
    :func:`latest_windows`."""
    agg = accuracy_stream(_scored(pairs_stream), by, event_time, window, watermark)

    def batch(df, epoch_id):
        df.select(F.col("window.start").alias("window_start"), by, "n_pairs", "n_correct") \
          .write.mode("overwrite").parquet(f"{sink}/batch_id={epoch_id}")
    w = agg.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return _run(w, available_now)


def latest_windows(spark: SparkSession, sink: str, by: str = "n_windows") -> DataFrame:
    """Each window's newest version: one aggregation, whatever was replayed."""
    t = spark.read.parquet(sink).groupBy("window_start", by).agg(
        F.max(F.struct("batch_id", "n_pairs", "n_correct")).alias("v"))
    return t.select("window_start", by, "v.n_pairs", "v.n_correct",
                    (F.col("v.n_correct") / F.col("v.n_pairs")).alias("accuracy"))


def latest_totals(spark: SparkSession, sink: str) -> DataFrame:
    """The newest version of ST3's totals."""
    t = spark.read.parquet(sink)
    newest = t.agg(F.max("batch_id")).first()[0]
    return t.where(F.col("batch_id") == newest).drop("batch_id")


def file_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """A Parquet file-source stream (one file per micro-batch by default)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
