"""File readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohera.operators.permute import gather, kept_order, pair_name
from cohera.operators.sampling import hash_unit

# The 9 review columns, in file order (fixed values).
REVIEW_COLUMNS = ["DOC_ID", "LABEL", "RATING", "VERIFIED_PURCHASE", "PRODUCT_CATEGORY",
                  "PRODUCT_ID", "PRODUCT_TITLE", "REVIEW_TITLE", "REVIEW_TEXT"]
REVIEW_SCHEMA = T.StructType([
    T.StructField(c, T.IntegerType() if c == "RATING" else T.StringType(), True)
    for c in REVIEW_COLUMNS])

# The 15 marketplace sample columns, in file order (fixed values).
MARKETPLACE_SCHEMA = T.StructType([
    T.StructField("marketplace", T.StringType()), T.StructField("customer_id", T.StringType()),
    T.StructField("review_id", T.StringType()), T.StructField("product_id", T.StringType()),
    T.StructField("product_parent", T.StringType()), T.StructField("product_title", T.StringType()),
    T.StructField("product_category", T.StringType()), T.StructField("star_rating", T.IntegerType()),
    T.StructField("helpful_votes", T.IntegerType()), T.StructField("total_votes", T.IntegerType()),
    T.StructField("vine", T.StringType()), T.StructField("verified_purchase", T.StringType()),
    T.StructField("review_headline", T.StringType()), T.StructField("review_body", T.StringType()),
    T.StructField("review_date", T.StringType()),
])

# Request-log columns of the demo's flagging CSV (fixed values).
REQUEST_LOG_SCHEMA = T.StructType([
    T.StructField("product_title", T.StringType()), T.StructField("review_text", T.StringType()),
    T.StructField("max_len", T.IntegerType()), T.StructField("n_sequences", T.IntegerType()),
    T.StructField("output", T.StringType()), T.StructField("flag", T.StringType()),
    T.StructField("username", T.StringType()), T.StructField("ts", T.StringType()),
])


def read_reviews(spark: SparkSession, path: str, header: str = "skip") -> DataFrame:
    """Tab-separated review files with the 9 fixed columns.

    ``header='skip'`` (default) skips a header line; ``header='data'``
    reproduces the reference's reader, which keeps the header line as a data
    row (its RATING then reads as null)."""
    r = (spark.read.schema(REVIEW_SCHEMA).option("sep", "\t").option("quote", '"')
         .option("escape", '"').option("multiLine", True)
         .option("header", header == "skip").option("mode", "PERMISSIVE"))
    return r.csv(path)


def write_reviews(df: DataFrame, path: str) -> None:
    (df.select(*REVIEW_COLUMNS).write.mode("overwrite").option("sep", "\t")
       .option("header", True).option("quote", '"').option("escape", '"').csv(path))


def write_splits(df: DataFrame, frac: float, seed: int, key: str, path: str) -> None:
    """Complementary ``frac`` / ``1-frac`` files (test / train) from one
    hash column, with a header and no index column."""
    u = hash_unit(seed, F.col(key))
    write_reviews(df.filter(u < frac), path + "/test")
    write_reviews(df.filter(u >= frac), path + "/train")


def read_marketplace_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The 15-column headered marketplace sample, mapped onto the review
    schema (mapping: review_id->DOC_ID, star_rating->RATING,
    verified_purchase->VERIFIED_PURCHASE, product_category, product_id,
    product_title, review_headline->REVIEW_TITLE, review_body->REVIEW_TEXT;
    LABEL is null). ``review_date`` is parsed to DATE and kept."""
    raw = (spark.read.schema(MARKETPLACE_SCHEMA).option("sep", "\t").option("header", True)
           .option("quote", "").csv(path))
    return raw.select(
        F.col("review_id").alias("DOC_ID"), F.lit(None).cast("string").alias("LABEL"),
        F.col("star_rating").alias("RATING"), F.col("verified_purchase").alias("VERIFIED_PURCHASE"),
        F.col("product_category").alias("PRODUCT_CATEGORY"), F.col("product_id").alias("PRODUCT_ID"),
        F.col("product_title").alias("PRODUCT_TITLE"), F.col("review_headline").alias("REVIEW_TITLE"),
        F.col("review_body").alias("REVIEW_TEXT"), F.to_date("review_date").alias("review_date"))


def read_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    """S3: a path list -> ``manifest(split, path, doc_id)``; the document
    name is the last path part (the reference keeps the last two parts and
    appends ``.EGrid`` to find the grid file: ``grid_name``)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    p = F.trim(F.col("value"))
    last2 = F.substring_index(p, "/", -2)
    return lines.select(F.lit(split).alias("split"), p.alias("path"),
                        F.substring_index(p, "/", -1).alias("doc_id"),
                        F.concat(last2, F.lit(".EGrid")).alias("grid_name"))


def restrict_to_manifest(files: DataFrame, manifest: DataFrame, n_neg: int = 40) -> DataFrame:
    """S3: keep the manifest's documents plus their numbered negatives
    ``name-1 ... name-n_neg`` (left-semi join on the expanded name list)."""
    negs = manifest.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(n_neg))).alias("_i"))
    names = manifest.select("doc_id").union(
        negs.select(F.concat(F.col("doc_id"), F.lit("-"), F.col("_i").cast("string")).alias("doc_id")))
    return files.join(names.distinct(), "doc_id", "left_semi")


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The pair table, partitioned by ``split`` and ``n_windows`` (so a
    reader of one split/window count prunes the rest); ``fmt='json'`` writes
    JSON lines instead. Pairs in nested form (``negatives_of(nested=True)``) keep a
    document's text once a window count, with its negatives' index arrays."""
    w = pairs.write.mode("overwrite").partitionBy("split", "n_windows")
    (w.json(path) if fmt == "json" else w.parquet(path))


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The pair table that :func:`write_pairs` wrote, one row a pair in any case."""
    t = spark.read.json(path) if fmt == "json" else spark.read.parquet(path)
    if "negs" not in t.columns:
        return t
    t = t.select("*", F.inline("negs")).withColumn("neg", gather(F.col("pos"), kept_order(F.col("perm"))))
    return t.select(pair_name(F.col("doc_id")).alias("pair_id"), "doc_id", "perm_no", "perm", "pos", "neg", "split", "n_windows")


def _request_log(reader, path: str, malformed: bool) -> DataFrame:
    schema = REQUEST_LOG_SCHEMA
    if malformed:
        schema = T.StructType([*schema.fields, T.StructField("malformed", T.StringType())])
        # every column is parsed, else a line's faults depend on the columns asked for
        reader = reader.option("columnNameOfCorruptRecord", "malformed").option("columnPruning", False)
    df = (reader.schema(schema).option("header", True).option("quote", "'").option("escape", "'")
          .option("multiLine", True).option("mode", "PERMISSIVE").csv(path))
    return df.withColumn("ts", F.try_to_timestamp("ts"))


def read_request_log(spark: SparkSession, path: str, malformed: bool = False) -> DataFrame:
    """The demo's request log (single-quote CSV with a header). With
    ``malformed`` a column of that name holds the raw line where a row has too
    few or many fields or a field of the wrong type, and null elsewhere."""
    return _request_log(spark.read, path, malformed)


def stream_request_log(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """S8 as a stream over a folder that log files are added to, with the
    ``malformed`` column of :func:`read_request_log`."""
    return _request_log(spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger), path, True)


TRAINING_LOG_SCHEMA = T.StructType([
    T.StructField("best_metric", T.DoubleType()),
    T.StructField("best_model_checkpoint", T.StringType()),
    T.StructField("epoch", T.DoubleType()),
    T.StructField("global_step", T.LongType()),
    T.StructField("max_steps", T.LongType()),
    T.StructField("num_train_epochs", T.LongType()),
    T.StructField("total_flos", T.DoubleType()),
    T.StructField("log_history", T.ArrayType(T.StructType([
        T.StructField("epoch", T.DoubleType()), T.StructField("step", T.LongType()),
        T.StructField("learning_rate", T.DoubleType()), T.StructField("loss", T.DoubleType()),
        T.StructField("eval_loss", T.DoubleType()), T.StructField("eval_runtime", T.DoubleType()),
        T.StructField("eval_samples_per_second", T.DoubleType()),
        T.StructField("eval_steps_per_second", T.DoubleType()),
    ]))),
])


def read_training_log(spark: SparkSession, path: str, multi_line: bool = True,
                      run_col: str | None = None) -> DataFrame:
    """Explode a trainer state's ``log_history`` into rows ``(run, epoch,
    step, learning_rate, loss, eval_loss, ...)``; train rows have ``loss``,
    eval rows ``eval_loss``. ``run`` = the parent folder of the file, or the
    field ``run_col`` of each JSON object (``multi_line=False``: one state
    object per line)."""
    schema = TRAINING_LOG_SCHEMA
    if run_col:
        schema = T.StructType(schema.fields + [T.StructField(run_col, T.StringType())])
    raw = (spark.read.schema(schema).option("multiLine", multi_line).json(path)
           .withColumn("_path", F.input_file_name()))
    run = F.col(run_col) if run_col else F.element_at(F.split("_path", "/"), -2)
    e = raw.select(run.alias("run"), F.explode("log_history").alias("h"))
    return e.select("run", "h.*")


def write_training_log(log: DataFrame, path: str, run: str = "run") -> None:
    """One trainer-state object per run (``log_history`` ordered by step)
    as JSON lines -- the S9 reader's ``multi_line=False`` input."""
    cols = ["epoch", "step", "learning_rate", "loss", "eval_loss"]
    g = log.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(
        F.col("step"), *[F.col(c) for c in cols if c != "step"]))).alias("log_history"))
    g.write.mode("overwrite").json(path)
