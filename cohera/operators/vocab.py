"""Vocabulary jobs.

A vocabulary is one table ``vocab(idx LONG, word STRING, cnt LONG)``; word->id
and id->word are joins on it, never a driver-side dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cohera.operators.sampling import dense_index, fixed_size, fixed_size_columns
from cohera.session import materialise

# Special tokens appended after the counted words (fixed values, in order).
VOCAB_SPECIALS = ["<unk>", "<pad>"]
LM_SPECIALS = ["<bos>", "<eos>"]

def build_vocab(counts: DataFrame, ratio: float = 1.0, specials=VOCAB_SPECIALS,
                word: str = "word", cnt: str = "cnt") -> DataFrame:
    """A2: most frequent ``int(n * ratio)`` words by count desc (ties: word
    asc), dense ids 0.., then the specials at ``n, n+1, ...`` (count 0).

    The dense index is computed by range partitioning + per-partition offsets
    (no single-partition window)."""
    c = counts.select(F.col(word).alias("word"), F.col(cnt).cast("long").alias("cnt"))
    c = c.withColumn("_neg", -F.col("cnt"))
    ranked, n = dense_index(c, ["_neg", "word"], "idx")
    ranked = ranked.drop("_neg")
    top = int(n * ratio)
    if ratio < 1.0:
        ranked = ranked.filter(F.col("idx") < top)
    return append_specials(ranked.select("idx", "word", "cnt"), specials, base=top)


def append_specials(vocab: DataFrame, specials, base: int | None = None) -> DataFrame:
    """Union special tokens at ids ``base, base+1, ...`` (default
    ``max(idx) + 1``)."""
    spark = vocab.sparkSession
    if base is None:
        m = vocab.agg(F.max("idx")).first()[0]
        base = 0 if m is None else m + 1
    sp = spark.createDataFrame([(base + i, w, 0) for i, w in enumerate(specials)],
                               "idx long, word string, cnt long")
    return vocab.unionByName(sp)


def lm_vocab(vocab: DataFrame, pad: str = "<pad>") -> DataFrame:
    """The language-model id space: the vocabulary plus ``<bos>``/``<eos>``,
    minus ``<pad>``, re-numbered densely in the old id order -- ids above the
    removed ``<pad>`` move down by one (arithmetic, no re-sort)."""
    v = append_specials(vocab, LM_SPECIALS)
    pad_row = vocab.filter(F.col("word") == pad).select("idx").first()
    if pad_row is None:
        return v
    p = pad_row[0]
    return v.filter(F.col("word") != pad).select(
        F.when(F.col("idx") > p, F.col("idx") - 1).otherwise(F.col("idx")).alias("idx"), "word", "cnt")


def extend_vocab(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """A3: append words not in ``vocab`` in order of first appearance
    (``tokens(doc_id, sent_idx, tok_idx, word)``); existing ids never change."""
    new = tokens.join(vocab.select("word"), "word", "left_anti")
    first = new.groupBy("word").agg(
        F.min(F.struct("doc_id", "sent_idx", "tok_idx")).alias("_first"),
        F.count(F.lit(1)).alias("cnt"))
    first = first.select("word", "cnt", "_first.doc_id", "_first.sent_idx", "_first.tok_idx")
    base = vocab.agg(F.max("idx")).first()[0]
    base = 0 if base is None else base + 1
    ranked, _ = dense_index(first, ["doc_id", "sent_idx", "tok_idx"], "_k")
    return vocab.unionByName(ranked.select((F.col("_k") + base).alias("idx"), "word", "cnt"))


def token_table(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """D2 long form ``(doc_id, sent_idx, tok_idx, word)`` from an
    ``ARRAY<ARRAY<STRING>>`` column."""
    s = docs.select("doc_id", F.posexplode(tokens).alias("sent_idx", "_t"))
    return s.select("doc_id", "sent_idx", F.posexplode("_t").alias("tok_idx", "word"))


def encode(tokens: DataFrame, vocab: DataFrame, oov: str = "unk",
           unk: str = "<unk>") -> DataFrame:
    """Word -> idx for a long token table; unknown words map to the id of
    ``unk`` (``oov='unk'``) or raise (``oov='error'``). Returns the token
    table with ``idx``."""
    v = vocab.select("word", "idx")
    j = tokens.join(v, "word", "left")
    if oov == "unk":
        unk_id = vocab.filter(F.col("word") == unk).select("idx").first()
        if unk_id is None:
            raise ValueError(f"vocabulary has no {unk!r}")
        return j.withColumn("idx", F.coalesce(F.col("idx"), F.lit(unk_id[0])))
    if oov == "error":
        return j.withColumn("idx", F.when(F.col("idx").isNull(),
                                          F.raise_error(F.concat(F.lit("word not in vocabulary: "),
                                                                 F.col("word"))))
                            .otherwise(F.col("idx")))
    raise ValueError(oov)


def encode_docs(docs: DataFrame, vocab: DataFrame, tokens: str = "tokens", oov: str = "unk",
                unk: str = "<unk>", commonest: int = 1 << 15) -> DataFrame:
    """J3 without moving tokens: ``docs`` with ``ids`` (``ARRAY<ARRAY<LONG>>``) for
    ``tokens`` (``ARRAY<ARRAY<STRING>>``), other columns unchanged.

    The ``commonest`` words -- ids count down from the most frequent, so their
    number bounds what each task gets -- are looked up where the document is. What
    is joined is one row a document and distinct other word, none of which is hot.
    A null array has null ids, an unknown or null word the id of ``unk``
    (``oov='unk'``) or raises (``oov='error'``)."""
    if oov not in ("unk", "error"):
        raise ValueError(oov)
    unk_id = vocab.filter(F.col("word") == unk).select("idx").first()
    if unk_id is None and oov == "unk":
        raise ValueError(f"vocabulary has no {unk!r}")
    table = vocab.select(F.col("word").alias("k"), F.col("idx").alias("v"))
    return _look_up(docs, tokens, "ids", table, "v", commonest, unk_id[0] if oov == "unk" else None,
                    "word not in vocabulary: " if oov == "error" else None)


def decode_docs(docs: DataFrame, vocab: DataFrame, ids: str = "ids", commonest: int = 1 << 15) -> DataFrame:
    """T11 in the document's row: ``docs`` with ``words`` for ``ids``, looked up as by
    :func:`encode_docs`; an id that the vocabulary has not is null."""
    table = vocab.select(F.col("idx").alias("k"), F.col("word").alias("v"))
    return _look_up(docs, ids, "words", table, "k", commonest)


def _look_up(docs: DataFrame, column: str, name: str, table: DataFrame, idx: str, commonest: int, miss=None, error=None) -> DataFrame:
    """``docs`` with ``name``: the values ``v`` of ``table(k, v)`` for the keys in the
    nested arrays ``column``. Rows of ``table`` whose ``idx`` is below ``commonest`` go to every
    task, the others to the documents that have their key. A key without a value takes
    ``miss``, or raises ``error``; of several values the one of least ``v`` counts."""
    table = table.filter("k IS NOT NULL")
    # read three times: written once, so nothing is tokenised again
    rows = materialise(docs.withColumn("_row", F.xxhash64("doc_id", column)), "look-up-rows")
    top = table.filter(F.col(idx) < commonest).groupBy("k").agg(F.min("v").alias("v"))
    common = fixed_size_columns(top)
    keys = rows.select("_row", F.explode(F.array_distinct(F.flatten(column))).alias("k")).filter("k IS NOT NULL")
    keys = keys.join(fixed_size(top.select("k")), "k", "left_anti")
    found = keys.join(table.filter(F.col(idx) >= commonest), "k")
    own = found.groupBy("_row").agg(F.collect_set(F.struct("k", "v")).alias("_d"))
    own = own.select("_row", F.col("_d.k").alias("_keys"), F.col("_d.v").alias("_values"))
    keep = [f for f in docs.schema.fields if f.name != name]
    value = table.schema["v"].dataType
    schema = StructType([*keep, StructField(name, ArrayType(ArrayType(value)))])

    def look_up(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def lists(like, values):
            return pa.ListArray.from_arrays(like.offsets, values, mask=like.is_null() if like.null_count else None)

        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns))
            rare = pa.table({"k": get["_keys"].flatten(), "v": get["_values"].flatten()}).group_by("k").aggregate([("v", "min")])
            k = pa.concat_arrays([common.value["k"].cast(rare["k"].type), rare["k"].combine_chunks()])
            v = pa.concat_arrays([common.value["v"].cast(rare["v_min"].type), rare["v_min"].combine_chunks()])
            sents = get[column]
            sents = sents if sents.offset == 0 else pa.concat_arrays([sents])
            words = sents.values
            flat = words.values
            at = pc.index_in(flat, value_set=k)
            if error and at.null_count:
                raise ValueError(f"{error}{flat.filter(at.is_null())[0]}")
            out = v.take(at)
            out = out.fill_null(miss) if miss is not None else out
            yield pa.RecordBatch.from_arrays([*(get[f.name] for f in keep), lists(sents, lists(words, out))], [*(f.name for f in keep), name])

    rows = rows.join(own, "_row", "left").select(*[f.name for f in keep], "_keys", "_values")
    return rows.mapInArrow(look_up, schema)


def regroup(long: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Ordered regroup after explode/join: ``collect_list(struct(order, value))``
    sorted, then the values (``collect_list`` alone is unordered)."""
    agg = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_a"))
    return agg.select(*keys, F.transform("_a", lambda s: s[value]).alias(name))


def decode_ids(ids_long: DataFrame, vocab: DataFrame, keys: list[str], order: str = "tok_idx",
               idx: str = "idx") -> DataFrame:
    """Ids -> words joined with spaces, per ``keys``."""
    j = ids_long.join(vocab.select(F.col("idx").alias(idx), "word"), idx, "left")
    r = regroup(j, keys, order, "word", "_w")
    return r.select(*keys, F.array_join("_w", " ").alias("text"))


def save_vocab(vocab: DataFrame, path: str) -> None:
    """One Parquet table replaces the three JSON files."""
    vocab.write.mode("overwrite").parquet(path)


def load_vocab(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
