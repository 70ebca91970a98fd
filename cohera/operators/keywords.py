"""TF-IDF keywords (A9, K1, K2) and keyword sampling (T15) as long tables.

Term rule (library defaults of the reference's vectoriser): lower-case,
tokens of two or more word characters, stop words removed; raw counts;
smoothed idf ``ln((1+N)/(1+df)) + 1``; rows L2-normalised. The matrix is
never densified: ``(doc, term, weight)`` rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohera.functions.hashing import md5_int, md5_key
from cohera.functions.text import STOP_WORDS, col
from cohera.session import materialise

TERM_RE = r"[\p{L}\p{N}_]{2,}"


def terms(text) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TERM_RE), 0)


def term_counts(docs: DataFrame, key: str, text: str, stop_words=None) -> DataFrame:
    """``(key, term, tf)`` raw counts, stop words removed (default: the
    library's fixed list; another is a parameter)."""
    stop = stop_words if stop_words is not None else STOP_WORDS
    t = docs.select(F.col(key), F.explode(terms(text)).alias("term"))
    # a literal IN list becomes a hash-set lookup (InSet), not a scan per term
    t = t.filter(~F.col("term").isin(list(stop)))
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(docs: DataFrame, key: str, text: str, stop_words=None,
              tf: DataFrame | None = None) -> DataFrame:
    """A9 fit: the idf table ``(term, df, idf)`` over ``docs`` (the saved
    model). ``tf`` may pass already computed term counts of ``docs``."""
    n = docs.count()
    tf = tf if tf is not None else term_counts(docs, key, text, stop_words)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0)


def tfidf_weights(docs: DataFrame, key: str, text: str, idf: DataFrame,
                  stop_words=None, tf: DataFrame | None = None) -> DataFrame:
    """``(key, term, weight)`` L2-normalised over the known terms of each doc
    (unknown terms ignored -- the transform rule for unseen text)."""
    tf = tf if tf is not None else term_counts(docs, key, text, stop_words)
    j = tf.join(idf.select("term", "idf"), "term", "inner")
    j = j.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return j.select(key, "term", (F.col("w") / norm).alias("weight"))


def top_keywords(weights: DataFrame, key: str, k: int = 10, docs: DataFrame | None = None) -> DataFrame:
    """K1: per document the ``k`` heaviest non-zero terms (ties: smaller
    term first), joined with a leading space each -> ``(key, keywords)``.
    With ``docs`` every document has a row, ``''`` where no term is left."""
    w = Window.partitionBy(key).orderBy(F.col("weight").desc(), F.col("term"))
    top = weights.filter(F.col("weight") != 0).withColumn("_r", F.row_number().over(w)) \
                 .filter(F.col("_r") <= k)
    agg = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("_t"))
    out = agg.select(key, F.concat_ws("", F.transform("_t", lambda s: F.concat(F.lit(" "), s["term"])))
                     .alias("keywords"))
    if docs is None:
        return out
    return docs.select(key).join(out.hint("merge"), key, "left").select(key, F.coalesce("keywords", F.lit("")).alias("keywords"))


def fit_transform_weights(docs: DataFrame, key: str, text: str, stop_words=None):
    """A9 fit and transform on the same documents with one tokenisation:
    the term counts are written once and feed both the idf fit and the weights.
    Returns ``(idf, weights)``."""
    tf = materialise(term_counts(docs, key, text, stop_words), "term-counts")
    idf = fit_tfidf(docs, key, text, stop_words, tf=tf)
    return idf, tfidf_weights(docs, key, text, idf, stop_words, tf=tf)


def transform_keywords(new_docs: DataFrame, idf: DataFrame, key: str, text: str,
                       k: int = 10, stop_words=None) -> DataFrame:
    """K2: apply an already fitted idf table to unseen text, then K1 (a row
    for every text). The joins merge: a stream does them in every micro-batch, and
    a broadcast would pass the idf table through the driver each time."""
    return top_keywords(tfidf_weights(new_docs, key, text, idf.hint("merge"), stop_words), key, k, docs=new_docs)


def sample_keywords(keywords: Column, seed, key: Column) -> Column:
    """Keep a random-length prefix (0..n) of the keyword list, shuffle
    it, join with commas. Length = ``md5int(seed|key) mod (n+1)``; order by
    ``md5(seed|key|keyword)``."""
    kw = col(keywords)
    n = F.size(kw)
    size = F.pmod(md5_int(seed, key), n + 1)
    pref = F.slice(kw, 1, size.cast("int"))
    shuffled = F.transform(F.array_sort(F.transform(
        pref, lambda x: F.struct(md5_key(seed, key, x).alias("r"), x.alias("k")))), lambda s: s["k"])
    return F.when(size == 0, F.lit("")).otherwise(F.array_join(shuffled, ","))
