"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased words; a window is as many words as an item has, and its
features are its five-word shingles with their multiplicities as weights (an
item or text of fewer than five words is one shingle).  Steps:

1. A window that shares no shingle with any item has similarity 0, so only the
   positions of shingles that items hold are joined (a join of two tables of
   hashes; Spark chooses its kind by their sizes).
2. Around each such position all windows of that item's length are formed, and
   equal windows (a passage that many documents share) are fingerprinted once.
3. SimHash: 64 signs of weighted sums over the window's shingles.  Multi-index:
   both fingerprints are cut into ``radius + 1`` blocks; two fingerprints within
   the radius agree on a whole block, so a join on (length, block number, block)
   finds all of them, and the Hamming distance is checked.
4. The weighted Jaccard similarity of each candidate (sum of minima over sum
   of maxima of the multiplicities) is computed exactly; ``similarity`` or more
   is a leak.

Nulls: a null text or item has no words and never matches; a null ``doc_id``
is carried through.  Repeated rows are reported each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.llm.common import materialise

SHINGLE = 5
BITS = 64


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(h: Column) -> Column:
    """Hashes of the five-word shingles of an array of word hashes."""
    at = F.sequence(F.lit(0), F.size(h) - SHINGLE)
    many = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(h) >= SHINGLE, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(sh: Column) -> Column:
    """SimHash of an array of hashes, within its row: a bit is set where at least
    half of the members have it."""
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda fp, b: F.when(
        2 * F.size(F.filter(sh, lambda x: F.getbit(x, b) == 1)) >= F.size(sh),
        fp.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(fp))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """``(first bit, width)`` of ``radius + 1`` blocks that cover all bits."""
    n = radius + 1
    edge = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge[:-1], edge[1:])]


def _indexed(df: DataFrame, radius: int) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << w) - 1}L").alias("v"))
                      for i, (a, w) in enumerate(_blocks(radius))])
    return df.withColumn("block", F.explode(parts))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity``: each document's best
    window (of equals the first) for each item that it leaks."""
    return _leaking(docs, benchmark, similarity, radius).drop("body")


def _leaking(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int) -> DataFrame:
    """:func:`leaks` with ``body``, the hash of the row's text."""
    items = benchmark.select("item_id", _word_hashes(F.col("text")).alias("h")).select(
        "item_id", F.size("h").alias("n"), _shingles(F.col("h")).alias("sh")).where("n > 0")
    items = materialise(items, "bench-items")
    held = items.select("n", F.explode("sh").alias("x")).distinct()
    lengths = held.groupBy("x").agg(F.collect_set("n").alias("ns"))  # as many as there are item lengths
    # a body is a text by its hash: equal texts are searched once
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("body"))

    def shingled(df):
        return df.withColumn("h", _word_hashes(F.col("text"))).select("body", _shingles(F.col("h")).alias("sh"))

    hits = shingled(texts).select("body", F.posexplode_outer("sh").alias("pos", "x")).join(materialise(lengths, "bench-lengths"), "x")
    hits = hits.groupBy("body", "pos").agg(F.first("ns").alias("ns"), F.count("*").alias("c"))
    hits = materialise(hits, "bench-hits")
    # the same kind of join at every size: the texts that hold hits grow with the documents
    some = texts.join(hits.select("body").distinct().hint("merge"), "body", "left_semi")
    some = materialise(some, "bench-texts")
    bodies = shingled(some.dropDuplicates(["body"]))
    m = F.greatest(F.col("n") - SHINGLE + 1, F.lit(1))
    reach = hits.select("body", "pos", F.explode("ns").alias("n")).withColumn("m", m)
    starts = reach.select("body", "n", "m", F.explode(F.expr("sequence(greatest(pos - m + 1, 0), pos)")).alias("start")).distinct()
    win = starts.join(bodies, "body").where((F.col("start") == 0) | (F.col("start") + F.col("m") <= F.size("sh")))
    win = win.select("body", "n", "start", F.expr("slice(sh, start + 1, m)").alias("sh"))
    win = win.withColumn("wkey", F.xxhash64("n", "sh"))
    win = materialise(win, "bench-windows")
    distinct = win.groupBy("wkey").agg(F.first("n").alias("n"), F.first("sh").alias("sh"))
    distinct = materialise(distinct, "bench-distinct")
    wfp = distinct.select("wkey", "n", _fingerprint(F.col("sh")).alias("fp"))
    ifp = items.select("item_id", "n", _fingerprint(F.col("sh")).alias("fp"))
    near = _indexed(wfp, radius).alias("w").join(
        _indexed(ifp, radius).alias("i"),
        (F.col("w.n") == F.col("i.n")) & (F.col("w.block") == F.col("i.block"))
        & (F.bit_count(F.col("w.fp").bitwiseXOR(F.col("i.fp"))) <= radius))
    near = near.select("wkey", "item_id").distinct()

    def weights(df, *key):
        return df.select(*key, F.explode("sh").alias("x")).groupBy(*key, "x").agg(F.count("*").alias("c"))

    w = near.join(distinct.select("wkey", "sh"), "wkey")
    w = w.select("wkey", "item_id", F.size("sh").alias("m"), "sh")
    both = weights(w, "wkey", "item_id", "m").join(
        weights(items, "item_id").withColumnsRenamed({"c": "ci"}), ["item_id", "x"])
    least = both.groupBy("wkey", "item_id", "m").agg(F.sum(F.least("c", "ci")).alias("low"))
    sim = least.join(items.select("item_id", F.size("sh").alias("mi")), "item_id")
    sim = sim.select("wkey", "item_id", (F.col("low") / (F.col("m") + F.col("mi") - F.col("low"))).alias("similarity"))
    sim = sim.where(F.col("similarity") >= similarity)
    found = win.select("wkey", "body", "start", "n").join(sim, "wkey")
    best = found.groupBy("body", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    out = some.select("doc_id", "body").join(best, "body")
    return out.select("doc_id", "body", "item_id", (-F.col("best.back")).alias("start"), F.col("best.n").alias("n_words"),
                      F.col("best.similarity").alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """The rows of ``docs`` that leak no item: rows go by id and text, a null id
    included, so another text of the same id stays."""
    bad = _leaking(docs, benchmark, similarity, radius).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__body"))
    return docs.join(bad, same, "left_anti")
