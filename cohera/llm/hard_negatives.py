"""Hard negatives by a secondary-sort shuffle.

For each anchor row: its positives are the ``k_pos`` best other rows of its
label, and each positive opens a window of scores, ``low`` to ``high`` percent of
its own; the first ``k_neg`` rows of another label in the window are its hard
negatives.  A score is the integer inner product of ``floor(scale * x)``
vectors; higher scores come first, ties by smaller ``vec_id``.

1. Anchors and data meet in blocks of bounded bytes (a chunk of anchors, a part
   of the data), scored by a matrix product.  A first pass keeps each block's
   ``k_pos`` best rows of the anchor's label; a window function over anchors merges
   them into the anchor's positives.
2. A second pass, which knows the positives' windows, keeps of each block only
   the first ``k_neg`` rows of each window: no other row can be among the first
   ``k_neg`` of all blocks.
3. Positives and negatives become keys of fixed width, ``(anchor, row of the
   anchor, descending score, vec_id, kind)`` in bytes that sort in that order;
   ``repartitionAndSortWithinPartitions`` brings an anchor's keys together in
   order, and one pass over the iterator opens a window at each positive, emits
   negatives into the open windows and closes a window that is full or passed.
   It holds the open windows and ``k_neg`` ids, never an anchor's rows.

A row takes no part if its id, label or vector is null, or a component is null
or not finite; shorter vectors count as padded with zeros.  Equal rows (id, label
and vector) count once; rows that share an id only are rows of their own, as
anchors, positives and negatives alike.  A positive of a negative score has no
window; one of score 0 has the window of score 0 alone.  A component or a score
beyond 64 bits counts as the least or greatest long.  Other columns are ignored.
Empty tables, and anchors without positives, give no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohera.llm.common import materialise

#: bytes of vectors in a block's part of the data, and in its chunk of anchors
PART_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20
#: anchors and rows of data in one matrix product
STEP_ANCHORS, STEP_ROWS = 512, 8192
_LONG = (1 << 63) - 1
_KEY = struct.Struct(">QQQQBQ")
SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _clean(df: DataFrame, scale: float) -> DataFrame:
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(ok).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v")).distinct()


def _matrix(vs, dim: int) -> np.ndarray:
    out = np.zeros((len(vs), dim), dtype=np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _each(n: int) -> Column:
    return F.explode(F.expr(f"sequence(0L, {n - 1}L)"))


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products: floats hold them exactly, else Python's integers do."""
    if exact:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -_LONG, _LONG).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the columns ``at`` with the highest scores, ties by id."""
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, -k)[-k]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _key(anchor: int, row: int, score: int, vec_id: int, kind: int, other: int) -> bytes:
    """Sorts by anchor, anchor's row, descending score, id."""
    return _KEY.pack(anchor + _LONG + 1, row, _LONG - score, vec_id + _LONG + 1, kind, other)


def emit(keys: Iterator[tuple[bytes, None]], k_neg: int, low: int, high: int) -> Iterator[tuple]:
    """Hard negatives from keys in order."""
    at, windows, zeros = None, [], []
    for key, _ in keys:
        anchor, row, score, vec_id, positive, _ = _KEY.unpack(key)
        anchor, score, vec_id = anchor - _LONG - 1, _LONG - score, vec_id - _LONG - 1
        if at != (anchor, row):
            at, windows, zeros = (anchor, row), [], []
        if positive:
            if score >= 0:
                before = zeros if score == 0 else []  # of the same score, but smaller ids
                for i, z in enumerate(before):
                    yield anchor, vec_id, i + 1, z, 0, 0
                windows.append([vec_id, score, len(before)])
            continue
        if score == 0 and len(zeros) < k_neg:
            zeros.append(vec_id)
        for w in windows:
            if low * w[1] <= 100 * score <= high * w[1] and w[2] < k_neg:
                w[2] += 1
                yield anchor, w[0], w[2], vec_id, w[1], score
        windows = [w for w in windows if w[2] < k_neg and low * w[1] <= 100 * score]


def mine(vectors: DataFrame, is_anchor: Column, k_pos: int = 5, k_neg: int = 3, low: int = 50, high: int = 95,
         scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` of the anchors among ``vectors`` (``vec_id, label,
    embedding``); ``is_anchor`` is a condition on ``vec_id`` and ``label``."""
    if not 0 <= low <= high < 100:
        raise ValueError("the window must lie between 0 and 99 percent of the positive's score")
    spark = vectors.sparkSession
    rows = _clean(vectors, scale).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "negatives-vectors")
    big = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    st = rows.agg(F.max(F.size("v")).alias("dim"), F.max(big).alias("big"), F.count(F.lit(1)).alias("n"),
                  F.count_if("anchor").alias("anchors")).first()
    dim = max(1, st["dim"] or 0)
    exact = (st["big"] or 0) ** 2 * dim < 1 << 52
    parts = max(1, -(-st["n"] * 8 * dim // PART_BYTES))
    chunks = max(1, -(-st["anchors"] * 8 * dim // CHUNK_BYTES))
    part, chunk = F.pmod(F.xxhash64("row"), F.lit(parts)), F.pmod(F.xxhash64("row"), F.lit(chunks))
    none = F.lit(None).cast("array<bigint>").alias("wins")
    data = rows.select("vec_id", "label", "v", "row", F.lit(False).alias("anchor"), none, part.alias("part"),
                       _each(chunks).alias("chunk"))

    def meet(anchors: DataFrame) -> DataFrame:
        a = anchors.select("vec_id", "label", "v", "row", F.lit(True).alias("anchor"), "wins",
                           _each(parts).alias("part"), chunk.alias("chunk"))
        return data.unionByName(a).groupBy("part", "chunk")

    def blocks(pdf: pd.DataFrame):
        """For each anchor and slice of the data: the anchor, scores, slice."""
        a, d = pdf[pdf["anchor"]], pdf[~pdf["anchor"]]
        for i in range(0, len(a), STEP_ANCHORS):
            some = a.iloc[i: i + STEP_ANCHORS]
            q = _matrix(some["v"], dim)
            for j in range(0, len(d), STEP_ROWS):
                x = d.iloc[j: j + STEP_ROWS]
                ids, label, row = x["vec_id"].to_numpy(), x["label"].to_numpy(), x["row"].to_numpy()
                score = _scores(q, _matrix(x["v"], dim), exact)
                for one, s in zip(some.itertuples(index=False), score):
                    yield one, s, ids, label, row

    def same_label(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for one, s, ids, label, row in blocks(pdf):
            best = _first(s, ids, np.flatnonzero((label == one.label) & (row != one.row)), k_pos)
            out += zip([one.row] * len(best), s[best], ids[best], row[best])
        return pd.DataFrame(out, columns=["row", "score", "vec_id", "other"]).astype("int64")

    anchors = rows.where("anchor")
    found = meet(anchors.withColumn("wins", none)).applyInPandas(same_label, "row bigint, score bigint, vec_id bigint, other bigint")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", "other")
    positives = materialise(found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k_pos).drop("k"), "negatives-positives")
    wins = positives.where("score >= 0").groupBy("row").agg(F.collect_set("score").alias("wins"))  # k_pos scores at most
    anchors = anchors.join(wins, "row")

    def other_label(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for one, s, ids, label, row in blocks(pdf):
            else_ = label != one.label
            keep = set()
            for p in map(int, one.wins):
                lo, hi = -(-low * p // 100), high * p // 100
                keep.update(_first(s, ids, np.flatnonzero(else_ & (s >= lo) & (s <= hi)), k_neg).tolist())
            out += [(_key(one.vec_id, one.row, int(s[j]), int(ids[j]), 0, int(row[j])),) for j in keep]
        return pd.DataFrame(out, columns=["key"])

    negatives = meet(anchors).applyInPandas(other_label, "key binary")
    opened = positives.join(rows.where("anchor").select("row", F.col("vec_id").alias("anchor_id")), "row")
    keys = negatives.rdd.map(lambda r: (bytes(r["key"]), None)).union(opened.rdd.map(
        lambda r: (_key(r["anchor_id"], r["row"], r["score"], r["vec_id"], 1, r["other"]), None)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:16]))
    return spark.createDataFrame(ordered.mapPartitions(lambda it: emit(it, k_neg, low, high)), SCHEMA, verifySchema=False)
