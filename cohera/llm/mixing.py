"""Mixing sources to target weights in fixed-length token blocks.

1. Sizes: words of every text, added up by source.  Targets: the sources by
   code point (null last) weigh 1, 2, 3, repeating, and share all words by
   weight; a target stops at ``max_epochs`` times its source's size, and the
   excess is shared again by weight until no target is above.
2. A source's documents, in the order of a hash of their row, form one stream
   of words, cut into blocks of ``block_words``.  Offsets come from two levels
   of running sums (hash buckets, then rows of one bucket), so no task holds a
   source.
3. A source's target is so many whole passes over its blocks and one part of a
   pass.  Its slots are drawn over the output shards by one multinomial each.
4. Slot i of a pass takes block ``P(i)``, P a keyed permutation of the source's
   block numbers (a four-round Feistel network, walked until the number is in
   range); a pass never takes a block twice, so no document is taken more than
   ``max_epochs`` times.
5. Slots join blocks by (source, block).

The result depends only on the rows and the seed.  Rows are told apart by id,
text and source; repeated rows share their group's taken words evenly, the
remainder to any one of them.  A null text has size 0 and is never taken; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohera.llm.common import materialise, mix64

#: hash buckets of a source's stream
BUCKETS = 4096
_SLOT = ["skey", "pass", "blocks", "lo", "hi", "shard"]


def n_words(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    The table has one row a source.  The share of one unit of weight is raised
    until no further source is capped; the driver holds two sums a round."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(w) - 1) % 3 + 1).cast("double"))
    s = materialise(s.withColumn("cap", F.col("source_size") * float(max_epochs)), "mix-sources")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    unit, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * unit
        r = s.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("used"),
                  F.sum(F.when(~full, F.col("weight"))).alias("open"),
                  F.count(F.when(full, 1)).alias("n")).first()
        if r["n"] == capped or not r["open"]:
            break
        capped, unit = r["n"], (total - r["used"]) / r["open"]
    return s.select("source", "source_size", "weight", F.least("cap", F.col("weight") * unit).alias("target"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of ``range(n)`` at ``index``: Feistel, cycle-walked."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key & (1 << 64) - 1))

    def once(x):
        a, b = x >> np.uint64(half), x & low
        for k in keys:
            a, b = b, a ^ (mix64(b + k) & low)
        return (a << np.uint64(half)) | b

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _slots(sources: DataFrame, block_words: int, shard_words: int, total: int, seed: int) -> DataFrame:
    """``skey, pass, lo, hi, shard``: ranges of slots of each pass in a shard."""
    shards = max(1, -(-total // shard_words))

    def f(batches):
        for pdf in batches:
            for skey, size, target in zip(pdf["skey"], pdf["source_size"], pdf["target"]):
                if not size:
                    continue
                blocks = -(-size // block_words)
                whole = int(target // size)
                part = min(blocks, int(round((target - whole * size) / size * blocks)))
                rng = np.random.default_rng([seed, skey & (1 << 63) - 1])
                counts = rng.multinomial(whole * blocks + part, np.full(shards, 1.0 / shards))
                at, rows = 0, []
                for shard, c in enumerate(counts):
                    while c:
                        p, lo = divmod(at, blocks)
                        n = min(int(c), blocks - lo)
                        rows += [(skey, p, blocks, a, min(a + 4096, lo + n), shard) for a in range(lo, lo + n, 4096)]
                        at, c = at + n, c - n
                        if len(rows) > 10_000:
                            yield pd.DataFrame(rows, columns=_SLOT)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_SLOT)

    return sources.select("skey", "source_size", "target").mapInPandas(
        f, "skey bigint, pass int, blocks bigint, lo bigint, hi bigint, shard bigint")


def _drawn_blocks(slots: DataFrame, seed: int) -> DataFrame:
    """``skey, block, shard``: the block of every slot."""
    def f(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key = int(mix64(np.array([r.skey & (1 << 64) - 1], dtype=np.uint64) ^ np.uint64(seed * 1000003 + r[1]))[0])
                b = permuted(np.arange(r.lo, r.hi), r.blocks, key)
                yield pd.DataFrame({"skey": r.skey, "block": b, "shard": r.shard})

    return slots.mapInPandas(f, "skey bigint, block bigint, shard bigint")


def plan_mix(docs: DataFrame, block_words: int = 256, shard_words: int = 1 << 24, max_epochs: int = 3,
             seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, text, source, ...)``: ``(documents, pieces, draws)``.

    ``documents``: ``rkey, doc_id, source, copies, size, source_size, target``,
    one row for equal rows; ``pieces``: ``rkey, skey, block, at, words``, the
    part of a document in a block, first word ``at``; ``draws``: ``skey, block,
    shard``, a row each time that a shard takes a block.
    """
    skey = F.xxhash64(F.col("source").isNull(), "source")
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tkey"))
    rows = rows.groupBy("doc_id", "source", "tkey").agg(F.max("size").alias("size"), F.count("*").alias("copies"))
    rows = rows.select(F.xxhash64("doc_id", "tkey", F.col("source").isNull(), "source").alias("rkey"), skey.alias("skey"),
                       "doc_id", "source", "size", "copies", (F.col("size") * F.col("copies")).alias("span"))
    rows = materialise(rows.withColumn("bucket", F.pmod("rkey", F.lit(BUCKETS))), "mix-rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("span").alias("source_size")), max_epochs)
    targets = materialise(targets.withColumn("skey", skey), "mix-targets")
    total = int(targets.agg(F.sum("source_size")).first()[0] or 0)
    up = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("skey", "bucket").agg(F.sum("span").alias("words"))
    base = base.select("skey", "bucket", F.coalesce(F.sum("words").over(up), F.lit(0)).alias("base"))
    inner = Window.partitionBy("skey", "bucket").orderBy("rkey", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("off", F.coalesce(F.sum("span").over(inner), F.lit(0))).join(base.hint("merge"), ["skey", "bucket"])
    placed = placed.where("span > 0").select("rkey", "skey", "span", (F.col("base") + F.col("off")).alias("off"))
    pieces = placed.withColumn("block", F.explode(F.expr(f"sequence(off div {block_words}, (off + span - 1) div {block_words})")))
    at = F.greatest(F.col("block") * block_words, F.col("off"))
    end = F.least((F.col("block") + 1) * block_words, F.col("off") + F.col("span"))
    pieces = pieces.select("rkey", "skey", "block", (at - F.col("off")).alias("at"), (end - at).alias("words"))
    slots = _slots(targets, block_words, shard_words, total, seed)
    slots = materialise(slots, "mix-slots").repartition("skey", "lo", "pass", "shard")
    draws = _drawn_blocks(slots, seed)
    documents = rows.join(targets.select("skey", "source_size", "target"), "skey")
    return documents, pieces, draws


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards`` for every row."""
    documents, pieces, draws = plan_mix(docs, **options)
    n = draws.groupBy("skey", "block").agg(F.count("*").alias("times"), F.collect_set("shard").alias("shards"))
    took = pieces.join(n.hint("merge"), ["skey", "block"])
    took = took.groupBy("rkey").agg(F.sum(F.col("words") * F.col("times")).alias("words"),
                                    F.array_distinct(F.flatten(F.collect_list("shards"))).alias("shards"))
    out = documents.join(took.hint("merge"), "rkey", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    share = F.expr("words div copies") + F.when(F.col("copy") <= F.col("words") % F.col("copies"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", share.cast("bigint").alias("taken"),
                      F.coalesce(F.array_sort("shards"), F.array().cast("array<bigint>")).alias("shards"))
