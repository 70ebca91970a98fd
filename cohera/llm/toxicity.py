"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max
inverted index; distance-weighted votes give a score and its evidence.

Terms are whole words and word beginnings of 4, 5 and 6 bytes (spellings that
vary in their ending share them).  Fitting uses at most ``per_class`` labelled
rows of each class, those of the least id hash, and keeps at most ``max_terms``
terms, those whose document rate in class 1 most exceeds that in class 0 (by
their z value); so the index has a size bound and is broadcast.  Scoring covers every document and
every word.

The score is ``(sum_i s_i y_i + prior) / (sum_i s_i + 1)`` over the ``k`` nearest
examples, s the cosine, y the label, prior the share of label 1 among all
training labels: far or few neighbours pull it to the prior.  Ties in the
cosine go to the smaller example id.

Null and empty texts, and texts without any kept term, score the prior.
Labels with a null id or null label are left out; of several labels of one id
the largest counts.  Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from cohera.llm.common import _BYTE, _powers, fold, map_texts, materialise, mix64, text_batches, word_batch

BLOCK = 64
PREFIXES = (4, 5, 6)
_EVIDENCE = StructType([StructField("score", DoubleType()), StructField("near_ids", ArrayType(LongType())),
                        StructField("near_labels", ArrayType(LongType())), StructField("near_cosines", ArrayType(DoubleType()))])


def batch_terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """``(term, text index)`` of all terms of a batch, with repeats."""
    h, first, starts, ends, data = word_batch(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    up, down = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    terms, owners = [h], [owner]
    for n in PREFIXES:
        long = ends - starts > n
        a = starts[long]
        terms.append(mix64((total[a + n] - total[a]) * down[a] + np.uint64(n * 0xC2B2AE3D27D4EB4F % (1 << 64))))
        owners.append(owner[long])
    return np.concatenate(terms), np.concatenate(owners)


def _distinct_terms(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, y, t)``: distinct terms of each labelled text."""
    def f(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in text_batches(texts):
                t, o = batch_terms(texts[part])
                u, at = np.unique(np.stack([o.astype(np.uint64), t]), axis=1, return_index=True)
                d, t = u[0].astype(np.int64), u[1]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[part][d],
                                    "y": pdf["y"].to_numpy()[part][d], "t": t.view(np.int64)})

    return docs.select("doc_id", "y", "text").mapInPandas(f, "doc_id bigint, y int, t bigint")


def labelled_rows(labels: DataFrame, label: str, n_folds: int, held_out: int) -> DataFrame:
    """``(doc_id, y)`` of the training folds, one row an id."""
    return (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
            .where(fold(F.col("doc_id"), n_folds) != held_out)
            .groupBy("doc_id").agg(F.max("y").alias("y")))


class BlockMaxIndex:
    """Postings of unit TF-IDF vectors in blocks of examples, with each
    block's largest weight; ``nearest`` is exact."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, examples: list[tuple[int, int, dict]]):
        order = np.argsort(terms)
        self.terms, self.idf = terms[order], idf[order]
        place = {int(t): i for i, t in enumerate(self.terms)}
        examples = sorted(examples, key=lambda e: e[0])
        self.ids = np.array([e[0] for e in examples], dtype=np.int64)
        self.y = np.array([e[1] for e in examples], dtype=np.float64)
        self.blocks = -(-len(examples) // BLOCK) or 1
        rows: list[list] = [[] for _ in range(len(self.terms))]
        for i, (_, _, tf) in enumerate(examples):
            js = np.array([place[t] for t in tf], dtype=np.int64)
            w = (1 + np.log(np.array(list(tf.values()), dtype=np.float64))) * self.idf[js] if len(js) else np.empty(0)
            norm = np.sqrt((w * w).sum())
            for j, x in zip(js, w):
                rows[j].append((i, x / norm))
        self.ptr = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        self.at = np.array([i for r in rows for i, _ in r], dtype=np.int64)
        self.w = np.array([x for r in rows for _, x in r], dtype=np.float64)
        # where each block begins in each term's postings
        self.cut = np.array([p + np.searchsorted(self.at[p:q], np.arange(self.blocks + 1) * BLOCK)
                             for p, q in zip(self.ptr[:-1], self.ptr[1:])], dtype=np.int64).reshape(len(rows), self.blocks + 1)
        self.top = np.zeros((len(self.terms), self.blocks), dtype=np.float64)
        np.maximum.at(self.top, (np.repeat(np.arange(len(rows)), np.diff(self.ptr)), self.at // BLOCK), self.w)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, t: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept terms among ``t``: their places and owners."""
        if not len(self.terms):
            return np.empty(0, np.int64), owner[:0]
        maybe = self.seen[(t & np.uint64(0xFFFF)).astype(np.int64)]
        t, owner = t[maybe], owner[maybe]
        j = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
        hit = self.terms[j] == t
        return j[hit], owner[hit]

    def nearest(self, j: np.ndarray, tf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and cosines of the ``k`` nearest examples with cosine > 0."""
        q = (1 + np.log(tf)) * self.idf[j]
        q = q / np.sqrt((q * q).sum())
        bound = q @ self.top[j]
        ids, sims, floor = np.empty(0, np.int64), np.empty(0), 0.0
        cuts = self.cut[j]
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(ids) >= k and bound[b] < floor - 1e-12):
                break  # no later block can enter the k best
            s = np.zeros(BLOCK)
            for (lo, hi), x in zip(cuts[:, b: b + 2].tolist(), q):
                if lo < hi:
                    s[self.at[lo:hi] - b * BLOCK] += x * self.w[lo:hi]
            own = np.flatnonzero(s > 0)
            ids, sims = np.concatenate((ids, own + b * BLOCK)), np.concatenate((sims, s[own]))
            best = np.lexsort((ids, -np.round(sims, 12)))[:k]
            ids, sims = ids[best], sims[best]
            floor = sims[-1] if len(sims) >= k else 0.0
        return ids, sims


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", n_folds: int = 3, held_out: int = 1,
        per_class: int = 1500, max_terms: int = 4096, min_z: float = 4.0) -> tuple[BlockMaxIndex, float]:
    """The index over the bounded labelled sample, and the prior."""
    rows = materialise(labelled_rows(labels, label, n_folds, held_out), "toxic-labels")
    share = rows.agg(F.avg("y")).first()[0] or 0.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = rows.where("y = 1").orderBy(*order).limit(per_class).unionByName(
        rows.where("y = 0").orderBy(*order).limit(per_class))
    ids = F.broadcast(materialise(pick, "toxic-sample"))  # at most 2 * per_class rows
    some = docs.select("doc_id", "text").join(ids, "doc_id").select(F.col("doc_id").cast("bigint"), "y", "text")
    some = materialise(some.dropDuplicates(["doc_id"]), "toxic-texts")
    terms = materialise(_distinct_terms(some).distinct(), "toxic-terms")
    n = {r["y"]: r["n"] for r in some.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return BlockMaxIndex(np.empty(0, np.uint64), np.empty(0), []), share
    df = terms.groupBy("t").agg(F.sum("y").alias("d1"), F.sum(1 - F.col("y")).alias("d0"))
    rate = (F.col("d1") + F.col("d0") + 1) / (n1 + n0)
    z = (F.col("d1") / n1 - F.col("d0") / n0) / F.sqrt(rate * (1.0 / n1 + 1.0 / n0))
    kept = df.withColumn("z", z).where((F.col("z") >= min_z) & (F.col("d1") + F.col("d0") >= 3))
    kept = kept.orderBy(F.col("z").desc(), "t").limit(max_terms).collect()
    terms = np.array([r["t"] for r in kept], dtype=np.int64).view(np.uint64)
    idf = np.log((1 + n1 + n0) / (1 + np.array([r["d1"] + r["d0"] for r in kept], dtype=np.float64))) + 1
    known = BlockMaxIndex(terms, idf, [])

    def vectors(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in text_batches(texts):
                j, o = known.find(*batch_terms(texts[part]))
                key, tf = np.unique(o * len(known.terms) + j, return_counts=True)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[part][key // len(known.terms)],
                                    "y": pdf["y"].to_numpy()[part][key // len(known.terms)],
                                    "t": known.terms[key % len(known.terms)].view(np.int64), "tf": tf})

    examples: dict[int, tuple[int, int, dict]] = {}
    if len(terms):
        for r in some.mapInPandas(vectors, "doc_id bigint, y int, t bigint, tf bigint").collect():
            examples.setdefault(r["doc_id"], (r["doc_id"], r["y"], {}))[2][r["t"] & (1 << 64) - 1] = r["tf"]
    return BlockMaxIndex(terms, idf, list(examples.values())), share


def score(docs: DataFrame, index: BlockMaxIndex, prior: float, k: int = 8) -> DataFrame:
    """``docs`` with ``score`` and the evidence: ids, labels and cosines of the
    nearest examples.  Columns of ``docs`` with those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = _EVIDENCE.names
    keep = [c for c in docs.columns if c not in names]

    def make(texts):
        ix = shared.value
        out = [(prior, [], [], []) for _ in texts]
        j, o = ix.find(*batch_terms(texts))
        if len(j):
            key, tf = np.unique(o * len(ix.terms) + j, return_counts=True)
            cut = np.flatnonzero(np.diff(key // len(ix.terms))) + 1
            for ks, n in zip(np.split(key, cut), np.split(tf, cut)):
                ids, sims = ix.nearest(ks % len(ix.terms), n, k)
                s = float((sims @ ix.y[ids] + prior) / (sims.sum() + 1))
                out[int(ks[0] // len(ix.terms))] = (s, ix.ids[ids].tolist(), ix.y[ids].astype(int).tolist(), sims.tolist())
        return {name: [x[i] for x in out] for i, name in enumerate(names)}

    return map_texts(docs, keep, _EVIDENCE.fields, make)


def drop_toxic(docs: DataFrame, index: BlockMaxIndex, prior: float, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, columns unchanged."""
    extra = [c for c in docs.columns if c in _EVIDENCE.names]
    safe = docs.withColumnsRenamed({c: f"__{c}" for c in extra})
    kept = score(safe, index, prior).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"__{c}").alias(c) if c in extra else F.col(c) for c in docs.columns])
