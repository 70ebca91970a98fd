"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are integer arrays.  With M the largest norm, the data vector x becomes
``(x, sqrt(M^2 - |x|^2))`` and the query q becomes ``(q, 0)``; then the nearest
points are those of the largest inner product, and the triangle inequality
holds.  Steps:

1. Pivots: farthest-first from a bounded sample (only their place depends on
   it).  Every vector belongs to its nearest pivot's cell.
2. Summaries: of each query cell its radius; of each data cell the distances of
   the k + 1 members nearest to the pivot.  They bound the distance theta_i
   within which every query of cell i has k partners besides its own row.
3. A data vector s goes to query cell i only if ``d(s, p_i) - radius_i <=
   theta_i``; what is not sent cannot be among the k best.
4. Cells are solved in groups of bounded size (parts of the data, chunks of the
   queries), each by a matrix product; the parts' k best are merged per query.

Scores are exact integers; ties go to the smaller ``vec_id``.  A vector that is
null, or has a null or non-finite component, takes no part, nor has a row with
a null id.  A shorter vector counts as padded with zeros.  Equal rows (same id
and vector) count once, and the query's own row is not its partner; rows of the
same id and another vector are.  Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohera.llm.common import materialise

#: bytes of vectors that one group holds, of data and of queries
PART_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20


def _clean(df: DataFrame, scale: float) -> DataFrame:
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).distinct()


def _matrix(vs, dim: int) -> np.ndarray:
    out = np.zeros((len(vs), dim), dtype=np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _lift(x: np.ndarray, m2: float, query: np.ndarray) -> np.ndarray:
    """The points in the space where the nearest are those sought."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))
    return np.concatenate((x, np.where(query, 0, rest)[:, None]), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        at = int(near.argmax())
        if near[at] <= 0:
            break
        chosen.append(at)
        near = np.minimum(near, _distances(sample, sample[at: at + 1])[:, 0])
    return sample[chosen]


def _products(q: np.ndarray, x: np.ndarray, exact: str) -> np.ndarray:
    """Integer inner products: floats hold them exactly, else integers do."""
    if exact == "float":
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if exact == "long":
        return q @ x.T
    return q.astype(object) @ x.astype(object).T


def _local_best(q, qid, x, xid, k: int, exact: str, step: int = 8192):
    """``(query row, data row, score)`` of each query's k best in this group."""
    rows, cols, scores = [], [], []
    for lo in range(0, len(x), step):
        s = _products(q, x[lo: lo + step], exact)
        ids = xid[lo: lo + step]
        maybe = qid[:, None] == ids[None]
        for i, j in zip(*np.nonzero(maybe)):  # the own row: same id, same vector
            if (q[i] == x[lo + j]).all():
                s[i, j] = np.iinfo(np.int64).min
        for i in range(len(q)):
            floor = np.partition(s[i], -k)[-k] if s.shape[1] > k else np.iinfo(np.int64).min
            c = np.flatnonzero((s[i] >= floor) & (s[i] > np.iinfo(np.int64).min))
            c = c[np.lexsort((ids[c], -s[i][c].astype(np.int64)))][:k]
            rows.append(np.full(len(c), i)), cols.append(c + lo), scores.append(s[i][c].astype(np.int64))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def knn_join(queries: DataFrame, data: DataFrame, k: int = 5, scale: float = 256.0, n_pivots: int = 32,
             sample_rows: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` partners of the
    largest inner product of ``floor(scale * x)`` vectors."""
    both = _clean(queries, scale).withColumn("kind", F.lit(1)).unionByName(_clean(data, scale).withColumn("kind", F.lit(0)))
    both = materialise(both, "knn-vectors")
    big = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: F.greatest(s, F.abs(x)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    st = both.agg(F.max(F.size("v")).alias("dim"), F.max(big).alias("big"), F.max(norm).alias("m2"),
                  F.sum(1 - F.col("kind")).alias("rows")).first()
    dim, m2, rows = st["dim"] or 1, float(st["m2"] or 0), int(st["rows"] or 0)
    span = (st["big"] or 0) ** 2 * dim
    exact = "float" if span < 1 << 52 else "long" if span < 1 << 62 else "object"
    packed = np.int16 if (st["big"] or 0) < 1 << 15 else np.int32 if st["big"] < 1 << 31 else np.int64
    sample = both.where("kind = 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    if not sample:
        return both.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    points = _lift(_matrix([r["v"] for r in sample], dim), m2, np.zeros(len(sample), bool))
    pivots = _pivots(points, n_pivots)
    slack = 1e-6 * (1 + np.sqrt(m2))  # far above the rounding of distances

    def summaries(batches):
        near: dict = {}
        far, count = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
        for pdf in batches:
            query = pdf["kind"].to_numpy() == 1
            d = _distances(_lift(_matrix(pdf["v"], dim), m2, query), pivots)
            cell = d.argmin(axis=1)
            own = d[np.arange(len(d)), cell]
            for c in np.unique(cell):
                s = own[(cell == c) & ~query]
                near[c] = np.sort(np.concatenate((near.get(c, np.empty(0)), s)))[: k + 1]
                q = own[(cell == c) & query]
                far[c], count[c] = max(far[c], q.max(initial=0)), count[c] + len(q)
        if near:
            cs = sorted(near)
            yield pd.DataFrame({"cell": cs, "near": [near[c] for c in cs], "far": far[cs], "n": count[cs]})

    cells = (both.select("kind", "v").mapInPandas(summaries, "cell int, near array<double>, far double, n bigint").groupBy("cell")
             .agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"),
                  F.max("far").alias("far"), F.sum("n").alias("n")).collect())  # one row a pivot
    gap = _distances(pivots, pivots)
    reach = np.full(len(pivots), -np.inf)
    chunks = np.zeros(len(pivots), np.int64)
    per_chunk = max(1, CHUNK_BYTES // (8 * dim))
    for c in cells:
        if c["n"]:
            up = np.sort(np.concatenate([c["far"] + gap[c["cell"], o["cell"]] + np.array(o["near"]) for o in cells]))
            theta = up[k] if len(up) > k else np.inf
            reach[c["cell"]], chunks[c["cell"]] = theta + c["far"] + slack, -(-c["n"] // per_chunk)
    parts = max(1, -(-rows * 8 * dim // PART_BYTES))

    def blocks(batches):
        for pdf in batches:
            x, ids = _matrix(pdf["v"], dim), pdf["vec_id"].to_numpy()
            query = pdf["kind"].to_numpy() == 1
            d = _distances(_lift(x, m2, query), pivots)
            cell = d.argmin(axis=1)
            h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (h % np.uint64(parts)).astype(np.int64)
            out = []
            for c in np.flatnonzero(chunks):
                chunk = (h // np.uint64(parts) % np.uint64(chunks[c])).astype(np.int64)
                for ch in range(chunks[c]):
                    m = query & (cell == c) & (chunk == ch)
                    if m.any():
                        out += [(c, ch, p, 1, ids[m].tobytes(), x[m].astype(packed).tobytes()) for p in range(parts)]
                    for p in range(parts):
                        m = ~query & (part == p) & (d[:, c] <= reach[c])
                        if m.any():
                            out.append((c, ch, p, 0, ids[m].tobytes(), x[m].astype(packed).tobytes()))
                    if len(out) >= 64:
                        yield pd.DataFrame(out, columns=["cell", "chunk", "part", "kind", "ids", "vs"])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=["cell", "chunk", "part", "kind", "ids", "vs"])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = []
        for kind in (1, 0):
            some = pdf[pdf["kind"] == kind]
            side += [np.frombuffer(b"".join(some["vs"]), packed).reshape(-1, dim).astype(np.int64), np.frombuffer(b"".join(some["ids"]), np.int64)]
        q, qid, x, xid = side
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "qrow": [], "vec_id": [], "score": []}).astype("int64")
        i, j, s = _local_best(q, qid, x, xid, k, exact)
        row = pd.util.hash_array(np.ascontiguousarray(q).view(f"S{8 * dim}").ravel().astype(object)).view(np.int64)
        return pd.DataFrame({"query_id": qid[i], "qrow": row[i], "vec_id": xid[j], "score": s})

    dealt = both.mapInPandas(blocks, "cell int, chunk bigint, part bigint, kind int, ids binary, vs binary")
    found = dealt.groupBy("cell", "chunk", "part").applyInPandas(solve, "query_id bigint, qrow bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id", "qrow").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
