"""Quality classifier: a factorisation machine over hashed words, structure
statistics and length metadata.

A document is a sparse vector x: hashed words (weight 1 + log of the count,
scaled to unit length), the statistics (binned, one-hot), and nothing of its
labels, language, source or id.  The score is

    sigmoid(b + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so the pairwise part costs time linear in the features.  Training: logistic
loss, AdaGrad with a fixed order, on at most ``sample_rows`` labelled rows, those
of the least id hash; the model has a fixed size and is broadcast.

Null and empty texts have only their statistics and are scored by them.
Labels with a null id or null label are left out; of several labels of one id
the largest counts.  Repeated rows are scored each; a text is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from cohera.llm.common import map_texts, materialise, text_batches, word_batch
from cohera.llm.toxicity import labelled_rows

WORD_BITS = 14
_BINS = 8
#: statistics of a text, each cut into bins
STATS = ("log words", "mean word length", "upper-case share", "digit share", "symbol share", "distinct words share",
         "commonest word share", "line end share", "words with symbols share", "repeated line share")
N_FEATURES = (1 << WORD_BITS) + len(STATS) * _BINS


@dataclass
class Machine:
    """Bias, linear weights and factors of a factorisation machine."""

    b: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Margins of rows in compressed form (no row is without features)."""
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, ptr[:-1], axis=0)
        sq = np.add.reduceat((vx * vx).sum(axis=1), ptr[:-1])
        return self.b + np.add.reduceat(self.w[at] * x, ptr[:-1]) + 0.5 * ((s * s).sum(axis=1) - sq)


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"-()"]] = True


def _stats(raw: np.ndarray, lens: np.ndarray, counts: np.ndarray, odd: int, text: str) -> list[float]:
    n, size = int(lens.size), max(1, raw.size)
    lines = text.split("\n")
    kept = [x for x in lines if x]
    return [np.log1p(n) / 1.5, (lens.mean() if n else 0) / 1.5, _UPPER[raw].sum() / size * 16, _DIGIT[raw].sum() / size * 32,
            _SYMBOL[raw].sum() / size * 24, len(counts) / max(1, n) * 8, (counts.max() if n else 0) / max(1, n) * 16,
            len(lines) / max(1, n) * 32, odd / max(1, n) * 8, (1 - len(set(kept)) / max(1, len(kept))) * 8]


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(at, x, ptr)``: feature numbers and values of each text, in rows."""
    ats, xs, sizes = [], [], []
    for part in text_batches(texts):
        some = ["" if t is None else t for t in texts[part]]
        h, first, starts, ends, data = word_batch(some)
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        odd = symbols[ends] > symbols[starts]
        bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        for i, t in enumerate(some):
            a, b = first[i], first[i + 1]
            u, c = np.unique(bucket[a:b], return_counts=True)
            x = 1 + np.log(c) if len(c) else np.empty(0)
            x = x / np.sqrt((x * x).sum()) if len(x) else x
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            st = np.clip(np.array(_stats(raw, ends[a:b] - starts[a:b], c, int(odd[a:b].sum()), t)), 0, _BINS - 1).astype(np.int64)
            ats += [u, (1 << WORD_BITS) + np.arange(len(STATS)) * _BINS + st]
            xs += [x, np.full(len(STATS), 0.5)]
            sizes.append(len(u) + len(STATS))
    at = np.concatenate(ats) if ats else np.empty(0, np.int64)
    x = np.concatenate(xs) if xs else np.empty(0)
    return at, x, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], factors: int = 8, epochs: int = 8, batch: int = 64,
          rate: float = 0.1, l2: float = 1e-4, seed: int = 1) -> Machine:
    """AdaGrad on ``(feature numbers, values, label)`` rows."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.01, (N_FEATURES, factors)))
    if not rows:
        return m
    share = np.clip(np.mean([r[2] for r in rows]), 1e-3, 1 - 1e-3)
    m.b = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            some = [rows[i] for i in order[lo: lo + batch]]
            at, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            n = np.array([len(r[0]) for r in some])
            ptr = np.concatenate(([0], np.cumsum(n)))
            e = (_sigmoid(m.margin(at, x, ptr)) - np.array([r[2] for r in some])) / len(some)
            owner = np.repeat(np.arange(len(some)), n)
            vx = m.v[at] * x[:, None]
            s = np.add.reduceat(vx, ptr[:-1], axis=0)
            u, inv = np.unique(at, return_inverse=True)
            dw = np.bincount(inv, e[owner] * x, len(u)) + l2 * m.w[u]
            dv = np.zeros((len(u), factors))
            np.add.at(dv, inv, (e[owner] * x)[:, None] * (s[owner] - vx))
            dv += l2 * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            gb += e.sum() ** 2
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            m.v[u] -= rate * dv / np.sqrt(gv[u])
            m.b -= rate * e.sum() / np.sqrt(gb)
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", n_folds: int = 4, held_out: int = 2,
        sample_rows: int = 6000) -> Machine:
    """Train on at most ``sample_rows`` labelled rows."""
    rows = labelled_rows(labels, label, n_folds, held_out)
    pick = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    ids = F.broadcast(materialise(pick, "quality-sample"))  # bounded by sample_rows

    def f(batches):
        for pdf in batches:
            at, x, ptr = features(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"],
                                "at": [at[a:b].astype(np.int32).tobytes() for a, b in zip(ptr[:-1], ptr[1:])],
                                "x": [x[a:b].astype(np.float32).tobytes() for a, b in zip(ptr[:-1], ptr[1:])]})

    some = docs.select("doc_id", "text").join(ids, "doc_id").select(F.col("doc_id").cast("bigint"), "y", "text")
    got = some.dropDuplicates(["doc_id"]).mapInPandas(f, "doc_id bigint, y int, at binary, x binary").collect()
    return train([(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64), float(r["y"]))
                  for r in sorted(got, key=lambda r: r["doc_id"])])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1 (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if c != "score"]

    return map_texts(docs, keep, [StructField("score", DoubleType())],
                     lambda texts: {"score": _sigmoid(shared.value.margin(*features(texts)))})
