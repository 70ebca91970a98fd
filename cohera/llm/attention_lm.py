"""LM scoring: a causal self-attention model in numpy over subword ids, which
sharpens the corpus's word counts by context.

Base.  Words of all training texts are counted in Spark (64-bit word hashes, one
end a text).  A word of count c has the base probability ``(c + 0.5) / (N + 0.5
(V + 1))``.  The commonest ``top_words`` counts are broadcast (a fixed bound); the
other words join the count table.

Classes.  A word's subwords come from a public byte-level BPE file; its class is
that of its first id.  The ``OWN`` commonest first ids are classes alone, the
others fall into clusters by the words they stand among: in the pass that counts,
each first id adds up the random signs of the words of its block of ``BLOCK``
words (all training texts, summed in Spark), and k-means on these sums, a table
of fixed size, gives the clusters.

Model.  One attention layer reads tokens (words and ends), each as the embeddings
of its first and its last subword id, and predicts the next token's class.  A text
is cut into windows of ``WINDOW`` tokens that overlap by ``OVERLAP``; each token is
scored once, with at least ``OVERLAP`` tokens of context where the text has them,
in batched masked attention.  A token's probability is ``base * (lam + (1 - lam) *
P(class | context) / P(class))``, P(class) being the class's share of the base:
classes move, words keep their share of their class.

Training.  Of each training text, the windows whose number is its hash modulo
``PART`` train the weights: all of them, as ``PART`` is 1.  They are
written by the pass that counts, and dealt by hash to S shards of about ``SHARD``
windows, S at least ``ROUNDS``; each of the ``ROUNDS`` rounds runs its shards from
the weights of the round before, and the results are averaged, summed in Spark by
kind of weight, so one model comes to the driver whatever S is.  A shard makes
``SHARD / BATCH`` steps, or as many as its windows need: one rule at every size.
One text in ``TUNE`` (by hash of the text, so copies stay together) does not train
the weights; ``lam`` maximises the likelihood of those texts.

A null text counts as empty: it has its end only.  A null id is in no fold: it
trains and is not held out.  Repeated rows are counted and scored each; a text
is read whole.  With no training text at all the base is 1 / 0.5 a token.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField

from cohera.llm.common import fold, map_texts, materialise, mix64, text_batches, word_batch

WINDOW, OVERLAP = 32, 8
DIM, OWN, CLUSTERS, INPUTS = 32, 32, 64, 3072
CLASSES, SYMBOLS = OWN + CLUSTERS, INPUTS + CLUSTERS
BATCH, SHARD, ROUNDS, PART, TUNE = 128, 1 << 15, 8, 1, 20
#: words of a block and signs of a word, for the clusters
BLOCK, SIGNS = 24, 16
IDS, END = 50257, 50256
CACHE_WORDS = 400_000
_MIX = [i / 50 for i in range(1, 50)]
_SUBWORDS: dict = {}
_CHUNK = 1024
#: a window to train on: first and last ids of the token before it (NONE at a
#: text's start) and of its tokens, and how many it has
NONE = 65535
_RECORD = np.dtype([("head", "<u2", WINDOW + 1), ("tail", "<u2", WINDOW + 1), ("n", "u1")])


class Subwords:
    """First and last subword ids of words (white space has none), kept by hash
    in a cache of ``CACHE_WORDS`` and what one batch adds."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        enc = tiktoken.Encoding("subwords", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.encode = enc.encode_ordinary
        self.known: dict[int, int] = {}

    def words(self, hashes: np.ndarray, starts, ends, data) -> tuple[np.ndarray, np.ndarray]:
        """First and last id of each word."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        get, raw = self.known.get, data.tobytes()
        out = [get(h) for h in hashes.tolist()]
        for i, x in enumerate(out):
            if x is None:
                ids = self.encode(raw[starts[i]: ends[i]].decode("utf-8", "replace"))
                out[i] = self.known[int(hashes[i])] = ids[0] << 16 | ids[-1]
        both = np.array(out, dtype=np.int64)
        return both >> 16, both & 65535


def _subwords(path: str) -> Subwords:
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


@dataclass
class Read:
    """A batch of texts as words, and as tokens: words and, after each text, END."""

    hashes: np.ndarray    # of all words
    first: np.ndarray     # words of text i: first[i]:first[i + 1]
    inverse: np.ndarray   # place of each word among the distinct ones
    unique: np.ndarray    # hashes of the distinct words
    heads: np.ndarray     # first and last ids of the distinct words
    tails: np.ndarray
    head: np.ndarray      # first and last ids of all tokens
    tail: np.ndarray
    cut: np.ndarray       # tokens of text i: cut[i]:cut[i + 1]


def read(texts: list, sub: Subwords) -> Read:
    h, first, starts, ends, data = word_batch(texts)
    u, at, inv = np.unique(h, return_index=True, return_inverse=True)
    heads, tails = sub.words(u, starts[at], ends[at], data)
    head, tail = (np.insert(x[inv], first[1:], END).astype(np.int32) for x in (heads, tails))
    return Read(h, first, inv, u, heads, tails, head, tail, first + np.arange(len(first)))


# ---------------------------------------------------------------- counts

def _signs(ids: np.ndarray) -> np.ndarray:
    """Fixed pseudorandom signs of ids."""
    bits = mix64(ids.astype(np.uint64) + np.uint64(1))[:, None] >> np.arange(8, 8 + SIGNS, dtype=np.uint64)
    return 1 - 2 * (bits & np.uint64(1)).astype(np.float32)


def count_corpus(texts: DataFrame, path: str) -> DataFrame:
    """One pass over ``text, o, waits``: rows ``kind, key, n, ids, data``, written.
    Kind 0: words by hash, their counts, their first and last ids (``first << 16 |
    last``); kind 1: the number of texts; kind 2: pieces of the clusters' table;
    kind 3: by ``o`` the windows of the texts that do not wait."""
    def f(batches):
        sub = _subwords(path)
        words, ends, kept = [], 0, 0
        signs = _signs(np.arange(IDS))
        table = np.zeros((IDS, SIGNS))

        def rows(kind, key, n=0, ids=0, data=None):
            return pd.DataFrame({"kind": kind, "key": key, "n": n, "ids": ids, "data": data})

        def merged():
            h, n, ids = (np.concatenate([w[k] for w in words]) for k in range(3))
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            return rows(0, u.view(np.int64), np.bincount(inv, n).astype(np.int64), ids[at])

        for pdf in batches:
            some, o, waits = pdf["text"].tolist(), pdf["o"].to_numpy(), pdf["waits"].to_numpy()
            ends += len(some)
            for part in text_batches(some):
                r = read(some[part], sub)
                go = np.flatnonzero(~waits[part])
                records, owner = records_of(r, o[part] % PART)
                cut = np.searchsorted(owner, np.arange(len(r.cut)))
                go = go[cut[go] < cut[go + 1]]
                if len(go):
                    yield rows(3, o[part][go], data=[records[cut[i]: cut[i + 1]].tobytes() for i in go])
                if not len(r.hashes):
                    continue
                words.append((r.unique, np.bincount(r.inverse, minlength=len(r.unique)), r.heads << 16 | r.tails))
                kept += len(r.unique)
                head, place = r.heads[r.inverse], np.arange(len(r.hashes)) - np.repeat(r.first[:-1], np.diff(r.first))
                edge = np.flatnonzero(place % BLOCK == 0)
                block = np.cumsum(place % BLOCK == 0) - 1
                sums = np.add.reduceat(signs[head], edge, axis=0)
                for k in range(SIGNS):
                    table[:, k] += np.bincount(head, sums[block, k], IDS)
                if kept > 2_000_000:  # bounded memory: hand over what is added up so far
                    yield merged()
                    words, kept = [], 0
        if words:
            yield merged()
        if ends:
            yield rows(1, [0], ends)
        for lo in range(0, IDS, _CHUNK):
            piece = table[lo: lo + _CHUNK]
            if piece.any():
                yield rows(2, [lo], data=[piece.astype("<f8").tobytes()])

    raw = texts.select("text", "o", "waits").mapInPandas(f, "kind int, key bigint, n bigint, ids bigint, data binary")
    return materialise(raw, "lm-partial-counts")


def _summed(pieces: DataFrame) -> DataFrame:
    """``key, data``: the numbers of a key added up, as many as one row has."""
    def add(rows):
        total = {}
        for pdf in rows:
            for k, b in zip(pdf["key"], pdf["data"]):
                x = np.frombuffer(b, "<f8")
                total[k] = total[k] + x if k in total else x
        if total:
            yield pd.DataFrame({"key": list(total), "data": [x.tobytes() for x in total.values()]})

    return pieces.repartition("key").mapInPandas(add, pieces.schema)


def clusters(table: np.ndarray, counts: np.ndarray, k: int = CLUSTERS, steps: int = 12) -> np.ndarray:
    """k-means of the rows of ``table`` by direction, after the part that counts
    alone explain is taken off; rows count by the square root of their count."""
    mean = table.sum(axis=0) / max(1, counts.sum())
    x = table - counts[:, None] * mean
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]
    weight = np.sqrt(counts)
    centre = x[np.argsort(-counts, kind="stable")[:k]]
    for _ in range(steps):
        own = (x @ centre.T).argmax(axis=1)
        total = np.stack([np.bincount(own, weight * x[:, j], k) for j in range(x.shape[1])], axis=1)
        size = np.sqrt((total * total).sum(axis=1))
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1e-9)[:, None], centre)
    return (x @ centre.T).argmax(axis=1).astype(np.int32)


# ---------------------------------------------------------------- model

@dataclass
class Model:
    """Classes of ids, the weights, and the corpus counts the scores need."""

    cls: np.ndarray       # class of a first id
    inp: np.ndarray       # input symbol of a first or last id
    share: np.ndarray     # log share of the base of each class
    weights: dict
    top: np.ndarray       # hashes of the commonest words, sorted
    top_count: np.ndarray
    total: int            # N
    distinct: int         # V
    ends: int             # training texts
    seen: int = 0         # windows that the weights were trained on
    lam: float = 0.5

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def id_classes(counts: np.ndarray, own: int, cluster: np.ndarray) -> np.ndarray:
    """The ``own`` commonest ids alone, the others by cluster."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = own + cluster
    out[order[:own]] = np.arange(own)
    return out.astype(np.int32)


def _initial(seed: int = 3) -> dict:
    r = np.random.default_rng(seed)
    def g(*s):
        return (r.normal(0, 0.5 / np.sqrt(s[0]), s)).astype(np.float32)
    return {"e": r.normal(0, 0.3, (SYMBOLS + 1, DIM)).astype(np.float32), "t": r.normal(0, 0.3, (SYMBOLS + 1, DIM)).astype(np.float32), "p": r.normal(0, 0.1, (WINDOW, DIM)).astype(np.float32),
            "q": g(DIM, DIM), "k": g(DIM, DIM), "v": g(DIM, DIM), "o": g(DIM, CLASSES), "b": np.zeros(CLASSES, np.float32)}


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


_TOP = np.float32(60)  # a logit beyond it counts as 60 (or -60): no exponential overflows and no sum is 0, so no maxima are needed


def _attend(w: dict, head: np.ndarray, tail: np.ndarray):
    """Inputs, projections, attention weights, their sums and outputs of windows
    of input symbols; position t sees the inputs up to t."""
    n, d = len(head), DIM
    x = w["e"].take(head, axis=0)
    x += w["t"].take(tail, axis=0)
    x += w["p"]
    flat = x.reshape(-1, d)
    into = np.concatenate([w["q"] * np.float32(d ** -0.5), w["k"], w["v"]], axis=1)
    both = (flat @ into).reshape(n, WINDOW, 3 * d)
    q, k, v = both[:, :, :d], both[:, :, d: 2 * d], both[:, :, 2 * d:]
    a = q @ k.transpose(0, 2, 1)
    np.clip(a, -_TOP, _TOP, out=a)
    a += _MASK
    np.exp(a, out=a)
    total = (a.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), np.float32)).reshape(n, WINDOW, 1)
    h = a @ v
    h /= total
    h += x
    return flat, into, q, k, v, a, total, h.reshape(-1, d)


def log_probs(w: dict, head: np.ndarray, tail: np.ndarray, at: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Log probabilities of the target classes at the places ``at`` (flat)."""
    z = _attend(w, head, tail)[-1].take(at, axis=0) @ w["o"]
    z += w["b"]
    np.clip(z, -_TOP, _TOP, out=z)
    own = z[np.arange(len(at)), targets]
    return own - np.log(np.exp(z, out=z) @ np.ones((CLASSES, 1), np.float32))[:, 0]


def _gradients(w: dict, head: np.ndarray, tail: np.ndarray, at: np.ndarray, targets: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the targets at the places ``at``, and its gradients."""
    n, d = len(head), DIM
    flat, into, q, k, v, a, total, h = _attend(w, head, tail)
    a /= total
    g = h.take(at, axis=0)
    z = g @ w["o"]
    z += w["b"]
    np.clip(z, -_TOP, _TOP, out=z)
    rows = np.arange(len(at))
    own = z[rows, targets]
    np.exp(z, out=z)
    sums = (z @ np.ones((CLASSES, 1), z.dtype))[:, 0]
    loss = (np.log(sums) - own).sum() / len(at)
    z /= (sums * z.dtype.type(len(at)))[:, None]
    z[rows, targets] -= z.dtype.type(1 / len(at))
    dx = np.zeros_like(h)
    dx[at] = z @ w["o"].T
    dh = dx.reshape(n, WINDOW, d)
    da = dh @ v.transpose(0, 2, 1)
    da *= a
    da -= a * (da.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), da.dtype)).reshape(n, WINDOW, 1)
    back = np.concatenate([da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh], axis=2).reshape(-1, 3 * d)
    dx = dx + back @ into.T
    dq, dk, dv = np.split(flat.T @ back, 3, axis=1)
    out = {"p": dx.reshape(n, WINDOW, d).sum(axis=0), "q": dq * np.float32(d ** -0.5), "k": dk, "v": dv, "o": g.T @ z, "b": z.sum(axis=0)}
    for name, symbols in (("e", head), ("t", tail)):
        order = np.argsort(symbols.astype(np.uint16), axis=None, kind="stable")  # a radix sort
        sym = symbols.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
        out[name] = np.zeros_like(w[name])
        out[name][sym[first]] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
    return float(loss), out


class Trainer:
    """Adam from given weights over one shard's windows."""

    def __init__(self, w: dict, cls: np.ndarray, inp: np.ndarray, rate: float, seed: int):
        self.w = {k: x.copy() for k, x in w.items()}
        self.cls, self.inp, self.rate, self.r = cls, inp, rate, np.random.default_rng(seed)
        self.m, self.s, self.spare = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(3))
        self.steps, self.seen = 0, 0
        self.uses = {k: np.zeros(SYMBOLS + 1) for k in "et"}

    def step(self, records: np.ndarray):
        head, tail, at, targets = places(records, self.cls, self.inp)
        w, i = self.w, self.steps + 1
        _, g = _gradients(w, head, tail, at, targets)
        rate = self.rate * min(1, i / 20)
        for k in w:
            m, s, d, x = self.m[k], self.s[k], g[k], self.spare[k]
            np.subtract(d, m, out=x)
            x *= np.float32(0.1)
            m += x
            np.multiply(d, d, out=x)
            x -= s
            x *= np.float32(0.01)
            s += x
            np.multiply(s, np.float32(1 / (1 - 0.99 ** i)), out=x)
            np.sqrt(x, out=x)
            x += np.float32(1e-8)
            np.divide(np.multiply(m, np.float32(rate / (1 - 0.9 ** i)), out=d), x, out=x)
            w[k] -= x
        self.steps = i
        for k, x in (("e", head), ("t", tail)):
            self.uses[k] += np.bincount(x.ravel(), minlength=SYMBOLS + 1)

    def run(self, records: np.ndarray, steps: int):
        """Each window at least once, and ``steps`` steps at least: windows come again
        only for the steps that are still missing."""
        self.seen += len(records)
        left = max(steps, -(-len(records) // BATCH)) if len(records) else 0
        while left > 0:
            order = self.r.permutation(len(records))
            for lo in range(0, min(len(order), left * BATCH), BATCH):
                self.step(records[order[lo: lo + BATCH]])
                left -= 1


def _windows(cut: np.ndarray, offset: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place of the first token, tokens from there on, text)`` of the windows of
    texts of tokens, which begin at ``offset`` and every ``step`` after it."""
    size = np.diff(cut)
    n = np.maximum(0, -(-(size - offset) // step))
    text = np.repeat(np.arange(len(size)), n)
    start = offset[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    return cut[text] + start, size[text] - start, text


def records_of(r: Read, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows ``number``, ``number + PART``, ... of each text, and their texts."""
    start, left, text = _windows(r.cut, number.astype(np.int64) * WINDOW, PART * WINDOW)
    out = np.zeros(len(start), _RECORD)
    out["n"] = np.minimum(left, WINDOW)
    place = start[:, None] + np.arange(-1, WINDOW)
    inside = np.minimum(np.maximum(place, 0), len(r.head) - 1)
    out["head"], out["tail"] = r.head[inside], r.tail[inside]
    first = start == r.cut[text]
    out["head"][first, 0] = out["tail"][first, 0] = NONE
    return out, text


def places(records: np.ndarray, cls: np.ndarray, inp: np.ndarray):
    """Input symbols, and flat places and classes of the targets, of windows."""
    head, tail = (np.where(x == NONE, SYMBOLS, inp[np.where(x == NONE, 0, x)]) for x in (records["head"][:, :-1], records["tail"][:, :-1]))
    at = np.flatnonzero(np.arange(WINDOW) < records["n"][:, None])
    return head, tail, at, cls[records["head"][:, 1:].ravel()[at]]


def _round(rows: DataFrame, w: dict, cls: np.ndarray, inp: np.ndarray, rate: float, seed: int) -> tuple[dict, int]:
    """One round over ``shard, key, data``: averaged weights, and the windows seen.
    A shard's weights count by its steps, an input symbol's by its uses."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((w, cls, inp))
    names = sorted(w)

    def f(batches):
        at, held = None, []
        total = {}

        def add(name, x):
            total[name] = total[name] + x if name in total else x

        def done():
            t = Trainer(*shared.value, rate, seed * 1_000_003 + int(at))
            t.run(np.concatenate(held), SHARD // BATCH)
            for k in names:
                add(k, t.w[k].astype(np.float64) * (t.uses[k][:, None] if k in t.uses else t.steps))
            for k, x in t.uses.items():
                add(f"uses of {k}", x)
            add("steps", np.array([t.steps, t.seen], np.float64))

        for pdf in batches:
            for shard, s in zip(pdf["shard"], pdf["data"]):
                if shard != at and held:
                    done()
                    held = []
                at = shard
                held.append(np.frombuffer(s, _RECORD))
        if held:
            done()
        if total:
            yield pd.DataFrame({"key": list(total), "data": [x.astype("<f8").tobytes() for x in total.values()]})

    sums = rows.repartition("shard").sortWithinPartitions("shard", "key", "data").mapInPandas(f, "key string, data binary")
    got = {r["key"]: np.frombuffer(r["data"], "<f8") for r in _summed(sums).collect()}  # one row a kind of weight
    shared.destroy()
    if not got:
        return w, 0
    steps, seen = got["steps"]
    out = {}
    for k, x in w.items():
        sums = got[k].reshape(x.shape)
        if k in "et":
            uses = got[f"uses of {k}"][:, None]
            out[k] = np.where(uses > 0, sums / np.maximum(uses, 1), x).astype(np.float32)
        else:
            out[k] = (sums / steps).astype(np.float32)
    return out, int(seen)


def train(rows: DataFrame, cls: np.ndarray, inp: np.ndarray, tokens: int) -> tuple[dict, int]:
    """Weights from the windows ``key, data``, and how many they are."""
    shards = max(ROUNDS, -(-tokens // WINDOW // PART // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    w, seen = _initial(), 0
    for i in range(ROUNDS):
        w, k = _round(rows.where(F.col("shard") % ROUNDS == i), w, cls, inp, 0.01 * (1 - 0.9 * i / (ROUNDS - 1)), i + 1)
        seen += k
    return w, seen


def _waits():
    """Whether a text waits for ``lam``; copies of a text are alike."""
    return F.pmod(F.xxhash64("text", F.lit(7)), F.lit(TUNE)) == 0


def token_ratios(r: Read, model: Model, chunk: int = 128) -> np.ndarray:
    """``log P(class | context) - log P(class)`` of each token, in order."""
    step = WINDOW - OVERLAP
    start, left, text = _windows(r.cut, np.zeros(len(r.cut) - 1, np.int64), step)
    opens = start == r.cut[text]
    keep = opens | (left > OVERLAP)  # else the window before has all of it
    start, left, opens = start[keep], left[keep], opens[keep]
    out = np.zeros(len(r.head))
    cls, head, tail = model.cls[r.head], model.inp[r.head], model.inp[r.tail]
    for lo in range(0, len(start), chunk):
        s, first = start[lo: lo + chunk], opens[lo: lo + chunk]
        place = np.minimum(s[:, None] + np.arange(WINDOW), len(cls) - 1)
        before = np.maximum(place - 1, 0)
        h, t = head[before], tail[before]
        h[first, 0] = t[first, 0] = SYMBOLS
        at = np.flatnonzero((np.arange(WINDOW) < left[lo: lo + chunk, None]) & (first[:, None] | (np.arange(WINDOW) >= OVERLAP)))
        to = place.ravel()[at]
        out[to] = log_probs(model.weights, h, t, at, cls[to]) - model.share[cls[to]]
    return out


def _gain(ratio: np.ndarray, lam: float) -> np.ndarray:
    """log10 of what the context makes of a token's base probability."""
    return np.log10(lam + (1 - lam) * np.exp(np.minimum(ratio, 700)))


def _parts(docs: DataFrame, model: Model, path: str):
    """Per text, written: sums over its end and common words, and its other words;
    and the broadcast that made them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        m = shared.value
        r = read(texts, _subwords(path))
        gain = np.concatenate(([0.0], np.cumsum(_gain(token_ratios(r, m), m.lam))))
        count = np.full(len(r.unique), -1, np.int64)
        if len(m.top) and len(r.unique):
            j = np.minimum(np.searchsorted(m.top, r.unique), len(m.top) - 1)
            hit = m.top[j] == r.unique
            count[hit] = m.top_count[j[hit]]
        count = count[r.inverse]
        known = count >= 0
        base = np.concatenate(([0.0], np.cumsum(np.where(known, np.log10((np.maximum(count, 0) + 0.5) / m.norm), 0))))
        end = np.log10((m.ends + 0.5) / m.norm)
        out = {f.name: [] for f in _PART}
        for i, (a, b) in enumerate(zip(r.first[:-1], r.first[1:])):
            k = known[a:b]
            row = (b - a + 1, int(k.sum()) + (m.ends > 0), base[b] - base[a] + end, gain[b + i + 1] - gain[a + i], r.hashes[a:b][~k].view(np.int64))
            for f, x in zip(_PART, row):
                out[f.name].append(x)
        return out

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return materialise(map_texts(rows, ["rid", "doc_id"], _PART, make), "lm-parts"), shared


_PART = [StructField("n_tokens", LongType()), StructField("known", LongType()), StructField("base", DoubleType()),
         StructField("gain", DoubleType()), StructField("hs", ArrayType(LongType()))]


def score(docs: DataFrame, model: Model, words: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every text; ``words`` is
    the count table ``key, n``."""
    parts, shared = _parts(docs, model, path)
    shared.destroy()  # the written rows no longer need it
    rare = parts.select("rid", F.explode("hs").alias("key")).groupBy("rid", "key").agg(F.count("*").alias("c"))
    rare = rare.join(words.select("key", "n"), "key", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("rid").agg(F.sum(F.when(n > 0, F.col("c")).otherwise(0)).alias("k2"),
                                   F.sum(F.col("c") * F.log10((n + 0.5) / model.norm)).alias("b2"))
    out = parts.drop("hs").join(rare.hint("merge"), "rid", "left")
    base = F.col("base") + F.coalesce("b2", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("k2", F.lit(0))).alias("n_known"), base.alias("base_score"),
                      (base + F.col("gain")).alias("score"))


def fit(training: DataFrame, path: str, top_words: int = 1 << 18) -> tuple[Model, DataFrame]:
    """The model and the word counts ``key, n`` of ``training(doc_id, text)``."""
    raw = count_corpus(training.select("text", F.xxhash64("doc_id", "text").alias("o"), _waits().alias("waits")), path)
    words = raw.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n"), F.first("ids").alias("ids"))
    words = materialise(words, "lm-counts")
    ends = int(raw.where("kind = 1").agg(F.sum("n")).first()[0] or 0)
    heads, tails, mass = (np.zeros(IDS) for _ in range(3))
    by = F.shiftright("ids", 16).cast("int")
    for r in words.groupBy(by.alias("id")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most one row an id, here and below
        heads[r["id"]], mass[r["id"]] = r["n"], r["n"] + 0.5 * r["v"]
    for r in words.groupBy(F.col("ids").bitwiseAND(65535).cast("int").alias("id")).agg(F.sum("n").alias("n")).collect():
        tails[r["id"]] = r["n"]
    heads[END], tails[END], mass[END] = ends, ends, ends + 0.5 * (ends > 0)
    sums = np.zeros((IDS, SIGNS))
    for r in _summed(raw.where("kind = 2").select("key", "data")).collect():
        x = np.frombuffer(r["data"], "<f8").reshape(-1, SIGNS)
        sums[r["key"]: r["key"] + len(x)] = x
    t = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    # the commonest words: all whose count reaches the least step that leaves top_words at most
    steps = words.groupBy(F.ceil(4 * F.log2("n")).alias("step")).agg(F.count("*").alias("c")).orderBy(F.desc("step")).collect()
    kept, low = 0, None  # at most four steps a doubling of the count
    for r in steps:
        kept += r["c"]
        if kept > top_words:
            break
        low = r["step"]
    best = words.where(F.ceil(4 * F.log2("n")) >= (low if low is not None else 1 << 30)).select("key", "n").toPandas()
    top = best["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(top)
    cluster = clusters(sums, heads)
    cls, inp = id_classes(heads, OWN, cluster), id_classes(heads + tails, INPUTS, cluster)
    share = np.bincount(cls, mass, CLASSES) + 0.5 / CLASSES  # the base's mass for unseen words, spread out
    model = Model(cls, inp, np.log(share / share.sum()), _initial(), top[order], best["n"].to_numpy().astype(np.int64)[order],
                  int(t["n"] or 0) + ends, int(t["v"]) + (ends > 0), ends)
    model.weights, model.seen = train(raw.where("kind = 3").select("key", "data"), cls, inp, model.total)
    model.lam = _best_mix(model, training.where(_waits()), path)
    return model, words.select("key", "n")


def _best_mix(model: Model, waiting: DataFrame, path: str) -> float:
    """The ``lam`` of the best likelihood of the ``waiting`` texts; the base does
    not matter for it."""
    shared = waiting.sparkSession.sparkContext.broadcast(model)

    def f(batches):
        total, n = np.zeros(len(_MIX)), 0
        for pdf in batches:
            some = pdf["text"].tolist()
            for part in text_batches(some):
                ratio = token_ratios(read(some[part], _subwords(path)), shared.value)
                total += [_gain(ratio, lam).sum() for lam in _MIX]
                n += 1
        if n:
            yield pd.DataFrame({"key": [0], "data": [total.astype("<f8").tobytes()]})

    rows = _summed(waiting.select("text").mapInPandas(f, "key bigint, data binary")).collect()  # one row
    shared.destroy()
    return _MIX[int(np.argmax(np.frombuffer(rows[0]["data"], "<f8")))] if rows else model.lam


def scored_corpus(docs: DataFrame, path: str, n_folds: int = 5, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    out = F.coalesce(fold(F.col("doc_id"), n_folds) == held_out, F.lit(False))
    docs = docs.select("doc_id", "text")
    model, words = fit(docs.where(~out), path)
    return score(docs, model, words, path).select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")
