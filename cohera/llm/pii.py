"""Personal data: fixed patterns, and a skip-chain conditional random field.

The patterns (email, ip, card, phone) give the base spans, which always stay.
The field labels every token with a digit or an at sign (others are O by
definition) as O or one of the kinds.  Its factors: token features; a chain
factor between neighbouring tokens; a skip factor between distant tokens of one
text that repeat each other or end in the same digits (each occurrence is tied
to the one before it and to the first, so edges grow with the tokens).  Tokens
inside base spans are fixed to their kind; loopy sum-product messages carry
that evidence along the edges; a token of another label than O with at least
``threshold`` adds a span.

The weights are trained by pseudo-likelihood on the base spans of at most
``sample_docs`` texts, those of the least id hash.  Offsets are code points,
the end exclusive.  A null or empty text has no spans; repeated rows are each
searched; a text is searched whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cohera.llm.common import map_texts, materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a leftmost match begins where a run of digits begins: the lookbehind only saves tries
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPACES = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}
_N = len(KINDS) + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` by start, then kind."""
    if not text:
        return []
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:  # the leftmost match with this at sign takes all local characters before it
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if not _ANY.search(text):
        return out
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            d = re.sub(r"[^0-9]", "", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def tokens(text: str) -> list[tuple[int, int]]:
    """White-space separated tokens with a digit or an at sign."""
    flat = text.translate(_SPACES)
    out, end = [], -1
    for m in _ANY.finditer(flat):
        if m.start() < end:
            continue
        start = flat.rfind(" ", 0, m.start()) + 1
        end = flat.find(" ", m.start())
        end = len(flat) if end < 0 else end
        out.append((start, end))
    return out


def _features(t: str) -> list[int]:
    d = sum(c in "0123456789" for c in t)
    seps = t.count("-") + t.count("(") + t.count(")")
    return [1, "@" in t, t.count("@") == 1 and "." in t[t.find("@"):], t.startswith("+"), d == 0, 0 < d <= 2, d == 3, d == 4, 5 <= d <= 8,
            9 <= d <= 11, 12 <= d <= 15, 16 <= d <= 19, d > 19, t.count(".") == 3, t.count(".") in (1, 2), t.count(".") > 3,
            seps == 1, seps > 1, d * 2 > len(t), d == len(t.strip(".,;:!?")), any("a" <= c.lower() <= "z" for c in t), "(" in t]


N_FEATURES = len(_features("x"))


def _normal(t: str) -> str:
    d = re.sub(r"[^0-9]", "", t)
    return d[-7:] if len(d) >= 4 and "@" not in t else t.strip(".,;:!?()[]<>\"'").lower()


class Graph:
    """Tokens, features, fixed labels and edges of a batch of texts."""

    def __init__(self, texts: list):
        feats, fixed, owner, spans, chain, skip = [], [], [], [], [], []
        self.base = []
        for i, text in enumerate(texts):
            base = base_spans(text)
            self.base.append(base)
            seen: dict[str, tuple[int, int]] = {}
            before, b = None, 0
            for s, e in tokens(text) if text else ():
                n, t = len(spans), text[s:e]
                while b < len(base) and base[b][1] <= s:
                    b += 1
                kind = next((k + 1 for x, y, k in base[b: b + 8] if x < e and y > s), 0)
                feats.append(_features(t))
                fixed.append(kind)
                owner.append(i)
                spans.append((s, e))
                if before is not None and s - before == 1:
                    chain.append((n - 1, n))
                before = e
                key = _normal(t)
                if key in seen:
                    first, last = seen[key]
                    skip.append((last, n))
                    if first != last:
                        skip.append((first, n))
                    seen[key] = (first, n)
                else:
                    seen[key] = (n, n)
        self.x = np.array(feats, dtype=np.float64).reshape(-1, N_FEATURES)
        self.fixed = np.array(fixed, dtype=np.int64)
        self.owner = np.array(owner, dtype=np.int64)
        self.spans = spans
        self.chain = np.array(chain, dtype=np.int64).reshape(-1, 2)
        self.skip = np.array(skip, dtype=np.int64).reshape(-1, 2)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(g: Graph, steps: int = 300, rate: float = 0.5, l2: float = 1e-3,
          consistency: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights ``(node, chain, skip)`` by pseudo-likelihood: each token's label
    from its features and the labels at its edges. The prior mean of the skip
    weights is ``consistency`` for equal labels, so repeats agree also where
    the sample has few of them; the other weights' is 0."""
    y = np.eye(_N)[g.fixed]
    w, c, s = np.zeros((N_FEATURES, _N)), np.zeros((_N, _N)), np.eye(_N) * consistency
    prior = [m.copy() for m in (w, c, s)]
    if not len(y):
        return w, c, s
    left, right, tied = np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
    np.add.at(left, g.chain[:, 1], y[g.chain[:, 0]])
    np.add.at(right, g.chain[:, 0], y[g.chain[:, 1]])
    np.add.at(tied, g.skip[:, 0], y[g.skip[:, 1]])
    np.add.at(tied, g.skip[:, 1], y[g.skip[:, 0]])
    tied /= np.maximum(tied.sum(axis=1, keepdims=True), 1)
    sq = [np.full_like(m, 1e-8) for m in (w, c, s)]
    for _ in range(steps):
        e = (y - _softmax(g.x @ w + left @ c + right @ c.T + tied @ s)) / len(y)
        half = tied.T @ e
        for m, q, mean, grad in zip((w, c, s), sq, prior, (g.x.T @ e, left.T @ e + e.T @ right, (half + half.T) / 2)):
            grad = grad - l2 * (m - mean) / 10
            q += grad * grad
            m += rate * grad / np.sqrt(q)
    return w, c, s


def marginals(g: Graph, model, rounds: int = 10) -> np.ndarray:
    """Label probabilities by loopy sum-product messages, all texts at once."""
    w, c, s = model
    node = g.x @ w
    held = np.flatnonzero(g.fixed)
    node[held] = -1e3
    node[held, g.fixed[held]] = 0
    edge = np.concatenate((g.chain, g.skip))
    if not len(edge):
        return _softmax(node) if len(node) else node
    a, b = np.concatenate((edge[:, 0], edge[:, 1])), np.concatenate((edge[:, 1], edge[:, 0]))
    n, m = len(g.chain), len(g.skip)
    pot = np.concatenate((np.repeat(c[None], n, 0), np.repeat(s[None], m, 0), np.repeat(c.T[None], n, 0), np.repeat(s.T[None], m, 0)))
    back = np.concatenate((np.arange(n + m, 2 * (n + m)), np.arange(n + m)))
    msg = np.zeros((len(a), _N))
    for _ in range(rounds):
        total = node.copy()
        np.add.at(total, b, msg)
        out = (total[a] - msg[back])[:, :, None] + pot
        top = out.max(axis=1)
        new = np.log(np.exp(out - top[:, None, :]).sum(axis=1)) + top
        msg = 0.5 * msg + 0.5 * (new - new.max(axis=1, keepdims=True))
    total = node.copy()
    np.add.at(total, b, msg)
    return _softmax(total)


def all_spans(texts: list, model, threshold: float = 0.9) -> list[tuple[list, list]]:
    """``(base, added)`` spans of each text."""
    g = Graph(texts)
    added: list[list] = [[] for _ in texts]
    if len(g.spans):
        p = marginals(g, model)
        kind = p.argmax(axis=1)
        joined = set(map(tuple, g.chain))
        take = (kind > 0) & (p.max(axis=1) >= threshold) & (g.fixed == 0)
        last = -2
        for n in np.flatnonzero(take):
            i, (s, e), k = g.owner[n], g.spans[n], int(kind[n]) - 1
            t = texts[i][s:e]
            s, e = s + len(t) - len(t.lstrip(".,;:!?()[]<>\"'")), e - (len(t) - len(t.rstrip(".,;:!?()[]<>\"'")))
            if e <= s:
                continue
            if last == n - 1 and (n - 1, n) in joined and added[i] and added[i][-1][2] == k:
                added[i][-1] = (added[i][-1][0], e, k)
            else:
                added[i].append((s, e, k))
            last = n
    return list(zip(g.base, added))


def fit(docs: DataFrame, sample_docs: int = 3000):
    """Train on at most ``sample_docs`` texts."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    ids = F.broadcast(materialise(ids, "pii-sample"))  # bounded by sample_docs

    def graph(batches):
        for pdf in batches:
            g = Graph(pdf["text"].tolist())
            yield pd.DataFrame({"x": [g.x.astype(np.uint8).tobytes()], "y": [g.fixed.astype(np.uint8).tobytes()],
                                "c": [g.chain.tobytes()], "s": [g.skip.tobytes()]})

    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("text").mapInPandas(
        graph, "x binary, y binary, c binary, s binary").collect()
    all_ = Graph([])
    x, y, c, s, n = [all_.x], [all_.fixed], [all_.chain], [all_.skip], 0
    for r in sorted(rows, key=lambda r: bytes(r["x"])):
        x.append(np.frombuffer(r["x"], np.uint8).reshape(-1, N_FEATURES).astype(np.float64))
        y.append(np.frombuffer(r["y"], np.uint8).astype(np.int64))
        c.append(np.frombuffer(r["c"], np.int64).reshape(-1, 2) + n)
        s.append(np.frombuffer(r["s"], np.int64).reshape(-1, 2) + n)
        n += len(y[-1])
    all_.x, all_.fixed, all_.chain, all_.skip = map(np.concatenate, (x, y, c, s))
    return train(all_)


SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def find(docs: DataFrame, model, threshold: float = 0.9) -> DataFrame:
    """``doc_id, text, base, added`` (arrays of kind, start, end) of every row."""
    def rows(spans):
        return [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]

    def make(texts):
        found = all_spans(texts, model, threshold)
        return {"base": [rows(b) for b, _ in found], "added": [rows(a) for _, a in found]}

    return map_texts(docs, ["doc_id", "text"], [StructField("base", SPAN), StructField("added", SPAN)], make)


def digests(docs: DataFrame, model, threshold: float = 0.9) -> DataFrame:
    """Counts and digests of the spans: ``n_<kind>`` counts base spans."""
    def told(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))

    def make(texts):
        found = all_spans(texts, model, threshold)
        out = {f"n_{name}": [sum(x[2] == k for x in b) for b, _ in found] for k, name in enumerate(KINDS)}
        out["base_sha256"] = [hashlib.sha256(told(b).encode()).hexdigest() for b, _ in found]
        out["spans"] = [told(b + a) for b, a in found]
        out["n_added"] = [len(a) for _, a in found]
        return out

    fields = [StructField(f"n_{name}", LongType()) for name in KINDS]
    fields += [StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_added", LongType())]
    return map_texts(docs, ["doc_id"], fields, make)


def redact(docs: DataFrame, model, threshold: float = 0.9) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; ``n_chars``,
    where it exists, is the new length.  All rows and columns stay."""
    names = [c for c in ("text", "n_chars") if c in docs.columns]

    def make(texts):
        out = []
        for t, (b, more) in zip(texts, all_spans(texts, model, threshold)):
            parts, at = [], 0
            for s, e, k in sorted(b + more):
                if s >= at:
                    parts += [t[at:s], f"[{KINDS[k]}]"]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if parts else t)
        return {"text": out, "n_chars": [None if t is None else len(t) for t in out]}

    new = map_texts(docs.withColumnRenamed("text", "__text"), [c for c in docs.columns if c not in names],
                    [docs.schema[c] for c in names], make, "__text")
    return new.select(*docs.columns)
