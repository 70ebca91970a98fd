"""N-gram Jaccard join: rare-first prefix filtering with length, positional
and suffix filters; candidates joined on prefix n-grams, each pair verified once.

A document's set holds its distinct n-word shingles (a shorter text: its whole
word sequence as one shingle; a text without words: the empty set, linked with
nothing).  Documents with equal sets form one class (told apart by a 128-bit key of the
set: two of n classes meet with a chance of about n^2 / 2^129), and only classes
are joined.  Shingles are ordered rare first by a count sketch of fixed size that
covers all documents (any fixed order gives the same links; rare first gives
few candidates).  A class publishes the first ``n - ceil(t n) + 1`` shingles of
that order; classes that can link share one of them.

Groups of near copies are not expanded into all pairs.  First each shared
prefix shingle pairs its members with two hubs; the verified links give
components.  Then only pairs of *different* components that share a prefix
shingle and pass the filters are tried, all of them, so no link that joins two
components is lost.

Nulls: a null text has an empty set; a null ``doc_id`` keeps its row and never
names a component that has another id.  Repeated rows stay and share a class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from cohera.llm.common import map_texts, materialise, mix64, text_batches, word_batch

#: buckets of the count sketch; its size does not depend on the data
SKETCH_BUCKETS = 1 << 21
_CHUNK = 1 << 14
#: parts into which the suffix filter deals a set, by hash
PARTS = 1024


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for part in text_batches(texts):
        h, first, *_ = word_batch(texts[part])
        for a, b in zip(first[:-1], first[1:]):
            w = h[a:b]
            if b - a == 0:
                out.append(np.empty(0, dtype=np.uint64))
            elif b - a < n:
                s = np.uint64(b - a)
                for x in w:
                    s = mix64(np.array([s], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
                out.append(np.array([s], dtype=np.uint64))
            else:
                s = np.zeros(b - a - n + 1, dtype=np.uint64)
                for k in range(n):
                    s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + w[k: b - a - n + 1 + k])
                out.append(np.unique(s))
    return out


def _slices(texts: pd.Series):
    """Lists of texts of bounded size."""
    texts = texts.tolist()
    return (texts[part] for part in text_batches(texts))


def _need(n: np.ndarray | int, pct: int):
    """Least overlap that a set of ``n`` shares with any partner."""
    return -(-n * pct // 100)


def count_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Shingle counts of all documents by hash bucket, added up in Spark."""
    def local(batches):
        total = np.zeros(SKETCH_BUCKETS, dtype=np.int64)
        for s in (s for pdf in batches for part in _slices(pdf["text"]) for s in shingle_sets(part, n)):
            if len(s):
                np.add.at(total, (s >> np.uint64(20)).astype(np.int64) % SKETCH_BUCKETS, 1)
        for c in range(0, SKETCH_BUCKETS, _CHUNK):
            part = total[c: c + _CHUNK]
            if part.any():
                yield pd.DataFrame({"chunk": [c // _CHUNK], "counts": [part.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(b, dtype=np.int64) for b in pdf["counts"])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [s.tobytes()]})

    rows = (docs.select("text").mapInPandas(local, "chunk int, counts binary")
            .groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect())
    total = np.zeros(SKETCH_BUCKETS, dtype=np.int64)
    for r in rows:
        total[r["chunk"] * _CHUNK: (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], dtype=np.int64)
    return np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)


def _class_key(s: np.ndarray) -> bytes:
    """128-bit key of a set: two independent sums of mixed members."""
    sums = [mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)]
    return mix64(np.array(sums, dtype=np.uint64)).astype(">u8").tobytes()


def _parities(s: np.ndarray) -> np.ndarray:
    """Whether each part of the set has an odd number of members, as bits: two
    sets differ in at least as many members as their parities do."""
    odd = np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _suffix_close(n1, h1, n2, h2, pct: int):
    """Suffix filter: linked sets differ in few members, so in few parities."""
    apart = sum((F.bit_count(F.get(h1, i).bitwiseXOR(F.get(h2, i))) for i in range(PARTS // 64)), F.lit(0))
    return (100 + pct) * apart <= (100 - pct) * (n1 + n2)


def _signatures(docs: DataFrame, sketch, n: int, pct: int) -> DataFrame:
    """One row per document: class key, set size, prefix in order, parities."""
    def make(texts):
        freq = sketch.value
        out = {"cls": [], "n": [], "prefix": [], "parity": []}
        for s in shingle_sets(texts, n):
            out["n"].append(len(s))
            if not len(s):
                for name in ("cls", "prefix", "parity"):
                    out[name].append(None)
                continue
            order = np.lexsort((s, freq[(s >> np.uint64(20)).astype(np.int64) % SKETCH_BUCKETS]))
            out["cls"].append(_class_key(s))
            out["prefix"].append(s[order[: len(s) - _need(len(s), pct) + 1]].view(np.int64))
            out["parity"].append(_parities(s))
        return out

    return map_texts(docs, ["doc_id", "k", "body"], [
        StructField("cls", BinaryType()), StructField("n", LongType()), StructField("prefix", ArrayType(LongType())),
        StructField("parity", ArrayType(LongType()))], make)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Whole shingle sets of the classes in ``wanted`` (k: one row of each)."""
    def f(batches):
        for texts in (part for pdf in batches for part in _slices(pdf["text"])):
            sets = shingle_sets(texts, n)
            yield pd.DataFrame({"cls": [_class_key(s) for s in sets], "s": [s.view(np.int64) for s in sets]})

    # the same kind of join at every size: the wanted classes grow with the documents
    some = docs.join(wanted.select("k").distinct().hint("merge"), "k", "left_semi").select("text")
    return some.mapInPandas(f, "cls binary, s array<bigint>").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, pct: int, name: str) -> DataFrame:
    """The pairs (a, b) of class keys whose whole sets meet the threshold."""
    info = classes.select("cls", "n", "parity", "k")
    p = (pairs.join(info.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("parity").alias("ha"), F.col("k").alias("ka")), "a")
         .join(info.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("hb"), F.col("k").alias("kb")), "b"))
    p = p.where(_suffix_close(F.col("na"), F.col("ha"), F.col("nb"), F.col("hb"), pct)).select("a", "b", "na", "nb", "ka", "kb")
    p = materialise(p, f"{name}-pairs")
    s = materialise(_sets(docs, p.select(F.explode(F.array("ka", "kb")).alias("k")), n), f"{name}-sets")
    j = (p.join(s.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a")
         .join(s.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    return materialise(j.where((100 + pct) * common >= pct * (F.col("na") + F.col("nb"))).select("a", "b"), f"{name}-links")


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components of ``(a, b)``: rows ``(node, root)``, root the
    least node; alternating large-star and small-star steps, each written to
    shared storage, until the edges no longer change."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def least(x, hop):
        m = x.groupBy("u").agg(F.min("v").alias("m"))
        return x.join(m.select(F.col("u"), F.least("u", "m").alias("m")), "u")

    def mark(x):
        r = x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    was = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = least(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        m = least(big, "small")
        e = m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        e = materialise(e.where("u <> v").distinct(), f"{name}-edges")
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def jaccard_components(docs: DataFrame, n: int = 3, pct: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text, ...)``.

    Two documents link when ``100 * |A & B| >= pct * |A | B|``; ``component_id``
    is the least ``doc_id`` that links reach, the document's own included.
    """
    kind = docs.schema["doc_id"].dataType
    out = _components_of_rows(docs, n, pct)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").cast(kind).alias("component_id"))


def _components_of_rows(docs: DataFrame, n: int, pct: int) -> DataFrame:
    """``doc_id, body, n_shingles, component_id, root`` of every row: ``body`` is the
    hash of the text, ``root`` names the component (null: no words)."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("body"), F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")).alias("k"))
    sketch = spark.sparkContext.broadcast(count_sketch(base, n))
    sig = materialise(_signatures(base, sketch, n, pct), "ngram-sig")
    sketch.destroy()  # the written signatures no longer need it
    classes = (sig.where("cls is not null").groupBy("cls").agg(
        F.min("n").alias("n"), F.min("k").alias("k"), F.min("doc_id").alias("doc_id"),
        F.min("prefix").alias("prefix"), F.min("parity").alias("parity")))
    classes = materialise(classes, "ngram-classes")
    # only shingles that several classes publish matter: found by narrow rows first
    pre = classes.select("cls", F.posexplode("prefix").alias("pos", "tok"))
    shared = pre.groupBy("tok").agg(F.count("*").alias("members")).where("members > 1").select("tok")
    pre = materialise(pre.join(shared, "tok").join(classes.select("cls", "n"), "cls"), "ngram-shared")
    # two hubs a shingle, the classes least by two orders of the class key
    h1 = F.struct("cls", "n", "pos")
    h2 = F.struct(F.xxhash64("cls").alias("h"), "cls", "n", "pos")
    hubs = pre.groupBy("tok").agg(F.min(h1).alias("h1"), F.min(h2).alias("h2"))
    pre = materialise(pre.join(hubs, "tok"), "ngram-prefix")

    def close(n1, p1, n2, p2):
        """Length filter, and positional filter at this shared shingle."""
        left = F.least(n1 - p1, n2 - p2)
        return (100 * F.least(n1, n2) >= pct * F.greatest(n1, n2)) & ((100 + pct) * left >= pct * (n1 + n2))

    c = F.col
    star = None
    for h in ("h1", "h2"):
        t = pre.where((c("cls") != c(f"{h}.cls")) & close(c("n"), c("pos"), c(f"{h}.n"), c(f"{h}.pos")))
        t = t.select(F.greatest("cls", f"{h}.cls").alias("a"), F.least("cls", f"{h}.cls").alias("b"))
        star = t if star is None else star.unionByName(t)
    star = materialise(star.distinct(), "ngram-tried")
    links = _verified(star, base, classes, n, pct, "ngram-star")
    comp = components(links, "ngram-star")
    # what may still link: pairs of different components that share a shingle
    lab = pre.select("tok", "pos", "cls", "n").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    lab = lab.withColumn("root", F.coalesce("root", "cls"))
    live = lab.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
    lab = lab.join(live, "tok", "left_semi").join(classes.select("cls", "parity"), "cls")
    lab = materialise(lab, "ngram-live")
    x, y = lab.alias("x"), lab.alias("y")
    cross = x.join(y, (c("x.tok") == c("y.tok")) & (c("x.root") > c("y.root"))
                   & close(c("x.n"), c("x.pos"), c("y.n"), c("y.pos"))
                   & _suffix_close(c("x.n"), c("x.parity"), c("y.n"), c("y.parity"), pct))
    cross = cross.select(F.greatest("x.cls", "y.cls").alias("a"), F.least("x.cls", "y.cls").alias("b")).distinct()
    more = _verified(cross.join(star, ["a", "b"], "left_anti"), base, classes, n, pct, "ngram-cross")
    member = classes.select("cls", "doc_id").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    member = member.withColumn("root", F.coalesce("root", "cls"))
    if not more.isEmpty():  # the late links join whole components: only their roots are walked again
        for end in ("a", "b"):
            more = more.join(comp.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
        over = components(more.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), "ngram-all")
        member = member.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        member = member.select("cls", "doc_id", F.coalesce("top", "root").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("cls", "component_id", "root")
    out = sig.select("doc_id", "body", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    return out.select("doc_id", "body", "n_shingles", "component_id", "root")


def keep_one_of_each(docs: DataFrame, n: int = 3, pct: int = 90) -> DataFrame:
    """One row of ``docs`` of each component: of its rows the one of the least id
    (a null id after all others), then of the least text hash; of rows with
    that same id and text, one.  A row without words stays."""
    rows = _components_of_rows(docs, n, pct).where("root is not null").select("doc_id", "body", "root")
    # the least of a component by partial sums, not a window: a component may be large
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "body"))
    best = rows.groupBy("root").agg(first.alias("best")).select(F.col("best.doc_id").alias("__id"), F.col("best.body").alias("__body"))
    # of equal rows one: the least row number of each id and text that is kept or has no words
    cols = docs.columns
    r = materialise(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__key", F.xxhash64("text")), "ngram-rows")
    same = r["doc_id"].eqNullSafe(F.col("__id")) & (r["__key"] == F.col("__body"))
    chosen = r.join(best.hint("merge"), same, "left_semi").groupBy("doc_id", "__key").agg(F.min("__row").alias("__row")).select("__row")
    worded = rows.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body")).distinct()
    plain = r.join(worded.hint("merge"), same, "left_anti").select("__row")
    return r.join(chosen.unionByName(plain).hint("merge"), "__row", "left_semi").select(*cols)
