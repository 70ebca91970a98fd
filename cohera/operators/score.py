"""Coherence scoring with table features.

The reference scores sentence orders with a neural network. This library
keeps the *shape* of that score with lexical table features, not the
network's values:

* ``T_i``   distinct words ``[\\p{L}\\p{N}_]{2,}`` of the lower-cased sentence i;
* ``sim_i`` ``|T_i ∩ T_{i+1}| / |T_{i+1}|`` (0 when ``T_{i+1}`` is empty) for
  i = 0..L-2 -- directional, so a reversed document scores differently;
* ``g``     mean over i of the 5-sentence neighbourhood mean of ``sim`` (W3);
* ``score_i = a*sim_i + b*sim_{i+1} + c*g + d`` on the valid 3-sentence
  windows i = 0..L-3 (W2); the document score is their sum (A6).

Two equivalent engines: the array form (row-local higher-order functions, no
shuffle, usable on streams) and the long form (W1/W3 as window functions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohera.functions.text import col, let
from cohera.operators.permute import by_index

WORD_RE = r"[\p{L}\p{N}_]{2,}"
DEFAULT_COEF = (1.0, 1.0, 1.0, 0.0)


def word_set(sentence) -> Column:
    """``T_i``: distinct words of the lower-cased sentence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(sentence)), F.lit(WORD_RE), 0))


def overlap(a: Column, b: Column) -> Column:
    """Directional overlap ``|a ∩ b| / |b|`` (0 for an empty ``b``)."""
    return F.when(F.size(b) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(b))


# ---------------------------------------------------------------------------
# array form
# ---------------------------------------------------------------------------

def sims_from_sets(sets: Column) -> Column:
    """``sim_i`` for i = 0..L-2 from an array of word sets."""
    def body(S):
        n = F.size(S)
        idx = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(idx, lambda i: overlap(F.element_at(S, i + 1), F.element_at(S, i + 2)))
    return let(sets, body)


def sims_of_order(sets: Column, sims: Column, order: Column) -> Column:
    """``sim_i`` of ``sets`` read in ``order``: neighbours that stand beside each
    other in the document too have its own ``sims``."""
    def body(O):
        n = F.size(O)
        idx = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))

        def at(i):
            a, b = F.element_at(O, i + 1), F.element_at(O, i + 2)
            return F.when(b == a + 1, F.element_at(sims, b)).otherwise(overlap(F.element_at(sets, a + 1), F.element_at(sets, b + 1)))
        return F.transform(idx, at)
    return let(order, body)


def neighbour_mean(xs: Column, k: int = 2) -> Column:
    """W3 array form: mean over positions ``i-k .. i+k`` inside the array."""
    def body(X):
        n = F.size(X)

        def at(i):
            lo = F.greatest(i - k, F.lit(0))
            hi = F.least(i + k, n - 1)
            part = F.slice(X, (lo + 1).cast("int"), (hi - lo + 1).cast("int"))
            return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / F.size(part)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(
            F.array().cast("array<double>"))
    return let(xs, body)


def mean(xs: Column) -> Column:
    return let(xs, lambda X: F.when(F.size(X) == 0, F.lit(0.0)).otherwise(
        F.aggregate(X, F.lit(0.0), lambda acc, x: acc + x) / F.size(X)))


def neighbourhood_mean(xs: Column, k: int = 2) -> Column:
    """``mean(neighbour_mean(xs, k))`` in one pass: of ``4k`` values or more all but
    the ``2k`` at either end weigh 1, and those by fixed numbers."""
    shares = [1.0 / (min(i, k) + k + 1) for i in range(3 * k)]
    more = [sum(shares[max(0, j - k): j + k + 1]) - 1.0 for j in range(2 * k)]

    def body(X):
        ends = F.lit(0.0)
        for j, m in enumerate(more):
            ends = ends + F.lit(m) * (F.element_at(X, j + 1) + F.element_at(X, -(j + 1)))
        whole = (F.aggregate(X, F.lit(0.0), lambda acc, x: acc + x) + ends) / F.size(X)
        return F.when(F.size(X) >= max(4 * k, 1), whole).otherwise(mean(neighbour_mean(X, k)))
    return let(xs, body)


def window_scores_from_sims(sims: Column, coef=DEFAULT_COEF, k: int = 2) -> Column:
    """Per valid window ``struct(win_idx, score, feat_mean)``; windows are
    i = 0..L-3 (``size(sims) = L-1``), so L < 3 has none."""
    a, b, c, d = coef

    def body(S):
        n = F.size(S)
        idx = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))

        def with_g(g):
            def at(i):
                s0 = F.element_at(S, i + 1)
                s1 = F.element_at(S, i + 2)
                return F.struct(i.alias("win_idx"),
                                (F.lit(a) * s0 + F.lit(b) * s1 + F.lit(c) * g + F.lit(d)).alias("score"),
                                ((s0 + s1) / 2.0).alias("feat_mean"))
            return F.transform(idx, at)
        return let(neighbourhood_mean(S, k), with_g)
    return let(sims, body)


def coherence_scores(sents, coef=DEFAULT_COEF, k: int = 2, perm=None) -> Column:
    """M1 array form: window scores of a document. With ``perm`` the word
    sets of the *positive* sentences are computed once and gathered by the
    permutation (the encode-once, reorder-for-negatives plan)."""
    sets = F.transform(col(sents), word_set)
    if perm is not None:
        sets = let(sets, lambda S: F.transform(col(perm), lambda i: F.element_at(S, (i + 1).cast("int"))))
    return window_scores_from_sims(sims_from_sets(sets), coef, k)


def document_score_expr(window_scores: Column) -> Column:
    """A6 array form: sum of the valid window scores."""
    return F.aggregate(window_scores, F.lit(0.0), lambda acc, s: acc + s["score"])


def pair_scores(pairs: DataFrame, coef=DEFAULT_COEF, k: int = 2, task: str = "std",
                pos: str = "pos", neg: str = "neg", perm: str | None = None,
                words: tuple[str, str] | None = None, sims: tuple[str, str] | None = None) -> DataFrame:
    """Score both sides of every pair row (no shuffle).

    ``task='std'`` scores the stored negative; ``task='inv'`` scores the
    reversed positive instead (P7). When ``perm`` names an index column the
    negative reuses the positive's word sets (J9). Adds ``pos_windows``,
    ``neg_windows`` (arrays of window structs) and ``pos_score``,
    ``neg_score``. ``words`` names a pair of columns that hold both sides' word
    sets already, ``sims`` one that holds their ``sim_i``."""
    def side(values):
        return let(window_scores_from_sims(values, coef, k),
                   lambda W: F.struct(W.alias("windows"), document_score_expr(W).alias("score")))

    def both(S):
        if task == "inv":
            neg_sets = F.reverse(S)
        elif words is not None:
            neg_sets = F.col(words[1])
        elif perm is not None:
            # reuse the positive's word sets unless cleaning dropped a sentence
            gathered = F.transform(col(perm), lambda i: F.element_at(S, (i + 1).cast("int")))
            neg_sets = F.when(F.size(col(perm)) == F.size(col(pos)), gathered).otherwise(
                F.transform(col(neg), word_set))
        else:
            neg_sets = F.transform(col(neg), word_set)
        return F.struct(side(sims_from_sets(S)).alias("p"), side(sims_from_sets(neg_sets)).alias("n"))

    if sims is not None:
        scored = F.struct(side(F.col(sims[0])).alias("p"), side(F.col(sims[1])).alias("n"))
    else:
        scored = let(F.col(words[0]) if words is not None else F.transform(col(pos), word_set), both)
    out = pairs.withColumn("_sc", scored)
    return out.select("*", F.col("_sc.p.windows").alias("pos_windows"),
                      F.col("_sc.n.windows").alias("neg_windows"),
                      F.col("_sc.p.score").alias("pos_score"),
                      F.col("_sc.n.score").alias("neg_score")).drop("_sc")


# ---------------------------------------------------------------------------
# long form (window functions)
# ---------------------------------------------------------------------------

def adjacent_pairs(sentences: DataFrame, key: str = "doc_id", idx: str = "sent_idx",
                   value: str = "sentence") -> DataFrame:
    """Each sentence with its successor; the last is paired with itself
    (index clamp). Adds ``next_<value>``."""
    w = Window.partitionBy(key).orderBy(idx)
    return sentences.withColumn(f"next_{value}", F.coalesce(F.lead(value).over(w), F.col(value)))


def score_windows_mask(n_sents: Column, win_idx: Column) -> Column:
    """Valid 3-sentence windows are ``0 .. L-3``."""
    return win_idx <= n_sents - 3


def neighbour_context(df: DataFrame, key: str, idx: str, value: str, k: int = 2,
                      name: str = "ctx") -> DataFrame:
    """Mean of ``value`` over rows ``idx-k .. idx+k`` of the same key."""
    w = Window.partitionBy(key).orderBy(idx).rowsBetween(-k, k)
    return df.withColumn(name, F.avg(value).over(w))


def coherence_scores_long(sentences: DataFrame, key: str = "doc_id", idx: str = "sent_idx",
                          value: str = "sentence", coef=DEFAULT_COEF, k: int = 2) -> DataFrame:
    """M1 long form: ``(key, win_idx, score, feat_mean)`` via W1, W3, W2.

    Shuffles once by ``key`` (all windows are partitioned by document, and a
    document is bounded in length)."""
    a, b, c, d = coef
    s = sentences.select(key, idx, word_set(value).alias("T"))
    w = Window.partitionBy(key).orderBy(idx)
    s = adjacent_pairs(s, key, idx, "T")
    s = s.withColumn("_last", F.lead(idx).over(w).isNull())
    sim = s.filter(~F.col("_last")).select(key, idx, overlap(F.col("T"), F.col("next_T")).alias("sim"))
    sim = neighbour_context(sim, key, idx, "sim", k, "ctx")
    wk = Window.partitionBy(key)
    sim = sim.withColumn("g", F.avg("ctx").over(wk)) \
             .withColumn("sim1", F.lead("sim").over(w))
    out = sim.filter(F.col("sim1").isNotNull())
    return out.select(key, F.col(idx).alias("win_idx"),
                      (F.lit(a) * F.col("sim") + F.lit(b) * F.col("sim1") + F.lit(c) * F.col("g")
                       + F.lit(d)).alias("score"),
                      ((F.col("sim") + F.col("sim1")) / 2.0).alias("feat_mean"))


def reorder_features(features: DataFrame, order: DataFrame, key: str = "doc_id",
                     src: str = "src", dst: str = "dst", idx: str = "sent_idx") -> DataFrame:
    """J9 long form: negatives reuse the positive's per-sentence features,
    gathered by an order table ``(pair_id, key, dst, src)`` -- an equi-join
    on ``(key, src)``."""
    f = features.withColumnRenamed(idx, src)
    return order.join(f, [key, src], "inner")


def feature_arrays(features: DataFrame, value: str, key: str = "doc_id", idx: str = "sent_idx") -> DataFrame:
    """``key, <value>s``: a document's features in its row, at the place of their
    sentence (null: none). A document's ``idx`` are single."""
    per = features.groupBy(key).agg(F.collect_list(F.struct(F.col(idx).alias("_i"), F.struct(F.col(value)).alias("_v"))).alias("_e"))
    none = F.lit(None).cast(features.select(F.struct(value)).schema[0].dataType)
    return per.select(key, by_index(F.col("_e"), "_i", "_v", none).alias(f"{value}s"))


def reorder_feature_rows(pairs: DataFrame, value: str, key: str = "pair_id", perm: str = "perm") -> DataFrame:
    """J9 in the pair's row: ``key, dst, src, value`` from the column ``<value>s`` of
    :func:`feature_arrays` and the pair's index array."""
    at = F.transform(perm, lambda src, dst: F.struct(dst.alias("dst"), src.alias("src"), F.get(F.col(f"{value}s"), src).alias("_v")))
    return pairs.select(key, F.inline(at)).where(F.col("_v").isNotNull()).select(key, "dst", "src", f"_v.{value}")


# ---------------------------------------------------------------------------
# aggregates over scores
# ---------------------------------------------------------------------------

def window_table(scored: DataFrame, key: str = "pair_id", by: list[str] | None = None, paired: bool = False) -> DataFrame:
    """X9 long table ``(by, pair_id, side, win_idx, score, feat_mean)``, both sides
    read off a pair's row at once.

    With ``paired`` a row is a window that both sides have, with their scores and
    features ``(by, pair_id, win_idx, ps, pf, ns, nf)``: made in the pair's row,
    whose windows count up from 0, so nothing is shuffled. Where rows may share a
    ``key``, :func:`paired_windows` pairs the windows of all of them."""
    by = by or []
    if paired:
        both = F.arrays_zip(F.col("pos_windows").alias("p"), F.col("neg_windows").alias("n"))
        w = scored.select(*by, key, F.explode(both).alias("w")).where("w.p IS NOT NULL AND w.n IS NOT NULL")
        return w.select(*by, key, F.col("w.p.win_idx").alias("win_idx"), F.col("w.p.score").alias("ps"), F.col("w.p.feat_mean").alias("pf"),
                        F.col("w.n.score").alias("ns"), F.col("w.n.feat_mean").alias("nf"))

    def of(side):
        return F.transform(f"{side}_windows", lambda w: F.struct(F.lit(side).alias("side"), w["win_idx"].alias("win_idx"),
                                                                 w["score"].alias("score"), w["feat_mean"].alias("feat_mean")))
    none = F.array().cast("array<struct<side:string,win_idx:int,score:double,feat_mean:double>>")
    sides = F.concat(F.coalesce(of("pos"), none), F.coalesce(of("neg"), none))
    return scored.select(*by, key, F.inline(sides))


def document_score(windows: DataFrame, key: str = "pair_id") -> DataFrame:
    """Sum of valid window scores per (pair, side)."""
    return windows.groupBy(key, "side").agg(F.sum("score").alias("doc_score"))


def pairwise_accuracy(doc_scores: DataFrame, by: list[str] | None = None, key: str = "pair_id",
                      pos: str = "pos_score", neg: str = "neg_score") -> DataFrame:
    """A5: fraction of pairs with score(pos) strictly above score(neg), per
    group ``by`` (e.g. a batch id) or overall."""
    by = by or []
    return doc_scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg((F.col(pos) > F.col(neg)).cast("double")).alias("accuracy"))


def paired_windows(windows: DataFrame, key: str = "pair_id", by: list[str] | None = None) -> DataFrame:
    """:func:`window_table`'s paired form from its long one: each window of the
    positive side with each of that key and place of the negative side."""
    p = windows.filter(F.col("side") == "pos").select(*(by or []), key, "win_idx", F.col("score").alias("ps"),
                                                      F.col("feat_mean").alias("pf"))
    n = windows.filter(F.col("side") == "neg").select(key, "win_idx", F.col("score").alias("ns"),
                                                      F.col("feat_mean").alias("nf"))
    return p.join(n, [key, "win_idx"], "inner")


def adaptive_pairwise_loss(windows: DataFrame, margin: float = 5.0, key: str = "pair_id",
                           denominator: str = "valid", by: list[str] | None = None) -> DataFrame:
    """``mean(max(0, m*mask + neg*mask - pos*mask))``; ``mask`` is 1 where
    the window's mean local feature differs between the sides.

    ``denominator='valid'`` averages over valid windows; ``'padded'`` divides
    by ``n_pairs * max_windows`` of the group, as a padded batch tensor.
    ``windows`` is :func:`window_table`'s long or paired form."""
    by = by or []
    j = paired_windows(windows, key, by) if "side" in windows.columns else windows
    mask = (~F.col("pf").eqNullSafe(F.col("nf"))).cast("double")
    term = F.greatest(F.lit(0.0), F.lit(margin) * mask + F.col("ns") * mask - F.col("ps") * mask)
    j = j.withColumn("_t", term)
    if denominator == "valid":
        return j.groupBy(*by).agg(F.avg("_t").alias("loss"), F.count(F.lit(1)).alias("n_windows"))
    if denominator == "padded":
        per_pair = j.groupBy(*by, key).agg(F.sum("_t").alias("_s"), F.count(F.lit(1)).alias("_n"))
        return per_pair.groupBy(*by).agg(
            (F.sum("_s") / (F.count(F.lit(1)) * F.max("_n"))).alias("loss"),
            F.sum("_n").alias("n_windows"))
    raise ValueError(denominator)


def running_best(log: DataFrame, run: str = "run", order: str = "epoch",
                 metric: str = "accuracy", start: float | None = 0.0, better: str = "max") -> DataFrame:
    """Best-so-far metric before each row (``start`` before the first)
    and whether this row improves on it (strictly). ``better='min'`` for
    losses (start default then +inf)."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if better == "max":
        prev = F.coalesce(F.max(metric).over(w), F.lit(0.0 if start is None else start))
        return log.withColumn("best_before", prev).withColumn("improved", F.col(metric) > prev) \
                  .withColumn("best_so_far", F.greatest(prev, F.col(metric)))
    prev = F.coalesce(F.min(metric).over(w), F.lit(float("inf") if start is None else start))
    return log.withColumn("best_before", prev).withColumn("improved", F.col(metric) < prev) \
              .withColumn("best_so_far", F.least(prev, F.col(metric)))
