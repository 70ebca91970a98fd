"""Candidate retrieval and story infill.

The reference *generates* middle sentences for a (first, last) gap with a
language model; here candidates are *retrieved* from a sentence pool and
ranked with the table scorer (M1).

Retrieval score of a candidate for a gap: ``max`` over shared terms of
``w_gap(t) * w_cand(t)`` (TF-IDF weights, idf fitted on the pool), ties to
the smaller candidate id. With a max-score the exact top-k of a gap always
lies in the union of every gap term's own top-k postings, so each term's
postings are cut to k by a window-group limit *before* gaps and candidates
meet: no cap on partners, no all-pairs for frequent terms, and the result
is exact. The sum of shared weights is reported as a second column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohera.operators.keywords import fit_tfidf, tfidf_weights
from cohera.operators.score import DEFAULT_COEF, coherence_scores, document_score_expr
from cohera.session import cut_lineage, materialise


def retrieve_candidates(gaps: DataFrame, pool: DataFrame, k: int = 5, gap_key: str = "gap_id",
                        gap_text: str = "gap_text", cand_key: str = "cand_id",
                        cand_text: str = "candidate", idf: DataFrame | None = None,
                        stop_words=None, pool_weights: DataFrame | None = None) -> DataFrame:
    """``(gap_id, cand_no, cand_id, candidate, score_max, score_sum)``,
    ``cand_no`` = 1..k by (score_max desc, cand_id asc). A gap that shares no
    term with the pool gets the ``k`` smallest candidate ids, scores 0.
    ``idf`` and ``pool_weights`` may be passed in when they are already known."""
    if idf is None:
        idf = fit_tfidf(pool, cand_key, cand_text, stop_words)
    cw = pool_weights if pool_weights is not None else tfidf_weights(pool, cand_key, cand_text, idf, stop_words)
    cw = cw.withColumnRenamed("weight", "cw")
    gw = tfidf_weights(gaps, gap_key, gap_text, idf, stop_words).withColumnRenamed("weight", "gw")
    # per-term top-k postings (partial limit runs before the shuffle)
    wt = Window.partitionBy("term").orderBy(F.col("cw").desc(), F.col(cand_key))
    post = cw.withColumn("_r", F.row_number().over(wt)).filter(F.col("_r") <= k).drop("_r")
    cand = gw.join(post, "term").select(gap_key, cand_key).distinct()
    # exact scores of the surviving (gap, candidate) pairs over all shared terms
    shared = cand.join(gw, gap_key).join(cw, [cand_key, "term"])
    sc = shared.groupBy(gap_key, cand_key).agg(F.max(F.col("gw") * F.col("cw")).alias("score_max"),
                                               F.sum(F.col("gw") * F.col("cw")).alias("score_sum"))
    wg = Window.partitionBy(gap_key).orderBy(F.col("score_max").desc(), F.col(cand_key))
    top = sc.withColumn("cand_no", F.row_number().over(wg)).filter(F.col("cand_no") <= k)
    least = [r[0] for r in pool.select(cand_key).distinct().orderBy(cand_key).limit(k).collect()]  # k ids
    if least:
        rest = gaps.select(gap_key).join(top.select(gap_key).distinct(), gap_key, "left_anti")
        fall = F.posexplode(F.array(*[F.lit(c) for c in least])).alias("cand_no", cand_key)
        rest = rest.select(gap_key, fall).withColumn("cand_no", F.col("cand_no") + 1)
        top = top.unionByName(rest.withColumn("score_max", F.lit(0.0)).withColumn("score_sum", F.lit(0.0)))
    return top.join(pool.select(cand_key, cand_text), cand_key)


def rank_candidates(cands: DataFrame, first: str = "first", last: str = "last",
                    cand_text: str = "candidate", coef=DEFAULT_COEF) -> DataFrame:
    """M5: score ``[first, candidate, last]`` with the table scorer (exactly
    one valid window) -> adds ``rank_score``."""
    doc = F.array(F.col(first), F.col(cand_text), F.col(last))
    return cands.withColumn("rank_score", document_score_expr(coherence_scores(doc, coef)))


def best_candidate(scored: DataFrame, gap_key: str = "gap_id", score: str = "rank_score",
                   no: str = "cand_no") -> DataFrame:
    """K5: arg-max score per gap; the first candidate wins ties."""
    best = scored.groupBy(gap_key).agg(
        F.max(F.struct(F.col(score).alias("s"), (-F.col(no)).alias("_neg_no"),
                       *[F.col(c) for c in scored.columns if c not in (gap_key, score, no)]))
        .alias("b"))
    cols = [F.col(f"b.{c}").alias(c) for c in scored.columns if c not in (gap_key, score, no)]
    return best.select(gap_key, F.col("b.s").alias(score), (-F.col("b._neg_no")).alias(no), *cols)


def infill_round(story: DataFrame, pool: DataFrame, idf: DataFrame, k: int = 5,
                 story_key: str = "story_id", pool_weights: DataFrame | None = None) -> DataFrame:
    """One M6 round: every gap between consecutive sentences gets its best
    retrieved candidate. ``story(story_id, pos, sentence)`` -> same schema,
    positions re-densified. Scores are compared after rounding to 9 decimals."""
    w = Window.partitionBy(story_key).orderBy("pos")
    g = story.withColumn("last", F.lead("sentence").over(w)).filter(F.col("last").isNotNull())
    g = g.select(story_key, F.col("pos").alias("gap_no"), F.col("sentence").alias("first"), "last",
                 F.concat_ws("|", F.col(story_key).cast("string"), F.col("pos").cast("string")).alias("gap_id"))
    gaps = g.withColumn("gap_text", F.concat_ws(" ", "first", "last"))
    c = retrieve_candidates(gaps.select("gap_id", "gap_text"), pool, k, idf=idf, pool_weights=pool_weights)
    c = c.join(gaps.select("gap_id", story_key, "gap_no", "first", "last"), "gap_id")
    ranked = rank_candidates(c).withColumn("rank_score", F.round("rank_score", 9))
    best = best_candidate(ranked.select("gap_id", "rank_score", "cand_no", story_key, "gap_no",
                                                    "candidate"))
    ins = best.select(story_key, (F.col("gap_no") * 2 + 1).alias("pos"), F.col("candidate").alias("sentence"))
    old = story.select(story_key, (F.col("pos") * 2).alias("pos"), "sentence")
    merged = old.unionByName(ins)
    return merged.withColumn("pos", (F.row_number().over(Window.partitionBy(story_key).orderBy("pos")) - 1)
                             .cast("int"))


def infill_story(seeds: DataFrame, pool: DataFrame, rounds: int = 2, k: int = 5,
                 story_key: str = "story_id", checkpoint: bool = True) -> DataFrame:
    """M6: start from ``seeds(story_id, first, last)``; each round inserts one
    ranked sentence in every gap (2 -> 3 -> 5 -> 9 sentences). A short
    driver loop over rounds; each round's story table is checkpointed to the
    shared checkpoint folder so lineage stays short and a lost executor only
    recomputes one round."""
    pool = materialise(pool, "infill-pool")
    idf = materialise(fit_tfidf(pool, "cand_id", "candidate"), "infill-idf")
    weights = materialise(tfidf_weights(pool, "cand_id", "candidate", idf), "infill-weights")
    story = seeds.select(story_key, F.posexplode(F.array("first", "last")).alias("pos", "sentence"))
    for _ in range(rounds):
        story = infill_round(story, pool, idf, k, story_key, weights)
        if checkpoint:
            story = cut_lineage(story)
    return story
