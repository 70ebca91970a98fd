"""M7: a linear pairwise ranker on document-feature differences.

Re-aim of the margin ranking loss: features per side are the table scorer's
document features; the pair becomes two labelled rows (+diff, 1) and
(-diff, 0), fitted with ``pyspark.ml``'s distributed ``LinearSVC`` (hinge
loss) without intercept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohera.operators.score import pair_scores
from cohera.session import materialise


def side_features(windows, score) -> list:
    """[mean window score, mean local feature, number of windows]."""
    n = F.size(windows)
    mean = lambda f: F.when(n == 0, F.lit(0.0)).otherwise(
        F.aggregate(windows, F.lit(0.0), lambda a, w: a + w[f]) / n)
    return [mean("score"), mean("feat_mean"), n.cast("double")]


def ranker_training_rows(pairs: DataFrame, perm: str | None = "perm") -> DataFrame:
    """The columns ``pos_words`` and ``neg_words``, if there, are both sides' word sets,
    ``pos_sims`` and ``neg_sims`` their overlaps."""
    words, sims = ("pos_words", "neg_words"), ("pos_sims", "neg_sims")
    has = lambda names: names if set(names) <= set(pairs.columns) else None
    s = pair_scores(pairs, perm=perm if perm in pairs.columns else None, words=has(words), sims=has(sims))
    pf = side_features(F.col("pos_windows"), F.col("pos_score"))
    nf = side_features(F.col("neg_windows"), F.col("neg_score"))
    diff = F.array(*[a - b for a, b in zip(pf, nf)])
    d = s.select("pair_id", diff.alias("d"))  # scored once for both rows
    both = F.array(F.struct(F.col("d").alias("x"), F.lit(1.0).alias("label")),
                   F.struct(F.transform("d", lambda v: -v).alias("x"), F.lit(0.0).alias("label")))
    return d.select("pair_id", F.inline(both))


def train_ranker(pairs: DataFrame, max_iter: int = 50, reg: float = 0.0):
    """Fit the ranker; returns ``(model, training_rows_with_prediction)``.

    The optimiser passes over the rows once per iteration, so they are written
    once to shared storage; their partitions follow ``spark.sql.files.*``."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    rows = materialise(ranker_training_rows(pairs), "ranker-rows").withColumn("features", array_to_vector("x"))
    rows = rows.select("pair_id", "features", "label")
    model = LinearSVC(maxIter=max_iter, regParam=reg, fitIntercept=False).fit(rows)
    return model, model.transform(rows)
