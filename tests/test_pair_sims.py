"""Pairs are scored from overlaps that their document's row holds; no word set goes with a pair."""

import pytest
from pyspark.sql import functions as F

from cohera.operators import score as SC
from cohera.plans.negative_dataset import build_negative_dataset


def _docs(spark):
    words = "red blue green dog cat runs sits under over tree".split()
    lines = lambda i, n: [" ".join(words[(i * j + t * t) % 10] for t in range(1 + (i + j) % 5)) for j in range(n)]
    rows = [(str(i), lines(i, 10 + i) + ([""] if i % 2 else []) + (["x"] if i == 3 else [])) for i in range(5)] + [("same", ["one two"] * 12)]
    return spark.createDataFrame(rows, "doc_id string, sents array<string>")


def test_scores_from_overlaps_equal_scores_from_words(spark):
    words = SC.pair_scores(build_negative_dataset(_docs(spark), features={"words": SC.word_set}), words=("pos_words", "neg_words"))
    sims = SC.pair_scores(build_negative_dataset(_docs(spark), sims=True), sims=("pos_sims", "neg_sims"))
    cols = ["pair_id", "pos_score", "neg_score", F.col("pos_windows.score").alias("p"), F.col("neg_windows.score").alias("n"), "pos", "neg"]
    a, b = ({r.pair_id: r for r in d.select(*cols).collect()} for d in (words, sims))
    assert a and a.keys() == b.keys()
    for k, r in a.items():
        assert (r.pos, r.neg) == (b[k].pos, b[k].neg) and r.p == pytest.approx(b[k].p) and r.n == pytest.approx(b[k].n)
        assert r.pos_score == pytest.approx(b[k].pos_score) and r.neg_score == pytest.approx(b[k].neg_score)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_neighbourhood_mean_in_one_pass(spark, k):
    rows = [([((i * 7) % 5) / 3 for i in range(n)],) for n in range(16)]
    d = spark.createDataFrame(rows, "x array<double>")
    for r in d.select(SC.neighbourhood_mean(F.col("x"), k).alias("a"), SC.mean(SC.neighbour_mean(F.col("x"), k)).alias("b")).collect():
        assert r.a == pytest.approx(r.b)
