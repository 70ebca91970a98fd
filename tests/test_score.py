"""Scorer fixtures (Y11) and array/long form equality."""

from pyspark.sql import functions as F

from cohera.operators import score as SC

# The ordered example document, a plain input (fixed value).
ORDERED = [
    ".START",
    "McDermott International Inc. said its Babcock & Wilcox unit completed the sale of its Bailey "
    "Controls Operations to Finmeccanica S.p.",
    "A. for $295 million.",
    "Finmeccanica is an Italian state-owned holding company with interests in the mechanical "
    "engineering industry.",
    "Bailey Controls, based in Wickliffe, Ohio, makes computerized industrial controls systems.",
    "It employs 2,700 people and has annual revenue of about $370 million.",
]


def _score(spark, docs):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "doc_id string, sents array<string>")
    return [r.s for r in df.orderBy("doc_id").select(
        SC.document_score_expr(SC.coherence_scores("sents")).alias("s")).collect()]


def test_y11_fixture_scores(spark):
    swapped = [ORDERED[1], ORDERED[0]] + ORDERED[2:]
    o, r, s = _score(spark, [ORDERED, ORDERED[::-1], swapped])
    assert round(o, 6) == 0.282667
    assert round(r, 6) == 0.188444
    assert round(s, 6) == round(o, 6)


def test_array_and_long_forms_agree(spark):
    from cohera.plans import catalog as C
    from cohera.operators.text_ops import sentence_table
    docs = C.corpus(spark, "/root/testdata/sf0.001")
    a = docs.select("doc_id", F.explode(SC.coherence_scores("sents")).alias("w")).select(
        "doc_id", "w.win_idx", F.round("w.score", 9).alias("score"))
    b = SC.coherence_scores_long(sentence_table(docs)).select("doc_id", "win_idx", F.round("score", 9).alias("score"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_running_best(spark):
    log = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.4), ("r", 3, 0.6)], "run string, epoch int, accuracy double")
    rows = SC.running_best(log).orderBy("epoch").collect()
    assert [r.improved for r in rows] == [True, False, True]
    assert [r.best_before for r in rows] == [0.0, 0.5, 0.5]
