"""What the pair queries shuffle and write: keys and documents, never a pair's text."""

from pyspark.sql import functions as F

from cohera.operators import batching as BT
from cohera.operators import permute as PM
from cohera.operators import vectors as VE
from cohera.plans.evaluation import evaluate_corpus
from cohera.plans.negative_dataset import build_negative_dataset, negatives_of, prepare_documents
from cohera.sources import files as FS
from cohera.streaming import jobs as ST


def _corpus(spark, n=6):
    rows = [(str(i), [f"Line {j} of {i}" if j % 5 else "Same line" for j in range(10 + i)] + ([""] if i % 2 else [])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, sents array<string>")


def test_negatives_are_the_kept_sentences_in_order(spark):
    for r in build_negative_dataset(_corpus(spark), features={"n": lambda s: F.length(s)}).collect():
        doc = [f"Line {j} of {r.doc_id}" if j % 5 else "Same line" for j in range(10 + int(r.doc_id))] + ([""] if int(r.doc_id) % 2 else [])
        assert r.pos == [s for s in doc if s] and r.neg == [doc[i] for i in r.perm if doc[i]] and r.neg != r.pos
        assert r.pos_n == [len(s) for s in r.pos] and r.neg_n == [len(s) for s in r.neg]


def test_batches_of_documents_equal_batches_of_pairs(spark):
    docs = prepare_documents(_corpus(spark).unionByName(_corpus(spark, 1)))  # one comes twice
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("string")))
    pairs = negatives_of(docs)
    cols = ["pair_id", "batch_id", "pos_in_batch", "pos", "neg"]
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    plain = BT.minibatches(pairs, 8, drop_last=False)
    nested = BT.minibatches(pairs, 8, drop_last=False, made_from=(docs, negatives_of), numbers={"_n": F.size("pos")},
                            more=lambda i: BT.longest_of_batch(i, "_n", "longest"))
    keys = lambda df: df.groupBy("pair_id").count().collect()
    assert sorted(map(str, keys(plain))) == sorted(map(str, keys(nested)))
    once = "doc_id not in ('0') and doc_id is not null"
    assert rows(plain.where(once)) == rows(nested.where(once))
    assert sorted(map(str, BT.pad_documents(nested, need="longest").select("pair_id", "pos").where("pair_id like '2%'").collect())) == \
        sorted(map(str, BT.pad_documents(nested).select("pair_id", "pos").where("pair_id like '2%'").collect()))


def test_pair_files_hold_a_text_once_a_window_count(spark, tmp_path):
    docs = _corpus(spark)
    FS.write_pairs(negatives_of(prepare_documents(docs), nested=True), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() <= 3 * docs.count()
    cols = ["pair_id", "split", "n_windows", "perm_no", "perm", "pos", "neg"]
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert rows(FS.read_pairs(spark, str(tmp_path / "p"))) == rows(build_negative_dataset(docs))


def test_documents_stream_into_accuracy(spark, tmp_path):
    docs = _corpus(spark)
    d = prepare_documents(docs, split=None)
    d.write.parquet(str(tmp_path / "in"))
    stream = ST.file_stream(spark, str(tmp_path / "in"), d.schema)
    ST.stream_accuracy(negatives_of(stream, features={"words": lambda s: F.split(s, " ")}), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = {r.n_windows: r["count"] for r in build_negative_dataset(docs).groupBy("n_windows").count().collect()}
    assert {r.n_windows: r.n_pairs for r in ST.latest_totals(spark, str(tmp_path / "out")).collect()} == want


def test_rare_and_common_words_make_the_same_means(spark):
    toks = spark.createDataFrame([("d", 0, "a"), ("d", 0, "a"), ("d", 0, "b"), ("d", 1, "c"), ("d", 1, "zz"), ("d", 2, None)], "doc_id string, sent_idx int, word string")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [4.0, 3.0]), ("c", [2.0, 2.0]), ("c", [4.0, 4.0])], "word string, vec array<double>")
    for commonest in (0, 1, 9):
        got = {r.sent_idx: r.svec for r in VE.sentence_vectors(toks, vecs, ["doc_id", "sent_idx"], 2, commonest).collect()}
        assert got == {0: [2.0, 1.0], 1: [3.0, 3.0]}


def test_evaluation_counts_every_pair(spark):
    docs = _corpus(spark)
    want = build_negative_dataset(docs).count()
    got = {r.n_windows: r.n_pairs for r in evaluate_corpus(docs, "std").collect()}
    assert got[None] == want


def test_permutation_keeps_unchosen_places(spark):
    perm = PM.permutation_index(42, F.lit("d"), 2, F.lit(1), F.array(F.lit(1), F.lit(3)), F.lit(14), 3)
    p = spark.range(1).select(perm.alias("p")).first()["p"]
    assert sorted(p) == list(range(14)) and all(p[i] == i for i in (0, 1, 2, 6, 7, 8, 12, 13)) and p[3:6] != [3, 4, 5] and p[9:12] != [9, 10, 11]


def test_every_window_trains():
    from cohera.llm import attention_lm as lm

    assert lm.PART == 1
