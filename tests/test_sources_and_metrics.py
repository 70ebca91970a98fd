"""File sources, training-log metrics (Y13), streaming equals batch."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from cohera.operators import metrics as ME
from cohera.sources import files as FS


def test_y13_best_checkpoint_from_trainer_state(spark):
    d = tempfile.mkdtemp(prefix="cohera-state-")
    run = os.path.join(d, "run_a")
    os.makedirs(run)
    state = {"best_metric": 0.5951671600341797, "global_step": 1500, "max_steps": 1770, "log_history": [
        {"epoch": 2.82, "step": 500, "learning_rate": 4e-05, "loss": 3.8931},
        {"epoch": 2.82, "step": 500, "eval_loss": 0.6259, "eval_runtime": 74.7337},
        {"epoch": 5.65, "step": 1000, "eval_loss": 0.6028, "eval_runtime": 74.6959},
        {"epoch": 8.47, "step": 1500, "eval_loss": 0.5951671600341797, "eval_runtime": 74.8045}]}
    with open(os.path.join(run, "trainer_state.json"), "w") as f:
        json.dump(state, f, indent=2)
    log = FS.read_training_log(spark, os.path.join(run, "trainer_state.json"))
    assert log.count() == 4 and log.filter(F.col("loss").isNotNull()).count() == 1
    best = ME.best_checkpoint(log).first()
    assert best.run == "run_a" and best.best_step == 1500 and best.best_eval_loss == 0.5951671600341797


def test_reviews_header_modes(spark):
    d = tempfile.mkdtemp(prefix="cohera-rev-")
    p = os.path.join(d, "r.tsv")
    with open(p, "w") as f:
        f.write("\t".join(FS.REVIEW_COLUMNS) + "\n")
        f.write("1\t__label1__\t5\tY\tToys\tP1\tMaze\tFun\tGreat toy.\n")
    assert FS.read_reviews(spark, p).count() == 1
    data = FS.read_reviews(spark, p, header="data")
    assert data.count() == 2 and data.filter(F.col("RATING").isNull()).count() == 1


def test_stream_scores_equal_batch(spark):
    from cohera.plans import queries as Q
    s = Q.q_st2_stream_scores(spark, "/root/testdata/sf0.001")
    b = Q.q_a6_document_score(spark, "/root/testdata/sf0.001")
    assert s.select("doc_id", "doc_score").exceptAll(b).count() == 0
    assert s.count() == b.count()


def test_st3_event_time_window_stream(spark):
    """ST3 event-time variant: watermarked tumbling windows over a file stream."""
    import datetime as dt

    from cohera.plans.queries import scratch_path
    from cohera.streaming import jobs as ST

    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(f"p{i}", 1 + i % 2, 1.0 if i % 3 else 0.5, 0.7, t0 + dt.timedelta(minutes=20 * i)) for i in range(12)]
    schema = "pair_id string, n_windows int, pos_score double, neg_score double, ts timestamp"
    src = scratch_path(spark, "st3e-in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)  # in event-time order: no late rows
    stream = ST.file_stream(spark, src, schema)
    agg = ST.accuracy_stream(stream, "n_windows", event_time="ts", window="1 hour", watermark="0 seconds")
    sink, ck = scratch_path(spark, "st3e-out"), scratch_path(spark, "st3e-ck")
    q = agg.writeStream.outputMode("append").format("parquet").option("path", sink) \
        .option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(sink)
    batch = ST.accuracy_stream(spark.createDataFrame(rows, schema), "n_windows", event_time="ts", window="1 hour")
    # windows closed by the watermark are final and equal the batch result
    assert out.count() > 0
    assert out.select("window", "n_windows", "n_pairs", "n_correct").exceptAll(
        batch.select("window", "n_windows", "n_pairs", "n_correct")).count() == 0


def test_a_corpus_is_written_as_a_file_a_document(spark, tmp_path):
    """What a partitioned write gives, without a folder a document."""
    import os

    from cohera.sources.corpus import read_corpus, write_corpus

    rows = [(1, "a b\n\u00e4 c"), (2, ""), (3, None), (4, "x\n\ny\n"), (5, "one"), (5, "two"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    write_corpus(docs, "file:" + new)
    docs.write.partitionBy("doc_id").text(old)
    got, want = (sorted(map(tuple, read_corpus(spark, p, encoding="UTF-8", key_from_dir="doc_id").collect())) for p in (new, old))
    assert got == want and len(got) == 6
    assert [d for _, folders, _ in os.walk(new) for d in folders] == ["part-00000"]
    write_corpus(docs, new)  # a repeated task puts the same files in place
    assert read_corpus(spark, new, encoding="UTF-8").count() == 6
