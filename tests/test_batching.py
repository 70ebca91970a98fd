"""Batching invariants and fixtures."""

from pyspark.sql import functions as F

from cohera.operators import batching as BT
from cohera.operators import infill as IN


def test_y12_lm_targets(spark):
    r = spark.range(1).select(BT.lm_targets(F.array(F.lit(5), F.lit(6), F.lit(7)), 100, 101).alias("t")).first()["t"]
    assert r.forward == [6, 7, 101] and r.backward == [100, 5, 6]


def test_pad_truncate_and_shift(spark):
    r = spark.range(1).select(BT.pad_truncate(F.array(*[F.lit(i) for i in (3, 4, 5)]), 5, 0).alias("p")).first()["p"]
    assert r.input_ids == [3, 4, 5, 0, 0] and r.attention_mask == [1, 1, 1, 0, 0] and r.labels == r.input_ids
    s = spark.range(1).select(BT.shift_targets(F.array(*[F.lit(i) for i in (3, 4, 5, 0)]), 0).alias("s")).first()["s"]
    assert s.trg_in == [3, 4, 5] and s.trg_out == [4, 5, 0] and s.ntokens == 2


def test_minibatches_drop_tail_and_partition_independent(spark):
    pairs = spark.range(100).select(F.col("id").cast("string").alias("pair_id"))
    a = BT.minibatches(pairs.repartition(1), 32)
    b = BT.minibatches(pairs.repartition(9), 32)
    assert a.count() == 96
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.c for r in a.groupBy("batch_id").count().withColumnRenamed("count", "c").collect()} == {32}


def test_y14_infill_growth(spark):
    words = "river stone bridge valley"
    pool = spark.createDataFrame([(f"c{i}", f"The {words} number{i} walk.") for i in range(12)],
                                 "cand_id string, candidate string")
    seeds = spark.createDataFrame([("s1", f"A {words} start.", f"The {words} end.")],
                                  "story_id string, first string, last string")
    for rounds, want in [(1, 3), (2, 5), (3, 9)]:
        out = IN.infill_story(seeds, pool, rounds=rounds, k=3)
        rows = out.orderBy("pos").collect()
        assert len(rows) == want
        assert [r.pos for r in rows] == list(range(want))
        assert rows[0].sentence.startswith("A ") and rows[-1].sentence.endswith("end.")


def test_gap_without_a_shared_term_is_filled(spark):
    pool = spark.createDataFrame([("c2", "green river"), ("c1", "blue stone"), ("c3", "old bridge")], "cand_id string, candidate string")
    gaps = spark.createDataFrame([("g", "nothing shared"), ("h", "stone wall")], "gap_id string, gap_text string")
    got = sorted((r.gap_id, r.cand_no, r.cand_id) for r in IN.retrieve_candidates(gaps, pool, 2).collect())
    assert got == [("g", 1, "c1"), ("g", 2, "c2"), ("h", 1, "c1")]


def test_filler_is_as_long_as_the_batch(spark):
    b = spark.createDataFrame([(0, "p", 0, ["a", "b", "c"], ["c", "b"])], "batch_id long, pair_id string, pos_in_batch int, pos array<string>, neg array<string>")
    fill = BT.fill_batch(b, 3).where("pair_id is null").collect()
    assert len(fill) == 2 and all(r.pos == r.neg == ["<pad>"] * 3 for r in fill)


def test_empty_inputs(spark):
    from cohera.operators import vocab as VO
    none = spark.createDataFrame([], "word string, cnt long")
    assert [r.word for r in VO.build_vocab(none).orderBy("idx").collect()] == ["<unk>", "<pad>"]
    assert BT.minibatches(spark.createDataFrame([], "pair_id string"), 32).count() == 0


def test_strict_encode_raises(spark):
    import pytest
    from cohera.operators import vocab as VO
    v = VO.build_vocab(spark.createDataFrame([("a", 2)], "word string, cnt long"))
    t = spark.createDataFrame([("d", 0, 0, "a"), ("d", 0, 1, "zzz")], "doc_id string, sent_idx int, tok_idx int, word string")
    with pytest.raises(Exception, match="word not in vocabulary: zzz"):
        VO.encode(t, v, oov="error").collect()
    assert [r.idx for r in VO.encode(t.where("word = 'a'"), v, oov="error").collect()] == [0]


def test_greedy_batches_do_not_depend_on_other_shards(spark):
    d = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 17 + 1).alias("s"), (F.col("id") % 11 + 1).alias("t"))
    a = {r.k: (r.shard, r.batch_no) for r in BT.token_budget_batches(d, 200, "s", "t", "k", n_shards=4).collect()}
    some = [k for k, v in a.items() if v[0] == 1]
    b = {r.k: (r.shard, r.batch_no) for r in BT.token_budget_batches(d.where(F.col("k").isin(some)), 200, "s", "t", "k", n_shards=4).collect()}
    assert b == {k: a[k] for k in some}


def test_token_budget_streams_sorted_shards(spark):
    """No shard is held whole: the rows come sorted, in Arrow batches of any size."""
    from cohera.operators.batching import token_budget_batches

    df = spark.range(500).selectExpr("id", "id * 37 % 50 + 1 AS a", "id * 11 % 40 + 1 AS b")
    want = sorted(map(tuple, token_budget_batches(df, 300, "a", "b", "id", n_shards=3).collect()))
    out = token_budget_batches(df, 300, "a", "b", "id", n_shards=3)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) == 500 and len({r[1] for r in want}) == 3


def test_padding_is_counted_without_a_copy_of_the_padded_document(spark, tmp_path):
    """the padded sentences were copied into a row before they were counted."""
    import cohera.plans.queries as Q

    rows = [(i, "\n".join(" ".join(f"w{j}x{k}" for k in range(1 + (i * j) % 6)) + (" <pad>" if j == 4 else "") for j in range(10 + i))) for i in range(1, 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = Q.q_b3_pad_sentences(spark, str(tmp_path))
    step = df._jdf.queryExecution().optimizedPlan().toString().split("\n")[1]
    assert "lambdafunction(concat" in step and "array_remove" in step  # padded and counted in one step
    batches = {r.pair_id: r.batch_id for r in Q.q_b1_minibatches(spark, str(tmp_path)).collect()}
    pairs = [r for r in Q._pairs(spark, str(tmp_path)).collect() if r.pair_id in batches]
    want = {}
    for side in ("pos", "neg"):
        longest = {b: max(len(s.split()) for r in pairs if batches[r.pair_id] == b for s in r[side]) for b in batches.values()}
        for r in pairs:
            m = longest[batches[r.pair_id]]
            want[r.pair_id, side] = (m, sum(m - len(s.split()) + s.split().count("<pad>") for s in r[side]))
    assert {(r.pair_id, r.side): (r.padded_len, r.n_pads) for r in df.collect()} == want and want
