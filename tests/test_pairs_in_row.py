"""What belongs to a pair is worked out in its document's row, as the long forms do."""

from pyspark.sql import functions as F

from cohera.operators import grid as GR
from cohera.operators import permute as PM
from cohera.operators import score as SC


def test_alignment_by_numbers_equals_alignment_by_text(spark):
    """Sentences repeat, one side is longer."""
    rows = [("a", ["x", "y", "x", "z"], [3, 2, 0, 1]), ("b", ["q", "q", "q"], [2, 0, 1]), ("c", ["m", None, "n"], [1, 0])]
    d = spark.createDataFrame(rows, "pair_id string, pos array<string>, perm array<int>")
    d = d.withColumn("neg", PM.gather(F.col("pos"), F.col("perm"))).withColumn("p", F.transform("pos", PM.first_place))
    d = d.withColumn("n", PM.gather(F.col("p"), F.col("perm")))
    for mode in PM.MODES:
        assert sorted(PM.align_order(d, mode=mode).collect()) == sorted(PM.align_order(d, "p", "n", mode=mode).collect())


def test_by_index_fills_gaps(spark):
    d = spark.createDataFrame([([(3, "d"), (1, "b")],), ([(1, "b"), (0, "a")],)], "e array<struct<i:int,v:string>>")
    assert [r[0] for r in d.select(PM.by_index(F.col("e"), "i", "v", F.lit("-"))).collect()] == [["-", "b", "-", "d"], ["a", "b"]]


def _grid(spark):
    cells = [("d", "A", 0, "X"), ("d", "A", 2, "X"), ("d", "B", 4, "X"), ("d", "B", 0, "S"), ("e", "A", 1, "X")]
    grid = spark.createDataFrame(cells, "doc_id string, entity string, sent_idx int, role string")
    widths = spark.createDataFrame([("d", 6), ("e", 2)], "doc_id string, n_cols int")
    perms = spark.createDataFrame([("d_1", "d", [2, 1, 0, 3, 5, 4]), ("e_1", "e", [1, 0])], "pair_id string, doc_id string, perm array<int>")
    return grid, widths, perms


def test_a_pairs_grid_in_its_row(spark):
    """equal cells, and only the documents' cells are shuffled (no shuffle by pair)."""
    grid, _, perms = _grid(spark)
    row = perms.join(GR.column_cells(grid), "doc_id").select("pair_id", "doc_id", F.inline(GR.permuted_cells("columns", "perm")))
    long = GR.apply_permutation_grid(grid, perms)
    assert sorted(row.select(long.columns).collect()) == sorted(long.collect()) and long.count() == 5


def test_a_pairs_permutation_in_its_row(spark):
    """Empty columns collapse by ``first`` and are matched in turn by ``bijective``."""
    grid, widths, perms = _grid(spark)
    sig = GR.column_signatures(grid, widths, ["doc_id"])
    p = perms.join(GR.signature_arrays(grid, widths), "doc_id")
    p = p.select("pair_id", "sigs", PM.gather(F.col("sigs"), F.col("perm")).alias("neg"))
    for mode in ("first", "bijective"):
        long = GR.recover_permutation(sig, GR.permute_signatures(sig, perms), mode=mode)
        assert sorted(GR.recover_permutation_arrays(p, "sigs", "neg", mode=mode).collect()) == sorted(long.collect())


def test_a_pairs_features_in_its_row(spark):
    """a sentence without a feature has no row; a null feature keeps its row."""
    feats = spark.createDataFrame([("d", 0, 5), ("d", 2, None), ("e", 0, 1), ("e", 1, 2)], "doc_id string, sent_idx int, n int")
    perms = spark.createDataFrame([("d_1", "d", [2, 1, 0]), ("e_1", "e", [1, 0])], "pair_id string, doc_id string, perm array<int>")
    row = SC.reorder_feature_rows(perms.join(SC.feature_arrays(feats, "n"), "doc_id"), "n")
    long = SC.reorder_features(feats, perms.select("pair_id", "doc_id", F.posexplode("perm").alias("dst", "src"))).select(row.columns)
    assert sorted(map(str, row.collect())) == sorted(map(str, long.collect())) and row.count() == 4


def test_long_alignment_by_numbers_equals_alignment_by_text(spark):
    """numbers of a document's sentences stand for their texts, repeated ones and nulls too."""
    rows = [("a", ["x", "y", "x", "z", "y"], [3, 2, 0, 4, 1]), ("b", ["q", "q", "q"], [2, 0, 1]), ("c", ["m", None, "n"], [1, 0, 2])]
    d = spark.createDataFrame(rows, "pair_id string, pos array<string>, perm array<int>").withColumn("place", F.transform("pos", PM.first_place))
    side = lambda c: d.select("pair_id", F.slice(c, 1, F.size(c) - 1).alias("p"), PM.gather(F.col(c), F.col("perm")).alias("n"))
    got, want = (sorted(map(str, PM.align_order_long(side(c), "p", "n", mode=PM.MODES).collect())) for c in ("place", "pos"))
    assert got == want and len(got) == 33


def test_the_long_alignment_writes_no_text(spark, monkeypatch, tmp_path):
    """the query wrote both sides' texts of every pair to the disk."""
    import cohera.plans.queries as Q

    docs = spark.createDataFrame([(i, "\n".join(f"line {j % 7} of {i}" for j in range(11 + i))) for i in (1, 2, 2)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    written, plain = [], Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, tag: written.append(df) or plain(df, tag))
    got = {(r.pair_id, r.mode, r.dst, r.src) for r in Q.q_j5_align_order_long(spark, str(tmp_path)).collect()}
    pairs = Q.build_negative_dataset(Q.C.corpus(spark, str(tmp_path))).select("pair_id", F.expr("slice(pos, 1, size(pos) - 1)").alias("pos"), "neg")
    assert got == {(r.pair_id, r.mode, r.dst, r.src) for r in PM.align_order_long(pairs, mode=PM.MODES).collect()}
    texts = [df for df in written if "array<string>" in [t for _, t in df.dtypes]]
    assert all(r.pair_id.startswith("2_") for df in texts for r in df.collect())  # those that share their name
