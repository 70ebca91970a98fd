"""Permutation-dataset properties and fixtures."""

from math import comb

from pyspark.sql import functions as F

from cohera.operators import permute as PM
from cohera.operators.score import score_windows_mask


def _docs(spark, lengths):
    rows = [(f"d{L}", [f"s{L}_{i}" for i in range(L)]) for L in lengths]
    return spark.createDataFrame(rows, "doc_id string, sents array<string>")


def test_y5_y6_negative_counts(spark):
    lengths = [10, 12, 21, 36, 101]
    negs = PM.build_negatives(_docs(spark, lengths))
    got = {(r.doc_id, r.n_windows): r.c for r in negs.groupBy("doc_id", "n_windows").agg(F.count("*").alias("c")).collect()}
    for L in lengths:
        for n in (1, 2, 3):
            want = min(20, comb(L // 3, n))
            assert got.get((f"d{L}", n), 0) == want, (L, n)
    assert got[("d10", 1)] == 3 and got[("d10", 2)] == 3 and got[("d10", 3)] == 1


def test_y5_window_starts(spark):
    r = spark.range(1).select(PM.window_starts(F.lit(10), 3).alias("s")).first()["s"]
    assert r == [0, 3, 6]


def test_y7_every_chosen_window_changes(spark):
    negs = PM.build_negatives(_docs(spark, [10, 21, 101]), neg_text=PM.apply_permutation)
    for r in negs.collect():
        assert sorted(r.neg) == sorted(r.sents)
        assert sorted(r.perm) == list(range(len(r.sents)))
        chosen = set(r.combo)
        for q in range(len(r.sents) // 3):
            window = r.perm[3 * q: 3 * q + 3]
            if q in chosen:
                assert window != [3 * q, 3 * q + 1, 3 * q + 2] and sorted(window) == [3 * q, 3 * q + 1, 3 * q + 2]
            else:
                assert window == [3 * q, 3 * q + 1, 3 * q + 2]
        assert r.perm[3 * (len(r.sents) // 3):] == list(range(3 * (len(r.sents) // 3), len(r.sents)))


def test_combinations_distinct_and_partition_independent(spark):
    d = _docs(spark, [36, 101, 406])
    a = sorted((r.pair_id, tuple(r.perm)) for r in PM.build_negatives(d.repartition(1)).collect())
    b = sorted((r.pair_id, tuple(r.perm)) for r in PM.build_negatives(d.repartition(7)).collect())
    assert a == b
    combos = {}
    for r in PM.build_negatives(d).collect():
        combos.setdefault((r.doc_id, r.n_windows), []).append(tuple(r.combo))
    for v in combos.values():
        assert len(v) == len(set(v))


def test_y8_alignment(spark):
    df = spark.createDataFrame([("p", ["A", "B", "A"], ["A", "A", "B"])], "pair_id string, pos array<string>, neg array<string>")
    assert PM.align_order(df, mode="bijective").first()["order"] == [0, 2, 1]
    assert PM.align_order(df, mode="first").first()["order"] == [0, 0, 1]


def test_y9_inverse_padded(spark):
    r = spark.range(1).select(PM.inverse_padded_order(F.lit(4), F.lit(10)).alias("p")).first()["p"]
    assert r == [3, 2, 1, 0, 4, 5, 6, 7, 8, 9]


def test_y10_valid_windows(spark):
    for L, want in [(5, 3), (3, 1), (2, 0), (1, 0)]:
        n = spark.range(L).filter(score_windows_mask(F.lit(L), F.col("id"))).count()
        assert n == want


def test_flagship_plan_has_no_shuffle(spark):
    from cohera.plans.negative_dataset import build_negative_dataset
    d = _docs(spark, [12, 30]).repartition(16)
    plan = build_negative_dataset(d, split=None)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.split("+- ", 1)[1].count("Exchange") <= 1  # the input of this test itself


def test_combinations_are_exact_for_every_size(spark):
    """One rule from 3 windows to 6 666: min(N, C) distinct increasing tuples."""
    d = spark.createDataFrame([(f"d{L}", L) for L in (10, 72, 406, 20_000)], "doc_id string, L int")
    for n in (1, 2, 3, 4):
        m = PM.n_windows_col(F.col("L"), 3)
        rows = d.select("L", PM.select_combinations(42, F.col("doc_id"), n, m, 20).alias("c")).collect()
        for r in rows:
            got = {tuple(c) for c in r.c}
            assert len(r.c) == len(got) == min(20, comb(r.L // 3, n)), (r.L, n)
            assert all(len(c) == n and list(c) == sorted(set(c)) and 0 <= c[0] and c[-1] < r.L // 3 for c in got)


def test_unranking_is_a_bijection(spark):
    from itertools import combinations
    for m, n in ((9, 1), (9, 2), (9, 3), (8, 4)):
        got = spark.range(comb(m, n)).select(PM.unrank_combination(F.col("id"), F.lit(m), n).alias("c")).collect()
        assert {tuple(r.c) for r in got} == set(combinations(range(m), n))
    big = comb(2_000_000, 3) - 1  # the last rank of two million windows
    r = spark.range(1).select(PM.unrank_combination(F.lit(big), F.lit(2_000_000), 3).alias("c")).first()["c"]
    assert r == [1_999_997, 1_999_998, 1_999_999]


def test_all_combinations(spark):
    from itertools import combinations
    d = spark.createDataFrame([("a", 5), ("b", 2), ("c", 1)], "doc_id string, m int")
    got = [(r.doc_id, tuple(r.combo)) for r in PM.all_combinations(d, F.col("m"), 2).collect()]
    assert sorted(got) == sorted([("a", c) for c in combinations(range(5), 2)] + [("b", (0, 1))])


def test_window_orders_wider_than_three(spark):
    d = _docs(spark, [12])
    for r in PM.build_negatives(d, n_windows=(1, 2), perms=(20, 20), w=4, neg_text=PM.apply_permutation).collect():
        for q in r.combo:
            window = r.perm[4 * q: 4 * q + 4]
            assert sorted(window) == list(range(4 * q, 4 * q + 4)) and window != sorted(window)


def test_reference_alignment(spark):
    df = spark.createDataFrame([("p", ["B", "A", "A"], ["A", "B", "A"])], "pair_id string, pos array<string>, neg array<string>")
    assert PM.align_order(df, mode="reference").first()["order"] == [1, 0, 2]
    assert PM.align_order(df, mode="reference", pad_to=F.lit(6)).first()["order"] == [1, 0, 2, 3, 4, 5]


def test_names_of_long_ids_stay_whole(spark):
    from cohera.operators.datasets import pos_text_name
    d = spark.createDataFrame([(7,), (1234,), (12345,), (12349,), (100007,)], "id long")
    assert [r[0] for r in d.select(pos_text_name(F.col("id"))).collect()] == [
        f"wsj_{x}.pos.text" for x in ("0007", "1234", "12345", "12349", "100007")]


def test_long_alignment_equals_array_form(spark):
    """Repeats, nulls, unequal and empty sides; then a document of 20 000 sentences."""
    import random
    import time

    r = random.Random(4)
    some = ["a", "b", "c", "dd", None]
    rows = [(f"p{i}", [r.choice(some) for _ in range(r.randint(0, 9))], [r.choice(some) for _ in range(r.randint(0, 9))]) for i in range(150)]
    rows += [("same", ["x", "y", "x"], ["x", "x", "y"]), ("none", None, ["x"]), ("empty", ["x"], [])]
    df = spark.createDataFrame(rows, "pair_id string, pos array<string>, neg array<string>")
    for mode in ("bijective", "first", "reference"):
        want = {(x["pair_id"], j): o for x in PM.align_order(df.where("pos IS NOT NULL"), mode=mode).collect() for j, o in enumerate(x["order"])}
        if mode == "first":  # the array form's lookup finds no null
            pos = {k: p for k, p, _ in rows}
            neg = {k: n for k, _, n in rows}
            want |= {(k, j): pos[k].index(None) if None in pos[k] else None for k, j in want if neg[k][j] is None}
        want["none", 0] = None
        got = {(x["pair_id"], x["dst"]): x["src"] for x in PM.align_order_long(df, mode=mode).collect()}
        assert got == want, mode
    n = 20_000
    long = [f"s{i % 15_000}" for i in range(n)]
    order = r.sample(range(n), n)
    big = spark.createDataFrame([("big", long, [long[i] for i in order] + ["other"])], df.schema)
    at = time.time()
    got = {x["dst"]: x["src"] for x in PM.align_order_long(big, mode="bijective").collect()}
    assert time.time() - at < 30 and len(got) == n + 1 and got[n] is None
    assert sorted(v for v in got.values() if v is not None) == list(range(n)) and all(long[got[j]] == long[i] for j, i in enumerate(order))
    assert {x["dst"] for x in PM.align_order_long(big, mode="reference").collect()} == set(range(n + 1))
    assert PM.align_order_long(df.limit(0)).count() == 0


def test_long_alignment_moves_no_sentence(spark):
    """several modes in one pass, no text in a shuffle; rows that share a key
    are aligned as one pair."""
    df = spark.createDataFrame([("p", ["a", "b", "a"], ["a", "a", "b"]), ("q", ["a"], ["b"]), ("q", ["b"], ["a", "b"]), (None, ["z"], ["z"])],
                               "pair_id string, pos array<string>, neg array<string>")
    got = {(r["pair_id"], r["mode"], r["dst"], r["src"]) for r in PM.align_order_long(df, mode=PM.MODES).collect()}
    one = {(r["pair_id"], m, r["dst"], r["src"]) for m in PM.MODES for r in PM.align_order_long(df, mode=m).collect()}
    assert got == one
    assert {x for x in got if x[0] == "p"} == {("p", m, j, s) for m, o in (("bijective", (0, 2, 1)), ("first", (0, 0, 1)), ("reference", (0, 0, 1)))
                                               for j, s in enumerate(o)}
    assert (None, "first", 0, 0) in got and ("q", "first", 0, 0) in got
    alone = PM._aligner("pair_id", ("first",), slice_bytes=1)
    rows = df.where("pair_id = 'p' OR pair_id IS NULL").select("pair_id", F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
    assert rows.mapInArrow(alone, "mode string, pair_id string, dst int, src int").count() == 4
