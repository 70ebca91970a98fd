"""Column signatures (J4): equal for equal multisets of cells only, and they
commute with the permutation of columns (P6)."""
import random

from cohera.operators import grid as GR


def test_signatures_tell_columns_apart_and_commute_with_permutation(spark):
    r = random.Random(3)
    cells, widths, perms = [], [], []
    for d in range(40):
        n = r.randint(1, 7)
        widths.append((f"d{d}", n))
        cells += [(f"d{d}", e, i, r.choice("SOX")) for i in range(n) for e in "abc" if r.random() < 0.4]
        cells += [(f"d{d}", "a", 0, "S")] * (d % 3)  # repeated lines of one entity
        perms += [(f"d{d}_{k}", f"d{d}", r.sample(range(n), n)) for k in range(3)]
    grid = spark.createDataFrame(cells, "doc_id string, entity string, sent_idx int, role string")
    w = spark.createDataFrame(widths, "doc_id string, n_cols int")
    p = spark.createDataFrame(perms, "pair_id string, doc_id string, perm array<int>")
    sig = GR.column_signatures(grid, w, ["doc_id"])
    got = {(x["doc_id"], x["sent_idx"]): tuple(x["sig"]) for x in sig.collect()}
    want = {}
    for d, e, i, role in cells:
        want.setdefault((d, i), []).append((e, role))
    keys = [(d, i) for d, n in widths for i in range(n)]
    assert set(got) == set(keys)
    by_cells, by_sig = ({k: f(k) for k in keys} for f in (lambda k: tuple(sorted(want.get(k, []))), got.get))
    assert len(set(by_cells.values())) == len(set(by_sig.values())) == len({(by_cells[k], by_sig[k]) for k in keys})
    long = GR.column_signatures(GR.apply_permutation_grid(grid, p), p.join(w, "doc_id").select("pair_id", "doc_id", "n_cols"), ["pair_id", "doc_id"])
    short = GR.permute_signatures(sig, p)
    rows = lambda df: sorted((x["pair_id"], x["sent_idx"], tuple(x["sig"])) for x in df.collect())
    assert rows(long) == rows(short)
    back = {x["pair_id"]: x["perm_idx"] for x in GR.recover_permutation(sig, short, mode="bijective").collect()}
    for pair, d, perm in perms:
        assert [got[d, perm[j]] for j in back[pair]] == [got[d, i] for i in range(len(perm))]
