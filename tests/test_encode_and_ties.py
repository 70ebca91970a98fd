"""J3 by document dictionaries and A11 on arrays against plain counting; exact
samples and first-n splits where keys repeat."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from cohera.operators import sampling as SM
from cohera.operators import vectors as VE
from cohera.operators import vocab as VO

DOCS = [("a", [["x", "y", "x"], ["z"], []], 1), ("b", [["y", "new"], ["x", None]], 2), ("c", None, 3), ("d", [], None), ("a", [["z", "z"]], 4),
        ("b", [["y", "new"], ["x", None]], 5)]


def test_encode_docs(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, tokens array<array<string>>, extra long").repartition(3)
    vocab = spark.createDataFrame([(0, "x", 9), (1, "y", 5), (2, "z", 4), (3, "<unk>", 0), (4, "<pad>", 0)], "idx long, word string, cnt long")
    ids = {"x": 0, "y": 1, "z": 2}
    for commonest in (0, 2, 4096):
        got = VO.encode_docs(docs, vocab, commonest=commonest)
        assert got.columns == ["doc_id", "tokens", "extra", "ids"]
        rows = got.collect()
        assert len(rows) == len(DOCS)
        for r in rows:
            assert r["ids"] == (None if r["tokens"] is None else [[ids.get(w, 3) for w in s] for s in r["tokens"]])
    known = docs.where("doc_id = 'a'")
    assert sorted(map(str, (r["ids"] for r in VO.encode_docs(known, vocab, oov="error").collect()))) == ["[[0, 1, 0], [2], []]", "[[2, 2]]"]
    with pytest.raises(Exception, match="not in vocabulary"):
        VO.encode_docs(docs, vocab, oov="error").collect()
    assert VO.encode_docs(docs.limit(0), vocab).collect() == []


@pytest.mark.parametrize("commonest", [1, 1 << 15])
def test_bidirectional_nll(spark, commonest):
    docs = {"a": [[0, 1, 0, 2], [1]], "b": [[2, 2, 2], [], [0]], "c": [[]]}
    V, bos, eos = 6, 4, 5
    c, ctx = collections.Counter(), collections.Counter()
    pairs = {d: [] for d in docs}
    for d, ss in docs.items():
        for s in ss:
            for t, w in enumerate(s):
                ctx[w] += 1
                for key in (("f", w, s[t + 1] if t + 1 < len(s) else eos), ("b", w, s[t - 1] if t else bos)):
                    c[key] += 1
                    pairs[d].append(key)
    df = spark.createDataFrame(list(docs.items()), "doc_id string, ids array<array<long>>")
    got = {r["doc_id"]: r for r in VE.bidirectional_nll(df, V, bos, eos, commonest=commonest).collect()}
    assert set(got) == {"a", "b"}
    for d in got:
        for dir, name in (("f", "nll_forward"), ("b", "nll_backward")):
            own = [-math.log((c[k] + 1) / (ctx[k[1]] + V)) for k in pairs[d] if k[0] == dir]
            assert abs(got[d][name] - sum(own) / len(own)) < 1e-12


def test_exact_sample_of_repeated_keys(spark):
    df = spark.createDataFrame([(i // 10, i) for i in range(100)], "k long, v long").repartition(4)
    picked = SM.sample_fraction(df, 0.25, 1, "k", exact=True)
    assert picked.count() == 25 and picked.distinct().count() == 25
    same = spark.createDataFrame([(1, 1)] * 40, "k long, v long")
    assert SM.sample_fraction(same, 0.25, 1, "k", exact=True).count() == 10


def test_first_n_of_repeated_names(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 5), (None, 6)], "doc_id string, v long")
    for n in range(1, 7):
        split = collections.Counter(r["split"] for r in SM.first_n_split(df, "doc_id", n).collect())
        assert split["train"] == min(n, 5) and sum(split.values()) == 6
    assert SM.first_n_split(df.limit(0), "doc_id", 3).collect() == []


def test_ids_are_decoded_in_the_documents_row(spark):
    """Common and rare words, an unknown id, nulls and empty sentences."""
    vocab = spark.createDataFrame([(0, "a", 9), (1, "b", 5), (2, "c", 1), (3, "<unk>", 0)], "idx long, word string, cnt long")
    docs = spark.createDataFrame([("d", [["a", "c"], [], ["zz", None]]), ("e", []), ("f", None)], "doc_id string, tokens array<array<string>>")
    for commonest in (0, 1, 9):
        enc = VO.encode_docs(docs, vocab, commonest=commonest)
        assert {r.doc_id: r.ids for r in enc.collect()} == {"d": [[0, 2], [], [3, 3]], "e": [], "f": None}
        dec = VO.decode_docs(enc.select("doc_id", "ids"), vocab, commonest=commonest)
        assert {r.doc_id: r.words for r in dec.collect()} == {"d": [["a", "c"], [], ["<unk>", "<unk>"]], "e": [], "f": None}
    odd = spark.createDataFrame([("g", [[7, 1, None]])], "doc_id string, ids array<array<long>>")
    assert VO.decode_docs(odd, vocab).first().words == [[None, "b", None]]


def test_encoding_by_row_equals_the_long_form(spark, tmp_path):
    """Documents that share their name are still encoded as one, as the token table is."""
    import cohera.plans.queries as Q

    rows = [(1, "A cat. Runs!\n\nA dog"), (2, "B b b"), (2, "c B\nzz"), (3, ""), (4, None), (None, "A b")]
    docs = spark.createDataFrame([(i, t, "en" if i != 3 else "de") for i, t in rows], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = str(tmp_path)
    v = Q._en_vocab(spark, at)
    enc = VO.encode(Q._tagged_tokens(spark, at), v, oov="unk")
    want = VO.decode_ids(enc.select("doc_id", "sent_idx", "tok_idx", "idx"), v, ["doc_id", "sent_idx"])
    assert sorted(map(str, Q.q_t11_decode_ids(spark, at).collect())) == sorted(map(str, want.collect()))
    ids = VO.regroup(enc, ["doc_id", "sent_idx"], "tok_idx", "idx", "ids")
    assert sorted(map(str, Q._vocab_ids(spark, at, v).collect())) == sorted(map(str, ids.collect()))
    whole = VO.regroup(ids, ["doc_id"], "sent_idx", "ids", "_s").select("doc_id", F.flatten("_s").alias("ids"))
    assert sorted(map(str, Q._doc_ids(spark, at, v).collect())) == sorted(map(str, whole.collect()))
