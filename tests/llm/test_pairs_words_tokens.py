"""Hard negatives, spelling variants and byte-level BPE against brute force and
the exact tokenizer, with nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import base64
import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohera.llm.queries import PATTERN, TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
VECTORS = "vec_id long, embedding array<float>, label int, score long, row long, part long, anchor boolean, wins long"
DOCS = "doc_id long, text string, word string, n long, form string, root string, ids string, decoded string, key string"


# ------------------------------------------------------------------ op11

def negatives_by_force(rows, is_anchor, k_pos=5, k_neg=3, low=50, high=95):
    clean = {(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y, *_ in rows
             if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    clean = sorted(clean)
    out = []
    for a in clean:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in clean if b is not a)
        for p in [s for s in scored if s[2] == a[1]][:k_pos]:
            found = [s for s in scored if s[2] != a[1] and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:k_neg]
            out += [(a[0], p[1], r + 1, s[1], -p[0], -s[0]) for r, s in enumerate(found)]
    return sorted(out)


def vector_rows(n=240, dim=6, seed=2):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, 1), 2) for _ in range(dim)], r.randrange(3)) for i in range(n)]
    rows += [(i, [0.0] * dim, 1) for i in (300, 310, 320)]  # scores of 0
    rows += [(400 + i, rows[5][1], i % 3) for i in range(30)]  # ties
    rows += [rows[10], rows[10], (10, rows[11][1], 2), (10, rows[11][1], 0)]  # repeated rows, one id twice
    rows += [(500, None, 1), (510, [1.0, None], 1), (520, [float("nan")] * dim, 1), (530, [float("inf")] * dim, 0), (None, rows[0][1], 1),
             (540, rows[0][1], None), (550, [1.0, 2.0], 1), (560, [], 0)]
    return [(*row, 1, 2, 3, True, 4) for row in rows]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    from cohera.llm import hard_negatives

    if small:  # many blocks
        for name, value in (("PART_BYTES", 2000), ("CHUNK_BYTES", 500), ("STEP_ANCHORS", 3), ("STEP_ROWS", 7)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect())
    want = negatives_by_force(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100
    assert any(r[4] == 0 for r in want)  # a window of score 0, with negatives before and behind its positive


def test_hard_negatives_edges(spark):
    from cohera.llm import hard_negatives

    def run(rows, **k):
        df = spark.createDataFrame([(*r, 1, 2, 3, None, 4) for r in rows], VECTORS)
        return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0, **k).collect())

    assert run([]) == []
    assert run([(0, [1.0], 1)]) == [] and run([(0, [1.0], 1), (1, [1.0], 2)]) == []  # no positive
    huge = [(0, [1e16], 1), (1, [1e16], 1), (2, [6e15], 0), (3, [1e30], 1), (4, [-1e30], 0)]
    assert all(-(1 << 63) <= r[4] < 1 << 63 for r in run(huge))  # beyond 64 bits: the greatest long
    wide = [(0, [10.0], 1), (1, [10.0], 1), (2, [9.0], 0), (3, [1.0], 0)]
    assert run(wide, low=0, high=90) == [(0, 1, 1, 2, 2560 * 2560, 2560 * 2304), (0, 1, 2, 3, 2560 * 2560, 2560 * 256)]
    with pytest.raises(ValueError):
        run(wide, high=100)


def test_emit_holds_windows_only():
    """The stream is read once, and what is held does not grow with it."""
    from cohera.llm import hard_negatives as H

    def keys():
        yield H._key(7, 1, 1000, 5, 1, 9), None
        for i in range(10_000):
            yield H._key(7, 1, 900 - i // 20, i, 0, i), None

    assert list(H.emit(keys(), 3, 50, 95)) == [(7, 5, 1, 0, 1000, 900), (7, 5, 2, 1, 1000, 900), (7, 5, 3, 2, 1000, 900)]


# ------------------------------------------------------------------ op12

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def variants_by_force(counts, ratio=2):
    best = {}
    for w, n in counts.items():
        some = sorted((-m, x) for x, m in counts.items() if near(w, x))
        best[w] = (len(some), *((some[0][1], -some[0][0]) if some and -some[0][0] >= ratio * n else (None, None)))
    out = []
    for w, n in counts.items():
        root = w
        while best[root][1] is not None:
            root = best[root][1]
        out.append((w, best[w][1], root, n, best[w][0], best[w][2]))
    return sorted(out)


def words_by_force(rows):
    counts = collections.Counter()
    for doc, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def spelling_rows():
    r = random.Random(4)
    base = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(5, 8))) for _ in range(120)]
    base += [w[:2] + w[3:] for w in base] + [w[:-1] + "z" for w in base] + ["q" + w for w in base]
    base += ["abcdef" + c for c in "ghijklmnop"] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "x" * 4000, "x" * 3999 + "y", "x" * 4001]
    weights = [r.choice((1, 1, 3, 9, 40)) for _ in base]
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(base, weights, k=120)) + "×÷,÷1") for i in range(200)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (900, None), (901, ""), (902, " \n"), (903, "éÉéÉé " * 40), (904, "one-two_three4five" * 9)]
    rows += [(905 + i, " ".join(base[-3:])) for i in range(4)]
    return [(*row, "w", 1, "f", "r", "i", "d", "k") for row in rows]


@pytest.mark.parametrize("block", [1 << 14, 40])
def test_spelling(spark, monkeypatch, block):
    from cohera.llm import spelling

    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "STEP_WORDS", 64 if block == 40 else 2048)
    rows = spelling_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    words = spelling.vocabulary(spelling.noisy_words(docs))
    want = words_by_force(rows)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    got = sorted(tuple(r) for r in spelling.variants(words).collect())
    assert got == variants_by_force(want)
    assert any(r[1] is not None and r[2] != r[1] for r in got)  # a chain
    assert any(len(r[0]) > 3000 and r[4] for r in got)


def test_spelling_edges(spark):
    from cohera.llm import spelling

    assert spelling.variants(spelling.vocabulary(spelling.noisy_words(spark.createDataFrame([], DOCS)))).collect() == []
    r = random.Random(7)
    for size in (1, 2, 3):  # short words too
        counts = {w: r.randint(1, 30) for w in {"".join(r.choice("abc") for _ in range(r.randint(1, size + 2))) for _ in range(60)}}
        vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
        assert sorted(tuple(x) for x in spelling.variants(vocab).collect()) == variants_by_force(counts)
    chain = {"a" * i: 2 ** i for i in range(1, 40)}  # the longest chain of forms
    got = spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {x["root"] for x in got} == {"a" * 39}
    with pytest.raises(ValueError):
        spelling.variants(vocab, ratio=1)


# ------------------------------------------------------------------ op13

def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_texts():
    r = random.Random(6)
    out = [None, "", " ", "\n\n \t x", "it's 1234 wörds<|endoftext|>", "a" * 5000, " " * 700 + "x", "=" * 900, "\U0001F600" * 200, "\x00\x1c\x85​﻿ a"]
    out += ["".join(r.choice("abcdefgh") for _ in range(1500)), "".join(r.choice("the ") for _ in range(3000)), "ab" * 1000]
    out += ["".join(chr(r.choice((r.randrange(1, 0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x20000)))) for _ in range(300)) for _ in range(20)]
    return out + out[4:6]


def test_pattern_is_the_published_one():
    import sys

    sys.path.insert(0, TOKENIZERS)
    import public_tokenizers

    assert PATTERN == public_tokenizers.PATTERN


def test_byte_bpe_equals_tiktoken(spark):
    from cohera.llm import byte_bpe

    enc, texts = tiktoken_encoding(), token_texts()
    docs = spark.createDataFrame([(i, t, "w", None, "f", "r", "i", "d", "k") for i, t in enumerate(texts)], DOCS).repartition(3)
    tokens = byte_bpe.encode(docs, RANKS, PATTERN)
    assert tokens.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    out = byte_bpe.decode(tokens, RANKS, PATTERN)
    assert out.columns == [c for c in tokens.columns if c != "decoded"] + ["decoded"]
    for row in out.collect():
        assert row["ids"] == enc.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert row["n"] is None and row["word"] == "w"
    assert byte_bpe.digests(spark.createDataFrame([], DOCS), RANKS, PATTERN).collect() == []
    ids = spark.createDataFrame([([464, None, 3290],), (None,), ([],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(ids.coalesce(1), RANKS, PATTERN).collect()] == [b"The dog", b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), RANKS, PATTERN).collect()


def test_byte_bpe_small_cache_and_one_at_a_time(monkeypatch):
    """Forgetting words changes nothing; nor does the keyed recursion."""
    from cohera.llm import byte_bpe

    enc, texts = tiktoken_encoding(), token_texts()
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(byte_bpe, "CACHE_CHARS", 4)
    monkeypatch.setattr(byte_bpe, "DECODE_TOKENS", 5)
    codec = byte_bpe.Codec(RANKS, PATTERN)
    for t in texts + texts:
        lists = codec.encode([t, "again", None])
        assert lists.to_pylist() == [enc.encode_ordinary(t or ""), enc.encode_ordinary("again"), []]
        assert codec.decode(lists) == [(t or "").encode(), b"again", b""]
    monkeypatch.setattr(byte_bpe, "LONG", 3)
    codec = byte_bpe.Codec(RANKS, PATTERN)
    r = random.Random(1)
    for _ in range(60):
        t = "".join(r.choice("aehinorst") for _ in range(r.randint(4, 40)))
        assert codec.encode([t]).to_pylist() == [enc.encode_ordinary(t)], t


def test_op13_digests(spark, tmp_path):
    import hashlib

    import __spark_entry__ as E

    enc, texts = tiktoken_encoding(), token_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = E.queries()["op13_byte_bpe"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        t = texts[row["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
