"""Sentence-permutation negatives (P1-P9), pairing (J1), alignment (J5), F4.

All random choices are md5 ranks of ``seed|doc_id|...`` so every row is
computed from its own document only: the whole generation is row-local array
work (no shuffle), and the result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from cohera.functions.hashing import hex_to_int, md5_int, md5_key
from cohera.functions.text import let
from cohera.session import materialise

# Non-identity orders of a 3-sentence window, lexicographic (fixed values).
ORDERS_W3 = [[0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]
# Non-identity order of a 2-sentence window (fixed value).
ORDERS_W2 = [[1, 0]]


def n_windows_col(n_sents: Column, w: int) -> Column:
    """Number of complete windows ``floor(L / w)`` (final partial dropped)."""
    return F.floor(n_sents / F.lit(w)).cast("int")


def window_starts(n_sents: Column, w: int = 3) -> Column:
    """Window start positions ``0, w, 2w, ...`` of complete windows."""
    m = n_windows_col(n_sents, w)
    return F.when(m > 0, F.sequence(F.lit(0), (m - 1) * w, F.lit(w))).otherwise(
        F.array().cast("array<int>"))


def binomial(m: Column, n: int) -> Column:
    """C(m, n) as an exact long (0 where m < n)."""
    acc = F.lit(1).cast("bigint")
    for j in range(1, n + 1):  # exact at every step: C(m - n + j, j)
        acc = F.call_function("div", acc * (m.cast("bigint") - n + j), F.lit(j).cast("bigint"))
    return F.when(m >= n, acc).otherwise(F.lit(0).cast("bigint"))


def unrank_combination(rank: Column, m: Column, n: int) -> Column:
    """The ``rank``-th increasing ``n``-tuple of ``0..m-1`` in colexicographic
    order: from the top place down, the largest c with C(c, k) <= rank."""
    def place(r, k, below):
        if k == 1:
            c = r.cast("int")
        elif k <= 3:  # a root is right up to one; the binomials decide exactly
            x = r.cast("double")
            guess = F.floor((F.sqrt(8 * x + 1) + 1) / 2) if k == 2 else F.floor(F.cbrt(6 * x)) + 1
            guess = F.greatest(guess.cast("int"), F.lit(k - 1))
            c = let(guess, lambda g: g - 1 + F.when(binomial(g, k) <= r, 1).otherwise(0)
                    + F.when((binomial(g, k) <= r) & (binomial(g + 1, k) <= r), 1).otherwise(0))
            c = F.greatest(c, F.lit(k - 1)).cast("int")
        else:
            c = F.array_max(F.filter(F.sequence(F.lit(k - 1), m - 1), lambda x: binomial(x, k) <= r)).cast("int")

        def rest(v):
            tail = F.concat(F.array(v), below)
            return tail if k == 1 else place(r - binomial(v, k), k - 1, tail)
        return let(c, rest)
    return place(rank.cast("bigint"), n, F.array().cast("array<int>"))


def all_combinations(docs: DataFrame, m: Column, n: int, name: str = "combo") -> DataFrame:
    """P2 ``all`` mode: a row for every increasing ``n``-tuple of window numbers
    ``0..m-1``. One explode a place: no row ever holds more than ``m`` numbers."""
    out = docs.withColumn("_m", m).withColumn(name, F.array().cast("array<int>"))
    for k in range(n):
        low = F.lit(0) if k == 0 else F.element_at(name, -1) + 1
        high = F.col("_m") - (n - k)
        out = out.withColumn("_lo", low).where(F.col("_lo") <= high)
        out = out.withColumn("_x", F.explode(F.sequence(F.col("_lo"), high)))
        out = out.withColumn(name, F.concat(F.col(name), F.array("_x"))).drop("_x", "_lo")
    return out.drop("_m")


def window_sentences(combo: Column, w: int = 3) -> Column:
    """Expand window numbers to their sentence indices."""
    return F.flatten(F.transform(combo, lambda q: F.sequence(q * w, q * w + (w - 1))))


def select_ranks(seed, doc: Column, n: int, total: Column, n_perm: int) -> Column:
    """``min(n_perm, total)`` distinct ranks of ``0..total-1``: Floyd's method,
    step i draws ``md5(seed|doc|n|i)`` (60 bits) modulo ``j + 1``, j = total - N +
    i, and takes j itself where the draw was taken before."""
    N = F.least(F.lit(n_perm).cast("bigint"), total)

    def step(acc, i):
        j = total - N + i
        draw = F.pmod(hex_to_int(md5_key(seed, doc, F.lit(n), i), 15), j + 1)
        return let(draw, lambda t: F.concat(acc, F.array(F.when(F.array_contains(acc, t), j).otherwise(t))))
    some = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(N - 1, F.lit(0))), F.array().cast("array<bigint>"), step)
    return F.when(total > 0, some).otherwise(F.array().cast("array<bigint>"))


def select_combinations(seed, doc: Column, n: int, m: Column, n_perm: int) -> Column:
    """Exactly ``min(n_perm, C(m, n))`` window combinations without
    replacement, by one rule for every size: distinct ranks, each unranked."""
    ranks = let(binomial(m, n), lambda c: select_ranks(seed, doc, n, c, n_perm))
    return F.transform(ranks, lambda r: unrank_combination(r, m, n))


def window_order(seed, doc: Column, n: int, perm_no: Column, q: Column, w: int) -> Column:
    """A non-identity order of the ``w`` sentences of window ``q``.

    w = 2, 3: uniform over the literal list of non-identity orders.
    w > 3: sort positions by md5, rotate by one when that is the identity."""
    if w in (2, 3):
        orders = ORDERS_W3 if w == 3 else ORDERS_W2
        lit = F.array(*[F.array(*[F.lit(v) for v in o]) for o in orders])
        k = F.pmod(md5_int(seed, doc, F.lit(n), perm_no, q), F.lit(len(orders)))
        return F.element_at(lit, (k + 1).cast("int"))
    pos = F.sequence(F.lit(0), F.lit(w - 1))
    srt = F.transform(F.array_sort(F.transform(
        pos, lambda k: F.struct(md5_key(seed, doc, F.lit(n), perm_no, q, k).alias("r"),
                                k.alias("k")))), lambda s: s["k"])
    rot = F.concat(F.slice(srt, 2, w - 1), F.slice(srt, 1, 1))
    return F.when(srt == pos, rot).otherwise(srt)


def permutation_index(seed, doc: Column, n: int, perm_no: Column, combo: Column,
                      n_sents: Column, w: int) -> Column:
    """P4+P5 as an index array: ``neg[i] = pos[perm[i]]``; positions outside
    the chosen windows keep their own index. ``combo`` is increasing: runs of
    unchanged indexes and the orders of the chosen windows stand one after the
    other, so each order is drawn once."""
    def run(lo, hi):
        return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))

    def add(acc, q):
        start = (q * w).cast("int")
        order = F.transform(window_order(seed, doc, n, perm_no, q, w), lambda o: start + o)
        return F.concat(acc, run(F.size(acc), start), order)
    changed = F.aggregate(combo, F.array().cast("array<int>"), add)
    return let(changed, lambda a: F.concat(a, run(F.size(a), n_sents)))


def apply_permutation(sents: Column, perm: Column) -> Column:
    """P5: reorder a sentence array by an index array."""
    return F.transform(perm, lambda i: F.element_at(sents, (i + 1).cast("int")))


def build_negatives(docs: DataFrame, n_windows=(1, 2, 3), perms=(20, 20, 20), w: int = 3,
                    seed: int = 42, sents: str = "sents",
                    neg_text=None, keep=None, extra=None, sure=None, n_sents: Column | None = None, nested: bool = False) -> DataFrame:
    """For each document and window count ``n`` build
    ``min(N, C(floor(L/w), n))`` negatives ``doc_n_i``, each with every chosen
    window in a non-identity order.

    ``neg_text(sents, perm) -> Column`` (optional) computes the negative's text,
    ``keep(neg) -> Column`` (optional) filters negatives *before* they become
    rows. ``sure(perm, combo) -> Column`` (optional) is true only where ``keep``
    is sure to hold; no text is built for the test there. The kept negative's
    text is a column of its row, so a query that does not read it never builds it.
    ``extra(perm) -> Column`` (optional) is one more value of each kept
    negative, computed inside the document's row (column ``extra``).
    ``n_sents`` (optional) is the number of sentences, else the size of ``sents``.
    With ``nested`` a row is a document and ``n_windows``, and its negatives are the
    array ``negs`` of ``struct(perm_no, combo, perm)``.

    Output: every input column plus ``n_windows, perm_no, pair_id,
    combo ARRAY<INT>, perm ARRAY<INT>`` (and ``neg`` when ``neg_text``)."""
    L = F.size(sents) if n_sents is None else n_sents
    m = n_windows_col(L, w)
    doc = F.col("doc_id")
    per_n = []
    for n, N in zip(n_windows, perms):
        sel = select_combinations(seed, doc, n, m, N)

        def maker(n):
            def make(c, i):
                perm = permutation_index(seed, doc, n, i + 1, c, L, w)
                return F.struct((i + 1).alias("perm_no"), c.alias("combo"), perm.alias("perm"))
            return make

        negs = F.transform(sel, maker(n))
        if keep is not None:
            def kept(s):
                exact = keep(neg_text(F.col(sents), s["perm"]))
                return exact if sure is None else sure(s["perm"], s["combo"]) | exact
            negs = F.filter(negs, kept)
        if extra is not None:
            negs = F.transform(negs, lambda s: s.withField("extra", extra(s["perm"])))
        per_n.append(F.when(F.lit(n) <= m, F.struct(F.lit(n).alias("n"), negs.alias("negs"))))
    base = docs.withColumn("_c", F.explode(F.filter(F.array(*per_n), lambda s: s.isNotNull())))
    if nested:
        return base.select("*", F.col("_c.n").alias("n_windows"), F.col("_c.negs").alias("negs")).drop("_c")
    out = base.select("*", F.col("_c.n").alias("n_windows"), F.explode("_c.negs").alias("_g"))
    cols = [F.col("_g.perm_no").alias("perm_no"), F.col("_g.combo").alias("combo"),
            F.col("_g.perm").alias("perm")]
    if extra is not None:
        cols.append(F.col("_g.extra").alias("extra"))
    out = out.select("*", *cols).drop("_c", "_g")
    if extra is None and neg_text is not None:
        out = out.withColumn("neg", neg_text(F.col(sents), F.col("perm")))
    return out.withColumn("pair_id", pair_name(doc))


def pair_name(doc: Column) -> Column:
    return F.concat_ws("_", doc, F.col("n_windows"), F.col("perm_no"))


def with_kept(docs: DataFrame, sents: str, drop_empty: bool = True) -> DataFrame:
    """What negatives need of a document, made once: ``pos`` (the sentences that
    are not empty), ``_lines`` (all sentences' number), ``_rank`` (a sentence's
    place in ``pos``, null for an empty one; null as a whole where none is
    empty) and ``_codes`` (a hash of each sentence of ``pos``)."""
    lines = F.size(sents)
    own = F.sequence(F.lit(0), lines - 1)
    full = lambda i: F.element_at(F.col(sents), i + 1) != ""
    rank = F.lit(None).cast("array<int>")
    pos = F.col(sents)
    if drop_empty:
        pos = F.filter(sents, lambda x: x != "")
        # array_position is 0 for the empty ones
        rank = let(F.filter(own, full), lambda k: F.transform(own, lambda i: F.nullif(F.array_position(k, i), F.lit(0)).cast("int") - 1))
        rank = F.when(F.exists(sents, lambda x: F.coalesce(x, F.lit("")) == ""), rank)
    d = docs.withColumn("_lines", lines).withColumn("_rank", rank).withColumn("pos", pos)
    return d.withColumn("_codes", F.transform("pos", lambda x: F.xxhash64(x)))


def kept_order(perm: Column) -> Column:
    """``perm`` of :func:`with_kept`'s sentences as an order of ``pos``: the empty
    ones are left out, ``neg[k] = pos[order[k]]``."""
    def ranked(p):
        return F.filter(F.transform(p, lambda i: F.element_at(F.col("_rank"), i + 1)), lambda r: r.isNotNull())
    return F.when(F.col("_rank").isNull(), perm).otherwise(ranked(perm))


def surely_changed(perm: Column, combo: Column, w: int = 3) -> Column:
    """True only where the negative of ``perm`` differs from ``pos``: hashes of
    sentences differ, in a chosen window if no sentence is empty."""
    code = lambda i: F.element_at(F.col("_codes"), i + 1)
    moved = F.exists(window_sentences(combo, w), lambda p: code(F.element_at(perm, p + 1)) != code(p))
    return F.when(F.col("_rank").isNull(), moved).otherwise(gather(F.col("_codes"), kept_order(perm)) != F.col("_codes"))


def gather(values: Column, order: Column) -> Column:
    """``values`` in the order of an index array."""
    return F.transform(order, lambda i: F.element_at(values, i + 1))


def first_place(sentence: Column) -> Column:
    """The place (from 1) of the first sentence of ``pos`` equal to this one, null
    for a null: sentences of a document are equal where these numbers are."""
    return F.array_position(F.col("pos"), sentence).cast("int")


def by_index(entries: Column, index: str, value: str, none: Column) -> Column:
    """Structs with a number ``index`` as an array whose place i holds the
    ``value`` of index i, ``none`` where there is none."""
    def add(acc, s):
        return F.concat(acc, F.array_repeat(none, s[index] - F.size(acc)), F.array(s[value]))

    def placed(e):
        whole = F.element_at(e, -1)[index] + 1 == F.size(e)
        return F.when(whole, F.transform(e, lambda s: s[value])).otherwise(F.aggregate(e, F.array_repeat(none, 0), add))
    return let(F.sort_array(entries), placed)


def inverse_order(sents: Column) -> tuple[Column, Column]:
    """Reversed document and its index array."""
    n = F.size(sents)
    perm = F.when(n > 0, F.reverse(F.sequence(F.lit(0), n - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.reverse(sents), perm


def inverse_padded_order(n_sents: Column, pad_to: Column) -> Column:
    """P7 with padding: reversed real positions, the padding tail stays identity."""
    real = F.reverse(F.sequence(F.lit(0), F.greatest(n_sents - 1, F.lit(0))))
    real = F.when(n_sents > 0, real).otherwise(F.array().cast("array<int>"))
    tail = F.when(pad_to > n_sents, F.sequence(n_sents, pad_to - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.concat(real, tail)


def permutation_check(pos: Column, neg: Column, perm: Column | None = None) -> dict:
    """Per-pair checks as boolean columns."""
    checks = {
        "same_length": F.size(pos) == F.size(neg),
        "same_multiset": F.array_sort(pos) == F.array_sort(neg),
        "n_moved": F.size(F.filter(F.zip_with(pos, neg, lambda a, b: ~a.eqNullSafe(b)),
                                   lambda b: b)),
    }
    if perm is not None:
        n = F.size(perm)
        checks["is_bijection"] = (F.size(F.array_distinct(perm)) == n) & F.forall(
            perm, lambda i: (i >= 0) & (i < n))
        checks["n_perm_moved"] = F.size(F.filter(
            F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                        lambda i: F.element_at(perm, (i + 1).cast("int")) != i), lambda b: b))
    return checks


def drop_identical_pairs(pairs: DataFrame, pos: str = "pos", neg: str = "neg") -> DataFrame:
    """skip pairs whose negative text equals the positive."""
    return pairs.filter(~F.col(pos).eqNullSafe(F.col(neg)))


def pair_pos_neg(pos_files: DataFrame, neg_files: DataFrame, window: int = 0) -> DataFrame:
    """Pair each positive document with its negatives.

    Both sides carry parsed names (``doc_id``; negatives also ``n_windows``
    and ``perm_no``, see :func:`cohera.operators.datasets.classify_files`),
    so this is an equi-join on ``doc_id`` -- never a regex scan of all
    negatives. ``window=0`` keeps every window count, 1-3 restricts to it.
    Columns ``name``/``sents`` become ``pos_name``/``pos`` and
    ``neg_name``/``neg``."""
    neg = neg_files
    if window:
        neg = neg.filter(F.col("n_windows") == window)
    p, n = pos_files, neg
    for c, a, b in (("name", "pos_name", "neg_name"), ("sents", "pos", "neg")):
        if c in p.columns:
            p = p.withColumnRenamed(c, a)
        if c in n.columns:
            n = n.withColumnRenamed(c, b)
    p = p.drop("n_windows", "perm_no", "kind")
    return p.join(n.drop("kind"), "doc_id", "inner")


def align_order(pairs: DataFrame, pos: str = "pos", neg: str = "neg",
                key: str = "pair_id", mode: str = "bijective", pad_to: Column | None = None) -> DataFrame:
    """For each negative sentence, its index in the positive document.

    ``bijective`` (default): the k-th occurrence of a sentence in the
    negative maps to its k-th occurrence in the positive. Row-local: when the
    two sides hold the same multiset, sorting ``(sentence, index)`` on both
    sides lines the k-th occurrences up (O(L log L), no shuffle); otherwise
    each negative position looks up its occurrence directly (unmatched ->
    null). ``first``: every sentence maps to its first index in the positive
    (duplicates then repeat an index). Returns ``key, order ARRAY<INT>``. Null
    sentences equal one another. The sides may hold numbers that tell the
    sentences apart (:func:`first_place`) instead of texts. ``first``,
    ``reference`` and unequal sides cost the square of a document's sentences:
    see :func:`align_order_long`."""
    P, N = F.col(pos), F.col(neg)

    def idx(a):
        return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(
            F.array().cast("array<int>"))

    if mode == "first":
        order = F.transform(N, lambda s: F.when(F.array_position(P, s) > 0,
                                                (F.array_position(P, s) - 1).cast("int")))
        return pairs.select(key, order.alias("order"))
    if mode == "reference":
        moved = F.filter(idx(N), lambda j: ~F.element_at(N, j + 1).eqNullSafe(F.try_element_at(P, j + 1)) | (j >= F.size(P)))

        def place(M):
            def at(j):
                s = F.element_at(N, j + 1)
                nth = F.size(F.filter(M, lambda x: (x < j) & F.element_at(N, x + 1).eqNullSafe(s)))
                hits = F.filter(idx(P), lambda i: F.element_at(P, i + 1).eqNullSafe(s))
                return F.when(F.array_contains(M, j), F.try_element_at(hits, (nth + 1).cast("int"))).otherwise(j)
            return F.transform(idx(N), at)
        order = let(moved, place)
        if pad_to is not None:
            n = F.size(N)
            order = F.concat(order, F.when(pad_to > n, F.sequence(n, pad_to - 1)).otherwise(F.array().cast("array<int>")))
        return pairs.select(key, order.alias("order"))
    if mode != "bijective":
        raise ValueError(mode)

    def tagged(a):
        return F.sort_array(F.transform(idx(a), lambda i: F.struct(F.element_at(a, i + 1).alias("s"),
                                                                   i.alias("i"))))

    def by_sort(ps, ns):
        z = F.zip_with(ns, ps, lambda n, p: F.struct(n["i"].alias("dst"), p["i"].alias("src")))
        return F.transform(F.sort_array(z), lambda t: t["src"])

    def by_lookup():
        def at(j):
            s = F.element_at(N, j + 1)
            occ = F.size(F.filter(F.slice(N, 1, j), lambda x: x.eqNullSafe(s)))
            hits = F.filter(idx(P), lambda i: F.element_at(P, i + 1).eqNullSafe(s))
            return F.try_element_at(hits, (occ + 1).cast("int"))
        return F.transform(idx(N), at)

    same = F.sort_array(P) == F.sort_array(N)
    order = F.when(same, let(tagged(P), lambda ps: by_sort(ps, tagged(N)))).otherwise(by_lookup())
    return pairs.select(key, order.alias("order"))


MODES = ("bijective", "first", "reference")


def align_order_long(pairs: DataFrame, pos: str = "pos", neg: str = "neg", key: str = "pair_id",
                     mode: str | tuple = "bijective") -> DataFrame:
    """J5 in long form: ``key, dst, src``, a row for each negative sentence with
    its index in the positive document (null: none), by the modes of
    :func:`align_order` (``reference`` without padding). Several modes share one
    pass; their rows then have a column ``mode``, too.

    A pair is aligned in its row, by sorting codes of its sentences, so a document
    may be of any length that a row holds, and no sentence is shuffled. Rows that
    share their ``key`` are aligned as one pair (:func:`_align_shared`). ``pairs``
    is read three times. Null arrays count as empty, null sentences equal one another.
    The sides may hold numbers (:func:`first_place`) if no rows of different documents share a ``key``."""
    modes = (mode,) if isinstance(mode, str) else tuple(mode)
    if not set(modes) <= set(MODES):
        raise ValueError(mode)
    none = F.array().cast(pairs.schema[pos].dataType)
    rows = pairs.select(key, F.coalesce(pos, none).alias("_pos"), F.coalesce(neg, none).alias("_neg"))
    shared = materialise(pairs.groupBy(key).count().where("count > 1").select(F.col(key).alias("_shared")), "shared-keys")
    same = F.col(key).eqNullSafe(F.col("_shared"))
    schema = StructType([StructField("mode", StringType()), pairs.schema[key], StructField("dst", IntegerType()), StructField("src", IntegerType())])
    out = rows.join(shared, same, "left_anti").mapInArrow(_aligner(key, modes), schema)
    several = rows.join(shared, same, "left_semi")
    for m in modes:
        out = out.unionByName(_align_shared(several, key, m).withColumn("mode", F.lit(m)))
    return out if not isinstance(mode, str) else out.drop("mode")


def _aligner(key: str, modes: tuple, slice_bytes: int = 8 << 20):
    """The Arrow form of J5. A slice of at most ``slice_bytes`` of text (or one
    row) is worked on at a time."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def places(lists):
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(n) - n
            return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(start, n), n, start

        def occurrence(k):
            """How many equal keys stand before each (rows stand in order)."""
            by = np.argsort(k, kind="stable")
            s = k[by]
            nth = np.empty(len(k), np.int64)
            nth[by] = np.arange(len(k)) - np.searchsorted(s, s, "left")
            return nth

        def aligned(b):
            P, N = b.column("_pos"), b.column("_neg")
            (prow, pat, pn, pstart), (nrow, nat, _, _) = places(P), places(N)
            texts = pa.concat_arrays([P.flatten(), N.flatten()])
            code = texts.dictionary_encode(null_encoding="encode")
            width, code = len(code.dictionary) + 1, code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pcode, ncode = code[:len(prow)], code[len(prow):]
            pk, nk = prow * width + pcode, nrow * width + ncode
            by = np.argsort(pk, kind="stable")
            s = pk[by]
            lo, hi = np.searchsorted(s, nk, "left"), np.searchsorted(s, nk, "right")

            def hit(nth):
                """The index of the ``nth`` equal sentence of the positive, -1 for none."""
                at, some = lo + nth, lo + nth < hi
                src = np.full(len(nk), -1, np.int64)
                src[some] = pat[by[at[some]]]
                return src

            for m in modes:
                if m == "first":
                    src = hit(np.zeros(len(nk), np.int64))
                elif m == "bijective":
                    src = hit(occurrence(nk))
                else:
                    stays = nat < pn[nrow]
                    beside = pstart[nrow[stays]] + nat[stays]
                    stays[stays] = pcode[beside] == ncode[stays]
                    moved = ~stays
                    nth = np.zeros(len(nk), np.int64)
                    nth[moved] = occurrence(nk[moved])
                    src = np.where(stays, nat, hit(nth))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(nk), m, dtype=object), pa.string()), b.column(key).take(pa.array(nrow)),
                    pa.array(nat.astype(np.int32)), pa.array(src.astype(np.int32), mask=src < 0)], ["mode", key, "dst", "src"])

        for batch in batches:
            rows = max(1, int(len(batch) * slice_bytes / max(batch.nbytes, 1)))
            for i in range(0, len(batch), rows):
                yield from aligned(batch.slice(i, rows))
    return run


def _align_shared(pairs: DataFrame, key: str, mode: str) -> DataFrame:
    """:func:`align_order_long` where rows share their ``key``: the sentences of all of
    them are numbered by their occurrence and meet in one shuffle by key and digest."""
    P, N = F.col("_pos"), F.col("_neg")

    def entry(s, i, side, stays):
        return F.struct(F.coalesce(F.sha2(s.cast("string"), 256), F.lit("")).alias("_s"), F.lit(side).alias("_neg"),
                        stays.alias("_stays"), i.alias("_i"))

    def in_place(s, j):
        return s.eqNullSafe(F.get(P, j)) & (j < F.size(P)) if mode == "reference" else F.lit(False)

    both = F.concat(F.transform(P, lambda s, i: entry(s, i, False, F.lit(False))),
                    F.transform(N, lambda s, j: entry(s, j, True, in_place(s, j))))
    e = pairs.select(key, F.inline(both)).repartition(key, "_s")
    if mode == "first":
        first = F.min(F.when(~F.col("_neg"), F.col("_i"))).over(Window.partitionBy(key, "_s"))
        return e.withColumn("src", first).where("_neg").select(key, F.col("_i").alias("dst"), "src")
    nth = F.row_number().over(Window.partitionBy(key, "_s", "_neg", "_stays").orderBy("_i"))
    met = e.withColumn("_n", nth).groupBy(key, "_s", "_stays", "_n").agg(
        F.max(F.when(F.col("_neg"), F.col("_i"))).alias("dst"),
        F.max(F.when(~F.col("_neg") | F.col("_stays"), F.col("_i"))).alias("src"))
    return met.where("dst IS NOT NULL").select(key, "dst", "src")
