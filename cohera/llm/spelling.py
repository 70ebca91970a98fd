"""Spelling variants: words one edit apart, by sorted-list dynamic programming.

Words come from whole texts; two are near if one inserted, deleted or replaced
code point makes one from the other.  A word's form is its near word of largest
count (ties: the smallest), if that count is at least ``ratio`` times its own;
the root follows forms to the last.

Lists.  With h = half a word's length, an edit lies either behind the first h
code points or before the rest.  So there are two sorted lists, of the words and
of the words reversed, and a word looks for partners only where its first h code
points (reversed: the others) stand unchanged: one run of the list.  Each list is
cut into blocks by Spark's range partitioning; a word goes to the blocks that its
run touches, except those whose common prefix is already over one edit away.

Scan.  Within a block the edit matrix of a word and the list is filled in a band
of three cells a row.  Words of the list that share a prefix share its rows (the
longest common prefixes of neighbours say which), so a row is computed once for
each prefix, and a range whose prefix has no cell of at most one is left.  The
scan goes through all ranges of one depth at a time, so that numpy fills their
rows together; ``STEP_WORDS`` words are matched at a time.

Skew.  Counts are combined before the shuffle.  A block holds about
``BLOCK_WORDS`` words of distinct spelling (more only where there are over
``MAX_BLOCKS`` blocks: the blocks' borders, cut to ``BORDER`` code points, are all
that passes the driver); the words that look into it stream past in its task.

Null texts have no words; a null id counts as an empty one in the rule that
deletes code points; repeated rows count each.  Ties are settled as above.  Other
columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.llm.common import materialise

#: words of a block, most blocks of a list, code points kept of a block's borders
BLOCK_WORDS = 1 << 14
MAX_BLOCKS = 4096
BORDER = 64
#: words that are matched with a block at a time
STEP_WORDS = 2048
#: forms at least double the count, so no chain of them is longer than a long has bits
CHAIN = 63
_LAST = "\U0010ffff"
_PARTIAL = "word string, n bigint, n_near bigint, form_n bigint, form string"


def noisy_words(docs: DataFrame, every: int = 97) -> DataFrame:
    """``word``, a row for each maximal run of Latin letters, A-Z in lower case;
    where ``every`` divides crc32 of ``<doc_id>:<run>``, the code point at crc32 %
    length is deleted."""
    run = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), 0))
    runs = docs.select("doc_id", run.alias("run")).withColumn(
        "run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is shared, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in one array, where each begins, its length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.append(points, np.uint32(0)), np.cumsum(size) - size, size


def one_edit_apart(words: list[str], queries: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(query, word)`` of all pairs at a distance of exactly one whose first
    ``halves`` code points agree.  ``words`` is sorted and has no word twice."""
    n = len(words)
    lcp = np.fromiter((_shared(a, b) for a, b in zip([""] + words, words)), np.int64, n)
    x, x_at, x_size = _flat(words)
    w, w_at, w_size = _flat(queries)
    starts = [(bisect_left(words, q[:h]), bisect_right(words, q[:h] + _LAST)) for q, h in zip(queries, halves.tolist())]
    starts = np.array(starts, dtype=np.int64).reshape(-1, 2)
    waiting = np.flatnonzero(starts[:, 0] < starts[:, 1])
    whole = waiting[(x_size[starts[waiting, 0]] == halves[waiting]) & (w_size[waiting] == halves[waiting] + 1)]
    found_q, found_x = [whole], [starts[whole, 0]]  # words that are all of a query but its last code point
    waiting = waiting[np.argsort(halves[waiting], kind="stable")]
    # a state is a query, a range of the list with a common prefix, and the
    # cells of that prefix's row beside and on the diagonal
    q = lo = hi = np.empty(0, np.int64)
    left = mid = right = np.empty(0, np.int8)
    depth, cut = 0, 0
    while len(q) or cut < len(waiting):
        if not len(q):
            depth = int(halves[waiting[cut]])
        to = int(np.searchsorted(halves[waiting], depth, side="right"))
        new, cut = waiting[cut:to], to
        one = np.ones(len(new), np.int8)
        q, lo, hi = np.concatenate((q, new)), np.concatenate((lo, starts[new, 0])), np.concatenate((hi, starts[new, 1]))
        left, mid, right = np.concatenate((left, one)), np.concatenate((mid, one - 1)), np.concatenate((right, one))
        lo = lo + (x_size[lo] == depth)  # a word that ends here goes no deeper
        keep = lo < hi
        q, lo, hi, left, mid, right = (a[keep] for a in (q, lo, hi, left, mid, right))
        # ranges of the next depth: each begins where neighbours share less
        edge = np.append(np.flatnonzero(lcp <= depth), n)
        first = np.searchsorted(edge, lo)  # lo itself may be no edge: the word before it may have ended here
        head = edge[first] > lo
        count = np.searchsorted(edge, hi) - first + head
        rep = np.repeat(np.arange(len(q)), count)
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) - head[rep]
        lo_next = np.where(nth < 0, lo[rep], edge[np.minimum(first[rep] + nth, len(edge) - 1)])
        hi_next = np.minimum(edge[np.minimum(first[rep] + nth + 1, len(edge) - 1)], hi[rep])
        q, lo, hi, a, b, c = q[rep], lo_next, hi_next, left[rep], mid[rep], right[rep]
        ch = x[x_at[lo] + depth]
        size, at = w_size[q], w_at[q] + depth

        def differs(shift: int) -> np.ndarray:
            ok = (depth + shift >= 0) & (depth + shift < size)
            return np.where(ok, w[np.where(ok, at + shift, 0)] != ch, 3).astype(np.int8)

        left = np.minimum(a + differs(-1), b + 1)
        mid = np.minimum(np.minimum(b + differs(0), c + 1), left + 1)
        mid = np.where(depth + 1 <= size, mid, 3).astype(np.int8)
        right = np.where(depth + 2 <= size, np.minimum(c + differs(1), mid + 1), 3).astype(np.int8)
        depth += 1
        end = x_size[lo] == depth
        gap = size - depth
        last = np.where(gap == -1, left, np.where(gap == 0, mid, np.where(gap == 1, right, 3)))
        hit = end & (last == 1)
        found_q.append(q[hit]), found_x.append(lo[hit])
        keep = (np.minimum(np.minimum(left, mid), right) <= 1) & (depth <= size)
        q, lo, hi, left, mid, right = (v[keep] for v in (q, lo, hi, left, mid, right))
    return np.concatenate(found_q), np.concatenate(found_x)


class Borders:
    """First and last key of each block of the two lists."""

    def __init__(self, rows: list):
        self.side = []
        for side in (0, 1):
            some = sorted((r["lo"], r["hi"], r["block"]) for r in rows if r["side"] == side)
            self.side.append(([r[0] for r in some], [r[1] for r in some], [r[2] for r in some], [_shared(r[0], r[1]) for r in some]))

    def reached(self, side: int, key: str, half: int) -> Iterator[int]:
        """The blocks in which ``key``'s partners may stand."""
        los, his, blocks, shared = self.side[side]
        head = key[: min(half, BORDER)]  # borders are cut, which only widens what is reached
        for i in range(bisect_left(his, head), len(los)):
            if los[i][: len(head)] > head:
                break
            if _within_one(los[i][: shared[i]], key):
                yield blocks[i]


def _within_one(prefix: str, word: str) -> bool:
    """Is ``prefix`` at most one edit from some prefix of ``word``?"""
    i = _shared(prefix, word)
    rest = prefix[i:]
    return not rest or any(word[j:j + len(r)] == r for j, r in ((i + 1, rest[1:]), (i + 1, rest), (i, rest[1:])))


def _solve(words: list[str], counts: list[int], queries: list[tuple], side: int) -> pd.DataFrame:
    """Of each query: its near words in this block, the best of them."""
    keys = [q[0] for q in queries]
    half = np.array([len(k) // 2 if side == 0 else len(k) - len(k) // 2 for k in keys], dtype=np.int64)
    near, best = [0] * len(keys), [None] * len(keys)
    for i, j in zip(*(v.tolist() for v in one_edit_apart(words, keys, half))):
        x, n = words[j], counts[j]
        if side:
            x = x[::-1]
            h = len(keys[i]) // 2
            if x[:h] == keys[i][: -h - 1: -1]:  # the other list has this pair
                continue
        near[i] += 1
        if best[i] is None or (-n, x) < best[i]:
            best[i] = (-n, x)
    return pd.DataFrame({"word": [k[::-1] if side else k for k in keys], "n": [q[1] for q in queries], "n_near": near,
                         "form_n": pd.array([None if b is None else -b[0] for b in best], "Int64"),
                         "form": [None if b is None else b[1] for b in best]})


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order, each block's list before the words that look into it."""
    at, words, counts, queries = None, [], [], []
    for pdf in batches:
        for block, side, query, key, n in zip(*(pdf[c].tolist() for c in ("block", "side", "query", "key", "n"))):
            if at != (block, side) or len(queries) == STEP_WORDS:
                if queries:
                    yield _solve(words, counts, queries, at[1])
                    queries = []
                if at != (block, side):
                    at, words, counts = (block, side), [], []
            if query:
                queries.append((key, n))
            else:
                words.append(key), counts.append(n)
    if queries:
        yield _solve(words, counts, queries, at[1])


def near_words(vocab: DataFrame) -> DataFrame:
    """``word, n, n_near, form_n, form``: of each word of ``vocab`` (``word, n``) the
    number of near words, and the count and spelling of the best, if any."""
    both = vocab.select("n", F.lit(0).alias("side"), F.col("word").alias("key")).unionByName(
        vocab.select("n", F.lit(1).alias("side"), F.reverse("word").alias("key")))
    blocks = min(MAX_BLOCKS, max(1, -(-2 * vocab.count() // BLOCK_WORDS)))
    lists = both.repartitionByRange(blocks, "side", "key").withColumn("block", F.spark_partition_id())
    lists = materialise(lists, "spelling-lists")
    cut = F.substring("key", 1, BORDER)
    borders = Borders(lists.groupBy("block", "side").agg(F.min(cut).alias("lo"), F.max(cut).alias("hi")).collect())  # MAX_BLOCKS + 1 rows

    def look(batches):
        for pdf in batches:
            out = []
            for side, key, n in zip(pdf["side"].tolist(), pdf["key"], pdf["n"].tolist()):
                half = len(key) // 2 if side == 0 else len(key) - len(key) // 2
                out += [(n, side, key, b, True) for b in borders.reached(side, key, half)]
            yield pd.DataFrame(out, columns=["n", "side", "key", "block", "query"])

    queries = lists.select("n", "side", "key").mapInPandas(look, "n bigint, side int, key string, block int, query boolean")
    dealt = lists.withColumn("query", F.lit(False)).unionByName(queries).repartition(blocks, "block", "side")
    parts = dealt.sortWithinPartitions("block", "side", "query", "key").mapInPandas(_scan, _PARTIAL)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form"))))
    return parts.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def variants(vocab: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``vocab``."""
    if ratio < 2:
        raise ValueError("forms must at least double the count, or chains of them may have no end")
    ok: Column = F.col("form_n") >= ratio * F.col("n")
    near = near_words(materialise(vocab, "spelling-words"))
    near = materialise(near.select("word", "n", "n_near", *(F.when(ok, F.col(c)).alias(c) for c in ("form", "form_n"))), "spelling-near")
    links = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    hops = 1
    while hops < CHAIN:  # each round doubles what a link spans
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        links = materialise(links, "spelling-roots")
        if not links.where("moved").take(1):
            break
        links, hops = links.drop("moved"), 2 * hops
    return near.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
