"""Byte-level BPE: texts to token ids and back, by recursive DuckDB queries.

A text is cut by the tokenizer's pattern into words, each encoded alone.  Inside
a Spark task an in-process DuckDB holds two tables made from the rank file: the
vocabulary (id, bytes) and the merges (left id, right id, id of the joined
bytes).  The words of a slice of texts that the worker does not know yet become
rows (word, position, token); a recursive query joins neighbours with the merge
table and contracts each word's leftmost pair of least rank, until no word has a
pair left.  Decoding joins ids with the vocabulary and puts the bytes of a text
together by an ordered aggregation.

Rules are those of the tiktoken library: a word that is itself a token is that
token; else the pair whose joined bytes have the least rank is merged first, of
equal ranks the leftmost.  No special tokens.

A word over ``LONG`` bytes has a recursion of its own, keyed by position, so its
state is one row a token however many steps it takes.  A step of it contracts
all pairs of the least rank from left to right, up to the first whose new
neighbours have a pair of that rank or less: what one pair at a time would do.

A null or empty text has no tokens, and no ids decode to no bytes; a null id
among ids is passed over, an id outside the vocabulary raises.  Texts are encoded
whole, repeated rows each; other columns pass through (one that is called like
the new column is replaced); empty tables give empty results.  A worker's memory
is bounded by a slice of texts, the longest text and ``CACHE_WORDS`` words of at
most ``CACHE_CHARS`` characters.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from cohera.llm.common import map_texts

#: words that a worker remembers besides the vocabulary, and the longest of them
CACHE_WORDS = 400_000
CACHE_CHARS = 32
#: bytes from which a word is contracted alone
LONG = 256
#: most tokens that one decoding query holds (a longer text is decoded alone)
DECODE_TOKENS = 1 << 18
#: what a worker's DuckDB may hold
DUCKDB_MEMORY = "1GB"

# each step's rows are those of the words that were contracted in it; a word's
# last step is its result
SHORT_WORDS = """
WITH RECURSIVE s AS (
  SELECT word, pos, tok, 0 AS step FROM seed
  UNION ALL
  (WITH p AS (SELECT s.*, lead(word) OVER o AS next_word, lead(pos) OVER o AS next_pos, lead(tok) OVER o AS next_tok
              FROM s WINDOW o AS (ORDER BY word, pos)),
   r AS (SELECT p.*, id FROM p JOIN merges m ON m.l = p.tok AND m.r = p.next_tok WHERE next_word = word),
   b AS (SELECT word, min(id::BIGINT << 32 | pos) AS best, arg_min(next_pos, id::BIGINT << 32 | pos) AS gone FROM r GROUP BY word)
   SELECT s.word, s.pos, CASE WHEN s.pos = best & 4294967295 THEN (best >> 32)::INTEGER ELSE s.tok END, step + 1
   FROM s JOIN b USING (word) WHERE s.pos <> gone))
SELECT word, list(tok ORDER BY pos) AS ids
FROM s JOIN (SELECT word, max(step) AS step FROM s GROUP BY word) USING (word, step) GROUP BY word ORDER BY word
"""

# -1 marks a position whose token was joined to the one before it
LONG_WORD = """
WITH RECURSIVE s(pos, tok) USING KEY (pos) AS (
  SELECT pos, tok FROM seed
  UNION
  (WITH live AS (
     SELECT pos, tok, row_number() OVER o AS rn, lag(tok) OVER o AS t0, lead(tok) OVER o AS t1, lead(tok, 2) OVER o AS t2, lead(pos) OVER o AS pos1
     FROM recurring.s WHERE tok >= 0 WINDOW o AS (ORDER BY pos)),
   r AS (SELECT live.*, id FROM live JOIN merges m ON m.l = live.tok AND m.r = live.t1),
   hit AS (SELECT *, rn - row_number() OVER (ORDER BY rn) AS run FROM r WHERE id = (SELECT min(id) FROM r)),
   free AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rn) AS k FROM hit) WHERE k % 2 = 1),
   near AS (SELECT free.*, CASE WHEN lag(rn) OVER (ORDER BY rn) = rn - 2 THEN id ELSE t0 END AS before FROM free),
   halt AS (SELECT min(rn) AS rn FROM near LEFT JOIN merges a ON a.l = near.before AND a.r = near.id
            LEFT JOIN merges b ON b.l = near.id AND b.r = near.t2 WHERE a.id <= near.id OR b.id <= near.id),
   done AS (SELECT near.* FROM near, halt WHERE halt.rn IS NULL OR near.rn <= halt.rn)
   SELECT pos, id FROM done UNION ALL SELECT pos1, -1 FROM done))
SELECT list(tok ORDER BY pos) AS ids FROM s WHERE tok >= 0
"""

DECODE = """
SELECT text, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM rows JOIN vocab USING (id) GROUP BY text ORDER BY text
"""

_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """A rank file's vocabulary and merges in an in-process DuckDB."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": DUCKDB_MEMORY})
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._table("merges", dict(zip("lri", (pa.array(c, pa.int32()) for c in zip(*merges)))), "l, r, i AS id")
        self._table("vocab", {"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}, "id, hex")
        self.known, ids = {}, []
        for t, r in ranks.items():
            try:
                self.known[t.decode("utf-8")] = len(ids)
                ids.append(r)
            except UnicodeDecodeError:  # part of a character: never a word
                pass
        self.known_ids = np.array(ids, dtype=np.int32)
        self._forget()

    def _forget(self) -> None:
        """Remember the vocabulary alone: ``cache`` has a word's number, and
        ``ids[ends[n]:ends[n + 1]]`` are the ids of word n."""
        self.cache = dict(self.known)
        self.ids, self.ends = self.known_ids, np.arange(len(self.known_ids) + 1)

    def _table(self, name: str, columns: dict, select: str) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT {select} FROM given")
        self.con.unregister("given")

    def _contract(self, words: list[bytes], query: str) -> pa.ListArray:
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.con.register("seed", pa.table({"word": word, "pos": pos, "tok": self.byte[data]}))
        return self.con.sql(query).to_arrow_table()["ids"].combine_chunks()

    def _learn(self, words: list[str]) -> None:
        """Encode words and remember them."""
        words = sorted(words, key=len)  # long ones come last, and are forgotten first
        raw = [w.encode() for w in words]
        short = next((i for i, r in enumerate(raw) if len(r) > LONG), len(raw))
        made = [self._contract(raw[:short], SHORT_WORDS)] if short else []
        made += [self._contract([r], SHORT_WORDS if len(r) <= LONG else LONG_WORD) for r in raw[short:]]
        self.cache.update(zip(words, range(len(self.cache), len(self.cache) + len(words))))
        sizes = np.concatenate([m.value_lengths().to_numpy(zero_copy_only=False) for m in made])
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate([self.ids, *(m.flatten().to_numpy() for m in made)])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The token ids of each text."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        new = list(set().union(*split) - self.cache.keys())
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        begin = self.ends[word]
        size = self.ends[word + 1] - begin
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        ends = total[np.concatenate(([0], np.cumsum(counts)))]
        if len(self.cache) > len(self.known) + CACHE_WORDS or any(len(w) > CACHE_CHARS for w in new):
            self._shrink()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    def _shrink(self) -> None:
        """Forget the long words, or all where there are too many."""
        while len(self.cache) > len(self.known) and len(next(reversed(self.cache))) > CACHE_CHARS:
            self.cache.popitem()
        if len(self.cache) > len(self.known) + CACHE_WORDS:
            self._forget()
        self.ends = self.ends[: len(self.cache) + 1]
        self.ids = self.ids[: self.ends[-1]].copy()

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out = [b""] * len(sizes)
        at = 0
        while at < len(sizes):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), DECODE_TOKENS, side="right")))
            n = sizes[at:to]
            ids = lists.slice(at, to - at).flatten()
            rows = pa.table({"text": np.repeat(np.arange(at, to, dtype=np.int64), n), "pos": np.arange(len(ids)), "id": ids.cast(pa.int32())})
            rows = rows.filter(rows["id"].is_valid())
            self.con.register("rows", rows)
            if self.con.execute("SELECT 1 FROM rows ANTI JOIN vocab USING (id) LIMIT 1").fetchone():
                raise ValueError("an id is not in the vocabulary")
            made = self.con.sql(DECODE).to_arrow_table()
            for i, b in zip(made["text"].to_pylist(), made["bytes"].to_pylist()):
                out[i] = b
            at = to
        return out


def _codec(rank_file: str, pattern: str) -> Codec:
    """One codec a worker and file."""
    key = (rank_file, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the tokens of ``column``.  ``rank_file`` is a path
    that every worker can read."""
    return map_texts(docs, [c for c in docs.columns if c != "ids"], [StructField("ids", ArrayType(IntegerType()))],
                     lambda texts: {"ids": _codec(rank_file, pattern).encode(texts)}, column)


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of ``ids`` (a text's bytes, where
    the ids are those of a text)."""
    keep = [c for c in tokens.columns if c != "decoded"]
    schema = StructType([tokens.schema[c] for c in keep] + [StructField("decoded", BinaryType())])
    binary = to_arrow_type(BinaryType())

    def f(batches):
        for batch in batches:
            made = _codec(rank_file, pattern).decode(batch.column(batch.schema.get_field_index("ids")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, binary)], names=[*keep, "decoded"])

    return tokens.select(*keep).mapInArrow(f, schema)


def digests(docs: DataFrame, rank_file: str, pattern: str, column: str = "text") -> DataFrame:
    """``docs`` without ``column``, but with ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256`` (of the bytes that the ids decode
    to), in lowercase hex: a round trip in one pass, which keeps neither."""
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def make(texts):
        codec = _codec(rank_file, pattern)
        lists = codec.encode(texts)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        return {"n_tokens": pa.array(np.diff(ends), pa.int64()),
                "ids_sha256": [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in codec.decode(lists)]}

    return map_texts(docs, [c for c in docs.columns if c not in {column, *(f.name for f in fields)}], fields, make, column)
