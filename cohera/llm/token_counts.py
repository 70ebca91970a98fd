"""Token counts of a unigram tokenizer, without making the tokens.

Aho-Corasick lists the vocabulary pieces that end at each character; dynamic
programming keeps, for each position, the best score and the number of tokens
of the best path.  Tie rules are those of the exact tokenizer: of equal scores
at a position the piece that starts first wins; a character that is no piece
itself may be unknown, at ten below the least score; with byte fallback an
unknown run costs one token a UTF-8 byte, else one token in all.

Spaces become U+2581 and one is put in front of a text that does not begin with
one.  No piece has that sign after another character (checked; otherwise a text
is one unit), so a text falls into units that are counted alone, and a unit's
count is kept in a bounded cache.

A null or empty text has 0 tokens; a text is counted whole, however long;
repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from cohera.llm.common import map_texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: most units that a worker remembers
CACHE_UNITS = 400_000
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_COUNTERS: dict = {}


def load_pieces(model_file: str) -> list[tuple[str, float]]:
    """``(piece, score)`` of the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


class Counter:
    """Counts the tokens of texts for one vocabulary."""

    def __init__(self, pieces: Iterable[tuple[str, float]], byte_fallback: bool = True):
        pieces = list(pieces)
        self.byte_fallback = byte_fallback
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.trie = ahocorasick.Automaton()
        for p, s in pieces:
            self.trie.add_word(p, (len(p), s))
        self.trie.make_automaton()
        self.split = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.cache: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Tokens of the best path through ``text``, taken as it is."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.trie.iter(text):
            ends[end].append(match)
        score, count, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            best, single = None, False
            for size, s in sorted(ends[end], reverse=True):  # the longest starts first
                single = single or size == 1
                s += score[end + 1 - size]
                if best is None or s > best:
                    best, to = s, (count[end + 1 - size] + 1, False)
            if not single:
                s = score[end] + self.unknown
                if best is None or s > best:
                    if self.byte_fallback:
                        more = len(text[end].encode("utf-8", "surrogatepass"))
                    else:
                        more = 0 if lost[end] else 1
                    best, to = s, (count[end] + more, True)
            score[end + 1], (count[end + 1], lost[end + 1]) = best, to
        return count[n]

    def _known(self, unit: str) -> int:
        n = self.cache.get(unit)
        if n is None:
            if len(self.cache) >= CACHE_UNITS:
                self.cache.clear()
            n = self.cache[unit] = self.unit(unit)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        if not marked.startswith(SPACE):
            marked = SPACE + marked
        if not self.split or not self.byte_fallback:  # an unknown run may cross units only without byte fallback
            return self.unit(marked)
        known = self._known
        get = self.cache.get
        return sum(get(u) or known(u) for u in _UNIT.findall(marked))


def _counter(source, byte_fallback: bool) -> Counter:
    """One counter a worker and vocabulary: a file's path, or the pieces."""
    key = (source, byte_fallback)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(load_pieces(source) if isinstance(source, str) else source, byte_fallback)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary, byte_fallback: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` (a column of that name is replaced).

    ``vocabulary``: the path of a sentencepiece file that every worker can
    read, or a tuple of ``(piece, score)``."""
    keep = [c for c in docs.columns if c != "n_tokens"]

    def make(texts):
        counter = _counter(vocabulary, byte_fallback)
        return {"n_tokens": [counter.count(t) for t in texts]}

    return map_texts(docs, keep, [StructField("n_tokens", LongType())], make)
