"""Text scalars as native Spark expressions (no Python UDFs).

White space is what ``str.strip()`` and ``str.split()`` take for it, Unicode
spaces and the ASCII separators included.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------

# English stop list used by the corpus cleaner (fixed values, natural order).
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just",
    "don", "should", "now", "n",
]

# Sentence-splitter vocabulary (fixed values: the protected-abbreviation classes).
SPLIT_ALPHABETS = "([A-Za-z])"
SPLIT_PREFIXES = "(Mr|St|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|Mt)[.]"
SPLIT_WEBSITES = "[.](com|net|org|io|gov|me|edu)"
SPLIT_SUFFIXES = "(Inc|Ltd|Jr|Sr|Co)"
SPLIT_STARTERS = ("(Mr|Mrs|Ms|Dr|He\\s|She\\s|It\\s|They\\s|Their\\s|Our\\s|We\\s|But\\s"
                  "|However\\s|That\\s|This\\s|Wherever)")
SPLIT_ACRONYMS = "([A-Z][.][A-Z][.](?:[A-Z][.])?)"
SPLIT_DIGITS = "([0-9])"

# Sentence tags of the tagged normalisation mode (fixed values).
SENT_OPEN, SENT_CLOSE = "<s>", "</s>"


def _deaccent_table() -> tuple[str, str]:
    """Accented Latin letters -> base letter, built by the Unicode rule
    (NFD, drop combining marks) over Latin-1 Supplement and Latin Extended-A."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


DEACCENT_FROM, DEACCENT_TO = _deaccent_table()


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Higher-order-function lambdas re-evaluate captured expressions for every
    element; binding the value first keeps array pipelines linear."""
    return F.element_at(F.transform(F.array(value), body), 1)


# The characters that ``str.isspace()`` holds for, and the same as a regex class
# (fixed values).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE_CLASS = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading and trailing whitespace (no regex)."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalize(c, mode: str = "tagged") -> Column:
    """T1 sentence normalisation.

    ``plain``  lower, strip, delete ``<s>``/``</s>``;
    ``tagged`` plain, then runs outside ``[a-zA-Z.!?@]`` become one space and
               the result is wrapped in ``<s>...</s>``;
    ``cased``  strip and delete tags, keep case.
    Strip runs before the tag deletion and the character-class rewrite.
    """
    c = col(c)
    if mode == "cased":
        return F.regexp_replace(py_strip(c), "(<s>|</s>)", "")
    if mode == "plain":
        return F.regexp_replace(py_strip(F.lower(c)), "(<s>|</s>)", "")
    if mode == "tagged":
        return F.array_join(tagged_words(c), " ")
    raise ValueError(f"unknown normalisation mode {mode!r}")


# The words of a tagged sentence: the tags, alone or with the word that they touch, and the runs between them.
_RUN = "[a-zA-Z.!?@]"
_TAGGED_WORDS = rf"\A{SENT_OPEN}{_RUN}*+(?:{SENT_CLOSE}\z)?|{_RUN}++(?:{SENT_CLOSE}\z)?|{SENT_CLOSE}\z"


def tagged_words(c) -> Column:
    """The words of T1's ``tagged`` form, which is these joined by a space each.
    The kept runs are read off; looking for what lies between them takes a regex
    several times as long."""
    tagged = F.concat(F.lit(SENT_OPEN), normalize(c, "plain"), F.lit(SENT_CLOSE))
    return F.regexp_extract_all(tagged, F.lit(_TAGGED_WORDS), 0)



def split_ws(c) -> Column:
    """``str.split()``: split on whitespace runs, drop empty pieces."""
    return F.filter(F.split(col(c), SPACE_CLASS + "+"), lambda t: t != "")


def deaccent(c) -> Column:
    return F.translate(col(c), DEACCENT_FROM, DEACCENT_TO)


def tokenize(c, mode: str = "whitespace", min_len: int = 2, max_len: int = 15) -> Column:
    """T2 tokenisers.

    ``whitespace``  split on whitespace, empties dropped;
    ``strip_ends``  whitespace, then drop the first and last token (tags);
    ``simple``      lower-case, de-accent, alphabetic tokens of
                    ``min_len``..``max_len`` chars not starting with ``_``;
    ``tagged``      the words of the tagged normalisation of ``c``.
    """
    c = col(c)
    if mode == "tagged":
        return tagged_words(c)
    if mode == "whitespace":
        return split_ws(c)
    if mode == "strip_ends":
        a = split_ws(c)
        return F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0)))
    if mode == "simple":
        toks = F.regexp_extract_all(deaccent(F.lower(c)), F.lit(r"([\p{L}_]+)"), 1)
        return F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len)
                        & ~t.startswith("_"))
    raise ValueError(f"unknown tokeniser {mode!r}")


def _lit_re(s: str) -> str:
    """Escape a literal for use as a Java regex."""
    out = []
    for ch in s:
        out.append("\\" + ch if ch in ".^$|?*+()[]{}\\" else ch)
    return "".join(out)


def split_sentences(c, keep_tail: bool = True) -> Column:
    """T3 rule-based sentence splitter -> ``ARRAY<STRING>``.

    Protects decimals, titles, web suffixes, Ph.D., initials, acronyms,
    company suffixes, closing quotes and e.g./i.e., then cuts after
    ``. ? !``. ``keep_tail=False`` reproduces the reference exactly (text
    after the last terminator is dropped, so un-terminated text yields no
    sentence); ``keep_tail=True`` keeps a non-blank tail as a last sentence.
    """
    rr = F.regexp_replace
    # fixed behaviour: the steps in this order give the cuts the jobs expect
    t = F.concat(F.lit(" "), col(c), F.lit("  "))
    t = rr(t, "\n", " ")
    t = rr(t, SPLIT_DIGITS + "[.]" + SPLIT_DIGITS, "$1<prd>$2")
    t = rr(t, SPLIT_PREFIXES, "$1<prd>")
    t = rr(t, SPLIT_WEBSITES, "<prd>$1")
    t = rr(t, _lit_re("Ph.D."), "Ph<prd>D<prd>")
    t = rr(t, "\\s" + SPLIT_ALPHABETS + "[.] ", " $1<prd> ")
    t = rr(t, SPLIT_ACRONYMS + " " + SPLIT_STARTERS, "$1<stop> $2")
    t = rr(t, SPLIT_ALPHABETS + "[.]" + SPLIT_ALPHABETS + "[.]" + SPLIT_ALPHABETS + "[.]",
           "$1<prd>$2<prd>$3<prd>")
    t = rr(t, SPLIT_ALPHABETS + "[.]" + SPLIT_ALPHABETS + "[.]", "$1<prd>$2<prd>")
    t = rr(t, " " + SPLIT_SUFFIXES + "[.] " + SPLIT_STARTERS, " $1<stop> $2")
    t = rr(t, " " + SPLIT_SUFFIXES + "[.]", " $1<prd>")
    t = rr(t, " " + SPLIT_ALPHABETS + "[.]", " $1<prd>")
    t = rr(t, _lit_re(".”"), "”.")
    t = rr(t, _lit_re('."'), '".')
    t = rr(t, _lit_re('!"'), '"!')
    t = rr(t, _lit_re('?"'), '"?')
    t = rr(t, _lit_re("e.g."), "e<prd>g<prd>")
    t = rr(t, _lit_re("i.e."), "i<prd>e<prd>")
    t = rr(t, "([.?!])", "$1<stop>")
    t = rr(t, "<prd>", ".")
    def cut(pieces):
        head = F.slice(pieces, 1, F.size(pieces) - 1)
        if not keep_tail:
            return head
        return F.when(F.element_at(pieces, -1) != "", pieces).otherwise(head)
    return let(F.transform(F.split(t, "<stop>"), py_strip), cut)


def first_last(sents) -> tuple[Column, Column]:
    """T4: first and last sentence of a sentence array."""
    s = col(sents)
    return F.element_at(s, 1), F.element_at(s, -1)
