"""DuckDB SQL oracles, one per registered query (same column names).

Written independently in long/list form; the md5 ranks are the same
expressions as in Spark, so sampled outputs compare row for row.
"""

from __future__ import annotations

# White space as Python's strip() and split() have it.
SP = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# documents -> (doc_id, sents): lines, stripped; file-iteration semantics.
DOCS = r"""
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id,
         list_transform(
           CASE WHEN text = '' THEN []::VARCHAR[]
                ELSE string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') END,
           lambda x: regexp_replace(x, '^SP+|SP+$', '', 'g')) AS sents
  FROM documents)
""".replace("SP", SP)

MD5I = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def md5i(expr: str) -> str:
    return MD5I.format(expr)


ORD3 = "[[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]]"



def P8_CTES(normalize: bool = True) -> str:
    """CTEs up to ``texts`` (pos/neg lists) of the permutation dataset."""
    norm = (lambda e: f"list_filter(list_transform({e}, lambda s: regexp_replace(regexp_replace(s, "
            f"'^{SP}+|{SP}+$', '', 'g'), '(<s>|</s>)', '', 'g')), lambda s: s <> '')") if normalize \
        else (lambda e: e)
    return f"""{DOCS},
elig AS (SELECT doc_id, sents, len(sents) AS L, len(sents) // 3 AS M
         FROM docs WHERE len(sents) >= 10),
cut AS (SELECT max(doc_id) AS c FROM (SELECT doc_id FROM elig ORDER BY doc_id LIMIT 121)),
ns AS (SELECT * FROM (VALUES (1, 20), (2, 20), (3, 20)) t(n, nperm)),
dn AS (
  SELECT e.*, ns.n, ns.nperm,
         CASE ns.n WHEN 1 THEN M::BIGINT WHEN 2 THEN M::BIGINT * (M - 1) // 2
                   ELSE M::BIGINT * (M - 1) * (M - 2) // 6 END AS C
  FROM elig e JOIN ns ON ns.n <= e.M),
floyd AS (
  SELECT doc_id, n, C, M, least(nperm, C) AS k, 0 AS i, []::BIGINT[] AS taken FROM dn
  UNION ALL
  SELECT doc_id, n, C, M, k, i + 1,
         list_append(taken, CASE WHEN list_contains(taken, t) THEN C - k + i ELSE t END)
  FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', '42', doc_id, n, i)), 1, 15))::BIGINT % (C - k + i + 1) AS t
        FROM floyd WHERE i < k)),
ranks AS (SELECT doc_id, n, M, unnest(taken) AS r, unnest(range(1, len(taken) + 1)) AS perm_no FROM floyd WHERE i = k),
t3 AS (SELECT *, CASE WHEN n = 3 THEN list_max(list_filter(range(2, M), lambda x: x * (x - 1) * (x - 2) // 6 <= r)) END AS c3 FROM ranks),
t2 AS (SELECT *, r - CASE WHEN n = 3 THEN c3 * (c3 - 1) * (c3 - 2) // 6 ELSE 0 END AS r2 FROM t3),
t1 AS (SELECT *, CASE WHEN n >= 2 THEN list_max(list_filter(range(1, M), lambda x: x * (x - 1) // 2 <= r2)) END AS c2 FROM t2),
chosen AS (
  SELECT doc_id, n, perm_no, CASE n WHEN 1 THEN [r] WHEN 2 THEN [r2 - c2 * (c2 - 1) // 2, c2]
                                    ELSE [r2 - c2 * (c2 - 1) // 2, c2, c3] END AS combo FROM t1),
perms AS (
  SELECT ch.doc_id, ch.n, ch.perm_no, ch.combo, e.sents,
         CASE WHEN e.doc_id <= (SELECT c FROM cut) THEN 'train' ELSE 'test' END AS split,
         list_transform(range(0, e.L), lambda p:
           CASE WHEN list_contains(ch.combo, p // 3)
                THEN (p // 3) * 3 + {ORD3}[
                       ({md5i("concat_ws('|', '42', ch.doc_id, ch.n, ch.perm_no, p // 3)")} % 5) + 1
                     ][p % 3 + 1]
                ELSE p END) AS perm
  FROM chosen ch JOIN elig e USING (doc_id)),
texts AS (
  SELECT doc_id, n, perm_no, split, perm, combo,
         {norm('sents')} AS pos,
         {norm('list_transform(perm, lambda i: sents[i + 1])')} AS neg
  FROM perms)
"""


P8 = f"""WITH RECURSIVE {P8_CTES()}
SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id, doc_id, split,
       CAST(n AS INTEGER) AS n_windows, CAST(perm_no AS INTEGER) AS perm_no,
       array_to_string(perm, ',') AS perm,
       array_to_string(pos, chr(10)) AS pos, array_to_string(neg, chr(10)) AS neg
FROM texts WHERE NOT (pos = neg)
"""

ORACLE = {
    "p8_negative_dataset": P8,
}


# ---------------------------------------------------------------------------
# SQL building blocks mirroring the text expressions
# ---------------------------------------------------------------------------

def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def PLAIN(x: str) -> str:
    return f"regexp_replace({STRIP(f'lower({x})')}, '(<s>|</s>)', '', 'g')"


def TAGGED(x: str) -> str:
    return f"('<s>' || regexp_replace({PLAIN(x)}, '[^a-zA-Z.!?@]+', ' ', 'g') || '</s>')"


def CASED(x: str) -> str:
    return f"regexp_replace({STRIP(x)}, '(<s>|</s>)', '', 'g')"


def WS(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SP}+'), lambda t: t <> '')"


def SIMPLE(x: str) -> str:
    return (f"list_filter(regexp_extract_all(strip_accents(lower({x})), '([\\p{{L}}_]+)', 1), "
            f"lambda t: length(t) >= 2 AND length(t) <= 15 AND NOT starts_with(t, '_'))")


_STARTERS = ("(Mr|Mrs|Ms|Dr|He\\s|She\\s|It\\s|They\\s|Their\\s|Our\\s|We\\s|But\\s"
             "|However\\s|That\\s|This\\s|Wherever)")


def SPLIT_SENTS(x: str, keep_tail: bool = True) -> str:
    def rr(t, p, r):
        return f"regexp_replace({t}, '{p}', '{r}', 'g')"
    t = f"(' ' || {x} || '  ')"
    t = f"replace({t}, chr(10), ' ')"
    t = rr(t, "([0-9])[.]([0-9])", r"\1<prd>\2")
    t = rr(t, "(Mr|St|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|Mt)[.]", r"\1<prd>")
    t = rr(t, "[.](com|net|org|io|gov|me|edu)", r"<prd>\1")
    t = f"replace({t}, 'Ph.D.', 'Ph<prd>D<prd>')"
    t = rr(t, r"\s([A-Za-z])[.] ", r" \1<prd> ")
    t = rr(t, "([A-Z][.][A-Z][.](?:[A-Z][.])?) " + _STARTERS, r"\1<stop> \2")
    t = rr(t, "([A-Za-z])[.]([A-Za-z])[.]([A-Za-z])[.]", r"\1<prd>\2<prd>\3<prd>")
    t = rr(t, "([A-Za-z])[.]([A-Za-z])[.]", r"\1<prd>\2<prd>")
    t = rr(t, " (Inc|Ltd|Jr|Sr|Co)[.] " + _STARTERS, r" \1<stop> \2")
    t = rr(t, " (Inc|Ltd|Jr|Sr|Co)[.]", r" \1<prd>")
    t = rr(t, " ([A-Za-z])[.]", r" \1<prd>")
    t = f"replace({t}, '.”', '”.')"
    t = f"replace({t}, '.\"', '\".')"
    t = f"replace({t}, '!\"', '\"!')"
    t = f"replace({t}, '?\"', '\"?')"
    t = f"replace({t}, 'e.g.', 'e<prd>g<prd>')"
    t = f"replace({t}, 'i.e.', 'i<prd>e<prd>')"
    t = rr(t, "([.?!])", r"\1<stop>")
    t = f"replace({t}, '<prd>', '.')"
    pieces = f"list_transform(string_split({t}, '<stop>'), lambda p: {STRIP('p')})"
    if not keep_tail:
        return f"list_slice({pieces}, 1, len({pieces}) - 1)"
    return (f"(CASE WHEN {pieces}[-1] <> '' THEN {pieces} "
            f"ELSE list_slice({pieces}, 1, len({pieces}) - 1) END)")


SENTS = """
sents AS (SELECT doc_id, CAST(unnest(range(len(sents))) AS INTEGER) AS sent_idx,
                 unnest(sents) AS sentence FROM docs)
"""

REVIEWS = """
reviews AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS DOC_ID,
         CASE WHEN l.quality IS NULL THEN NULL
              ELSE '__label' || CAST(l.quality + 1 AS VARCHAR) || '__' END AS LABEL,
         CAST(coalesce(l.toxic, 0) * 4 + 1 AS INTEGER) AS RATING,
         CASE WHEN l.toxic = 1 THEN 'N' ELSE 'Y' END AS VERIFIED_PURCHASE,
         d.source AS PRODUCT_CATEGORY, 'P' || CAST(d.doc_id AS VARCHAR) AS PRODUCT_ID,
         string_split(d.text, chr(10))[1] AS PRODUCT_TITLE, d.lang AS REVIEW_TITLE,
         d.text AS REVIEW_TEXT
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

STOP_SQL = None  # filled below from the Python list


def _stop_sql():
    from cohera.functions.text import STOP_WORDS
    return "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


STOP_SQL = _stop_sql()

ORACLE.update({
    "t1_normalize": f"""WITH {DOCS}, {SENTS}
SELECT doc_id, sent_idx, {PLAIN('sentence')} AS plain, {TAGGED('sentence')} AS tagged,
       {CASED('sentence')} AS cased FROM sents""",
    "t2_tokenize": f"""WITH {DOCS}, {SENTS}
SELECT doc_id, sent_idx, array_to_string({WS('sentence')}, ' ') AS ws,
       CAST(len({WS('sentence')}) AS INTEGER) AS n_ws,
       array_to_string(list_slice({WS('sentence')}, 2, greatest(len({WS('sentence')}) - 1, 1)), ' ')
         AS strip_ends,
       array_to_string({SIMPLE('sentence')}, ' ') AS simple FROM sents""",
    "t3_split_sentences": f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id,
       {SPLIT_SENTS('text', True)} AS ss FROM documents)
SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS sent_idx, unnest(ss) AS sentence FROM s""",
    "t3_split_sentences_ref": f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id,
       {SPLIT_SENTS('text', False)} AS ss FROM documents)
SELECT doc_id, CAST(len(ss) AS INTEGER) AS n_sents, array_to_string(ss, chr(10)) AS sentences
FROM s""",
    "t4_first_last": f"""WITH {REVIEWS}, s AS (SELECT DOC_ID, {SPLIT_SENTS('REVIEW_TEXT')} AS ss
  FROM reviews)
SELECT DOC_ID, ss[1] AS first_sentence, ss[-1] AS last_sentence FROM s""",
    "t5_flatten_tokens": f"""WITH {DOCS}, t AS (
  SELECT doc_id, list_filter(list_transform(sents, lambda s: {WS(TAGGED('s'))}),
                             lambda a: len(a) > 0) AS toks FROM docs)
SELECT doc_id, CAST(len(flatten(toks)) AS INTEGER) AS n_tokens,
       array_to_string(flatten(toks), ' ') AS global_tokens,
       array_to_string(list_transform(toks, lambda a: array_to_string(a, ' ')), chr(10))
         AS local_sentences FROM t""",
    "t6_doc_names": """WITH n AS (SELECT 'wsj_' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 4, '0')
  ELSE CAST(doc_id AS VARCHAR) END || '.pos.text.parsed.ner.EGrid' AS name FROM documents)
SELECT name, array_to_string(string_split(name, '.')[1:3], '.') AS stem,
       string_split(name, '.')[1] AS base, substr(string_split(name, '.')[1], 5, 2) AS section,
       array_to_string(string_split(name, '.')[1:3], '.') || '_3_20' AS neg_name FROM n""",
    "t7_prompts": f"""WITH {REVIEWS}, s AS (SELECT *, {SPLIT_SENTS('REVIEW_TEXT')} AS ss FROM reviews)
SELECT DOC_ID,
  '[BOS]' || coalesce(PRODUCT_TITLE, '') || '[SEP]' || coalesce(REVIEW_TITLE, '') || '[SEP]'
    || coalesce(REVIEW_TEXT, '') || '[EOS]' AS prompt_title,
  '[BOS]' || coalesce(ss[1], '') || '[SEP]' || coalesce(ss[-1], '') || '[SEP]'
    || coalesce(REVIEW_TEXT, '') || '[EOS]' AS prompt_first_last,
  '[BOS]' || coalesce(ss[1], '') || '[SEP]' || coalesce(ss[-1], '') || '[SEP]' AS query_first_last
FROM s""",
    "t8_strip_prompt": f"""WITH {REVIEWS}, s AS (SELECT *, {SPLIT_SENTS('REVIEW_TEXT')} AS ss FROM reviews),
g AS (SELECT DOC_ID, coalesce(ss[1], '') AS a, coalesce(ss[-1], '') AS b,
             coalesce(ss[1], '') || coalesce(ss[-1], '') || REVIEW_TEXT AS generated FROM s)
SELECT DOC_ID, substr(generated, length(a) + length(b) + 1) AS continuation FROM g""",
    "t9_doc_size": f"""WITH {DOCS} SELECT doc_id, CAST(len(sents) AS INTEGER) AS n_sents FROM docs""",
    "t16_numbered_list": """SELECT conv_id, string_agg('Generated Sentences ' || CAST(turn + 1 AS VARCHAR)
  || ': ' || text || chr(13) || chr(10) || chr(13) || chr(10), '' ORDER BY turn) AS numbered
FROM conversations GROUP BY conv_id""",
    "f1_min_sentences": f"""WITH {DOCS}
SELECT doc_id, CAST(len(sents) AS INTEGER) AS n_lines FROM docs WHERE len(sents) >= 10""",
    "f3_drop_empty_sentences": f"""WITH {DOCS}
SELECT doc_id, CAST(len(list_filter(list_transform(sents, lambda s: {PLAIN('s')}),
  lambda s: s <> '')) AS INTEGER) AS n_kept,
  CAST(len(list_transform(sents, lambda s: {TAGGED('s')})) AS INTEGER) AS n_tagged FROM docs""",
    "f5_filter_label": f"""WITH {REVIEWS}
SELECT DOC_ID, CASE WHEN LABEL IS NOT DISTINCT FROM '__label1__' THEN 'eq' ELSE 'ne' END AS branch
FROM reviews""",
    "f6_remove_stopwords": f"""WITH {DOCS}, {SENTS}
SELECT doc_id, sent_idx, array_to_string(list_filter({WS(PLAIN('sentence'))},
  lambda t: NOT list_contains({STOP_SQL}, t)), ' ') AS kept FROM sents""",
    "a1_word_count": f"""WITH {DOCS}, {SENTS}, w AS (SELECT unnest({WS(TAGGED('sentence'))}) AS word FROM sents)
SELECT word, count(*) AS cnt FROM w GROUP BY word""",
    "a1_char_count": f"""WITH {DOCS}, {SENTS},
w AS (SELECT unnest(string_split({PLAIN('sentence')}, '')) AS word FROM sents)
SELECT word, count(*) AS cnt FROM w WHERE word <> '' GROUP BY word""",
})


# ---------------------------------------------------------------------------
# Phase 2
# ---------------------------------------------------------------------------
TOKENS = f"""
toks AS (SELECT doc_id, sent_idx, CAST(unnest(range(len(tk))) AS INTEGER) AS tok_idx,
                unnest(tk) AS word
         FROM (SELECT doc_id, sent_idx, {WS(TAGGED('sentence'))} AS tk FROM sents))
"""


def VOCAB(src: str, name: str = "vocab") -> str:
    return f"""
{name}_c AS (SELECT word, count(*) AS cnt FROM {src} GROUP BY word),
{name} AS (
  SELECT row_number() OVER (ORDER BY cnt DESC, word) - 1 AS idx, word, cnt FROM {name}_c
  UNION ALL SELECT (SELECT count(*) FROM {name}_c), '<unk>', 0
  UNION ALL SELECT (SELECT count(*) FROM {name}_c) + 1, '<pad>', 0)
"""


EN_TOKS = "en_toks AS (SELECT * FROM toks WHERE doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en'))"

HU = "('0x' || substr(md5(concat_ws('|', '42', DOC_ID)), 1, 8))::BIGINT / 4294967296.0"

TFIDF = f"""
tt AS (SELECT DOC_ID, unnest(regexp_extract_all(lower(REVIEW_TEXT), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
       FROM {{src}}),
tf AS (SELECT DOC_ID, term, count(*) AS tf FROM tt WHERE NOT list_contains({STOP_SQL}, term)
       GROUP BY DOC_ID, term),
ndoc AS (SELECT count(*) AS n FROM {{src}}),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((1.0 + n) / (df + 1.0)) + 1.0 AS idf FROM dfs, ndoc)
"""


def TFIDF_ON(src: str, fit: str | None = None) -> str:
    fit = fit or src
    fitted = TFIDF.replace("{src}", fit)
    apply_tf = f"""
atk AS (SELECT DOC_ID, unnest(regexp_extract_all(lower(REVIEW_TEXT), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
       FROM {src}),
atf AS (SELECT DOC_ID, term, count(*) AS tf FROM atk WHERE NOT list_contains({STOP_SQL}, term)
        GROUP BY DOC_ID, term),
w0 AS (SELECT DOC_ID, term, tf * idf AS w FROM atf JOIN idf USING (term)),
wts AS (SELECT DOC_ID, term, w / sqrt(sum(w * w) OVER (PARTITION BY DOC_ID)) AS weight FROM w0)
"""
    return fitted + "," + apply_tf


TOPK = """
topk AS (SELECT DOC_ID, term, row_number() OVER (PARTITION BY DOC_ID ORDER BY weight DESC, term) AS r
         FROM wts WHERE weight <> 0),
kw0 AS (SELECT DOC_ID, string_agg(' ' || term, '' ORDER BY r) AS keywords FROM topk WHERE r <= 10
       GROUP BY DOC_ID),
kw AS (SELECT d.DOC_ID, coalesce(k.keywords, '') AS keywords FROM {src} d LEFT JOIN kw0 k USING (DOC_ID))
"""

ORACLE.update({
    "a2_build_vocab": f"WITH {DOCS}, {SENTS}, {TOKENS}, {VOCAB('toks')} SELECT * FROM vocab",
    "a3_extend_vocab": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {EN_TOKS}, {VOCAB('en_toks')},
newt AS (SELECT * FROM toks WHERE word NOT IN (SELECT word FROM vocab)),
firsts AS (SELECT word, count(*) AS cnt, min((doc_id, sent_idx, tok_idx)) AS f FROM newt GROUP BY word)
SELECT * FROM vocab
UNION ALL SELECT (SELECT max(idx) + 1 FROM vocab) + row_number() OVER (ORDER BY f) - 1, word, cnt
FROM firsts""",
    "j3_encode": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {EN_TOKS}, {VOCAB('en_toks')},
enc AS (SELECT t.doc_id, t.sent_idx, t.tok_idx,
               coalesce(v.idx, (SELECT idx FROM vocab WHERE word = '<unk>')) AS idx
        FROM toks t LEFT JOIN vocab v USING (word))
SELECT doc_id, sent_idx, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY tok_idx) AS ids
FROM enc GROUP BY doc_id, sent_idx""",
    "t11_decode_ids": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {EN_TOKS}, {VOCAB('en_toks')},
enc AS (SELECT t.doc_id, t.sent_idx, t.tok_idx,
               coalesce(v.idx, (SELECT idx FROM vocab WHERE word = '<unk>')) AS idx
        FROM toks t LEFT JOIN vocab v USING (word)),
dec AS (SELECT e.doc_id, e.sent_idx, e.tok_idx, v.word FROM enc e LEFT JOIN vocab v USING (idx))
SELECT doc_id, sent_idx, string_agg(word, ' ' ORDER BY tok_idx) AS text
FROM dec GROUP BY doc_id, sent_idx""",
    "u2_lm_vocab": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {VOCAB('toks')},
ext AS (SELECT * FROM vocab
        UNION ALL SELECT (SELECT max(idx) + 1 FROM vocab), '<bos>', 0
        UNION ALL SELECT (SELECT max(idx) + 2 FROM vocab), '<eos>', 0)
SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, word, cnt FROM ext WHERE word <> '<pad>'""",
    "s6_vocab_roundtrip": f"WITH {DOCS}, {SENTS}, {TOKENS}, {VOCAB('toks')} SELECT * FROM vocab",
    "a9_fit_tfidf": f"WITH {REVIEWS}, {TFIDF.replace('{src}', 'reviews')} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "a9_tfidf_weights": f"""WITH {REVIEWS}, {TFIDF_ON('reviews')}
SELECT DOC_ID, term, round(weight, 6) AS weight FROM wts""",
    "k1_top_keywords": f"WITH {REVIEWS}, {TFIDF_ON('reviews')}, {TOPK.replace('{src}', 'reviews')} SELECT * FROM kw",
    "k2_transform_keywords": f"""WITH {REVIEWS},
train AS (SELECT * FROM reviews WHERE {HU} >= 0.2),
test AS (SELECT * FROM reviews WHERE {HU} < 0.2),
{TFIDF_ON('test', 'train')}, {TOPK.replace('{src}', 'test')} SELECT * FROM kw""",
    "t15_sample_keywords": f"""WITH {REVIEWS}, {TFIDF_ON('reviews')}, {TOPK.replace('{src}', 'reviews')},
kl AS (SELECT DOC_ID, list_filter(string_split(keywords, ' '), lambda x: x <> '') AS kws FROM kw),
sz AS (SELECT DOC_ID, kws, ('0x' || substr(md5(concat_ws('|', '42', DOC_ID)), 1, 8))::BIGINT
              % (len(kws) + 1) AS k FROM kl),
pre AS (SELECT DOC_ID, k, unnest(list_slice(kws, 1, k)) AS x FROM sz WHERE k > 0)
SELECT DOC_ID, string_agg(x, ',' ORDER BY md5(concat_ws('|', '42', DOC_ID, x))) AS sampled
FROM pre GROUP BY DOC_ID
UNION ALL SELECT DOC_ID, '' FROM sz WHERE k = 0""",
    "r1_sample_fraction": f"WITH {REVIEWS} SELECT DOC_ID FROM reviews WHERE {HU} < 0.2",
    "r1_sample_exact": f"""WITH {REVIEWS} SELECT DOC_ID FROM reviews
ORDER BY md5(concat_ws('|', '42', DOC_ID)) LIMIT (SELECT CAST(round(0.2 * count(*)) AS BIGINT) FROM reviews)""",
    "r2_train_test_split": f"""WITH {REVIEWS}
SELECT DOC_ID, CASE WHEN {HU} < 0.2 THEN 'test' ELSE 'train' END AS split FROM reviews""",
    "r3_stratified_split": f"""WITH {REVIEWS}
SELECT DOC_ID, LABEL, CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', coalesce(LABEL, '\\N'), DOC_ID)),
  1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS label_split FROM reviews""",
    "j2_complement": f"WITH {REVIEWS} SELECT DOC_ID FROM reviews WHERE NOT ({HU} < 0.2)",
    "s5_write_splits": f"""WITH {REVIEWS}
SELECT DOC_ID, CASE WHEN {HU} < 0.2 THEN 'test' ELSE 'train' END AS split FROM reviews""",
})


# ---------------------------------------------------------------------------
# Phase 3
# ---------------------------------------------------------------------------
def POSNAME(d: str) -> str:
    s = f"CAST({d} AS VARCHAR)"
    return f"('wsj_' || CASE WHEN length({s}) < 4 THEN lpad({s}, 4, '0') ELSE {s} END || '.pos.text')"


NAMES = f"""
posn AS (SELECT {POSNAME('doc_id')} AS name FROM elig),
negn AS (SELECT {POSNAME('doc_id')} || '_' || CAST(n AS VARCHAR) || '_' || CAST(perm_no AS VARCHAR) AS name
         FROM chosen)
"""


def CLASSIFY(src: str) -> str:
    pt, pg = r"^wsj+_\d+\.pos\.text$", r"^wsj+_\d+\.pos\.text\.parsed\.ner\.EGrid$"
    nt, ng = r"^wsj+_\d+\.pos\.text.{k}.*$", r"^wsj+_\d+\.pos\.text\.parsed\.ner\.EGrid.{k}.*$"
    kind = f"CASE WHEN regexp_matches(name, '{pt}') THEN 'pos_text' WHEN regexp_matches(name, '{pg}') THEN 'pos_grid'"
    win = "CASE"
    for k in (1, 2, 3):
        kind += (f" WHEN regexp_matches(name, '{nt.format(k=k)}') THEN 'neg_text'"
                 f" WHEN regexp_matches(name, '{ng.format(k=k)}') THEN 'neg_grid'")
        win += (f" WHEN regexp_matches(name, '{nt.format(k=k)}') OR regexp_matches(name, '{ng.format(k=k)}')"
                f" THEN {k}")
    kind += " END"
    win += " END"
    return f"""(SELECT name, kind, doc_id,
    CASE WHEN starts_with(kind, 'neg') THEN CAST(win AS INTEGER) END AS n_windows,
    CASE WHEN starts_with(kind, 'neg') AND regexp_extract(name, '_(\\d+)$', 1) <> ''
         THEN CAST(regexp_extract(name, '_(\\d+)$', 1) AS INTEGER) END AS perm_no
  FROM (SELECT name, {kind} AS kind, {win} AS win, regexp_extract(name, '^(wsj+_\\d+)', 1) AS doc_id
        FROM {src}))"""


ORACLE.update({
    "r4_first_n_split": f"""WITH RECURSIVE {P8_CTES()}
SELECT doc_id, CASE WHEN doc_id <= (SELECT c FROM cut) THEN 'train' ELSE 'test' END AS split FROM elig""",
    "r5_section_split": f"""WITH n AS (SELECT {POSNAME('doc_id')} AS name FROM documents),
s AS (SELECT name, substr(split_part(name, '.', 1), 5, 2) AS section FROM n)
SELECT name, section, CASE WHEN CAST(section AS INTEGER) <= 13 THEN 'train' ELSE 'test' END AS split
FROM s""",
    "r6_shuffle": f"""WITH {DOCS}
SELECT doc_id, epoch, md5(concat_ws('|', '42', epoch, doc_id)) AS shuffle_key
FROM docs, (SELECT unnest([0, 1]) AS epoch)""",
    "p1_window_starts": f"""WITH {DOCS}
SELECT doc_id, CAST(len(sents) // 3 AS INTEGER) AS n_windows,
       array_to_string(range(0, (len(sents) // 3) * 3, 3), ',') AS starts FROM docs""",
    "p2_all_combinations": f"""WITH RECURSIVE {P8_CTES()},
a AS (SELECT doc_id, M, unnest(range(0, M)) AS a FROM elig),
b AS (SELECT doc_id, a, unnest(range(a + 1, M)) AS b FROM a)
SELECT doc_id, a || ',' || b AS combo,
  concat_ws(',', 3 * a, 3 * a + 1, 3 * a + 2, 3 * b, 3 * b + 1, 3 * b + 2) AS sent_idx FROM b""",
    "p2_one_choice": f"""WITH RECURSIVE {P8_CTES()}
SELECT doc_id, array_to_string([r - c * (c - 1) // 2, c], ',') AS combo
FROM (SELECT doc_id, r, list_max(list_filter(range(1, M), lambda x: x * (x - 1) // 2 <= r)) AS c
      FROM (SELECT doc_id, M, ('0x' || substr(md5(concat_ws('|', '42', doc_id, 2, 0)), 1, 15))::BIGINT % C AS r
            FROM dn WHERE n = 2))""",
    "p3_select_combinations": f"""WITH RECURSIVE {P8_CTES()}
SELECT doc_id, CAST(n AS INTEGER) AS n_windows, CAST(perm_no AS INTEGER) AS perm_no,
       array_to_string(combo, ',') AS combo FROM chosen""",
    "p4_window_orders": f"""WITH RECURSIVE {P8_CTES()},
x AS (SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id, perm, unnest(combo) AS q FROM perms)
SELECT pair_id, q, array_to_string(list_transform(perm[3 * q + 1: 3 * q + 3], lambda v: v - 3 * q), ',')
  AS window_order FROM x""",
    "p5_apply_permutation": f"""WITH RECURSIVE {P8_CTES()}
SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id,
       array_to_string(list_transform(perm, lambda i: sents[i + 1]), chr(10)) AS neg FROM perms""",
    "p7_inverse_order": f"""WITH {DOCS}
SELECT doc_id, array_to_string(list_reverse(sents), chr(10)) AS neg,
  array_to_string(list_reverse(range(0, len(sents))), ',') AS perm,
  array_to_string(list_concat(list_reverse(range(0, len(sents))), range(len(sents), greatest(len(sents), 10))),
                  ',') AS padded_perm FROM docs""",
    "p9_permutation_check": f"""WITH RECURSIVE {P8_CTES()}
SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id,
  CAST(len(pos) = len(neg) AS INTEGER) AS same_length,
  CAST(list_sort(pos) = list_sort(neg) AS INTEGER) AS same_multiset,
  CAST(len(list_filter(range(1, greatest(len(pos), len(neg)) + 1),
                       lambda i: pos[i] IS DISTINCT FROM neg[i])) AS INTEGER) AS n_moved,
  CAST(len(list_distinct(perm)) = len(perm) AND len(list_filter(perm, lambda i: i < 0 OR i >= len(perm))) = 0
       AS INTEGER) AS is_bijection,
  CAST(len(list_filter(range(0, len(perm)), lambda p: perm[p + 1] <> p)) AS INTEGER) AS n_perm_moved
FROM texts WHERE NOT (pos = neg)""",
    "f2_classify_files": f"""WITH RECURSIVE {P8_CTES()}, {NAMES},
files AS (SELECT name FROM posn UNION ALL SELECT name FROM negn
  UNION ALL SELECT replace(name, '.pos.text', '.pos.text.parsed.ner.EGrid') FROM posn
  UNION ALL SELECT replace(name, '.pos.text', '.pos.text.parsed.ner.EGrid') FROM negn)
SELECT * FROM {CLASSIFY('files')}""",
    "j1_pair_pos_neg": f"""WITH RECURSIVE {P8_CTES()}, {NAMES},
p AS (SELECT doc_id, name FROM {CLASSIFY('posn')}),
q AS (SELECT doc_id, name, n_windows, perm_no FROM {CLASSIFY('negn')})
SELECT p.name AS pos_name, q.name AS neg_name, q.n_windows, q.perm_no FROM p JOIN q USING (doc_id)""",
    "j5_align_order": f"""WITH RECURSIVE {P8_CTES()},
pr AS (SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id, pos, neg FROM texts WHERE NOT (pos = neg)),
pl AS (SELECT pair_id, unnest(range(0, len(pos))) AS src, unnest(pos) AS sentence FROM pr),
nl AS (SELECT pair_id, unnest(range(0, len(neg))) AS dst, unnest(neg) AS sentence FROM pr),
plo AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sentence ORDER BY src) AS occ FROM pl),
nlo AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sentence ORDER BY dst) AS occ FROM nl)
SELECT nlo.pair_id, string_agg(CAST(plo.src AS VARCHAR), ',' ORDER BY nlo.dst) AS "order"
FROM nlo LEFT JOIN plo USING (pair_id, sentence, occ) GROUP BY nlo.pair_id""",
    "j5_align_order_first": f"""WITH RECURSIVE {P8_CTES()},
pr AS (SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id, pos, neg FROM texts WHERE NOT (pos = neg)),
pl AS (SELECT pair_id, unnest(range(0, len(pos))) AS src, unnest(pos) AS sentence FROM pr),
nl AS (SELECT pair_id, unnest(range(0, len(neg))) AS dst, unnest(neg) AS sentence FROM pr),
f AS (SELECT pair_id, sentence, min(src) AS src FROM pl GROUP BY pair_id, sentence)
SELECT nl.pair_id, string_agg(CAST(f.src AS VARCHAR), ',' ORDER BY nl.dst) AS "order"
FROM nl LEFT JOIN f USING (pair_id, sentence) GROUP BY nl.pair_id""",
    "j5_align_order_reference": f"""WITH RECURSIVE {P8_CTES()},
pr AS (SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id, pos, neg FROM texts WHERE NOT (pos = neg)),
pl AS (SELECT pair_id, unnest(range(0, len(pos))) AS src, unnest(pos) AS sentence FROM pr),
nl AS (SELECT pair_id, unnest(range(0, len(neg))) AS dst, unnest(neg) AS sentence FROM pr),
same AS (SELECT nl.*, pl.src IS NOT NULL AS stays FROM nl LEFT JOIN pl
         ON pl.pair_id = nl.pair_id AND pl.src = nl.dst AND pl.sentence = nl.sentence),
plo AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sentence ORDER BY src) AS occ FROM pl),
nlo AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sentence ORDER BY dst) AS occ FROM same WHERE NOT stays),
o AS (SELECT pair_id, dst, dst AS src FROM same WHERE stays
      UNION ALL SELECT pair_id, nlo.dst, plo.src FROM nlo LEFT JOIN plo USING (pair_id, sentence, occ)
      UNION ALL SELECT pair_id, unnest(range(len(neg), 12)) AS dst, unnest(range(len(neg), 12)) AS src FROM pr)
SELECT pair_id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY dst) AS "order" FROM o GROUP BY pair_id""",
    "f4_identical_pairs": f"""WITH RECURSIVE {P8_CTES()}
SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id FROM perms
WHERE list_transform(perm, lambda i: sents[i + 1]) = sents""",
    "s4_write_pairs": f"""WITH RECURSIVE {P8_CTES()}
SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id, split, CAST(n AS INTEGER) AS n_windows,
       array_to_string(perm, ',') AS perm, array_to_string(neg, chr(10)) AS neg
FROM texts WHERE NOT (pos = neg)""",
    "a4_dataset_info": f"""WITH RECURSIVE {P8_CTES()}, {NAMES},
cls AS (SELECT * FROM {CLASSIFY('(SELECT name FROM posn UNION ALL SELECT name FROM negn)')}),
j AS (SELECT cls.*, CASE WHEN e.doc_id <= (SELECT c FROM cut) THEN 'train' ELSE 'test' END AS split
      FROM cls JOIN elig e ON regexp_extract(cls.doc_id, '_0*(\\d+)$', 1) = e.doc_id)
SELECT split, kind, n_windows, count(*) AS n_files FROM j GROUP BY ROLLUP (split, kind, n_windows)""",
    "u1_missing_counterparts": f"""WITH RECURSIVE {P8_CTES()}
SELECT {POSNAME('doc_id')} AS stem FROM documents
EXCEPT SELECT {POSNAME('doc_id')} FROM elig""",
    "u3_distinct_stems": f"""WITH RECURSIVE {P8_CTES()}, {NAMES}
SELECT DISTINCT regexp_replace(name, '_\\d+_\\d+$', '') AS stem FROM negn""",
})


# ---------------------------------------------------------------------------
# Phase 4
# ---------------------------------------------------------------------------
def WSET(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"


def SCORE_CTES(src: str, keys: str, sents: str, prefix: str = "sc") -> str:
    """window scores of ``sents`` of every row of ``src`` -> ``{prefix}_win``
    (keys, win_idx, score, feat_mean) and ``{prefix}_doc`` (keys, doc_score)."""
    return f"""
{prefix}_sets AS (SELECT {keys}, list_transform({sents}, lambda s: {WSET('s')}) AS T FROM {src}),
{prefix}_sims AS (SELECT {keys}, list_transform(range(0, greatest(len(T) - 1, 0)), lambda i:
    CASE WHEN len(T[i + 2]) = 0 THEN 0.0 ELSE len(list_intersect(T[i + 1], T[i + 2])) / len(T[i + 2]) END)
    AS sims FROM {prefix}_sets),
{prefix}_g AS (SELECT {keys}, sims, coalesce(list_avg(list_transform(range(0, len(sims)), lambda i:
    list_avg(sims[greatest(i - 2, 0) + 1 : least(i + 2, len(sims) - 1) + 1]))), 0.0) AS g FROM {prefix}_sims),
{prefix}_win AS (SELECT {keys}, CAST(win_idx AS INTEGER) AS win_idx,
    sims[win_idx + 1] + sims[win_idx + 2] + g AS score, (sims[win_idx + 1] + sims[win_idx + 2]) / 2.0 AS feat_mean
    FROM (SELECT {keys}, sims, g, unnest(range(0, greatest(len(sims) - 1, 0))) AS win_idx FROM {prefix}_g)),
{prefix}_doc AS (SELECT {keys}, coalesce((SELECT sum(score) FROM {prefix}_win w WHERE {' AND '.join(f'w.{k.strip()} = d.{k.strip()}' for k in keys.split(','))}), 0.0)
    AS doc_score FROM {prefix}_sets d)
"""


PAIRS_OK = "pairs AS (SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id, doc_id, split, n AS n_windows, perm, pos, neg FROM texts WHERE NOT (pos = neg))"
INV = "ipairs AS (SELECT pair_id, doc_id, split, n_windows, pos, list_reverse(pos) AS neg FROM pairs)"


def EVAL(task: str) -> str:
    src = "pairs" if task == "std" else "ipairs"
    extra = f", {INV}" if task == "inv" else ""
    return f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}{extra},
{SCORE_CTES(src, 'pair_id', 'pos', 'ps')}, {SCORE_CTES(src, 'pair_id', 'neg', 'ns')},
j AS (SELECT p.pair_id, p.n_windows, round(ps_doc.doc_score, 9) > round(ns_doc.doc_score, 9) AS win
      FROM {src} p JOIN ps_doc USING (pair_id) JOIN ns_doc USING (pair_id))
SELECT '{task}' AS task, n_windows, count(*) AS n_pairs, round(avg(CAST(win AS DOUBLE)), 6) AS accuracy
FROM j GROUP BY ROLLUP (n_windows)"""


GRID = """
gws AS (SELECT doc_id, CAST(unnest(range(len(sents))) AS INTEGER) AS sent_idx,
        unnest(list_transform(sents, lambda s: list_distinct(regexp_extract_all(s, '\\p{Lu}[\\p{L}\\p{N}_]*'))))
        AS ws FROM docs),
grid AS (SELECT doc_id, unnest(ws) AS entity, sent_idx, 'X' AS role FROM gws)
"""

NEG_GRID = """
pp AS (SELECT pair_id, doc_id, CAST(unnest(range(len(perm))) AS INTEGER) AS dst, unnest(perm) AS src FROM pairs),
ngrid AS (SELECT pp.pair_id, pp.doc_id, g.entity, pp.dst AS sent_idx, g.role
          FROM pp JOIN grid g ON g.doc_id = pp.doc_id AND g.sent_idx = pp.src)
"""


def RECOVER(mode: str) -> str:
    sig = "md5(array_to_string(list_sort(list(entity || '|' || role)), ' '))"
    if mode == "first":
        match = """m AS (SELECT n.pair_id, p.sent_idx AS pos_idx, min(n.sent_idx) AS neg_idx
               FROM nsig n JOIN psig p ON p.doc_id = n.doc_id AND p.sig = n.sig GROUP BY n.pair_id, p.sent_idx)"""
    else:
        match = """po AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sig ORDER BY sent_idx) AS occ FROM psig),
no AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sig ORDER BY sent_idx) AS occ FROM nsig),
m AS (SELECT no.pair_id, po.sent_idx AS pos_idx, no.sent_idx AS neg_idx
      FROM no JOIN po ON po.doc_id = no.doc_id AND po.sig = no.sig AND po.occ = no.occ)"""
    return f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {GRID}, {NEG_GRID},
pcols AS (SELECT doc_id, CAST(unnest(range(len(sents))) AS INTEGER) AS sent_idx FROM docs),
pcell AS (SELECT doc_id, sent_idx, {sig} AS sig FROM grid GROUP BY doc_id, sent_idx),
psig AS (SELECT c.doc_id, c.sent_idx, coalesce(s.sig, md5('')) AS sig FROM pcols c
         LEFT JOIN pcell s USING (doc_id, sent_idx)),
ncols AS (SELECT p.pair_id, p.doc_id, CAST(unnest(range(len(d.sents))) AS INTEGER) AS sent_idx
          FROM pairs p JOIN docs d USING (doc_id)),
ncell AS (SELECT pair_id, doc_id, sent_idx, {sig} AS sig FROM ngrid GROUP BY pair_id, doc_id, sent_idx),
nsig AS (SELECT c.pair_id, c.doc_id, c.sent_idx, coalesce(s.sig, md5('')) AS sig FROM ncols c
         LEFT JOIN ncell s USING (pair_id, doc_id, sent_idx)),
{match}
SELECT pair_id, string_agg(CAST(neg_idx AS VARCHAR), ',' ORDER BY pos_idx) AS perm_idx FROM m GROUP BY pair_id"""


ORACLE.update({
    "w1_adjacent_pairs": f"""WITH {DOCS}, {SENTS}
SELECT doc_id, sent_idx, sentence,
       coalesce(lead(sentence) OVER (PARTITION BY doc_id ORDER BY sent_idx), sentence) AS next_sentence
FROM sents""",
    "w2_score_windows": f"""WITH {DOCS}
SELECT doc_id, CAST(greatest(len(sents) - 2, 0) AS INTEGER) AS n_valid_windows FROM docs""",
    "w3_neighbour_context": f"""WITH {DOCS}, {SENTS}
SELECT doc_id, sent_idx, round(avg(len({WSET('sentence')})) OVER (PARTITION BY doc_id ORDER BY sent_idx
  ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS ctx FROM sents""",
    "m1_coherence_scores": f"""WITH {DOCS}, {SCORE_CTES('docs', 'doc_id', 'sents')}
SELECT doc_id, win_idx, round(score, 6) AS score, round(feat_mean, 6) AS feat_mean FROM sc_win""",
    "m1_coherence_scores_long": f"""WITH {DOCS}, {SCORE_CTES('docs', 'doc_id', 'sents')}
SELECT doc_id, win_idx, round(score, 6) AS score, round(feat_mean, 6) AS feat_mean FROM sc_win""",
    "a6_document_score": f"""WITH {DOCS}, {SCORE_CTES('docs', 'doc_id', 'sents')}
SELECT doc_id, round(doc_score, 6) AS doc_score FROM sc_doc""",
    "m4_evaluate_std": EVAL("std"),
    "m4_evaluate_inv": EVAL("inv"),
    "a5_pairwise_accuracy": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK},
{SCORE_CTES('pairs', 'pair_id', 'pos', 'ps')}, {SCORE_CTES('pairs', 'pair_id', 'neg', 'ns')},
j AS (SELECT p.split, round(ps_doc.doc_score, 9) > round(ns_doc.doc_score, 9) AS win
      FROM pairs p JOIN ps_doc USING (pair_id) JOIN ns_doc USING (pair_id))
SELECT split, count(*) AS n_pairs, round(avg(CAST(win AS DOUBLE)), 6) AS accuracy FROM j GROUP BY split""",
    "a7_adaptive_loss": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK},
{SCORE_CTES('pairs', 'pair_id', 'pos', 'ps')}, {SCORE_CTES('pairs', 'pair_id', 'neg', 'ns')},
j AS (SELECT p.split, a.score AS ps, a.feat_mean AS pf, b.score AS ns, b.feat_mean AS nf
      FROM ps_win a JOIN ns_win b USING (pair_id, win_idx) JOIN pairs p USING (pair_id)),
t AS (SELECT split, CAST(pf IS DISTINCT FROM nf AS DOUBLE) AS m, ps, ns FROM j)
SELECT split, round(avg(greatest(0.0, 5.0 * m + ns * m - ps * m)), 6) AS loss, count(*) AS n_windows
FROM t GROUP BY split""",
    "j9_reorder_features": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {SENTS},
o AS (SELECT pair_id, doc_id, CAST(unnest(range(len(perm))) AS INTEGER) AS dst, CAST(unnest(perm) AS INTEGER) AS src
      FROM pairs)
SELECT o.pair_id, o.dst, o.src, CAST(len({WSET('s.sentence')}) AS INTEGER) AS n_words
FROM o JOIN sents s ON s.doc_id = o.doc_id AND s.sent_idx = o.src""",
    "s7_entity_grid": f"WITH {DOCS}, {GRID} SELECT doc_id, entity, sent_idx, role FROM grid",
    "j6_join_text_grid": f"""WITH RECURSIVE {P8_CTES()}
SELECT {POSNAME('e.doc_id')} AS name, CAST(e.L AS INTEGER) AS n_sents, CAST(len(d.sents) AS INTEGER) AS n_cols
FROM elig e JOIN docs d USING (doc_id)
WHERE len(list_filter(d.sents, lambda s: len(regexp_extract_all(s, '\\p{{Lu}}[\\p{{L}}\\p{{N}}_]*')) > 0)) > 0""",
    "p6_apply_permutation_grid": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {GRID}, {NEG_GRID}
SELECT pair_id, count(*) AS n_cells,
       md5(array_to_string(list_sort(list(entity || '|' || CAST(sent_idx AS VARCHAR) || '|' || role)), ' '))
       AS cells_md5 FROM ngrid GROUP BY pair_id""",
    "j4_recover_permutation": RECOVER("first"),
    "j4_recover_permutation_bijective": RECOVER("bijective"),
})


# ---------------------------------------------------------------------------
# Phase 5
# ---------------------------------------------------------------------------
BATCHES = """
bi AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '2022', 0, pair_id))) - 1 AS i FROM pairs),
ball AS (SELECT *, i // 32 AS batch_id, CAST(i % 32 AS INTEGER) AS pos_in_batch FROM bi),
bat AS (SELECT * FROM ball WHERE i < ((SELECT count(*) FROM pairs) // 32) * 32)
"""

ENC = f"""
vtoks AS (SELECT * FROM toks),
{VOCAB('vtoks')},
enc AS (SELECT t.doc_id, t.sent_idx, t.tok_idx, coalesce(v.idx, (SELECT idx FROM vocab WHERE word = '<unk>')) AS idx
        FROM toks t LEFT JOIN vocab v USING (word)),
sids AS (SELECT doc_id, sent_idx, list(idx ORDER BY tok_idx) AS ids FROM enc GROUP BY doc_id, sent_idx),
dids AS (SELECT doc_id, flatten(list(ids ORDER BY sent_idx)) AS ids FROM sids GROUP BY doc_id),
padid AS (SELECT idx AS pad FROM vocab WHERE word = '<pad>'),
pt AS (SELECT doc_id, list_concat(ids[1:768], list_transform(range(0, 768 - len(ids[1:768])), lambda x: pad))
         AS input_ids, list_concat(list_transform(range(0, len(ids[1:768])), lambda x: 1),
                                   list_transform(range(0, 768 - len(ids[1:768])), lambda x: 0)) AS attention_mask
       FROM dids, padid)
"""

LMENC = f"""
{VOCAB('toks')},
ext AS (SELECT * FROM vocab
        UNION ALL SELECT (SELECT max(idx) + 1 FROM vocab), '<bos>', 0
        UNION ALL SELECT (SELECT max(idx) + 2 FROM vocab), '<eos>', 0),
lmv AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, word FROM ext WHERE word <> '<pad>'),
lenc AS (SELECT t.doc_id, t.sent_idx, t.tok_idx, coalesce(v.idx, (SELECT idx FROM lmv WHERE word = '<unk>')) AS idx
         FROM toks t LEFT JOIN lmv v USING (word)),
lids AS (SELECT doc_id, sent_idx, list(idx ORDER BY tok_idx) AS ids FROM lenc GROUP BY doc_id, sent_idx),
bos AS (SELECT idx AS b FROM lmv WHERE word = '<bos>'),
eos AS (SELECT idx AS e FROM lmv WHERE word = '<eos>')
"""

def FALLBACK(d: str) -> str:
    u = "('0x' || substr(md5(concat_ws('|', '42', word, {}, {})), 1, 8))::BIGINT"
    return (f"CAST(0.6 * sqrt(-2.0 * ln(({u.format(d, 1)} + 1.0) / (4294967296.0 + 1.0)))"
            f" * cos(2 * pi() * ({u.format(d, 2)} / 4294967296.0)) AS FLOAT)")


# every vocabulary word's vector, found or fallback
WORDVEC = f"""
vec AS (SELECT v.word, e.embedding AS vec FROM vocab v JOIN embeddings e ON v.idx = e.vec_id),
wordvec AS (SELECT v.idx, v.word, CAST(x.vec IS NOT NULL AS INTEGER) AS found,
                   coalesce(x.vec, list_transform(range(0, 64), lambda d: {FALLBACK('d').replace('word', 'v.word')})) AS vec
            FROM vocab v LEFT JOIN vec x USING (word))
"""

ORACLE.update({
    "b1_minibatches": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {BATCHES}
SELECT pair_id, batch_id, pos_in_batch FROM bat""",
    "b2_pad_documents": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {BATCHES},
b AS (SELECT *, max(len(pos)) OVER (PARTITION BY batch_id) AS need FROM bat)
SELECT pair_id, batch_id, CAST(greatest(need, len(pos)) AS INTEGER) AS n_pos,
       CAST(len(neg) + greatest(need - len(neg), 0) AS INTEGER) AS n_neg,
       CAST(len(list_filter(neg, lambda s: s = '<pad>')) + greatest(need - len(neg), 0) AS INTEGER) AS n_neg_pads
FROM b""",
    "b3_pad_sentences": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {BATCHES},
b AS (SELECT pair_id, batch_id, 'pos' AS side, list_transform(pos, lambda s: {WS('s')}) AS tk FROM bat
      UNION ALL SELECT pair_id, batch_id, 'neg', list_transform(neg, lambda s: {WS('s')}) FROM bat),
m AS (SELECT *, max(list_max(list_transform(tk, lambda t: len(t)))) OVER (PARTITION BY batch_id, side) AS mx FROM b)
SELECT pair_id, side, CAST(mx AS INTEGER) AS padded_len,
  CAST(list_sum(list_transform(tk, lambda t: len(list_filter(t, lambda x: x = '<pad>')) + mx - len(t))) AS INTEGER)
    AS n_pads FROM m""",
    "b4_sentence_steps": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {BATCHES}
SELECT batch_id, CAST(unnest(range(0, len(pos))) AS INTEGER) AS sent_idx, pair_id, unnest(pos) AS pos_s,
       unnest(neg) AS neg_s FROM bat""",
    "b5_fill_batch": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {BATCHES},
cnt AS (SELECT batch_id, count(*) AS n, CAST(greatest(max(len(pos)), max(len(neg))) AS INTEGER) AS m FROM ball GROUP BY batch_id)
SELECT batch_id, pos_in_batch, pair_id, CAST(len(pos) AS INTEGER) AS n_pos FROM ball
UNION ALL SELECT batch_id, CAST(unnest(range(n, 32)) AS INTEGER), NULL, m FROM cnt WHERE n < 32""",
    "b7_unpair": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}
SELECT pair_id, 'pos' AS side, CAST(len(pos) AS INTEGER) AS n_sents, md5(array_to_string(pos, chr(10))) AS text_md5 FROM pairs
UNION ALL SELECT pair_id, 'neg', CAST(len(neg) AS INTEGER), md5(array_to_string(neg, chr(10))) FROM pairs""",
    "t10_sentence_lengths": f"""WITH {DOCS},
l AS (SELECT doc_id, list_transform(sents, lambda s: CAST(len({WS('s')}) AS INTEGER)) AS lens FROM docs)
SELECT doc_id, array_to_string(lens, ',') AS lengths,
  array_to_string(list_concat(lens, list_transform(range(0, 20), lambda x: 1))[1:20], ',') AS padded FROM l""",
    "t12_pad_truncate": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {ENC}
SELECT doc_id, array_to_string(input_ids, ',') AS input_ids, array_to_string(attention_mask, ',') AS attention_mask
FROM pt""",
    "t13_lm_targets": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {LMENC}
SELECT doc_id, sent_idx, array_to_string(list_concat(ids[2:], [(SELECT e FROM eos)]), ',') AS forward,
       array_to_string(list_concat([(SELECT b FROM bos)], ids[1:len(ids) - 1]), ',') AS backward FROM lids""",
    "t14_shift_targets": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {ENC}
SELECT doc_id, CAST(len(input_ids) - 1 AS INTEGER) AS n_in,
  CAST(len(list_filter(input_ids[2:], lambda v: v <> pad)) AS INTEGER) AS ntokens,
  md5(array_to_string(input_ids[2:], ',')) AS trg_out_md5 FROM pt, padid""",
    "k3_sort_by_length": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {BATCHES}
SELECT pair_id, batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY len(pos) DESC, pair_id) - 1 AS INTEGER)
  AS len_rank FROM bat""",
    "j7_lookup_vectors": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {VOCAB('toks')}, {WORDVEC}
SELECT idx, word, found, CAST(len(vec) AS INTEGER) AS dim,
  CAST(list_sum(list_transform(range(1, len(vec) + 1), lambda i: i * CAST(round(CAST(vec[i] AS DOUBLE) * 10000) AS BIGINT))) AS BIGINT)
    AS checksum FROM wordvec""",
    "a10_embedding_coverage": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {VOCAB('toks')},
vec AS (SELECT v.word FROM vocab v JOIN embeddings e ON v.idx = e.vec_id)
SELECT count(*) AS n_words, count(x.word) AS n_found, round(count(x.word) / count(*), 6) AS coverage
FROM vocab v LEFT JOIN vec x USING (word)""",
    "a11_bidirectional_nll": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {LMENC},
occ AS (
  SELECT doc_id, 'f' AS dir, unnest(ids) AS ctx, unnest(list_concat(ids[2:], [(SELECT e FROM eos)])) AS tgt FROM lids
  UNION ALL
  SELECT doc_id, 'b', unnest(ids), unnest(list_concat([(SELECT b FROM bos)], ids[1:len(ids) - 1])) FROM lids),
big AS (SELECT dir, ctx, tgt, count(*) AS c FROM occ GROUP BY ALL),
cx AS (SELECT dir, ctx, count(*) AS cc FROM occ GROUP BY ALL),
j AS (SELECT o.doc_id, o.dir, -ln((b.c + 1.0) / (x.cc + (SELECT count(*) FROM lmv))) AS nll
      FROM occ o JOIN big b USING (dir, ctx, tgt) JOIN cx x USING (dir, ctx)),
per AS (SELECT doc_id, avg(CASE WHEN dir = 'f' THEN nll END) AS f, avg(CASE WHEN dir = 'b' THEN nll END) AS b
        FROM j GROUP BY doc_id)
SELECT doc_id, round(f, 6) AS nll_forward, round(b, 6) AS nll_backward, round(1.0 * (f + b), 6) AS lm_loss FROM per""",
})


# ---------------------------------------------------------------------------
# Phase 6
# ---------------------------------------------------------------------------
TERMS_RE = "'[\\p{L}\\p{N}_]{2,}'"

POOL = f"""
pool AS (SELECT CAST(item_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) AS cand_id, s AS candidate
         FROM (SELECT item_id, unnest(range(len(ss))) AS i, unnest(ss) AS s
               FROM (SELECT item_id, {SPLIT_SENTS('text')} AS ss FROM benchmark))),
ptt AS (SELECT cand_id, unnest(regexp_extract_all(lower(candidate), {TERMS_RE})) AS term FROM pool),
ptf AS (SELECT cand_id, term, count(*) AS tf FROM ptt WHERE NOT list_contains({STOP_SQL}, term) GROUP BY ALL),
pn AS (SELECT count(*) AS n FROM pool),
pdf AS (SELECT term, count(*) AS df FROM ptf GROUP BY term),
pidf AS (SELECT term, ln((1.0 + n) / (df + 1.0)) + 1.0 AS idf FROM pdf, pn),
cw0 AS (SELECT cand_id, term, tf * idf AS w FROM ptf JOIN pidf USING (term)),
cwt AS (SELECT cand_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cand_id)) AS cw FROM cw0),
fall AS (SELECT cand_id, row_number() OVER (ORDER BY cand_id) AS cand_no FROM pool QUALIFY cand_no <= 5)
"""


def RETRIEVE_ON(g: str, p: str = "") -> str:
    """Candidates (``{p}topc``, ``{p}cands``), ranks and best of the gaps in ``g``."""
    return f"""
{p}gtt AS (SELECT gap_id, unnest(regexp_extract_all(lower(gap_text), {TERMS_RE})) AS term FROM {g}),
{p}gtf AS (SELECT gap_id, term, count(*) AS tf FROM {p}gtt WHERE NOT list_contains({STOP_SQL}, term) GROUP BY ALL),
{p}gw0 AS (SELECT gap_id, term, tf * idf AS w FROM {p}gtf JOIN pidf USING (term)),
{p}gwt AS (SELECT gap_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY gap_id)) AS gw FROM {p}gw0),
{p}sc AS (SELECT gap_id, cand_id, max(gw * cw) AS score_max, sum(gw * cw) AS score_sum
       FROM {p}gwt JOIN cwt USING (term) GROUP BY gap_id, cand_id),
{p}met AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY score_max DESC, cand_id) AS cand_no
                        FROM {p}sc) WHERE cand_no <= 5),
{p}topc AS (SELECT gap_id, cand_id, score_max, score_sum, cand_no FROM {p}met
  UNION ALL SELECT gap_id, cand_id, 0.0, 0.0, cand_no FROM {g}, fall WHERE gap_id NOT IN (SELECT gap_id FROM {p}met)),
{p}cands AS (SELECT t.*, p.candidate, g.first, g.last, [g.first, p.candidate, g.last] AS doc3
          FROM {p}topc t JOIN pool p USING (cand_id) JOIN {g} g USING (gap_id))
"""


GAPS = """
gaps AS (SELECT doc_id AS gap_id, sents[1] AS first, sents[-1] AS last,
                concat_ws(' ', sents[1], sents[-1]) AS gap_text FROM elig)
"""
RETRIEVE = f"{POOL}, {GAPS}, {RETRIEVE_ON('gaps')}"


def RANKED_ON(p: str = "") -> str:
    return f"""
{SCORE_CTES(p + 'cands', 'gap_id, cand_no', 'doc3', p + 'rk')},
{p}ranked AS (SELECT c.*, r.doc_score AS rank_score FROM {p}cands c JOIN {p}rk_doc r USING (gap_id, cand_no)),
{p}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY round(rank_score, 9) DESC, cand_no)
                        AS rr FROM {p}ranked) WHERE rr = 1)
"""


RANKED = RANKED_ON()

TLOG = """
tlog AS (SELECT CAST(user_id AS VARCHAR) AS run, dayofmonth(ts) - 1 + hour(ts) / 24.0 AS epoch, event_id AS step,
                CASE WHEN event_type <> 'view' THEN value END AS loss,
                CASE WHEN event_type = 'view' THEN value END AS eval_loss,
                CAST(json_extract_string(props, '$.k') AS BIGINT) AS ntokens, value AS elapsed FROM events)
"""

ORACLE.update({
    "j8_retrieve_candidates": f"""WITH RECURSIVE {P8_CTES()}, {RETRIEVE}
SELECT gap_id, CAST(cand_no AS INTEGER) AS cand_no, cand_id, round(score_max, 6) AS score_max,
       round(score_sum, 6) AS score_sum FROM topc""",
    "m5_rank_candidates": f"""WITH RECURSIVE {P8_CTES()}, {RETRIEVE}, {RANKED}
SELECT gap_id, CAST(cand_no AS INTEGER) AS cand_no, round(rank_score, 6) AS rank_score FROM ranked""",
    "k5_best_candidate": f"""WITH RECURSIVE {P8_CTES()}, {RETRIEVE}, {RANKED}
SELECT gap_id, CAST(cand_no AS INTEGER) AS cand_no, cand_id, round(rank_score, 6) AS rank_score FROM best""",
    "m6_infill_one_round": f"""WITH RECURSIVE {P8_CTES()}, {RETRIEVE}, {RANKED}
SELECT gap_id AS story_id, 0 AS pos, first AS sentence FROM gaps
UNION ALL SELECT gap_id, 1, candidate FROM best UNION ALL SELECT gap_id, 2, last FROM gaps""",
    "m6_infill_story": f"""WITH RECURSIVE {P8_CTES()}, {RETRIEVE}, {RANKED},
one AS (SELECT g.gap_id AS story_id, g.first AS a, b.candidate AS b, g.last AS c FROM gaps g JOIN best b USING (gap_id)),
gaps2 AS (SELECT story_id || '|0' AS gap_id, a AS first, b AS last, concat_ws(' ', a, b) AS gap_text FROM one
          UNION ALL SELECT story_id || '|1', b, c, concat_ws(' ', b, c) FROM one),
{RETRIEVE_ON('gaps2', 's')}, {RANKED_ON('s')}
SELECT story_id, 0 AS pos, a AS sentence FROM one UNION ALL SELECT story_id, 2, b FROM one
UNION ALL SELECT story_id, 4, c FROM one
UNION ALL SELECT split_part(gap_id, '|', 1), CASE split_part(gap_id, '|', 2) WHEN '0' THEN 1 ELSE 3 END, candidate FROM sbest""",
    "s9_read_training_log": f"""WITH {TLOG}
SELECT run, step, round(epoch, 6) AS epoch, loss, eval_loss FROM tlog""",
    "a8_weighted_epoch_loss": f"""WITH {TLOG}
SELECT run, round(sum(coalesce(loss, eval_loss)) / sum(ntokens), 6) AS loss_per_token,
       round(sum(ntokens) / sum(elapsed), 6) AS tokens_per_sec, count(*) AS n_batches FROM tlog GROUP BY run""",
    "w4_running_best": f"""WITH {TLOG}, ev AS (SELECT * FROM tlog WHERE eval_loss IS NOT NULL),
b AS (SELECT run, step, eval_loss, coalesce(min(eval_loss) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS bb FROM ev)
SELECT run, step, round(bb, 6) AS best_before, CAST(eval_loss < bb AS INTEGER) AS improved FROM b""",
    "k4_best_checkpoint": f"""WITH {TLOG},
r AS (SELECT run, step, eval_loss, row_number() OVER (PARTITION BY run ORDER BY eval_loss, step) AS rn
      FROM tlog WHERE eval_loss IS NOT NULL)
SELECT run, step AS best_step, eval_loss AS best_eval_loss FROM r WHERE rn = 1""",
})


# ---------------------------------------------------------------------------
# Phase 7
# ---------------------------------------------------------------------------
ORACLE.update({
    "st1_stream_keywords": ORACLE["k2_transform_keywords"],
    "st2_stream_scores": f"""WITH {DOCS}, {SCORE_CTES('docs', 'doc_id', 'sents')}
SELECT d.doc_id, round(s.doc_score, 6) AS doc_score, CAST(len(d.sents) AS INTEGER) AS n_sents
FROM docs d JOIN sc_doc s USING (doc_id)""",
    "st3_stream_accuracy": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK},
{SCORE_CTES('pairs', 'pair_id', 'pos', 'ps')}, {SCORE_CTES('pairs', 'pair_id', 'neg', 'ns')},
j AS (SELECT p.n_windows, round(ps_doc.doc_score, 9) > round(ns_doc.doc_score, 9) AS win
      FROM pairs p JOIN ps_doc USING (pair_id) JOIN ns_doc USING (pair_id))
SELECT CAST(n_windows AS INTEGER) AS n_windows, count(*) AS n_pairs, CAST(sum(CAST(win AS BIGINT)) AS BIGINT) AS n_correct,
       round(sum(CAST(win AS BIGINT)) / count(*), 6) AS accuracy FROM j GROUP BY n_windows""",
    "s2_read_corpus": f"""WITH {DOCS}
SELECT doc_id, CAST(len(sents) AS INTEGER) AS n_lines, md5(array_to_string(sents, chr(10))) AS text_md5 FROM docs""",
    "s3_read_manifest": f"""WITH RECURSIVE {P8_CTES()},
tr AS (SELECT doc_id FROM elig WHERE doc_id <= (SELECT c FROM cut))
SELECT {POSNAME('doc_id')} AS name FROM tr
UNION ALL SELECT {POSNAME('c.doc_id')} || '-' || CAST((c.n - 1) * 20 + c.perm_no AS VARCHAR)
FROM chosen c JOIN tr USING (doc_id) WHERE (c.n - 1) * 20 + c.perm_no <= 40""",
    "s10_read_marketplace_reviews": r"""SELECT 'R' || CAST(d.doc_id AS VARCHAR) AS DOC_ID,
  CAST(coalesce(l.quality, 0) * 4 + 1 AS INTEGER) AS RATING, d.source AS REVIEW_TITLE,
  md5(regexp_replace(replace(d.text, chr(9), ' '), '\r\n|\r|\n', '<br />', 'g')) AS text_md5, '2015-08-31' AS review_date
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
})


ORACLE.update({
    "s8_read_request_log": """SELECT role AS product_title, text AS review_text,
  CAST(turn * 10 + 50 AS INTEGER) AS max_len, CAST(turn % 3 + 1 AS INTEGER) AS n_sequences, CAST(NULL AS VARCHAR) AS output,
  CAST(NULL AS VARCHAR) AS flag, 'u' || CAST(conv_id AS VARCHAR) AS username, '2021-11-30 10:00:00' AS ts FROM conversations""",
    "m3_score_batches": f"""WITH {DOCS},
w AS (SELECT doc_id, len(sents) AS m, {WS("lower(array_to_string(sents, ' '))")} AS ws FROM docs)
SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_distinct(ws)) / len(ws) END AS type_token_ratio,
       CASE WHEN m = 0 THEN 0.0 ELSE len(ws) / m END AS mean_sentence_len FROM w""",
    "m2_vector_coherence": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {VOCAB('toks')}, {WORDVEC},
comp AS (SELECT word, unnest(range(0, 64)) AS d, CAST(unnest(vec) AS DOUBLE) AS x FROM wordvec),
sv AS (SELECT doc_id, sent_idx, d, avg(x) AS x FROM toks JOIN comp USING (word) GROUP BY ALL),
od AS (SELECT doc_id, sent_idx, lead(sent_idx) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS nx
       FROM (SELECT DISTINCT doc_id, sent_idx FROM sv)),
cs AS (SELECT a.doc_id, a.sent_idx, sum(a.x * b.x) AS ab, sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb
       FROM od JOIN sv a ON a.doc_id = od.doc_id AND a.sent_idx = od.sent_idx
       JOIN sv b ON b.doc_id = od.doc_id AND b.sent_idx = od.nx AND b.d = a.d GROUP BY ALL)
SELECT doc_id, count(*) AS n_pairs, round(avg(CASE WHEN aa = 0 OR bb = 0 THEN 0.0 ELSE ab / (sqrt(aa) * sqrt(bb)) END), 6) AS score
FROM cs GROUP BY doc_id""",
    "b6_token_budget_batches": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK},
ln AS (SELECT pair_id, list_sum(list_transform(pos, lambda s: len({WS('s')}))) AS s,
              list_sum(list_transform(neg, lambda s: len({WS('s')}))) AS t FROM pairs),
sh AS (SELECT pair_id, CAST(coalesce(s, 0) AS BIGINT) AS s, CAST(coalesce(t, 0) AS BIGINT) AS t,
              ('0x' || substr(md5(concat_ws('|', '0', pair_id)), 1, 8))::BIGINT % 8 AS shard FROM ln),
rn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY s, t, pair_id) AS i FROM sh),
-- state after each row: its batch, and the open batch's number, size and two longest lengths
go AS (
  SELECT DISTINCT shard, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS pair_id, CAST(0 AS BIGINT) AS mine, CAST(0 AS BIGINT) AS b,
         CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS ms, CAST(0 AS BIGINT) AS mt FROM rn
  UNION ALL
  SELECT shard, i, pair_id, mine, CASE WHEN c2 * greatest(ms2, mt2) = 4000 THEN mine + 1 ELSE mine END,
         CASE WHEN c2 * greatest(ms2, mt2) = 4000 THEN 0 ELSE c2 END, CASE WHEN c2 * greatest(ms2, mt2) = 4000 THEN 0 ELSE ms2 END,
         CASE WHEN c2 * greatest(ms2, mt2) = 4000 THEN 0 ELSE mt2 END
  FROM (SELECT r.shard, r.i, r.pair_id,
               CASE WHEN g.c > 0 AND (g.c + 1) * greatest(g.ms, r.s, g.mt, r.t + 2) > 4000 THEN g.b + 1 ELSE g.b END AS mine,
               CASE WHEN g.c > 0 AND (g.c + 1) * greatest(g.ms, r.s, g.mt, r.t + 2) > 4000 THEN 1 ELSE g.c + 1 END AS c2,
               CASE WHEN g.c > 0 AND (g.c + 1) * greatest(g.ms, r.s, g.mt, r.t + 2) > 4000 THEN r.s ELSE greatest(g.ms, r.s) END AS ms2,
               CASE WHEN g.c > 0 AND (g.c + 1) * greatest(g.ms, r.s, g.mt, r.t + 2) > 4000 THEN r.t + 2 ELSE greatest(g.mt, r.t + 2) END AS mt2
        FROM go g JOIN rn r ON r.shard = g.shard AND r.i = g.i + 1))
SELECT pair_id, shard, mine AS batch_no FROM go WHERE i > 0""",
})


ORACLE.update({
    "s1_read_reviews_header_as_data": f"""WITH {REVIEWS}
SELECT DOC_ID, LABEL, RATING FROM reviews
UNION ALL SELECT 'DOC_ID', 'LABEL', CAST(NULL AS INTEGER)""",
    "f6_remove_stopwords_long": f"""WITH {DOCS}, {SENTS},
t AS (SELECT doc_id, unnest({WS(PLAIN('sentence'))}) AS word FROM sents)
SELECT doc_id, count(*) AS n_kept FROM t WHERE NOT list_contains({STOP_SQL}, word) GROUP BY doc_id""",
})


# ---------------------------------------------------------------------------
# Other scorers: vectors of sentences, a feature of neighbours, windows (M1)
# ---------------------------------------------------------------------------
def WEIGHT(i: int, j: int) -> float:
    """The bilinear example's weights, by rule."""
    return ((31 * i + 17 * j) % 13 - 6) / 13.0


def VECTOR_SCORES(docs: str, sides: str, bilinear: bool) -> str:
    """``docs(doc_id, sents)`` and ``sides(id, doc_id, ord)`` (indexes into sents)
    -> ``vs_doc(id, doc_score)``."""
    feature = "list_sum(list_transform(range(1, 65), lambda d: p.wx[d] * q.x[d])) + 0.1" if bilinear else \
        "CASE WHEN p.nn = 0 OR q.nn = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, 65), lambda d: p.x[d] * q.x[d])) / (p.nn * q.nn) END"
    left = "list_transform(range(0, 64), lambda j: list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * (((31 * i + 17 * j) % 13 - 6) / 13.0))))" \
        if bilinear else "CAST(NULL AS DOUBLE[])"
    return f"""
vec AS (SELECT v.word, list_transform(e.embedding, lambda y: CAST(y AS DOUBLE)) AS vec FROM vocab v JOIN embeddings e ON v.idx = e.vec_id),
vst AS (SELECT doc_id, unnest(range(0, len(sents))) AS sent_idx, unnest(sents) AS sentence FROM {docs}),
vtk AS (SELECT doc_id, sent_idx, unnest({WS(TAGGED('sentence'))}) AS word FROM vst),
vcomp AS (SELECT word, unnest(range(0, 64)) AS d, unnest(vec) AS y FROM vec),
vav AS (SELECT doc_id, sent_idx, d, avg(y) AS y FROM vtk JOIN vcomp USING (word) GROUP BY ALL),
vsv AS (SELECT doc_id, sent_idx, list(y ORDER BY d) AS x FROM vav GROUP BY ALL),
vall AS (SELECT t.doc_id, t.sent_idx, coalesce(v.x, list_transform(range(0, 64), lambda d: 0.0)) AS x
         FROM vst t LEFT JOIN vsv v USING (doc_id, sent_idx)),
vn AS (SELECT doc_id, sent_idx, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS nn, {left} AS wx FROM vall),
vpl AS (SELECT id, doc_id, unnest(range(0, greatest(len(ord) - 1, 0))) AS i, unnest(ord[: greatest(len(ord) - 1, 0)]) AS a, unnest(ord[2:]) AS b FROM {sides}),
vpair AS (SELECT DISTINCT doc_id, a, b FROM vpl),
vf AS (SELECT z.doc_id, z.a, z.b, {feature} AS f FROM vpair z
       JOIN vn p ON p.doc_id = z.doc_id AND p.sent_idx = z.a JOIN vn q ON q.doc_id = z.doc_id AND q.sent_idx = z.b),
vo AS (SELECT l.id, l.i, vf.f, avg(vf.f) OVER (PARTITION BY l.id ORDER BY l.i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ctx,
              lead(vf.f) OVER (PARTITION BY l.id ORDER BY l.i) AS f1
       FROM vpl l JOIN vf ON vf.doc_id = l.doc_id AND vf.a = l.a AND vf.b = l.b),
vg AS (SELECT id, avg(ctx) AS g FROM vo GROUP BY id),
vs_doc AS (SELECT s.id, coalesce(sum(f + f1 + g), 0.0) AS doc_score
           FROM {sides} s LEFT JOIN vo ON vo.id = s.id AND f1 IS NOT NULL LEFT JOIN vg ON vg.id = s.id GROUP BY s.id)
"""


def EVAL_VECTOR(task: str, bilinear: bool) -> str:
    return f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK}, {SENTS}, {TOKENS}, {VOCAB('toks')},
raw AS (SELECT doc_id, sents, list_transform(sents, lambda s: {CASED('s')}) AS ns FROM docs),
own AS (SELECT doc_id, ns AS sents FROM raw WHERE doc_id IN (SELECT doc_id FROM pairs)),
sides AS (
  SELECT 'p' || doc_id AS id, doc_id, list_filter(range(0, len(sents)), lambda i: sents[i + 1] <> '') AS ord FROM own
  UNION ALL
  SELECT 'n' || pair_id, doc_id, {"list_reverse(list_filter(range(0, len(sents)), lambda i: sents[i + 1] <> ''))" if task == "inv" else
                                  "list_filter(perm, lambda i: sents[i + 1] <> '')"} FROM pairs JOIN own USING (doc_id)),
{VECTOR_SCORES('own', 'sides', bilinear)},
j AS (SELECT n_windows, round(p.doc_score, 9) > round(n.doc_score, 9) AS win FROM pairs
      JOIN vs_doc p ON p.id = 'p' || doc_id JOIN vs_doc n ON n.id = 'n' || pair_id)
SELECT '{task}' AS task, n_windows, count(*) AS n_pairs, round(avg(CAST(win AS DOUBLE)), 6) AS accuracy FROM j GROUP BY ROLLUP (n_windows)"""


def FRONT(sents: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, len({sents}) + 1), lambda i: len({WS(f'{sents}[i]')}) / i)), 0.0)"


ORACLE.update({
    "m4_evaluate_vector": EVAL_VECTOR("std", False),
    "m4_evaluate_bilinear": EVAL_VECTOR("inv", True),
    "m4_evaluate_model": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK},
j AS (SELECT n_windows, round({FRONT('pos')}, 9) > round({FRONT('neg')}, 9) AS win FROM pairs)
SELECT 'std' AS task, n_windows, count(*) AS n_pairs, round(avg(CAST(win AS DOUBLE)), 6) AS accuracy FROM j GROUP BY ROLLUP (n_windows)""",
    "m2_bilinear_scores": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {VOCAB('toks')},
sides AS (SELECT doc_id AS id, doc_id, range(0, len(sents)) AS ord FROM docs), {VECTOR_SCORES('docs', 'sides', True)}
SELECT doc_id, CAST(len(sents) AS INTEGER) AS n_sents, round(doc_score, 5) AS doc_score FROM docs JOIN vs_doc ON id = doc_id""",
    "st2_stream_scores_model": f"""WITH {DOCS}
SELECT doc_id, round({FRONT('sents')}, 6) AS doc_score, CAST(len(sents) AS INTEGER) AS n_sents FROM docs""",
})


_REQUESTS = f"""{REVIEWS}, req AS (SELECT *, CAST(DOC_ID AS BIGINT) % 10 = 3 AS bad FROM reviews WHERE {HU} < 0.2)"""
ORACLE.update({
    "s8_stream_request_log": f"""WITH {_REQUESTS}
SELECT DOC_ID AS username, CASE WHEN NOT bad THEN CAST(CAST(DOC_ID AS BIGINT) % 200 + 50 AS INTEGER) END AS max_len,
       CAST(CAST(DOC_ID AS BIGINT) % 3 + 1 AS INTEGER) AS n_sequences, '2021-11-30 10:00:00' AS ts, CAST(bad AS INTEGER) AS malformed
FROM req""",
    "st1_stream_prompts": f"""WITH {REVIEWS},
train AS (SELECT * FROM reviews WHERE {HU} >= 0.2),
test AS (SELECT * FROM reviews WHERE {HU} < 0.2),
{TFIDF_ON('test', 'train')}, {TOPK.replace('{src}', 'test')}
SELECT r.DOC_ID AS username, CAST(CAST(r.DOC_ID AS BIGINT) % 10 = 3 AS INTEGER) AS malformed,
       CASE WHEN CAST(r.DOC_ID AS BIGINT) % 10 <> 3
            THEN '[BOS]' || coalesce(r.PRODUCT_TITLE, '') || '[SEP]' || coalesce(k.keywords, '') || '[SEP]' END AS prompt
FROM test r LEFT JOIN kw k USING (DOC_ID)""",
    "st3_stream_accuracy_windows": f"""WITH RECURSIVE {P8_CTES()}, {PAIRS_OK},
{SCORE_CTES('pairs', 'pair_id', 'pos', 'ps')}, {SCORE_CTES('pairs', 'pair_id', 'neg', 'ns')},
j AS (SELECT p.n_windows, CAST(p.doc_id AS BIGINT) AS id, round(ps_doc.doc_score, 9) > round(ns_doc.doc_score, 9) AS win
      FROM pairs p JOIN ps_doc USING (pair_id) JOIN ns_doc USING (pair_id))
SELECT strftime(TIMESTAMP '2024-01-01' + to_hours(CAST((id % 360) // 60 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_start,
       CAST(n_windows AS INTEGER) AS n_windows, count(*) AS n_pairs, CAST(sum(CAST(win AS BIGINT)) AS BIGINT) AS n_correct,
       round(sum(CAST(win AS BIGINT)) / count(*), 6) AS accuracy
FROM j WHERE NOT (id % 360 < 60 AND id % 11 = 0) GROUP BY ALL""",
})


ORACLE.update({
    "j5_align_order_long": f"""WITH RECURSIVE {P8_CTES()},
pr AS (SELECT concat_ws('_', doc_id, n, perm_no) AS pair_id, pos[1:len(pos) - 1] AS pos, neg FROM texts WHERE NOT (pos = neg)),
pl AS (SELECT pair_id, unnest(range(0, len(pos))) AS src, unnest(pos) AS sentence FROM pr),
nl AS (SELECT pair_id, unnest(range(0, len(neg))) AS dst, unnest(neg) AS sentence FROM pr),
plo AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sentence ORDER BY src) AS occ FROM pl),
nlo AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sentence ORDER BY dst) AS occ FROM nl),
same AS (SELECT nl.*, pl.src IS NOT NULL AS stays FROM nl LEFT JOIN pl
         ON pl.pair_id = nl.pair_id AND pl.src = nl.dst AND pl.sentence = nl.sentence),
mo AS (SELECT *, row_number() OVER (PARTITION BY pair_id, sentence ORDER BY dst) AS occ FROM same WHERE NOT stays),
a AS (SELECT 'bijective' AS mode, nlo.pair_id, nlo.dst, plo.src FROM nlo LEFT JOIN plo USING (pair_id, sentence, occ)
      UNION ALL SELECT 'first', nlo.pair_id, nlo.dst, plo.src FROM nlo LEFT JOIN plo
        ON plo.pair_id = nlo.pair_id AND plo.sentence = nlo.sentence AND plo.occ = 1
      UNION ALL SELECT 'reference', pair_id, dst, dst FROM same WHERE stays
      UNION ALL SELECT 'reference', mo.pair_id, mo.dst, plo.src FROM mo LEFT JOIN plo USING (pair_id, sentence, occ))
SELECT pair_id, mode, CAST(dst AS INTEGER) AS dst, CAST(src AS INTEGER) AS src FROM a""",
})


ORACLE.update({
    "u2_prompt_vocab": f"""WITH {DOCS}, {SENTS}, {TOKENS}, {VOCAB('toks')}
SELECT idx, word, cnt FROM vocab WHERE idx < 50257
UNION ALL SELECT * FROM (VALUES (50257, '[SEP]', 0), (50258, '[PAD]', 0), (50259, '[CLS]', 0),
  (50260, '[MASK]', 0), (50261, '[BOS]', 0), (50262, '[EOS]', 0)) AS t(idx, word, cnt)""",
})
