"""Text operators as table jobs (T1-T16, A1): native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohera.functions.text import col, let, normalize, split_sentences, split_ws, tagged_words, tokenize

# Prompt markers of the language-model special-token map (fixed values).
SPECIAL_TOKENS = {"unk_token": "[UNK]", "sep_token": "[SEP]", "pad_token": "[PAD]",
                  "cls_token": "[CLS]", "mask_token": "[MASK]", "bos_token": "[BOS]",
                  "eos_token": "[EOS]"}
# Ids appended after the 50257-token base vocabulary (fixed values, id order).
ADDED_TOKEN_IDS = [("[SEP]", 50257), ("[PAD]", 50258), ("[CLS]", 50259), ("[MASK]", 50260),
                   ("[BOS]", 50261), ("[EOS]", 50262)]
BOS, SEP, EOS = SPECIAL_TOKENS["bos_token"], SPECIAL_TOKENS["sep_token"], SPECIAL_TOKENS["eos_token"]


def sentence_table(docs: DataFrame, sents: str = "sents") -> DataFrame:
    """D1 long form ``(doc_id, sent_idx, sentence)``."""
    return docs.select("doc_id", F.posexplode(sents).alias("sent_idx", "sentence"))


def split_reviews(df: DataFrame, text: str, key: str, keep_tail: bool = True) -> DataFrame:
    """T3 as a table: ``(key, sent_idx, sentence)``."""
    return df.select(key, F.posexplode(split_sentences(F.col(text), keep_tail))
                     .alias("sent_idx", "sentence"))


def first_last_sentence(df: DataFrame, text: str, keep_tail: bool = True) -> DataFrame:
    """T4: first and last sentence of each review (one sentence -> equal; none -> null)."""
    fl = let(split_sentences(F.col(text), keep_tail),
             lambda s: F.struct(F.try_element_at(s, F.lit(1)).alias("f"), F.try_element_at(s, F.lit(-1)).alias("l")))
    return df.withColumn("_s", fl).withColumn("first_sentence", F.col("_s.f")) \
             .withColumn("last_sentence", F.col("_s.l")).drop("_s")


def first_sentence_or_text(text) -> Column:
    """T4 candidate rule: the first sentence, or the whole trimmed text when
    the splitter finds none."""
    s = split_sentences(col(text), keep_tail=False)
    from cohera.functions.text import py_strip
    return F.coalesce(F.try_element_at(s, F.lit(1)), py_strip(col(text)))


def flatten_tokens(sents: Column, mode: str = "global", norm_mode: str = "tagged") -> Column:
    """T5: ``global`` -> one word list for the document (normalise, split,
    drop empty sentences, flatten); ``local`` -> sentences re-joined by a space."""
    words = tagged_words if norm_mode == "tagged" else lambda s: split_ws(normalize(s, norm_mode))
    toks = F.filter(F.transform(sents, words),
                    lambda a: F.size(a) > 0)
    if mode == "global":
        return F.flatten(toks)
    if mode == "local":
        return F.transform(toks, lambda a: F.array_join(a, " "))
    raise ValueError(mode)


def parse_doc_name(name: Column) -> dict[str, Column]:
    """``wsj_0001.pos.text...`` -> stem (first 3 dot parts), base name
    (first dot part), section (chars 5-6 of the base: ``wsj_0001`` -> ``00``)."""
    stem = F.substring_index(name, ".", 3)
    base = F.substring_index(name, ".", 1)
    return {"stem": stem, "base": base, "section": F.substring(base, 5, 2)}


def compose_neg_name(stem: Column, n: Column, i: Column) -> Column:
    """Negative file name ``stem_<n>_<i>``."""
    return F.concat_ws("_", stem, n.cast("string"), i.cast("string"))


def _z(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def build_prompt(template: str, title=None, review_title=None, text=None,
                 first=None, last=None, keywords=None, query: bool = False) -> Column:
    """T7 prompt templates (markers without spaces; a null part is empty).

    ``title``      BOS title SEP review_title SEP text EOS
    ``first_last`` BOS first SEP last SEP text EOS
    ``keywords``   BOS title SEP keywords SEP  (already the query form)
    ``query=True`` drops ``text EOS`` (the generation-time prompt)."""
    if template == "title":
        head = [F.lit(BOS), _z(title), F.lit(SEP), _z(review_title), F.lit(SEP)]
    elif template == "first_last":
        head = [F.lit(BOS), _z(first), F.lit(SEP), _z(last), F.lit(SEP)]
    elif template == "keywords":
        return F.concat(F.lit(BOS), _z(title), F.lit(SEP), _z(keywords), F.lit(SEP))
    else:
        raise ValueError(template)
    if query:
        return F.concat(*head)
    return F.concat(*head, _z(text), F.lit(EOS))


def strip_prompt(generated, a, b, offset: int = 0) -> Column:
    """Drop the echoed condition by character count,
    ``text[len(a) + len(b) + offset:]`` (keyword variant: ``offset=-1``)."""
    g = col(generated)
    start = F.length(_z(a)) + F.length(_z(b)) + F.lit(offset + 1)
    return F.when(start <= 1, g).otherwise(g.substr(start.cast("int"), F.length(g) + 1))


def doc_size(sents: Column) -> Column:
    """Sentence count of a text document."""
    return F.size(sents)


def grid_doc_size(grid_line: Column) -> Column:
    """T9, grid variant: role fields of a grid row (first field is the entity)."""
    return F.size(F.split(grid_line, " ")) - 1


def numbered_list(df: DataFrame, key: str, no: str, text: str,
                  label: str = "Generated Sentences ") -> DataFrame:
    """Join a request's results into one string
    ``Generated Sentences i: text`` + CRLF CRLF, in result order."""
    agg = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(col(no).alias("no"),
                                                                   col(text).alias("t")))).alias("_r"))
    item = lambda s: F.concat(F.lit(label), (s["no"] + 1).cast("string"), F.lit(": "),
                              s["t"], F.lit("\r\n\r\n"))
    return agg.select(key, F.array_join(F.transform("_r", item), "").alias("numbered"))


def word_count(tokens: DataFrame, word: str = "word", unit: str = "word") -> DataFrame:
    """A1: counts over all documents (partial + final hash aggregate).
    ``unit='char'`` counts characters instead (the quirk of the cleaner that
    returned a string)."""
    if unit == "char":
        tokens = tokens.select(F.explode(F.filter(F.split(F.col(word), ""),
                                                  lambda c: c != "")).alias(word))
    return tokens.groupBy(word).agg(F.count(F.lit(1)).alias("cnt"))


__all__ = ["sentence_table", "split_reviews", "first_last_sentence", "flatten_tokens",
           "parse_doc_name", "compose_neg_name", "build_prompt", "strip_prompt", "doc_size",
           "numbered_list", "word_count", "tokenize"]
