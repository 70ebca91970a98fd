"""Dataset bookkeeping over file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File-name classes of the permutation corpus (fixed values). The dot before
# the window digit is an unescaped wildcard, so ``name_2_5`` is window 2.
POS_TEXT_RE = r"^wsj+_\d+\.pos\.text$"
NEG_TEXT_RE = r"^wsj+_\d+\.pos\.text.{k}.*$"
POS_GRID_RE = r"^wsj+_\d+\.pos\.text\.parsed\.ner\.EGrid$"
NEG_GRID_RE = r"^wsj+_\d+\.pos\.text\.parsed\.ner\.EGrid.{k}.*$"


def classify_files(files: DataFrame, name: str = "name", windows=(1, 2, 3)) -> DataFrame:
    """``kind`` in pos_text / neg_text / pos_grid / neg_grid (null when
    no class matches), ``doc_id`` = the ``wsj_NNNN`` base, ``n_windows`` for
    negatives (first window class that matches), ``perm_no`` = trailing
    ``_<i>`` of a negative."""
    n = F.col(name)
    kind = (F.when(n.rlike(POS_TEXT_RE), "pos_text")
             .when(n.rlike(POS_GRID_RE), "pos_grid"))
    win = None
    for k in windows:
        t = n.rlike(NEG_TEXT_RE.format(k=k))
        g = n.rlike(NEG_GRID_RE.format(k=k))
        kind = kind.when(t, "neg_text").when(g, "neg_grid")
        cond = t | g
        win = F.when(cond, F.lit(k)) if win is None else win.when(cond, F.lit(k))
    perm = F.regexp_extract(n, r"_(\d+)$", 1)
    return files.withColumn("kind", kind) \
        .withColumn("doc_id", F.regexp_extract(n, r"^(wsj+_\d+)", 1)) \
        .withColumn("n_windows", F.when(F.col("kind").startswith("neg"), win)) \
        .withColumn("perm_no", F.when(F.col("kind").startswith("neg") & (perm != ""),
                                      perm.cast("int")))


def dataset_info(files: DataFrame) -> DataFrame:
    """A4: file count per (split, kind, n_windows) with rollup totals (the
    printed "Summation")."""
    return files.rollup("split", "kind", "n_windows").agg(F.count(F.lit(1)).alias("n_files"))


def missing_counterparts(text_stems: DataFrame, grid_stems: DataFrame, stem: str = "stem") -> DataFrame:
    """Grid stems that have no text file."""
    return grid_stems.select(stem).subtract(text_stems.select(stem))


def distinct_stems(neg_names: DataFrame, name: str = "name") -> DataFrame:
    """De-duplicated text names from negative names ``stem_<n>_<i>``."""
    stem = F.regexp_replace(F.col(name), r"_\d+_\d+$", "")
    return neg_names.select(stem.alias("stem")).distinct()


def pos_text_name(doc_id: Column) -> Column:
    """Corpus naming: ``wsj_<id of 4 digits or more>.pos.text``."""
    return F.concat(F.lit("wsj_"), padded(doc_id, 4), F.lit(".pos.text"))


def padded(number: Column, width: int) -> Column:
    """Zeros in front up to ``width`` characters; longer ids stay whole."""
    s = number.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)
