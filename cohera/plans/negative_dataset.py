"""The permutation dataset, the reference's central data product.

documents -> lines (D1) -> F1 min sentences -> R4 split -> P1-P5 negatives
``doc_n_i`` -> paired with their positive (J1, direct here because each
negative is generated from its positive row) -> T1 normalisation + F3 ->
optional F4. One lazy plan; the only job before it is the R4 cut value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohera.functions.text import normalize
from cohera.operators.filters import by_name, min_sentences  # noqa: F401
from cohera.operators.permute import build_negatives, gather, kept_order, surely_changed, with_kept
from cohera.operators.sampling import first_n_split, section_split
from cohera.operators.score import sims_from_sets, sims_of_order, word_set


def build_negative_dataset(docs: DataFrame, n_windows=(1, 2, 3), perms=(20, 20, 20),
                           w: int = 3, min_sents: int = 10, seed: int = 42,
                           split: str = "first_n", n_train: int = 121,
                           normalize_mode: str | None = "cased",
                           drop_identical: bool = True, features=None, sims: bool = False) -> DataFrame:
    """``docs(doc_id, sents)`` -> ``pairs(pair_id, doc_id, split, n_windows,
    perm_no, perm, pos, neg)`` and the ``features`` and ``sims`` of :func:`negatives_of`."""
    d = prepare_documents(docs, min_sents, split, n_train, normalize_mode)
    return negatives_of(d, n_windows, perms, w, seed, normalize_mode, drop_identical, features, sims=sims)


def prepare_documents(docs: DataFrame, min_sents: int = 10, split: str = "first_n", n_train: int = 121,
                      normalize_mode: str | None = "cased") -> DataFrame:
    """The documents of P8: long enough, with their split and the normalised
    sentences ``_ns`` (each normalised once a document)."""
    d = min_sentences(docs, min_sents)
    if split == "first_n":
        d = first_n_split(d, "doc_id", n_train)
    elif split == "section":
        d = section_split(d.withColumn("section", F.substring("doc_id", 5, 2)), "section")
    elif split is None:
        d = d.withColumn("split", F.lit("train"))
    else:
        raise ValueError(split)
    ns = F.transform("sents", lambda x: normalize(x, normalize_mode)) if normalize_mode else F.col("sents")
    return d.withColumn("_ns", ns).drop("sents")


def negatives_of(d: DataFrame, n_windows=(1, 2, 3), perms=(20, 20, 20), w: int = 3, seed: int = 42,
                 normalize_mode: str | None = "cased", drop_identical: bool = True, features=None,
                 nested: bool = False, sims: bool = False) -> DataFrame:
    """The pairs of :func:`prepare_documents`' rows, each made from its row alone;
    further columns (those with ``_`` in front excepted) pass through.

    ``features`` (name -> ``feature(sentence)``) adds ``pos_<name>`` and
    ``neg_<name>``: a value for each sentence of a side, computed once a
    document and only reordered for its negatives. ``sims`` adds ``pos_sims`` and
    ``neg_sims``, the overlaps of neighbouring sentences that M1 scores: a negative's
    are read off its document's where neighbours stay, so its row holds no word sets."""
    features = features or {}
    own = [c for c in d.columns if c not in ("doc_id", "split", "sents") and not c.startswith("_")]
    d = with_kept(d, "_ns", drop_empty=normalize_mode is not None)
    for name, feature in features.items():
        d = d.withColumn(f"pos_{name}", F.transform("pos", feature))
    if sims:
        d = d.withColumn("_sets", F.transform("pos", word_set)).withColumn("pos_sims", sims_from_sets(F.col("_sets")))
    extra = (lambda perm: sims_of_order(F.col("_sets"), F.col("pos_sims"), kept_order(perm))) if sims else None
    keep = (lambda neg: ~neg.eqNullSafe(F.col("pos"))) if drop_identical else None
    out = build_negatives(d.drop("_ns"), n_windows, perms, w, seed, sents="pos", n_sents=F.col("_lines"),
                          neg_text=lambda s, perm: gather(s, kept_order(perm)), keep=keep,
                          sure=lambda perm, combo: surely_changed(perm, combo, w), nested=nested, extra=extra)
    if nested:  # one row a document and window count: ``files.write_pairs``
        negs = F.transform("negs", lambda s: F.struct(s["perm_no"].alias("perm_no"), s["perm"].alias("perm")))
        return out.select("doc_id", "split", "n_windows", "pos", "_rank", negs.alias("negs"))
    if sims:
        out = out.withColumn("neg", gather(F.col("pos"), kept_order(F.col("perm"))))
    for name in features:
        out = out.withColumn(f"neg_{name}", gather(F.col(f"pos_{name}"), kept_order(F.col("perm"))))
    return out.select("pair_id", "doc_id", "split", "n_windows", "perm_no", "perm", "pos", "neg", *own,
                      *[f"{side}_{name}" for name in features for side in ("pos", "neg")],
                      *(["pos_sims", F.col("extra").alias("neg_sims")] if sims else []))
