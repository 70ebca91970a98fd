"""M3: plug-in batch scoring with a user model over ``mapInPandas``.

The model factory runs once per Python worker (cached), then every Arrow
batch of the partition is scored. No model is shipped with the library;
:func:`type_token_model` is a tiny example factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

_MODELS: dict = {}


def score_batches(df: DataFrame, model_factory: Callable, schema: str,
                  model_key: str | None = None, slice_rows: int = 256) -> DataFrame:
    """Apply ``model_factory()(pdf) -> pdf`` to every batch of ``df``, at most
    ``slice_rows`` rows at a time: what a model makes of its rows (such as a
    Python string a word) is many times their size, and an Arrow batch may hold
    10 000 documents."""
    key = model_key or f"{model_factory.__module__}.{model_factory.__qualname__}"

    def run(it: Iterator):
        model = _MODELS.get(key)
        if model is None:
            model = _MODELS[key] = model_factory()
        for pdf in it:
            for i in range(0, len(pdf), slice_rows):
                yield model(pdf.iloc[i:i + slice_rows].reset_index(drop=True))
    return df.mapInPandas(run, schema)


def type_token_model():
    """Example model: distinct-word ratio and mean sentence length of a
    document given as ``sents`` (array of strings)."""
    import numpy as np
    import pandas as pd

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        # one long table of (document, word) for the batch; numpy counts it
        words = pdf["sents"].map(" ".join).str.lower().str.split()
        sizes = words.str.len().to_numpy()
        doc = np.repeat(np.arange(len(pdf)), sizes)
        code, _ = pd.factorize(np.concatenate(words.to_list()) if sizes.sum() else np.empty(0, object))
        distinct = np.bincount(np.unique(np.stack([doc, code]), axis=1)[0], minlength=len(pdf)) if sizes.sum() else sizes * 0
        n_sents = pdf["sents"].str.len().to_numpy()
        return pd.DataFrame({"doc_id": pdf["doc_id"], "type_token_ratio": np.where(sizes > 0, distinct / np.maximum(sizes, 1), 0.0),
                             "mean_sentence_len": np.where(n_sents > 0, sizes / np.maximum(n_sents, 1), 0.0)})
    return model
