"""Corpus documents: one document = ordered lines, one sentence per line."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.functions.text import py_strip


def text_lines(text) -> F.Column:
    """Lines of a text as file iteration yields them: a final newline does
    not open an extra empty line, and the empty text has no line."""
    t = F.col(text) if isinstance(text, str) else text
    body = F.regexp_replace(t, "\r?\n$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n"))


def corpus_from_documents(documents: DataFrame, strip: bool = True) -> DataFrame:
    """``documents(doc_id, text, ...)`` -> ``docs(doc_id STRING, sents ARRAY<STRING>)``.

    Lines are stripped as the reference's corpus reader does; blank lines are
    kept (they count toward the minimum-length filter)."""
    lines = text_lines("text")
    if strip:
        lines = F.transform(lines, py_strip)
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"),
                            lines.alias("sents"))


def read_corpus(spark: SparkSession, path: str, pattern: str | None = None,
                encoding: str = "ISO-8859-1", name_regex: str | None = None,
                key_from_dir: str | None = None) -> DataFrame:
    """Every file under ``path`` (recursive) is one document.

    ``pattern`` is a file-name glob pushed into the file listing;
    ``name_regex`` an extra regex filter on the file name. Bytes are decoded
    with ``encoding`` (latin-1 by default, as the corpus is stored). The
    document key is the file name, or with ``key_from_dir='doc_id'`` the
    value of a ``doc_id=<v>`` folder (a partitioned write) or file (:func:`write_corpus`)."""
    r = (spark.read.format("binaryFile").option("recursiveFileLookup", "true"))
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    df = r.load(path).select(F.col("path"), F.col("content"))
    if key_from_dir:
        name = F.regexp_extract(F.col("path"), f"{key_from_dir}=([^/]+)", 1)
    else:
        name = F.element_at(F.split(F.col("path"), "/"), -1)
    df = df.select(name.alias("doc_id"), F.decode("content", encoding).alias("text"))
    if name_regex:
        df = df.filter(F.col("doc_id").rlike(name_regex))
    return corpus_from_documents(df)


def write_corpus(documents: DataFrame, path: str) -> None:
    """One file a document of ``documents(doc_id, text)``, for :func:`read_corpus`:
    ``part-<task>/doc_id=<id>``, written in place by the tasks and with no folder a
    document. Rows of a task that share their id share a file, a line break after
    each text; a null id is named as a partitioned write names it. A file gets its
    name when it is whole, so a repeated task changes nothing. Where ``path`` is no
    folder that :mod:`pyarrow.fs` knows, Spark writes a folder a document."""
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    try:
        fs.FileSystem.from_uri(uri)
    except (ValueError, OSError):
        documents.select("doc_id", "text").write.partitionBy("doc_id").text(path)
        return

    def write(batches: Iterator[pd.DataFrame]):
        task = TaskContext.get()
        files, root = fs.FileSystem.from_uri(uri)
        folder = f"{root}/part-{task.partitionId():05d}"
        files.create_dir(folder)
        rows = ((i, t) for pdf in batches for i, t in zip(pdf["id"], pdf["text"]))
        n = 0
        for name, some in groupby(rows, key=lambda r: r[0]):
            draft = f"{folder}/.{task.taskAttemptId()}"
            with files.open_output_stream(draft) as f:
                for _, text in some:
                    f.write(text + b"\n")
            files.move(draft, f"{folder}/doc_id={quote(name, safe=' ')}")
            n += 1
        yield pd.DataFrame({"n": [n]})

    rows = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("id"),
                            F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows.sortWithinPartitions("doc_id").select("id", "text").mapInPandas(write, "n long").agg(F.sum("n")).collect()  # one row
