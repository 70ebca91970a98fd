"""Helpers shared by the operators: storage, folds and vectorised tokenising.

``word_batch`` is the one tokeniser of the package: it lower-cases A-Z, takes
the runs of bytes outside ``[\\x20\\x09-\\x0D]`` and gives each a 64-bit
polynomial hash, all with numpy over a whole batch of texts.  Words are
identified by that hash: two different words among n meet with a chance of
about n^2 / 2^65.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: most text bytes that one numpy batch holds (a longer text is its own batch)
BATCH_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared storage named by ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        root = _LOCAL.get("root") or _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="cohera-llm-"))  # one process: nothing to share
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/cohera-llm/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: the lineage
    ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def ascii_lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, BATCH_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a batch of texts.

    Returns ``(hashes, first, starts, ends, data)``: 64-bit word hashes in
    text order, ``first[i]:first[i+1]`` the words of text i, the byte range of
    each word, and the lower-cased bytes.  Null and blank texts have no words.
    """
    blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    data = _LOWER[data]
    text_ends = np.cumsum(np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs)))
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.concatenate(([0], np.searchsorted(starts, text_ends)))
    return hashes, first, starts, ends, data


def text_batches(texts: list) -> Iterator[slice]:
    """Slices of a list of texts (or of records with texts), each of about
    ``BATCH_BYTES`` at most, a longer text alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else sum(len(x) for x in t.values() if isinstance(x, str)) if t else 0
        if i > at and size + n > BATCH_BYTES:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def map_texts(df: DataFrame, keep: list[str], fields: list[StructField], make: Callable[[list], dict],
              column: str = "text") -> DataFrame:
    """``df``'s columns ``keep`` and the new ``fields``: ``make`` gets slices of
    bounded size of ``column`` and returns ``{name: values or Arrow array}``. The kept columns
    pass through as Arrow arrays, so no null turns an integer into a float."""
    names = [*keep, *[f.name for f in fields]]
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def f(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for part in text_batches(values):
                made = make(values[part])
                rows = batch.slice(part.start, part.stop - part.start)
                arrays = [rows.column(rows.schema.get_field_index(c)) for c in keep]
                arrays += [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], type=t) for n, t in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    columns = [*keep, *([] if column in keep else [column])]
    return df.select(*columns).mapInArrow(f, StructType([df.schema[c] for c in keep] + fields))
