"""Sampling and splits (R1-R6, J2) as md5 ranks; dense index helper.

Every choice is a function of ``md5(seed|key)``, so a row's fate does not
depend on partitioning, and every split is reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohera.functions.hashing import hex_to_int, md5_key
from cohera.session import materialise

_U32 = float(2 ** 32)


def hash_unit(seed, key) -> F.Column:
    """A uniform number in [0, 1) from ``md5(seed|key)`` (first 8 hex digits)."""
    return hex_to_int(md5_key(seed, key)) / F.lit(_U32)


def sample_fraction(df: DataFrame, frac: float, seed: int, key: str,
                    exact: bool = False, bucket_rows: int = 200_000) -> DataFrame:
    """Sample without replacement.

    Default: Bernoulli by hash (``u < frac``), no shuffle. ``exact=True``
    returns exactly ``round(frac * n)`` rows -- those with the smallest
    ``md5(seed|key)``. The cut value is found without ranking the table:
    histograms of hash prefixes (at most 65 536 counts per pass, 4 more hex
    digits each pass) narrow it down to one prefix bucket of at most
    ``bucket_rows`` rows, and only that bucket is ranked."""
    h = md5_key(seed, F.col(key))
    if not exact:
        return df.filter(hash_unit(seed, F.col(key)) < F.lit(frac))
    hs = df.select(h.alias("_h"))
    n = hs.count()
    need = int(round(frac * n))
    if need <= 0:
        return df.limit(0)
    if need >= n:
        return df
    prefix = ""
    while len(prefix) < 32:
        d = len(prefix) + 4
        part = hs.filter(F.col("_h").startswith(prefix)) if prefix else hs
        hist = sorted((r[0], r[1]) for r in part.groupBy(F.substring("_h", 1, d)).count().collect())
        acc = 0
        for b, c in hist:
            if acc + c >= need:
                prefix, need = b, need - acc
                bucket = c
                break
            acc += c
        if bucket <= bucket_rows:
            break
    bucket = hs.filter(F.col("_h").startswith(prefix))
    cut = bucket.orderBy("_h").limit(need).agg(F.max("_h").alias("c")).first()["c"]
    less, equal = bucket.agg(F.count_if(F.col("_h") < cut), F.count_if(F.col("_h") == cut)).first()
    if less + equal == need:
        return df.filter(h <= F.lit(cut))
    # rows that share the key at the cut: as many as are missing, by a hash of the whole row
    return df.filter(h < F.lit(cut)).unionByName(_first_rows(df.filter(h == F.lit(cut)), need - less, seed)[0])


def _first_rows(df: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``n`` rows of ``df`` by a hash of the row and a running number, and the others."""
    ranked, _ = dense_index(df.withColumn("_rh", F.xxhash64(F.lit(seed), F.struct(*df.columns))), ["_rh"], "_rn")
    return ranked.filter(F.col("_rn") < n).select(df.columns), ranked.filter(F.col("_rn") >= n).select(df.columns)


def train_test_split(df: DataFrame, ratio: float, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """R2: one hash column, two complementary predicates (disjoint, complete).
    ``ratio`` is the share of the *sampled* part (the test side)."""
    u = hash_unit(seed, F.col(key))
    return df.filter(u >= F.lit(ratio)), df.filter(u < F.lit(ratio))


def complement(df: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``subset`` (left-anti join)."""
    return df.join(subset.select(key), key, "left_anti")


def stratified_split(df: DataFrame, ratio: float, seed: int, key: str, label: str,
                     consistent: bool = False) -> DataFrame:
    """Per-label train/test assignment.

    Reference behaviour (default): drawn independently of R2 -- the hash is
    salted with the label value, so a per-label test set may overlap the
    global one. ``consistent=True`` uses the R2 hash, so it never does.
    Returns the input with ``label_split`` in {'train','test'}."""
    if consistent:
        u = hash_unit(seed, F.col(key))
    else:
        u = hex_to_int(md5_key(seed, F.coalesce(F.col(label).cast("string"), F.lit("\\N")),
                               F.col(key))) / F.lit(_U32)
    return df.withColumn("label_split", F.when(u < F.lit(ratio), "test").otherwise("train"))


def first_n_cutoff(df: DataFrame, key: str, n: int):
    """The n-th smallest ``key`` value (the greatest, if fewer), and how many
    smaller ones there are where the next row has that value too, else null.
    A distributed top-k of n + 1 values; one row back."""
    top = df.select(F.col(key).alias("k")).filter("k is not null").orderBy("k").limit(n + 1)
    a = top.agg(F.sort_array(F.collect_list("k")).alias("a")).select("a", F.get("a", F.least(F.size("a"), F.lit(n)) - 1).alias("cut"))
    tied = F.get("a", F.lit(n)) == F.col("cut")
    r = a.select("cut", F.when(tied, F.size(F.filter("a", lambda x: x < F.col("cut")))).alias("less")).first()
    return r["cut"], r["less"]


def first_n_split(df: DataFrame, key: str = "doc_id", n: int = 121) -> DataFrame:
    """The first ``n`` documents by name are train, the rest (those without a
    name too) test. Of rows that share the name at the cut, as many as are
    missing are train, by a hash of the row."""
    cut, less = first_n_cutoff(df, key, n)
    if cut is None:
        return df.withColumn("split", F.lit("test"))
    by_name = df.withColumn("split", F.when(F.col(key) <= F.lit(cut), "train").otherwise("test"))
    if less is None:
        return by_name
    first, rest = _first_rows(df.filter(F.col(key) == F.lit(cut)), n - less, 0)
    return by_name.filter(~F.col(key).eqNullSafe(F.lit(cut))).unionByName(
        first.withColumn("split", F.lit("train"))).unionByName(rest.withColumn("split", F.lit("test")))


def section_split(df: DataFrame, section: str = "section", cut: int = 13) -> DataFrame:
    """Section <= cut is train, else test."""
    return df.withColumn("split", F.when(F.col(section).cast("int") <= cut, "train")
                         .otherwise("test"))


def shuffle_key(seed, *keys) -> F.Column:
    """A shuffle order key ``md5(seed|keys...)`` (sort by it)."""
    return md5_key(seed, *[F.col(k) if isinstance(k, str) else k for k in keys])


def fixed_size(df: DataFrame) -> DataFrame:
    """A table whose number of rows a parameter bounds, whatever the input: each
    task gets a copy, and the other side of a join is not shuffled."""
    return F.broadcast(df)


def fixed_size_columns(df: DataFrame):
    """A table as for :func:`fixed_size`, for Python tasks: the ``value`` of the result
    has its columns by name, an Arrow array each."""
    t = df.toArrow()
    return df.sparkSession.sparkContext.broadcast({c: t.column(c).combine_chunks() for c in t.column_names})


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                n_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Dense 0..n-1 index in the order of ``order_cols`` without a
    single-partition window; returns ``(indexed rows, n)``.

    Range-partition by the order columns, sort inside partitions and write
    that once; ``monotonically_increasing_id`` is ``(partition << 33) +
    position``, so one small job counts rows per partition (at most
    ``n_partitions`` numbers) and a row's index is its partition's offset --
    joined from a table of one row a partition -- plus its position.
    ``order_cols`` must give a total order for the index to be deterministic."""
    spark = df.sparkSession
    n_partitions = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n_partitions, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = materialise(ranged, "dense-index").withColumn("_p", F.shiftright("_mid", 33).cast("int"))
    offsets, acc = [], 0
    for p, c in sorted((r[0], r[1]) for r in ranged.groupBy("_p").count().collect()):
        offsets.append((p, acc))
        acc += c
    table = F.broadcast(spark.createDataFrame(offsets, "_p int, _off long"))  # one row a partition
    out = ranged.join(table, "_p")
    out = out.withColumn(name, F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_p").cast("long"), 33))
    return out.drop("_mid", "_p", "_off"), acc
