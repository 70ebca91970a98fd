"""Entity grids (S7, J4, J6, P6) as a sparse long table.

A grid line is ``entity r0 r1 ...`` (one role per sentence, ``-`` = absent).
The long form keeps present cells only: ``grid(doc_id, entity, sent_idx,
role)``; a document's column count travels separately (``n_cols``). Absent
cells are implied, so two columns are equal iff their sets of present
``(entity, role)`` cells are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.operators.permute import align_order, by_index

ABSENT = "-"


def parse_grid_lines(lines: DataFrame, key: str = "doc_id", line: str = "line") -> DataFrame:
    """Grid text lines -> sparse long grid ``(key, entity, sent_idx, role)``
    (the entity field is dropped from the role list)."""
    parts = F.split(F.col(line), " ")
    df = lines.select(key, F.element_at(parts, 1).alias("entity"),
                      F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
                      .alias("sent_idx", "role"))
    return df.filter(F.col("role") != ABSENT)


def grid_widths(lines: DataFrame, key: str = "doc_id", line: str = "line") -> DataFrame:
    """T9 grid variant per document: role fields of its first line (all
    lines of a grid have the same width)."""
    return lines.groupBy(key).agg(F.max(F.size(F.split(F.col(line), " ")) - 1).alias("n_cols"))


def read_entity_grid(spark: SparkSession, path: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S7 file reader: every file is one grid; the file name is the key.
    Returns ``(grid, widths)``."""
    r = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    df = r.text(path).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1)) \
        .filter(F.trim("value") != "")
    lines = df.select(F.col("name").alias("doc_id"), F.col("value").alias("line"))
    return parse_grid_lines(lines), grid_widths(lines)


def column_signatures(grid: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sent_idx, sig``: per grid column a signature of its present cells
    as a multiset. Two 64-bit hashes of each cell are added up in 32-bit halves
    (sums that commute, so they combine before the shuffle and no cell moves);
    equal columns have equal signatures, and others differ but for a clash of
    128 bits. A column without a present cell has all sums 0.
    ``widths`` has ``keys + [n_cols]``."""
    def halves(seed):
        h = F.xxhash64(F.lit(seed), "entity", "role")
        return [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]

    sums = [x.alias(f"_h{i}") for i, x in enumerate(halves(1) + halves(2))]
    present = grid.groupBy(*keys, "sent_idx").agg(*sums)
    cols = widths.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("sent_idx"))
    sig = F.struct(*[F.coalesce(f"_h{i}", F.lit(0)).alias(f"h{i}") for i in range(len(sums))])
    return cols.join(present, keys + ["sent_idx"], "left").select(*keys, "sent_idx", sig.alias("sig"))


def signature_arrays(grid: DataFrame, widths: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, sigs``: :func:`column_signatures` with a row a document, whose
    ``sigs`` holds the signature of each column (an array of ``n_cols``). Keys are
    single in ``widths``; only sums of a column's cells are shuffled."""
    s = column_signatures(grid, widths.where("n_cols > 0"), [key])
    per = s.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sent_idx", "sig"))).alias("_s"))
    return per.select(key, F.transform("_s", lambda e: e["sig"]).alias("sigs"))


def column_cells(grid: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, columns``: a document's grid in its row, for each column the array of
    its present ``(entity, role)`` cells. A document without cells has no row."""
    g = grid.repartition(key).groupBy(key, "sent_idx").agg(F.collect_list(F.struct("entity", "role")).alias("_c"))
    per = g.groupBy(key).agg(F.collect_list(F.struct("sent_idx", "_c")).alias("_e"))
    return per.select(key, by_index(F.col("_e"), "sent_idx", "_c", F.array().cast(_CELLS)).alias("columns"))


def permuted_cells(columns, perm) -> Column:
    """P6 in the pair's row: the present cells ``(entity, sent_idx, role)`` of the
    grid whose column ``dst`` is the column ``perm[dst]`` of ``columns``."""
    def moved(src, dst):
        own = F.coalesce(F.get(F.col(columns), src), F.array().cast(_CELLS))
        return F.transform(own, lambda c: F.struct(c["entity"].alias("entity"), dst.alias("sent_idx"), c["role"].alias("role")))
    return F.flatten(F.transform(F.col(perm), moved))


_CELLS = "array<struct<entity:string,role:string>>"


def permute_signatures(signatures: DataFrame, perms: DataFrame, key: str = "doc_id",
                       pair: str = "pair_id", perm: str = "perm") -> DataFrame:
    """The signatures of the grids that :func:`apply_permutation_grid` would
    make: a column keeps its signature wherever it goes, so a pair moves one row
    a column instead of all cells."""
    order = perms.select(pair, key, F.posexplode(perm).alias("dst", "src"))
    s = signatures.withColumnRenamed("sent_idx", "src")
    return order.join(s, [key, "src"]).select(pair, key, F.col("dst").alias("sent_idx"), "sig")


def apply_permutation_grid(grid: DataFrame, perms: DataFrame, key: str = "doc_id",
                           pair: str = "pair_id", perm: str = "perm") -> DataFrame:
    """Reorder every entity row's columns like the text: the negative's
    column ``dst`` is the positive's column ``perm[dst]`` -- an equi-join of
    the exploded permutation with the grid, no row rewriting."""
    order = perms.select(pair, key, F.posexplode(perm).alias("dst", "src"))
    g = grid.withColumnRenamed("sent_idx", "src")
    return order.join(g, [key, "src"], "inner").select(pair, key, "entity",
                                                       F.col("dst").alias("sent_idx"), "role")


def recover_permutation(pos_sig: DataFrame, neg_sig: DataFrame, key: str = "doc_id",
                        pair: str = "pair_id", mode: str = "first") -> DataFrame:
    """For each positive column the negative column with the same
    signature -> ``(pair, perm_idx ARRAY<INT>)`` indexed by positive column.

    ``first`` reproduces the reference (first identical column; identical
    columns collapse); ``bijective`` matches the k-th occurrence of a
    signature with the k-th occurrence."""
    from pyspark.sql.window import Window

    p = pos_sig.select(key, F.col("sent_idx").alias("pos_idx"), "sig")
    n = neg_sig.select(pair, key, F.col("sent_idx").alias("neg_idx"), "sig")
    if mode == "first":
        # first negative column per signature, before the join: one match per
        # positive column, never all pairs of identical columns
        first = n.groupBy(pair, key, "sig").agg(F.min("neg_idx").alias("neg_idx"))
        j = first.join(p, [key, "sig"], "inner").select(pair, "pos_idx", "neg_idx")
    elif mode == "bijective":
        p = p.withColumn("occ", F.row_number().over(Window.partitionBy(key, "sig").orderBy("pos_idx")))
        n = n.withColumn("occ", F.row_number().over(Window.partitionBy(pair, "sig").orderBy("neg_idx")))
        j = n.join(p, [key, "sig", "occ"], "inner").select(pair, "pos_idx", "neg_idx")
    else:
        raise ValueError(mode)
    agg = j.groupBy(pair).agg(F.array_sort(F.collect_list(F.struct("pos_idx", "neg_idx"))).alias("_m"))
    return agg.select(pair, F.transform("_m", lambda s: s["neg_idx"]).alias("perm_idx"))


def recover_permutation_arrays(pairs: DataFrame, pos: str, neg: str, pair: str = "pair_id",
                               mode: str = "first") -> DataFrame:
    """J4 where a pair holds the signatures of both grids' columns (or numbers that
    tell them apart) as arrays: :func:`recover_permutation` in the pair's row."""
    if mode not in ("first", "bijective"):
        raise ValueError(mode)
    r = align_order(pairs, neg, pos, pair, mode)  # each positive column among the negative's
    r = r.select(pair, F.filter("order", lambda i: i.isNotNull()).alias("perm_idx"))
    return r.where(F.size("perm_idx") > 0)


def join_text_grid(texts: DataFrame, grids: DataFrame, text_name: str = "name",
                   grid_name: str = "grid_name") -> DataFrame:
    """A grid file's first three dot parts are its text file's name."""
    g = grids.withColumn(text_name, F.substring_index(F.col(grid_name), ".", 3))
    return texts.join(g, text_name, "inner")
