"""J8 retrieval: per-term pruning is exact (equals brute force) even when a
hot term is shared by most candidates."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohera.operators import infill as IN
from cohera.operators.keywords import fit_tfidf, tfidf_weights


def test_retrieval_pruning_equals_brute_force(spark):
    pool_rows = [(f"c{i:03d}", f"hot hot word{i % 7} other{i % 5} extra{i % 3}") for i in range(120)]
    pool_rows += [(f"r{i}", f"rare{i} hot") for i in range(5)]
    pool = spark.createDataFrame(pool_rows, "cand_id string, candidate string")
    gaps = spark.createDataFrame([("g1", "hot word3 rare2"), ("g2", "other4 extra1 hot"), ("g3", "rare4 word6")],
                                 "gap_id string, gap_text string")
    k = 3
    got = IN.retrieve_candidates(gaps, pool, k).select("gap_id", "cand_no", "cand_id")
    idf = fit_tfidf(pool, "cand_id", "candidate")
    cw = tfidf_weights(pool, "cand_id", "candidate", idf).withColumnRenamed("weight", "cw")
    gw = tfidf_weights(gaps, "gap_id", "gap_text", idf).withColumnRenamed("weight", "gw")
    brute = gw.join(cw, "term").groupBy("gap_id", "cand_id").agg(F.max(F.col("gw") * F.col("cw")).alias("s"))
    w = Window.partitionBy("gap_id").orderBy(F.col("s").desc(), F.col("cand_id"))
    brute = brute.withColumn("cand_no", F.row_number().over(w)).filter(F.col("cand_no") <= k) \
                 .select("gap_id", "cand_no", "cand_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute.collect()))
    assert got.count() == 3 * k
