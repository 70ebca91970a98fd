"""Dense index and split properties."""

from pyspark.sql import functions as F

from cohera.operators import sampling as SM


def test_dense_index_partition_independent(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k"))
    res = []
    for n in (1, 4, 64):
        d, total = SM.dense_index(df.repartition(n), ["k"], "idx", n_partitions=n)
        assert total == 1000
        res.append(sorted((r.k, r.idx) for r in d.collect()))
    assert res[0] == res[1] == res[2]
    assert [i for _, i in res[0]] == list(range(1000))
    assert [k for k, _ in res[0]] == sorted(k for k, _ in res[0])


def test_splits_disjoint_and_complete(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    tr, te = SM.train_test_split(df, 0.2, 42, "key")
    assert tr.count() + te.count() == 2000
    assert tr.join(te, "key").count() == 0
    ex = SM.sample_fraction(df, 0.2, 42, "key", exact=True)
    assert ex.count() == 400
    assert SM.complement(df, ex, "key").count() == 1600


def test_exact_sample_histogram_path_matches_brute_force(spark):
    from cohera.functions.hashing import md5_key
    df = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    got = SM.sample_fraction(df, 0.3, 7, "key", exact=True, bucket_rows=5)
    brute = df.withColumn("h", md5_key(7, F.col("key"))).orderBy("h").limit(1500).select("key")
    assert got.count() == 1500
    assert got.exceptAll(brute).count() == 0
