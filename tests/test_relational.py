from collections import Counter

from headwater.operators import relational


def test_null_keys_are_dealt_out(spark):
    a = spark.createDataFrame([(1, 10), (None, 11), (None, 12), (2, 13)], "k int, a int")
    b = spark.createDataFrame([(1, 20), (3, 21), (None, 22)], "k int, b int")
    c = spark.createDataFrame([(1, 30), (3, 31), (None, 32)], "k int, c int")
    got = Counter(map(tuple, relational.full_chain_on_first([a, b, c], "k").collect()))
    assert got == Counter([(1, 10, 20, 30), (None, 11, None, None), (None, 12, None, None), (2, 13, None, None), (None, None, 21, None), (None, None, 22, None), (None, None, None, 31), (None, None, None, 32)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        nulls = spark.range(4000).selectExpr("CAST(NULL AS INT) AS k", "id AS a")
        joined = relational.full_chain_on_first([nulls, b.limit(3)], "k")
        sizes = [len(p) for p in joined.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4003 and max(sizes) < 2500


def test_product(spark):
    got = relational.product(spark.range(3).toDF("a"), spark.range(4).toDF("b"))
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(3) for b in range(4)]
    assert relational.product(spark.range(0).toDF("a"), spark.range(4).toDF("b")).count() == 0
