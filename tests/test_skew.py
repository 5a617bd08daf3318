from newsloom.plans.skew import split_join


def test_hot_keys_are_divided_and_nothing_is_lost_or_doubled(spark):
    rows = [(i % 3 if i % 2 else 7, i) for i in range(300)] + [(None, 1)]
    one, two = spark.createDataFrame(rows, "k int, a int"), spark.createDataFrame([(k, v) for k, v in rows], "k int, b int")
    want = sorted(map(tuple, one.join(two, "k").collect()))
    for limit in (10, 60, 10_000):
        assert sorted(map(tuple, split_join(one, two, "k", left_by="a", right_by="b", rows=limit).select("k", "a", "b").collect())) == want


def test_a_hot_key_is_no_longer_one_task(spark):
    rows = spark.range(4000).selectExpr("cast(0 as int) k", "id a").repartition(4)
    joined = split_join(rows, rows.withColumnRenamed("a", "b"), "k", left_by="a", right_by="b", rows=500).filter("a < b")
    sizes = [r[0] for r in joined.selectExpr("spark_partition_id() p").groupBy("p").count().selectExpr("count").collect()]
    assert sum(sizes) == 4000 * 3999 // 2 and max(sizes) < 0.75 * sum(sizes)


def test_empty(spark):
    none = spark.createDataFrame([], "k int, a int")
    assert split_join(none, none.withColumnRenamed("a", "b"), "k", left_by="a", right_by="b").count() == 0
