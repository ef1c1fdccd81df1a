import pytest
from conftest import dicts
from pyspark.sql import functions as F

from vendastat.operators.lookup import hot_keys, lookup_join


@pytest.fixture
def skewed(spark):
    """9000 rows: key 7 on a third, no key on a third, the rest spread over 1000 keys."""
    third = F.col("id") % 3
    key = F.when(third == 0, 7).when(third == 1, F.col("id") % 1000 + 100)
    return spark.range(9000).select(F.col("id").alias("row"), key.cast("bigint").alias("k"))


@pytest.fixture
def lookup(spark):
    # The hot key has a match, every second other key has one.
    return spark.range(0, 2000).where("id = 7 OR id % 2 = 0").select(
        F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")
    )


def test_hot_keys_are_found_exactly(skewed):
    found = dict(hot_keys(skewed, "k", share=0.1))
    assert set(found) == {7, None}
    assert found[7] == found[None] == 4  # 3000 rows, 900 per salt


def test_no_hot_keys(spark):
    assert hot_keys(spark.range(1000).toDF("k"), "k", share=0.01) == []
    assert hot_keys(spark.range(0).toDF("k"), "k") == []


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("share", [0.1, 1e-4])
def test_salted_join_equals_plain_join(spark, skewed, lookup, how, share):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(skewed, lookup, "k", how, share=share)
        assert joined.columns == ["row", "k", "name"]
        got = sorted(tuple(r) for r in joined.select("row", "name").fillna("-").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = skewed.join(lookup, "k", how).select("row", "name").fillna("-")
    assert got == sorted(tuple(r) for r in plain.collect())


def test_hot_rows_leave_the_single_partition(spark, skewed, lookup):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        def largest(df):
            return dicts(df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("n")))[0]["n"]

        # Few matching rows besides the hot key, so its spread shows.
        assert largest(skewed.join(lookup, "k")) >= 3000
        assert largest(lookup_join(skewed, lookup, "k", "inner", share=0.01)) < 2000
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_small_lookup_is_broadcast_and_large_one_is_not(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/k")
    small = spark.read.parquet(f"{tmp_path}/k").withColumn("v", F.lit(1))
    rows = spark.range(1000).withColumnRenamed("id", "k")

    def plan(df):
        return df._jdf.queryExecution().sparkPlan().toString()

    assert "BroadcastHashJoin" in plan(lookup_join(rows, small, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "BroadcastHashJoin" not in plan(lookup_join(rows, small, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
