import random

import pytest
from pyspark.sql import functions as F

from kohorta.plans.skew import small_table, spread_join
from kohorta.session import checkpoint_dir, written



@pytest.fixture
def fact(table):
    rng = random.Random(7)
    # One key holds a third of the rows.
    return table([(0 if i % 3 == 0 else rng.randint(1, 40), i) for i in range(1200)], "k INT, v INT")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_plain_join(fact, rows, how):
    tops = fact.groupBy("k").agg(F.max("v").alias("top")).where("k <> 3")
    plain = fact.join(tops, "k", how)
    assert rows(spread_join(fact, tops, ["k"], how).select(plain.columns)) == rows(plain)


def test_hot_key_is_split(spark):
    """With thresholds for small data, the shuffle of a hot key's rows is split in the plan that ran."""
    lowered = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in lowered}
    try:
        for key, value in lowered.items():
            spark.conf.set(key, value)
        rows = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("k"), "id")
        joined = spread_join(rows, rows.groupBy("k").agg(F.max("id").alias("top")), ["k"])
        assert joined.where("id > top").count() == 0
        assert joined.count() == 200_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_small_table(fact, rows):
    assert small_table(fact, 10) is None
    few = fact.groupBy("k").agg(F.count("*").alias("n"))
    assert rows(small_table(few, 100)) == rows(few)


def test_written_goes_to_the_checkpoint_folder(spark, fact, rows):
    back = written(fact, "probe")
    assert all(f.startswith("file:") and checkpoint_dir(spark) in f for f in back.inputFiles())
    assert rows(back) == rows(fact)
