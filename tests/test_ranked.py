import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from attesta.operators.ranked import with_rank
from attesta.operators.spread import spread


def test_ranks_equal_a_window_also_for_one_large_scope(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int, v double").repartition(6)
    got = {r.id: r["rank"] for r in with_rank(df, ["k"], ["v", "id"]).collect()}
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("v", "id"))).collect()}
    assert got == want and len(got) == 3000
    assert with_rank(df.where("false"), ["k"], ["id"]).count() == 0


def test_spreading_keeps_the_rows(spark):
    df = spark.range(0, 100, 1, 1)
    assert spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and spread(df).count() == 100
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide) is wide
