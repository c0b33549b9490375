"""The split form of every group helper must equal its plain window form."""

from pyspark.sql import functions as F

from conftest import rows
from tablework import scale


def _frame(spark):
    n = 3000
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        (F.hash("id") % 100000).alias("o"),
        F.col("id"),
        F.when(F.hash(F.col("id") + 7) % 4 == 0, F.col("id")).alias("v"),
    )


def test_rank_split_equals_plain(spark, split_groups):
    df = _frame(spark)
    assert scale.is_large(df)
    plain = scale.rank_in_group(df, ["k"], ["o", "id"], "r")
    assert rows(scale.rank(df, ["k"], ["o", "id"], "r")) == rows(plain)
    hot = scale.hot_buckets(df, ["k"])
    assert scale.with_chunk(df, ["k"], ["o", "id"], hot).filter("k = 'hot'").select("__chunk").distinct().count() > 50


def test_previous_and_fill_split_equal_plain(spark, split_groups):
    df = _frame(spark)
    split = scale.previous(df, ["k"], ["o", "id"], F.col("v"), "p")
    filled = scale.fill_down(df, ["k"], ["o", "id"], {"f": F.col("v")})
    got, got_fill = rows(split), rows(filled)
    spark.conf.set("spark.tablework.splitBytes", str(1 << 40))
    assert got == rows(scale.previous(df, ["k"], ["o", "id"], F.col("v"), "p"))
    assert got_fill == rows(scale.fill_down(df, ["k"], ["o", "id"], {"f": F.col("v")}))


def test_join_unique_split_equals_plain(spark, split_groups):
    df = _frame(spark)
    right = df.filter("k is not null").groupBy("k").agg(F.min("id").alias("first"))
    right = right.filter("k <> 'k5'")
    plain = df.join(right, ["k"], "left").select("k", "o", "id", "v", "first")
    assert rows(scale.join_unique(df, right, ["k"]).select("k", "o", "id", "v", "first")) == rows(plain)


def test_first_per_group_limits_before_shuffle(spark):
    df = scale.first_per_group(_frame(spark), ["k"], ["o", "id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_no_chunk_outgrows_the_bound(spark, split_groups):
    """Nine tenths of the rows on one key: every (key, chunk) holds at most the rows that a task should."""
    df = spark.range(6000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.hash("id") % 1000).alias("o"), "id", F.lit(None).cast("long").alias("v"))
    want = rows(scale.rank_in_group(df, ["k"], ["o", "id"], "r"))
    for bound in (100, 700, 3000):
        spark.conf.set("spark.tablework.hotMinRows", str(bound))
        hot = scale.hot_buckets(df, ["k"])
        assert list(hot.values()) == [5400]
        sizes = scale.with_chunk(df.filter("k = 'hot'"), ["k"], ["o", "id"], hot).groupBy("k", "__chunk").count()
        assert sizes.agg(F.max("count")).first()[0] <= bound
        assert rows(scale.rank(df, ["k"], ["o", "id"], "r")) == want
    spark.conf.set("spark.tablework.hotMinRows", "10000")
    assert scale.hot_buckets(df, ["k"]) == {}


def test_spread_gives_tasks_equal_shares(spark, tmp_path):
    """More input makes more partitions, not larger ones."""
    spark.range(20000).selectExpr("id", "uuid() as t").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert scale.spread(df).rdd.getNumPartitions() == cores
    spark.conf.set("spark.tablework.taskBytes", str(scale.source_bytes(df) // (5 * cores)))
    try:
        assert scale.spread(df).rdd.getNumPartitions() >= 5 * cores
    finally:
        spark.conf.unset("spark.tablework.taskBytes")
