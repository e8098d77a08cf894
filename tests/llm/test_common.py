from leadlens.llm import common


def test_partitions_follow_bytes_only_where_the_sessions_would_be_larger(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert common.dealt_by_bytes(df, ["k"], 8 << 20, 1 << 20) is df  # 8 partitions in the session
    dealt = common.dealt_by_bytes(df, ["k"], 40 << 20, 1 << 20)
    assert dealt.rdd.getNumPartitions() == 40 and dealt.count() == 1000
