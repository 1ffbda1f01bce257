from pyspark.sql import functions as F

from tonelake.plans.ranks import numbered, running_sums


def test_running_sums_across_parts(spark):
    rows = [(i * 7919 % 1000, i % 13, None if i % 5 == 0 else i * 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, n long, x double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running_sums(df, [F.desc("k")], {"upto": "n", "sum": "x"}).collect()
        assert len(running_sums(df, [F.desc("k")], {"upto": "n"}).select(F.spark_partition_id()).distinct().collect()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, n, x = {}, 0, 0.0
    for k, a, b in sorted(rows, reverse=True):
        n, x = n + a, x + (b or 0)
        want[k] = (n, x)
    assert {r.k: (r.upto, r.sum) for r in out} == want
    assert running_sums(df.limit(0), [F.col("k")], {"upto": "n"}).collect() == []


def test_numbered(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("B",)], "s string")
    assert {r.s: r.n for r in numbered(df, [F.col("s").isNull(), F.col("s")], "n").collect()} == {"B": 1, "a": 2, "b": 3, None: 4}
