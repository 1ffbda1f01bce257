from tonelake.plans.joins import join_back


def test_join_back_keeps_nulls_and_shuffles_both_sides(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k long, v string")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = {(r.k, r.v, r.n) for r in join_back(rows, groups, ["k"]).collect()}
    assert got == {(1, "a", 2), (1, "b", 2), (None, "c", 1), (2, "d", 1)}
    assert {r.v for r in join_back(rows, groups.where("n > 1"), ["k"], "left_semi").collect()} == {"a", "b"}
    assert {r.v for r in join_back(rows, groups.where("n > 1"), ["k"], "left_anti").collect()} == {"c", "d"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_back(rows, groups, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3


def test_a_large_table_is_never_broadcast_by_estimate(spark):
    from tonelake.plans import joins

    rows, groups = spark.range(20).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    plan = lambda df: df.join(groups, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(joins.unless_few(rows)) and "BroadcastHashJoin" in plan(joins.unless_few(rows, joins.FEW_ROWS))
    for df in (joins.shuffled(rows), joins.unless_few(rows, joins.FEW_ROWS + 1)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df) and df.join(groups, "k").count() == 5
