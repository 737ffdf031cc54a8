from pyspark.sql import functions as F

from tessella.llm.native import sketch


def test_a_sketch_keeps_all_values_and_stays_out_of_the_plans_text(spark):
    known = spark.range(0, 300_000, 3).select((F.col("id") * 1_000_003 - 7).alias("v"))
    may = sketch(known, F.col("v"))
    rows = spark.range(0, 30_000).select((F.col("id") * 1_000_003 - 7).alias("x")).unionByName(spark.sql("select cast(null as bigint) as x"))
    kept = rows.where(may(F.col("x")))
    got = {r["x"] for r in kept.collect()}
    assert {i * 1_000_003 - 7 for i in range(0, 30_000, 3)} <= got
    assert len(got) < 15_000 and None not in got
    for text in (kept._jdf.queryExecution().toString(), kept._jdf.queryExecution().executedPlan().treeString()):
        assert len(text) < 10_000


def test_a_sketch_of_nothing_lets_nothing_pass(spark):
    may = sketch(spark.range(0), F.col("id"))
    assert spark.range(100).where(may(F.col("id"))).count() == 0
