"""Draws of the bootstrap are not held in a table of (replicate, chip)."""

from pyspark.sql import functions as F

from furrow.operators import evaluation


def test_draws_meet_their_chip(spark):
    stats = spark.range(30).select("id", *[(F.col("id") * k + 1).alias(c) for k, c in enumerate(evaluation.COUNTS)])
    found = evaluation.bootstrap_by_draws(stats, "id", 20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [rep" in plan and not any("Aggregate [rep" in line and "idx" in line for line in plan.split("\n"))
    assert found.count() == len(evaluation.METRICS)
