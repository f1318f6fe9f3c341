"""Joins whose key has few values, and parts of a query that are computed once."""

from pyspark.sql import functions as F

from coursemine.catalog import plan_queries as pq
from coursemine.plans import quiz as qz


def questions(spark):
    tasks = spark.range(1000).select(
        F.col("id").alias("plan_id"), F.lit(1).alias("task_no"), F.lit("t").alias("topic"),
        F.when(F.col("id") % 100 == 0, "rings").otherwise("generic").alias("template"))
    return qz.instantiate_questions(tasks, pq.question_templates(spark))


def test_tasks_are_not_dealt_out_by_template(spark):
    """At 64 partitions the planner would not send the templates by itself, and a task would hold nearly all rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = questions(spark)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(template" not in plan
        assert out.count() == 3000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_templates_meet_tasks_in_salts(spark, monkeypatch):
    small = sorted(questions(spark).select("plan_id", "pos", "question").collect())
    monkeypatch.setattr(qz, "SENT_TEMPLATES", 2)
    assert sorted(questions(spark).select("plan_id", "pos", "question").collect()) == small


def reads(df, column):
    """How often the plan reads a table by this column."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(column)


def test_grades_are_computed_once(spark):
    """Rule grades are stored: the plan of the repair numbers no answers again."""
    df = pq.q_repair_grades(spark, "/root/testdata/sf0.001")
    assert reads(df, "row_number()") == 0


def test_reviews_and_audit_are_computed_once(spark):
    df = pq.q_adjusted_plans(spark, "/root/testdata/sf0.001")
    assert reads(df, "row_number()") == 0
