from pyspark.sql import functions as F

from coursemine.operators import outline as ol


def test_titles_are_cleaned_once_for_their_tests(spark):
    """The filter lies below the projection of the title; the cleaning must not be repeated in each of its tests."""
    rows = spark.range(30).select(
        F.lit(1).alias("material_id"), F.col("id").alias("toc_no"), F.lit("2").alias("level"), F.lit("7").alias("page"),
        F.concat(F.lit("# Chapter "), F.col("id"), F.lit(" Heat ..... 12")).alias("title"))
    out = ol.outline_from_toc_rows(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\.{2,}") <= 4
    assert [r["title"] for r in out.orderBy("order").limit(2).collect()] == ["Chapter 0 Heat", "Chapter 1 Heat"]
