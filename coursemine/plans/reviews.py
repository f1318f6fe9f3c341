"""Completion, weak points, reviews and the adjustment of the next day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import strip
from coursemine.operators.ranking import latest_per_key, top_per_key


def half_up_percent(numerator: Column, denominator: Column) -> Column:
    """100 * numerator / denominator rounded half up, in integers only."""
    return F.floor((200 * numerator + denominator) / (2 * denominator))


def completion_rate(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """(plan_id, half_points, task_count, percent, completion_rate); plans without tasks count 0.

    A done task gives two half points, a partial one gives one.
    """
    points = F.when(F.col("status") == "done", 2).when(F.col("status") == "partial", 1).otherwise(0)
    sums = tasks.groupBy("plan_id").agg(F.sum(points).alias("half_points"), F.count(F.lit(1)).alias("task_count"))
    out = plans.select("plan_id").join(sums, "plan_id", "left").fillna(0, ["half_points", "task_count"])
    percent = F.when(
        F.col("task_count") > 0, half_up_percent(F.col("half_points"), 2 * F.col("task_count"))
    ).otherwise(F.lit(0))
    out = out.withColumn("percent", percent.cast("int"))
    return out.withColumn("completion_rate", F.col("percent") / F.lit(100.0))


def feedback_points(feedback: Column) -> Column:
    low = F.lower(F.coalesce(feedback, F.lit("")))
    parts = []
    for triggers, points in fv.FEEDBACK_RULES:
        test = F.lit(False)
        for trigger in triggers:
            test = test | low.contains(trigger)
        parts.append(F.when(test, F.array(*[F.lit(p) for p in points])).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def weak_points(plans: DataFrame, tasks: DataFrame, feedback: str = "feedback", n: int = 4) -> DataFrame:
    """(plan_id, weak_points): points named in the feedback, then titles of unfinished tasks; distinct, first n."""
    said = plans.select("plan_id", F.posexplode(feedback_points(F.col(feedback))).alias("at", "point"))
    left = tasks.filter(F.col("status").isin("partial", "missed")).select(
        "plan_id", (F.col("task_no") + 1000).alias("at"), F.coalesce("title", F.lit(fv.UNTITLED_TASK)).alias("point")
    )
    first = said.unionByName(left).filter(F.col("point") != "").groupBy("plan_id", "point").agg(F.min("at").alias("at"))
    kept = top_per_key(first, ["plan_id"], [F.col("at")], n, "turn")
    lists = kept.groupBy("plan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "point"))), lambda x: x["point"]).alias("_points")
    )
    out = plans.select("plan_id").join(lists, "plan_id", "left")
    return out.select("plan_id", F.coalesce("_points", F.array(F.lit(fv.DEFAULT_WEAK_POINT))).alias("weak_points"))


def review_plans(plans: DataFrame, tasks: DataFrame, feedback: str = "feedback") -> DataFrame:
    """Completion, weak points and the texts of the band the completion falls into."""
    base = plans.select("plan_id", "goal_id", "topic").join(completion_rate(plans, tasks), "plan_id").join(
        weak_points(plans, tasks, feedback), "plan_id"
    )
    summary = suggestions = None
    for least, text, advice in fv.REVIEW_BANDS:
        before, after = text.split("{topic}")
        line = F.concat(F.lit(before), F.col("topic"), F.lit(after))
        items = F.array(*[F.lit(a) for a in advice])
        test = F.col("percent") >= int(least * 100)
        summary = F.when(test, line) if summary is None else summary.when(test, line)
        suggestions = F.when(test, items) if suggestions is None else suggestions.when(test, items)
    return base.select(
        "plan_id", "goal_id", "percent", "completion_rate", summary.alias("summary"), "weak_points", suggestions.alias("suggestions")
    )


RAW_REVIEW = "completion_rate string, summary string, weak_points array<string>, suggestions array<string>"


def repair_reviews(raw: DataFrame, fallback: DataFrame) -> DataFrame:
    """Untrusted reviews (plan_id, raw JSON): rate clamped, lists of at most 6, blanks from the rule review."""
    r = raw.select("plan_id", F.from_json("raw", RAW_REVIEW).alias("r"))
    both = fallback.join(r, "plan_id", "left")
    rate = F.when(F.col("r.completion_rate").isNull(), F.col("completion_rate")).otherwise(F.col("r.completion_rate").try_cast("double"))
    usable = rate.isNotNull() & F.col("r").isNotNull()

    def strings(name: str) -> Column:
        kept = F.slice(F.filter(F.col(f"r.{name}"), lambda x: strip(x) != ""), 1, 6)
        return F.when(usable & (F.size(kept) > 0), kept).otherwise(F.col(name))

    return both.select(
        "plan_id",
        F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))).otherwise(F.col("completion_rate")).alias("completion_rate"),
        F.when(usable & (F.col("r.summary") != ""), F.col("r.summary")).otherwise(F.col("summary")).alias("summary"),
        strings("weak_points").alias("weak_points"), strings("suggestions").alias("suggestions"),
    )


def adjust_next_day(plans: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit rows, plans): the latest review of day d rewrites day d + 1 of the same goal.

    Without a review, or without a next day, nothing changes.
    """
    latest = latest_per_key(
        reviews.select("plan_id", "completion_rate", "weak_points", "created_at", "review_id"), ["plan_id"], ["created_at", "review_id"]
    )
    done = plans.select("plan_id", "goal_id", F.col("day_index").alias("from_day")).join(latest, "plan_id")
    today = done.select("goal_id", "from_day", (F.col("from_day") + 1).alias("day_index"), "completion_rate", "weak_points")
    tomorrow = plans.join(today, ["goal_id", "day_index"])
    point = F.when(F.size("weak_points") > 0, F.get("weak_points", F.lit(0))).otherwise(F.lit("今日薄弱点"))
    topic = F.col("topic")
    percent = (F.col("completion_rate") * 100).cast("int").cast("string")
    audit = tomorrow.select(
        "goal_id", "plan_id", "from_day", topic.alias("original_topic"), F.col("objective").alias("original_objective"),
        F.concat(F.lit("补强"), point, F.lit(" + "), topic).alias("adjusted_topic"),
        F.concat(
            F.lit("先用 30-40 分钟回补「"), point, F.lit("」，再推进「"), topic, F.lit("」的基础内容，避免薄弱点继续滚雪球。")
        ).alias("adjusted_objective"),
        F.concat(
            F.lit("今日完成率为 "), percent, F.lit("%，主要薄弱点集中在「"), point, F.lit("」，因此明日计划先补弱再推进。")
        ).alias("reason"),
    )
    return audit, apply_adjustments(plans, audit)


def repair_adjustments(raw: DataFrame, audit: DataFrame) -> DataFrame:
    """Untrusted texts (plan_id, raw JSON) over the rule adjustment; blanks keep the rule's text."""
    r = raw.select("plan_id", F.from_json("raw", "adjusted_topic string, adjusted_objective string, reason string").alias("r"))
    pick = lambda c: F.when(F.col(f"r.{c}") != "", F.col(f"r.{c}")).otherwise(F.col(c))
    return (
        audit.join(r, "plan_id", "left").withColumn("adjusted_topic", F.substring(pick("adjusted_topic"), 1, 200))
        .withColumn("adjusted_objective", pick("adjusted_objective")).withColumn("reason", pick("reason")).drop("r")
    )


def apply_adjustments(plans: DataFrame, audit: DataFrame) -> DataFrame:
    a = audit.select("plan_id", "adjusted_topic", "adjusted_objective", "reason")
    out = plans.join(a, "plan_id", "left")
    hit = F.col("adjusted_topic").isNotNull()
    return (
        out.withColumn("topic", F.coalesce("adjusted_topic", "topic")).withColumn("objective", F.coalesce("adjusted_objective", "objective"))
        .withColumn("adjusted", hit).withColumn("adjustment_reason", F.col("reason")).drop("adjusted_topic", "adjusted_objective", "reason")
    )
