"""Goals, plans and tasks: validation, expansion, budgets, roll-ups, repair of outside plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import lines, strip, unnest
from coursemine.operators.ranking import latest_per_key, top_per_key
from coursemine.sources.tables import delete_for_replan

Strings = "array<string>"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def goal_problems() -> Column:
    checks = [
        (~F.coalesce(F.length("title").between(2, 200), F.lit(False)), "title must have 2-200 characters"),
        (~F.coalesce(F.col("goal_type").isin("exam", "duration"), F.lit(False)), "unknown goal_type"),
        ((F.col("goal_type") == "exam") & F.col("exam_date").isNull(), "exam goals need exam_date"),
        ((F.col("goal_type") == "duration") & F.col("duration_days").isNull(), "duration goals need duration_days"),
        (F.col("duration_days").isNotNull() & ~F.col("duration_days").between(3, 120), "duration_days must be 3-120"),
        (~F.coalesce(F.col("daily_minutes").between(30, 600), F.lit(False)), "daily_minutes must be 30-600"),
        (~F.coalesce(F.length("current_level").between(1, 40), F.lit(False)), "current_level must have 1-40 characters"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in checks]))


def validate_goals(goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    checked = goals.withColumn("reasons", goal_problems())
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def parse_topics(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,，]"), strip), lambda x: x != "")


def goal_end_date(today: Column) -> Column:
    return F.coalesce(F.col("exam_date"), F.date_add(today, F.greatest(F.coalesce("duration_days", F.lit(1)), F.lit(1)) - 1))


def day_count(today: Column) -> Column:
    clamp = lambda c: F.greatest(F.lit(3), F.least(c, F.lit(120)))
    named = F.regexp_extract("title", r"(\d+)\s*天", 1)
    fixed = (F.col("goal_type") == "duration") & (F.coalesce("duration_days", F.lit(0)) != 0)
    return (
        F.when(fixed, clamp(F.col("duration_days")))
        .when(named != "", clamp(F.coalesce(named.try_cast("int"), F.lit(120))))
        .when(F.col("exam_date").isNotNull(), clamp(F.date_diff(F.col("exam_date"), today)))
        .otherwise(F.lit(10))
        .cast("int")
    )


def hit_topics(hits: DataFrame, n: int = 5) -> DataFrame:
    """(goal_id, topics): short lines of the hits (goal_id, rank, content) in rank order."""
    cut = F.transform(lines(F.col("content")), lambda x: F.regexp_replace(x, r"\A[ #\t:\-—]+|[ #\t:\-—]+\z", ""))
    each = unnest(hits, ["goal_id", "rank"], F.filter(cut, lambda x: F.length(x).between(4, 40)), "pos", "topic")
    first = each.groupBy("goal_id", "topic").agg(F.min(F.struct("rank", "pos")).alias("at"))
    kept = top_per_key(first, ["goal_id"], [F.col("at")], n, "turn")
    return kept.groupBy("goal_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "topic"))), lambda x: x["topic"]).alias("topics")
    )


def resolve_topics(goals: DataFrame, outlines: DataFrame, hits: DataFrame) -> DataFrame:
    """Goals with ``topics``: own key topics, else outline titles, else lines of hits, else the defaults."""
    a = outlines.select("goal_id", F.col("topics").alias("_outline"))
    b = hit_topics(hits).select("goal_id", F.col("topics").alias("_hits"))
    given = lambda c: F.when(F.size(c) > 0, c)
    topics = F.coalesce(
        given(F.col("key_topics")), given(F.col("_outline")), given(F.col("_hits")), _strings(fv.DEFAULT_TOPICS)
    )
    return goals.join(a, "goal_id", "left").join(b, "goal_id", "left").withColumn("topics", topics).drop("_outline", "_hits")


def material_note(has_hits: Column, files: Column) -> Column:
    return (
        F.when(~F.coalesce(has_hits, F.lit(False)), F.lit(""))
        .when(F.coalesce(files, F.lit("")) == "", F.lit(" 结合上传资料中的相关章节。"))
        .otherwise(F.concat(F.lit(" 结合上传资料「"), files, F.lit("」中的相关章节。")))
    )


def expand_plans(goals: DataFrame, today: Column, note: Column | None = None) -> DataFrame:
    """One row per goal and day.  Goals need ``topics``; every goal has at most 120 days."""
    note = F.lit("") if note is None else note
    staged = goals.withColumn("_n", day_count(today)).withColumn("_note", note)
    days = staged.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pool = F.concat(F.col("topics"), _strings(fv.DEFAULT_TOPICS))
    last = F.col("_i") == F.col("_n") - 1
    practice = F.col("_i") >= F.greatest(F.col("_n") - 2, F.lit(1))
    own = F.element_at(pool, (F.col("_i") % F.size(pool) + 1).cast("int"))
    topic = F.when(last, fv.LAST_DAY_TOPIC).when(practice, fv.PRACTICE_DAY_TOPIC).otherwise(own)
    objective = (
        F.when(last, F.lit(fv.LAST_DAY_OBJECTIVE))
        .when(practice, F.concat(F.lit(fv.PRACTICE_DAY_OBJECTIVE), F.col("_note")))
        .otherwise(F.concat(F.lit("围绕「"), own, F.lit("」建立核心概念框架，并完成基础题巩固。"), F.col("_note")))
    )
    return days.select(
        "goal_id", (F.col("_i") + 1).cast("int").alias("day_index"), F.date_add(today, F.col("_i")).alias("plan_date"),
        topic.alias("topic"), objective.alias("objective"),
    )


RAW_PLAN = "array<struct<day_index:string,plan_date:string,topic:string,objective:string>>"


def repair_plans(raw: DataFrame, fallback: DataFrame) -> DataFrame:
    """Untrusted plans (goal_id, raw JSON) against the rule plan: a bad row discards the goal's whole set."""
    items = unnest(raw, ["goal_id"], F.from_json("raw", RAW_PLAN), "pos", "i").select(
        "goal_id", (F.col("pos") + 1).alias("_at"), F.col("i").isNull().alias("_missing"), "i.*"
    )
    items = items.withColumnsRenamed({c: "_" + c for c in ("day_index", "plan_date", "topic", "objective")})
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    both = fallback.withColumn("_at", F.col("day_index")).join(items, ["goal_id", "_at"], "left")
    present = F.col("_missing").isNotNull()
    date = F.when(given("_plan_date").isNull(), F.col("plan_date")).otherwise(
        F.when(F.substring("_plan_date", 1, 10).rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.substring("_plan_date", 1, 10).try_cast("date"))
    )
    number = F.when(F.col("_day_index").isNull(), F.col("_at")).otherwise(F.col("_day_index").try_cast("int"))
    bad = F.coalesce(F.col("_missing"), F.lit(False)) | (present & (date.isNull() | number.isNull()))
    ok = both.groupBy("goal_id").agg((~F.bool_or(bad)).alias("_ok"))
    merged = both.withColumn("_date", date).withColumn("_number", number).join(ok, "goal_id")
    use = F.col("_ok") & F.col("_missing").isNotNull()
    return merged.select(
        "goal_id",
        F.when(use, F.col("_number")).otherwise(F.col("day_index")).cast("int").alias("day_index"),
        F.when(use, F.col("_date")).otherwise(F.col("plan_date")).alias("plan_date"),
        F.when(use, F.substring(F.coalesce(given("_topic"), F.col("topic")), 1, 200)).otherwise(F.col("topic")).alias("topic"),
        F.when(use, F.coalesce(given("_objective"), F.col("objective"))).otherwise(F.col("objective")).alias("objective"),
    )


def replace_plans(tables: dict[str, DataFrame], new_plans: DataFrame) -> dict[str, DataFrame]:
    """Tables after the plans of the new rows' goals are replaced; those goals become active."""
    goals = new_plans.select("goal_id").distinct()
    out = delete_for_replan(tables, goals)
    out["plan"] = out["plan"].unionByName(new_plans, allowMissingColumns=True)
    marked = tables["goal"].join(goals.withColumn("_new", F.lit(True)), "goal_id", "left")
    out["goal"] = marked.withColumn("status", F.when(F.col("_new"), "active").otherwise(F.col("status"))).drop("_new")
    return out


def reference_note(source: Column) -> Column:
    return F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit(" 参考资料："), source, F.lit("。"))).otherwise(F.lit(""))


def allocate_tasks(plans: DataFrame, goals: DataFrame, note: Column | None = None) -> DataFrame:
    """Four tasks per plan; minutes by share of the goal's day, the last takes the remainder."""
    note = F.lit("") if note is None else note
    p = plans.withColumn("_note", note).join(goals.select("goal_id", "daily_minutes"), "goal_id")
    day = F.col("daily_minutes")
    spent, items = F.lit(0), []
    for turn, (kind, share, least, title, text) in enumerate(fv.TASK_TEMPLATES, 1):
        minutes = F.greatest(F.lit(least), F.floor(day * F.lit(share)).cast("int") if share else day - spent)
        spent = spent + minutes
        before, _, after = title.partition("{topic}")
        shown = F.concat(F.lit(before), F.col("topic"), F.lit(after)) if after else F.lit(title)
        body = F.concat(F.lit(text), F.col("_note")) if turn == 1 else F.lit(text)
        items.append(
            F.struct(
                F.lit(turn).alias("task_no"), shown.alias("title"), body.alias("description"),
                minutes.cast("int").alias("estimated_minutes"), F.lit(kind).alias("task_type"),
            )
        )
    return p.select("plan_id", "goal_id", F.inline(F.array(*items)))


def repair_tasks(raw: DataFrame, plans: DataFrame, goals: DataFrame) -> DataFrame:
    """Untrusted tasks (plan_id, pos, title, description, estimated_minutes text, task_type) within the day's budget.

    Plans without usable rows get the rule tasks, and so does a plan with an unusable
    value up to and including the first row behind the budget: minutes are read before
    the budget is looked at.
    """
    first = top_per_key(raw, ["plan_id"], [F.col("pos")], 6, "task_no")
    budget = plans.join(goals.select("goal_id", "daily_minutes"), "goal_id").select("plan_id", "goal_id", "daily_minutes")
    minutes = F.greatest(F.lit(5), F.when(F.col("estimated_minutes").isNull(), 20).otherwise(F.col("estimated_minutes").try_cast("int")))
    wrong = F.col("estimated_minutes").isNotNull() & F.col("estimated_minutes").try_cast("int").isNull()
    w = Window.partitionBy("plan_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    timed = (
        first.join(budget, "plan_id").withColumn("_m", minutes).withColumn("_wrong", wrong)
        .withColumn("_before", F.coalesce(F.sum("_m").over(w), F.lit(0)))
        .withColumn("_earlier", F.lag("_before").over(Window.partitionBy("plan_id").orderBy("pos")))
        .filter(F.col("_earlier").isNull() | (F.col("_earlier") < F.col("daily_minutes")))
    )
    fits = F.col("_before") < F.col("daily_minutes")
    spoiled = timed.groupBy("plan_id").agg(F.bool_or("_wrong").alias("_bad"))
    text = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.lit(other))
    good = timed.filter(fits).join(spoiled.filter(~F.col("_bad")).select("plan_id"), "plan_id", "left_semi").select(
        "plan_id", "goal_id", "task_no", F.substring(text("title", "学习任务"), 1, 200).alias("title"),
        text("description", "完成指定学习内容。").alias("description"),
        F.least(F.col("_m"), F.col("daily_minutes") - F.col("_before")).cast("int").alias("estimated_minutes"),
        F.substring(text("task_type", "study"), 1, 40).alias("task_type"),
    )
    rest = plans.join(good.select("plan_id").distinct(), "plan_id", "left_anti")
    return good.unionByName(allocate_tasks(rest, goals))


TASK_STATES = ["pending", "partial", "done", "missed"]


def apply_status_updates(tasks: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected): the latest valid update per task (plan_id, task_no, status, ts, event_id) wins."""
    known = F.col("status").isin(*TASK_STATES)
    latest = updates.filter(known).groupBy("plan_id", "task_no").agg(F.max_by("status", F.struct("ts", "event_id")).alias("_status"))
    out = tasks.join(latest, ["plan_id", "task_no"], "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    bad = updates.filter(~known).withColumn("reason", F.lit("unknown status"))
    lost = updates.filter(known).join(tasks.select("plan_id", "task_no"), ["plan_id", "task_no"], "left_anti")
    return out, bad.unionByName(lost.withColumn("reason", F.lit("unknown task")))


# --- roll-ups -----------------------------------------------------------------


def goal_summaries(goals: DataFrame, plans: DataFrame, materials: DataFrame) -> DataFrame:
    """Goals with plan_count and material_count, newest update first; children are counted before the join."""
    count = lambda df, name: df.groupBy("goal_id").agg(F.count(F.lit(1)).alias(name))
    out = goals.join(count(plans, "plan_count"), "goal_id", "left").join(count(materials, "material_count"), "goal_id", "left")
    return out.fillna(0, ["plan_count", "material_count"]).orderBy(F.col("updated_at").desc(), F.col("goal_id").desc())


def goal_timeline(goals: DataFrame, plans: DataFrame) -> DataFrame:
    """Goal columns beside each of its plans, in day order; goals without plans keep one row."""
    p = plans.withColumnRenamed("status", "plan_status")
    return goals.join(p, "goal_id", "left").orderBy("goal_id", "day_index")


def plan_context(plans: DataFrame, goals: DataFrame, tasks: DataFrame, reviews: DataFrame, quizzes: DataFrame) -> DataFrame:
    """One row per plan: parent goal, first 8 tasks, task count, latest review, quiz count."""
    first = top_per_key(tasks, ["plan_id"], [F.col("task_no")], 8, "_n")
    nested = first.groupBy("plan_id").agg(
        F.array_sort(F.collect_list(F.struct("task_no", "title", "status"))).alias("tasks")
    )
    sizes = tasks.groupBy("plan_id").agg(F.count(F.lit(1)).alias("task_count"))
    review = latest_per_key(reviews, ["plan_id"], ["created_at", "review_id"]).select("plan_id", F.struct("review_id", "summary").alias("latest_review"))
    quiz = quizzes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("quiz_count"))
    g = goals.select("goal_id", F.col("title").alias("goal_title"), "daily_minutes")
    out = plans.join(g, "goal_id", "left")
    for part in (nested, sizes, review, quiz):
        out = out.join(part, "plan_id", "left")
    return out.fillna(0, ["task_count", "quiz_count"])


def material_rollup(materials: DataFrame) -> DataFrame:
    return materials.groupBy("goal_id").agg(
        F.count(F.lit(1)).alias("materials"), F.count_if(F.col("parse_status").isin("ready", "ocr_ready")).alias("ready"),
        F.sum("chunk_count").alias("chunks"),
    )


def list_children(table: DataFrame, parents: DataFrame, order: list[Column], searchable: bool = False, file_type: str | None = None) -> DataFrame:
    """Rows of all ``parents`` (distinct key columns), sorted by parent and then the given order.

    Optionally only searchable materials or one file type.
    """
    keys = parents.columns
    table = table.join(parents.distinct(), keys, "left_semi")
    if searchable:
        table = table.filter((F.col("parse_status") == "ready") & (F.col("chunk_count") > 0))
    if file_type:
        table = table.filter(F.lower("file_type") == file_type)
    return table.orderBy(*keys, *order)


def resolve_scope(requests: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, rejected) of requests (request_id, goal_id, plan_id?, day_index?); a plan id wins over a day."""
    by_id = plans.select(F.col("plan_id"), F.col("goal_id").alias("_g"), F.col("day_index").alias("_d"))
    by_day = plans.groupBy("goal_id", "day_index").agg(F.min("plan_id").alias("_p"))
    r = requests.join(by_id, "plan_id", "left").join(by_day, ["goal_id", "day_index"], "left")
    asked_plan, asked_day = F.col("plan_id").isNotNull(), F.col("day_index").isNotNull()
    reason = F.when(asked_plan & ~F.coalesce(F.col("_g") == F.col("goal_id"), F.lit(False)), "Plan does not belong to goal").when(
        ~asked_plan & asked_day & F.col("_p").isNull(), "Plan day not found"
    )
    out = r.select(
        "request_id", "goal_id", F.when(asked_plan, F.col("plan_id")).otherwise(F.col("_p")).alias("plan_id"),
        F.when(asked_plan, F.col("_d")).otherwise(F.col("day_index")).alias("day_index"), reason.alias("reason"),
    )
    return out.filter(F.col("reason").isNull()).drop("reason"), out.filter(F.col("reason").isNotNull()).select("request_id", "goal_id", "reason")
