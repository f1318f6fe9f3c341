"""Registered queries on goals, plans, tasks, reviews and quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemine.catalog import duck as d
from coursemine.catalog.outline_queries import _outline, _T, materials as toc_materials, toc
from coursemine.catalog.text_queries import SEP, joined
from coursemine.fixtures import table, view
from coursemine.functions import fixed_values as fv
from coursemine.operators import outline as ol, ranking as rk
from coursemine.plans import planning as pl, quiz as qz, reviews as rv

def today() -> F.Column:
    return F.to_date(F.lit("2024-01-01"))


day = lambda c: F.date_format(c, "yyyy-MM-dd")


def goals(spark: SparkSession, sf: str) -> DataFrame:
    """Goals with topics for two of three; every third names none."""
    g = view(spark, sf, "goal")
    return g.withColumn("key_topics", F.when(F.col("goal_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("current_level", "goal_type")))


def plans(spark, sf):
    return view(spark, sf, "plan").withColumn("objective", F.concat(F.lit("work on "), F.col("topic")))


def tasks(spark, sf):
    return view(spark, sf, "task")


def feedback_plans(spark, sf):
    said = F.when(F.col("plan_id") % 5 == 0, "信号量 and PV are hard").when(F.col("plan_id") % 5 == 1, "死锁，内存").otherwise("fine")
    return plans(spark, sf).withColumn("feedback", said)


def reviews(spark, sf):
    """Two reviews for every plan; the later one counts."""
    r = rk.stored(rv.review_plans(feedback_plans(spark, sf), tasks(spark, sf)), "reviews")
    a = r.withColumn("created_at", F.lit(1)).withColumn("review_id", F.col("plan_id") * 2)
    b = a.withColumn("created_at", F.lit(2)).withColumn("review_id", F.col("plan_id") * 2 + 1).withColumn("completion_rate", F.col("completion_rate") / 2)
    return a.unionByName(b)


def rule_plans(spark, sf):
    return pl.expand_plans(pl.resolve_topics(goals(spark, sf), _outline_topics(spark, sf), _goal_hits(spark, sf)), today())


def _outline_topics(spark, sf):
    return ol.outline_topics(toc_materials(spark, sf), ol.extract_outline(toc(spark, sf)))


def _goal_hits(spark, sf):
    """Hits of a goal: the passages its requests were made from."""
    return view(spark, sf, "query").select("goal_id", F.col("query_id").alias("rank"), F.regexp_replace("query", "[.,] ", "\n").alias("content"))


def _plan_out(df):
    return df.select("goal_id", "day_index", day("plan_date").alias("plan_date"), "topic", "objective")


def _raw_json(df: DataFrame, key: str, fields: list) -> DataFrame:
    """One raw JSON array per key from rows ordered by day."""
    item = F.struct(*fields)
    return df.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("day_index", item.alias("i")))), lambda x: x["i"])).alias("raw"))


def q_validate_goals(spark, sf):
    good, bad = pl.validate_goals(view(spark, sf, "goal"))
    return good.select("goal_id", F.lit("").alias("reasons")).unionByName(bad.select("goal_id", F.array_join("reasons", "; ").alias("reasons")))


def q_parse_topics(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat_ws(",", F.col("p_name"), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ，")), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")))
    return p.select("p_partkey", joined(pl.parse_topics(raw)).alias("topics"))


def q_goal_day_count(spark, sf):
    g = view(spark, sf, "goal").withColumn("title", F.when(F.col("goal_id") % 4 == 0, F.concat(F.col("goal_id").cast("string"), F.lit(" 天 "), F.col("title"))).otherwise(F.col("title")))
    return g.select("goal_id", day(pl.goal_end_date(today())).alias("end_date"), pl.day_count(today()).alias("days"))


def q_resolve_topics(spark, sf):
    r = pl.resolve_topics(goals(spark, sf), _outline_topics(spark, sf), _goal_hits(spark, sf))
    return r.select("goal_id", joined(F.col("topics")).alias("topics"))


def q_expand_plans(spark, sf):
    return _plan_out(rule_plans(spark, sf))


def q_repair_plans(spark, sf):
    base = pl.expand_plans(goals(spark, sf).withColumn("topics", F.array("current_level", "goal_type")), today())
    few = base.filter(F.col("day_index") <= F.col("goal_id") % 5 + 2)
    g, i = F.col("goal_id"), F.col("day_index")
    fields = [
        F.when((g % 7 == 3) & (i == 2), "later").otherwise((i * 10).cast("string")).alias("day_index"),
        F.when((g % 7 == 4) & (i == 1), "soon").when(i % 3 == 0, F.lit(None)).otherwise(F.concat(day(F.date_add("plan_date", 1)), F.lit("T08:00:00"))).alias("plan_date"),
        F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("new "), F.col("topic"))).alias("topic"),
        F.when(i % 4 == 1, "new objective").alias("objective"),
    ]
    raw = _raw_json(few, "goal_id", fields)
    raw = raw.withColumn("raw", F.when(F.col("goal_id") % 7 == 5, "not json").otherwise(F.col("raw")))
    return _plan_out(pl.repair_plans(raw, base))


def q_replace_plans(spark, sf):
    t = {
        "goal": view(spark, sf, "goal").withColumn("status", F.lit("planning")), "plan": view(spark, sf, "plan"), "task": tasks(spark, sf),
        "quiz": view(spark, sf, "quiz_question").withColumnRenamed("quiz_id", "plan_id"),
    }
    fresh = pl.expand_plans(goals(spark, sf).filter("goal_id % 6 = 1").withColumn("topics", F.col("key_topics")), today())
    out = pl.replace_plans(t, fresh.withColumn("plan_id", F.col("goal_id") * 1000 + F.col("day_index")))
    rows = [out[k].agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n")) for k in ("plan", "task", "quiz")]
    rows.append(out["goal"].filter("status = 'active'").agg(F.lit("active goals").alias("name"), F.count(F.lit(1)).alias("n")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def q_allocate_tasks(spark, sf):
    note = pl.reference_note(F.when(F.col("plan_id") % 2 == 0, F.concat(F.lit("src#"), F.col("day_index").cast("string"))))
    return pl.allocate_tasks(plans(spark, sf), view(spark, sf, "goal"), note)


def q_repair_tasks(spark, sf):
    t = tasks(spark, sf)
    raw = t.select(
        "plan_id", F.col("task_no").alias("pos"), F.when(F.col("task_no") == 2, "").otherwise(F.col("title")).alias("title"), F.lit("").alias("description"),
        F.when((F.col("plan_id") % 9 == 4) & (F.col("task_no") == 3), "long").when(F.col("task_no") == 4, F.lit(None)).otherwise((F.col("estimated_minutes") * 3).cast("string")).alias("estimated_minutes"),
        F.lit(None).cast("string").alias("task_type"),
    )
    return pl.repair_tasks(raw, plans(spark, sf), view(spark, sf, "goal"))


def _updates(spark, sf):
    e = view(spark, sf, "events")
    return e.select(
        F.col("job_id").alias("plan_id"), (F.col("event_id") % 3 + 1).cast("int").alias("task_no"),
        F.when(F.col("event_id") % 11 == 0, "cancelled").when(F.col("status") == "success", "done").when(F.col("status") == "failed", "missed")
        .when(F.col("status") == "running", "partial").otherwise(F.col("status")).alias("status"), "ts", "event_id",
    )


def q_apply_status_updates(spark, sf):
    return pl.apply_status_updates(tasks(spark, sf), _updates(spark, sf))[0].select("plan_id", "task_no", "status")


def q_rejected_status_updates(spark, sf):
    return pl.apply_status_updates(tasks(spark, sf), _updates(spark, sf))[1].select("event_id", "reason")


def _parsed_materials(spark, sf):
    m = view(spark, sf, "material")
    return m.select(
        "material_id", "goal_id", "file_type",
        F.element_at(F.array(*[F.lit(x) for x in ("ready", "ocr_ready", "failed", "uploaded")]), (F.col("material_id") % 4 + 1).cast("int")).alias("parse_status"),
        (F.col("material_id") % 13).cast("int").alias("chunk_count"), F.col("material_id").alias("created_at"),
    )


def q_goal_summaries(spark, sf):
    g = view(spark, sf, "goal").withColumn("updated_at", (F.col("goal_id") * 37) % 1000)
    return pl.goal_summaries(g, view(spark, sf, "plan"), _parsed_materials(spark, sf)).select("goal_id", "plan_count", "material_count", "updated_at")


def q_goal_timeline(spark, sf):
    t = pl.goal_timeline(view(spark, sf, "goal"), view(spark, sf, "plan"))
    return t.select("goal_id", "title", "day_index", "plan_id", "topic", "plan_status", day("plan_date").alias("plan_date"))


def q_plan_context(spark, sf):
    r = view(spark, sf, "plan").select("plan_id", F.col("day_index").alias("created_at"), F.col("plan_id").alias("review_id"), F.when(F.col("plan_id") % 2 == 0, F.col("topic")).alias("summary"))
    q = view(spark, sf, "quiz_question").withColumnRenamed("quiz_id", "plan_id")
    c = pl.plan_context(view(spark, sf, "plan"), view(spark, sf, "goal"), tasks(spark, sf), r, q)
    return c.select(
        "plan_id", "goal_title", "task_count", "quiz_count", F.coalesce(F.when(F.col("tasks").isNotNull(), F.size("tasks")), F.lit(0)).alias("shown_tasks"),
        F.coalesce(joined(F.transform("tasks", lambda x: x["title"])), F.lit("")).alias("titles"), F.col("latest_review.summary").alias("review"),
    )


def q_material_rollup(spark, sf):
    return pl.material_rollup(_parsed_materials(spark, sf))


def q_list_children(spark, sf):
    m = _parsed_materials(spark, sf)
    goals = view(spark, sf, "goal").filter("goal_id % 2 = 1").select("goal_id")
    some = view(spark, sf, "plan").filter("plan_id % 3 = 1").select("plan_id")
    out = pl.list_children(m, goals, [F.col("created_at").desc()], searchable=True, file_type="md").select(F.lit("materials").alias("list"), F.col("material_id").alias("a"), F.col("chunk_count").alias("b"))
    t = pl.list_children(tasks(spark, sf), some, [F.col("task_no")]).select(F.lit("tasks").alias("list"), F.col("plan_id").alias("a"), F.col("task_no").alias("b"))
    return out.unionByName(t)


def q_resolve_scope(spark, sf):
    p = view(spark, sf, "plan")
    r = p.select(
        F.col("plan_id").alias("request_id"), F.when(F.col("plan_id") % 5 == 0, F.col("goal_id") + 1).otherwise(F.col("goal_id")).alias("goal_id"),
        F.when(F.col("plan_id") % 3 == 0, F.col("plan_id")).alias("plan_id"), F.when(F.col("plan_id") % 3 <= 1, F.col("day_index") * (F.col("plan_id") % 2 * 3 + 1)).cast("int").alias("day_index"),
    )
    ok, bad = pl.resolve_scope(r, p)
    null = F.lit(None).cast("string")
    return ok.withColumn("reason", null).unionByName(bad.withColumn("plan_id", F.lit(None).cast("bigint")).withColumn("day_index", F.lit(None).cast("int")))


def q_completion_rate(spark, sf):
    return rv.completion_rate(view(spark, sf, "plan"), tasks(spark, sf)).select("plan_id", "half_points", "task_count", "percent")


def q_weak_points(spark, sf):
    return rv.weak_points(feedback_plans(spark, sf), tasks(spark, sf)).select("plan_id", joined(F.col("weak_points")).alias("weak_points"))


def q_review_plans(spark, sf):
    r = rv.review_plans(feedback_plans(spark, sf), tasks(spark, sf))
    return r.select("plan_id", "percent", "summary", joined(F.col("weak_points")).alias("weak_points"), joined(F.col("suggestions")).alias("suggestions"))


def q_repair_reviews(spark, sf):
    r = rv.review_plans(feedback_plans(spark, sf), tasks(spark, sf))
    p = F.col("plan_id")
    raw = r.select(
        "plan_id",
        F.when(p % 6 == 0, F.lit("{broken")).otherwise(
            F.to_json(F.struct(
                F.when(p % 6 == 1, "high").when(p % 6 == 2, "1.7").when(p % 6 == 3, "0.25").alias("completion_rate"),
                F.when(p % 2 == 0, "").otherwise("better").alias("summary"),
                F.when(p % 3 == 0, F.array(F.lit(" "), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f"), F.lit("g"))).when(p % 3 == 1, F.array().cast("array<string>")).alias("weak_points"),
                F.array(F.lit("rest")).alias("suggestions"),
            ))
        ).alias("raw"),
    )
    out = rv.repair_reviews(raw, r)
    return out.select("plan_id", F.round("completion_rate", 4).alias("completion_rate"), "summary", joined(F.col("weak_points")).alias("weak_points"), joined(F.col("suggestions")).alias("suggestions"))


def q_latest_per_key(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    out = rk.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


def q_adjust_next_day(spark, sf):
    return rv.adjust_next_day(plans(spark, sf), reviews(spark, sf))[0]


def q_adjusted_plans(spark, sf):
    p, r = rk.stored(plans(spark, sf), "plans"), reviews(spark, sf)
    audit = rk.stored(rv.adjust_next_day(p, r)[0], "audit")
    raw = audit.select("plan_id", F.when(F.col("plan_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("T "), F.col("original_topic")).alias("adjusted_topic"), F.lit("").alias("reason")))).otherwise("none").alias("raw"))
    out = rv.apply_adjustments(p, rv.repair_adjustments(raw, audit))
    return out.select("plan_id", "topic", "adjusted", F.md5("adjustment_reason").alias("reason_md5"))


# --- quizzes ------------------------------------------------------------------
QUIZ_RULES = [("rings", ["RING", "small"]), ("widgets", ["widget", "Gear"])]


def _named_tasks(spark, sf):
    t = tasks(spark, sf).withColumn("p_partkey", F.substring("title", 6, 20).cast("bigint"))
    named = t.join(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    return named.join(plans(spark, sf).select("plan_id", "topic"), "plan_id").select(
        "plan_id", "task_no", F.concat(F.lit("「"), F.col("p_name"), F.lit("」")).alias("title"), "topic", F.col("p_type").alias("description")
    )


def question_templates(spark: SparkSession) -> DataFrame:
    rows = []
    for name in ("rings", "widgets", "generic"):
        for pos, kind in enumerate(("single_choice", "single_choice", "short_answer")):
            choice = kind == "single_choice"
            rows.append((name, pos, kind, f"{name} question {pos} on {{topic}}?", ["A. yes", "B. no"] if choice else [], "A. yes" if choice else None, None if choice else "explain {topic}", "because"))
    return spark.createDataFrame(
        rows, "template string, pos int, type string, question string, options array<string>, correct_answer string, reference_answer string, explanation string"
    )


def q_tasks_without_quiz(spark, sf):
    t = tasks(spark, sf).select("plan_id", "task_no")
    have = view(spark, sf, "quiz_answer").select(F.col("quiz_id").alias("plan_id"), F.col("seq").alias("task_no"))
    redo = t.filter("task_no = 1")
    return qz.tasks_without_quiz(t, have, redo)


def q_choose_template(spark, sf):
    picked = qz.choose_template(_named_tasks(spark, sf), QUIZ_RULES)
    q = qz.instantiate_questions(picked, question_templates(spark))
    return q.select("plan_id", "task_no", "template", "pos", "type", "question", "reference_answer")


def _rule_questions(spark, sf):
    q = view(spark, sf, "plan").select(F.col("plan_id").alias("quiz_id"), "topic", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    choice = F.col("pos") < 2
    return q.select(
        "quiz_id", "pos", F.concat(F.lit("q"), (F.col("pos") + 1).cast("string")).alias("question_id"), F.when(choice, "single_choice").otherwise("short_answer").alias("type"),
        F.concat(F.lit("about "), F.col("topic")).alias("question"), F.when(choice, F.array(F.lit("A. yes"), F.lit("B. no"))).otherwise(F.array().cast("array<string>")).alias("options"),
        F.when(choice, "A. yes").alias("correct_answer"), F.when(~choice, F.col("topic")).alias("reference_answer"), F.lit("why").alias("explanation"),
    )


def q_repair_questions(spark, sf):
    r = _rule_questions(spark, sf)
    k, i = F.col("quiz_id"), F.col("pos")
    item = F.struct(
        F.when(i == 0, "").otherwise(F.concat(F.lit("x"), i.cast("string"))).alias("id"), F.when(k % 5 == 0, "essay").otherwise(F.col("type")).alias("type"),
        F.when((k % 8 == 3) & (i == 1), "??").when((k % 8 == 4) & (i == 2), "今天这个任务 is").otherwise(F.concat(F.lit(" better "), F.col("question"))).alias("question"),
        F.when(k % 3 == 0, F.array(F.lit(" one "), F.lit(""), F.lit("two"), F.lit("three"), F.lit("four"), F.lit("five"))).when(k % 3 == 1, F.array(F.lit("only"))).alias("options"),
        F.when(k % 4 == 0, "two").when(k % 4 == 1, "b").when(k % 4 == 2, "Z").alias("correct_answer"),
        F.when(k % 2 == 0, "").otherwise("ref").alias("reference_answer"), F.when(i == 1, "since").alias("explanation"),
    )
    raw = r.filter(~((k % 8 == 5) & (i == 2))).groupBy("quiz_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"])).alias("raw")
    )
    out = qz.repair_questions(raw, r)
    return out.select("quiz_id", "pos", "question_id", "type", "question", joined(F.col("options")).alias("options"), "correct_answer", "reference_answer", "explanation", "origin")


def questions(spark, sf):
    """Questions, those numbered 5 as short answers with a reference."""
    short = F.col("question_id") == "q5"
    q = view(spark, sf, "quiz_question")
    return q.select(
        "quiz_id", "question_id", F.when(short, "short_answer").otherwise(F.col("type")).alias("type"),
        F.when(~short, F.col("correct_answer")).alias("correct_answer"), F.when(short, F.concat(F.lit("see "), F.col("correct_answer"))).alias("reference_answer"),
    )


def graded(spark, sf):
    return qz.grade_choices(questions(spark, sf), view(spark, sf, "quiz_answer"))


def q_grade_choices(spark, sf):
    return graded(spark, sf).select("quiz_id", "question_id", "is_correct", "score", "feedback", "correct_answer")


def q_quiz_scores(spark, sf):
    return qz.quiz_scores(graded(spark, sf))


def q_score_short_answers(spark, sf):
    t = _named_tasks(spark, sf)
    rows = t.select(
        "plan_id", "task_no",
        F.when(F.col("task_no") == 1, "  ").when(F.col("task_no") == 2, F.concat(F.lit(" it is "), F.col("description"))).when(F.col("task_no") == 3, "short").otherwise(F.col("topic")).alias("answer"),
        F.when(F.col("task_no") % 2 == 0, F.col("description")).otherwise(F.lit("?")).alias("reference_answer"), F.col("topic").alias("question"),
    )
    return qz.score_short_answers(rows).select("plan_id", "task_no", "score", "is_correct", "feedback")


def _raw_grades(g):
    k, n = F.col("quiz_id"), F.substring("question_id", 2, 5).cast("int")
    item = F.struct(
        F.when(n % 5 == 0, F.concat(F.lit("z"), F.col("question_id"))).otherwise(F.col("question_id")).alias("question_id"), F.when(n % 3 == 0, F.lit(True)).alias("is_correct"),
        F.when(n == 4, "many").otherwise(F.concat((n * 30).cast("string"), F.lit(".5"))).alias("score"), F.when(n == 2, "ok").alias("feedback"), F.lit("").alias("correct_answer"),
    )
    items = g.groupBy("quiz_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), item.alias("i")))), lambda x: x["i"]).alias("items"))
    return items.select(
        "quiz_id", F.when(k % 7 == 2, "[]").otherwise(F.to_json(F.struct(F.when(k % 2 == 0, "88.5").alias("score"), "items", F.when(k % 3 == 0, "fine").alias("summary")))).alias("raw")
    )


def _repaired_grades(spark, sf):
    """The rule grades are stored, as the raw ones and the rest both come from them."""
    g = rk.stored(graded(spark, sf), "graded")
    return qz.repair_grades(_raw_grades(g), questions(spark, sf), g)


def q_repair_grades(spark, sf):
    return _repaired_grades(spark, sf)[0]


def q_repair_grade_totals(spark, sf):
    return _repaired_grades(spark, sf)[1]


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

# --- oracle -------------------------------------------------------------------
_G, _P, _TK, _QQ, _QA = (d.view(n) for n in ("goal", "plan", "task", "quiz_question", "quiz_answer"))
_D0 = "DATE '2024-01-01'"
_DEF = d.lst(fv.DEFAULT_TOPICS)
_J = d.q(SEP)


def _days(title: str = "title") -> str:
    return f"CAST(CASE WHEN goal_type = 'duration' AND coalesce(duration_days, 0) <> 0 THEN greatest(3, least(duration_days, 120)) WHEN exam_date IS NOT NULL THEN greatest(3, least(exam_date - {_D0}, 120)) ELSE 10 END AS INT)"


def _expand(src: str, name: str) -> str:
    """CTE ``name`` of plan rows from src (goal columns, topics list)."""
    return f"""{name}0 AS (SELECT *, {_days()} AS n, list_concat(topics, {_DEF}) AS pool FROM {src}),
{name}1 AS (SELECT *, unnest(range(n)) AS i FROM {name}0),
{name} AS (SELECT goal_id, CAST(i + 1 AS INT) AS day_index, CAST({_D0} + CAST(i AS INT) AS DATE) AS plan_date,
 CASE WHEN i = n - 1 THEN {d.q(fv.LAST_DAY_TOPIC)} WHEN i >= greatest(n - 2, 1) THEN {d.q(fv.PRACTICE_DAY_TOPIC)} ELSE pool[i % len(pool) + 1] END AS topic,
 CASE WHEN i = n - 1 THEN {d.q(fv.LAST_DAY_OBJECTIVE)} WHEN i >= greatest(n - 2, 1) THEN {d.q(fv.PRACTICE_DAY_OBJECTIVE)}
   ELSE concat('围绕「', pool[i % len(pool) + 1], '」建立核心概念框架，并完成基础题巩固。') END AS objective FROM {name}1)"""


_KT = "CASE WHEN goal_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE [current_level, goal_type] END"
_RES = f"""{_outline(_T, 'ot')}, tm AS (SELECT material_id, max(line_no) AS created_at FROM {_T} GROUP BY material_id),
op AS (SELECT material_id % 5 AS goal_id, trim(title) AS title, created_at, material_id, "order" FROM ot JOIN tm USING (material_id)),
of1 AS (SELECT * FROM op QUALIFY row_number() OVER (PARTITION BY goal_id, title ORDER BY created_at, material_id, "order") = 1),
ok AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY created_at, material_id, "order") AS turn FROM of1 QUALIFY turn <= 12),
oo AS (SELECT goal_id, list(title ORDER BY turn) AS ol FROM ok GROUP BY goal_id),
hl AS (SELECT goal_id, query_id AS rank, string_split(regexp_replace(query, '[.,] ', chr(10), 'g'), chr(10)) AS ls FROM {d.view('query')}),
hu AS (SELECT goal_id, rank, unnest(range(len(ls))) AS pos, {d.sub('unnest(ls)', '^[ #' + chr(9) + ':—-]+|[ #' + chr(9) + ':—-]+$')} AS topic FROM hl),
hf AS (SELECT * FROM hu WHERE length(topic) BETWEEN 4 AND 40 QUALIFY row_number() OVER (PARTITION BY goal_id, topic ORDER BY rank, pos) = 1),
hk AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY rank, pos) AS turn FROM hf QUALIFY turn <= 5),
hh AS (SELECT goal_id, list(topic ORDER BY turn) AS hl FROM hk GROUP BY goal_id),
res AS (SELECT g.*, coalesce(CASE WHEN goal_id % 3 <> 0 THEN [current_level, goal_type] END, ol, hl, {_DEF}) AS topics FROM {_G} g LEFT JOIN oo USING (goal_id) LEFT JOIN hh USING (goal_id))"""


def _alloc(src: str, topic: str = "topic", note: str = "''") -> str:
    m = [("greatest(20, CAST(floor(dm * 0.3::DOUBLE) AS INT))"), ("greatest(25, CAST(floor(dm * 0.38::DOUBLE) AS INT))"), ("greatest(15, CAST(floor(dm * 0.18::DOUBLE) AS INT))")]
    m.append(f"greatest(10, dm - {' - '.join(m)})")
    rows = []
    for n, ((kind, _, _, title, text), minutes) in enumerate(zip(fv.TASK_TEMPLATES, m), 1):
        shown = f"replace({d.q(title)}, '{{topic}}', {topic})"
        body = f"concat({d.q(text)}, {note})" if n == 1 else d.q(text)
        rows.append(f"SELECT plan_id, goal_id, {n} AS task_no, {shown} AS title, {body} AS description, CAST({minutes} AS INT) AS estimated_minutes, {d.q(kind)} AS task_type FROM {src}")
    return " UNION ALL ".join(rows)


def _half_up(s: str, n: str) -> str:
    return f"(2 * {s} + {n}) // (2 * {n})"


_PD = f"pd AS (SELECT p.*, g.daily_minutes AS dm FROM {_P} p JOIN {_G} g USING (goal_id))"
_UPD = f"""up AS (SELECT job_id AS plan_id, CAST(event_id % 3 + 1 AS INT) AS task_no, ts, event_id,
  CASE WHEN event_id % 11 = 0 THEN 'cancelled' WHEN status = 'success' THEN 'done' WHEN status = 'failed' THEN 'missed' WHEN status = 'running' THEN 'partial' ELSE status END AS status FROM {d.view('events')})"""
_RATE = f"""cr0 AS (SELECT plan_id, sum(CASE status WHEN 'done' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS hp, count(*) AS tc FROM {_TK} GROUP BY plan_id),
cr AS (SELECT p.plan_id, CAST(coalesce(hp, 0) AS BIGINT) AS half_points, coalesce(tc, 0) AS task_count, CAST(CASE WHEN tc > 0 THEN (200 * hp + 2 * tc) // (4 * tc) ELSE 0 END AS INT) AS percent FROM {_P} p LEFT JOIN cr0 USING (plan_id))"""
_WEAK = f"""fb AS (SELECT plan_id, CASE plan_id % 5 WHEN 0 THEN ['PV 操作', '信号量'] WHEN 1 THEN ['死锁判定', '内存管理'] ELSE [] END AS ps FROM {_P}),
wp0 AS (SELECT plan_id, unnest(range(len(ps))) AS pos, unnest(ps) AS point FROM fb UNION ALL SELECT plan_id, task_no + 1000, title FROM {_TK} WHERE status IN ('partial', 'missed')),
wp1 AS (SELECT plan_id, point, min(pos) AS pos FROM wp0 GROUP BY ALL),
wp2 AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS turn FROM wp1 QUALIFY turn <= 4),
wp3 AS (SELECT plan_id, list(point ORDER BY turn) AS w FROM wp2 GROUP BY plan_id),
wp AS (SELECT p.plan_id, coalesce(w, [{d.q(fv.DEFAULT_WEAK_POINT)}]) AS w FROM {_P} p LEFT JOIN wp3 USING (plan_id))"""
_BANDS = [(int(a * 100), t, s) for a, t, s in fv.REVIEW_BANDS]
_SUMMARY = "CASE " + " ".join(f"WHEN percent >= {a} THEN replace({d.q(t)}, '{{topic}}', topic)" for a, t, _ in _BANDS) + " END"
_ADVICE = "CASE " + " ".join(f"WHEN percent >= {a} THEN {d.q(SEP.join(s))}" for a, _, s in _BANDS) + " END"
_REV = f"{_RATE}, {_WEAK}, rv AS (SELECT p.plan_id, p.goal_id, p.day_index, topic, percent, {_SUMMARY} AS summary, w, {_ADVICE} AS advice FROM {_P} p JOIN cr USING (plan_id) JOIN wp USING (plan_id))"
_ADJ = f"""{_REV}, td AS (SELECT goal_id, day_index AS from_day, percent / 100.0::DOUBLE / 2 AS rate, w[1] AS pt FROM rv),
adj AS (SELECT p.goal_id, p.plan_id, td.from_day, p.topic AS original_topic, concat('work on ', p.topic) AS original_objective, concat('补强', pt, ' + ', p.topic) AS adjusted_topic,
  concat('先用 30-40 分钟回补「', pt, '」，再推进「', p.topic, '」的基础内容，避免薄弱点继续滚雪球。') AS adjusted_objective,
  concat('今日完成率为 ', CAST(trunc(rate * 100) AS INT), '%，主要薄弱点集中在「', pt, '」，因此明日计划先补弱再推进。') AS reason
  FROM {_P} p JOIN td ON td.goal_id = p.goal_id AND td.from_day + 1 = p.day_index)"""
_LAST = f"la AS (SELECT quiz_id, question_id, arg_max(coalesce(answer, ''), seq) AS answer FROM {_QA} GROUP BY ALL)"
_GR = f"""{_LAST}, qs AS (SELECT quiz_id, question_id, question_id = 'q5' AS short, CASE WHEN question_id = 'q5' THEN concat('see ', correct_answer) ELSE correct_answer END AS correct_answer FROM {_QQ}),
gr0 AS (SELECT q.*, NOT short AND lower({d.sub("coalesce(answer, '')", chr(92) + 's+')}) = lower({d.sub('correct_answer', chr(92) + 's+')}) AS ok FROM qs q LEFT JOIN la USING (quiz_id, question_id)),
gr AS (SELECT quiz_id, question_id, ok AS is_correct, CASE WHEN ok THEN 100 ELSE 0 END AS score,
  CASE WHEN short THEN {d.q(fv.SHORT_UNSCORED)} WHEN ok THEN {d.q(fv.CHOICE_RIGHT)} ELSE {d.q(fv.CHOICE_WRONG)} END AS feedback, correct_answer, short FROM gr0)"""


def _band(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a} THEN {d.q(t)}" for a, t in fv.SCORE_BANDS) + " END"


_short_feedback = "CASE " + " ".join(f"WHEN score >= {a} THEN {d.q(t)}" for a, t in fv.SHORT_FEEDBACK) + " END"
_NT = f"""nt AS (SELECT t.plan_id, t.task_no, concat('「', p_name, '」') AS title, p_name, topic, p_type AS description
  FROM {_TK} t JOIN part ON p_partkey = CAST(substr(t.title, 6) AS BIGINT) JOIN {_P} p ON p.plan_id = t.plan_id)"""
_RG = f"""{_GR}, rg AS (SELECT quiz_id, question_id, CAST(substr(question_id, 2) AS INT) AS n, correct_answer FROM gr WHERE quiz_id % 7 <> 2),
kn AS (SELECT *, CASE WHEN n = 4 THEN 0 ELSE CAST(greatest(0, least(100, round_even(n * 30 + 0.5::DOUBLE, 0))) AS INT) END AS score FROM rg WHERE n % 5 <> 0),
mn AS (SELECT quiz_id, CAST((2 * sum(score) + count(*)) // (2 * count(*)) AS INT) AS mean FROM kn GROUP BY quiz_id)"""

ORACLE = {
    "validate_goals": f"""SELECT goal_id, concat_ws('; ', CASE WHEN goal_type = 'duration' AND duration_days IS NULL THEN 'duration goals need duration_days' END,
  CASE WHEN duration_days IS NOT NULL AND duration_days NOT BETWEEN 3 AND 120 THEN 'duration_days must be 3-120' END, CASE WHEN daily_minutes NOT BETWEEN 30 AND 600 THEN 'daily_minutes must be 30-600' END) AS reasons FROM {_G}""",
    "parse_topics": f"SELECT p_partkey, array_to_string(list_filter([p_name, p_type, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END], lambda x: x <> ''), {_J}) AS topics FROM part",
    "goal_day_count": f"""SELECT goal_id, strftime(coalesce(exam_date, {_D0} + CAST(greatest(coalesce(duration_days, 1), 1) - 1 AS INT)), '%Y-%m-%d') AS end_date,
  CASE WHEN goal_type = 'duration' AND coalesce(duration_days, 0) <> 0 THEN {_days()} WHEN goal_id % 4 = 0 THEN CAST(greatest(3, least(goal_id, 120)) AS INT) ELSE {_days()} END AS days FROM {_G}""",
    "resolve_topics": f"WITH {_RES} SELECT goal_id, array_to_string(topics, {_J}) AS topics FROM res",
    "expand_plans": f"WITH {_RES}, {_expand('res', 'ex')} SELECT * REPLACE (strftime(plan_date, '%Y-%m-%d') AS plan_date) FROM ex",
    "repair_plans": f"""WITH gt AS (SELECT *, [current_level, goal_type] AS topics FROM {_G}), {_expand('gt', 'ex')},
r AS (SELECT *, day_index <= goal_id % 5 + 2 AND goal_id % 7 NOT IN (3, 4, 5) AS ok FROM ex)
SELECT goal_id, CASE WHEN ok THEN day_index * 10 ELSE day_index END AS day_index,
  strftime(CASE WHEN ok AND day_index % 3 <> 0 THEN plan_date + 1 ELSE plan_date END, '%Y-%m-%d') AS plan_date,
  CASE WHEN ok AND day_index % 2 = 1 THEN concat('new ', topic) ELSE topic END AS topic, CASE WHEN ok AND day_index % 4 = 1 THEN 'new objective' ELSE objective END AS objective FROM r""",
    "replace_plans": f"""WITH p AS {_P}, gone AS (SELECT plan_id FROM p WHERE goal_id % 6 = 1), n AS (SELECT sum({_days()}) AS s, count(*) AS c FROM {_G} WHERE goal_id % 6 = 1)
SELECT 'plan' AS name, CAST((SELECT count(*) FROM p WHERE goal_id % 6 <> 1) + s AS BIGINT) AS n FROM n
UNION ALL SELECT 'task', count(*) FROM {_TK} WHERE plan_id NOT IN (SELECT plan_id FROM gone)
UNION ALL SELECT 'quiz', count(*) FROM {_QQ} WHERE quiz_id NOT IN (SELECT plan_id FROM gone)
UNION ALL SELECT 'active goals', c FROM n""",
    "allocate_tasks": f"WITH {_PD} {_alloc('pd', note='CASE WHEN plan_id % 2 = 0 THEN concat(' + d.q(' 参考资料：src#') + ', day_index, ' + d.q('。') + ') ELSE ' + d.q('') + ' END')}",
    "repair_tasks": f"""WITH {_PD}, t AS (SELECT plan_id, task_no, CASE WHEN task_no = 2 THEN '学习任务' ELSE title END AS title,
  CASE WHEN task_no = 4 THEN 20 ELSE greatest(5, estimated_minutes * 3) END AS m, plan_id % 9 = 4 AND task_no = 3 AS bad FROM {_TK} WHERE task_no <= 6),
b AS (SELECT t.*, goal_id, dm, coalesce(sum(CASE WHEN bad THEN NULL ELSE m END) OVER (PARTITION BY plan_id ORDER BY task_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN pd USING (plan_id)),
seen AS (SELECT *, lag(before) OVER (PARTITION BY plan_id ORDER BY task_no) AS earlier FROM b),
ok AS (SELECT plan_id FROM seen WHERE earlier IS NULL OR earlier < dm GROUP BY plan_id HAVING NOT bool_or(bad) AND bool_or(before < dm)), k AS (SELECT * FROM b WHERE before < dm),
rest AS (SELECT * FROM pd WHERE plan_id NOT IN (SELECT plan_id FROM ok))
SELECT plan_id, goal_id, CAST(task_no AS INT) AS task_no, title, '完成指定学习内容。' AS description, CAST(least(m, dm - before) AS INT) AS estimated_minutes, 'study' AS task_type
FROM k WHERE plan_id IN (SELECT plan_id FROM ok) UNION ALL {_alloc('rest')}""",
    "apply_status_updates": f"""WITH {_UPD}, l AS (SELECT plan_id, task_no, arg_max(status, (ts, event_id)) AS s FROM up WHERE status <> 'cancelled' GROUP BY ALL)
SELECT t.plan_id, t.task_no, coalesce(s, t.status) AS status FROM {_TK} t LEFT JOIN l USING (plan_id, task_no)""",
    "rejected_status_updates": f"""WITH {_UPD} SELECT event_id, 'unknown status' AS reason FROM up WHERE status = 'cancelled'
UNION ALL SELECT event_id, 'unknown task' FROM up WHERE status <> 'cancelled' AND NOT EXISTS (SELECT 1 FROM {_TK} t WHERE t.plan_id = up.plan_id AND t.task_no = up.task_no)""",
    "goal_summaries": f"""SELECT goal_id, coalesce(pc, 0) AS plan_count, coalesce(mc, 0) AS material_count, (goal_id * 37) % 1000 AS updated_at FROM {_G}
LEFT JOIN (SELECT goal_id, count(*) AS pc FROM {_P} GROUP BY goal_id) USING (goal_id) LEFT JOIN (SELECT goal_id, count(*) AS mc FROM {d.view('material')} GROUP BY goal_id) USING (goal_id)""",
    "goal_timeline": f"SELECT g.goal_id, title, day_index, plan_id, topic, p.status AS plan_status, strftime(plan_date, '%Y-%m-%d') AS plan_date FROM {_G} g LEFT JOIN {_P} p USING (goal_id)",
    "plan_context": f"""SELECT p.plan_id, g.title AS goal_title, coalesce(tc, 0) AS task_count, coalesce(qc, 0) AS quiz_count, CAST(least(coalesce(tc, 0), 8) AS INT) AS shown_tasks, coalesce(ts, '') AS titles,
  CASE WHEN p.plan_id % 2 = 0 THEN p.topic END AS review FROM {_P} p LEFT JOIN {_G} g USING (goal_id)
LEFT JOIN (SELECT plan_id, count(*) AS tc, string_agg(title, {_J} ORDER BY task_no) FILTER (WHERE task_no <= 8) AS ts FROM {_TK} GROUP BY plan_id) USING (plan_id)
LEFT JOIN (SELECT quiz_id AS plan_id, count(*) AS qc FROM {_QQ} GROUP BY quiz_id) USING (plan_id)""",
    "material_rollup": f"SELECT goal_id, count(*) AS materials, count(*) FILTER (WHERE material_id % 4 <= 1) AS ready, CAST(sum(material_id % 13) AS BIGINT) AS chunks FROM {d.view('material')} GROUP BY goal_id",
    "list_children": f"""SELECT 'materials' AS list, material_id AS a, CAST(material_id % 13 AS INT) AS b FROM {d.view('material')} WHERE goal_id % 2 = 1 AND goal_id IN (SELECT goal_id FROM {_G}) AND material_id % 4 = 0 AND material_id % 13 > 0
UNION ALL SELECT 'tasks', plan_id, task_no FROM {_TK} WHERE plan_id % 3 = 1 AND plan_id IN (SELECT plan_id FROM {_P})""",
    "resolve_scope": f"""WITH p AS {_P}, r AS (SELECT plan_id AS request_id, CASE WHEN plan_id % 5 = 0 THEN goal_id + 1 ELSE goal_id END AS goal_id, CASE WHEN plan_id % 3 = 0 THEN plan_id END AS plan_id,
  CASE WHEN plan_id % 3 <= 1 THEN CAST(day_index * (plan_id % 2 * 3 + 1) AS INT) END AS day_index FROM p),
j AS (SELECT r.*, a.goal_id AS ag, a.day_index AS ad, b.plan_id AS bp FROM r LEFT JOIN p a ON a.plan_id = r.plan_id LEFT JOIN p b ON b.goal_id = r.goal_id AND b.day_index = r.day_index),
k AS (SELECT *, CASE WHEN plan_id IS NOT NULL AND ag <> goal_id THEN 'Plan does not belong to goal' WHEN plan_id IS NULL AND day_index IS NOT NULL AND bp IS NULL THEN 'Plan day not found' END AS reason FROM j)
SELECT request_id, goal_id, CASE WHEN reason IS NULL THEN coalesce(plan_id, bp) END AS plan_id, CASE WHEN reason IS NULL THEN CASE WHEN plan_id IS NOT NULL THEN ad ELSE day_index END END AS day_index, reason FROM k""",
    "completion_rate": f"WITH {_RATE} SELECT * FROM cr",
    "weak_points": f"WITH {_WEAK} SELECT plan_id, array_to_string(w, {_J}) AS weak_points FROM wp",
    "review_plans": f"WITH {_REV} SELECT plan_id, percent, summary, array_to_string(w, {_J}) AS weak_points, advice AS suggestions FROM rv",
    "repair_reviews": f"""WITH {_REV}, x AS (SELECT *, plan_id % 6 NOT IN (0, 1) AS ok FROM rv)
SELECT plan_id, round(CASE plan_id % 6 WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE percent / 100.0::DOUBLE END, 4) AS completion_rate,
  CASE WHEN ok AND plan_id % 2 = 1 THEN 'better' ELSE summary END AS summary, CASE WHEN ok AND plan_id % 3 = 0 THEN array_to_string(['a', 'b', 'c', 'd', 'e', 'f'], {_J}) ELSE array_to_string(w, {_J}) END AS weak_points,
  CASE WHEN ok THEN 'rest' ELSE advice END AS suggestions FROM x""",
    "latest_per_key": """SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "adjust_next_day": f"WITH {_ADJ} SELECT * FROM adj",
    "adjusted_plans": f"""WITH {_ADJ} SELECT p.plan_id, CASE WHEN a.plan_id IS NULL THEN p.topic WHEN p.plan_id % 3 = 0 THEN concat('T ', p.topic) ELSE adjusted_topic END AS topic,
  a.plan_id IS NOT NULL AS adjusted, md5(reason) AS reason_md5 FROM {_P} p LEFT JOIN adj a ON a.plan_id = p.plan_id""",
    "tasks_without_quiz": f"""WITH a AS (SELECT DISTINCT quiz_id, seq FROM {_QA}), t AS (SELECT plan_id, task_no, a.quiz_id IS NOT NULL AS has FROM {_TK} t LEFT JOIN a ON a.quiz_id = t.plan_id AND a.seq = t.task_no)
SELECT plan_id, task_no, CASE WHEN has THEN 'regenerate' ELSE 'missing' END AS reason FROM t WHERE NOT has OR task_no = 1""",
    "choose_template": f"""WITH {_NT}, c AS (SELECT *, lower(concat_ws(' ', p_name, topic, description)) AS x FROM nt),
k AS (SELECT *, CASE WHEN contains(x, 'ring') OR contains(x, 'small') THEN 'rings' WHEN contains(x, 'widget') OR contains(x, 'gear') THEN 'widgets' ELSE 'generic' END AS template FROM c),
u AS (SELECT *, CAST(unnest([0, 1, 2]) AS INT) AS pos FROM k)
SELECT plan_id, task_no, template, pos, CASE WHEN pos < 2 THEN 'single_choice' ELSE 'short_answer' END AS type, concat(template, ' question ', pos, ' on ', topic, '?') AS question,
  CASE WHEN pos = 2 THEN concat('explain ', topic) END AS reference_answer FROM u""",
    "repair_questions": f"""WITH f AS (SELECT plan_id AS k, topic, CAST(unnest([0, 1, 2]) AS INT) AS i FROM {_P}), s AS (SELECT *, k % 8 NOT IN (3, 4, 5) AS ok FROM f),
o AS (SELECT *, CASE WHEN i = 2 THEN [] WHEN NOT ok OR k % 3 <> 0 THEN ['A. yes', 'B. no'] ELSE ['one', 'two', 'three', 'four'] END AS os FROM s)
SELECT k AS quiz_id, i AS pos, CASE WHEN ok AND i > 0 THEN concat('x', i) ELSE concat('q', i + 1) END AS question_id, CASE WHEN i < 2 THEN 'single_choice' ELSE 'short_answer' END AS type,
  CASE WHEN ok THEN concat('better about ', topic) ELSE concat('about ', topic) END AS question, coalesce(array_to_string(os, {_J}), '') AS options,
  CASE WHEN i = 2 THEN NULL WHEN NOT ok THEN 'A. yes' WHEN k % 3 = 0 THEN CASE k % 4 WHEN 0 THEN 'two' WHEN 1 THEN 'two' ELSE 'one' END WHEN k % 4 = 1 THEN 'B. no' ELSE 'A. yes' END AS correct_answer,
  CASE WHEN i < 2 THEN NULL WHEN NOT ok THEN topic WHEN k % 2 = 1 THEN 'ref' ELSE CASE k % 4 WHEN 0 THEN 'two' WHEN 2 THEN 'Z' END END AS reference_answer,
  CASE WHEN ok AND i = 1 THEN 'since' ELSE 'why' END AS explanation, CASE WHEN ok THEN 'repaired' ELSE 'fallback' END AS origin FROM o""",
    "grade_choices": f"WITH {_GR} SELECT * EXCLUDE (short) FROM gr",
    "quiz_scores": f"WITH {_GR}, s AS (SELECT quiz_id, CAST(coalesce((2 * sum(score) FILTER (WHERE NOT short) + count(*) FILTER (WHERE NOT short)) // (2 * nullif(count(*) FILTER (WHERE NOT short), 0)), 0) AS INT) AS score FROM gr GROUP BY quiz_id) SELECT quiz_id, score, '{fv.CHOICES_ONLY_SUMMARY}' AS summary FROM s",
    "score_short_answers": f"""WITH {_NT}, r AS (SELECT plan_id, task_no, {d.strip("CASE task_no WHEN 1 THEN '  ' WHEN 2 THEN concat(' it is ', description) WHEN 3 THEN 'short' ELSE topic END")} AS a,
  CASE WHEN task_no % 2 = 0 THEN description ELSE '?' END AS ref, topic FROM nt),
w AS (SELECT *, regexp_extract_all(ref, '[A-Za-z0-9]{{2,}}') AS k1, regexp_extract_all(topic, '[A-Za-z0-9]{{2,}}') AS k2 FROM r),
s AS (SELECT plan_id, task_no, CASE WHEN a = '' THEN 0 WHEN len(list_filter(CASE WHEN len(k1) > 0 THEN k1 ELSE k2 END, lambda x: contains(a, x))) > 0 THEN CASE WHEN length(a) >= 12 THEN 80 ELSE 65 END
  WHEN length(a) >= 28 THEN 60 WHEN length(a) >= 10 THEN 40 ELSE 20 END AS score FROM w) SELECT *, score >= 60 AS is_correct, {_short_feedback} AS feedback FROM s""",
    "repair_grades": f"""WITH {_RG} SELECT quiz_id, question_id, CASE WHEN n % 3 = 0 THEN true ELSE score >= 60 END AS is_correct, score, CASE WHEN n = 2 THEN 'ok' ELSE {d.q(fv.GRADED_DEFAULT_FEEDBACK)} END AS feedback, correct_answer FROM kn
UNION ALL SELECT quiz_id, question_id, is_correct, score, feedback, correct_answer FROM gr WHERE quiz_id NOT IN (SELECT quiz_id FROM mn)""",
    "repair_grade_totals": f"""WITH {_RG}, f AS (SELECT quiz_id, CAST((2 * sum(score) + count(*)) // (2 * count(*)) AS INT) AS score FROM gr WHERE quiz_id NOT IN (SELECT quiz_id FROM mn) GROUP BY quiz_id)
SELECT quiz_id, CASE WHEN quiz_id % 2 = 0 THEN 88 ELSE mean END AS score, CASE WHEN quiz_id % 3 = 0 THEN 'fine' ELSE {_band('mean')} END AS summary FROM mn
UNION ALL SELECT quiz_id, score, {_band('score')} FROM f""",
}
