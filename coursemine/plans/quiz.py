"""Quizzes: which tasks need one, templates, repair of outside questions, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import let, strip, unnest
from coursemine.operators.ranking import is_small, spread_join
from coursemine.plans.reviews import half_up_percent

QUIZ_KEY = ["quiz_id", "question_id"]
# Template rows up to which the table is sent to every task.
SENT_TEMPLATES = 10_000


def tasks_without_quiz(tasks: DataFrame, quizzes: DataFrame, regenerate: DataFrame) -> DataFrame:
    """Tasks that have no quiz, and those for which a new one is asked."""
    key = ["plan_id", "task_no"]
    missing = tasks.join(quizzes.select(*key).distinct(), key, "left_anti").withColumn("reason", F.lit("missing"))
    forced = tasks.join(quizzes.select(*key).distinct(), key, "left_semi").join(regenerate.select(*key).distinct(), key, "left_semi")
    return missing.unionByName(forced.withColumn("reason", F.lit("regenerate")))


def choose_template(tasks: DataFrame, rules: list[tuple[str, list[str]]], default: str = "generic") -> DataFrame:
    """Add ``template``: the first rule with a keyword in title, plan topic or description."""
    title = F.regexp_replace("title", "[「」]", "")
    text = F.lower(F.concat_ws(" ", title, F.col("topic"), F.col("description")))

    def pick(low: Column) -> Column:
        out = None
        for name, keywords in rules:
            test = F.lit(False)
            for keyword in keywords:
                test = test | low.contains(keyword.lower())
            out = F.when(test, name) if out is None else out.when(test, name)
        return F.lit(default) if out is None else out.otherwise(default)

    return tasks.withColumn("template", let(text, pick))


def instantiate_questions(tasks: DataFrame, templates: DataFrame) -> DataFrame:
    """Question rows of each task from the template table; ``{topic}`` becomes the plan topic.

    There are few template names, so tasks are not dealt out by name: one task would hold a large share of the rows.
    """
    filled = lambda c: F.replace(F.col(c), F.lit("{topic}"), F.col("topic"))
    if is_small(templates, SENT_TEMPLATES):
        both = tasks.join(F.broadcast(templates), "template")
    else:
        both = spread_join(tasks, templates, ["template"], F.struct("plan_id", "task_no"))
    return both.select(
        "plan_id", "task_no", "template", "pos", "type", filled("question").alias("question"), "options", "correct_answer",
        filled("reference_answer").alias("reference_answer"), "explanation",
    )


RAW_QUESTION = (
    "array<struct<id:string,type:string,question:string,options:array<string>,correct_answer:string,"
    "reference_answer:string,explanation:string>>"
)
QUESTION_COLUMNS = ["question_id", "type", "question", "options", "correct_answer", "reference_answer", "explanation"]


def repair_questions(raw: DataFrame, fallback: DataFrame) -> DataFrame:
    """Untrusted questions (quiz_id, raw JSON) against three rule questions (quiz_id, pos, …).

    Any unusable item, or fewer than three, gives the whole rule set.
    """
    f = fallback.withColumnsRenamed({c: "f_" + c for c in QUESTION_COLUMNS})
    items = unnest(raw, ["quiz_id"], F.slice(F.from_json("raw", RAW_QUESTION), 1, 3), "pos", "i")
    both = f.join(items, ["quiz_id", "pos"], "left")
    given = lambda c: F.when(F.col(f"i.{c}") != "", F.col(f"i.{c}"))
    kind = F.coalesce(given("type"), F.col("f_type"))
    kind = F.when(kind.isin("single_choice", "short_answer"), kind).otherwise(F.col("f_type"))
    question = strip(F.coalesce(given("question"), F.col("f_question")))
    options = F.filter(F.transform("i.options", lambda x: F.substring(strip(x), 1, 300)), lambda x: x != "")
    options = let(options, lambda o: F.when(F.size(o) >= 2, F.slice(o, 1, 4)).otherwise(F.col("f_options")))
    staged = both.withColumn("_kind", kind).withColumn("_question", question).withColumn(
        "_options", F.when(F.col("_kind") == "single_choice", options).otherwise(F.array().cast("array<string>"))
    )
    meta = F.col("_question").rlike("|".join(fv.META_QUESTION_MARKS))
    value = strip(F.coalesce(F.col("i.correct_answer"), F.lit("")))
    at = F.instr(F.lit("ABCD"), F.upper(F.substring(value, 1, 1)))
    by_letter = F.when(F.substring(value, 1, 1).rlike("[A-Da-d]"), F.get("_options", at - 1))
    answer = (
        F.when(F.array_contains("_options", value), value)
        .when(by_letter.isNotNull(), by_letter)
        .when(F.array_contains("_options", F.col("f_correct_answer")), F.col("f_correct_answer"))
        .otherwise(F.get("_options", F.lit(0)))
    )
    choice = F.col("_kind") == "single_choice"
    good = F.col("i").isNotNull() & (F.length("_question") >= 4) & ~meta
    ok = staged.groupBy("quiz_id").agg((F.bool_and(good) & (F.count(F.lit(1)) == 3)).alias("_ok"))
    out = staged.withColumn("_answer", answer).join(ok, "quiz_id")
    blank = F.lit("")
    use = lambda fixed, name: F.when(F.col("_ok"), fixed).otherwise(F.col("f_" + name)).alias(name)
    return out.select(
        "quiz_id", "pos",
        use(F.coalesce(given("id"), F.concat(F.lit("q"), (F.col("pos") + 1).cast("string"))), "question_id"),
        use(F.col("_kind"), "type"), use(F.substring("_question", 1, 500), "question"), use(F.col("_options"), "options"),
        use(F.when(choice, F.col("_answer")), "correct_answer"),
        use(
            F.when(~choice, F.substring(F.coalesce(given("reference_answer"), given("correct_answer"), F.col("f_reference_answer"), blank), 1, 1200)),
            "reference_answer",
        ),
        use(F.substring(F.coalesce(given("explanation"), F.col("f_explanation"), blank), 1, 1000), "explanation"),
        F.when(F.col("_ok"), "repaired").otherwise("fallback").alias("origin"),
    )


# --- grading ------------------------------------------------------------------


def clean_answer(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def grade_choices(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One graded row per question; the last answer by ``seq`` counts, a missing one is blank.

    Short answers are not judged here but shown their reference answer, if the questions have one.
    """
    last = answers.groupBy(*QUIZ_KEY).agg(F.max_by("answer", "seq").alias("answer"))
    both = questions.join(last, QUIZ_KEY, "left").withColumn("answer", strip(F.coalesce("answer", F.lit(""))))
    choice = F.col("type") == "single_choice"
    right = choice & (clean_answer(F.col("answer")) == clean_answer(F.coalesce("correct_answer", F.lit(""))))
    feedback = F.when(~choice, fv.SHORT_UNSCORED).when(right, fv.CHOICE_RIGHT).otherwise(fv.CHOICE_WRONG)
    return both.select(
        *QUIZ_KEY, "type", right.alias("is_correct"), F.when(right, 100).otherwise(0).alias("score"),
        feedback.alias("feedback"), right_answer(questions).alias("correct_answer"),
    )


def right_answer(questions: DataFrame) -> Column:
    """Correct answer of a choice, reference answer of a short answer; blank when absent."""
    reference = F.col("reference_answer") if "reference_answer" in questions.columns else F.lit(None).cast("string")
    return F.coalesce(F.when(F.col("type") == "single_choice", F.col("correct_answer")).otherwise(reference), F.lit(""))


def score_summary(score: Column) -> Column:
    out = None
    for least, text in fv.SCORE_BANDS:
        out = F.when(score >= least, text) if out is None else out.when(score >= least, text)
    return out


def quiz_scores(graded: DataFrame, all_types: bool = False) -> DataFrame:
    """(quiz_id, score, summary): mean of the items, half up, 0 when there are none.

    With choices only, the summary says so; with all types it goes by the score.
    """
    counted = F.lit(True) if all_types else F.col("type") == "single_choice"
    sums = graded.groupBy("quiz_id").agg(F.sum(F.when(counted, F.col("score"))).alias("s"), F.count_if(counted).alias("n"))
    score = F.when(F.col("n") > 0, half_up_percent(F.col("s"), 100 * F.col("n"))).otherwise(0)
    out = sums.select("quiz_id", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("score"))
    return out.withColumn("summary", score_summary(F.col("score")) if all_types else F.lit(fv.CHOICES_ONLY_SUMMARY))


def keywords(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"[一-鿿A-Za-z0-9]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~x.isin(*fv.KEYWORD_SKIPS))), 1, 6)


def short_answer_score(answer: Column, reference: Column, question: Column) -> Column:
    words = let(keywords(reference), lambda r: F.when(F.size(r) > 0, r).otherwise(keywords(question)))
    hit = F.exists(words, lambda k: answer.contains(k))
    return (
        F.when(strip(answer) == "", 0)
        .when(hit, F.when(F.length(answer) >= 12, 80).otherwise(65))
        .when(F.length(answer) >= 28, 60)
        .when(F.length(answer) >= 10, 40)
        .otherwise(20)
    )


def score_short_answers(rows: DataFrame) -> DataFrame:
    staged = rows.withColumn("answer", strip(F.coalesce("answer", F.lit(""))))
    score = short_answer_score(F.col("answer"), F.coalesce("reference_answer", F.lit("")), F.coalesce("question", F.lit("")))
    feedback = None
    for least, text in fv.SHORT_FEEDBACK:
        feedback = F.when(F.col("score") >= least, text) if feedback is None else feedback.when(F.col("score") >= least, text)
    return staged.withColumn("score", score).withColumn("is_correct", F.col("score") >= 60).withColumn("feedback", feedback)


RAW_GRADE = (
    "score string, items array<struct<question_id:string,is_correct:boolean,score:string,feedback:string,correct_answer:string>>, summary string"
)


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.bround(c.try_cast("double"), 0).cast("int"), F.lit(0))))


def repair_grades(raw: DataFrame, questions: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, totals) from untrusted grades (quiz_id, raw JSON); unknown questions are dropped.

    Quizzes without a usable item take the rule grades.
    """
    r = raw.select("quiz_id", F.from_json("raw", RAW_GRADE).alias("r"))
    items = unnest(r, ["quiz_id"], F.col("r.items"), "pos", "i").select("quiz_id", "pos", F.col("i.question_id").alias("question_id"), "i")
    known = items.join(questions.select(*QUIZ_KEY, right_answer(questions).alias("_right")), QUIZ_KEY)
    score = _clamped(F.coalesce(F.col("i.score"), F.lit("0")))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    fixed = known.withColumn("score", score).select(
        *QUIZ_KEY, F.coalesce(F.col("i.is_correct"), F.col("score") >= 60).alias("is_correct"), "score",
        F.substring(F.coalesce(given("i.feedback"), F.lit(fv.GRADED_DEFAULT_FEEDBACK)), 1, 1000).alias("feedback"),
        F.coalesce(given("i.correct_answer"), given("_right"), F.lit("")).alias("correct_answer"),
    )
    means = fixed.groupBy("quiz_id").agg(half_up_percent(F.sum("score"), 100 * F.count(F.lit(1))).cast("int").alias("_mean"))
    totals = means.join(r, "quiz_id").select(
        "quiz_id",
        F.when(F.col("r.score").isNull(), F.col("_mean")).otherwise(_clamped(F.col("r.score"))).alias("score"),
        F.substring(F.coalesce(given("r.summary"), score_summary(F.col("_mean"))), 1, 1200).alias("summary"),
    )
    rest = fallback.join(means, "quiz_id", "left_anti")
    items_out = fixed.unionByName(rest.select(*fixed.columns))
    return items_out, totals.unionByName(quiz_scores(rest, all_types=True).select("quiz_id", "score", "summary"))
