"""Conversation reduction: last messages, recent turns, useful lines, compression, intents, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import collapse, let, lines, strip, unnest
from coursemine.operators.ranking import latest_per_key, running_sum, top_per_key

# turns per block in the running sums below: no task sees a whole conversation
BLOCK = 256


def last_user_message(turns: DataFrame) -> DataFrame:
    """(conv_id, message): the latest user turn, stripped; "" when there is none."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return turns.groupBy("conv_id").agg(F.coalesce(strip(F.max(user)["text"]), F.lit("")).alias("message"))


def recent_turns(turns: DataFrame, n: int = 12) -> DataFrame:
    spoken = turns.filter(strip(F.col("text")) != "")
    return top_per_key(spoken, ["conv_id"], [F.col("turn").desc()], n, "from_end")


def useful_line_array(text: Column, most: int = 24) -> Column:
    def useful(line: Column) -> Column:
        test = F.lit(False)
        for pattern in fv.USEFUL_LINE_PATTERNS:
            test = test | line.rlike(pattern)
        return (line != "") & test

    def shown(line: Column) -> Column:
        return F.substring(strip(F.regexp_replace(line, r"\A(#{1,6}\s+|[-*+]\s+)", "")), 1, 500)

    return F.slice(F.transform(F.filter(F.transform(lines(text), strip), useful), shown), 1, most)


def useful_lines(turns: DataFrame, most: int = 24) -> DataFrame:
    return unnest(turns, ["conv_id", "turn"], useful_line_array(F.col("text"), most), "line_no", "line")


def _blocks(turns: DataFrame) -> DataFrame:
    """Add ``piece``: what each turn contributes to the compressed history (null when nothing)."""
    head = F.concat(F.col("turn_no").cast("string"), F.lit(". "), F.col("role"), F.lit("："))
    bullets = let(
        useful_line_array(F.col("text"), 10), lambda ls: F.when(F.size(ls) > 0, F.array_join(F.transform(ls, lambda x: F.concat(F.lit("- "), x)), "\n"))
    )
    preview = F.substring(F.replace(strip(F.col("text")), F.lit("\n"), F.lit(" ")), 1, 300)
    staged = turns.withColumn("_bullets", bullets).withColumn("_preview", preview)
    piece = F.when(F.col("_bullets").isNotNull(), F.concat(head, F.lit("\n"), F.col("_bullets"))).when(
        F.col("_preview") != "", F.concat(head, F.col("_preview"))
    )
    return staged.withColumn("piece", piece).drop("_bullets", "_preview")


def compress_history(turns: DataFrame, target: int = 6000) -> DataFrame:
    """(conv_id, summary, summary_chars, original_chars) of the turns of each conversation.

    A turn is kept while the text before it is shorter than the target, so the
    joined result is bounded by the target and one more piece, and only those
    pieces are gathered.  ``turn_no`` counts the turns from 1.
    """
    block = F.floor(F.col("turn") / BLOCK)
    numbered = turns if "turn_no" in turns.columns else _numbered(turns)
    totals = numbered.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("original_chars")
    )
    pieces = _blocks(numbered).select("conv_id", "turn", "turn_no", "piece", F.coalesce(F.length("piece") + 1, F.lit(0)).alias("_len"))
    grown = running_sum(pieces, ["conv_id"], block, [F.col("turn")], F.col("_len"), "_upto")
    header_chars = F.length(_header(F.col("n_turns")))
    # pieces start while the header and the earlier pieces are still below the target
    kept = grown.join(totals, "conv_id").filter(
        F.col("piece").isNotNull() & ((header_chars + F.col("_upto") - F.col("_len") < target) | (F.col("turn_no") == 1))
    )
    bodies = kept.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "piece"))), lambda x: x["piece"]), "\n").alias("_body")
    )
    whole = F.concat(_header(F.col("n_turns")), F.coalesce(F.concat(F.lit("\n"), F.col("_body")), F.lit("")))
    out = totals.join(bodies, "conv_id", "left").withColumn("_all", whole)
    cut = F.when(
        F.length("_all") > target, F.concat(F.substring("_all", 1, max(0, target - 20)), F.lit("\n" + fv.HISTORY_CUT))
    ).otherwise(F.col("_all"))
    return out.withColumn("summary", cut).select(
        "conv_id", "summary", F.length("summary").alias("summary_chars"), "original_chars"
    )


def _header(n_turns: Column) -> Column:
    return F.concat(F.lit(f"{fv.HISTORY_HEADER}\n{fv.HISTORY_COUNT}"), n_turns.cast("string"), F.lit(f"\n{fv.HISTORY_POINTS}"))


def _numbered(turns: DataFrame) -> DataFrame:
    one = turns.withColumn("_one", F.lit(1))
    return running_sum(one, ["conv_id"], F.floor(F.col("turn") / BLOCK), [F.col("turn")], F.col("_one"), "turn_no").drop("_one")


def fit_context(
    turns: DataFrame,
    budget: int = 36000,
    keep: int = 4,
    window: int = 12,
    compress_at: int = 16000,
    most_per_message: int = 24000,
) -> DataFrame:
    """Decision per recent turn: keep, clamp or fold into the compressed history.

    The window bounds a conversation to ``window`` rows, so the sums over it are small.
    """
    recent = recent_turns(turns, window).withColumn("chars", F.length("text"))
    w = Window.partitionBy("conv_id")
    older = F.col("from_end") > keep
    folded = (F.max(F.when(older, F.col("chars"))).over(w) > compress_at) | (
        (F.max(F.col("from_end")).over(w) > keep) & (F.sum("chars").over(w) > budget)
    )
    action = (
        F.when(older & F.coalesce(folded, F.lit(False)), "compress")
        .when(F.col("chars") > most_per_message, "clamp")
        .otherwise("keep")
    )
    return recent.withColumn("action", action).select("conv_id", "turn", "role", "chars", "from_end", "action")


def fitted_messages(
    turns: DataFrame,
    budget: int = 36000,
    keep: int = 4,
    window: int = 12,
    compress_at: int = 16000,
    target: int = 6000,
    most_per_message: int = 24000,
) -> DataFrame:
    """The messages to send: one compressed message for the folded turns, then the kept ones."""
    decided = fit_context(turns, budget, keep, window, compress_at, most_per_message)
    joined = turns.join(decided.select("conv_id", "turn", "action", "from_end"), ["conv_id", "turn"])
    folded = compress_history(joined.filter("action = 'compress'").select("conv_id", "turn", "role", "text"), target)
    head = folded.select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("assistant").alias("role"), F.col("summary").alias("text"))
    clamp = F.when(
        F.length("text") > most_per_message, F.substring("text", 1, most_per_message - 80)
    ).otherwise(F.col("text"))
    rest = joined.filter("action <> 'compress'").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", clamp.alias("text"))
    return head.unionByName(rest)


def classify_intent(
    messages: DataFrame,
    text: str = "message",
    rules: list | None = None,
    markers: list[str] | None = None,
    has_goal: Column | None = None,
    has_plan: Column | None = None,
    has_page: Column | None = None,
) -> DataFrame:
    """Add intent and payload: the first rule of which every group of words has a hit.

    All rules need a goal, "adjust" and "review" a plan and "read_page" a page being
    read (boolean columns, true by default); a message that lacks one falls through to
    the later rules.
    """
    yes = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
    needs = {"adjust": yes(has_plan), "review": yes(has_plan), "read_page": yes(has_page)}
    rules = fv.INTENT_RULES if rules is None else rules
    markers = fv.INSERT_MARKERS if markers is None else markers
    c = F.col(text)

    def holds(words: list[str]) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | c.contains(word)
        return test

    intent = None
    for name, groups in rules:
        test = yes(has_goal) & needs.get(name, F.lit(True))
        for group in groups:
            test = test & holds(group)
        intent = F.when(test, name) if intent is None else intent.when(test, name)
    payload = None
    for marker in markers:
        after = strip(F.substring(c, F.locate(marker, c) + len(marker), F.length(c)))
        value = F.when(after != "", after).otherwise(c)
        payload = F.when(c.contains(marker), value) if payload is None else payload.when(c.contains(marker), value)
    out = messages.withColumn("intent", intent.otherwise("chat"))
    return out.withColumn("payload", F.when(F.col("intent") == rules[0][0], payload.otherwise(c)))


def session_title(c: Column) -> Column:
    return let(
        strip(collapse(c)),
        lambda t: F.when(F.length(t) > 20, F.concat(F.substring(t, 1, 20), F.lit("...")))
        .when(t != "", t)
        .otherwise(F.lit(fv.SESSION_DEFAULT_TITLE)),
    )


def session_context(material: Column, plan: Column, goal: Column) -> Column:
    return F.when(material.isNotNull(), "pdf").when(plan.isNotNull(), "plan").when(goal.isNotNull(), "goal").otherwise("general")


def session_index(writes: DataFrame) -> DataFrame:
    """Last well-formed write per session id; (id, title, context_type, created_at, updated_at, write_no)."""
    complete = writes.filter(
        F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("created_at").isNotNull()
        & F.col("updated_at").isNotNull() & F.col("context_type").isin(*fv.SESSION_TYPES)
    )
    return latest_per_key(complete, ["id"], ["write_no"])
