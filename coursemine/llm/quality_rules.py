"""Host-level quality rules: failures by host, rates shrunk by a beta prior, verdicts joined back to documents.

A document fails by itself when it is short or mostly repetition; otherwise it shares
the fate of its host.  The rate of failures of a host with few documents says little, so
it is pulled towards the rate of all hosts by a beta prior whose two parameters are
fitted to the hosts themselves (method of moments).  Everything is SQL expressions.

Defined results: a null text counts as empty (0 words, failed); a null host is a host of
its own; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coursemine.functions.text import let
from coursemine.llm.common import cut, strip_ascii, whole, words
from coursemine.operators.ranking import is_small

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"
# A host is rejected when more than this share of its documents fails, after shrinking.
HOST_LIMIT = 0.5
# Weight of the prior, in documents, where the hosts do not tell (one host, or no variation).
PRIOR_WEIGHT = 10.0
BROADCAST_HOSTS = 100_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _covered(hashes: Column) -> Column:
    """Number of words that lie in a window whose hash occurs twice or more."""
    def places(s: Column) -> Column:
        twin = lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])
        return F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(twin(e, i), F.lit(False))), lambda e: e["at"]))

    def length(p: Column) -> Column:
        overlaps = F.transform(p, lambda x, i: F.greatest(F.coalesce(WINDOW - (F.get(p, i + 1) - x), F.lit(0)), F.lit(0)))
        return WINDOW * F.size(p) - F.aggregate(overlaps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return let(let(pairs, places), length)


def repeat_words(w: Column, n: Column) -> Column:
    """Words within repeated windows of eight; only texts with a repeated window are sorted."""
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))
    return F.when(n > WINDOW, some).otherwise(0)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(text, "\n", -1), lambda x: strip_ascii(x) != "")
    return let(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measure(text: Column, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> Column:
    """Struct of the measures of one text and whether it fails by itself."""
    def of(w: Column) -> Column:
        n = F.size(w)
        return let(repeat_words(w, n), lambda r: F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            dup_lines(text).cast("long").alias("n_dup_lines"),
            r.cast("long").alias("n_repeat_words"),
            ((n < min_words) | (100 * r.cast("long") > repeat_percent * n)).alias("base_failed"),
        ))

    return let(words(text), of)


def host_verdicts(measured: DataFrame, host: str, failed: str, limit: float = HOST_LIMIT, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """Per host: documents, failures, shrunk rate, ``host_kept``.

    Counts are combined before the shuffle, so a host with a third of the rows sends one
    row per task.  The prior comes from one row of sums over the hosts.
    """
    hosts = cut(measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed")
    ))
    n, f = F.col("host_docs"), F.col("host_failed")
    s = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.count(F.lit(1)).alias("hosts")).first()
    total = s["n"] or 0
    mean = s["f"] / total if total else 0.0
    spread = s["ff"] / total - mean * mean if total else 0.0
    between = spread - mean * (1 - mean) * s["hosts"] / total if total else 0.0
    weight = max(mean * (1 - mean) / between - 1, 1.0) if between > 1e-9 else prior_weight
    rate = (f + mean * weight) / (n + weight)
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= limit)


def apply_host_rules(docs: DataFrame, host: Column, text: str = "text", key: str = "doc_id", **options: float) -> DataFrame:
    """Measures and verdict of every row of ``docs``: key, host, measures, host columns, ``kept``.

    The measures are stored once (no text in them) and read twice: for the host sums, and
    for the join with the host verdicts, whose small side the adaptive planner broadcasts
    or else whose hot hosts it splits.
    """
    m = docs.select(F.col(key), host.alias("host"), measure(whole(text)).alias("m"))
    m = cut(m.select(key, "host", *[F.col("m")[c].alias(c) for c in MEASURES]))
    verdicts = host_verdicts(m, "host", "base_failed", **options).withColumnRenamed("host", "_host")
    joined = m.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def keep_good(docs: DataFrame, host: Column, text: str = "text", **options: float) -> DataFrame:
    """The rows of ``docs`` with a good verdict, columns as they are.

    Texts are measured again in the second pass, which is cheaper than to shuffle them.
    """
    failed = measure(whole(text))["base_failed"]
    flagged = docs.select(host.alias("host"), failed.alias("failed"))
    bad = host_verdicts(flagged, "host", "failed", **options).filter(~F.col("host_kept")).select(F.col("host").alias("__bad_host"))
    # Rejected hosts up to a number go to every task, so texts are not shuffled by host; beyond it hot hosts are split.
    bad = F.broadcast(bad) if is_small(bad, BROADCAST_HOSTS) else bad
    return docs.filter(~failed).join(bad, host.eqNullSafe(F.col("__bad_host")), "left_anti")
