"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursemine.fixtures import table
from coursemine.llm import (
    decontamination, fingerprints, html_extraction, language_id, language_model, licenses, line_dedup, mixing, quality_classifier, quality_rules, simhash, spelling, whitening,
)
from coursemine.llm.common import cut, remainder

WORD = r"[^\x20\x09-\x0D]+"


def q_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    out = quality_rules.apply_host_rules(docs, F.col("source"))
    return out.select("doc_id", *quality_rules.MEASURES, "kept", "host_docs", "host_failed")


SQL_QUALITY_RULES = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) > 7)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wins) WHERE c > 1),
rep AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(x, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT t.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (
  SELECT source, count(*) AS host_docs, CAST(sum(CAST(base_failed AS BIGINT)) AS BIGINT) AS host_failed FROM f GROUP BY source),
s AS (
  SELECT sum(host_docs) AS n, sum(host_failed) / sum(host_docs) AS mean,
         sum(host_failed * host_failed / host_docs) / sum(host_docs) AS ff, count(*) AS hosts FROM h),
b AS (SELECT mean, ff - mean * mean - mean * (1 - mean) * hosts / n AS between_hosts FROM s),
p AS (
  SELECT mean, CASE WHEN between_hosts > 1e-9 THEN greatest(mean * (1 - mean) / between_hosts - 1, 1.0) ELSE 10.0 END AS weight FROM b),
v AS (SELECT source, host_docs, host_failed, (host_failed + mean * weight) / (host_docs + weight) <= 0.5 AS host_kept FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept, host_docs, host_failed
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

def q_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex(spark).insert(docs)
    out = line_dedup.split_lines(docs, index)
    return out.select(
        "doc_id", F.size("__drop").cast("long").alias("n_lines"),
        F.size(F.filter("__drop", lambda x: x)).cast("long").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"),
    )


SQL_LINE_DEDUP = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM t)),
frequent AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN frequent f ON l.k = f.k GROUP BY r, doc_id"""

def q_simhash(spark, sf):
    out = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def q_mixing(spark, sf):
    out = mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    out = out.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def q_decontamination(spark, sf):
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    out = decontamination.contaminations(docs, items)
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "coverage", "renamed")


def q_licenses(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents").select("doc_id", "text")).drop("spans")


def q_quality_classifier(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    ranking = quality_classifier.fit(docs, labels.filter(remainder(5) != 0))
    out = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), quality_classifier.score(docs, ranking).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality_classifier.CUT).cast("int"))


def q_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    dictionaries = language_id.fit(docs.filter(remainder(5) != 0))
    out = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), language_id.identify(docs, dictionaries).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.accepted")


def q_html_extraction(spark, sf):
    out = html_extraction.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def q_language_model(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = language_model.train(docs.filter(~language_model.held_out()))
    out = language_model.score(docs, model).withColumn("held_out", language_model.held_out())
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )


def q_whitening(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return whitening.components(vectors, whitening.fit(vectors))


def q_fingerprints(spark, sf):
    rows = cut(fingerprints.edited(table(spark, sf, "documents").select("doc_id", "text")))
    return rows.join(fingerprints.classes(rows), "fingerprint").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")


def q_spelling(spark, sf):
    return spelling.variants(table(spark, sf, "documents").select("doc_id", "text"))


SQL_SPELLING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (
  SELECT concat(doc_id, ':') AS head, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents)),
counted AS (SELECT head, run, count(*) AS n FROM runs GROUP BY ALL),
sums AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(head || run) + 1),
           lambda i: CASE WHEN unicode(substring(head || run, i, 1)) < 128 THEN [unicode(substring(head || run, i, 1))::BIGINT]
                          ELSE [195::BIGINT, unicode(substring(head || run, i, 1))::BIGINT - 64] END))),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2)
                    ELSE run END AS word, n FROM sums)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
near AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS best FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN best END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words w LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, root FROM forms f JOIN (
  SELECT c.word, c.root FROM chain c JOIN forms g ON c.root = g.word WHERE g.form IS NULL) USING (word)"""

QUERIES = {"op1_line_dedup": q_line_dedup, "op8_quality_rules": q_quality_rules,
    "op5_simhash": q_simhash, "op9_mixing": q_mixing,
    "op3_decontamination": q_decontamination, "op10_licenses": q_licenses,
    "op2_language_model": q_language_model, "op6_html_extraction": q_html_extraction,
    "op4_quality_classifier": q_quality_classifier, "op7_language_id": q_language_id,
    "op11_fingerprints": q_fingerprints, "op12_whitening": q_whitening, "op13_spelling": q_spelling,
}
ORACLE = {"op1_line_dedup": SQL_LINE_DEDUP, "op8_quality_rules": SQL_QUALITY_RULES, "op13_spelling": SQL_SPELLING}
