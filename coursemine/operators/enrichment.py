"""Chunk enrichment: retrieval text, formulas, language, terms, summary, embedding text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.terms import TERM_TYPE, extract_key_terms, normalize_terms, rank_terms, rerank_extracted
from coursemine.functions.text import clean_for_retrieval, detect_language, extract_formulas, shorten


def english_summary(terms: Column) -> Column:
    names = F.array_join(F.transform(F.slice(terms, 1, 5), lambda t: t["source"]), "、")
    return F.concat(F.lit("该英文片段主要围绕 "), F.when(names != "", names).otherwise(F.lit("核心概念")), F.lit(" 等概念展开。"))


def embedding_text(content: Column, retrieval: Column, formulas: Column, summary: Column, terms: Column) -> Column:
    pairs = F.array_join(
        F.transform(
            F.filter(terms, lambda t: (t["source"] != "") | (t["zh"] != "")),
            lambda t: F.concat(t["source"], F.lit(" = "), t["zh"]),
        ),
        "；",
    )
    parts = F.array(
        F.when(retrieval != "", retrieval).otherwise(content),
        F.when(F.size(formulas) > 0, F.concat(F.lit("Formulae: "), F.array_join(F.slice(formulas, 1, 5), " ; "))),
        F.when(summary != "", F.concat(F.lit("中文摘要："), summary)),
        F.when(pairs != "", F.concat(F.lit("核心术语："), pairs)),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def enrich_chunks(chunks: DataFrame, content: str = "content", model_terms: str | None = None) -> DataFrame:
    """Add retrieval_text, formulas, source_lang, summary_zh, key_terms, embedding_text to each chunk.

    A map over rows: no shuffle, whatever the size of a material.
    ``model_terms`` names an optional ARRAY column of terms supplied from outside.
    """
    raw = F.col(content)
    staged = chunks.withColumn("retrieval_text", clean_for_retrieval(raw)).withColumn("formulas", extract_formulas(raw))
    staged = staged.withColumn("source_lang", detect_language(F.col("retrieval_text"))).withColumn(
        "_local", extract_key_terms(F.col("retrieval_text"))
    )
    staged = staged.withColumn(
        "summary_zh",
        F.when(F.col("source_lang") == "en", english_summary(F.col("_local"))).otherwise(shorten(F.col("retrieval_text"))),
    )
    if model_terms is None:
        terms = rerank_extracted(F.col("_local"))
    else:
        terms = rank_terms(F.concat(normalize_terms(F.col(model_terms), "llm"), normalize_terms(F.col("_local"), "local")))
    staged = staged.withColumn("key_terms", terms).drop("_local")
    return staged.withColumn(
        "embedding_text",
        embedding_text(raw, F.col("retrieval_text"), F.col("formulas"), F.col("summary_zh"), F.col("key_terms")),
    )


def rebuild_chunk_terms(chunks: DataFrame, material_ids: DataFrame) -> DataFrame:
    """Recomputed text columns for the chunks of the chosen materials; vectors are untouched.

    Returned rows are the diff to write; the caller overwrites with ``replace_chunks``.
    """
    wanted = chunks.join(material_ids.select("material_id").distinct(), "material_id", "left_semi")
    raw = F.coalesce(F.col("content_raw"), F.col("content_preview"), F.lit(""))
    out = wanted.withColumn("content_raw", raw)
    out = out.withColumn("retrieval_text", clean_for_retrieval(F.col("content_raw"))).withColumn(
        "formulas", extract_formulas(F.col("content_raw"))
    )
    return out.withColumn("key_terms", extract_key_terms(F.col("retrieval_text"))).withColumn(
        "source_lang", detect_language(F.col("retrieval_text"))
    )


# --- flat metadata as a vector store keeps it ---------------------------------


def pack_metadata(df: DataFrame, scalars: list[str]) -> DataFrame:
    """One JSON object of scalars per row, nulls dropped, with terms and formulas as JSON strings inside."""
    fields = [F.col(c) for c in scalars] + [
        F.to_json(F.coalesce(F.col("key_terms"), F.array().cast(f"array<{TERM_TYPE}>"))).alias("key_terms_json"),
        F.to_json(F.coalesce(F.col("formulas"), F.array().cast("array<string>"))).alias("formulas_json"),
    ]
    return df.withColumn("metadata", F.to_json(F.struct(*fields)))


def unpack_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Terms and formulas back from the JSON object; bad JSON becomes an empty list."""
    def inner(name: str, schema: str) -> Column:
        text = F.get_json_object(F.col(column), f"$.{name}")
        value = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))
        return F.coalesce(value, F.array().cast(schema))

    return df.withColumn("key_terms", inner("key_terms_json", f"array<{TERM_TYPE}>")).withColumn(
        "formulas", inner("formulas_json", "array<string>")
    )
