"""Chunking: paragraphs packed up to a size, long paragraphs cut into overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import let, normalize_text, strip, unnest
from coursemine.operators.ranking import number_in_key


def _empty() -> Column:
    return F.array().cast("array<string>")


def windows(paragraph: Column, size: int, overlap: int) -> Column:
    """Overlapping character windows of a long paragraph.

    The paragraph is cut once into pieces of one step; each window is a piece
    followed by the start of the next ones.  That is linear in the text, where
    one ``substring`` per window would rescan it from its start.
    """
    step = max(1, size - overlap)
    pieces = F.regexp_extract_all(paragraph, F.lit("(?s).{1,%d}" % step), F.lit(0))
    following = -(-(size - step) // step)
    joined = pieces
    if following > 0:
        joined = let(
            pieces,
            lambda ps: F.transform(
                ps,
                lambda p, i: F.concat(p, F.substring(F.array_join(F.slice(ps, i + 2, following), ""), 1, size - step)),
            ),
        )
    return F.filter(F.transform(joined, strip), lambda w: w != "")


def chunk_text(c: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Chunks of one text as ARRAY<string>."""
    paragraphs = F.filter(F.transform(F.split(normalize_text(c), "\n{2,}"), strip), lambda p: p != "")
    start = F.struct(_empty().alias("done"), F.lit("").alias("open"))

    def flushed(s: Column) -> Column:
        return F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        joined = F.concat(s["open"], F.lit("\n\n"), p)
        return (
            F.when(
                F.length(p) > size,
                F.struct(F.concat(flushed(s), windows(p, size, overlap)).alias("done"), F.lit("").alias("open")),
            )
            .when(s["open"] == "", F.struct(s["done"].alias("done"), p.alias("open")))
            .when(F.length(joined) <= size, F.struct(s["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), p.alias("open")))
        )

    def pack(ps: Column) -> Column:
        # one paragraph is the common case and needs no fold
        only = F.get(ps, F.lit(0))
        single = F.when(F.length(only) > size, windows(only, size, overlap)).otherwise(ps)
        return F.when(F.size(ps) > 1, F.aggregate(ps, start, step, flushed)).when(F.size(ps) == 1, single).otherwise(_empty())

    return F.filter(let(paragraphs, pack), lambda x: F.length(x) >= fv.MIN_CHUNK_CHARS)


def chunk_documents(df: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """(material_id, text, …) → one row per chunk with chunk_index and content; other columns are kept."""
    kept = [c for c in df.columns if c != "text"]
    return unnest(df, kept, chunk_text(F.col("text"), size, overlap), "chunk_index", "content")


def source_label(filename: Column, chunk_index: Column, page_index: Column | None = None) -> Column:
    plain = F.concat(filename, F.lit("#chunk-"), chunk_index)
    if page_index is None:
        return plain
    paged = F.concat(filename, F.lit("#page-"), page_index, F.lit("-chunk-"), chunk_index)
    return F.when(page_index.isNotNull(), paged).otherwise(plain)


def chunk_pages(pages: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """(material_id, page_index, text, …) → chunks numbered across the pages of each material, from 0.

    Numbering goes by blocks of 64 pages, so a material that holds much of the
    corpus is not gathered into one task.
    """
    kept = [c for c in pages.columns if c != "text"]
    cut = unnest(pages, kept, chunk_text(F.col("text"), size, overlap), "_pos", "content")
    numbered = number_in_key(
        cut, ["material_id"], F.floor(F.col("page_index") / 64), [F.col("page_index"), F.col("_pos")], "_n"
    )
    return numbered.withColumn("chunk_index", F.col("_n") - 1).drop("_n", "_pos")
