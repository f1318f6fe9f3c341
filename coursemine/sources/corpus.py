"""Reading course files, OCR results and page-marked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import strip, unnest
from coursemine.operators.ranking import number_in_key

TEXT_EXTENSIONS = ["txt", "md"]
PAGE_MARK = r"\[(?:PDF page|PDF OCR page|PPT slide) (\d+)\]"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def decode_text(content: Column) -> Column:
    """UTF-8 text of file bytes; invalid bytes are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def read_text_corpus(
    spark: SparkSession, path: str, exts: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(materials, rejected): whole text of TXT/MD files, and the other files with a reason.

    The listing is filtered by name, in any case, before content is read; for the other
    files only their paths are read.
    """
    exts = TEXT_EXTENSIONS if exts is None else exts
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    names = ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in exts)
    texts = found.option("pathGlobFilter", "{" + names + "}").load(path).select(
        "path", extension(F.col("path")).alias("file_type"), decode_text(F.col("content")).alias("text")
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", extension(F.col("path")).alias("file_type"))
    reason = F.when(
        F.col("file_type").isin(*fv.SUPPORTED_EXTENSIONS), "binary format: supply its extracted, page-marked text"
    ).otherwise(F.concat(F.lit("unsupported file type: "), F.col("file_type")))
    rejected = files.filter(~F.col("file_type").isin(*exts)).select("path", "file_type", reason.alias("reason"))
    return texts, rejected


def detect_changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state, sha256) from files (path, content) and the cached hashes (path, file_sha256).

    New and stale files are to be processed; entries of the manifest without a
    file, or without a hash, are stale as well.
    """
    now = files.select("path", F.sha2(F.col("content"), 256).alias("sha256"))
    both = now.join(manifest.select("path", "file_sha256", F.lit(True).alias("_known")), "path", "full")
    state = (
        F.when(F.col("sha256").isNull(), "stale")
        .when(F.col("_known").isNull(), "new")
        .when(F.coalesce("file_sha256", F.lit("")) == F.col("sha256"), "unchanged")
        .otherwise("stale")
    )
    return both.select("path", state.alias("state"), "sha256")


OCR_SCHEMA = "result struct<layoutParsingResults: array<struct<markdown: struct<text: string>>>>"


def ocr_pages_from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, failed) from JSONL lines (material_id, line_no, line).

    Every item of every line takes a page number; pages without text are left
    out but keep theirs.  A material without any page goes to ``failed``.
    """
    items = F.from_json("line", OCR_SCHEMA)["result"]["layoutParsingResults"]
    parsed = unnest(lines.filter(strip(F.col("line")) != ""), ["material_id", "line_no"], items, "pos", "item")
    block = F.floor(F.col("line_no") / 256)
    numbered = number_in_key(parsed, ["material_id"], block, [F.col("line_no"), F.col("pos")], "page_index")
    pages = numbered.select(
        "material_id", "page_index", strip(F.coalesce(F.col("item.markdown.text"), F.lit(""))).alias("markdown")
    ).filter(F.col("markdown") != "")
    failed = lines.select("material_id").distinct().join(pages.select("material_id").distinct(), "material_id", "left_anti")
    return pages, failed.withColumn("reason", F.lit("no page text was extracted"))


def read_ocr_pages(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.jsonl)?$") -> tuple[DataFrame, DataFrame]:
    """OCR pages of JSONL files, one file per material; ``name`` finds the material's id in the path, the file's name by default."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    named = whole.select(
        F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("material_id"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"),
    )
    return ocr_pages_from_lines(named)


def split_marked_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, page_index, page_text) of texts with page marks; text before the first mark has no page."""
    kept = [c for c in df.columns if c != text]
    parts = unnest(df, kept, F.split(F.col(text), r"(?m)(?=^" + PAGE_MARK + "$)"), "_pos", "_part")
    number = F.regexp_extract("_part", r"\A" + PAGE_MARK, 1)
    body = strip(F.regexp_replace("_part", r"\A" + PAGE_MARK, ""))
    return parts.select(*kept, F.when(number != "", number.cast("int")).alias("page_index"), body.alias("page_text")).filter(
        F.col("page_text") != ""
    )


def assemble_marked_pages(pages: DataFrame, mark: str = "PDF page") -> DataFrame:
    """One marked text per material, pages joined by a blank line, empty ones left out.

    The result is one document per row, so a group is as long as that document.
    """
    part = F.concat(F.lit(f"[{mark} "), F.col("page_index").cast("string"), F.lit("]\n"), F.col("page_text"))
    return (
        pages.filter(strip(F.coalesce("page_text", F.lit(""))) != "")
        .groupBy("material_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("page_index", part.alias("part")))), lambda x: x["part"]), "\n\n"
            ).alias("text")
        )
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """Text per page, OCR before built-in text; readable tells whether there is any."""
    given = lambda c: F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    text = F.coalesce(given("ocr_text"), given("built_in_text"), F.lit(""))
    return pages.select("material_id", "page_index", text.alias("text")).withColumn("readable", F.col("text") != "")


def page_catalog(pages: DataFrame) -> DataFrame:
    """(material_id, page_count, readable_pages) over pages with built-in and OCR text."""
    p = page_texts(pages)
    return p.groupBy("material_id").agg(
        F.count_distinct("page_index").alias("page_count"),
        F.array_sort(F.collect_set(F.when(F.col("readable"), F.col("page_index")))).alias("readable_pages"),
    )
