"""Packing of paragraph rows against the fold over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from coursemine.operators import chunking, packing


def pieces(seed, n, longest):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé字", k=rng.randint(1, 9)))
    out = []
    for _ in range(n):
        k = rng.choice([0, 1, 1, 2, 5])
        paragraphs = [" ".join(word() for _ in range(rng.choice([1, 1, 3, 8, longest]))) for _ in range(k)]
        out.append(rng.choice([None, "", " \n", "\n\n\n".join(paragraphs), "\n\n".join(paragraphs) + "\n"]))
    return out


@pytest.mark.parametrize("size, block, fan", [(100, 36, 2), (100, 4096, 256), (40, 16, 3)])
def test_equals_the_fold(spark, size, block, fan):
    rows = [(m, i, t) for m, (n, longest) in enumerate([(400, 12), (3, 20), (1, 2), (60, 60), (700, 2)]) for i, t in enumerate(pieces(m, n, longest))]
    rows += [(9, 0, None), (10, 0, "alone and long enough to stay")]
    df = spark.createDataFrame(rows, "material_id bigint, page int, text string").repartition(5)
    joined = spark.createDataFrame(
        [(m, "\n\n".join(t for k, _, t in rows if k == m and t is not None)) for m in {r[0] for r in rows}], "material_id bigint, text string")
    want = {tuple(r) for r in chunking.chunk_documents(joined, size, 7).select("material_id", "chunk_index", "content").collect()}
    extra = df.withColumn("block", F.lit(1)).withColumn("content", F.lit("x"))
    got = packing.pack_paragraphs(packing.paragraph_rows(extra, ["material_id"], "page"), ["material_id"], size, 7, 8, block, fan).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_material_with_most_rows_is_cut_into_blocks(spark):
    """No task gets more than a block of the material, whose paragraphs never meet a break that would reset the packing."""
    df = spark.range(30_000).select(F.lit(1).alias("material_id"), F.col("id").alias("page"), F.repeat(F.lit("ab "), (F.col("id") * 7 % 90 + 5).cast("int")).alias("text"))
    rows = packing.paragraph_rows(df, ["material_id"], "page")
    got = packing.pack_paragraphs(rows, ["material_id"], block=300, fan=4)
    whole = df.groupBy("material_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    want = chunking.chunk_documents(whole).select("material_id", "chunk_index", "content")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_no_rows_and_too_small_blocks(spark):
    empty = spark.createDataFrame([], "material_id bigint, page int, text string")
    assert packing.pack_paragraphs(packing.paragraph_rows(empty, ["material_id"], "page"), ["material_id"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack_paragraphs(packing.paragraph_rows(empty, ["material_id"], "page"), ["material_id"], block=100)
