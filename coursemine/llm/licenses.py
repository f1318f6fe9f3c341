"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of the
same k-grams in license templates.  A hit votes for its diagonal, document position minus
template position; neighbouring diagonals of a template, as left by inserted or missing
words, are merged, and a merged span counts when it holds enough of the template within
a length like the template's.

Defined results: null and empty texts have no words, no places and no labels; repeated
rows each have their own result; texts without a place have null first and last words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from coursemine.llm.common import cut
from coursemine.llm.decontamination import _arrow_kind
from coursemine.llm.windows import MEMO, Memo, bitmap, may_match, rolling, word_code

GRAM = 3
# Diagonals this far apart belong together; share of a template's k-grams that a span needs; its longest length in templates.
NEAR = 4
ENOUGH = 0.6
LONGEST = 1.5
# Phrases that name a license.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Notices in their usual wording.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
]
# Bytes that separate words, after lowering A-Z: all ASCII but letters and digits.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def text_words(text: str) -> list[bytes]:
    return text.encode().lower().translate(_TABLE).split()


def templates(spark: SparkSession) -> DataFrame:
    """template, label, base, grams (their number), q, hash, gram: a table of fixed size."""
    rows = []
    for t, (label, text) in enumerate(PHRASES + NOTICES):
        w = text_words(text)
        hashes = rolling(np.array([word_code(x) for x in w], np.uint64), GRAM)
        rows += [
            (t, label, t < len(PHRASES), len(hashes), q, int(h), b" ".join(w[q:q + GRAM]).decode())
            for q, h in enumerate(hashes)
        ]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, q int, hash long, gram string")


def _grams(bits, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([
        ("at", pa.int64()), ("hash", pa.int64()), ("gram", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits_set = Memo(word_code, MEMO), bits.value
        for b in batches:
            counts, hits = [], []
            for text in b.column(1):
                w = text_words(text.as_py() or "")
                hashes = rolling(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)), GRAM)
                counts.append(len(w))
                hits.append([
                    {"at": i, "hash": int(hashes[i]), "gram": b" ".join(w[i:i + GRAM]).decode()}
                    for i in may_match(hashes, bits_set).tolist()
                ])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(hits, schema.field("hits").type)], schema=schema)

    return run


def license_spans(hits: DataFrame, sides: DataFrame) -> DataFrame:
    """row, label, base, start, last, score: verified spans from hits (row, at, hash, gram)."""
    votes = hits.join(F.broadcast(sides), ["hash", "gram"]).withColumn("diagonal", F.col("at") - F.col("q"))
    diagonals = votes.groupBy("row", "template", "label", "base", "grams", "diagonal").agg(
        F.collect_set("q").alias("q"), F.min("at").alias("start"), F.max("at").alias("last"))
    # A phrase stands where a single diagonal has all of its k-grams.
    exact = diagonals.filter(F.col("base") & (F.size("q") == F.col("grams"))).select(
        "row", "label", "base", "start", "last", F.lit(1.0).alias("score"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(0)) > NEAR
    loose = diagonals.filter(~F.col("base")).withColumn("apart", apart.cast("int"))
    loose = loose.withColumn("cluster", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = loose.groupBy("row", "template", "label", "base", "grams", "cluster").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("q")))).alias("held"), F.min("start").alias("start"), F.max("last").alias("last"))
    score = F.col("held") / F.col("grams")
    fits = F.col("last") - F.col("start") + GRAM <= LONGEST * (F.col("grams") + GRAM - 1)
    return exact.unionByName(spans.filter((score >= ENOUGH) & fits).select("row", "label", "base", "start", "last", score.alias("score")))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row."""
    spark = docs.sparkSession
    sides = templates(spark)
    bits = spark.sparkContext.broadcast(bitmap(sides))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    rows = rows.mapInArrow(_grams(bits, _arrow_kind(rows, "id")), f"id {kind}, n_words long, hits array<struct<at: bigint, hash: bigint, gram: string>>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    spans = license_spans(rows.select("row", F.explode("hits").alias("h")).select("row", "h.*"), sides)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("row").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), names(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        names(F.col("label")).alias("labels"), F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "last", "label", "score"))).alias("spans"),
    )
    out = rows.select("row", F.col("id").alias(key), "n_words").join(found, "row", "left").drop("row")
    return out.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
