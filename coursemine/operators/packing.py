"""Greedy packing of paragraphs that are rows: a material of any length, no text in one row, no fold over it.

The greedy rule (``chunking.chunk_text``) carries one number from paragraph to paragraph, the
length of the open chunk.  So a block of paragraphs is a function from the length at its
start to that at its end, a short array.  These functions are composed in a tree, block
by block and then group by group; the way down gives every block its own start, and each
block packs alone.  A chunk that goes over the edge of a block is put together from its two parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import normalize_text, strip, unnest
from coursemine.operators.chunking import windows
from coursemine.operators.ranking import number_in_key

GLUE = "\n\n"
# Paragraphs of a block, and blocks (or groups) that one task composes.
BLOCK = 4096
FAN = 256


def paragraph_rows(pieces: DataFrame, keys: list[str], position: str, text: str = "text") -> DataFrame:
    """(*keys, position, part, paragraph) of pieces of text that stand in order, such as pages or turns.

    A piece ends a paragraph.  Null and blank pieces have none.
    """
    found = F.filter(F.transform(F.split(normalize_text(F.col(text)), "\n{2,}"), strip), lambda p: p != "")
    return unnest(pieces, [*keys, F.col(position).alias("position")], found, "part", "paragraph")


def _lengths_after(lengths: np.ndarray, size: int) -> np.ndarray:
    """Open length at the end of a block for every open length 0 … size at its start."""
    state: np.ndarray | int = np.arange(size + 1)
    for n in lengths.tolist():
        if n > size:
            state = 0
        elif isinstance(state, int):
            state = state + 2 + n if state and state + 2 + n <= size else n
        else:
            state = np.where((state > 0) & (state + 2 + n <= size), state + 2 + n, n)
            if state[0] == state[-1] and (state == state[0]).all():
                state = int(state[0])  # all ways have met
    return np.full(size + 1, state) if isinstance(state, int) else state


def _packed(frame: pd.DataFrame, start: int, size: int) -> pd.DataFrame:
    """Chunks of one block: where they start, whether they are a long paragraph, and the edge that they go over."""
    out, current, open_length, first = [], [], start, 0
    block = int(frame["_block"].iloc[0])
    from_before = start > 0

    def flush(edge):
        if current:
            out.append((first, False, edge, GLUE.join(current)))
            current.clear()

    for at, n, paragraph in zip(frame["_n"].tolist(), frame["_length"].tolist(), frame["paragraph"].tolist()):
        joins = open_length > 0 and n <= size and open_length + 2 + n <= size
        if not joins:
            flush(block if from_before else None)
            from_before, first = False, at
        elif not current:
            first = at
        if n > size:
            out.append((at, True, None, paragraph))
            open_length = 0
        else:
            open_length = open_length + 2 + n if joins else n
            current.append(paragraph)
    # the next block may go on with what is open here; if nothing does, its parts are one
    flush(block if from_before else block + 1)
    return pd.DataFrame(out, columns=["_n", "_long", "_edge", "content"]).astype({"_edge": "Int64"})


def pack_paragraphs(
    paragraphs: DataFrame, keys: list[str], size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP,
    pieces_per_block: int = 64, block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """(*keys, chunk_index, content) from ``paragraph_rows``: the rows of ``chunk_documents`` on the joined text.

    ``position`` must be a number that holds few rows each; keys must not be null.  One chunk takes at
    most (size + 2) / 3 paragraphs, and a block must hold more.
    """
    if block <= (size + 2) // 3 + 1:
        raise ValueError("a block must hold more paragraphs than a chunk can")
    order = [F.col("position"), F.col("part")]
    rows = number_in_key(paragraphs, keys, F.floor(F.col("position") / pieces_per_block), order, "_n")
    rows = rows.select(*keys, (F.col("_n") - 1).cast("long").alias("_n"), F.length("paragraph").alias("_length"), "paragraph")
    rows = rows.withColumn("_block", F.floor(F.col("_n") / block).cast("long"))
    key_schema = ", ".join(f"`{k}` {paragraphs.schema[k].dataType.simpleString()}" for k in keys)
    starts = _block_starts(rows.select(*keys, "_block", "_n", "_length"), keys, key_schema, size, fan)

    def pack(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        start = int(right["_start"].iloc[0]) if len(right) else 0
        out = _packed(left.sort_values("_n"), start, size)
        for i, k in enumerate(keys):
            out.insert(i, k, [left[k].iloc[0]] * len(out))
        return out

    by = [*keys, "_block"]
    packed = rows.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(pack, f"{key_schema}, _n long, _long boolean, _edge long, content string")
    # parts of chunks over an edge meet; everything else has an edge of its own
    parts = packed.groupBy(*keys, F.coalesce("_edge", -1 - F.col("_n")).alias("_edge")).agg(
        F.min("_n").alias("_n"), F.max("_long").alias("_long"),
        F.array_sort(F.collect_list(F.struct("_n", "content"))).alias("_parts"),
    )
    content = F.array_join(F.transform("_parts", lambda x: x["content"]), GLUE)
    cut = parts.select(*keys, "_n", "_long", content.alias("content"))
    pieces = F.when(F.col("_long"), windows(F.col("content"), size, overlap)).otherwise(F.array("content"))
    chunks = unnest(cut, [*keys, "_n"], F.filter(pieces, lambda x: F.length(x) >= fv.MIN_CHUNK_CHARS), "_part", "content")
    chunks = number_in_key(chunks, keys, F.floor(F.col("_n") / block), [F.col("_n"), F.col("_part")], "_i")
    return chunks.select(*keys, (F.col("_i") - 1).alias("chunk_index"), "content")


def _block_starts(rows: DataFrame, keys: list[str], key_schema: str, size: int, fan: int) -> DataFrame:
    """(*keys, _block, _start): length of the open chunk where each block begins; blocks that begin with none are left out."""
    schema = f"{key_schema}, _block long, _after array<int>"
    by = [*keys, "_block"]

    def described(frame: pd.DataFrame, after: np.ndarray, at: int) -> pd.DataFrame:
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "_block": [at], "_after": [after.astype(np.int32)]})

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame.sort_values("_n")["_length"].to_numpy()
        return described(frame, _lengths_after(lengths, size), int(frame["_block"].iloc[0]))

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_block")
        after = np.arange(size + 1)
        for step in frame["_after"]:
            after = np.asarray(step)[after]
        return described(frame, after, int(frame["_block"].iloc[0]) // fan)

    def descend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("_block")
        state, starts = int(right["_start"].iloc[0]) if len(right) else 0, []
        for step in left["_after"]:
            starts.append(state)
            state = int(step[state])
        out = left[by].assign(_start=starts)
        return out[out["_start"] > 0]

    # only materials of several blocks need more than the start, which is zero
    several = rows.filter(F.col("_block") > 0).select(*keys).distinct()
    top = rows.agg(F.max("_block")).first()[0] or 0
    levels = [rows.join(several, keys, "left_semi").groupBy(*by).applyInPandas(measure, schema)]
    while top >= fan:
        levels.append(levels[-1].groupBy(*keys, F.floor(F.col("_block") / fan)).applyInPandas(compose, schema))
        top //= fan
    group = F.floor(F.col("_block") / fan).alias("_group")
    starts = rows.sparkSession.createDataFrame([], f"{key_schema}, _block long, _start long")
    for level in reversed(levels):
        grouped = level.groupBy(*keys, group)
        starts = grouped.cogroup(starts.groupBy(*keys, F.col("_block").alias("_group"))).applyInPandas(descend, f"{key_schema}, _block long, _start long")
    return starts
