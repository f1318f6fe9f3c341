"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose parameters were
changed keeps its template.  Windows of template tokens of the documents are hash-joined
with those of the benchmark.  On a diagonal (document position minus item position) the
placeholders of item and document are aligned; a true re-parameterisation maps each
value of the item to one value of the document.  A document is contaminated by an item
when consistent diagonals together cover enough of the item's template.

A word at a sentence start may be a name, and a copy in lower case hides names: items are
looked for in three readings (such words as words, as names; no names at all), documents
in the first two.  Windows with few plain words must agree in the values of their
placeholders as well.  An item shorter than a window is one window of its own length; of
fewer than ``SHORT`` tokens it must be a line of the document, as a word or two stand in
many texts that have nothing of a benchmark.

Defined results: null and empty texts have no tokens and are clean; an item without tokens
is never found; repeated rows and repeated items each have their own
result; with an empty benchmark all documents are clean.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from coursemine.llm.common import cut
from coursemine.llm.windows import bitmap, may_match, rolling
from coursemine.operators.ranking import is_small

WINDOW = 6
# Items of fewer tokens are found only as whole lines.
SHORT = 3
# Windows with fewer plain words match only with equal values; a window of placeholders alone says nothing.
MIN_LITERAL = 3
COVERAGE = 0.5
CONSISTENCY = 0.8
# Benchmark windows up to this many go to every task (about 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_WINDOWS = 500_000
# Texts that are cut into tokens at a time.
PIECE_BYTES = 4_000_000
# Unit words.
UNITS = frozenset("""
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons
s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years
dollar dollars cent cents euro euros percent degree degrees mph kmh kph w kw v hz
""".split())
NUMBER = r"^[0-9][0-9.,:/]*(?:am|pm|st|nd|rd|th)?$"
NUMBER_WORDS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen
""".split())
# A number with its unit in one token, as 5kg.
GLUED = re.compile(rf"(?<![\w.,:/])(\d[\d.,:/]*)({'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\w)", re.I | re.A)
EDGES = string.punctuation + "“”‘’„«»‹›…–—¿¡€£°"
NONE, NUM, UNIT, NAME = 0, 1, 2, 3
BREAK = "\x1e"
# Readings of a text: words at a sentence start are words, or names where they have a capital; nothing is a name.
WORDS, NAMES, LOWER = 0, 1, 2
SCHEMA = "hits array<struct<at: int, width: int, reading: int, hash: bigint, slot_at: array<int>, slots: array<string>>>"


# A token is one number: the hash of its word above four bits, its class below, and a bit where a sentence ends;
# of a token of several, as a number with its unit, its class alone.
PLAIN, NAMED, LINE, SEVERAL, ENDS = 4, 5, 6, 7, 8


def _describe(words: pa.Array) -> np.ndarray:
    """The numbers of distinct tokens; of one without a word, its class alone."""
    told = lambda x: x.to_numpy(zero_copy_only=False)
    cores = pc.utf8_trim(words, characters=EDGES)
    low, size = pc.utf8_lower(cores), told(pc.utf8_length(cores))
    # Words all in capitals are shouting or acronyms, not names.
    named = told(pc.utf8_is_upper(pc.utf8_slice_codeunits(cores, 0, 1))) & ((size == 1) | ~told(pc.utf8_is_upper(cores)))
    kind = np.where(named, NAMED, PLAIN)
    kind[told(pc.is_in(low, pa.array(sorted(UNITS), low.type)))] = UNIT
    kind[told(pc.match_substring_regex(low, NUMBER)) | told(pc.is_in(low, pa.array(sorted(NUMBER_WORDS), low.type)))] = NUM
    ends = np.where(told(pc.match_substring_regex(words, r"[.!?:]$")), ENDS, 0)
    out = pd.util.hash_array(low.to_numpy(zero_copy_only=False), categorize=False) & ~np.uint64(15) | (kind | ends).astype(np.uint64)
    bare = size == 0
    out[bare] = (NONE | ends)[bare].astype(np.uint64)
    # the empty token stands before the first one of a text
    out[told(pc.equal(words, BREAK))], out[told(pc.equal(words, ""))] = LINE | ENDS, NONE | ENDS
    for i in np.flatnonzero(told(pc.match_substring_regex(words, r"[0-9][0-9.,:/]*[A-Za-z]"))).tolist():
        if GLUED.search(words[i].as_py()):
            out[i] = SEVERAL
    return out


class Reading(NamedTuple):
    """Template tokens of one reading: codes (placeholders, or above them words), codes of their values, whether a code differs
    from the first reading, whether a line begins here, the word behind each; a run of names is one placeholder."""

    codes: np.ndarray
    values: np.ndarray
    other: np.ndarray
    begins: np.ndarray
    behind: np.ndarray
    words: pa.Array


class Canonical:
    """Template tokens of texts, cut and numbered by the batch; each distinct token of it is described once."""

    def numbered(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """Per text: numbers of its tokens, and which of the words of the batch they are."""
        lists = pc.ascii_split_whitespace(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", f" {BREAK} "))
        coded = lists.flatten().dictionary_encode()
        at, words, ends = coded.indices.to_numpy().astype(np.int64), coded.dictionary, lists.offsets.to_numpy()
        numbers = _describe(words)
        glued = np.flatnonzero(numbers == SEVERAL)
        if len(glued):
            first, parts, more = np.arange(len(words)), np.ones(len(words), np.int64), []
            for i in glued.tolist():
                cut_up = GLUED.sub(r"\1 \2", words[i].as_py()).split()
                first[i], parts[i] = len(words) + len(more), len(cut_up)
                more += cut_up
            more = pa.array(more, words.type)
            words, numbers = pa.concat_arrays([words, more]), np.concatenate([numbers, _describe(more)])
            lengths = parts[at]
            starts = np.concatenate([[0], np.cumsum(lengths)])
            ends = starts[ends]
            at = np.repeat(first[at] - starts[:-1], lengths) + np.arange(starts[-1])
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            yield numbers[at[a:b]], at[a:b], words

    def readings(self, numbers: np.ndarray, at: np.ndarray, words: pa.Array, kinds: tuple[int, ...] = (WORDS,)) -> Iterator[Reading]:
        kind = (numbers & np.uint64(7)).astype(np.int8)
        word = numbers & ~np.uint64(15) | np.uint64(PLAIN)
        lines = np.cumsum(kind == LINE)
        kind[kind == LINE] = NONE
        starts = np.ones(len(numbers), bool)
        starts[1:] = (numbers[:-1] & np.uint64(ENDS)) > 0
        fixed = np.where(kind < PLAIN, kind.astype(np.uint64), word)  # as it is without names
        names = kind == NAMED
        plain = np.where(names & ~starts, np.uint64(NAME), fixed)
        for reading in kinds:
            codes = plain if reading == WORDS else fixed if reading == LOWER else np.where(names, np.uint64(NAME), fixed)
            dropped = codes == NONE
            dropped[1:] |= (codes[1:] == NAME) & (codes[:-1] == NAME)
            kept = np.flatnonzero(~dropped)
            line = lines[kept]
            begins = np.ones(len(kept), bool)
            begins[1:] = line[1:] > line[:-1]
            yield Reading(codes[kept], word[kept], (codes != plain)[kept], begins, at[kept], words)

    def codes(self, text: str) -> tuple[np.ndarray, list[str]]:
        """Template codes and the words behind them."""
        first = next(self.readings(*next(self.numbered(pa.array([text])))))
        return first.codes, first.words.take(pa.array(first.behind)).to_pylist()

    def items(self, texts: pa.Array) -> Iterator[list[tuple[int, list[dict]]]]:
        """(length, windows) of every distinct reading of an item; a short one is one window."""
        for text in self.numbered(texts):
            out, known = [], set()
            for kind, reading in enumerate(self.readings(*text, (WORDS, NAMES, LOWER))):
                codes = reading.codes
                if codes.tobytes() not in known and len(codes):
                    known.add(codes.tobytes())
                    out.append((len(codes), _windows(reading, kind, min(WINDOW, len(codes)))))
            yield out

    def windows(self, texts: pa.Array, bits_set: np.ndarray, widths: list[int]) -> Iterator[list[dict]]:
        """Windows of a document that an item may have; of the second reading, those that it changes."""
        for text in self.numbered(texts):
            yield [
                w for kind, reading in enumerate(self.readings(*text, (WORDS, NAMES)))
                for width in widths for w in _windows(reading, kind, width, bits_set, kind != WORDS)
            ]


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts a few megabytes at a time; a longer one by itself."""
    at, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > at and held + n > PIECE_BYTES:
            yield texts.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(texts):
        yield texts.slice(at)


def _within(marks: np.ndarray, width: int) -> np.ndarray:
    """How many of every ``width`` consecutive entries are set."""
    total = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=total[1:])
    return total[width:] - total[:-width]


def _windows(r: Reading, kind: int, width: int, bits_set: np.ndarray | None = None, changed: bool = False) -> list[dict]:
    codes = r.codes
    if len(codes) < width or changed and not r.other.any():
        return []
    at = np.arange(len(codes) - width + 1)
    if width < SHORT and bits_set is not None:
        ends = np.append(r.begins[1:], True)
        at = at[r.begins[at] & ends[at + width - 1] & (_within(r.begins, width) == 1)]
    few = _within(codes > NAME, width) < min(MIN_LITERAL, width)
    if changed:
        at = at[_within(r.other, width)[at] > 0]
    rolled = rolling(codes, width)
    if few[at].any():
        rolled = np.where(few, rolling(r.values, width), rolled)
    hashes = rolled[at]
    hit = may_match(hashes, bits_set) if bits_set is not None else np.arange(len(hashes))
    out = []
    for i, h in zip(at[hit].tolist(), hashes[hit].tolist()):
        places = (i + np.flatnonzero(codes[i:i + width] <= NAME)).tolist()
        slots = [r.words[r.behind[j]].as_py().strip(EDGES).lower() for j in places]
        out.append({"at": i, "width": width, "reading": kind, "hash": h, "slot_at": places, "slots": slots})
    return out


HITS = pa.list_(pa.struct([
    ("at", pa.int32()), ("width", pa.int32()), ("reading", pa.int32()), ("hash", pa.int64()), ("slot_at", pa.list_(pa.int32())), ("slots", pa.list_(pa.string()))]))


def _items_of(kind: pa.DataType):
    """item, length, hits: a row for each reading of each item."""
    schema = pa.schema([("item", kind), ("length", pa.int32()), ("hits", HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for b in batches:
            found = [(i, *reading) for i, of in enumerate(canonical.items(b.column(1))) for reading in of]
            columns = [b.column(0).take(pa.array([i for i, _, _ in found], pa.int64())), pa.array([n for _, n, _ in found], pa.int32()), pa.array([w for _, _, w in found], HITS)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _windows_of(bits, widths: list[int], key: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical, bits_set = Canonical(), bits.value
        for b in batches:
            hits = pa.array([w for texts in _pieces(b.column(1)) for w in canonical.windows(texts, bits_set, widths)], HITS)
            yield pa.RecordBatch.from_arrays([b.column(0), hits], schema=pa.schema([(key, kind), ("hits", HITS)]))

    return run


def _arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def contaminations(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
                   item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """row, key, items (sorted), coverage (largest), renamed: for every row of ``docs``, none of an item when clean."""
    spark = docs.sparkSession
    kind = benchmark.schema[item].dataType.simpleString()
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("t"))
    items = items.mapInArrow(_items_of(_arrow_kind(items, "item")), f"item {kind}, length int, {SCHEMA}")
    items = cut(items.withColumn("item_row", F.monotonically_increasing_id()).select(
        "item_row", "item", "length", F.explode("hits").alias("w")).select("item_row", "item", "length", "w.*"))
    bits, widths = spark.sparkContext.broadcast(bitmap(items)), [r["width"] for r in items.select("width").distinct().collect()]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    rows = rows.mapInArrow(_windows_of(bits, widths, "id", _arrow_kind(rows, "id")), f"id {kind}, {SCHEMA}")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    side = items.select("item_row", "item", "length", F.col("hash").alias("_hash"), F.col("width").alias("_width"), F.col("at").alias("q"), F.col("slots").alias("item_slots"))
    side = F.broadcast(side) if is_small(items, BROADCAST_WINDOWS) else side
    joined = found.join(side, (F.col("hash") == F.col("_hash")) & (F.col("width") == F.col("_width")) & (F.size("slots") == F.size("item_slots")))
    # Positions and slot pairs per diagonal: both bounded by the item's length.
    diagonals = joined.groupBy("row", "item_row", "item", "length", "width", "reading", (F.col("at") - F.col("q")).alias("diagonal")).agg(
        F.collect_set("q").alias("q"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))))).alias("pairs"),
    )
    n_pairs, n_values = F.size("pairs"), F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    consistent = F.when(n_pairs == 0, 1.0).otherwise(n_values / n_pairs)
    renamed = F.exists("pairs", lambda p: p["i"] != p["d"])
    good = diagonals.filter(consistent >= CONSISTENCY).withColumn("renamed", renamed)
    covered = F.array_distinct(F.flatten(F.transform(
        F.flatten(F.collect_list("q")), lambda q: F.sequence(q, q + F.col("width") - 1))))
    per_item = good.groupBy("row", "item_row", "item", "length", "width").agg((F.size(covered) / F.first("length")).alias("coverage"), F.max("renamed").alias("renamed"))
    verdicts = per_item.filter(F.col("coverage") >= coverage).groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.max("coverage").alias("coverage"), F.max("renamed").alias("renamed"))
    out = rows.select("row", F.col("id").alias(key)).join(verdicts, "row", "left")
    none = F.array().cast(f"array<{benchmark.schema[item].dataType.simpleString()}>")
    return out.select("row", key, F.coalesce("items", none).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("renamed", F.lit(False)).alias("renamed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The clean rows of ``docs``; rows that share the key of a contaminated one go with it."""
    bad = cut(contaminations(docs, benchmark, text, key, **options).filter(F.size("items") > 0).select(F.col(key).alias("__bad")).distinct())
    bad = F.broadcast(bad) if is_small(bad, BROADCAST_WINDOWS) else bad
    return docs.join(bad, F.col(key).eqNullSafe(F.col("__bad")), "left_anti")
