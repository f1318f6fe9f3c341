"""Grouping of spelling variants with FM-indexes searched from both ends.

Two words are near when one inserted, deleted or replaced code point makes them equal.
Of such a pair, the first or the last half (of the shorter word's length) is the same in
both, so words meet by length class and half: a search scheme matches the half exactly and
extends across the rest with one error.  The search with the last half goes leftwards over
the FM-index of the delimited words, the one with the first half rightwards, over the index
of the reversed text; each begins at an end of the pattern, so an interval of suffix ranks
in its own direction is all it carries.  Steps are taken for all open intervals at once.

Spark deals the halves out to tasks: a task indexes its words and asks for the same words.
The words of one half are cut into parts of a bounded index where they are many, and each
of these words asks all parts.  A pair is counted once: in the class of the shorter
length, and from the end unless the first halves agree.  Only counts and the best partner leave a
task, no pairs.

Defined results: null and empty texts have no words, a null id counts as an empty one,
repeated rows count repeatedly, a text without delimiters is one run whatever its length;
an empty table gives no rows, other columns are ignored.  Of equally frequent partners the
smallest in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from coursemine.llm.common import cut

SHORTEST = 7
LEAST = 2
RATIO = 10
# Of the occurrences, those whose checksum this number divides lose a code point.
DAMAGED = 31
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# Distinct words that a task counts before it passes them on.
HELD = 200_000
# Words of one half in one index, and rows of a task of many halves.
PART = 50_000
TASK_ROWS = 100_000


def occurrences(doc_id, text: str | None, shortest: int = SHORTEST, damaged: int = DAMAGED) -> Iterator[str]:
    """Words of a text: its runs of letters in lower case, some with a code point less."""
    name = "" if doc_id is None else str(doc_id)
    for m in RUNS.finditer(text or ""):
        if m.end() - m.start() < shortest:
            continue
        run = m[0].lower() if m[0].isascii() else m[0].translate(LOWER)
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % damaged == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < shortest:
                continue
        yield run


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: the distinct words with at least ``least`` occurrences; tasks add up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1)):
                counts.update(occurrences(doc_id, x.as_py(), shortest))
                if len(counts) >= HELD:
                    yield told()
                    counts.clear()
        yield told()

    counted = docs.select(F.col(key).cast("string"), text).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class FmIndex:
    """Suffix ranks of distinct words, each between delimiters, with backward search steps for many intervals at once.

    Symbols are dense codes, 0 the delimiter.  ``keys`` holds (symbol, place) of the
    transformed text in order, so one binary search gives a symbol's rank before a place.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        """``words``: matrix of code points, one padded row a word."""
        self.letters = np.unique(words[np.arange(words.shape[1]) < lengths[:, None]])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(starts[-1] + 1, np.int64)
        inside = np.arange(words.shape[1]) < lengths[:, None]
        places = (starts[:-1, None] + 1 + np.arange(words.shape[1]))[inside]
        text[places] = np.searchsorted(self.letters, words[inside]) + 1
        self.n, self.words = len(text), len(words)
        order = self._sorted_suffixes(text)
        self.before = text[order - 1]
        self.keys = np.sort(self.before * (self.n + 1) + np.arange(self.n))
        # the ranks of suffixes that begin with a word's own delimiter, and which word that is
        at = order[: self.words + 1]
        self.word_at = np.searchsorted(starts[:-1], at)

    @staticmethod
    def _sorted_suffixes(text: np.ndarray) -> np.ndarray:
        """Order of the cyclic suffixes by doubling; distinct words between delimiters make it strict soon."""
        rank, step = text, 1
        while True:
            key = rank * (len(text) + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            new = np.empty(len(text), np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if new[order[-1]] == len(text) - 1 or step >= len(text):
                return order
            rank, step = new, 2 * step

    def codes(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Dense codes of the same shape; a code point that the index lacks becomes one that matches nothing."""
        at = np.searchsorted(self.letters, words)
        known = (at < len(self.letters)) & (self.letters[np.minimum(at, len(self.letters) - 1)] == words)
        return np.where(np.arange(words.shape[1]) < lengths[:, None], np.where(known, at + 1, len(self.letters) + 1), 0)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with ``symbol`` and go on as those in [low, high)."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) for every letter before a suffix of an interval: read off narrow ones, tried for wide ones."""
        size, sigma = high - low, len(self.letters)
        wide = np.flatnonzero(size > sigma)
        narrow = np.flatnonzero((size <= sigma) & (size > 0))
        owner = np.repeat(narrow, size[narrow])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow])
        seen = np.unique(owner * (sigma + 1) + self.before[low[owner] + offset])
        owner, letter = np.divmod(seen, sigma + 1)
        return (np.concatenate([owner[letter > 0], np.repeat(wide, sigma)]),
                np.concatenate([letter[letter > 0], np.tile(np.arange(1, sigma + 1), len(wide))]))


def _one_error(index: FmIndex, words: np.ndarray, lengths: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, word of the index) for the words of length ``short`` or one more, whose last short // 2 code points are
    the same and that become equal by one error in the rest; read from the last code point to the first."""
    codes = index.codes(words, lengths)
    half = short // 2
    rows = np.arange(len(words))
    low, high = index.step(np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), index.n))
    todo = lengths.copy()  # code points still to match, from the right
    for _ in range(half):
        todo -= 1
        low, high = index.step(codes[rows, todo], low, high)
    # rows with an error behind them: row, code points to match, interval
    after: list[tuple[np.ndarray, ...]] = []
    while len(rows):
        alive = low < high
        rows, todo, low, high = rows[alive], todo[alive], low[alive], high[alive]
        if not len(rows):
            break
        owner, letter = index.branches(low, high)
        more = todo[owner] > 0
        here = codes[rows[owner], np.maximum(todo[owner] - 1, 0)]
        lo, hi = index.step(letter, low[owner], high[owner])
        shorter = lengths[rows[owner]] == short
        swap = shorter & more & (letter != here)
        after.append((rows[owner][swap], todo[owner][swap] - 1, lo[swap], hi[swap]))
        after.append((rows[owner][shorter], todo[owner][shorter], lo[shorter], hi[shorter]))
        skip = (lengths[rows] > short) & (todo > 0)
        after.append((rows[skip], todo[skip] - 1, low[skip], high[skip]))
        on = todo > 0
        rows, todo, low, high = rows[on], todo[on] - 1, low[on], high[on]
        low, high = index.step(codes[rows, todo], low, high)
    if not after:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, todo, low, high = (np.concatenate(x) for x in zip(*after))
    found_rows, found = [], []
    while len(rows):
        alive = low < high
        rows, todo, low, high = rows[alive], todo[alive], low[alive], high[alive]
        done = todo == 0
        lo, hi = index.step(np.zeros(done.sum(), np.int64), low[done], high[done])
        hit = lo < hi  # distinct words: one suffix begins with the word and its delimiters
        found_rows.append(rows[done][hit])
        found.append(index.word_at[lo[hit]])
        rows, todo, low, high = rows[~done], todo[~done] - 1, low[~done], high[~done]
        low, high = index.step(codes[rows, todo], low, high)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(found_rows) * len(index.word_at) + np.concatenate(found))
    return np.divmod(pairs, len(index.word_at))


def _matrix(words: list[str], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max())
    flat = "".join((w[::-1] if backwards else w).ljust(width, "\0") for w in words)
    return np.frombuffer(flat.encode("utf-32-le"), "<u4").reshape(len(words), width).astype(np.int64), lengths


def _search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Near words of the words that ask, among the indexed ones of the task; all of one side and length class."""
    _, first, short = key[:3]
    rows = rows.sort_values("word")
    words, n, asks, held = rows["word"].tolist(), rows["n"].to_numpy(), rows["asks"].to_numpy(bool), rows["held"].to_numpy(bool)
    told = lambda word, near, less, other: pd.DataFrame({
        "word": pd.Series(word, dtype=object), "near": near, "less": less, "other": pd.Series(other, dtype=object)})
    empty = told([], np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    if not asks.any() or not held.any():
        return empty
    points, lengths = _matrix(words, backwards=first)
    index = FmIndex(points[held], lengths[held])
    asking, held = np.flatnonzero(asks), np.flatnonzero(held)
    row, other = _one_error(index, points[asking], lengths[asking], short)
    row, other = asking[row], held[other]
    if not first:  # pairs whose first halves agree are those of the other side
        fresh = np.array([words[a][:short // 2] != words[b][:short // 2] for a, b in zip(row, other)], bool)
        row, other = row[fresh], other[fresh]
    if not len(row):
        return empty
    order = np.lexsort((other, -n[other], row))  # rows are in the order of their words
    row, other = row[order], other[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = other[starts]
    return told([words[i] for i in row[starts]], np.diff(starts, append=len(row)), -n[best], [words[i] for i in best])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, form_n, best: how many near words a word has, and the most frequent of them; words without any are left out."""
    length = F.length("word")
    classes = F.array(length.cast("long"), (length - 1).cast("long"))
    rows = vocabulary.select("word", "n", F.explode(classes).alias("short")).filter(F.col("short") >= SHORTEST)
    rows = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    half = (F.col("short") / 2).cast("int")
    part = F.when(F.col("first"), F.substring("word", F.lit(1), half)).otherwise(F.right("word", half))
    rows = rows.withColumn("shard", F.xxhash64("first", "short", part))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    total = vocabulary.count()
    rows = rows.join(sizes, "shard").withColumn("parts", F.ceil(F.col("size") / PART))
    rows = rows.select(
        "word", "n", "first", "short", "shard", F.pmod(F.xxhash64("word"), F.col("parts")).alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
    )
    task = F.pmod(F.xxhash64("shard", "part"), F.lit(4 * total // TASK_ROWS + 1))
    dealt = rows.select(
        task.alias("task"), "first", "short", "part", "word", "n", F.lit(True).alias("asks"), (F.col("own") == F.col("part")).alias("held"))
    found = dealt.groupBy("task", "first", "short", "part").applyInPandas(_search, "word string, near long, less long, other string")
    least = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
    return least.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.other").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of every chain of forms, by doubling; counts grow tenfold a step, so few rounds do."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = cut(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if not longer.filter("_moved").take(1):
            return links
        links = longer.select("word", "root")


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents.

    The form is the most frequent near word where it is ``ratio`` times as frequent as the
    word itself; the root is the last of the forms that follow.
    """
    known = cut(vocabulary(docs, text, key))
    near = known.join(near_words(known), "word", "left")
    frequent = F.col("form_n") >= ratio * F.col("n")
    rows = cut(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n")))
    roots = _roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
