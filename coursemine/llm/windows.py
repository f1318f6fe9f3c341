"""Rolling hashes of token windows and a fixed-size bitmap that tells which windows can match."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from coursemine.llm.common import mixed

# The bitmap has this many bits (2 MB) whatever the number of windows; it only spares
# windows the join that decides, so more windows than bits cost time, not results.
BITS = 24
STEP = 0x9E3779B97F4A7C15
MEMO = 400_000


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive codes, as signed longs."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    total, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        total += codes[j:j + n] * np.uint64(factor)
        factor = factor * STEP % (1 << 64)
    return mixed(total).view(np.int64)


def bitmap(windows: DataFrame, hash_column: str = "hash", bits: int = BITS) -> np.ndarray:
    """Bit ``hash mod 2^bits`` set for every window; built by the executors, at most 2^bits / 64 rows reach the driver."""
    marked = windows.select(F.pmod(F.col(hash_column), F.lit(1 << bits)).alias("bit"))
    marked = marked.selectExpr("shiftright(bit, 6) AS at", "shiftleft(1L, CAST(bit % 64 AS INT)) AS mark")
    rows = marked.groupBy("at").agg(F.bit_or("mark").alias("word")).collect()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if rows:
        out[[r["at"] for r in rows]] = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    return out


def may_match(hashes: np.ndarray, bits_set: np.ndarray) -> np.ndarray:
    """Positions of the windows whose bit is set."""
    bit = hashes.view(np.uint64) & np.uint64(len(bits_set) * 64 - 1)
    return np.flatnonzero((bits_set[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))


class Memo(dict):
    """Values for words, computed once per distinct word; a bounded one starts anew when it has grown too large."""

    def __init__(self, compute, bound: int | None = None) -> None:
        self.compute, self.bound = compute, bound

    def __missing__(self, word: bytes):
        if self.bound and len(self) >= self.bound:
            self.clear()
        value = self[word] = self.compute(word)
        return value


def word_code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)
