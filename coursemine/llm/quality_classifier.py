"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of measures of its text.  It is learned from
preference pairs, a good document over a poor one: the chance that the first is preferred
is the logistic function of the difference of strengths, so the loss is logistic in the
difference of the measures.  A ranking has no natural cut; the cut is put at the quantile
of the strengths that leaves out the share of poor documents among the labels.

Defined results: null and empty texts have measures of zero and a score like any other;
a document labelled more than once is good when most of its labels are; without labels
of both kinds every score is 0.5; repeated rows each have their own result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from coursemine.llm.common import cut

# Good documents that each poor one meets, good documents of a bucket in which they meet, and what the rank of the cut may be off.
OPPONENTS = 10
OF_BUCKET = 256
RANK_ERROR = 1e-4
RIDGE = 1e-3
STEPS = 60
SEED = 4
# Score at the cut: documents at or above it are predicted good.
CUT = 0.3
_COUNTS = [re.compile(p) for p in (r"[#*$%&<>]", r"[|]", r"!", r"[.,;:?]", r"\d", r"https?:|www\.|@")]
N_MEASURES = 15


def measures(text: str | None) -> list[float]:
    """Length, word shape, character classes and repetition of a whole text."""
    t = text or ""
    w = t.encode().split()
    n = len(w)
    if not n:
        return [0.0] * N_MEASURES
    chars = max(len(t), 1)
    upper = sum(map(str.isupper, t))
    lines = [x for x in t.split("\n") if x.strip()]
    low = t.lower().encode().split()
    distinct = len(set(low))
    again = sum(map(bytes.__eq__, low, low[1:]))
    pairs = len(set(zip(low, low[1:])))
    return [
        math.log1p(n), sum(map(len, w)) / n, upper / chars, float(upper > 0.5 * chars),
        *[len(p.findall(t)) / n for p in _COUNTS],
        distinct / math.sqrt(n), again / n, pairs / max(n - 1, 1), 1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)),
    ]


def measure(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([measures(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return run(text)


class Ranking:
    """Strength of a document and its score; a few numbers whatever the corpus."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float) -> None:
        self.middle, self.scale, self.weights, self.cut, self.slope = middle, scale, weights, cut, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient, curvature and number of pairs of the loss: rows of ``d`` are good minus poor measures."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
    return d.T @ (p - 1), (d * (p * (1 - p))[:, None]).T @ d, len(d)


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]], size: int, ridge: float) -> np.ndarray:
    """Weights of least mean logistic loss, from its sums over all pairs."""
    w = np.zeros(size)
    for _ in range(STEPS):
        gradient, curve, n = sums(w)
        step = np.linalg.solve(curve / n + ridge * np.eye(len(w)), gradient / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _standard(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - middle) / scale, -8, 8)


def _pairs(good: np.ndarray, poor: np.ndarray, opponents: int, rng: np.random.Generator) -> np.ndarray:
    """Differences of each poor document to good ones drawn at random."""
    a = rng.integers(len(good), size=(len(poor), opponents))
    return (good[a] - poor[:, None]).reshape(-1, good.shape[1])


def _ranking(middle: np.ndarray, scale: np.ndarray, weights: np.ndarray, lower: float, upper: float, spread: float) -> Ranking:
    return Ranking(middle, scale, weights, (lower + upper) / 2, float(np.clip(1 / (spread + 1e-9), 1e-3, 1e3)) * 2)


def bradley_terry(good: np.ndarray, poor: np.ndarray, share_poor: float) -> Ranking:
    """Fit to measures held in memory; ``share_poor`` is the share of poor documents among all labels."""
    both = np.concatenate([good, poor])
    middle, scale = both.mean(0), both.std(0) + 1e-9
    z = lambda x: _standard(x, middle, scale)
    differences = _pairs(z(good), z(poor), OPPONENTS, np.random.default_rng(SEED))
    weights = _newton(lambda w: _sums(differences, w), both.shape[1], RIDGE)
    s = np.concatenate([z(good) @ weights, z(poor) @ weights])
    mass = np.concatenate([np.full(len(good), (1 - share_poor) / len(good)), np.full(len(poor), share_poor / len(poor))])
    order = np.argsort(s, kind="stable")
    below = np.searchsorted(np.cumsum(mass[order]), share_poor)
    return _ranking(middle, scale, weights, float(s[order[min(below, len(s) - 1)]]), float(s[order[min(below + 1, len(s) - 1)]]), float(s.std()))


def measured(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """_key, good, x of every labelled document; of a document's repeated rows one is measured."""
    votes = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.avg(label) > 0.5).alias("good"))
    rows = docs.join(votes, F.col(key) == F.col("_key")).select("_key", "good", F.col(text).alias("t"))
    return rows.groupBy("_key", "good").agg(F.max("t").alias("t")).select("_key", "good", measure(F.col("t")).alias("x"))


def _paired(rows: DataFrame, n_good: int, n_poor: int, middle: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Differences of all pairs, packed by bucket.

    In each of ``OPPONENTS`` rounds documents are dealt into buckets by a hash, and a poor one meets
    a good one of its bucket.  Buckets hold some ``OF_BUCKET`` good documents or fewer, and a bucket with
    more poor ones is sliced, its good ones going to each slice.
    """
    buckets = max(1, OPPONENTS * n_good // OF_BUCKET)
    slices = max(1, OPPONENTS * n_poor // buckets // (4 * OF_BUCKET))
    dealt = rows.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(OPPONENTS - 1))))
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("bucket"), "_round", "_key"), F.lit(buckets)))
    of = F.when(F.col("good"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(
        F.array(F.pmod(F.xxhash64(F.lit("slice"), "_round", "_key"), F.lit(slices)).cast("int")))
    dealt = dealt.withColumn("_slice", F.explode(of))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_key", "_round"])
        x, good = _standard(np.array(frame["x"].tolist(), float), middle, scale), frame["good"].to_numpy(bool)
        rng = np.random.default_rng([SEED, int(frame["_bucket"].iloc[0]), int(frame["_slice"].iloc[0])])
        # a bucket without good documents, which the bound makes next to impossible, has no pairs
        d = _pairs(x[good], x[~good], 1, rng) if good.any() else np.empty((0, N_MEASURES))
        return pd.DataFrame({"d": [d.astype("<f8").tobytes()]})

    return cut(dealt.groupBy("_bucket", "_slice").applyInPandas(meet, "d binary"))


def _sums_of(pairs: DataFrame) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]]:
    """``_sums`` over all buckets: each task returns one row of its totals."""
    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(N_MEASURES + N_MEASURES**2 + 1)
            for frame in frames:
                for blob in frame["d"]:
                    gradient, curve, n = _sums(np.frombuffer(blob, "<f8").reshape(-1, N_MEASURES), w)
                    total += np.concatenate([gradient, curve.ravel(), [n]])
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        found = {r["i"]: r["v"] for r in pairs.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        total = np.array([found[i] for i in range(len(found))])
        return total[:N_MEASURES], total[N_MEASURES:-1].reshape(N_MEASURES, -1), int(total[-1])

    return sums


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Ranking | None:
    """Ranking from all labelled documents; None without both kinds.

    Moments, pairs, weights and cut come from sums over every one of them; the cut's rank is found to within ``RANK_ERROR``.
    """
    rows = cut(measured(docs, labels, text, key, label))
    of = lambda f: [f(F.col("x")[i]) for i in range(N_MEASURES)]
    sizes = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("poor"), F.array(*of(F.avg)).alias("middle"), F.array(*of(F.stddev_pop)).alias("scale")).first()
    if not sizes["good"] or not sizes["poor"]:
        return None
    middle, scale = np.array(sizes["middle"]), np.array(sizes["scale"]) + 1e-9
    weights = _newton(_sums_of(_paired(rows, sizes["good"], sizes["poor"], middle, scale)), N_MEASURES, RIDGE)

    @F.arrow_udf("double")
    def strength(x: pa.Array) -> pa.Array:
        return pa.array(_standard(np.array(x.to_pylist(), float).reshape(-1, N_MEASURES), middle, scale) @ weights)

    s = cut(rows.select(strength(F.col("x")).alias("s")))
    at = s.approxQuantile("s", [sizes["poor"] / (sizes["good"] + sizes["poor"])], RANK_ERROR)[0]
    found = s.agg(F.max(F.when(F.col("s") <= at, F.col("s"))), F.min(F.when(F.col("s") > at, F.col("s"))), F.stddev_pop("s")).first()
    return _ranking(middle, scale, weights, found[0], found[0] if found[1] is None else found[1], found[2])


def score(docs: DataFrame, ranking: Ranking | None, text: str = "text") -> Column:
    """Score of the text column, 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(ranking)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if held.value is None or not len(texts):
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(held.value.score(np.array([measures(t.as_py()) for t in texts])))

    return run(F.col(text))
