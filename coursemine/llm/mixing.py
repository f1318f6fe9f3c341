"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source_size times: a whole number of
copies and a fraction.  The fractions are rounded together: two open units exchange
words, in a random direction chosen so that each keeps its expected copies, until one of
them is whole; the other goes on.  Words, not units, are conserved, so a source's total
stays at its target up to its last open unit.  Sources are cut into blocks by hash;
each block leaves at most one open unit, and these meet in a reduction tree.

Defined results: a null text has size 0 and takes no words; a null source is the last
source; rows that agree in key, source and size share one decision; an empty table gives
no rows.  Random numbers depend on seed, source and block only, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from coursemine.llm.common import SPACES, cut, strip_ascii, whole
from coursemine.operators.ranking import is_small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 20
# Units per block, and open units per node of the reduction tree.
BLOCK = 5_000
FAN_IN = 1_000
# Sources up to this many go to every task; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Number of words of a non-null text."""
    bare = strip_ascii(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_no, source_size, units, target for rows of (source, size, n).

    The share of a source is level x weight, or ``most`` times its size where that is
    less; the level rises until the shares make up the whole.  Each round reads one row
    of sums over the sources.
    """
    sums = cut(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units")))
    # Numbering by position in a distributed sort: no task holds all sources.
    ordered = sums.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    numbered = cut(ordered.toDF("source string, source_size long, units long, source_no long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight)
    most_words = F.col("source_size") * most
    level, full = 0.0, -1
    while True:
        at_most = F.col("weight") * F.lit(level) >= most_words
        row = numbered.agg(
            F.sum("source_size").alias("all"), F.sum(at_most.cast("long")).alias("full"),
            F.sum(F.when(at_most, most_words).otherwise(0)).alias("fixed"), F.sum(F.when(at_most, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if row["full"] is None or row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (share * row["all"] - row["fixed"]) / row["open"]
    target = F.least(F.col("weight") * F.lit(level), most_words.cast("double"))
    return numbered.select("source", "source_no", "source_size", "units", target.alias("target"))


def pivot(p: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> None:
    """Round ``p`` in place until at most one entry is open; sum(p * words) stays."""
    chance = rng.random(len(p))
    a = 0
    while a < len(p) and not 0 < p[a] < 1:
        a += 1
    for b in range(a + 1, len(p)):
        if not 0 < p[b] < 1:
            continue
        if not 0 < p[a] < 1:
            a = b
            continue
        up, down = min((1 - p[a]) * words[a], p[b] * words[b]), min(p[a] * words[a], (1 - p[b]) * words[b])
        moved = up if chance[b] * (up + down) < down else -down
        x, y = p[a] + moved / words[a], p[b] - moved / words[b]
        p[a], p[b] = (round(v) if min(v, 1 - v) < 1e-9 else v for v in (x, y))
        if not 0 < p[a] < 1:
            a = b


def _round_block(seed: int, level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: what stays open at the end is then a short one, as a rule.
        rows = rows.assign(words=rows["size"] * rows["n"]).sort_values(["words", "order", "n"], ascending=[False, True, True])
        rows = rows.reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(rows["source_no"].iloc[0]), int(rows["block"].iloc[0])])
        p = rows["p"].to_numpy(np.float64, copy=True)
        pivot(p, np.maximum(rows.pop("words"), 1).to_numpy(np.float64), rng)
        if last:  # the last open unit of the source
            at = (p > 0) & (p < 1)
            p[at] = rng.random(int(at.sum())) < p[at]
        rows["p"] = p
        return rows

    return run


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Inner join on the source, null with null; a few sources go to every task."""
    side = sources.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if is_small(sources, BROADCAST_SOURCES) else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """key, source, size, source_size, target, n (rows that agree in key, source and size), copies."""
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(whole(text)).alias("size"))
    units = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = cut(source_targets(units))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.floor(F.col("units") / block) + 1
    rows = join_sources(units, sources).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = rows.select(
        "source_no", "doc_id", "size", "n", "order", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("p"),
        F.pmod("order", blocks).alias("block"),
    )
    most = sources.agg(F.max(blocks).alias("b")).first()["b"] or 1
    done, level = [], 0
    while True:
        rows = cut(rows.groupBy("source_no", "block").applyInPandas(_round_block(seed, level, most == 1), rows.schema))
        whole_rows = F.col("p").isin(0.0, 1.0)
        done.append(rows.filter(whole_rows))
        if most == 1:
            break
        rows = rows.filter(~whole_rows).withColumn("block", F.floor(F.col("block") / FAN_IN))
        level, most = level + 1, -(-most // FAN_IN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    side = sources.select(F.col("source_no").alias("_no"), "source", "source_size", "target")
    side = F.broadcast(side) if is_small(sources, BROADCAST_SOURCES) else side
    out = out.join(side, F.col("source_no") == F.col("_no"))
    copies = (F.col("base") + F.col("p")).cast("long")
    return out.select(F.col("doc_id").alias(key), "source", "size", "source_size", "target", "n", copies.alias("copies"))


def repeat_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options: int) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with ``copy`` from 1."""
    plan = mix(docs, text, source, key, **options).filter("copies > 0").select(
        F.col(key).alias("__key"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    on = F.col(key).eqNullSafe(F.col("__key")) & F.col(source).eqNullSafe(F.col("__source")) & (n_words(whole(text)) == F.col("__size"))
    taken = docs.join(plan, on)
    return taken.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"))
