"""Hierarchical Pitman-Yor language model: seating by Gibbs, averaged predictive probabilities.

A word is generated in the restaurant of its context; each table there sends one customer
to the parent restaurant, which all contexts share, and that one's tables draw from the
uniform distribution over the known words and one for all unknown.  A context is the
previous word, known by its 64-bit hash, and has a restaurant of its own.  The totals of
the ``COMMON`` most frequent contexts are sent to every task.  Those of all others grow with
the vocabulary and are sent to none: between rounds they are summed by parts of the contexts, and
each shard gets back the totals of the contexts that it holds.

Counts are kept by shards of the words, a shard holding all contexts of its words; a word
with a large share of the corpus is cut into slices of its contexts.  A Gibbs sweep unseats all
customers of a word in a restaurant and seats them again one by one (the late ones of a
large count in blocks), given everybody else's seats.  Seating in turn does not yet follow
the conditional distribution of the whole seating, so it is tried several times and a try
is kept with probability proportional to its weight.  Shards are swept in parallel;
between rounds the totals of the restaurants are summed, as usual for distributed Gibbs.  The last rounds are samples: the seats of a sample are drawn once more,
from the same random numbers, and its probabilities follow from them and from its own
totals, so they sum to one in every context; the probabilities of the samples are averaged.

To score, tokens are sent to the shard that knows their word, packed per block of
documents, and each shard returns packed sums per document and block and not a row per token.
A word that a rare context has never had needs totals that its shard need not hold: such
tokens go on, packed, to the part of their context, which adds their probability.

Defined results: a null or empty text is one end token; a null id counts as the empty
text in the held-out rule; repeated rows each have their own result; without training
tokens all probabilities are one; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from copy import copy
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from coursemine.llm.common import cut, discard, mixed, remainder, shared_folder, short_lived_shuffles, store

# Contexts whose totals every task holds, and how many of them are summed in one group.
COMMON = 1 << 16
RANGE = 1 << 12
# Bytes of text per block of documents, tokens per shard of words, and the least number of shards.
BLOCK_BYTES = 9_000_000
SHARD = 3_000_000
SHARDS = 64
# Tokens per part of the rare contexts, and the least number of parts.
PART = 6_000_000
PARTS = 16
# Words with more than this share of the tokens are cut into slices of contexts and, for scoring, of documents.
HOT_SHARE = 1 / 400
SLICES = 8
STRENGTH = 1.0
# Rounds of sweeps before the first sample, sweeps of a round, samples.
ROUNDS = 1
SWEEPS = 2
SAMPLES = 2
TRIES = 3
ONE_BY_ONE = 64
# Not words, as they hold a space.
END, START = (pd.util.hash_array(np.array([x], object), categorize=False) for x in (" end", " start"))
COUNT_SCHEMA = "shard long, words binary, word binary, context binary, rare binary, n binary"


def pack(a: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers by byte planes, so that high bytes of small numbers cost nothing."""
    a = np.ascontiguousarray(a, kind)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_hashes(a: np.ndarray) -> bytes:
    """Hashes in order, as differences."""
    return pack(np.diff(a.astype(np.uint64), prepend=np.uint64(0)), "<u8")


def unpack_hashes(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "<u8"), dtype=np.uint64)


class Layout:
    """Which shard knows a (word, context), hot words having shards of their own by context, and how contexts are numbered.

    Numbers below ``span`` are those of the common contexts, 0 of the start of a text; ``span`` + i is the i-th of a list
    of rare contexts, which goes with the numbers.
    """

    def __init__(self, shards: int, hot: np.ndarray, common: np.ndarray, parts: int = 1) -> None:
        self.shards, self.hot, self.parts, self.span = shards, np.sort(hot), parts, len(common) + 1
        order = np.argsort(common)
        self.common, self.number = common[order], (order + 1).astype(np.int32)

    def shard(self, words: np.ndarray, contexts: np.ndarray, w: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Shards of words ``w`` in contexts ``k``, which are places in the lists of hashes."""
        of_word = (mixed(words) >> np.uint64(20)).astype(np.int64) % self.shards
        of_context = (mixed(contexts) >> np.uint64(40)).astype(np.int64) % SLICES
        if not len(self.hot):
            return of_word[w]
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        is_hot = self.hot[at] == words
        out = np.where(is_hot, self.shards + at * SLICES, of_word)[w]
        slices = np.flatnonzero(is_hot[w])
        out[slices] += of_context[k[slices]]
        return out

    def part(self, k: np.ndarray) -> np.ndarray:
        """Which part sums the totals of rare contexts."""
        return (mixed(k) >> np.uint64(24)).astype(np.int64) % self.parts

    def contexts(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the words of a block as contexts, those of rare ones by their places; the last is the start of a text."""
        out = np.append(np.arange(len(words)) + self.span, 0)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
            is_common = self.common[at] == words
            out[:-1][is_common] = self.number[at[is_common]]
        return out

    def packed(self, words: np.ndarray, word: np.ndarray, k: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """Distinct words, word of each row, context of each row and distinct rare contexts; the hashes in order."""
        own, local = _numbered(word, len(words))
        is_rare = k >= self.span
        rare, at = _numbered(k[is_rare] - self.span, len(words))
        k = k.copy()
        k[is_rare] = self.span + at
        return pack_hashes(words[own]), pack(local), pack(k), pack_hashes(words[rare])


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, document of each token, hashes of the distinct words in order, word of each token, word before it), by about ``BLOCK_BYTES`` of text."""
    keys, texts, held = [], [], 0
    for frame in frames:
        for key, text in zip(frame["key"], frame["text"]):
            keys.append(key)
            texts.append(text)
            held += len(text or "") + 1
            if held >= BLOCK_BYTES:
                yield _block(keys, texts)
                keys, texts, held = [], [], 0
    if keys:
        yield _block(keys, texts)


def _block(keys: list, texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are cut, lower-cased and numbered in columns; every document has its end as one more token; the word before its first has the number after the last."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(pa.array(texts, pa.large_string()), "")))
    found = lists.flatten()
    real = pc.not_equal(found, "").to_numpy(zero_copy_only=False)  # the empty ones are at the ends of a text
    until = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()]
    coded = found.filter(pa.array(real)).dictionary_encode()
    words = np.concatenate([pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False), END])
    doc = np.repeat(np.arange(len(texts)), np.diff(until))
    word = np.full(len(doc) + len(texts), len(words) - 1)
    word[np.arange(len(doc)) + doc] = coded.indices.to_numpy()
    order = np.argsort(words)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    word = place[word]
    lengths = np.diff(until) + 1
    before = np.concatenate([[0], word[:-1]])
    before[np.cumsum(lengths) - lengths] = len(words)
    return keys, np.repeat(np.arange(len(texts)), lengths), words[order], word, before


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def _by_shard(shard: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 else shard, kind="stable")  # short numbers are sorted by radix
    return np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)


def _numbered(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, all below ``size``, in order, and which each one is."""
    if size > 64 * len(x):
        return np.unique(x, return_inverse=True)
    found = np.zeros(size, bool)
    found[x] = True
    own, place = np.flatnonzero(found), np.empty(size, np.int32)
    place[own] = np.arange(len(own))
    return own, place[x]


def _word_totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, _, words, word, _ in _blocks(frames):
        yield pd.DataFrame({"word": words.view(np.int64), "n": np.bincount(word)})


def _pair_counts(layout: Layout) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, words, word, before in _blocks(frames):
            pairs, n = _counted(word * (len(words) + 1) + before)
            word, before = np.divmod(pairs, len(words) + 1)
            shard, k = layout.shard(words, np.append(words, START), word, before), layout.contexts(words)[before]
            out = [(shard[at[0]], *layout.packed(words, word[at], k[at]), pack(n[at])) for at in _by_shard(shard)]
            yield pd.DataFrame(out, columns=["shard", "words", "word", "context", "rare", "n"])

    return run


def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct hashes of all lists in order, and where those of each list are."""
    found, at = np.unique(np.concatenate(lists), return_inverse=True)
    return found, np.split(at, np.cumsum([len(x) for x in lists[:-1]]))


def _merge(span: int) -> Callable:
    """Counts of a shard from those of the blocks."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words, word_at = _merged([unpack_hashes(x) for x in rows["words"]])
        rare, rare_at = _merged([unpack_hashes(x) for x in rows["rare"]])
        pairs = []
        for r, w, q in zip(rows.itertuples(), word_at, rare_at):
            k = unpack(r.context).astype(np.int64)
            is_rare = k >= span
            k[is_rare] = span + q[k[is_rare] - span]
            pairs.append(w[unpack(r.word)].astype(np.int64) * (span + len(rare)) + k)
        pairs = np.concatenate(pairs)
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        n = np.add.reduceat(np.concatenate([unpack(x) for x in rows["n"]])[order].astype(np.int64), first)
        word, k = pairs[first] // (span + len(rare)), pairs[first] % (span + len(rare))
        return pd.DataFrame([(rows["shard"].iloc[0], pack_hashes(words), pack(word), pack(k), pack_hashes(rare), pack(n))],
                            columns=["shard", "words", "word", "context", "rare", "n"])

    return run


class Totals:
    """What every task knows of the whole model: a few numbers per common context and per hot word."""

    def __init__(self, vocabulary: int, layout: Layout, hot_counts: dict[int, int]) -> None:
        self.vocabulary, self.layout, self.hot_counts = vocabulary, layout, hot_counts
        self.customers = np.zeros(layout.span)   # tokens per context restaurant
        self.tables = np.zeros(layout.span)
        self.root_customers = self.root_tables = 0.0
        self.hot_tables: dict[int, float] = {}
        self.hot_root: dict[int, float] = {}  # tables of hot words in the parent, the mean of their slices
        self.discount = self.root_discount = 0.5

    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)

    def new_table(self, rare: np.ndarray | tuple = ()) -> np.ndarray:
        """Mass of a new table per context, before the parent's probability; ``rare`` are the tables of rare contexts."""
        return STRENGTH + self.discount * np.concatenate([self.tables, rare])

    def root_new(self) -> float:
        return (STRENGTH + self.root_discount * self.root_tables) * self.base()

    def unseen(self) -> float:
        """Parent's probability of an unknown word."""
        return self.root_new() / (STRENGTH + self.root_customers) if self.vocabulary else 1.0

    def parents(self, sent: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Parent's probabilities of words with so many customers and tables there."""
        return (sent - self.root_discount * tables + self.root_new()) / (STRENGTH + max(self.root_customers, 1.0))


def seat(c: np.ndarray, mass: np.ndarray, d: float, rng: np.random.Generator, tries: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Tables after c customers of one dish sat down in turn, and the log weight of the seating; a row per try.

    ``c`` must not grow.  A customer opens a table with weight ``mass`` against i - d t for
    the tables there.  After ``ONE_BY_ONE`` customers they come in blocks, over which the
    odds hardly change.
    """
    t = np.repeat(np.minimum(c, 1).astype(float)[None], tries, 0)
    weight, log_weight = np.ones(t.shape), np.zeros(t.shape)
    i, active = 1, int(np.searchsorted(-c, -1))  # dishes with more than i customers come first
    while active:
        step = 1 if i < ONE_BY_ONE else i // 16
        here, m = t[:, :active], mass[:active]
        if step == 1:
            total = (i + m) - d * here
            weight[:, :active] *= total
            here += rng.random(total.shape) * total < m
        else:
            many = np.minimum(step, c[:active] - i)
            total = i + (many - 1) / 2 + m - d * here
            log_weight[:, :active] += many * np.log(total)
            here += rng.binomial(many, m / total)
        i += step
        active = int(np.searchsorted(-c, -i))
    return t, log_weight + np.log(weight)


class Rare:
    """Rare contexts of a shard: parts that sum their totals, and the totals that came back after each round."""

    def __init__(self, row, layout: Layout, back: pd.DataFrame) -> None:
        self.hashes = unpack_hashes(row.rare)
        part = layout.part(self.hashes)
        self.own = _by_shard(part) if len(part) else []
        self.parts = [int(part[at[0]]) for at in self.own]
        first = back[back["places"].notna()]
        self.places = dict(zip(first["part"], first["places"]))
        self.tables = {number: self._whole(rows, "tables") for number, rows in back.groupby("number")}
        self.customers = self._whole(first, "customers")

    def _whole(self, rows: pd.DataFrame, column: str) -> np.ndarray:
        out, blobs = np.zeros(len(self.hashes)), dict(zip(rows["part"], rows[column]))
        for part, at in zip(self.parts, self.own):
            if part in blobs:
                out[at] = unpack(blobs[part])
        return out


class Seating:
    """Seatings of the words of one shard."""

    def __init__(self, row, totals: Totals, seed: int, rare: Rare) -> None:
        self.words, self.word, self.k, self.c = unpack_hashes(row.words), unpack(row.word).astype(np.int64), unpack(row.context).astype(np.int64), unpack(row.n).astype(np.int64)
        self.totals, self.rng = totals, np.random.default_rng([seed, int(row.shard)])
        self.new = totals.new_table(rare.tables.get(seed - 1, np.zeros(len(rare.hashes))))
        self.is_hot = row.shard >= totals.layout.shards
        self.t = np.minimum(self.c, 1).astype(float)
        several = np.flatnonzero(self.c > 1)  # a single customer has a single table
        self.several = several[np.argsort(-self.c[several], kind="stable")]
        self._root()

    def _reseat(self, c: np.ndarray, mass: np.ndarray, d: float) -> np.ndarray:
        """Tables of one of several tries, drawn by weight."""
        t, weights = seat(c, mass, d, self.rng, TRIES)
        share = np.cumsum(np.exp(weights - weights.max(0)), 0) if len(c) else weights
        pick = (self.rng.random(len(c)) * share[-1] > share).sum(0)
        return t[np.minimum(pick, TRIES - 1), np.arange(len(c))]

    def _root(self) -> None:
        """Parent's seating and probabilities for the present tables of the contexts."""
        g = self.totals
        self.sent = np.bincount(self.word, self.t, len(self.words))
        if self.is_hot:  # the word's other slices send their customers from other shards
            self.sent = np.maximum(self.sent, g.hot_tables.get(int(self.words[0]), 0.0))
        order = np.argsort(-self.sent, kind="stable")
        self.root_t = np.empty(len(order))
        self.root_t[order] = self._reseat(self.sent[order].astype(np.int64), np.full(len(order), g.root_new()), g.root_discount)
        self.parent = g.parents(self.sent, self.root_t)

    def sweep(self) -> None:
        g = self.totals
        at = self.several
        self.t[at] = self._reseat(self.c[at], self.new[self.k[at]] * self.parent[self.word[at]], g.discount)
        self._root()

    def predictive(self, after: Totals, tables: np.ndarray, customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the words in their contexts and in the parent, given these seats and their totals over all shards, also those of the rare contexts."""
        sent, root_t = np.bincount(self.word, self.t, len(self.words)), self.root_t
        if self.is_hot:
            w = int(self.words[0])
            sent, root_t = np.array([after.hot_tables[w]]), np.array([after.hot_root[w]])
        parent = after.parents(sent, root_t)
        old = self.c - after.discount * self.t
        return (old + after.new_table(tables)[self.k] * parent[self.word]) / (STRENGTH + np.concatenate([after.customers, customers])[self.k]), parent


# Sums of a round have a kind; other rows are totals of contexts, those of common ones in negative parts.
# The first round names contexts by hashes and is told their places in the list of their part, which name them in the others.
BACK_SCHEMA = "number long, part long, shard long, contexts binary, places binary, tables binary, customers binary"
ROUND_SCHEMA = f"kind string, key long, value double, {BACK_SCHEMA}"
BACK, ROUND = ([x.split()[0] for x in schema.split(", ")] for schema in (BACK_SCHEMA, ROUND_SCHEMA))


def _sums(kind: str, keys, values) -> pd.DataFrame:
    rows = pd.DataFrame({"kind": kind, "key": np.asarray(keys, np.int64), "value": np.asarray(values, float)})
    return rows.assign(number=0, part=0, shard=0, contexts=None, places=None, tables=None, customers=None)


def _round(totals: Totals, number: int) -> Callable:
    """Sums and totals of contexts of a round for one shard; round 0 only counts."""
    def run(counts: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(counts):
            return pd.DataFrame(columns=ROUND)
        row = next(counts.itertuples())
        rare = Rare(row, totals.layout, back)
        s = Seating(row, totals, number, rare)
        for _ in range(SWEEPS if number else 0):
            s.sweep()
        out, span = [], totals.layout.span
        if number == 0:
            few = np.bincount(s.word, minlength=len(s.words))
            out.append(_sums("few", [1, 2, 3, 4], [(s.c == 1).sum(), (s.c == 2).sum(), (few == 1).sum(), (few == 2).sum()]))
        own = np.bincount(s.word, s.t, len(s.words))
        if s.is_hot:
            out.append(_sums("hot", s.words.view(np.int64), own))
            out.append(_sums("hot root", s.words.view(np.int64), s.root_t / SLICES))
            out.append(_sums("root", [0, 1], [own.sum(), s.root_t.sum() / SLICES]))
        else:
            out.append(_sums("root", [0, 1], [own.sum(), s.root_t.sum()]))
        size = span + len(rare.hashes)
        tables, customers = np.bincount(s.k, s.t, size), np.bincount(s.k, s.c, size) if number == 0 else None
        pick = lambda at: (pack(tables[at]), None if customers is None else pack(customers[at]))
        totals_of = [(number, -1 - a // RANGE, row.shard, None, None, *pick(slice(a, min(a + RANGE, span)))) for a in range(0, span, RANGE)]
        name = lambda part, at: (None, rare.places[part]) if number else (pack_hashes(rare.hashes[at]), None)
        totals_of += [(number, part, row.shard, *name(part, at), *pick(span + at)) for part, at in zip(rare.parts, rare.own)]
        return pd.concat([*out, pd.DataFrame(totals_of, columns=BACK).assign(kind=None, key=0, value=0.0)])[ROUND]

    return run


def _first_round(held) -> Callable:
    def run(counts: pd.DataFrame) -> pd.DataFrame:
        return _round(held.value, 0)(counts, pd.DataFrame(columns=BACK))

    return run


def _sum_part(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of the contexts of a part, in a row of shard -1, and for each shard those of its rare contexts."""
    number, part = rows["number"].iloc[0], rows["part"].iloc[0]
    columns = ["tables", "customers"] if number == 0 else ["tables"]
    blobs = lambda sums, to: ([None if x is None else pack(x[to]) for x in sums] + [None])[:2]
    if part < 0:
        sums = [sum(unpack(x).astype(np.int64) for x in rows[c]) for c in columns]
        return pd.DataFrame([(number, part, -1, None, None, *blobs(sums, slice(None)))], columns=BACK)
    if number == 0:
        contexts, at = _merged([unpack_hashes(x) for x in rows["contexts"]])
        contexts, places = pack_hashes(contexts), [pack(np.diff(x, prepend=0)) for x in at]
    else:
        contexts, places, at = None, [None] * len(rows), [np.cumsum(unpack(x), dtype=np.int64) for x in rows["places"]]
    everywhere = np.concatenate(at)
    sums = [np.bincount(everywhere, np.concatenate([unpack(x) for x in rows[c]])) for c in columns]
    out = [(number, part, shard, None, place, *blobs(sums, to)) for shard, place, to in zip(rows["shard"], places, at)]
    return pd.DataFrame([(number, part, -1, contexts, None, *blobs(sums, slice(None))), *out], columns=BACK)


def _taken_in(before: Totals, rows: list, common: list) -> Totals:
    totals, few = copy(before), {}
    totals.hot_tables, totals.hot_root = {}, {}
    common = sorted(common, key=lambda r: -r["part"])
    for name in ("tables", "customers"):
        if common and common[0][name] is not None:
            setattr(totals, name, np.concatenate([unpack(bytes(r[name])) for r in common]).astype(float))
    for r in rows:
        kind, key, value = r["kind"], r["key"], r["value"]
        if kind in ("hot", "hot root"):
            (totals.hot_tables if kind == "hot" else totals.hot_root)[int(np.int64(key).view(np.uint64))] = value
        elif kind == "root":
            setattr(totals, ("root_customers", "root_tables")[key], value)
        else:
            few[key] = value
    if few:
        share = lambda a, b: float(np.clip((a + 0.5) / (a + 2 * b + 1), 0.1, 0.95))
        totals.discount, totals.root_discount = share(few[1], few[2]), share(few[3], few[4])
    return totals


def _predict(states: list[Totals]) -> Callable:
    """Per shard: words with count and the parent's probability in each sample, pairs with mean log10 probability.

    ``states`` are the totals after each round.
    """
    def run(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=MODEL)
        row = next(rows.itertuples())
        rare = Rare(row, states[-1].layout, back)
        p, parents = 0.0, []
        for number in range(len(states) - SAMPLES, len(states)):
            s = Seating(row, states[number - 1], number, rare)
            for _ in range(SWEEPS):
                s.sweep()
            own, parent = s.predictive(states[number], rare.tables.get(number, ()), rare.customers)
            p = p + own / SAMPLES
            parents.append(parent)
        counts = np.bincount(s.word, s.c, len(s.words)).astype(np.int64)
        if s.is_hot:
            counts[:] = states[-1].hot_counts[int(s.words[0])]
        return pd.DataFrame([(row.shard, pack(s.words, "<u8"), pack(counts, "<u8"), pack(np.concatenate(parents), "<f4"), row.word, row.context, row.rare, pack(np.log10(p).astype("<f4"), "<f4"))],
                            columns=MODEL)

    return run


def back_off(samples: list[Totals], k: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Mean probability of words that their common contexts ``k`` have never had, from the parent's probability in each sample (rows)."""
    return sum(g.new_table()[k] * p for g, p in zip(samples, parents)) / SAMPLES / (STRENGTH + samples[0].customers[k])


MODEL_SCHEMA = "shard long, words binary, counts binary, parents binary, word binary, context binary, rare binary, logs binary"
MODEL = [x.split()[0] for x in MODEL_SCHEMA.split(", ")]


class Model:
    """Fitted model: the samples' totals on the driver (fixed size), one row per shard and the totals of rare contexts by part in Spark."""

    def __init__(self, samples: list[Totals], train_tokens: int, shards: DataFrame, contexts: DataFrame) -> None:
        self.samples, self.totals, self.train_tokens, self.shards, self.contexts = samples, samples[-1], train_tokens, shards, contexts


def train(docs: DataFrame, text: str = "text") -> Model:
    """Fit to all rows of ``docs``."""
    with short_lived_shuffles(docs.sparkSession):
        return _train(docs, text)


def _train(docs: DataFrame, text: str) -> Model:
    spark, rows = docs.sparkSession, docs.select(F.lit(0).alias("key"), F.col(text).alias("text"))
    words = rows.mapInPandas(_word_totals, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = store(words)
    n, v = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n = n or 0
    # At most 1 / HOT_SHARE words can have such a share.
    hot = {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in words.filter(F.col("n") > max(n * HOT_SHARE, SHARD / 30)).collect()}
    # The most frequent words, as whole steps of the counts, so that no more than ``COMMON`` of them come to the driver.
    step, can_precede = F.floor(F.log2("n") * 16), words.filter(F.col("word") != int(END.view(np.int64)[0]))
    least, room = None, COMMON - 1
    for r in sorted(can_precede.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    common = [] if least is None else sorted(can_precede.filter(step >= least).collect(), key=lambda r: (-r["n"], r["word"]))
    common = np.array([r["word"] for r in common], np.int64).view(np.uint64)
    discard(words)
    layout = Layout(max(n // SHARD, SHARDS), np.array(sorted(hot), np.uint64), common, max(n // PART, PARTS))
    totals = Totals(v, layout, hot)
    counts = rows.mapInPandas(_pair_counts(layout), COUNT_SCHEMA).groupBy("shard").applyInPandas(_merge(layout.span), COUNT_SCHEMA)
    counts, name = _bucketed(counts, max(layout.shards // 2, 1))
    states, backs = [], []
    for number in range(ROUNDS + SAMPLES + 1):
        held = spark.sparkContext.broadcast(totals)
        if number:
            out = _with_totals(counts, backs[0] if number == 1 else backs[0].unionAll(backs[-1]), _late(_round, held, number), ROUND_SCHEMA)
        else:
            out = counts.groupBy("shard").applyInPandas(_first_round(held), ROUND_SCHEMA)
        out = store(out)
        sums = out.filter(F.col("kind").isNotNull()).groupBy("kind", "key").agg(F.sum("value").alias("value")).collect()
        back = cut(out.filter(F.col("kind").isNull()).select(*BACK).groupBy("part").applyInPandas(_sum_part, BACK_SCHEMA))
        discard(out)
        totals = _taken_in(totals, sums, back.filter(F.col("part") < 0).collect())
        states.append(totals)
        backs.append(back.filter(F.col("part") >= 0))
        held.unpersist()
    held = spark.sparkContext.broadcast(states)
    back = reduce(DataFrame.unionAll, backs)
    shards = cut(_with_totals(counts, back, _late(_predict, held), MODEL_SCHEMA))
    discard(counts)
    spark.sql(f"DROP TABLE {name}")
    return Model(states[-SAMPLES:], n, shards, back.filter((F.col("shard") == -1) & ((F.col("number") == 0) | (F.col("number") > ROUNDS))))


def _bucketed(counts: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Counts as a table in buckets of shards, so that no round shuffles them; and its name."""
    name = f"counts_{uuid.uuid4().hex}"
    counts.write.bucketBy(n, "shard").option("path", f"{shared_folder(counts.sparkSession)}/{name}").saveAsTable(name)
    return counts.sparkSession.table(name), name


def _with_totals(counts: DataFrame, back: DataFrame, make: Callable, schema: str) -> DataFrame:
    """A function of the counts of each shard and the totals of its rare contexts."""
    return counts.groupBy("shard").cogroup(back.filter(F.col("shard") >= 0).groupBy("shard")).applyInPandas(make, schema)


def _late(make: Callable, held, *more) -> Callable:
    """The same function, with its totals read from the broadcast where it runs."""
    return lambda rows, others: make(held.value, *more)(rows, others)


def _route(layout: Layout) -> Callable:
    """Tokens of a block to the shards of their words, and the block's ids to a directory row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for keys, doc, words, word, before in _blocks(frames):
            block = (part << 24) + number
            number += 1
            pair, pairs = word * (len(words) + 1) + before, None
            if len(keys) * len(words) * (len(words) + 1) >= 1 << 62:  # pairs are numbered anew where a triple would not fit
                pairs, pair = np.unique(pair, return_inverse=True)
            triples, n = _counted(pair * len(keys) + doc)
            pair, doc = np.divmod(triples, len(keys))
            word, before = np.divmod(pair if pairs is None else pairs[pair], len(words) + 1)
            k = layout.contexts(words)[before]
            shard = layout.shard(words, np.append(words, START), word, before)
            out = [(-1 - block % 4096, 0, block, keys, None, None, None, None, None, None)]
            for at in _by_shard(shard):
                s = shard[at[0]]
                salt = block % SLICES if s >= layout.shards else 0
                out.append((s, salt, block, None, *layout.packed(words, word[at], k[at]), pack(doc[at]), pack(n[at])))
            yield pd.DataFrame(out, columns=["shard", "salt", "block", "ids", "words", "word", "context", "rare", "doc", "n"])

    return run


# Rows of a block: its ids, or packed sums of its documents.  Rows of a part: tokens of rare contexts, with the parent's probabilities.
PIECE_SCHEMA = "block long, ids array<string>, doc binary, n_tokens binary, n_known binary, base binary, score binary, part long, contexts binary, blocks binary, parents binary"
PIECE = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]


def _score_shard(held) -> Callable:
    def run(tokens: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        samples, out, late = held.value, [], []
        layout = samples[0].layout
        words, rare = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(model) and len(tokens):
            m = model.iloc[0]
            words, counts, parents = unpack(m["words"], "<u8"), unpack(m["counts"], "<u8").astype(np.int64), unpack(m["parents"], "<f4").astype(float).reshape(SAMPLES, -1)
            rare, logs = unpack_hashes(m["rare"]), unpack(m["logs"], "<f4")
            size = layout.span + len(rare) + 1  # the last number is of contexts that the shard does not know
            pairs = unpack(m["word"]).astype(np.int64) * size + unpack(m["context"])
        unseen = np.array([[g.unseen()] for g in samples])
        for r in tokens.itertuples():
            if r.ids is not None:
                out.append({"block": r.block, "part": -1, "ids": r.ids})
                continue
            w, word, k, n = unpack_hashes(r.words), unpack(r.word), unpack(r.context).astype(np.int64), unpack(r.n).astype(np.int64)
            asked, own = unpack_hashes(r.rare), k
            c, parent, log_p = np.zeros(len(w), np.int64), np.repeat(unseen, len(w), 1), np.full(len(k), np.nan)
            if len(words):
                at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                known = words[at] == w
                c, parent = np.where(known, counts[at], 0), np.where(known, parents[:, at], unseen)
                if len(asked):
                    place = np.minimum(np.searchsorted(rare, asked), max(len(rare) - 1, 0))
                    place = np.where(rare[place] == asked, place, len(rare)) if len(rare) else np.zeros(len(asked), np.int64)
                    own = np.concatenate([np.arange(layout.span), layout.span + place])[k]
                pair = np.where(known, at, -1)[word] * size + own  # below all pairs where the word is unknown
                where = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                log_p = np.where(pairs[where] == pair, logs[where], np.nan)
            of_count, c, new = np.log10(c + 1.0)[word], c[word], np.isnan(log_p)
            log_p[new] = 0.0
            doc = unpack(r.doc).astype(np.int64)
            if samples[0].vocabulary:
                near, far = np.flatnonzero(new & (k < layout.span)), np.flatnonzero(new & (k >= layout.span))
                log_p[near] = np.log10(back_off(samples, k[near], parent[:, word[near]]))
                late.append((asked[k[far] - layout.span], np.full(len(far), r.block), doc[far], n[far], parent[:, word[far]]))
            docs = np.flatnonzero(np.bincount(doc))
            total = lambda x: np.bincount(doc, x)[docs]
            out.append({"block": r.block, "part": -1, "doc": pack(np.diff(docs, prepend=0)), "n_tokens": pack(total(n)), "n_known": pack(total(n * (c > 0))),
                        "base": pack(total(n * of_count), "<f8"), "score": pack(total(n * log_p), "<f8")})
        contexts, blocks, doc, n, parent = (np.concatenate(x, -1) for x in zip(*late)) if late else (np.zeros(0, np.uint64),) * 5
        for at in _by_shard(layout.part(contexts)) if len(contexts) else []:
            out.append({"block": -1, "part": layout.part(contexts[at[:1]])[0], "contexts": pack(contexts[at], "<u8"), "blocks": pack(blocks[at], "<u8"), "doc": pack(doc[at]),
                        "n_tokens": pack(n[at]), "parents": pack(parent[:, at].ravel(), "<f4")})
        return pd.DataFrame([[x.get(c) for c in PIECE] for x in out], columns=PIECE)

    return run


def _score_part(held) -> Callable:
    """Sums of the tokens that rare contexts have never had before, by block."""
    def run(tokens: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        samples, out = held.value, []
        if not len(tokens):
            return pd.DataFrame(columns=PIECE[:7])
        known = {r.number: r for r in totals.itertuples()}
        hashes = unpack_hashes(known[0].contexts) if known else np.zeros(0, np.uint64)
        # a context without training has no customers and no tables
        of = lambda number, column: np.append(unpack(getattr(known[number], column)), 0.0) if known else np.zeros(1)
        asked, blocks, doc, n = (np.concatenate([unpack(x, kind) for x in tokens[c]]) for c, kind in (("contexts", "<u8"), ("blocks", "<u8"), ("doc", "<u4"), ("n_tokens", "<u4")))
        parents = np.concatenate([unpack(x, "<f4").reshape(SAMPLES, -1) for x in tokens["parents"]], 1).astype(float)
        at = np.minimum(np.searchsorted(hashes, asked), max(len(hashes) - 1, 0))
        at = np.where(hashes[at] == asked, at, len(hashes)) if len(hashes) else np.zeros(len(asked), np.int64)
        numbers = range(ROUNDS + 1, ROUNDS + SAMPLES + 1)
        new = [(STRENGTH + g.discount * of(i, "tables"))[at] for g, i in zip(samples, numbers)]
        log_p = n * np.log10(sum(x * p for x, p in zip(new, parents)) / SAMPLES / (STRENGTH + of(0, "customers")[at]))
        for rows in _by_shard(blocks.astype(np.int64)):
            docs, to = np.unique(doc[rows], return_inverse=True)
            none = pack(np.zeros(len(docs)))
            out.append((int(blocks[rows[0]]), None, pack(np.diff(docs.astype(np.int64), prepend=0)), none, none,
                        pack(np.zeros(len(docs)), "<f8"), pack(np.bincount(to, log_p[rows]), "<f8")))
        return pd.DataFrame(out, columns=PIECE[:7])

    return run


def _sum_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of the documents of a block over all shards and parts."""
    ids = next(x for x in rows["ids"] if x is not None)
    out = {"key": list(ids)}
    rows = rows[rows["doc"].notna()]
    doc = np.concatenate([np.cumsum(unpack(x).astype(np.int64)) for x in rows["doc"]])
    for name, kind in (("n_tokens", "<u4"), ("n_known", "<u4"), ("base", "<f8"), ("score", "<f8")):
        sums = np.bincount(doc, np.concatenate([unpack(x, kind) for x in rows[name]]), len(ids))
        out[name] = sums.astype(np.int64) if kind == "<u4" else sums
    return pd.DataFrame(out)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score, score, perplexity of every row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    tokens = rows.mapInPandas(
        _route(model.totals.layout),
        "shard long, salt int, block long, ids array<string>, words binary, word binary, context binary, rare binary, doc binary, n binary")
    hot = F.col("shard") >= model.totals.layout.shards
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
    sides = model.shards.withColumn("salt", F.explode(copies))
    held = spark.sparkContext.broadcast(model.samples)
    with short_lived_shuffles(spark):
        pieces = cut(tokens.groupBy("shard", "salt").cogroup(sides.groupBy("shard", "salt")).applyInPandas(_score_shard(held), PIECE_SCHEMA))
    late = pieces.filter(F.col("part") >= 0).groupBy("part").cogroup(model.contexts.groupBy("part")).applyInPandas(
        _score_part(held), ", ".join(PIECE_SCHEMA.split(", ")[:7]))
    sums = pieces.filter(F.col("part") < 0).select(*PIECE[:7]).unionAll(late).groupBy("block").applyInPandas(
        _sum_block, "key string, n_tokens long, n_known long, base double, score double")
    smooth = float(np.log10(model.train_tokens + model.totals.vocabulary + 1))
    return sums.select(
        F.col("key").cast(kind).alias(key), "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * F.lit(smooth)).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def held_out(key: str = "doc_id"):
    return remainder(7, key) == 2
