"""Language identification by compression.

Per language, the words found in most of a sample of whole labelled texts form a
raw-content zstandard dictionary.  A text is compressed with each of them; the language of
the smallest result is the prediction, and it is rejected when the next one is hardly
larger.  What is compressed are the distinct words of the whole text in lower case:
repetition within the text, which any dictionary would serve equally well, then says
nothing, and symbols do not count.

A larger dictionary shortens any text, so languages are compared on dictionaries of equal
size only.  Every dictionary is cut to a power of two of bytes; the winner among the
largest is cut to the next smaller size and compared there with the languages that have
no more, and so on.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go
to the language with the larger dictionary, then with more labelled documents; a language
whose sampled texts hold fewer than ``SMALLEST`` bytes of words is not learned; an empty
training table makes everything ``und``; repeated rows each have their own result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from coursemine.llm.common import group_sizes, hash_sample
from coursemine.operators.ranking import top_per_key

# Bounds of the fit: documents per language, bytes per dictionary, bytes of all dictionaries
# together.  With so many languages that these are exceeded all dictionaries are shorter.
PER_LANGUAGE = 200
DICTIONARY_BYTES = 65_536
TOTAL_BYTES = 1 << 24
SMALLEST = 16
LEVEL = 6
# A prediction is rejected when the next language needs less than this share more bytes.
MARGIN = 0.01
# Extra bytes of the next language, as a share, that give a score of one half.
HALF_SCORE = 0.03
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
SCHEMA = "struct<lang: string, score: double, accepted: boolean>"


def distinct_words(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    return list(dict.fromkeys(found)) if any(c.isalpha() for w in found for c in w) else []


def word_sets(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([distinct_words(t.as_py() or "") for t in texts], pa.list_(pa.string()))

    return run(text)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, bytes]]:
    """(language, dictionary), largest first, then by labelled documents.

    The sample is bounded: ``PER_LANGUAGE`` whole documents a language in hash order.  Its
    words are counted by Spark; of those in most documents (ties: code-point order) as many
    as fit go to the driver, ``TOTAL_BYTES`` in all.  The most frequent stand last, where
    references to them are shortest.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("t")).dropna(subset=["lang", "t"])
    sizes = group_sizes(rows, "lang", "key")
    if not sizes:
        return []
    size = min(DICTIONARY_BYTES, TOTAL_BYTES // len(sizes))
    sample = hash_sample(rows, "lang", "key", sizes, PER_LANGUAGE, tie=F.col("t"))
    words = sample.select("lang", F.explode(word_sets(F.col("t"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # a word takes two bytes at least, the blank before it included
    best = top_per_key(words, ["lang"], [F.desc("n"), F.col("word")], size // 2)
    content: dict[str, list[bytes]] = {}
    for r in best.orderBy("lang", "rank").select("lang", "word").collect():
        content.setdefault(r["lang"], []).append(r["word"].encode())
    ranks = sorted(content, key=lambda name: (-sizes[name][0], name))
    joined = [(name, (b" " + b" ".join(content[name]))[:size]) for name in ranks]
    cut = [(name, c[:1 << (len(c).bit_length() - 1)]) for name, c in joined if len(c) >= SMALLEST]
    # most frequent last; sorting is stable, so more labelled documents stay first among equals
    return sorted(((name, b" ".join(c.split(b" ")[::-1])) for name, c in cut), key=lambda x: -len(x[1]))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Compressors:
    def __init__(self, dictionaries: list[tuple[str, bytes]]) -> None:
        self.dictionaries, self.made = dictionaries, {}
        self.sizes = sorted({len(c) for _, c in dictionaries}, reverse=True)
        self.at = {s: [i for i, (_, c) in enumerate(dictionaries) if len(c) == s] for s in self.sizes}

    def length(self, i: int, size: int, data: bytes) -> int:
        """Bytes of the data under the dictionary of a language cut to its ``size`` most frequent bytes."""
        if (i, size) not in self.made:
            self.made[i, size] = compressor(self.dictionaries[i][1][-size:])
        return len(self.made[i, size].compress(data))

    def classify(self, text: str | None) -> dict:
        data = " ".join(distinct_words(text or "")).encode()
        if not data or not self.dictionaries:
            return {"lang": UNKNOWN, "score": 0.0, "accepted": False}
        best, more = None, 1.0
        for size in self.sizes:
            rivals = ([] if best is None else [best]) + self.at[size]
            lengths = [self.length(i, size, data) for i in rivals]
            first = min(range(len(rivals)), key=lengths.__getitem__)
            rest = lengths[:first] + lengths[first + 1:]
            margin = (min(rest) - lengths[first]) / lengths[first] if rest else 1.0
            # a winner that stays is as sure as in its closest comparison
            more = margin if rivals[first] != best else min(more, margin)
            best = rivals[first]
        return {"lang": self.dictionaries[best][0], "score": more / (more + HALF_SCORE), "accepted": more >= MARGIN}


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text") -> Column:
    """Struct (lang, score, accepted) for the text column of ``docs``; the dictionaries, bounded by the fit, go to every task."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        compressors = Compressors(held.value)
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
        return pa.array([compressors.classify(t.as_py()) for t in texts], kind)

    return run(F.col(text))
