"""Language identification: dictionaries and predictions against plain Python, whole texts, equal sizes, no bound on languages."""

import collections
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from coursemine.llm import common, language_id as li

SYLLABLES = {"aa": "ka to mi ra su", "bb": "schl ung tz ei rk", "cc": "eau oir ille que ent"}
DOCS = "doc_id bigint, text string, lang string"


def words(rng, lang, n):
    return ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, " ".join(words(rng, lang, rng.choice([5, 40, 300]))) + ". 12", lang) for i, lang in enumerate(["aa", "bb", "cc", "aa"] * 30)]
    return out + [(None, out[0][1], "aa"), (3, out[3][1], "aa"), (500, None, "bb"), (501, "", "bb"), (502, "12 ? 3", "cc"), (503, out[1][1], None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def brute_words(text):
    return list(dict.fromkeys(re.findall(r"[^\W\d_]+", text.lower())))


def brute_fit(spark, rows, per_language, bound):
    """As the docstrings say, from the hash of the ids on."""
    keys = spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "k bigint")
    order = {r["k"]: r["h"] & (2**64 - 1) for r in keys.select("k", F.xxhash64(F.lit("fit"), "k").alias("h")).collect()}
    by_lang = collections.defaultdict(list)
    for key, text, lang in rows:
        if lang is not None and text is not None:
            by_lang[lang].append((order[key], text))
    out = []
    for lang, texts in sorted(by_lang.items(), key=lambda x: (-len(x[1]), x[0])):
        n = collections.Counter(w for _, t in sorted(texts)[:per_language] for w in brute_words(t))
        content = b"".join(b" " + w.encode() for w in sorted(n, key=lambda w: (-n[w], w)))[:bound]
        size = 1
        while size * 2 <= len(content):
            size *= 2
        out.append((lang, b" ".join(content[:size].split(b" ")[::-1])))
    return sorted(out, key=lambda x: -len(x[1]))


@pytest.mark.parametrize("per_language, bound", [(200, 65_536), (20, 1024), (7, 300)])
def test_dictionaries_equal_brute_force(spark, rows, docs, monkeypatch, per_language, bound):
    monkeypatch.setattr(li, "PER_LANGUAGE", per_language)
    monkeypatch.setattr(li, "DICTIONARY_BYTES", bound)
    assert li.fit(docs) == brute_fit(spark, rows, per_language, bound)


def test_predictions_equal_brute_force(spark, rows, docs):
    fitted = li.fit(docs)
    for name in ("lang_pred", "score", "key", "t", "word", "n", "_group"):
        docs = docs.withColumn(name, F.lit("mine"))
    assert li.fit(docs) == fitted
    got = docs.select("text", li.identify(docs, fitted).alias("p")).collect()
    sizes = sorted({len(c) for _, c in fitted}, reverse=True)

    def length(content, size, data):
        d = zstandard.ZstdCompressionDict(content[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=li.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(data))

    for text, p in got:
        data = " ".join(brute_words(text or "")).encode()
        if not data:
            assert tuple(p) == ("und", 0.0, False)
            continue
        best = None
        for size in sizes:
            rivals = ([best] if best else []) + [f for f in fitted if len(f[1]) == size]
            best = min(rivals, key=lambda f: length(f[1], size, data))
        assert p["lang"] == best[0] and 0 <= p["score"] <= 1


def test_words_far_into_a_text_are_learned(spark):
    filler = "zzzz " * 5000
    df = spark.createDataFrame([(i, filler + " ".join(words(random.Random(i), lang, 50)), lang) for i, lang in enumerate(["aa", "bb"] * 10)], DOCS)
    fitted = li.fit(df)
    assert all(any(s.encode() in c for s in SYLLABLES[lang].split()) for lang, c in fitted)
    probe = spark.createDataFrame([(i, " ".join(words(random.Random(99 + i), lang, 30)), lang) for i, lang in enumerate(["aa", "bb"] * 5)], DOCS)
    assert probe.select("lang", li.identify(probe, fitted).alias("p")).filter("lang <> p.lang").count() == 0


def test_a_small_language_is_compared_at_its_size(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, "aa", 300)), "aa") for i in range(40)] + [(100, " ".join(words(rng, "bb", 60)), "bb")]
    fitted = li.fit(spark.createDataFrame(rows, DOCS))
    assert [lang for lang, _ in fitted] == ["aa", "bb"] and len(fitted[0][1]) >= 4 * len(fitted[1][1])
    probe = spark.createDataFrame([(i, " ".join(words(rng, lang, 40)), lang) for i, lang in enumerate(["aa", "bb"] * 10)], DOCS)
    assert probe.select("lang", li.identify(probe, fitted).alias("p")).filter("lang <> p.lang").count() == 0


def test_every_language_can_be_predicted(spark, monkeypatch):
    rng = random.Random(7)
    alphabets = ["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(6)) for _ in range(700)]
    text = lambda a, r: " ".join("".join(r.choices(a, k=3)) for _ in range(40))
    df = spark.createDataFrame([(i, text(a, rng), f"l{i}") for i, a in enumerate(alphabets)], DOCS)
    monkeypatch.setattr(li, "TOTAL_BYTES", 700 * 300)
    fitted = li.fit(df)
    assert len(fitted) == 700 and {len(c) for _, c in fitted} == {256}
    probe = spark.createDataFrame([(i, text(alphabets[i], rng), f"l{i}") for i in (0, 350, 699)], DOCS)
    assert probe.select("lang", li.identify(probe, fitted).alias("p")).filter("lang <> p.lang").count() == 0


def test_equal_languages_tie_by_labelled_documents(spark):
    t = " ".join(words(random.Random(1), "aa", 50))
    df = spark.createDataFrame([(1, t, "y"), (2, t, "x"), (3, t, "x")], DOCS)
    p = df.select(li.identify(df, li.fit(df)).alias("p")).select("p.*").distinct().collect()
    assert [tuple(r) for r in p] == [("x", 0.0, False)]


def test_hash_sample_never_loses_a_group(spark):
    df = spark.createDataFrame([(None if g == "nulls" else g == "one" and 7 or i, g) for g in ("nulls", "one", "many") for i in range(3000)], "k bigint, g string")
    n = {r["g"]: r["n"] for r in common.hash_sample(df, "g", "k", common.group_sizes(df, "g", "k"), 20).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert n == {"nulls": 20, "one": 20, "many": 20}
