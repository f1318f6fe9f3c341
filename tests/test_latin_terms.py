"""Key terms, formulas, language and hash vectors of texts against the plain expressions they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from coursemine.functions import terms as tm, text as tx, tokens as tk
from coursemine.operators import retrieval as rt, vectors as vx

WORDS = [
    "the", "The", "a", "b", "X", "of", "alpha", "line", "integral", "Line", "partial", "derivative", "dx", "x1", "root", "Root2", "over", "over3", "sum",
    "foo", "Bar", "bar", "foobar", "é", "café", "_", "x_y", "2", "3a", "ab", "abcde", "abcdef", "fraction", "²", "naïve", "power", "“q”", "x" * 90, "a-b",
    "$x^2$", "\\alpha", "the\tline", "don't", "定理", "π", "y = a + b", "\n\n",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    pools = [WORDS, WORDS[:40]]  # with and without other scripts
    rows = [(" ".join(rng.choice(pools[i % 2]) for _ in range(rng.randint(0, 40))),) for i in range(400)]
    return spark.createDataFrame(rows + [(None,), ("",)], "t string").repartition(4).cache()


def test_latin_terms_equal_the_expressions(texts):
    """Texts of Latin letters are ranked in Arrow batches; both kinds occur."""
    t = F.col("t")
    fast = tm._latin_top(5)(tx.clean_for_retrieval(t)).isNotNull()
    rows = texts.select("t", fast.alias("fast"), tm.extract_key_terms(t).alias("a"), tm.key_terms_of_any(t).alias("b")).collect()
    assert 100 < sum(r["fast"] for r in rows) < 400
    assert [r["t"] for r in rows if r["a"] != r["b"]] == []


def test_expressions_per_phrase_are_not_run_on_latin_chunks(texts):
    """The work of a batch is done once: a chunk of Latin letters has its terms from the Arrow function alone."""
    plan = texts.select(tm.extract_key_terms(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_language_and_formulas(spark, texts):
    rows = texts.select("t", tx.detect_language(F.col("t")).alias("lang"), tx.extract_formulas(F.col("t")).alias("f")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["f"] is None
            continue
        latin, cjk = sum(c.isascii() and c.isalpha() for c in r["t"]), sum("一" <= c <= "鿿" for c in r["t"])
        assert r["lang"] == ("unknown" if not latin + cjk else "en" if latin > 2 * cjk else "zh" if cjk > latin else "mixed")
        assert not r["f"] or any(c in r["t"] for c in "$\\=^_+-")


def test_hash_vectors_equal_the_expressions(texts):
    plain = vx.dense_vector(vx.unit_weights(vx.sparse_hash_vector(tk.hash_tokens(F.col("t")))))
    rows = vx.hash_embed(texts, "t").withColumn("plain", plain).collect()
    assert len(rows) == 402 and all(r["vector"] == r["plain"] for r in rows)


def test_usable_terms_equal_the_plain_expressions(spark):
    """Plain words take a shorter way; stop words, short and noise words, marks and ideographs among them."""
    rng = random.Random(8)
    words = WORDS + ["of", "and", "is", "alpha", "frac", "Theorem", "matrix", "in", "定理", "OF", "formula: x", "$y$"]
    sides = [None, "", " ", *words, *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(600)]]
    rows = [(i, [(rng.choice(sides), rng.choice(sides), "term", rng.choice([None, 0.4, 0.9]), "local") for _ in range(rng.randint(0, 4))]) for i in range(400)]
    df = spark.createDataFrame(rows + [(-1, None)], f"i int, x array<{tm.TERM_TYPE}>").repartition(4)
    side = lambda c: tm.clean_key_term(F.coalesce(c, F.lit("")))
    trusted = F.filter("x", lambda t: t["confidence"].isNull() | (t["confidence"] >= 0.45))
    plain = F.array_distinct(F.filter(
        F.flatten(F.transform(trusted, lambda t: F.array(side(t["source"]), side(t["zh"])))), lambda x: (x != "") & tm.valid_key_term(x)))
    got = df.select("i", tm.usable_terms(F.col("x")).alias("got"), plain.alias("want")).collect()
    assert sum(len(r["want"] or []) for r in got) > 150 and [r for r in got if r["got"] != r["want"]] == []


def test_joined_words_are_made_once(spark):
    """The words of a chunk are joined and its terms cleaned once, though words and ideographs are looked for apart."""
    e = spark.createDataFrame([(1, 2, 0, "定理 alpha", "", [], [])], f"goal_id int, material_id int, chunk_index int, retrieval_text string, content_preview string, formulas array<string>, key_terms array<{tm.TERM_TYPE}>")
    t = rt.token_table(e)
    assert t._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") == 1
    assert t.first()["tokens"] == ["alpha", "定理"] and rt.token_table(e, "goal_id", "retrieval_text").first()["retrieval_text"] == "定理 alpha"
