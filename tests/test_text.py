"""Text functions against values worked out by hand, above all the ideograph paths that the tables lack."""

import random
import re

from pyspark.sql import functions as F

from coursemine.catalog import text_queries
from coursemine.functions import terms, text as tx, tokens as tk
from coursemine.operators import chunking



def test_normalize(spark, one):
    assert one(lambda X: tx.normalize_text(X), "　a \t b\r\nc\r\n\r\n\r\nd\n") == "a b\nc\n\nd"


def test_clean_for_retrieval(spark, one):
    assert one(lambda X: tx.clean_for_retrieval(X), r"\frac{a}{b} \alpha \to x_1^2") == "fraction a over b alpha x subscript 1 power 2"
    assert one(lambda X: tx.clean_for_retrieval(X), "a ```code\n``` b ![i](u) $x+y$ \\text{word} \\unknown c") == "a b word c"
    assert one(lambda X: tx.clean_for_retrieval(X), r"\left( \sqrt{2} \begin{matrix} 1 \end{matrix}") == "square root 2 1"


def test_formulas(spark, one):
    text = "see $$a+b$$ and $x = y$\nplain prose line here\n\\int f dx\n$x = y$ z = 3 - w"
    assert one(lambda X: tx.extract_formulas(X), text) == ["a+b", "and", "x = y", "\\int f dx", "z = 3 - w"]  # "$ and $" lies between two marks
    assert one(lambda X: tx.is_formula_line(X), "f dx = 1") is True
    assert one(lambda X: tx.is_formula_line(X), "one two three four five seven eight = nine") is False


def test_language(spark, one):
    got = [one(lambda X: tx.detect_language(X), t) for t in ("12 .", "hello 极限 word", "abc 极限", "极限导数 a")]
    assert got == ["unknown", "en", "mixed", "zh"]


def test_lexical_tokens(spark, one):
    assert one(lambda X: tk.tokenize_lexical(X), "The ABC abc 正项级数收敛 3.5 怎么") == [
        "abc", "3.5", "正项级数收敛", "正项", "项级", "级数", "数收", "收敛", "正项级", "项级数", "级数收", "数收敛",
    ]
    assert one(lambda X: tk.hash_tokens(X), "A b_1 极 x 限") == ["a", "b_1", "x", "极", "限", "极限"]
    assert one(lambda X: tk.hash_tokens(X), "") == []


def test_formula_tokens(spark, one):
    assert one(lambda X: tk.formula_tokens(X), r"\frac{A}{2} = x") == ["a", "2", "x", "{", "}", "="]


def test_key_terms_with_ideographs(spark, one):
    got = one(lambda X: terms.extract_key_terms(X), "比较判别法")
    assert [(t["source"], t["kind"], t["confidence"]) for t in got] == [
        ("比较判别法", "method", 0.95), ("判别法", "method", 0.95), ("较判别法", "method", 0.842),
    ]
    assert all(t["zh"] == t["source"] for t in got)


def test_key_terms_latin(spark, one):
    got = one(lambda X: terms.extract_key_terms(X), "the line integral. Fourier series, Fourier series")
    assert got[0]["source"] == "line integral" and got[0]["kind"] == "concept" and got[0]["confidence"] == 0.95
    assert len(got) <= 5 and len({t["source"].lower() for t in got}) == len(got)


def test_clean_and_validate_terms(spark, one):
    assert one(lambda X: terms.clean_key_term(X), " $the Fourier series x$ ") == "Fourier series"
    assert one(lambda X: terms.clean_key_term(X), "formula: 可见级数") == "级数"
    for bad in ("dx over", "heat", "gradient", "x", "12.5", "a=b", "{abc}defgh", "the"):
        assert one(lambda X: terms.valid_key_term(X), bad) is False, bad
    for good in ("Fourier series", "级数", "process scheduling"):
        assert one(lambda X: terms.valid_key_term(X), good) is True, good


def test_rank_merges_sources(spark):
    df = spark.sql(
        "select array(named_struct('source','Taylor Series','zh','幂级数','kind','','confidence',cast(null as double),'term_source','')) m,"
        " array(named_struct('source','Fourier series','zh','','kind','','confidence',0.3D,'term_source','local'),"
        " named_struct('source','幂级数','zh','','kind','','confidence',0.9D,'term_source','local')) l"
    )
    merged = F.concat(terms.normalize_terms(F.col("m"), "llm"), terms.normalize_terms(F.col("l"), "local"))
    got = df.select(terms.rank_terms(merged).alias("v")).first()["v"]
    # 0.76 + 2.1 / 10 is above 0.9, so the supplied pair keeps the place of its identity
    assert [(t["source"], t["zh"], t["confidence"], t["term_source"]) for t in got] == [
        ("Taylor Series", "幂级数", 0.95, "llm"), ("Fourier series", "", 0.3, "local"),
    ]


def test_chunk_windows_cover_the_text(spark, one):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    got = one(lambda X: chunking.chunk_text(X, 800, 120), text)
    assert got == [text[0:800], text[680:1480], text[1360:2000]]
    # a last window inside the overlap is kept when it is long enough
    assert one(lambda X: chunking.chunk_text(X, 800, 120), text[:1400])[-1] == text[1360:1400]
    assert one(lambda X: chunking.chunk_text(X, 100, 90), text[:130]) == [text[i : min(i + 100, 130)] for i in range(0, 111, 10)]


def test_chunk_packs_paragraphs(spark, one):
    a, b, c = "a" * 30, "b" * 30, "c" * 90
    assert one(lambda X: chunking.chunk_text(X, 64, 10), f"{a}\n\n{b}\n\n\n{a}\n\n{c}\n\ntiny") == [f"{a}\n\n{b}", a, "c" * 64, "c" * 36]
    assert one(lambda X: chunking.chunk_text(X), "  \n ") == []


def test_parse_json_fallback(spark, one):
    expr = lambda X: tx.fallback_parse_json(X, "k int", F.struct(F.lit(-1).alias("k")))["k"]
    assert [one(expr, t) for t in ('{"k": 3}', 'so: {"k": 4} ok', '{"k": ', "none")] == [3, 4, -1, -1]


def test_first_words_equal_those_of_the_whole_text(spark):
    """The start that is cleaned holds the first pieces of any text, also where nothing but signs stands between spaces."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab Z\n\t,.9é好$\\", k=rng.randrange(60))) for _ in range(3000)] + ["", " ", "a", " a  b", "好" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    plain = F.slice(F.split(F.regexp_replace("x", "[^A-Za-z ]", ""), " +"), 1, 6)
    rows = df.select("x", plain.alias("want"), text_queries._first_words(F.col("x"), 6).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in rows)
    assert max(len(r["got"]) for r in rows) == 6


def test_single_blanks_symbols_and_accents(one):
    """Runs of white space and of marks become one blank, whichever they are made of; wide symbols mark a formula, accents do not."""
    for text in ("a b", "a  b", "a\tb", "a \t b\t", "\t\n\n\n a\n\n\n\nb \n", "a\r\nb\rc", " "):
        want = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", re.sub("\r\n?", "\n", text))).strip()
        assert one(tx.normalize_text, text) == want
    for text in ("a b", "a, b", "a.b", "a b", "a\nb", "a   b", "x - y", "-x-", " ; ", "a{b}c", "é. à", "a|b"):
        assert one(tx.clean_for_retrieval, text) == re.sub(r"[{}\\=+\-*/<>|()\[\],.;:\s]+", " ", text).strip(" ")
    for symbol in "=^_+-*/<>|∫√∞≤≥≠≈∑∏∂∆∇±×÷":
        line = f"é1 {symbol} 2{symbol} 3"
        assert one(tx.extract_formulas, f"été\n{line}\nplain") == [line]
    assert one(tx.extract_formulas, "été, naïve Grüße") == [] == one(tx.extract_formulas, "a well-known long word in a sentence of prose")
