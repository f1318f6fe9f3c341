"""Tokenizers as array expressions; no row leaves the JVM and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import clean_for_retrieval, extract_formulas, let, strip


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _ngrams(c: Column, n: int) -> Column:
    # ``c`` must be cheap: a column or a lambda variable.  sequence() counts downwards when its end is below its start, hence the guard
    return F.when(
        F.length(c) >= n,
        F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))),
    ).otherwise(F.array().cast("array<string>"))


def tokenize_lexical(c: Column) -> Column:
    """Words, numbers and CJK runs with their 2- and 3-grams; distinct, first seen first."""
    latin = F.array_except(
        _all(F.lower(c), r"[a-z][a-z0-9-]{1,}|[0-9]+(?:\.[0-9]+)?"), F.array(*[F.lit(w) for w in fv.QUERY_STOPWORDS])
    )
    runs = F.filter(_all(c, r"[\u4e00-\u9fff]{2,16}"), lambda t: ~t.isin(*fv.QUERY_STOPWORDS))
    grams = F.flatten(
        F.transform(
            runs,
            lambda b: F.when(F.length(b) > 4, F.concat(F.array(b), _ngrams(b, 2), _ngrams(b, 3))).otherwise(F.array(b)),
        )
    )
    # both are distinct in themselves, and no string is in both
    return F.concat(latin, F.array_distinct(grams))


def formula_tokens(text: Column, formulas: Column | None = None) -> Column:
    def of(c: Column) -> Column:
        words = F.filter(
            F.transform(_all(F.replace(c, F.lit("\\"), F.lit(" ")), r"[A-Za-z][A-Za-z0-9]*|[0-9]+(?:\.[0-9]+)?"), F.lower),
            lambda t: ~t.isin(*fv.FORMULA_QUERY_STOPWORDS),
        )
        return F.concat(words, _all(c, r"[=+\-*/^_(){}\[\],]"))

    found = of(text)
    if formulas is not None:
        found = F.concat(found, F.flatten(F.transform(formulas, of)))
    return F.array_distinct(found)


def hash_tokens(c: Column) -> Column:
    """Words, single ideographs and ideograph pairs, repeats kept."""
    ideographs = F.array_join(_all(c, r"[\u4e00-\u9fff]+"), "")
    pairs = let(ideographs, lambda x: F.concat(_ngrams(x, 1), _ngrams(x, 2)))
    return F.concat(_all(F.lower(c), "[a-z0-9_]+"), pairs)


def query_signals(query: Column) -> list[Column]:
    """Columns semantic_query, lexical_terms, formula_terms of a search request."""
    semantic = let(clean_for_retrieval(query), lambda t: F.when(t != "", t).otherwise(strip(query)))
    return [
        semantic.alias("semantic_query"),
        F.slice(tokenize_lexical(semantic), 1, fv.QUERY_TERM_LIMIT).alias("lexical_terms"),
        F.slice(formula_tokens(query, extract_formulas(query)), 1, fv.QUERY_TERM_LIMIT).alias("formula_terms"),
    ]
