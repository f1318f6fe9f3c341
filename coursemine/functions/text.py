"""Column functions for course text: whitespace, LaTeX, formulas, language, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from coursemine.functions import fixed_values as fv

LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
CJK = r"[\u4e00-\u9fff]"
EMPTY = "cast(array() as array<string>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A lambda variable is bound to a result, whereas an expression that is used
    twice in a lambda body is computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, kept: list, array: Column, pos: str, name: str) -> DataFrame:
    """One row per element of a computed array, with its position from 0.

    The outer form is used because for the plain one the optimizer adds a filter
    on the array's size, which computes the array a second time.
    """
    return df.select(*kept, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())


def strip(c: Column) -> Column:
    """Strip Unicode white space at both ends (SQL ``trim`` strips spaces only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def normalize_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    # a single blank is left as it is: between most words it would be replaced by itself
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def drop_formula_spans(c: Column) -> Column:
    for pattern in fv.FORMULA_SPANS:
        c = F.regexp_replace(c, "(?s)" + pattern, " ")
    return c


def _speak_commands(c: Column) -> Column:
    """Replace each LaTeX command by its spoken form, or by nothing.

    The text is cut at the commands and re-joined with the looked-up words, so
    the substitution stays a built-in expression.
    """
    return let(c, _spoken)


def _spoken(c: Column) -> Column:
    spoken = {k: v for k, v in fv.LATEX_SPOKEN.items() if k not in fv.LATEX_DROPPED}
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in spoken.items()) + ")")
    command = r"\\[A-Za-z]+"
    between = F.split(c, command, -1)
    commands = F.regexp_extract_all(c, F.lit(command), F.lit(0))
    words = F.transform(
        commands,
        lambda m: F.concat(F.lit(" "), F.coalesce(F.try_element_at(table, F.substring(m, 2, 1000)), F.lit("")), F.lit(" ")),
    )
    joined = F.array_join(
        F.zip_with(between, words, lambda t, w: F.concat(t, F.coalesce(w, F.lit("")))), ""
    )
    return F.when(c.contains("\\"), joined).otherwise(c)


def _has_formula_mark(c: Column) -> Column:
    """Whether a text can hold a formula span or a command; most have neither, and one look spares them the patterns."""
    return c.contains("$") | c.contains("\\")


def clean_for_retrieval(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)```.*?```", " ")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]+\)", " ")
    c = let(c, lambda t: F.when(_has_formula_mark(t), _without_commands(t)).otherwise(t))
    c = F.replace(F.replace(c, F.lit("^"), F.lit(" power ")), F.lit("_"), F.lit(" subscript "))
    # as for runs of blanks, a single one is left
    c = F.regexp_replace(c, r"(?U)[{}\\=+\-*/<>|()\[\],.;:\s]{2,}|[{}\\=+\-*/<>|()\[\],.;:\s&&[^ ]]", " ")
    return F.trim(c)


def _without_commands(c: Column) -> Column:
    c = drop_formula_spans(c)
    c = F.regexp_replace(c, r"\\left|\\right", " ")
    c = F.regexp_replace(c, r"\\(?:mathrm|operatorname|text)\{([^{}]*)\}", " $1 ")
    c = F.regexp_replace(c, r"(?U)\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", " fraction $1 over $2 ")
    c = F.regexp_replace(c, r"(?U)\\sqrt\s*\{([^{}]*)\}", " square root $1 ")
    c = F.regexp_replace(c, r"\\begin\{[^{}]+\}|\\end\{[^{}]+\}", " ")
    return _speak_commands(c)


def is_formula_line(c: Column) -> Column:
    return let(c, _is_formula_line)


def _is_formula_line(line: Column) -> Column:
    prose = count_of(line, r"(?U)\b[A-Za-z]{3,}\b")
    cjk = count_of(line, CJK)

    def symbolic(symbols: Column) -> Column:
        # most lines fail by their few symbols, before words are counted
        wordy = (symbols < 4) & ((cjk > 8) | (prose > 6))
        return (
            ((symbols >= 2) & (count_of(line, r"[A-Za-z0-9\u4e00-\u9fff]") >= 2))
            | ((symbols >= 1) & line.rlike(r"(?iU)\b(?:dx|dy|dz|dt)\b"))
        ) & ~wordy

    return F.length(line).between(3, 500) & (
        line.rlike(r"\\(?:frac|int|sum|lim|sqrt|begin|partial|nabla)") | let(count_of(line, fv.MATH_SYMBOL_CLASS), symbolic)
    )


def normalize_formula(c: Column) -> Column:
    c = strip(c)
    for opening, closing in ((r"\$\$", r"\$\$"), (r"\$", r"\$"), (r"\\\(", r"\\\)"), (r"\\\[", r"\\\]")):
        c = strip(F.regexp_replace(c, rf"\A{opening}|{closing}\z", ""))
    return F.substring(collapse(c), 1, fv.MAX_FORMULA_CHARS)


def extract_formulas(c: Column) -> Column:
    """Delimited spans, pattern by pattern, then formula-looking lines; distinct, at most twelve."""
    spans = F.concat(*[F.regexp_extract_all(c, F.lit("(?s)" + p), F.lit(0)) for p in fv.FORMULA_SPANS])
    # a formula line has a math symbol or a command: cheap test first, and once more without the spans, which add none
    marked = lambda x: x.rlike(fv.MATH_SYMBOL_CLASS + r"|\\")
    bare = F.filter(
        F.transform(F.filter(lines(c), marked), lambda x: strip(F.when(_has_formula_mark(x), drop_formula_spans(x)).otherwise(x))),
        lambda x: marked(x) & is_formula_line(x),
    )
    all_spans = F.when(_has_formula_mark(c), spans).otherwise(F.expr(EMPTY))
    found = F.filter(F.transform(F.concat(all_spans, bare), normalize_formula), lambda x: x != "")
    # most texts have neither a mark nor a symbol, and are not cut into lines; one range around the wide symbols is fast, accented letters are none
    plain = ~c.rlike(r"[=\^_+\-*/<>|\\$\xB1\xD7\xF7\u2202-\u2265]")
    return F.when(plain, F.expr(EMPTY)).otherwise(F.slice(F.array_distinct(found), 1, fv.MAX_FORMULAS))


def detect_language(c: Column) -> Column:
    # what a run of letters takes away is counted, not each letter found
    held = lambda letters: F.length(c) - F.length(F.regexp_replace(c, letters, ""))
    latin, cjk = held("[A-Za-z]+"), F.when(has_cjk(c), held(CJK + "+")).otherwise(0)
    return (
        F.when((latin == 0) & (cjk == 0), "unknown")
        .when(latin > cjk * 2, "en")
        .when(cjk > latin, "zh")
        .otherwise("mixed")
    )


def shorten(c: Column, n: int = 160) -> Column:
    return let(
        strip(collapse(c)),
        lambda t: F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("..."))),
    )


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def payload_key(prefix: str, fields: dict[str, Column], namespace: str = "coursemine") -> Column:
    """Stable cache key: SHA-256 of the JSON object with its fields in name order."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{namespace}:{prefix}:"), F.sha2(body, 256))


def fallback_parse_json(c: Column, schema: str, fallback: Column) -> Column:
    """JSON object from text; else from its outermost braces; else the fallback.

    ``from_json`` yields a struct of nulls on bad input, so validity is tested
    apart, with ``try_parse_json``.
    """
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return (
        F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
        .when((inner != "") & F.try_parse_json(inner).isNotNull(), F.from_json(inner, schema))
        .otherwise(fallback)
    )
