"""Pieces of DuckDB SQL shared by the oracle queries."""

from __future__ import annotations

from coursemine.fixtures import duck as view
from coursemine.functions import fixed_values as fv


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def inlist(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def sub(x: str, pattern: str, to: str = "", opts: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, {q(opts)})"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def normalize(x: str) -> str:
    x = sub(x, r"\r\n?", "\n")
    x = sub(x, r"[ \t]+", " ")
    return strip(sub(x, r"\n{3,}", "\n\n"))


def spans_dropped(x: str) -> str:
    for p in fv.FORMULA_SPANS:
        x = sub(x, p, " ", "gs")
    return x


def clean(x: str, commands: bool = False) -> str:
    x = sub(x, r"```.*?```", " ", "gs")
    x = sub(x, r"!\[[^\]]*\]\([^)]+\)", " ")
    x = spans_dropped(x)
    x = sub(x, r"\\left|\\right", " ")
    x = sub(x, r"\\(?:mathrm|operatorname|text)\{([^{}]*)\}", r" \1 ")
    x = sub(x, r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r" fraction \1 over \2 ")
    x = sub(x, r"\\sqrt\s*\{([^{}]*)\}", r" square root \1 ")
    x = sub(x, r"\\begin\{[^{}]+\}|\\end\{[^{}]+\}", " ")
    if commands:
        for word in sorted(fv.LATEX_SPOKEN, key=len, reverse=True):
            spoken = "" if word in fv.LATEX_DROPPED else fv.LATEX_SPOKEN[word]
            x = sub(x, rf"\\{word}\b", f" {spoken} ")
    x = sub(x, r"\\[A-Za-z]+", " ")
    x = f"replace(replace({x}, '^', ' power '), '_', ' subscript ')"
    return f"trim({sub(x, r'[{}=+*/<>|()\[\],.;:\s\\-]+', ' ')})"


def distinct(x: str) -> str:
    """Distinct in first-seen order."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def lexical_tokens(x: str) -> str:
    """Latin tokens, repeats kept (the driver tables hold no ideographs)."""
    found = f"regexp_extract_all(lower({x}), '[a-z][a-z0-9-]{{1,}}|[0-9]+(?:\\.[0-9]+)?')"
    return f"list_filter({found}, lambda t: t NOT IN {inlist(fv.QUERY_STOPWORDS)})"


def formula_tokens_of(x: str) -> str:
    words = f"regexp_extract_all(replace({x}, '\\', ' '), '[A-Za-z][A-Za-z0-9]*|[0-9]+(?:\\.[0-9]+)?')"
    kept = f"list_filter(list_transform({words}, lambda t: lower(t)), lambda t: t NOT IN {inlist(fv.FORMULA_QUERY_STOPWORDS)})"
    return f"list_concat({kept}, regexp_extract_all({x}, {q('[=+*/^_(){}' + chr(92) + '[' + chr(92) + '],-]')}))"


def masked(x: str) -> str:
    """Words with accented letters become '#', as RE2 word boundaries only know ASCII."""
    return sub(x, r"[A-Za-z0-9_]*[\x{00C0}-\x{024F}][A-Za-z0-9_\x{00C0}-\x{024F}]*", "#")


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def is_formula_line(x: str) -> str:
    m = masked(x)
    sym = count(x, r"[=\^_+\-*/<>|∫√∞≤≥≠≈∑∏∂∆∇±×÷]")
    prose = count(m, r"\b[A-Za-z]{3,}\b")
    alnum = count(x, r"[A-Za-z0-9]")
    return (
        f"(length({x}) BETWEEN 3 AND 500 AND (regexp_matches({x}, '\\\\(?:frac|int|sum|lim|sqrt|begin|partial|nabla)') OR "
        f"(NOT ({prose} > 6 AND {sym} < 4) AND (({sym} >= 2 AND {alnum} >= 2) OR "
        f"({sym} >= 1 AND regexp_matches({m}, '(?i)\\b(?:dx|dy|dz|dt)\\b'))))))"
    )


LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def formula(x: str) -> str:
    x = strip(x)
    for a in (r"^\$\$|\$\$$", r"^\$|\$$", r"^\\\(|\\\)$", r"^\\\[|\\\]$"):
        x = strip(sub(x, a))
    return f"substr({sub(x, chr(92) + 's+', ' ')}, 1, 500)"


def formulas_cte(src: str, keys: str, text: str = "text") -> str:
    """CTEs giving ``formulas`` (keys, fs LIST) from relation ``src``."""
    spans = ", ".join(f"regexp_extract_all({text}, {q(p)}, 0, 's')" for p in fv.FORMULA_SPANS)
    one = strip(spans_dropped(strip("x")))
    return f"""
f_raw AS (SELECT {keys}, flatten([{spans}]) AS spans,
   list_transform(string_split_regex({text}, {q(LINE_BREAK)}), lambda x: {one}) AS ls FROM {src}),
f_line AS (SELECT {keys}, spans, list_filter(list_filter(ls, lambda x: regexp_matches(x, '[=\\^_+*/<>|∫√∞≤≥≠≈∑∏∂∆∇±×÷\\\\-]')),
   lambda x: {is_formula_line('x')}) AS ls FROM f_raw),
f_all AS (SELECT {keys}, list_filter(list_transform(list_concat(spans, ls), lambda x: {formula('x')}), lambda x: x <> '') AS fs FROM f_line),
formulas AS (SELECT {keys}, list_filter(fs, lambda x, i: list_position(fs, x) = i)[1:12] AS fs FROM f_all)"""


def chunks_cte(extra: str = "goal_id, filename, file_type") -> str:
    """CTE ``chunks`` (material_id, extra…, chunk_index, content) of the material view."""
    cut = (
        f"CASE WHEN t = '' THEN [] WHEN length(t) <= {fv.CHUNK_SIZE} THEN [t] ELSE "
        f"list_transform(range(0, length(t), {fv.CHUNK_SIZE - fv.CHUNK_OVERLAP}), lambda i: {strip(f'substr(t, i + 1, {fv.CHUNK_SIZE})')}) END"
    )
    return f"""
mat AS (SELECT material_id, {extra}, {normalize('text')} AS t FROM {view('material')}),
cut AS (SELECT material_id, {extra}, list_filter({cut}, lambda x: length(x) >= 20) AS cs FROM mat),
chunks AS (SELECT material_id, {extra}, CAST(unnest(range(len(cs))) AS INT) AS chunk_index, unnest(cs) AS content FROM cut)"""


def hash_cte(src: str, keys: str, text: str, name: str = "hashed", dims: int = fv.EMBED_DIMS) -> str:
    """CTE ``name`` (keys, bucket, w): normalized signed hash weights."""
    return f"""
{name}_t AS (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS tok FROM {src}),
{name}_h AS (SELECT {keys}, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM {name}_t),
{name}_b AS (SELECT {keys}, CAST(h % {dims} AS INT) AS bucket, SUM(CASE WHEN (h >> 8) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {keys}, bucket, s / sqrt(SUM(s * s) OVER (PARTITION BY {keys})::DOUBLE) AS w FROM {name}_b WHERE s <> 0)"""
