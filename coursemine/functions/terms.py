"""Key terms: cleaning, validity, concept bonus, candidates and ranking.

Every function maps a row to a row.  A chunk has at most a few hundred
candidate phrases, so counting and ranking them inside the row beats exploding
them into a shuffle.  Chunks of Latin letters alone are ranked in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import clean_for_retrieval, collapse, count_of, has_cjk, let, strip

TERM_TYPE = "struct<source:string,zh:string,kind:string,confidence:double,term_source:string>"
TERM_FIELDS = ["source", "zh", "kind", "confidence", "term_source"]

_STOP = "|".join(fv.TERM_STOPWORDS)
_NOISE_WORDS = sorted(
    {w.lower() for w in fv.LATEX_DROPPED} | {w.lower() for w in fv.LATEX_SPOKEN} | set(fv.EXTRA_NOISE_WORDS) | set(fv.TERM_STOPWORDS)
)


def _trim_stopwords(c: Column) -> Column:
    """Drop stop words at both ends of a single-spaced phrase."""
    c = F.regexp_replace(c, rf"(?i)\A(?:(?:{_STOP})(?: |\z))+", "")
    return F.trim(F.regexp_replace(c, rf"(?i)(?:(?: |\A)(?:{_STOP}))+\z", ""))


def clean_latin_phrase(c: Column) -> Column:
    """``clean_key_term`` for single-spaced phrases of Latin words, where only its last steps can fire."""
    return _trim_stopwords(F.regexp_replace(c, r" [A-Za-z]\z", ""))


def clean_key_term(c: Column) -> Column:
    c = F.regexp_replace(strip(c), r"\A\$+|\$+\z", "")
    c = strip(F.regexp_replace(c, r"\A\\\(|\\\)\z|\A\\\[|\\\]\z", ""))
    c = F.regexp_replace(c, r"(?iU)\Aformulae?\s*:\s*", "")
    c = F.regexp_replace(c, "|".join(fv.CJK_NOISE), " ")
    c = F.regexp_replace(c, r"(?U)\s+[A-Za-z]\z", "")
    return _trim_stopwords(strip(collapse(c)))


def _constants(rows: list[dict]) -> Column:
    """Literal ARRAY of structs, parsed from one SQL text: hundreds of ``lit`` calls would cost seconds to build."""
    def value(v: object) -> str:
        return f"{v!r}D" if isinstance(v, float) else str(v) if isinstance(v, int) else f"'{v}'"

    structs = (", ".join(f"'{k}', {value(v)}" for k, v in row.items()) for row in rows)
    return F.expr("array(" + ", ".join(f"named_struct({x})" for x in structs) + ")")


def _one_of(words: list[str]) -> str:
    return r"\A(?:" + "|".join(words) + r")\z"


def concept_kind(term: Column) -> Column:
    """Struct (kind, bonus) of a cleaned term: whole concept, part of one, or by suffix."""
    def entry(kind: Column | str, bonus: Column | float) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        bonus = F.lit(float(bonus)) if isinstance(bonus, (int, float)) else bonus
        return F.struct(kind.alias("kind"), bonus.alias("bonus"))

    def of(low: Column) -> Column:
        return let(best_held(low), lambda held: chosen(low, held))

    rows = _constants([{"name": n, "kind": k, "bonus": float(b), "turn": -i} for i, (n, k, b) in enumerate(fv.CONCEPTS)])

    def best_held(low: Column) -> Column:
        return F.array_max(
            F.transform(
                F.filter(rows, lambda c: low.contains(c["name"])),
                lambda c: F.struct(
                    F.when(c["name"] == low, c["bonus"] * 10).otherwise(c["bonus"] * F.lit(0.65)).alias("rank"),
                    c["turn"].alias("turn"), c["kind"].alias("kind"), c["name"].alias("name"), c["bonus"].alias("bonus"),
                ),
            )
        )

    def chosen(low: Column, held: Column) -> Column:
        out = F.when(
            held["name"].isNotNull(),
            entry(held["kind"], F.when(held["name"] == low, held["bonus"]).otherwise(held["bonus"] * F.lit(0.65))),
        )
        for suffix, kind, bonus in fv.CONCEPT_SUFFIXES:
            out = out.when(low.endswith(suffix), entry(kind, bonus))
        return out.otherwise(entry("term", 0.0))

    return let(F.lower(term), of)


def latin_kind(term: Column) -> Column:
    """``concept_kind`` restricted to the concepts a Latin phrase can hold."""
    low = F.lower(term)
    out = None
    for scale, test in ((1.0, lambda name: low == name), (0.65, lambda name: low.contains(name))):
        for name, kind, bonus in fv.CONCEPTS:
            if name.isascii():
                value = F.struct(F.lit(kind).alias("kind"), F.lit(bonus * scale).alias("bonus"))
                out = F.when(test(name), value) if out is None else out.when(test(name), value)
    return out.otherwise(F.struct(F.lit("term").alias("kind"), F.lit(0.0).alias("bonus")))


def valid_latin_phrase(c: Column) -> Column:
    """``valid_key_term`` for a cleaned phrase of letters, digits, hyphens and spaces."""
    formula_words = "|".join(fv.FORMULA_WORDS)
    lone_words = "|".join(fv.FORMULA_WORDS + fv.FORMULA_LONE_WORDS)
    rejected = "|".join(
        [
            r"\A.?\z", "-", r"\A\d*[A-Za-z]\d*\z", r"\A(?:[A-Za-z] *){1,5}\z",
            rf"(?<![A-Za-z])(?:{formula_words})(?![A-Za-z])", rf"\A[^A-Za-z]*(?:{lone_words})[^A-Za-z]*\z",
        ]
    )
    return ~c.rlike(f"(?i){rejected}|{_one_of(_NOISE_WORDS)}")


def valid_key_term(raw: Column) -> Column:
    return let(clean_key_term(raw), _valid_cleaned)


def _valid_cleaned(c: Column) -> Column:
    packed = F.regexp_replace(c, r"(?U)\s+", "")
    formula_words = "|".join(fv.FORMULA_WORDS)
    lone_words = "|".join(fv.FORMULA_WORDS + fv.FORMULA_LONE_WORDS)
    symbols = count_of(c, r"(?U)[^A-Za-z0-9一-鿿\s-]")
    return ~(
        (F.length(c) < 2)
        | c.rlike("(?i)" + _one_of(_NOISE_WORDS))
        | (has_cjk(c) & (packed.rlike(_one_of(fv.CJK_NOISE)) | ((F.length(packed) > 10) & (concept_kind(packed)["bonus"] <= 0))))
        | c.rlike(rf"(?i)(?<![A-Za-z])(?:{formula_words})(?![A-Za-z])")
        | c.rlike(rf"(?i)\A[^A-Za-z]*(?:{lone_words})[^A-Za-z]*\z")
        | c.rlike(r"[\\{}^_]")
        | c.rlike(r"(?U)\A\d*[A-Za-z]\d*\z")
        | c.rlike(r"(?U)\A(?:[A-Za-z]\s*){1,5}\z")
        | c.rlike(r"(?U)\A[\d\s.,:/+-]+\z")
        | (c.rlike(r"[=+\-*/<>]") & c.rlike(r"[A-Za-z0-9]"))
        | (symbols > F.greatest(F.lit(1), F.floor(F.length(c) / 4)))
    )


def identity(c: Column) -> Column:
    return F.when(has_cjk(c), F.regexp_replace(c, r"(?U)\s+", "")).otherwise(F.trim(F.lower(collapse(c))))


def _keep_best(items: Column) -> Column:
    """Best score per identity; among equals the first.  Items carry (identity, score)."""
    # Sorted by identity, the best of each is the first of its run; then back to the order of scores.
    by_identity = F.array_sort(
        F.transform(items, lambda t, i: F.struct(t["identity"].alias("identity"), (-t["score"]).alias("down"), i.alias("at"), t.alias("t")))
    )
    leading = let(
        by_identity,
        lambda xs: F.filter(xs, lambda x, i: F.coalesce(F.get(xs, i - 1)["identity"] != x["identity"], F.lit(True))),
    )
    ordered = F.array_sort(F.transform(leading, lambda x: F.struct(x["down"], x["at"], x["t"])))
    return F.transform(ordered, lambda x: x["t"])


def _rank(items: Column, k: int) -> Column:
    """Order by score, display length, source text; keep k; drop the score."""
    def shown(t: Column) -> Column:
        return F.when(t["zh"] != "", t["zh"]).otherwise(t["source"])

    ordered = F.array_sort(
        F.transform(
            items,
            lambda t: F.struct(
                (-t["score"]).alias("down"), (-F.length(shown(t))).alias("short"), t["source"].alias("word"), t.alias("t")
            ),
        )
    )
    return F.transform(
        F.slice(ordered, 1, k),
        lambda x: F.struct(*[x["t"][f].alias(f) for f in TERM_FIELDS]),
    )


def _candidate(term: Column, score: Column, latin: bool) -> Column:
    kind_of = latin_kind if latin else concept_kind
    return let(kind_of(term), lambda kb: _candidate_item(term, score + kb["bonus"], kb, latin))


def _candidate_item(term: Column, total: Column, kb: Column, latin: bool) -> Column:
    confidence = F.round(F.least(F.lit(0.95), F.lit(0.48) + total / F.lit(6.0)), 3)
    zh = F.lit("") if latin else F.when(has_cjk(term), F.substring(term, 1, 80)).otherwise(F.lit(""))
    return F.struct(
        F.substring(term, 1, 80).alias("source"),
        zh.alias("zh"),
        kb["kind"].alias("kind"),
        confidence.alias("confidence"),
        F.lit("local").alias("term_source"),
        (F.lower(term) if latin else identity(term)).alias("identity"),
        total.alias("own"),
        # the first ranking counts the bonus a second time
        (total + confidence + kb["bonus"]).alias("score"),
    )


def _counted(items: Column) -> Column:
    """Distinct strings in the order of their first places, as (at, p, n): sorted once, counted by run length."""
    placed = F.array_sort(F.transform(items, lambda p, i: F.struct(p.alias("p"), i.alias("at"))))
    first = lambda xs: F.filter(
        F.transform(xs, lambda x, i: F.when(F.coalesce(F.get(xs, i - 1)["p"] != x["p"], F.lit(True)), F.struct(x["p"].alias("p"), x["at"].alias("at"), i.alias("from")))),
        lambda x: x.isNotNull(),
    )
    sized = lambda xs: let(first(xs), lambda runs: F.transform(
        runs, lambda r, i: F.struct(r["at"].alias("at"), r["p"].alias("p"), (F.coalesce(F.get(runs, i + 1)["from"], F.size(xs)) - r["from"]).alias("n"))
    ))
    return F.array_sort(let(placed, sized))


def _latin_candidates(text: Column) -> Column:
    phrases = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z][A-Za-z0-9-]*){0,2}\b"), F.lit(0)),
            clean_latin_phrase,
        ),
        lambda p: p != "",
    )
    scored = F.transform(
        _counted(phrases),
        lambda x: F.struct(
            x["p"].alias("p"),
            (F.lit(0.7) + F.least(x["n"], F.lit(4)) * F.lit(0.25) + F.least(count_of(x["p"], "[A-Za-z]+"), F.lit(3)) * F.lit(0.15)).alias("s"),
        ),
    )
    # counted in its first cleaned form; a second pass settles phrases that end in two lone letters
    settled = F.transform(scored, lambda x: F.struct(clean_latin_phrase(x["p"]).alias("p"), x["s"].alias("s")))
    return F.transform(F.filter(settled, lambda x: valid_latin_phrase(x["p"])), lambda x: _candidate(x["p"], x["s"], True))


def _looks_like_concept(term: Column) -> Column:
    return has_cjk(term) & (
        term.rlike(_one_of([n for n, _, _ in fv.CONCEPTS]))
        | (
            (F.length(term) >= 4)
            & ~term.rlike(f"\\A[{fv.CJK_BAD_STARTS}]")
            & term.rlike("|".join(fv.CJK_MARKERS))
        )
    )


def _cjk_candidates(text: Column) -> Column:
    names = F.expr("array(" + ", ".join(f"'{n}'" for n, _, _ in fv.CONCEPTS if not n.isascii()) + ")")

    def of_block(raw: Column) -> Column:
        return let(clean_key_term(raw), of_cleaned)

    def of_cleaned(block: Column) -> Column:
        whole = F.filter(names, lambda n: block.contains(n))
        longest = F.least(F.lit(8), F.length(block))
        grams = F.when(
            F.length(block) >= 2,
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), longest),
                    lambda n: F.transform(
                        F.sequence(F.lit(1), F.length(block) - n + 1), lambda i: clean_key_term(F.substring(block, i, n))
                    ),
                )
            ),
        ).otherwise(F.array().cast("array<string>"))
        found = F.array_distinct(F.concat(whole, F.filter(grams, _looks_like_concept)))
        ordered = F.array_sort(
            F.transform(
                found,
                lambda t: F.struct(
                    (-concept_kind(t)["bonus"]).alias("b"), (-F.length(t)).alias("n"), t.alias("t")
                ),
            )
        )
        return F.transform(ordered, lambda x: x["t"])

    blocks = F.regexp_extract_all(text, F.lit(r"[一-鿿]{2,24}"), F.lit(0))
    terms = F.filter(F.flatten(F.transform(blocks, of_block)), lambda t: (t != "") & valid_key_term(t))
    return F.transform(terms, lambda t: _candidate(t, F.lit(1.0), False))


def _concept_candidates(text: Column, ascii_only: bool) -> Column:
    """Concepts named in the text; their score holds the concept's bonus once more."""
    def row(name: str, kind: str, bonus: float) -> dict:
        own = bonus + 1.0 + bonus
        confidence = round(min(0.95, 0.48 + own / 6.0), 3)
        return {
            "source": name, "zh": "" if name.isascii() else name, "kind": kind, "confidence": confidence,
            "term_source": "local", "identity": name, "own": own, "score": own + confidence + bonus,
        }

    rows = _constants([row(*c) for c in fv.CONCEPTS if c[0].isascii() or not ascii_only])
    return let(F.lower(text), lambda low: F.filter(rows, lambda x: low.contains(x["source"])))


def _best_by_own(items: Column) -> Column:
    """One candidate per identity by its own score, the first among equals."""
    as_scored = F.transform(items, lambda t: t.withField("final", t["score"]).withField("score", t["own"]))
    return F.transform(_keep_best(as_scored), lambda t: t.withField("score", t["final"]))


# --- the same for texts of Latin letters only ---------------------------------
# Most chunks hold no ideograph, and their phrases are words between single blanks: a loop over words then
# does what the expressions above do with a dozen patterns per phrase.

_LATIN_TEXT = re.compile("[\\0-\u017f]*")
_LETTER = "A-Za-z0-9_ªµºÀ-ÖØ-öø-\u017f"
_LATIN_PHRASE = re.compile(rf"(?<![{_LETTER}])[A-Za-z][A-Za-z0-9]*(?: [A-Za-z][A-Za-z0-9]*){{0,2}}(?![{_LETTER}])")
_LETTERS, _DIGIT = re.compile("[A-Za-z]+"), re.compile("[0-9]")
_STOP_SET, _NOISE_SET = frozenset(fv.TERM_STOPWORDS), frozenset(_NOISE_WORDS)
_FORMULA_SET = frozenset(fv.FORMULA_WORDS)
_LONE_SET = _FORMULA_SET | frozenset(fv.FORMULA_LONE_WORDS)
_LATIN_CONCEPTS = [(n, kind, float(bonus)) for n, kind, bonus in fv.CONCEPTS if n.isascii()]


def _latin_words(words: list[str]) -> list[str]:
    """``clean_latin_phrase`` on the words of a phrase."""
    a, b = 0, len(words) - (len(words) > 1 and len(words[-1]) == 1)
    while a < b and words[a].lower() in _STOP_SET:
        a += 1
    while a < b and words[b - 1].lower() in _STOP_SET:
        b -= 1
    return words[a:b]


def _valid_latin(low: str) -> bool:
    """``valid_latin_phrase`` of a cleaned phrase in lower case."""
    runs = _LETTERS.findall(low)
    letters = sum(map(len, runs))
    lettered = letters + low.count(" ") == len(low)  # no digits
    if len(low) < 2 or (lettered and letters <= 5) or not _FORMULA_SET.isdisjoint(runs):
        return False
    if len(runs) > 1:
        return True
    return letters > 1 and runs[0] not in _LONE_SET and low not in _NOISE_SET


@cache
def _latin_scores(n: int, runs: int, bonus: float) -> tuple[float, float, float]:
    """(own score, confidence, score of the first ranking); the arithmetic of ``_candidate_item``."""
    own = 0.7 + min(n, 4) * 0.25 + min(runs, 3) * 0.15 + bonus
    exact = Decimal(repr(min(0.95, 0.48 + own / 6.0)))
    confidence = float(exact.quantize(Decimal("0.001"), ROUND_HALF_UP))
    return own, confidence, own + confidence + bonus


def _latin_kind(low: str, concepts: list[tuple[str, str, float]]) -> tuple[str, float]:
    for scale, test in ((1.0, low.__eq__), (0.65, low.__contains__)):
        for name, kind, bonus in concepts:
            if test(name):
                return kind, bonus * scale
    return "term", 0.0


def latin_terms(text: str | None, k: int) -> list[tuple[str, str, float]] | None:
    """(source, kind, confidence) of the top-k terms of a cleaned text; null beyond Latin letters."""
    if text is None or not _LATIN_TEXT.fullmatch(text):
        return None
    low_text = text.lower()
    named = [c for c in _LATIN_CONCEPTS if c[0] in low_text]
    best: dict[str, tuple] = {}  # identity -> own score, then the order of the ranking
    for name, kind, bonus in named:
        own = bonus + 1.0 + bonus
        confidence = round(min(0.95, 0.48 + own / 6.0), 3)
        best[name] = own, -(own + confidence + bonus), -len(name), name, kind, confidence
    counts = Counter(" ".join(_latin_words(p.split(" "))) for p in _LATIN_PHRASE.findall(text))
    counts.pop("", None)
    digits = _DIGIT.search(text)
    kind, bonus = "term", 0.0
    for phrase, n in counts.items():
        # counted in its first cleaned form; a second pass settles phrases that end in two lone letters
        settled = phrase if phrase[-2:-1] != " " else " ".join(_latin_words(phrase.split(" ")))
        low = settled.lower()
        if named:
            kind, bonus = _latin_kind(low, named)
        runs = len(_LETTERS.findall(phrase)) if digits else phrase.count(" ") + 1
        own, confidence, score = _latin_scores(min(n, 4), min(runs, 3), bonus)
        held = best.get(low)
        if held is None or own > held[0]:
            best[low] = own, -score, -min(len(settled), 80), settled[:80], kind, confidence
    # whether a term is valid depends on its identity alone, so few need the test
    ranked = sorted((x[1:], low) for low, x in best.items())
    valid = ((source, kind, confidence) for (_, _, source, kind, confidence), low in ranked if _valid_latin(low))
    return list(islice(valid, k))


def _latin_top(k: int) -> Callable[[Column], Column]:
    @F.arrow_udf(f"array<{TERM_TYPE}>")
    def run(texts: pa.Array) -> pa.Array:
        found = [latin_terms(t, k) for t in texts.to_pylist()]
        items = [x for xs in found if xs for x in xs]
        source, kind, confidence = zip(*items) if items else ((), (), ())
        same = lambda v: pa.array([v] * len(items), pa.string())
        fields = [pa.array(source, pa.string()), same(""), pa.array(kind, pa.string()), pa.array(confidence, pa.float64()), same("local")]
        ends, offsets = 0, [0]
        for xs in found:
            ends += len(xs or ())
            offsets.append(ends)
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, TERM_FIELDS), mask=pa.array([xs is None for xs in found]))

    return run


def extract_key_terms(retrieval_text: Column, k: int = fv.MAX_KEY_TERMS) -> Column:
    """Top-k key terms of a chunk as ARRAY<struct source, zh, kind, confidence, term_source>.

    Not for use inside a lambda: texts of Latin letters go through Arrow, the others through ``key_terms_of_any``.
    """
    return F.coalesce(_latin_top(k)(clean_for_retrieval(retrieval_text)), key_terms_of_any(retrieval_text, k))


def key_terms_of_any(retrieval_text: Column, k: int = fv.MAX_KEY_TERMS) -> Column:
    """``extract_key_terms`` by expressions alone, for texts of any script."""
    return let(clean_for_retrieval(retrieval_text), lambda text: _terms_of(text, k))


def _terms_of(text: Column, k: int) -> Column:
    latin = F.concat(_concept_candidates(text, True), _latin_candidates(text))
    mixed = F.concat(_concept_candidates(text, False), _latin_candidates(text), _cjk_candidates(text))
    # the n-gram search is only entered for rows that hold ideographs
    return F.when(has_cjk(text), _rank(_best_by_own(mixed), k)).otherwise(_rank(_best_by_own(latin), k))


def _sided(items: Column) -> Column:
    """Items as (s, z, t): source and zh form cleaned, blank where invalid; dropped when both are."""
    def clean_side(c: Column) -> Column:
        return let(
            clean_key_term(F.coalesce(c, F.lit(""))),
            lambda cleaned: F.when(valid_key_term(cleaned), cleaned).otherwise(F.lit("")),
        )

    return F.filter(
        F.transform(items, lambda t: F.struct(clean_side(t["source"]).alias("s"), clean_side(t["zh"]).alias("z"), t.alias("t"))),
        lambda x: (x["s"] != "") | (x["z"] != ""),
    )


def normalize_terms(items: Column, default_source: str) -> Column:
    """Clean terms from outside (source, zh, kind, confidence, term_source), filling confidence and kind."""
    sided = _sided(items)

    def shape(x: Column) -> Column:
        s, z, t = x["s"], x["z"], x["t"]
        return let(concept_kind(F.when(z != "", z).otherwise(s)), lambda kb: shape_with(s, z, t, kb))

    def shape_with(s: Column, z: Column, t: Column, kb: Column) -> Column:
        any_source = F.when(s != "", s).otherwise(z)
        origin = F.when(strip(t["term_source"]) != "", strip(t["term_source"])).otherwise(F.lit(default_source))
        base = F.when(origin == "llm", F.lit(0.76)).otherwise(F.lit(0.62))
        confidence = F.coalesce(t["confidence"], F.least(F.lit(0.95), base + kb["bonus"] / 10))
        kind = F.when(strip(t["kind"]) != "", strip(t["kind"])).otherwise(kb["kind"])
        return F.struct(
            F.substring(any_source, 1, 80).alias("source"),
            F.substring(F.when(has_cjk(any_source), F.when(z != "", z).otherwise(s)).otherwise(z), 1, 80).alias("zh"),
            kind.alias("kind"),
            F.round(F.greatest(F.lit(0.0), F.least(confidence, F.lit(0.98))), 3).alias("confidence"),
            F.when(origin.isin("local", "llm"), origin).otherwise(F.lit(default_source)).alias("term_source"),
        )

    return F.transform(sided, shape)


def rank_terms(items: Column, k: int = fv.MAX_KEY_TERMS) -> Column:
    """Merge normalized terms: score = confidence + bonus, best per identity, top k."""
    def scored(x: Column) -> Column:
        s, z, t = x["s"], x["z"], x["t"]
        shown = F.when(z != "", z).otherwise(s)
        any_source = F.when(s != "", s).otherwise(z)
        confidence = F.when(F.coalesce(t["confidence"], F.lit(0.0)) != 0, t["confidence"]).otherwise(F.lit(0.55))
        return let(
            concept_kind(shown),
            lambda kb: F.struct(
                F.substring(any_source, 1, 80).alias("source"),
                F.substring(F.when(has_cjk(any_source), F.when(z != "", z).otherwise(s)).otherwise(z), 1, 80).alias("zh"),
                F.when(t["kind"] != "", t["kind"]).otherwise(kb["kind"]).alias("kind"),
                F.round(F.greatest(F.lit(0.0), F.least(confidence, F.lit(0.98))), 3).alias("confidence"),
                F.coalesce(t["term_source"], F.lit("local")).alias("term_source"),
                identity(shown).alias("identity"),
                (confidence + kb["bonus"]).alias("score"),
            ),
        )

    return _rank(_keep_best(F.transform(_sided(items), scored)), k)


def rerank_extracted(items: Column, k: int = fv.MAX_KEY_TERMS) -> Column:
    """``rank_terms`` for the output of ``extract_key_terms``: already clean, valid and distinct, so only the order changes."""
    def scored(t: Column) -> Column:
        shown = F.when(t["zh"] != "", t["zh"]).otherwise(t["source"])
        return t.withField("score", t["confidence"] + concept_kind(shown)["bonus"])

    return _rank(F.transform(items, scored), k)


def _usable_form(c: Column) -> Column:
    """The cleaned form of a term's side, blank where invalid.  For words of two letters or more, as most terms are, few of the tests can fire."""
    def plain(t: Column) -> Column:
        return let(_trim_stopwords(t), lambda x: F.when(valid_latin_phrase(x), x).otherwise(F.lit("")))

    def other(t: Column) -> Column:
        return let(clean_key_term(t), lambda x: F.when(valid_key_term(x), x).otherwise(F.lit("")))

    words = r"\A[A-Za-z]{2,}(?: [A-Za-z]{2,})*\z"
    return let(F.coalesce(c, F.lit("")), lambda t: F.when(t == "", t).when(t.rlike(words), plain(t)).otherwise(other(t)))


def usable_terms(items: Column, least: float = 0.45) -> Column:
    """Source and zh forms of the trusted terms, cleaned, valid, distinct in order."""
    trusted = F.filter(items, lambda t: t["confidence"].isNull() | (t["confidence"] >= least))
    forms = F.flatten(F.transform(trusted, lambda t: F.array(_usable_form(t["source"]), _usable_form(t["zh"]))))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def term_labels(items: Column, n: int = 5) -> Column:
    source = lambda t: F.coalesce(t["source"], F.lit(""))
    zh = lambda t: F.coalesce(t["zh"], F.lit(""))
    labels = F.transform(
        items,
        lambda t: F.when(
            (zh(t) != "") & (source(t) != "") & (zh(t) != source(t)), F.concat(source(t), F.lit(" / "), zh(t))
        ).otherwise(F.when(source(t) != "", source(t)).otherwise(zh(t))),
    )
    return F.slice(F.filter(labels, lambda x: x != ""), 1, n)
