"""Spelling variants against a comparison of all pairs of words."""

import random
from collections import Counter

import pytest

from coursemine.llm import spelling as sp

SCHEMA = "doc_id bigint, text string, word string, n int"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def expected(rows):
    counts = Counter(w for k, t in rows for w in sp.occurrences(k, t))
    n = {w: c for w, c in counts.items() if c >= 2}
    partners = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in partners.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(partners[w]), form.get(w), n.get(form.get(w)), root)
    return out


def variants(docs):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in sp.variants(docs).collect()}


def corpus(seed=5):
    """Few letters, so that words have many neighbours, chains of forms and repeated letters; frequencies over four powers of ten."""
    rng = random.Random(seed)
    letters = "aabéÿ"
    words = set()
    for _ in range(60):
        w = [rng.choice(letters) for _ in range(rng.randint(7, 10))]
        for _ in range(rng.randint(0, 14)):
            words.add("".join(w))
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[at:at + (kind > 0)] = [rng.choice(letters)] if kind < 2 else []
    words = sorted(w for w in words if len(w) >= 7)
    rows, k = [], 0
    for w in words:
        for _ in range(rng.choice([1, 2, 3, 20, 40])):
            rows.append((k, f"{w.upper() if w.isascii() else w}, {w}; short"))
            k += 1
        if rng.random() < 0.1:
            rows.append((k, " ".join([w] * 300)))
            k += 1
    # a chain: the last is near the second only
    return rows + [(k, "kastanie " * 900), (k + 1, "kastanje " * 50), (k + 2, "kastanjx " * 4)]


@pytest.mark.parametrize("part", [sp.PART, 5])
def test_equals_all_pairs(spark, monkeypatch, part):
    """Whole, and with the words of one half cut into parts."""
    monkeypatch.setattr(sp, "PART", part)
    rows = corpus()
    want = expected(rows)
    assert sum(v[2] is not None for v in want.values()) > 30 and any(v[2] not in (None, v[4]) for v in want.values())
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA).repartition(6)
    assert variants(docs) == want


def test_nulls_empty_texts_ties_and_long_runs(spark):
    long = "x" * 3000
    rows = [(None, "Planeta planeta"), (None, "Planeta planeta"), (1, None), (2, ""), (3, "12 345 -- "), (4, f"{long} {long}y {long}y {long}")]
    rows += [(10 + i, "kontrast kontrass kontrasz") for i in range(11)] + [(30, "kontrasx kontrasx")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    want = expected(rows)
    assert variants(docs) == want
    assert sp.variants(docs.filter("false")).collect() == []
    assert sp.variants(docs.filter("text is null or text = ''")).collect() == []


def test_index_finds_what_it_holds():
    words = ["ananasa", "bananas", "bananan", "panamas"]
    points, lengths = sp._matrix(words, backwards=False)
    index = sp.FmIndex(points, lengths)
    asked, n = sp._matrix(["xananas", "bananxs", "bananas"], backwards=False)
    rows, found = sp._one_error(index, asked, n, 7)
    assert {(int(r), words[f]) for r, f in zip(rows, found)} == {(0, "bananas"), (1, "bananas")}
