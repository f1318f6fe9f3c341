"""Near copies are decided by the Jaccard similarity of their five-word shingles."""

import random

import pytest

from coursemine.llm import simhash


def words(rng, n):
    return ["".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def similarity(a, b):
    x, y = (set(simhash.shingles(t, 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_links_follow_the_similarity(spark):
    """Scattered edits, and passages put in at one place, on both sides of 0.8."""
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(240):
        a = words(rng, 250)
        b = list(a)
        if i % 2:
            for at in rng.sample(range(250), rng.randint(3, 9)):
                b[at] = "edited"
        else:
            b[100:100] = words(rng, rng.randint(40, 90))
        pair = " ".join(a), " ".join(b)
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
        want |= {2 * i} | ({2 * i + 1} if similarity(*pair) < 0.8 else set())
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert 300 < len(want) < 420
    assert kept == want


def edited_group(rng, size, shared):
    """Copies of one text of which any two have about ``shared`` in common: each has edits of its own."""
    base = words(rng, 400)
    edits = round(400 * (1 - (2 * shared / (1 + shared)) ** 0.5) / 5 * 1.09)
    rows = []
    for i in range(size):
        t = list(base)
        for at in rng.sample(range(400), edits):
            t[at] = f"e{i}x{at}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("shared", [0.55, 0.8, 0.95])
def test_pairs_of_a_group_stay_in_proportion(spark, shared):
    """What leaves the shards per document does not grow with the group, and the result is that of all pairs."""
    per_document = []
    for size in (150, 600):
        rng = random.Random(size)
        rows = edited_group(rng, size, shared)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        made = []
        judged = simhash.candidates
        simhash.candidates = lambda *a, **b: made.append(simhash.cut(judged(*a, **b))) or made[-1]
        try:
            kept = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
        finally:
            simhash.candidates = judged
        per_document.append(sum(m.count() for m in made) / size)
        if size == 150:
            sets = [simhash.shingle_set(t) for _, t in rows]
            group = list(range(size))
            for i in range(size):
                for j in range(i):
                    if group[i] != group[j] and simhash.jaccard(sets[i], sets[j]) >= 0.8:
                        group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
            assert kept == set(group)
    assert per_document[1] < 24 and per_document[1] < 2 * per_document[0] + 1


def test_groups_of_many_doubtful_pairs(spark, monkeypatch):
    """Pairs put off and pairs refused leave the result as if all had been compared."""
    monkeypatch.setattr(simhash, "DOUBTFUL", 1)
    rng = random.Random(8)
    base, rows = words(rng, 200), []
    for i in range(40):
        t = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 6])):
            t[at] = f"edit{i}"
        rows.append((i, " ".join(t)))
    group = list(range(40))
    for i, a in rows:
        for j, b in rows[:i]:
            if similarity(a, b) >= 0.8:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(group) and 1 < len(kept) < 40
