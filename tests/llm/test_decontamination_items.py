"""Short items, items of numbers, other ways to write numbers, names at sentence starts and in lower case."""

import random

import pytest

from coursemine.llm import decontamination

ITEMS = [
    (1, "Who wrote Faust?"),
    (2, "Compute 3 + 4 + 5 km minus 17 km and 6 km by 12."),
    (3, "A baker sells three loaves on the first morning and seven loaves later that long day."),
    (4, "A parcel of 5kg leaves at 9am and another parcel of 7kg arrives on the 2nd floor."),
    (5, "Alice has 5 apples. Bob has 3. Carol eats 2."),
    (6, "When did Marie Curie and Lise Meitner and Emmy Noether and Ada Lovelace first meet Otto Hahn?"),
]


@pytest.mark.parametrize("text, items", [
    ("Before it. Who wrote Faust? After it.", [1]), ("who wrote it", []),
    ("Well: compute 3 + 4 + 5 km minus 17 km and 6 km by 12.", [2]), ("Compute 31 + 41 + 9 km minus 2 km and 8 km by 77.", []),
    ("A baker sells four loaves on the first morning and nine loaves later that long day.", [3]),
    ("A parcel of 8 kg leaves at 6pm and another parcel of 4lb arrives on the 3rd floor.", [4]),
    ("Dora has 7 apples. Emil has 4. Fritz eats 1.", [5]),
    ("when did marie curie and lise meitner and emmy noether and ada lovelace first meet otto hahn?", [6]),
    ("Nothing of the kind stands here. It was 5 o'clock. Bob had gone.", []),
])
def test_items_are_found(spark, text, items):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert decontamination.contaminations(docs, bench).first()["items"] == items


@pytest.mark.parametrize("text, items", [
    ("Before.\nParis\nAfter it.", [10]), ("We went to Paris in May.", []), ("paris\n", [10]), ("otto hahn", [11]), ("Otto Hahn", [11]), ("Emil Berg", []), ("Otto Hahn spoke.", []),
    ("x\n17\ny", [12]), ("x\n18\ny", []),
])
def test_items_of_a_word_or_two_are_found_as_lines(spark, text, items):
    bench = spark.createDataFrame([(10, "Paris"), (11, "Otto Hahn"), (12, "17"), (13, ""), (14, None), (15, "...")], "item_id int, text string")
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.contaminations(docs, bench).collect()}
    assert got == {1: items, 2: [], 3: []}


# ---- against a comparison of every item with every document at every shift ----

def canonical(text, reading):
    """(code, value, word) of the template tokens: a plain reading of the rules, token by token."""
    out, start, last = [], True, None
    for line in text.split("\n"):
        for token in line.split():
            core = token.strip(decontamination.EDGES)
            low = core.lower()
            if core:
                if low[0].isdigit() or low in decontamination.NUMBER_WORDS:
                    code = "NUM"
                elif low in decontamination.UNITS:
                    code = "UNIT"
                elif core[0].isupper() and (len(core) == 1 or not core.isupper()) and (reading == 1 or reading == 0 and not start):
                    code = "NAME"
                else:
                    code = low
                if not (code == "NAME" and last == "NAME"):
                    out.append((code, low, core.lower()))
                last = code
            else:
                last = None
            start = token[-1] in ".!?:"
        start, last = True, None
    return out


PLACEHOLDERS = ("NUM", "UNIT", "NAME")


def contaminated(text, item):
    for item_reading in range(3):
        a = canonical(item, item_reading)
        w = min(6, len(a))
        for reading in range(2):
            b = canonical(text, reading)
            covered = set()
            for shift in range(-len(a), len(b)):
                at, pairs = [], set()
                for q in range(len(a) - w + 1):
                    if 0 <= q + shift <= len(b) - w:
                        x, y = a[q:q + w], b[q + shift:q + shift + w]
                        few = lambda z: sum(c[0] not in PLACEHOLDERS for c in z) < min(3, w)
                        equal = [c[1] for c in x] == [c[1] for c in y] if few(x) and few(y) else not few(x) and not few(y) and [c[0] for c in x] == [c[0] for c in y]
                        if equal:
                            at.append(q)
                            pairs |= {(c[2], d[2]) for c, d in zip(x, y) if c[0] in PLACEHOLDERS}
                if at and (not pairs or len({p for p, _ in pairs}) / len(pairs) >= 0.8):
                    covered |= {q + k for q in at for k in range(w)}
            if len(covered) >= 0.5 * len(a):
                return True
    return False


def test_equals_brute_force(spark):
    rng = random.Random(2)
    plain = "the a cat river walks under green bridge and sells old maps near every market while birds sing over quiet hills".split()
    pick = lambda: rng.choice(plain) if rng.random() < 0.7 else rng.choice([str(rng.randint(1, 40)), "Anna", "Bruno Klee", "km", "kg", "seven"])
    items = [" ".join(pick() for _ in range(rng.randint(4, 22))) + "." for _ in range(25)]
    docs = []
    for i in range(120):
        words = rng.choice(items).split()
        words = words[rng.randint(0, len(words) // 2):] if i % 3 else words
        same = {w: str(rng.randint(1, 99)) for w in words}
        words = [same[w] if w.isdigit() and i % 2 else "Carla" if w == "Anna" and i % 5 == 0 else w for w in words]
        if i % 7 == 0:
            words[rng.randrange(len(words))] = "elsewhere"
        docs.append("\n".join(" ".join(pick() for _ in range(rng.randint(0, 12))) + x for x in (".", " " + " ".join(words), "")))
    want = {i: [k for k, t in enumerate(items) if contaminated(d, t)] for i, d in enumerate(docs)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = decontamination.contaminations(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3), bench).collect()
    assert {r["doc_id"]: r["items"] for r in got} == want
    assert 20 < sum(bool(v) for v in want.values()) < 120
