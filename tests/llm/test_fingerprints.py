"""Fingerprints of documents against plain Python: edited texts, and classes within the radius against all pairs."""

import hashlib
import random

import pytest

from coursemine.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, fingerprint string, part int"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubdkmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def expected(rows):
    """In falling order of the ids; the ids are distinct here."""
    of = fp.Hasher()
    rows = sorted(((k, t or "") for k, t in rows), reverse=True)
    out = {}
    for i, (k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        changed = text[:len(text) - n] + after[:n]
        a, b, c = of(text), of(changed), of(after)
        out[k] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), fp.likeness(a, b), fp.likeness(a, c))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = [(i * 3, prose(rng, rng.randint(1, 120))) for i in range(150)]
    rows += [(1, None), (2, ""), (4, " \n "), (5, "é" * 40 + " Wörter ÀÉ"), (7, prose(rng, 30_000)), (8, rows[3][1]), (10, "one")]
    return rows


def test_edited_texts(spark, corpus):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in corpus], SCHEMA).repartition(7)
    got = {r[0]: tuple(r)[1:] for r in fp.edited(docs).collect()}
    assert got == expected(corpus)


def test_ties_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "x y z x y z"), (3, "x y z x y z"), (3, "other words")]
    docs = spark.createDataFrame([(k, t, "", 0) for k, t in rows], SCHEMA)
    got = fp.edited(docs).collect()
    assert sorted((r[0] is None, r[0] or 0, r["n_chars"]) for r in got) == sorted((k is None, k or 0, len(t)) for k, t in rows)
    assert {r["fingerprint"] for r in got if r["n_chars"] == 5} == {fp.Hasher()("a b c").hex()}
    only = fp.edited(docs.filter("text = 'other words'")).first()
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256(b"other wooth").hexdigest()
    assert fp.edited(docs.filter("false")).collect() == []


def flipped(rng, value, n):
    for at in rng.sample(range(fp.BITS), n):
        value ^= 1 << at
    return value


@pytest.mark.parametrize("part", [fp.PART, 7])
def test_classes_equal_all_pairs(spark, monkeypatch, part):
    """Chains and groups on both sides of the radius, whole and with runs cut into parts that meet pairwise."""
    monkeypatch.setattr(fp, "PART", part)
    rng = random.Random(9)
    values = []
    for _ in range(12):
        at = rng.getrandbits(fp.BITS)
        for _ in range(rng.randint(1, 25)):
            values.append(at)
            at = flipped(rng, at, rng.choice([0, 3, 7, 8, 9, 10]))
    rows = [(i, f"{v:0{fp.BITS // 4}x}") for i, v in enumerate(values)] + [(None, f"{values[0]:0{fp.BITS // 4}x}")]
    label = list(range(len(values)))
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if (a ^ b).bit_count() <= fp.RADIUS and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    prints = spark.createDataFrame(rows, "doc_id bigint, fingerprint string")
    got = {r["fingerprint"]: r["class_id"] for r in fp.classes(prints).collect()}
    assert got == {p: label[i] for i, p in rows if i is not None}
    assert fp.classes(prints.filter("false")).collect() == []


def test_fingerprint_column_equals_the_hasher(spark, corpus):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in corpus], SCHEMA)
    of = fp.Hasher()
    got = {r[0]: r[1] for r in docs.select("doc_id", fp.fingerprint(docs["text"])).collect()}
    assert got == {k: of(t or "").hex() for k, t in corpus}
    assert of("") == bytes(fp.BITS // 8) and of("A b  C") == of("a B\tc")
