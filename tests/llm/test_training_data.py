"""The training-data operators against plain Python on small tables, and their corner cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from coursemine.llm import (
    components, decontamination, html_extraction, language_id, language_model, licenses, line_dedup, mixing,
    quality_classifier, quality_rules, simhash,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in "ba co du fi gal hem jon kur lam".split() for b in "ta ne si por dal mek".split()]


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", rng.choice(WORDS)])
        out.append(w + rng.choice(["", "", "", ".", ".\n"]))
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [prose(rng, rng.choice([3, 25, 80, 200])) for _ in range(60)]
    near = [" ".join("changed" if i == 40 else w for i, w in enumerate(t.split(" "))) for t in base if len(t.split(" ")) > 60]
    common = [f"Shared line here\n{prose(rng, 30)}" for _ in range(12)]
    odd = [None, "", "   ", "\n\n", "é", "A" * 50_000, "x y " * 20_000, base[3], base[3]]
    return base + near + common + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ["a", "b", None, ""][i % 4], 0) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None), (3, texts[3], "en", "b", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with columns of names that operators use for their own."""
    for name in ("host", "kept", "row", "key", "h1", "shard", "fp", "node", "size", "n", "copies", "block", "items", "score", "id", "h"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def words(t):
    return (t or "").encode().split()


# ---- 1 ----

def line_key(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))


def without_frequent(texts, threshold=10):
    n = collections.Counter(k for t in texts for k in {line_key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if not line_key(x) or n[line_key(x)] < threshold) for t in texts]


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup_by_either_way(spark, docs, broadcast):
    index = line_dedup.LineIndex(spark, shard_keys=64).insert(docs)
    rows = line_dedup.split_lines(clashing(docs), index, broadcast_bytes=broadcast).select("doc_id", "text", "__kept").collect()
    want = without_frequent([r["text"] for r in rows])
    assert [r["__kept"] for r in rows] == want
    assert sum((r["text"] or "") != k for r, k in zip(rows, want)) >= 12


def test_line_index_is_reversible(spark):
    text = lambda i: f"line {i}\nall\neven" if i % 2 == 0 else f"line {i}\nall"
    table = lambda ids: spark.createDataFrame([(i, text(i)) for i in ids], "doc_id bigint, text string")
    index = line_dedup.LineIndex(spark, threshold=5, shard_keys=8).insert(table(range(8)))
    dropped = lambda ids: {x for r in line_dedup.split_lines(table(ids), index).collect() for x, d in zip(r["text"].split("\n"), r["__drop"]) if d}
    assert dropped(range(8)) == {"all"}
    index.insert(table(range(8, 12)))
    assert dropped(range(12)) == {"all", "even"}
    index.delete(table([0, 2, 4, 6, 8]))
    assert dropped([1, 3, 10]) == {"all"}
    index.delete(table([1, 3, 5]))
    assert dropped([7, 9, 11, 10]) == set()
    again = line_dedup.LineIndex(spark, threshold=5, shard_keys=8).insert(table([7, 9, 10, 11]))
    assert sorted(map(tuple, index.counts().collect())) == sorted(map(tuple, again.counts().collect()))


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(-2**62, 2**62, (2, 5000))
    slots = line_dedup.empty_filter(5000)
    assert line_dedup.insert(slots, h1, h2) and line_dedup.contains(slots, h1, h2).all()
    line_dedup.delete(slots, h1[:2500], h2[:2500])
    assert line_dedup.contains(slots, h1[2500:], h2[2500:]).all()
    assert line_dedup.contains(slots, h1[:2500], h2[:2500]).mean() < 0.01
    full = np.zeros((4, 4), np.uint16)
    assert not line_dedup.insert(full, h1[:40], h2[:40])


# ---- 2 ----

def test_language_model_counts_and_normalization(spark, docs):
    train = docs.filter(~language_model.held_out())
    model = language_model.train(train)
    rows = language_model.score(clashing(docs), model).collect()
    tokens = lambda t: [w.lower() for w in words(t)] + [None]
    known = collections.Counter(w for r in train.collect() for w in tokens(r["text"]))
    n, v = sum(known.values()), len(known)
    assert model.train_tokens == n and len(rows) == docs.count()
    want = sorted((len(t), sum(known[w] > 0 for w in t), round(sum(math.log10((known[w] + 1) / (n + v + 1)) for w in t), 6)) for r in docs.collect() for t in [tokens(r["text"])])
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in rows)


def test_predictive_probabilities_sum_to_one(spark, docs, monkeypatch):
    """In every context, over the words it has had, all others and the unknown one; hot words are cut into slices as well."""
    monkeypatch.setattr(language_model, "SHARD", 600)
    model = language_model.train(docs)
    assert model.totals.hot_counts
    samples, unpack = model.samples, language_model.unpack
    of_word, seen, seen_parents = {}, collections.defaultdict(float), collections.defaultdict(float)
    for r in model.shards.collect():
        words = unpack(r["words"], "<u8").tolist()
        parents = unpack(r["parents"], "<f4").astype(float).reshape(len(samples), -1)
        of_word |= dict(zip(words, parents.T))
        for a, k, log in zip(unpack(r["word"]), unpack(r["context"]), unpack(r["logs"], "<f4").astype(float)):
            seen[k] += 10.0 ** log
            seen_parents[k] = seen_parents[k] + parents[:, a]
    unseen = np.array([g.unseen() for g in samples])
    everything = sum(of_word.values()) + unseen
    assert np.abs(everything - 1).max() < 1e-4
    for k, total in seen.items():
        rest = language_model.back_off(samples, np.array([k]), (everything - seen_parents[k])[:, None])[0]
        assert abs(total + rest - 1) < 1e-3


def test_contexts_are_the_words_themselves(spark, docs, monkeypatch):
    """Every previous word has a restaurant of its own, whether its totals are sent out or joined, and scores follow from these."""
    monkeypatch.setattr(language_model, "COMMON", 8)
    monkeypatch.setattr(language_model, "SHARD", 600)
    train = docs.filter(~language_model.held_out())
    model = language_model.train(train)
    unpack, layout, samples = language_model.unpack, model.totals.layout, model.samples
    hashed = lambda w: int(language_model.pd.util.hash_array(np.array([w], object), categorize=False)[0])
    cut_up = lambda t: [w.lower() for w in words(t)]
    follow, types = collections.Counter(), collections.defaultdict(set)
    for r in train.collect():
        t = cut_up(r["text"])
        for a, b in zip([" start", *t], [*t, " end"]):
            follow[hashed(a)] += 1
            types[hashed(a)].add(b)
    rare = collections.defaultdict(dict)
    of_parts = model.contexts.collect()
    lists = {r["part"]: language_model.unpack_hashes(r["contexts"]).tolist() for r in of_parts if r["number"] == 0}
    for r in of_parts:
        for i, k in enumerate(lists[r["part"]]):
            rare[k].update({(r["number"], c): int(unpack(r[c])[i]) for c in ("customers", "tables") if r[c] is not None})
    common = dict(zip(layout.common.tolist(), layout.number.tolist())) | {int(language_model.START[0]): 0}
    assert 1 <= layout.span <= 8 and not set(common) & set(rare) and set(common) | set(rare) >= set(follow)
    last = language_model.ROUNDS + language_model.SAMPLES
    numbers = range(last - len(samples) + 1, last + 1)
    for k, n in follow.items():
        assert n == (samples[0].customers[common[k]] if k in common else rare[k][0, "customers"])
        for g, number in zip(samples, numbers):
            tables = g.tables[common[k]] if k in common else rare[k][number, "tables"]
            assert len(types[k]) <= tables <= n
    # probabilities of all pairs, and of words that a context has not had, from the same totals
    pair, parent = {}, {}
    for r in model.shards.collect():
        own, others = unpack(r["words"], "<u8").tolist(), language_model.unpack_hashes(r["rare"]).tolist()
        parent |= dict(zip(own, unpack(r["parents"], "<f4").astype(float).reshape(len(samples), -1).T))
        name = {i: k for k, i in common.items()} | {layout.span + i: k for i, k in enumerate(others)}
        for a, k, log in zip(unpack(r["word"]), unpack(r["context"]).tolist(), unpack(r["logs"], "<f4").astype(float)):
            pair[name[k], own[a]] = log
    unseen = np.array([g.unseen() for g in samples])

    def log_p(k, w):
        if (k, w) in pair:
            return pair[k, w]
        p = parent.get(w, unseen)
        if k in common:
            return math.log10(language_model.back_off(samples, np.array([common[k]]), p[:, None])[0])
        n = rare[k][0, "customers"] if k in rare else 0
        tables = [rare[k][i, "tables"] if k in rare else 0 for i in numbers]
        return math.log10(sum((language_model.STRENGTH + g.discount * t) * q for g, t, q in zip(samples, tables, p)) / len(samples) / (language_model.STRENGTH + n))

    total = collections.defaultdict(float)  # over all words and the rest of every context
    for (k, w), log in pair.items():
        total[k] += 10.0 ** log
    for k in types:
        rest = sum(parent.values()) + unseen - sum(parent[w] for c, w in pair if c == k)
        n, tables = follow[k], [g.tables[common[k]] if k in common else rare[k][i, "tables"] for g, i in zip(samples, numbers)]
        rest = sum((language_model.STRENGTH + g.discount * t) * q for g, t, q in zip(samples, tables, rest)) / len(samples) / (language_model.STRENGTH + n)
        assert abs(total[k] + rest - 1) < 1e-3
    asked = docs.unionAll(docs.sparkSession.createDataFrame([docs.first()], docs.schema).withColumn("text", F.lit("Zyx zyx qwv the zyx")))
    want = sorted(round(sum(log_p(hashed(a), hashed(b)) for t in [cut_up(r["text"])] for a, b in zip([" start", *t], [*t, " end"])), 3) for r in asked.collect())
    got = sorted(round(r["score"], 3) for r in language_model.score(asked, model).collect())
    assert np.allclose(got, want, atol=2e-3)


def test_seating_of_small_counts():
    """Tables of two customers: the second opens one with weight mass against 1 - d."""
    rng = np.random.default_rng(0)
    (t,), (weight,) = language_model.seat(np.full(20_000, 2), np.full(20_000, 0.5), 0.5, rng)
    assert abs((t - 1).mean() - 0.5) < 0.02 and np.allclose(weight, 0.0)
    (t,), _ = language_model.seat(np.array([100_000, 1, 0]), np.full(3, 0.2), 0.5, rng)
    assert t[2] == 0 and t[1] == 1 and 1 < t[0] < 30


def test_language_model_without_training(spark, docs, empty):
    model = language_model.train(empty)
    rows = language_model.score(docs, model).collect()
    assert {r["score"] for r in rows} == {0.0} and {r["n_known"] for r in rows} == {0}
    assert language_model.score(empty, model).count() == 0


# ---- 3 ----

BENCH = [
    (1, "A train leaves Boston at 9 km per hour and covers 300 km before it meets the second slow train of the evening line."),
    (2, "Find how many green apples remain in the basket when Peter eats three of them and gives the other ones away."),
    (3, "too short"), (4, None),
]


def test_decontamination(spark):
    bench = spark.createDataFrame(BENCH, "item_id int, text string")
    rng = random.Random(5)
    renamed = BENCH[0][1].replace("Boston", "Vienna").replace("9 km", "14 km").replace("300 km", "750 mi")
    mixed_up = "A train leaves Boston at 9 km per hour and covers 300 km before. " + BENCH[0][1].replace("9", "8")
    rows = [
        (1, prose(rng, 50) + ". " + BENCH[0][1] + " " + prose(rng, 50)), (2, prose(rng, 20) + ".\n" + renamed), (3, BENCH[1][1].upper()),
        (4, prose(rng, 300)), (5, None), (6, ""), (7, "too short"), (8, "find how many green apples"), (9, mixed_up), (1, "again"),
    ]
    got = decontamination.contaminations(clashing(spark.createDataFrame(rows, "doc_id bigint, text string")), bench).collect()
    found = sorted((r["doc_id"], tuple(r["items"]), r["renamed"]) for r in got)
    assert found[:4] == [(1, (), False), (1, (1,), False), (2, (1,), True), (3, (2,), False)]
    assert [f[:2] for f in found[4:9]] == [(4, ()), (5, ()), (6, ()), (7, (3,)), (8, ())]
    kept = decontamination.drop_contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [4, 5, 6, 8]
    nothing = spark.createDataFrame([], "item_id int, text string")
    assert decontamination.drop_contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), nothing).count() == len(rows)


def test_canonical_tokens():
    c = decontamination.Canonical()
    one = c.codes("We saw Mary Ann Smith buy 12.5 kg. Then it rained.")[0].tolist()
    two = c.codes("We saw Otto buy 3 pounds. Then it rained.")[0].tolist()
    assert one == two and one[2:6:3] == [decontamination.NAME, decontamination.UNIT]
    assert c.codes("it was Then")[0][2] == decontamination.NAME and c.codes("it.\nThen")[0][1] > decontamination.NAME


# ---- 4 ----

def test_quality_classifier(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        t = prose(rng, 60)
        if i % 4 == 0:
            t = [t.upper() + "!!", " | ".join(t.split()), "### ".join(t.split()), " ".join(w for w in t.split() for _ in range(4))][i // 4 % 4]
        rows.append((i, t))
        labels.append((i, int(i % 4 != 0)))
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    ranking = quality_classifier.fit(df, lab.filter("doc_id < 160"))
    scored = df.select("doc_id", quality_classifier.score(df, ranking).alias("s")).filter("doc_id >= 160").collect()
    assert sum((r["s"] >= quality_classifier.CUT) == (r["doc_id"] % 4 != 0) for r in scored) >= 76
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "a")], df.schema)
    assert all(0 <= r[0] <= 1 for r in odd.select(quality_classifier.score(odd, ranking)).collect())
    one_kind = quality_classifier.fit(df, lab.filter("quality = 1"))
    assert one_kind is None and {r[0] for r in odd.select(quality_classifier.score(odd, one_kind)).collect()} == {0.5}


def test_quality_classifier_learns_from_every_label(spark):
    """Means over more documents of a kind than any sample held before."""
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("good words here "), "id")).otherwise("BUY! NOW!").alias("text"))
    labels = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("quality"))
    ranking = quality_classifier.fit(docs, labels)
    texts = [f"good words here {i}" if i % 2 == 0 else "BUY! NOW!" for i in range(8000)]
    x = np.array([quality_classifier.measures(t) for t in texts])
    assert np.allclose(ranking.middle, x.mean(0), rtol=1e-9, atol=1e-12) and np.allclose(ranking.scale, x.std(0) + 1e-9, rtol=1e-6, atol=1e-9)
    assert ((ranking.score(x) >= quality_classifier.CUT) == (np.arange(8000) % 2 == 0)).all()


def test_bradley_terry_orders_by_preference():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    good = x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=2000) > -1
    r = quality_classifier.bradley_terry(x[good], x[~good], float((~good).mean()))
    assert ((r.score(x) >= quality_classifier.CUT) == good).mean() > 0.95
    assert r.weights[0] > 0 > r.weights[1] and abs(r.weights[2]) < 0.2 * r.weights[0]


# ---- 5 ----

def naive_print(t, n=4):
    w = (t or "").encode().lower().split()
    parts = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, texts, docs, empty):
    rows = simhash.near_duplicates(clashing(docs)).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id").collect()
    prints = [(r["doc_id"], r["text"], naive_print(r["text"])) for r in docs.collect()]
    assert sorted((str(i), f"{p:016x}") for i, _, p in prints) == sorted((str(r["doc_id"]), r["f"]) for r in rows)
    group = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][2] ^ prints[b][2]).bit_count() <= 4 and group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((prints[i][0] for i in range(len(prints)) if group[i] == g and prints[i][0] is not None), default=None) for g in group}
    assert sorted((str(prints[i][0]), str(least[g])) for i, g in enumerate(group)) == sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_bk_tree_and_shards_lose_no_link(spark, monkeypatch):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(150)}
    values |= {v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for v in list(values) for _ in range(3)}
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for q in list(values)[:60]:
        assert sorted(tree.within(q, 4)) == sorted(v for v in values if (v ^ q).bit_count() <= 4)
    monkeypatch.setattr(simhash, "SLICE", 2)  # every shard is cut
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v), signed(v), None) for v in values], "node long, fp long, wide binary")
    want = {frozenset((signed(a), signed(b))) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 4}
    for blocks in (6, 7):
        got = components.components(simhash.link(nodes, 4, blocks))
        assert groups((r["u"], r["v"]) for r in got.collect()) == groups(tuple(p) for p in want)


def groups(pairs):
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[root(a)] = root(b)
    out = collections.defaultdict(set)
    for x in list(parent):
        out[root(x)].add(x)
    return {frozenset(g) for g in out.values()}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 1001)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000, 5000: 1000}


def test_near_copies_leave_one(spark):
    rng = random.Random(11)
    a, b = prose(rng, 300), prose(rng, 300)
    edited = a.split(" ")
    edited[100] = "edited"
    rows = [(5, a, "x"), (2, " ".join(edited), "y"), (9, b, "z"), (9, b, "z"), (4, None, "n"), (7, "", "n"), (None, prose(rng, 90), "q"), (8, a.upper(), "u")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, mark string"))
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "9", "None"]


# ---- 6 ----

def page(i, body, side="menu"):
    return (
        f"<html><head><title>t{i}</title><script>if (a < b) x('<p>')</script></head><body><nav><ul><li><a href='/a'>{side}</a></li></ul></nav>"
        f"<div class='ad'>Buy {i}</div><article><h1>Head {i}</h1>{body}<aside>more</aside><ul class=\"comments\"><li>nice</li></ul></article>"
        f"<form>Mail <input name=x></form><footer>&copy; {i}</footer></body></html>"
    )


def test_html_extraction(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<p>One &amp; two\n  {i}<br>more<p>Next <b>bo</b>ld &lt;x&gt;")) for i in range(5)]
    rows += [(90, None, None), (91, "junk", ""), (92, "http://b.example/", "<p>Plain <!-- no --> text</p>cut <a href='x"), (93, "http://c.example/", page(93, "<p>whole &am")[:-130])]
    rows += [(94, "http://a.example/4", rows[4][2])]
    out = {}
    pages = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    for r in html_extraction.extract(pages).collect():
        out.setdefault(r["page_id"], []).append(r["main_text"])
    assert [out[i] for i in range(5)] == [[f"Head {i}\n\nOne & two {i} more\n\nNext bold <x>"] for i in range(5)]
    assert out[90] == out[91] == [""] and out[92] == ["Plain text\n\ncut"] and out[94] == out[4]
    assert out[93][0].startswith("Head 93\n\nwhole")
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_templates_find_the_skeleton(spark):
    """Without an article, text that a host's pages share is template and not main text."""
    rows = [(i, f"http://h.example/{i}", f"<html><body><div id='top'>Welcome to us</div><div id='c{'x'}'><p>Story {i} {WORDS[i]}</p></div></body></html>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted(r["main_text"] for r in html_extraction.extract(df).collect()) == sorted(f"Story {i} {WORDS[i]}" for i in range(6))
    t = html_extraction.templates(df.select(html_extraction.host_of(F.col("url")).alias("host"), F.col("page_id").alias("page"), "html")).first()
    assert "html>body>div.top" in t["slots"] and len(t["constants"]) == 1


# ---- 7 ----

def test_language_id(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ban", "dor", "mil", "ten"], "bb": ["qu", "ixe", "oja", "uze"], "cc": ["жа", "ло", "ши"]}
    text = lambda l: " ".join("".join(rng.choice(kinds[l]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, text(l), l) for i, l in enumerate(["aa", "aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    fitted = language_id.fit(df.filter("doc_id < 100"))
    assert [l for l, _ in fitted] == ["aa", "bb", "cc"]
    got = df.select("doc_id", "lang", language_id.identify(df, fitted).alias("p")).filter("doc_id >= 100").select("lang", "p.*").collect()
    assert all(r[0] == r[1] and 0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, None), (2, "123 ²½ !!", None), (3, "", "aa")], df.schema)
    assert {tuple(r) for r in odd.select(language_id.identify(odd, fitted).alias("p")).select("p.*").collect()} == {("und", 0.0, False)}
    assert language_id.fit(odd.filter("doc_id < 3")) == []
    assert df.select(language_id.identify(df, []).alias("p")).filter("p.lang <> 'und'").count() == 0


# ---- 8 ----

def naive_rules(t):
    t = t or ""
    w = [x.decode() for x in words(t)]
    wins = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    full = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered)


def test_quality_rules(spark, docs, empty):
    rng = random.Random(8)
    more = [(1000, "a b c d e f g h i a b c d e f g h j", "", "z", 0), (1001, "x # y $\nl\nl\n\n", "", "z", 0), (1002, "w " * 30 + prose(rng, 90), "", None, 0)]
    df = clashing(docs.unionByName(spark.createDataFrame(more, DOCS)))
    got = quality_rules.apply_host_rules(df, F.col("source")).collect()
    src = df.collect()
    assert sorted((str(r["doc_id"]), *[r[c] for c in quality_rules.MEASURES[:5]]) for r in got) == sorted((str(r["doc_id"]), *naive_rules(r["text"])) for r in src)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert quality_rules.apply_host_rules(empty, F.col("source")).count() == 0
    assert quality_rules.keep_good(empty, F.col("source")).count() == 0


def test_hosts_share_their_verdict(spark):
    rng = random.Random(9)
    good, bad = prose(rng, 40), "short"
    rows = [(i, bad if i % 10 else good, "spam") for i in range(50)] + [(100 + i, good if i % 10 else bad, h) for i in range(100) for h in ("fine", None)]
    rows += [(500, bad, "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, site string")
    got = quality_rules.apply_host_rules(df, F.col("site")).collect()
    kept = {(r["doc_id"], r["host"]) for r in got if r["kept"]}
    assert kept == {(i, h) for i, t, h in rows if t == good and h != "spam"}
    assert {(r["doc_id"], r["site"]) for r in quality_rules.keep_good(df, F.col("site")).collect()} == kept
    tiny = next(r for r in got if r["host"] == "tiny")
    assert 0.2 < tiny["host_rate"] < 1  # one failure of one, pulled towards all hosts


# ---- 9 ----

def naive_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        above = {s for s in names if target[s] >= most * sizes[s]} - full
        if not above:
            return target
        full |= above


def test_mixing(spark, docs, empty):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 40)), "en", rng.choice(["big"] * 6 + ["é", "a", "", None]), 0) for i in range(1500)]
    df = clashing(docs.unionByName(spark.createDataFrame(rows, DOCS)))
    run = lambda: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["n"], r["copies"]) for r in mixing.mix(df, block=50).collect())
    monkey = mixing.FAN_IN
    mixing.FAN_IN = 3
    try:
        assert run() == run()
    finally:
        mixing.FAN_IN = monkey
    got = mixing.mix(df, block=50).collect()
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in df.collect():
        sizes[r["source"]] += len(words(r["text"]))
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"] * r["n"]
        longest[r["source"]] = max(longest[r["source"]], r["size"] * r["n"])
        assert 0 <= r["copies"] <= 2 and r["size"] * r["n"] >= 0
    want = naive_targets(dict(sizes))
    for s, t in want.items():
        assert abs(t - next(r["target"] for r in got if r["source"] == s)) < 1e-6 * t + 1e-9
        assert abs(taken[s] - t) <= longest[s] + 1
    out = mixing.repeat_documents(df)
    assert out.columns == [*df.columns, "copy"]
    assert mixing.mix(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0


def test_pivot_keeps_words_and_expectations():
    words_of, p0 = np.array([5.0, 3.0, 8.0, 1.0, 4.0, 4.0]), np.array([0.3, 0.7, 0.5, 0.2, 0.9, 0.4])
    rng = np.random.default_rng(6)
    total = np.zeros(6)
    for _ in range(4000):
        p = p0.copy()
        mixing.pivot(p, words_of, rng)
        assert abs((p * words_of).sum() - (p0 * words_of).sum()) < 1e-6 and ((p > 0) & (p < 1)).sum() <= 1
        total += p
    assert np.abs(total / 4000 - p0).max() < 0.04


# ---- 10 ----

def test_licenses(spark, empty):
    notice = licenses.NOTICES[0][1].split()
    rows = [
        (1, "Released under the MIT License."), (2, "under the mit license, (under the MIT-license) CC BY-NC 4.0"), (3, None), (4, ""),
        (5, "x " * 20 + " ".join(notice[:9] + ["inserted"] + notice[9:])), (6, " ".join(notice[:6])), (7, "Apache License, Version 2.0"),
        (8, "under the mitt license cc é by nc"), (9, " ".join(w + " pad pad pad" for w in notice)), (1, "cc by nc"),
    ]
    got = licenses.scan_licenses(clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    out = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in got if r["doc_id"] != 1)
    assert out == [
        (2, 13, 3, 0, 8, "cc-by-nc,mit", "cc-by-nc,mit"), (3, 0, 0, None, None, "", ""), (4, 0, 0, None, None, "", ""), (5, 20 + len(notice) + 1, 0, None, None, "", "mit"),
        (6, 6, 0, None, None, "", ""), (7, 5, 1, 0, 0, "apache-2", "apache-2"), (8, 8, 0, None, None, "", ""), (9, 4 * len(notice), 0, None, None, "", ""),
    ]
    assert sorted((r["n_base"], r["labels"]) for r in got if r["doc_id"] == 1) == [(1, "cc-by-nc"), (1, "mit")]
    assert all(0 <= r["score"] <= 1 for r in got) and licenses.scan_licenses(empty).count() == 0


# ---- queries and pipeline ----

def test_rules_for_held_out_rows(spark):
    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", language_model.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame(BENCH[:2], "item_id int, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = spark.createDataFrame([(2000, BENCH[1][1] + " " + prose(random.Random(1), 30), "en", "a", 0)], DOCS)
    now = docs.unionByName(leak)
    columns = now.columns
    ids = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert now.columns == columns + ["copy"] * (name == "mixing")
        ids[name] = {r[0] for r in now.select("doc_id").collect()}
    source = {r["doc_id"]: r["text"] for r in docs.collect()} | {2000: BENCH[1][1]}
    assert ids["quality_rules"] == {i for i, t in source.items() if len(words(t)) >= 20 and 100 * naive_rules(t)[4] <= 30 * len(words(t))}
    assert ids["line_dedup"] == ids["quality_rules"] and 3 in ids["simhash"] and len(ids["simhash"]) < len(ids["line_dedup"])
    assert ids["decontamination"] == ids["simhash"] - {2000} and ids["mixing"] <= ids["decontamination"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_digest_of_kept_lines(spark, docs):
    index = line_dedup.LineIndex(spark).insert(docs)
    rows = line_dedup.split_lines(docs, index).select("text", F.sha2("__kept", 256).alias("s")).collect()
    assert [r["s"] for r in rows] == [hashlib.sha256(k.encode()).hexdigest() for k in without_frequent([r["text"] for r in rows])]
