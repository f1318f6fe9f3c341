"""Operators on small inputs: skewed keys, ties, brute force, hand-worked values."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from coursemine.operators import conversations as cv, outline as ol, ranking as rk, retrieval as rt, vectors as vx
from coursemine.plans import planning as pl, quiz as qz
from coursemine.sources import corpus as co, tables as tb
from coursemine.streaming import incremental as ic


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.5 else rng.randrange(20), i, rng.randrange(9)) for i in range(3000)]
    return spark.createDataFrame(data, "k int, pos int, v int")


def test_number_in_key_equals_one_window(skewed):
    want = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("pos")))
    got = rk.number_in_key(skewed, ["k"], F.floor(F.col("pos") / 100), [F.col("pos")], "n")
    assert rows(got, "k", "pos", "n") == rows(want, "k", "pos", "n")


def test_running_sum_equals_one_window(skewed):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    got = rk.running_sum(skewed, ["k"], F.floor(F.col("pos") / 100), [F.col("pos")], F.col("v"), "s")
    assert rows(got, "k", "pos", "s") == rows(skewed.withColumn("s", F.sum("v").over(w)), "k", "pos", "s")


def test_spread_join_equals_join(skewed):
    small = skewed.groupBy("k").agg(F.max("v").alias("m"))
    assert rows(rk.spread_join(skewed, small, ["k"], F.col("pos")), "k", "pos", "m") == rows(skewed.join(small, "k"), "k", "pos", "m")


@pytest.mark.parametrize("tile", [10_000, 16])
def test_dense_topk_against_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8)).astype(np.float32)
    v[40:90] = v[40]  # a large group of exact copies
    q = np.vstack([rng.normal(size=(4, 8)), v[40]]).astype(np.float32)
    scope = [0] * 100 + [1] * 20
    vectors = spark.createDataFrame([(scope[i], i, [float(x) for x in v[i]]) for i in range(120)], "goal_id int, chunk_id int, embedding array<float>")
    queries = spark.createDataFrame([(i, 0, [float(x) for x in q[i]]) for i in range(5)], "query_id int, goal_id int, vector array<float>")
    got = vx.dense_topk(queries, vectors, ["chunk_id"], 7, tile_vectors=tile, tile_queries=2)
    want = []
    for i in range(5):
        d = [1 - float(np.dot(q[i].astype(float), v[j].astype(float)) / np.linalg.norm(q[i].astype(float)) / np.linalg.norm(v[j].astype(float))) for j in range(100)]
        best = sorted((round(d[j], 6) + 0.0, j) for j in range(100))[:7]
        want += [(i, j, x, n + 1) for n, (x, j) in enumerate(best)]
    assert rows(got, "query_id", "chunk_id", "distance", "rank") == sorted(want)


def test_embed_with_retries_and_nulls(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise IOError("first call fails")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "de")], "id int, text string").coalesce(1)
    assert rows(vx.embed_with(df, flaky, batch=2).select("id", F.col("vector")[0].alias("x")), "id", "x") == [(1, 3.0), (2, 0.0), (3, 2.0)]


def test_blake_encoder():
    v = vx.hash_encoder(dims=16)(["b b", ""])
    h = int.from_bytes(hashlib.blake2b(b"b", digest_size=8).digest(), "little")
    want = np.zeros(16)
    want[h % 16] = 1.0 if (h >> 8) % 2 == 0 else -1.0
    assert np.allclose(v[0], want) and not v[1].any()


def test_hash_embed_shape(spark):
    df = spark.createDataFrame([(1, "a b a 极限"), (2, "")], "id int, text string")
    got = {r["id"]: r["vector"] for r in vx.hash_embed(df).collect()}
    assert len(got[1]) == len(got[2]) == 384
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2])


def test_bm25_by_hand(spark):
    tokens = spark.createDataFrame(
        [(1, 10, 0, ["a1", "b1"], ["x"]), (1, 10, 1, ["a1"], []), (1, 11, 0, ["c1", "d1", "e1"], []), (2, 12, 0, ["a1"], [])],
        "goal_id int, material_id int, chunk_index int, tokens array<string>, formula_tokens array<string>",
    )
    queries = spark.createDataFrame([(1, 1, ["a1", "zz"], ["x", "="])], "query_id int, goal_id int, lexical_terms array<string>, formula_terms array<string>")
    idf = np.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    part = lambda n: idf * 2.4 / (1 + 1.4 * (0.25 + 0.75 * n / 2.0))
    want = [(10, 0, round(part(2) + 1.2, 6)), (10, 1, round(part(1), 6))]
    for bound in (1000, 0):
        got = rt.lexical_scores(queries, tokens, max_query_rows=bound)
        assert rows(got, "material_id", "chunk_index", "lexical_score") == want
    none = rt.lexical_topk(queries.withColumn("day_index", F.lit(3)), tokens)
    assert none.count() == 0


def test_lexical_scores_read_every_chunk_once(spark):
    """Statistics, frequencies and scores follow from one pass over the tokens."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def read(words):
        seen.add(1)
        return words

    tokens = spark.createDataFrame([(i % 2, i, 0, ["a", f"b{i % 3}"], ["="]) for i in range(30)], "goal_id int, material_id int, chunk_index int, tokens array<string>, formula_tokens array<string>")
    tokens = tokens.withColumn("tokens", read("tokens"))
    queries = spark.createDataFrame([(1, 0, ["a"], ["="]), (2, 1, ["b1"], [])], "query_id int, goal_id int, lexical_terms array<string>, formula_terms array<string>")
    assert len(rt.lexical_scores(queries, tokens).collect()) == 15 + 5
    assert seen.value == 30


def test_formula_bonus_compares_classes_not_pairs(spark):
    """The same rows as term by term; only the last join, which aggregates nothing, is as large as the result."""
    terms = [["x", "="], ["=", "x"], ["y"], list("abcdefgh"), [], None]
    queries = spark.createDataFrame([(i, i % 2, [], terms[i % 6]) for i in range(60)], "query_id int, goal_id int, lexical_terms array<string>, formula_terms array<string>")
    held = [["x", "="], ["x"], list("hgfedcba"), [], ["z"]]
    tokens = spark.createDataFrame([(i % 3, i, 0, ["w"], held[i % 5]) for i in range(90)], "goal_id int, material_id int, chunk_index int, tokens array<string>, formula_tokens array<string>")
    want = []
    for q in range(60):
        for m in range(90):
            n = len(set(terms[q % 6] or []) & set(held[m % 5]))
            if q % 2 == m % 3 and n:
                want.append((q, m, 0, round(min(n * 1.2, 4.8), 6)))
    for bound in (1000, 0):
        got = rt.formula_bonus(queries, tokens, max_query_rows=bound)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    got = rt.formula_bonus(queries, tokens)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    last = min(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    assert not any("Aggregate" in line for line in plan.splitlines()[:last])


def test_outline_of_chinese_contents(spark):
    text = ["目录", "第一章 极限 ..... 1", "1.1 数列极限 … 5", "第二章 导数 ..... 20", "第二章 导数", "1. 引言", "尾注"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "material_id int, line_no int, line string")
    got = ol.extract_outline(df).orderBy("order").collect()
    assert [(r["title"], r["level"], r["page_start"], r["page_end"], r["confidence"]) for r in got] == [
        ("第一章 极限", 1, 1, 4, 0.86), ("1.1 数列极限", 2, 5, 19, 0.86), ("第二章 导数", 1, 20, None, 0.86),
    ]
    assert ol.extract_outline(df.filter("line_no < 3")).count() == 0


def test_ocr_pages_number_blank_ones(spark):
    line = lambda *texts: '{"result": {"layoutParsingResults": [' + ", ".join('{"markdown": {"text": "%s"}}' % t for t in texts) + "]}}"
    df = spark.createDataFrame([("m", 0, line("one", " ")), ("m", 1, "  "), ("m", 2, line("three")), ("n", 0, line(""))], "material_id string, line_no int, line string")
    pages, failed = co.ocr_pages_from_lines(df)
    assert rows(pages, "material_id", "page_index", "markdown") == [("m", 1, "one"), ("m", 3, "three")]
    assert rows(failed, "material_id") == [("n",)]


def test_read_text_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ab\n极".encode() + b"\xff!")
    (tmp_path / "b.MD").write_bytes(b"# t")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"x")
    texts, rejected = co.read_text_corpus(spark, str(tmp_path))
    assert rows(texts, "file_type", "text") == [("md", "# t"), ("txt", "ab\n极!")]
    assert [r[0] for r in rows(rejected, "file_type", "reason")] == ["exe", "pdf"]


def test_dense_search_of_many_scopes_returns_few_rows(spark):
    """No task returns more than k rows per request, however many scopes its vectors have."""
    rng = np.random.default_rng(2)
    v = [(i % 1000, i, [float(x) for x in rng.normal(size=4)]) for i in range(20_000)]
    vectors = spark.createDataFrame(v, "goal_id int, chunk_id int, embedding array<float>")
    queries = spark.createDataFrame([(s, s, v[s][2]) for s in range(1000)], "query_id int, goal_id int, vector array<float>")
    queries = queries.select("query_id", F.col("goal_id").alias("_scope"), F.col("vector").alias("_q"))
    vectors = vectors.select(F.col("goal_id").alias("_scope"), "chunk_id", F.col("embedding").alias("_v"))
    near = vx._tile_nearest(queries, vectors, ["chunk_id"], 3, "query_id int, chunk_id int, distance double", 50_000, 2_000)
    assert near.groupBy("query_id").count().agg(F.max("count"), F.sum("count")).first() == (3, 3000)


def test_versions_are_repeatable(spark, tmp_path):
    path = str(tmp_path / "t")
    rows_of = lambda pairs: spark.createDataFrame(pairs, "job_id int, state int")
    tb.write_version(rows_of([(1, 0), (2, 0), (3, 0)]), path, 0)
    for _ in range(2):
        tb.write_version(rows_of([(1, 7), (4, 0)]), path, 1)
    assert rows(tb.newest(spark, path, ["job_id"]), "job_id", "state") == [(1, 7), (2, 0), (3, 0), (4, 0)]
    tb.compact(spark, path, str(tmp_path / "c"), ["job_id"])
    assert rows(tb.newest(spark, str(tmp_path / "c"), ["job_id"]), "job_id", "state") == [(1, 7), (2, 0), (3, 0), (4, 0)]


def _materials(spark, pairs):
    return spark.createDataFrame(pairs, "material_id bigint, text string")


def test_ingestion_loses_no_material(spark):
    long = "A sentence that is long enough. " * 3
    stored, failed = ic.ingest_batch(_materials(spark, [(1, long), (2, "short"), (3, None), (4, "a" + " " * 30 + "b"), (5, "")]))
    assert rows(stored, "material_id") == [(1,)]
    assert rows(failed, "material_id") == [(2,), (3,), (4,), (5,)]
    notes = spark.createDataFrame([(1, 1, "n", "a" + " " * 30 + "b", None, None), (2, 1, "n", long, 1, 1)], "note_id bigint, goal_id int, source_name string, content string, plan_id int, day_index int")
    corpus, errors = tb.ingest_snippets(spark.createDataFrame([], "material_id bigint, goal_id int, filename string, file_type string, text string"), notes, 100)
    assert rows(corpus, "material_id") == [(102,)] and rows(errors, "note_id") == [(1,)]


def test_a_batch_that_dies_half_way_is_repeated(spark, tmp_path):
    """Lost between its chunks and its status, a batch is not seen, and its repetition completes it."""
    arrivals, a, b, check = (str(tmp_path / n) for n in ("in", "chunks", "status", "check"))
    long = "A sentence that is long enough. "
    plain = lambda m: tb.chunk_rows(ic.chunk_documents(m.select("material_id", "text")))

    def run(process):
        stream = spark.readStream.schema("material_id bigint, text string").parquet(arrivals)
        ic.stream_ingest(stream, a, b, check, process).awaitTermination()

    def seen():
        return rows(ic.stored_chunks(spark, a, b), "material_id", "content_raw"), rows(ic.ingest_failures(spark, b), "material_id")

    _materials(spark, [(1, long), (2, "short")]).write.parquet(arrivals)
    run(plain)
    before = seen()
    assert before == ([(1, long.strip())], [(2,)])
    _materials(spark, [(1, "gone"), (2, long), (3, long)]).write.mode("append").parquet(arrivals)
    write = ic.write_version

    def dies(df, path, number):
        if path == b:
            raise RuntimeError("lost driver")
        write(df, path, number)

    ic.write_version = dies
    try:
        with pytest.raises(Exception, match="lost driver"):
            run(plain)
    finally:
        ic.write_version = write
    assert seen() == before
    run(plain)
    assert seen() == ([(2, long.strip()), (3, long.strip())], [(1,)])


def test_compaction_keeps_replaced_chunks_out(spark, tmp_path):
    a, b, c, d = (str(tmp_path / n) for n in ("chunks", "status", "chunks2", "status2"))
    long = "A sentence that is long enough. "
    plain = lambda m: tb.chunk_rows(ic.chunk_documents(m.select("material_id", "text")))
    for number, text in enumerate((long * 100, long * 30)):
        arrivals = str(tmp_path / f"in{number}")
        _materials(spark, [(1, text), (2, long if number == 0 else "short")]).write.parquet(arrivals)
        # each with a checkpoint of its own, as after a lost one: versions go on
        stream = spark.readStream.schema("material_id bigint, text string").parquet(arrivals)
        ic.stream_ingest(stream, a, b, str(tmp_path / f"check{number}"), plain).awaitTermination()
    want = rows(ic.stored_chunks(spark, a, b), "material_id", "chunk_index")
    assert want == rows(ic.chunk_documents(_materials(spark, [(1, long * 30)])), "material_id", "chunk_index")
    assert len(want) < tb.versions(spark, a).filter("version = 0 and material_id = 1").count()
    ic.compact_ingested(spark, a, b, c, d)
    assert rows(ic.stored_chunks(spark, c, d), "material_id", "chunk_index") == want
    assert rows(ic.ingest_failures(spark, d), "material_id") == rows(ic.ingest_failures(spark, b), "material_id") == [(2,)]
    assert tb.versions(spark, c).count() == len(want)


def test_versions_go_on_with_a_new_checkpoint(spark, tmp_path):
    """Late and repeated translations, and a second stream with a checkpoint of its own."""
    cache = str(tmp_path / "cache")
    schema = "material_id int, page_index int, target_lang string, text_hash string, translated_text string, seq int"
    for number, pairs in enumerate(([("a", 1), ("a", 3), ("b", 1)], [("a", 2), ("b", 2), ("b", 2), ("c", 1)])):
        arrivals = str(tmp_path / f"in{number}")
        spark.createDataFrame([(1, 1, "zh", k, f"{k}{s}", s) for k, s in pairs], schema).write.parquet(arrivals)
        ic.upsert_cache_stream(spark.readStream.schema(schema).parquet(arrivals), cache, str(tmp_path / f"check{number}")).awaitTermination()
    assert rows(ic.cached(spark, cache), "text_hash", "translated_text") == [("a", "a3"), ("b", "b2"), ("c", "c1")]
    numbers = [r["version"] for r in tb.versions(spark, cache).select("version").distinct().orderBy("version").collect()]
    assert len(numbers) == 2 and numbers[1] == numbers[0] + 1


def test_tasks_stay_within_the_day(spark):
    plans = spark.createDataFrame([(1, 1, "t"), (2, 1, "t")], "plan_id int, goal_id int, topic string")
    goals = spark.createDataFrame([(1, 60)], "goal_id int, daily_minutes int")
    raw = spark.createDataFrame([(1, i, "", "", m, None) for i, m in enumerate(("30", "2", "40", "x"))], "plan_id int, pos int, title string, description string, estimated_minutes string, task_type string")
    got = pl.repair_tasks(raw, plans, goals)
    # "x" is the first row behind the budget: its minutes are read before the budget is looked at
    assert rows(got.filter("plan_id = 1"), "task_no", "estimated_minutes") == rows(got.filter("plan_id = 2"), "task_no", "estimated_minutes")
    assert got.filter("plan_id = 1").count() == 4
    fine = raw.withColumn("pos", F.when(F.col("estimated_minutes") == "x", 9).otherwise(F.col("pos")))
    more = spark.createDataFrame([(1, 4, "", "", "7", None)], raw.schema)
    got = pl.repair_tasks(fine.unionByName(more), plans, goals)
    assert [r[0] for r in rows(got.filter("plan_id = 1"), "estimated_minutes")] == [5, 25, 30]  # "x" comes later still


def test_compression_stays_below_target(spark):
    turns = spark.createDataFrame([(1, i, "user", f"## head {i}\n" + "word " * 50) for i in range(40)], "conv_id int, turn bigint, role string, text string")
    got = cv.compress_history(turns, 300).first()
    assert got["summary"].startswith("【已压缩的聊天历史】\n原始消息数：40\n保留要点：\n1. user：\n- head 0")
    assert got["summary_chars"] <= 300 and got["original_chars"] == turns.select(F.sum(F.length("text"))).first()[0]


def test_intents(spark):
    texts = ["请写入知识库： 极限 ", "调整明天的计划", "讲讲这一页", "今天复盘", "检索积分", "你好", "复盘并调整计划"]
    df = spark.createDataFrame([(t,) for t in texts], "message string")
    no = cv.classify_intent(df, has_plan=F.lit(False), has_page=F.lit(False)).collect()
    assert [r["intent"] for r in no] == ["insert", "chat", "chat", "chat", "search", "chat", "chat"]
    assert {r["intent"] for r in cv.classify_intent(df, has_goal=F.lit(None).cast("boolean")).collect()} == {"chat"}
    got = [(r["intent"], r["payload"]) for r in cv.classify_intent(df).collect()]
    assert got == [("insert", "极限"), ("adjust", None), ("read_page", None), ("review", None), ("search", None), ("chat", None), ("adjust", None)]


def test_goal_rules(spark):
    df = spark.sql("select '30 天复习' title, 'exam' goal_type, date'2024-03-01' exam_date, cast(null as int) duration_days")
    assert df.select(pl.day_count(F.to_date(F.lit("2024-01-01")))).first()[0] == 30
    topics = spark.createDataFrame([("极限， 导数,,积分 ",)], "t string").select(pl.parse_topics(F.col("t"))).first()[0]
    assert topics == ["极限", "导数", "积分"]


def test_short_answers(spark):
    df = spark.createDataFrame([("", "矩阵 范数", ""), ("矩阵", "矩阵 说明", ""), ("矩阵的最大列和就是它的一范数", "矩阵", ""), ("x" * 28, "矩阵", ""), ("abc", "核心", "abc 定义")], "answer string, reference_answer string, question string")
    assert [r["score"] for r in qz.score_short_answers(df).collect()] == [0, 65, 80, 60, 65]


def test_pair_scores_are_retried_and_equal_brute_force(spark, tmp_path):
    hits = spark.createDataFrame([(q, m, 0, f"a b w{q}" if q else None, f"b w{m} c" if m else None) for q in range(5) for m in range(30)], "query_id int, material_id bigint, chunk_index int, query string, content string")
    marks = str(tmp_path)

    def shaky(pairs):
        import os
        import uuid

        assert len(pairs) <= 7
        first = f"{marks}/{hash(tuple(pairs))}"
        if not os.path.exists(first):
            open(first, "w").close()
            raise RuntimeError(str(uuid.uuid4()))
        return [len(set(q.split()) & set(t.split())) for q, t in pairs]

    got = rt.score_pairs(hits, shaky, batch=7)
    want = [(r["query_id"], r["material_id"], 0, float(len(set((r["query"] or "").split()) & set((r["content"] or "").split())))) for r in hits.collect()]
    assert rows(got, "query_id", "material_id", "chunk_index", "rerank_score") == sorted(want)


def test_only_requests_without_hits_search_everywhere(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    scoped = spark.createDataFrame([(2, 7)], "query_id int, chunk_id int")
    seen = []
    got = rt.scoped_else_global(asked, scoped, lambda rest: seen.extend(r[0] for r in rest.collect()) or rest.withColumn("chunk_id", F.lit(9)))
    assert sorted(seen) == [1, 3]
    assert rows(got, "query_id", "chunk_id", "scope_used") == [(1, 9, "global"), (2, 7, "day"), (3, 9, "global")]


def test_few_requests_go_to_the_vectors_once(spark):
    """Brute force over scopes, conditions, copies and requests that come twice; every vector is made once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def made(v):
        seen.add(1)
        return v

    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, size=(300, 4)).astype(float) + 0.25  # many equal ones
    data = [(None if i % 11 == 0 else i % 3, i // 2, i % 2, "ab"[i % 2], v[i].tolist()) for i in range(300)]
    vectors = spark.createDataFrame(data, "goal_id int, material_id long, chunk_index int, kind string, embedding array<float>").repartition(5)
    asked = [(i // 2, [0, 1, 2, 7, None][i // 2 % 5], [None, "a", "b"][i // 2 % 3], rng.normal(size=4).round(2).tolist()) for i in range(0, 30, 2)]
    asked.append(asked[0])
    queries = spark.createDataFrame(asked, "query_id long, goal_id int, kind string, vector array<float>")
    got = vx.dense_topk(queries, vectors.withColumn("embedding", made("embedding")), ["material_id", "chunk_index"], 6, conditions=("kind",))
    found = rows(got, "query_id", "material_id", "chunk_index", "distance", "rank")
    assert seen.value == 300
    unit = lambda x: (y := np.float32(x).astype(float)) / np.linalg.norm(y)
    want = []
    for q in sorted({x[0] for x in asked}):
        near = []
        for _, goal, kind, x in (a for a in asked if a[0] == q):
            near += [(round(1 - float(unit(x) @ unit(r[4])), 6) + 0.0, r[1], r[2]) for r in data if r[0] == goal and kind in (None, r[3])]
        want += [(q, m, c, d, n + 1) for n, (d, m, c) in enumerate(sorted(near)[:6])]
    assert found == sorted(want)
    grid = vx.dense_topk(queries, vectors, ["material_id", "chunk_index"], 6, conditions=("kind",), tile_queries=3)
    assert rows(grid, "query_id", "material_id", "chunk_index", "distance", "rank") == found
