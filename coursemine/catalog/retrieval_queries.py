"""Registered vector and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from coursemine.catalog import duck as d
from coursemine.catalog.source_queries import scratch
from coursemine.catalog.text_queries import chunks
from coursemine.fixtures import fill_cores, table, view
from coursemine.functions import text as tx, tokens as tk
from coursemine.functions.terms import TERM_TYPE
from coursemine.operators.ranking import is_small, stored
from coursemine.operators import approximate as ap, chunking, conversations as cv, enrichment as en, postings as ps, retrieval as rt, vectors as vx


def searchable(spark: SparkSession, sf: str, cut: DataFrame | None = None) -> DataFrame:
    """Chunk rows as the lexical search reads them, of ``cut`` where chunks are at hand; terms come from ``enrich_chunks`` where it has run."""
    c = chunks(spark, sf) if cut is None else cut
    return (
        c.withColumn("retrieval_text", tx.clean_for_retrieval(F.col("content")))
        .withColumn("content_preview", F.substring("content", 1, 500))
        .withColumn("formulas", tx.extract_formulas(F.col("content")))
        .withColumn("key_terms", F.array().cast(f"array<{TERM_TYPE}>"))
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return rt.rewrite_queries(view(spark, sf, "query"))


def tokens(spark: SparkSession, sf: str, cut: DataFrame | None = None) -> DataFrame:
    return rt.token_table(searchable(spark, sf, cut))


def math_chunks(spark: SparkSession, sf: str) -> DataFrame:
    m = view(spark, sf, "math").select(F.col("chunk_id").alias("material_id"), F.lit(0).alias("chunk_index"), "text")
    goals = table(spark, sf, "part").select(F.col("p_partkey").alias("material_id"), (F.col("p_size") % 5).alias("goal_id"))
    m = m.join(goals, "material_id")
    return (
        m.withColumn("retrieval_text", tx.clean_for_retrieval(F.col("text")))
        .withColumn("content_preview", F.substring("text", 1, 500))
        .withColumn("formulas", tx.extract_formulas(F.col("text")))
        .withColumn("key_terms", F.array().cast(f"array<{TERM_TYPE}>"))
    )


def math_requests(spark: SparkSession, sf: str) -> DataFrame:
    s = fill_cores(table(spark, sf, "supplier"), "s_suppkey")
    more = F.when(F.col("s_suppkey") % 4 == 0, "}^2$ + alpha / 2").when(F.col("s_suppkey") % 4 == 1, "}$ = b").when(F.col("s_suppkey") % 4 == 2, "}$").otherwise("} + q$")
    text = F.concat(F.lit("solve $x_{"), (F.col("s_suppkey") % 50).cast("string"), more)
    return rt.rewrite_queries(
        s.select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 5).cast("int").alias("goal_id"), text.alias("query"))
    )


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One request per goal and label: the mean of its vectors."""
    v = view(spark, sf, "vec")
    return vx.mean_pool(v, ["goal_id", "material_id"]).select(
        (F.col("goal_id") * 10 + F.col("material_id")).alias("query_id"), "goal_id", "vector"
    )


def dense_hits(spark: SparkSession, sf: str, cut: DataFrame, k: int = 30) -> DataFrame:
    c = vx.hash_embed(cut, "content", out="embedding").select("goal_id", *rt.CHUNK_KEY, "embedding")
    q = vx.hash_embed(requests(spark, sf), "semantic_query", out="vector")
    return vx.dense_topk(q, c, rt.CHUNK_KEY, k)


def merged_hits(spark: SparkSession, sf: str) -> DataFrame:
    cut = stored(chunks(spark, sf).select("goal_id", *rt.CHUNK_KEY, "content"), "chunks")  # both searches read them
    return rt.merge_hits(dense_hits(spark, sf, cut), rt.lexical_topk(requests(spark, sf), tokens(spark, sf, cut)))


def ranked_hits(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return rt.hybrid_rank(merged_hits(spark, sf), k)


def chunks_of(hits: DataFrame, sf: str) -> DataFrame:
    """Chunks of the materials among the stored hits; no other text is cut or moved."""
    spark = hits.sparkSession
    found = hits.select("material_id").distinct()
    found = F.broadcast(found) if is_small(found, 500_000) else found
    return chunking.chunk_documents(view(spark, sf, "material").join(found, "material_id", "left_semi"))


def full_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked hits with the chunk's own columns."""
    hits = stored(ranked_hits(spark, sf), "hits")
    c = chunks_of(hits, sf).withColumn("source", chunking.source_label(F.col("filename"), F.col("chunk_index")))
    return hits.join(c.drop("goal_id"), rt.CHUNK_KEY).withColumn("summary_zh", F.lit(None).cast("string"))


def q_hash_embed(spark, sf):
    v = view(spark, sf, "material").select("material_id", vx.unit_weights(vx.sparse_hash_vector(tk.hash_tokens(F.col("text")))).alias("w"))
    return tx.unnest(v, ["material_id"], F.col("w"), "_pos", "x").select("material_id", "x.bucket", F.round("x.weight", 6).alias("weight"))


def q_hash_embed_dense(spark, sf):
    v = tx.unnest(vx.hash_embed(view(spark, sf, "material")), ["material_id"], F.col("vector"), "bucket", "x")
    return v.groupBy("material_id").agg(
        F.count(F.lit(1)).alias("dims"), F.round(F.sum(F.col("x").cast("double") * (F.col("bucket") + 1)), 4).alias("checksum")
    )


def q_mean_pool(spark, sf):
    m = vx.mean_pool(view(spark, sf, "vec"), ["material_id"])
    return m.select("material_id", F.posexplode("vector").alias("pos", "x")).select("material_id", "pos", F.round("x", 6).alias("mean"))


def q_embed_with(spark, sf):
    """An encoder in Python against the same hashing in SQL, value by value."""
    v = vx.embed_with(view(spark, sf, "material").select("material_id", "text"), vx.hash_encoder(vx.md5_hash), number=T.DoubleType())
    return tx.unnest(v, ["material_id"], F.col("vector"), "bucket", "x").filter("x <> 0").select("material_id", "bucket", F.round("x", 6).alias("weight"))


def q_build_queries(spark, sf):
    goals = view(spark, sf, "goal").withColumn("key_topics", F.array("current_level", "goal_type"))
    plans = view(spark, sf, "plan").withColumn("objective", F.col("status"))
    tasks = view(spark, sf, "task").withColumn("description", F.col("status"))
    last = cv.last_user_message(table(spark, sf, "conversations")).select(
        "conv_id", "message",
        F.when(F.col("conv_id") % 4 != 3, F.col("conv_id")).alias("goal_id"),
        F.when(F.col("conv_id") % 3 == 0, F.col("conv_id")).alias("plan_id"),
    )
    null = F.lit(None).cast("bigint")
    one = lambda df, name, a, b: df.select(F.lit(name).alias("consumer"), "goal_id", a.alias("key_a"), b.alias("key_b"), "query", "k")
    out = one(rt.planner_queries(goals), "planner", null, null)
    out = out.unionByName(one(rt.task_queries(tasks, plans, goals), "quiz", F.col("plan_id"), F.col("task_no").cast("bigint")))
    out = out.unionByName(one(rt.plan_queries(plans), "tasks", F.col("plan_id"), F.col("day_index").cast("bigint")))
    return out.unionByName(one(rt.chat_queries(last, plans, goals), "chat", F.col("conv_id"), null))


def _conditioned(v: DataFrame) -> DataFrame:
    """Vectors with a plan, a day and a source type."""
    k = F.col("chunk_id")
    return v.withColumn("plan_id", k % 7).withColumn("day_index", (k % 3).cast("int")).withColumn("source_type", F.when(k % 2 == 0, "pdf").otherwise("manual"))


def _own_scopes(spark, sf) -> DataFrame:
    """The centroids as requests, each with conditions of its own."""
    q = F.col("query_id")
    return centroids(spark, sf).select(
        "query_id", "goal_id", "vector", F.when(q % 4 == 0, (q % 10).cast("int")).alias("material_id"), F.when(q % 4 == 1, q % 7).alias("plan_id"),
        F.when(q % 3 == 0, (q % 3).cast("int")).alias("day_index"), F.when(q % 5 == 2, "pdf").when(q % 5 == 3, "slides").alias("source_type"),
    )


def q_scope_filter(spark, sf):
    """Chunks that each request may see under all four conditions."""
    return rt.scope_filter(_conditioned(view(spark, sf, "vec")), _own_scopes(spark, sf))


def q_dense_topk_own_scopes(spark, sf):
    """Requests with conditions of their own in one search."""
    v = _conditioned(view(spark, sf, "vec"))
    return vx.dense_topk(_own_scopes(spark, sf), v, ["chunk_id"], 5, conditions=rt.SCOPE_COLUMNS, tile_vectors=100)


def q_dense_topk(spark, sf):
    v = view(spark, sf, "vec").select("goal_id", "chunk_id", "embedding")
    return vx.dense_topk(centroids(spark, sf), v, ["chunk_id"], 10)


def q_dense_topk_tiled(spark, sf):
    """The same search cut into small tiles, as a large scope would be."""
    v = view(spark, sf, "vec").select("goal_id", "chunk_id", "embedding")
    return vx.dense_topk(centroids(spark, sf), v, ["chunk_id"], 10, tile_vectors=7, tile_queries=3)


def _indexed(spark, sf):
    """Vectors with cell and code, stored by cell, and their index: 64 floats become 16 bytes."""
    v = view(spark, sf, "vec").select("goal_id", "chunk_id", "embedding")
    index = ap.fit_index(v, ["chunk_id"], cells=16, subspaces=16)
    path = scratch(spark, "cells")
    ap.encode(v, index).write.mode("overwrite").partitionBy("cell").parquet(path)
    return spark.read.parquet(path), index


def _near(spark, sf, encoded, index):
    return ap.approximate_topk(centroids(spark, sf), encoded, index, ["chunk_id"], 10, least_cells=index.cells_for(0.95), candidates=60)


def q_approximate_topk(spark, sf):
    """The nearest vectors of each request, by codes, from as many cells as the sample asks for."""
    return _near(spark, sf, *_indexed(spark, sf))


def q_approximate_topk_all(spark, sf):
    """With all cells and all candidates the rows are those of the exact search."""
    encoded, index = _indexed(spark, sf)
    return ap.approximate_topk(centroids(spark, sf), encoded, index, ["chunk_id"], 10, least_cells=16, candidates=1_000_000)


def q_approximate_recall(spark, sf):
    """Share of the exact neighbours that are found, over all requests, and the bytes of a code."""
    encoded, index = _indexed(spark, sf)
    out = ap.recall(q_dense_topk(spark, sf), _near(spark, sf, encoded, index), ["chunk_id"])
    return out.withColumn("bytes", F.lit(len(index.books))).withColumn("cells", F.lit(index.cells_for(0.95)))


def q_bm25_score(spark, sf):
    return rt.bm25_score(requests(spark, sf), tokens(spark, sf))


def q_formula_bonus(spark, sf):
    return rt.formula_bonus(math_requests(spark, sf), rt.token_table(math_chunks(spark, sf)))


def q_lexical_topk(spark, sf):
    return rt.lexical_topk(requests(spark, sf), tokens(spark, sf))


def q_lexical_topk_salted(spark, sf):
    """The plan for request sets too large to broadcast."""
    hits = rt.lexical_scores(requests(spark, sf), tokens(spark, sf), max_query_rows=0)
    return rt.top_per_key(
        hits.select("query_id", *rt.CHUNK_KEY, "lexical_score"), ["query_id"],
        [F.col("lexical_score").desc(), *[F.col(c) for c in rt.CHUNK_KEY]], 30,
    )


def stored_index(spark: SparkSession, sf: str) -> str:
    """Folder of stored postings: all materials, and those of several chunks once more, as if they had been edited."""
    path, t = scratch(spark, "postings"), stored(tokens(spark, sf), "tokens")
    materials = view(spark, sf, "material").select("goal_id", "material_id")
    ps.write_postings(t, materials, path, 0)
    several = t.filter("chunk_index = 1").select("material_id").distinct()
    several = F.broadcast(several) if is_small(several, 500_000) else several
    edited = materials.join(several, "material_id", "left_semi")
    # a chunk after the first has a chunk 1 beside it: only first chunks need be looked up, and moved for it
    again = t.filter("chunk_index >= 1 and material_id is not null").unionByName(t.filter("chunk_index = 0").join(several, "material_id", "left_semi"))
    ps.write_postings(again, edited, path, 1)
    return path


def narrow_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The requests, each for the first material of its goal that has a chunk."""
    first = chunks(spark, sf).groupBy("goal_id").agg(F.min("material_id").alias("material_id"))
    return requests(spark, sf).join(first, "goal_id")


def q_lexical_topk_stored(spark, sf):
    return ps.stored_topk(requests(spark, sf), stored_index(spark, sf))


def q_lexical_topk_narrow(spark, sf):
    return rt.lexical_topk(narrow_requests(spark, sf), tokens(spark, sf))


def q_lexical_topk_stored_narrow(spark, sf):
    return ps.stored_topk(narrow_requests(spark, sf), stored_index(spark, sf))


def q_merge_hits(spark, sf):
    return merged_hits(spark, sf)


def q_hybrid_search(spark, sf):
    return ranked_hits(spark, sf)


def q_rerank_topk(spark, sf):
    """Pair scores from chunk length stand in for a model; every third chunk has none."""
    hits = stored(ranked_hits(spark, sf, 30), "hits")
    scores = hits.filter(F.col("chunk_index") % 3 != 2).select(
        "query_id", *rt.CHUNK_KEY, ((F.col("material_id") * 7 + F.col("chunk_index") * 13) % 101 / F.lit(101.0)).alias("rerank_score")
    )
    out = rt.rerank_topk(hits, scores, 5)
    return out.select("query_id", *rt.CHUNK_KEY, F.round("rerank_score", 6).alias("rerank_score"), "rank")


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of a request's words that a text has: a scorer in plain Python."""
    words = [(set(q.split(" ")), set(t.split(" "))) for q, t in pairs]
    return [len(q & t) / len(q) for q, t in words]


def q_rerank_scored(spark, sf):
    """Candidates scored pair by pair and ordered anew."""
    hits = stored(ranked_hits(spark, sf, 30), "hits")
    hits = hits.join(chunks_of(hits, sf).select(*rt.CHUNK_KEY, "content"), rt.CHUNK_KEY)
    hits = hits.join(view(spark, sf, "query").select("query_id", "query"), "query_id")
    out = rt.rerank_topk(hits, rt.score_pairs(hits, shared_words), 5)
    return out.select("query_id", *rt.CHUNK_KEY, F.round("rerank_score", 6).alias("rerank_score"), "rank")


def q_scoped_else_global(spark, sf):
    v = view(spark, sf, "vec").select("goal_id", F.col("material_id").alias("day_index"), "chunk_id", "embedding")
    q = vx.mean_pool(v, ["goal_id"]).select(F.col("goal_id").alias("query_id"), "goal_id", (F.col("goal_id") % 12).alias("day_index"), "vector")
    in_day = lambda df: df.withColumn("day_scope", F.concat_ws(":", "goal_id", "day_index"))
    scoped = vx.dense_topk(in_day(q), in_day(v), ["chunk_id"], 3, scope="day_scope")
    return rt.scoped_else_global(q, scoped, lambda rest: vx.dense_topk(rest, v, ["chunk_id"], 3))


def q_useful_hits(spark, sf):
    return rt.useful_hits(view(spark, sf, "query"), full_hits(spark, sf), max_distance=0.75)


def q_first_snippet(spark, sf):
    return rt.first_snippet(full_hits(spark, sf))


def q_cited_files(spark, sf):
    hits = full_hits(spark, sf)
    return rt.cited_files(hits).join(rt.first_source(hits), "query_id")


def q_enriched_search(spark, sf):
    """The whole path: chunk, enrich, embed the enriched text, search both ways, fuse."""
    e = en.enrich_chunks(chunks(spark, sf)).withColumn("content_preview", F.substring("content", 1, 500))
    t = stored(rt.token_table(e, "goal_id", "embedding_text"), "enriched")  # both searches read it, and no text is enriched twice
    c = vx.hash_embed(t, "embedding_text", out="embedding").select("goal_id", *rt.CHUNK_KEY, "embedding")
    q = requests(spark, sf)
    dense = vx.dense_topk(vx.hash_embed(q, "semantic_query"), c, rt.CHUNK_KEY, 30)
    return rt.hybrid_rank(rt.merge_hits(dense, rt.lexical_topk(q, t.drop("embedding_text"))), 5)


QUERIES = {
    "hash_embed": q_hash_embed,
    "hash_embed_dense": q_hash_embed_dense,
    "mean_pool": q_mean_pool,
    "embed_with": q_embed_with,
    "build_queries": q_build_queries,
    "scope_filter": q_scope_filter,
    "dense_topk": q_dense_topk,
    "approximate_topk": q_approximate_topk,
    "approximate_topk_all": q_approximate_topk_all,
    "approximate_recall": q_approximate_recall,
    "dense_topk_own_scopes": q_dense_topk_own_scopes,
    "dense_topk_tiled": q_dense_topk_tiled,
    "bm25_score": q_bm25_score,
    "formula_bonus": q_formula_bonus,
    "lexical_topk": q_lexical_topk,
    "lexical_topk_salted": q_lexical_topk_salted,
    "lexical_topk_stored": q_lexical_topk_stored,
    "lexical_topk_narrow": q_lexical_topk_narrow,
    "lexical_topk_stored_narrow": q_lexical_topk_stored_narrow,
    "merge_hits": q_merge_hits,
    "hybrid_search": q_hybrid_search,
    "rerank_topk": q_rerank_topk,
    "rerank_scored": q_rerank_scored,
    "scoped_else_global": q_scoped_else_global,
    "useful_hits": q_useful_hits,
    "first_snippet": q_first_snippet,
    "cited_files": q_cited_files,
    "enriched_search": q_enriched_search,
}

# --- oracle -------------------------------------------------------------------
_V = d.view("vec")
_UNIT = d.hash_cte(d.view("material"), "material_id", "text")

_CENTROIDS = f"""el AS (SELECT goal_id, material_id, chunk_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM {_V}),
mp AS (SELECT goal_id, material_id, pos, avg(x::DOUBLE) AS m FROM el GROUP BY ALL),
cent AS (SELECT goal_id * 10 + material_id AS query_id, goal_id, list(m ORDER BY pos) AS qv FROM mp GROUP BY ALL)"""
_OWN = f"""vc AS (SELECT *, chunk_id % 7 AS plan_id, chunk_id % 3 AS day_index, CASE WHEN chunk_id % 2 = 0 THEN 'pdf' ELSE 'manual' END AS source_type FROM {_V}),
rq AS (SELECT *, CASE WHEN query_id % 4 = 0 THEN query_id % 10 END AS w_material, CASE WHEN query_id % 4 = 1 THEN query_id % 7 END AS w_plan,
  CASE WHEN query_id % 3 = 0 THEN query_id % 3 END AS w_day, CASE query_id % 5 WHEN 2 THEN 'pdf' WHEN 3 THEN 'slides' END AS w_type FROM cent)"""
_MEETS = """v.goal_id = rq.goal_id AND (w_material IS NULL OR w_material = v.material_id) AND (w_plan IS NULL OR w_plan = v.plan_id)
  AND (w_day IS NULL OR w_day = v.day_index) AND (w_type IS NULL OR w_type = v.source_type)"""
_DENSE = f"""WITH {_CENTROIDS},
p AS (SELECT query_id, chunk_id, round(list_cosine_distance(qv::DOUBLE[], embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS distance FROM cent JOIN {_V} v USING (goal_id))
SELECT query_id, chunk_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS rank FROM p QUALIFY rank <= 10"""


def _tokens(src: str, text: str) -> str:
    """CTEs toks (goal_id, material_id, chunk_index, ts, ft) from relation src (goal_id, material_id, chunk_index, text)."""
    words = f"concat_ws(' ', {d.clean(text)}, substr({text}, 1, 500), coalesce(array_to_string(fs, ' '), ''))"
    ft = f"CASE WHEN len(fs) > 0 THEN list_distinct({d.formula_tokens_of(chr(39) + ' ' + chr(39) + ' || array_to_string(fs, ' + chr(39) + ' ' + chr(39) + ')')}) ELSE [] END"
    return f"""{d.formulas_cte(f'(SELECT material_id, chunk_index, {text} AS text FROM {src})', 'material_id, chunk_index')},
toks AS (SELECT s.goal_id, s.material_id, s.chunk_index, list_distinct({d.lexical_tokens(words)}) AS ts, {ft} AS ft
  FROM {src} s JOIN formulas f ON s.material_id = f.material_id AND s.chunk_index = f.chunk_index)"""


def _requests(src: str, name: str = "req") -> str:
    """CTE req (query_id, goal_id, semantic_query, lt, ft) from src (query_id, goal_id, query)."""
    sem = d.clean("query")
    fs = d.formulas_cte(f"(SELECT query_id, query AS text FROM {src})", "query_id")
    for a in ("f_raw", "f_line", "f_all", "formulas"):
        fs = fs.replace(f"{a} AS", f"q{a} AS").replace(f"FROM {a}", f"FROM q{a}")
    return f"""{fs},
q1 AS (SELECT query_id, goal_id, query, CASE WHEN {sem} <> '' THEN {sem} ELSE {d.strip('query')} END AS semantic_query FROM {src}),
q2 AS (SELECT q1.*, {d.lexical_tokens('semantic_query')} AS l0,
  flatten(list_concat([{d.formula_tokens_of('query')}], list_transform(fs, lambda f: {d.formula_tokens_of('f')}))) AS f0 FROM q1 JOIN qformulas USING (query_id)),
{name} AS (SELECT query_id, goal_id, semantic_query, {d.distinct('l0')}[1:24] AS lt, {d.distinct('f0')}[1:24] AS ft FROM q2)"""


_BM25 = """
post AS (SELECT goal_id, material_id, chunk_index, len(ts) AS len, unnest(ts) AS term FROM toks),
st AS (SELECT goal_id, count(*) AS n, avg(len(ts)::DOUBLE) AS avg_len FROM toks GROUP BY goal_id),
dfq AS (SELECT goal_id, term, count(*) AS df FROM post GROUP BY ALL),
qt AS (SELECT query_id, goal_id, unnest(lt) AS term FROM req),
qf AS (SELECT query_id, goal_id, unnest(ft) AS term FROM req),
bm AS (SELECT query_id, material_id, chunk_index, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.4::DOUBLE
    / (1 + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(avg_len, 1.0::DOUBLE)))) AS bm25
  FROM qt JOIN post USING (goal_id, term) JOIN dfq USING (goal_id, term) JOIN st USING (goal_id) GROUP BY ALL),
fpost AS (SELECT goal_id, material_id, chunk_index, unnest(ft) AS term FROM toks),
fb AS (SELECT query_id, material_id, chunk_index, least(count(*) * 1.2::DOUBLE, 4.8::DOUBLE) AS bonus FROM qf JOIN fpost USING (goal_id, term) GROUP BY ALL),
lex AS (SELECT query_id, material_id, chunk_index, round(coalesce(bm25, 0) + coalesce(bonus, 0), 6) AS lexical_score FROM bm FULL JOIN fb USING (query_id, material_id, chunk_index)),
lexk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, material_id, chunk_index) AS INT) AS rank FROM lex WHERE lexical_score > 0 QUALIFY rank <= 30)"""
_CH = d.chunks_cte()
_BASE = f"{_CH}, {_tokens('chunks', 'content')}, {_requests(d.view('query'))}, {_BM25}"
# As _BASE, with a material in the place of the goal.
_NARROW = f"""{_CH}, {_tokens('chunks', 'content')}, {_requests(d.view('query'))},
reqn AS (SELECT query_id, m AS goal_id, lt, ft FROM req JOIN (SELECT goal_id, min(material_id) AS m FROM chunks GROUP BY goal_id) USING (goal_id)),
toksn AS (SELECT material_id AS goal_id, material_id, chunk_index, ts, ft FROM toks), {_BM25.replace('FROM toks', 'FROM toksn').replace('FROM req', 'FROM reqn')}"""
_HYBRID = f"""{_BASE},
{d.hash_cte('chunks', 'goal_id, material_id, chunk_index', 'content', 'cv')},
{d.hash_cte('req', 'query_id, goal_id', 'semantic_query', 'qv')},
cn AS (SELECT goal_id, material_id, chunk_index, sqrt(sum(w::FLOAT::DOUBLE * w::FLOAT::DOUBLE)) AS nn FROM cv GROUP BY ALL),
qn AS (SELECT query_id, goal_id, sqrt(sum(w::FLOAT::DOUBLE * w::FLOAT::DOUBLE)) AS nn FROM qv GROUP BY ALL),
dots AS (SELECT query_id, material_id, chunk_index, sum(cv.w::FLOAT::DOUBLE * qv.w::FLOAT::DOUBLE) AS dot FROM cv JOIN qv USING (goal_id, bucket) GROUP BY ALL),
allp AS (SELECT req.query_id, c.material_id, c.chunk_index, round(1.0::DOUBLE - coalesce(dot / (cn.nn * qn.nn), 0), 6) AS distance
  FROM req JOIN chunks c USING (goal_id) LEFT JOIN dots p ON p.query_id = req.query_id AND p.material_id = c.material_id AND p.chunk_index = c.chunk_index
  LEFT JOIN cn ON cn.material_id = c.material_id AND cn.chunk_index = c.chunk_index LEFT JOIN qn ON qn.query_id = req.query_id),
densek AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, material_id, chunk_index) AS rank FROM allp QUALIFY rank <= 30),
merged AS (SELECT query_id, material_id, chunk_index, distance, lexical_score,
  CASE WHEN distance IS NOT NULL AND lexical_score IS NOT NULL THEN 'hybrid' WHEN distance IS NOT NULL THEN 'dense' ELSE 'lexical' END AS retrieval_source
  FROM (SELECT query_id, material_id, chunk_index, distance FROM densek) FULL JOIN (SELECT query_id, material_id, chunk_index, lexical_score FROM lexk) USING (query_id, material_id, chunk_index)),
scored AS (SELECT *, round(CASE WHEN distance IS NULL THEN 0 ELSE 1.0::DOUBLE / (1.0::DOUBLE + greatest(distance, 0)) END * 0.7::DOUBLE
  + least(coalesce(lexical_score, 0), 8) / 8.0::DOUBLE * 0.3::DOUBLE, 6) AS score FROM merged),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, material_id, chunk_index) AS INT) AS rank FROM scored)"""
_MATH = f"(SELECT p_size % 5 AS goal_id, chunk_id AS material_id, 0 AS chunk_index, text FROM {d.view('math')} m JOIN part ON p_partkey = chunk_id)"
_MREQ = "(SELECT s_suppkey AS query_id, CAST(s_suppkey % 5 AS INT) AS goal_id, concat('solve $x_{', s_suppkey % 50, CASE s_suppkey % 4 WHEN 0 THEN '}^2$ + alpha / 2' WHEN 1 THEN '}$ = b' WHEN 2 THEN '}$' ELSE '} + q$' END) AS query FROM supplier)"
_FULL = f"WITH {_HYBRID}, hits AS (SELECT r.*, content, filename, concat(filename, '#chunk-', r.chunk_index) AS source FROM ranked r JOIN chunks c ON r.material_id = c.material_id AND r.chunk_index = c.chunk_index WHERE rank <= 10)"

ORACLE = {
    "hash_embed": f"WITH {_UNIT} SELECT material_id, bucket, round(w, 6) AS weight FROM hashed",
    "hash_embed_dense": f"""WITH {_UNIT} SELECT material_id, 384::BIGINT AS dims, round(coalesce(sum(w::FLOAT::DOUBLE * (bucket + 1)), 0), 4) AS checksum
FROM {d.view('material')} LEFT JOIN hashed USING (material_id) GROUP BY material_id""",
    "mean_pool": f"""SELECT material_id, CAST(pos AS INT) AS pos, round(avg(x::DOUBLE), 6) AS mean
FROM (SELECT material_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM {_V}) GROUP BY ALL""",
    "build_queries": f"""WITH g AS (SELECT *, concat(current_level, ' ', goal_type) AS topics FROM {d.view('goal')}), p AS (SELECT * FROM {d.view('plan')}),
lu AS (SELECT conv_id, coalesce({d.strip("arg_max(text, turn) FILTER (WHERE role = 'user')")}, '') AS message FROM conversations GROUP BY conv_id),
ch AS (SELECT lu.conv_id, message, p.goal_id AS pg, p.topic, p.status, CASE WHEN conv_id % 4 <> 3 THEN conv_id END AS gid
  FROM lu LEFT JOIN p ON p.plan_id = CASE WHEN conv_id % 3 = 0 THEN conv_id END),
cq AS (SELECT conv_id, coalesce(gid, pg) AS goal_id, topic, message, status FROM ch)
SELECT 'planner' AS consumer, goal_id, NULL::BIGINT AS key_a, NULL::BIGINT AS key_b, {d.strip("concat_ws(' ', title, topics)")} AS query, 6 AS k FROM g
UNION ALL SELECT 'quiz', p.goal_id, p.plan_id, t.task_no, {d.strip("concat_ws(' ', t.title, t.status, p.topic, g.topics)")}, 4 FROM {d.view('task')} t JOIN p USING (plan_id) JOIN g ON g.goal_id = p.goal_id
UNION ALL SELECT 'tasks', goal_id, plan_id, day_index, {d.strip('topic')}, 3 FROM p
UNION ALL SELECT 'chat', cq.goal_id, conv_id, NULL, {d.strip("concat_ws(' ', nullif(message, ''), CASE WHEN topic IS NOT NULL THEN concat(topic, ' ', status) ELSE concat_ws(' ', g.title, g.topics) END)")}, 3 FROM cq LEFT JOIN g USING (goal_id) WHERE cq.goal_id IS NOT NULL""",
    "scope_filter": f"WITH {_CENTROIDS}, {_OWN} SELECT rq.query_id, count(v.chunk_id) AS chunks FROM rq LEFT JOIN vc v ON {_MEETS} GROUP BY rq.query_id",
    "dense_topk_own_scopes": f"""WITH {_CENTROIDS}, {_OWN},
p AS (SELECT rq.query_id, chunk_id, round(list_cosine_distance(qv::DOUBLE[], embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS distance FROM rq JOIN vc v ON {_MEETS})
SELECT query_id, chunk_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS rank FROM p QUALIFY rank <= 5""",
    "dense_topk": _DENSE,
    "approximate_topk_all": _DENSE,
    "dense_topk_tiled": _DENSE,
    "bm25_score": f"WITH {_BASE} SELECT query_id, material_id, chunk_index, round(bm25, 6) AS bm25 FROM bm",
    "formula_bonus": f"WITH mc AS {_MATH}, {_tokens('mc', 'text')}, {_requests(_MREQ)}, {_BM25} SELECT query_id, material_id, chunk_index, round(bonus, 6) AS bonus FROM fb",
    "lexical_topk": f"WITH {_BASE} SELECT query_id, material_id, chunk_index, lexical_score, rank FROM lexk",
    "lexical_topk_salted": f"WITH {_BASE} SELECT query_id, material_id, chunk_index, lexical_score, rank FROM lexk",
    "lexical_topk_stored": f"WITH {_BASE} SELECT query_id, material_id, chunk_index, lexical_score, rank FROM lexk",
    "lexical_topk_narrow": f"WITH {_NARROW} SELECT query_id, material_id, chunk_index, lexical_score, rank FROM lexk",
    "lexical_topk_stored_narrow": f"WITH {_NARROW} SELECT query_id, material_id, chunk_index, lexical_score, rank FROM lexk",
    "merge_hits": f"WITH {_HYBRID} SELECT query_id, material_id, chunk_index, distance, lexical_score, retrieval_source FROM merged",
    "hybrid_search": f"WITH {_HYBRID} SELECT query_id, material_id, chunk_index, distance, lexical_score, retrieval_source, score, rank FROM ranked WHERE rank <= 10",
    "rerank_topk": f"""WITH {_HYBRID}, s AS (SELECT query_id, material_id, chunk_index, CASE WHEN chunk_index % 3 <> 2 THEN round((material_id * 7 + chunk_index * 13) % 101 / 101.0::DOUBLE, 6) ELSE 0.0::DOUBLE END AS rerank_score FROM ranked WHERE rank <= 30)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, material_id, chunk_index) AS INT) AS rank FROM s QUALIFY rank <= 5""",
    "rerank_scored": f"""WITH {_HYBRID}, w AS (SELECT r.query_id, r.material_id, r.chunk_index, list_distinct(string_split(q.query, ' ')) AS qw, list_distinct(string_split(c.content, ' ')) AS cw
  FROM ranked r JOIN chunks c USING (material_id, chunk_index) JOIN {d.view('query')} q ON q.query_id = r.query_id WHERE rank <= 30),
s AS (SELECT query_id, material_id, chunk_index, len(list_intersect(qw, cw))::DOUBLE / len(qw) AS score FROM w)
SELECT query_id, material_id, chunk_index, round(score, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, material_id, chunk_index) AS INT) AS rank FROM s QUALIFY rank <= 5""",
    "scoped_else_global": f"""WITH el AS (SELECT goal_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM {_V}),
mp AS (SELECT goal_id, pos, avg(x::DOUBLE) AS m FROM el GROUP BY ALL),
cent AS (SELECT goal_id AS query_id, goal_id, goal_id % 12 AS day_index, list(m ORDER BY pos) AS qv FROM mp GROUP BY ALL),
p AS (SELECT query_id, chunk_id, v.material_id = day_index AS in_day, round(list_cosine_distance(qv::DOUBLE[], embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS distance FROM cent JOIN {_V} v USING (goal_id)),
w AS (SELECT *, bool_or(in_day) OVER (PARTITION BY query_id) AS any_day FROM p)
SELECT query_id, chunk_id, distance, CASE WHEN any_day THEN 'day' ELSE 'global' END AS scope_used,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS rank FROM w WHERE in_day OR NOT any_day QUALIFY rank <= 3""",
    "useful_hits": f"""{_FULL} SELECT req.query_id, CASE WHEN bool_or(length({d.strip('content')}) >= 80 AND (distance IS NULL OR distance <= 0.75)) THEN 'rag' ELSE 'llm_fallback' END AS source_mode
FROM req LEFT JOIN hits USING (query_id) GROUP BY req.query_id""",
    "first_snippet": f"{_FULL} SELECT query_id, substr(arg_min({d.strip('content')}, rank), 1, 180) AS snippet FROM hits GROUP BY query_id",
    "cited_files": f"""{_FULL}, ff AS (SELECT query_id, filename, min(rank) AS rank FROM hits GROUP BY ALL),
fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM ff QUALIFY n <= 2),
fs AS (SELECT query_id, string_agg(filename, '、' ORDER BY n) AS files FROM fk GROUP BY query_id)
SELECT query_id, files, source FROM fs JOIN (SELECT query_id, arg_min(source, rank) AS source FROM hits GROUP BY query_id) USING (query_id)""",
}


def _enriched_search() -> str:
    """The hybrid query with enriched texts as dense documents; their tokens include ideographs and pairs."""
    cjk = "regexp_extract_all(embedding_text, '[一-鿿]')"
    toks = f"""ev_c AS (SELECT material_id, chunk_index, embedding_text, {cjk} AS cs FROM enr),
ev_l AS (SELECT material_id, chunk_index, list_concat(list_concat(regexp_extract_all(lower(embedding_text), '[a-z0-9_]+'), cs),
  list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) AS ts FROM ev_c),
ev_t AS (SELECT c.goal_id, e.material_id, e.chunk_index, unnest(ts) AS tok FROM ev_l e JOIN chunks c ON c.material_id = e.material_id AND c.chunk_index = e.chunk_index),
cv_t AS (SELECT * FROM ev_t)"""
    base = _HYBRID.replace(d.hash_cte("chunks", "goal_id, material_id, chunk_index", "content", "cv"), "@@")
    plain = d.hash_cte("chunks", "goal_id, material_id, chunk_index", "content", "cv")
    rest = plain[plain.index("cv_h AS"):]
    src = f"esrc AS (SELECT material_id, chunk_index, content AS text, {d.clean('content')} AS rt FROM chunks)"
    from coursemine.catalog.text_queries import enriched_cte

    enr = enriched_cte("esrc")
    for name in ("f_raw", "f_line", "f_all", "formulas"):
        enr = enr.replace(f"{name} AS", f"e{name} AS").replace(f"FROM {name}", f"FROM e{name}").replace(f"JOIN {name} ", f"JOIN e{name} ")
    enr = enr.replace("ranked", "eranked")
    return f"WITH {base.replace('@@', f'{src}, {enr}, {toks}, {rest}')} SELECT query_id, material_id, chunk_index, distance, lexical_score, retrieval_source, score, rank FROM ranked WHERE rank <= 5"


ORACLE["enriched_search"] = _enriched_search()
# every text with a token has a unit vector, whichever hash is used
ORACLE["embed_with"] = ORACLE["hash_embed"] + " WHERE round(w, 6) <> 0"
