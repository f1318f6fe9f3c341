"""Entity views over the driver's tables; the only place that reads raw tables.

Each view is one SQL text with table names in braces, so the Spark query and its
DuckDB counterpart start from the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemine.operators.ranking import number_in_key

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "material": """
SELECT doc_id AS material_id, CAST(substr(source, 4) AS INT) AS goal_id,
       concat(source, '/', CAST(doc_id AS STRING), '.md') AS filename, 'md' AS file_type, text
FROM {documents}""",
    "pages": """
SELECT conv_id AS material_id, CAST(turn + 1 AS INT) AS page_index,
       CASE WHEN turn % 7 = 3 THEN '' ELSE text END AS built_in_text,
       CASE WHEN turn % 5 = 0 THEN concat('# ', text) END AS ocr_text
FROM {conversations}""",
    "query": """
SELECT item_id AS query_id, CAST(item_id % 20 AS INT) AS goal_id, text AS query
FROM {benchmark}""",
    "vec": """
SELECT vec_id AS chunk_id, CAST(label AS INT) AS material_id, CAST(vec_id % 20 AS INT) AS goal_id, embedding
FROM {embeddings}""",
    "goal": """
SELECT c_custkey AS goal_id, c_name AS title,
       CASE WHEN c_custkey % 2 = 0 THEN 'exam' ELSE 'duration' END AS goal_type,
       CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-01-01' + CAST(c_custkey % 200 AS INT) END AS exam_date,
       CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey % 130 AS INT) END AS duration_days,
       CAST(c_custkey % 650 AS INT) AS daily_minutes, c_mktsegment AS current_level
FROM {customer}""",
    "plan": """
SELECT o_orderkey AS plan_id, o_custkey AS goal_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS day_index,
       CAST(o_orderdate AS DATE) AS plan_date,
       concat(o_orderpriority, ' ', CAST(o_orderkey % 13 AS STRING)) AS topic, o_orderstatus AS status
FROM {orders}""",
    "task": """
SELECT l_orderkey AS plan_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS task_no,
       concat('Part ', CAST(l_partkey AS STRING)) AS title, CAST(l_quantity AS INT) AS estimated_minutes,
       CASE WHEN l_returnflag = 'R' THEN 'missed' WHEN l_returnflag = 'A' THEN 'partial'
            WHEN l_linestatus = 'F' THEN 'done' ELSE 'pending' END AS status
FROM {lineitem}""",
    "quiz_question": """
SELECT l_orderkey AS quiz_id, concat('q', CAST(l_linenumber AS STRING)) AS question_id,
       'single_choice' AS type, min(l_returnflag) AS correct_answer
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "quiz_answer": """
SELECT l_orderkey AS quiz_id, concat('q', CAST(l_linenumber AS STRING)) AS question_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS seq,
       CASE WHEN l_linenumber = 3 THEN NULL WHEN l_partkey % 2 = 0 THEN concat(' ', lower(l_returnflag)) ELSE l_linestatus END AS answer
FROM {lineitem}""",
    "events": """
SELECT user_id AS job_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'success'
            WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
       CAST(floor(value) AS INT) AS progress
FROM {events}""",
    "toc": """
SELECT p_size AS material_id, p_partkey AS line_no,
       CASE WHEN p_partkey % 40 = 0 THEN 'Contents'
            WHEN p_partkey % 4 = 0 THEN concat('Chapter ', CAST(p_partkey % 25 AS STRING), ' ', p_name, ' ..... ', CAST(p_partkey % 300 AS STRING))
            WHEN p_partkey % 4 = 1 THEN concat(CAST(p_partkey % 9 AS STRING), '.', CAST(p_partkey % 5 AS STRING), ' ', p_name)
            WHEN p_partkey % 4 = 2 THEN concat('# Section ', CAST(p_partkey % 7 AS STRING), '.', CAST(p_partkey % 3 AS STRING), ': ', p_type)
            ELSE p_name END AS line
FROM {part}""",
    "math": """
SELECT p_partkey AS chunk_id,
       concat('Let $x_{{', CAST(p_size AS STRING), '}}^2$ be ', p_name, chr(10),
              CASE WHEN p_partkey % 3 = 0 THEN concat('a = b + ', CAST(p_size AS STRING), ' - c') ELSE p_type END, chr(10),
              chr(92), 'frac{{', CAST(p_size AS STRING), '}}{{2}} ', chr(92), 'alpha') AS text
FROM {part}""",
}
# Views with a number per key, as Spark builds them: the same rows without the
# number, the key, a block that grows with the order, the order, the number's name.
# One goal or plan may hold much of a table, so it is numbered block by block.
_LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    "l_returnflag", "l_linestatus",
]
_LINE_BLOCK = "struct(l_linenumber, floor(l_partkey / 1000))"
NUMBERED = {
    # a date and a slice of the keys: blocks stay small for a goal with a third of all orders
    "plan": ("goal_id", "struct(o_orderdate, floor(o_orderkey / 100000))", ["o_orderdate", "o_orderkey"], "day_index"),
    "task": ("plan_id", _LINE_BLOCK, _LINE_ORDER, "task_no"),
    "quiz_answer": ("quiz_id", _LINE_BLOCK, _LINE_ORDER, "seq"),
}
MULTI_SPARK = """
SELECT conv_id AS material_id,
       listagg(text, concat(chr(10), chr(10))) WITHIN GROUP (ORDER BY turn) AS text
FROM {conversations} GROUP BY conv_id"""
MULTI_DUCK = """
SELECT conv_id AS material_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that is planned with fewer tasks than cores over all cores.

    Text operators are bound by CPU, and a small table of one row group is one task.  The
    planned number of tasks is known without a job and without the list of files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = MULTI_SPARK if name == "multi" else VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    if "documents" in used:
        used["documents"] = fill_cores(used["documents"], "doc_id")
    if name == "math":
        used["part"] = fill_cores(used["part"], "p_partkey")
    if name in NUMBERED:
        return _numbered(spark, text, used, *NUMBERED[name])
    return spark.sql(text, **used)


def _numbered(
    spark: SparkSession, text: str, used: dict[str, DataFrame], key: str, block: str, order: list[str], number: str
) -> DataFrame:
    columns = spark.sql(text, **used).columns
    start, end = text.index("CAST(row_number()"), text.index(f"AS {number},") + len(f"AS {number},")
    bare = text[:start] + "".join(f"{c} AS _{c}, " for c in order) + f"{block} AS _b, " + text[end:]
    rows = number_in_key(spark.sql(bare, **used), [key], F.col("_b"), [F.col(f"_{c}") for c in order], number)
    return rows.select(*columns)


def duck(name: str) -> str:
    """The view as a parenthesized DuckDB subquery."""
    text = MULTI_DUCK if name == "multi" else VIEWS[name].format(**{t: t for t in TABLES})
    return f"({text.strip()})"
