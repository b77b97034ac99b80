"""The study tables, mapped from the synthetic tables: each as a DataFrame and as DuckDB SQL.

A mapping is one SELECT that both engines understand, but for a few functions named per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import HAN, PAGE_LINES

#: Functions spelled differently: (Spark, DuckDB).
SPELLING = {
    "{days:": ("datediff(cast(%s as date), date'1970-01-01')", "date_diff('day', date '1970-01-01', cast(%s as date))"),
    "{lines:": ("split(%s, '\\n', -1)", "string_split(%s, chr(10))"),
}

BOOK = "cast(substr(source, 4) as bigint)"

SOURCES: dict[str, str] = {
    "settings": "SELECT r_name AS key, cast(r_regionkey as string) AS value FROM region",
    "books": f"""SELECT {BOOK} AS id, source AS title, 'READY' AS status, cast(count(*) as bigint) AS total_chapters, min(doc_id) * 1000 AS created_at,
        max(doc_id) * 1000 AS updated_at, CASE WHEN {BOOK} % 3 = 0 THEN NULL ELSE cast(sum(n_chars) as bigint) END AS last_read_at, cast(NULL as bigint) AS last_chapter_id,
        CASE WHEN {BOOK} % 2 = 0 THEN concat('{{"gist":"', source, '"}}') END AS overview_json FROM documents GROUP BY source""",
    "chapters": f"""SELECT doc_id AS id, {BOOK} AS book_id, cast(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 as int) AS idx, concat('Chapter ', cast(doc_id as string)) AS title,
        CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END AS level, CASE doc_id % 3 WHEN 0 THEN 'UNREAD' WHEN 1 THEN 'READING' ELSE 'DONE' END AS read_state,
        CASE WHEN doc_id % 9 = 8 THEN NULL ELSE cast(doc_id % 400 + 1 as int) END AS start_page, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang END AS ai_gist,
        CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('[{{"term":"', lang, ' ', cast(doc_id % 11 as string), '","plain":"', source, '"}}]') END AS key_terms_json, 0 AS last_read_para FROM documents""",
    "paragraphs": """SELECT doc_id * 100000 + pos AS id, doc_id AS chapter_id, cast(pos as int) AS idx, line AS text,
        CASE pos % 11 WHEN 3 THEN 'TOC' WHEN 5 THEN 'FOOTNOTE' WHEN 7 THEN 'FIGURE' WHEN 9 THEN 'TITLE' ELSE 'BODY' END AS role,
        CASE WHEN pos % 4 = 0 THEN NULL ELSE cast(floor(pos / 4) as int) + 1 END AS page_no, cast(NULL as string) AS ai_action, cast(NULL as bigint) AS group_id, cast(NULL as string) AS why FROM lines""",
    "para_notes": "SELECT doc_id * 100000 + pos AS id, doc_id AS chapter_id, concat('[', cast(doc_id * 100000 + pos as string), ']') AS para_ids, line AS note, pos * 10 AS created_at FROM lines WHERE pos % 6 = 0",
    "chapter_assets": """SELECT doc_id AS chapter_id, concat('quality ', cast(quality as string)) AS summary_md, CASE WHEN toxic = 0 THEN 'root' END AS mindmap_tree,
        '[{"q":"one","type":"RECALL"},{"q":"two","type":"APPLY"},{"q":"three","type":"OTHER"}]' AS quiz_json, 1 AS prompt_version, doc_id * 7 AS created_at FROM labels""",
    "quiz_attempts": """SELECT event_id AS id, user_id AS chapter_id, CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS q_index,
        props AS answer, CASE event_id % 3 WHEN 0 THEN 'WRONG' WHEN 1 THEN 'PARTIAL' ELSE 'RIGHT' END AS verdict, cast(floor(value) as bigint) AS created_at FROM events""",
    "review_items": """SELECT o_orderkey AS id, o_custkey % 20 AS book_id, o_custkey AS chapter_id, o_orderpriority AS title, 0 AS interval_idx, cast({days:o_orderdate} as bigint) * 86400000 AS due_at,
        o_orderstatus = 'F' AS done, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS fsrs_state, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderkey % 50 + 1 as double) END AS fsrs_stability,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderkey % 9 + 1 as double) END AS fsrs_difficulty, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast({days:o_orderdate} as bigint) * 86400000 - 864000000 END AS last_review_at FROM orders""",
    "review_log": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS item_id, cast(1 + (l_linenumber - 1) % 4 as int) AS rating, cast({days:l_shipdate} as bigint) * 86400000 AS reviewed_at FROM lineitem",
    "vision_queue": """SELECT o_orderkey AS id, o_custkey % 20 AS book_id, cast(o_orderkey % 500 as int) AS page_no, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
        cast(o_orderkey % 4 as int) AS attempts, cast({days:o_orderdate} as bigint) AS updated_at FROM orders""",
    "figures": "SELECT p_partkey AS id, cast(p_size % 20 as bigint) AS book_id, p_partkey % 1000 AS chapter_id, p_size AS page_no, cast(p_partkey % 7 - 1 as int) AS ord_after_para, p_retailprice AS y, p_brand AS md5 FROM part",
    "bookmarks": "SELECT c_custkey AS id, cast(c_nationkey % 20 as bigint) AS book_id, c_custkey % 1000 AS chapter_id, cast(c_nationkey as int) AS para_idx, c_name AS preview, cast(floor(c_acctbal) as bigint) AS created_at FROM customer",
    "para_memos": "SELECT s_suppkey AS id, cast(s_nationkey % 20 as bigint) AS book_id, s_suppkey % 50 AS chapter_id, s_suppkey % 13 AS para_idx, s_name AS memo, cast(floor(s_acctbal) as bigint) AS created_at FROM supplier",
    "qa_history": "SELECT conv_id * 1000 + turn AS id, conv_id % 20 AS book_id, conv_id % 50 AS chapter_id, role AS chapter_title, text AS question, cast(floor(turn / 2) as bigint) AS created_at FROM conversations",
    "reading_stats": "SELECT user_id AS book_id, cast(cast(ts as date) as string) AS day, cast(sum(cast(floor(value) as bigint)) as bigint) AS minutes FROM events GROUP BY user_id, cast(cast(ts as date) as string)",
}

SOURCES["page_lines"] = PAGE_LINES
SOURCES["han"] = HAN
LINES = {
    "spark": "SELECT doc_id, cast(p as bigint) AS pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n', -1)) t AS p, line",
    "duckdb": "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents",
}
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages", "benchmark", "embeddings")


def _spelled(sql: str, engine: int) -> str:
    for head, ways in SPELLING.items():
        while head in sql:
            at = sql.index(head)
            end = sql.index("}", at)
            sql = sql[:at] + ways[engine] % sql[at + len(head) : end] + sql[end + 1 :]
    return sql.replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A study table, or a raw one, as a DataFrame."""
    if name in RAW:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spelled(SOURCES[name], 0) if name != "lines" else LINES["spark"]
    source = next(r for r in (*RAW, "lines") if f"FROM {r}" in sql)
    view = f"folio_{source}_{abs(hash(sf_dir))}"
    table(spark, sf_dir, source).createOrReplaceTempView(view)
    df = spark.sql(sql.replace(f"FROM {source}", f"FROM {view}"))
    if name == "han":
        # generated, so that what reads the text several times has a column there, not this long expression each time
        df = df.select(*[F.explode(F.array("text")).alias("text") if c == "text" else c for c in df.columns])
    return df


def oracle(sql: str) -> str:
    """DuckDB SQL over study tables: those it names are defined before it."""
    import re

    used = [n for n in SOURCES if re.search(rf"\b{n}\b", sql)]
    bodies = {n: _spelled(SOURCES[n], 1).replace(" as string)", " as varchar)") for n in used}
    lines = {"lines": LINES["duckdb"]} if any("FROM lines" in b for b in [*bodies.values(), sql]) else {}
    defined = ", ".join(f"{n} AS ({b})" for n, b in (lines | bodies).items())
    sql = sql.replace(" as string)", " as varchar)")
    if not defined:
        return sql
    return f"WITH {defined}, {sql[5:]}" if sql.lstrip().startswith("WITH ") else f"WITH {defined} {sql}"
