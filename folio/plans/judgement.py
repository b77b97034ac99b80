"""Judgements on chapters and pages over the study tables (P13–P15, A19, A20, A29, R, X05, X08, X13, C13, C24)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import parsing as J
from ..operators import review as V
from ..operators import temporal as X
from ..sources.roles import oracle, table
from . import structure

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def with_titles(t):
    chapters = t("chapters").select(F.col("id").alias("chapter_id"), "book_id", F.col("idx").alias("chapter_idx"), "title")
    return t("paragraphs").join(chapters, "chapter_id")


@query(
    "P13_phantom_chapters",
    "WITH b AS (SELECT p.chapter_id, p.idx, p.text, NOT regexp_matches(trim(text), '^[A-Z]') AS other FROM paragraphs p WHERE role = 'BODY'), c AS (SELECT chapter_id, count(*) AS n, count(*) FILTER (other) AS others, max(CASE WHEN other THEN length(text) END) AS longest FROM b GROUP BY 1) SELECT chapter_id, CASE WHEN n < 2 THEN 'keep' WHEN others = 0 THEN CASE WHEN n <= 15 THEN 'drop' ELSE 'keep' END WHEN others <= 3 AND longest >= 2000 THEN 'clean' ELSE 'keep' END AS decision FROM c",
)
def phantom(t):
    return V.phantom_chapters(with_titles(t), title_shape="^Chapter", entry_shape="^[A-Z]").select("chapter_id", "decision")


@query(
    "P14_front_matter",
    "WITH c AS (SELECT chapter_id, count(*) AS n, sum(length(text)) AS chars, list_sort(list(length(text))) AS l, count(*) FILTER (regexp_matches(trim(text), '/\\s*\\d{1,4}\\s*$')) AS tails, count(*) FILTER (regexp_matches(trim(text), '^[^，。；：！？、,.;:!?]*$')) AS plain, arg_min(role, idx) AS r FROM paragraphs GROUP BY 1) SELECT chapter_id, 'contents' AS rule FROM c WHERE r = 'BODY' AND n >= 5 AND l[CAST(floor(n / 2) AS INT) + 1] <= 40 AND (tails * 10 >= n * 7 OR (plain * 10 >= n * 7 AND chars < 3000))",
)
def front(t):
    return V.front_matter(with_titles(t))


@query(
    "A19_rules_fallback",
    "WITH p AS (SELECT book, page, count(*) AS before, count(*) FILTER (NOT contains(text, '|')) AS after FROM page_lines GROUP BY 1, 2) SELECT book, page, CASE WHEN after = 0 THEN before ELSE after END AS kept, after = 0 AS flagged FROM p",
)
def rules_fallback(t):
    """Lines kept by a rule; a page that would lose all keeps all, and is flagged."""
    p = t("page_lines").groupBy("book", "page").agg(F.count("*").alias("before"), F.count_if(~F.col("text").contains("|")).alias("after"))
    return p.select("book", "page", F.when(F.col("after") == 0, F.col("before")).otherwise(F.col("after")).alias("kept"), (F.col("after") == 0).alias("flagged"))


@query("A20_quality_note", "WITH g AS (SELECT book, list_sort(list(length(text))) AS l, count(*) AS n FROM page_lines GROUP BY 1) SELECT book, l[CAST(floor(n / 2) AS INT) + 1] AS median, CAST(len(list_filter(l, lambda x: x < 10)) AS DOUBLE) / n AS low FROM g")
def quality_note(t):
    g = t("page_lines").groupBy("book").agg(F.sort_array(F.collect_list(F.length("text"))).alias("l"), F.count("*").alias("n"))
    return g.select("book", F.get("l", F.floor(F.col("n") / 2).cast("int")).alias("median"), (F.size(F.filter("l", lambda x: x < 10)) / F.col("n")).alias("low"))


@query("A29_portrait_share", "SELECT book, avg(CASE WHEN y0 > x0 THEN 1.0 ELSE 0.0 END) AS share FROM page_lines GROUP BY 1")
def portrait(t):
    return t("page_lines").groupBy("book").agg(F.avg((F.col("y0") > F.col("x0")).cast("double")).alias("share"))


@query("A12_global_body_size", "WITH s AS (SELECT book, round(size, 1) AS b, sum(length(text)) AS n FROM page_lines WHERE y0 BETWEEN 50 AND 350 GROUP BY 1, 2) SELECT book, arg_max(b, struct_pack(n := n, b := b)) AS body FROM s GROUP BY 1")
def global_body(t):
    return X.weighted_mode(t("page_lines").where("y0 between 50 and 350"), ["book"], F.round("size", 1), F.length("text"), name="body")


@query("A22_latest_wrong", "SELECT id FROM (SELECT * FROM quiz_attempts QUALIFY row_number() OVER (PARTITION BY chapter_id, q_index ORDER BY created_at DESC, id DESC) = 1) WHERE verdict = 'WRONG'")
def latest_wrong(t):
    from .study import latest_attempts

    return latest_attempts(t("quiz_attempts")).where("verdict = 'WRONG'").select("id")


@query("A24_coverage_guard", "SELECT chapter_id, CAST(sum(length(text)) FILTER (role = 'BODY') AS BIGINT) * 10 >= CAST(sum(length(text)) AS BIGINT) * 8 AS covered FROM paragraphs GROUP BY 1")
def coverage(t):
    body = F.sum(F.when(F.col("role") == "BODY", F.length("text")))
    return t("paragraphs").groupBy("chapter_id").agg((body * 10 >= F.sum(F.length("text")) * 8).alias("covered"))


@query("R03_figure_areas", "SELECT book, page, ord FROM page_lines WHERE (x1 - x0) * size / 480000 > 0.005 AND (x1 - x0) * size / 480000 < 0.85")
def figure_areas(t):
    area = (F.col("x1") - F.col("x0")) * F.col("size") / 480000
    return t("page_lines").where((area > 0.005) & (area < 0.85)).select("book", "page", "ord")


@query("R04_decorations", "SELECT book, page, ord FROM page_lines WHERE size < 12 OR size / (x1 - x0) < 0.06")
def decorations(t):
    return t("page_lines").where("size < 12 or size / (x1 - x0) < 0.06").select("book", "page", "ord")


@query("R07_page_lists", "WITH p AS (SELECT book_id, list_sort(list(DISTINCT page_no)) AS p FROM figures GROUP BY 1) SELECT book_id, array_to_string(list_transform(p[1:5], lambda x: 'p' || x), '、') || CASE WHEN len(p) > 5 THEN ' 等 ' || len(p) || ' 张' ELSE '' END AS pages FROM p")
def page_lists(t):
    return t("figures").groupBy("book_id").agg(F.collect_set("page_no").alias("p")).select("book_id", V.page_list(F.col("p")).alias("pages"))


@query("R08_role_profiles", "SELECT key AS role, CASE WHEN key IN ('ASIA', 'AFRICA') THEN value WHEN key <> 'EUROPE' THEN (SELECT value FROM settings WHERE key = 'AFRICA') END AS profile FROM settings")
def role_profiles(t):
    s = t("settings")
    return V.resolve_roles(s.select(F.col("key").alias("role")), s.where("key in ('ASIA', 'AFRICA')").select(F.col("key").alias("role"), F.col("value").alias("profile")), "AFRICA", ["EUROPE"])


@query("R09_feedback_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1")
def feedback(t):
    return t("events").where(F.col("event_type").isin("error", "click")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("R10_key_values", "SELECT book_id, count(*) AS n FROM chapters GROUP BY 1")
def key_values(t):
    """Lines of `key value` as a map; here titles and ids, counted back."""
    line = F.concat_ws("  ", F.col("id").cast("string"), "title")
    pair = F.struct(F.regexp_extract(line, r"^(\S+)\s", 1).alias("k"), F.regexp_extract(line, r"\s\s(.*)$", 1).alias("v"))
    return t("chapters").groupBy("book_id").agg(F.map_from_entries(F.collect_list(pair)).alias("m")).select("book_id", F.size("m").cast("long").alias("n"))


@query("R22_spot_check")
def spot_check(t):
    """Five pages of a book in a seeded order, with their text."""
    picks = structure.seeded_sample(t)
    lines = t("page_lines").join(picks, ["book", "page"], "left_semi").groupBy("book", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return lines


@query("X05_explain_units", "SELECT chapter_id, idx AS anchor, 1 AS members FROM paragraphs WHERE role = 'TITLE' UNION ALL SELECT chapter_id, CAST(min(idx) AS INT) AS anchor, CAST(least(3, count(*)) AS INT) AS members FROM paragraphs WHERE role = 'BODY' AND page_no IS NOT NULL GROUP BY chapter_id, page_no")
def units(t):
    p = t("paragraphs").withColumns({"ai_action": F.when(F.col("role") == "TITLE", "EXPLAIN").when((F.col("role") == "BODY") & F.col("page_no").isNotNull(), "GROUP"), "group_id": -F.col("page_no").cast("long")})
    return J.explain_units(p).select("chapter_id", "anchor", F.size("members").alias("members"))


@query(
    "X08_questions",
    "WITH q AS (SELECT chapter_id, idx, text, count(*) FILTER (idx % 3 = 0) OVER (PARTITION BY chapter_id ORDER BY idx) AS k FROM paragraphs) SELECT chapter_id, k, min(CASE WHEN idx % 3 = 0 THEN text END) AS question, count(*) - 1 AS answer_lines FROM q GROUP BY 1, 2",
)
def questions(t):
    """Lines grouped under the question line that opens them."""
    q = X.islands(t("paragraphs"), ["chapter_id"], ["idx"], F.col("idx") % 3 == 0, "k")
    return q.groupBy("chapter_id", "k").agg(F.min(F.when(F.col("idx") % 3 == 0, F.col("text"))).alias("question"), (F.count("*") - 1).alias("answer_lines"))


@query("X13_learner_context", "WITH q AS (SELECT chapter_id, string_agg(left(answer, 40), '；' ORDER BY id) AS a FROM quiz_attempts WHERE verdict = 'WRONG' GROUP BY 1), m AS (SELECT chapter_id, string_agg(left(memo, 60), '；' ORDER BY id) AS b FROM para_memos GROUP BY 1) SELECT q.chapter_id, '做错的题：' || a || coalesce(chr(10) || '读者批注：' || b, '') AS context FROM q LEFT JOIN m USING (chapter_id)")
def learner(t):
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("id", c))), lambda s: s[c])
    wrong = t("quiz_attempts").where("verdict = 'WRONG'").groupBy("chapter_id").agg(in_order("answer").alias("wrong"))
    memos = t("para_memos").groupBy("chapter_id").agg(in_order("memo").alias("memos"))
    none = F.array().cast("array<string>")
    return wrong.join(memos, "chapter_id", "left").select("chapter_id", V.learner_context(F.col("wrong"), none, F.coalesce("memos", none)).alias("context"))


@query("C13_pages_to_blocks", "WITH b AS (SELECT book, first, first + 1 AS last, 'K' || first AS kind FROM (SELECT DISTINCT book, CAST(floor((page - 1) / 2) * 2 AS INT) + 1 AS first FROM page_lines)) SELECT DISTINCT p.book, p.page, b.kind FROM page_lines p JOIN b ON b.book = p.book AND p.page BETWEEN first AND last")
def pages_to_blocks(t):
    pages = t("page_lines").select("book", "page").distinct()
    blocks = pages.select("book", (F.floor((F.col("page") - 1) / 2) * 2 + 1).cast("int").alias("first")).distinct()
    return V.page_blocks(pages, blocks.select("book", "first", (F.col("first") + 1).alias("last"), F.concat(F.lit("K"), F.col("first").cast("string")).alias("kind")))


@query("C24_chapter_candidates", "WITH c AS (SELECT book, page, ord, text, size FROM page_lines WHERE size = 14 AND length(text) BETWEEN 1 AND 40), g AS (SELECT *, count(*) OVER (PARTITION BY book, page) AS n FROM c) SELECT book, page, ord, text FROM g WHERE n <= 2")
def candidates(t):
    """Heading-like lines, but on pages that hold many of them, as contents pages do."""
    c = t("page_lines").where("size = 14 and length(text) between 1 and 40").withColumn("n", F.count("*").over(W.partitionBy("book", "page")))
    return c.where("n <= 2").select("book", "page", "ord", "text")


@query("C16_page_route", "WITH g AS (SELECT book, page, list_sort(list(size / 14)) AS c, count(*) AS n FROM page_lines GROUP BY 1, 2) SELECT book, CASE WHEN c[CAST(floor(n / 2) AS INT) + 1] < 0.85 THEN 'rejected' ELSE 'kept' END AS route, count(*) AS pages FROM g GROUP BY 1, 2")
def page_route(t):
    g = t("page_lines").groupBy("book", "page").agg(F.sort_array(F.collect_list(F.col("size") / 14)).alias("c"), F.count("*").alias("n"))
    return g.select("book", F.when(F.get("c", F.floor(F.col("n") / 2).cast("int")) < 0.85, "rejected").otherwise("kept").alias("route")).groupBy("book", "route").agg(F.count("*").alias("pages"))


@query("C18_edge_tabs", "SELECT book, page, ord FROM page_lines WHERE NOT (length(text) BETWEEN 1 AND 4 AND (x0 < 60 OR x1 > 390))")
def edge_tabs(t):
    """Lines without short ones at a page's edge."""
    return t("page_lines").where("not (length(text) between 1 and 4 and (x0 < 60 or x1 > 390))").select("book", "page", "ord")


@query("IO12_replaced_book", "SELECT id, chapter_id FROM paragraphs WHERE chapter_id NOT IN (SELECT id FROM chapters WHERE book_id = 3) UNION ALL SELECT id + 1000000000, chapter_id FROM paragraphs WHERE chapter_id IN (SELECT id FROM chapters WHERE book_id = 3)")
def replaced_book(t):
    """A book's paragraphs deleted and written anew."""
    own = t("chapters").where("book_id = 3").select(F.col("id").alias("chapter_id"))
    kept = t("paragraphs").join(own, "chapter_id", "left_anti").select("id", "chapter_id")
    return kept.unionByName(t("paragraphs").join(own, "chapter_id", "left_semi").select((F.col("id") + 1000000000).alias("id"), "chapter_id"))


@query("IO15_collected_batches", "SELECT book_id, page_no, max(id) AS id FROM vision_queue WHERE status = 'DONE' GROUP BY 1, 2")
def collected(t):
    """All finished batches; the last one of a page counts."""
    return t("vision_queue").where("status = 'DONE'").groupBy("book_id", "page_no").agg(F.max_by("id", "id").alias("id"))


@query("IO18_export_text", "SELECT a.chapter_id, '# ' || c.title || chr(10) || a.summary_md AS md FROM chapter_assets a JOIN chapters c ON c.id = a.chapter_id")
def export_text(t):
    c = t("chapters").select(F.col("id").alias("chapter_id"), "title")
    return t("chapter_assets").join(c, "chapter_id").select("chapter_id", F.format_string("# %s\n%s", "title", "summary_md").alias("md"))


@query("ST06_remaining_blocks", "WITH p AS (SELECT chapter_id, idx, role = 'FIGURE' AS failed FROM paragraphs), f AS (SELECT chapter_id, min(idx) AS bad FROM p WHERE failed GROUP BY 1) SELECT p.chapter_id, count(*) AS done FROM p LEFT JOIN f USING (chapter_id) WHERE bad IS NULL OR idx < bad GROUP BY 1")
def remaining(t):
    """Blocks done before the first failure of each chapter."""
    first = F.min(F.when(F.col("role") == "FIGURE", F.col("idx"))).over(W.partitionBy("chapter_id"))
    return t("paragraphs").withColumn("at", first).where("at is null or idx < at").groupBy("chapter_id").agg(F.count("*").alias("done"))


@query("ST07_cache_hits", "SELECT n.id FROM para_notes n JOIN chapter_assets a ON a.chapter_id = n.chapter_id AND a.prompt_version = 1")
def cache_hits(t):
    return t("para_notes").withColumn("prompt_version", F.lit(1)).join(t("chapter_assets").select("chapter_id", "prompt_version"), ["chapter_id", "prompt_version"]).select("id")


@query("ST09_reminder", "SELECT count(*) AS due FROM review_items WHERE NOT done AND due_at <= 850000000000")
def reminder(t):
    return t("review_items").where("NOT done AND due_at <= 850000000000").agg(F.count("*").alias("due"))


@query("SET_uncovered_pages", "SELECT book_id, page_no FROM vision_queue WHERE status = 'DONE' EXCEPT SELECT book_id, page_no FROM figures")
def uncovered(t):
    return t("vision_queue").where("status = 'DONE'").select("book_id", "page_no").subtract(t("figures").select("book_id", "page_no"))
