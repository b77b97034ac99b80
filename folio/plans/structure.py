"""Predicates, joins, aggregates, windows and orders of the inventory (P, J, A, W, T, M, D), over the study tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import CONTENTS_LEADER, PRIVATE_USE
from ..operators import relational as R
from ..operators import temporal as X
from ..sources.roles import oracle, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


# --- predicates


@query("P04_computed_flag", "SELECT c.id, a.chapter_id IS NOT NULL AS has_asset FROM chapters c LEFT JOIN chapter_assets a ON a.chapter_id = c.id")
def computed_flag(t):
    return t("chapters").join(t("chapter_assets").select("chapter_id"), F.col("id") == F.col("chapter_id"), "left").select("id", F.col("chapter_id").isNotNull().alias("has_asset"))


@query("P06_model_input_roles", "SELECT id, role FROM paragraphs WHERE role NOT IN ('TOC', 'FOOTNOTE', 'FIGURE')")
def model_input(t):
    return t("paragraphs").where(~F.col("role").isin("TOC", "FOOTNOTE", "FIGURE")).select("id", "role")


def analysis_scope(chapters: DataFrame, body: str, back: str, least: int = 50) -> DataFrame:
    """Chapters to analyse: from the first whose title is body-styled (else all), but back matter and short ones."""
    first = F.coalesce(F.min(F.when(F.col("title").rlike(body), F.col("idx"))).over(W.partitionBy("book_id")), F.lit(0))
    return chapters.withColumn("__first", first).where((F.col("idx") >= F.col("__first")) & ~F.col("title").rlike(back) & (F.col("chars") >= least)).drop("__first")


@query(
    "P07_analysis_scope",
    "SELECT id, book_id, idx FROM (SELECT c.id, c.book_id, c.idx, c.title, coalesce(min(CASE WHEN regexp_matches(c.title, '5$') THEN c.idx END) OVER (PARTITION BY c.book_id), 0) AS f, d.n_chars AS chars FROM chapters c JOIN documents d ON d.doc_id = c.id) WHERE idx >= f AND NOT regexp_matches(title, '9$') AND chars >= 50",
)
def scope(t):
    chapters = t("chapters").join(t("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("chars")), "id")
    return analysis_scope(chapters, "5$", "9$").select("id", "book_id", "idx")


@query("P08_deletion_mask", "SELECT id, chapter_id FROM paragraphs ANTI JOIN (SELECT id FROM para_notes) d USING (id)")
def deletion_mask(t):
    return t("paragraphs").join(t("para_notes").select("id"), "id", "left_anti").select("id", "chapter_id")


def suspicious_pages(pages: DataFrame) -> DataFrame:
    """Pages of a line table that may be unreadable: under 5 characters, two private-use ones, or many short lines."""
    chars = F.sum(F.length("text"))
    private = F.sum(F.regexp_count("text", F.lit(PRIVATE_USE)))
    short = F.count_if((F.length("text") > 0) & (F.length("text") < 8))
    found = pages.groupBy("book", "page").agg(chars.alias("chars"), private.alias("private"), short.alias("short"), F.count("*").alias("lines"))
    return found.where("chars < 5 OR private >= 2 OR (short >= 5 AND short / lines >= 0.4)")


@query(
    "P09_suspicious_pages",
    "SELECT book, page, CAST(chars AS BIGINT) AS chars, short FROM (SELECT book, page, sum(length(text)) AS chars, count(*) FILTER (length(text) > 0 AND length(text) < 8) AS short, count(*) AS lines FROM page_lines GROUP BY 1, 2) WHERE chars < 5 OR (short >= 5 AND short / lines >= 0.4)",
)
def pages_suspicious(t):
    return suspicious_pages(t("page_lines")).select("book", "page", "chars", "short")


@query(
    "P10_pages_without_figures",
    "WITH p AS (SELECT book, page, sum(length(text)) AS chars FROM page_lines GROUP BY 1, 2), f AS (SELECT DISTINCT book_id, page_no FROM figures) SELECT book, page, CAST(chars AS BIGINT) AS chars FROM p WHERE chars < 100 OR NOT EXISTS (SELECT 1 FROM f WHERE f.book_id = p.book AND f.page_no = p.page)",
)
def pages_without_figures(t):
    pages = t("page_lines").groupBy("book", "page").agg(F.sum(F.length("text")).alias("chars"))
    figures = t("figures").select(F.col("book_id").alias("book"), F.col("page_no").alias("page")).distinct()
    return pages.where("chars >= 100").join(figures, ["book", "page"], "left_anti").unionByName(pages.where("chars < 100"))


@query(
    "P11_repeated_figures",
    "SELECT md5, count(DISTINCT page_no) AS pages, count(*) AS n FROM figures GROUP BY md5 HAVING count(DISTINCT page_no) >= 3",
)
def repeated_figures(t):
    return t("figures").groupBy("md5").agg(F.countDistinct("page_no").alias("pages"), F.count("*").alias("n")).where("pages >= 3")


@query(
    "P12_page_gate",
    "WITH g AS (SELECT book, page, list_sort(list(size / 14)) AS c, count(*) AS n FROM page_lines GROUP BY 1, 2) SELECT book, page, c[CAST(floor(n / 2) AS INT) + 1] AS median, (c[CAST(floor(n / 2) AS INT) + 1] < 0.85 OR len(list_filter(c, lambda x: x < 0.5)) * 5 > n) AS rejected FROM g",
)
def page_gate(t):
    """A page is rejected whose upper-median confidence is under 0.85, or a fifth of whose lines are under 0.5."""
    g = t("page_lines").groupBy("book", "page").agg(F.sort_array(F.collect_list(F.col("size") / 14)).alias("c"), F.count("*").alias("n"))
    median = F.get("c", F.floor(F.col("n") / 2).cast("int"))
    low = F.size(F.filter("c", lambda x: x < 0.5))
    return g.select("book", "page", median.alias("median"), ((median < 0.85) | (low * 5 > F.col("n"))).alias("rejected"))


@query(
    "P16_due_display",
    "SELECT id, book_id, chapter_id FROM review_items WHERE NOT done QUALIFY row_number() OVER (PARTITION BY CASE WHEN title = '1-URGENT' THEN 'i' || id ELSE 'c' || book_id || '_' || chapter_id END ORDER BY due_at, id) = 1",
)
def due_display(t):
    """One row for each chapter, the soonest due, but every row of terms."""
    key = F.when(F.col("title") == "1-URGENT", F.concat(F.lit("i"), F.col("id").cast("string"))).otherwise(F.concat_ws("_", F.lit("c"), "book_id", "chapter_id"))
    return R.newest_of_each(t("review_items").where("NOT done").withColumn("k", key), ["k"], [F.col("due_at"), F.col("id")]).select("id", "book_id", "chapter_id")


# --- joins


@query("J09_dangling_references", "SELECT b.id, c.id AS chapter_id FROM bookmarks b LEFT JOIN chapters c ON c.id = b.chapter_id")
def dangling(t):
    return R.dangling_to_null(t("bookmarks"), t("chapters"), "chapter_id").select("id", "chapter_id")


STARTS = "(SELECT book_id, start_page, min(id) AS cid FROM chapters WHERE start_page IS NOT NULL GROUP BY 1, 2)"


@query(
    "J12_figure_to_chapter",
    f"SELECT f.id, s.cid AS chapter FROM figures f ASOF LEFT JOIN {STARTS} s ON f.book_id = s.book_id AND f.page_no >= s.start_page",
)
def figure_chapter(t):
    chapters = t("chapters").select("book_id", "start_page", F.col("id").alias("chapter"))
    return X.asof_join(t("figures").select("id", "book_id", "page_no"), chapters, "book_id", "page_no", "start_page", ["chapter"]).select("id", "chapter")


@query(
    "J13_section_host",
    f"WITH p AS (SELECT book_id, max(start_page) AS pages FROM chapters GROUP BY 1) SELECT f.id, s.cid AS chapter FROM figures f JOIN p ON p.book_id = f.book_id AND f.page_no <= p.pages ASOF JOIN {STARTS} s ON f.book_id = s.book_id AND f.page_no >= s.start_page",
)
def section_host(t):
    """As J12, for pages that the book has only, and without those before the first chapter."""
    pages = t("chapters").groupBy("book_id").agg(F.max("start_page").alias("pages"))
    inside = t("figures").join(pages, "book_id").where("page_no <= pages").select("id", "book_id", "page_no")
    chapters = t("chapters").select("book_id", "start_page", F.col("id").alias("chapter"))
    return X.asof_join(inside, chapters, "book_id", "page_no", "start_page", ["chapter"]).where("chapter is not null").select("id", "chapter")


@query(
    "J14_figure_clamped",
    f"WITH f1 AS (SELECT book_id, arg_min(id, struct_pack(s := start_page, i := id)) AS first FROM chapters WHERE start_page IS NOT NULL GROUP BY 1) SELECT f.id, coalesce(s.cid, f1.first) AS chapter FROM figures f LEFT JOIN f1 ON f1.book_id = f.book_id ASOF LEFT JOIN {STARTS} s ON f.book_id = s.book_id AND f.page_no >= s.start_page",
)
def figure_clamped(t):
    """As J12, those before the first chapter going to it."""
    first = t("chapters").where("start_page is not null").groupBy("book_id").agg(F.min_by("id", F.struct("start_page", "id")).alias("first"))
    chapters = t("chapters").select("book_id", "start_page", F.col("id").alias("chapter"))
    found = X.asof_join(t("figures").select("id", "book_id", "page_no"), chapters, "book_id", "page_no", "start_page", ["chapter"])
    return found.join(first, "book_id", "left").select("id", F.coalesce("chapter", "first").alias("chapter"))


@query(
    "J15_figure_anchor",
    "SELECT f.id, coalesce(max(p.ord), -1) AS anchor FROM figures f LEFT JOIN page_lines p ON p.book = f.book_id AND p.page = f.page_no AND p.y0 <= f.y - 900 GROUP BY f.id",
)
def figure_anchor(t):
    """The last line above a figure on its page, -1 if none."""
    lines = t("page_lines").select(F.col("book").alias("book_id"), F.col("page").alias("page_no"), "ord", "y0")
    found = t("figures").join(lines, ["book_id", "page_no"], "left").groupBy("id").agg(F.max(F.when(F.col("y0") <= F.col("y") - 900, F.col("ord"))).alias("anchor"))
    return found.select("id", F.coalesce("anchor", F.lit(-1)).alias("anchor"))


@query(
    "J16_entry_to_line",
    r"""WITH l AS (SELECT book_id, idx + 1 AS leaf, h.id % 100000 AS pos, text, replace(text, ' ', '') AS plain FROM han h JOIN chapters c ON c.id = h.book),
    e AS (SELECT book_id, leaf AS entry, leaf - (leaf * 7) % 30 AS due, left(plain, 8) AS needle FROM l WHERE pos = 0 AND leaf % 2 = 0)
    SELECT e.book_id, entry, min(leaf) AS page FROM e JOIN l ON l.book_id = e.book_id AND leaf BETWEEN due - 3 AND due + 20 AND contains(plain, needle) AND NOT regexp_matches(text, '[…·.•‧．●]{2,}\s*[（(]?\d{1,4}[）)]?\s*$') GROUP BY 1, 2""",
)
def entry_to_line(t):
    """The first page, from three before to twenty after the expected one, with a line that holds an entry's beginning.

    Entries and lines meet by equal pages; an entry asks for 24 of them, whatever the book's length.
    """
    pages = t("chapters").select(F.col("id").alias("book"), "book_id", (F.col("idx") + 1).alias("leaf"))
    lines = t("han").select("book", (F.col("id") % 100000).alias("pos"), "text", F.replace("text", F.lit(" "), F.lit("")).alias("plain")).join(pages, "book")
    at = F.col("leaf") - (F.col("leaf") * 7) % 30
    entries = lines.where("pos = 0 and leaf % 2 = 0").select("book_id", F.col("leaf").alias("entry"), F.left("plain", F.lit(8)).alias("needle"), F.explode(F.sequence(at - 3, at + 20)).alias("leaf"))
    hits = entries.join(lines.where(~F.col("text").rlike(CONTENTS_LEADER)).select("book_id", "leaf", "plain"), ["book_id", "leaf"]).where(F.contains("plain", "needle"))
    return hits.groupBy("book_id", "entry").agg(F.min("leaf").alias("page"))


@query(
    "J19_overlap_best",
    "WITH r AS (SELECT book, page, ord, x0, y0, x1, y0 + size AS y1 FROM page_lines), j AS (SELECT a.book, a.page, a.ord, b.ord AS other, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1 + 12) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS s1, (b.x1 - b.x0) * (b.y1 + 12 - b.y0) AS s2 FROM r a JOIN r b ON a.book = b.book AND a.page = b.page AND a.ord = b.ord + 1 AND a.y0 < b.y1 + 12) SELECT book, page, ord, other, inter / (s1 + s2 - inter) AS iou FROM j WHERE inter > 0 AND inter / (s1 + s2 - inter) >= 0.3",
)
def overlap_best(t):
    """Rectangles of neighbouring lines (the upper one made taller) that overlap by a third or more."""
    r = t("page_lines").select("book", "page", "ord", "x0", "y0", "x1", (F.col("y0") + F.col("size")).alias("y1"))
    w = W.partitionBy("book", "page").orderBy("ord")
    b = F.lag(F.struct("ord", "x0", "y0", "x1", (F.col("y1") + 12).alias("y1"))).over(w)
    j = r.withColumn("b", b).where("b.ord = ord - 1 and y0 < b.y1")
    inter = (F.least("x1", "b.x1") - F.greatest("x0", "b.x0")) * (F.least("y1", "b.y1") - F.greatest("y0", "b.y0"))
    s1, s2 = F.expr("(x1 - x0) * (y1 - y0)"), F.expr("(b.x1 - b.x0) * (b.y1 - b.y0)")
    j = j.withColumn("inter", inter).where("inter > 0").withColumn("iou", F.col("inter") / (s1 + s2 - F.col("inter")))
    return j.where("iou >= 0.3").select("book", "page", "ord", F.col("b.ord").alias("other"), "iou")


@query(
    "J20_positional_join",
    "WITH f AS (SELECT id, book_id, page_no, row_number() OVER (PARTITION BY book_id, page_no ORDER BY y, id) AS k FROM figures), p AS (SELECT book, page, ord, row_number() OVER (PARTITION BY book, page ORDER BY ord) AS k FROM page_lines WHERE size = 14) SELECT f.id, p.ord FROM f JOIN p ON p.book = f.book_id AND p.page = f.page_no AND p.k = f.k",
)
def positional(t):
    """The k-th figure of a page meets the k-th placeholder of it."""
    nth = lambda *o: F.row_number().over(W.partitionBy("book", "page").orderBy(*o))
    figures = t("figures").select("id", F.col("book_id").alias("book"), F.col("page_no").alias("page"), "y").withColumn("k", nth("y", "id"))
    places = t("page_lines").where("size = 14").select("book", "page", "ord").withColumn("k", nth("ord"))
    return figures.join(places, ["book", "page", "k"]).select("id", "ord")


@query(
    "J21_reading_rows",
    "WITH u AS (SELECT chapter_id, idx AS slot, 0 AS kind, id FROM paragraphs UNION ALL SELECT chapter_id, ord_after_para AS slot, 1 AS kind, id FROM figures) SELECT chapter_id, kind, id, row_number() OVER (PARTITION BY chapter_id ORDER BY slot, kind, id) AS place FROM u",
)
def reading_rows(t):
    """Paragraphs and figures of a chapter in reading order: a figure follows the paragraph it is anchored after."""
    both = t("paragraphs").select("chapter_id", F.col("idx").alias("slot"), F.lit(0).alias("kind"), "id")
    both = both.unionByName(t("figures").select("chapter_id", F.col("ord_after_para").alias("slot"), F.lit(1).alias("kind"), "id"))
    return both.withColumn("place", F.row_number().over(W.partitionBy("chapter_id").orderBy("slot", "kind", "id"))).drop("slot")


@query(
    "J22_floor_else_ceil",
    "WITH k AS (SELECT DISTINCT book_id, page_no AS page FROM vision_queue WHERE status = 'DONE'), q AS (SELECT id, book_id, page_no FROM vision_queue WHERE status <> 'DONE') SELECT q.id, coalesce((SELECT max(page) FROM k WHERE k.book_id = q.book_id AND page <= page_no), (SELECT min(page) FROM k WHERE k.book_id = q.book_id AND page > page_no)) AS page FROM q",
)
def floor_else_ceil(t):
    """An orphan page goes to the nearest kept page before it, else to the one after."""
    found = X.nearest_marked(t("vision_queue"), "book_id", "page_no", F.col("status") == "DONE", "page")
    return found.where("status <> 'DONE'").select("id", "page")


@query(
    "J23_wrong_question",
    "SELECT q.id, CASE q_index WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three' END AS question FROM quiz_attempts q LEFT JOIN chapter_assets a ON a.chapter_id = q.chapter_id WHERE verdict = 'WRONG' AND a.chapter_id IS NOT NULL",
)
def wrong_question(t):
    """The text of a wrongly answered question, looked up by its ordinal in the asset's JSON."""
    quiz = F.from_json("quiz_json", "array<struct<q:string,type:string>>")
    assets = t("chapter_assets").select("chapter_id", quiz.alias("quiz"))
    return t("quiz_attempts").where("verdict = 'WRONG'").join(assets, "chapter_id").select("id", F.get("quiz", F.col("q_index"))["q"].alias("question"))


@query("J24_note_to_unit", "SELECT n.id, p.id AS unit FROM para_notes n JOIN paragraphs p ON n.para_ids = '[' || p.id || ']'")
def note_to_unit(t):
    """Notes meet the unit with the same list of ids: equality of arrays."""
    notes = t("para_notes").select("id", F.from_json("para_ids", "array<bigint>").alias("ids"))
    return notes.join(t("paragraphs").select(F.col("id").alias("unit"), F.array("id").alias("ids")), "ids").select("id", "unit")


@query(
    "J25_section_parent",
    "SELECT id, coalesce(max(CASE WHEN level = 1 THEN idx END) OVER (PARTITION BY book_id ORDER BY idx ROWS UNBOUNDED PRECEDING), min(CASE WHEN level = 1 THEN idx END) OVER (PARTITION BY book_id)) AS parent FROM chapters QUALIFY level = 2",
)
def section_parent(t):
    """A section's chapter: the nearest before it, else the book's first."""
    top = F.when(F.col("level") == 1, F.col("idx"))
    w = W.partitionBy("book_id")
    found = t("chapters").withColumn("parent", F.coalesce(F.max(top).over(w.orderBy("idx").rowsBetween(W.unboundedPreceding, 0)), F.min(top).over(w)))
    return found.where("level = 2").select("id", "parent")


@query(
    "J26_page_neighbours",
    "WITH p AS (SELECT book, page, max_by(text, ord) AS tail, min_by(text, ord) AS head FROM page_lines GROUP BY 1, 2) SELECT a.book, a.page, a.tail, b.head FROM p a JOIN p b ON a.book = b.book AND b.page = a.page + 1",
)
def page_neighbours(t):
    """The last line of a page beside the first of the next."""
    pages = t("page_lines").groupBy("book", "page").agg(F.max_by("text", "ord").alias("tail"), F.min_by("text", "ord").alias("head"))
    following = F.lead(F.struct("page", "head")).over(W.partitionBy("book").orderBy("page"))
    return pages.withColumn("n", following).where("n.page = page + 1").select("book", "page", "tail", F.col("n.head").alias("head"))


# --- aggregates


@query("A01_filtered_count", "SELECT count(*) AS n FROM review_items WHERE NOT done")
def filtered_count(t):
    return t("review_items").where("NOT done").agg(F.count("*").alias("n"))


@query(
    "A08_body_size",
    "WITH s AS (SELECT book, CAST(floor(size * 2) AS INT) AS b, sum(length(text)) AS n FROM page_lines GROUP BY 1, 2) SELECT book, arg_max(b, struct_pack(n := n, b := b)) / 2 AS body FROM s GROUP BY 1",
)
def body_size(t):
    return X.weighted_mode(t("page_lines"), ["book"], F.floor(F.col("size") * 2).cast("int"), F.length("text")).select("book", (F.col("mode") / 2).alias("body"))


@query(
    "A09_margins",
    "WITH l AS (SELECT book, CAST(x0 AS INT) AS b, count(*) AS n FROM page_lines GROUP BY 1, 2), r AS (SELECT book, CAST(x1 AS INT) AS b, count(*) AS n FROM page_lines GROUP BY 1, 2) SELECT book, l1 AS margin_left, r1 AS margin_right FROM (SELECT book, arg_max(b, struct_pack(n := n, b := -b)) AS l1 FROM l GROUP BY 1) JOIN (SELECT book, arg_max(b, struct_pack(n := n, b := b)) AS r1 FROM r GROUP BY 1) USING (book)",
)
def margins(t):
    lines = t("page_lines")
    left = X.weighted_mode(lines, ["book"], F.col("x0").cast("int"), F.lit(1), larger=False, name="margin_left")
    return left.join(X.weighted_mode(lines, ["book"], F.col("x1").cast("int"), F.lit(1), name="margin_right"), "book")


@query(
    "A10_line_pitch",
    "WITH g AS (SELECT book, y0 - lag(y0) OVER (PARTITION BY book, page ORDER BY ord) AS gap FROM page_lines), h AS (SELECT book, CAST(floor(gap) AS INT) AS b, count(*) AS n FROM g WHERE gap > 0 GROUP BY 1, 2), p AS (SELECT book, arg_max(b, struct_pack(n := n, b := -b)) AS peak, max(n) AS top, sum(n) AS total FROM h GROUP BY 1) SELECT p.book, CASE WHEN total >= 8 THEN coalesce(CAST((SELECT min(b) FROM h WHERE h.book = p.book AND b >= 1.1 * peak AND n <= 0.25 * top) AS DOUBLE), 1.4 * peak) END AS pitch FROM p",
)
def line_pitch(t):
    """The gap between lines above which a paragraph ends: the first rare gap past the most common one."""
    gap = F.col("y0") - F.lag("y0").over(W.partitionBy("book", "page").orderBy("ord"))
    h = t("page_lines").withColumn("gap", gap).where("gap > 0").groupBy("book", F.floor("gap").cast("int").alias("b")).agg(F.count("*").alias("n"))
    p = h.groupBy("book").agg(F.max_by("b", F.struct(F.col("n"), -F.col("b"))).alias("peak"), F.max("n").alias("top"), F.sum("n").alias("total"))
    valley = F.min(F.when((F.col("b") >= 1.1 * F.col("peak")) & (F.col("n") <= 0.25 * F.col("top")), F.col("b"))).cast("double")
    found = h.join(p, "book").groupBy("book", "peak", "total").agg(valley.alias("valley"))
    return found.select("book", F.when(F.col("total") >= 8, F.coalesce("valley", 1.4 * F.col("peak"))).alias("pitch"))


@query(
    "A11_robust_size",
    "WITH m AS (SELECT *, max(size) OVER (PARTITION BY book, page) AS top FROM page_lines WHERE length(text) > 0) SELECT book, page, sum(size * length(text)) / sum(length(text)) AS size FROM m WHERE size >= 0.55 * top GROUP BY 1, 2",
)
def robust_size(t):
    m = t("page_lines").where(F.length("text") > 0).withColumn("top", F.max("size").over(W.partitionBy("book", "page")))
    return m.where("size >= 0.55 * top").groupBy("book", "page").agg((F.sum(F.col("size") * F.length("text")) / F.sum(F.length("text"))).alias("size"))


@query(
    "A13_running_headers",
    "WITH d AS (SELECT DISTINCT book, page, regexp_replace(text, '[0-9 ]', '', 'g') AS norm FROM page_lines WHERE ord = 0) SELECT norm, count(*) AS pages FROM d WHERE norm <> '' GROUP BY 1 HAVING count(*) >= 3",
)
def running_headers(t):
    top = t("page_lines").where("ord = 0").select("book", "page", F.regexp_replace("text", "[0-9 ]", "").alias("norm")).distinct()
    return top.where("norm <> ''").groupBy("norm").agg(F.count("*").alias("pages")).where("pages >= 3")


@query(
    "A15_batch_gates",
    "WITH b AS (SELECT book_id, CAST(floor(page_no / 50) AS INT) AS batch, list_sort(list(DISTINCT page_no)) AS got, count(*) AS n, min(page_no) AS lo, max(page_no) AS hi FROM vision_queue WHERE status = 'DONE' GROUP BY 1, 2) SELECT book_id, batch, n - len(got) AS repeated, hi - lo + 1 - len(got) AS missing FROM b",
)
def batch_gates(t):
    """What is missing or repeated among the finished pages of a batch: set operations on arrays."""
    done = t("vision_queue").where("status = 'DONE'").withColumn("batch", F.floor(F.col("page_no") / 50).cast("int"))
    b = done.groupBy("book_id", "batch").agg(F.collect_set("page_no").alias("got"), F.count("*").alias("n"), F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    missing = F.size(F.array_except(F.sequence("lo", "hi"), "got"))
    return b.select("book_id", "batch", (F.col("n") - F.size("got")).alias("repeated"), missing.alias("missing"))


@query(
    "A16_thin_chapters",
    "WITH c AS (SELECT c.id, c.book_id, c.idx, d.n_chars, c.level FROM chapters c JOIN documents d ON d.doc_id = c.id), g AS (SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY book_id ORDER BY idx) AS part FROM c) SELECT book_id, part, min(id) AS id, CAST(sum(n_chars) AS BIGINT) AS chars FROM g GROUP BY 1, 2 HAVING sum(n_chars) < 300",
)
def thin_chapters(t):
    """Chapters with little text before the next one of the first level."""
    c = t("chapters").join(t("documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    g = X.islands(c, ["book_id"], ["idx"], F.col("level") == 1, "part")
    return g.groupBy("book_id", "part").agg(F.min("id").alias("id"), F.sum("n_chars").alias("chars")).where("chars < 300")


@query(
    "A17_number_gaps",
    "WITH n AS (SELECT book_id, list(DISTINCT page_no) AS got, min(page_no) AS lo, max(page_no) AS hi FROM figures GROUP BY 1) SELECT book_id, CAST(hi - lo + 1 - len(got) AS INT) AS gaps FROM n",
)
def number_gaps(t):
    n = t("figures").groupBy("book_id").agg(F.collect_set("page_no").alias("got"), F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    return n.select("book_id", F.size(F.array_except(F.sequence("lo", "hi"), "got")).alias("gaps"))


@query(
    "A18_page_offset",
    "WITH d AS (SELECT book_id, start_page - idx AS off, count(*) AS n, min(idx) AS first FROM chapters WHERE start_page IS NOT NULL GROUP BY 1, 2) SELECT book_id, arg_max(off, struct_pack(n := n, f := -first)) AS page_offset FROM d GROUP BY 1",
)
def page_offset(t):
    """The most common difference of a page and its printed number; of equals the first seen."""
    d = t("chapters").where("start_page is not null").groupBy("book_id", F.expr("start_page - idx").alias("off")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return d.groupBy("book_id").agg(F.max_by("off", F.struct(F.col("n"), -F.col("first"))).alias("page_offset"))


@query(
    "A21_verdict",
    "SELECT chapter_id, CASE WHEN count(*) FILTER (verdict = 'WRONG') > 0 THEN 'FORGOT' WHEN count(*) FILTER (verdict = 'PARTIAL') > 0 THEN 'FUZZY' ELSE 'REMEMBER' END AS verdict FROM quiz_attempts GROUP BY 1",
)
def verdicts(t):
    any_of = lambda v: F.bool_or(F.col("verdict") == v)
    return t("quiz_attempts").groupBy("chapter_id").agg(F.when(any_of("WRONG"), "FORGOT").when(any_of("PARTIAL"), "FUZZY").otherwise("REMEMBER").alias("verdict"))


@query(
    "A23_systematic_shift",
    "SELECT book_id, median(page_no - id % 40) AS mid, var_pop(page_no - id % 40) AS spread, median(page_no - id % 40) >= 2 AND var_pop(page_no - id % 40) < 1000 AS shifted FROM figures GROUP BY 1",
)
def shift(t):
    d = F.expr("page_no - id % 40")
    s = t("figures").groupBy("book_id").agg(F.median(d).alias("mid"), F.round(F.var_pop(d), 6).alias("spread"))
    return s.withColumn("shifted", F.expr("mid >= 2 and spread < 1000"))


ORACLES["A23_systematic_shift"] = ORACLES["A23_systematic_shift"].replace("var_pop(page_no - id % 40) AS spread", "round(var_pop(page_no - id % 40), 6) AS spread")


@query(
    "A25_contents_guard",
    "WITH o AS (SELECT book_id, start_page, level, lag(start_page) OVER (PARTITION BY book_id ORDER BY idx) AS before FROM chapters) SELECT book_id, count(*) >= 3 AND count(*) FILTER (level = 1) >= 1 AND count(*) FILTER (start_page >= before) * 10 >= count(*) FILTER (start_page IS NOT NULL AND before IS NOT NULL) * 9 AS passes FROM o GROUP BY 1",
)
def contents_guard(t):
    """At least three entries, one of the first level, and nine in ten neighbouring pages not falling."""
    o = t("chapters").withColumn("before", F.lag("start_page").over(W.partitionBy("book_id").orderBy("idx")))
    rising, pairs = F.count_if(F.col("start_page") >= F.col("before")), F.count_if(F.col("start_page").isNotNull() & F.col("before").isNotNull())
    return o.groupBy("book_id").agg(((F.count("*") >= 3) & (F.count_if(F.col("level") == 1) >= 1) & (rising * 10 >= pairs * 9)).alias("passes"))


@query(
    "A26_status_pivot",
    "SELECT book_id, count(*) FILTER (status = 'DONE') AS DONE, count(*) FILTER (status = 'FAILED') AS FAILED, count(*) FILTER (status = 'PENDING') AS PENDING FROM vision_queue GROUP BY 1",
)
def status_pivot(t):
    return t("vision_queue").groupBy("book_id").pivot("status", ["DONE", "FAILED", "PENDING"]).count().na.fill(0)


TODAY = "2024-01-30"


@query(
    "A27_reading_summary",
    f"WITH d AS (SELECT day, sum(minutes) AS m FROM reading_stats GROUP BY 1), g AS (SELECT CAST(day AS DATE) AS d, CAST(day AS DATE) - CAST(row_number() OVER (ORDER BY day) AS INT) AS run FROM d), r AS (SELECT count(*) AS n, max(d) AS last FROM g GROUP BY run) SELECT CAST(coalesce((SELECT m FROM d WHERE day = '{TODAY}'), 0) AS BIGINT) AS today, CAST((SELECT sum(m) FROM d) AS BIGINT) AS total, coalesce((SELECT max(n) FROM r WHERE date_diff('day', last, DATE '{TODAY}') IN (0, 1)), 0) AS streak",
)
def reading_summary(t):
    s = t("reading_stats")
    sums = s.agg(F.coalesce(F.sum(F.when(F.col("day") == TODAY, F.col("minutes"))), F.lit(0)).alias("today"), F.coalesce(F.sum("minutes"), F.lit(0)).alias("total"), F.lit(1).alias("k"))
    run = X.streaks(s.select(F.lit(1).alias("k"), F.col("day").cast("date").alias("d")), "k", "d", TODAY)
    return sums.join(run, "k", "left").select("today", "total", F.coalesce("streak", F.lit(0)).alias("streak"))


@query(
    "A28_column_gap",
    "WITH x AS (SELECT book, page, x0, x0 - lag(x0) OVER (PARTITION BY book, page ORDER BY x0, ord) AS gap, row_number() OVER (PARTITION BY book, page ORDER BY x0, ord) AS k, count(*) OVER (PARTITION BY book, page) AS n FROM page_lines), m AS (SELECT book, page, any_value(n) AS n, arg_max(k - 1, struct_pack(g := gap, k := -k)) AS below, max(gap) AS gap FROM x WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT book, page, gap, n >= 20 AND gap > 15 AND below * 100 >= 15 * n AND (n - below) * 100 >= 15 * n AS two_columns FROM m",
)
def column_gap(t):
    """Two columns are likely where the widest gap between left edges parts off enough lines on both sides."""
    w = W.partitionBy("book", "page").orderBy("x0", "ord")
    x = t("page_lines").select("book", "page", F.expr("x0").alias("x"), (F.col("x0") - F.lag("x0").over(w)).alias("gap"), F.row_number().over(w).alias("k"), F.count("*").over(W.partitionBy("book", "page")).alias("n"))
    m = x.where("gap is not null").groupBy("book", "page").agg(F.max("n").alias("n"), F.max_by(F.col("k") - 1, F.struct(F.col("gap"), -F.col("k"))).alias("below"), F.max("gap").alias("gap"))
    return m.select("book", "page", "gap", F.expr("n >= 20 and gap > 15 and below * 100 >= 15 * n and (n - below) * 100 >= 15 * n").alias("two_columns"))


@query("A30_units", "SELECT chapter_id, count(*) FILTER (role = 'BODY') AS explains, count(DISTINCT page_no) AS grps FROM paragraphs GROUP BY 1")
def unit_counts(t):
    return t("paragraphs").groupBy("chapter_id").agg(F.count_if(F.col("role") == "BODY").alias("explains"), F.countDistinct("page_no").alias("grps"))


# --- windows


@query("W04_forward_fill", "SELECT id, last_value(page_no IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS page FROM paragraphs")
def fill_forward(t):
    return X.forward_fill(t("paragraphs"), ["chapter_id"], ["idx"], "page_no", "page").select("id", "page")


@query("W05_back_fill", "SELECT id, first_value(start_page IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS page FROM chapters")
def fill_back(t):
    return X.backward_fill(t("chapters"), ["book_id"], ["idx"], "start_page", "page").select("id", "page")


@query(
    "W06_page_drop_segments",
    "WITH l AS (SELECT *, last_value(start_page IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM chapters) SELECT id, CAST(sum(CASE WHEN start_page < before THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM l",
)
def drop_segments(t):
    before = F.last("start_page", True).over(W.partitionBy("book_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    return X.islands(t("chapters").withColumn("before", before), ["book_id"], ["idx"], F.col("start_page") < F.col("before"), "segment").select("id", "segment")


@query(
    "W07_contents_groups",
    "WITH p AS (SELECT DISTINCT book_id, page_no FROM vision_queue WHERE status = 'FAILED'), g AS (SELECT *, sum(CASE WHEN page_no - before > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, lag(page_no) OVER (PARTITION BY book_id ORDER BY page_no) AS before FROM p)), s AS (SELECT book_id, grp, count(*) AS n, min(page_no) AS first FROM g GROUP BY 1, 2) SELECT book_id, first, n FROM (SELECT *, sum(n) OVER (PARTITION BY book_id ORDER BY first ROWS UNBOUNDED PRECEDING) AS upto FROM s) WHERE upto <= 8",
)
def contents_groups(t):
    """Groups of pages at most five apart, from the first on, while they hold eight pages together."""
    p = t("vision_queue").where("status = 'FAILED'").select("book_id", "page_no").distinct()
    p = p.withColumn("before", F.lag("page_no").over(W.partitionBy("book_id").orderBy("page_no")))
    s = X.islands(p, ["book_id"], ["page_no"], F.col("page_no") - F.col("before") > 5, "grp").groupBy("book_id", "grp").agg(F.count("*").alias("n"), F.min("page_no").alias("first"))
    upto = F.sum("n").over(W.partitionBy("book_id").orderBy("first").rowsBetween(W.unboundedPreceding, 0))
    return s.withColumn("upto", upto).where("upto <= 8").select("book_id", "first", "n")


@query(
    "W09_monotone_filter",
    "SELECT id, start_page FROM (SELECT *, max(start_page) OVER (PARTITION BY book_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM chapters WHERE start_page IS NOT NULL) WHERE top IS NULL OR start_page > top",
)
def monotone(t):
    top = F.max("start_page").over(W.partitionBy("book_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    return t("chapters").where("start_page is not null").withColumn("top", top).where("top is null or start_page > top").select("id", "start_page")


@query(
    "W10_visual_rows",
    "WITH g AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY book, page ORDER BY y0, ord) AS gap FROM page_lines) SELECT book, page, ord, CAST(sum(CASE WHEN gap > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY book, page ORDER BY y0, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visual FROM g",
)
def visual_rows(t):
    gap = F.col("y0") - F.lag("y0").over(W.partitionBy("book", "page").orderBy("y0", "ord"))
    return X.islands(t("page_lines").withColumn("gap", gap), ["book", "page"], ["y0", "ord"], F.col("gap") > 15, "visual").select("book", "page", "ord", "visual")


@query("W11_dense_index", "SELECT id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY idx) - 1 AS INT) AS idx FROM chapters WHERE level = 1")
def dense_index(t):
    return t("chapters").where("level = 1").select("id", (F.row_number().over(W.partitionBy("book_id").orderBy("idx")) - 1).alias("idx"))


@query(
    "W13_adjacent_blocks",
    "WITH g AS (SELECT book, page, CASE WHEN sum(length(text)) > 900 THEN 'A' ELSE 'B' END AS kind FROM page_lines GROUP BY 1, 2), f AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND page - lag(page) OVER w <= 1 THEN 0 ELSE 1 END AS s FROM g WINDOW w AS (PARTITION BY book ORDER BY page)), i AS (SELECT *, sum(s) OVER (PARTITION BY book ORDER BY page ROWS UNBOUNDED PRECEDING) AS b FROM f) SELECT book, kind, min(page) AS first, max(page) AS last FROM i GROUP BY book, kind, b",
)
def adjacent_blocks(t):
    """Neighbouring pages of one kind merge to blocks."""
    g = t("page_lines").groupBy("book", "page").agg(F.when(F.sum(F.length("text")) > 900, "A").otherwise("B").alias("kind"))
    w = W.partitionBy("book").orderBy("page")
    joins = F.coalesce((F.col("kind") == F.lag("kind").over(w)) & (F.col("page") - F.lag("page").over(w) <= 1), F.lit(False))
    i = X.islands(g.withColumn("joins", joins), ["book"], ["page"], ~F.col("joins"), "b")
    return i.groupBy("book", "kind", "b").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("b")


@query(
    "W14_streaks",
    f"WITH g AS (SELECT book_id, CAST(day AS DATE) AS d, CAST(day AS DATE) - CAST(row_number() OVER (PARTITION BY book_id ORDER BY day) AS INT) AS run FROM reading_stats), r AS (SELECT book_id, run, count(*) AS n, max(d) AS last FROM g GROUP BY 1, 2) SELECT book_id, coalesce(max(CASE WHEN date_diff('day', last, DATE '{TODAY}') IN (0, 1) THEN n END), 0) AS streak FROM r GROUP BY 1",
)
def streak(t):
    return X.streaks(t("reading_stats").withColumn("d", F.col("day").cast("date")), "book_id", "d", TODAY)


@query(
    "W16_footnote_tail",
    "SELECT book, page, ord, max(CASE WHEN text LIKE 'A%' AND y0 > 250 THEN 1 ELSE 0 END) OVER (PARTITION BY book, page ORDER BY ord ROWS UNBOUNDED PRECEDING) = 1 AS footnote FROM page_lines",
)
def footnote_tail(t):
    """Once a footnote has started in the lower band of a page it goes on to the page's end."""
    starts = F.when(F.col("text").like("A%") & (F.col("y0") > 250), 1).otherwise(0)
    w = W.partitionBy("book", "page").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return t("page_lines").select("book", "page", "ord", (F.max(starts).over(w) == 1).alias("footnote"))


# --- orders, dates, geometry


@query(
    "T06_every_nth_page",
    "SELECT book, page FROM (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY page) AS k FROM (SELECT DISTINCT book, page FROM page_lines)) WHERE (k - 1) % 3 = 0 AND k <= 30",
)
def every_nth(t):
    p = t("page_lines").select("book", "page").distinct().withColumn("k", F.row_number().over(W.partitionBy("book").orderBy("page")))
    return p.where("(k - 1) % 3 = 0 and k <= 30").select("book", "page")


@query("T05_seeded_order")
def seeded_order(t):
    return t("review_items").where("NOT done").withColumn("r", F.xxhash64(F.lit(7), "id")).orderBy("r").select("id")


@query("T07_seeded_sample")
def seeded_sample(t):
    """Five pages of each book in a seeded order."""
    p = t("page_lines").select("book", "page").distinct()
    return R.newest_of_each(p, ["book"], [F.xxhash64(F.lit(7), "book", "page"), F.col("page")], 5)


@query(
    "T08_anchor_picks",
    "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY book_id) AS n FROM chapters) WHERE k = 1 OR k = floor(n / 2) + 1 OR k = n",
)
def anchor_picks(t):
    c = t("chapters").select("id", F.row_number().over(W.partitionBy("book_id").orderBy("idx")).alias("k"), F.count("*").over(W.partitionBy("book_id")).alias("n"))
    return c.where("k = 1 or k = n div 2 + 1 or k = n").select("id")


@query("T09_last_five", "SELECT id, book_id FROM qa_history QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY id DESC) <= 5 ORDER BY id")
def last_five(t):
    return R.newest_of_each(t("qa_history"), ["book_id"], [F.desc("id")], 5).select("id", "book_id").orderBy("id")


@query("D03_milestones", "SELECT day, minutes, minutes IN (7, 30, 100, 365) AS hit, list_min(list_filter([7, 30, 100, 365], lambda x: x > minutes)) AS next FROM (SELECT day, CAST(sum(minutes) % 400 AS INT) AS minutes FROM reading_stats GROUP BY 1)")
def milestones(t):
    d = t("reading_stats").groupBy("day").agg((F.sum("minutes") % 400).cast("int").alias("minutes"))
    marks = F.array(*[F.lit(x) for x in (7, 30, 100, 365)])
    return d.select("day", "minutes", F.col("minutes").isin(7, 30, 100, 365).alias("hit"), F.array_min(F.filter(marks, lambda x: x > F.col("minutes"))).alias("next"))


GOAL = 2000


@query(
    "D04_heat_map",
    f"WITH d AS (SELECT CAST(unnest(generate_series(date_trunc('week', DATE '{TODAY}') - INTERVAL 112 DAY, TIMESTAMP '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS d), m AS (SELECT day, sum(minutes) AS m FROM reading_stats GROUP BY 1) SELECT CAST(d AS VARCHAR) AS day, CASE WHEN coalesce(m, 0) = 0 THEN 0 WHEN m < {GOAL // 2} THEN 1 WHEN m < {GOAL} THEN 2 ELSE 3 END AS bucket FROM d LEFT JOIN m ON m.day = CAST(d AS VARCHAR)",
)
def heat_map(t):
    """Seventeen weeks to today, Monday first, with a bucket of minutes for each day."""
    m = t("reading_stats").groupBy("day").agg(F.sum("minutes").alias("m"))
    today = F.lit(TODAY).cast("date")
    first = F.date_sub(F.trunc(today, "week"), 112)
    days = m.sparkSession.range(1).select(F.explode(F.sequence(first, today)).alias("day")).select(F.col("day").cast("string").alias("day"))
    n = F.coalesce("m", F.lit(0))
    return days.join(m, "day", "left").select("day", F.when(n == 0, 0).when(n < GOAL // 2, 1).when(n < GOAL, 2).otherwise(3).alias("bucket"))


@query("D05_flush", "SELECT event_id, CAST(floor(floor(value * 1000) / 60000) AS BIGINT) AS minutes, CAST(floor(value * 1000) AS BIGINT) % 60000 AS carry FROM events")
def flush(t):
    ms = F.floor(F.col("value") * 1000)
    return t("events").select("event_id", F.floor(ms / 60000).alias("minutes"), (ms % 60000).alias("carry"))


@query("D06_days_between", "SELECT id, greatest(1, CAST(floor((due_at - last_review_at) / 86400000) AS BIGINT)) AS days FROM review_items WHERE last_review_at IS NOT NULL")
def days_between(t):
    return t("review_items").where("last_review_at is not null").select("id", F.greatest(F.lit(1).cast("long"), F.floor((F.col("due_at") - F.col("last_review_at")) / 86400000)).alias("days"))


@query("D07_back_off", "SELECT id, CASE WHEN status = 'FAILED' THEN [30, 60, 120][CAST(least(attempts, 2) AS INT) + 1] ELSE 2 END AS wait FROM vision_queue")
def back_off(t):
    waits = F.array(F.lit(30), F.lit(60), F.lit(120))
    return t("vision_queue").select("id", F.when(F.col("status") == "FAILED", F.get(waits, F.least("attempts", F.lit(2)))).otherwise(2).alias("wait"))


@query("M03_unit_budget", "SELECT chapter_id, id, CASE WHEN n = 1 THEN 10 ELSE greatest(1, least(4, CAST(floor(10.0 * len / total + 0.5) AS INT))) END AS budget FROM (SELECT chapter_id, id, length(text) AS len, sum(length(text)) OVER (PARTITION BY chapter_id) AS total, count(*) OVER (PARTITION BY chapter_id) AS n FROM paragraphs WHERE length(text) > 0)")
def unit_budget(t):
    """Ten units for a chapter of one block, else one to four by its share."""
    w = W.partitionBy("chapter_id")
    p = t("paragraphs").where(F.length("text") > 0).select("chapter_id", "id", F.length("text").alias("len"), F.sum(F.length("text")).over(w).alias("total"), F.count("*").over(w).alias("n"))
    share = F.floor(10.0 * F.col("len") / F.col("total") + 0.5).cast("int")
    return p.select("chapter_id", "id", F.when(F.col("n") == 1, 10).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), share))).alias("budget"))


@query("M01_rotated", "SELECT book, page, ord, CASE page % 4 WHEN 0 THEN x0 WHEN 1 THEN 800 - y0 WHEN 2 THEN 600 - x0 ELSE y0 END AS rx, CASE page % 4 WHEN 0 THEN y0 WHEN 1 THEN x0 WHEN 2 THEN 800 - y0 ELSE 600 - x0 END AS ry FROM page_lines")
def rotated(t):
    """A point on a page of 600 by 800 turned by quarter turns."""
    turn = F.col("page") % 4
    pick = lambda a, b, c, d: F.when(turn == 0, a).when(turn == 1, b).when(turn == 2, c).otherwise(d)
    x, y = F.col("x0"), F.col("y0")
    return t("page_lines").select("book", "page", "ord", pick(x, 800 - y, 600 - x, y).alias("rx"), pick(y, x, 800 - y, 600 - x).alias("ry"))
