"""The study queries (Q001 to Q133): each a DataFrame query and the same in DuckDB SQL.

Reads name a table, a predicate and an order, which both engines spell alike. A write gives the table as it is after
it. Ids and limits are parameters with the defaults that the registered queries use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.roles import SOURCES, oracle, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(lambda n: table(spark, sf_dir, n))
    if sql:
        ORACLES[name] = oracle(sql)


def _order(order: str) -> list[Column]:
    """Sort keys as in SQL, nulls being smallest."""
    out = []
    for key in order.split(", "):
        column, _, way = key.partition(" ")
        out.append(F.col(column).desc_nulls_last() if way == "desc" else F.col(column).asc_nulls_first())
    return out


def read(name: str, source: str, where: str = "true", columns: str = "*", order: str | None = None, limit: int | None = None, distinct: bool = False) -> None:
    def query(t: Callable[[str], DataFrame]) -> DataFrame:
        found = t(source)
        found = R.ordered(found, where, _order(order), limit) if order else found.where(where)
        found = found.select(*columns.split(", ")) if columns != "*" else found
        return found.distinct() if distinct else found

    by = ", ".join(f"{k} nulls {'last' if k.endswith('desc') else 'first'}" for k in order.split(", ")) if order else ""
    sql = f"SELECT {'DISTINCT ' * distinct}{columns} FROM {source} WHERE {where}" + f" ORDER BY {by}" * bool(by and not distinct) + f" LIMIT {limit}" * bool(limit)
    register(name, query, sql)


def update(name: str, source: str, where: str, **values: str) -> None:
    names = list(_columns(source))
    changed = ", ".join(f"CASE WHEN {where} THEN {values[c]} ELSE {c} END AS {c}" if c in values else c for c in names)
    register(name, lambda t: R.update_where(t(source), where, {c: F.expr(v) for c, v in values.items()}), f"SELECT {changed} FROM {source}")


def delete(name: str, source: str, where: str) -> None:
    register(name, lambda t: R.delete_where(t(source), where), f"SELECT * FROM {source} WHERE NOT coalesce({where}, false)")


def append(name: str, source: str, where: str, **values: str) -> None:
    """Rows like those of a predicate, with new values, are added."""
    names = list(_columns(source))
    fresh = ", ".join(f"{values.get(c, c)} AS {c}" for c in names)
    register(
        name, lambda t: R.append(t(source), t(source).where(where).selectExpr(*(f"{values.get(c, c)} AS {c}" for c in names))),
        f"SELECT * FROM {source} UNION ALL SELECT {fresh} FROM {source} WHERE {where}",
    )


def upsert(name: str, source: str, keys: str, where: str, **values: str) -> None:
    names = list(_columns(source))
    fresh = ", ".join(f"{values.get(c, c)} AS {c}" for c in names)
    register(
        name, lambda t: R.upsert(t(source), t(source).where(where).selectExpr(*(f"{values.get(c, c)} AS {c}" for c in names)), keys.split(", ")),
        f"WITH fresh AS (SELECT {fresh} FROM {source} WHERE {where}) SELECT * FROM {source} ANTI JOIN fresh USING ({keys}) UNION ALL SELECT * FROM fresh",
    )


def _columns(source: str) -> list[str]:
    """Names of a study table's columns, from the aliases of its definition."""
    import re

    body = re.split(r" FROM ", SOURCES[source])[0]
    depth, parts, start = 0, [], len("SELECT ")
    for i, ch in enumerate(body + ","):
        depth += (ch in "([{") - (ch in ")]}")
        if ch == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    return [p.split(" AS ")[-1].strip() for p in parts]


DAY, NOW, BOOK, CHAPTER = "2024-01-10", 850_000_000_000, 3, 7

upsert("Q001_settings_upsert", "settings", "key", "key like 'A%'", value="'new'")
read("Q002_settings_get", "settings", "key = 'ASIA'")
delete("Q003_settings_delete", "settings", "key = 'ASIA'")
read("Q004_settings_watch", "settings", "key = 'EUROPE'", "value")
read("Q005_books_all", "books", order="last_read_at desc, updated_at desc, id")
read("Q006_book_get", "books", f"id = {BOOK}")


def _progress(t: Callable[[str], DataFrame]) -> DataFrame:
    done = t("chapters").where("read_state = 'DONE'").groupBy("book_id").agg(F.count("*").alias("n"))
    return t("books").join(done, F.col("id") == F.col("book_id"), "left").select("id", "title", F.coalesce("n", F.lit(0)).alias("done"), "total_chapters")


PROGRESS = "SELECT id, title, (SELECT count(*) FROM chapters c WHERE c.book_id = b.id AND read_state = 'DONE') AS done, total_chapters FROM books b"
register("Q007_book_progress", lambda t: _progress(t).where(f"id = {BOOK}"), f"{PROGRESS} WHERE id = {BOOK}")
register("Q008_books_progress", _progress, PROGRESS)
update("Q009_book_mark_reading", "books", f"id = {BOOK}", last_chapter_id=f"{CHAPTER}", last_read_at=f"{NOW}", updated_at=f"{NOW}", status="'READING'")
append("Q010_book_insert", "books", f"id = {BOOK}", id="id + 1000", title="'copy'")
upsert("Q011_book_update", "books", "id", f"id = {BOOK}", title="'renamed'", updated_at=f"{NOW}")

#: A book's tables: those whose rows go with it, and by which keys; of (table, column) each is a row of that table.
CASCADES = {
    "chapters": [("books", "book_id")], "paragraphs": [("chapters", "chapter_id")], "vision_queue": [("books", "book_id")], "figures": [("books", "book_id"), ("chapters", "chapter_id")],
    "para_notes": [("chapters", "chapter_id")], "chapter_assets": [("chapters", "chapter_id")], "quiz_attempts": [("chapters", "chapter_id")], "review_items": [("books", "book_id"), ("chapters", "chapter_id")],
    "review_log": [("review_items", "item_id")], "bookmarks": [("books", "book_id"), ("chapters", "chapter_id")], "qa_history": [("books", "book_id")], "para_memos": [("books", "book_id"), ("chapters", "chapter_id")],
    "reading_stats": [("books", "book_id")],
}


def _deleted(t) -> DataFrame:
    """(source, gone, kept): what goes with a book, table by table, along every key."""
    gone, out = {"books": t("books").where(f"id = {BOOK}").select("id")}, None
    for name, keys in CASCADES.items():
        rows = t(name)
        for i, (parent, column) in enumerate(keys):
            rows = rows.join(gone[parent].select(F.col("id").alias(column), F.lit(1).alias(f"hit{i}")), column, "left")
        lost = F.coalesce(*[F.col(f"hit{i}") for i in range(len(keys))]).isNotNull()
        if "id" in rows.columns:
            gone[name] = rows.where(lost).select("id")
        count = rows.agg(F.count_if(lost).alias("gone"), F.count_if(~lost).alias("kept")).select(F.lit(name).alias("source"), "gone", "kept")
        out = count if out is None else out.unionByName(count)
    return out


def _deleted_sql() -> str:
    parts, where = [], {"books": f"SELECT id FROM books WHERE id = {BOOK}"}
    for name, keys in CASCADES.items():
        hit = " OR ".join(f"coalesce({column} IN ({where[parent]}), false)" for parent, column in keys)
        where[name] = f"SELECT id FROM {name} WHERE {hit}"
        parts.append(f"SELECT '{name}' AS source, count(*) FILTER ({hit}) AS gone, count(*) FILTER (NOT ({hit})) AS kept FROM {name}")
    return " UNION ALL ".join(parts)


register("Q012_book_delete", _deleted, _deleted_sql())
read("Q013_book_overview", "books", f"id = {BOOK + 1}", "overview_json")
update("Q014_book_save_overview", "books", f"id = {BOOK}", overview_json="'{}'", updated_at=f"{NOW}")


def _with_assets(t: Callable[[str], DataFrame], flat: bool) -> DataFrame:
    assets = t("chapter_assets").select(F.col("chapter_id"), "mindmap_tree", "summary_md")
    chapters = t("chapters").where(f"book_id = {BOOK}")
    chapters = chapters.where("level = 1") if flat else chapters
    out = chapters.join(assets, F.col("id") == F.col("chapter_id"), "left").withColumns(
        {"has_asset": F.col("chapter_id").isNotNull(), "has_map": F.coalesce(F.col("mindmap_tree") != "", F.lit(False))}
    )
    return out.orderBy("idx").select("id", "idx", "title", "read_state", "has_asset", "has_map", *([] if flat else ["level", "start_page", "ai_gist"]))


ASSETS = "SELECT id, idx, title, read_state, a.chapter_id IS NOT NULL AS has_asset, coalesce(mindmap_tree <> '', false) AS has_map%s FROM chapters c LEFT JOIN chapter_assets a ON a.chapter_id = c.id WHERE book_id = %d%s ORDER BY idx"
register("Q015_chapters_with_assets", lambda t: _with_assets(t, True), ASSETS % ("", BOOK, " AND level = 1"))
read("Q016_chapters_by_book", "chapters", f"book_id = {BOOK}", order="idx")
register("Q017_chapter_tree", lambda t: _with_assets(t, False), ASSETS % (", level, start_page, ai_gist", BOOK, ""))
read("Q018_chapter_by_id", "chapters", f"id = {CHAPTER}")
read("Q019_chapter_by_id_live", "chapters", f"id = {CHAPTER + 1}")
append("Q020_chapters_insert", "chapters", f"book_id = {BOOK}", id="id + 1000000", idx="idx + 1000")
update("Q021_chapter_read_state", "chapters", f"id = {CHAPTER}", read_state="'DONE'")
update("Q022_chapter_title", "chapters", f"id = {CHAPTER}", title="'A new title'")
update("Q023_chapter_gist", "chapters", f"id = {CHAPTER}", ai_gist="'gist'", key_terms_json="'[]'")
update("Q024_chapter_last_para", "chapters", f"id = {CHAPTER}", last_read_para="12")
delete("Q025_chapters_delete", "chapters", f"book_id = {BOOK}")


def _terms(t: Callable[[str], DataFrame]) -> DataFrame:
    books = t("books").select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    found = t("chapters").where("key_terms_json is not null and key_terms_json <> ''").join(books, "book_id")
    return found.select("book_id", "book_title", "id", "idx", "title", "key_terms_json").orderBy("book_id", "idx")


TERMS = "SELECT b.id AS book_id, b.title AS book_title, c.id, c.idx, c.title, c.key_terms_json FROM chapters c JOIN books b ON b.id = c.book_id WHERE c.key_terms_json IS NOT NULL AND c.key_terms_json <> ''"
register("Q026_chapters_with_terms", _terms, TERMS + " ORDER BY 1, 4")
read("Q027_paragraphs_live", "paragraphs", f"chapter_id = {CHAPTER}", order="idx")
read("Q028_paragraphs_by_chapter", "paragraphs", f"chapter_id = {CHAPTER + 2}", order="idx")
read("Q029_paragraph_by_idx", "paragraphs", f"chapter_id = {CHAPTER} AND idx = 1", order="id", limit=1)
append("Q030_paragraphs_insert", "paragraphs", f"chapter_id = {CHAPTER}", id="id + 50000", idx="idx + 50000")
update("Q031_paragraph_action", "paragraphs", f"id = {CHAPTER * 100000 + 1}", ai_action="'EXPLAIN'", group_id="1", why="'key'")
delete("Q032_paragraphs_delete", "paragraphs", f"chapter_id = {CHAPTER}")


def _chapters_of(t: Callable[[str], DataFrame], *columns: Column) -> DataFrame:
    return t("chapters").select(F.col("id").alias("chapter_id"), F.col("book_id"), *columns)


register(
    "Q033_paragraphs_for_rebuild",
    lambda t: t("paragraphs").join(_chapters_of(t, F.col("idx").alias("chapter_idx")).where(f"book_id = {BOOK}"), "chapter_id").orderBy(F.asc_nulls_first("page_no"), "chapter_idx", "idx").select("id", "chapter_id", "idx", "text", "role", "page_no"),
    f"SELECT p.id, chapter_id, p.idx, text, role, page_no FROM paragraphs p JOIN chapters c ON c.id = p.chapter_id WHERE book_id = {BOOK} ORDER BY page_no NULLS FIRST, c.idx, p.idx",
)


def escaped(query: str) -> str:
    """A pattern that finds the query anywhere, its wildcards taken literally."""
    for mark in "\\%_":
        query = query.replace(mark, "\\" + mark)
    return f"%{query}%"


def _folded(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(t: Callable[[str], DataFrame], book: int, query: str, limit: int) -> DataFrame:
    """Paragraphs of a book that hold the query, ASCII case ignored, in reading order."""
    hits = t("paragraphs").where(_folded(F.col("text")).like(escaped(query).translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))))
    hits = hits.join(_chapters_of(t, F.col("title"), F.col("idx").alias("chapter_idx")).where(f"book_id = {book}"), "chapter_id")
    return hits.orderBy("chapter_idx", "idx").limit(limit).select("id", "chapter_id", "title", "idx", "text")


FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
register(
    "Q034_search_in_book", lambda t: search(t, BOOK, "The", 50),
    f"SELECT p.id, chapter_id, c.title, p.idx, text FROM paragraphs p JOIN chapters c ON c.id = p.chapter_id WHERE book_id = {BOOK} AND {FOLD} LIKE '%the%' ESCAPE '\\' ORDER BY c.idx, p.idx LIMIT 50",
)
register(
    "Q035_chars_by_book", lambda t: t("paragraphs").join(_chapters_of(t).where(f"book_id = {BOOK}"), "chapter_id").groupBy("chapter_id").agg(F.sum(F.length("text")).alias("chars")),
    f"SELECT chapter_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM paragraphs p JOIN chapters c ON c.id = p.chapter_id WHERE book_id = {BOOK} GROUP BY 1",
)
read("Q036_notes_live", "para_notes", f"chapter_id = {CHAPTER}", order="id")
read("Q037_notes_by_chapter", "para_notes", f"chapter_id = {CHAPTER + 3}", order="id")
append("Q038_note_insert", "para_notes", f"chapter_id = {CHAPTER}", id="id + 50000")
delete("Q039_notes_delete", "para_notes", f"chapter_id = {CHAPTER}")
delete("Q040_notes_delete_by_paras", "para_notes", f"para_ids = '[{CHAPTER * 100000}]'")
delete("Q041_note_delete", "para_notes", f"id = {CHAPTER * 100000}")
read("Q042_asset_by_chapter", "chapter_assets", f"chapter_id = {CHAPTER}")
read("Q043_asset_live", "chapter_assets", "chapter_id < 20")
upsert("Q044_asset_upsert", "chapter_assets", "chapter_id", "chapter_id < 50", summary_md="'new'", created_at=f"{NOW}")
read("Q045_attempts_by_chapter", "quiz_attempts", f"chapter_id = {CHAPTER}", order="created_at desc, id desc")


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The newest attempt at each question; of equally new ones the larger id."""
    return R.newest_of_each(attempts, ["chapter_id", "q_index"], [F.col("created_at").desc(), F.col("id").desc()])


LATEST = "(SELECT * FROM quiz_attempts QUALIFY row_number() OVER (PARTITION BY chapter_id, q_index ORDER BY created_at DESC, id DESC) = 1)"
register(
    "Q046_wrong_latest_by_chapter",
    lambda t: latest_attempts(t("quiz_attempts").where(f"chapter_id = {CHAPTER}")).where("verdict in ('WRONG', 'PARTIAL')").orderBy(F.desc("created_at"), F.desc("id")).limit(5),
    f"SELECT * FROM {LATEST} WHERE chapter_id = {CHAPTER} AND verdict IN ('WRONG', 'PARTIAL') ORDER BY created_at DESC, id DESC LIMIT 5",
)
read("Q047_attempts_live", "quiz_attempts", f"chapter_id = {CHAPTER + 1}", order="created_at desc, id desc")
delete("Q048_attempts_delete", "quiz_attempts", f"chapter_id = {CHAPTER}")
append("Q049_attempt_insert", "quiz_attempts", "id = 1", id="id + 10000000")
register(
    "Q050_wrong_latest",
    lambda t: latest_attempts(t("quiz_attempts")).where("verdict = 'WRONG'").join(_chapters_of(t, F.col("title").alias("chapter_title")), "chapter_id").join(t("books").select(F.col("id").alias("book_id"), F.col("title").alias("book_title")), "book_id").orderBy(F.desc("created_at")).select("id", "chapter_id", "q_index", "answer", "created_at", "chapter_title", "book_id", "book_title"),
    f"SELECT a.id, chapter_id, q_index, answer, a.created_at, c.title AS chapter_title, b.id AS book_id, b.title AS book_title FROM {LATEST} a JOIN chapters c ON c.id = a.chapter_id JOIN books b ON b.id = c.book_id WHERE verdict = 'WRONG'",
)
register("Q051_due_count", lambda t: t("review_items").where(f"NOT done AND due_at <= {NOW}").agg(F.count("*").alias("due")), f"SELECT count(*) AS due FROM review_items WHERE NOT done AND due_at <= {NOW}")
read("Q052_due_list", "review_items", f"NOT done AND due_at <= {NOW}", order="due_at, id")


def due_with_book(t: Callable[[str], DataFrame], now: int = NOW) -> DataFrame:
    books = t("books").select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    return t("review_items").where(f"NOT done AND due_at <= {now}").join(books, "book_id")


register("Q053_due_with_book", lambda t: due_with_book(t).select("id", "book_id", "chapter_id", "due_at", "book_title").orderBy("due_at", "id"), f"SELECT r.id, r.book_id, chapter_id, due_at, b.title AS book_title FROM review_items r JOIN books b ON b.id = r.book_id WHERE NOT done AND due_at <= {NOW}")
register("Q054_due_by_book", lambda t: due_with_book(t).groupBy("book_id", "book_title").agg(F.countDistinct("chapter_id").alias("chapters")), f"SELECT b.id AS book_id, b.title AS book_title, count(DISTINCT chapter_id) AS chapters FROM review_items r JOIN books b ON b.id = r.book_id WHERE NOT done AND due_at <= {NOW} GROUP BY 1, 2")
register(
    "Q055_review_insert_new", lambda t: R.append_new(t("review_items"), t("review_items").where("id % 3 = 0").withColumn("id", F.expr("CASE WHEN id % 2 = 0 THEN id + 100000000 ELSE id END")), ["id"]),
    f"WITH fresh AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN id + 100000000 ELSE id END AS id) FROM review_items WHERE id % 3 = 0) SELECT * FROM review_items UNION ALL SELECT * FROM fresh ANTI JOIN review_items USING (id)",
)
update("Q056_review_mark_result", "review_items", "id = 33", interval_idx="2", due_at=f"{NOW}", done="true", fsrs_state="2", fsrs_stability="4.5", fsrs_difficulty="6.0", last_review_at=f"{NOW - 1}")
read("Q057_pending_by_book", "review_items", f"book_id = {BOOK} AND NOT done", order="due_at, id")
read("Q058_review_by_id", "review_items", "id = 33")
delete("Q059_review_delete", "review_items", f"chapter_id = {CHAPTER}")
append("Q060_log_insert", "review_log", "id = 11", id="id + 1000000000")
register("Q061_log_count", lambda t: t("review_log").where("item_id = 33").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM review_log WHERE item_id = 33")
read("Q062_log_latest", "review_log", order="id desc", limit=1)
register("Q063_log_previous", lambda t: t("review_log").where("item_id = 33").orderBy(F.desc("id")).offset(1).limit(1), "SELECT * FROM review_log WHERE item_id = 33 ORDER BY id DESC LIMIT 1 OFFSET 1")
delete("Q064_log_delete", "review_log", "id = 11")
append("Q065_queue_insert", "vision_queue", "id < 40", id="id + 100000000", status="'PENDING'", attempts="0")
read("Q066_queue_by_book", "vision_queue", f"book_id = {BOOK}", order="page_no, id")
read("Q067_books_with_pending", "vision_queue", "status = 'PENDING'", "book_id", distinct=True)
update("Q068_queue_reset_failed", "vision_queue", "status = 'FAILED'", status="'PENDING'", attempts="0", updated_at=f"{NOW}")
update("Q069_queue_reset_failed_book", "vision_queue", f"status = 'FAILED' AND book_id = {BOOK}", status="'PENDING'", attempts="0", updated_at=f"{NOW}")
update("Q070_queue_update_status", "vision_queue", "id = 33", status="'FAILED'", attempts="3", updated_at=f"{NOW}")
register(
    "Q071_queue_progress", lambda t: t("vision_queue").groupBy("book_id").agg(F.count_if(F.col("status") == "DONE").alias("done"), F.count("*").alias("total"), F.count_if(F.col("status") == "FAILED").alias("failed")),
    "SELECT book_id, count(*) FILTER (status = 'DONE') AS done, count(*) AS total, count(*) FILTER (status = 'FAILED') AS failed FROM vision_queue GROUP BY 1",
)


def any_use(t: Callable[[str], DataFrame], book: int) -> DataFrame:
    """Whether a book has a finished page, a gist, a note or an asset: each an existence, no row is counted."""
    of_book = t("chapters").where(f"book_id = {book}")
    ids = of_book.select(F.col("id").alias("chapter_id"))
    there = [
        t("vision_queue").where(f"book_id = {book} AND status = 'DONE'"), of_book.where("ai_gist is not null and ai_gist <> ''"),
        t("para_notes").join(ids, "chapter_id", "left_semi"), t("chapter_assets").join(ids, "chapter_id", "left_semi"),
    ]
    out = there[0].limit(1).select(F.lit(1).alias("x"))
    for more in there[1:]:
        out = out.unionByName(more.limit(1).select(F.lit(1).alias("x")))
    return out.agg((F.count("*") > 0).alias("used"))


register(
    "Q072_any_ai_use", lambda t: any_use(t, BOOK),
    f"SELECT EXISTS (SELECT 1 FROM vision_queue WHERE book_id = {BOOK} AND status = 'DONE') OR EXISTS (SELECT 1 FROM chapters WHERE book_id = {BOOK} AND ai_gist <> '') OR EXISTS (SELECT 1 FROM para_notes n JOIN chapters c ON c.id = n.chapter_id WHERE book_id = {BOOK}) OR EXISTS (SELECT 1 FROM chapter_assets a JOIN chapters c ON c.id = a.chapter_id WHERE book_id = {BOOK}) AS used",
)
read("Q073_done_pages", "vision_queue", f"book_id = {BOOK} AND status = 'DONE'", "page_no", distinct=True)
append("Q074_figures_insert", "figures", f"book_id = {BOOK}", id="id + 1000000")
read("Q075_figures_by_chapter", "figures", f"chapter_id = {CHAPTER}", order="page_no, ord_after_para, y, id")
read("Q076_figures_by_book", "figures", f"book_id = {BOOK}", order="page_no, ord_after_para, y, id")
read("Q077_figure_pages", "figures", f"book_id = {BOOK}", "page_no", distinct=True)
delete("Q078_figures_delete", "figures", f"book_id = {BOOK}")
append("Q079_bookmark_insert", "bookmarks", "id = 1", id="id + 1000000")
delete("Q080_bookmark_delete", "bookmarks", "id = 1")


def _with_chapter(source: str, name: str, book: int) -> None:
    register(
        name, lambda t: t(source).where(f"book_id = {book}").join(t("chapters").select(F.col("id").alias("chapter_id"), F.col("title").alias("chapter_title"), F.col("idx").alias("chapter_idx")), "chapter_id").orderBy(F.desc("created_at"), F.desc("id")),
        f"SELECT s.*, c.title AS chapter_title, c.idx AS chapter_idx FROM {source} s JOIN chapters c ON c.id = s.chapter_id WHERE s.book_id = {book}",
    )


_with_chapter("bookmarks", "Q081_bookmarks_with_chapter", BOOK)
append("Q082_qa_insert", "qa_history", "id < 1003", id="id + 100000000")
read("Q083_qa_latest_by_book", "qa_history", f"book_id = {BOOK}", order="created_at desc, id desc", limit=50)
read("Q084_qa_latest_by_chapter", "qa_history", f"chapter_id = {CHAPTER}", order="created_at desc, id desc", limit=5)
register(
    "Q085_qa_trim", lambda t: R.newest_of_each(t("qa_history"), ["book_id"], [F.desc("created_at"), F.desc("id")], 10),
    "SELECT * FROM qa_history QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, id DESC) <= 10",
)
append("Q086_memo_insert", "para_memos", "id = 1", id="id + 1000000")
delete("Q087_memo_delete", "para_memos", "id = 1")
read("Q088_memos_live", "para_memos", f"chapter_id = {CHAPTER}", order="para_idx, id")
read("Q089_memos_by_chapter", "para_memos", f"chapter_id = {CHAPTER + 1}", order="para_idx, id")
_with_chapter("para_memos", "Q090_memos_with_chapter", BOOK)
BACKUP = ["books", "chapters", "paragraphs", "para_notes", "chapter_assets", "quiz_attempts", "review_items", "bookmarks", "qa_history", "para_memos", "settings", "reading_stats"]
KEYS = {"settings": "key", "chapter_assets": "chapter_id", "reading_stats": "book_id, day"}
for i, source in enumerate(BACKUP):
    read(f"Q{91 + i:03d}_backup_{source}", source, order=KEYS.get(source, "id"))
CLEARED = ["paragraphs", "para_notes", "chapter_assets", "quiz_attempts", "review_items", "bookmarks", "qa_history", "para_memos", "reading_stats", "figures", "vision_queue", "chapters", "books"]
for i, source in enumerate(CLEARED):
    register(f"Q{103 + i}_clear_{source}", lambda t, s=source: R.truncate(t(s)), f"SELECT * FROM {source} LIMIT 0")
delete("Q116_backup_delete_setting", "settings", "key = 'AFRICA'")
RESTORED = ["books", "chapters", "paragraphs", "para_notes", "chapter_assets", "quiz_attempts", "review_items", "bookmarks", "qa_history", "para_memos", "reading_stats", "settings"]
for i, source in enumerate(RESTORED):
    # a restore inserts what the backup holds into the cleared table
    register(f"Q{117 + i}_restore_{source}", lambda t, s=source: R.append(R.truncate(t(s)), t(s)), f"SELECT * FROM {source}")
read("Q129_minutes_for", "reading_stats", f"book_id = {CHAPTER} AND day = '{DAY}'", "minutes")
upsert("Q130_stats_upsert", "reading_stats", "book_id, day", f"day = '{DAY}'", minutes="minutes + 5")


def add_minutes(stats: DataFrame, more: DataFrame) -> DataFrame:
    """Minutes read are added to the day's: a log of additions, summed."""
    return stats.unionByName(more).groupBy("book_id", "day").agg(F.sum("minutes").alias("minutes"))


register(
    "Q131_add_minutes", lambda t: add_minutes(t("reading_stats"), t("reading_stats").where(f"day = '{DAY}'").withColumn("minutes", F.lit(7).cast("long"))),
    f"SELECT book_id, day, CASE WHEN day = '{DAY}' THEN minutes + 7 ELSE minutes END AS minutes FROM reading_stats",
)
register("Q132_minutes_on_day", lambda t: t("reading_stats").where(f"day = '{DAY}'").agg(F.coalesce(F.sum("minutes"), F.lit(0)).alias("minutes")), f"SELECT CAST(coalesce(sum(minutes), 0) AS BIGINT) AS minutes FROM reading_stats WHERE day = '{DAY}'")
register("Q133_minutes_by_day", lambda t: t("reading_stats").groupBy("day").agg(F.sum("minutes").alias("minutes")).orderBy(F.desc("day")), "SELECT day, CAST(sum(minutes) AS BIGINT) AS minutes FROM reading_stats GROUP BY 1")
register("A06_minutes_by_day", lambda t: t("reading_stats").groupBy("day").agg(F.sum("minutes").alias("m")), "SELECT day, CAST(sum(minutes) AS BIGINT) AS m FROM reading_stats GROUP BY 1")
