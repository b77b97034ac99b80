"""Books cut by their contents, read again, pulled and worked through.

A source is a book here, its documents are the pages, and their lines, spelt in Chinese, stand on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..cluster import written
from ..functions import text as T
from ..operators import calibration as C
from ..operators import chapters as H
from ..operators import pull as U
from ..operators import rebuild as B
from ..operators import recognition as G
from ..operators import review as V
from ..operators import workflow as K
from ..operators.temporal import asof_values
from ..sources.roles import oracle, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Pages of a volume, each of which begins with a page of contents; the size of a page.
VOLUME, WIDTH, HEIGHT = 24, 460.0, 470.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def shelf(t) -> DataFrame:
    """(book, page, ord, id, doc, text): the lines of each source's documents as pages of a book, written, as all that follows reads them."""
    pages = t("chapters").select(F.col("id").alias("doc"), F.col("book_id"), (F.col("idx") + 1).alias("leaf"))
    lines = t("han").join(pages, F.col("book") == F.col("doc"))
    ord_ = ((F.col("page") - 1) * 30 + F.col("ord")).cast("int")
    return written(lines.select(F.col("book_id").alias("book"), F.col("leaf").alias("page"), ord_.alias("ord"), "id", "doc", "text"), "books-shelf")


def calibration_inputs(t) -> dict[str, DataFrame]:
    """A contents list with chapters and sections, some without a page and, in some books, some out of order; chapters cut
    before, some of them two pages late and some missing."""
    lines = shelf(t)
    heads = written(lines.where("ord = 0").select("book", (F.col("page") - 1).alias("idx"), "text"), "books-heads")
    place, title = F.col("idx") % VOLUME, T.normal_title(F.col("text"))
    printed = F.when(F.col("idx") % 16 == 9, None).when((F.col("idx") % 40 == 17) & (F.col("book") % 5 == 3), F.greatest(F.lit(1), place - 9)).otherwise(place - 2)
    entries = heads.where((place >= 3) & (F.col("idx") % 2 == 1)).select("book", F.col("idx").alias("seq"), title.alias("title"), printed.cast("int").alias("page"), F.when(F.col("idx") % 4 == 1, 1).otherwise(2).alias("level"))
    cut = heads.where("idx = 0 or idx % 4 = 1 and idx % 3 <> 2").withColumn("start", F.col("idx") + 1 + F.when(F.col("idx") % 3 == 1, 2).otherwise(0))
    paragraphs = asof_values(lines.select("book", "page", "ord", "id"), cut.select("book", "start", F.col("idx").alias("chapter")), "book", "page", "start", ["chapter"])
    lost = (F.col("page") * 31 + F.col("ord")) % 53 == 0
    paragraphs = paragraphs.select("book", "chapter", (F.col("page") * 10000 + F.col("ord")).alias("idx"), F.when(~lost, F.col("page")).alias("page"), "id")
    ends = heads.where(place == 0).select("book", (F.col("idx") + 1).alias("last_page"))
    return {
        "entries": entries, "chapters": cut.select("book", F.col("idx").alias("chapter"), F.col("text").alias("title")), "paragraphs": paragraphs, "lines": lines.select("book", "page", "ord", "text"),
        "books": heads.groupBy("book").agg((F.max("idx") + 1).alias("pages")), "contents_ends": ends,
    }


def marked_blocks(t) -> DataFrame:
    """Blocks of three lines in Chinese, some pages' first ones with the mark of their page, a few with that of a contents list."""
    lines = t("han").select("book", (F.col("id") % 100000).alias("pos"), "text")
    rows = lines.groupBy("book", F.floor(F.col("pos") / 3).alias("idx")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("lines"))
    page = F.when(F.col("idx") % 10 == 0, F.array(F.concat(F.lit("〔页"), (F.col("idx") / 10 + 1).cast("int").cast("string"), F.lit("〕")))).otherwise(F.array().cast("array<string>"))
    listed = F.when(F.col("idx") % 29 == 13, F.array(F.lit("〔目录〕"))).otherwise(F.array().cast("array<string>"))
    return rows.select("book", "idx", F.concat(page, listed, "lines").alias("lines"))


@query("C07_book_chapters")
def book_chapters(t):
    return H.parse(marked_blocks(t)).chapters


@query("C07_book_paragraphs")
def book_paragraphs(t):
    return H.parse(marked_blocks(t)).paragraphs


@query(
    "F19_contents_blocks",
    r"""WITH l AS (SELECT book, (id % 100000) // 3 AS idx, trim(text) AS t FROM han), k AS (SELECT book, idx, t, regexp_matches(t, '[…·.•‧．●]{2,}\s*[（(]?\d{1,4}[）)]?\s*$') OR regexp_matches(t, '^(\d{1,4}|[（(]\d{1,4}[）)])$')
    OR regexp_matches(t, '^第[一二三四五六七八九十百千零〇两]+[章节目款回].{0,60}?[（(]?\d{1,4}[）)]?\s*$') AS dot FROM l WHERE t <> '')
    SELECT book, idx, max(CAST(dot AS INT)) = 1 AND 2 * count(*) FILTER (dot OR regexp_matches(t, '^第[一二三四五六七八九十百千0-9零〇两]+[章单元篇部卷回节讲]') OR t IN ('前言', '序言', '引言', '目录', '附录', '后记', '参考文献')) >= count(*) AS listed FROM k GROUP BY 1, 2""",
)
def contents_blocks(t):
    """Blocks of three lines that read as part of a contents list."""
    lines = t("han").groupBy("book", F.floor((F.col("id") % 100000) / 3).alias("idx")).agg(F.collect_list("text").alias("lines"))
    return lines.select("book", "idx", T.contents_block(F.col("lines")).alias("listed"))


@query(
    "P13_phantom_of_headings",
    """WITH p AS (SELECT book, id % 100000 AS pos, trim(text) AS t, length(text) AS n FROM han UNION ALL SELECT book, 99999, '注', CAST(sum(length(text)) AS BIGINT) FROM han GROUP BY book),
    k AS (SELECT * FROM p WHERE CASE book % 3 WHEN 0 THEN pos % 17 = 1 AND pos < 99999 WHEN 1 THEN pos % 17 = 1 OR pos = 99999 ELSE pos < 99999 END), c AS (SELECT book, count(*) AS n, count(*) FILTER (NOT regexp_matches(t, '^第[一二三四五六七八九十百千零〇两]+节')) AS others, max(CASE WHEN NOT regexp_matches(t, '^第[一二三四五六七八九十百千零〇两]+节') THEN n END) AS longest FROM k GROUP BY 1)
    SELECT book AS chapter_id, CASE WHEN n < 2 THEN 'keep' WHEN others = 0 THEN CASE WHEN n <= 15 THEN 'drop' ELSE 'keep' END WHEN others <= 3 AND longest >= 2000 THEN 'clean' ELSE 'keep' END AS decision FROM c""",
)
def phantom_of_headings(t):
    """A third of the chapters holds section entries only, a third has a paragraph of all text beside them, a third is whole."""
    han = t("han").select(F.col("book").alias("chapter_id"), (F.col("id") % 100000).alias("idx"), "text")
    whole = han.groupBy("chapter_id").agg(F.lit(99999).cast("long").alias("idx"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "").alias("text"))
    entry, book = F.col("idx") % 17 == 1, F.col("chapter_id") % 3
    lines = han.where((book == 2) | entry).unionByName(whole.where(book == 1))
    return V.phantom_chapters(lines.withColumns({"title": F.lit("第一章 总则"), "role": F.lit("BODY")})).select("chapter_id", "decision")


@query("C10_calibrated")
def calibrated(t):
    return C.calibrate(**calibration_inputs(t)).chapters


@query(
    "C15_carried_over",
    r"""WITH o AS (SELECT book_id AS book, id, idx, title, read_state, replace(title, ' ', '') AS key, row_number() OVER (PARTITION BY book_id, replace(title, ' ', '') ORDER BY idx) AS nth FROM chapters),
    v AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY idx) - 1 AS ord, CASE WHEN idx % 7 = 3 THEN title || 'x' WHEN idx % 3 = 1 THEN replace(title, ' ', '  ') ELSE title END AS title FROM o WHERE idx % 5 <> 4),
    n AS (SELECT *, replace(title, ' ', '') AS key, row_number() OVER (PARTITION BY book, replace(title, ' ', '') ORDER BY ord) AS nth FROM v),
    r AS (SELECT book, key, max_by(read_state, idx) AS read_state FROM o WHERE read_state <> 'UNREAD' GROUP BY 1, 2)
    SELECT book, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.ord IS NULL THEN 'delete' WHEN o.title = n.title AND o.idx = n.ord THEN 'keep' ELSE 'update' END AS action, id, CAST(ord AS INTEGER) AS ord, n.title AS title,
      CASE WHEN n.ord IS NOT NULL THEN coalesce(r.read_state, 'UNREAD') END AS read_state FROM o FULL JOIN n USING (book, key, nth) LEFT JOIN r USING (book, key)""",
)
def carried_over(t):
    old = t("chapters").select(F.col("book_id").alias("book"), "id", "idx", "title", "read_state")
    title = F.when(F.col("idx") % 7 == 3, F.concat("title", F.lit("x"))).when(F.col("idx") % 3 == 1, F.replace("title", F.lit(" "), F.lit("  "))).otherwise(F.col("title"))
    new = old.where("idx % 5 <> 4").select("book", (F.row_number().over(W.partitionBy("book").orderBy("idx")) - 1).cast("int").alias("ord"), title.alias("title"))
    return C.carry_over(old, new)


def recalibration_inputs(t) -> tuple[DataFrame, ...]:
    """The same books with pages of contents in them; every seventh is in use."""
    given = calibration_inputs(t)
    ids = lambda book, chapter: F.col(book) * 1_000_000 + F.col(chapter)
    state = F.when(F.col("chapter") % 2 == 1, "DONE").otherwise("UNREAD")
    chapters = given["chapters"].select("book", ids("book", "chapter").alias("id"), F.col("chapter").alias("idx"), "title", state.alias("read_state"))
    texts = given["lines"].select("book", "page", "ord", "text").withColumn("text", F.when((F.col("page") % VOLUME == 1) & (F.col("ord") > 0), F.concat(F.left("text", F.lit(6)), F.lit(" …… 3"))).otherwise(F.col("text")))
    rows = given["paragraphs"].withColumn("at", F.expr("cast(idx div 10000 as int)")).withColumn("ord", (F.col("idx") % 10000).cast("int"))
    rows = rows.select("book", F.col("at").alias("leaf"), "ord", "id", ids("book", "chapter").alias("chapter"), "idx", F.col("page").alias("known"))
    paragraphs = rows.join(texts.withColumnRenamed("page", "leaf"), ["book", "leaf", "ord"]).select("book", "id", "chapter", "idx", F.col("known").alias("page"), "text")
    books = given["books"].select("book", (F.col("book") * 1_000_000 + 1).alias("last_read"))
    return books, chapters, paragraphs, given["entries"], books.where("book % 7 = 6").select("book")


@query("C15_recalibrated")
def recalibrated(t):
    """The changes of each book's chapters, and why the others have none."""
    verdicts, changes, _ = C.recalibrate(*recalibration_inputs(t))
    told = verdicts.select("book", F.col("reason").alias("action"), F.lit(None).cast("long").alias("id"), "last_read_ord")
    return changes.select("book", "action", "id", "ord", "title", "read_state").unionByName(told.select("book", "action", "id", F.col("last_read_ord").alias("ord"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("read_state")))


def rebuild_inputs(t) -> tuple[DataFrame, ...]:
    """Every third page read again, and some that no paragraph was on; some books are in use, some have sections."""
    lines = shelf(t)
    paragraphs = lines.select("book", F.col("doc").alias("chapter"), F.col("ord").alias("idx"), "page", "text", F.lit("BODY").alias("role"))
    chapters = t("chapters").select(F.col("book_id").alias("book"), "id", "idx", F.when(F.col("book_id") % 6 == 5, F.col("level")).otherwise(1).alias("level"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.concat(x["text"], F.lit("＊")))
    again = lines.where("page % 3 = 2").groupBy("book", "page").agg(body.alias("body"), F.array(F.max("text")).alias("notes"))
    orphans = again.where("page % 10 = 5").select("book", (F.col("page") + 100000).alias("page"), "body", F.array().cast("array<string>").alias("notes"))
    figures = t("figures").select(F.col("book_id").alias("book"), "id", F.col("page_no").alias("page"), F.col("chapter_id").alias("chapter"))
    return paragraphs, chapters, again.unionByName(orphans), chapters.where("book % 7 = 6").select("book").distinct(), figures


@query("C14_rebuilt")
def rebuilt(t):
    out, _, _ = B.rebuild_if_safe(*rebuild_inputs(t))
    return out.select("book", "chapter", "idx", "page", F.sha2("text", 256).alias("text_sha256"), "role")


@query("C14_figures")
def rebuilt_figures(t):
    _, homes, verdicts = B.rebuild_if_safe(*rebuild_inputs(t))
    return homes.join(verdicts, "book", "left").select("id", "book", "page", "chapter", "reason")


def sign_rows(t) -> DataFrame:
    """The lines of all documents' pages, some full of signs and some with a caption."""
    place, head = F.col("ord") % 15, F.left("text", F.lit(6))
    text = F.when(place.isin(5, 6), F.concat(F.lit("｛"), head, F.lit("｜｝"))).when(place == 7, F.concat(F.lit("图"), (F.col("ord") % 9).cast("string"), F.lit(" 说明"))).when(place == 8, F.concat(head, F.lit("＼｜〜"))).otherwise(F.col("text"))
    frags = F.when(F.col("ord") % 10 == 9, 3).otherwise(1)
    return t("han").select("book", "page", "ord", text.alias("text"), "x0", "x1", (F.col("y0") + 30).alias("y0"), (F.col("y0") + 30 + F.col("size")).alias("y1"), "size", frags.alias("n_frag"), F.when(frags == 3, 40.0).otherwise(0.0).alias("max_gap"))


@query("C20_figure_bands")
def bands(t):
    return U.figure_bands(sign_rows(t), WIDTH, HEIGHT)


@query("C21_page_texts")
def page_texts(t):
    """The paragraphs, notes and figures of every page, and what is to be looked at again."""
    got = U.pull_pages(sign_rows(t), WIDTH, HEIGHT, traditional="義務")
    notes = got.notes.select("book", "page", F.lit("note").alias("kind"), "n", "text")
    paragraphs = got.paragraphs.select("book", "page", F.when(F.col("figure"), "figure").otherwise("paragraph").alias("kind"), "n", "text")
    pages = got.pages.select("book", "page", F.lit("page").alias("kind"), F.lit(0).alias("n"), F.concat_ws(" ", F.col("chars").cast("string"), F.col("needs_vision").cast("string")).alias("text"))
    return paragraphs.unionByName(notes).unionByName(pages)


@query(
    "M07_ctc_text",
    """WITH s AS (SELECT vec_id, i, list_slice(embedding, i * 8 + 1, i * 8 + 8) AS step FROM embeddings, range(8) AS r(i)), b AS (SELECT vec_id, i, list_position(step, list_max(step)) - 1 AS k, CAST(list_max(step) AS DOUBLE) AS p FROM s),
    f AS (SELECT *, k <> 0 AND k <> coalesce(lag(k) OVER (PARTITION BY vec_id ORDER BY i), 0) AS new FROM b)
    SELECT vec_id, coalesce(string_agg(substr('abcdefg', CAST(k AS BIGINT), 1), '' ORDER BY i) FILTER (new), '') AS text, round(coalesce(avg(p) FILTER (new), 0), 6) AS confidence FROM f GROUP BY vec_id""",
)
def ctc_text(t):
    """Vectors as 8 steps by 8 classes."""
    said = t("embeddings").select("vec_id", G.ctc_decode(F.col("embedding"), 8, F.lit("abcdefg")).alias("v"))
    return said.select("vec_id", "v.text", F.round("v.confidence", 6).alias("confidence"))


@query("M07_boxes")
def boxes(t):
    """Vectors as maps of 8 by 8 cells."""
    cells = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.abs(x.cast("double")) * 4))
    return G.detected_boxes(t("embeddings").select(F.col("vec_id").alias("id"), cells.alias("cells")), 8, least=4)


@query(
    "R19_batch_states",
    """WITH RECURSIVE moves(was, command, now) AS (VALUES """
    + ", ".join(f"('{was}', '{command}', '{now}')" for (was, command), now in K.MOVES.items())
    + """), e AS (SELECT user_id % 20 AS book, user_id AS batch, event_id AS seq, CASE event_type WHEN 'view' THEN 'next' WHEN 'signup' THEN 'pass' WHEN 'purchase' THEN 'fail' WHEN 'error' THEN 'retry' ELSE 'reopen' END AS command,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT e.*, 'pending' AS before, coalesce(now, 'pending') AS after, now IS NOT NULL AS legal FROM e LEFT JOIN moves m ON m.was = 'pending' AND m.command = e.command WHERE n = 1
      UNION ALL SELECT e.*, r.after, coalesce(m.now, r.after), m.now IS NOT NULL FROM r JOIN e ON e.batch = r.batch AND e.n = r.n + 1 LEFT JOIN moves m ON m.was = r.after AND m.command = e.command)
    SELECT book, batch, seq, command, before, after, legal FROM r""",
)
def batch_states(t):
    """The events of a user as the commands for a batch."""
    names = F.coalesce(*[F.when(F.col("event_type") == kind, command) for kind, command in (("view", "next"), ("signup", "pass"), ("purchase", "fail"), ("error", "retry"))], F.lit("reopen"))
    return K.batch_states(t("events").select((F.col("user_id") % 20).alias("book"), F.col("user_id").alias("batch"), F.col("event_id").alias("seq"), names.alias("command")))


_RUN_SQL = """WITH s AS (SELECT c.id, c.book_id, c.idx, c.title, coalesce(min(CASE WHEN regexp_matches(c.title, '5$') THEN c.idx END) OVER (PARTITION BY c.book_id), 0) AS f, d.n_chars AS chars, d.lang FROM chapters c JOIN documents d ON d.doc_id = c.id),
    u AS (SELECT book_id AS book, id AS chapter, idx, phase, 0 AS unit, lang FROM s, (VALUES (0), (1)) AS p(phase) WHERE idx >= f AND NOT regexp_matches(title, '9$') AND chars >= 50),
    a AS (SELECT u.*, x.chapter_id IS NOT NULL AS there, CASE WHEN u.chapter % 31 <> 8 THEN u.chapter % 29 <> 7 END AS ok FROM u LEFT JOIN chapter_assets x ON x.chapter_id = u.chapter AND phase = 0 AND x.mindmap_tree = 'root'),
    m AS (SELECT *, min(CASE WHEN NOT there AND NOT coalesce(ok, false) THEN idx * 10 + phase END) OVER (PARTITION BY book) AS stop FROM a)
    SELECT book, chapter, phase, unit, CASE WHEN stop IS NULL OR idx * 10 + phase < stop THEN CASE WHEN there THEN 'cached' ELSE 'called' END WHEN idx * 10 + phase = stop AND ok IS NOT NULL THEN 'failed' ELSE 'waiting' END AS action FROM m"""


def analysis(t) -> DataFrame:
    from .structure import analysis_scope

    chapters = t("chapters").join(t("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("chars")), "id")
    scope = analysis_scope(chapters, "5$", "9$").select(F.col("book_id").alias("book"), F.col("id").alias("chapter"), "idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("phase"), F.lit(0).alias("unit"))
    units = scope.withColumns({"key": F.concat_ws("/", F.col("chapter").cast("string"), F.col("phase").cast("string")), "version": F.lit(1), "model": F.lit("root")})
    cache = t("chapter_assets").select(F.concat(F.col("chapter_id").cast("string"), F.lit("/0")).alias("key"), F.col("prompt_version").alias("version"), F.col("mindmap_tree").alias("model"))
    outcomes = scope.where("chapter % 31 <> 8").select("book", "chapter", "phase", "unit", (F.col("chapter") % 29 != 7).alias("ok"))
    return K.run_book(units, cache, outcomes)


@query("C29_run_book", _RUN_SQL)
def run_book(t):
    """Two phases of each chapter in scope; answers are there for some first ones, and some calls fail or were never made."""
    return analysis(t)


@query("C29_book_states", f"WITH q AS ({_RUN_SQL}), c AS (SELECT book, chapter, bool_and(action IN ('cached', 'called')) AS whole, count(*) FILTER (action IN ('called', 'failed')) AS calls FROM q GROUP BY 1, 2) SELECT book, CASE WHEN bool_and(whole) THEN 'Succeeded' ELSE 'Interrupted' END AS state, count(*) FILTER (whole) AS chapters_done, CAST(sum(calls) AS BIGINT) AS calls FROM c GROUP BY 1")
def book_states(t):
    return K.book_states(analysis(t))
