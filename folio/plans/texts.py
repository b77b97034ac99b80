"""Text functions and documents' structure (F, X, C, R, IO), over the study tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import parsing as J
from ..functions import scheduling as S
from ..functions import text as T
from ..operators import documents as D
from ..sources.roles import oracle, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def on_paragraphs(name: str, column, sql: str | None) -> None:
    """A function of a paragraph's text, as column v."""
    query(name, f"SELECT id, {sql} AS v FROM paragraphs" if sql else None)(lambda t: t("paragraphs").select("id", column(F.col("text")).alias("v")))


_TRIM = r"regexp_replace(text, '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g')"
on_paragraphs("F01_escape_like", T.escape_like, r"'%' || replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_') || '%'")
on_paragraphs("F06_ends_sentence", T.ends_sentence, r"regexp_matches(rtrim(text), '[。！？；：！?:…”』」\x{2460}-\x{2473}]$') OR regexp_matches(rtrim(text), '[\x{3000}-\x{9FFF}\x{FF00}-\x{FFEF}][0-9]$') OR regexp_matches(rtrim(text), '[\[〔]\d{1,3}[\]〕]$')")
on_paragraphs("F07_strip_control", T.strip_control, r"regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g')")
on_paragraphs("F09_private_use", T.private_use, r"CAST(len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}]')) AS INT)")
on_paragraphs("F11_footnote_lead", lambda c: T.footnote_marked(c) | T.footnote_lead(c), r"regexp_matches(text, '^[\x{2460}-\x{2473}@]') OR regexp_matches(text, '^[0Oo][\x{4E00}-\x{9FFF}]') OR (length(text) >= 6 AND (regexp_matches(right(text, 12), '[（(]\d{4}[）)]?\s*[.。]?\s*$') OR (length(text) >= 16 AND len(regexp_extract_all(text, '[A-Za-z0-9]')) * 2 >= length(text))))")
on_paragraphs("F16_title_candidate", T.title_candidate, r"length(text) > 0 AND length(text) <= 40 AND NOT regexp_matches(right(text, 1), '[。？！，、；,.?!;]') AND NOT regexp_matches(text, '[…·.•‧．●]{2,}\s*[（(]?\d{1,4}[）)]?\s*$')")
on_paragraphs("F22_normal_title", T.normal_title, None)
on_paragraphs("F23_clean_title", T.clean_title, "regexp_replace(regexp_replace(text, '[…·.•‧]{2,}.*$', ''), '^[\\s\\x{A0}\\x{3000}]+|[\\s\\x{A0}\\x{3000}]+$', '', 'g')")
on_paragraphs("F27_split_glued", lambda c: F.size(T.split_glued(c)), None)
on_paragraphs("F29_half_width", T.half_width, "translate(text, '，（）：；', ',():;')")
on_paragraphs("F30_strip_citations", T.strip_citations, None)
on_paragraphs("F31_strip_refs", lambda c: T.strip_refs(F.concat(c, F.lit("〔p1〕〔p2〕")), F.array(F.lit(1))), "text || '〔p1〕'")
on_paragraphs("F32_classify_sample", T.classify_sample, "CASE WHEN length(text) <= 200 THEN text ELSE left(text, 150) || '…' || right(text, 50) END")
on_paragraphs("F33_sentences", lambda c: F.size(T.sentences(c)), None)
on_paragraphs("F37_fix_list", lambda c: T.fix_latin_digits(T.fix_list_l(c)), None)
on_paragraphs("F38_running_norm", T.running_norm, r"regexp_replace(text, '[\s\d０-９]+', '', 'g')")
on_paragraphs("F39_compared", T.compared, r"""regexp_replace(text, '[\s，。、；：？！「」『』（）〔〕《》”“‘’"''—…·．.，,;:!?()\-－—]', '', 'g')""")
on_paragraphs("F46_book_key", T.book_key, None)
on_paragraphs("IO02_garbled_ratio", lambda c: (F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))) / F.greatest(F.length(c), F.lit(1)), "CAST(length(text) - length(replace(text, chr(65533), '')) AS DOUBLE) / greatest(length(text), 1)")


@query("F05_soft_join")
def soft_join(t):
    lines = t("paragraphs").groupBy("chapter_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]).alias("lines"))
    return lines.select("chapter_id", F.length(T.soft_join("lines")).alias("joined"), F.length(T.soft_merge(F.col("lines"))).alias("merged"))


@query("F41_merge_candidates")
def merge_candidates(t):
    following = F.lead("text").over(W.partitionBy("book").orderBy("page", "ord"))
    return t("page_lines").withColumn("b", following).where("b is not null").select("book", "page", "ord", T.merge_candidate(F.col("text"), F.col("b")).alias("merges"))


@query("F44_numerals", "SELECT id, CAST(idx % 1000 AS INT) AS n FROM chapters")
def numerals(t):
    """Ordinals written in Chinese numerals, read back."""
    digit = lambda n: F.element_at(F.array(*[F.lit(x) for x in "一二三四五六七八九"]), n.cast("int"))
    n = F.col("idx") % 1000  # the numerals go to the hundreds
    hundred = F.when(n >= 100, F.concat(digit(F.floor(n / 100)), F.lit("百"))).otherwise("")
    rest = n % 100
    ten = F.when(rest >= 10, F.concat(F.when(rest >= 20, digit(F.floor(rest / 10))).otherwise(F.when(n >= 100, "一").otherwise("")), F.lit("十"))).otherwise(F.when((n >= 100) & (rest > 0), "零").otherwise(""))
    one = F.when(rest % 10 > 0, digit(rest % 10)).otherwise(F.when(n == 0, "零").otherwise(""))
    return t("chapters").select("id", T.zh_to_int(F.concat(hundred, ten, one)).alias("n"))


@query("F40_title_similarity")
def similarity(t):
    """The benchmark item most like each chapter by their titles, the first sentences of both."""
    title = lambda c: F.regexp_extract(c, r"^([^.\n]*)", 1)
    items = t("benchmark").select(F.col("item_id").alias("entry"), title(F.col("text")).alias("title"))
    return D.most_similar(t("paragraphs").where("idx = 0").select(F.col("chapter_id").alias("id"), title(F.col("text")).alias("text")), items)


# --- parsing


@query("X02_lenient_int", "SELECT event_id, coalesce(CAST(trunc(TRY_CAST(CASE event_id % 3 WHEN 0 THEN CAST(floor(value) AS BIGINT)::VARCHAR || '.0' WHEN 1 THEN (event_id % 50)::VARCHAR ELSE 'x' END AS DOUBLE)) AS INT), -1) AS n FROM events")
def lenient(t):
    raw = F.when(F.expr("event_id % 3 = 0"), F.concat(F.floor("value").cast("string"), F.lit(".0"))).when(F.expr("event_id % 3 = 1"), F.expr("cast(event_id % 50 as string)")).otherwise("x")
    return t("events").select("event_id", J.lenient_int(raw).alias("n"))


@query("X04_quiz_decode", "SELECT chapter_id, 3 AS questions, 'one|two|three' AS texts, 'RECALL|APPLY|RECALL' AS kinds FROM chapter_assets")
def quiz_decode(t):
    quiz = J.decode_quiz(F.col("quiz_json"))
    return t("chapter_assets").select("chapter_id", F.size(quiz).alias("questions"), F.array_join(quiz["q"], "|").alias("texts"), F.array_join(quiz["type"], "|").alias("kinds"))


@query(
    "X06_book_terms",
    "WITH x AS (SELECT id, book_id, idx, json_extract_string(key_terms_json, '$[0].term') AS term, json_extract_string(key_terms_json, '$[0].plain') AS plain FROM chapters WHERE key_terms_json <> '') SELECT book_id, id AS chapter, term, plain FROM x QUALIFY row_number() OVER (PARTITION BY book_id, regexp_replace(term, '\\s', '', 'g') ORDER BY idx) = 1",
)
def book_terms(t):
    return J.first_terms(t("chapters"))


@query("X07_tagged", r"SELECT id, text AS gist FROM paragraphs WHERE text <> '' AND NOT regexp_matches(text, '^\s|\s$')")
def tagged(t):
    raw = F.concat(F.lit("noise <gist> "), F.col("text"), F.lit(" </gist> tail"))
    return t("paragraphs").where((F.col("text") != "") & ~F.col("text").rlike(r"^\s|\s$")).select("id", J.tag(raw, "gist").alias("gist"))


@query(
    "X09_tree_rows",
    r"""WITH l AS (SELECT chapter_id, idx, repeat(chr(9), CAST(idx * 7 % 4 AS INT)) || text AS line FROM paragraphs), n AS (SELECT chapter_id, idx, regexp_extract(line, '^([\t ]*)', 1) AS i, regexp_replace(line, '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g') AS t FROM l),
    d AS (SELECT chapter_id, idx, CAST(CASE WHEN contains(i, chr(9)) THEN length(i) - length(replace(i, chr(9), '')) ELSE floor(length(i) / 4) END AS INT) AS depth, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^[\-•·*]\s+', ''), '^#{1,6}\s*', ''), '^\*+|\*+$', '', 'g'), '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g') AS topic FROM n)
    SELECT a.chapter_id, a.idx, a.topic, a.depth, max(b.idx) AS parent FROM d a LEFT JOIN d b ON b.chapter_id = a.chapter_id AND b.idx < a.idx AND b.depth < a.depth AND b.topic <> '' WHERE a.topic <> '' GROUP BY 1, 2, 3, 4""",
)
def tree_rows(t):
    """Lines as an indented tree: each node with its depth and parent."""
    indented = t("paragraphs").select("chapter_id", "idx", F.concat(F.repeat(F.lit("\t"), (F.col("idx") * 7 % 4).cast("int")), F.col("text")).alias("line"))
    return J.tree_parents(indented, "chapter_id", "idx", "line")


@query("X12_budget_tier", "SELECT id, CASE WHEN length(text) <= 300 THEN text WHEN length(left(text, 280) || '…') <= 300 THEN left(text, 280) || '…' ELSE left(text, 100) END AS v FROM paragraphs")
def budget(t):
    c = F.col("text")
    return t("paragraphs").select("id", J.first_within([c, F.concat(F.left(c, F.lit(280)), F.lit("…")), F.left(c, F.lit(100))], 300).alias("v"))


@query("X14_last_turns", "SELECT book_id, count(*) AS turns, max(id) AS newest FROM (SELECT * FROM qa_history QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY id DESC) <= 10) GROUP BY 1")
def last_turns(t):
    return J.last_messages(t("qa_history"), "book_id", "id", 10).select("book_id", F.size("messages").alias("turns"), F.element_at("messages", -1)["id"].alias("newest"))


@query("X15_prompt_texts", "SELECT chapter_id, idx, CAST(least(length(text), 200, greatest(0, 800 - coalesce(before, 0))) AS INT) AS n FROM (SELECT *, sum(least(length(text), 200)) OVER (PARTITION BY chapter_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM paragraphs) WHERE coalesce(before, 0) < 800")
def prompt_texts(t):
    return J.texts_within(t("paragraphs"), "chapter_id", "idx", each=200, total=800).select("chapter_id", "idx", F.length("part").alias("n"))


# --- documents


@query("C01_rows_of_spans", "WITH g AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY book, page ORDER BY y0, ord) AS gap FROM page_lines), v AS (SELECT *, sum(CASE WHEN gap > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY book, page ORDER BY y0, ord ROWS UNBOUNDED PRECEDING) AS r FROM g) SELECT book, page, min(y0) AS y0, min(x0) AS x0, max(x1) AS x1, count(*) AS spans FROM v GROUP BY book, page, r")
def rows_of_spans(t):
    return D.visual_rows(t("page_lines"), tolerance=15).select("book", "page", "y0", "x0", "x1", "spans")


@query("C04_paragraphs")
def assemble(t):
    return D.paragraphs(t("page_lines"), left=50.0, right=400.0, body=10.0, pitch=18.0)


@query("C07_chapters")
def chapters(t):
    return D.chapters(t("paragraphs").select(F.col("chapter_id").alias("book"), "idx", "text"), custom="^[A-Z][a-z]+ly ")


@query("C08_blind_chapters")
def blind(t):
    return D.blind_chapters(t("paragraphs"), "chapter_id", "idx")


@query("C09_chunks")
def chunks(t):
    return D.greedy_blocks(t("paragraphs"), "chapter_id", "idx", most_chars=2000, most_items=15)


@query("C27_review")
def review(t):
    """Every card rated by its item's last log row: new state and next interval."""
    last = t("review_log").groupBy("item_id").agg(F.max_by("rating", "id").alias("rating"))
    cards = t("review_items").join(last, F.col("id") == F.col("item_id"))
    return S.review(cards, F.lit(850_000_000_000)).select("id", "rating", "stability", "difficulty", "interval_days")


@query("T04_risk_order")
def risk(t):
    return t("review_items").where("NOT done").withColumn("r", F.round(S.retrievability(F.col("fsrs_stability"), F.col("last_review_at"), F.lit(850_000_000_000)), 9)).orderBy("r", "due_at", "id").select("id", "r")


@query("T10_capped_lists", "WITH r AS (SELECT book_id, title, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS k FROM chapters) SELECT book_id, string_agg(left(title, 9), '|' ORDER BY k) AS titles FROM r WHERE k <= 5 GROUP BY 1")
def capped(t):
    """At most five titles of a book, each of at most nine characters: rows are capped before they are gathered."""
    nth = F.row_number().over(W.partitionBy("book_id").orderBy("idx"))
    first = t("chapters").withColumn("k", nth).where("k <= 5").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("k", F.left("title", F.lit(9)).alias("t")))).alias("l"))
    return first.select("book_id", F.array_join(F.transform("l", lambda x: x["t"]), "|").alias("titles"))


@query("C28_wrong_rows", "SELECT q.id, q.chapter_id, CASE q_index WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three' END AS question, answer FROM (SELECT * FROM quiz_attempts QUALIFY row_number() OVER (PARTITION BY chapter_id, q_index ORDER BY created_at DESC, id DESC) = 1) q JOIN chapter_assets a ON a.chapter_id = q.chapter_id WHERE verdict = 'WRONG'")
def wrong_rows(t):
    from .study import latest_attempts

    wrong = latest_attempts(t("quiz_attempts")).where("verdict = 'WRONG'")
    assets = t("chapter_assets").select("chapter_id", J.decode_quiz(F.col("quiz_json")).alias("quiz"))
    return wrong.join(assets, "chapter_id").select("id", "chapter_id", F.get("quiz", F.col("q_index"))["q"].alias("question"), "answer")


@query("C22_stitched_pages")
def stitched(t):
    """Pages with their text as it is written back: paragraphs apart by an empty line, or the mark of a blank page."""
    pages = t("page_lines").groupBy("book", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: T.trimmed(s["text"])).alias("paras"))
    body = F.when(F.col("paras") == 0, "〔空白页〕").otherwise(F.array_join("texts", "\n\n"))
    return D.stitched(pages).select("book", "page", "paras", "chars", "tail", "head", body.alias("body"))


@query(
    "C17_merged_fragments",
    "WITH s AS (SELECT book, page, ord, y0 FROM page_lines WHERE length(text) < 8), b AS (SELECT book, page, ord, y0 FROM page_lines WHERE length(text) >= 8), n AS (SELECT s.book, s.page, s.ord, arg_min(b.ord, struct_pack(d := abs(s.y0 - b.y0), o := b.ord)) AS target FROM s JOIN b ON b.book = s.book AND b.page = s.page AND abs(s.y0 - b.y0) <= 15 GROUP BY 1, 2, 3) SELECT l.book, l.page, l.ord, coalesce(target, l.ord) AS \"into\" FROM page_lines l LEFT JOIN n ON n.book = l.book AND n.page = l.page AND n.ord = l.ord",
)
def fragments(t):
    return D.merge_fragments(t("page_lines"))


@query("J17_banded_match")
def banded(t):
    at = lambda by: F.expr(f"cast(idx * {by} % 60 as int)")
    c = t("chapters")
    entries = c.where("idx % 3 = 2").select("book_id", F.col("id").alias("entry"), at(3).alias("page"))
    return D.match_in_band(entries, c.where("idx % 3 <> 2").select("book_id", F.col("id").alias("chapter"), at(7).alias("start")), band=5)


@query("C11_offset_anchors", "WITH a AS (SELECT book_id, start_page - idx AS d, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY book_id) AS n FROM chapters WHERE start_page IS NOT NULL), s AS (SELECT book_id, count(*) AS c, median(d) AS mid, avg(d) AS mean, max(d) - min(d) AS spread FROM a WHERE k = 1 OR k = floor(n / 2) + 1 OR k = n GROUP BY 1) SELECT book_id, CASE WHEN c = 3 AND spread <= 1 THEN CAST(floor(mid) AS INT) WHEN c = 2 THEN CAST(floor(mean + 0.5) AS INT) END AS page_offset, c = 3 AND spread <= 1 AS sure FROM s")
def offsets(t):
    return D.offset_of_anchors(t("chapters").where("start_page is not null"))


@query("R02_figure_numbers", "SELECT id, row_number() OVER (PARTITION BY book_id ORDER BY page_no, ord_after_para, y, id) AS number FROM figures")
def figure_numbers(t):
    return t("figures").select("id", F.row_number().over(W.partitionBy("book_id").orderBy("page_no", "ord_after_para", "y", "id")).alias("number"))


@query("R01_figure_rules", "WITH k AS (SELECT md5 FROM figures GROUP BY md5 HAVING count(DISTINCT page_no) >= 3), c AS (SELECT CASE WHEN y > 1500 THEN 'R1' WHEN y < 950 THEN 'R2' WHEN md5 IN (SELECT md5 FROM k) THEN 'R3' ELSE 'kept' END AS reason FROM figures) SELECT reason, count(*) AS n FROM c GROUP BY 1")
def figure_rules(t):
    repeated = t("figures").groupBy("md5").agg((F.countDistinct("page_no") >= 3).alias("often"))
    reason = F.when(F.col("y") > 1500, "R1").when(F.col("y") < 950, "R2").when(F.col("often"), "R3").otherwise("kept")
    return t("figures").join(repeated, "md5").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("R11_sentence_to_paragraph", "WITH c AS (SELECT chapter_id, idx, sum(length(text)) OVER (PARTITION BY chapter_id ORDER BY idx) AS upto FROM paragraphs) SELECT chapter_id, min(idx) AS idx FROM c WHERE upto > 500 GROUP BY 1")
def sentence_place(t):
    """The paragraph that holds the 500th unit of a chapter: a running sum, then the first above it."""
    upto = F.sum(F.length("text")).over(W.partitionBy("chapter_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    return t("paragraphs").withColumn("upto", upto).where("upto > 500").groupBy("chapter_id").agg(F.min("idx").alias("idx"))


@query("R12_previous_tail", "SELECT book, page, lag(tail) OVER (PARTITION BY book ORDER BY page) AS tail FROM (SELECT book, page, right(max_by(text, ord), 60) AS tail FROM page_lines GROUP BY 1, 2)")
def previous_tail(t):
    tails = t("page_lines").groupBy("book", "page").agg(F.right(F.max_by("text", "ord"), F.lit(60)).alias("tail"))
    return tails.select("book", "page", F.lag("tail").over(W.partitionBy("book").orderBy("page")).alias("tail"))


@query("R17_todo_pages", "SELECT id FROM vision_queue v WHERE status = 'DONE' AND NOT EXISTS (SELECT 1 FROM figures f WHERE f.book_id = v.book_id AND f.page_no = v.page_no)")
def todo_pages(t):
    return t("vision_queue").where("status = 'DONE'").join(t("figures").select("book_id", "page_no").distinct(), ["book_id", "page_no"], "left_anti").select("id")


@query("R20_first_failed_gate", "WITH g AS (SELECT book_id, count(*) FILTER (status = 'FAILED') AS f, count(*) FILTER (status = 'PENDING') AS p FROM vision_queue GROUP BY 1) SELECT book_id, CASE WHEN f > 100 THEN 'qa' WHEN p > 500 THEN 'pages' ELSE 'done' END AS gate FROM g")
def first_gate(t):
    g = t("vision_queue").groupBy("book_id").agg(F.count_if(F.col("status") == "FAILED").alias("f"), F.count_if(F.col("status") == "PENDING").alias("p"))
    return g.select("book_id", F.when(F.col("f") > 100, "qa").when(F.col("p") > 500, "pages").otherwise("done").alias("gate"))


# --- sources and sinks


@query("IO10_references", "SELECT 'books key' AS rule, 0 AS bad UNION ALL SELECT 'chapters.book_id', (SELECT count(*) FROM chapters WHERE book_id NOT IN (SELECT id FROM books)) UNION ALL SELECT 'bookmarks.chapter_id', (SELECT count(*) FROM bookmarks WHERE chapter_id NOT IN (SELECT id FROM chapters))")
def references(t):
    from ..operators.relational import violations

    tables = {n: t(n) for n in ("books", "chapters", "bookmarks")}
    return violations(tables, {"books": ["id"]}, [("chapters", "book_id", "books", "id"), ("bookmarks", "chapter_id", "chapters", "id")])


@query("IO11_import_order", "SELECT id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY idx) - 1 AS INT) AS idx FROM paragraphs WHERE text <> ''")
def import_order(t):
    return t("paragraphs").where("text <> ''").select("id", (F.row_number().over(W.partitionBy("chapter_id").orderBy("idx")) - 1).alias("idx"))


@query("IO13_figure_dedupe", "SELECT id FROM figures QUALIFY row_number() OVER (PARTITION BY book_id, md5, page_no, ord_after_para ORDER BY id) = 1")
def figure_dedupe(t):
    from ..operators.relational import newest_of_each

    return newest_of_each(t("figures"), ["book_id", "md5", "page_no", "ord_after_para"], [F.col("id")]).select("id")


@query("IO14_packed_text", "SELECT book, string_agg('〔页' || page || '〕' || chr(10) || body, chr(10) ORDER BY page) AS packed FROM (SELECT book, page, string_agg(text, chr(10) ORDER BY ord) AS body FROM page_lines GROUP BY 1, 2) GROUP BY 1")
def packed_text(t):
    return D.pack_text(t("page_lines"))


@query("IO16_split_pages", "SELECT book, page, count(*) AS n FROM page_lines WHERE trim(text) <> '' GROUP BY 1, 2")
def split_pages(t):
    """The packed text parted into its pages again."""
    return D.unpack_text(D.pack_text(t("page_lines"))).groupBy("book", "page").agg(F.count("*").alias("n"))


@query("IO21_batches", "SELECT book, CAST(floor((page - 1) / 3) AS BIGINT) AS batch, count(DISTINCT page) AS pages FROM page_lines GROUP BY 1, 2")
def batches(t):
    return t("page_lines").groupBy("book", F.floor((F.col("page") - 1) / 3).alias("batch")).agg(F.countDistinct("page").alias("pages"))


@query("IO22_page_ranges", "SELECT DISTINCT n AS page FROM (SELECT unnest([1, 2, 3, 7, 5, 6, 7]) AS n) ORDER BY 1")
def page_ranges(t):
    return D.page_ranges(t("settings").limit(1).select(F.lit("1-3,7,5-7").alias("pages")), "pages", 1, 100).distinct()


@query("ST05_queue_fold", "SELECT chapter_id, CASE WHEN max(CASE WHEN verdict = 'RIGHT' THEN 1 ELSE 0 END) = 1 THEN 'DONE' WHEN count(*) FILTER (verdict = 'WRONG') >= 3 THEN 'FAILED' ELSE 'PENDING' END AS state FROM quiz_attempts GROUP BY 1")
def queue_fold(t):
    """A work queue's state from its events: done once it succeeded, failed after three failures."""
    return t("quiz_attempts").groupBy("chapter_id").agg(F.when(F.bool_or(F.col("verdict") == "RIGHT"), "DONE").when(F.count_if(F.col("verdict") == "WRONG") >= 3, "FAILED").otherwise("PENDING").alias("state"))


@query("ST08_replay")
def replay(t):
    """Every card's log replayed in order."""
    return S.replay(t("review_log"), "item_id", "id", "rating", "reviewed_at")
