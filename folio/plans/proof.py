"""Proofreading and packed books over the lines in Chinese."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import kit as K
from ..operators import proofread as P
from ..operators import review as V
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


def on_han(name: str, column, sql: str | None) -> None:
    """A function of a line's text, as column v."""
    query(name, f"SELECT id, {sql} AS v FROM han" if sql else None)(lambda t: t("han").select("id", column(F.col("text")).alias("v")))


# shapes for the SQL, which has no look-around
_CJK, _HAN = r"[\x{3000}-\x{9FFF}\x{FF00}-\x{FFEF}]", r"[\x{4E00}-\x{9FFF}]"
_TRIMMED = r"regexp_replace(text, '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g')"
_HEADER = rf"(regexp_matches(text, '^[第笫][0-9\x{{4E00}}-\x{{9FFF}} ]*[0-9\x{{4E00}}-\x{{9FFF}}][ 0-9\x{{4E00}}-\x{{9FFF}}]*[章节篇回][0-9\x{{4E00}}-\x{{9FFF}} ]*$|^[第笫][0-9\x{{4E00}}-\x{{9FFF}} ]+[章节篇回]') AND regexp_matches(text, '({_HAN} *|{_HAN} +)[0-9]{{1,4}} *$'))"
_HEADER_NUMBER = rf"regexp_matches(text, '^[0-9]{{1,4}} ?{_HAN}{{2,12}}$')"
_LEADER, _HEADED = r"[…·.•‧．●]{2,}\s*[（(]?\d{1,4}[）)]?\s*$", r"^第[一二三四五六七八九十百千零〇两]+[章节目款回].{0,60}?[（(]?\d{1,4}[）)]?\s*$"
_CONTENTS = rf"(regexp_matches(text, '{_LEADER}') OR regexp_matches(text, '^(\d{{1,4}}|[（(]\d{{1,4}}[）)])$') OR regexp_matches(text, '{_HEADED}'))"
_NUMBER = r"regexp_matches(text, '^(\d{1,4}|[−\-–]\s*\d{1,4}\s*[−\-–]|[·•‧]\s*\d{1,4}\s*[·•‧]|第?\s*\d{1,4}\s*页|\d{1,3}\s*/\s*\d{1,3})$')"
_NOTED = rf"(regexp_matches(text, '^[\x{{2460}}-\x{{2473}}＠@]') OR regexp_matches(text, '^[0Oo心]{_HAN}') OR starts_with(text, '参见'))"
_FRONT = f"(text IN ('前言', '序言', '引言') OR regexp_matches(text, '{T.FRONT_FAMILY}'))"
_BACK = f"(text IN ('参考文献', '附录', '后记') OR regexp_matches(text, '{T.BACK_FAMILY}'))"
_TAILED = rf"regexp_matches(text, '{_HAN}\s*\d{{1,4}}\s*$')"
_LONG = "(length(text) > 24 OR regexp_matches(text, '[，,；;]'))"
_INLINE = f"regexp_matches(text, '第[{T.NUMERAL}]+[节讲]')"

on_han("F08_plain_yi", T.plain_yi, "translate(text, 'ꎬꎮꎻ', '，。；')")
on_han("F10_header_like", lambda c: T.header_like(c) | T.header_number_like(c), f"{_HEADER} OR {_HEADER_NUMBER}")
on_han("F12_contents_line", T.contents_line, _CONTENTS)
on_han("F13_page_number", T.page_number, _NUMBER)
on_han(
    "F14_title_style", T.title_style,
    rf"""CASE WHEN regexp_matches(text, '{T.TITLE_A_HAN}') THEN CASE WHEN {_TAILED} OR {_INLINE} OR {_LONG} THEN NULL ELSE 'A_HAN' END
    WHEN regexp_matches(text, '^(?i)(Chapter|Unit)\s+\d+') THEN CASE WHEN {_TAILED} THEN NULL ELSE 'A_LATIN' END
    WHEN text IN ('目录', '前言', '序言', '引言') OR {_FRONT} OR {_BACK} THEN 'A_FIXED' WHEN regexp_matches(text, '{T.TITLE_B}') THEN CASE WHEN {_TAILED} THEN NULL ELSE 'B' END
    WHEN regexp_matches(text, '{T.TITLE_C_HAN}') THEN 'C_HAN' WHEN regexp_matches(text, '{T.TITLE_C_PAREN}') THEN 'C_PAREN'
    WHEN regexp_matches(text, '{T.TITLE_C_NUM}') THEN 'C_NUM' WHEN regexp_matches(text, '{T.TITLE_C_NUM1}') THEN 'C_NUM1' END""",
)
on_han(
    "F17_front_and_back", lambda c: F.concat_ws(",", F.when(T.front_title(c), "front"), F.when(T.back_title(c), "back"), F.when(T.front_entry(c), "entry")),
    f"concat_ws(',', CASE WHEN {_FRONT} THEN 'front' END, CASE WHEN {_BACK} THEN 'back' END, CASE WHEN text <> '' AND length(text) <= 14 AND ({_FRONT} OR regexp_matches(text, '{T.EDITION_ENTRY}') OR "
    + " OR ".join(f"starts_with(text, '{w}')" for w in T.FRONT_ENTRIES) + ") THEN 'entry' END)",
)
on_han("F18_role", T.role_of, f"CASE WHEN text = '目录' THEN 'FRONT' WHEN {_BACK} THEN 'BACK' WHEN {_FRONT} THEN 'FRONT' ELSE 'BODY' END")
on_han("F28_contents_entry", lambda c: T.trimmed(c).rlike(T.CONTENTS_ENTRY), rf"regexp_matches({_TRIMMED}, '^第[一二三四五六七八九十百千0-9]+[章节回][^0-9]*\d+\s*$')")
on_han(
    "F35_fix_ocr", P.fix_ocr,
    rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '＠([。，；：、！？）】》]|$)', '\1', 'g'), '(^|[。；：！？])＠({_HAN})', '\1\2', 'g'),
    '(^|[。；：！？])(心([^理中情态灵得意愿证血脏智存怀思\x{{0}}-\x{{4DFF}}\x{{A000}}-\x{{10FFFF}}])|[卫卢竺]([^生星梭森法\x{{0}}-\x{{4DFF}}\x{{A000}}-\x{{10FFFF}}]))', '\1●\3\4', 'g'),
    '于千([0-9]|[^{P.THOUSAND_AFTER}\x{{0}}-\x{{4DFF}}\x{{A000}}-\x{{10FFFF}}])', '于\1', 'g'), '(^|[^{P.THOUSAND_BEFORE}])千([0-9A-Za-z，。；：、！？（）“”｀“＂"(《]|[^{P.THOUSAND_AFTER}\x{{0}}-\x{{4DFF}}\x{{A000}}-\x{{10FFFF}}])', '\1于\2', 'g')""",
)
on_han(
    "F36_fix_quotes", P.fix_quotes,
    "CASE WHEN length(text) - length(replace(text, '“', '')) < 2 THEN text ELSE array_to_string(list_transform(regexp_split_to_array(text, '[“”]'), lambda p, i: CASE WHEN i = 1 THEN p WHEN i % 2 = 0 THEN '“' || p ELSE '”' || p END), '') END",
)
_NOSPACE = r"regexp_replace(text, '[\s\x{3000}]+', '', 'g')"
on_han(
    "F43_title_kind", P.title_kind,
    rf"""CASE WHEN text = '' OR length(text) > 40 OR regexp_matches(text, '{P.CONTENTS_ROW}') THEN NULL WHEN regexp_matches(text, '{P.NUMBERED_TITLE}') THEN CASE WHEN regexp_matches(text, '[，,；;]') THEN NULL ELSE 'num' END
    WHEN regexp_matches(text, '[，,；;]|[。！？；，,;?!]$') THEN NULL
    WHEN regexp_matches(text, '{P.EDITION_FOREWORD}') OR regexp_matches({_NOSPACE}, '^({"|".join(P.FRONT_TITLES)})([：:．.、(（]|$)') OR {_NOSPACE} = '序' OR regexp_matches(text, '^序[：:]') THEN 'front'
    WHEN regexp_matches({_NOSPACE}, '^({"|".join(P.BACK_TITLES)})') OR regexp_matches(text, '^跋([：:]|$)') THEN 'back' WHEN regexp_matches(text, '{P.SECTION_TITLE}') THEN 'sec' END""",
)


@query(
    "P15_junk_paragraphs",
    rf"""WITH t AS (SELECT id, {_TRIMMED} AS t FROM han), s AS (SELECT id, t, len(regexp_extract_all(t, '[{P.JUNK}]')) AS junk FROM t WHERE length(t) BETWEEN 1 AND 40
    AND NOT regexp_matches(t, '{P.STRUCTURED}') AND NOT regexp_matches(t, '{P.CHAPTER_LINE}') AND NOT regexp_matches(t, '{P.SECTION_LINE}') AND NOT regexp_matches(t, '{P.SUB_LINE}'))
    SELECT id FROM s WHERE junk >= 2 OR (junk = 1 AND NOT regexp_matches(t, '[，。；！？：]'))""",
)
def junk(t):
    return t("han").where(P.junk_paragraph(F.col("text"))).select("id")


@query(
    "C03_clean_lines",
    rf"""WITH r AS (SELECT *, {_TRIMMED} AS raw FROM han), p AS (SELECT book, page, count(*) FILTER (regexp_matches(text, '{_LEADER}')) AS leaders, count(*) FILTER (regexp_matches(text, '{_HEADED}')) AS heads,
    count(*) FILTER (regexp_matches(text, '[…·.•‧．●]{{2,}}')) AS dots FROM han GROUP BY 1, 2), l AS (SELECT r.book, r.page, r.ord, r.y0, r.size, translate(raw, 'ꎬꎮꎻ', '，。；') AS text, leaders >= 3 OR heads >= 3 OR (dots >= 3 AND leaders >= 1) AS listed FROM r JOIN p ON p.book = r.book AND p.page = r.page)
    SELECT book, page, ord, CASE WHEN text = '' THEN 'blank' WHEN y0 BETWEEN 0 AND 60 AND length(text) <= 40 AND (size BETWEEN 0.1 AND 9.5 OR {_HEADER} OR {_HEADER_NUMBER}) THEN 'header' WHEN listed THEN 'contents'
    WHEN {_NUMBER} THEN 'number' WHEN y0 >= 360 AND (size BETWEEN 0.1 AND 8.5 OR {_NOTED}) THEN 'footnote' ELSE 'keep' END AS kind FROM l""",
)
def clean_lines(t):
    return D.classify_lines(t("han"), body=10.0, height=500.0)


_FIXED = (
    "regexp_replace(regexp_replace(f, '([。；：！？”）】》])[心卫卢竺专叩产令乃弓井]([^理中情态灵得意愿证血脏智存怀思生星梭森法业利家职项门题称注论判词求议编责成状案字氏国\\x{0}-\\x{4DFF}\\x{A000}-\\x{10FFFF}])', '\\1\\2', 'g'), "
    "'([。；：！？”）】》])[心卫卢竺专叩产令乃弓井]($|[\\s，。；：！？（）〔【])', '\\1\\2', 'g')"
)


@query(
    "C26_rules_page",
    rf"""WITH r AS (SELECT *, {_TRIMMED} AS t, regexp_matches({_TRIMMED}, '{P.STRUCTURED}') AS kept FROM han),
    j AS (SELECT *, len(regexp_extract_all(t, '[{P.JUNK}]')) AS junk, NOT kept AND length(t) BETWEEN 1 AND 40 AND NOT regexp_matches(t, '{P.CHAPTER_LINE}') AND NOT regexp_matches(t, '{P.SECTION_LINE}') AND NOT regexp_matches(t, '{P.SUB_LINE}') AS short FROM r),
    d AS (SELECT *, short AND (junk >= 2 OR (junk = 1 AND NOT regexp_matches(t, '[，。；！？：]'))) AS dropped FROM j),
    f0 AS (SELECT *, replace(replace(t, '知已知彼', '知己知彼'), '淮据', '准据') AS f1 FROM d),
    f2 AS (SELECT *, CASE WHEN regexp_matches(f1, '[(（]\s*[2-9一二三四五六七八九十]\s*[)）]|[2-9][.、．]') THEN regexp_replace(f1, '([(（])l([)）])', '\1' || '1' || '\2', 'g') ELSE f1 END AS g FROM f0),
    f3 AS (SELECT *, replace(g, '（IO', '（10') AS f FROM f2),
    w AS (SELECT *, {_FIXED} AS fixed FROM f3), p AS (SELECT book, page, count(*) FILTER (NOT kept) > 0 AND count(*) FILTER (NOT kept AND NOT dropped) = 0 AS empties, count(*) FILTER (dropped OR (NOT kept AND regexp_matches(fixed, '[{P.JUNK}]'))) > 0 AS junky FROM w GROUP BY 1, 2)
    SELECT w.book, w.page, ord, CASE WHEN kept OR empties THEN text ELSE fixed END AS text, empties OR junky AS flagged FROM w JOIN p ON p.book = w.book AND p.page = w.page WHERE empties OR NOT dropped""",
)
def rules(t):
    return P.rules_page(t("han"))


@query(
    "C23_contents",
    rf"""WITH p AS (SELECT book, page, bool_or(regexp_matches(text, '{P.CONTENTS_HEAD}')) AS head, count(*) FILTER (regexp_matches(text, '{P.CONTENTS_ROW}') AND NOT regexp_matches(text, '{P.CONTENTS_HEAD}')) AS hits, count(*) AS n FROM han GROUP BY 1, 2),
    f AS (SELECT book, min(page) AS first FROM p WHERE head GROUP BY 1), b AS (SELECT p.book, min(page) AS stop FROM p JOIN f ON f.book = p.book WHERE page > first AND NOT (hits >= 2 AND hits >= 0.4 * n) GROUP BY 1)
    SELECT h.book, h.page, h.ord, trim(regexp_extract(text, '{P.CONTENTS_ROW}', 1)) AS entry, CAST(regexp_extract(text, '{P.CONTENTS_ROW}', 2) AS INT) AS printed FROM han h JOIN f ON f.book = h.book LEFT JOIN b ON b.book = h.book
    WHERE h.page >= first AND (stop IS NULL OR h.page < stop) AND regexp_matches(text, '{P.CONTENTS_ROW}') AND NOT regexp_matches(text, '{P.CONTENTS_HEAD}')""",
)
def contents(t):
    return P.detect_contents(t("han"))


_KIND = ORACLES["F43_title_kind"][ORACLES["F43_title_kind"].index("CASE WHEN text = ''") : ORACLES["F43_title_kind"].rindex(" AS v FROM han")]


@query(
    "C24_scanned_chapters",
    rf"""WITH pg AS (SELECT book, page, bool_or(regexp_matches(text, '{P.CONTENTS_HEAD}')) AS head, count(*) FILTER (regexp_matches(text, '{P.CONTENTS_ROW}') AND NOT regexp_matches(text, '{P.CONTENTS_HEAD}')) AS hits, count(*) AS n, bool_or(length(regexp_replace(text, '\s', '', 'g')) >= 40) AS long FROM han GROUP BY 1, 2),
    f AS (SELECT book, min(page) AS first FROM pg WHERE head GROUP BY 1), b AS (SELECT pg.book, min(page) AS stop FROM pg JOIN f ON f.book = pg.book WHERE page > first AND NOT (hits >= 2 AND hits >= 0.4 * n) GROUP BY 1),
    toc AS (SELECT pg.book, pg.page FROM pg JOIN f ON f.book = pg.book LEFT JOIN b ON b.book = pg.book WHERE page >= first AND (stop IS NULL OR page < stop)),
    c AS (SELECT h.book, h.page, text AS title, min(ord) AS ord, {_KIND} AS kind FROM han h WHERE NOT EXISTS (SELECT 1 FROM toc WHERE toc.book = h.book AND toc.page = h.page) GROUP BY h.book, h.page, text),
    k AS (SELECT c.*, long, count(*) FILTER (kind = 'num') OVER (PARTITION BY c.book, c.page) AS nums FROM c JOIN pg ON pg.book = c.book AND pg.page = c.page WHERE kind IS NOT NULL),
    kept AS (SELECT *, min(CASE WHEN kind = 'num' THEN page END) OVER (PARTITION BY book) AS begins FROM k WHERE NOT (kind = 'num' AND nums >= 2) OR (NOT long AND regexp_matches(title, '{P.VOLUME}'))),
    u AS (SELECT book, title, page, CASE WHEN kind = 'sec' THEN 2 ELSE 1 END AS level, CASE WHEN kind IN ('num', 'sec') THEN 'BODY' WHEN kind = 'front' AND (begins IS NULL OR page < begins) THEN 'FRONT' ELSE 'BACK' END AS role, CASE WHEN kind = 'sec' THEN 2 ELSE 1 END AS turn, ord FROM kept
      UNION ALL SELECT book, '目录', min(page), 1, 'TOC', 0, 0 FROM toc GROUP BY book),
    o AS (SELECT * FROM u UNION ALL SELECT h.book, '开篇', 1, 1, 'FRONT', -1, 0 FROM (SELECT DISTINCT book FROM han) h LEFT JOIN (SELECT book, min(page) AS least FROM u GROUP BY 1) l ON l.book = h.book WHERE least IS NULL OR least > 1)
    SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY page, turn, ord, title) - 1 AS INT) AS n, title, page, level, role, left(title, 8) AS anchor FROM o""",
)
def scanned(t):
    return P.scan_chapters(t("han"))


@query("C25_reconciled")
def reconciled(t):
    facts = P.line_facts(t("han"))
    return P.reconcile(facts, P.scan_chapters(facts), P.detect_contents(facts))


def titles_of(t):
    """Contents entries and headings of each book, without marks and blanks."""
    facts = P.line_facts(t("han"))
    entries = P.detect_contents(facts).select("book", T.compared(F.col("entry")).alias("a"))
    return entries, P.scan_chapters(facts).select("book", T.compared(F.col("title")).alias("b"))


@query("J18_similar_titles")
def similar_titles(t):
    """The pairs of a contents entry and a heading of a book with a likeness of 0.7 or more."""
    pairs = D.similar_titles(*titles_of(t), 0.7)
    return pairs.select("book", "a", "b", F.round("ratio", 9).alias("ratio"))


@query("F20_contents_entries")
def entries(t):
    return P.contents_entries(t("han"))


@query(
    "F28_inferred_contents",
    rf"SELECT book, page, count(*) FILTER (regexp_matches({_TRIMMED}, '^第[一二三四五六七八九十百千0-9]+[章节回][^0-9]*\d+\s*$')) >= 3 AS listed FROM han GROUP BY 1, 2",
)
def inferred(t):
    """A page is one of contents by three lines with a heading's number at the beginning and a page's at the end."""
    return t("han").groupBy("book", "page").agg((F.count_if(T.trimmed(F.col("text")).rlike(T.CONTENTS_ENTRY)) >= 3).alias("listed"))


@query("F42_joined_lines")
def joined_lines(t):
    return P.join_lines(t("han"))


@query("F42_joined_notes", "WITH t AS (SELECT book, page, ord, trim(text) AS t FROM han WHERE trim(text) <> ''), n AS (SELECT *, sum(CASE WHEN regexp_matches(t, '^[\\x{2460}-\\x{2473}0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY book, page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS note FROM t) SELECT book, page, CAST(note AS BIGINT) AS note, string_agg(t, '' ORDER BY ord) AS text FROM n GROUP BY 1, 2, 3")
def joined_notes(t):
    return P.join_notes(t("han"))


@query(
    "F34_highlights",
    r"""WITH k AS (SELECT book AS chapter_id, min(id) AS id FROM han WHERE ord = 3 GROUP BY 1), h AS (SELECT k.chapter_id, regexp_replace(regexp_replace(substr(text, 1, 4), '[\s\x{3000}]+', '', 'g'), '^〔标题〕', '') AS key FROM k JOIN han ON han.id = k.id),
    p AS (SELECT book AS chapter_id, (page - 1) * 30 + ord AS idx, regexp_replace(regexp_replace(text, '[\s\x{3000}]+', '', 'g'), '^〔标题〕', '') AS t FROM han WHERE NOT starts_with(text, '〔脚注〕'))
    SELECT h.chapter_id, arg_min(idx, struct_pack(o := t <> key, s := CASE WHEN t <> key THEN length(t) ELSE 0 END, i := idx)) AS idx FROM h JOIN p ON p.chapter_id = h.chapter_id AND starts_with(t, key) WHERE key <> '' GROUP BY 1""",
)
def highlights(t):
    """The fourth line's beginning of each chapter, looked up among its paragraphs."""
    han = t("han")
    wanted = han.where("ord = 3").groupBy(F.col("book").alias("chapter_id")).agg(F.left(F.min_by("text", "id"), F.lit(4)).alias("highlight"))
    role = F.when(F.col("text").startswith("〔脚注〕"), "FOOTNOTE").otherwise("BODY")
    return P.find_highlight(han.select(F.col("book").alias("chapter_id"), ((F.col("page") - 1) * 30 + F.col("ord")).alias("idx"), "text", role.alias("role")), wanted)


@query(
    "X11_edits",
    r"""WITH e AS (SELECT book, page, min(ord) AS n, '总则' AS f, '通则' AS r FROM han GROUP BY 1, 2), c AS (SELECT book, page, sum((length(text) - length(replace(text, '总则', ''))) / 2) AS times FROM han GROUP BY 1, 2)
    SELECT h.book, h.page, h.ord, CASE WHEN times = 1 AND NOT regexp_matches(text, '^[\s\x{A0}\x{3000}]*〔(图|图版页|空白页|脚注|KIT|页)') THEN replace(text, '总则', '通则') ELSE text END AS text FROM han h JOIN c ON c.book = h.book AND c.page = h.page""",
)
def edits(t):
    """One edit for each page, applied where its text stands once, and one that is refused."""
    pages = t("han").select("book", "page").distinct()
    each = lambda n, find, replace: pages.select("book", "page", F.lit(n).alias("n"), F.lit(find).alias("find"), F.lit(replace).alias("replace"))
    return P.apply_edits(t("han"), each(1, "总则", "通则").unionByName(each(2, "民法", "民法典的全部条文")))


@query("C12_kit_chapters")
def kit(t):
    """Blocks of three lines, cut by the list of the headings among them; every fifth is of the second level."""
    han = t("han").withColumn("place", (F.col("page") - 1) * 30 + F.col("ord"))
    lines = han.select("book", F.floor(F.col("place") / 3).alias("block"), "page", "ord", "text")
    heads = han.where((F.col("place") % 17 == 0) & (F.col("text") != ""))
    level = F.when(F.floor(F.col("place") / 17) % 5 == 4, 2).otherwise(1)
    role = F.when(F.col("place") == 0, "FRONT").otherwise("BODY")
    chapters = heads.select("book", F.col("place").cast("int").alias("n"), F.col("text").alias("title"), "page", F.left("text", F.lit(8)).alias("anchor"), level.alias("level"), role.alias("role"))
    return K.kit_chapters(lines, chapters)


@query("D08_eta", "SELECT id, CAST(floor((500 - page_no) * (CASE WHEN attempts >= 3 THEN (attempts * 1000 + page_no) * 1.0 / attempts ELSE 1240.0 END) / 1000 + 0.5) AS INT) AS seconds FROM vision_queue")
def eta(t):
    done = F.col("attempts")
    return t("vision_queue").select("id", P.eta_seconds(F.lit(500), F.col("page_no"), done, done * 1000 + F.col("page_no")).alias("seconds"))


@query("M08_sample_size", "SELECT id, CASE WHEN y < 1 THEN 1 ELSE CAST(CASE WHEN floor(y) <= 100 AND floor(y * 1.5) <= 120 THEN 1 WHEN least(floor(floor(floor(y) / 2) / 100), floor(floor(floor(y * 1.5) / 2) / 120)) < 1 THEN 1 ELSE 2 ** (length(bin(CAST(least(floor(floor(floor(y) / 2) / 100), floor(floor(floor(y * 1.5) / 2) / 120)) AS BIGINT)))) END AS INT) END AS size FROM figures")
def sample(t):
    return t("figures").select("id", P.sample_size(F.floor("y"), F.floor(F.col("y") * 1.5), F.lit(100), F.lit(120)).alias("size"))


_FIXED_OCR = ORACLES["F35_fix_ocr"][ORACLES["F35_fix_ocr"].rindex("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text") : ORACLES["F35_fix_ocr"].rindex(" AS v FROM han")]
_FREE = f"NOT starts_with(text, '〔') AND NOT regexp_matches(text, '{P.CHAPTER_LINE}') AND NOT regexp_matches(text, '{P.SECTION_LINE}') AND NOT regexp_matches(text, '{P.SUB_LINE}')"


@query(
    "A14_page_scores",
    rf"""WITH g AS (SELECT book, page, string_agg(text, chr(10) ORDER BY ord) AS text, count(*) FILTER (length(text) >= 8 AND length(text) - length(replace(text, '“', '')) <> length(text) - length(replace(text, '”', ''))) AS quotes,
    count(*) FILTER (length(text) BETWEEN 1 AND 3 AND {_FREE}) AS short, count(*) FILTER (length(text) >= 15 AND {_FREE} AND NOT regexp_matches(text, '{P.CLOSES}')) AS open_ended FROM han GROUP BY 1, 2),
    f AS (SELECT *, {_FIXED_OCR} AS fixed FROM g), b AS (SELECT *, len(list_filter(list_zip(string_split(text, ''), string_split(fixed, ''), true), lambda x: x[1] <> x[2])) + len(regexp_extract_all(text, '{P.BAD_MARKS}')) AS bad FROM f)
    SELECT book, page, CAST(bad AS INT) AS bad, quotes, short, open_ended, CAST(2 * bad + quotes + 0.5 * short + 0.5 * open_ended AS DOUBLE) AS score FROM b""",
)
def page_scores(t):
    return P.page_scores(t("han"))


@query(
    "A15_gate_reasons",
    rf"""WITH p AS (SELECT book, page, CAST(floor((page - 1) / 3) AS INT) AS part, sum(length(regexp_replace(text, '\s', '', 'g'))) AS chars, sum(len(regexp_extract_all(regexp_replace(text, '\s', '', 'g'), '[{_HAN[1:-1]}A-Za-z0-9]'))) AS readable, bool_or(contains(text, chr(65533))) AS garbled FROM han GROUP BY 1, 2),
    b AS (SELECT book, part, count(*) AS n, sum(chars) AS chars, sum(readable) AS readable, bool_or(garbled) AS garbled, bool_or(page % 3 = 2) AS second FROM p GROUP BY 1, 2)
    SELECT book * 1000 + part AS batch, CASE WHEN book % 7 = 3 THEN 'repeated' WHEN book % 5 = 1 AND second THEN 'pages' WHEN garbled THEN 'garbled' WHEN chars < 100 * n THEN 'few' WHEN readable * 2 < greatest(chars, 1) THEN 'unreadable' END AS reason FROM b""",
)
def gates(t):
    """Batches of three pages with marks, some of them repeated or left out."""
    batch = (F.col("book") * 1000 + F.floor((F.col("page") - 1) / 3)).alias("batch")
    han = t("han")
    pages = han.select("book", "page").distinct()
    place = lambda c: (F.col("page") * 1000 + c).alias("ord")
    mark = F.concat(F.lit("〔页"), F.col("page").cast("string"), F.lit("〕")).alias("text")
    marks = pages.where("not (book % 5 = 1 and page % 3 = 2)").select(batch, place(F.lit(0)), mark).unionByName(pages.where("book % 7 = 3 and page % 3 = 1").select(batch, place(F.lit(900)), mark))
    lines = han.select(batch, place(F.col("ord") + 1), "text").unionByName(marks)
    return P.gate_reasons(lines, pages.groupBy(batch).agg(F.sort_array(F.collect_list("page")).alias("pages")))


@query(
    "P11_figure_rules",
    """WITH f AS (SELECT id, md5 AS key, page_no AS page, y % 50 AS x, y % 300 AS y, y % 620 AS w, (y * 7) % 850 AS h FROM figures), c AS (SELECT key, arg_min(struct_pack(x := x / 612.0, y := y / 792.0, w := w / 612.0), struct_pack(page := page, x := x, y := y)) AS first, count(DISTINCT page) AS pages FROM f GROUP BY 1),
    m AS (SELECT f.key, bool_and(abs(f.x / 612.0 - first.x) <= 0.02 AND abs(f.y / 792.0 - first.y) <= 0.02 AND abs(f.w / 612.0 - first.w) <= 0.02) AS mark FROM f JOIN c ON c.key = f.key WHERE pages >= 3 GROUP BY 1)
    SELECT id, CASE WHEN w * h / (612.0 * 792.0) >= 0.85 OR (w / 612.0 >= 0.9 AND h / 792.0 >= 0.9) THEN 'R1' WHEN w < 40 OR h < 40 OR w * h < 0.02 * 612.0 * 792.0 THEN 'R2' WHEN mark THEN 'R3' END AS reason FROM f LEFT JOIN m ON m.key = f.key""",
)
def figure_rules(t):
    f = t("figures").select("id", F.col("md5").alias("key"), F.col("page_no").alias("page"), (F.col("y") % 50).alias("x"), (F.col("y") % 300).alias("y"), (F.col("y") % 620).alias("w"), (F.col("y") * 7 % 850).alias("h"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"))
    return V.figure_rules(f).select("id", "reason")
