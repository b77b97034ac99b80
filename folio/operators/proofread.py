"""Proofreading of recognised pages: repairs as column expressions, rules by page, edits of a reply, contents pages.

Lines lie in tables (book, page, ord, text). What a rule needs of a page comes from windows over its lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..cluster import written
from ..functions import text as T
from .documents import similar_titles
from .temporal import asof_join, islands

# Shapes of lines, confused characters and their words, junk, and words that titles consist of.
STRUCTURED = "^〔(图|图版页|空白页|脚注|KIT|页)"
CHAPTER_LINE = r"^[第笫]\s*[0-9〇零一二三四五六七八九十百千]+\s*[章编部篇次]"
SECTION_LINE = r"^([第笫]\s*[0-9〇零一二三四五六七八九十百千]+\s*[节讲款]|[一二三四五六七八九十]+\s*、)"
SUB_LINE = r"^(?:[一二三四五六七八九十]+、|[（(][一二三四五六七八九十0-9]+[）)])"
JUNK = "勹＄竺叩＼｜｀〜｛｝�卩〓"
NOTE_TAIL = "心卫卢竺专叩产令乃弓井"
NOTE_TAIL_WORDS = "理中情态灵得意愿证血脏智存怀思生星梭森法业利家职项门题称注论判词求议编责成状案字氏梭理国"
CONFUSED = {"淮确": "准确", "淮的": "准的", "淮据": "准据", "淮此": "准此", "淮绳": "准绳", "淮时": "准时", "淮于": "准于"}
THOUSAND_BEFORE = "0123456789〇零一二三四五六七八九十百千万亿两几数成上若"
THOUSAND_AFTER = (
    "年月日万字百十人古秋金克米瓦佛岛山仞钧载禧里军马言语丝缕篇律姿态奇怪家户呼唤恩谢叮嘱疮孔锤炼难险水落乘门生"
    "元圆倍余块吨亩顷尺寸丈套辆架艘匹只棵株座层间页张片场次遍回件名句计般变差奇真辛方丝头态状岁夜"
)
NUMBERED_TITLE = r"^第\s*([0-9〇零一二三四五六七八九十百千]+)\s*[章编部篇卷回次]"
EDITION_FOREWORD = r"^第\s*[0-9〇零一二三四五六七八九十]+\s*版序"
FRONT_TITLES = [
    "前言", "序言", "自序", "再版序", "初版序", "重排版序", "增订版序", "修订版序", "总序", "译序", "代序", "导读", "引言", "导论", "导言", "写在前面", "绪论", "开场白", "凡例", "作者简介", "出版说明", "编译说明",
]
BACK_TITLES = ["结语", "结论", "结束语", "后记", "再版后记", "译后记", "附录", "参考文献", "参考书目", "主要参考书目", "条文索引", "法规索引", "致谢", "谢辞", "索引", "大事记", "年表"]
CONTENTS_HEAD = r"(?i)^(目\s*录|目\s*次|简\s*目|要\s*目|总\s*目|contents)\s*$"
CONTENTS_ROW = r"^(.{2,60}?)[\s.·•…\-—]*?[(（]?(\d{1,4})[)）]?\s*$"
SECTION_TITLE = r"^第\s*[0-9〇零一二三四五六七八九十百千]+\s*[节讲]"
VOLUME = r"^第\s*[0-9〇零一二三四五六七八九十百千]+\s*编"
FORBIDDEN = ["〔页", "〔图", "〔FIGURES", "〔脚注", "〔KIT", "http", "\n", "【", "〕"]
CLOSED = "[。；：！？”）】》]"


def structured(c: Column) -> Column:
    return T.trimmed(c).rlike(STRUCTURED)


def _heading(c: Column) -> Column:
    return c.rlike(CHAPTER_LINE) | c.rlike(SECTION_LINE) | c.rlike(SUB_LINE)


def junk_paragraph(c: Column, more: str = "") -> Column:
    """A short piece with junk and no punctuation, or with two junk characters; `more` adds to the junk."""
    t, junk = T.trimmed(c), f"[{JUNK}{more}]"
    short = F.length(t).between(1, 40) & ~t.rlike(STRUCTURED) & ~_heading(t)
    return short & ((t.rlike(junk) & ~t.rlike("[，。；！？：]")) | (F.regexp_count(t, F.lit(junk)) >= 2))


def fix_confused(c: Column) -> Column:
    """words that recognition confuses."""
    c = F.replace(c, F.lit("知已知彼"), F.lit("知己知彼"))
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), CONFUSED.items(), c)


def fix_note_tail(c: Column) -> Column:
    """a misread note number after a closed sentence goes, unless it begins a word."""
    c = F.regexp_replace(c, f"(?<={CLOSED})[{NOTE_TAIL}](?=[一-鿿])(?![{NOTE_TAIL_WORDS}])", "")
    return F.regexp_replace(c, rf"(?<={CLOSED})[{NOTE_TAIL}](?=$|[\s，。；：！？（）〔【])", "")


def fix_ocr(c: Column) -> Column:
    """raised note marks and list marks that were misread, and the 千 that stands for 于."""
    c = F.regexp_replace(c, "＠(?=[。，；：、！？）】》]|$)", "")
    # each pattern begins with the character it is about; what stands before is looked at only there
    c = F.regexp_replace(c, "＠(?=[一-鿿])(?<=^＠|[。；：！？]＠)", "")
    c = F.regexp_replace(c, r"[心卫卢竺](?=[一-鿿])(?<=^[心卫卢竺]|[。；：！？\n][心卫卢竺])(?:(?<=心)(?![理中情态灵得意愿证血脏智存怀思])|(?<!心)(?![生星梭森法]))", "●")
    c = F.regexp_replace(c, f"千(?<=于千)(?![{THOUSAND_AFTER}])(?=[一-鿿0-9])", "")
    return F.regexp_replace(c, f"千(?<![{THOUSAND_BEFORE}]千)(?![{THOUSAND_AFTER}])(?=[一-鿿0-9A-Za-z，。；：、！？（）“”｀“＂'\"（《])", "于")


def fix_quotes(c: Column) -> Column:
    """of two and more opening or closing quotes, every other one opens; no blanks inside them."""

    def alternate(text: Column, mark: str) -> Column:
        parts = F.split(text, mark, -1)
        return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(i % 2 == 1, "“").otherwise("”"), p))), "")

    def plain(c: Column) -> Column:
        grave = F.replace(F.replace(F.replace(c, F.lit("｀｀"), F.lit("“")), F.lit("＇"), F.lit("”")), F.lit("＂"), F.lit("”"))
        odd = reduce(lambda a, b: a | b, [F.contains(c, F.lit(mark)) for mark in "｀＇＂"])
        c = F.when(odd, alternate(grave, "｀")).otherwise(c)
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"“\s+", "“"), r"(?<!\s)\s+”", "”"), r"”\s+(?=[一-鿿])", "”")

    def paired(c: Column) -> Column:
        return F.when(F.regexp_count(c, F.lit("“")) < 2, c).otherwise(alternate(c, "[“”]"))

    return T.once(T.once(c, plain), paired)


def rules_page(lines: DataFrame, traditional: str = "", more: str = "") -> DataFrame:
    """(book, page, ord, text, flagged): a page's lines without junk, repaired; a page that would lose all keeps all.

    traditional: characters of which three in a short line make it a misread one. flagged: the page is to be looked at.
    """
    t = T.trimmed(F.col("text"))
    junk = junk_paragraph(F.col("text"), more)
    foreign = (F.regexp_count(t, F.lit(f"[{traditional}]")) >= 3) & (F.length(t) < 60) if traditional else F.lit(False)
    fixed = reduce(lambda c, fix: fix(c), (fix_confused, T.fix_list_l, T.fix_latin_digits, fix_note_tail), t)
    rows = lines.withColumns({"kept_as_is": structured(F.col("text")), "dropped": ~structured(F.col("text")) & (junk | foreign)})
    w = W.partitionBy("book", "page")
    free = ~F.col("kept_as_is")
    rows = rows.withColumn("empties", (F.count_if(free).over(w) > 0) & (F.count_if(free & ~F.col("dropped")).over(w) == 0))
    junky = F.count_if(F.col("dropped") | (free & fixed.rlike(f"[{JUNK}{more}]"))).over(w) > 0
    out = F.when(F.col("kept_as_is") | F.col("empties"), F.col("text")).otherwise(fixed)
    rows = rows.withColumns({"flagged": F.col("empties") | junky, "out": out}).where("empties or not dropped")
    return rows.select("book", "page", "ord", F.col("out").alias("text"), "flagged")


def title_kind(c: Column) -> Column:
    """num, front, back or sec; null for a line that is no title."""
    front_words, back_words = "|".join(FRONT_TITLES), "|".join(BACK_TITLES)

    def kind(c: Column) -> Column:
        plain = F.regexp_replace(c, r"[\s　]+", "")
        comma = c.rlike("[，,；;]")
        front = c.rlike(EDITION_FOREWORD) | c.rlike("^序[：:]") | plain.rlike(rf"^(?:(?:{front_words})(?:[：:．.、(（]|\z)|序\z)")
        back = c.rlike("^跋([：:]|$)") | plain.rlike(f"^(?:{back_words})")
        return F.when(c.rlike(NUMBERED_TITLE), F.when(~comma, "num")).when(comma | c.rlike("[。！？；，,;?!]$"), None).when(front, "front").when(back, "back").when(c.rlike(SECTION_TITLE), "sec")

    return F.when((c != "") & (F.length(c) <= 40) & ~c.rlike(CONTENTS_ROW), kind(c))


FACTS = ["book", "page", "ord", "head", "entry", "kind", "chars", "text"]


def line_facts(lines: DataFrame) -> DataFrame:
    """What C23 to C25 need of each line, written once: a heading of contents, an entry, the kind of title, and characters.

    The text stays with entries and titles only, which are short. Facts as lines stay as they are.
    """
    if lines.columns == FACTS:
        return lines
    t = F.col("text")
    head = t.rlike(CONTENTS_HEAD)
    rows = lines.select("book", "page", "ord", head.alias("head"), (t.rlike(CONTENTS_ROW) & ~head).alias("entry"), title_kind(t).alias("kind"), F.length(F.regexp_replace("text", r"\s", "")).alias("chars"), "text")
    return written(rows.withColumn("text", F.when(F.col("entry") | F.col("kind").isNotNull(), t)), "line-facts")


def contents_span(lines: DataFrame) -> DataFrame:
    """(book, page): the pages of a book's contents.

    They begin at the first page with their heading; the pages that follow belong to them as long as two lines and two
    fifths of all are entries.
    """
    pages = line_facts(lines).groupBy("book", "page").agg(F.max("head").alias("head"), F.count_if("entry").alias("hits"), F.count("*").alias("n"))
    first = pages.groupBy("book").agg(F.min(F.when(F.col("head"), F.col("page"))).alias("first"))
    pages = pages.join(first, "book").where("page >= first")
    broken = (F.col("page") > F.col("first")) & ~((F.col("hits") >= 2) & (F.col("hits") >= 0.4 * F.col("n")))
    ended = F.max(broken).over(W.partitionBy("book").orderBy("page").rowsBetween(W.unboundedPreceding, 0))
    return pages.withColumn("ended", ended).where(~F.col("ended")).select("book", "page")


def detect_contents(lines: DataFrame) -> DataFrame:
    """(book, page, ord, entry, printed): the entries of a book's contents."""
    lines = line_facts(lines)
    rows = lines.where("entry").join(contents_span(lines), ["book", "page"])
    title, printed = (F.regexp_extract("text", CONTENTS_ROW, i) for i in (1, 2))
    return rows.select("book", "page", "ord", T.trimmed(title).alias("entry"), printed.cast("int").alias("printed"))


RULINGS = "book long, page int, old string, action string, title string"


def scan_chapters(lines: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """(book, n, title, page, level, role, anchor): the chapters of a book by its lines.

    Lines that are titles, but those in the contents. Two and more numbered ones on a page are quoted where the page has
    a long line, and dropped; on a page of titles alone only volumes stay. Rulings (book, page, old, action, title), by the
    first twelve characters of a title, drop, rename or add. Contents, and what stands before the first chapter, are chapters too.
    """
    lines = line_facts(lines)
    span = written(contents_span(lines), "contents-span")
    on_page = W.partitionBy("book", "page")
    long = lines.groupBy("book", "page").agg(F.max(F.col("chars") >= 40).alias("long"))
    rows = lines.where("kind is not null").join(span, ["book", "page"], "left_anti").groupBy("book", "page", "text", "kind").agg(F.min("ord").alias("ord")).join(long, ["book", "page"])
    several = (F.count_if(F.col("kind") == "num").over(on_page) >= 2) & (F.col("kind") == "num")
    rows = rows.withColumn("several", several).where(~F.col("several") | (~F.col("long") & F.col("text").rlike(VOLUME))).select("book", "page", "ord", "kind", F.col("text").alias("title"))
    if rulings is not None:
        key = F.left("title", F.lit(12))
        by = rulings.select("book", "page", F.left("old", F.lit(12)).alias("key"), "action", F.col("title").alias("new"))
        rows = rows.withColumn("key", key).join(by, ["book", "page", "key"], "left").where("action is null or action <> 'DROP'")
        rows = rows.select("book", "page", "ord", "kind", "key", F.when(F.col("action") == "RENAME", F.col("new")).otherwise(F.col("title")).alias("title"))
        added = by.where("action = 'ADD'").join(rows.select("book", "page", F.left("title", F.lit(12)).alias("key")), ["book", "page", "key"], "left_anti")
        rows = rows.drop("key").unionByName(added.select("book", "page", F.lit(1 << 30).alias("ord"), F.lit("num").alias("kind"), F.col("new").alias("title")))
    begins = F.min(F.when(F.col("kind") == "num", F.col("page"))).over(W.partitionBy("book"))
    front = begins.isNull() | (F.col("page") < begins)
    role = F.when(F.col("kind").isin("num", "sec"), "BODY").when((F.col("kind") == "front") & front, "FRONT").otherwise("BACK")
    section = (F.col("kind") == "sec").cast("int")
    rows = rows.select("book", "title", "page", (section + 1).alias("level"), role.alias("role"), (section + 1).alias("turn"), "ord")
    listed = span.groupBy("book").agg(F.min("page").alias("page")).select("book", F.lit("目录").alias("title"), "page", F.lit(1).alias("level"), F.lit("TOC").alias("role"), F.lit(0).alias("turn"), F.lit(0).alias("ord"))
    rows = written(rows.unionByName(listed), "scanned-titles")
    books = lines.select("book").distinct().join(rows.groupBy("book").agg(F.min("page").alias("least")), "book", "left").where("least is null or least > 1")
    opening = books.select("book", F.lit("开篇").alias("title"), F.lit(1).alias("page"), F.lit(1).alias("level"), F.lit("FRONT").alias("role"), F.lit(-1).alias("turn"), F.lit(0).alias("ord"))
    rows = rows.unionByName(opening)
    n = F.row_number().over(W.partitionBy("book").orderBy("page", "turn", "ord", "title")) - 1
    return rows.select("book", n.alias("n"), "title", "page", "level", "role", F.left("title", F.lit(8)).alias("anchor"))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s·•.。:：、，,;；\-—…（）()「」『』〔〕\[\]]+", "")


def reconcile(lines: DataFrame, chapters: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, kind, page, what): contents entries without a chapter, numbers left out, and chapters with hardly a text.

    An entry has the chapter most like it, from a likeness of 0.55 on; what it would be on is reckoned by the offset that
    most of those with one have. chapters as of scan_chapters(), entries as of detect_contents().
    """
    lines, chapters, entries = line_facts(lines), written(chapters, "reconcile-chapters"), written(entries, "reconcile-entries")
    pool = chapters.where("role <> 'TOC'").select("book", "n", _bare(F.col("title")).alias("b"), F.col("page").alias("on"))
    pool = pool.groupBy("book", "b").agg(F.min("n").alias("n"), F.min_by("on", "n").alias("on"))
    asked = entries.withColumn("a", _bare(F.col("entry")))
    best = similar_titles(asked, pool, 0.55).join(pool, ["book", "b"]).groupBy("book", "a").agg(F.max_by("on", F.struct("ratio", -F.col("n"))).alias("on"))
    best = written(best, "reconcile-best")
    offsets = asked.join(best, ["book", "a"]).where("on - printed is not null").groupBy("book", (F.col("on") - F.col("printed")).alias("d"))
    offsets = offsets.agg(F.count("*").alias("times"), F.min(F.struct("page", "ord", "entry")).alias("at"))
    offsets = offsets.groupBy("book").agg(F.min_by("d", F.struct(-F.col("times"), "at")).alias("d"))
    missed = asked.join(best, ["book", "a"], "left_anti").join(offsets, "book", "left")
    missed = missed.select("book", F.lit("toc_miss").alias("kind"), (F.col("printed") + F.col("d")).cast("int").alias("page"), F.col("entry").alias("what"))
    first = chapters.where("level = 1 and role <> 'TOC'")
    numbers = first.where("role = 'BODY'").withColumn("number", T.zh_to_int(F.regexp_extract("title", NUMBERED_TITLE, 1))).where("number > 0").groupBy("book").agg(F.collect_list("number").alias("all"), F.collect_set("number").alias("set"))
    gaps = numbers.where("size(all) >= 2 and size(all) = size(set)").select("book", F.explode(F.array_except(F.sequence(F.array_min("set"), F.array_max("set")), "set")).alias("miss"))
    gaps = gaps.select("book", F.lit("gap").alias("kind"), F.lit(None).cast("int").alias("page"), F.col("miss").cast("string").alias("what"))
    chars = lines.groupBy("book", "page").agg(F.sum("chars").alias("chars"))
    heads = chapters.where("level = 1").select("book", F.col("page").alias("start"), (-F.col("n")).alias("minus"))
    held = asof_join(chars, heads, "book", "page", "start", ["minus"]).groupBy("book", (-F.col("minus")).alias("n")).agg(F.sum("chars").alias("chars"))
    thin = first.where("role = 'BODY'").join(held, ["book", "n"], "left").where("coalesce(chars, 0) < 50").select("book", F.lit("thin").alias("kind"), "page", F.col("title").alias("what"))
    return missed.unionByName(gaps).unionByName(thin)


def contents_entries(lines: DataFrame) -> DataFrame:
    """(book, page, entry, text): a contents page's lines put together to entries, each closed by a line with its page.

    A page number alone joins the entry before it if that has none, and is dropped otherwise.
    """
    rows = lines.withColumn("t", T.trimmed(F.col("text"))).where("t <> ''")
    closes = F.lag(T.contents_line(F.col("t"))).over(W.partitionBy("book", "page").orderBy("ord"))
    rows = islands(rows, ["book", "page"], ["ord"], closes, "part")
    parts = rows.groupBy("book", "page", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda s: s["t"]).alias("lines"))
    parts = parts.select("book", "page", "part", T.soft_merge(F.col("lines")).alias("text"), (F.size("lines") == 1).alias("single"))
    alone = F.col("single") & F.col("text").rlike(T.LONE_PAGE) & (F.col("part") > 0)
    parts = islands(parts.withColumn("alone", alone), ["book", "page"], ["part"], ~F.col("alone"), "entry")
    in_entry = F.sort_array(F.collect_list(F.struct("part", "text")))
    entries = parts.groupBy("book", "page", "entry").agg(in_entry.alias("p"))
    first, second = F.get("p", F.lit(0))["text"], F.get("p", F.lit(1))["text"]
    paged = F.right(first, F.lit(8)).rlike(T.ENTRY_PAGE_TAIL)
    return entries.select("book", "page", "entry", F.when(second.isNull() | paged, first).otherwise(T.soft_merge(F.array(first, second))).alias("text"))


def apply_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """X11: (book, page, ord, text): the edits (book, page, n, find, replace) of a reply, each where it fits one place only.

    Dropped are edits that touch marks, make a text over four characters longer, repeat one before, or whose text stands
    not once in the page, or in a marked line. A line replaced by nothing goes. Edits of a page are few; each line gets those that it holds.
    """
    touches = reduce(lambda a, b: a | b, [F.contains(F.col(c), F.lit(k)) for k in FORBIDDEN for c in ("find", "replace")])
    fits = (F.col("find") != "") & F.col("replace").isNotNull() & ~touches & (F.length("replace") <= F.length("find") + 4)
    edits = edits.where(fits).groupBy("book", "page", "find").agg(F.min_by("replace", "n").alias("replace"), F.min("n").alias("n"))
    held = lines.join(edits, ["book", "page"]).where(F.contains("text", "find"))
    times = (F.length("text") - F.length(F.replace(F.col("text"), F.col("find"), F.lit("")))) / F.length("find")
    held = held.withColumn("times", F.sum(times).over(W.partitionBy("book", "page", "find"))).where("times = 1").where(~structured(F.col("text")))
    per_line = held.groupBy("book", "page", "ord").agg(F.sort_array(F.collect_list(F.struct("n", "find", "replace"))).alias("edits"))
    edited = F.aggregate(F.col("edits"), F.col("text"), lambda acc, e: F.replace(acc, e["find"], e["replace"]))
    joined = lines.join(per_line, ["book", "page", "ord"], "left").withColumn("text", F.when(F.col("edits").isNull(), F.col("text")).otherwise(edited))
    return joined.where(F.col("edits").isNull() | (T.trimmed(F.col("text")) != "")).select("book", "page", "ord", "text")


def join_lines(lines: DataFrame) -> DataFrame:
    """(book, page, para, text): lines that a reply broke, joined; blank lines part, headings, items and figures stand alone."""
    t = T.trimmed(F.col("text"))
    alone = t.startswith("〔图") | t.rlike(CHAPTER_LINE) | t.rlike(SECTION_LINE) | t.rlike("^[（(][0-9一二三四五六七八九十]+[）)]") | t.rlike("^[0-9]+[.、．]")
    rows = lines.withColumns({"t": t, "alone": alone})
    before = lambda c: F.lag(c).over(W.partitionBy("book", "page").orderBy("ord"))
    starts = F.col("alone") | before(F.col("alone")) | (before(F.col("t")) == "")
    rows = islands(rows, ["book", "page"], ["ord"], starts, "para").where("t <> ''")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda s: s["t"])
    word = lambda c: c.rlike("[0-9A-Za-z]")
    joined = F.aggregate(texts, F.lit(""), lambda acc, x: F.concat(acc, F.when(word(F.right(acc, F.lit(1))) & word(F.left(x, F.lit(1))), " ").otherwise(""), x))
    return rows.groupBy("book", "page", "para").agg(joined.alias("text"))


def join_notes(lines: DataFrame) -> DataFrame:
    """(book, page, note, text): note lines, each that begins with a number a new one, the others its continuation."""
    rows = lines.withColumn("t", T.trimmed(F.col("text"))).where("t <> ''")
    rows = islands(rows, ["book", "page"], ["ord"], F.col("t").rlike("^[①-⑳0-9]"), "note")
    return rows.groupBy("book", "page", "note").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda s: s["t"]), "").alias("text"))


def find_highlight(paragraphs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chapter_id, idx): the paragraph that a highlighted title (chapter_id, highlight) names.

    One that equals it, white space aside; else the shortest that begins with it. Contents, notes and figures are no candidates.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"[\s　]+", ""), "^〔标题〕", "")
    texts = paragraphs.where(~F.col("role").isin("TOC", "FOOTNOTE", "FIGURE")).select("chapter_id", "idx", plain(F.col("text")).alias("t")).where("t <> ''")
    keys = wanted.select("chapter_id", plain(F.col("highlight")).alias("key")).where("key <> ''")
    found = texts.join(keys, "chapter_id").where(F.col("t").startswith(F.col("key")))
    rank = F.struct((F.col("t") != F.col("key")).alias("other"), F.when(F.col("t") != F.col("key"), F.length("t")).alias("size"), "idx")
    return found.groupBy("chapter_id").agg(F.min_by("idx", rank).alias("idx"))


def eta_seconds(total: Column, page: Column, done: Column, elapsed_ms: Column, seconds_per_page: float = 1.24) -> Column:
    """What is left by the session's mean after three pages, by a fixed pace before."""
    pace = F.when(done >= 3, elapsed_ms / done).otherwise(F.lit(seconds_per_page * 1000))
    return F.floor((total - page) * pace / 1000 + 0.5).cast("int")


def sample_size(width: Column, height: Column, wanted_width: Column, wanted_height: Column) -> Column:
    """The largest power of two by which half of both sides still reach what is wanted; 1 for images that are not larger."""
    half_w, half_h = F.floor(width / 2), F.floor(height / 2)
    fits = F.least(F.floor(half_w / wanted_width), F.floor(half_h / wanted_height))
    doubled = F.when(fits >= 1, F.pow(F.lit(2), F.floor(F.log2(fits.cast("double") + 0.5)) + 1)).otherwise(F.lit(1))
    return F.when((width > wanted_width) | (height > wanted_height), doubled).otherwise(F.lit(1)).cast("int")


# Marks of a bad text layer, and what a sentence may end in.
BAD_MARKS, CLOSES = "[＠｛｝｀＼｜〜�]", "[。！？；…”』」）】》?!;.：:]$"


def page_scores(lines: DataFrame, traditional: str = "", bands: DataFrame | None = None) -> DataFrame:
    """(book, page, bad, quotes, short, open_ended, score) of every page, the higher the worse.

    bad: places that the repairs change, and bad marks; quotes: longer lines with unequal quotes; short and open_ended:
    lines of one to three characters, and longer ones without an end, but for headings and marks. bands (book, page, n):
    figures found on a page, which count where no placeholder stands for them.
    """
    t, free = F.col("text"), ~F.col("text").startswith("〔") & ~_heading(F.col("text"))
    quoted = F.regexp_count(t, F.lit("“")) != F.regexp_count(t, F.lit("”"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n")
    pages = lines.groupBy("book", "page").agg(
        joined.alias("whole"), F.count_if((F.length(t) >= 8) & quoted).alias("quotes"), F.count_if(F.length(t).between(1, 3) & free).alias("short"),
        F.count_if((F.length(t) >= 15) & free & ~t.rlike(CLOSES)).alias("open_ended"), F.count_if(t.startswith("〔图")).alias("figures"),
    )
    changed = F.size(F.filter(F.zip_with(F.split("whole", ""), F.split(fix_ocr(F.col("whole")), ""), lambda a, b: a != b), lambda x: x))
    pages = pages.withColumns({"bad": changed + F.regexp_count("whole", F.lit(BAD_MARKS)), "foreign": F.regexp_count("whole", F.lit(f"[{traditional}]")) if traditional else F.lit(0)})
    opened = F.lit(0)
    if bands is not None:
        pages = pages.join(bands.select("book", "page", "n"), ["book", "page"], "left")
        opened = F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - F.col("figures"))
    score = 3 * opened + 2 * F.col("bad") + 2 * F.col("foreign") + F.col("quotes") + 0.5 * F.col("short") + 0.5 * F.col("open_ended")
    return pages.select("book", "page", "bad", "quotes", "short", "open_ended", score.cast("double").alias("score"))


def gate_reasons(lines: DataFrame, wanted: DataFrame, least: int = 100) -> DataFrame:
    """(batch, reason): the first gate that a batch's text fails: repeated, pages, disorder, garbled, few, unreadable; null for none.

    lines: batch, ord, text, with a mark line before each page; wanted: batch, pages (the pages it should have).
    """
    mark = F.regexp_extract("text", T.PAGE_MARK, 1)
    plain = F.when(mark == "", F.regexp_replace("text", r"\s", "")).otherwise("")
    b = lines.groupBy("batch").agg(
        F.transform(F.sort_array(F.collect_list(F.when(mark != "", F.struct("ord", mark.cast("int").alias("p"))))), lambda s: s["p"]).alias("got"), F.max(F.contains("text", F.lit("�"))).alias("garbled"),
        F.sum(F.length(plain)).alias("chars"), F.sum(F.regexp_count(plain, F.lit("[一-鿿A-Za-z0-9]"))).alias("readable"),
    )
    b = wanted.join(b, "batch", "left").withColumn("got", F.coalesce("got", F.array().cast("array<int>")))
    apart = (F.size(F.array_except("pages", "got")) > 0) | (F.size(F.array_except("got", "pages")) > 0)
    reason = (
        F.when(F.size(F.array_distinct("got")) < F.size("got"), "repeated").when(apart, "pages").when(F.sort_array("got") != F.col("got"), "disorder").when(F.col("garbled"), "garbled")
        .when(F.col("chars") < least * F.size("pages"), "few").when(F.col("readable") * 2 < F.greatest("chars", F.lit(1)), "unreadable")
    )
    return b.select("batch", reason.alias("reason"))
