"""Chapters of an imported book set right by its contents list (C10), and a book cut anew with its read state kept.

Entries of a contents list are few against the lines of a book; lines are only reached by the pages that an entry may
stand on, through equal (book, page), and by place within the page. Choices in order are running maxima, or the counts
that match_in_band folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..cluster import written
from ..functions import text as T
from .documents import match_in_band
from .temporal import asof_join, asof_values, backward_fill, islands

# The shares, distances and bounds of the calibration.
MISSING_PAGES, ANCHORED, INVERTED, INVERTED_MOST = 0.05, 0.6, 0.2, 5
BACK, AHEAD, OFFSET_MOST = 3, 20, 50
PREFIX, SHORT_TITLE = 8, 8
ALIGNED, BAND, OVERLAP = 1, 5, 0.5
CONTENTS_LINES, CONTENTS_GAP, CONTENTS_PAGES, CHARS_KEPT = 3, 5, 8, 0.9


@dataclass
class Calibrated:
    """chapters: book, ord, sub, title, start_page, level, parent, local_only, redundant, low_confidence, title_fallback,
    local_index, shifted. paragraphs: those given, with ord, the chapter that they go to (null before the first start)."""

    chapters: DataFrame
    paragraphs: DataFrame


def _dealt(entries: DataFrame, contents_ends: DataFrame) -> DataFrame:
    """Entries with their segment, contents end, and page, that of the next entry of the segment where it is missing."""
    so_far = W.partitionBy("book").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = islands(entries.withColumn("before", F.last("page", True).over(so_far)), ["book"], ["seq"], F.col("page") < F.col("before"), "segment").drop("before")
    rows = backward_fill(rows, ["book", "segment"], ["seq"], "page", "at").withColumn("inherited", F.col("page").isNull() & F.col("at").isNotNull())
    by = W.partitionBy("book")
    ends = contents_ends.select("book", (F.row_number().over(by.orderBy("last_page")) - 1).alias("region"), F.count("*").over(by).alias("regions"), "last_page")
    # segments meet regions in order; where they are fewer, the last one, of one segment the first
    regions = ends.select("book", "regions").distinct()
    return rows.join(regions, "book").withColumn("region", F.least(F.col("segment"), F.col("regions") - 1)).join(ends.select("book", "region", "last_page"), ["book", "region"])


def _anchorable(lines: DataFrame) -> DataFrame:
    """(book, page, place, n, raw, norm): the lines of a page that have a text, numbered."""
    rows = lines.select("book", "page", "ord", T.trimmed(F.col("text")).alias("raw")).where("raw <> ''")
    w = W.partitionBy("book", "page")
    return rows.select("book", "page", (F.row_number().over(w.orderBy("ord")) - 1).alias("place"), F.count("*").over(w).alias("n"), "raw", T.normal_title(F.col("raw")).alias("norm"))


def _holds(prefix: Column) -> Column:
    return T.anchor_line(F.col("raw"), F.col("norm"), prefix)


def _offsets(level1: DataFrame, anchorable: DataFrame) -> DataFrame:
    """(book, segment, offset, unsure): how far the first, middle and last entry of a segment are from the pages they name."""
    w = W.partitionBy("book", "segment")
    picked = level1.withColumns({"k": F.row_number().over(w.orderBy("seq")) - 1, "c": F.count("*").over(w)}).where("c = 2 or c >= 3 and (k = 0 or k = c div 2 or k = c - 1)")
    assumed = F.col("last_page") + F.col("at")
    picked = picked.where("at is not null and title <> ''").withColumn("assumed", assumed)
    picked = picked.withColumns({"since": F.greatest(F.lit(1), assumed - BACK, F.col("last_page") + 1), "upto": F.least("pages", assumed + AHEAD)}).where("since <= upto")
    asked = picked.select("book", "segment", "seq", "title", "assumed", F.explode(F.sequence("since", "upto")).alias("page"))
    first = asked.join(anchorable, ["book", "page"]).where(_holds(F.left("title", F.lit(PREFIX)))).groupBy("book", "segment", "seq", "title", "assumed", "page", "n").agg(F.min("place").alias("place"))
    upper = (F.length("title") > SHORT_TITLE) | (F.col("place") < F.expr("(n + 1) div 2"))
    found = first.where(upper).groupBy("book", "segment", "seq", "assumed").agg(F.min("page").alias("page")).withColumn("away", F.col("page") - F.col("assumed"))
    of = found.groupBy("book", "segment").agg(F.sort_array(F.collect_list("away")).alias("away"))  # three at most
    n, spread = F.size("away"), F.array_max("away") - F.array_min("away")
    mean = F.floor((F.get("away", F.lit(0)) + F.get("away", F.lit(1))) / 2 + 0.5).cast("int")
    offset = F.when(n == 1, F.get("away", F.lit(0))).when(spread <= 1, F.when(n == 2, mean).otherwise(F.get("away", F.lit(1))))
    return of.select("book", "segment", offset.alias("offset"), (n == 1).alias("unsure")).where(F.col("offset").between(0, OFFSET_MOST))


def _kept(level1: DataFrame, offsets: DataFrame) -> DataFrame:
    """(book, seq, mapped, ...) of the entries that rise in pages, for the books in which enough do."""
    mapped = F.col("last_page") + F.col("at") + F.col("offset")
    anchored = level1.where("at is not null").join(offsets, ["book", "segment"]).withColumn("mapped", mapped.cast("int")).where("mapped between 1 and pages")
    top = F.max("mapped").over(W.partitionBy("book").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    anchored = anchored.withColumn("top", top)
    rises = F.col("top").isNull() | (F.col("mapped") > F.col("top"))
    facts = anchored.groupBy("book").agg(F.count("*").alias("anchored"), F.count_if(F.col("mapped") < F.col("top")).alias("inverted"), F.count_if(rises).alias("rising"))
    every = level1.groupBy("book").agg(F.count("*").alias("all"))
    few = F.col("inverted") <= F.least(F.floor(F.col("anchored") * INVERTED), F.lit(INVERTED_MOST))
    good = facts.join(every, "book").where(few & (F.col("rising") / F.col("all") >= ANCHORED)).select("book")
    return anchored.where(rises).join(good, "book", "left_semi")


def _names(wanted: DataFrame, anchorable: DataFrame) -> DataFrame:
    """(book, seq, name): the first line that holds an entry's title on the pages it is looked for, in their order."""
    asked = wanted.select("book", "seq", F.left("title", F.lit(PREFIX)).alias("prefix"), "pages", F.posexplode("looked").alias("nth", "page")).where("page between 1 and pages")
    return asked.join(anchorable, ["book", "page"]).where(_holds(F.col("prefix"))).groupBy("book", "seq").agg(F.min_by("raw", F.struct("nth", "place")).alias("name"))


def calibrate(entries: DataFrame, chapters: DataFrame, paragraphs: DataFrame, lines: DataFrame, books: DataFrame, contents_ends: DataFrame) -> Calibrated:
    """The chapters of each book by its contents list; books whose list and text don't agree have none.

    entries: book, seq, title, page (may be null), level (1, 2); chapters: book, chapter, title, as cut before;
    paragraphs: book, chapter, idx, page (may be null); lines: book, page, ord, text; books: book, pages; contents_ends:
    book, last_page, for each run of contents pages. Chapters stay, move or come new; none goes.
    """
    paragraphs = written(paragraphs, "calibrate-paragraphs")  # their pages and chapters are asked for several times
    front = (F.col("level") == 1) & T.front_entry(F.col("title"))
    pages = paragraphs.groupBy("book").agg(F.count("*").alias("n"), F.count_if(F.col("page").isNull()).alias("missing"))
    whole = pages.where(F.col("missing") <= F.col("n") * MISSING_PAGES).join(books.where("pages > 0"), "book").select("book", "pages")
    whole = written(whole, "calibrate-books")
    rows = written(_dealt(entries.where(~front), contents_ends).join(whole, "book"), "calibrate-entries")
    level1, level2 = rows.where("level = 1"), rows.where("level = 2")
    anchorable = written(_anchorable(lines), "calibrate-anchors")
    offsets = written(_offsets(level1, anchorable), "calibrate-offsets")
    kept = written(_kept(level1, offsets), "calibrate-kept")

    starts = paragraphs.where("page is not null").groupBy("book", "chapter").agg(F.min_by("page", "idx").alias("start"))
    local = chapters.join(starts, ["book", "chapter"], "left").select("book", "chapter", F.col("title").alias("local_title"), F.coalesce("start", F.lit(0)).alias("start"))
    local = written(local.join(kept.select("book").distinct(), "book", "left_semi"), "calibrate-local")
    matched = match_in_band(kept.select(F.col("book").alias("book_id"), F.col("seq").alias("entry"), F.col("mapped").alias("page")), local.where("start > 0").select(F.col("book").alias("book_id"), "chapter", "start"), BAND)
    matched = written(matched.select(F.col("book_id").alias("book"), F.col("entry").alias("seq"), "chapter"), "calibrate-matched")
    toc = kept.join(matched, ["book", "seq"], "left").join(local, ["book", "chapter"], "left")
    state = F.when(F.col("chapter").isNull(), "new").when(F.abs(F.col("start") - F.col("mapped")) <= ALIGNED, "aligned").otherwise("moved")
    toc = toc.withColumn("state", state).withColumn("start_page", F.coalesce("start", "mapped"))
    only = local.join(matched, ["book", "chapter"], "left_anti").select("book", F.col("start").alias("start_page"), F.lit(1).alias("rank"), F.col("chapter").alias("key"), F.col("local_title"), F.col("chapter").alias("local_index"), F.lit("only").alias("state"))
    toc = toc.select("book", "start_page", F.lit(0).alias("rank"), F.col("seq").alias("key"), "local_title", F.col("chapter").alias("local_index"), "state", "seq", "title", "mapped", "pages", (F.col("unsure") | F.col("inherited")).alias("low"))
    by = W.partitionBy("book")
    out = toc.unionByName(only, allowMissingColumns=True).withColumn("ord", F.row_number().over(by.orderBy("start_page", "rank", "key")))
    out = written(out, "calibrate-chapters")

    sections = level2.where("at is not null").join(offsets, ["book", "segment"]).join(kept.select("book").distinct(), "book", "left_semi")
    sections = sections.withColumn("mapped", (F.col("last_page") + F.col("at") + F.col("offset")).cast("int"))
    sections = sections.select("book", "seq", "title", "mapped", "pages", (F.col("unsure") | F.col("inherited")).alias("low")).where("mapped <= pages")
    sections = asof_join(sections, out.select("book", "start_page", "ord"), "book", "mapped", "start_page", ["ord"]).where("ord is not null")
    sections = written(sections, "calibrate-sections")

    around = F.array("start_page", F.col("start_page") - 1, F.col("start_page") + 1)
    wanted = out.where("state in ('new', 'moved')").select("book", "seq", "title", "pages", F.when(F.col("state") == "new", F.array("mapped")).otherwise(around).alias("looked"))
    names = _names(wanted.unionByName(sections.select("book", "seq", "title", "pages", F.array("mapped").alias("looked"))), anchorable)
    told = F.when(F.col("state").isin("aligned", "only"), F.col("local_title")).otherwise(F.coalesce("name", "title"))
    fallback = F.col("state").isin("new", "moved") & F.col("name").isNull()
    shift = out.where("state = 'moved'").groupBy("book").agg(F.median(F.col("start_page") - F.col("mapped")).alias("mid"), F.var_pop(F.col("start_page") - F.col("mapped")).alias("var"))
    shift = shift.select("book", ((F.col("var") < 1) & (F.abs("mid") >= 2)).alias("shifted"))

    spans = _redundant(out, paragraphs, whole)
    out_named = out.join(names, ["book", "seq"], "left").join(spans, ["book", "ord"], "left").select(
        "book", "ord", F.lit(0).cast("long").alias("sub"), T.clean_title(told).alias("title"), "start_page", F.lit(1).alias("level"), F.lit(None).cast("int").alias("parent"), (F.col("state") == "only").alias("local_only"),
        F.coalesce("redundant", F.lit(False)).alias("redundant"), (F.col("state").isin("new", "moved") & F.col("low")).alias("low_confidence"), fallback.alias("title_fallback"), "local_index",
    )
    sections_named = sections.join(names, ["book", "seq"], "left").select(
        "book", "ord", F.col("seq").cast("long").alias("sub"), T.clean_title(F.coalesce("name", "title")).alias("title"), F.col("mapped").alias("start_page"), F.lit(2).alias("level"), F.col("ord").alias("parent"), F.lit(False).alias("local_only"),
        F.lit(False).alias("redundant"), F.col("low").alias("low_confidence"), F.col("name").isNull().alias("title_fallback"), F.lit(None).cast(dict(chapters.dtypes)["chapter"]).alias("local_index"),
    )
    every = out_named.unionByName(sections_named).join(shift, "book", "left").withColumn("shifted", F.coalesce("shifted", F.lit(False)))

    good = paragraphs.join(out.select("book").distinct(), "book", "left_semi")
    paged = asof_values(good.where("page is not null"), out.select("book", "start_page", "ord"), "book", "page", "start_page", ["ord"])
    follows = out.where("local_index is not null").select("book", F.col("local_index").alias("chapter"), "ord")
    unpaged = good.where("page is null").join(follows, ["book", "chapter"], "left").withColumn("ord", F.coalesce("ord", F.lit(1)))
    return Calibrated(every, paged.unionByName(unpaged))


def _redundant(out: DataFrame, paragraphs: DataFrame, books: DataFrame) -> DataFrame:
    """(book, ord, redundant) of chapters that the list doesn't have: most of their paragraphs lie in a listed neighbour."""
    by = W.partitionBy("book")
    listed = out.where("state <> 'only'").join(books.select("book", F.col("pages").alias("last")), "book")
    span = F.struct(F.col("start_page").alias("lo"), F.coalesce(F.lead("start_page").over(by.orderBy("ord")), F.col("last") + 1).alias("hi"))
    spans = out.select("book", "ord", "state", "local_index").join(listed.select("book", "ord", span.alias("span")), ["book", "ord"], "left")
    sides = {side: F.last("span", True).over(by.orderBy(o).rowsBetween(W.unboundedPreceding, -1)) for side, o in (("before", F.col("ord")), ("after", F.desc("ord")))}
    only = spans.select("*", *[c.alias(side) for side, c in sides.items()]).where("state = 'only'")
    inside = {side: F.count_if((F.col("page") >= F.col(f"{side}.lo")) & (F.col("page") < F.col(f"{side}.hi"))) for side in sides}
    held = only.join(paragraphs.select("book", F.col("chapter").alias("local_index"), "page"), ["book", "local_index"]).groupBy("book", "ord").agg(F.count("*").alias("n"), *[c.alias(side) for side, c in inside.items()])
    return held.select("book", "ord", (F.greatest("before", "after") > F.col("n") * OVERLAP).alias("redundant"))


def contents_regions(lines: DataFrame) -> DataFrame:
    """(book, last_page): pages of three and more contents lines, in runs at most five pages apart, the first runs that hold eight pages together."""
    pages = lines.groupBy("book", "page").agg(F.count_if(T.trimmed(F.col("text")).rlike(T.CONTENTS_LEADER)).alias("n")).where(F.col("n") >= CONTENTS_LINES)
    by = W.partitionBy("book").orderBy("page")
    runs = islands(pages.withColumn("gap", F.col("page") - F.lag("page").over(by)), ["book"], ["page"], F.col("gap") > CONTENTS_GAP, "run")
    runs = runs.groupBy("book", "run").agg(F.max("page").alias("last_page"), F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("book").orderBy("run").rowsBetween(W.unboundedPreceding, 0))
    return runs.withColumn("upto", upto).where(F.col("upto") <= CONTENTS_PAGES).select("book", "last_page")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, rf"{T.WHITE}+", "")


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """(book, action, id, ord, title, read_state): what makes the old list of chapters the new one.

    old: book, id, idx, title, read_state; new: book, ord, title. Chapters are the same by book, title without white
    space, and how many of that title come before: they are kept, or updated where title or place differ; others are
    inserted or deleted. A new chapter gets the last state other than UNREAD that a chapter of its title had.
    """
    key = squeezed(F.col("title"))
    nth = lambda o: F.row_number().over(W.partitionBy("book", "key").orderBy(o))
    a = old.withColumn("key", key).withColumn("nth", nth("idx")).select("book", "key", "nth", "id", F.col("title").alias("was"), "idx")
    b = new.withColumn("key", key).withColumn("nth", nth("ord")).select("book", "key", "nth", "title", "ord")
    read = old.where("read_state <> 'UNREAD'").groupBy("book", key.alias("key")).agg(F.max_by("read_state", "idx").alias("read_state"))
    both = a.join(b, ["book", "key", "nth"], "full").join(read, ["book", "key"], "left")
    same = (F.col("was") == F.col("title")) & (F.col("idx") == F.col("ord"))
    action = F.when(F.col("id").isNull(), "insert").when(F.col("ord").isNull(), "delete").when(same, "keep").otherwise("update")
    return both.select("book", action.alias("action"), "id", "ord", "title", F.when(F.col("ord").isNotNull(), F.coalesce("read_state", F.lit("UNREAD"))).alias("read_state"))


def recalibrate(books: DataFrame, chapters: DataFrame, paragraphs: DataFrame, entries: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books cut anew by their contents: (verdicts, changes, placed).

    books: book, last_read (a chapter's id, or null); chapters: book, id, idx, title, read_state; paragraphs: book, id,
    chapter (an id), idx, page, text; used: book, of those with notes, summaries or reviews, which stay as they are.
    verdicts: book, reason (`done`, or why nothing changes), last_read_ord (the new chapter of the last one read, by title);
    changes: carry_over() of the books done; placed: book, id, ord, the new chapter of each paragraph.
    """
    paragraphs = written(paragraphs.select("book", "id", "chapter", "idx", "page", "text"), "recalibrate-lines")
    chapters = written(chapters.select("book", "id", "idx", "title", "read_state"), "recalibrate-cut")
    lines = paragraphs.where("page is not null").select("book", "page", F.struct("chapter", "idx").alias("ord"), "text")
    regions = written(contents_regions(lines), "recalibrate-regions")
    local = chapters.select("book", F.col("id").alias("chapter"), "idx", "title")
    paged = lines.groupBy("book").agg(F.max("page").alias("pages"))
    told = paragraphs.join(local.select("book", "chapter", F.col("idx").alias("nth")), ["book", "chapter"])
    numbered = told.select("book", F.col("nth").alias("chapter"), F.col("idx").alias("idx"), "page", "id", F.length("text").alias("chars"))
    may = written(books.join(used.select("book").distinct(), "book", "left_anti").select("book"), "recalibrate-books")
    only = lambda df: df.join(may, "book", "left_semi")
    got = calibrate(only(entries), only(local.select("book", F.col("idx").alias("chapter"), "title")), only(numbered), only(lines), only(paged), only(regions))
    placed, cut = written(got.paragraphs, "recalibrate-paragraphs"), written(got.chapters.where("level = 1"), "recalibrate-chapters")
    # what was placed must be nearly all there was
    chars = placed.groupBy("book").agg(F.sum(F.when(F.col("ord").isNotNull(), F.col("chars"))).alias("kept"), F.sum("chars").alias("all"))
    whole = chars.where(F.coalesce("kept", F.lit(0)) >= F.col("all") * CHARS_KEPT).select("book", F.lit(True).alias("whole"))
    ready = chars.select("book", F.lit(True).alias("calibrated")).join(whole, "book", "left")
    flag = lambda df, name: df.select("book").distinct().withColumn(name, F.lit(True))
    facts = books
    for df, name in ((used, "used"), (chapters, "cut"), (lines, "paged"), (regions, "listed")):
        facts = facts.join(flag(df, name), "book", "left")
    reason = (
        F.when(F.col("used"), "used").when(F.col("cut").isNull(), "no chapters").when(F.col("paged").isNull(), "no pages").when(F.col("listed").isNull(), "no contents")
        .when(F.col("calibrated").isNull(), "not calibrated").when(F.col("whole").isNull(), "text lost").otherwise("done")
    )
    verdicts = facts.join(ready, "book", "left").withColumn("reason", reason)
    verdicts = written(verdicts, "recalibrate-verdicts")
    done = verdicts.where("reason = 'done'").select("book")
    new = cut.select("book", (F.col("ord") - 1).alias("ord"), "title").join(done, "book", "left_semi")
    last = verdicts.join(chapters.select("book", F.col("id").alias("last_read"), F.col("title").alias("last_title")), ["book", "last_read"], "left")
    of_title = new.groupBy("book", squeezed(F.col("title")).alias("key")).agg(F.min("ord").alias("last_read_ord"))
    verdicts = last.withColumn("key", squeezed(F.col("last_title"))).join(of_title, ["book", "key"], "left").select("book", "reason", "last_read_ord")
    changes = carry_over(chapters.join(done, "book", "left_semi"), new)
    placed = placed.join(done, "book", "left_semi").select("book", "id", (F.col("ord") - 1).alias("ord"))
    return verdicts, changes, placed
