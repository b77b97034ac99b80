"""A book's blocks to chapters: headings, contents lists inserted as chapters, notes, and parts of one title joined again.

The blocks with what the marks say, their kinds, and the paragraphs are written, each once, since several steps read them.
Every step is a column expression on a block, an aggregate by book, or an as-of join in buckets of the order, so that a
book that holds most of the rows is many tasks; only the chapters themselves are numbered book by book.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..cluster import written
from ..functions import text as T
from .proofread import contents_entries
from .temporal import asof_join, islands

# Marks of the text protocol, and titles of chapters that no heading gives.
SIZE_MARK, CONTENTS_MARK, NOTE_MARK = "〔标题〕", "〔目录〕", "〔脚注〕"
CONTENTS_NAMES = ["目录", "目次"]
OPENING, CONTENTS = "开篇", "目录"
DENSE = 3


class Book(NamedTuple):
    """chapters: book, chapter, title, first, blocks, paragraphs, chars; paragraphs: book, idx, n, title, role, page, text."""

    chapters: DataFrame
    paragraphs: DataFrame


def _with_last(rows: DataFrame, right: DataFrame, payload: list[str]) -> DataFrame:
    """rows with the payload of the last row of right (book, at, ...) up to their idx; texts are not sorted for it."""
    found = asof_join(rows.select("book", "idx").distinct(), right, "book", "idx", "at", payload)
    return rows.join(found, ["book", "idx"])


def _unmarked(blocks: DataFrame, sized: bool) -> DataFrame:
    """Blocks without marks of pages, contents and sizes; what they said is columns. Blocks of nothing else go."""
    mark = lambda x: F.regexp_extract(T.trimmed(x), r"^〔页(\d+)〕$", 1)
    marks = F.filter(F.transform("lines", mark), lambda m: m != "")
    rows = blocks.select("book", "idx", F.filter("lines", lambda x: mark(x) == "").alias("lines"), F.get(marks, F.lit(0)).cast("int").alias("own"), F.try_element_at(marks, F.lit(-1)).cast("int").alias("last_mark"))
    rows = written(rows, "marked")
    before = rows.where("last_mark is not null").select("book", F.col("idx").alias("at"), F.col("last_mark").alias("page_before"))
    rows = _with_last(rows.drop("last_mark"), before, ["page_before"])
    listed = F.coalesce(T.trimmed(F.get("lines", F.lit(0))) == CONTENTS_MARK, F.lit(False))
    rows = rows.select("book", "idx", F.coalesce("own", "page_before").alias("page"), listed.alias("listed"), F.when(listed, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")).alias("lines"))
    lead = F.transform("lines", lambda x: F.ltrim(x))
    big = F.transform(lead, lambda x: x.startswith(SIZE_MARK)) if sized else F.transform("lines", lambda x: F.lit(True))
    bare = F.transform(lead, lambda x: F.when(x.startswith(SIZE_MARK), F.substring(x, len(SIZE_MARK) + 1, F.length(x))).otherwise(x)) if sized else F.col("lines")
    return rows.where(F.size("lines") > 0).select("book", "idx", "page", "listed", bare.alias("lines"), big.alias("big"))


def _judged(rows: DataFrame, custom: str | None) -> DataFrame:
    """rows with what its lines say: the style of each that may be a heading, the one that names a contents list (-1 if none),
    whether the block reads as part of one, and its contents lines."""
    rows = rows.withColumn("t", F.transform("lines", T.trimmed))
    named = F.transform("t", lambda t: t.isin(CONTENTS_NAMES) | (F.lower(t) == "contents"))
    styles = F.transform("t", lambda t: F.when(T.title_candidate(t), T.title_style(t, custom)))
    rows = rows.select("*", styles.alias("styles"), (F.array_position(named, F.lit(True)) - 1).cast("int").alias("names"), F.transform("t", T.contents_line).alias("dotted"))
    strong = F.size(F.filter(F.transform("t", lambda t, i: F.get("dotted", i) | T.contents_like(t)), lambda x: x))
    is_list = F.array_contains("dotted", True) & (strong * 2 >= F.size(F.filter("t", lambda t: t != "")))
    return rows.withColumns({"is_list": is_list, "dots": F.size(F.filter("dotted", lambda x: x))}).drop("t", "dotted")


def _region(rows: DataFrame) -> DataFrame:
    """(book, region, region_end, anchor): the blocks of a book's contents list, and the line that names it, -1 if none does."""
    anchored, dense = F.col("names") >= 0, F.col("is_list") & (F.col("dots") >= DENSE)
    found = rows.groupBy("book").agg(F.min(F.when(anchored, F.struct("idx", F.col("names").alias("anchor")))).alias("a"), F.min(F.when(dense, F.struct("idx", F.lit(-1).alias("anchor")))).alias("d"))
    found = found.select("book", F.coalesce("a", "d").alias("r")).where("r is not null").select("book", F.col("r.idx").alias("region"), F.col("r.anchor").alias("anchor"))
    ends = found.join(rows.select("book", "idx", "is_list"), "book").groupBy("book", "region", "anchor").agg(F.min(F.when((F.col("idx") > F.col("region")) & ~F.col("is_list"), F.col("idx"))).alias("region_end"))
    return ends.select("book", "region", "region_end", "anchor")


def _headed(rows: DataFrame, sized: bool) -> DataFrame:
    """rows with the title and the line of the heading of the book's best grade, and without books that have none."""

    def one(style: Column, i: Column) -> Column:
        fits = ~F.col("inside") | ((F.col("idx") == F.col("region")) & (i == F.col("anchor")))
        proven = F.get("big", i) | (T.title_grade(style) == 3) | (style == "CUSTOM") if sized else F.lit(True)
        return F.when(style.isNotNull() & fits & ~F.col("listed") & proven, i)

    rows = rows.withColumn("at", F.get(F.filter(F.transform("styles", one), lambda x: x.isNotNull()), F.lit(0)))
    rows = rows.withColumns({"style": F.get("styles", F.col("at")), "t": T.trimmed(F.get("lines", F.col("at")))})
    title = F.when(F.col("style") == "A_HAN_SUB", F.coalesce(T.subtitle_cut(F.col("t")), F.col("t"))).otherwise(F.col("t"))
    rows = rows.withColumn("hit", F.when(F.col("at").isNotNull(), F.struct("style", title.alias("title"), F.col("at").alias("line")))).drop("at", "style", "t", "styles")
    rows = rows.withColumn("grade", T.title_grade(F.col("hit.style")))
    best = rows.where("grade is not null").groupBy("book").agg(F.min("grade").alias("best"), F.min_by("hit.style", F.when(F.col("grade") == 3, F.col("idx"))).alias("best_style"))
    top = (F.col("grade") == F.col("best")) & ((F.col("best") < 3) | (F.col("hit.style") == F.col("best_style")))
    return rows.join(best, "book").withColumn("hit", F.when(top, F.col("hit")))


def parse(blocks: DataFrame, custom: str | None = None, sized: bool = False) -> Book:
    """C07 in full, of blocks (book, idx, lines). sized: headings of the first two grades need their mark of size.

    A contents list, named or dense, and further blocks like one are a chapter of their own; the text after it goes on
    with the chapter before, or after a chapter that a heading named so, with the opening. Parts of one title are one
    chapter if nothing but contents stand between them. Chapters without text go. With custom there is no list's region.
    Books without any heading are not returned: blind_chapters() is for these. Null lines are empty ones.
    """
    rows = blocks.select("book", F.col("idx").cast("long").alias("idx"), F.transform("lines", lambda x: F.coalesce(x, F.lit(""))).alias("lines"))
    rows = written(_judged(_unmarked(rows, sized), custom), "blocks")
    if custom:
        rows = rows.withColumns({"inside": F.lit(False), "region": F.lit(-1).cast("long"), "anchor": F.lit(-1)})
    else:
        rows = rows.join(_region(rows), "book", "left")
        inside = (F.col("idx") >= F.col("region")) & (F.col("region_end").isNull() | (F.col("idx") < F.col("region_end")))
        rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False)))
    rows = _headed(rows, sized)
    note = T.trimmed(F.get("lines", F.lit(0))).startswith(NOTE_MARK)
    listing = F.col("listed") | F.col("is_list")
    kind = (
        F.when(F.col("hit").isNotNull(), "heading").when(F.col("inside"), F.when(F.col("anchor") >= 0, "region").otherwise("list"))
        .when(note, "note").when(listing, "list").otherwise("body")
    )
    rows = written(rows.select("book", "idx", "page", "lines", "inside", "hit", kind.alias("kind")), "kinds")
    heads = rows.where("kind = 'heading'").select("book", F.col("idx").alias("at"), F.col("hit.title").alias("head"), F.col("idx").alias("head_at"))
    turns = rows.where("kind in ('heading', 'list', 'body')").select("book", F.col("idx").alias("at"), F.col("kind").alias("state"))
    rows = _with_last(_with_last(rows, heads, ["head", "head_at"]), turns, ["state"])
    base = F.when(F.col("head") != CONTENTS, F.col("head")).otherwise(OPENING)
    title = F.when(F.col("state") == "heading", F.col("head")).when(F.col("state") == "list", CONTENTS).otherwise(base)
    role = F.when(title == OPENING, "FRONT").otherwise(T.role_of(title))
    rows = rows.select("book", "idx", "page", "lines", "kind", "inside", F.col("hit.line").alias("line"), F.coalesce("head_at", F.lit(-1)).alias("head_at"), title.alias("title"), role.alias("role"))

    rest = F.when(F.col("line").isNotNull(), F.filter("lines", lambda x, i: i != F.col("line"))).otherwise(F.col("lines"))
    is_list = F.col("kind").isin("region", "list") | ((F.col("kind") == "heading") & F.col("inside"))
    shape = ["book", "idx", "n", "head_at", "title", "role", "page", "text"]
    first = F.regexp_replace(T.trimmed(F.get("lines", F.lit(0))), f"^{NOTE_MARK}", "")
    text = F.when(F.col("kind") == "note", first).otherwise(T.soft_merge(rest))
    plain = rows.where(~is_list).withColumns({"n": F.lit(0).cast("long"), "text": text, "role": F.when(F.col("kind") == "note", "FOOTNOTE").otherwise(F.col("role"))})
    plain = plain.where("kind = 'note' or text <> ''").select(shape)
    lists = rows.where(is_list)
    lines = lists.select("book", F.col("idx").alias("page"), F.posexplode(rest).alias("ord", "text"))
    entries = contents_entries(lines).select("book", F.col("page").alias("idx"), F.col("entry").cast("long").alias("n"), "text").where("text <> ''")
    listed = entries.join(lists.select("book", "idx", "head_at", "title", "page"), ["book", "idx"]).withColumn("role", F.lit("TOC")).select(shape)
    paragraphs = written(plain.unionByName(listed), "paragraphs")
    return Book(_joined(paragraphs), paragraphs.drop("head_at"))


def _joined(paragraphs: DataFrame) -> DataFrame:
    """Chapters of the paragraphs: first the parts of each heading, then, part by part, those of one title."""
    is_list = F.col("title") == CONTENTS
    begun = paragraphs.where(~is_list).groupBy("book", "head_at").agg(F.min("idx").alias("begun"))
    rows = paragraphs.join(begun, ["book", "head_at"], "left").withColumns({"is_list": is_list, "late": is_list & F.coalesce(F.col("idx") > F.col("begun"), F.lit(False))})
    parts = rows.groupBy("book", "head_at", "title", "is_list", "late").agg(F.min("idx").alias("first"), F.countDistinct("idx").alias("blocks"), F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))
    order = W.partitionBy("book").orderBy("first")
    before = F.last(F.when(~F.col("is_list"), F.col("title")), True).over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("starts", ~F.col("is_list") & ~F.col("title").eqNullSafe(before))
    parts = islands(parts, ["book"], ["first"], F.col("starts"), "run")
    sums = [F.sum(c).alias(c) for c in ("blocks", "paragraphs", "chars")]
    out = parts.groupBy("book", "run", "is_list").agg(F.min_by("title", "first").alias("title"), F.min("first").alias("first"), *sums)
    return out.select("book", (F.row_number().over(order) - 1).alias("chapter"), "title", "first", "blocks", "paragraphs", "chars")
