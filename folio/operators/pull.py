"""The text layer of a page: figure bands grown from rows full of signs (C20), paragraphs, notes and figures.

A row table has book, page, ord, text, x0, x1, y0, y1, size, n_frag (pieces that it was joined from), max_gap (the widest
gap between them). Rows that can belong to a band depend on themselves and the next row only, so bands are islands; what
a whole book has to say, its body size and its running heads, is counted before any page is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..cluster import written
from ..functions import text as T
from .proofread import CHAPTER_LINE, SECTION_LINE, fix_ocr, fix_quotes

# Signs of figures, page numbers, what follows a number in a text, and the shares of the rules.
SIGNS = r"[｛｝＼｜〜\\|]"
NUMBER_LINE = r"^[\s·•.\-—]*\d{1,4}[\s·•.\-—]*$"
RUN_ON_NUMBER = r"^\d{1,3}(?![\d年月日世条项款章节页人次个种分秒元万亿])([一-鿿].*)$"
MARGIN, HEAD_BAND, TOP, FOOT, NOTES, GAP, DEFAULT_SIZE = 0.02, 0.13, 0.062, 0.958, 0.72, 2.2, 12.0


def _page():
    return W.partitionBy("book", "page")


def _heading(c: Column) -> Column:
    return c.rlike(CHAPTER_LINE) | c.rlike(SECTION_LINE)


def caption(c: Column) -> Column:
    t = T.trimmed(c)
    return F.length(t).between(4, 42) & ~t.rlike(r"[，。；！？：]\z") & ~_heading(t)


def _rect(width: float, height: float) -> list[Column]:
    """The hull of grouped rows with a margin, as shares of the page."""
    inside = lambda c: F.round(c, 4)
    return [
        inside(F.greatest(F.lit(MARGIN), F.min("x0") / width - MARGIN)).alias("left"), inside(F.greatest(F.lit(MARGIN), F.min("y0") / height - MARGIN)).alias("top"),
        inside(F.least(F.lit(1 - MARGIN), F.max("x1") / width + MARGIN)).alias("right"), inside(F.least(F.lit(1 - MARGIN), F.max("y1") / height + MARGIN)).alias("bottom"),
    ]


def figure_bands(rows: DataFrame, width: float, height: float) -> DataFrame:
    """C20: (book, page, start, end, left, top, right, bottom, title, kind): rows start to end of a page are a figure.

    A row full of signs starts a band; rows of a table, short rests with a sign, and one caption before more of them go
    on with it; a narrow caption after it belongs to it. Bands of full lines, too high or too small ones are none.
    """
    t = F.col("text")
    n = F.length(t)
    signs = F.regexp_count(t, F.lit(SIGNS))
    strong = t.rlike("[｛｝]") | ((signs >= 2) & (signs >= 0.03 * n)) | ((n >= 10) & (F.regexp_count(t, F.lit("：")) >= 4) & ~t.rlike("[，。！？；]"))
    table = (F.coalesce("n_frag", F.lit(0)) >= 2) & (F.coalesce("max_gap", F.lit(0.0)) > 2.5 * F.col("size")) & (n <= 80)
    off = (F.col("y1") <= 0) | (F.col("y0") >= height) | (F.col("y1") <= F.col("y0"))
    order = _page().orderBy("ord")
    r = rows.select("*", F.when(off, "").when(strong, "strong").when(table, "table").otherwise("").alias("kind"), caption(t).alias("cap"), signs.alias("signs"), (F.row_number().over(order) - 1).alias("pos"))
    goes_on = (F.col("kind") != "") | ((n <= 12) & (F.col("signs") > 0)) | (F.col("cap") & (F.lead("kind").over(order) != ""))
    r = r.withColumn("joins", F.coalesce(goes_on, F.lit(False)))
    stops = F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    tail = F.coalesce(F.lag("joins").over(order), F.lit(False)) & F.col("cap") & (F.col("x1") - F.col("x0") < 0.75 * width)
    r = r.withColumn("band", F.when(F.col("joins"), stops).when(tail, stops - 1)).where("band is not null")
    r = r.withColumn("start", F.min(F.when(F.col("kind") == "strong", F.col("pos"))).over(W.partitionBy("book", "page", "band"))).where("pos >= start")
    wide = F.col("x1") - F.col("x0")
    last_two = F.slice(F.sort_array(F.collect_list(F.struct("pos", "text", (F.col("cap") & (F.col("signs") == 0)).alias("names"))), asc=False), 1, 2)
    bands = r.groupBy("book", "page", "start").agg(
        F.max("pos").alias("end"), F.count("*").alias("n"), F.max(wide).alias("widest"), F.count_if(wide > 0.8 * width).alias("full"), (F.max("y1") - F.min("y0")).alias("h"), (F.max("x1") - F.min("x0")).alias("w"),
        *_rect(width, height), F.get(F.filter(last_two, lambda x: x["names"]), F.lit(0))["text"].alias("title"), F.max(F.coalesce("n_frag", F.lit(0)) >= 2).alias("pieces"),
    )
    lines = (F.col("widest") > 0.9 * width) & (F.col("full") >= F.greatest(F.lit(2), F.expr("n div 2")))
    sized = F.col("h").between(0.02 * height, 0.75 * height) & (F.col("w") * F.col("h") >= 0.02 * width * height)
    return bands.where(~lines & sized).select("book", "page", "start", "end", "left", "top", "right", "bottom", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("pieces"), "table").otherwise("diagram").alias("kind"))


def body_sizes(rows: DataFrame, height: float) -> DataFrame:
    """(book, body): the size that most characters of the middle of a book's pages have, of equals the one met first."""
    middle = rows.where((F.col("y0") > 0.10 * height) & (F.col("y0") < 0.85 * height))
    tally = middle.groupBy("book", F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "ord")).alias("first"))
    return tally.groupBy("book").agg(F.max_by("s", F.struct("n", -F.col("first.page"), -F.col("first.ord"))).alias("body"))


def running_heads(rows: DataFrame, height: float) -> DataFrame:
    """(book, norm): what stands at the top of three pages and more, numbers aside."""
    heads = rows.where(F.col("y1") <= HEAD_BAND * height).select("book", "page", T.running_norm(F.col("text")).alias("norm")).distinct()
    return heads.where(F.length("norm").between(4, 60) & ~F.col("norm").endswith("。")).groupBy("book", "norm").agg(F.count("*").alias("n")).where("n >= 3").select("book", "norm")


@dataclass
class Pulled:
    """paragraphs: book, page, n, text, figure; notes: book, page, n, text; figures: book, page, n, left, top, right,
    bottom, title, kind; pages: book, page, chars, fig_area, needs_vision, first_x0, first_size, first_is_head,
    last_is_head, page_left."""

    paragraphs: DataFrame
    notes: DataFrame
    figures: DataFrame
    pages: DataFrame


def body_like(c: Column) -> Column:
    return ((F.length(c) > 20) & c.rlike("[，。；]")) | ((F.length(c) > 8) & c.endswith("："))


def pull_pages(rows: DataFrame, width: float, height: float, traditional: str = "") -> Pulled:
    """What each page holds, in the order of its rows, which is that of their heights.

    Running heads, page numbers and small print at the edges go; small rows at the foot, and all below a wide gap there,
    are notes; bands without sentences become figures, with others the page is one to be looked at again, as is an index
    page or one with several of the traditional characters.
    """
    rows = rows.join(body_sizes(rows, height), "book", "left").withColumn("body", F.coalesce("body", F.lit(DEFAULT_SIZE)))
    heads = running_heads(rows, height).withColumn("runs", F.lit(True))
    rows = rows.withColumn("norm", T.running_norm(F.col("text"))).join(heads, ["book", "norm"], "left")
    t, size, body = F.col("text"), F.col("size"), F.col("body")
    above, below = F.col("y1") / height, F.col("y0") / height
    number = t.rlike(NUMBER_LINE)
    top = (above <= 0.11) & (number | (size < body * 0.88) | ((F.length(t) <= 12) & (size < body * 1.15)))
    furniture = (F.coalesce("runs", F.lit(False)) & (above <= HEAD_BAND)) | (above <= TOP) | (below >= FOOT) | top | (number & ((above <= 0.10) | (below >= 0.90)))
    rows = rows.where(~furniture).withColumn("small", (below > NOTES) & (size < body * 0.88))
    upper = ~F.col("small") & (below < 0.20) & (F.length(t) > 20)
    rows = rows.withColumn("text", F.when(upper, F.regexp_replace(t, RUN_ON_NUMBER, "$1")).otherwise(t)).drop("norm", "runs")
    rows = written(rows, "pull-kept")  # notes, the text and the pages are all made of these
    order = _page().orderBy("ord")
    large = rows.where("not small").withColumn("gap", F.col("y0") - F.lag("y1").over(order)).withColumn("pos", F.row_number().over(order) - 1)
    cut = F.min(F.when((F.col("y0") > 0.68 * height) & (F.col("gap") > GAP * body), F.col("pos"))).over(_page())
    large = large.withColumn("cut", cut).withColumn("late", F.coalesce(F.col("pos") >= F.col("cut"), F.lit(False)))
    noted = rows.where("small").select("book", "page", "y0", F.lit(0).alias("late"), "ord", "text").unionByName(large.where("late").select("book", "page", "y0", F.lit(1).alias("late"), "ord", "text"))
    notes = noted.select("book", "page", F.row_number().over(_page().orderBy("y0", "late", "ord")).alias("n"), fix_quotes(fix_ocr(F.col("text"))).alias("text"))
    main = large.where("not late").drop("gap", "cut", "late", "small").withColumn("like", body_like(F.col("text")))
    main = written(main, "pull-rows")  # the bands, and all that is made of them, start from here

    bands = written(_widened(main, figure_bands(main.drop("pos"), width, height), width, height), "pull-bands")
    clean = _without(main, bands.where("not mixed"), width, height)
    figures = bands.where("not mixed").select("book", "page", F.row_number().over(_page().orderBy("top", "start")).alias("n"), "left", "top", "right", "bottom", "title", "kind")
    title = F.when(F.col("title") == "", F.concat(F.lit("第"), F.col("page").cast("string"), F.lit("页插图"))).otherwise(F.col("title"))
    figures = figures.withColumn("title", title)

    head = (size >= body * 1.15) | _heading(F.col("text"))
    edge = F.min("x0").over(_page())
    clean = clean.withColumns({"head": head, "edge": edge}).withColumn("i", F.row_number().over(order))
    starts = F.col("head") | (F.col("x0") - F.col("edge") > body * 1.4) | (F.col("i") == 1)
    clean = clean.withColumn("para", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    clean = written(clean, "pull-clean")
    paras = clean.groupBy("book", "page", "para").agg(F.min_by("y0", "ord").alias("y"), joined.alias("text"))
    paras = written(paras.withColumn("text", fix_quotes(fix_ocr(F.col("text")))), "pull-paragraphs")
    marks = figures.select("book", "page", F.col("n").cast("long").alias("para"), (F.col("top") * height).alias("y"), F.concat(F.lit("〔图：第"), F.col("page").cast("string"), F.lit("页插图"), F.col("n").cast("string"), F.lit("〕")).alias("text"), F.lit(True).alias("figure"))
    every = paras.withColumn("figure", F.lit(False)).unionByName(marks)
    paragraphs = every.select("book", "page", F.row_number().over(_page().orderBy("y", "figure", "para")).alias("n"), "text", "figure")

    counts = main.groupBy("book", "page").agg(
        F.count("*").alias("rows"), F.count_if((F.length("text") <= 45) & (F.regexp_count("text", F.lit(r"\d+")) >= 3)).alias("listed"),
        F.sum(F.length("text") - F.length(F.translate("text", traditional, ""))).alias("old") if traditional else F.lit(0).alias("old"),
    )
    mixed = bands.groupBy("book", "page").agg(F.bool_or("mixed").alias("mixed"))
    area = figures.groupBy("book", "page").agg(F.sum((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))).alias("fig_area"))
    chars = paras.groupBy("book", "page").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("chars"))
    ends = clean.groupBy("book", "page").agg(F.min_by("x0", "i").alias("first_x0"), F.min_by("size", "i").alias("first_size"), F.min_by("head", "i").alias("first_is_head"), F.max_by("head", "i").alias("last_is_head"), F.min("x0").alias("page_left"))
    pages = rows.select("book", "page").distinct()
    for df in (counts, mixed, area, chars, ends):
        pages = pages.join(df, ["book", "page"], "left")
    index = (F.col("rows") >= 10) & (F.col("listed") * 2 >= F.col("rows"))
    vision = F.coalesce(F.col("mixed"), F.lit(False)) | F.coalesce(index, F.lit(False)) | F.coalesce(F.col("old") >= 3, F.lit(False))
    pages = pages.select(
        "book", "page", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), F.coalesce("fig_area", F.lit(0.0)).alias("fig_area"), vision.alias("needs_vision"), "first_x0", "first_size",
        F.coalesce("first_is_head", F.lit(True)).alias("first_is_head"), F.coalesce("last_is_head", F.lit(True)).alias("last_is_head"), "page_left",
    )
    return Pulled(paragraphs, notes, figures, pages)


def _widened(main: DataFrame, bands: DataFrame, width: float, height: float) -> DataFrame:
    """Bands grown over the short rows beside them, with their new rectangles, and whether they hold sentences."""
    order = _page().orderBy("pos")
    stays = F.col("like") | ~((F.length("text") <= 40) | (F.col("size") > F.col("body") * 1.5))
    stop = F.when(stays, F.col("pos"))
    reach = main.select(
        "book", "page", "pos", F.coalesce(F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)).alias("before"),
        F.coalesce(F.min(stop).over(order.rowsBetween(1, W.unboundedFollowing)), F.count("*").over(_page())).alias("after"),
    )
    grown = bands.select("book", "page", "start", "end", "title", "kind")
    grown = grown.join(reach.select("book", "page", F.col("pos").alias("start"), "before"), ["book", "page", "start"]).join(reach.select("book", "page", F.col("pos").alias("end"), "after"), ["book", "page", "end"])
    grown = grown.select("book", "page", "title", "kind", F.col("start").alias("first"), (F.col("before") + 1).alias("start"), (F.col("after") - 1).alias("end"))
    rows = grown.select("*", F.explode(F.sequence("start", "end")).alias("pos")).join(main.select("book", "page", "pos", "x0", "x1", "y0", "y1", "like"), ["book", "page", "pos"])
    return rows.groupBy("book", "page", "first", "start", "end", "title", "kind").agg(*_rect(width, height), F.bool_or("like").alias("mixed"))


def _without(main: DataFrame, bands: DataFrame, width: float, height: float) -> DataFrame:
    """Rows that no band holds, nor, short as they are, any rectangle of one."""
    by_page = bands.groupBy("book", "page").agg(F.collect_list(F.struct("start", "end", "left", "top", "right", "bottom")).alias("bands"))
    x, y = (F.col("x0") + F.col("x1")) / 2 / width, (F.col("y0") + F.col("y1")) / 2 / height
    full = (F.col("x1") - F.col("x0") > 0.5 * width) & (F.length("text") > 20)
    held = lambda b: F.col("pos").between(b["start"], b["end"]) | (~full & x.between(b["left"], b["right"]) & y.between(b["top"], b["bottom"]))
    return main.join(by_page, ["book", "page"], "left").where(F.coalesce(~F.exists("bands", held), F.lit(True))).drop("bands")
