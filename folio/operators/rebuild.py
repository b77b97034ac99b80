"""Pages of a book replaced by what was read of them again, where that is safe (C14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..cluster import written
from ..functions import text as T
from .temporal import asof_join

# Contents entries that make a page one of contents, and the share of the expected text that must be there.
CONTENTS_ENTRIES, COVERED = 3, 0.8


def read_again(pages: DataFrame) -> DataFrame:
    """(book, page, n, text, role): the paragraphs of pages (book, page, body, notes) read again; a contents page entry by entry."""
    listed = F.size(F.filter("body", lambda t: T.trimmed(t).rlike(T.CONTENTS_ENTRY))) >= CONTENTS_ENTRIES
    body = F.when(listed, F.flatten(F.transform("body", lambda t: F.transform(T.split_glued(t), lambda x: F.struct(x.alias("text"), F.lit("TOC").alias("role")))))).otherwise(
        F.transform("body", lambda t: F.struct(t.alias("text"), F.lit("BODY").alias("role")))
    )
    note = F.when(F.size("notes") > 0, F.array(F.struct(T.soft_join(F.col("notes")).alias("text"), F.lit("FOOTNOTE").alias("role")))).otherwise(F.array().cast("array<struct<text:string,role:string>>"))
    return pages.select("book", "page", F.posexplode(F.concat(body, note)).alias("n", "p")).select("book", "page", "n", "p.text", "p.role")


def page_owners(paragraphs: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, page, chapter): whose a page is: of its last paragraph, else of the nearest page before with one, else after.

    paragraphs: book, chapter (an id), idx, page; chapters: book, id, idx; pages: book, page.
    """
    last = paragraphs.groupBy("book", "chapter", "page").agg(F.max("idx").alias("idx"))
    rows = last.join(chapters.select("book", F.col("id").alias("chapter"), F.col("idx").alias("nth")), ["book", "chapter"])
    own = rows.groupBy("book", "page").agg(F.max_by("chapter", F.struct("nth", "idx")).alias("owner")).withColumn("at", F.col("page"))
    before = asof_join(pages.select("book", "page"), own, "book", "page", "at", ["owner"])
    first = own.groupBy("book").agg(F.min_by("owner", "page").alias("first"))
    return before.join(first, "book").select("book", "page", F.coalesce("owner", "first").alias("chapter"))


def rebuild_if_safe(paragraphs: DataFrame, chapters: DataFrame, pages: DataFrame, used: DataFrame, figures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C14: (paragraphs, figures, verdicts): each book's text with the pages read again in place of what stood on them.

    paragraphs: book, chapter, idx, page, text, role; chapters: book, id, idx, level; pages: book, page, body, notes, of
    those read again; used: book, of those with notes, summaries or reviews; figures: book, id, page, chapter. Chapters
    stay as they are; paragraphs of one page keep their order, and all of a chapter follow each other by page. Figures go
    to the chapter that their page is in then. Books that a guard stops come back row for row; verdicts has its name.
    """
    fresh = read_again(pages)
    # what guards, owners and figures ask of the texts is how long they are, by chapter and page: texts are read for that once
    spots = paragraphs.groupBy("book", "chapter", "page").agg(F.sum(F.length("text")).alias("chars"), F.max("idx").alias("idx"))
    spots = written(spots, "rebuild-spots")
    asked = written(pages.select("book", "page").distinct(), "rebuild-asked")
    sizes = written(fresh.groupBy("book", "page").agg(F.sum(F.length("text")).alias("chars")), "rebuild-fresh")
    old = spots.groupBy("book").agg(F.sum("chars").alias("chars"), F.bool_or(F.col("page").isNull()).alias("unpaged"))
    gone = spots.join(asked, ["book", "page"], "left_semi").groupBy("book").agg(F.sum("chars").alias("replaced"))
    deep = chapters.groupBy("book").agg(F.bool_or(F.col("level") != 1).alias("sections"))
    facts = chapters.select("book").distinct()
    seen = lambda df, name: df.select("book").distinct().withColumn(name, F.lit(True))
    for df in (seen(asked, "again"), seen(used, "used"), old, gone, deep):
        facts = facts.join(df, "book", "left")
    stops = (
        F.when(F.col("again").isNull(), "nothing read").when(F.col("used"), "used").when(F.col("chars").isNull() | F.col("unpaged"), "no pages").when(F.col("sections"), "sections")
    )
    facts = written(facts.withColumn("reason", stops), "rebuild-books")
    may = facts.where("reason is null").select("book")

    owners = written(page_owners(spots.join(may, "book", "left_semi"), chapters, asked.join(may, "book", "left_semi")), "rebuild-owners")
    placed = fresh.join(owners, ["book", "page"]).select("book", "chapter", "page", F.lit(1).alias("again"), F.col("n").cast("long").alias("n"), "text", "role")
    kept = paragraphs.join(may, "book", "left_semi").join(asked, ["book", "page"], "left_anti")
    staged = kept.select("book", "chapter", "page", F.lit(0).alias("again"), F.col("idx").cast("long").alias("n"), "text", "role").unionByName(placed)
    lasting = spots.join(may, "book", "left_semi").join(asked, ["book", "page"], "left_anti").select("book", "chapter", "page", "chars")
    lasting = lasting.unionByName(sizes.join(owners, ["book", "page"]).select("book", "chapter", "page", "chars"))
    new = lasting.groupBy("book").agg(F.sum("chars").alias("staged"))
    wanted = sizes.groupBy("book").agg(F.sum("chars").alias("fresh"))
    verdicts = facts.join(new, "book", "left").join(wanted, "book", "left")
    expected = F.col("chars") - F.coalesce("replaced", F.lit(0)) + F.coalesce("fresh", F.lit(0))
    short = F.coalesce("staged", F.lit(0)) < COVERED * expected
    verdicts = verdicts.select("book", F.coalesce("reason", F.when(short, "text lost"), F.lit("done")).alias("reason"))
    verdicts = written(verdicts, "rebuild-verdicts")

    done = verdicts.where("reason = 'done'").select("book")
    order = W.partitionBy("book", "chapter").orderBy("page", "again", "n")
    swapped = staged.join(done, "book", "left_semi").select("book", "chapter", (F.row_number().over(order) - 1).cast(dict(paragraphs.dtypes)["idx"]).alias("idx"), "page", "text", "role")
    columns = ["book", "chapter", "idx", "page", "text", "role"]
    out = paragraphs.select(columns).join(done, "book", "left_anti").unionByName(swapped.select(columns))
    starts = lasting.join(done, "book", "left_semi").groupBy("book", F.col("chapter").alias("home")).agg(F.min("page").alias("start"))
    moved = asof_join(figures.join(done, "book", "left_semi"), starts, "book", "page", "start", ["home"])
    homes = figures.join(done, "book", "left_anti").unionByName(moved.withColumn("chapter", F.coalesce("home", "chapter")).select(figures.columns))
    return out, homes, verdicts
