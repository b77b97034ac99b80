"""Judgements on imported chapters and pages: phantom chapters, front matter, junk, proofreading counts, page lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

# Shapes of headings and contents lines.
CHAPTER_TITLE, SECTION_ENTRY = "^第[一二三四五六七八九十百千零〇两]+章", "^第[一二三四五六七八九十百千零〇两]+节"
VOLUME_TITLE, PAGE_TAIL, NO_PUNCTUATION = "^第[一二三四五六七八九十百]+编", r"/\s*\d{1,4}\s*$", "^[^，。；：！？、,.;:!?]*$"


def phantom_chapters(paragraphs: DataFrame, title_shape: str = CHAPTER_TITLE, entry_shape: str = SECTION_ENTRY) -> DataFrame:
    """(chapter_id, decision, new_title): a chapter of nothing but section entries is dropped, a mixed one is cleaned.

    paragraphs: chapter_id, idx, title, text, role. Chapters with one paragraph, or with over 15 entries, are kept.
    """
    other = ~T.trimmed(F.col("text")).rlike(entry_shape)
    c = paragraphs.where("role = 'BODY'").groupBy("chapter_id", "title").agg(
        F.count("*").alias("n"), F.count_if(other).alias("others"), F.max(F.when(other, F.length("text"))).alias("longest"), F.min_by(F.when(other, F.col("text")), F.when(other, F.col("idx"))).alias("head")
    )
    decision = (
        F.when(~T.trimmed(F.col("title")).rlike(title_shape) | (F.col("n") < 2), "keep").when(F.col("others") == 0, F.when(F.col("n") <= 15, "drop").otherwise("keep"))
        .when((F.col("others") <= 3) & (F.col("longest") >= 2000), "clean").otherwise("keep")
    )
    return c.select("chapter_id", decision.alias("decision"), F.when(decision == "clean", F.left(T.trimmed(F.col("head")), F.lit(10))).alias("new_title"))


def front_matter(paragraphs: DataFrame) -> DataFrame:
    """(chapter_id, rule) of body chapters to drop: volume stubs, contents-shaped ones, short twins of a title.

    paragraphs: book_id, chapter_id, chapter_idx, idx, title, text, role.
    """
    t = T.trimmed(F.col("text"))
    lengths = F.sort_array(F.collect_list(F.length("text")))
    c = paragraphs.groupBy("book_id", "chapter_id", "chapter_idx", "title").agg(
        F.min_by("role", "idx").alias("first_role"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), lengths.alias("lengths"),
        F.count_if(t.rlike(PAGE_TAIL)).alias("tails"), F.count_if(t.rlike(NO_PUNCTUATION)).alias("plain"),
    )
    c = c.where("first_role = 'BODY'")
    median = F.get("lengths", F.floor(F.col("n") / 2).cast("int"))
    listed = (F.col("n") >= 5) & (median <= 40) & ((F.col("tails") * 10 >= F.col("n") * 7) | ((F.col("plain") * 10 >= F.col("n") * 7) & (F.col("chars") < 3000)))
    c = c.withColumn("rule", F.when((F.col("chars") < 200) & T.trimmed(F.col("title")).rlike(VOLUME_TITLE), "volume").when(listed, "contents"))
    w = W.partitionBy("book_id", F.regexp_replace("title", r"\s", ""), F.col("rule").isNull()).orderBy(F.desc("chars"), "chapter_idx")
    twin = F.col("rule").isNull() & (F.row_number().over(w) > 1) & (F.col("chars") < 200)
    return c.select("chapter_id", F.coalesce("rule", F.when(twin, "twin")).alias("rule")).where("rule is not null")


def page_list(pages: Column, most: int = 5) -> Column:
    """The first pages of a set, and how many there are in all."""
    names = F.transform(F.slice(F.sort_array(pages), 1, most), lambda p: F.concat(F.lit("p"), p.cast("string")))
    return F.concat(F.array_join(names, "、"), F.when(F.size(pages) > most, F.concat(F.lit(" 等 "), F.size(pages).cast("string"), F.lit(" 张"))).otherwise(""))


def resolve_roles(wanted: DataFrame, profiles: DataFrame, main: str, strict: list[str]) -> DataFrame:
    """(role, profile): each role's own profile, else the main one, which strict roles don't fall back to."""
    own = profiles.select(F.col("role"), F.col("profile").alias("own"))
    fallback = profiles.where(F.col("role") == main).agg(F.max("profile").alias("fallback"))
    return wanted.join(own, "role", "left").crossJoin(F.broadcast(fallback)).select("role", F.coalesce("own", F.when(~F.col("role").isin(strict), F.col("fallback"))).alias("profile"))


def learner_context(wrong: Column, asked: Column, memos: Column) -> Column:
    """Lines for wrong answers, questions and memos (arrays of strings), each cut; null if all are empty."""
    part = lambda head, items, n: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(F.transform(items, lambda x: F.left(x, F.lit(n))), "；")))
    out = F.concat_ws("\n", part("做错的题：", wrong, 40), part("问过的问题：", asked, 50), part("读者批注：", memos, 60))
    return F.when(out != "", out)


def page_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages (book, page) with the block (book, first, last, kind) whose interval holds them; equi-join on the book, then a range."""
    return pages.join(blocks, "book").where("page between first and last").select("book", "page", "kind")


# Shares of a page and points that make a figure its background, an ornament or a running mark.
BLEED_AREA, BLEED_EDGE, ORNAMENT_EDGE, ORNAMENT_AREA, MARK_PAGES, MARK_SHIFT = 0.85, 0.9, 40.0, 0.02, 3, 0.02


def figure_rules(figures: DataFrame) -> DataFrame:
    """Figures (key, page, x, y, w, h, page_w, page_h) with reason: R1 the page's background, R2 an ornament, R3 a mark at one place of three pages and more; else null."""
    known = (F.col("page_w") > 0) & (F.col("page_h") > 0)
    area, of = F.col("w") * F.col("h"), F.col("page_w") * F.col("page_h")
    bleed = known & (F.col("w") >= 0) & (F.col("h") >= 0) & ((area / of >= BLEED_AREA) | ((F.col("w") / F.col("page_w") >= BLEED_EDGE) & (F.col("h") / F.col("page_h") >= BLEED_EDGE)))
    ornament = known & ((F.col("w") < ORNAMENT_EDGE) | (F.col("h") < ORNAMENT_EDGE) | (area < ORNAMENT_AREA * of))
    place = F.struct((F.col("x") / F.col("page_w")).alias("x"), (F.col("y") / F.col("page_h")).alias("y"), (F.col("w") / F.col("page_w")).alias("w"))
    first = figures.where(known).groupBy("key").agg(F.min_by(place, F.struct("page", "x", "y")).alias("first"), F.countDistinct("page").alias("pages"))
    rows = figures.join(first.where(F.col("pages") >= MARK_PAGES), "key", "left")
    near = (F.abs(F.col("x") / F.col("page_w") - F.col("first.x")) <= MARK_SHIFT) & (F.abs(F.col("y") / F.col("page_h") - F.col("first.y")) <= MARK_SHIFT) & (F.abs(F.col("w") / F.col("page_w") - F.col("first.w")) <= MARK_SHIFT)
    far = rows.where(F.col("first").isNotNull()).groupBy("key").agg(F.bool_and(near).alias("mark"))
    reason = F.when(bleed, "R1").when(ornament, "R2").when(F.coalesce("mark", F.lit(False)), "R3")
    return figures.join(far, "key", "left").select(*figures.columns, reason.alias("reason"))
