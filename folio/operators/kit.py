"""Chapters of a packed book by its list of chapters (C12): anchors found in order, titles off, roles on, empty ones chained."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..cluster import shipped, written
from ..functions import text as T
from .temporal import asof_join, islands

# Marks of notes and figures, roles of a chapter's paragraphs, what joins titles.
NOTE, FIGURE, JOINER = "〔脚注〕", "^〔图[：:]", " · "
ROLES = {"FRONT": "FRONT", "TOC": "TOC", "BACK": "BACK"}
#: Characters of an anchor, white space aside, at most.
ANCHOR = 8


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def strip_title(line: Column, title: Column) -> Column:
    """the line without the title at its beginning, whatever white space is in either; the line itself if it has another."""
    letters = F.filter(F.split(squeezed(title), ""), lambda x: x != "")
    shape = F.concat(F.lit(r"^\s*"), F.array_join(F.transform(letters, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), r"\s*"))
    return F.when(F.size(letters) == 0, line).when(F.rlike(line, shape), F.regexp_replace(line, F.concat(shape, F.lit(r"\s*")), F.lit(""))).otherwise(line)


def chapter_starts(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, n, start): the block at which each chapter of a list begins, in order; those not found are left out, but for the first.

    lines: book, block, page, ord, text; chapters: book, n, page, anchor. Lines and anchors meet by equal prefixes; the
    choice in order gets the blocks that were hit, not the lines.
    """
    plain = squeezed(F.col("text"))
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(ANCHOR), F.length("plain"))), lambda i: F.left(F.col("plain"), i)))
    keys = lines.withColumn("plain", plain).where("plain <> ''").select("book", "block", F.col("page").alias("at"), prefix.alias("key"))
    wanted = chapters.select("book", "n", F.col("page").alias("least"), F.left(squeezed(F.col("anchor")), F.lit(ANCHOR)).alias("key"))
    reached = F.col("at").isNull() | (F.col("at") >= F.col("least"))
    hits = keys.join(wanted.where("key <> ''"), ["book", "key"]).where(reached).select("book", "n", "block")
    blocks = lines.select("book", "block", F.col("page").alias("at")).distinct()
    hits = hits.unionByName(blocks.join(wanted.where("key = ''"), "book").where(reached).select("book", "n", "block"))
    hits = hits.groupBy("book", "n").agg(F.sort_array(F.collect_set("block")).alias("hits"))
    first = blocks.groupBy("book").agg(F.min("block").alias("begin"))
    rows = chapters.select("book", "n").join(hits, ["book", "n"], "left").join(first, "book")

    def run(batches):
        book, pointer = None, -1
        for pdf in batches:
            out = []
            for of, n, found, begin in zip(pdf["book"].tolist(), pdf["n"].tolist(), pdf["hits"], pdf["begin"].tolist(), strict=True):
                opens = of != book
                if opens:
                    book, pointer = of, -1
                found = [] if found is None else found.tolist()
                at = bisect_left(found, pointer)
                if at < len(found):
                    out.append((of, n, found[at]))
                    pointer = found[at] + 1
                elif opens:
                    out.append((of, n, begin))
            if out:
                yield pd.DataFrame(out, columns=["book", "n", "start"])

    rows = shipped(rows).select("book", "n", "hits", "begin").repartition("book").sortWithinPartitions("book", "n")
    return rows.mapInPandas(run, "book long, n int, start long")


def kit_chapters(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, n, title, block, part, text, role): the paragraphs of each chapter.

    lines: book, block, page, ord, text; chapters: book, n, title, page, anchor, level, role. Only first-level chapters
    count where a book has any. A block is one paragraph, but for its figure lines; one that begins with a note's mark is
    that note. Titles of chapters without paragraphs are put before the next one's. The list, the starts and the lines with
    their chapters are written, each once, since several steps read them.
    """
    any_first = F.max(F.col("level") <= 1).over(W.partitionBy("book"))
    chapters = written(chapters.withColumn("__any", any_first).where("level <= 1 or not __any").drop("__any"), "kit-chapters")
    starts = written(chapter_starts(lines, chapters).join(chapters.select("book", "n", "title", "anchor", "role"), ["book", "n"]), "kit-starts")
    placed = asof_join(lines, starts, "book", "block", "start", ["n", "title", "anchor", "role"]).where("n is not null")
    begun = starts.select("book", F.col("start").alias("block"), F.lit(True).alias("begins"))
    placed = placed.join(begun, ["book", "block"], "left")
    hit = F.col("begins") & (F.col("anchor") != "") & squeezed(F.col("text")).startswith(squeezed(F.col("anchor")))
    first_hit = F.min(F.when(hit, F.col("ord"))).over(W.partitionBy("book", "block"))
    placed = placed.withColumn("anchored", first_hit).withColumn("text", F.when(F.col("ord") == F.col("anchored"), strip_title(F.col("text"), F.col("title"))).otherwise(F.col("text")))
    rows = placed.where(T.trimmed(F.col("text")) != "").withColumn("t", T.trimmed(F.col("text")))
    in_block = W.partitionBy("book", "block")
    head = F.first("t").over(in_block.orderBy("ord"))
    rows = rows.withColumns({"note": head.startswith(NOTE), "figure": F.col("t").rlike(FIGURE), "nth": F.row_number().over(in_block.orderBy("ord"))})
    rows = written(rows.select("book", "n", "title", "role", "block", "ord", "t", "note", "figure", "nth"), "kit-rows")
    keys = ["book", "n", "title", "block"]
    notes = rows.where("note and nth = 1").select(*keys, F.lit(0).alias("part"), F.substring("t", len(NOTE) + 1, 1 << 30).alias("text"), F.lit("FOOTNOTE").alias("role"))
    figures = rows.where("not note and figure").select(*keys, "nth", F.col("t").alias("text")).select(*keys, F.col("nth").alias("part"), "text", F.lit("FIGURE").alias("role"))
    role = F.coalesce(*[F.when(F.col("role") == k, v) for k, v in ROLES.items()], F.lit("BODY"))
    merged = rows.where("not note and not figure").groupBy(*keys, role.alias("role")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda s: s["t"]).alias("l"))
    plain = merged.select(*keys, F.lit(1 << 20).alias("part"), T.soft_merge(F.col("l")).alias("text"), "role").where("text <> ''")
    paragraphs = notes.unionByName(figures).unionByName(plain)
    # chapters without paragraphs hand their titles on
    counts = starts.select("book", "n", "title").join(paragraphs.select("book", "n").distinct().withColumn("full", F.lit(True)), ["book", "n"], "left")
    before = F.lag("full").over(W.partitionBy("book").orderBy("n"))
    chained = islands(counts.withColumn("before", before), ["book"], ["n"], F.coalesce("before", F.lit(False)), "chain")
    titles = chained.groupBy("book", "chain").agg(
        F.max(F.when(F.col("full"), F.col("n"))).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "title"))), lambda s: s["title"]), JOINER).alias("title")
    )
    return paragraphs.drop("title").join(titles.where("n is not null").select("book", "n", "title"), ["book", "n"])
