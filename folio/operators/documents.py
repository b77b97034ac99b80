"""Documents from page lines: rows, paragraphs, chapters, blocks, stitching, matching.

A line table has book, page, ord, text, x0, x1, y0, size. Rows are ordered by (page, ord); steps that depend on their
own earlier choices run grouped by book or page.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..cluster import shipped, written
from ..functions import text as T
from .temporal import islands

# The factors of the layout rules.
INDENT, FULL_LINE, NEAR_FULL, SHORT_LINE, Y_JUMP, TITLE_FACTOR = 1.5, 1.0, 2.0, 2.0, 1.0, 1.2
LEADING_NO_BREAK = "[，。！？；：、）】》”’%]"
STRONG_NEW = r"^(第[一二三四五六七八九十百]+|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d{1,2}[.、])"

#: What begins a paragraph that is never joined across pages, and what a line of a colophon has.
SEAM_HEAD = re.compile(
    r"(第\s*[0-9〇零一二三四五六七八九十百千]+\s*[章编部篇节讲]|[一二三四五六七八九十]+\s*、|[（(][0-9①-⑳一二三四五六七八九十]+\s*[）)、．.]"
    r"|[0-9①-⑳]+\s*[、．.]|附录|目录|序言|前言|导论|结语|后记|参考文献|索引|注释|[表图]\s*[0-9一二三四五六七八九十])"
)
COLOPHON = re.compile("定价|ISBN|印张|开本|版次|印次|字数|书号|发行|经销|印刷|装订")
STITCHED = pa.schema({"book": pa.int64(), "page": pa.int32(), "paras": pa.int32(), "chars": pa.int64(), "texts": pa.list_(pa.string()), "tail": pa.string(), "head": pa.string()})


def visual_rows(lines: DataFrame, tolerance: float) -> DataFrame:
    """Spans of a page whose heights differ by little are one row: text in reading order, hull, weighted size."""
    gap = F.col("y0") - F.lag("y0").over(W.partitionBy("book", "page").orderBy("y0", "ord"))
    rows = islands(lines.withColumn("gap", gap), ["book", "page"], ["y0", "ord"], F.col("gap") > tolerance, "r")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ord", "text"))), lambda s: s["text"]), "")
    weight = F.greatest(F.length("text"), F.lit(1))
    return rows.groupBy("book", "page", "r").agg(
        text.alias("text"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), (F.sum(F.col("size") * weight) / F.sum(weight)).alias("size"), F.count("*").alias("spans")
    )


def contents_pages(lines: DataFrame) -> Column:
    """Whether a line's page is one of contents: three leaders with pages, or headings with pages, or leaders of which one has its page."""
    w = W.partitionBy("book", "page")
    hits = lambda shape: F.count_if(F.col("text").rlike(shape)).over(w)
    leaders = hits(T.CONTENTS_LEADER)
    return (leaders >= 3) | (hits(T.CONTENTS_HEADING) >= 3) | ((hits(T.CONTENTS_DOTS) >= 3) & (leaders >= 1))


def classify_lines(lines: DataFrame, body: float, height: float) -> DataFrame:
    """(book, page, ord, kind): blank, header, page number, footnote or keep; contents pages lose their headers only.

    A header is a short line in the top band that is set small or reads as one; a footnote is a line in the foot band
    that is set small or is marked as one.
    """
    text = T.trimmed(T.strip_control(T.plain_yi(F.col("text"))))
    rows = lines.withColumns({"listed": contents_pages(lines), "t": text})
    t, small = F.col("t"), lambda factor: F.col("size").between(0.1, factor * body)
    header = F.col("y0").between(0, max(56.0, 0.12 * height)) & (F.length(t) <= 40) & (small(0.95) | T.header_like(t) | T.header_number_like(t))
    foot = (F.col("y0") >= 0.72 * height) & (small(0.85) | T.footnote_marked(t))
    kind = F.when(t == "", "blank").when(header, "header").when(F.col("listed"), "contents").when(T.page_number(t), "number").when(foot, "footnote").otherwise("keep")
    return rows.select("book", "page", "ord", kind.alias("kind"))


def paragraphs(lines: DataFrame, left: float, right: float, body: float, pitch: float | None) -> DataFrame:
    """(book, page, para, text, size, y0): lines joined to paragraphs; a break is decided from a line and the one before."""
    w = W.partitionBy("book", "page").orderBy("ord")
    before = F.lag(F.struct("text", "x1", "y0", "size")).over(w)
    rows = lines.withColumn("p", before)
    title = lambda size, text: (size >= TITLE_FACTOR * body) & (F.length(text) <= 40)
    dy = F.col("y0") - F.col("p.y0")
    ended, is_title, was_title = T.ends_sentence(F.col("p.text")) | F.col("p.text").rlike(r"[.!]$"), title(F.col("size"), F.col("text")), title(F.col("p.size"), F.col("p.text"))
    strong = ended & F.left("text", F.lit(6)).rlike(STRONG_NEW)
    top = F.col("x0") < left + INDENT * body
    indented = F.col("x0") >= left + INDENT * body
    full = F.col("p.x1") >= right - FULL_LINE * body
    wide = (dy > pitch) & (ended | (~full & indented)) if pitch is not None else F.lit(False)
    breaks = (
        F.when(F.col("p").isNull(), True).when(F.left("text", F.lit(1)).rlike(LEADING_NO_BREAK), False)
        .when(is_title, ~(was_title & (dy >= 0) & (dy <= 2.0 * F.col("p.size")))).when(was_title, True).when(dy < -Y_JUMP * F.greatest(F.col("p.size"), F.col("size")), True)
        .when(~strong & top & (F.col("p.x1") >= right - NEAR_FULL * body) & ended, False).when(wide, True).when(indented & ended, True)
        .when((F.col("x1") < right - SHORT_LINE * F.col("size")) & ended, True).when(F.lit(pitch is None) & ended, True).otherwise(False)
    )
    rows = islands(rows.withColumn("breaks", breaks), ["book", "page"], ["ord"], F.col("breaks"), "para")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])
    out = rows.groupBy("book", "page", "para").agg(texts.alias("texts"), F.max("size").alias("size"), F.min_by("y0", "ord").alias("y0"))
    return out.select("book", "page", "para", T.trimmed(T.soft_join(F.col("texts"))).alias("text"), "size", "y0").where("text <> ''")


def chapters(blocks: DataFrame, custom: str | None = None) -> DataFrame:
    """(book, chapter, title, first, blocks, chars): blocks split at the headings of the best grade found.

    Blocks before the first heading are chapter 0. blocks: book, idx, text.
    """
    c = T.trimmed(F.regexp_extract("text", r"^([^\n]*)", 1))
    rows = blocks.withColumns({"head": c, "style": F.when(T.title_candidate(c) | F.lit(custom is not None), T.title_style(c, custom))})
    # of a text only its length goes on, and of those that are headings the head; all the rest is one sort of a book's blocks
    rows = rows.select("book", "idx", F.length("text").alias("chars"), F.when(F.col("style").isNotNull(), F.col("head")).alias("head"), "style", T.title_grade(F.col("style")).alias("grade"))
    order = W.partitionBy("book").orderBy("idx")
    whole, before, so_far = (order.rowsBetween(W.unboundedPreceding, end) for end in (W.unboundedFollowing, -1, 0))
    rows = rows.withColumns({"best": F.min("grade").over(whole), "first_c": F.first(F.when(F.col("grade") == 3, F.col("style")), True).over(whole)})
    starts = F.coalesce((F.col("grade") == F.col("best")) & ((F.col("best") < 3) | (F.col("style") == F.col("first_c"))), F.lit(False))
    rows = rows.withColumn("starts", starts).withColumns(
        {"chapter": F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(so_far), "blocks": F.count("*").over(before), "told": F.count("chars").over(before), "sum": F.coalesce(F.sum("chars").over(before), F.lit(0))}
        | {"all_blocks": F.count("*").over(whole), "all_told": F.count("chars").over(whole), "all_sum": F.coalesce(F.sum("chars").over(whole), F.lit(0))}
    )
    # a chapter has what the next one, or the end, has before it and it has not
    own = {c: F.coalesce(F.lead(c).over(order), F.col(f"all_{c}")) - F.col(c) for c in ("blocks", "told", "sum")}
    firsts = rows.where("starts or blocks = 0").select("book", "chapter", F.when(F.col("starts"), F.col("head")).alias("title"), F.col("idx").alias("first"), *[v.alias(c) for c, v in own.items()])
    return firsts.select("book", "chapter", "title", "first", "blocks", F.when(F.col("told") > 0, F.col("sum")).alias("chars"))


def _in_order(df: DataFrame, group: str, order: str, start, step) -> DataFrame:
    """(group, order, block): a fold over the lengths of each group's texts in order, whose state is all that is held.

    start(): a group's first state; step(state, length) gives the block's number.
    """
    kinds = dict(df.dtypes)

    def run(batches):
        current, state = None, None
        for pdf in batches:
            out = []
            for g, n in zip(pdf["g"].tolist(), pdf["n"].tolist(), strict=True):
                if state is None or g != current:
                    current, state = g, start()
                out.append(step(state, n))
            yield pd.DataFrame({group: pdf["g"], order: pdf["o"], "block": out})

    rows = shipped(df).select(F.col(group).alias("g"), F.col(order).alias("o"), F.length("text").alias("n"))
    return rows.repartition("g").sortWithinPartitions("g", "o").mapInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, block int")


def greedy_blocks(df: DataFrame, group: str, order: str, most_chars: int, most_items: int) -> DataFrame:
    """(group, order, block): rows packed in order into blocks; a row too long for any stands alone."""

    def step(state: dict, n: int) -> int:
        long = n > most_chars
        if state["items"] and (long or state["alone"] or state["chars"] + n > most_chars or state["items"] + 1 > most_items):
            state.update(block=state["block"] + 1, chars=0, items=0)
        state.update(chars=state["chars"] + n, items=state["items"] + 1, alone=long)
        return state["block"]

    return _in_order(df, group, order, lambda: {"block": 0, "chars": 0, "items": 0, "alone": False}, step)


def blind_chapters(df: DataFrame, group: str, order: str, whole: int = 50_000, least: int = 3_000) -> DataFrame:
    """(group, order, block): a text without headings up to `whole` characters is one chapter, else each ends with the row that brings it to `least`."""

    def step(state: dict, n: int) -> int:
        block = state["block"]
        state["chars"] += n
        if state["chars"] >= least:
            state.update(block=block + 1, chars=0)
        return block

    cut = _in_order(df, group, order, lambda: {"block": 0, "chars": 0}, step)
    total = df.groupBy(group).agg((F.sum(F.length("text")) > whole).alias("long"))
    return cut.join(total, group).select(group, order, F.when(F.col("long"), F.col("block")).otherwise(0).alias("block"))


def _goes_on(a: str, b: str) -> bool:
    """Whether a page's last paragraph goes on with the next page's first.

    Neither is a mark or a heading, list item, table or figure; the one before is no line of a colophon, has 12 characters and
    ends within a sentence. Besides Chinese characters Latin letters are words, of which the second begins with a small one.
    """
    within = len(a) >= 12 and re.match("[一-鿿a-zA-Z，、：]", a[-1]) and re.match("[一-鿿a-z]", b)
    return bool(within) and not any(x.startswith("〔") or SEAM_HEAD.match(x) for x in (a, b)) and not COLOPHON.search(a)


def stitched(pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(book, page, paras, chars, texts, tail, head): pages (book, page, paras) with paragraphs cut by a page's end joined to their beginning.

    The rest of a paragraph is the first one of the page numbered next, which loses it; empty and null ones are dropped. paras
    and chars count what a page has then, texts. tail and head are 14 characters on both sides of a seam, null where a page's
    end has none. done: (book, page) of pages joined to the next before, which are not joined again.

    Sequential in a book: a page that gives its only paragraph away changes the next decision. One page is held at a time.
    """

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for book, page, paras, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = {"book": book, "page": page, "texts": [x for x in paras or [] if x], "before": before}
                if held and held["book"] == book and held["page"] is not None and held["page"] + 1 == page and not held["before"] and held["texts"] and now["texts"]:
                    a, b = held["texts"][-1], now["texts"][0]
                    if _goes_on(a, b):
                        held["texts"][-1] = a + (" " if a[-1].isascii() and b[0].isascii() else "") + b
                        held |= {"tail": a[-14:], "head": b[:14]}
                        del now["texts"][0]
                if held:
                    out.append(held)
                held = now
            if out:
                yield measured(out)
        if held:
            yield measured([held])

    def measured(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r | {"paras": len(r["texts"]), "chars": sum(map(len, r["texts"]))} for r in rows], STITCHED)

    marks = done.select("book", "page").distinct().withColumn("before", F.lit(True)) if done is not None else None
    rows = pages.select("book", "page", "paras")
    rows = rows.withColumn("before", F.lit(False)) if marks is None else rows.join(marks, ["book", "page"], "left")
    rows = shipped(rows).repartition("book").sortWithinPartitions("book", "page")
    return rows.mapInArrow(run, "book long, page int, paras int, chars long, texts array<string>, tail string, head string")


def stitch(pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(book, page, paras, chars) of stitched pages."""
    return stitched(pages, done).select("book", "page", "paras", "chars")


def merge_fragments(lines: DataFrame, reach: float = 15.0) -> DataFrame:
    """C17: (book, page, ord, into): short lines of a page merged into the nearest longer one, of equally near ones the first.

    Lines meet in bands as high as the reach, so that a crowded page is many small groups.
    """
    band = F.floor(F.col("y0") / reach)
    short = F.length("text") < 8
    small = lines.where(short).select("book", "page", F.col("ord").alias("s"), F.col("y0").alias("ys"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    large = lines.where(~short).select("book", "page", F.col("ord").alias("b"), F.col("y0").alias("yb"), band.alias("band"))
    away = F.abs(F.col("ys") - F.col("yb"))
    near = small.join(large, ["book", "page", "band"]).where(away <= reach).groupBy("book", "page", F.col("s").alias("ord")).agg(F.min_by("b", F.struct(away, "b")).alias("b"))
    return lines.select("book", "page", "ord").join(near, ["book", "page", "ord"], "left").select("book", "page", "ord", F.coalesce("b", "ord").alias("into"))


def match_in_band(entries: DataFrame, found: DataFrame, band: int) -> DataFrame:
    """(book_id, entry, chapter): each entry, in page order, takes the nearest chapter within the band that is left.

    Entries of a page and chapters of a page are numbered, and only how many there are on each page of a book goes to
    the greedy choice; its runs of numbers are then joined back.
    """
    nth = lambda by, o: F.row_number().over(W.partitionBy("book_id", by).orderBy(o)) - 1
    ones, twos = entries.withColumn("i", nth("page", "entry")), found.withColumn("j", nth("start", "chapter"))
    count = lambda df, at, side: df.groupBy("book_id", F.col(at).alias("at")).agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    counts = count(entries, "page", 0).unionByName(count(found, "start", 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {int(r.at): [0, int(r.n)] for r in pdf[pdf.side == 1].itertuples()}
        out = []
        for r in pdf[pdf.side == 0].sort_values("at").itertuples():
            done = 0
            for away in range(band + 1):
                for at in sorted({r.at - away, r.at + away}):
                    used, of = left.get(at, (0, 0))
                    n = min(r.n - done, of - used)
                    if n > 0:
                        out.append((r.book_id, r.at, done, at, used, n))
                        left[at][0] += n
                        done += n
        return pd.DataFrame(out, columns=["book_id", "page", "i0", "start", "j0", "n"])

    runs = shipped(counts).groupBy("book_id").applyInPandas(run, "book_id long, page int, i0 long, start int, j0 long, n long")
    each = runs.select("book_id", "page", "start", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k", "_"), "i0", "j0")
    each = each.select("book_id", "page", "start", (F.col("i0") + F.col("k")).alias("i"), (F.col("j0") + F.col("k")).alias("j"))
    return each.join(ones, ["book_id", "page", "i"]).join(twos, ["book_id", "start", "j"]).select("book_id", "entry", "chapter")


class Titles:
    """Titles (entry, title), one after another as bits of one number, so that a text meets all of them at once."""

    #: Titles from this length on have characters that SequenceMatcher leaves out as too frequent.
    JUNK = 200

    def __init__(self, titles: list[tuple[int, str]]):
        self.titles, self.entries = [t for _, t in titles], np.array([e for e, _ in titles])
        self.lengths = np.array([len(t) for t in self.titles])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])  # above each title a bit takes its carry
        self.size = int((self.lengths + 1).sum()) // 8 + 1
        self.places = _places("\0".join(self.titles))
        self.places["\0"] = self.places.get("\0", 0) & ~sum(1 << at - 1 for at in self.starts[1:].tolist())
        self.all = sum(self.places.values())
        self.matchers = {k: difflib.SequenceMatcher(None, "", t) for k, t in enumerate(self.titles) if len(t) >= self.JUNK}

    def bounds(self, text: str) -> np.ndarray:
        """For each title the ratio that the longest common subsequence would have: matching blocks are a common one."""
        free = self.all
        for at in map(self.places.get, text):
            if at:
                met = free & at
                free = (free + met | free - met) & self.all
        bits = np.unpackbits(np.frombuffer(free.to_bytes(self.size, "little"), np.uint8), bitorder="little")
        total = len(text) + self.lengths
        return np.where(total > 0, 2.0 * (self.lengths - np.add.reduceat(bits, self.starts, dtype=np.int64)) / np.maximum(total, 1), 1.0)

    def best(self, text: str) -> tuple[float, int]:
        """(ratio, -entry) of the title most like the text, of equals of the least entry."""
        bound, best, places = self.bounds(text), (-1.0, 0), _places(text)
        for k in np.lexsort((self.entries, -bound)).tolist():
            entry = int(self.entries[k])
            if (bound[k], -entry) < best:
                break
            if k in self.matchers:
                self.matchers[k].set_seq1(text)
                ratio = self.matchers[k].ratio()
            else:
                ratio = _block_ratio(places, len(text), self.titles[k], best[0])
            best = max(best, (ratio, -entry))
        return best


def _places(text: str) -> dict[str, int]:
    """The places of each character as bits."""
    at: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        at.setdefault(c, []).append(i)
    out = {}
    for c, found in at.items():
        bits = bytearray(len(text) // 8 + 1)
        for i in found:
            bits[i >> 3] |= 1 << (i & 7)
        out[c] = int.from_bytes(bits, "little")
    return out


def _block_ratio(places: dict[str, int], n: int, title: str, least: float) -> float:
    """SequenceMatcher's ratio of a text of n characters and a title shorter than Titles.JUNK; 0 once it is below least.

    runs[k - 1]: for each place of the title the places of the text, as bits, where runs of k characters end that are
    equal up to these. The longest run within a stretch, the first of the text, then of the title, leaves two stretches.
    """
    total = n + len(title)
    if not total:
        return 1.0
    runs: list[tuple[list[int], list[int]]] = []
    level = [(j, at) for j, at in enumerate(map(places.get, title)) if at]
    while level:
        runs.append(([j for j, _ in level], [at for _, at in level]))
        level = [(j + 1, on) for j, at in level if j + 1 < len(title) and (on := at << 1 & places.get(title[j + 1], 0))]
    sure, may = 0, min(n, len(title))
    todo = [(0, n, 0, len(title), len(runs), may)]
    while todo:
        alo, ahi, blo, bhi, most, size = todo.pop()
        may -= size
        for k in range(min(most, size), 0, -1):
            ends, at = runs[k - 1]
            first, j, inside = n + 1, 0, (1 << ahi - alo - k + 1) - 1
            for x in range(bisect_left(ends, blo + k - 1), bisect_left(ends, bhi)):
                held = at[x] >> alo + k - 1 & inside
                if held and (low := (held & -held).bit_length()) < first:
                    first, j = low, ends[x] - k + 1
            if first <= n:
                i = alo + first - 1
                sure += k
                for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                    if size := min(part[1] - part[0], part[3] - part[2]):
                        todo.append((*part, k, size))
                        may += size
                break
        if 2.0 * (sure + may) / total < least:
            return 0.0
    return 2.0 * sure / total


def most_similar(texts: DataFrame, entries: DataFrame, block: int = 1000, share: int = 1000) -> DataFrame:
    """(id, entry, ratio): for each text the entry most like it by matching blocks, of equals the least.

    Equal texts are one, and equal titles; nulls are empty. Every text meets the entries block by block: a task reads one
    block, then its share of the texts, row by row. Entries are compared from the greatest bound on, while it reaches the
    best so far.
    """
    each = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    asked, titles = each.select("text").distinct(), entries.groupBy(F.coalesce("title", F.lit("")).alias("text")).agg(F.min("entry").alias("entry"))
    blocks = max(1, -(-titles.count() // block))
    shares = max(1, -(-asked.count() // share), 4 * texts.sparkSession.sparkContext.defaultParallelism // blocks)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    titles = titles.select("text", "entry", of(blocks).alias("block"), numbers(shares).alias("share"))
    asked = asked.select("text", F.lit(None).cast("long").alias("entry"), numbers(blocks).alias("block"), of(shares).alias("share"))
    dealt = titles.unionByName(asked).select("text", "entry", (F.col("block") * shares + F.col("share")).alias("task"))
    dealt = shipped(dealt).repartitionById(blocks * shares, "task").sortWithinPartitions(F.col("entry").isNull())

    def run(batches):
        held, known = [], None
        for pdf in batches:
            mine = pdf["entry"].notna()
            held += zip(pdf["entry"][mine].astype("int64").tolist(), pdf["text"][mine].tolist(), strict=True)
            found = []
            for text in pdf["text"][~mine].tolist():
                known = known or (Titles(held) if held else None)
                if known:
                    found.append((text, *known.best(text)))
            if found:
                yield pd.DataFrame(found, columns=["text", "ratio", "minus"])

    found = dealt.mapInPandas(run, "text string, ratio double, minus long").groupBy("text").agg(F.max(F.struct("ratio", "minus")).alias("best"))
    return each.join(found, "text").select("id", (-F.col("best.minus")).alias("entry"), F.round("best.ratio", 9).alias("ratio"))


def _numbered(c: Column) -> Column:
    """A string's characters, each with how often it stood before: sets of these meet in what multisets of characters share."""
    each = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(each, lambda x, i: F.concat(x, F.size(F.filter(F.slice(each, 1, i), lambda y: y == x)).cast("string")))


def similar_titles(asked: DataFrame, pool: DataFrame, least: float) -> DataFrame:
    """(book, a, b, ratio): the pairs of a book's a of asked and b of pool whose ratio by matching blocks is `least` or more.

    Matching blocks hold no more than the characters that both have. So, with characters ordered from rare to common in the
    book, two such strings share one of the first of each, and pairs meet by (book, character) of these only; where the
    shared characters are enough for the ratio, it is computed. Empty and null strings are like none; repeated ones are one.
    """
    held = [df.select("book", F.col(c).alias("s"), F.lit(c).alias("side")).where("s <> ''").distinct() for df, c in ((asked, "a"), (pool, "b"))]
    tokens = held[0].unionByName(held[1]).select("book", "s", "side", F.explode(_numbered(F.col("s"))).alias("token"))
    counts = tokens.groupBy("book", "token").agg(F.count("*").alias("often"))
    ranked = tokens.join(counts, ["book", "token"]).groupBy("book", "s", "side").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("tokens"))
    needed = F.ceil(F.size("tokens") * F.lit(least / (2 - least)) - 1e-9)
    lead = F.slice("tokens", 1, (F.size("tokens") - needed + 1).cast("int"))
    leads = written(ranked.select("book", "s", "side", F.explode(F.transform(lead, lambda x: x["token"])).alias("token")), "title-leads")
    first, second = (leads.where(F.col("side") == c).select("book", "token", F.col("s").alias(c)) for c in "ab")
    pairs = first.join(second, ["book", "token"]).select("book", "a", "b").distinct()
    shared = F.size(F.array_intersect(_numbered(F.col("a")), _numbered(F.col("b"))))
    pairs = pairs.where(2 * shared >= F.lit(least - 1e-9) * (F.length("a") + F.length("b")))

    def run(batches):
        for pdf in batches:
            pdf["ratio"] = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf[pdf["ratio"] >= least]

    kinds = dict(pairs.dtypes)
    return shipped(pairs).mapInPandas(run, f"book {kinds['book']}, a string, b string, ratio double")


def offset_of_anchors(chapters_: DataFrame) -> DataFrame:
    """C11: (book_id, page_offset, sure): the first, middle and last entry agree on an offset, two give their rounded mean."""
    w = W.partitionBy("book_id")
    a = chapters_.select("book_id", F.expr("start_page - idx").alias("d"), F.row_number().over(w.orderBy("idx")).alias("k"), F.count("*").over(w).alias("n"))
    s = a.where("k = 1 or k = n div 2 + 1 or k = n").groupBy("book_id").agg(F.count("*").alias("c"), F.median("d").alias("mid"), F.avg("d").alias("mean"), (F.max("d") - F.min("d")).alias("spread"))
    sure = F.expr("c = 3 and spread <= 1")
    return s.select("book_id", F.when(sure, F.floor("mid").cast("int")).when(F.col("c") == 2, F.floor(F.col("mean") + 0.5).cast("int")).alias("page_offset"), sure.alias("sure"))


def pack_text(lines: DataFrame) -> DataFrame:
    """IO14: (book, packed): a book's pages as one text with page marks, in order."""
    in_order = lambda o, c: F.transform(F.sort_array(F.collect_list(F.struct(o, c))), lambda s: s[c])
    pages = lines.groupBy("book", "page").agg(F.array_join(in_order("ord", "text"), "\n").alias("body"))
    marked = pages.select("book", "page", F.concat(F.lit("〔页"), F.col("page").cast("string"), F.lit("〕\n"), "body").alias("part"))
    return marked.groupBy("book").agg(F.array_join(in_order("page", "part"), "\n").alias("packed"))


def unpack_text(packed: DataFrame) -> DataFrame:
    """IO16: (book, page, ord, text): the non-blank lines of a packed text under their page mark."""
    lines = packed.select("book", F.posexplode(F.split("packed", "\n", -1)).alias("ord", "text"))
    mark = F.regexp_extract("text", T.PAGE_MARK, 1)
    page = F.last(F.when(mark != "", mark.cast("int")), True).over(W.partitionBy("book").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("page", page).where(mark == "").where("trim(text) <> ''").select("book", "page", "ord", "text")


def page_ranges(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """IO22: the pages that an expression such as "1-3,7" names, within bounds."""
    part = F.explode(F.split(F.regexp_replace(column, r"\s", ""), ",")).alias("part")
    ends = F.split("part", "-")
    first, last = ends[0].cast("int"), F.element_at(ends, -1).cast("int")
    return df.select(part).select(F.explode(F.sequence(F.greatest(first, F.lit(low)), F.least(last, F.lit(high)))).alias("page"))
