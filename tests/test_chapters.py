"""Chapters of blocks against a walk over each book, block by block."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import chapters as H
from folio.plans import books
from folio.sources.roles import table

SF = "/root/testdata/sf0.001"
MARK = "〔标题〕"


def facts_of(spark, lines, custom):
    """What the line functions say of each line; the walk below needs no pattern of its own."""
    df = spark.createDataFrame([(x,) for x in sorted(lines)], "line string").withColumn("t", T.trimmed(F.col("line")))
    style = F.when(T.title_candidate(F.col("t")), T.title_style(F.col("t"), custom))
    strong = F.col("t").rlike(f"{T.TITLE_A_HAN}|{T.TITLE_B}") | F.col("t").isin(T.FIXED_TITLES)
    cut = F.when(style == "A_HAN_SUB", T.subtitle_cut(F.col("t")))
    rows = df.select("line", "t", style.alias("style"), T.title_grade(style).alias("grade"), T.contents_line(F.col("t")).alias("dot"), strong.alias("strong"), F.coalesce(cut, "t").alias("title"), T.role_of(F.coalesce(cut, "t")).alias("role"))
    return {r.line: r for r in rows.collect()}


def is_list(lines, facts):
    held = [facts[x] for x in lines if facts[x].t]
    return any(f.dot for f in held) and 2 * sum(f.dot or f.strong for f in held) >= len(held)


def walk(blocks, facts, custom, sized):
    """Titles of the chapters with the blocks that each holds, None for a book without headings."""
    last, book = None, []
    for idx, lines in blocks:
        marks = [int(x.strip()[2:-1]) for x in lines if x.strip().startswith("〔页")]
        lines = [x for x in lines if not x.strip().startswith("〔页")]
        page = marks[0] if marks else last
        last = marks[-1] if marks else last
        listed = bool(lines) and lines[0].strip() == "〔目录〕"
        lines = lines[1:] if listed else lines
        if lines:
            big = [not sized or x.lstrip().startswith(MARK) for x in lines]
            book.append((idx, page, listed, [x.lstrip().removeprefix(MARK) if sized and x.lstrip().startswith(MARK) else x for x in lines], big))
    region, end, anchor = None, None, -1
    if not custom:
        named = [(i, j) for i, b in enumerate(book) for j, x in enumerate(b[3]) if x.strip() in ("目录", "目次") or x.strip().lower() == "contents"]
        dense = [(i, -1) for i, b in enumerate(book) if is_list(b[3], facts) and sum(facts[x].dot for x in b[3]) >= 3]
        if named or dense:
            region, anchor = (named or dense)[0]
            end = region
            while end + 1 < len(book) and is_list(book[end + 1][3], facts):
                end += 1
    inside = lambda i: region is not None and region <= i <= end
    hits = {}
    for i, (_, _, listed, lines, big) in enumerate(book):
        for j, x in enumerate(lines):
            f = facts[x]
            if listed or not f.style or (inside(i) and (i, j) != (region, anchor)) or not (big[j] or f.grade == 3 or f.style == "CUSTOM"):
                continue
            hits[i] = (j, f)
            break
    if not hits:
        return None
    best = min(f.grade for _, f in hits.values())
    style = next((f.style for _, (_, f) in sorted(hits.items()) if f.grade == 3), None)
    top = {i: h for i, h in hits.items() if h[1].grade == best and (best < 3 or h[1].style == style)}
    found, title, before = [], "开篇", "开篇"  # (title, block, has content)
    for i, (idx, page, listed, lines, _) in enumerate(book):
        rest = lines
        if i in top:
            j, f = top[i]
            title = before = f.title
            rest = lines[:j] + lines[j + 1 :]
        elif inside(i):
            title = title if anchor >= 0 else "目录"
        elif lines[0].strip().startswith("〔脚注〕"):
            found.append((title, idx))
            continue
        elif listed or is_list(lines, facts):
            title = "目录"
        elif title == "目录":
            before = title = "开篇" if before == "目录" else before
        if any(facts[x].t for x in rest):
            found.append((title, idx))
    cut = []
    for t, idx in found:
        if cut and cut[-1][0] == t:
            cut[-1][1].append(idx)
        else:
            cut.append((t, [idx]))
    merged = []
    for t, held in cut:
        at = len(merged) - (2 if len(merged) > 1 and merged[-1][0] == "目录" and merged[-2][0] == t else 1)
        if at >= 0 and merged[at][0] == t:
            merged[at][1].extend(held)
        else:
            merged.append((t, list(held)))
    return [(t, min(held), len(held)) for t, held in merged]


def check(spark, blocks, custom=None, sized=False):
    given = {}
    for r in blocks.collect():
        given.setdefault(r.book, []).append((r.idx, r.lines))
    lines = {x for b in given.values() for _, ls in b for x in ls}
    facts = facts_of(spark, lines | {x.lstrip().removeprefix(MARK) for x in lines}, custom)
    want = {book: w for book, b in given.items() if (w := walk(sorted(b), facts, custom, sized))}
    got = {}
    for r in H.parse(blocks, custom, sized).chapters.orderBy("book", "chapter").collect():
        got.setdefault(r.book, []).append((r.title, r["first"], r.blocks))
    assert got == want
    return want


def test_registered_blocks(spark):
    want = check(spark, books.marked_blocks(lambda n: table(spark, SF, n)))
    assert any("目录" in [t for t, _, _ in w] for w in want.values()) and max(map(len, want.values())) > 3


@pytest.mark.parametrize(("custom", "sized"), [(None, False), (None, True), ("^卷[一二三]", False)])
def test_made_up_books(spark, custom, sized):
    rng = random.Random(f"{custom}{sized}")
    kinds = [
        ["第一章 总则"], [f"{MARK}第二章 权利"], ["第一章 总则", "一段正文。"], ["目录"], ["目 录", "第一章 总则……1"], ["第一章 总则……1", "第二章 权利……9", "12"], ["〔目录〕", "碎行", "又一行"], ["〔脚注〕参见某书"],
        ["正文在这里，很长。"], ["〔页3〕"], ["〔页4〕", "另一段正文。"], ["一、小题"], ["（一）小题", "正文。"], ["Contents"], ["附录"], ["卷一", "内容。"], ["", "　"], ["第三节 物", "甲"], ["正文一行。", "第九章 继承"],
    ]
    rows = [(b, i, rng.choice(kinds[: rng.choice([9, len(kinds)])])) for b in range(60) for i in range(rng.randrange(1, 22))]
    want = check(spark, spark.createDataFrame(rows, "book long, idx long, lines array<string>"), custom, sized)
    assert len(want) > 10


def test_pages_roles_and_notes(spark):
    lines = [["〔页7〕", "序言"], ["甲", "乙。"], ["〔脚注〕注一"], ["目录"], ["第一章 总则……1", "第二章 权利……9"], ["〔页9〕", "第一章 总则", None, "正文。"], ["尾。"]]
    book = H.parse(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "book long, idx long, lines array<string>"))
    got = [tuple(r) for r in book.paragraphs.orderBy("idx", "n").select("idx", "title", "role", "page", "text").collect()]
    assert got == [
        (1, "序言", "FRONT", 7, "甲乙。"), (2, "序言", "FOOTNOTE", 7, "注一"), (4, "目录", "TOC", 7, "第一章 总则……1"), (4, "目录", "TOC", 7, "第二章 权利……9"),
        (5, "第一章 总则", "BODY", 9, "正文。"), (6, "第一章 总则", "BODY", 9, "尾。"),
    ]
    assert H.parse(spark.createDataFrame([], "book long, idx long, lines array<string>")).chapters.count() == 0


def test_lines_are_judged_once(spark):
    """Chapters and paragraphs of blocks start from what was written of them, and texts are not sorted by their marks."""
    blocks = spark.createDataFrame([(1, 0, ["〔页3〕", "第一章 甲"]), (1, 1, ["正文一二三"])], "book long, idx long, lines array<string>")
    plan = H._unmarked(blocks, False)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window" in line and "__bucket" in line)
    assert "LogicalRDD" not in plan and "lines" not in window
    assert [r.text for r in H.parse(blocks).paragraphs.collect()] == ["正文一二三"]
