"""Proofreading, contents and packed books: small texts, and choices in order against plain loops."""

import difflib
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import documents as D
from folio.operators import kit as K
from folio.operators import proofread as P
from folio.plans import proof
from folio.sources.roles import table

SF = "/root/testdata/sf0.001"
LINE = "book long, page int, ord int, text string"


def each(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", function(F.col("text")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_repairs(spark):
    assert each(spark, P.fix_note_tail, ["债之关系。专", "他说。心理学", "完。竺此外", "完。专题", None]) == ["债之关系。", "他说。心理学", "完。此外", "完。专题", None]
    assert each(spark, P.fix_ocr, ["有助于千台湾", "一千人", "致力千研究", "完＠。", "心甲乙", "心理学"]) == ["有助于台湾", "一千人", "致力于研究", "完。", "●甲乙", "心理学"]
    assert each(spark, P.fix_quotes, ["“甲“乙", "“甲", "｀甲｀乙", "“ 甲 ”乙“丙“"]) == ["“甲”乙", "“甲", "“甲”乙", "“甲”乙“丙”"]
    assert each(spark, P.fix_confused, ["知已知彼", "知已", "淮据法"]) == ["知己知彼", "知已", "准据法"]


def test_junk(spark):
    assert each(spark, P.junk_paragraph, ["勹甲乙", "勹甲，乙", "勹甲，＄乙", "第一章 勹", "〔图：勹＄〕", "甲乙", "", "勹" + "甲" * 40]) == [True, False, True, False, False, False, False, False]


def test_rules_page(spark):
    rows = [(1, 1, 0, "勹＄"), (1, 1, 1, "正文。专"), (1, 2, 0, "勹＄"), (1, 2, 1, "〔图：x〕"), (1, 3, 0, "好的")]
    got = {(r.page, r.ord): (r.text, r.flagged) for r in P.rules_page(spark.createDataFrame(rows, LINE)).collect()}
    assert got == {(1, 1): ("正文。", True), (2, 0): ("勹＄", True), (2, 1): ("〔图：x〕", True), (3, 0): ("好的", False)}


def test_titles(spark):
    texts = ["第一章 总则", "第一章 总则，分则", "第一章 总则 12", "前 言", "前言：说明", "序", "索 引", "第二节 债", "普通的一行", "第三次 推论是什么？", "说明。"]
    assert each(spark, P.title_kind, texts) == ["num", None, None, "front", "front", "front", "back", "sec", None, "num", None]
    assert each(spark, T.front_title, ["第二版序", "修订版序言", "写在前面的话", "序三", "丛书总序", "他的序"]) == [True, True, True, True, True, False]
    assert each(spark, T.front_entry, ["写在前面——致读者", "总序（2003年）", "", "第3版的话", "正文" * 8]) == [True, True, False, True, False]


def test_lines_of_pages(spark):
    """A number in mid page is no header; a marked note of body size is one; lone numbers make no contents page."""
    rows = [(1, 1, 0, "书名", 10.0, 9.0), (1, 1, 1, "第三章 民法 12", 250.0, 10.0), (1, 1, 2, "①见前注", 450.0, 10.0), (1, 1, 3, "12", 480.0, 10.0), (1, 1, 4, "13", 485.0, 10.0), (1, 1, 5, "14", 490.0, 10.0)]
    rows += [(1, 2, i, f"甲乙……{i}", 100.0 + i, 10.0) for i in range(3)] + [(1, 2, 3, "15", 300.0, 10.0), (1, 2, 4, "页眉", 5.0, 8.0)]
    lines = spark.createDataFrame(rows, LINE + ", y0 double, size double")
    got = {(r.page, r.ord): r.kind for r in D.classify_lines(lines, 10.0, 500.0).collect()}
    assert [got[1, i] for i in range(6)] == ["header", "keep", "footnote", "number", "number", "number"]
    assert [got[2, i] for i in range(5)] == ["contents"] * 4 + ["header"]


def test_contents(spark):
    rows = [(1, 3, 0, "目 录"), (1, 3, 1, "总则…1"), (1, 4, 0, "债法…20"), (1, 4, 1, "物权（30）"), (1, 5, 0, "这是正文。"), (1, 6, 0, "债法…20"), (1, 6, 1, "物权…30")]
    got = sorted((r.page, r.entry, r.printed) for r in P.detect_contents(spark.createDataFrame(rows, LINE)).collect())
    assert got == [(3, "总则", 1), (4, "债法", 20), (4, "物权", 30)]
    rows = [(1, 1, i, t) for i, t in enumerate(["第一节", "请求权……107", "第二节 抗辩……", "159", "88", "后记"])]
    got = sorted((r.entry, r.text) for r in P.contents_entries(spark.createDataFrame(rows, LINE)).collect())
    assert [t for _, t in got] == ["第一节请求权……107", "第二节 抗辩…… 159", "后记"]


def test_chapters_of_a_book(spark):
    """Titles, quoted ones, volumes, rulings; then entries without a chapter, gaps and thin chapters."""
    body = "正文" * 30
    pages = {
        1: ["封面"], 2: ["目 录", "第一章 总则 1", "第二章 债法 5", "第五章 物权 9"], 3: ["前言", body], 4: ["第一章 总则", "第一节 起点", body],
        5: ["第七章 引述", "第八章 引述", body], 6: ["第二编 分则", "第三章 扉页"], 8: ["第二章 债法", body], 9: ["第四章 薄", "少"], 10: ["后记", body], 11: ["前言", body],
    }
    lines = spark.createDataFrame([(1, p, i, t) for p, texts in pages.items() for i, t in enumerate(texts)], LINE)
    rulings = spark.createDataFrame([(1, 10, "后记", "RENAME", "后记一"), (1, 11, "前言", "DROP", ""), (1, 7, "补章", "ADD", "补章")], P.RULINGS)
    chapters = P.scan_chapters(lines, rulings)
    got = [(r.title, r.page, r.level, r.role) for r in sorted(chapters.collect(), key=lambda r: r.n)]
    assert got == [
        ("开篇", 1, 1, "FRONT"), ("目录", 2, 1, "TOC"), ("前言", 3, 1, "FRONT"), ("第一章 总则", 4, 1, "BODY"), ("第一节 起点", 4, 2, "BODY"), ("第二编 分则", 6, 1, "BODY"), ("补章", 7, 1, "BODY"),
        ("第二章 债法", 8, 1, "BODY"), ("第四章 薄", 9, 1, "BODY"), ("后记一", 10, 1, "BACK"),
    ]
    warnings = sorted((r.kind, r.page, r.what) for r in P.reconcile(lines, P.scan_chapters(lines), P.detect_contents(lines)).where("kind <> 'gap'").collect())
    assert warnings == [("thin", 6, "第二编 分则"), ("thin", 9, "第四章 薄"), ("toc_miss", 12, "第五章 物权")]
    numbered = spark.createDataFrame([(1, p, 0, f"第{z}章 甲") for p, z in ((1, "一"), (2, "二"), (4, "五"))] + [(1, 1, 1, body), (1, 2, 1, body), (1, 4, 1, body)], LINE)
    assert [(r.kind, r.what) for r in P.reconcile(numbered, P.scan_chapters(numbered), P.detect_contents(numbered)).orderBy("what").collect()] == [("gap", "3"), ("gap", "4")]


def brute_titles(asked, pool, least):
    pairs = {(k, a, b) for k, a in asked for j, b in pool if j == k and a and b}
    return {(k, a, b, round(r, 9)) for k, a, b in pairs if (r := difflib.SequenceMatcher(None, a, b).ratio()) >= least}


@pytest.mark.parametrize("least", [0.55, 0.8, 1.0])
def test_similar_titles(spark, least):
    rng = random.Random(least)
    title = lambda: "".join(rng.choices("甲乙丙丁戊己庚辛一二", k=rng.randrange(0, 9)))
    asked, pool = ([(k, rng.choice([title(), title(), None])) for k in range(4) for _ in range(60)] for _ in "ab")
    pool += [(k, a and a[:2] + "壬" + a[2:]) for k, a in asked[::3]] + [(9, "甲")]
    df = D.similar_titles(spark.createDataFrame(asked, "book long, a string"), spark.createDataFrame(pool, "book long, b string"), least)
    assert sorted((*r[:3], round(r.ratio, 9)) for r in df.collect()) == sorted(brute_titles(asked, pool, least))


def test_registered_titles(spark):
    asked, pool = (sorted(map(tuple, df.collect())) for df in proof.titles_of(lambda n: table(spark, SF, n)))
    want = brute_titles(asked, pool, 0.7)
    assert sorted(map(tuple, proof.QUERIES["J18_similar_titles"](spark, SF).collect())) == sorted(want)


def test_registered_reconciliation(spark):
    """Missed entries against a loop over each book's entries and headings."""
    han = table(spark, SF, "han")
    entries, heads = P.detect_contents(han).collect(), P.scan_chapters(han).where("role <> 'TOC'").collect()
    bare = {t: re.sub(r"[\s·•.。:：、，,;；\-—…（）()「」『』〔〕\[\]]+", "", t) for t in {*(e.entry for e in entries), *(h.title for h in heads)}}
    want = []
    for book in {e.book for e in entries}:
        pool = sorted((h.n, bare[h.title], h.page) for h in heads if h.book == book)
        near, rows = {}, sorted((e.page, e.ord, e.entry, e.printed) for e in entries if e.book == book)
        for i, (_, _, entry, _) in enumerate(rows):
            best = max(((difflib.SequenceMatcher(None, bare[entry], t).ratio(), -n, page) for n, t, page in pool), default=(0, 0, 0))
            if bare[entry] and best[0] >= 0.55:
                near[i] = best[2]
        offsets = [page - rows[i][3] for i, page in near.items()]
        d = statistics.mode(offsets) if offsets else None
        want += [(book, None if d is None else r[3] + d, r[2]) for i, r in enumerate(rows) if i not in near]
    got = P.reconcile(han, P.scan_chapters(han), P.detect_contents(han)).where("kind = 'toc_miss'").select("book", "page", "what").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_edits(spark):
    lines = spark.createDataFrame([(1, 1, 0, "甲乙丙"), (1, 1, 1, "甲丁"), (1, 1, 2, "〔图：戊〕"), (1, 1, 3, "删去")], LINE)
    edits = [(1, 1, 0, "乙", "己"), (1, 1, 1, "甲", "庚"), (1, 1, 2, "戊", "辛"), (1, 1, 3, "删去", ""), (1, 1, 4, "丁", "丁丁丁丁丁丁"), (1, 1, 5, "乙", "壬")]
    got = P.apply_edits(lines, spark.createDataFrame(edits, "book long, page int, n int, find string, replace string"))
    assert sorted((r.ord, r.text) for r in got.collect()) == [(0, "甲己丙"), (1, "甲丁"), (2, "〔图：戊〕")]


def test_joined(spark):
    rows = [(1, 1, i, t) for i, t in enumerate(["甲乙", "丙丁", "", "第一章 总则", "one", "two", "（一）戊", "己"])]
    got = sorted((r.para, r.text) for r in P.join_lines(spark.createDataFrame(rows, LINE)).collect())
    assert [t for _, t in got] == ["甲乙丙丁", "第一章 总则", "one two", "（一）戊", "己"]


def test_highlights(spark):
    paragraphs = spark.createDataFrame([(1, 0, "第一节 债", "TOC"), (1, 1, "第一节债与物", "BODY"), (1, 2, "第一节 债", "BODY"), (2, 0, "第二节很长的", "BODY"), (2, 1, "第二节 长", "BODY")], "chapter_id long, idx int, text string, role string")
    wanted = spark.createDataFrame([(1, "第一节债"), (2, "第二节"), (3, "无"), (1, "")], "chapter_id long, highlight string")
    assert sorted(map(tuple, P.find_highlight(paragraphs, wanted).collect())) == [(1, 2), (2, 1)]


def test_numbers(spark):
    rows = spark.createDataFrame([(1000, 800, 100, 100), (90, 90, 100, 100), (400, 5000, 100, 100), (1600, 1600, 100, 100)], "w int, h int, a int, b int")

    def plain(w, h, a, b):
        size = 1
        while (w > a or h > b) and w // 2 // size >= a and h // 2 // size >= b:
            size *= 2
        return size

    assert [r.v for r in rows.select(P.sample_size(*map(F.col, "whab")).alias("v")).collect()] == [plain(*r) for r in rows.collect()]
    eta = spark.createDataFrame([(100, 10, 2, 9000), (100, 10, 3, 9000)], "t int, p int, d int, ms int").select(P.eta_seconds(*map(F.col, ("t", "p", "d", "ms"))).alias("v"))
    assert [r.v for r in eta.collect()] == [112, 270]


def test_strip_title(spark):
    rows = spark.createDataFrame([("第三节 代理终止第一百条", "第三节代理终止"), ("另一行", "第三节"), ("甲.乙", "甲."), ("标题", "标 题"), ("x", "")], "line string, title string")
    assert [r.v for r in rows.select(K.strip_title(F.col("line"), F.col("title")).alias("v")).collect()] == ["第一百条", "另一行", "乙", "", "x"]


def test_kit(spark):
    lines = [(0, 1, "封面"), (1, 2, "目 录"), (1, 2, "第一章 总则…9"), (2, 9, "第一章 总则"), (3, 9, "第一节 起点本节正文"), (3, 9, "续行"), (4, 10, "〔图：甲〕"), (5, 10, "〔脚注〕注文"), (6, 12, "第二章 债"), (7, 12, "债的正文")]
    lines = spark.createDataFrame([(1, b, p, i, t) for i, (b, p, t) in enumerate(lines)], "book long, block long, page int, ord int, text string")
    chapters = [(0, "目录", 2, "目录", 1, "TOC"), (1, "第一章 总则", 9, "第一章 总则", 1, "BODY"), (2, "第一节 起点", 9, "第一节 起", 1, "BODY"), (3, "第九章", 9, "第九章", 1, "BODY"), (4, "第二章 债", 12, "第二章 债", 1, "BODY"), (5, "附", 12, "附", 2, "BACK")]
    chapters = spark.createDataFrame([(1, *c) for c in chapters], "book long, n int, title string, page int, anchor string, level int, role string")
    got = sorted((r.n, r.block, r.part, r.title, r.text, r.role) for r in K.kit_chapters(lines, chapters).collect())
    assert [(n, title, text, role) for n, _, _, title, text, role in got] == [
        (0, "目录", "第一章 总则…9", "TOC"), (2, "第一章 总则 · 第一节 起点", "本节正文续行", "BODY"), (2, "第一章 总则 · 第一节 起点", "〔图：甲〕", "FIGURE"),
        (2, "第一章 总则 · 第一节 起点", "注文", "FOOTNOTE"), (4, "第二章 债", "债的正文", "BODY"),
    ]


def greedy(entries, found, band):
    taken, out = set(), []
    for page, entry in sorted(entries):
        near = sorted((abs(page - s), s, c) for s, c in found if abs(page - s) <= band and c not in taken)
        if near:
            taken.add(near[0][2])
            out.append((entry, near[0][2]))
    return sorted(out)


def test_banded_match(spark):
    rng = random.Random(1)
    entries = [(rng.randrange(40), i) for i in range(150)]
    found = [(rng.randrange(40), 1000 + i) for i in range(90)]
    e = spark.createDataFrame([(7, i, p) for p, i in entries], "book_id long, entry long, page int")
    c = spark.createDataFrame([(7, i, p) for p, i in found], "book_id long, chapter long, start int")
    assert sorted((r.entry, r.chapter) for r in D.match_in_band(e, c, 5).collect()) == greedy(entries, found, 5)


@pytest.mark.parametrize("block", [1, 1000])
def test_most_similar(spark, block):
    import difflib

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 12)))
    texts, titles = [word() for _ in range(40)], [word() for _ in range(30)]
    got = D.most_similar(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(titles)), "entry long, title string"), block)
    want = [max((difflib.SequenceMatcher(None, a, b).ratio(), -i) for i, b in enumerate(titles)) for a in texts]
    assert {r.id: (r.entry, r.ratio) for r in got.collect()} == {i: (-e, round(r, 9)) for i, (r, e) in enumerate(want)}


def test_most_similar_of_many_kinds(spark):
    """Equal texts and titles, nulls, long titles with frequent characters, and texts like none."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefgh 甲乙😀", k=rng.randrange(0, n)))
    texts, titles = [word(60) for _ in range(40)] + [word(3000), "", None, "xyz", "a\0b\0", "a" * 300], [word(60) for _ in range(30)] + [word(900) for _ in range(6)] + ["a\0b", "a" * 260]
    texts, titles = texts + texts[:10], titles + titles[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(i + 7, t) for i, t in enumerate(titles)], "entry long, title string")
    want = [max((difflib.SequenceMatcher(None, a or "", b).ratio(), -i - 7) for i, b in enumerate(titles)) for a in texts]
    for block, share in ((1000, 1000), (9, 5)):
        got = D.most_similar(*df, block, share)
        assert {r.id: (r.entry, r.ratio) for r in got.collect()} == {i: (-e, round(r, 9)) for i, (r, e) in enumerate(want)}


def test_most_similar_compares_few(monkeypatch):
    """Titles that cannot be the most alike by their common subsequences are not compared."""
    rng = random.Random(5)
    titles = D.Titles([(i, "".join(rng.choices("abcdefghijklmnop", k=50))) for i in range(500)])
    asked, tried = [t[:20] + "z" + t[20:] for t in titles.titles[::25]], []
    ratio = D._block_ratio
    monkeypatch.setattr(D, "_block_ratio", lambda *x: tried.append(x) or ratio(*x))
    assert [-titles.best(a)[1] for a in asked] == list(range(0, 500, 25)) and len(tried) == len(asked)


def test_blocks_in_order(spark):
    rng = random.Random(3)
    rows = [(g, i, "x" * rng.randrange(0, 60)) for g in range(5) for i in range(80)]
    df = spark.createDataFrame(rows, "g long, i int, text string")
    got = {(r.g, r.i): r.block for r in D.greedy_blocks(df, "g", "i", 50, 4).collect()}
    blind = {(r.g, r.i): r.block for r in D.blind_chapters(df, "g", "i", whole=2400, least=100).collect()}
    for g in range(5):
        block = chars = items = 0
        alone, part, acc = False, 0, 0
        total = sum(len(t) for x, _, t in rows if x == g)
        for _, i, t in sorted(r for r in rows if r[0] == g):
            if items and (len(t) > 50 or alone or chars + len(t) > 50 or items + 1 > 4):
                block, chars, items = block + 1, 0, 0
            chars, items, alone = chars + len(t), items + 1, len(t) > 50
            assert got[g, i] == block and blind[g, i] == (part if total > 2400 else 0)
            acc += len(t)
            if acc >= 100:
                part, acc = part + 1, 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_spelt_in_one_place(spark):
    """Steps that read the text of the Chinese lines several times have it as a column, not as its expression."""
    han = table(spark, SF, "han")
    twice = han.where("text <> '' and length(text) > 2").select("book", F.concat("text", F.upper("text")).alias("t")).where("t <> 'x'")
    assert _plan(twice).count("translate(") <= 2


def test_books_in_batches(spark):
    """Starts and stitched pages are folds over sorted rows, whatever the batches; no book is a group by itself."""
    rng = random.Random(6)
    part = lambda: rng.choice(["", "〔页", "第一章", "一、总"]) * (rng.random() < 0.2) + "".join(rng.choices("民法人事 。ab", k=rng.randrange(0, 30)))
    pages = [(b, p, [part() for _ in range(rng.randrange(0, 3))]) for b in range(9) for p in range(1, rng.randrange(2, 12))]
    rows = {b: [(p, [x for x in paras if x]) for k, p, paras in pages if k == b] for b in range(9)}
    heading = re.compile(f"^第[{T.NUMERAL}]+[章节编篇]|^[一二三四五六七八九十]+、")
    for of in rows.values():
        for (_, a), (_, b) in zip(of[:-1], of[1:], strict=True):
            if a and b and len(a[-1]) >= 12 and not any(x.startswith("〔") or heading.match(x) for x in (a[-1], b[0])) and re.search("[一-鿿a-zA-Z]$", a[-1]) and re.match("[一-鿿a-z]", b[0]):
                a[-1] += (" " if a[-1][-1].isascii() and b[0][0].isascii() else "") + b.pop(0)
    want = sorted((b, p, len(x), sum(map(len, x))) for b, of in rows.items() for p, x in of)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = D.stitch(spark.createDataFrame(pages, "book long, page int, paras array<string>").repartition(3))
        assert sorted(map(tuple, df.collect())) == want and "FlatMapGroups" not in _plan(df)
        lines = [(b, i, i // 4 + 1, i, rng.choice(["甲乙", "丙丁戊", "己"]) + str(rng.randrange(3))) for b in range(6) for i in range(20)]
        listed = [(b, n, rng.randrange(1, 4), rng.choice(["甲乙", "丙 丁", "己", "壬", ""])) for b in range(6) for n in range(7)]
        found = K.chapter_starts(spark.createDataFrame(lines, "book long, block long, page int, ord int, text string"), spark.createDataFrame(listed, "book long, n int, page int, anchor string"))
        assert "FlatMapGroups" not in _plan(found)
        starts = []
        for b in range(6):
            pointer = -1
            for k, n, least, anchor in listed:
                hits = [i for c, i, p, _, text in lines if k == c == b and p >= least and text.startswith(anchor.replace(" ", "")) and i >= pointer]
                if k == b and (hits or n == 0):
                    starts.append((b, n, hits[0] if hits else 0))
                    pointer = hits[0] + 1 if hits else pointer
        assert sorted(map(tuple, found.collect())) == sorted(starts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repairs_as_looked_behind(spark):
    """Patterns that begin with the character they are about repair what those that look behind everywhere do."""
    dice, texts = random.Random(5), ["", "＠甲", "千人"]
    texts += ["".join(dice.choices("＠心卫千于。；\n甲理生年一A”", k=dice.randrange(1, 14))) for _ in range(400)]

    def plain(c):
        c = F.regexp_replace(c, "＠(?=[。，；：、！？）】》]|$)", "")
        c = F.regexp_replace(c, "(^|(?<=[。；：！？]))＠(?=[一-鿿])", "$1")
        c = F.regexp_replace(c, r"(?:^|(?<=[。；：！？\n]))(?:心(?![理中情态灵得意愿证血脏智存怀思])(?=[一-鿿])|[卫卢竺](?![生星梭森法])(?=[一-鿿]))", "●")
        c = F.regexp_replace(c, f"(?<=于)千(?![{P.THOUSAND_AFTER}])(?=[一-鿿0-9])", "")
        return F.regexp_replace(c, f"(?<![{P.THOUSAND_BEFORE}])千(?![{P.THOUSAND_AFTER}])(?=[一-鿿0-9A-Za-z，。；：、！？（）“”｀“＂'\"（《])", "于")

    assert each(spark, P.fix_ocr, texts) == each(spark, plain, texts)
    assert "(^|(?<=" not in _plan(spark.createDataFrame([("",)], "t string").select(P.fix_ocr(F.col("t"))))


def test_lines_are_read_once(spark):
    """Chapters and contents entries start from what was written of the lines, and are those of the lines."""
    lines = spark.createDataFrame([(1, p, i, t) for p, texts in ((1, ["目录", "第一章 甲 3", "第二章 乙 5"]), (3, ["第一章 甲", "正文" * 30])) for i, t in enumerate(texts)], LINE)
    facts = P.line_facts(lines)
    for step in (P.scan_chapters, P.detect_contents):
        assert sorted(map(tuple, step(facts).collect())) == sorted(map(tuple, step(lines).collect()))
        assert "初版序" not in _plan(step(lines))
    assert _plan(P.scan_chapters(lines)).count("LocalTableScan") == 0
