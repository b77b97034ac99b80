"""Text rules on small literals: the synthetic tables have no Chinese text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.functions import parsing as J
from folio.functions import scheduling as S
from folio.functions import text as T
from folio.operators import documents as D
from folio.sources import files


@pytest.fixture(scope="module")
def value(spark):
    def run(column, *texts):
        rows = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        return rows.select(column(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    "text, style",
    [("第一章 总则", "A_HAN"), ("第12章 民法", "A_HAN"), ("Chapter 3 Torts", "A_LATIN"), ("前言", "A_FIXED"), ("第二节 物权", "B"), ("一、概述", "C_HAN"), ("（三）要件", "C_PAREN"), ("1.2 定义", "C_NUM"),
     ("3、说明", "C_NUM1"), ("第一章 私法绪论 3", None), ("第二章婚姻规定，未使当事人", None), ("第四章 行为 第一节 能力", None), ("普通文字", None)],
)
def test_title_style(value, text, style):
    assert value(T.title_style, text) == style


@pytest.mark.parametrize("text, ends", [("他走了。", True), ("问什么?", True), ("分号;", False), ("感叹!", False), ("见注①", True), ("如此。[12]", True), ("条文3", True), ("共计30", False), ("未完", False), ("", False)])
def test_ends_sentence(value, text, ends):
    assert value(T.ends_sentence, text) is ends


@pytest.mark.parametrize("a, b, joiner", [("字", "字", ""), ("a", "b", " "), ("字", "b", " "), ("。", "b", ""), ("1", "字", " "), ("a", "，", "")])
def test_line_joiner(value, a, b, joiner):
    assert value(T.line_joiner, a, b) == joiner


@pytest.mark.parametrize("text, n", [("十二", 12), ("一百零三", 103), ("百", 100), ("二十", 20), ("15", 15), ("两", 2), ("千", None), ("x", None)])
def test_zh_to_int(value, text, n):
    assert value(T.zh_to_int, text) == n


def test_small_rules(value):
    assert value(lambda c: T.soft_merge(F.split(c, "\\|")), "你 |好|a|b") == "你好a b"
    assert value(T.plain_yi, "甲ꎬ乙ꎮ") == "甲，乙。"
    assert value(T.plain_yi, "ꀀꎬ") == "ꀀꎬ"
    assert value(T.half_width, "（甲）：乙；") == "(甲):乙;"
    assert value(T.strip_citations, "正文①继续[12]") == "正文继续"
    assert value(T.normal_title, " 第 515 号 A B ") == "第515号A B"
    assert value(T.clean_title, "〔标题〕第一章 总则……12") == "第一章 总则"
    assert value(T.split_glued, "第一章 (12)二、概述(15)") == ["第一章 (12)", "二、概述(15)"]
    assert value(T.role_of, "目录") == "FRONT" and value(T.role_of, "附录") == "BACK" and value(T.role_of, "第一章") == "BODY"
    assert value(T.subtitle_cut, "第一章 私法绪论 ——私法社会、私法秩序") == "第一章 私法绪论"
    assert value(T.fix_list_l, "（l）甲（2）乙") == "（1）甲（2）乙" and value(T.fix_list_l, "（l）甲") == "（l）甲"
    assert value(T.fix_latin_digits, "（IO万元）") == "（10万元）"
    assert value(lambda c: T.strip_refs(c, F.array(F.lit(1), F.lit(2))), "见〔p1〕与〔p9〕") == "见〔p1〕与"
    assert value(T.sentences, "甲。乙！\n丙") == ["甲。", "乙！", "丙"]
    assert value(T.page_number, "- 12 -") and value(T.page_number, "第12页") and not value(T.page_number, "12章")
    assert value(T.contents_line, "总则……12") and value(T.contents_line, "第一节 概念 (35)")
    assert value(T.footnote_marked, "①参见") and value(T.footnote_lead, "王泽鉴，民法总则，北京大学出版社，2009")
    assert value(T.escape_like, r"50%_\\") == r"%50\%\_\\\\%"
    assert value(T.private_use, "a\ue000\uf8ffb") == 2
    assert value(T.header_number_like, "12 民法总则") and not value(T.header_number_like, "12 a")


def test_empty_and_null(value):
    for f in (T.ends_sentence, T.title_style, T.strip_citations, T.normal_title, T.page_number, T.half_width, T.sentences, T.zh_to_int):
        value(f, "")
        assert value(f, None) in (None, [])


def test_parsing(spark, value):
    assert [value(J.lenient_int, x) for x in ("3", "3.0", " 7 ", "x", None)] == [3, 3, 7, -1, -1]
    assert value(lambda c: J.tag(c, "gist"), "x<gist> a\nb </gist>") == "a\nb"
    assert value(lambda c: J.tag(c, "gist"), "<gist>a") is None and value(lambda c: J.tag(c, "gist", True), "<gist>a") == "a"
    assert value(J.decode_quiz, "broken") == []
    assert [x["type"] for x in value(J.decode_quiz, '[{"q":"a","type":"ODD"}]')] == ["RECALL"]
    assert value(J.json_slice, 'see ```json\n{"a": "}"}\n``` end') is not None
    assert value(J.json_slice, 'x {"a": "}\\""} y') == '{"a": "}\\""}'
    assert value(J.json_slice, "none") is None and value(J.json_slice, "{open") is None
    assert value(J.rulings, "A | DROP\nB | RENAME x\nA | IGNORE") == {"A": "IGNORE", "B": "RENAME x"}


def test_plan(spark):
    reply = '{"paragraphs":[{"id":"1","action":"skip"},{"id":2,"action":"group","group":[2,3]},{"id":3,"action":"group","group":[3,5]},{"id":9,"action":"skip"},{"id":1,"action":"explain","why":"w"}]}'
    rows = spark.createDataFrame([(1, [1, 2, 3], reply), (2, [1, 2, 3, 4, 5, 6], reply)], "block int, known array<int>, reply string")
    got = sorted((r.block, r.id, r.action, r.start) for r in J.parse_plan(rows, "block", "known", "reply").collect())
    assert got == [(1, 1, "EXPLAIN", None), (1, 2, "GROUP", 2), (1, 3, "EXPLAIN", None)]


def test_tree(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["root", "\t- a", "\t\t**b**", "\tc", "", "other"])], "doc int, n int, line string")
    got = [(r.topic, r.depth, r.parent) for r in J.tree_parents(rows, "doc", "n", "line").orderBy("n").collect()]
    assert got == [("root", 0, None), ("a", 1, 0), ("b", 2, 1), ("c", 1, 0), ("other", 0, None)]


def test_deep_tree(spark):
    import random

    dice = random.Random(1)
    depths = [*range(40), *range(39, -1, -3), *(dice.randrange(60) for _ in range(200))]
    rows = spark.createDataFrame([(d, i, "\t" * n + f"t{i}") for d in (1, 2) for i, n in enumerate(depths[:: d])], "doc int, n int, line string").repartition(3)
    got = {(r.doc, r.n): (r.depth, r.parent) for r in J.tree_parents(rows, "doc", "n", "line").collect()}
    for d in (1, 2):
        own = depths[::d]
        for i, n in enumerate(own):
            assert got[d, i] == (n, max((k for k in range(i) if own[k] < n), default=None))


def test_trimmed(spark):
    texts = ["x \u2028", "\u2029 x", "\u3000x\u00a0", "x\x85", " ", "", "\u200ax y\u205f\x1c", None]
    each = lambda f, ts: [r.v for r in sorted(spark.createDataFrame(list(enumerate(ts)), "i int, text string").select("i", f(F.col("text")).alias("v")).collect(), key=lambda r: r.i)]
    assert each(T.trimmed, texts) == [None if t is None else t.strip() for t in texts]
    assert each(T.ends_sentence, ["好。 \u2028", "好 。x", "见[12]  ", "甲3", "a3", "", "x" * 100 + "！\n\n"]) == [True, False, True, True, False, False, True]


def test_units(spark):
    rows = spark.createDataFrame([(1, 0, "EXPLAIN", None), (1, 1, "GROUP", 1), (1, 2, "GROUP", 1), (1, 4, "GROUP", 7), (1, 5, "SKIP", None)], "chapter_id int, idx int, ai_action string, group_id long")
    assert sorted((r.anchor, r.members) for r in J.explain_units(rows).collect()) == [(0, [0]), (1, [1, 2]), (4, [4])]


def test_scheduler(spark):
    day = S.DAY_MS
    rows = spark.createDataFrame([(1, None, None, None, 1), (2, 10.0, 5.0, 0, 3), (3, 10.0, 5.0, 0, 1)], "id int, fsrs_stability double, fsrs_difficulty double, last_review_at long, rating int")
    got = {r.id: r for r in S.review(rows, F.lit(10 * day)).collect()}
    assert got[1].stability == pytest.approx(S.PARAMETERS[0]) and got[1].interval_days == 1
    assert got[2].stability > 10 > got[3].stability and 1 <= got[3].difficulty <= 10
    r = S.preview(rows, F.lit(10 * day)).where("id = 2").first()
    assert r.forgot_days <= r.fuzzy_days <= r.remember_days <= r.easy_days
    chance = rows.select(S.retrievability(F.col("fsrs_stability"), F.col("last_review_at"), F.lit(10 * day)).alias("r")).collect()
    assert chance[0].r == 0.0 and chance[1].r == pytest.approx(0.9)


def test_greedy_blocks(spark):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([4, 4, 20, 3, 3, 3, 3])], "chapter_id int, idx int, text string")
    got = [r.block for r in D.greedy_blocks(rows, "chapter_id", "idx", 10, 3).orderBy("idx").collect()]
    assert got == [0, 0, 1, 2, 2, 2, 3]


def test_chapters(spark):
    texts = ["序文", "第一章 总则\n甲", "一、概述", "乙", "第二章 物权"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "book int, idx int, text string")
    got = [(r.chapter, r.title, r.blocks) for r in D.chapters(rows).orderBy("chapter").collect()]
    assert got == [(0, None, 1), (1, "第一章 总则", 3), (2, "第二章 物权", 1)]


def test_chapters_carry_no_texts(spark):
    """One shuffle, of lengths and headings; blocks without a text count as blocks, and a book without headings is one chapter."""
    texts = {1: [None, "第一章 总则\n甲", None, "乙", "第二章 物权"], 2: ["甲乙", None], 3: [None]}
    rows = spark.createDataFrame([(b, i, t) for b, x in texts.items() for i, t in enumerate(x)], "book int, idx int, text string")
    df = D.chapters(rows)
    got = {(r.book, r.chapter): (r.title, r.first, r.blocks, r.chars) for r in df.collect()}
    assert got == {
        (1, 0): (None, 0, 1, None), (1, 1): ("第一章 总则", 1, 3, 9), (1, 2): ("第二章 物权", 4, 1, 6), (2, 0): (None, 0, 2, 2), (3, 0): (None, 0, 1, None),
    }
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_stitch(spark):
    rows = spark.createDataFrame([(1, 1, ["这一段文字在页尾被切断而没有"]), (1, 2, ["说完。", "下一段"]), (1, 3, ["第一章 总则"])], "book long, page int, paras array<string>")
    assert [(r.page, r.paras) for r in D.stitch(rows).orderBy("page").collect()] == [(1, 1), (2, 1), (3, 1)]


#: stitch.py's patterns, with Latin letters besides.
SEAM_HEAD = re.compile(
    r"^(第\s*[0-9〇零一二三四五六七八九十百千]+\s*[章编部篇节讲]|[一二三四五六七八九十]+\s*、|[（(][0-9①-⑳一二三四五六七八九十]+\s*[）)、．.]|[0-9①-⑳]+\s*[、．.]"
    r"|附录|目录|序言|前言|导论|结语|后记|参考文献|索引|注释|表\s*[0-9一二三四五六七八九十]|图\s*[0-9一二三四五六七八九十])"
)
COLOPHON = re.compile("定价|ISBN|印张|开本|版次|印次|字数|书号|发行|经销|印刷|装订")


def stitched_in_order(pages, done=()):
    """{page: (texts, tail, head)} of a book, {page: texts}, one boundary after the other."""
    pages, seams = {n: [x for x in paras or [] if x] for n, paras in pages.items()}, {}
    for n in sorted(pages):
        if n in done or not pages[n] or not pages.get(n + 1):
            continue
        a, b = pages[n][-1], pages[n + 1][0]
        apart = any(x.startswith("〔") or SEAM_HEAD.match(x) for x in (a, b)) or COLOPHON.search(a) or len(a) < 12
        if not apart and re.match("[一-鿿a-zA-Z，、：]", a[-1]) and re.match("[一-鿿a-z]", b):
            seams[n] = (a[-14:], b[:14])
            pages[n][-1] = a + (" " if a[-1].isascii() and b[0].isascii() else "") + b
            del pages[n + 1][0]
    return {n: (paras, *seams.get(n, (None, None))) for n, paras in pages.items()}


def test_stitched_texts(spark):
    """Pages have their joined texts; guards, gaps between pages, seams of before and runs of single paragraphs are as one boundary after the other gives them."""
    dice = random.Random(9)
    starts = ["第 一 讲", "第三部", "（1）", "(二).", "12、", "③．", "附录", "目录", "表 1", "图二", "一 、", "〔图：", "第　二节", "B", "b", "。", "第一回"]
    part = lambda: dice.choice([*starts, *[""] * 40]) + "这一段文字在页尾被切断而没有"[: dice.choice([5, 14, 14, 14])] + dice.choice([*"民，、：。bC7,人事法", "定价书", "ISBN法"])
    books = {b: {p: dice.choice([[part()], [part()], [part(), part()], [part(), None, "", part()], [], None]) for p in sorted(dice.sample(range(1, 16), 13))} for b in range(90)}
    books[90] = {p: ["这一段文字在页尾被切断而没有"] for p in range(1, 8)}
    done = [(b, p) for b in books for p in books[b] if dice.random() < 0.1]
    pages = spark.createDataFrame([(b, p, paras) for b, of in books.items() for p, paras in of.items()], "book long, page int, paras array<string>").repartition(3)
    marks = spark.createDataFrame(done + done[:3], "book long, page int")
    for before in (None, marks):
        want = {(b, p): v for b, of in books.items() for p, v in stitched_in_order(of, [q for c, q in done if c == b and before is not None]).items()}
        got = D.stitched(pages, before).collect()
        assert {(r.book, r.page): (r.texts, r.tail, r.head) for r in got} == want and len(got) == len(want)
        assert all((r.paras, r.chars) == (len(r.texts), sum(map(len, r.texts))) for r in got)
        assert sum(r.tail is not None for r in got) > 80


def test_stitch_guards(spark):
    end, rest = "这一段文字在页尾被切断而没有", "说完。"
    cases = [
        (f"{end}，", rest, 1), (f"{end}：", rest, 1), (end, "（1）" + rest, 0), (end, "3．" + rest, 0), (end, "附录" + rest, 0), (end, "表 2" + rest, 0), (end, "第二讲" + rest, 0),
        (f"定价二十元{end}", rest, 0), (f"本书印次{end}", rest, 0), (end, rest, 1), (end, "", 0),
    ]
    rows = [(b, p, [x]) for b, (x, y, _) in enumerate(cases) for p, x in ((1, x), (2, y))] + [(99, 1, [end]), (99, 3, [rest])]
    got = {(r.book, r.page): r.paras for r in D.stitch(spark.createDataFrame(rows, "book long, page int, paras array<string>")).collect()}
    assert [1 - got[b, 2] if y else 0 for b, (_, y, _) in enumerate(cases)] == [joined for _, _, joined in cases]
    assert got[99, 1] == got[99, 3] == 1  # page 2 is missing


def test_stitched_query(spark, tmp_path):
    """The query gives whole texts, trimmed; a page that gave all it had is blank."""
    from folio.plans import registry

    lines = ["  第一页的第一行。\t", " ", *["一行"] * 27, "\u3000这一段文字在页尾被切断而没有 ", " 说完。", *["\xa0"] * 29, "尾页"]
    text = "\n".join(lines)
    spark.createDataFrame([(5, text, "zh", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.page: r.asDict() for r in registry.queries()["C22_stitched_pages"](spark, str(tmp_path)).collect()}
    whole = ["第一页的第一行。", *["一行"] * 27, "这一段文字在页尾被切断而没有说完。"]
    assert got[1] == {"book": 5, "page": 1, "paras": 29, "chars": sum(map(len, whole)), "tail": "这一段文字在页尾被切断而没有", "head": "说完。", "body": "\n\n".join(whole)}
    assert got[2] == {"book": 5, "page": 2, "paras": 0, "chars": 0, "tail": None, "head": None, "body": "〔空白页〕"}
    assert got[3]["body"] == "尾页" and len(got) == 3


def test_decode():
    assert files.decode("中文".encode("gbk")) == ("中文", "gbk")
    assert files.decode("中文".encode()) == ("中文", "utf-8")
    assert files.decode(b"\xef\xbb\xbfabc") == ("abc", "utf-8")
    assert files.decode(b"") == ("", "utf-8")


def test_files(spark, tmp_path):
    import json
    import zipfile

    (tmp_path / "a.txt").write_bytes("中文书".encode("gb18030"))
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "中文书"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("kit.json", json.dumps({"title": "t", "figures": [{"page": 1, "file": "f.png"}, {"page": 2, "file": "../x"}, {"file": "f.png"}]}))
        z.writestr("book.txt", "body")
        z.writestr("f.png", b"1")
    got = files.read_kits(spark, str(tmp_path / "b.zip")).first()
    assert got.body == "body" and len(got.figures) == 1


def test_backup(spark, tmp_path):
    books = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    chapters = spark.createDataFrame([(1, 1), (2, 2)], "id long, book_id long")
    settings = spark.createDataFrame([("k", "v"), ("token_enc", "s")], "key string, value string")
    tables = {"books": books, "chapters": chapters, "settings": settings}
    files.export_backup(tables, str(tmp_path))
    schemas = {n: d.schema for n, d in tables.items()}
    refs = [("chapters", "book_id", "books", "id")]
    back = files.restore_backup(spark, str(tmp_path), schemas, {"books": ["id"]}, refs)
    assert back["books"].count() == 2 and [r.key for r in back["settings"].collect()] == ["k"]
    chapters.unionByName(spark.createDataFrame([(3, 9)], "id long, book_id long")).write.mode("overwrite").json(f"{tmp_path}/v1/chapters")
    with pytest.raises(ValueError):
        files.restore_backup(spark, str(tmp_path), schemas, {"books": ["id"]}, refs)


def test_sentences(spark, value):
    """The pieces of a pattern, without running one over every character."""
    dice, pattern = random.Random(3), r"[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+$"
    for _ in range(15):
        text = "".join(dice.choices("ab 字。！？!?；;\n\r　.", k=dice.randrange(30)))
        pieces = [p for p in (m.strip(T.WHITE_CHARACTERS) for m in re.findall(pattern, text)) if p]
        assert value(lambda c: T.sentences(c, 4), text) == [p[i : i + 4] for p in pieces for i in range(0, len(p), 4)]
    assert value(T.sentences, None) is None
    plan = spark.range(1).select(T.sentences(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "regexp" not in plan
