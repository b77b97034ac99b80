"""Text functions as columns: shapes of headings, notes and contents lines, joins of lines, repairs of recognised text.

Lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point classes, word lists, marks and patterns of the texts that are read.
CJK_LIKE = r"[　-鿿＀-￯]"
HAN = r"[一-鿿]"
LATIN_WORD = r"[0-9A-Za-zÀ-ÿ]"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}]"
NUMERAL = "一二三四五六七八九十百千0-9零〇两"
TITLE_A_HAN = f"^第[{NUMERAL}]+[章单元篇部卷回]"
TITLE_A_LATIN = r"(?i)^(Chapter|Unit)\s+\d+"
TITLE_B = f"^第[{NUMERAL}]+[节讲]"
TITLE_C_HAN = "^[一二三四五六七八九十]+[、.，]"
TITLE_C_PAREN = "^（[一二三四五六七八九十]+）"
TITLE_C_NUM = r"^\d{1,3}(\.\d{1,3})+[、.．]?\s*\S"
TITLE_C_NUM1 = r"^\d{1,3}[、.．]\s*\S"
SECTION_INLINE = f"第[{NUMERAL}]+[节讲]"
MID_PUNCTUATION = "[，,；;]"
TRAILING_PAGE = HAN + r"\s*\d{1,4}\s*$"
TITLE_MAX, TITLE_A_MAX = 40, 24
TITLE_END = "[。？！，、；,.?!;]"
CONTENTS_LEADER = r"[…·.•‧．●]{2,}\s*[（(]?\d{1,4}[）)]?\s*$"
CONTENTS_DOTS = "[…·.•‧．●]{2,}"
CONTENTS_HEADING = r"^第[一二三四五六七八九十百千零〇两]+[章节目款回].{0,60}?[（(]?\d{1,4}[）)]?\s*$"
PAGE_ONLY = r"^(\d{1,4}|[（(]\d{1,4}[）)])$"
PAGE_NUMBER = r"^(\d{1,4}|[−\-–]\s*\d{1,4}\s*[−\-–]|[·•‧]\s*\d{1,4}\s*[·•‧]|第?\s*\d{1,4}\s*页|\d{1,3}\s*/\s*\d{1,3})$"
FIXED_TITLES = ["前言", "序言", "引言", "目录", "附录", "后记", "参考文献"]
FRONT_FIXED, BACK_FIXED = ["前言", "序言", "引言"], ["参考文献", "附录", "后记"]
FRONT_FAMILY = (
    "^(?:"
    "(?:第?[0-9一二三四五六七八九十百]{1,3}版|初版|再版|新版|修订版|增订版)?序(?:言|[一二三四五六七八九十])?"
    "|(?:丛书)?总序|自序|代序|小序"
    "|写在前面(?:的话)?|写在卷首|作者的话|译者的话"
    "|(?:再版|修订|新版|出版|编写|编译|增订)说明"
    "|凡例|缩略语表?|简称(?:对照)?表"
    "|作者简介|译者简介|作者与译者简介|关于作者|献词"
    ")$"
)
BACK_FAMILY = "^(?:致谢|谢辞|译后记|跋)$"
FRONT_ENTRIES = [
    "写在前面", "写在卷首", "总序", "译序", "译者序", "译者的话", "自序", "作者的话", "序言", "初版序", "再版序", "再版说明", "修订说明", "增订版", "凡例", "缩略语", "作者简介", "译者简介",
]
EDITION_ENTRY, FRONT_ENTRY_MAX = "^第?[0-9一二三四五六七八九十百]{1,3}版", 14
CONTENTS_TITLE = "目录"
HEADING_LIKE = f"^第[{NUMERAL}]+[章单元篇部卷回节讲]|^[一二三四五六七八九十]+[、.，]|^（[一二三四五六七八九十]+）"
LONE_PAGE = r"^\(?\d{1,4}\)?[.。]?$"
ENTRY_PAGE_TAIL = r"\d{1,4}\s*[.。]?$"
CONTENTS_ENTRY = r"^第[一二三四五六七八九十百千0-9]+[章节回][^0-9]*\d+\s*$"
CITATION_END = r"[\[〔]\d{1,3}[\]〕]$"
SENTENCE_END = "[。！？；：！?:…”』」①-⑳]$"
SENTENCE_MARKS = "。！？!?；;"
FOOTNOTE_DIGIT = r"[　-鿿＀-￯][0-9]$"
TITLE_SPACE = r"(?<![A-Za-z0-9])[\s　]+|[\s　]+(?![A-Za-z0-9])"
GLUED_ENTRY = r"(?<=[)）0-9②③④⑤⑥⑦⑧⑨⑩])\s*(?=(?:[（(]?[一二三四五六七八九十]{1,3}[）)]?[、.．：:]?[^0-9一二三四五六七八九十])|[0-9]{1,3}[、.．])"
FOOTNOTE_LEAD = "参见|载《|判例|判决|台上字|最高法院|出版社|编印|年第.{0,8}期|页以下|注[：:]"
FOOTNOTE_YEAR = r"[（(]\d{4}[）)]?\s*[.。]?\s*$"
YI_MARKS, YI_PLAIN = "ꎬꎮꎻ", "，。；"
FULL_MARKS, HALF_MARKS = "，（）：；", ",():;"
COMPARED_MARKS = r"""[\s，。、；：？！「」『』（）〔〕《》”“‘’"'—…·．.，,;:!?()\-－—]"""
PAGE_MARK = r"^\s*〔页\s*(\d+)\s*〕\s*$"
FIGURE_MARK = r"^\s*〔图[:：]\s*(.+?)\s*〕(.*)$"
PARAGRAPH_REF = r"〔p(\d+)〕"
ZH_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "两": 2}
#: White space of every kind.
WHITE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITE_CHARACTERS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() alone takes spaces only)."""
    return F.btrim(c, F.lit(WHITE_CHARACTERS))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that f names several times, and that is computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def escape_like(c: Column) -> Column:
    """a pattern that finds the text literally, anywhere."""
    for mark in ("\\", "%", "_"):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return F.concat(F.lit("%"), c, F.lit("%"))


def soft_merge(lines: Column) -> Column:
    """trimmed lines joined, by a space only between two that aren't CJK."""
    lines = F.filter(F.transform(lines, trimmed), lambda x: x != "")

    def join(acc: Column, line: Column) -> Column:
        apart = ~F.right(acc, F.lit(1)).rlike(CJK_LIKE) & ~F.left(line, F.lit(1)).rlike(CJK_LIKE)
        return F.when(acc == "", line).otherwise(F.concat(acc, F.when(apart, " ").otherwise(""), line))

    return F.aggregate(lines, F.lit(""), join)


def line_joiner(last: Column, first: Column) -> Column:
    """what goes between two characters: nothing beside punctuation, a space beside a Latin one, else nothing."""
    word = lambda c: c.rlike(LATIN_WORD) | c.rlike(HAN)
    return F.when(word(last) & word(first) & (last.rlike(LATIN_WORD) | first.rlike(LATIN_WORD)), " ").otherwise("")


def soft_join(texts: Column) -> Column:
    """a fold of line_joiner."""

    def join(acc: Column, text: Column) -> Column:
        return F.when(acc == "", text).when(text == "", acc).otherwise(F.concat(acc, line_joiner(F.right(acc, F.lit(1)), F.left(text, F.lit(1))), text))

    return F.aggregate(texts, F.lit(""), join)


def ends_sentence(c: Column) -> Column:
    """by a mark or closer, a circled number, one digit after CJK, or a bracketed number."""
    ends = "|".join(end.removesuffix("$") for end in (SENTENCE_END, FOOTNOTE_DIGIT, CITATION_END))
    return F.right(F.rtrim(c, F.lit(WHITE_CHARACTERS)), F.lit(8)).rlike(rf"(?:{ends})\z")


def strip_control(c: Column) -> Column:
    """F07."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")


def plain_yi(c: Column) -> Column:
    """borrowed marks become punctuation unless other syllables of that script are there."""
    return F.when(F.translate(c, YI_MARKS, "").rlike(r"[ꀀ-ꒌ]"), c).otherwise(F.translate(c, YI_MARKS, YI_PLAIN))


def private_use(c: Column) -> Column:
    """how many characters are of private use."""
    return F.regexp_count(c, F.lit(PRIVATE_USE))


def header_like(c: Column) -> Column:
    """a chapter heading with a page number after it."""
    return c.rlike(r"^[第笫][0-9一-鿿 ]*[0-9一-鿿][ 0-9一-鿿]*[章节篇回][0-9一-鿿 ]*$|^[第笫][0-9一-鿿 ]+[章节篇回]") & c.rlike(r"[一-鿿] *(?<![0-9])[0-9]{1,4} *$")


def header_number_like(c: Column) -> Column:
    """a page number, then 2 to 12 Han characters."""
    return c.rlike(r"^[0-9]{1,4} ?[一-鿿]{2,12}$")


def footnote_marked(c: Column) -> Column:
    """starts as a footnote does."""
    return c.rlike(r"^[①-⑳＠@]") | c.rlike(r"^[0Oo心][一-鿿]") | c.startswith("参见")


def footnote_lead(c: Column) -> Column:
    """reads as a citation: its words, a year at the end, or mostly Latin."""
    latin = F.regexp_count(c, F.lit("[A-Za-z0-9]"))
    cites = F.left(c, F.lit(24)).rlike(FOOTNOTE_LEAD) | F.right(c, F.lit(12)).rlike(FOOTNOTE_YEAR)
    return (F.length(c) >= 6) & (cites | ((F.length(c) >= 16) & (latin * 2 >= F.length(c))))


def contents_line(c: Column) -> Column:
    """a leader and a page, a page alone, or a heading with a page."""
    # each of them ends in a digit, or in one and a bracket; only then is the line looked through
    ends = F.right(F.rtrim(c, F.lit(WHITE_CHARACTERS)), F.lit(2)).rlike("[0-9]")
    return ends & (c.rlike(CONTENTS_LEADER) | c.rlike(PAGE_ONLY) | c.rlike(CONTENTS_HEADING))


def contents_like(c: Column) -> Column:
    """what else stands in a contents list: headings and fixed titles."""
    return c.rlike(f"{TITLE_A_HAN}|{TITLE_B}") | c.isin(FIXED_TITLES)


def contents_block(lines: Column) -> Column:
    """a block with a contents line at least, of whose lines, but for blank ones, half are such, headings or fixed titles."""
    lines = F.filter(F.transform(lines, trimmed), lambda x: x != "")
    strong = F.size(F.filter(lines, lambda x: contents_line(x) | contents_like(x)))
    return F.exists(lines, contents_line) & (strong * 2 >= F.size(lines))


def page_number(c: Column) -> Column:
    """F13."""
    return c.rlike(PAGE_NUMBER)


def title_candidate(c: Column) -> Column:
    """F16: short, not a sentence, not a contents line."""
    return (F.length(c) > 0) & (F.length(c) <= TITLE_MAX) & ~F.right(c, F.lit(1)).rlike(TITLE_END) & ~c.rlike(CONTENTS_LEADER)


def front_title(c: Column) -> Column:
    """a fixed word or one of the family of forewords, editions and notes, and nothing else on the line."""
    return c.isin(FRONT_FIXED) | c.rlike(FRONT_FAMILY)


def back_title(c: Column) -> Column:
    """F17."""
    return c.isin(BACK_FIXED) | c.rlike(BACK_FAMILY)


def front_entry(c: Column) -> Column:
    """a contents entry of front matter, which may go on after the title: short, and begins as one."""
    begins = reduce(lambda a, b: a | b, [c.startswith(w) for w in FRONT_ENTRIES])
    return (c != "") & (F.length(c) <= FRONT_ENTRY_MAX) & (front_title(c) | begins | c.rlike(EDITION_ENTRY))


def role_of(c: Column) -> Column:
    """F18."""
    return F.when(c == CONTENTS_TITLE, "FRONT").when(back_title(c), "BACK").when(front_title(c), "FRONT").otherwise("BODY")


def subtitle_cut(c: Column) -> Column:
    """the head before a dash, where both halves are clean; else null."""
    head, tail = trimmed(F.regexp_extract(c, "^([^—─⸺\\-－]+)[—─⸺\\-－]", 1)), F.regexp_replace(c, "^[^—─⸺\\-－]+[—─\\-－ \\u3000]+", "")
    clean = (head != "") & (tail != "") & (tail != c) & (F.length(head) <= TITLE_A_MAX) & ~head.rlike(MID_PUNCTUATION) & ~head.rlike(SECTION_INLINE)
    return F.when(clean & ~tail.rlike(MID_PUNCTUATION) & ~tail.rlike("[。！？；：!?:]$"), head)


def title_style(c: Column, custom: str | None = None) -> Column:
    """the style of a heading, null for others. With custom, its matches and no built-in style."""
    if custom:
        return F.when(c.rlike(custom), "CUSTOM")
    long = (F.length(c) > TITLE_A_MAX) | c.rlike(MID_PUNCTUATION)
    han = F.when(long, F.when(subtitle_cut(c).isNotNull(), "A_HAN_SUB")).when(~c.rlike(SECTION_INLINE), F.lit("A_HAN"))
    paged = c.rlike(TRAILING_PAGE)
    return (
        F.when(c.rlike(TITLE_A_HAN), F.when(~paged, han)).when(c.rlike(TITLE_A_LATIN), F.when(~paged, "A_LATIN")).when(c.isin(FIXED_TITLES) | front_title(c) | back_title(c), F.when(~paged, "A_FIXED"))
        .when(c.rlike(TITLE_B), F.when(~paged, "B")).when(c.rlike(TITLE_C_HAN), "C_HAN").when(c.rlike(TITLE_C_PAREN), "C_PAREN").when(c.rlike(TITLE_C_NUM), "C_NUM").when(c.rlike(TITLE_C_NUM1), "C_NUM1")
    )


def title_grade(style: Column) -> Column:
    """1 for styles A and custom ones, 2 for B, 3 for C."""
    return F.when(style.startswith("A") | (style == "CUSTOM"), 1).when(style == "B", 2).when(style.startswith("C"), 3)


def split_blocks(c: Column) -> Column:
    """blocks of text parted by blank lines; a line of full-width spaces is blank."""
    return F.filter(F.transform(F.split(c, r"\n(?:[ \t　]*\n)+"), trimmed), lambda b: b != "")


def normal_title(c: Column) -> Column:
    """no white space beside anything but letters and digits of ASCII."""
    return F.regexp_replace(trimmed(c), TITLE_SPACE, "")


def clean_title(c: Column) -> Column:
    """without a title mark and a dotted tail."""
    return trimmed(F.regexp_replace(F.replace(c, F.lit("〔标题〕"), F.lit("")), "[…·.•‧]{2,}.*$", ""))


def anchor_line(line: Column, normal: Column, title: Column) -> Column:
    """holds the title, not followed by a digit, and is no contents line or header. normal: normal_title() of the line."""
    at = F.position(title, normal)
    follows = F.substring(normal, at + F.length(title), F.lit(1))
    return (at > 0) & ~line.rlike(CONTENTS_LEADER) & ~line.rlike(TRAILING_PAGE) & ~follows.rlike(r"^\p{Nd}$")


def file_title(name: Column) -> Column:
    """a file name without folder and extension, and without a site's tail."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return trimmed(F.regexp_replace(base, r"[\s_\-]*[（(\[][^（()\[\]）]*(?:\.com|\.org|\.net|\.cn)[^（()\[\]）]*[）)\]]\s*$", ""))


def split_glued(c: Column) -> Column:
    """contents entries that run into each other, parted."""
    parts = F.filter(F.transform(F.split(trimmed(c), GLUED_ENTRY), trimmed), lambda p: p != "")
    return F.when(F.size(parts) <= 1, F.array(c)).otherwise(parts)


def half_width(c: Column) -> Column:
    """F29."""
    return F.translate(c, FULL_MARKS, HALF_MARKS)


def strip_citations(c: Column) -> Column:
    """circled and bracketed numbers go; a bibliographic line stays as it is."""
    circled, digits = "[①-⑳]", r"[【\[][0-9０-９]{1,3}[】\]]"
    out = F.regexp_replace(c, f"^({WHITE}*){circled}({WHITE}+)", "$1$2")
    out = F.regexp_replace(out, f"^({WHITE}*){digits}{WHITE}*", "$1")
    out = F.regexp_replace(F.regexp_replace(out, circled, ""), digits, "")
    return F.when(c.rlike(rf"[IVXⅠ-Ⅳ]+\.{WHITE}*{circled}"), c).otherwise(out)


def strip_refs(c: Column, allowed: Column) -> Column:
    """paragraph references go whose number isn't among the allowed ones."""
    bad = F.array_except(F.regexp_extract_all(c, F.lit(PARAGRAPH_REF), 1), F.transform(allowed, lambda x: x.cast("string")))
    return F.aggregate(bad, c, lambda acc, n: F.replace(acc, F.concat(F.lit("〔p"), n, F.lit("〕")), F.lit("")))


def classify_sample(c: Column) -> Column:
    """F32: the head of 150 and the tail of 50 of a longer text."""
    return F.when(F.length(c) <= 200, c).otherwise(F.concat(F.left(c, F.lit(150)), F.lit("…"), F.right(c, F.lit(50))))


def sentences(c: Column, limit: int = 4000) -> Column:
    """sentences, each cut at every `limit` characters.

    Each mark gets a line break after it, at which texts are parted: a pattern of such characters costs as much as all the rest.
    """
    broken = reduce(lambda acc, mark: F.replace(acc, F.lit(mark), F.lit(mark + "\n")), SENTENCE_MARKS, c)
    pieces = F.filter(F.transform(F.split(broken, "\n", -1), trimmed), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))
    return F.flatten(F.transform(pieces, cut))


def running_norm(c: Column) -> Column:
    """without white space and digits."""
    return F.regexp_replace(c, r"[\s\d０-９]+", "")


def compared(c: Column) -> Column:
    """without white space and punctuation."""
    return F.regexp_replace(c, COMPARED_MARKS, "")


def merge_candidate(a: Column, b: Column) -> Column:
    """whether a paragraph at a page's end and one at the next one's start may be one."""
    heading = lambda c: c.rlike(f"^第[{NUMERAL}]+[章节编篇]") | c.rlike("^[一二三四五六七八九十]+、")
    word = "[\\u4E00-\\u9FFFa-zA-Z]"
    return ~a.startswith("〔") & ~b.startswith("〔") & ~heading(a) & ~heading(b) & (F.length(a) >= 12) & a.rlike(word + "$") & b.rlike("^" + word)


def zh_to_int(c: Column) -> Column:
    """a number in Chinese or Arabic numerals, to the hundreds; null for others."""
    step = lambda acc, ch: (
        F.when(ch == "十", F.struct((acc["total"] + F.greatest(acc["num"], F.lit(1)) * 10).alias("total"), F.lit(0).alias("num")))
        .when(ch == "百", F.struct((acc["total"] + F.greatest(acc["num"], F.lit(1)) * 100).alias("total"), F.lit(0).alias("num")))
        .otherwise(F.struct(acc["total"].alias("total"), reduce(lambda w, kv: w.when(ch == kv[0], kv[1]), list(ZH_DIGITS.items())[1:], F.when(ch == "零", 0)).alias("num")))
    )
    t = trimmed(c)
    folded = F.aggregate(F.filter(F.split(t, ""), lambda x: x != ""), F.struct(F.lit(0).alias("total"), F.lit(0).alias("num")), step, lambda acc: acc["total"] + acc["num"])
    return F.when(t.rlike("^[0-9]+$"), F.try_to_number(t, F.lit("999999999")).cast("int")).when(t.rlike(f"^[{''.join(ZH_DIGITS)}十百]+$"), folded)


def book_key(c: Column) -> Column:
    """a file-safe key of a title."""
    return F.left(F.regexp_replace(c, r"[^\w一-鿿]+", "_"), F.lit(40))


def ref_segments(c: Column) -> Column:
    """a text as plain and reference segments, in order."""
    plain, refs = F.split(c, PARAGRAPH_REF), F.regexp_extract_all(c, F.lit(PARAGRAPH_REF), 1)
    both = F.transform(plain, lambda p, i: F.struct(p.alias("text"), F.get(refs, i).alias("ref")))
    return F.filter(both, lambda s: (s["text"] != "") | s["ref"].isNotNull())


def fix_list_l(c: Column) -> Column:
    """(l) becomes (1) where the paragraph has other list marks."""
    listed = c.rlike(r"[(（]\s*[2-9一二三四五六七八九十]\s*[)）]|[2-9][.、．]")
    return F.when(listed, F.regexp_replace(c, r"(?<=[(（])l(?=[)）])", "1")).otherwise(c)


def fix_latin_digits(c: Column) -> Column:
    """I and O in the place of digits after an opening bracket become 1 and 0, as first found."""
    found = F.regexp_extract(c, r"[(（]\s*I[0-9O]{1,6}", 0)
    digits = F.translate(F.regexp_replace(found, r"^[(（]\s*I", ""), "O", "0")
    return F.when(found != "", F.replace(c, found, F.concat(F.left(found, F.lit(1)), F.lit("1"), digits))).otherwise(c)
