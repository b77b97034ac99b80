"""Page lines: the lines of documents laid out on pages by arithmetic, for the layout operators.

A book is a source's document (doc_id); a page holds 30 lines. Geometry is in points, deterministic, and has all the
cases that layout rules tell apart: indents, short lines, larger title lines, wide gaps.
"""

from __future__ import annotations

#: Both engines understand it; `lines` is defined in roles.
PAGE_LINES = """SELECT doc_id AS book, cast(floor(pos / 30) as int) + 1 AS page, cast(pos % 30 as int) AS ord, line AS text,
    cast(50 + CASE WHEN pos % 5 = 0 THEN 20 ELSE 0 END as double) AS x0, cast(CASE WHEN pos % 4 = 3 THEN 200 ELSE 400 END as double) AS x1,
    cast((pos % 30) * 14 + floor((pos % 30) / 7) * 8 as double) AS y0, cast(CASE WHEN pos % 13 = 0 THEN 14 ELSE 10 END as double) AS size FROM lines"""

_NUMERAL, _PAGE = "substr('一二三四五六七八九', cast(doc_id % 9 as int) + 1, 1)", "cast(doc_id % 400 + 1 as string)"
_HAN = "translate(line, 'abcdefghijklmnopqrstuvwxyz.,', '法人民事权利义务合同责任当行为代理债物总则的之在。，')"

#: The same lines spelt in Chinese characters, each by its place made a heading, a contents line, a page number, a note, or
#: text with what recognition leaves in it, so that every rule of such texts has lines to find.
HAN = f"""SELECT doc_id * 100000 + pos AS id, doc_id AS book, cast(floor(pos / 30) as int) + 1 AS page, cast(pos % 30 as int) AS ord,
    CASE pos % 17 WHEN 0 THEN concat('第', n, '章 ', substr(h, 1, 8)) WHEN 1 THEN concat('第', n, '节 ', substr(h, 1, 10), '……', p) WHEN 2 THEN concat('（', n, '）', h)
    WHEN 3 THEN concat(n, '、', substr(h, 1, 12)) WHEN 4 THEN concat('①', h) WHEN 5 THEN concat(substr(h, 1, 6), ' …… ', p) WHEN 6 THEN p WHEN 7 THEN concat('第 ', p, ' 页')
    WHEN 8 THEN CASE doc_id % 7 WHEN 0 THEN '写在前面' WHEN 1 THEN '致谢' WHEN 2 THEN '目录' WHEN 3 THEN '附录' WHEN 4 THEN '初版序' WHEN 5 THEN '第二版序言' ELSE '总序' END
    WHEN 9 THEN concat(h, 'ꎬ〔p', p, '〕') WHEN 10 THEN concat(substr(h, 1, 5), '勹＄') WHEN 11 THEN concat(p, ' 民法总则编') WHEN 12 THEN concat('第', n, '章民法 ', p)
    WHEN 13 THEN concat(h, '。心（l）之（2）为（IO万元），知已知彼，淮据') WHEN 14 THEN concat('“民法“总则”有助于千台湾，一千人，＠') WHEN 15 THEN concat('〔脚注〕', h) ELSE concat(h, '。') END AS text,
    x0, x1, y0, size FROM (SELECT doc_id, pos, {_HAN} AS h, {_NUMERAL} AS n, {_PAGE} AS p, cast(50 + CASE WHEN pos % 5 = 0 THEN 20 ELSE 0 END as double) AS x0,
    cast(CASE WHEN pos % 4 = 3 THEN 200 ELSE 400 END as double) AS x1, cast((pos % 30) * 14 + floor((pos % 30) / 7) * 8 as double) AS y0,
    cast(CASE WHEN pos % 13 = 0 THEN 14 WHEN pos % 7 = 4 THEN 8 ELSE 10 END as double) AS size FROM lines)"""
