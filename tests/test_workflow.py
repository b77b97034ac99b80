"""Safe replacement of pages, recognised matrices, batch logs, resumable runs, and streams with timers."""

import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio.operators import rebuild as B
from folio.operators import recognition as G
from folio.operators import workflow as K
from folio.streaming import study

# --- C14

PARAGRAPHS = "book long, chapter long, idx int, page int, text string, role string"
PAGES = "book long, page int, body array<string>, notes array<string>"


def brute_rebuild(paragraphs, chapters, pages, used):
    """{book: (reason, rows)}, page by page."""
    out = {}
    for b in sorted({c[0] for c in chapters}):
        own = sorted((c[2], c[1], c[3]) for c in chapters if c[0] == b)
        place = {cid: n for n, cid, _ in own}
        rows = [p for p in paragraphs if p[0] == b]
        new = {p[1]: p for p in pages if p[0] == b}
        keep = lambda why, rows=rows: (why, sorted(rows, key=repr))
        if not new:
            out[b] = keep("nothing read")
        elif b in used:
            out[b] = keep("used")
        elif not rows or any(r[3] is None for r in rows):
            out[b] = keep("no pages")
        elif any(level != 1 for _, _, level in own):
            out[b] = keep("sections")
        else:
            ordered = sorted(rows, key=lambda r: (r[3], place[r[1]], r[2]))
            owners = {r[3]: r[1] for r in ordered}
            staged, fresh = [], 0
            for page, (_, _, body, notes) in new.items():
                before = [p for p in owners if p <= page]
                home = owners[max(before) if before else min(owners)]
                for n, text in enumerate([*body, *(["".join(notes)] if notes else [])]):
                    staged.append((home, page, 1, n, text, "FOOTNOTE" if n >= len(body) else "BODY"))
                    fresh += len(text)
            staged += [(r[1], r[3], 0, r[2], r[4], r[5]) for r in rows if r[3] not in new]
            chars = lambda rs: sum(len(r[4]) for r in rs)
            if chars(staged) < 0.8 * (chars(rows) - chars([r for r in rows if r[3] in new]) + fresh):
                out[b] = keep("text lost")
                continue
            done = []
            for _, cid, _ in own:
                mine = sorted((s for s in staged if s[0] == cid), key=lambda s: s[1:4])
                done += [(b, cid, i, s[1], s[4], s[5]) for i, s in enumerate(mine)]
            out[b] = ("done", sorted(done, key=repr))
    return out


def test_rebuild(spark):
    dice = random.Random(2)
    paragraphs, chapters, pages = [], [], []
    for b in range(12):
        page = 3
        for c in range(4):
            chapters.append((b, b * 10 + c, c, 2 if b == 5 and c == 2 else 1))
            for i in range(dice.randrange(1, 6)):
                paragraphs.append((b, b * 10 + c, i, None if b == 6 and i == 0 else page, f"旧文{b}-{c}-{i}" * dice.randrange(1, 4), "BODY"))
                page += dice.random() < 0.6
        for p in range(1, page + 4):
            if b != 7 and dice.random() < 0.4:
                pages.append((b, p, [f"新文{b}-{p}-{k}" for k in range(dice.randrange(0, 4))], [f"注{p}"] * dice.randrange(0, 2)))
    used = {8}
    figures = [(b, b * 100 + p, p, b * 10) for b in range(12) for p in (1, 4, 7, 30)]
    frames = spark.createDataFrame(paragraphs, PARAGRAPHS), spark.createDataFrame(chapters, "book long, id long, idx int, level int"), spark.createDataFrame(pages, PAGES)
    out, homes, verdicts = B.rebuild_if_safe(*frames, spark.createDataFrame([(u,) for u in used], "book long"), spark.createDataFrame(figures, "book long, id long, page int, chapter long"))
    rows, reasons = defaultdict(list), {r.book: r.reason for r in verdicts.collect()}
    for r in out.collect():
        rows[r.book].append(tuple(r))
    truth = brute_rebuild(paragraphs, chapters, pages, used)
    assert reasons == {b: why for b, (why, _) in truth.items()} and set(reasons.values()) >= {"done", "used", "no pages", "sections", "nothing read"}
    for b, (_, expected) in truth.items():
        assert sorted(rows[b], key=repr) == expected
    for r in homes.collect():
        starts = {cid: min(x[3] for x in rows[r.book] if x[1] == cid) for cid in {x[1] for x in rows[r.book]}} if reasons[r.book] == "done" else {}
        before = [(s, -cid) for cid, s in starts.items() if s <= r.page]
        assert r.chapter == (-max(before)[1] if before else r.book * 10)


def test_read_again(spark):
    body = ["第一章总则 1", "第二章债 20", "第三章物权 30", "一、案例•(188)二、思考模式•(189)"]
    rows = B.read_again(spark.createDataFrame([(1, 1, body, []), (1, 2, ["甲", "乙"], ["注一", "注二"])], PAGES)).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.n) if r.page == 1][-2:] == ["一、案例•(188)", "二、思考模式•(189)"] and {r.role for r in rows if r.page == 1} == {"TOC"}
    assert [(r.text, r.role) for r in sorted(rows, key=lambda r: r.n) if r.page == 2] == [("甲", "BODY"), ("乙", "BODY"), ("注一注二", "FOOTNOTE")]


# --- M07


def brute_ctc(scores, classes, alphabet):
    text, sure, before = "", [], 0
    for t in range(len(scores) // classes):
        step = scores[t * classes : (t + 1) * classes]
        best = step.index(max(step))
        if best not in (0, before) and best <= len(alphabet):
            text += alphabet[best - 1]
            sure.append(step[best])
        before = best
    return text, sum(sure) / len(sure) if sure else 0.0


def test_ctc(spark):
    dice = random.Random(4)
    rows = [(i, [dice.choice([0.0, 0.25, 0.5, 0.75, 1.0]) for _ in range(5 * dice.randrange(0, 12))]) for i in range(60)] + [(99, None)]
    got = spark.createDataFrame(rows, "id long, s array<double>").select("id", G.ctc_decode(F.col("s"), 5, F.lit("abc")).alias("v")).collect()
    for r in got:
        if rows[min(r.id, 60)][1] is not None:
            text, sure = brute_ctc(rows[r.id][1], 5, "abc")
            assert r.v.text == text and abs(r.v.confidence - sure) < 1e-12


def test_boxes(spark):
    width = 40
    blank = [0.0] * (width * 60)

    def drawn(*rects):
        cells = list(blank)
        for x0, y0, x1, y1, p in rects:
            for y in range(y0, y1 + 1):
                cells[y * width + x0 : y * width + x1 + 1] = [p] * (x1 - x0 + 1)
        return cells

    maps = [
        (1, drawn((5, 5, 14, 9, 0.9))), (2, drawn((5, 5, 14, 9, 0.4))), (3, drawn((5, 5, 8, 8, 0.9))), (4, drawn((2, 5, 21, 12, 0.9), (23, 5, 38, 12, 0.9))),
        (5, drawn((2, 2, 9, 7, 0.9), (10, 8, 17, 13, 0.9))), (6, drawn((2, 40, 12, 46, 0.8), (2, 2, 12, 8, 0.8))), (7, None), (8, []),
    ]
    found = defaultdict(list)
    for r in sorted(G.detected_boxes(spark.createDataFrame(maps, "id long, cells array<double>"), width).collect(), key=lambda r: (r.id, r.n)):
        found[r.id].append((r.x0, r.y0, r.x1, r.y1))
    assert dict(found) == {1: [(3, 3, 16, 11)], 4: [(0, 3, 39, 14)], 5: [(0, 0, 21, 16)], 6: [(0, 0, 14, 10), (0, 38, 14, 48)]}


# --- R19, C29


def test_batch_states(spark):
    dice = random.Random(9)
    log = [(b, k, s, dice.choice(["next", "pass", "fail", "retry", "reopen", "noise"])) for b in range(4) for k in range(5) for s in range(dice.randrange(1, 30))]
    got = {(r.book, r.batch, r.seq): (r.before, r.after, r.legal) for r in K.batch_states(spark.createDataFrame(log, "book long, batch long, seq long, command string")).collect()}
    state, last = {}, {}
    for b, k, s, command in log:
        was = state.get((b, k), "pending")
        now = K.MOVES.get((was, command))
        assert got[b, k, s] == (was, now or was, now is not None)
        state[b, k] = last[b, k] = now or was
    assert len(got) == len(log) and len(set(state.values())) == 4
    frame = spark.createDataFrame([(b, k, a) for (b, k), a in last.items()], "book long, batch long, after string")
    first = {b: min(k for (x, k), a in last.items() if x == b and a == "pending") for b in {b for (b, _), a in last.items() if a == "pending"}}
    assert {r.book: r.batch for r in K.next_batches(frame).collect()} == first


def test_run_book(spark):
    dice = random.Random(7)
    units = [(b, c + 10 * b, 9 - c, p, u, f"k{dice.randrange(40)}", 1, "m") for b in range(6) for c in range(4) for p in (0, 1) for u in range(3)]
    cache = [(f"k{i}", 1, dice.choice(["m", "m", "other"])) for i in range(0, 40, 3)]
    outcomes = [(u[0], u[1], u[3], u[4], dice.random() < 0.97 or u[0] == 0) for u in units if dice.random() < 0.98 or u[0] == 0]
    got = K.run_book(
        spark.createDataFrame(units, "book long, chapter long, idx int, phase int, unit int, key string, version int, model string"), spark.createDataFrame(cache, "key string, version int, model string"),
        spark.createDataFrame(outcomes, "book long, chapter long, phase int, unit int, ok boolean"),
    )
    actions = {(r.book, r.chapter, r.phase, r.unit): r.action for r in got.collect()}
    there, ok = set(cache), {o[:4]: o[4] for o in outcomes}
    states = {r.book: r for r in K.book_states(got).collect()}
    for b in range(6):
        stopped, calls = False, 0
        for _, c, _, p, u, key, version, model in sorted((x for x in units if x[0] == b), key=lambda x: (x[2], x[3], x[4])):
            if stopped:
                expected = "waiting"
            elif (key, version, model) in there:
                expected = "cached"
            else:
                made = ok.get((b, c, p, u))
                expected = "called" if made else "failed" if made is False else "waiting"
                calls += made is not None
                stopped = not made
            assert actions[b, c, p, u] == expected
        assert (states[b].state, states[b].calls) == ("Interrupted" if stopped else "Succeeded", calls)
    assert {r.state for r in states.values()} == {"Interrupted", "Succeeded"}


# --- streams with timers


def test_cool_downs(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    parts = [[("a", at(0), "429"), ("b", at(0), "net"), ("c", at(5), "40x"), ("d", at(5), "ok")], [("z", at(299), "ok")], [("b", at(400), "net"), ("c", at(400), "429")], [("z", at(1799), "ok"), ("a", at(600), "net")], [("z", at(4000), "ok")], [("z", at(9000), "ok")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "profile string, ts timestamp, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("profile string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = study.cool_downs(stream).writeStream.format("memory").queryName("cool").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = defaultdict(list)
    for r in spark.sql("select * from cool").collect():
        got[r.profile].append((int((r.at - t0).total_seconds()), r.state))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(0, "resting"), (900, "ready")], "b": [(0, "resting"), (300, "ready"), (400, "resting"), (700, "ready")], "c": [(5, "off")]}


@pytest.mark.parametrize("flush", [100, 60_000])
def test_bundled_deltas(spark, tmp_path, flush):
    path, schema = f"{tmp_path}/in", "stream long, seq long, delta string, last boolean"
    name = f"bundles{flush}"
    spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "x", False)], schema).coalesce(1).write.parquet(f"{path}/0")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    q = study.bundled_deltas(stream, flush).writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="50 milliseconds").start()
    found = lambda: sorted((r.stream, r.first_seq, r.last_seq, r.text) for r in spark.sql(f"select * from {name}").collect())
    end = time.time() + 40
    while sum(p["numInputRows"] for p in q.recentProgress) < 3 and time.time() < end:
        time.sleep(0.2)
    while flush == 100 and len(found()) < 2 and time.time() < end:  # nothing comes in: the timers let the bundles go
        time.sleep(0.2)
    assert found() == ([(1, 1, 2, "ab"), (2, 1, 1, "x")] if flush == 100 else [])
    spark.createDataFrame([(1, 3, "c", True), (2, 2, "y", False), (2, 3, "z", True)], schema).coalesce(1).write.parquet(f"{path}/1")
    end = time.time() + 40
    while not {(1, 3), (2, 3)} <= {(r[0], r[2]) for r in found()} and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert {s: "".join(r[3] for r in found() if r[0] == s) for s in (1, 2)} == {1: "abc", 2: "xyz"}
