from pyspark.sql import functions as F

from folio.streaming import study


def run(stream, mode):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.sql("select * from out").collect()


def source(spark, rows, schema, path):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("overwrite").json(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def test_minutes(spark, tmp_path):
    s = source(spark, [[(1, "d", 5), (2, "d", 1)], [(1, "d", 7)]], "book_id long, day string, minutes long", str(tmp_path))
    got = run(study.minutes_by_day(s), "complete")
    assert sorted((r.book_id, r.minutes) for r in got) == [(1, 12), (2, 1)]


def test_feed_split_marks():
    shown, pending, thinking = "", "", False
    for delta in ["a<th", "ink>hid", "den</thi", "nk>b<", "c"]:
        more, pending, thinking = study.feed(pending, thinking, delta)
        shown += more
    assert shown + pending == "ab<c" and not thinking


def test_visible_text(spark, tmp_path):
    s = source(spark, [[(1, 1, "x<thi", False), (1, 2, "nk>y</think>z<", True)], [(2, 1, "<think>never", True)]], "stream long, seq long, delta string, last boolean", str(tmp_path))
    got = run(study.visible_text(s), "append")
    text = {k: "".join(r.text for r in sorted(got, key=lambda r: r.seq) if r.stream == k) for k in (1, 2)}
    assert text == {1: "xz<", 2: ""}


def test_queue(spark):
    rows = spark.createDataFrame([(1, False), (1, True), (2, False), (2, False), (2, False), (3, False)], "page int, ok boolean")
    assert {r.page: r.status for r in study.queue_states(rows).collect()} == {1: "DONE", 2: "FAILED", 3: "PENDING"}
    assert study.queue_states(rows).select(F.sum("attempts")).first()[0] == 5
