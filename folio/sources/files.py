"""Files: texts of unknown encoding, book archives, backups, day logs."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shipped

# Encodings in the order tried, the share of unreadable characters that is borne, book marks.
ENCODINGS = ("utf-8", "gbk", "gb18030")
GARBLED = 0.005
META_BEGIN, META_END = "〔元数据〕", "〔/元数据〕"
SECRET_SUFFIX = "_enc"
BACKUP_VERSION = 1


def garbled_ratio(c: Column) -> Column:
    """IO02: the share of replacement characters."""
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))) / F.length(c)).otherwise(F.lit(0.0))


def decode(data: bytes, explicit: str | None = None) -> tuple[str, str]:
    """IO01: text and encoding: by its mark, else the first encoding that reads it with few replacements."""
    if explicit:
        return data.decode(explicit, errors="replace"), explicit
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, errors="replace"), name
    for name in ENCODINGS:
        text = data.decode(name, errors="replace")
        if text.count("�") <= GARBLED * max(1, len(text)) and (name != "utf-8" or "�" not in text):
            return text, name
    return data.decode("gb18030", errors="replace"), "gb18030"


def read_texts(spark: SparkSession, path: str, explicit: str | None = None) -> DataFrame:
    """IO01: (path, text, encoding) of files of any encoding."""

    def run(batches):
        for pdf in batches:
            got = [decode(bytes(x), explicit) for x in pdf.content]
            yield pd.DataFrame({"path": pdf.path, "text": [g[0] for g in got], "encoding": [g[1] for g in got]})

    return shipped(spark.read.format("binaryFile").load(path)).select("path", "content").mapInPandas(run, "path string, text string, encoding string")


def read_kits(spark: SparkSession, path: str) -> DataFrame:
    """IO06: (path, meta, body, figures) of zip archives with kit.json, book.txt and figure files.

    Figures that are missing, have no page or would leave the archive's folder are dropped.
    """

    def one(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            meta = json.loads(z.read("kit.json").decode("utf-8-sig")) if "kit.json" in names else {}
            body = z.read("book.txt").decode("utf-8-sig") if "book.txt" in names else ""
            safe = lambda n: isinstance(n, str) and n in names and ".." not in n.split("/") and not n.startswith("/")
            figures = [json.dumps(f, ensure_ascii=False) for f in meta.get("figures", []) if isinstance(f, dict) and isinstance(f.get("page"), int) and safe(f.get("file"))]
            return json.dumps(meta, ensure_ascii=False), body, figures

    def run(batches):
        for pdf in batches:
            got = [one(bytes(x)) for x in pdf.content]
            yield pd.DataFrame({"path": pdf.path, "meta": [g[0] for g in got], "body": [g[1] for g in got], "figures": [g[2] for g in got]})

    return shipped(spark.read.format("binaryFile").load(path)).select("path", "content").mapInPandas(run, "path string, meta string, body string, figures array<string>")


def book_meta(c: Column) -> Column:
    """IO07: the chapter table in a text's header block: (title, pages, chapters), null without one."""
    block = F.regexp_extract(c, f"(?s){META_BEGIN}\\s*(.*?)\\s*{META_END}", 1)
    return F.when(block != "", F.from_json(block, "struct<title:string,pages:int,chapters:array<struct<t:string,p:int,lv:int,r:string,a:string>>>"))


def without_meta(c: Column) -> Column:
    """IO07: the text without its header block."""
    return F.regexp_replace(c, f"(?s)^\\s*{META_BEGIN}.*?{META_END}\\s*", "")


def export_backup(tables: dict[str, DataFrame], path: str) -> None:
    """IO08: each table as JSON lines under path; settings whose key marks a secret stay out."""
    for name, df in tables.items():
        kept = df.where(~F.col("key").endswith(SECRET_SUFFIX)) if name == "settings" else df
        kept.write.mode("overwrite").json(f"{path}/v{BACKUP_VERSION}/{name}")


def restore_backup(spark: SparkSession, path: str, schemas: dict, keys: dict[str, list[str]], refs: list[tuple[str, str, str, str]], version: int = BACKUP_VERSION) -> dict[str, DataFrame]:
    """IO09: the tables of a backup; an unknown version, a repeated key or an orphan is an error and nothing is returned."""
    from ..operators.relational import violations

    if version > BACKUP_VERSION:
        raise ValueError(f"backup version {version}")
    tables = {name: spark.read.schema(schema).json(f"{path}/v{version}/{name}") for name, schema in schemas.items()}
    bad = violations(tables, keys, refs).where("bad > 0").limit(5).collect()
    if bad:
        raise ValueError(", ".join(f"{r['rule']}: {r['bad']}" for r in bad))
    return tables


def day_logs(spark: SparkSession, path: str, last: str, days: int) -> DataFrame:
    """IO19: the lines of day-named logs of the last days, oldest first."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1)
    lines = spark.read.text(path).select(name.alias("day"), F.col("value").alias("line"))
    return lines.where(F.col("day").between(F.date_sub(F.lit(last).cast("date"), days - 1).cast("string"), F.lit(last))).orderBy("day")


def todo(all_pages: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """IO20, ST06: what a checkpoint table doesn't hold yet."""
    return all_pages.join(done.select(*keys), keys, "left_anti")
