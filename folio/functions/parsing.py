"""Parsing of model replies and stored JSON: lenient numbers, tagged text, quizzes, terms, trees, budgets, turns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from ..cluster import shipped
from .text import trimmed

# Question kinds, decisions, the largest groups, the share of paragraphs that may be missing.
QUIZ_KINDS = ["RECALL", "APPLY", "CONTRAST"]
ACTIONS = ["skip", "explain", "group"]
MISSING_SHARE = 0.3


def lenient_int(c: Column) -> Column:
    """X02: "3", 3.0 and the like as an int; -1 for null and anything else."""
    number = trimmed(c.cast("string")).try_cast("double")
    return F.coalesce(F.when(number > 0, F.floor(number)).otherwise(F.ceil(number)).cast("int"), F.lit(-1))


def decode_quiz(c: Column) -> Column:
    """Questions of a stored quiz; of unknown kinds are made the first kind, bad JSON is an empty list."""
    quiz = F.coalesce(F.from_json(c, "array<struct<q:string,type:string>>"), F.array().cast("array<struct<q:string,type:string>>"))
    return F.transform(quiz, lambda x: F.struct(x["q"].alias("q"), F.when(x["type"].isin(QUIZ_KINDS), x["type"]).otherwise(QUIZ_KINDS[0]).alias("type")))


def first_terms(chapters: DataFrame) -> DataFrame:
    """Each term of a book at its first chapter, white space aside. chapters: id, book_id, idx, key_terms_json."""
    terms = F.from_json("key_terms_json", "array<struct<term:string,plain:string>>")
    rows = chapters.select("book_id", F.col("id").alias("chapter"), "idx", F.posexplode(terms).alias("pos", "t")).select("*", "t.*")
    w = W.partitionBy("book_id", F.regexp_replace("term", r"\s", "")).orderBy("idx", "pos")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("book_id", "chapter", "term", "plain")


def tag(c: Column, name: str, unclosed: bool = False) -> Column:
    """What stands between a tag and its end, trimmed; null without it. unclosed: up to the end will do."""
    found = F.regexp_extract(c, rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1)
    has = c.rlike(rf"(?s)<{name}>.*</{name}>")
    rest = F.when(c.contains(f"<{name}>"), trimmed(F.regexp_extract(c, rf"(?s)<{name}>(.*)$", 1))) if unclosed else F.lit(None).cast("string")
    return F.when(has, found).otherwise(rest)


def tagged(c: Column, names: list[str]) -> Column:
    """All tags, or null if one is missing or empty."""
    parts = [tag(c, n) for n in names]
    whole = reduce(lambda a, b: a & b, [F.coalesce(p != "", F.lit(False)) for p in parts])
    return F.when(whole, F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)]))


@F.pandas_udf(StringType())
def json_slice(raw: pd.Series) -> pd.Series:
    """The first balanced JSON value of a reply, without a code fence; null if there is none."""
    import re

    marks = re.compile(r'["\\{}\[\]]')

    def one(text):
        if text is None:
            return None
        fenced = re.match(r"(?s)\s*```[^\n]*\n(.*?)(?:```(?!.*```).*)?$", text)
        text = fenced[1] if fenced else text
        begin = re.search(r"[{\[]", text)
        if not begin:
            return None
        opening = begin[0]
        closing = {"{": "}", "[": "]"}[opening]
        depth, quoted, skip = 0, False, -1
        for m in marks.finditer(text, begin.start()):
            at, ch = m.start(), m[0]
            if at == skip:
                continue
            if quoted:
                if ch == "\\":
                    skip = at + 1
                elif ch == '"':
                    quoted = False
            elif ch == '"':
                quoted = True
            elif ch in (opening, closing):
                depth += 1 if ch == opening else -1
                if not depth:
                    return text[begin.start() : at + 1]
        return None

    return raw.map(one)


def parse_plan(replies: DataFrame, block: str, known: str, reply: str) -> DataFrame:
    """(block, id, action, start, why), one row for each decision of a reply, or none where too many are missing.

    known: the array of the block's ids. Unknown ids and actions are dropped; groups of other than two or three
    neighbours become explanations; of repeated ids the last counts.
    """
    schema = "struct<paragraphs:array<struct<id:string,action:string,group:array<string>,why:string>>>"
    rows = replies.select(block, known, F.posexplode(F.from_json(reply, schema)["paragraphs"]).alias("pos", "p"))
    group = F.transform(F.coalesce("p.group", F.array().cast("array<string>")), lenient_int)
    rows = rows.select(block, known, "pos", lenient_int(F.col("p.id")).alias("id"), F.lower(F.trim("p.action")).alias("action"), group.alias("g"), F.left("p.why", F.lit(40)).alias("why"))
    rows = rows.where(F.array_contains(known, F.col("id")) & F.col("action").isin(ACTIONS))
    low, high = F.array_min("g"), F.array_max("g")
    fits = F.size("g").between(2, 3) & (F.size(F.array_except("g", known)) == 0) & (F.col("g") == F.sequence(low, F.greatest(low, high)))
    fits = F.when(F.size("g") > 0, fits).otherwise(F.lit(False))
    action = F.when(F.col("action") == "group", F.when(fits, "GROUP").otherwise("EXPLAIN")).otherwise(F.upper("action"))
    rows = rows.select(block, known, "pos", "id", action.alias("action"), F.when(action == "GROUP", low).alias("start"), "why")
    last = rows.groupBy(block, "id").agg(F.max_by(F.struct(known, "action", "start", "why"), "pos").alias("r")).select(block, "id", "r.*")
    enough = F.count("*").over(W.partitionBy(block)) >= F.size(known) - F.floor(F.size(known) * MISSING_SHARE)
    return last.withColumn("ok", enough).where("ok").select(block, "id", "action", "start", "why")


def tree_parents(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """(doc, order, topic, depth, parent): an indented tree's nodes; parent is the order of the nearest shallower line before.

    A tab is a level; without tabs four spaces are. List and heading marks before a topic are dropped. Rows stream in
    order through sorted partitions; what is held is the line of each depth that the current one stands below.
    """
    indent = F.regexp_extract(line, r"^([\t ]*)", 1)
    tabs = F.regexp_count(indent, F.lit("\t"))
    depth = F.when(tabs > 0, tabs).otherwise(F.floor(F.length(indent) / 4).cast("int"))
    topic = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed(F.col(line)), r"^[\-•·*]\s+", ""), r"^#{1,6}\s*", ""), r"^\*+|\*+$", ""))
    nodes = lines.select(doc, order, depth.alias("depth"), topic.alias("topic")).where("topic <> ''")
    kinds = dict(nodes.dtypes)

    def run(batches):
        current, above = None, []
        for pdf in batches:
            parents = []
            for d, at, depth in zip(pdf["d"], pdf["o"], pdf["depth"], strict=True):
                if d != current:
                    current, above = d, []
                while above and above[-1][0] >= depth:
                    above.pop()
                parents.append(above[-1][1] if above else None)
                above.append((depth, at))
            yield pdf.assign(parent=pd.array(parents, "Int64"))

    rows = shipped(nodes.select(F.col(doc).alias("d"), F.col(order).alias("o"), "topic", "depth")).repartition("d").sortWithinPartitions("d", "o")
    rows = rows.mapInPandas(run, f"d {kinds[doc]}, o {kinds[order]}, topic string, depth int, parent {kinds[order]}")
    return rows.select(F.col("d").alias(doc), F.col("o").alias(order), "topic", "depth", "parent")


def first_within(tiers: list[Column], budget: int) -> Column:
    """The first tier that fits the budget, else the last."""
    return F.coalesce(*[F.when(F.length(t) <= budget, t) for t in tiers[:-1]], tiers[-1])


def texts_within(df: DataFrame, group: str, order: str, each: int = 10_000, total: int = 40_000) -> DataFrame:
    """Each text cut at `each` characters, and at what the group's `total` leaves; none once that is used up."""
    cut = F.least(F.length("text"), F.lit(each))
    before = F.coalesce(F.sum(cut).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.least(cut.cast("long"), F.lit(total) - before).cast("int")
    return df.withColumn("__before", before).where(F.col("__before") < total).withColumn("part", F.left("text", room)).drop("__before")


def last_messages(turns: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The last n turns of each conversation, oldest first."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    rest = [c for c in turns.columns if c not in (key, order)]
    kept = turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("messages"))


def explain_units(paragraphs: DataFrame) -> DataFrame:
    """(chapter_id, anchor, members): single explained paragraphs, and groups of up to three.

    A group's anchor is the member whose idx is the group's id, else its first; of one member only it is single.
    """
    single = paragraphs.where("ai_action = 'EXPLAIN'").select("chapter_id", F.col("idx").alias("anchor"), F.array("idx").alias("members"))
    grouped = paragraphs.where("ai_action = 'GROUP' and group_id is not null").groupBy("chapter_id", "group_id").agg(F.slice(F.sort_array(F.collect_list("idx")), 1, 3).alias("members"))
    anchor = F.when(F.array_contains("members", F.col("group_id").cast("int")), F.col("group_id").cast("int")).otherwise(F.get("members", F.lit(0)))
    members = F.when(F.size("members") < 2, F.array(anchor)).otherwise(F.col("members"))
    return single.unionByName(grouped.select("chapter_id", anchor.alias("anchor"), members.alias("members")))


def rulings(c: Column) -> Column:
    """Lines of `title | ruling` as a map; the last line of a title counts."""
    lines = F.filter(F.split(c, r"\n"), lambda x: x.contains("|"))
    pairs = F.transform(lines, lambda x: F.struct(trimmed(F.split(x, r"\|", 2)[0]).alias("k"), trimmed(F.split(x, r"\|", 2)[1]).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_entries(F.array(p))))


