"""Merkle manifest of a data set: a leaf for every row, a subroot for every source, one root, and proofs that lead there.

H is the lowercase hex SHA-256 of its inputs, one after the other, digests as hex text. A leaf is H of a row's fields,
each `-` if null, else its UTF-8 byte count, `:` and its value. Leaves get row numbers within their source, in ranges of
the order that are counted apart and added up, so that a source of any size is many groups. A level divides the row
numbers by the fanout, collects each run of so many digests in order, and hashes it into the parent; what remains of a
source is its subroot, and the subroots are the leaves of a last tree. Every level is a table in the shared folder.
From the root down, a join for each level appends a node's siblings to what its parent has, so that only the last
join is as large as the data set.

Defined results: rows of one source follow each other by id (nulls first), equal ids by their leaves, and repeated rows
are leaves of their own; the null source comes first and is not the empty one; null, empty and long texts are values as
any; further columns take no part; a source of one row has that leaf as its subroot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def framed(c: Column) -> Column:
    """A field as it is hashed."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(row: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in row.values()]), 256)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with idx, the row number within its group by order (from 0), and n, the rows of the group."""
    # Rows alike in all of order are interchangeable: a last random key lets ranges part them too.
    dealt = df.withColumn("__salt", F.rand(1)).repartitionByRange(partitions(df), *group, *order, "__salt")
    dealt = materialize(dealt.withColumn("__part", F.spark_partition_id()), "manifest-rows")
    by = W.partitionBy(*group)
    counts = dealt.groupBy(*group, "__part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(by.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*group, "__part", before.alias("__before"), F.sum("rows").over(by).alias("n"))
    within = F.row_number().over(W.partitionBy(*group, "__part").orderBy(*order)) - 1
    rows = dealt.withColumn("__within", within).join(counts, [*group, "__part"])
    return rows.withColumn("idx", F.col("__before") + F.col("__within")).drop("__salt", "__part", "__before", "__within")


class Trees:
    """Trees over nodes (tree, idx, n, digest, item): idx from 0 to n - 1 within each tree."""

    def __init__(self, nodes: DataFrame, fanout: int = 3):
        self.levels: list[DataFrame] = []
        self.tops: list[DataFrame] = []
        self.fanout, item = fanout, nodes.schema["item"].dataType
        nodes = materialize(nodes.select("tree", "idx", "n", "digest", "item"), "manifest-nodes")
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most:
            self.tops.append(nodes.where("n = 1"))
            if most == 1:
                break
            runs = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {fanout}").alias("parent"), "n")
            runs = runs.agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "item"))).alias("run"))
            runs = materialize(runs.withColumn("digest", F.sha2(F.array_join("run.digest", ""), 256)), "manifest-level")
            self.levels.append(runs)
            nodes = runs.select("tree", F.col("parent").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), "digest", F.lit(None).cast(item).alias("item"))
            most = -(-most // fanout)

    def roots(self) -> DataFrame | None:
        """(tree, digest) of what remains of each tree; None of no nodes."""
        every = None
        for top in self.tops:
            top = top.select("tree", "digest")
            every = top if every is None else every.unionByName(top)
        return every

    def leaves(self, start: DataFrame) -> DataFrame:
        """(item, digest, path, top) of every leaf; start has (tree, path, top), the path that goes on from each tree's root."""
        here = None
        for level in reversed(range(len(self.tops))):
            ended = self.tops[level].join(start, "tree").select("tree", "idx", "digest", "item", "path", "top")
            if here is not None:
                above = here.select("tree", F.col("idx").alias("parent"), "path", "top")
                rows = self.levels[level].drop("digest").join(above, ["tree", "parent"])
                rows = rows.select("tree", "path", "top", "run", F.posexplode("run").alias("at", "own"))
                side = lambda taken: F.array_join(taken["digest"], "")
                beside = F.struct(side(F.slice("run", F.lit(1), F.col("at"))).alias("left"), side(F.slice("run", F.col("at") + 2, F.lit(self.fanout))).alias("right"))
                ended = ended.unionByName(rows.select("tree", "own.idx", "own.digest", "own.item", F.concat(F.array(beside), "path").alias("path"), "top"))
            here = ended
        return here.select("item", "digest", "path", "top")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source", fanout: int = 3) -> DataFrame:
    """(key, leaf, subroot, root, path, what carry names) of every row; path has the siblings of each level, left and right."""
    carry = carry or {}
    item = F.struct(F.col(key).alias("key"), *[c.alias(name) for name, c in carry.items()])
    tree = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source))
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf_of({f: F.col(f) for f in fields}).alias("digest"), item.alias("item"))
    trees = Trees(numbered(materialize(rows, "manifest-leaves"), ["tree"], ["key", "digest"]), fanout)
    kind = docs.schema[key].dataType
    roots = trees.roots()
    if roots is None:
        return docs.sparkSession.createDataFrame([], f"{key} {kind.simpleString()}, leaf string, subroot string, root string, path {PATH}").select("*", *[F.lit(None).alias(name) for name in carry])
    subroots = numbered(roots.select(F.lit("").alias("all"), "tree", "digest"), ["all"], ["tree"])
    upper = Trees(subroots.select(F.lit("").alias("tree"), "idx", "n", "digest", F.struct(F.col("tree").alias("of")).alias("item")), fanout)
    root = upper.roots().first()["digest"]
    start = docs.sparkSession.createDataFrame([("", [], root)], f"tree string, path {PATH}, top string")
    start = upper.leaves(start).select(F.col("item.of").alias("tree"), "path", F.col("digest").alias("top"))
    found = trees.leaves(start)
    return found.select(F.col("item.key").alias(key), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).alias("root"), "path", *[f"item.{name}" for name in carry])
