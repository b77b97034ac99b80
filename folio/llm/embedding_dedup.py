"""Exact cosine neighbours of embeddings by a dual traversal of cover trees.

Vectors of one label and one direction are one point. The top of the tree is built over the whole table, level by level: a
cell with too many points is split among a few of its own points as centres, and every cell knows its covering radius.
Pairs of cells are then visited from the roots down by joins, and dropped where the distance of the centres less both
radii is above the threshold. What is left are pairs of small cells, each a task: there both sides become cover trees
in memory (nested levels, radii halved from level to level), traversed together in the same way; pairs of nodes that lie
within the threshold as a whole are counted as a whole. A task returns counts of links and a spanning forest, not the links.

Distances are chords of unit vectors: cosine c is chord sqrt(2 - 2c). Links are confirmed by the cosine itself.

Defined results: vectors that are null, empty, zero or hold a null or non-finite number, and those with a null label
or vec_id, link with nothing; vectors of different lengths don't link; repeated rows link with each other, as do all
multiples of one vector (directions that differ by less than 1e-11 in each coordinate count as one); an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .simhash import _roots, _unite
from .store import materialize, ship

#: Points of a cell, children that a larger one is split among, and levels at most; cells that are still larger are cut anyhow.
CELL, FANOUT, LEVELS = 2048, 4, 12
#: Points of a leaf, points that find their centres at a time, and what a bound gives way for rounding.
LEAF, BLOCK, SLACK = 16, 512, 1e-7
#: Pairs of points that are compared at a time.
AT_ONCE = 1 << 15


@dataclass
class Node:
    """Points within `radius` of a centre; none of its children's radii is above half the one it was made with."""

    centre: int
    radius: float
    points: np.ndarray
    children: list = field(default_factory=list)


def _chord(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _covered(x: np.ndarray, points: np.ndarray, reach: float) -> list[np.ndarray]:
    """points parted among some of them as centres, which come first: all of a part within reach of its centre."""
    centres, owner = np.zeros(0, np.int64), np.zeros(len(points), np.int64)
    for at in range(0, len(points), BLOCK):
        block = np.arange(at, min(at + BLOCK, len(points)))
        if len(centres):
            away = _chord(x[points[block]], x[points[centres]])
            owner[block] = away.argmin(axis=1)
            block = block[away.min(axis=1) > reach]
        while len(block):
            near = _chord(x[points[block[:1]]], x[points[block]])[0] <= reach
            near[0] = True
            owner[block[near]] = len(centres)
            centres = np.append(centres, block[0])
            block = block[~near]
    order = np.argsort(owner, kind="stable")
    parts = np.split(points[order], np.flatnonzero(np.diff(owner[order])) + 1)
    return [np.concatenate([points[c : c + 1], part[part != points[c]]]) for c, part in zip(centres, parts, strict=True)]


def cover_tree(x: np.ndarray, points: np.ndarray) -> Node:
    """The tree of unit vectors x[points]; the first is its centre."""
    node = Node(int(points[0]), float(_chord(x[points[:1]], x[points])[0].max()), points)
    if len(points) > LEAF and node.radius > SLACK:
        half = 2.0 ** (np.ceil(np.log2(node.radius)) - 1)  # radii are powers of two; levels that would part nothing are left out
        node.children = [cover_tree(x, part) for part in _covered(x, points, half)]
    return node


def dual_pairs(x: np.ndarray, a: Node, b: Node, chord: float):
    """(points, points, all, each): pairs that may be within the chord; all: they are. each: one with one, else all with all.

    Each pair of nodes comes once; a node with itself has its points on both sides. Pairs of leaves come many at a time.
    """
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a is b and 2 * a.radius <= chord - SLACK:
            yield a.points, a.points, True, False
            continue
        if not a.children and not b.children:
            yield a.points, b.points, False, False
            continue
        ones, twos = a.children or [a], b.children or [b]
        apart = _chord(x[[n.centre for n in ones]], x[[n.centre for n in twos]])
        radii = np.array([n.radius for n in ones])[:, None] + np.array([n.radius for n in twos])[None, :]
        near = apart <= radii + chord + SLACK
        within = apart + radii <= chord - SLACK
        leaves = np.array([not n.children for n in ones])[:, None] & np.array([not n.children for n in twos])[None, :]
        if a is b:
            near = np.triu(near)
            np.fill_diagonal(within, False)
            np.fill_diagonal(leaves, False)
        for sure in (True, False):
            i, j = np.nonzero(near & leaves & (within == sure))
            for p, q in _leaf_pairs(ones, twos, i, j):
                yield p, q, sure, True
        for i, j in zip(*np.nonzero(near & within & ~leaves), strict=True):
            yield ones[i].points, twos[j].points, True, False
        stack += [(ones[i], twos[j]) for i, j in zip(*np.nonzero(near & ~within & ~leaves), strict=True)]


def _leaf_pairs(ones: list[Node], twos: list[Node], i: np.ndarray, j: np.ndarray):
    """The pairs of points of pairs (i, j) of leaves, so many at a time."""
    if not len(i):
        return
    (p, m, at), (q, n, to) = ((np.concatenate([x.points for x in nodes]), k := np.array([len(x.points) for x in nodes]), np.cumsum(k) - k) for nodes in (ones, twos))
    many = m[i] * n[j]
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(many) // AT_ONCE)) + 1):
        pair = np.repeat(part, many[part])
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
        wide = n[j[pair]]
        yield p[at[i[pair]] + nth // wide], q[to[j[pair]] + nth % wide]


def link_cells(group: pa.Table, cosine: float) -> pa.Table:
    """Links between the two sides of a pair of cells, or within one cell: (a, b, links), b being a's parent in a forest."""
    side, point, copies = (group.column(c).to_numpy() for c in ("side", "point", "copies"))
    raw = group.column("vector").combine_chunks()
    raw = np.asarray(raw.flatten()).reshape(len(raw), -1)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    chord = float(np.sqrt(max(2 - 2 * cosine, 0)))
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    first = cover_tree(unit, one)
    second = cover_tree(unit, two) if len(two) else first
    parent, links = np.arange(len(point)), np.zeros(len(point), np.int64)

    def link(x: np.ndarray, y: np.ndarray, sure: bool) -> None:
        """Count the pairs (x, y) that are links."""
        if not sure:
            exact = (raw[x] * raw[y]).sum(axis=1) / (np.sqrt((raw[x] ** 2).sum(axis=1)) * np.sqrt((raw[y] ** 2).sum(axis=1))) >= cosine
            x, y = x[exact], y[exact]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        _unite(parent, x, y)

    for p, q, every, each in dual_pairs(unit, first, second, chord):
        if each:
            link(p, q, every)
        elif every:
            links[p] += copies[q].sum() - (copies[p] if p is q else 0)
            if p is not q:
                links[q] += copies[p].sum()
            several = np.concatenate([p, q])
            _unite(parent, several, np.full(len(several), several[0]))
        else:
            for at in range(0, len(p), BLOCK):
                i, j = np.nonzero(unit[p[at : at + BLOCK]] @ unit[q].T >= cosine - SLACK)
                i, j = p[i + at], q[j]
                once = i < j if p is q else i != j
                i, j = i[once], j[once]
                for part in range(0, len(i), AT_ONCE):
                    link(i[part : part + AT_ONCE], j[part : part + AT_ONCE], False)
    root = _roots(parent, np.arange(len(point)))
    some = np.flatnonzero(links)
    return pa.table({"a": pa.array(point[some]), "b": pa.array(point[root[some]]), "links": pa.array(links[some])})


def _apart(a: Column, b: Column) -> Column:
    """The chord of two unit vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def _split(points: DataFrame, large: DataFrame, seed: int) -> DataFrame:
    """points, those in large cells dealt to the nearest of FANOUT points of their cell."""
    inside = points.join(large.select("cell"), "cell")
    order = W.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed), "point"), "point")
    centres = inside.select("cell", "point", "unit").withColumn("n", F.row_number().over(order)).where(F.col("n") <= FANOUT)
    centres = centres.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("n", "point", "unit"))).alias("centres"))

    def nearest(batches):
        for batch in batches:
            n = len(batch)
            unit = np.asarray(batch.column("unit").flatten()).reshape(n, -1) if n else np.zeros((0, 1))
            lists = batch.column("centres")
            flat = lists.flatten()
            many = np.diff(lists.offsets.to_numpy())
            if n:
                centre = np.asarray(flat.field("unit").flatten() if flat.offset == 0 else pa.concat_arrays([flat]).field("unit").flatten()).reshape(len(flat), -1)
                own = np.repeat(np.arange(n), many)
                dot = np.einsum("ij,ij->i", centre, unit[own])
                starts = np.cumsum(many) - many
                best = np.array([s + int(np.argmax(dot[s : s + m])) for s, m in zip(starts.tolist(), many.tolist(), strict=True)], np.int64)
                child = np.asarray(flat.field("point"))[best]
            else:
                child = np.zeros(0, np.int64)
            kept = [c for c in batch.schema.names if c != "centres"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(child, pa.int64())], names=[*kept, "child"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inside.schema]
    dealt = ship(inside).join(centres, "cell").mapInArrow(nearest, ", ".join([*fields, "child long"]))
    return dealt


def _cut(points: DataFrame, pairs: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """Cells that no level made small enough in pieces, and every pair of cells as the pairs of their pieces."""
    parts = materialize(points.groupBy("cell").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts")), "cell-parts")
    if parts.where("parts > 1").isEmpty():
        return points, pairs
    piece = lambda cell, i: F.when(F.col("parts") > 1, F.xxhash64(cell, i)).otherwise(cell)
    out = points.join(parts, "cell").withColumn("cell", piece(F.col("cell"), F.pmod(F.xxhash64("point"), F.col("parts").cast("long")).cast("int"))).drop("parts")
    pieces = parts.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "parts")
    ones, twos = (pieces.select(F.col("cell").alias(c), piece(F.col("cell"), F.col("i")).alias(f"{c}2")) for c in "ab")
    both = pairs.join(ones, "a").join(twos, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
    return materialize(out, "points"), materialize(both, "cell-pairs")


def near_links(points: DataFrame, cosine: float, cell: int = CELL) -> DataFrame:
    """(a, b, links): for points (point, label, copies, vector), counts of links and a spanning forest."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, v: acc + v * v))
    size = F.size("vector")
    points = points.withColumns({"unit": F.transform("vector", lambda v: v / norm), "cell": F.xxhash64("label", size)})
    points = materialize(points, "points")
    chord = float(np.sqrt(max(2 - 2 * cosine, 0)))
    # levels of the tree: (cell, parent, centre, radius); a root has no centre and any radius
    level = points.select("cell").distinct().select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    pairs = materialize(level, "cell-pairs")
    for depth in range(LEVELS):
        counted = points.groupBy("cell").count()
        large = materialize(counted.where(F.col("count") > cell), "large-cells")
        if not large.count():
            break
        dealt = _split(points, large, depth).withColumn("next", F.xxhash64("cell", "child", F.lit(depth)))
        stay = points.join(large.select("cell"), "cell", "left_anti").withColumns({"child": F.lit(None).cast("long"), "next": F.col("cell")})
        dealt = materialize(dealt.unionByName(stay), "points")
        centre = dealt.where("point = child").select("next", F.col("unit").alias("centre"))
        moved = dealt.where("child is not null").select("cell", "next", "unit").join(centre, "next")
        nodes = moved.groupBy("cell", "next").agg(F.max(_apart(F.col("unit"), F.col("centre"))).alias("radius"))
        nodes = nodes.join(centre, "next")
        kept = large.select(F.col("cell").alias("gone"))
        still = pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct().join(kept, F.col("cell") == F.col("gone"), "left_anti")
        same = still.select("cell", F.col("cell").alias("next"), F.lit(None).cast("double").alias("radius"), F.lit(None).cast("array<double>").alias("centre"))
        nodes = materialize(nodes.select("cell", "next", "radius", "centre").unionByName(same), "cells")
        ones = nodes.select(F.col("cell").alias("a"), F.col("next").alias("a2"), F.col("radius").alias("ra"), F.col("centre").alias("ca"))
        twos = nodes.select(F.col("cell").alias("b"), F.col("next").alias("b2"), F.col("radius").alias("rb"), F.col("centre").alias("cb"))
        near = F.coalesce(_apart(F.col("ca"), F.col("cb")) <= F.col("ra") + F.col("rb") + (chord + SLACK), F.lit(True))
        pairs = pairs.join(ones, "a").join(twos, "b").where(near).select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        pairs = materialize(pairs, "cell-pairs")
        points = dealt.select("point", "label", "copies", "vector", "unit", F.col("next").alias("cell"))
    points, pairs = _cut(points, pairs, cell)
    sides = pairs.select(F.xxhash64("a", "b").alias("pair"), F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("cell")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("cell")), F.struct(F.lit(1).alias("side"), F.col("b").alias("cell"))))).alias("s"))
    sides = sides.select("pair", F.col("s.side").alias("side"), F.col("s.cell").alias("cell"))
    tasks = sides.join(points.select("cell", "point", "copies", "vector"), "cell").select("pair", "side", "point", "copies", "vector")

    def run(group: pa.Table) -> pa.Table:
        return link_cells(group, cosine)

    return ship(tasks).groupBy("pair").applyInArrow(run, "a long, b long, links long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    vector = F.col("embedding").cast("array<double>")
    wrong = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~wrong & F.exists(vector, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"), F.coalesce(able, F.lit(False)).alias("able"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, v: acc + v * v))
    rows = rows.withColumn("direction", F.when(F.col("able"), F.transform("vector", lambda v: F.round(v / norm * 1e11).cast("long"))))
    classes = rows.where("able").groupBy("label", "direction").agg(F.min(F.struct("vec_id", "vector")).alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.select("label", "direction", F.col("least.vec_id").alias("point"), F.col("least.vector").alias("vector"), "copies"), "vector-classes")
    links = materialize(near_links(classes, cosine), "vector-links")
    counts = links.groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    roots = components(links.select("a", "b")).select(F.col("node").alias("point"), "root")
    known = classes.join(counts, "point", "left").join(roots, "point", "left").select(
        "label", "direction", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "point").alias("root")
    )
    out = rows.where("able").join(known, ["label", "direction"]).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.where("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
