"""SimHash near-duplicates: a binary trie self-join of 64-bit fingerprints under a Hamming budget.

Fingerprints within `budget` bits agree on at least s of `budget + s` blocks of bits. For every choice of s blocks, the
fingerprints that share them are the leaves of one subtrie over the other bits, and each subtrie is joined with itself:
pairs of nodes are visited together, the bits in which they differ are added up, and a pair is dropped as soon as they
exceed the budget, or when one component holds all leaves of both. s grows with the logarithm of the number of
fingerprints, so that subtries stay small and many, and tasks share them evenly; from each, only a spanning forest of the
links found comes out. Documents with one fingerprint are one leaf.

Defined results: a null or empty text has no words and the fingerprint 0, linked like any other; a text of fewer
words than a shingle is one shingle; a null doc_id is kept, and is no component's least id unless alone; repeated
rows are returned as often as they occur; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shingles
from .components import components
from .store import materialize, ship
from .tokens import text_blocks

#: Node pairs with at most this many leaf pairs are compared leaf by leaf; so many pairs are compared at a time.
LEAF_PAIRS, AT_ONCE = 64, 1 << 20
#: Leaves of a subtrie on average, at most; the most blocks that its leaves share.
LEAVES, MOST_SHARED = 256, 4


def simhash(text: bytes, words: int, seed: int = 42) -> int:
    """The fingerprint of a text: bit by bit the majority of its shingles' XXH64."""
    joined = shingles.normal(text)
    return shingles.majority(shingles.every(joined, words, seed)) if joined else 0


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, fp) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch.column("text")):
                fp = np.array([simhash(x, words) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(fp)], names=["doc_id", "fp"])

    return ship(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def shared_blocks(n: int, budget: int) -> int:
    """How many blocks the leaves of a subtrie share, so that n random fingerprints make subtries of few leaves."""
    fits = (s for s in range(1, MOST_SHARED) if n >> (64 * s // (budget + s)) <= LEAVES)
    return next(fits, MOST_SHARED)


def block_orders(budget: int, shared: int) -> list[tuple[list[int], int]]:
    """For every choice of so many of the budget + shared blocks: all bits (from the highest) with those blocks first, and how many these are."""
    edges = np.linspace(0, 64, budget + shared + 1).astype(int)
    blocks = [list(range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = []
    for chosen in combinations(range(len(blocks)), shared):
        head = [b for i in chosen for b in blocks[i]]
        out.append((head + [b for b in range(64) if b not in head], len(head)))
    return out


def _runs(order: list[int]) -> list[tuple[int, int, int]]:
    """The stretches of an order of bits: (from, to, how many), from the highest bit."""
    out: list[tuple[int, int, int]] = []
    for to, bit in enumerate(order):
        if out and out[-1][0] + out[-1][2] == bit:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((bit, to, 1))
    return out


def _move(fp: np.ndarray, runs: list[tuple[int, int, int]], back: bool = False) -> np.ndarray:
    out = np.zeros_like(fp)
    for bit, to, n in runs:
        a, b = (to, bit) if back else (bit, to)
        out |= (fp >> np.uint64(64 - a - n) & np.uint64((1 << n) - 1)) << np.uint64(64 - b - n)
    return out


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        parent[at] = parent[up]
        at = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(parent, a, b)


def trie_links(leaves: np.ndarray, first: np.ndarray, end: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """The parent of each leaf in a spanning forest of all links within the subtries.

    leaves: distinct fingerprints; those from first to end are a subtrie, sorted, equal in their highest `depth` bits.
    """
    everything = np.arange(len(leaves))
    parent = everything.copy()
    # neighbours in the order first: a large group of near fingerprints is then mostly one component
    place, subtrie = _ranges(first, end), np.repeat(np.arange(len(first)), end - first)
    pair = place[:-1][subtrie[1:] == subtrie[:-1]]
    pair = pair[np.bitwise_count(leaves[pair] ^ leaves[pair + 1]) <= budget]
    _unite(parent, pair, pair + 1)
    alo, ahi, blo, bhi, diff = first, end, first, end, np.zeros(len(first), np.int64)
    while len(alo):
        root = _roots(parent, everything)
        turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        apart = (turns[ahi - 1] != turns[alo]) | (turns[bhi - 1] != turns[blo]) | (root[alo] != root[blo])
        alo, ahi, blo, bhi, diff = (x[apart] for x in (alo, ahi, blo, bhi, diff))
        same = alo == blo
        many = (ahi - alo) * (bhi - blo)
        near = diff + 64 - depth <= budget  # whatever the other bits are
        _unite(parent, np.repeat(alo[near], (bhi - blo)[near]), _ranges(blo[near], bhi[near]))
        _unite(parent, np.repeat(blo[near], (ahi - alo)[near]), _ranges(alo[near], ahi[near]))
        flat = ~near & ((many <= LEAF_PAIRS) | (depth >= 64))
        order = np.flatnonzero(flat & ~(same & (many == 1)))
        for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(many[order]) // AT_ONCE)) + 1):
            width = (bhi - blo)[part]
            pair = np.repeat(part, many[part])
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            a, b = alo[pair] + nth // np.repeat(width, many[part]), blo[pair] + nth % np.repeat(width, many[part])
            close = (a != b) & (np.bitwise_count(leaves[a] ^ leaves[b]) <= budget)
            _unite(parent, a[close], b[close])
        on = ~flat & ~near
        alo, ahi, blo, bhi, diff, same = (x[on] for x in (alo, ahi, blo, bhi, diff, same))
        if not len(alo):
            break
        high, bit = np.uint64(64 - depth), np.uint64(1 << (63 - depth))

        def middle(lo, hi, high=high, bit=bit, depth=depth):
            prefix = leaves[lo] >> high << high if depth else np.zeros(len(lo), np.uint64)
            # a subtrie is sorted, but the array need not be: bisect each range by itself
            low, top, want = lo.copy(), hi.copy(), prefix | bit
            while (low < top).any():
                mid = (low + top) // 2
                less = (low < top) & (leaves[np.minimum(mid, len(leaves) - 1)] < want)
                low, top = np.where(less, mid + 1, low), np.where(less | (low >= top), top, mid)
            return low

        am, bm = middle(alo, ahi), middle(blo, bhi)
        children = [(alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), tuple(x[~same] for x in (am, ahi, blo, bm, diff + 1))]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (ahi > alo) & (bhi > blo) & (diff <= budget)
        alo, ahi, blo, bhi, diff = (x[alive] for x in (alo, ahi, blo, bhi, diff))
        depth += 1
    return _roots(parent, everything)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    many = hi - lo
    return np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)


def near_links(classes: DataFrame, budget: int, shared: int | None = None) -> DataFrame:
    """(a, b): links between the fingerprints of classes (fp) that join all those within the budget, in few rows."""
    orders = [(_runs(order), head) for order, head in block_orders(budget, shared or shared_blocks(classes.count(), budget))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i, (runs, head) in enumerate(orders):
                moved = _move(fp, runs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i)), pa.array((moved >> np.uint64(64 - head)).astype(np.int64)), pa.array(moved.view(np.int64))], names=["nth", "subtrie", "leaf"])

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, (runs, head) in enumerate(orders):
            lo, hi = np.searchsorted(rows[0], [i, i + 1])
            if lo == hi:
                continue
            subtrie, leaf = rows[1, lo:hi], rows[2, lo:hi].view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], subtrie[1:] != subtrie[:-1]]))
            end = np.concatenate([first[1:], [hi - lo]])
            several = end - first > 1
            root = trie_links(leaf, first[several], end[several], head, budget)
            linked = np.flatnonzero(root != np.arange(hi - lo))
            node = _move(leaf, runs, back=True).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the last subtrie, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            rows = np.array([batch.column(c).to_numpy() for c in ("nth", "subtrie", "leaf")])
            if held and (held[-1][:2, -1] == rows[:2, 0]).all() and (rows[:2, 0] == rows[:2, -1]).all():
                held.append(rows)
                continue
            whole = int(np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0)).max(initial=-1)) + 1
            yield from links(np.concatenate([*held, rows[:, :whole]], axis=1))
            held = [rows[:, whole:]]
        if held:
            yield from links(np.concatenate(held, axis=1))

    dealt = ship(classes).select("fp").mapInArrow(deal, "nth long, subtrie long, leaf long")
    return dealt.repartition("nth", "subtrie").sortWithinPartitions("nth", "subtrie", "leaf").mapInArrow(join, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = 5, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    component_id: the least doc_id reachable by links between fingerprints that differ in at most `budget` bits.
    """
    found = materialize(fingerprints(docs, words), "simhash")
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(near_links(classes, budget)).withColumnRenamed("node", "linked")
    rooted = classes.join(roots, F.col("fp") == F.col("linked"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_pairs(nodes: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b), a < b, of nodes (node, fp): few pairs that join all those of equal fingerprints, or of some within the budget."""
    nodes = materialize(nodes, "simhash-nodes")
    classes = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "simhash-classes")
    ends = [classes.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}")) for c in "ab"]
    linked = near_links(classes, budget).join(ends[0], "a").join(ends[1], "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    equal = nodes.join(classes, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return materialize(equal.unionByName(linked).distinct(), "simhash-pairs")


def one_of_each(docs: DataFrame, words: int = 5, budget: int = 4) -> DataFrame:
    """docs without those that some smaller doc_id is reachable from, by links between texts of a Jaccard likeness of 0.8 or more.

    Texts whose fingerprints the trie join links are compared first, shingle by shingle; the links between texts whose
    fingerprints differ in more than `budget` bits are found by their leading shingles.
    Of repeated rows (one doc_id and one text) one stays, as of equal texts without a doc_id where nothing like them has one.
    """
    groups = shingles.near_groups(docs, words, lambda nodes: near_pairs(nodes, budget))
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    known = groups.join(kept, "root").groupBy(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark")).agg(F.max(first).alias("__first"), F.count("*").alias("__n"))
    known = materialize(known, "one-of-each")
    rows = docs.join(known, docs["doc_id"].cast("long").eqNullSafe(known["__doc"]) & (shingles.mark_of(F.col("text")) == known["__mark"]), "left")
    out = rows.where("__first is null or (__first and __n = 1)").select(docs.columns)
    if known.where("__first and __n > 1").isEmpty():
        return out
    order = W.partitionBy("__doc", "__mark").orderBy(F.xxhash64(*docs.columns))
    again = rows.where("__first and __n > 1").withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    return out.unionByName(again.select(docs.columns))
