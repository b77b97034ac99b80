"""Near copies by their shingles: all links between texts whose sets of shingles have a Jaccard likeness of 0.8 or more.

An exact join of sets, by pigeonhole: under one order of all shingles, two sets so alike share one of the first
n // 5 + 1 shingles of each. Common shingles, as counted over all texts, come last in the order, so that few sets meet.
Sets that meet and that neither size nor place rules out are compared whole, word by word. Where many meet, they are
compared with a few of them first, then only those that no link joins yet; so large groups of near copies do not make all
their pairs.

Defined results: shingles are ASCII-lowered words by ASCII white space; 64-bit hashes of them only choose which texts are
compared. A text of fewer words than a shingle is one shingle, a null or empty text the empty one; texts of the same words,
by 128 bits of BLAKE2b, are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import bucketed, drop_path, drop_table, materialize, new_path, ship, shuffles_removed
from .tokens import text_blocks

#: Slots, by the first bits of their hashes, in which the shingles of all texts are counted.
SLOT_BITS = 22
#: Words of 64 bits that hold the parities of a set's shingles: where they differ, so do the sets, at least so often.
PARITIES = [f"p{i}" for i in range(16)]
#: Members of a group that all others are compared with, round by round; the last round compares all that are apart.
PIVOTS = ((0, 1), (1, 16), None)
#: Pairs are compared by their texts in so many parts, one after another, so that their texts don't lie on disk at once.
SLICES = 4


def normal(text: bytes) -> bytes:
    """The words of a text, ASCII-lowered, joined by one blank."""
    return b" ".join(text.lower().split())


def every(joined: bytes, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of the shingles of a normal text as they follow, repeats included."""
    from xxhash import xxh64_intdigest

    parts = joined.split()
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in parts])
    n = len(parts) - words + 1
    first, last = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, n)


def shingles(joined: bytes, words: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes of the shingles of a normal text, in order."""
    return np.unique(every(joined, words, seed).view(np.int64))


def majority(hashes: np.ndarray) -> int:
    """Bit by bit whether over half of the hashes have a 1."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def likely(one: bytes, two: bytes, words: int) -> bool:
    """Whether the sets of shingles of two texts have a Jaccard likeness of 0.8 or more, by their words."""
    ids: dict[bytes, int] = {}
    each = [np.array([ids.setdefault(w, len(ids) + 1) for w in x.lower().split()], np.int64) for x in (one, two)]
    each = [np.pad(x, (0, max(0, words - len(x)))) for x in each]  # 0 is no word: a short text is like no shingle of a longer one
    runs = each  # numbers of runs of 1, 2, … words; equal runs have equal numbers
    for k in range(1, words):
        longer = np.concatenate([r[:-1] * (len(ids) + 1) + x[k:] for r, x in zip(runs, each, strict=True)])
        longer = np.unique(longer, return_inverse=True)[1]
        runs = [longer[: len(runs[0]) - 1], longer[len(runs[0]) - 1 :]]
    a, b = (np.unique(r) for r in runs)
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def mark_of(text: Column) -> Column:
    """128 bits of a text's SHA-256; a null is an empty text."""
    return F.unhex(F.left(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), F.lit(32)))


def _doc() -> Column:
    """doc_id, or for a null one the least long."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark)"""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark_of(F.col("text")).alias("mark"))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))


def commonness(marked: DataFrame, words: int) -> np.ndarray:
    """For each slot of shingles the magnitude of its count over all texts; so many numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, _, texts in text_blocks(batch.column("text")):
                slots = np.concatenate([_slots(shingles(normal(x), words)) for x in texts])
                np.add.at(n, slots, 1)
        held = np.flatnonzero(n)
        for at in range(0, len(held), 1 << 16):
            part = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["slot", "n"])

    counted = ship(marked).select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    sizes = counted.select("slot", F.floor(2 * F.log2("n")).cast("tinyint").alias("size"))
    with shuffles_removed(marked.sparkSession):
        by_size = sizes.toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[by_size.column("slot").to_numpy()] = by_size.column("size").to_numpy()
    return out


def leads(marked: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, k0, k1, n, fp, lead, p0, …): each text's words by 128 bits, its number of shingles, its SimHash, the first shingles by the order, and the parities of all."""
    common = marked.sparkSession.sparkContext.broadcast(commonness(marked, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, width = common.value, 64 * len(PARITIES)
        for batch in batches:
            for a, b, texts in text_blocks(batch.column("text")):
                texts = [normal(x) for x in texts]
                keys = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in texts), np.int64).reshape(-1, 2)
                hashes = [every(x, words) for x in texts]
                fp = np.array([majority(h) if x else 0 for x, h in zip(texts, hashes, strict=True)], np.uint64).view(np.int64)
                found = [np.unique(h.view(np.int64)) for h in hashes]
                first = [x[np.argsort(level[_slots(x)], kind="stable")[: len(x) // 5 + 1]] for x in found]
                odd = np.array([np.packbits((np.bincount(x & (width - 1), minlength=width) & 1).astype(np.uint8)) for x in found]).view(np.int64)
                columns = [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "mark")), *(pa.array(x) for x in keys.T), pa.array([len(x) for x in found], pa.int32()), pa.array(fp), _lists(first), *(pa.array(x) for x in odd.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "k0", "k1", "n", "fp", "lead", *PARITIES])

    return ship(marked).mapInArrow(run, ", ".join(["doc_id long, mark binary, k0 long, k1 long, n int, fp long, lead array<long>", *(f"{p} long" for p in PARITIES)]))


def _members(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[np.ndarray]:
    """Whole groups of rows that are sorted by the first column, as arrays of their columns, many groups at a time."""
    held: list[np.ndarray] = []  # of the last group, which may go on in the next batch
    for batch in batches:
        if not len(batch):
            continue
        rows = np.array([batch.column(c).to_numpy() for c in columns], np.int64)
        whole = int(np.searchsorted(rows[0], rows[0, -1]))
        if whole or held and held[-1][0, -1] != rows[0, 0]:
            yield np.concatenate([*held, rows[:, :whole]], axis=1)
            held = []
        held.append(rows[:, whole:])
    if held:
        yield np.concatenate(held, axis=1)


MET, KINDS = ["token", "k0", "k1", "n", "place"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def meeting(found: DataFrame) -> DataFrame:
    """(token, k0, k1, n, place): the leading shingles of texts that several texts have among their leading ones."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # copies in one task, so far as they fit; several() drops the others
        for batch in batches:
            if len(seen) > 1 << 18:
                seen.clear()
            keys, sizes, column = (batch.column("k0").to_pylist(), batch.column("k1").to_pylist()), batch.column("n").to_pylist(), batch.column("lead")
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            out = []
            for k0, k1, n, a, b in zip(*keys, sizes, offsets[:-1], offsets[1:], strict=True):
                if (k0, k1) not in seen:
                    seen.add((k0, k1))
                    out.append(np.array([values[a:b], np.full(b - a, k0), np.full(b - a, k1), np.full(b - a, n), np.arange(b - a)]))
            if out:
                rows = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, KINDS, strict=True)], names=MET)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _members(batches, MET):
            if rows.shape[1]:
                rows = rows[:, np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])]
                same = rows[0, 1:] == rows[0, :-1]
                rows = rows[:, np.concatenate([[False], same]) | np.concatenate([same, [False]])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, KINDS, strict=True)], names=MET)

    shape = "token long, k0 long, k1 long, n int, place int"
    return ship(found.select("k0", "k1", "n", "lead")).mapInArrow(lead, shape).repartition("token").sortWithinPartitions("token", "k0", "k1").mapInArrow(several, shape)


def candidates(rooted: DataFrame, pivots: tuple[int, int] | None) -> DataFrame:
    """(a, b), a < b: sets of rooted (token, node, n, place, root) that meet, are apart and may be alike.

    With pivots, only pairs with those members of a group; with None all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _members(batches, ["token", "node", "n", "place", "root"]):
            if not rows.shape[1]:
                continue
            cuts = np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1
            pairs: set[tuple[int, int]] = set()
            for lo, hi in zip([0, *cuts], [*cuts, rows.shape[1]], strict=True):
                node, n, place, root = rows[1:, lo:hi]
                if (root == root[0]).all():
                    continue
                if pivots:
                    against = np.arange(len(node))[pivots[0] : pivots[1]]
                else:  # of two that are apart, one is outside the largest part
                    _, nth, many = np.unique(root, return_inverse=True, return_counts=True)
                    against = np.flatnonzero(nth != np.argmax(many))
                for p in against:
                    both = n + n[p]
                    shared = np.minimum(n - place, n[p] - place[p])  # if this is the first shingle they share
                    may = (root != root[p]) & (5 * np.minimum(n, n[p]) >= 4 * np.maximum(n, n[p])) & (9 * shared >= 4 * both)
                    other = node[may]
                    pairs.update(zip(np.minimum(other, node[p]).tolist(), np.maximum(other, node[p]).tolist(), strict=True))
                    if len(pairs) > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])
                        pairs = set()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])

    dealt = ship(rooted).select("token", "node", "n", "place", "root").repartition("token").sortWithinPartitions("token", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def alike(pairs: DataFrame, rows: DataFrame, stored: DataFrame, words: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets have a likeness of 0.8 or more.

    The parities rule most of the others out; the rest are compared by their texts, by slices of the pairs.
    stored: (doc, mark, text), bucketed by doc; only the texts asked for leave it.
    """
    spark = pairs.sparkSession
    sketch = rows.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "n", _doc().alias("doc"), "mark", *PARITIES).dropDuplicates(["node"])
    first, second = (sketch.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ["n", "doc", "mark", *PARITIES])) for c in "ab")
    apart = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES), F.lit(0))
    close = pairs.join(first, "a").join(second, "b").where(9 * apart <= F.col("n_a") + F.col("n_b"))
    close_path, path = new_path(spark, "shingles-close"), new_path(spark, "shingles-texts")
    close = materialize(close.select("a", "b", "doc_a", "mark_a", "doc_b", "mark_b"), path=close_path)
    ends = F.array(*(F.struct(F.col(f"doc_{c}").alias("doc"), F.col(f"mark_{c}").alias("mark")) for c in "ab"))
    wanted = close.select(F.explode(ends).alias("end")).groupBy("end.doc").agg(F.collect_set("end.mark").alias("asked"))
    # an equality of marks would become a key of the join, which the table is not dealt by
    texts = stored.join(wanted.hint("shuffle_hash"), "doc").where(F.array_contains("asked", F.col("mark"))).dropDuplicates(["mark"]).select("mark", "text")
    texts = materialize(texts, path=path)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = (batch.column(c).cast(pa.binary()) for c in ("text_a", "text_b"))
            same = [likely(x.as_py() or b"", y.as_py() or b"", words) for x, y in zip(ones, twos, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    out = None
    for i in range(SLICES):
        part = close.where(F.pmod(F.xxhash64("b"), F.lit(SLICES)) == i)
        first, second = (texts.select(F.col("mark").alias(f"mark_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = part.join(second, "mark_b").join(first, "mark_a").select("a", "b", "text_a", "text_b")
        linked = materialize(ship(both).mapInArrow(compare, "a long, b long"), "shingles-alike")
        out = linked if out is None else out.unionByName(linked)
    drop_path(spark, path)
    drop_path(spark, close_path)
    return out


def near_groups(docs: DataFrame, words: int = 5, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, mark, node, root) for every row of docs (doc_id, text): those of one root are joined by links, and no others.

    first: makes of (node, fp), each text's SimHash, the pairs (a, b) that are compared before any others; what these join
    is not compared again.
    """
    spark, marked, keys = docs.sparkSession, _marked(docs), ["k0", "k1"]
    path, met_path, rows_path = (new_path(spark, name) for name in ("shingles", "shingles-met", "shingles-rows"))
    found = materialize(leads(marked, words), path=path)
    nodes = materialize(found.select(keys).distinct().withColumn("node", F.monotonically_increasing_id()), "shingles-nodes")
    met = materialize(meeting(found).join(nodes, keys).select("token", "node", "n", "place"), path=met_path)
    rows = materialize(found.drop("lead").join(nodes, keys).drop(*keys), path=rows_path)
    drop_path(spark, path)
    # every round asks for few texts; without this table each would send all texts through a shuffle
    stored = bucketed(marked.select(_doc().alias("doc"), "mark", "text"), "doc", path=(texts_path := new_path(spark, "shingles-stored")))
    links = roots = None
    if first:
        links = alike(first(rows.select("node", "fp").dropDuplicates(["node"])), rows, stored, words)
        roots = materialize(components(links), "shingles-roots")
    for pivots in PIVOTS:
        rooted = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = materialize(candidates(rooted, pivots), "shingles-pairs")
        now = alike(pairs, rows, stored, words)
        links = now if links is None else links.unionByName(now)
        roots = materialize(components(links), "shingles-roots")
    drop_path(spark, met_path)
    drop_table(spark, texts_path)
    known = materialize(rows.select("doc_id", "mark", "node"), "shingles-known")
    drop_path(spark, rows_path)
    return known.join(roots, "node", "left").select("doc_id", "mark", "node", F.coalesce("root", "node").alias("root"))
