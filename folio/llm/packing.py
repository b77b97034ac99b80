"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents longer than a sequence are cut; all others stay whole. Pieces above a third of the capacity are matched
first: each, from the longest down, with the longest that fits beside it, at most two in a sequence. Smaller pieces,
from the longest down, then go where the least room is left. Both work on the histogram of lengths, which has at
most `capacity` entries: what the driver holds is bounded by the capacity, not by the corpus. Pieces of one length
are interchangeable; a piece's rank among those of its length, found in salted groups, gives its place.

Defined results: a null or empty text is the end token alone; repeated rows are packed as often as they occur; a
null doc_id is kept; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import materialize, ship
from .tokens import encoder, text_blocks

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """The pieces of every document (doc_id, text): its ids and the end token, cut at every multiple of capacity.

    with_ids adds the column ids.
    """

    def cut(batches):
        for batch in batches:
            for a, b, texts in text_blocks(batch.column("text")):
                ids, begins = encoder(tokenizer).encode(texts)
                lengths = np.diff(begins) + 1
                flat = np.insert(ids, begins[1:], np.uint32(END_ID)).astype("<u4")
                n = -(-lengths // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(lengths[doc] - start, capacity)
                at = (np.cumsum(lengths) - lengths)[doc] + start
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
                out = [batch.column("doc_id").slice(a, b - a).take(pa.array(doc)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([flat[i:j].astype(np.int32) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return ship(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the pieces of each length go, and the number of sequences.

    Each entry is (length, first rank, first sequence, pieces in each sequence, offset): from that rank on, until
    the length's next entry, pieces fill consecutive sequences.
    """
    left = {n: k for n, k in histogram.items() if k}
    rank = dict.fromkeys(left, 0)
    places: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = {}  # by space left: runs of sequences (first, how many)
    spaces: list[int] = []

    def put(length: int, count: int, first: int, each: int, offset: int) -> None:
        places.append((length, rank[length], first, each, offset))
        rank[length] += count
        left[length] -= count

    def leave(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        at = bisect_right(large, capacity - length) - 1
        mate = large[at] if at >= 0 else None
        if mate == length and left[length] == 1:
            mate = large[at - 1] if at else None
        if mate is None:
            many = left[length]
            put(length, many, sequences, 1, 0)
        elif mate == length:
            many = left[length] // 2
            put(length, 2 * many, sequences, 2, 0)
        else:
            many = min(left[length], left[mate])
            put(length, many, sequences, 1, 0)
            put(mate, many, sequences, 1, length)
        used = length if mate is None else length + mate
        leave(capacity - used, sequences, many)
        sequences += many
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                space, first = capacity, sequences
                many = -(-left[length] // (capacity // length))
                sequences += many
            else:
                space = spaces[at]
                first, many = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
            each = space // length
            full = min(many, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - space)
                leave(space - each * length, first, full)
            rest = many - full
            if rest and (over := left[length]):
                put(length, over, first + full, over, capacity - space)
                leave(space - over * length, first + full, 1)
                full, rest = full + 1, rest - 1
            leave(space, first + full, rest)
    return places, sequences


def assign(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset. cut: a stored table with doc_id, piece and length."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    places, _ = plan_bins(histogram, capacity)
    total = sum(histogram.values())
    salts = int(min(4096, max(8, total // 500)))
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "__salt").count().select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("__rank", within).join(firsts, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__first")).drop("__salt", "__first")
    table = np.array(sorted(places), np.int64).reshape(-1, 5)

    def place(batches):
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            added = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            kept = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, names=[*kept, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank"]
    return ship(ranked).mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs."""
    return assign(materialize(pieces(docs, tokenizer, capacity), "pack-pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, starts), starts being the offsets of the pieces."""
    placed = assign(materialize(pieces(docs, tokenizer, capacity, with_ids=True), "pack-ids"), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most capacity ids
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))
