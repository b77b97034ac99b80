"""Which windows of a text (runs of `window` bytes or words) also start in an earlier document.

Any window holds `window - gram + 1` grams; the one with the least hash, the leftmost of equals, is its anchor. Equal
windows have equal anchors at equal places, so only windows around a gram that several documents hold as an anchor
can repeat, and an index of anchored suffixes, a small share of all positions, finds every repeat. Neighbouring windows
with one anchor form a stretch; documents with equal stretches form a class, whose first document is kept. Of a class's
later documents all windows of the stretch repeat. First documents of different classes with one anchor gram are
compared window by window: by sorting their suffixes at the anchor and scanning the common prefixes of neighbours
(scan), or by the digests of their windows (windows_of), as the spec says. Equal windows agree in at least half of what
they hold beside the gram, before it or after it; so only stretches that meet another's 16 bits of one of these halves
(their sides) are compared, in groups of one gram and one half.

The index is log-structured: each batch of documents (later batches hold larger ids) adds an immutable sorted run of
its anchors; the batch is merge-joined with the runs before it; runs of like size are merged.

Hashes from prefix sums only choose anchors and gather what may be equal. What counts as equal is equal by its bytes, or
by BLAKE2b digests of them: windows by 128 bits, stretches by 64 beside the 64-bit hash of their gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bucketed, drop_path, materialize, new_path, ship
from .tokens import ByteHash, text_blocks

ANCHORS = "u long, v long, c int, doc long"
_ODD = np.uint64(0x9FB21C651E98DF25)
#: Rows whose suffixes are sorted at a time.
CHUNK = 1 << 15


@dataclass(frozen=True)
class Spec:
    """Windows of so many symbols, anchored at grams of so many; symbols are bytes, or words parted by ASCII white space.

    Stretches of one gram are compared by their sorted suffixes where at most `sorted_at_most` of them differ, and
    beyond it, where one task would get a large group, by the digests of their windows, which many tasks share.
    """

    window: int
    gram: int
    words: bool
    sorted_at_most: int = 0

    @property
    def half(self) -> int:
        """Of the symbols that a window holds beside its gram, at least so many stand before the gram or at least so many after it."""
        return (max(0, self.window - self.gram) + 1) // 2


@dataclass
class Symbols:
    """A block's symbols: prefix sums of their hashes, and where each document's begin; the last entry is the end.

    buffer holds the texts, of words parted by single spaces; symbol i is buffer[first[i]:last[i]], for bytes buffer[i].
    """

    prefix: np.ndarray
    begins: np.ndarray
    buffer: bytes
    first: np.ndarray | None = None
    last: np.ndarray | None = None

    def span(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols from lo up to, not including, hi lie in the buffer."""
        return (lo, hi) if self.first is None else (self.first[lo], self.last[hi - 1])

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """128 bits of the bytes of each run of symbols, as two columns."""
        a, b = self.span(lo, hi)
        data = self.buffer
        out = b"".join([blake2b(data[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        return np.frombuffer(out, np.int64).reshape(-1, 2)


@dataclass
class Stretches:
    """Neighbouring windows with one anchor: those that start from lo to hi of document doc (a number in the block)."""

    k: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray

    def take(self, which: np.ndarray) -> Stretches:
        return Stretches(self.k[which], self.at[which], self.lo[which], self.hi[which], self.doc[which])

    def codes(self, symbols: Symbols, window: int) -> np.ndarray:
        """What a stretch is known by: its gram's hash, and 64 bits of its bytes' digest."""
        return np.stack([self.k.view(np.int64), symbols.digests(self.lo, self.hi + window)[:, 1]], axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


class Reader:
    """Finds the stretches of blocks of texts."""

    def __init__(self, spec: Spec):
        self.spec, self.hash, self.words = spec, ByteHash(3), ByteHash(5)

    def symbols(self, texts: list[bytes]) -> Symbols:
        if not self.spec.words:
            buffer = b"".join(texts)
            return Symbols(self.hash.prefix(np.frombuffer(buffer, np.uint8)), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]), buffer)
        parts = [x.split() for x in texts]
        begins = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        buffer = b" ".join([b" ".join(x) for x in parts if x])
        data = np.frombuffer(buffer, np.uint8)
        space = np.flatnonzero(data == 32)
        some = int(begins[-1] > 0)
        first, last = np.concatenate([[0] * some, space + 1]).astype(np.int64), np.concatenate([space, [len(data)] * some]).astype(np.int64)
        h = _mix(self.words.of(self.words.prefix(data), first, last) + (last - first).astype(np.uint64))
        n = len(h)
        self.hash.prefix(np.zeros(n, np.uint8))  # enough powers
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.hash.power[:n], out=prefix[1:])
        return Symbols(prefix, begins, buffer, first, last)

    def sides(self, s: Symbols, of: Stretches) -> np.ndarray:
        """16 bits each of the half window before the gram and, above, of that after it; 0 where no window of the stretch holds it."""
        half, gram = self.spec.half, self.spec.gram
        out = np.zeros(len(of.at), np.uint32)
        for has, begin, shift in ((of.at - half >= of.lo, of.at - half, 0), (of.at + gram + half <= of.hi + self.spec.window, of.at + gram, 16)):
            begin = begin[has]
            h = _mix((s.prefix[begin + half] - s.prefix[begin]) * self.hash.back[begin]) >> np.uint64(48)
            out[has] |= np.maximum(h, np.uint64(1)).astype(np.uint32) << np.uint32(shift)
        return out.view(np.int32)

    def stretches(self, s: Symbols) -> Stretches:
        size, gram = self.spec.window, self.spec.gram
        n = len(s.prefix) - 1
        many = np.maximum(np.diff(s.begins) - size + 1, 0)
        if not many.sum():
            none = np.zeros(0, np.int64)
            return Stretches(none.astype(np.uint64), none, none, none, none)
        grams = _mix((s.prefix[gram:] - s.prefix[:-gram]) * self.hash.back[: n - gram + 1])
        # the same bits of the hash count in blocks of any size, so that copies have their anchors at the same places
        place = np.uint64(32)
        least = (grams >> place << place) | np.arange(len(grams), dtype=np.uint64)
        span, width = size - gram + 1, 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        doc = np.repeat(np.arange(len(many)), many)
        start = np.arange(many.sum()) + np.repeat(s.begins[:-1] - (np.cumsum(many) - many), many)
        anchor = (least[start] & np.uint64((1 << 32) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        tail = np.concatenate([head[1:], [len(anchor)]]) - 1
        return Stretches(grams[anchor[head]], anchor[head], start[head], start[tail], doc[head])


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each lo to its hi."""
    many = hi - lo + 1
    return np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)


def _first_of_equals(*columns: np.ndarray) -> np.ndarray:
    """Where each distinct row of the columns stands first."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return order[new]


def _find(wanted: tuple[np.ndarray, ...], known: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which row of known (doc, u, v) each row of wanted is, -1 for none."""
    if not len(known[0]) or not len(wanted[0]):
        return np.full(len(wanted[0]), -1)
    tags = [_mix(_mix(u.astype(np.uint64)) ^ v.astype(np.uint64) ^ (doc.astype(np.uint64) + np.uint64(1)) * _ODD) for doc, u, v in (wanted, known)]
    order = np.argsort(tags[1], kind="stable")
    at = order[np.minimum(np.searchsorted(tags[1][order], tags[0]), len(order) - 1)]
    return np.where(np.all([w == k[at] for w, k in zip(wanted, known, strict=True)], axis=0), at, -1)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each value of a list column of structs, and all values."""
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), flat


def _digests_in(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, flat = _lists(column)
    return row, flat.field("u").to_numpy(), flat.field("v").to_numpy()


def anchors(docs: DataFrame, spec: Spec) -> DataFrame:
    """(u, v, c, doc): the gram's hash, the stretch's digest and its sides of every anchor, once for each document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(spec)
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for a, b, texts in text_blocks(batch.column("text")):
                symbols = reader.symbols(texts)
                found = reader.stretches(symbols)
                code = found.codes(symbols, spec.window)
                once = _first_of_equals(found.doc, code[:, 0], code[:, 1])
                columns = [code[once, 0], code[once, 1], reader.sides(symbols, found)[once], ids[a:b][found.doc[once]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["u", "v", "c", "doc"])

    return ship(docs).select("doc", "text").mapInArrow(emit, ANCHORS)


def shared_grams(held: DataFrame, above: int | None) -> DataFrame:
    """The rows of held (u, v, c, doc) whose gram, but for its last bit, stands in several rows, some of a doc above `above`.

    One sort by gram; of a gram's rows those above come first, told by the last bit. One row is held at a time.
    """
    old = F.lit(0) if above is None else F.when(F.col("doc") > above, F.lit(0)).otherwise(F.lit(1))
    order = F.col("u").bitwiseAND(F.lit(-2)).bitwiseOR(old.cast("long"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # alone of its gram so far
        gram = known = None  # of the row before; known: whether it has a row above
        for batch in batches:
            if not len(batch):
                continue
            u, doc = batch.column("u").to_numpy() >> 1, batch.column("doc").to_numpy()
            own = np.ones(len(u), bool) if above is None else doc > above
            new = np.concatenate([[gram is None or u[0] != gram], u[1:] != u[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(u)), -1))
            has = np.where(head < 0, bool(known), own[np.maximum(head, 0)])
            several = ~new | np.concatenate([~new[1:], [False]])
            if last is not None and not new[0] and known:
                yield last
            last = batch.slice(len(u) - 1) if new[-1] else None
            gram, known = u[-1], has[-1]
            yield batch.filter(pa.array(several & has))

    return held.select("u", "v", "c", "doc").repartition(F.shiftright("u", 1)).sortWithinPartitions(order).mapInArrow(emit, ANCHORS)


def _wanted(reader: Reader, symbols: Symbols, column: pa.ListArray) -> tuple[Stretches, np.ndarray]:
    """The stretches whose digests a list column names, and the digests."""
    found = reader.stretches(symbols)
    named = np.zeros(len(symbols.begins) - 1, bool)
    listed = _digests_in(column)
    named[listed[0]] = True
    found = found.take(np.flatnonzero(named[found.doc] & np.isin(found.k.view(np.int64), listed[1])))
    digest = found.codes(symbols, reader.spec.window)
    which = np.flatnonzero(_find((found.doc, digest[:, 0], digest[:, 1]), listed) >= 0)
    return found.take(which), digest[which]


def windows_of(docs: DataFrame, spec: Spec, column: str) -> DataFrame:
    """(u, v, doc): the digests of all windows in the stretches of docs (doc, text, column) named there, once for each document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(spec)
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for a, b, texts in text_blocks(batch.column("text")):
                symbols = reader.symbols(texts)
                found, _ = _wanted(reader, symbols, batch.column(column).slice(a, b - a))
                at, doc = _spans(found.lo, found.hi), np.repeat(found.doc, found.hi - found.lo + 1)
                digest = symbols.digests(at, at + spec.window)
                once = _first_of_equals(doc, digest[:, 0], digest[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(digest[once, 0]), pa.array(digest[once, 1]), pa.array(ids[a:b][doc[once]])], names=["u", "v", "doc"])

    return ship(docs).select("doc", "text", column).mapInArrow(emit, "u long, v long, doc long")


SUFFIXES = "g long, doc long, u long, v long, side long, at int, bytes binary"


def suffixes_of(docs: DataFrame, spec: Spec, column: str) -> DataFrame:
    """(g, doc, u, v, side, at, bytes): the bytes of the stretches of docs (doc, text, column) named there, and where in them the anchor is.

    g: a hash of what makes a group, the gram and the half beside it.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(spec)
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for a, b, texts in text_blocks(batch.column("text")):
                symbols = reader.symbols(texts)
                lists = batch.column(column).slice(a, b - a)
                found, digest = _wanted(reader, symbols, lists)
                listed, side = _digests_in(lists), lists.flatten().field("side").to_numpy()
                which = _find(listed, (found.doc, digest[:, 0], digest[:, 1]))
                side, which = side[which >= 0], which[which >= 0]
                found, digest = found.take(which), digest[which]
                group = _mix(_mix(digest[:, 0].astype(np.uint64)) ^ (side.astype(np.uint64) + np.uint64(1)) * _ODD).view(np.int64)
                lo, hi = symbols.span(found.lo, found.hi + spec.window)
                data = pa.array([symbols.buffer[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                columns = [pa.array(group), pa.array(ids[a:b][found.doc]), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(side), pa.array((found.at - found.lo).astype(np.int32)), data]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "doc", "u", "v", "side", "at", "bytes"])

    return ship(docs).select("doc", "text", column).mapInArrow(emit, SUFFIXES)


def _rows_of(data: np.ndarray, begin: np.ndarray, step: int, length: np.ndarray, width: int) -> np.ndarray:
    """A matrix of bytes: so many from each begin on, forwards or backwards, and zeros."""
    place = np.arange(width)
    at = begin[:, None] + step * place[None, :]
    inside = place[None, :] < length[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8)


def _ordered(group: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of each group's rows, all groups in one order, and each suffix's common prefix with the one before (-1: another group)."""
    wide = -(-rows.shape[1] // 8) * 8
    words = np.zeros((len(rows), wide), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8")
    order = np.lexsort([length, *words.T[::-1], group])
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(length[order[1:]], length[order[:-1]]))
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def repeated(group: np.ndarray, doc: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """A matrix: whether window i of each stretch (its bytes from i on) is in a stretch of its group and a smaller doc.

    The stretches' bytes lie in data, with the anchor at `at`. A window that starts d bytes before the anchor is in two
    stretches if they agree in d bytes before it and in window - d from it on: runs of neighbours in the two suffix
    arrays, of what stands after the anchor and, backwards, of what stands before it.
    """
    n, most = len(doc), int((size - window).max()) + 1
    after, before = size - at, at
    right, common = _ordered(group, _rows_of(data, begin + at, 1, after, window), np.minimum(after, window))
    left, shared = _ordered(group, _rows_of(data, begin + at - 1, -1, before, max(1, int(before.max()))), before)
    out = np.zeros((n, most), bool)
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(at.max()) + 1):
        some = np.flatnonzero((at >= d) & (at - d <= size - window))
        if len(some) < 2:
            continue
        one[right], two[left] = np.cumsum(common < window - d), np.cumsum(shared < d)
        x, y, z = one[some], two[some], doc[some]
        order = np.lexsort([z, y, x])
        x, y, z = x[order], y[order], z[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        first = z[new][np.cumsum(new) - 1]
        later = some[order[z > first]]
        out[later, (at - d)[later]] = True
    return out


def scan(suffixes: DataFrame, spec: Spec) -> DataFrame:
    """(doc, u, v, side, bits): the stretches with windows that start in a document with a smaller id too; a bit for each window."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def take(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            k = table.column("g").to_numpy()
            end = len(k) if last else int(np.searchsorted(k, k[-1]))  # the last group may go on
            rest = table.slice(end)
            held, rows = rest.to_batches(), len(rest)
            if end:
                table = table.slice(0, end)
                column = table.column("bytes").combine_chunks()
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + end + 1].astype(np.int64)
                data = np.frombuffer(column.buffers()[2], np.uint8)
                doc = table.column("doc").to_numpy()
                found = repeated(k[:end], doc, table.column("at").to_numpy().astype(np.int64), data, offsets[:-1], np.diff(offsets), spec.window)
                some = np.flatnonzero(found.any(axis=1))
                bits = np.packbits(found[some], axis=1)
                columns = [pa.array(doc[some]), *(table.column(c).combine_chunks().take(pa.array(some)) for c in ("u", "v", "side")), pa.array([x.tobytes() for x in bits], pa.binary())]
                yield from pa.Table.from_arrays(columns, names=["doc", "u", "v", "side", "bits"]).combine_chunks().to_batches()

        for batch in batches:
            if len(batch):
                held.append(batch)
                rows += len(batch)
            if rows >= CHUNK:
                yield from take(False)
        if rows:
            yield from take(True)

    return suffixes.repartition("g").sortWithinPartitions("g").mapInArrow(emit, "doc long, u long, v long, side long, bits binary")


class RepeatIndex:
    """Runs of anchors of the batches seen so far, newest last. texts: (doc, text) of all batches, dealt by doc."""

    def __init__(self, spec: Spec, texts: DataFrame):
        self.spec, self.texts = spec, texts
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.temporary: list[str] = []

    def _hold(self, df: DataFrame, name: str) -> DataFrame:
        """df written until _drop()."""
        self.temporary.append(new_path(df.sparkSession, name))
        return materialize(df, path=self.temporary[-1])

    def _drop(self, spark: SparkSession) -> None:
        for path in self.temporary:
            drop_path(spark, path)
        self.temporary = []

    def add(self, docs: DataFrame, above: int | None = None, last: bool = False) -> DataFrame:
        """(doc, stretches, parts, windows) of the documents of this batch with repeats.

        stretches: the digests of stretches all of whose windows also start in a document with a smaller id, in this
        batch or before; parts: of others, with a bit for each such window; windows: the digests of such windows.

        docs: (doc long, text), all ids larger than `above` and those of earlier batches not. last: no batch follows, and no run is kept.
        """
        spark, path = docs.sparkSession, new_path(docs.sparkSession, "repeat-run")
        run = anchors(docs, self.spec)
        if not last:
            run = materialize(run, path=path)
        held = run
        for _, level, _ in self.levels:
            held = held.unionByName(level)
        shared = self._hold(shared_grams(held, above), "repeat-shared")
        classes = self._hold(shared.groupBy("u", "v").agg(F.min("doc").alias("first"), F.max("c").alias("c"), F.count("*").alias("n")), "repeat-classes")
        own = F.lit(True) if above is None else F.col("doc") > above
        later = shared.where(own).select("u", "v", "doc").join(classes.where("n > 1").select("u", "v", "first"), ["u", "v"]).where("doc > first")
        later = later.select("doc", "u", "v", F.lit(None).cast("long").alias("side"), F.lit(None).cast("long").alias("several"))
        halves = F.array(F.col("c").bitwiseAND(F.lit(0xFFFF)).cast("long"), F.shiftrightunsigned("c", 16).cast("long") + F.lit(1 << 16))
        sided = classes.select("u", "v", "first", F.explode(F.filter(halves, lambda x: x.bitwiseAND(F.lit(0xFFFF)) != 0)).alias("side"))
        meets = sided.groupBy("u", "side").agg(F.count("*").alias("several"), F.max("first").alias("newest")).where("several > 1")
        if above is not None:  # groups of earlier batches' stretches alone were compared then
            meets = meets.where(F.col("newest") > above)
        known = self._hold(sided.join(meets, ["u", "side"]).select(F.col("first").alias("doc"), "u", "v", "side", "several"), "repeat-known")
        coded = later.unionByName(known)
        code, few = F.struct("u", "v"), F.col("several") <= self.spec.sorted_at_most
        per_doc = coded.groupBy("doc").agg(
            F.collect_list(F.when(F.col("several").isNull(), code)).alias("stretches"), F.collect_list(F.when(few, F.struct("u", "v", "side"))).alias("few"), F.collect_set(F.when(~few, code)).alias("many")
        )
        docs_path = new_path(spark, "repeat-docs")
        per_doc = materialize(per_doc, path=docs_path)
        self._drop(spark)
        if not last:
            self._push(run, path)
        self.temporary.append(docs_path)
        windows = self._hold(windows_of(self._read(per_doc, "many"), self.spec, "many"), "repeat-windows")
        firsts = windows.groupBy("u", "v").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
        firsts = self._hold(firsts.select("u", "v", "first"), "repeat-firsts")
        again = windows.join(firsts, ["u", "v"]).where("doc > first").groupBy("doc").agg(F.collect_list(code).alias("windows"))
        out = per_doc.select("doc", "stretches").join(again, "doc", "full")
        if self.spec.sorted_at_most:
            found = scan(suffixes_of(self._read(per_doc, "few"), self.spec, "few"), self.spec)
            parts = self._hold(found.groupBy("doc").agg(F.collect_list(F.struct("u", "v", "side", "bits")).alias("parts")), "repeat-parts")
            out = out.join(parts, "doc", "full")
        else:
            out = out.withColumn("parts", F.lit(None).cast(PARTS))
        if above is not None:  # what earlier documents hold again is known since their own batch
            out = out.where(F.col("doc") > above)
        found = out.select("doc", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("stretches", CODES), ("parts", PARTS), ("windows", CODES))))
        found = materialize(found.where("size(stretches) + size(parts) + size(windows) > 0"), "repeat-found")
        self._drop(spark)
        return found

    def _read(self, per_doc: DataFrame, column: str) -> DataFrame:
        """(doc, text, column) of the documents that per_doc names there; the texts stay where they lie."""
        named = per_doc.where(F.size(column) > 0).select("doc", column)
        return self.texts.select("doc", "text").join(named.hint("shuffle_hash"), "doc")

    def _push(self, run: DataFrame, path: str) -> None:
        """Add a run, each class by its first document, merged with those before while these are not more than twice as large."""
        spark, old, rows = run.sparkSession, [path], run.count()
        while self.levels and self.levels[-1][0] <= 2 * rows:
            many, older, older_path = self.levels.pop()
            run, rows = older.unionByName(run), rows + many
            old.append(older_path)
        run = run.groupBy("u", "v").agg(F.max("c").alias("c"), F.min("doc").alias("doc")).sortWithinPartitions("u", "v")
        path = new_path(spark, "repeat-level")
        run = materialize(run, path=path)
        for gone in old:
            drop_path(spark, gone)
        self.levels.append((run.count(), run, path))


def _own_repeats(symbols: Symbols, there: Stretches, window: int) -> list[np.ndarray]:
    """Where windows start that start earlier in their document too.

    Of equal stretches all but the first repeat as a whole; firsts of different stretches with one gram are compared
    window by window.
    """

    def shared(of: Stretches) -> Stretches:
        order = np.lexsort([of.k, of.doc])
        equal = (of.k[order[1:]] == of.k[order[:-1]]) & (of.doc[order[1:]] == of.doc[order[:-1]])
        again = np.zeros(len(order), bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        return of.take(np.flatnonzero(again))

    some = shared(there)
    code = some.codes(symbols, window)
    firsts = np.zeros(len(some.doc), bool)
    firsts[_first_of_equals(some.doc, code[:, 0], code[:, 1])] = True
    starts = [_spans(some.lo[~firsts], some.hi[~firsts])]
    some = shared(some.take(np.flatnonzero(firsts)))
    at, doc = _spans(some.lo, some.hi), np.repeat(some.doc, some.hi - some.lo + 1)
    code = symbols.digests(at, at + window)
    order = np.lexsort([at, code[:, 1], code[:, 0], doc])
    x, y = order[1:], order[:-1]
    return [*starts, at[x[(doc[x] == doc[y]) & (code[x] == code[y]).all(axis=1)]]]


CODES, PARTS = "array<struct<u:bigint,v:bigint>>", "array<struct<u:bigint,v:bigint,side:bigint,bits:binary>>"


def mark(docs: DataFrame, found: DataFrame, spec: Spec, own: bool, render, schema: str) -> DataFrame:
    """render(reader, symbols, texts, covered) for every block of docs (doc, text); covered: symbols in windows that start earlier too.

    own: windows that start earlier in the same document count as well. render yields the columns after doc.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(spec)
        for batch in batches:
            for a, b, texts in text_blocks(batch.column("text")):
                symbols = reader.symbols(texts)
                there = reader.stretches(symbols)
                lists = {c: batch.column(c).slice(a, b - a) for c in ("stretches", "parts", "windows")}
                rows = {c: _digests_in(x) for c, x in lists.items()}
                named = np.zeros(b - a, bool)
                for x in rows.values():
                    named[x[0]] = True
                grams = np.concatenate([rows["stretches"][1], rows["parts"][1]])
                some = there.take(np.flatnonzero(np.isin(there.k.view(np.int64), grams) & named[there.doc] | np.isin(there.doc, rows["windows"][0])))
                code = some.codes(symbols, spec.window)
                key = (some.doc, code[:, 0], code[:, 1])
                whole = _find(key, rows["stretches"]) >= 0
                starts = [_spans(some.lo[whole], some.hi[whole])]
                if len(rows["parts"][0]):
                    flat = _lists(lists["parts"])[1]
                    bits, after = flat.field("bits").to_pylist(), flat.field("side").to_numpy() >> 16
                    for side in (0, 1):
                        of = np.flatnonzero(after == side)
                        part = _find(key, tuple(x[of] for x in rows["parts"]))
                        for i in np.flatnonzero((part >= 0) & ~whole).tolist():
                            starts.append(some.lo[i] + np.flatnonzero(np.unpackbits(np.frombuffer(bits[of[part[i]]], np.uint8))))
                if len(rows["windows"][0]):
                    asked = ~whole & np.isin(some.doc, rows["windows"][0])
                    at = _spans(some.lo[asked], some.hi[asked])
                    doc = np.repeat(some.doc[asked], some.hi[asked] - some.lo[asked] + 1)
                    code = symbols.digests(at, at + spec.window)
                    starts.append(at[_find((doc, code[:, 0], code[:, 1]), rows["windows"]) >= 0])
                if own:
                    starts += _own_repeats(symbols, there, spec.window)
                at = np.concatenate(starts)
                n = len(symbols.prefix)
                covered = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + spec.window, minlength=n))[: n - 1] > 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *render(symbols, texts, covered)], schema=_arrow(batch.schema.field("doc_id").type))

    def _arrow(kind: pa.DataType) -> pa.Schema:
        kinds = {"long": pa.int64(), "string": pa.string()}
        return pa.schema([pa.field("doc_id", kind), *(pa.field(n, kinds[t]) for n, t in (x.split() for x in schema.split(", ")))])

    joined = docs.join(found.hint("shuffle_hash"), "doc", "left").select(
        "doc_id", "text", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("stretches", CODES), ("parts", PARTS), ("windows", CODES)))
    )
    return ship(joined).mapInArrow(emit, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text): doc is doc_id, or for a null one the least long."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc"), F.col("text").cast("string").alias("text"))


def batches_of(docs: DataFrame, batches: int) -> list[tuple[int | None, DataFrame]]:
    """docs (doc, …) in so many ranges of ascending ids, each with the id that all of its are above."""
    if batches < 2:
        return [(None, docs)]
    cuts = docs.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)])).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = docs if low is None else docs.where(F.col("doc") > low)
        out.append((low, part if high is None else part.where(F.col("doc") <= high)))
    return out


def without_repeats(docs: DataFrame, spec: Spec, own: bool, render, schema: str, batches: int = 1) -> DataFrame:
    """mark() over all docs, indexed in so many batches.

    The texts are written once, dealt and bucketed by document; later joins by document leave them where they are.
    """
    texts = bucketed(keyed(docs), "doc", "repeat-texts")
    index, out = RepeatIndex(spec, texts), None
    parts = batches_of(texts, batches)
    for i, (above, part) in enumerate(parts):
        found = index.add(part.select("doc", "text"), above, last=i == len(parts) - 1)
        out = found if out is None else out.unionByName(found)
    for _, _, path in index.levels:
        drop_path(docs.sparkSession, path)
    return mark(texts, out, spec, own, render, schema)
