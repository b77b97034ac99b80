"""Line dedup that can be taken back: exact reference-count tables, with sharded cuckoo filters before them.

A line's key is the line stripped and lower-cased (ASCII); keys are equal by 128 bits of SHA-256. The index holds postings (key, doc_id), appended batch by
batch: a key's reference count is the number of its documents. An insertion or deletion counts anew only the keys that it
touches. Keys whose count makes them repeats are in the cuckoo filter of their shard; they enter when their count reaches
the limit and leave when it falls below. Every posting is asked of its shard's filter first, and only those that may
repeat are joined with the exact counts.

Defined results: a null or empty text is one empty line; texts of any length; rows that share a doc_id are one document
where documents are counted, and all of the largest doc_id keep a line; rows with a null doc_id count as no document and
keep no line that enough others hold; further columns stay with the rewritten text, whatever their names, but that
rewrite() sets n_lines and n_dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuckoo import CuckooFilter
from .store import materialize, partitions, ship
from .text import WHITE, ascii_lower

#: Keys in one filter, on average.
SHARD_KEYS = 1 << 14


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, rf"^[{WHITE}]+|[{WHITE}]+\z", ""))  # `$` would also match before a last U+2028


def _digest(key: Column) -> Column:
    """128 bits of SHA-256, by which keys are equal."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def _hashes(key: Column) -> Column:
    """A key's digest, and 64 bits for the filters."""
    return F.struct(F.xxhash64(key).alias("h"), _digest(key).alias("g"))


def postings_of(docs: DataFrame, least: int) -> DataFrame:
    """(h, g, doc_id) of every key of at least so many code points, once for each row of docs (doc_id, text)."""
    keys = F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: F.length(k) >= least)
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(keys, _hashes))).alias("key")).select("key.h", "key.g", "doc_id")


KEY = ["h", "g"]


class LineIndex:
    """Postings and filters of all documents inserted and not deleted."""

    def __init__(self, least: int = 40, documents: int = 5):
        self.least, self.documents = least, documents
        self.parts: list[DataFrame] = []
        self.gone: DataFrame | None = None
        self.repeats: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 1

    @property
    def postings(self) -> DataFrame:
        """(h, g, doc_id) of all documents that are not deleted."""
        every = self.parts[0]
        for part in self.parts[1:]:
            every = every.unionByName(part)
        return every if self.gone is None else every.join(self.gone, "doc_id", "left_anti")

    def insert(self, docs: DataFrame) -> None:
        """Add documents: their postings, and to the filters the keys that now repeat."""
        if self.gone is not None:  # an id that comes again is not to be taken for the deleted one
            self.parts, self.gone = [materialize(self.postings, "line-postings")], None
        new = postings_of(docs, self.least)
        twice = materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "line-twice")
        if not twice.isEmpty():  # rows that share a doc_id
            new = new.join(twice, "doc_id", "left_anti").unionByName(new.join(twice, "doc_id", "left_semi").distinct())
        new = materialize(new, "line-postings")
        touched = new.select(KEY).distinct() if self.parts else None
        self.parts.append(new)
        self._count(touched)

    def delete(self, ids: DataFrame) -> None:
        """Take documents (doc_id) out again: their postings, and from the filters the keys that no longer repeat."""
        ids = materialize(ids.select("doc_id").where("doc_id is not null").distinct(), "line-deleted")
        touched = materialize(self.postings.join(ids, "doc_id", "left_semi").select(KEY).distinct(), "line-touched")
        self.gone = ids if self.gone is None else self.gone.unionByName(ids)
        self._count(touched)

    def _count(self, touched: DataFrame | None) -> None:
        """Count the touched keys (None: all), and move those that begin or cease to repeat in or out of the filters."""
        postings = self.postings if touched is None else self.postings.join(touched, KEY, "left_semi")
        counted = postings.groupBy(KEY).agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= self.documents)
        before, now = self.repeats, materialize(counted, "line-counts")
        if before is None or touched is None:
            self.repeats, changes = now, now.select("h", F.lit(True).alias("enters"))
        else:
            was = before.join(touched, KEY, "left_semi")
            both = now.select(*KEY, F.lit(1).alias("there")).join(was.select(*KEY, F.lit(1).alias("was")), KEY, "full").where("there is null or was is null")
            changes = both.select("h", F.col("there").isNotNull().alias("enters"))
            self.repeats = materialize(before.join(touched, KEY, "left_anti").unionByName(now), "line-repeats")
        fit = max(1, self.repeats.count() // SHARD_KEYS)
        if self.filters is None or fit > 2 * self.shards:  # first filters, or more of them
            self.shards, self.filters = fit, None
            changes = self.repeats.select("h", F.lit(True).alias("enters"))
        self._refill(changes)

    def _refill(self, changes: DataFrame) -> None:
        changes = ship(changes).select(F.pmod("h", F.lit(self.shards)).cast("int").alias("shard"), "h", "enters")

        def update(_, changed: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            enter, leave = (changed.h[changed.enters == x].to_numpy(np.int64) for x in (True, False))
            if len(held):
                current, keys = CuckooFilter.load(held["filter"].iloc[0]), held["keys"].iloc[0]
                current.delete(leave)
                keys = np.concatenate([np.setdiff1d(keys, leave), enter])
                try:
                    current.insert(enter)
                except OverflowError:
                    current = CuckooFilter.of(keys)
            else:
                keys, current = enter, CuckooFilter.of(enter)
            shard = (changed if len(changed) else held).shard.iloc[0]
            return pd.DataFrame({"shard": [shard], "filter": [current.dump()], "keys": [keys]})

        schema = "shard int, filter binary, keys array<long>"
        held = self.filters if self.filters is not None else changes.sparkSession.createDataFrame([], schema)
        self.filters = materialize(changes.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(update, schema), "line-filters")

    def asked(self) -> DataFrame:
        """The postings whose keys may repeat, by the filters: each shard's comes to its postings, which are dealt over several tasks."""
        postings = self.postings
        salts = max(1, -(-4 * partitions(postings) // self.shards))
        spread = F.array(*[F.lit(i) for i in range(salts)])
        filters = self.filters.select("shard", F.explode(spread).alias("salt"), "filter")
        dealt = postings.select(F.pmod("h", F.lit(self.shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("g", "doc_id"), F.lit(salts)).cast("int").alias("salt"), *KEY, "doc_id")
        both = filters.unionByName(dealt, allowMissingColumns=True)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, of = None, None
            for batch in batches:
                shard, salt, sent, h = (batch.column(c) for c in ("shard", "salt", "filter", "h"))
                if not len(batch):
                    continue
                shard, salt = shard.to_numpy(), salt.to_numpy()
                h, may = h.fill_null(0).to_numpy(), np.zeros(len(shard), bool)
                cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                    if of != (shard[lo], salt[lo]):
                        of, current = (shard[lo], salt[lo]), None
                    if sent[lo].is_valid:  # a shard's filter comes first
                        current, lo = CuckooFilter.load(sent[lo].as_py()), lo + 1
                    if current is not None and lo < hi:
                        may[lo:hi] = current.contains(h[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*KEY, "doc_id")], names=[*KEY, "doc_id"]).filter(pa.array(may))

        kind = dict(postings.dtypes)["doc_id"]
        sorted_ = ship(both).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        return sorted_.mapInArrow(ask, f"h long, g binary, doc_id {kind}")

    def drops(self) -> DataFrame:
        """(doc_id, __drop): the keys, as g, whose lines a document loses: those that repeat and that a larger doc_id holds."""
        lost = self.asked().join(self.repeats.select(*KEY, "last"), KEY).where("doc_id is null or doc_id < last")
        return lost.groupBy("doc_id").agg(F.collect_set("g").alias("__drop"))


def _rewritten(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with text rewritten, and __lines and __kept."""
    drops = index.drops().withColumnRenamed("doc_id", "__doc")
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").withColumn("__lines", lines_of(F.col("text")))
    repeated = lambda line: (F.length(line) >= index.least) & F.array_contains("__drop", _digest(key_of(line)))
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda line: ~repeated(line)))
    text = F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("__kept", "\n"))
    return joined.withColumn("__kept", kept).withColumn("text", text)


def rewrite(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with text rewritten, and n_lines (before dropping) and n_dropped."""
    out = _rewritten(docs, index)
    counts = {"n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long")}
    return out.withColumns(counts).drop("__doc", "__drop", "__lines", "__kept")


def cleaned(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """docs, all their columns as they are but for text, by an index of docs themselves."""
    index = LineIndex(least, documents)
    index.insert(docs.select("doc_id", "text"))
    return _rewritten(docs, index).select(docs.columns)


def dedup_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """rewrite() of docs by an index of docs themselves."""
    index = LineIndex(least, documents)
    index.insert(docs.select("doc_id", "text"))
    return rewrite(docs, index)
