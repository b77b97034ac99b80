"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the total in proportion to its weight, but no more than `max_epochs` times what it
holds. Sources above that are clamped, and what they leave is shared among the others by weight, until none is
above. A document is then taken a whole number of times, and once more if it is among the first of a seeded random
order that fill the fractional part. That order is kept in buckets, so that a hot source is never in one task.

Defined results: a null source is a source of its own; a null or empty text has size 0 and is taken with its
source's rate, adding no words; sources with a null or non-positive weight get nothing; repeated rows share their
place in the order and are counted one by one; reruns give the same rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import materialize
from .text import word_count

#: Rows of a source in one bucket of its random order, on average, and the most buckets that a source gets.
BUCKET_ROWS, MAX_BUCKETS = 200, 4096
#: Tables of at most this many rows (two keys and a number each) are broadcast.
BROADCAST_ROWS = 200_000


def fill_targets(sources: DataFrame, total: float, max_epochs: float = 2.0) -> DataFrame:
    """sources (…, weight, held) with target: the water-filling of total by weight under max_epochs * held.

    Each round is one aggregate over the per-source table. The level rises from round to round, so that a source
    once clamped stays so; the rounds end when no further source is above its cap.
    """
    able = F.coalesce(F.col("weight"), F.lit(0.0)) > 0
    cap = F.col("held") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        full = able & (cap <= F.col("weight") * F.lit(level))
        now = sources.agg(
            F.coalesce(F.sum(F.when(full, 1)), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(able & ~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if now["n"] == clamped or not now["weights"]:
            break
        clamped, level = now["n"], (total - now["used"]) / now["weights"]
    filled = F.when(able, F.least(cap, F.col("weight") * F.lit(level))).otherwise(F.lit(0.0))
    if not now["weights"]:  # every source is clamped
        filled = F.when(able, F.least(cap, F.greatest(cap, F.col("weight") * F.lit(level)))).otherwise(F.lit(0.0))
    return sources.withColumn("target", filled)


def _key(source: Column) -> Column:
    return F.struct(source.isNull().alias("no"), F.coalesce(source, F.lit("")).alias("name"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with the seeded place of each document in its source's order, and the seeded number of its bucket."""
    place = F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << 52) - 1))
    return docs.withColumns({"__key": _key(F.col("source")), "__place": place, "__deal": F.xxhash64(F.lit(seed + 1), F.col("doc_id"))})


def plan_mix(docs: DataFrame, weights, share: float, max_epochs: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan of each source, the last place taken once more in each bucket, and (doc_id, __key, __place, __deal, size)."""
    sized = _placed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), seed).drop("source")
    sized = materialize(sized, "mix-sizes")
    held = materialize(sized.groupBy("__key").agg(F.sum("size").alias("held"), F.count("*").alias("rows")), "mix-sources")
    total = (held.agg(F.sum("held")).first()[0] or 0) * share
    plan = fill_targets(weights(held), total, max_epochs)
    rate = F.when(F.col("held") > 0, F.col("target") / F.col("held")).otherwise(F.lit(0.0))
    plan = plan.select(
        "__key", F.col("held").alias("source_size"), "target", F.floor(rate).alias("__whole"), (rate - F.floor(rate)).alias("__part"),
        F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("int").alias("__buckets"),
    )
    plan = materialize(plan, "mix-plan")
    order = W.partitionBy("__key", "bucket").orderBy("__place").rangeBetween(W.unboundedPreceding, W.currentRow)
    words = F.sum("size").over(W.partitionBy("__key", "bucket"))
    cuts = (
        sized.join(_small(plan), "__key")
        .select("__key", F.pmod("__deal", "__buckets").alias("bucket"), "__place", "size", "__part")
        .withColumns({"upto": F.sum("size").over(order), "words": words})
        .where(F.col("upto") - F.col("size") / 2 <= F.col("__part") * F.col("words"))
        .groupBy("__key", "bucket")
        .agg(F.max("__place").alias("__last"))
    )
    return plan, materialize(cuts, "mix-cuts"), sized


def _times(rows: DataFrame, plan: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with source_size, target and the number of times each is taken; small plans and cuts move no row."""
    rows = rows.join(_small(plan), "__key").withColumn("bucket", F.pmod("__deal", "__buckets")).join(_small(cuts), ["__key", "bucket"], "left")
    extra = F.coalesce(F.col("__place") <= F.col("__last"), F.lit(False)) & (F.col("__part") > 0)
    return rows.withColumn("times", (F.col("__whole") + extra.cast("int")).cast("int"))


def repetitions(docs: DataFrame, weights, share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, times) for every row of docs (doc_id, text, source).

    weights: takes the table of sources (__key, held) and adds the column weight.
    """
    plan, cuts, sized = plan_mix(docs, weights, share, max_epochs, seed)
    return _times(sized, plan, cuts).select("doc_id", "size", "source_size", "target", "times")


def cycle_weights(cycle: tuple[float, ...]):
    """Weights that repeat `cycle` over the sources in code point order, a null source last. One row per source."""

    def add(sources: DataFrame) -> DataFrame:
        nth = F.row_number().over(W.orderBy("__key")) - 1
        return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (nth % len(cycle) + 1).cast("int")))

    return add


def mix(docs: DataFrame, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, with its own columns only."""
    plan, cuts, _ = plan_mix(docs, cycle_weights(cycle), share, max_epochs, seed)
    columns = docs.columns
    kept = _placed(docs.select(F.struct(*columns).alias("__row"), "doc_id", "source"), seed)
    taken = _times(kept, plan, cuts).where("times > 0")
    return taken.select(F.explode(F.array_repeat("__row", F.col("times"))).alias("__row")).select([F.col("__row")[c].alias(c) for c in columns])
