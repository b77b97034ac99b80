"""As-of and range joins, islands, forward fill, streaks: order-dependent operators as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, start: str, payload: list[str], width: int = 64) -> DataFrame:
    """left with the payload of the right row of its group with the greatest start not above `on`; nulls if there is none.

    Of equal starts the least payload wins. Both sides meet in buckets of `width` units, so that one large group is
    many window partitions; a bucket without a fitting start takes the last one of the buckets before it.
    """
    pick = F.struct(F.col(start).alias("s"), *[F.col(c) for c in payload])
    best = right.where(F.col(start).isNotNull()).groupBy(by, start).agg(*[F.min_by(c, F.struct(*payload)).alias(c) for c in payload])
    best = best.select(by, F.floor(F.col(start) / width).alias("__bucket"), F.col(start).alias("__at"), pick.alias("__pick"))
    last = best.groupBy(by, "__bucket").agg(F.max_by("__pick", "__at").alias("__last"))
    events = left.select("*", F.floor(F.col(on) / width).alias("__bucket"), F.col(on).alias("__at"), F.lit(None).cast(best.schema["__pick"].dataType).alias("__pick"), F.lit(1).alias("__side"))
    rights = best.select(by, "__bucket", "__at", "__pick", F.lit(0).alias("__side"))
    w = W.partitionBy(by, "__bucket").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    inside = events.unionByName(rights, allowMissingColumns=True).withColumn("__in", F.last("__pick", True).over(w)).where("__side = 1")
    # what the buckets before hold, for the buckets that left rows are in: one row per group and bucket
    wanted = events.select(by, "__bucket").distinct().withColumn("__want", F.lit(1))
    carried = wanted.join(last, [by, "__bucket"], "full")
    before = W.partitionBy(by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.withColumn("__before", F.last("__last", True).over(before)).where("__want = 1").select(by, "__bucket", "__before")
    out = inside.join(carried, [by, "__bucket"], "left").withColumn("__got", F.coalesce("__in", "__before"))
    return out.select(*left.columns, *[F.col("__got")[c].alias(c) for c in payload])


def asof_values(left: DataFrame, right: DataFrame, by: str, on: str, start: str, payload: list[str], width: int = 64) -> DataFrame:
    """asof_join of a left side many rows of which share a value of `on`: only the distinct values are put in order."""
    found = asof_join(left.where(F.col(on).isNotNull()).select(by, on).distinct(), right, by, on, start, payload, width)
    return left.join(found, [by, on], "left").select(*left.columns, *payload)


def islands(df: DataFrame, by: list[str], order: list[Column | str], starts: Column, name: str = "island") -> DataFrame:
    """A running number of the islands of each group: a row where `starts` is true begins one."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def forward_fill(df: DataFrame, by: list[str], order: list[Column | str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.last(column, True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def backward_fill(df: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The next value of each group, the row's own included: a forward fill of the reversed order, whose frame only grows."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, True).over(w))


def nearest_marked(df: DataFrame, by: str, on: str, marked: Column, name: str) -> DataFrame:
    """For each row the greatest marked `on` of its group not above its own, else the least one above it.

    Both are running extremes over the distinct values of `on`, which are few against the rows.
    """
    values = df.groupBy(by, on).agg(F.max(F.when(marked, F.col(on))).alias("__mark"))
    before = W.partitionBy(by).orderBy(on).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(by).orderBy(F.desc(on)).rowsBetween(W.unboundedPreceding, 0)
    found = values.select(by, on, F.max("__mark").over(before).alias("__before"), F.min("__mark").over(after).alias("__after"))
    return df.join(found.select(by, on, F.coalesce("__before", "__after").alias(name)), [by, on])


def streaks(days: DataFrame, key: str, day: str, today: str) -> DataFrame:
    """The number of consecutive days that ends today or yesterday, 0 if none does. day: a date column."""
    runs = days.select(key, day).distinct().withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(day)))
    runs = runs.withColumn("__run", F.date_sub(day, F.col("__n"))).groupBy(key, "__run").agg(F.count("*").alias("n"), F.max(day).alias("last"))
    ends = F.datediff(F.lit(today).cast("date"), F.col("last")).isin(0, 1)
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(ends, F.col("n"))), F.lit(0)).alias("streak"))


def weighted_mode(df: DataFrame, by: list[str], value: Column, weight: Column, larger: bool = True, name: str = "mode") -> DataFrame:
    """The value of each group with the greatest total weight; of equals the larger, or the smaller one."""
    totals = df.groupBy(*by, value.alias("__value")).agg(F.sum(weight).alias("__weight"))
    rank = F.struct("__weight", F.col("__value") if larger else -F.col("__value"))
    return totals.groupBy(*by).agg(F.max_by("__value", rank).alias(name))
