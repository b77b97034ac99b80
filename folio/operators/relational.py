"""Relational operators on study tables: lookups, ordered scans, newest-per-group, and writes as rewrites of a table.

A write takes the table as it is and returns it as it will be; storing it is the caller's choice of sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lookup(df: DataFrame, where: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of a point filter, projected."""
    found = df.where(where)
    return found.select(*columns) if columns else found


def ordered(df: DataFrame, where: str | None, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A filtered scan in a given order; with a limit a top-k."""
    found = (df.where(where) if where else df).orderBy(*order)
    if offset:
        found = found.offset(offset)
    return found.limit(limit) if limit is not None else found


def newest_of_each(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group. The last sort key must be unique."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def nth_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") == n).drop("__n")


def update_where(df: DataFrame, where: str, values: dict[str, Column]) -> DataFrame:
    """Columns set to new values on the rows of a predicate."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def delete_where(df: DataFrame, where: str) -> DataFrame:
    return df.where(~F.coalesce(F.expr(where), F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows replace those with their keys, or are added."""
    return df.join(rows.select(*keys), keys, "left_anti").select(df.columns).unionByName(rows.select(df.columns))


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows.select(df.columns))


def append_new(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose unique key isn't there yet are added; others are ignored, as are repeats among the rows."""
    first = rows.dropDuplicates(keys)
    return df.unionByName(first.join(df.select(*keys), keys, "left_anti").select(df.columns))


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def cascade(parents: DataFrame, child: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of child whose parent is still there."""
    return child.join(parents.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_semi")


def dangling_to_null(df: DataFrame, parents: DataFrame, column: str, key: str = "id") -> DataFrame:
    """References without a parent become null."""
    known = parents.select(F.col(key).alias("__key"))
    return df.join(known, F.col(column) == F.col("__key"), "left").withColumn(column, F.col("__key")).drop("__key")


def violations(tables: dict[str, DataFrame], keys: dict[str, list[str]], refs: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, bad): for each primary key its repeated values, for each reference (child, column, parent, key) its orphans."""
    out = None
    for name, columns in keys.items():
        bad = tables[name].groupBy(*columns).count().where("count > 1").agg(F.count("*").alias("bad")).select(F.lit(f"{name} key").alias("rule"), "bad")
        out = bad if out is None else out.unionByName(bad)
    for child, column, parent, key in refs:
        orphans = tables[child].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(key).alias(column)), column, "left_anti")
        out = out.unionByName(orphans.agg(F.count("*").alias("bad")).select(F.lit(f"{child}.{column}").alias("rule"), "bad"))
    return out
