"""Connected components of a graph of links, by alternating large and small stars.

Each round hangs every node's larger neighbours on its least one, then its smaller ones. Rounds end when the links
are stars. Every round is joins and aggregates on the links, written to the shared folder. A node's least neighbour is
written apart from the join with its links, so that both sides of the join are plain shuffles, which adaptive execution
parts where one node, such as a star's centre, has a large share of the links; the aggregates combine before they shuffle.

Defined results: repeated links and links of a node with itself count once or not at all; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = materialize(e.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long): root is the least node reachable."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = materialize(e, "links"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        e = materialize(_small(_large(e)), "links")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
