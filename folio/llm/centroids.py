"""Centroid clustering: Lloyd's rounds on integer vectors, exact and alike whatever the partitions.

The centroids, a few rows, go to every task with its function; mapInPandas gives each vector the centroid of the least
squared difference in 64-bit integers, the lowest index among equals. For the next centroids each partition sends one
row of integer sums for every centroid, and a groupBy adds them.

Defined results: vectors of another length, null ones and those with null or non-finite components are left out; a
component beyond 2^26 after scaling counts as 2^26, so that every difference and distance fits a long, and a sum of
distances beyond a long is the largest long; repeated rows are
vectors of their own, and of a repeated or null id each row is kept; with fewer vectors than centroids each vector starts
one; further columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, ship

#: Largest component after scaling; 64 squares of twice as much stay below 2^62.
LIMIT = 1 << 26
LONGEST = (1 << 63) - 1


def quantized(vectors: pd.Series, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and their components as integers floor(scale * x)."""

    def kept(v) -> bool:
        return v is not None and len(v) == width and not (v.dtype == object and any(x is None for x in v))

    fit = vectors.map(kept).to_numpy(bool)
    found = np.array([np.asarray(v, np.float64) for v in vectors[fit]]).reshape(-1, width)
    finite = np.isfinite(found).all(axis=1)
    fit[np.flatnonzero(fit)[~finite]] = False
    return fit, np.floor(np.clip(found[finite] * scale, -LIMIT, LIMIT)).astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's centroid, the lowest index among equals, and the squared distance."""
    distances = np.empty((len(points), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        distances[:, k] = np.square(points - c).sum(axis=1)
    at = distances.argmin(axis=1)
    return at, distances[np.arange(len(points)), at]


class Lloyd:
    """Clusters of vectors (vec_id, embedding)."""

    def __init__(self, vectors: DataFrame, k: int = 16, width: int = 64, scale: int = 64, seed: str = "1"):
        self.width, self.scale, self.kind = width, scale, dict(vectors.dtypes)["vec_id"]
        self.vectors = ship(vectors.select(F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("none"), "embedding"))  # no nulls: pandas makes floats of ids beside them
        self.centroids = self._seeds(k, seed)

    def _seeds(self, k: int, seed: str) -> np.ndarray:
        """The k kept vectors of the smallest digests of seed and id; equal ids by their components."""
        width, scale = self.width, self.scale

        def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                fit, found = quantized(b.embedding, width, scale)
                yield pd.DataFrame({"id": b.id[fit].to_numpy(), "none": b.none[fit].to_numpy(), "q": pd.Series(list(found), dtype=object)})

        digest = F.when(~F.col("none"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
        rows = self.vectors.mapInPandas(numbers, f"id {self.kind}, none boolean, q array<long>").orderBy(digest.asc_nulls_last(), "q").limit(k).collect()
        return np.array([r.q for r in rows], np.int64).reshape(-1, width)

    def round(self) -> None:
        """Assign all vectors, and replace every non-empty centroid by the floor of its vectors' mean."""
        width, scale, centroids = self.width, self.scale, self.centroids

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for b in batches:
                _, found = quantized(b.embedding, width, scale)
                at, _ = nearest(found, centroids)
                count += np.bincount(at, minlength=len(centroids))
                np.add.at(total, at, found)
            some = np.flatnonzero(count)
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "total": pd.Series(list(total[some]), dtype=object)})

        if not len(centroids):
            return
        parts = self.vectors.mapInPandas(sums, "cluster int, n long, total array<long>")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)])
        moved = centroids.copy()
        for row in added.collect():  # one row for each centroid
            moved[row["cluster"]] = [row[f"t{i}"] // row["n"] for i in range(width)]
        self.centroids = moved

    def assigned(self) -> DataFrame:
        """(vec_id, cluster, distance) by the centroids as they are."""
        width, scale, centroids = self.width, self.scale, self.centroids

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                fit, found = quantized(b.embedding, width, scale)
                if len(found):
                    at, distance = nearest(found, centroids)
                    yield pd.DataFrame({"id": b.id[fit].to_numpy(), "none": b.none[fit].to_numpy(), "cluster": at.astype(np.int32), "distance": distance})

        rows = self.vectors.mapInPandas(assign, f"id {self.kind}, none boolean, cluster int, distance long")
        return rows.select(F.when(~F.col("none"), F.col("id")).alias("vec_id"), "cluster", "distance")


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after so many rounds."""
    lloyd = Lloyd(vectors, k, width, scale, seed)
    for _ in range(rounds):
        lloyd.round()
    rows = materialize(lloyd.assigned(), "clusters")
    added = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum"))
    sums = {r["cluster"]: int(r["sum"]) for r in added.collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in lloyd.centroids]
    table = [(c, min(s, LONGEST), min(sum(sums.values()), LONGEST), digests[c]) for c, s in sums.items()]
    facts = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
