"""A quality classifier learned from trusted positives and unlabelled text (non-negative unbiased risk).

A text becomes a few measures, such as the shares of kinds of characters and of repeated words, and the shares of its
hashed pairs of neighbouring bytes, found in numpy for blocks of texts. A linear model of them is trained to minimise the
non-negative unbiased risk of positive-unlabelled learning: with prior p, p * loss(positives as 1) + max(0,
loss(unlabelled as 0) - p * loss(positives as 0)). The prior is estimated from the positives and the unlabelled texts
alone; labels other than 1 are never read. Only the features of a bounded sample are made before training and reach
the driver; then every text is scored in one pass.

Defined results: a null or empty text has all features 0 and gets a score like any other; rows with a null doc_id are
scored and never learned from; a doc_id with several labels of 1 is one positive; repeated rows get equal scores; without
any trusted positive every score is 1; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, ship
from .tokens import ByteHash, text_blocks

#: At most about this many positives, and as many unlabelled rows, are sampled for learning.
SAMPLE = 20_000
#: Buckets of hashed pairs of bytes.
PAIRS = 64
FEATURES = ["upper", "digit", "mark", "sign", "other", "pipe", "space", "line", "length", "again", "repeat", "vary", "longest", "caps_words", "sign_words", "bang"]


class Measures:
    """The features of blocks of texts."""

    def __init__(self):
        self.hash = ByteHash(9)
        kind = np.zeros((256, 8), np.float32)
        for i, chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()", b"#$%&*+/<=>@\\^_`{}~[]", b"", b"|", b" ", b"\n"]):
            kind[list(chars), i] = 1
        self.kind = kind
        self.inside = np.ones(256, bool)
        self.inside[list(b" \t\n\x0b\x0c\r")] = False

    def of(self, texts: list[bytes]) -> np.ndarray:
        buffer = b"\n".join([b"", *texts, b""])
        data = np.frombuffer(buffer, np.uint8)
        lengths = np.array([len(x) for x in texts], np.int64)
        begins = 1 + np.cumsum(lengths + 1) - lengths - 1
        some = np.maximum(lengths, 1)[:, None]

        def share(of_byte: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0.0], np.cumsum(of_byte, dtype=np.float64)])
            return (total[begins + lengths] - total[begins])[:, None]

        kinds = [share(self.kind[:, i][data]) / some for i in (0, 1, 2, 3, 5, 6)]
        control = share((data < 32) & (data != 10) & (data != 9)) / some
        bang = share(data == 33) / some
        lines = share(data == 10) / some
        inside = self.inside[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        h = self.hash.of(self.hash.prefix(data), first, last)
        at = np.searchsorted(first, np.concatenate([begins, [len(data)]]))
        n = np.diff(at)
        doc = np.repeat(np.arange(len(texts)), n)
        words = np.maximum(n, 1)[:, None]

        def over_words(flag: np.ndarray) -> np.ndarray:
            return np.bincount(doc, flag, len(texts))[:, None] / words

        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        tag = h ^ (doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        repeat = np.ones(len(h))
        repeat[np.unique(tag, return_index=True)[1]] = 0
        size = last - first
        mean = over_words(size)
        upper = np.concatenate([[0], np.cumsum(self.kind[:, 0][data])])
        sign = np.concatenate([[0], np.cumsum(self.kind[:, 3][data])])
        caps = (upper[last] - upper[first] >= 2) & (upper[last] - upper[first] >= 0.5 * size)
        vary = np.sqrt(np.maximum(over_words(size.astype(float) ** 2) - mean**2, 0))
        columns = [*kinds[:4], control, *kinds[4:6], lines, np.log1p(n)[:, None] / 10, over_words(again), over_words(repeat) * (n[:, None] > 20), vary / 10, mean / 10]
        columns += [over_words(caps), over_words(sign[last] > sign[first]), bang]
        row = np.repeat(np.arange(len(texts)), np.maximum(lengths - 1, 0))
        at = np.arange(len(row)) + np.repeat(begins - (np.cumsum(np.maximum(lengths - 1, 0)) - np.maximum(lengths - 1, 0)), np.maximum(lengths - 1, 0))
        pair = (data[at].astype(np.uint32) << 8 | data[at + 1]) * np.uint32(0x9E3779B1) >> np.uint32(32 - PAIRS.bit_length() + 1)
        pairs = np.bincount(row * PAIRS + pair, minlength=len(texts) * PAIRS).reshape(-1, PAIRS)
        out = np.hstack([*columns, np.sqrt(pairs / some)])
        out[lengths == 0] = 0
        return out.astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, features) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = Measures()
        for batch in batches:
            for a, b, texts in text_blocks(batch.column("text")):
                got = measures.of(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32()), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "features"])

    return ship(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, features array<float>")


@dataclass
class Model:
    """Squashed features, centred, into a weighted sum: each measure x also counts as x / (x + scale), for rates of rare marks."""

    scale: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def of(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((_squashed(raw, self.scale) - self.mean) / self.spread @ self.weights + self.bias, -30, 30)))


def _squashed(raw: np.ndarray, scale: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    some = raw[:, : len(scale)]
    return np.hstack([raw, some / (some + scale)])


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk with the logistic loss, and the gradient to descend.

    Where the negatives' part is below zero, which only overfitting makes it, the gradient climbs out of it instead.
    """
    sp, su = (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) for z in (p, u))
    negative = np.mean(np.logaddexp(0, u @ w)) - prior * np.mean(np.logaddexp(0, p @ w))
    as_one = p.T @ (sp - 1) / len(p)
    below = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    return prior * np.mean(np.logaddexp(0, -(p @ w))) + max(0.0, negative), prior * as_one + below if negative >= 0 else -below


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise the risk by Adam over the whole sample."""
    raw = np.vstack([positive, unlabelled])
    k = min(len(FEATURES), raw.shape[1])
    scale = np.maximum(raw[:, :k].mean(axis=0, dtype=np.float64), 1e-3)
    every = _squashed(raw, scale)
    mean, spread = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    x = np.hstack([(every - mean) / spread, np.ones((len(every), 1))])
    p, u = x[: len(positive)], x[len(positive) :]
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    shrink = np.full(x.shape[1] - 1, decay)
    shrink[k : raw.shape[1]] = 100 * decay  # hashed features are many
    for step in range(1, steps + 1):
        grad = risk(w, p, u, prior)[1]
        grad[:-1] += shrink * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(scale, mean, spread, w[:-1], float(w[-1]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, from these two samples alone.

    A model that tells positives from unlabelled rows, learned on one half, ranks the other. Above any threshold the
    share of unlabelled rows over that of positives bounds the prior from above; the threshold is chosen where the bound
    with its sampling error is least. Both halves take their turn.
    """
    found = []
    for turn in (0, 1):
        if not min(len(x[k::2]) for x in (positive, unlabelled) for k in (0, 1)):
            continue
        one = learn(positive[turn::2], unlabelled[turn::2], 0.5, steps=300)
        p, u = (np.sort(one.of(x[1 - turn :: 2])) for x in (positive, unlabelled))
        at = np.unique(np.concatenate([p, u]))
        above_p, above_u = ((len(x) - np.searchsorted(x, at)) / len(x) for x in (p, u))
        at, above_p, above_u = at[above_p > 0], above_p[above_p > 0], above_u[above_p > 0]
        error = sum(np.sqrt(np.log(4 / sure) / (2 * len(x))) for x in (p, u))
        best = np.argmin((above_u + error) / above_p)
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the rows of docs (doc_id, text) that are not held out, and the labels (doc_id, quality) of 1.

    Trusted positives are rows labelled 1. The unlabelled sample is drawn from all rows, whatever their label.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    may = docs.where("doc_id is not null").where(~held_out(F.col("doc_id")))
    ones = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("one")).distinct()
    ids = may.select("doc_id")
    ones = materialize(ids.join(ones, F.col("doc_id") == F.col("one"), "left_semi").distinct(), "quality-ones")
    many, rows = ones.count(), ids.count()
    if not many:
        return None

    def drawn(some: DataFrame, of: int, seed: int) -> np.ndarray:
        """Measures of about `sample` of so many rows, each drawn by itself: rows that share an id are not all in or all out."""
        some = some.where(F.rand(seed) < sample / of) if of > sample else some
        return np.array([r.features for r in features(some).limit(2 * sample).orderBy("doc_id", "features").collect()], np.float32)

    chosen = ones.where(F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col("doc_id")), 1) <= F.lit(min((1 << 63) - 1, (sample << 63) // many)))
    chosen = ones.orderBy("doc_id").limit(sample) if chosen.isEmpty() else chosen
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "one"))  # at most about `sample` ids
    has_one = F.col("doc_id") == F.col("one")
    positive = drawn(may.join(chosen, has_one, "left_semi"), ids.join(chosen, has_one, "left_semi").count(), 1)
    unlabelled = drawn(may, rows, 2)
    if not len(positive):  # of a sample of a few rows none may have been drawn
        positive = drawn(may.join(chosen, has_one, "left_semi").limit(sample), sample, 1)
    if not len(unlabelled):
        unlabelled = drawn(may.limit(sample), sample, 2)
    return learn(positive, unlabelled, estimate_prior(positive, unlabelled))


def _scorer(model: Model):
    """Scores of the texts of a batch."""
    measures = Measures()

    def score(batch: pa.RecordBatch) -> np.ndarray:
        scores = [model.of(measures.of(texts)) for _, _, texts in text_blocks(batch.column("text"))]
        return np.concatenate(scores) if scores else np.zeros(0)

    return score


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch))], names=["doc_id", "score"])

    scored = rows.select("doc_id", F.lit(1.0).alias("score")) if model is None else ship(rows).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; no row is shuffled."""
    model = train(docs, labels)
    if model is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(score(batch) >= 0.5))

    return ship(docs).mapInArrow(keep, docs.schema)
