"""Removal of word windows that occur in an earlier document, by a log-structured fingerprint index.

Each batch of documents adds a sorted immutable run of window fingerprints (repeats.py: of the 13-word windows, a
stretch with one anchor stands for all, so that a run is a fraction of the text), is merge-joined with the historical
runs by 64-bit hashes of the anchors, verified by 128-bit digests of the stretches' and windows' bytes, read again from
the documents, and compacted with the runs.

Defined results: a null text has no words; texts of any length; a null doc_id counts as the smallest; rows that share a
doc_id don't remove each other's words; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Spec, Symbols, without_repeats

#: Grams of 5 words anchor windows of 13.
GRAM = 5


def _kept(symbols: Symbols, texts: list[bytes], covered: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    begins = symbols.begins
    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[begins])
    keep = ~covered
    out = [b" ".join(compress(t.split(), keep[begins[i] : begins[i + 1]].tolist()) if removed[i] else t.split()) for i, t in enumerate(texts)]
    return removed, out


def _render(symbols: Symbols, texts: list[bytes], covered: np.ndarray) -> list[pa.Array]:
    removed, kept = _kept(symbols, texts, covered)
    return [pa.array(np.diff(symbols.begins), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]


def dedup_words(docs: DataFrame, window: int = 13, batches: int = 1) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs (doc_id, text).

    Removed is each word covered by a window of so many words that also starts in a document with a smaller doc_id.
    """
    return without_repeats(docs, Spec(window, max(1, min(GRAM, window)), words=True), False, _render, "n_words long, n_removed long, kept_sha256 string", batches)


def kept_texts(docs: DataFrame, window: int = 13, batches: int = 1) -> DataFrame:
    """(doc_id, text): the kept words of each document, joined by one space."""

    def render(symbols: Symbols, texts: list[bytes], covered: np.ndarray) -> list[pa.Array]:
        return [pa.array([x.decode() for x in _kept(symbols, texts, covered)[1]], pa.string())]

    return without_repeats(docs, Spec(window, max(1, min(GRAM, window)), words=True), False, render, "text string", batches)
