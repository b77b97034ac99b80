"""Removal of long byte strings that occur earlier in the corpus, by a logarithmic family of sparse suffix arrays.

Each batch of documents adds a sorted run of anchored suffixes (repeats.py: of any 100 bytes one anchor is indexed, so no
repeat is missed), which is merge-scanned against the runs before it; runs of like size merge, so that their number
stays logarithmic. Where several texts go on differently around one anchor, their suffixes from it on and the texts
before it, backwards, are sorted, and the common prefixes of neighbours tell which windows are equal. Suffixes are
anchored rather than taken at every byte, since a full array of 8-byte positions is several times the corpus.

Defined results: a null text is empty; texts of any length; a null doc_id counts as the smallest; rows that share a
doc_id don't remove each other's bytes, each is judged against smaller ids and itself; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Spec, Symbols, without_repeats

#: Grams of 32 bytes anchor windows of 100: about one anchor in 35 bytes.
GRAM = 32
#: Texts around one anchor, alike before or after it, that are sorted in one task, at most half of its chunk; the windows of more are compared by digests in many tasks.
SORTED = 1 << 14


def _render(symbols: Symbols, texts: list[bytes], covered: np.ndarray) -> list[pa.Array]:
    begins = symbols.begins
    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[begins])
    head = covered & ~np.concatenate([[False], covered[:-1]])
    inner = begins[:-1][np.diff(begins) > 0]
    head[inner] = covered[inner]
    spans = np.diff(np.concatenate([[0], np.cumsum(head)])[begins])
    kept = []
    for i, text in enumerate(texts):
        if removed[i]:
            text = np.frombuffer(text, np.uint8)[~covered[begins[i] : begins[i + 1]]].tobytes()
        kept.append(hashlib.sha256(text).hexdigest())
    return [pa.array(x, pa.int64()) for x in (np.diff(begins), removed, spans)] + [pa.array(kept)]


def spec_of(window: int) -> Spec:
    return Spec(window, max(1, min(GRAM, window // 2)), words=False, sorted_at_most=SORTED)


def dedup_bytes(docs: DataFrame, window: int = 100, batches: int = 1) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text).

    Removed is each byte covered by a string of `window` bytes that also starts in a smaller doc_id, or earlier in the
    same document.
    """
    return without_repeats(docs, spec_of(window), True, _render, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", batches)


def kept_texts(docs: DataFrame, window: int = 100, batches: int = 1) -> DataFrame:
    """(doc_id, text): what remains of each document; cut characters are dropped."""

    def render(symbols: Symbols, texts: list[bytes], covered: np.ndarray) -> list[pa.Array]:
        begins = symbols.begins
        return [pa.array([np.frombuffer(t, np.uint8)[~covered[begins[i] : begins[i + 1]]].tobytes().decode(errors="ignore") for i, t in enumerate(texts)], pa.string())]

    return without_repeats(docs, spec_of(window), True, render, "text string", batches)
