"""Token ids of many texts by a public tokenizer that drops white space, each distinct word encoded once.

White space never joins two words' tokens, so a text's ids are its words' ids in order. Words are found and hashed
(64 bits) for a whole block of texts at once; a table from hash to ids, bounded in size, answers for those seen before.
A hash only proposes a word: every occurrence is compared with the word's bytes, and those that differ are encoded apart.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are joined to blocks of about this many bytes.
BLOCK = 1 << 20
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")


class ByteHash:
    """Hashes of byte ranges from prefix sums: sum of a random number for each byte times a power of an odd base, modulo 2^64.

    They place and group, and never decide that two texts are equal: unequal ones of one hash can be made for any base.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.inverse = np.uint64(pow(int(self.BASE), -1, 1 << 64))
        self.power = self.back = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if n > len(self.power):
            ones = np.ones(max(n, BLOCK), np.uint64)
            self.power, self.back = (np.multiply.accumulate(np.concatenate([ones[:1], ones[1:] * b])) for b in (self.BASE, self.inverse))
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.power[: n - 1], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.back[start]


def text_blocks(column: pa.Array, size: int = BLOCK):
    """(from, to, texts as bytes) for slices of a string column of about size bytes each; a null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + size)))
        yield at, end, [x or b"" for x in column.slice(at, end - at).cast(pa.binary()).to_pylist()]
        at = end


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


class WordEncoder:
    """Ids of texts by the tokenizer at path: BPE with word ends that drops white space."""

    def __init__(self, path: str, capacity: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.capacity, self.hash = capacity, ByteHash()
        self.kind = np.full(256, 3, np.uint8)
        self.kind[list(b" \t\n\x0b\x0c\r")] = 0
        self.kind[list(range(97, 123)) + list(range(65, 91))] = 1
        self.kind[list(b".,!?;:")] = 2
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(2 * self.capacity, np.uint64)
        self.slots = np.zeros(2 * self.capacity, np.int32)
        self.starts = np.zeros(self.capacity + 1, np.int64)
        self.pool = np.zeros(4 * self.capacity, np.uint32)
        self.letters, self.spelt = np.zeros(8 * self.capacity, np.uint8), np.zeros(self.capacity + 1, np.int64)
        self.apart: dict[bytes, int] = {}
        self.n = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's word number, -1 for new ones."""
        mask = np.int64(len(self.keys) - 1)
        slot = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.int64) & mask
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.slots[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return out

    def _store(self, words: list[bytes]) -> np.ndarray:
        """Encode and keep new words; the order in which they got the next numbers."""
        order, flat, counts = self._encode(words)
        ordered = [words[i] for i in order]
        for name, starts, values, sizes in (("pool", self.starts, flat, counts), ("letters", self.spelt, np.frombuffer(b"".join(ordered), np.uint8), np.array([len(w) for w in ordered], np.int64))):
            held, at = getattr(self, name), starts[self.n]
            if at + len(values) > len(held):
                held = np.concatenate([held, np.zeros(max(len(held), len(values)), held.dtype)])
                setattr(self, name, held)
            held[at : at + len(values)] = values
            starts[self.n + 1 : self.n + 1 + len(words)] = at + np.cumsum(sizes)
        self.n += len(words)
        return order

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        begin = self.n
        h = h[self._store(words)]
        mask = np.int64(len(self.keys) - 1)
        number = begin + np.arange(len(h), dtype=np.int32)
        slot = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.int64) & mask
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.slots[slot[won]] = h[won], number[won]
            on = np.ones(len(h), bool)
            on[won] = False
            h, number, slot = h[on], number[on], (slot[on] + 1) & mask

    def _differ(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which words data[first:last] are other words than those of their numbers."""
        size = last - first
        same = size == self.spelt[number + 1] - self.spelt[number]
        size = np.where(same, size, 0)
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0)
        wrong = np.flatnonzero(data[at + np.repeat(first - upto + size, size)] != self.letters[at + np.repeat(self.spelt[number] - upto + size, size)])
        same[np.searchsorted(upto, wrong, "right")] = False
        return np.flatnonzero(~same)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the words, their ids in that order, and how many each has.

        Plain words are encoded many at a time and told apart by their last token; others one by one.
        """
        texts = [w.decode() for w in words]
        plain = np.array([bool(_LETTERS.fullmatch(w)) for w in texts])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        groups = [[texts[i] for i in order[a : min(a + 50, n)]] for a in range(0, n, 50)]
        flat = self._flat([" ".join(g) for g in groups])[0]
        counts = np.diff(np.flatnonzero(self.ends[flat]) + 1, prepend=0)
        if len(counts) != n:
            flat, counts = self._flat([texts[i] for i in order[:n]])
        more, many = self._flat([texts[i] for i in order[n:]])
        return order, np.concatenate([flat, more]), np.concatenate([counts, many])

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin, with the end as last."""
        buffer = b"\n".join([b"", *texts, b"", b""])
        data = np.frombuffer(buffer, np.uint8)
        if data.max() < 0xCC and b"<|" not in buffer:  # no combining marks, no special tokens
            buffer = buffer.lower()  # as the tokenizer does
            data = np.frombuffer(buffer, np.uint8)
        begins = np.cumsum([1, *(len(x) + 1 for x in texts)])
        kind = self.kind[data]
        inside = kind != 0
        cut = np.zeros(len(data), bool)  # a letter, then one or two marks up to white space: two words
        cut[1:-2] = (kind[1:-2] == 2) & (kind[:-3] == 1) & ((kind[2:-1] == 0) | (kind[2:-1] == 2) & (kind[3:] == 0))
        first = np.flatnonzero(inside[1:] & (~inside[:-1] | cut[1:])) + 1
        last = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:])) + 1
        del kind, inside, cut
        prefix = self.hash.prefix(data)
        h = self.hash.of(prefix, first, last) + (last - first).astype(np.uint64)
        h[h == 0] = 1
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            if self.n + len(new) > self.capacity:
                self._clear()
                number[:] = -1
                new = np.arange(len(h))
            keys, where = np.unique(h[new], return_index=True)
            if len(keys) > self.capacity:
                self.capacity = 1 << int(len(keys)).bit_length()
                self._clear()
            where = new[where]
            self._learn(keys, [buffer[a:b] for a, b in zip(first[where].tolist(), last[where].tolist(), strict=True)])
            number[new] = self._find(h[new])
        for i in self._differ(data, first, last, number).tolist():
            word = buffer[first[i] : last[i]]
            if word not in self.apart:
                if self.n >= len(self.starts) - 1:  # no number left: hold more
                    self.starts, self.spelt = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.spelt))
                self.apart[word] = self.n
                self._store([word])
            number[i] = self.apart[word]
        begin = self.starts[number]
        count = self.starts[number + 1] - begin
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(first, begins)]
