"""A cuckoo filter of 64-bit keys in numpy: 16-bit tags, four to a bucket; keys can be deleted."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
_ODD = np.uint64(0x9FB21C651E98DF25)


class CuckooFilter:
    """No false negatives; about one false positive in 8,000. A key inserted twice must be deleted twice."""

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * 0.85 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mixed = keys.astype(np.uint64) * _ODD
        tag = (mixed >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        one = (mixed >> np.uint64(8)) & mask
        return tag, one.astype(np.int64), self._other(one.astype(np.int64), tag)

    def _other(self, bucket, tag):
        return bucket ^ ((np.asarray(tag).astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, one, two = self._places(keys)
        return (self.table[one] == tag[:, None]).any(axis=1) | (self.table[two] == tag[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Fill free slots of the keys' buckets, many keys at a time; those that find none push others to their other bucket."""
        tag, one, two = self._places(keys)
        for turn in (0, 1):
            order = np.argsort((one, two)[turn], kind="stable")
            tag, one, two = tag[order], one[order], two[order]
            bucket = (one, two)[turn]
            nth = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = self.table[bucket] == 0
            fits = nth < free.sum(axis=1)
            slot = np.argmax(np.cumsum(free, axis=1) == nth[:, None] + 1, axis=1)
            self.table[bucket[fits], slot[fits]] = tag[fits]
            tag, one, two = tag[~fits], one[~fits], two[~fits]
        rng = np.random.default_rng(1)
        for t, bucket in zip(tag.tolist(), two.tolist(), strict=True):
            for _ in range(KICKS):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = t
                    break
                i = int(rng.integers(SLOTS))
                t, self.table[bucket, i] = int(self.table[bucket, i]), t
                bucket = int(self._other(bucket, t))
            else:
                raise OverflowError("no room; of() starts anew with more")

    def delete(self, keys: np.ndarray) -> None:
        for tag, one, two in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == tag)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter with these keys, with more room if need be."""
        room = max(4, len(keys))
        while True:
            out = cls(room)
            try:
                out.insert(keys)
                return out
            except OverflowError:
                room *= 2

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out
