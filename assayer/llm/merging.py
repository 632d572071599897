"""BPE merges of many words at once, in numpy. The rank arrays of all words lie one after another; each
round every word finds its least rank, deletes that boundary and refreshes the ranks beside it."""

from __future__ import annotations

import numpy as np

from .bpe import _NONE, _SHIFT, RankBpe


class BatchMerger:
    def __init__(self, ranks: RankBpe) -> None:
        self.keys = np.array(sorted(ranks.rank), dtype=np.int64)
        self.ranks = np.array([ranks.rank[k] for k in self.keys.tolist()], dtype=np.int32)
        self.made = np.array(ranks.made, dtype=np.int64)
        self.start, self.last = np.array(ranks.start, dtype=np.int64), np.array(ranks.last, dtype=np.int64)
        left = np.repeat(self.start, 256)
        # ranks of two bytes side by side, inside a word and at its end
        self.inside = self._rank(left << _SHIFT | np.tile(self.start, 256))
        self.ending = self._rank(left << _SHIFT | np.tile(self.last, 256))

    def _rank(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], _NONE).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """For each word (one byte or more) its ids, little-endian unsigned 32-bit."""
        n = len(words)
        if not n:
            return []
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        end = np.cumsum(size)
        parts = self.start[raw]
        parts[end - 1] = self.last[raw[end - 1]]
        near = np.full(len(raw), _NONE, dtype=np.int32)
        pair = (raw[:-1] << 8) | raw[1:]
        near[:-1] = self.inside[pair]
        long = size > 1
        near[end[long] - 2] = self.ending[pair[end[long] - 2]]
        near[end - 1] = _NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        word = np.arange(n)
        while len(word):
            begin = end - size
            low = np.minimum.reduceat(near, begin)
            live = low < _NONE
            if not live.all():  # finished words leave the arrays
                keep = np.repeat(live, size)
                done.append((word[~live], size[~live], parts[~keep]))
                parts, near, word, size, low = parts[keep], near[keep], word[live], size[live], low[live]
                if not len(word):
                    break
                end = np.cumsum(size)
                begin = end - size
            hit = np.flatnonzero(near == np.repeat(low, size))
            owner = np.searchsorted(end, hit, side="right")
            first = np.ones(len(hit), dtype=bool)
            first[1:] = owner[1:] != owner[:-1]
            at = hit[first]  # one place in each word
            parts[at] = self.made[low]
            keep = np.ones(len(parts), dtype=bool)
            keep[at + 1] = False
            parts, near = parts[keep], near[keep]
            at = at - np.arange(len(at))
            size = size - 1
            end = np.cumsum(size)
            begin = end - size
            right = at < end - 1
            near[at] = _NONE
            near[at[right]] = self._rank(parts[at[right]] << _SHIFT | parts[at[right] + 1])
            left = at[at > begin]
            near[left - 1] = self._rank(parts[left - 1] << _SHIFT | parts[left])
        out: list[bytes] = [b""] * n
        for which, sizes, ids in done:
            held, stop = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            begin = 0
            for w, e in zip(which.tolist(), stop):
                out[w] = held[begin:e]
                begin = e
        return out
