"""A run-length index of short texts: the Burrows-Wheeler transform in runs, with sampled run ends.

The texts are given in the order of their documents, so that equal suffixes sort by document. The
index keeps, for each run of equal symbols, its start, its symbol and where that symbol's suffixes
continue (the sampled end), and for each range of suffixes that agree on `least` symbols the
smallest document; two directories name the run and the range of a place. Texts are streamed through it backwards, all at once: one step takes every text
one symbol to the left, and once `least` symbols are matched the range tells the earliest document.
"""

from __future__ import annotations

import numpy as np

_FIRST = 7  # symbols of 9 bits in the first key


class RunIndex:
    def __init__(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, least: int):
        """data, at: bytes of the texts and their offsets; doc: each text's document, ascending."""
        size = np.diff(at)
        n_texts, n = len(size), len(data) + len(size)
        self.size, self.least = size, least
        end = np.cumsum(size + 1) - 1
        symbol = np.zeros(n + _FIRST, np.uint16)
        inner = np.ones(n, bool)
        inner[end] = False
        symbol[:n][inner] = data.astype(np.uint16) + np.uint16(1)
        text = np.repeat(np.arange(n_texts, dtype=np.int32), size + 1)
        left = (end[text] - np.arange(n)).astype(np.int32)
        suffixes = self._sorted(symbol, left, n)
        # the transform in runs
        before = np.where(inner[suffixes - 1] & (suffixes > 0), symbol[suffixes - 1], np.uint16(0))
        new = np.ones(n, bool)
        new[1:] = before[1:] != before[:-1]
        self.run_start, self.run_of = np.flatnonzero(new), (np.cumsum(new) - 1).astype(np.int32)
        self.run_symbol = before[self.run_start]
        length = np.diff(np.append(self.run_start, n))
        below = np.concatenate([[0], np.cumsum(np.bincount(symbol[:n].astype(np.int64), minlength=257))])
        order = np.argsort(self.run_symbol, kind="stable")
        ahead = np.cumsum(length[order]) - length[order]
        base = np.concatenate([[0], np.cumsum(np.bincount(self.run_symbol, weights=length, minlength=257).astype(np.int64))])
        self.run_next = np.empty(len(order), np.int64)
        self.run_next[order] = below[self.run_symbol[order]] + ahead - base[self.run_symbol[order]]
        # ranges of suffixes that agree on `least` symbols
        edge = np.ones(n, bool)
        whole = left[suffixes] >= least
        pair = np.flatnonzero(whole[1:] & whole[:-1]) + 1
        for lo in range(0, len(pair), 1 << 16):
            k = pair[lo:lo + (1 << 16)]
            same = np.ones(len(k), bool)
            for j in range(least):
                same &= symbol[suffixes[k] + j] == symbol[suffixes[k - 1] + j]
            edge[k] = ~same
        self.range_start, self.range_of = np.flatnonzero(edge), (np.cumsum(edge) - 1).astype(np.int32)
        self.range_first = np.minimum.reduceat(doc[text[suffixes]], self.range_start)

    @staticmethod
    def _sorted(symbol: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
        """Suffixes in order, each up to its own text's end; equal ones in the order of the texts."""
        key, live = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(_FIRST):
            live &= left >= j
            key = (key << np.uint64(9)) | np.where(live, symbol[j:n + j], np.uint16(0))
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (left[order][1:] < _FIRST)
        rank, reach = np.empty(n, np.int64), _FIRST
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = start
        while True:
            single = new & np.append(new[1:], True)
            open_ = np.flatnonzero(~single)
            if not len(open_):
                return order
            part = order[open_]
            second = rank[part] * n + rank[np.minimum(part + reach, n - 1)]
            by = np.argsort(second, kind="stable")
            order[open_], second = part[by], second[by]
            fresh = np.ones(len(open_), bool)
            fresh[1:] = second[1:] != second[:-1]
            new[open_] = fresh
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[order[open_]] = start[open_]
            reach *= 2

    def earliest(self) -> np.ndarray:
        """For every start of `least` symbols in every text, in order: the smallest document that has them."""
        windows = np.maximum(self.size - self.least + 1, 0)
        first = np.cumsum(windows) - windows
        out = np.empty(int(windows.sum()), np.int64)
        text = np.flatnonzero(windows)
        at, matched = text.astype(np.int64), 0  # the terminators sort first, in the order of the texts
        while len(text):
            run = self.run_of[at]
            at = self.run_next[run] + at - self.run_start[run]
            matched += 1
            if matched >= self.least:
                out[first[text] + self.size[text] - matched] = self.range_first[self.range_of[at]]
                more = self.size[text] > matched
                text, at = text[more], at[more]
        return out
