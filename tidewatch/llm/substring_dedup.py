"""Substring dedup over words by level-wise doubling.

Level one: of each window's half-length windows the one with the least hash stands for it; those
that no two texts share are dropped with all they stand for. Survivors alone are extended to windows
of twice the length (the two halves' hashes joined, 128 bits), and the bucket of each tells the
smallest document that starts it. A window that starts in a smaller document is removed word by word.

Defined cases: null text has no words; a text shorter than the window loses nothing; of equal
texts all but the one with the smallest id lose everything (if long enough); rows with one doc_id
are one document and don't match each other; a null doc_id sorts first. Other columns are not read.
A text of any length is taken whole, by one task; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tidewatch.llm import blocks
from tidewatch.llm.text import NOT_SPACE, covered, mix, pieces, sliding_min, word_hash, spans, window_hash

_K = np.uint64(0x9FB21C651E98DF25)


def _halves(data, at, half: int, which: int):
    """Words, their rows, and the hash of each half-length window."""
    start, end, row = spans(NOT_SPACE[data], at)
    return start, end, row, window_hash(word_hash(data, start, end, which), half, which)


def _doubled(h: np.ndarray, half: int) -> np.ndarray:
    return mix(h[:-half] * _K + h[half:]) if len(h) > half else h[:0]


def _chosen(row, h, half: int):
    """Least half-window hash of each window, and which windows stay inside one row."""
    least = sliding_min(h, half + 1)
    return least, row[:len(least)] == row[2 * half - 1:2 * half - 1 + len(least)]


def _seeds(data, at, doc, half: int, n: int):
    values, rows = [], []
    for lo, _, data_, at_ in pieces(data, at):
        _, _, row, h = _halves(data_, at_, half, 0)
        least, inside = _chosen(row, h, half)
        if not len(least):
            continue
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | (row[1:len(least)] != row[:len(least) - 1]) | ~inside[:-1]
        values.append(blocks.anchor_code(least[new], n))
        rows.append(row[:len(least)][new] + lo)
    return blocks.send_anchors(blocks.anchors(np.concatenate(values), doc[np.concatenate(rows)])) if values else []


def _windows(data, at, doc, replies, half: int, n: int):
    alive, _ = blocks.anchor_table(replies.get(1, []))
    a, b, d = [], [], []
    for lo, _, data_, at_ in pieces(data, at):
        _, _, row, h = _halves(data_, at_, half, 0)
        least, inside = _chosen(row, h, half)
        keep = np.flatnonzero(inside & blocks.member(blocks.anchor_code(least, n), alive)[0])
        if len(keep):
            a.append(_doubled(h, half)[keep])
            b.append(_doubled(_halves(data_, at_, half, 1)[3], half)[keep])
            d.append(doc[row[keep] + lo])
    if not a:
        return
    a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
    order = np.lexsort((d, b, a))
    a, b, d = a[order], b[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    last = d[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
    a, b, d = a[new], b[new], d[new]
    for bucket, at_ in blocks.by_bucket(blocks.bucket_of(a, n)):
        yield bucket, blocks.packed(a[at_], b[at_], d[at_], last[at_])


def _earliest(payloads):
    (a, b, d, last), at = blocks.gathered(payloads, np.uint64, np.uint64, np.int64, np.int64)
    order = np.lexsort((d, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    edge = np.flatnonzero(new)
    first = np.empty(len(a), np.int64)
    first[order] = np.repeat(d[order][edge], np.diff(np.append(edge, len(a))))
    for lo, hi in zip(at[:-1], at[1:]):
        hit = np.flatnonzero(first[lo:hi] < last[lo:hi]) + lo
        yield blocks.packed(a[hit], b[hit], first[hit]) if len(hit) else None


def _removed(data, at, doc, first, replies, half: int):
    (a, b, least), _ = blocks.gathered(replies.get(2, []), np.uint64, np.uint64, np.int64)
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    for lo, hi, data_, at_ in pieces(data, at):
        start, end, row, h = _halves(data_, at_, half, 0)
        gone = np.zeros(len(start), bool)
        if len(a) and len(h) > half:
            h50 = _doubled(h, half)
            hit = np.flatnonzero(blocks.member(h50, a)[0] & (row[:len(h50)] == row[2 * half - 1:2 * half - 1 + len(h50)]))
            if len(hit):
                there, where = blocks.located(h50[hit], _doubled(_halves(data_, at_, half, 1)[3], half)[hit], a, b)
                hit = hit[there & (least[where] < doc[lo + row[hit]])]
                gone = covered(len(start), hit, hit + 2 * half)
        n = np.bincount(row, minlength=hi - lo)
        gone |= (~first[lo:hi] & (n >= 2 * half))[row]
        yield lo, hi, data_, at_, start, end, row, n, gone


def _digest(data, at, doc, first, replies, half: int):
    n_words, n_removed, sha = [], [], []
    for lo, hi, data_, at_, start, end, row, n, gone in _removed(data, at, doc, first, replies, half):
        n_words += n.tolist()
        n_removed += np.bincount(row[gone], minlength=hi - lo).tolist()
        out, mask = np.append(data_, np.uint8(32)), np.zeros(len(data_) + 1, bool)
        s, e, r = start[~gone], end[~gone], row[~gone]
        if len(s):
            mask[:-1] = covered(len(data_), s, e)
            more = e[:-1][r[1:] == r[:-1]]
            out[more], mask[more] = 32, True
        stay, ends = out[mask], np.concatenate([[0], np.cumsum(mask)])[at_]
        stay = stay.tobytes()
        sha += [hashlib.sha256(stay[i:j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return n_words, n_removed, sha


def digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per document: words, words removed, digest of the kept words joined by one space. `window` is even."""
    if window % 2:
        raise ValueError("the window is twice its half")
    half = window // 2
    ex = blocks.Exchange(docs)
    n = ex.n
    seeds = ex.send([], lambda data, at, doc, _: _seeds(data, at, doc, half, n))
    alive = ex.answer(seeds, blocks.repeated_anchors(255), 1)
    windows = ex.send([alive], lambda data, at, doc, replies: _windows(data, at, doc, replies, half, n))
    found = ex.answer(windows, lambda payloads: list(_earliest(payloads)), 2)
    return ex.finish([found], lambda *rows: _digest(*rows, half), "n_words long, n_removed long, kept_sha256 string")
