"""Substring dedup over bytes with a run-length index of the repetitive part of the corpus.

Each `least`-byte window is stood for by the least hash of its inner byte strings (its anchor), so
equal windows share an anchor wherever they lie. Anchors that no two texts share are dropped with
their windows: those can't match. The rest is cut into segments, runs of windows with one anchor;
the bucket of an anchor gets the distinct segments with their smallest documents, builds the run-length
index over them and streams the segments through it, which tells each window's earliest document.
Segments of an anchor in very many texts are dealt on by window, so that no bucket grows with one
passage. A bucket's content comes in parts by anchor, and an index covers neighbouring parts of about
INDEX_BYTES, so its memory does not grow with the bucket. A window that starts in a smaller document is
removed byte by byte.

Defined cases: null text is empty; a text shorter than `least` loses nothing; of equal texts all but
the one with the smallest id lose everything (if long enough); rows with one doc_id are one document
and don't match each other; a null doc_id sorts first. Other columns are not read.
A text of any length is taken whole, by one task; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from tidewatch.llm import blocks
from tidewatch.llm.run_index import RunIndex
from tidewatch.llm.text import covered, mix, pieces, sliding_min, span_hash, window_hash

INNER = 24
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
STRETCH = 32
HOT = 255
BLOCK_BYTES = 1 << 24
PIECE = 1 << 19
PARTS = 256
INDEX_BYTES = 1 << 18


def _anchored(data, at, least: int):
    """(anchor of each window start, whether the window stays inside one text, its row)."""
    h = window_hash(_SYMBOL[data], INNER)
    low = sliding_min(h, least - INNER + 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(low)]
    return low, np.arange(len(low)) + least <= at[1:][row], row


def _seeds(data, at, doc, least: int, n: int):
    values, rows = [], []
    for lo, _, data_, at_ in pieces(data, at, PIECE):
        low, inside, row = _anchored(data_, at_, least)
        if not len(low):
            continue
        new = inside.copy()
        new[1:] &= (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        values.append(blocks.anchor_code(low[new], n))
        rows.append(row[new] + lo)
    return blocks.send_anchors(blocks.anchors(np.concatenate(values), doc[np.concatenate(rows)])) if values else []


def _segments(data, at, alive, flag, least: int, n: int):
    """Runs of windows with one shared anchor: starts, ends (bytes), rows, two hashes, bucket and part in one number."""
    low, inside, row = _anchored(data, at, least)
    if not len(low):
        return None
    edge = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    hit, where = (np.repeat(x, np.diff(np.append(edge, len(low)))) for x in blocks.member(blocks.anchor_code(low[edge], n), alive))
    hit &= inside
    if not hit.any():
        return None
    new = hit.copy()
    new[1:] &= (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~hit[:-1]
    if flag.any():
        new |= hit & (flag[where] > 0)
    start = np.flatnonzero(new)
    stop = np.flatnonzero(hit & ~np.append(hit[1:] & ~new[1:], False)) + 1
    long = np.maximum(1, -(-(stop - start) // STRETCH))
    first = np.repeat(start, long) + STRETCH * (np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long))
    stop = np.minimum(first + STRETCH, np.repeat(stop, long))
    end = stop + least - 1
    a, b = span_hash(data, first, end, 0), span_hash(data, first, end, 1)
    key = np.where(flag[where[first]] > 0, low[first] ^ a, low[first])
    return first, end, row[first], a, b, blocks.bucket_of(key, index_buckets(n)).astype(np.int64) * PARTS + (mix(key) >> np.uint64(56)).astype(np.int64)


def index_buckets(n: int) -> int:
    """More buckets than blocks where there are few, since an index takes many times its text's memory."""
    return max(n, min(4 * n, 512))


def _texts(data, start, end):
    """The bytes of ranges one after another, and their offsets."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)], at


def _send(data, at, doc, replies, least: int, n: int):
    alive, flag = blocks.anchor_table(replies.get(1, []))
    if not len(alive):
        return
    found = []
    for lo, hi, data_, at_ in pieces(data, at, PIECE):
        got = _segments(data_, at_, alive, flag, least, n)
        if got:
            start, end, row, a, b, place = got
            found.append((start + at[lo], end + at[lo], doc[row + lo], a, b, place))
    if not found:
        return
    start, end, d, a, b, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((d, b, a, place))
    new = np.ones(len(order), bool)
    same = [x[order] for x in (place, a, b)]
    new[1:] = np.any([x[1:] != x[:-1] for x in same], axis=0)
    keep, edge = order[new], np.flatnonzero(new)
    several = d[order[np.append(edge[1:], len(order)) - 1]] > d[keep]
    for bucket, at_ in blocks.by_bucket(place[keep] // PARTS):
        k = keep[at_]
        text, _ = _texts(data, start[k], end[k])
        part = (place[k] % PARTS).astype(np.uint8)
        yield bucket, zstandard.compress(blocks.packed(d[k], several[at_].astype(np.uint8), (end[k] - start[k]).astype(np.uint8), part, text), 3)


def _match(payloads, least: int):
    fields = [blocks.unpacked(zstandard.decompress(p), np.int64, np.uint8, np.uint8, np.uint8, np.uint8) for p in payloads]
    # a message's segments come in order of their part
    row = np.array([np.searchsorted(f[3], np.arange(PARTS + 1)) for f in fields])
    byte = np.array([np.concatenate([[0], np.cumsum(f[2], dtype=np.int64)])[r] for f, r in zip(fields, row)])
    replies: list[list] = [[] for _ in fields]
    for lo, hi in _batches(np.diff(byte.sum(axis=0))):
        cut = [(f, *r) for f, r in zip(fields, np.stack([row[:, lo], row[:, hi], byte[:, lo], byte[:, hi]], axis=1).tolist())]
        found = _matched(*(np.concatenate([f[i][x:y] for f, x, y, _, _ in cut]) for i in range(3)), np.concatenate([f[4][x:y] for f, _, _, x, y in cut]), least)
        a, b, n, run_from, run_doc, useful = found
        # the useful rows, then their runs, up to each message
        to = np.concatenate([[0], np.cumsum(useful)])[np.concatenate([[0], np.cumsum(row[:, hi] - row[:, lo])])]
        run_to = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[to]
        for i in np.flatnonzero(np.diff(to)).tolist():
            x, y, u, v = to[i], to[i + 1], run_to[i], run_to[i + 1]
            replies[i].append((a[x:y], b[x:y], n[x:y], run_from[u:v], run_doc[u:v]))
    for got in replies:
        yield blocks.packed(*(np.concatenate(x) for x in zip(*got))) if got else None


def _batches(volume):
    """(first part, end part) of runs of parts of about INDEX_BYTES."""
    lo, total = 0, 0
    for part, more in enumerate(volume.tolist()):
        if total and total + more > INDEX_BYTES:
            yield lo, part
            lo, total = part, 0
        total += more
    if total:
        yield lo, len(volume)


def _matched(d, several, size, data, least: int):
    """Hashes and runs (number, window, earliest document) of the segments that someone has to be told of, and which those are."""
    size = size.astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    a, b = span_hash(data, at[:-1], at[1:], 0), span_hash(data, at[:-1], at[1:], 1)
    order = np.lexsort((d, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    owner = order[new]
    owner = owner[np.argsort(d[owner], kind="stable")]
    place = np.empty(len(owner), np.int64)
    place[group[owner]] = np.arange(len(owner))
    text, text_at = _texts(data, at[owner], at[owner + 1])
    first = RunIndex(text, text_at, d[owner], least).earliest()
    windows = size[owner] - least + 1
    # runs of equal documents inside each distinct segment
    ends = np.cumsum(windows)
    edge = np.ones(len(first), bool)
    edge[1:] = first[1:] != first[:-1]
    edge[ends[:-1]] = True
    run = np.flatnonzero(edge)
    of = np.searchsorted(ends, run, "right")
    run_doc, run_from = first[run], (run - (ends - windows)[of]).astype(np.uint8)
    run_at = np.searchsorted(of, np.arange(len(owner) + 1))
    lo, n = run_at[place[group]], np.diff(run_at)[place[group]]
    take = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
    useful = (np.minimum.reduceat(run_doc[take], np.cumsum(n) - n) < d) | (several > 0)
    take = take[np.repeat(useful, n)]
    return a[useful], b[useful], n[useful].astype(np.uint8), run_from[take], run_doc[take], useful


def _removed(data, at, doc, first, replies, least: int, n: int):
    """(rows of a piece, bytes, offsets, which bytes go)."""
    alive, flag = blocks.anchor_table(replies.get(1, []))
    (a, b, runs, run_from, run_doc), _ = blocks.gathered(replies.get(2, []), np.uint64, np.uint64, np.uint8, np.uint8, np.int64)
    runs = runs.astype(np.int64)
    run_at = np.cumsum(runs) - runs
    order = np.lexsort((b, a))
    key_a, key_b = a[order], b[order]
    for lo, hi, data_, at_ in pieces(data, at, PIECE):
        gone = np.zeros(len(data_), bool)
        got = _segments(data_, at_, alive, flag, least, n) if len(a) else None
        if got:
            start, end, row, sa, sb, _ = got
            hit, where = blocks.located(sa, sb, key_a, key_b)
            hit = np.flatnonzero(hit)
            if len(hit):
                reply = order[where[hit]]
                k = runs[reply]
                take = np.arange(k.sum()) + np.repeat(run_at[reply] - (np.cumsum(k) - k), k)
                seg = np.repeat(hit, k)
                begin = start[seg] + run_from[take]
                stop = np.append(begin[1:], 0)
                last = np.cumsum(k) - 1
                stop[last] = end[hit] - least + 1
                earlier = run_doc[take] < doc[lo + row[seg]]
                gone = covered(len(data_), begin[earlier], stop[earlier] + least - 1)
        size = np.diff(at_)
        gone |= np.repeat(~first[lo:hi] & (size >= least), size)
        yield data_, at_, gone


def _digest(data, at, doc, first, replies, least: int, n: int):
    n_bytes, n_removed, n_spans, sha = [], [], [], []
    for data_, at_, gone in _removed(data, at, doc, first, replies, least, n):
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        head = at_[:-1][np.diff(at_) > 0]
        begins[head] = gone[head]
        left = np.concatenate([[0], np.cumsum(~gone)])[at_]
        n_bytes += np.diff(at_).tolist()
        n_removed += (np.diff(at_) - np.diff(left)).tolist()
        n_spans += np.diff(np.concatenate([[0], np.cumsum(begins)])[at_]).tolist()
        stay = data_[~gone].tobytes()
        sha += [hashlib.sha256(stay[i:j]).hexdigest() for i, j in zip(left[:-1].tolist(), left[1:].tolist())]
    return n_bytes, n_removed, n_spans, sha


def digests(docs: DataFrame, least: int = 50) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, digest of the remaining bytes."""
    if not INNER < least <= 200:
        raise ValueError(f"least must lie above {INNER} and not above 200")
    ex = blocks.Exchange(docs, BLOCK_BYTES)
    n = ex.n
    seeds = ex.send([], lambda data, at, doc, _: _seeds(data, at, doc, least, n))
    alive = ex.answer(seeds, blocks.repeated_anchors(HOT), 1)
    segments = ex.send([alive], lambda data, at, doc, replies: _send(data, at, doc, replies, least, n))
    found = ex.answer(segments, lambda payloads: list(_match(payloads, least)), 2)
    return ex.finish([alive, found], lambda *rows: _digest(*rows, least, n), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
