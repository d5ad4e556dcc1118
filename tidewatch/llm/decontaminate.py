"""Benchmark decontamination: a broadcast set of benchmark windows against every training text.

Windows of benchmark words become 64-bit hashes; each task looks its text windows up in the sorted
set and checks every hit word for word. A set larger than `max_windows` is split by hash and the
texts pass through one part after another, so that what is broadcast stays bounded.

Defined cases: null or empty text has no words and no hits; an item of fewer words than the window
is one window, an item without words none; items with null id are ignored; repeated items and rows
count as themselves; an empty benchmark hits nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import ALNUM, LOWER, bytes_of, materialised, pieces, prepare, span_hash, spans, window_hash

MARKS = "doc_id long, n_words long, hit_words array<int>, hit_bytes array<int>, items array<string>"


def _words(data: np.ndarray, at: np.ndarray):
    low = LOWER[data]
    start, end, row = spans(ALNUM[low], at)
    return low, start, end, row, span_hash(low, start, end)


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = bytes_of(b.column(1))
        low, start, end, row, h = _words(data, at)
        counts = np.bincount(row, minlength=len(b))
        first = np.concatenate([[0], np.cumsum(counts)])
        ids, size, key, text = [], [], [], []
        for i, item in enumerate(b.column(0).to_pylist()):
            n = int(counts[i])
            k = min(n, window)
            if not k:
                continue
            lo = first[i]
            for j, x in enumerate(window_hash(h[lo:lo + n], k)):
                ids.append(item)
                size.append(k)
                key.append(int(x.astype(np.int64)))
                text.append(b" ".join(low[s:e].tobytes() for s, e in zip(start[lo + j:lo + j + k], end[lo + j:lo + j + k])))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(size, pa.int32()), pa.array(key, pa.int64()),
                                          pa.array(text, pa.binary())], ["item", "size", "key", "words"])


def _by_size(rows) -> dict:
    """size -> (sorted keys, {key: {words: [items]}})."""
    out: dict = {}
    for item, size, key, words in rows:
        out.setdefault(size, {}).setdefault(key & (1 << 64) - 1, {}).setdefault(bytes(words), set()).add(item)
    return {size: (np.array(sorted(found), np.uint64), found) for size, found in out.items()}


def _scan(batches: Iterator[pa.RecordBatch], index, carried: bool) -> Iterator[pa.RecordBatch]:
    sets = index.value
    for b in batches:
        data, at = bytes_of(b.column(1))
        n_words, hits, hit_bytes, items = np.zeros(len(b), np.int64), [[] for _ in range(len(b))], [[] for _ in range(len(b))], [set() for _ in range(len(b))]
        if carried:
            for i, (old, names) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                hits[i], items[i] = list(zip(old[::2], old[1::2])), set(names)
        for lo, hi, data_, at_ in pieces(data, at):
            low, start, end, row, h = _words(data_, at_)
            count = np.bincount(row, minlength=hi - lo)
            n_words[lo:hi] = count
            first = np.concatenate([[0], np.cumsum(count)])
            for size, (keys, found) in sets.items():
                w = window_hash(h, size)
                if not len(w) or not len(keys):
                    continue
                pos = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
                hit = np.flatnonzero((keys[pos] == w) & (row[:len(w)] == row[size - 1:size - 1 + len(w)]))
                for j in hit.tolist():
                    words = b" ".join(low[s:e].tobytes() for s, e in zip(start[j:j + size], end[j:j + size]))
                    names = found[int(w[j])].get(words)
                    if names:
                        i = int(row[j])
                        items[lo + i] |= names
                        hits[lo + i].append((j - int(first[i]), j - int(first[i]) + size))
            for i in range(hi - lo):
                if hits[lo + i]:
                    hits[lo + i] = _union(hits[lo + i])
                    base = int(at_[i])
                    for s, e in hits[lo + i]:
                        hit_bytes[lo + i] += [int(start[first[i] + s]) - base, int(end[first[i] + e - 1]) - base]
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n_words), pa.array([[x for r in h for x in r] for h in hits], ints), pa.array(hit_bytes, ints),
             pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["doc_id", "text", "n_words", "hit_words", "hit_bytes", "items"])


def _union(ranges: list) -> list:
    out: list = []
    for s, e in sorted(set(ranges)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _lean(batches: Iterator[pa.RecordBatch], scan) -> Iterator[pa.RecordBatch]:
    for b in scan(batches):
        yield b.select([0, 2, 3, 4, 5])


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = 300_000) -> DataFrame:
    """Per document: word count, merged hit ranges in words and in bytes (flat start, end pairs), items hit.

    `max_windows` bounds what one broadcast holds (about 150 bytes a window); beyond it the set is
    dealt by hash into as many parts as needed and the texts go through them in turn.
    """
    spark = prepare(docs.sparkSession)
    windows = (benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null")
               .mapInArrow(lambda it: _item_windows(it, window), "item string, size int, key long, words binary").distinct())
    total = windows.count()
    n = max(1, -(-total // max_windows))
    if n > 1:
        windows = materialised(windows, "benchmark-windows")
    texts, key = docs.select(F.col("doc_id").cast("long"), "text"), F.pmod(F.xxhash64("key"), F.lit(n))
    for part in range(n):
        index = spark.sparkContext.broadcast(_by_size(map(tuple, (windows if n == 1 else windows.filter(key == part)).collect())))
        scan = lambda it, index=index, carried=part > 0: _scan(it, index, carried)
        if part == n - 1:
            return texts.mapInArrow(lambda it, scan=scan: _lean(it, scan), MARKS)
        texts = materialised(texts.mapInArrow(scan, "doc_id long, text string, " + MARKS.partition(", ")[2]), "benchmark-part")
        texts = texts.select("doc_id", "text", "hit_words", "items")


def digest(marks: DataFrame) -> DataFrame:
    """Counts and the item digest of marked documents."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_words") - 1), F.lit(0).cast("long"),
                        lambda a, i: a + F.when(i % 2 == 1, F.col("hit_words")[i]).otherwise(-F.col("hit_words")[i]))
    n_hit = F.when(F.size("hit_words") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return marks.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any hit, all columns kept."""
    hit = mark(docs, benchmark, window).filter(F.size("hit_words") > 0).select(F.col("doc_id").alias("_hit_id")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_hit_id")), "left_anti")
