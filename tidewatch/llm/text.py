"""Vector helpers over UTF-8 bytes, shared by the operators that work on Arrow batches.

A batch is a run of whole texts in one byte array with offsets; words, windows and hashes are arrays
over it, so no text is looped over in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
PIECE_BYTES = 1 << 21


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, since one text may be very long; leaves alone what was set at launch."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)
    return spark


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; only a local session may fall back to its own."""
    from tidewatch.session import scratch_dir

    return scratch_dir(spark, name)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, kept per worker."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, 2 * len(_POWERS[which][0]) if which in _POWERS else 1 << 16)
        up = np.full(size, _BASES[which], np.uint64)
        down = np.full(size, pow(int(_BASES[which]), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[which] = np.cumprod(up), np.cumprod(down)
    return _POWERS[which]


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: (first row, end row, bytes, offsets)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def byte_class(pairs) -> np.ndarray:
    """Table of 256 booleans, true within the given inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in pairs:
        table[a:b + 1] = True
    return table


SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
NOT_SPACE = ~SPACE
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that stay inside one text: starts, ends, row of each."""
    n = len(member)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, member[1:]
    start = np.flatnonzero(member & (edge[:n] | ~before))
    end = np.flatnonzero(member & (edge[1:] | ~after)) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte range, by a polynomial modulo 2**64.

    Patterned ranges of a thousand bytes or more can cancel out: for short ranges, or where hits are verified.
    """
    up, down = powers(which, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + _STEP * (end - start).astype(np.uint64))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte range of any length.

    The range's 8-byte blocks are mixed with their place before they are summed, so no pattern of bytes
    cancels out; another `which` gives an independent function.
    """
    size = (end - start).astype(np.int64)
    blocks = (size + 7) >> 3
    if not len(blocks) or not blocks.any():
        return mix(_STEP * size.astype(np.uint64) + _BASES[which])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    ends = np.cumsum(blocks)
    place = np.arange(ends[-1]) - np.repeat(ends - blocks, blocks)
    value = word[np.repeat(start, blocks) + 8 * place]
    rest = ends[blocks > 0] - 1  # the last block of each range may be cut
    value[rest] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (np.uint64(8) * (((size[blocks > 0] - 1) & 7) + 1).astype(np.uint64)))
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ mix(place.astype(np.uint64) * _STEP + _BASES[which])), out=total[1:])
    return mix(total[ends] - total[ends - blocks] + _STEP * size.astype(np.uint64) + _BASES[which])


def window_hash(word: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """64-bit hash of each k consecutive hashes; windows may cross texts, callers mask those."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(which, len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[:len(word)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n] + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    step, out = 1, x
    while step * 2 <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:len(x) - w + 1], out[w - step:w - step + len(x) - w + 1])


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True where any of the ranges lies."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) > 0


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
