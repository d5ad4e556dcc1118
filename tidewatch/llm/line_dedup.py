"""Line dedup: lines found in many documents stay in the largest of them only.

Keys of long lines become 128-bit hashes. Rows (hash, document, position) are dealt by range of
(hash, document), so that one very common line spreads over many tasks, and sorted by hash, then
document. Each task streams its rows once. A run of one hash that touches an end of the task's range
may go on in a neighbour; only such runs (two per task at most) are summed up in a small table.
The result is one compressed keep bitmap per document, not text.

Defined cases: null or empty text is one empty line; rows that share a doc_id are one document, each
row (told apart by its text) keeps its own lines; a null doc_id is a document of its own that sorts first. Other columns are
not read.
A text of any length is taken whole, by one task; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import materialised, parts, prepare

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
RUNS = "h1 long, h2 long, n_docs long, last long"


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of every line whose key has at least `min_chars` code points; row is the text's hash."""
    line = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")
    key = F.translate(F.trim(F.col("line"), F.lit(BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), line)
            .select("doc_id", "row", "pos", key.alias("key"))
            .filter(F.char_length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "pos"))


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row for each hash held by enough documents, and for the runs at both ends of the task's range."""
    open_run, first = None, True
    for b in batches:
        if not len(b):
            continue
        h1, h2 = (b.column(i).to_numpy() for i in (0, 1))
        doc = b.column(2).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        new = np.ones(len(b), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(new)
        run = [h1[at], h2[at], np.add.reduceat(other.astype(np.int64), at), np.maximum.reduceat(doc, at)]
        if open_run is not None:
            if open_run[0] == run[0][0] and open_run[1] == run[1][0]:
                run[2][0] += open_run[2] - (open_run[4] == doc[0])
                run[3][0] = max(run[3][0], open_run[3])
            else:
                run = [np.concatenate([[x], y]) for x, y in zip(open_run, run)]
        keep = run[2] >= least
        if first:
            keep[0], first = True, len(keep) == 1
        keep = np.flatnonzero(keep[:-1])
        if len(keep):
            yield _run_batch([x[keep] for x in run])
        open_run = [x[-1] for x in run] + [doc[-1]]
    if open_run is not None:
        yield _run_batch([np.array([x]) for x in open_run[:4]])


def _run_batch(run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in run], ["h1", "h2", "n_docs", "last"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for at in b.column(2).to_pylist():
            stay = np.ones(max(at) // 8 * 8 + 8, bool)
            stay[at] = False
            out.append(zlib.compress(np.packbits(stay, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in b.column(2)], pa.int64()), pa.array(out, pa.binary())],
                                         ["doc_id", "row", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, n_dropped, keep) of the rows that lose lines.

    `keep` is a zlib-compressed bitmap, least bit first, set where a line stays; it ends with the last
    dropped line, and every line beyond it stays.
    """
    spark = prepare(docs.sparkSession)
    lines = materialised(keyed_lines(docs, min_chars), "line-keys")
    dealt = lines.repartitionByRange(parts(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    runs = dealt.select("h1", "h2", "doc_id").mapInArrow(lambda it: _runs(it, min_docs), RUNS)
    common = (runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))
              .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "last"))
    lowest = F.lit(-(1 << 63)).cast("long")
    dropped = lines.join(common, ["h1", "h2"]).filter(F.coalesce("doc_id", lowest) < F.col("last")).select("doc_id", "row", "pos")
    return dropped.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("pos")).mapInArrow(_bitmaps, "doc_id long, row long, n_dropped long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        count, left, gone = [], [], []
        for text, keep in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lines = (text or "").split("\n")
            count.append(len(lines))
            if keep:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:len(lines)].tolist()
                stay = [x for x, k in zip(lines, bits) if k] + lines[len(bits):]
                gone.append(len(lines) - len(stay))
                left.append("\n".join(stay))
            else:
                gone.append(0)
                left.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())],
                                         ["doc_id", "n_lines", "n_dropped", "text"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _apply(batches):
        sha = [hashlib.sha256((x or "").encode()).hexdigest() for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    bits = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("_dealt_of"), F.col("row").alias("_dealt_row"), F.col("keep").alias("_dealt_keep"))
    return docs.join(bits, F.col("doc_id").eqNullSafe(F.col("_dealt_of")) & (F.xxhash64("text") == F.col("_dealt_row")), "left")


def digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: lines, lines dropped, digest of what stays."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return _with_bitmaps(docs, min_chars, min_docs).select("doc_id", "text", "_dealt_keep").mapInArrow(
        _digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def remove(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with common lines taken out of `text`; all columns stay, n_chars follows the text."""
    names = docs.columns

    def apply(batches):
        for b in batches:
            table = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            made = list(_apply([b.select(["doc_id", "text", "_dealt_keep"])]))[0]
            table["text"] = made.column(3)
            if "n_chars" in table:
                table["n_chars"] = pa.array([None if x is None else len(x) for x in made.column(3).to_pylist()], table["n_chars"].type)
            yield pa.RecordBatch.from_arrays([table[n] for n in names], names)

    return _with_bitmaps(docs, min_chars, min_docs).select(*names, "_dealt_keep").mapInArrow(apply, docs.schema)
