"""Two rounds of exchange between blocks of documents and buckets of content.

Documents are dealt into blocks by id. A block sends each content bucket one packed message about
its distinct content (what occurs often inside the block goes once); a bucket answers each block.
Spark's shuffles carry the messages, so no task holds more than a block or a bucket, and neither
pairs nor the copies of one text ever meet. The documents' own shuffle is shared by all rounds.

Exact copies of a text are told apart from their first document by one narrow aggregate: only the
copy with the smallest id sends messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import bytes_of, mix, parts, prepare

MESSAGE = "bucket int, block int, payload binary"
REPLY = "block int, doc long, payload binary, round int"
NO_ID = -(1 << 63)


def _block(doc: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(n)).cast("int")


class Exchange:
    def __init__(self, docs: DataFrame, block_bytes: int | None = None):
        """`docs` needs doc_id and text. A null doc_id is a document that sorts first.

        `block_bytes`: the texts are summed up first, and there are as many blocks as give a block no more than
        that on average, however few the shuffle partitions are.
        """
        spark = prepare(docs.sparkSession)
        n = parts(spark)
        self.n = max(n, min(2 * n, 128))  # messages grow with its square
        if block_bytes:
            self.n = max(self.n, -(-(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // block_bytes))
        doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
        self.docs = docs.select(_block(doc, self.n).alias("block"), doc.alias("doc"), "text")
        first = (docs.select(doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
                 .select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("n"))
                 .groupBy("h1", "h2", "n").agg(F.min("doc").alias("doc")))
        self.known = first.select(_block(F.col("doc"), self.n).alias("block"), "doc", F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("round"))

    def _meet(self, infos: list[DataFrame], work: Callable, schema: str) -> DataFrame:
        right = self.known
        for info in infos:
            right = right.unionByName(info)
        return self.docs.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(work, schema)

    def send(self, infos: list[DataFrame], make: Callable) -> DataFrame:
        """`make(data, at, doc, replies)` of the first copies gives (bucket, payload) pairs."""
        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
            doc, data, at, first = _block_rows(left, right)
            got = list(make(*_only(data, at, doc, first), _replies(right)))
            return pa.table({"bucket": pa.array([b for b, _ in got], pa.int32()), "block": pa.array([left.column("block")[0].as_py()] * len(got), pa.int32()),
                             "payload": pa.array([p for _, p in got], pa.binary())})

        return self._meet(infos, work, MESSAGE)

    def answer(self, messages: DataFrame, reduce: Callable, round_: int) -> DataFrame:
        """`reduce(payloads)` of one bucket gives one payload (or None) for each."""
        def work(table: pa.Table) -> pa.Table:
            got = [(b, p) for b, p in zip(table.column("block").to_pylist(), reduce(table.column("payload").to_pylist())) if p]
            return pa.table({"block": pa.array([b for b, _ in got], pa.int32()), "doc": pa.array([None] * len(got), pa.int64()),
                             "payload": pa.array([p for _, p in got], pa.binary()), "round": pa.array([round_] * len(got), pa.int32())})

        return messages.groupBy("bucket").applyInArrow(work, REPLY)

    def finish(self, infos: list[DataFrame], make: Callable, schema: str) -> DataFrame:
        """`make(data, at, doc, first, replies)` of a whole block gives columns of its rows, without doc_id."""
        names = [x.split()[0] for x in schema.split(", ")]

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            doc, data, at, first = _block_rows(left, right)
            columns = make(data, at, doc, first, _replies(right)) if left.num_rows else [[] for _ in names]
            ids = pa.array(doc, pa.int64(), mask=doc == NO_ID)
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            return pa.table({"doc_id": ids} | {n: pa.array(c, kinds[k]) for n, k, c in zip(names, (x.split()[1] for x in schema.split(", ")), columns)})

        return self._meet(infos, work, "doc_id long, " + schema)


def _block_rows(left: pa.Table, right: pa.Table):
    doc = left.column("doc").to_numpy().astype(np.int64)
    data, at = bytes_of(left.column("text"))
    known = right.filter(right.column("payload").is_null()).column("doc").to_numpy()
    return doc, data, at, np.isin(doc, known.astype(np.int64))


def _only(data, at, doc, keep):
    """The kept rows' bytes, offsets and ids."""
    if keep.all():
        return data, at, doc
    size = np.diff(at)
    return data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]), doc[keep]


def _replies(right: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for r, p in zip(right.column("round").to_pylist(), right.column("payload").to_pylist()):
        if p is not None:
            out.setdefault(r, []).append(p)
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of any length one after another, each with its length."""
    return b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)


def unpacked(payload: bytes, *kinds) -> list[np.ndarray]:
    out, p = [], 0
    for kind in kinds:
        n = int(np.frombuffer(payload, np.int64, 1, p)[0])
        out.append(np.frombuffer(payload, kind, n // np.dtype(kind).itemsize, p + 8))
        p += 8 + n
    return out


def gathered(payloads: list[bytes], *kinds) -> tuple[list[np.ndarray], np.ndarray]:
    """Each field over all payloads, and where each payload's first field starts."""
    fields = [unpacked(p, *kinds) for p in payloads]
    at = np.concatenate([[0], np.cumsum([len(f[0]) for f in fields])]).astype(np.int64)
    return [np.concatenate([f[i] for f in fields]) if fields else np.zeros(0, k) for i, k in enumerate(kinds)], at


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket; positions stay in order."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edge):
        if len(part):
            yield int(bucket[part[0]]), part


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key) % np.uint64(n)).astype(np.int32)


def anchors(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and in how many rows each occurs (255 at most)."""
    if not len(values):
        return values[:0], np.zeros(0, np.uint8)
    order = np.lexsort((row, values))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    other = new.copy()
    other[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(new)
    return values[at], np.minimum(np.add.reduceat(other.astype(np.int64), at), 255).astype(np.uint8)


def anchor_code(anchor: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the upper half, 32 more bits of the hash in the lower. Only a chance equality inside
    one bucket makes two anchors one; that adds candidates, which later rounds refuse, and loses none."""
    key = mix(anchor)
    return (key % np.uint64(n)) << np.uint64(32) | (mix(key) >> np.uint64(32))


def send_anchors(found: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    code, rows = found
    if len(code):
        bucket = (code >> np.uint64(32)).astype(np.int32)  # codes are sorted
        edge = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip(np.append(0, edge), np.append(edge, len(code))):
            yield int(bucket[lo]), packed(code[lo:hi].astype(np.uint32), rows[lo:hi], bucket[lo:lo + 1])


def repeated_anchors(hot: int) -> Callable[[list[bytes]], list[bytes | None]]:
    """Answers each block with those of its anchors that two or more texts hold; flags those in more than `hot`."""
    def reduce(payloads: list[bytes]) -> list[bytes | None]:
        (key, rows, bucket), at = gathered(payloads, np.uint32, np.uint8, np.int32)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        total = np.empty(len(key), np.int64)
        total[order] = np.repeat(np.add.reduceat(rows[order].astype(np.int64), np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(key))))
        out = []
        for lo, hi in zip(at[:-1], at[1:]):
            again = np.flatnonzero(total[lo:hi] > 1) + lo
            out.append(packed(key[again], (total[again] > hot).astype(np.uint8), bucket[:1]) if len(again) else None)
        return out

    return reduce


def member(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it there, where) of values in a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values, at


def located(a: np.ndarray, b: np.ndarray, key_a: np.ndarray, key_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it there, where) of 128-bit values in keys sorted by their first, then second half."""
    hit, where = member(a, key_a)
    while len(key_a):
        on = np.flatnonzero(hit & (key_b[where] != b))
        if not len(on):
            break
        where[on] += 1
        hit[on] &= key_a[np.minimum(where[on], len(key_a) - 1)] == a[on]
        hit[on] &= where[on] < len(key_a)
        where[on] = np.minimum(where[on], len(key_a) - 1)
    return hit, where


def anchor_table(replies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the anchors that stay alive, and their flags."""
    fields = [unpacked(p, np.uint32, np.uint8, np.int32) for p in replies]
    if not fields:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    code = np.concatenate([f[0].astype(np.uint64) | np.uint64(int(f[2][0]) << 32) for f in fields])
    order = np.argsort(code)
    return code[order], np.concatenate([f[1] for f in fields])[order]
