"""Product codes of vectors by Lloyd's method on parts that stay where they are.

A vector is cut into `PARTS` parts; a part is a member of one entry of its position's codebook. Members
live in the partition of (position, entry, salt); the salt spreads an entry that holds many of them.
In each round

1. every partition adds up its own members by entry, and only these sums are shuffled; they give
   the new entries, a table of PARTS x ENTRIES rows, which is all that reaches the driver;
2. every partition assigns its own members anew. Those that keep their entry stay in place; those
   that change it are written apart and go to their new owner in one shuffle, and nothing else does.

A round's members are written to the shared folder, so lost executors cost one round at most;
the round before is deleted when its successor is complete. All arithmetic is on integers, so results don't
depend on how rows are dealt.

Defined cases: a vector that is null or holds a null or non-finite component is dropped; fewer than ENTRIES
vectors give as many entries; equal distances go to the lower index, an unused entry stays; equal vec_ids
are different rows, of which the smaller vector comes first; a null vec_id comes last; vectors shorter than
the longest, or of a length that PARTS doesn't divide, are filled up with zeros; an empty table gives no rows.
A component beyond 2**26 / SCALE in size is refused with an error, since squares must fit 64 bits.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.text import parts as shuffle_parts
from tidewatch.llm.text import prepare, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 26
MEMBER = "row long, p int, e int, salt int, d long, part binary"
MOVED = MEMBER + ", moved boolean"
NAMES = [x.split()[0] for x in MOVED.split(", ")]


def _integers(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    out = np.floor(out * SCALE)
    if len(out) and np.abs(out).max(initial=0) > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST / SCALE:g}")
    return out.astype(np.int64)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry, the lowest index of equals."""
    best, least = np.zeros(len(part), np.int64), np.full(len(part), np.iinfo(np.int64).max)
    for e, entry in enumerate(entries):
        d = ((part - entry) ** 2).sum(axis=1)
        closer = d < least
        best[closer], least[closer] = e, d[closer]
    return best, least


def _cut(batches: Iterator[pa.RecordBatch], width: int, books, salts: int) -> Iterator[pa.RecordBatch]:
    """Members of whole vectors, assigned to the first entries."""
    size = width // PARTS
    for b in batches:
        row = b.column(0).to_numpy()
        whole = _integers(b.column(1).to_pylist(), width)
        for p in range(PARTS):
            part = np.ascontiguousarray(whole[:, p * size:(p + 1) * size])
            e, d = nearest(part, books.value[p])
            yield _members(row, np.full(len(row), p), e, np.arange(len(row)) % salts, d, part, None)


def _members(row, p, e, salt, d, part, moved) -> pa.RecordBatch:
    n, width = part.shape
    raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (4 * width)), pa.py_buffer(part.astype("<i4").tobytes())])
    columns = [pa.array(row), *(pa.array(x.astype(np.int32)) for x in (p, e, salt)), pa.array(d), raw]
    return pa.RecordBatch.from_arrays(columns + ([] if moved is None else [pa.array(moved)]), NAMES[:6] if moved is None else NAMES)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    part = b.column(5)
    raw = np.frombuffer(b"".join(part.to_pylist()), "<i4").reshape(len(part), -1) if len(part) else np.zeros((0, 1), np.int32)
    return (*(b.column(i).to_numpy() for i in range(5)), raw.astype(np.int64))


def _sums(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """One row for each position and entry that has members here."""
    total = count = None
    for b in batches:
        _, p, e, _, _, part = _read(b)
        if total is None:
            total, count = np.zeros((PARTS * entries, part.shape[1]), np.int64), np.zeros(PARTS * entries, np.int64)
        of = p.astype(np.int64) * entries + e
        order = np.argsort(of, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(of[order]) > 0))
        total[of[order[edge]]] += np.add.reduceat(part[order], edge)
        count += np.bincount(of, minlength=len(count))
    if total is not None:
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)), pa.array(count[used]),
                                          pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["p", "e", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, p, e, salt, d, part = _read(b)
        e, d, new = e.copy(), d.copy(), e.copy()
        for position in np.unique(p):
            at = np.flatnonzero(p == position)
            new[at], d[at] = nearest(part[at], books.value[position])
        yield _members(row, p, new, salt, d, part, new != e)


class Members:
    """The members as tables in the shared folder: those that stayed, and those that came."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch(spark, name)

    def read(self) -> DataFrame:
        stayed = self.spark.read.schema(MEMBER).parquet(f"{self.path}/members/moved=false")
        return stayed.unionByName(self.spark.read.schema(MEMBER).parquet(f"{self.path}/came"))

    def moved(self) -> DataFrame:
        return self.spark.read.schema(MOVED).parquet(f"{self.path}/members").filter("moved").drop("moved")

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _owned(members: DataFrame, n: int) -> DataFrame:
    return members.repartition(n, "p", "e", "salt")


def new_entries(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries after one update; PARTS x ENTRIES rows of sums reach the driver."""
    size, entries = books.shape[2], books.shape[1]
    rows = members.mapInArrow(lambda it: _sums(it, entries), "p int, e int, n long, sums array<long>")
    total = rows.groupBy("p", "e").agg(F.sum(F.col("n").cast("decimal(20, 0)")).alias("n"), *(F.sum(F.col("sums")[j].cast("decimal(20, 0)")).alias(f"s{j}") for j in range(size)))
    books = books.copy()
    for r in total.collect():
        books[r.p, r.e] = [int(r[f"s{j}"]) // int(r.n) for j in range(size)]
    return books


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame | None, DataFrame, np.ndarray]:
    """(members after the last assignment, rows with their labels, entries) of `vectors` (vec_id, label, embedding)."""
    spark = prepare(vectors.sparkSession)
    n = shuffle_parts(spark)
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull()).filter(sound)
    path = scratch(spark, "vectors")
    kept.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)  # numbered once
    kept = spark.read.parquet(path)
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None, kept, np.zeros((PARTS, 0, 0), np.int64)
    width = max(1, -(-longest // PARTS)) * PARTS
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    books = _integers([r.v for r in first], width).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()

    known = spark.sparkContext.broadcast(books)
    state = Members(spark, "members")
    cut = kept.select("row", "v").mapInArrow(lambda it: _cut(it, width, known, n), MEMBER)
    _owned(cut, n).write.parquet(f"{state.path}/members/moved=false")
    cut.limit(0).write.parquet(f"{state.path}/came")
    for k in range(rounds):
        books = new_entries(state.read(), books)
        state = _moved_on(spark, state, books, f"members-{k}", n)
    return state.read(), kept, books


def _moved_on(spark: SparkSession, state: Members, books: np.ndarray, name: str, n: int) -> Members:
    """The members after one assignment to new entries."""
    known = spark.sparkContext.broadcast(books)
    after = Members(spark, name)
    state.read().mapInArrow(lambda it: _assigned(it, known), MOVED).write.partitionBy("moved").parquet(f"{after.path}/members")
    spark.createDataFrame([], MEMBER).write.mode("append").parquet(f"{after.path}/members/moved=false")  # there even if all moved
    _owned(after.moved(), n).write.parquet(f"{after.path}/came")
    state.delete()
    return after


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row, vec_id, label, code, error) of every sound vector, and the entries (position, entry, component)."""
    members, rows, books = train(vectors, rounds)
    if members is None:
        return rows.select("row", "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    pairs = F.array_sort(F.collect_list(F.struct("p", "e")))  # PARTS of them
    code = members.groupBy("row").agg(F.transform(pairs, lambda x: F.lower(F.lpad(F.hex(x.e), 2, "0"))).alias("c"), F.sum("d").alias("error"))
    return rows.select("row", "vec_id", "label").join(code.select("row", F.array_join("c", "").alias("code"), "error"), "row"), books


def digests(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every sound vector."""
    coded, books = encode(vectors, rounds)
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    found = coded.join(total, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
