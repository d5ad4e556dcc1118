"""Building blocks that stay exact, parallel and cheap on very uneven or very large input."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tidewatch.functions.geo import seconds_between
from tidewatch.session import stored

EPOCH = "1970-01-01 00:00:00"


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str],
                  salts: int | None = None) -> DataFrame:
    """The first ``n`` rows of every key.

    Spark drops rows beyond ``n`` per key before the shuffle, so for a small ``n`` a hot key sends
    only ``n`` rows per map task. For a large ``n`` the key is first split by a hash of ``spread``
    (columns that differ between the rows of a key), ranked within each split, and only the
    survivors, at most ``salts * n`` per key, are ranked together. The result is the same.
    """
    if salts is None:
        salts = 1 if n <= 100 else 32
    if salts > 1:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        within = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= n).drop("_rank", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= n).drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], spread: list[str]) -> DataFrame:
    return top_n_per_key(df, keys, order, 1, spread)


def with_previous(df: DataFrame, key: str, ts: str, tie: str, carried: list[str],
                  bucket_seconds: int = 3600, counts: Column | None = None) -> DataFrame:
    """Add ``prev`` = STRUCT<ts, carried...> of the preceding row of the key, by (ts, tie), and ``_bucket``.

    A key is never one window: rows are ranked inside (key, time bucket), and the last row of a
    bucket is carried into the next bucket in use. Only those carried rows see the whole key.
    With ``counts`` only rows for which it holds can be a preceding row.
    """
    bucket = F.floor(seconds_between(F.lit(EPOCH).cast("timestamp_ntz"), F.col(ts)) / bucket_seconds)
    rows = df.withColumn("_bucket", bucket)
    point = F.struct(ts, tie, *carried)
    last = F.struct(ts, tie)
    tails = rows.groupBy(key, "_bucket").agg(F.max_by(point, last if counts is None else F.when(counts, last)).alias("_tail"))
    by_key = Window.partitionBy(key).orderBy("_bucket")
    if counts is None:
        before = F.lag("_tail").over(by_key)
    else:  # a bucket may hold no row that counts
        before = F.last("_tail", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    carry = tails.withColumn("_tail", before).where(F.col("_tail").isNotNull())
    carry = carry.select(key, "_bucket", "_tail.*", F.lit(True).alias("_carried"))
    both = rows.withColumn("_carried", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    in_bucket = Window.partitionBy(key, "_bucket").orderBy(ts, tie)
    row = F.struct(ts, *carried)
    if counts is None:
        prev = F.lag(row).over(in_bucket)
    else:
        prev = F.last(F.when(counts, row), ignorenulls=True).over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("prev", prev).where(~F.col("_carried")).drop("_carried")


def dealt_by_range(df: DataFrame, order: list[str], tasks: int | None = None) -> DataFrame:
    """Rows in ranges of ``order``, sorted inside each; a hot key spreads over as many tasks as its rows need."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def _within_task(batches: Iterator[pa.RecordBatch], key: str, point: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds ``prev``, and marks the task's first row (``_open``) and its last one (``_tail``)."""
    last = held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield _marked(*held, False)
        rows = pa.Table.from_batches([b]).select(list(dict.fromkeys([key, *point])))
        before = pa.concat_tables([rows.slice(0, 1) if last is None else last, rows.slice(0, b.num_rows - 1)]).combine_chunks()
        was, now = before[key].combine_chunks(), rows[key].combine_chunks()
        other = pc.invert(pc.or_(pc.fill_null(pc.equal(was, now), False), pc.and_(pc.is_null(was), pc.is_null(now))))
        if last is None:
            other = pa.concat_arrays([pa.array([True]), other.slice(1)])
        prev = pa.StructArray.from_arrays([before[c].combine_chunks() for c in point], point, mask=other)
        held, last = (b, prev, last is None), rows.slice(b.num_rows - 1)
    if held is not None:
        yield _marked(*held, True)


def _marked(b: pa.RecordBatch, prev: pa.Array, first: bool, final: bool) -> pa.RecordBatch:
    rest = [False] * (b.num_rows - 1)
    return pa.RecordBatch.from_arrays([*b.columns, prev, pa.array([first, *rest]), pa.array([*rest, final])],
                                      [*b.schema.names, "prev", "_open", "_tail"])


def ranged_previous(df: DataFrame, key: str, ts: str, tie: str, carried: list[str], tasks: int | None = None) -> DataFrame:
    """``prev`` as in ``with_previous``, for keys with very many rows inside one time bucket.

    Rows are dealt by range of (key, ts, tie), whatever stretch of time is hot. Each task streams its rows
    once; only its first row may have its predecessor elsewhere, and that is the last row of the task
    before. The dealt rows are written once, so that both ends of a task come from the same ranges, and
    at most two rows a task meet by key. Empty times come first, empty keys are one key.
    """
    point = [ts, *carried]
    prev = StructField("prev", StructType([StructField(c, df.schema[c].dataType) for c in point]))
    marks = [StructField("_task", IntegerType()), prev, StructField("_open", BooleanType()), StructField("_tail", BooleanType())]
    fields = [StructField(f.name, f.dataType) for f in df.schema.fields]
    rows = dealt_by_range(df, [key, ts, tie], tasks).withColumn("_task", F.spark_partition_id())
    rows = stored(rows.mapInArrow(lambda it: _within_task(it, key, point), StructType(fields + marks)), "ranged")
    ends = rows.where(F.col("_open") | F.col("_tail"))
    before = Window.partitionBy(key).orderBy("_task", F.desc("_open")).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(F.when(F.col("_tail"), F.struct(*point)), ignorenulls=True).over(before)
    first = ends.withColumn("prev", carry).where("_open")
    return rows.where(~F.col("_open")).unionByName(first).drop("_task", "_open", "_tail")


def unnest(df: DataFrame, keep: list, array: Column, pos: str, value: str) -> DataFrame:
    """One row per array element, with its position.

    A plain explode makes Spark test the array for emptiness in a filter of its own further down,
    which computes it a second time; the outer form does not, and the empty rows are dropped here.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())
