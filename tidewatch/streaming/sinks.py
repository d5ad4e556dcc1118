"""Sinks that survive a repeated micro-batch, and stay few: runs of batches.

A batch owns the folder `run_A_A` and overwrites it; a fold of batches A to B is the folder `run_A_B`.
A run counts once Spark has committed it (its `_SUCCESS` marker), and a reader takes the widest runs
that cover all batches. So a fold that is cut off, or done again, or whose parts have not been
deleted yet, changes nothing. Every `fold_every` runs of one width become one run of the next, so a row is
rewritten a logarithmic number of times and the folders stay few.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources import folders

FOLD_EVERY = 10
_RUN = re.compile(r"run_(-?\d+)_(-?\d+)")


def run_path(path: str, first: int, last: int) -> str:
    return f"{path}/run_{first}_{last}"


def all_runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) of every committed run, also of those that a wider one covers."""
    found = [(int(m[1]), int(m[2])) for m in map(_RUN.fullmatch, folders.children(spark, path)) if m]
    return sorted((r for r in found if folders.complete(spark, run_path(path, *r))), key=lambda r: (r[0], -r[1]))


def runs(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[int, int]]:
    """The widest committed runs of batches, in order; of the batches ``before`` one, if given."""
    out: list[tuple[int, int]] = []
    for first, last in all_runs(spark, path):
        if (before is None or last < before) and (not out or first > out[-1][1]):
            out.append((first, last))
    return out


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All rows so far."""
    return spark.read.parquet(*[run_path(path, *r) for r in runs(spark, path, before)])


def next_fold(found: list[tuple[int, int]], every: int) -> tuple[int, int, int] | None:
    """(from, to, how many) of the oldest neighbouring runs of one width class that are due."""
    if every < 2:
        raise ValueError("a fold takes at least two runs")

    def width(run: tuple[int, int]) -> int:
        n, k = run[1] - run[0] + 1, 0
        while n >= every:
            n, k = n // every, k + 1
        return k

    at = 0
    while at < len(found):
        end = at
        while end < len(found) and width(found[end]) == width(found[at]):
            end += 1
        if end - at >= every:
            return found[at][0], found[at + every - 1][1], every
        at = end
    return None


def fold(spark: SparkSession, path: str, every: int = FOLD_EVERY, combine: Callable[[DataFrame], DataFrame] | None = None,
         before: int | None = None, write: Callable[[DataFrame, str], None] | None = None) -> int:
    """Fold runs that are due, then delete what wider runs cover. Harmless if repeated or cut off; returns the number of folds."""
    done = 0
    while (due := next_fold(runs(spark, path, before), every)) is not None:
        parts = [r for r in runs(spark, path, before) if due[0] <= r[0] and r[1] <= due[1]]
        rows = spark.read.parquet(*[run_path(path, *r) for r in parts])
        rows, to = combine(rows) if combine else rows, run_path(path, due[0], due[1])
        if write:
            write(rows, to)
        else:
            rows.write.mode("overwrite").parquet(to)
        done += 1
    sweep(spark, path)
    return done


def sweep(spark: SparkSession, path: str) -> None:
    """Delete runs that a wider committed run covers."""
    keep = runs(spark, path)
    for first, last in all_runs(spark, path):
        if (first, last) not in keep and any(a <= first and last <= b for a, b in keep):
            folders.delete(spark, run_path(path, first, last))


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  each: Callable[..., DataFrame] | None = None, available_now: bool = True, with_id: bool = False,
                  fold_every: int = FOLD_EVERY, combine: Callable[[DataFrame], DataFrame] | None = None,
                  after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start a query that writes every micro-batch, after ``each`` (also given the batch id if asked), to its own run under ``path``.

    Earlier runs are folded with ``combine`` (rows to rows; as they are by default). ``after`` is called when a batch is written.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id % fold_every == 0:
            fold(spark, path, fold_every, combine, before=batch_id)
        rows = (each(batch, batch_id) if with_id else each(batch)) if each else batch
        rows.write.mode("overwrite").parquet(run_path(path, batch_id, batch_id))
        if after:
            after(batch_id)

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_per_key(batches: DataFrame, keys: list[str], order: str = "batch_id") -> DataFrame:
    """The row with the newest ``order`` for every key."""
    rest = [c for c in batches.columns if c not in (*keys, order)]
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s"))
    return newest.select(*keys, "s.*")
