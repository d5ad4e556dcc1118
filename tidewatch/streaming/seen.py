"""An index of links seen so far, of which a batch reads what concerns it only.

Every batch adds a run of its new links, in buckets by hash: the hash of each link and the link itself,
as columns of one file per bucket. The hash column alone is the bucket's filter: a batch reads the
hashes of the buckets it touches, and the links of those buckets where a hash is met. The number of
buckets follows the size of a run and stands in its name, so a bucket never holds much more than
PER_BUCKET links, and what a batch reads follows its own links, however long the history is. Runs are folded
like all batch folders; a fold has more buckets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.sources import folders
from tidewatch.streaming import sinks

PER_BUCKET, MOST_BUCKETS = 4096, 1 << 16
STORE_RUN = -1  # the links of the store, before the first batch


def _hash() -> Column:
    return F.xxhash64("link")


def buckets_for(links: int, per_bucket: int = PER_BUCKET) -> int:
    """A power of two, so that buckets of narrow runs are split, not mixed, in wide ones."""
    return min(MOST_BUCKETS, 1 << max(0, -(-links // per_bucket) - 1).bit_length())


class SeenLinks:
    def __init__(self, spark: SparkSession, path: str, per_bucket: int = PER_BUCKET, fold_every: int = sinks.FOLD_EVERY):
        self.spark, self.path, self.per_bucket, self.fold_every = spark, path, per_bucket, fold_every

    def _layout(self, run: tuple[int, int]) -> tuple[str, int]:
        """Folder and number of buckets of a run."""
        base = sinks.run_path(self.path, *run)
        name = next(x for x in folders.children(self.spark, base) if re.fullmatch(r"of_\d+", x))
        return f"{base}/{name}", int(name[3:])

    def _write(self, links: DataFrame, to: str) -> None:
        """Links once each; the marker of the run is written last."""
        folders.delete(self.spark, to)
        n = buckets_for(links.count(), self.per_bucket)
        rows = links.select("link", _hash().alias("h")).withColumn("bucket", F.pmod("h", F.lit(n)).cast("int"))
        rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "h")  # a file for each
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/of_{n}")
        self.spark.range(0).coalesce(1).write.mode("append").parquet(to)  # commits the run

    def add(self, links: DataFrame, batch_id: int) -> None:
        """The new links of a batch; a repeated batch replaces its own run."""
        self._write(links, sinks.run_path(self.path, batch_id, batch_id))

    def seed(self, store: DataFrame) -> None:
        """The links of the store, written once."""
        if not any(first == STORE_RUN for first, _ in sinks.runs(self.spark, self.path)):
            self._write(store.select(F.col("url").alias("link")).where("link is not null").distinct(), sinks.run_path(self.path, STORE_RUN, STORE_RUN))

    def fold(self, before: int) -> None:
        """Fold batches; the run of the store stays as it is."""
        while (due := sinks.next_fold([r for r in sinks.runs(self.spark, self.path, before) if r[0] > STORE_RUN], self.fold_every)) is not None:
            parts = [r for r in sinks.runs(self.spark, self.path, before) if due[0] <= r[0] and r[1] <= due[1]]
            links = None
            for r in parts:
                rows = self.spark.read.parquet(self._layout(r)[0]).select("link")
                links = rows if links is None else links.unionByName(rows)
            self._write(links, sinks.run_path(self.path, due[0], due[1]))
        sinks.sweep(self.spark, self.path)

    def _touched(self, links: DataFrame, n: int) -> list[int]:
        """Buckets that hold some of the links; at most ``n`` numbers."""
        return [r[0] for r in links.select(F.pmod(_hash(), F.lit(n)).cast("int").alias("b")).distinct().collect()]

    def _known(self, links: DataFrame, run: tuple[int, int]) -> DataFrame | None:
        """Those of the links that the run holds."""
        folder, n = self._layout(run)
        part = self.spark.read.schema("link string, h long, bucket int").parquet(folder)
        wanted = part.where(F.col("bucket").isin(self._touched(links, n)))
        met = links.join(wanted.select("h").distinct(), _hash() == F.col("h"), "left_semi")  # hashes only
        hits = self._touched(met, n)
        if not hits:
            return None
        return met.join(part.where(F.col("bucket").isin(hits)).select("link"), "link", "left_semi")

    def unseen(self, links: DataFrame, before: int) -> DataFrame:
        """Those of the links (column `link`, once each) that no batch ``before`` and no stored article holds."""
        known = None
        for run in sinks.runs(self.spark, self.path, before):
            found = self._known(links, run)
            if found is not None:
                known = found if known is None else known.unionByName(found)
        return links if known is None else links.join(known, "link", "left_anti")

    def files(self, links: DataFrame, before: int) -> list[str]:
        """The files that `unseen` looks into for the hashes of its buckets."""
        out: list[str] = []
        for run in sinks.runs(self.spark, self.path, before):
            folder, n = self._layout(run)
            part = self.spark.read.schema("link string, h long, bucket int").parquet(folder).where(F.col("bucket").isin(self._touched(links, n)))
            out += [r[0] for r in part.select(F.input_file_name()).distinct().collect()]
        return out
