"""Collected items: one contract for every source, unions, per-source counts."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import text as T
from tidewatch.functions.urls import normalize_url
from tidewatch.operators.filters import ts

ITEM_COLUMNS = ["title", "link", "pub_date", "summary_raw"]


def normalize_item(entries: DataFrame, source_type: Column, source_name: Column, fetched_at: datetime) -> DataFrame:
    """Project raw entries to the seven item columns; missing values become empty text."""
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in entries.columns else F.lit("").alias(c)
            for c in ITEM_COLUMNS]
    extra = [F.col(c) for c in ("seq",) if c in entries.columns]
    return entries.select(*extra, *cols, source_type.alias("source_type"), source_name.alias("source_name"),
                          ts(fetched_at).alias("fetched_at"))


def complete_item_fields(items: DataFrame) -> DataFrame:
    """Fill pub_date from date, source_name from source, and the type of items that only have a source."""
    for name in ("date", "source"):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast("string"))
    has_source = ~T.is_blank(F.col("source"))
    return (items.withColumn("pub_date", T.first_filled(F.col("pub_date"), F.col("date")))
            .withColumn("source_name", T.first_filled(F.col("source_name"), F.col("source")))
            .withColumn("source_type", F.when(T.is_blank(F.col("source_type")) & has_source, F.lit("wechat"))
                        .otherwise(F.col("source_type")))
            .drop("date", "source"))


def normalize_links(items: DataFrame) -> DataFrame:
    return items.withColumn("link", normalize_url(F.col("link")))


def rss_content(content: Column, summary_raw: Column, source_type: Column) -> Column:
    return F.when(T.is_blank(content) & (source_type == "rss"), F.coalesce(summary_raw, F.lit(""))).otherwise(
        F.coalesce(content, F.lit("")))


def union_sources(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def source_fetch_stats(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Status and number of items per configured source; ``error`` in sources marks a failed one."""
    counts = items.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    failed = ~T.is_blank(F.col("error"))
    return sources.join(counts, "name", "left").select(
        "name", F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("count"))


def source_fetch_totals(stats: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return stats.agg(F.sum("count").alias("total_fetched"), F.count_if(ok).alias("total_success"),
                     F.count_if(~ok).alias("total_failed"))
