"""Duplicates inside a run, set difference with the store, and the ingest decision.

What a row needs to know about the other rows of its link is a minimum over that link. Minima are
combined before the shuffle, so a link that holds a third of all items costs one row per task; the
join back is split by adaptive execution.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions import dates, text as T
from tidewatch.operators import filters
from tidewatch.operators.items import rss_content
from tidewatch.operators.skew import first_per_key


def dedup_in_run(items: DataFrame) -> DataFrame:
    """Add is_duplicate: not the first item of its link."""
    first = items.groupBy("link").agg(F.min("seq").alias("_first"))
    return (items.join(first, "link", "left")
            .withColumn("is_duplicate", F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))).drop("_first"))


def new_minus_store(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items whose link is not stored."""
    return items.join(store.select(F.col("url").alias("link")), "link", "left_anti")


def insert_new_only(items: DataFrame, store: DataFrame, as_of: datetime) -> DataFrame:
    """First item of every link that is not stored yet, as store rows."""
    fresh = new_minus_store(items.where(~T.is_blank(F.col("link"))), store)
    return as_store_rows(first_per_key(fresh, ["link"], [F.asc("seq")], ["seq"]), as_of)


def as_store_rows(items: DataFrame, as_of: datetime) -> DataFrame:
    """Items in the layout of freshly stored articles."""
    content = F.col("content") if "content" in items.columns else F.lit("")
    return items.select(
        F.xxhash64("link").alias("id"), F.col("link").alias("url"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("pub_date", F.lit("")).alias("pub_date"),
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
        F.coalesce("source_name", F.lit("")).alias("source_name"),
        rss_content(content, F.col("summary_raw"), F.col("source_type")).alias("content"),
        F.lit("").alias("remark"), F.lit(0).alias("is_hidden"), F.lit(1).alias("valid"),
        F.lit(0).alias("is_retained"), filters.ts(as_of).alias("created_at"))


def insert_counts(items: DataFrame, store: DataFrame) -> DataFrame:
    """Scanned items and new links: one pass, two-step distinct."""
    links = items.groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    known = store.select(F.col("url").alias("link"), F.lit(1).alias("known"))
    return links.join(known, "link", "left").agg(
        F.sum("n").alias("scanned"), F.count_if(F.col("known").isNull()).alias("inserted"))


def processed_lookup(items: DataFrame, store: DataFrame) -> DataFrame:
    """Add is_processed from the store."""
    flags = store.select(F.col("url").alias("link"), filters.is_processed().alias("_done"))
    return (items.join(flags, "link", "left")
            .withColumn("is_processed", F.coalesce("_done", F.lit(False))).drop("_done"))


def ingest_disposition(items: DataFrame, store: DataFrame, as_of: datetime) -> DataFrame:
    """Decide about every item: add remark, new_valid and new_hidden (NULL = leave the store alone).

    Also adds is_known (the link is stored) and is_first (first item of its link, empty or not).
    """
    if "filtered_reason" not in items.columns:
        items = items.withColumn("filtered_reason", F.lit(None).cast("string"))
    empty = T.is_blank(F.col("title")) | T.is_blank(F.col("link"))
    facts = (items.select("link", "seq", empty.alias("_empty")).groupBy("link").agg(
        F.min(F.when(~F.col("_empty"), F.col("seq"))).alias("_first_ok"),
        F.min(F.when(F.col("_empty"), F.col("seq"))).alias("_first_empty")))
    # a stored link has a flag, true or false; any other link has none
    flags = store.select(F.col("url").alias("link"), filters.is_processed().alias("_done"))
    facts = facts.join(flags, "link", "left")
    rows = items.join(facts, "link", "left").withColumn("pub_ts", dates.parse_pub_datetime(F.col("pub_date")))
    # an empty-title item has already invalidated its link for the items after it
    done = F.coalesce(F.col("_done"), F.lit(False)) | F.coalesce(F.col("_first_empty") < F.col("seq"), F.lit(False))
    may_lack_date = F.coalesce(F.col("source_type").isin(V.DATELESS_SOURCES), F.lit(False))
    step = (F.when(empty, F.lit("empty"))
            .when(F.col("seq") > F.col("_first_ok"), F.lit("duplicate"))
            .when(done, F.lit("processed"))
            .when(~T.is_blank(F.col("filtered_reason")), F.lit("filtered"))
            .when(F.col("pub_ts").isNull() & ~may_lack_date, F.lit("no_date"))
            .when(filters.is_stale(F.col("pub_ts"), as_of), F.lit("old"))
            .otherwise(F.lit("pending")))
    rows = rows.withColumn("disposition", step)
    what = F.col("disposition")
    return (rows.withColumn("remark", disposition_remark(what, F.col("filtered_reason")))
            .withColumn("new_valid", F.when(what.isin("empty", "filtered", "no_date", "old"), 0)
                        .when(what == "pending", 1))
            .withColumn("new_hidden", F.when(what == "filtered", 1))
            .withColumn("is_known", F.col("_done").isNotNull())
            .withColumn("is_first", F.col("seq") == F.least("_first_ok", "_first_empty"))
            .drop("_first_ok", "_first_empty", "_done"))


def disposition_remark(what: Column, reason: Column) -> Column:
    return (F.when(what == "empty", F.lit(V.R_EMPTY)).when(what == "duplicate", F.lit(V.R_DUPLICATE))
            .when(what == "processed", F.lit(V.R_PROCESSED))
            .when(what == "filtered", F.concat(F.lit(V.R_FILTERED), reason))
            .when(what == "no_date", F.lit(V.R_NO_DATE)).when(what == "old", F.lit(V.R_OLD))
            .otherwise(F.lit(V.R_PENDING)))


def audit_projection(decided: DataFrame) -> DataFrame:
    """One audit row per item."""
    return decided.select("seq", F.coalesce("source_name", F.lit("")).alias("site"),
                          F.coalesce("title", F.lit("")).alias("title"), F.coalesce("link", F.lit("")).alias("link"),
                          "pub_date", "source_type", F.lit(False).alias("keep"), "remark")



def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def dedup_market_titles(articles: DataFrame) -> DataFrame:
    """Within Market keep the first row of every title key; other rows pass untouched."""
    is_market = F.coalesce(F.col("category") == "Market", F.lit(False))
    key = T.title_key(T.first_filled(F.col("title_cn"), F.col("title"), F.col("summary_cn")))
    market = articles.where(is_market).withColumn(
        "_key", T.first_filled(key, F.col("url"), F.col("id").cast("string")))
    kept = first_per_key(market, ["_key"], newest_first(), ["id"]).drop("_key")
    return kept.unionByName(articles.where(~is_market))


def report_dedup(items: DataFrame) -> DataFrame:
    """First row per category and item key; rows without any key all stay."""
    id_key = F.when(F.col("id") != 0, F.col("id").cast("string"))
    keyed = items.withColumn("_key", F.coalesce(id_key, T.first_filled(F.col("url"), F.col("title_cn"), F.col("title"))))
    kept = first_per_key(keyed.where(F.col("_key").isNotNull()), ["category", "_key"], newest_first(), ["url"])
    return kept.unionByName(keyed.where(F.col("_key").isNull())).drop("_key")


def title_dedup_top(items: DataFrame, n: int = 5) -> DataFrame:
    """First row per shown title, then the first n."""
    shown = items.withColumn("shown_title", T.first_filled(F.col("title_cn"), F.col("title")))
    return first_per_key(shown, ["shown_title"], newest_first(), ["id"]).orderBy(*newest_first()).limit(n)
