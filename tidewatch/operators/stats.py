"""Counts, trends and top lists. All are partial aggregates first; nothing wide is shuffled."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions import dates, labels, text as T
from tidewatch.operators.filters import ts, visible_valid


def daily_counts(articles: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Visible, valid articles per day of collection."""
    return (articles.where((F.col("created_at") >= ts(as_of - timedelta(days=days))) & visible_valid())
            .groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("articles")).orderBy("day"))


def total_count(articles: DataFrame) -> DataFrame:
    return articles.where(visible_valid()).agg(F.count(F.lit(1)).alias("total"))


def known_category() -> Column:
    c = F.col("category")
    return F.when(T.is_blank(c) | (c == "None"), F.lit("Unknown")).otherwise(c)


def category_counts(articles: DataFrame) -> DataFrame:
    return (articles.groupBy(known_category().alias("category")).agg(F.count(F.lit(1)).alias("articles"))
            .withColumn("label", labels.category_chart_label(F.col("category"))))


def trend_day() -> Column:
    """Publication day, else collection day; unreadable text gives no day."""
    text = T.first_filled(F.col("pub_date"), F.col("created_at").cast("string"))
    return dates.date_of_text(F.replace(text, F.lit("T"), F.lit(" ")))


def _counted(rows: DataFrame) -> DataFrame:
    """Counts per (category, day) and per source, in one pass: (category, day, source, by_source, n)."""
    keys = {"category": known_category(), "day": trend_day(), "source": source_label()}
    named = rows.select(*(c.alias(k) for k, c in keys.items()))
    return (named.groupingSets([["category", "day"], ["source"]], "category", "day", "source")
            .agg(F.grouping("category").cast("bigint").alias("by_source"), F.count(F.lit(1)).alias("n")))


def _kept(cells: DataFrame, by_source: int) -> DataFrame:
    """The counts of one kind.

    The factor n keeps this filter above the aggregate, so that all uses share one scan and one shuffle.
    """
    return cells.where(F.col("n") * (F.col("by_source") == by_source).cast("bigint") > 0)


def _dense(cells: DataFrame) -> DataFrame:
    """Counts per category and day with zeros for the days that only other categories have.

    A category is one row with its counts by day, and the days in use come as one array: both are bounded
    by the calendar, however many categories there are. The cells never meet in one row or task.
    """
    # days come from the counted cells, n included, so that the shuffle below is the one of the cells
    days = cells.where(F.col("n") > 0).agg(F.collect_set("day").alias("days"))
    known = cells.groupBy("category").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("day").isNotNull(), F.struct("day", "n")))).alias("known"))
    rows = known.select("category", "known", F.explode(days.scalar()).alias("day"))
    return rows.select("category", "day", F.coalesce(F.try_element_at("known", "day"), F.lit(0)).cast("bigint").alias("articles"),
                       labels.category_chart_label(F.col("category")).alias("label"))


def category_trend(articles: DataFrame) -> DataFrame:
    """Articles per category and day, zero where a category has none on a day in use."""
    return _dense(articles.select(known_category().alias("category"), trend_day().alias("day"))
                  .groupBy("category", "day").agg(F.count(F.lit(1)).alias("n")))


def all_dates(articles: DataFrame) -> DataFrame:
    return articles.select(trend_day().alias("day")).where(F.col("day").isNotNull()).distinct()


def source_label() -> Column:
    """Name of the source; a missing one falls back to the source type."""
    name = F.col("source_name")
    return F.when(T.is_blank(name) | (name == "None"), F.col("source_type")).otherwise(name)


def source_top(articles: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent sources."""
    return (articles.groupBy(source_label().alias("source")).agg(F.count(F.lit(1)).alias("articles"))
            .orderBy(F.desc("articles"), "source").limit(n))


def statistics_range(articles: DataFrame, as_of: datetime, start: date | None = None, end: date | None = None,
                     visible_only: bool = False) -> DataFrame:
    """Rows of whole days, by default the last 30; hidden and invalid rows count unless asked otherwise."""
    start = start or (as_of - timedelta(days=30)).date()
    end = end or as_of.date()
    rows = articles.where(F.col("created_at").between(ts(f"{start} 00:00:00"), ts(f"{end} 23:59:59")))
    return rows.where(visible_valid()) if visible_only else rows


def statistics_bundle(articles: DataFrame, as_of: datetime, **kw) -> dict[str, DataFrame]:
    """The three parts of the statistics report, all from one table of counts."""
    cells = _counted(statistics_range(articles, as_of, **kw))
    by_day = _kept(cells, 0)
    pie = (by_day.groupBy("category").agg(F.sum("n").alias("articles"))
           .withColumn("label", labels.category_chart_label(F.col("category"))))
    bar = (_kept(cells, 1).select("source", F.col("n").alias("articles"))
           .orderBy(F.desc("articles"), "source").limit(20))
    return {"category_stats": pie, "trend_stats": _dense(by_day), "source_stats": bar}


def statistics_long(articles: DataFrame, as_of: datetime, **kw) -> DataFrame:
    """The same bundle as one long table (part, key, day, n)."""
    parts = statistics_bundle(articles, as_of, **kw)
    no_day = F.lit(None).cast("date")
    pie = parts["category_stats"].select(F.lit("category").alias("part"), F.col("label").alias("key"),
                                         no_day.alias("day"), F.col("articles").alias("n"))
    trend = parts["trend_stats"].select(F.lit("trend").alias("part"), F.col("label").alias("key"), "day",
                                        F.col("articles").alias("n"))
    bar = parts["source_stats"].select(F.lit("source").alias("part"), F.col("source").alias("key"),
                                       no_day.alias("day"), F.col("articles").alias("n"))
    return pie.unionByName(trend).unionByName(bar)


def digest_bucket(category: Column) -> Column:
    known = [c for c, _ in V.DIGEST_LABELS]
    return F.when(category.isin(known), category).otherwise(F.lit(V.DEFAULT_CATEGORY))


def item_key() -> Column:
    return F.coalesce(F.col("id").cast("string"), T.first_filled(F.col("url"), F.col("title")))


def digest_category_counts(articles: DataFrame) -> DataFrame:
    """Distinct articles per digest category; categories without any are listed with 0."""
    spark = articles.sparkSession
    listed = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(V.DIGEST_LABELS)], "category string, place int")
    counts = (articles.select(digest_bucket(F.col("category")).alias("category"), item_key().alias("key"))
              .where(F.col("key").isNotNull()).distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n")))
    return listed.join(counts, "category", "left").select(
        "category", "place", F.coalesce("n", F.lit(0)).cast("bigint").alias("articles"))


def run_summary(decided: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of run counters, from the decided items of a run (as `jobs.ingest` stores them) and per-result flags.

    Items and results are counted by one aggregate over both; no link is grouped or looked up again.
    """
    what = F.col("remark")
    items = decided.select(F.lit(True).alias("_item"), "remark", (F.col("is_first") & ~F.col("is_known")).alias("_new"),
                           F.when(F.col("link").isNull(), 1).alias("_unlinked"))
    results = outcomes.select(F.lit(False).alias("_item"), "kept", "text_ok", "vl_ok")
    rows = items.unionByName(results, allowMissingColumns=True).agg(
        F.count_if("_item").alias("scanned"), (F.count_if("_new") + F.coalesce(F.max("_unlinked"), F.lit(0))).alias("inserted"),
        F.count_if(what == V.R_EMPTY).alias("skipped"), F.count_if(what == V.R_DUPLICATE).alias("duplicates"),
        F.count_if(what == V.R_PROCESSED).alias("processed"), F.count_if(what.isin(V.R_NO_DATE, V.R_OLD)).alias("outdated"),
        F.count_if(~F.col("_item")).alias("analysed"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("junk"),
        F.count_if("text_ok").alias("text_success"), F.count_if("vl_ok").alias("image_success"),
        F.count_if(~F.col("vl_ok")).alias("image_failed"))

    def rate(part: str, total: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(part) * 100.0, total), F.lit(0.0))

    return (rows.withColumn("text_rate", F.round(rate("text_success", F.col("analysed")), 6))
            .withColumn("image_rate", F.round(rate("image_success", F.col("image_success") + F.col("image_failed")), 6)))


OTHER_SOURCE = "其他来源"


def group_by_source(articles: DataFrame) -> DataFrame:
    """Articles with the size of their source group, larger groups first.

    Sizes come from an aggregate joined back, so a source with most of the rows is never one task.
    """
    rows = articles.withColumn("source_group", T.first_filled(F.col("source_name"), F.lit(OTHER_SOURCE)))
    sizes = rows.groupBy("source_group").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, "source_group").orderBy(F.desc("group_size"), "source_group", F.desc("created_at"),
                                                    F.desc("id"))


def group_by_category(articles: DataFrame) -> DataFrame:
    """Articles of the listed categories in section order."""
    order = F.array(*[F.lit(c) for c, _ in V.REPORT_SECTIONS])
    rows = articles.withColumn("section_order", F.array_position(order, F.col("category")).cast("int"))
    return rows.where(F.col("section_order") > 0).orderBy("section_order", F.desc("created_at"), F.desc("id"))


def run_history(audit: DataFrame) -> DataFrame:
    """Runs newest first with the number of rows and of kept rows."""
    runs = audit.groupBy("run_id").agg(F.count(F.lit(1)).alias("searched"), F.count_if("keep").alias("kept"))
    at = F.regexp_replace("run_id", r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2}).*$", "$1-$2-$3 $4:$5:$6")
    return (runs.withColumn("run_at", at.try_cast("timestamp_ntz")).where(F.col("run_at").isNotNull())
            .withColumn("summary", F.concat(F.lit("(搜"), F.col("searched").cast("string"), F.lit("条，入"),
                                            F.col("kept").cast("string"), F.lit("条)")))
            .orderBy(F.desc("run_id")))
