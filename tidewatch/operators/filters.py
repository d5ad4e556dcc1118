"""Row filters, look-ups and paging over the article store."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions import dates, text as T
from tidewatch.functions.categories import all_of


def ts(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def visible_valid() -> Column:
    return (F.coalesce(F.col("is_hidden"), F.lit(0)) == 0) & (F.coalesce(F.col("valid"), F.lit(1)) == 1)


def created_between(start, end) -> Column:
    """Both ends included."""
    return F.col("created_at").between(ts(start), ts(end))


def is_stale(pub_ts: Column, as_of: datetime, days: int = V.FRESH_DAYS) -> Column:
    return pub_ts < ts(as_of - timedelta(days=days))


def freshness(items: DataFrame, as_of: datetime) -> DataFrame:
    """Add pub_ts and is_stale; an unknown date is not stale."""
    pub = dates.parse_pub_datetime(F.col("pub_date"))
    return items.withColumn("pub_ts", pub).withColumn(
        "is_stale", F.coalesce(is_stale(F.col("pub_ts"), as_of), F.lit(False)))


def like_pattern(keyword: str, strict: bool) -> str:
    if strict:
        keyword = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{keyword}%"


def keyword_search(keyword: str, strict: bool = False) -> Column:
    """Case-blind substring on the three text columns; % and _ act as wildcards unless strict."""
    pattern = F.lit(like_pattern(keyword, strict))
    hit = F.lit(False)
    for name in ("title", "title_cn", "summary_cn"):
        hit = hit | F.coalesce(F.ilike(F.col(name), pattern), F.lit(False))
    return hit


def article_filter(articles: DataFrame, *, valid: int | None = None, is_retained: int | None = None,
                   category: str | None = None, day: date | None = None, start: date | None = None,
                   end: date | None = None, keyword: str | None = None, source_type: str | None = None,
                   source_name: str | None = None) -> DataFrame:
    """Not hidden, and every given condition. Days are compared as half-open time ranges."""
    conditions = [F.coalesce(F.col("is_hidden"), F.lit(0)) == 0]
    for name, value in (("valid", valid), ("is_retained", is_retained)):
        if value is not None:
            conditions.append(F.col(name) == value)
    for name, value in (("category", category), ("source_type", source_type), ("source_name", source_name)):
        if value:
            conditions.append(F.col(name) == value)
    if day:
        start = end = day
    if start and end:
        conditions.append((F.col("created_at") >= ts(start)) & (F.col("created_at") < ts(end + timedelta(days=1))))
        if "created_date" in articles.columns:
            conditions.append(F.col("created_date").between(F.lit(start), F.lit(end)))
    if keyword:
        conditions.append(keyword_search(keyword))
    return articles.where(all_of(conditions))


def page_of(articles: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page, newest first. Only page * page_size rows leave each task."""
    return (articles.orderBy(F.desc("created_at"), F.desc("pub_date"), F.desc("id"))
            .offset(max(page - 1, 0) * page_size).limit(page_size))


def page_after(articles: DataFrame, last_created_at, last_pub_date: str | None, last_id: int | None,
               page_size: int = 50) -> DataFrame:
    """The page after a known last row; cheap however deep the page lies.

    Empty values come last, as on numbered pages, so all pages in turn give every row once.
    """
    last = {"created_at": ts(last_created_at) if last_created_at is not None else None,
            "pub_date": F.lit(last_pub_date), "id": F.lit(last_id).cast("bigint")}
    if last["created_at"] is None:
        last["created_at"] = F.lit(None).cast("timestamp_ntz")

    def place(values) -> Column:
        created, published, number = values
        return F.struct(created.isNotNull(), F.coalesce(created, F.lit("0001-01-01").cast("timestamp_ntz")), published.isNotNull(),
                        F.coalesce(published, F.lit("")), number.isNotNull(), F.coalesce(number, F.lit(0).cast("bigint")))

    rest = place([F.col("created_at"), F.col("pub_date"), F.col("id").cast("bigint")]) < place(last.values())
    if last_created_at is not None:  # reaches the scan
        rest = (F.col("created_at").isNull() | (F.col("created_at") <= ts(last_created_at))) & rest
    return page_of(articles.where(rest), 1, page_size)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def present_article(articles: DataFrame) -> DataFrame:
    """Serving form: dates without fractions, category also as an array."""
    return (articles.withColumn("created_at", dates.cut_fraction(F.col("created_at").cast("string")))
            .withColumn("pub_date", dates.cut_fraction(F.col("pub_date")))
            .withColumn("categories", categories_array(F.col("category"))))


def categories_array(category: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(T.is_blank(category), empty).otherwise(F.array(category))


def article_by_id(articles: DataFrame, article_id: int) -> DataFrame:
    return present_article(articles.where(F.col("id") == article_id))


def articles_in(articles: DataFrame, wanted: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is in a list given as a DataFrame."""
    return articles.join(wanted.select(key), key, "left_semi")


def _narrow(articles: DataFrame, created_after, ids: DataFrame | None) -> DataFrame:
    if created_after is not None:
        articles = articles.where(F.col("created_at") >= ts(created_after))
    if ids is not None:
        articles = articles.join(ids.select("id"), "id", "left_semi")
    return articles


def needs_enrichment(articles: DataFrame, as_of: datetime, created_after=None,
                     ids: DataFrame | None = None) -> DataFrame:
    """Valid, recent or undated, and without text or screenshot. Dates compare as text."""
    cutoff = (as_of - timedelta(days=V.FRESH_DAYS)).strftime("%Y-%m-%d")
    open_rows = articles.where(
        (F.col("valid") == 1) & ((F.col("pub_date") >= cutoff) | T.is_blank(F.col("pub_date")))
        & (T.is_blank(F.col("content")) | T.is_blank(F.col("screenshot_path"))))
    return _narrow(open_rows, created_after, ids)


def needs_analysis(articles: DataFrame, created_after=None, ids: DataFrame | None = None) -> DataFrame:
    open_rows = articles.where((F.col("valid") == 1) & (F.col("content") != "") & T.is_blank(F.col("summary_cn")))
    return _narrow(open_rows, created_after, ids)


def is_processed() -> Column:
    """A stored article that needs no further work."""
    no = F.lit(False)
    return (F.coalesce(F.col("valid") == 0, no) | F.coalesce(F.col("is_retained") == 1, no)
            | F.coalesce(F.length("summary_cn") > 5, no))


def recent_retained(articles: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    return articles.where((F.col("is_retained") == 1) & (F.col("created_at") >= ts(as_of - timedelta(hours=hours)))
                          ).orderBy(F.desc("pub_date"), F.desc("id"))


def publish_window_filter(articles: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Collected inside the window, or else published inside it (bare dates compare by day)."""
    pub, date_only = dates.parse_event_datetime(F.col("pub_date"))
    pub_in = F.when(date_only, pub.cast("date").between(F.lit(start.date()), F.lit(end.date()))).otherwise(
        pub.between(ts(start), ts(end)))
    keep = F.coalesce(created_between(start, end), F.lit(False)) | F.coalesce(pub_in, F.lit(False))
    return articles.where(keep)


def stale_on_insert(pub_date: Column, as_of: datetime, days: int = V.STALE_DAYS) -> Column:
    """Published more than ``days`` calendar days ago."""
    pub, _ = dates.parse_event_datetime(pub_date)
    return F.coalesce(F.date_diff(F.lit(as_of.date()), pub.cast("date")) > days, F.lit(False))


def with_stale_flags(articles: DataFrame, as_of: datetime) -> DataFrame:
    stale = stale_on_insert(F.col("pub_date"), as_of)
    return (articles.withColumn("_stale", stale)
            .withColumn("is_hidden", F.when(F.col("_stale"), 1).otherwise(0))
            .withColumn("valid", F.when(F.col("_stale"), 0).otherwise(F.coalesce("valid", F.lit(1))))
            .withColumn("remark", F.when(F.col("_stale"), F.lit(V.R_STALE)).otherwise(F.lit("")))
            .drop("_stale"))


def post_enrich_validity(items: DataFrame, as_of: datetime) -> DataFrame:
    """After a page was read: still no date or too old makes the article invalid."""
    pub = dates.parse_pub_datetime(F.col("pub_date"))
    return (items.withColumn("_pub", pub)
            .withColumn("remark", F.when(F.col("_pub").isNull(),
                                         F.concat(F.coalesce("remark", F.lit("")), F.lit(V.R_ENRICH_NO_DATE)))
                        .when(is_stale(F.col("_pub"), as_of), F.lit(V.R_ENRICH_OLD)).otherwise(F.col("remark")))
            .withColumn("valid", F.when(F.col("_pub").isNull() | is_stale(F.col("_pub"), as_of), 0)
                        .otherwise(F.col("valid")))
            .drop("_pub"))
