"""Shift digests, headline lists, the written report and the audit table."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions import categories as C, dates, labels, text as T
from tidewatch.operators import filters
from tidewatch.operators.dedup import newest_first
from tidewatch.operators.skew import first_per_key
from tidewatch.operators.stats import digest_bucket, item_key
from tidewatch.vocab import AUDIT_HEADER, DIGEST_NAME, DIGEST_NONE, EVENING, MORNING  # noqa: F401


def report_range(kind: str, day: date) -> tuple[datetime, datetime]:
    """morning: 18:00 of the day before to 08:00; evening: 08:00 to 18:00."""
    if kind == "morning":
        return datetime.combine(day - timedelta(days=1), time(18)), datetime.combine(day, time(8))
    return datetime.combine(day, time(8)), datetime.combine(day, time(18))


def push_window(now: datetime) -> tuple[datetime, datetime, str]:
    """Window and label of the digest sent at ``now``."""
    kind = "morning" if now.hour <= 8 else "evening"
    start, end = report_range(kind, now.date())
    return start, end, f"{now.month}月{now.day}日{MORNING if kind == 'morning' else EVENING}"


def _at_hour(day: Column, hours: int) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hours))


def report_range_columns(kind: Column, day: Column) -> tuple[Column, Column]:
    morning = kind == "morning"
    return (F.when(morning, _at_hour(day, -6)).otherwise(_at_hour(day, 8)),
            F.when(morning, _at_hour(day, 8)).otherwise(_at_hour(day, 18)))


def push_window_columns(now: Column) -> tuple[Column, Column, Column]:
    day = F.to_date(now)
    kind = F.when(F.hour(now) <= 8, F.lit("morning")).otherwise(F.lit("evening"))
    start, end = report_range_columns(kind, day)
    label = F.concat(F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"),
                     F.when(kind == "morning", F.lit(MORNING)).otherwise(F.lit(EVENING)))
    return start, end, label


def shift_start(at: Column) -> Column:
    """Start of the half-open shift a time falls into: 18:00-08:00 or 08:00-18:00."""
    day, hour = F.to_date(at), F.hour(at)
    return F.when(hour < 8, _at_hour(day, -6)).when(hour < 18, _at_hour(day, 8)).otherwise(_at_hour(day, 18))


def window_articles(articles: DataFrame, start, end, is_retained: int | None = None) -> DataFrame:
    """Visible, valid articles collected in the window."""
    rows = articles.where(filters.created_between(start, end) & filters.visible_valid())
    return rows if is_retained is None else rows.where(F.col("is_retained") == is_retained)


def events_window(articles: DataFrame, as_of: datetime, start=None, end=None, is_retained: int | None = 1) -> DataFrame:
    if not (start and end):
        start, end = as_of - timedelta(days=1), as_of
    return report_order(window_articles(articles, start, end, is_retained))


def report_order(articles: DataFrame) -> DataFrame:
    return articles.orderBy(*newest_first())


def daily_digest(articles: DataFrame, now: datetime, name: str = DIGEST_NAME) -> DataFrame:
    """One row: label, number of articles, category line and message text."""
    start, end, label = push_window(now)
    rows = window_articles(articles, start, end, 1)
    bucket = digest_bucket(C.primary_category(filters.categories_array(F.col("category"))))
    per_key = rows.select(bucket.alias("category"), item_key().alias("key")).groupBy("category", "key").agg(
        F.count(F.lit(1)).alias("rows"))
    per_cat = per_key.groupBy("category").agg(F.sum("rows").alias("rows"), F.count("key").alias("n"))
    parts = [F.concat(F.lit(short), F.coalesce(F.max(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).cast("string"))
             for c, short in V.DIGEST_LABELS]
    out = per_cat.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), F.concat_ws(" | ", *parts).alias("category_line"))
    head = f"【{name} {label}】\n"
    full = F.concat(F.lit(head + "本次更新: "), F.col("total").cast("string"), F.lit(" 条\n\n"), F.col("category_line"))
    return out.select(F.lit(label).alias("label"), "total", "category_line",
                      F.when(F.col("total") == 0, F.lit(head + DIGEST_NONE)).otherwise(full).alias("message"))


def digest_cover(articles: DataFrame, now: datetime) -> DataFrame:
    """Screenshot file of the newest article in the window that has one."""
    start, end, _ = push_window(now)
    rows = window_articles(articles, start, end, 1).where(~T.is_blank(F.col("screenshot_path")))
    best = rows.agg(F.max_by("screenshot_path", F.struct("created_at", "id")).alias("path"))
    return best.select("path", F.substring_index("path", "/", -1).alias("file"))


def hot_titles(articles: DataFrame, n: int = 4, cut: int = 10) -> DataFrame:
    """The first n non-empty titles, cut; a last line of dots if there are more. One row per line."""
    rows = articles.withColumn("short", T.cut_title(T.first_filled(F.col("title_cn"), F.col("title")), cut))
    rows = rows.withColumn("_key", F.coalesce(F.col("id").cast("string"), F.col("url")))
    rows = first_per_key(rows, ["_key"], newest_first(), ["url"]).where(F.col("short") != "")
    few = rows.select("short", "created_at", "id").orderBy(*newest_first()).limit(n + 1)
    lines = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id", "short")))), lambda r: r["short"])
    shown = few.agg(lines.alias("l")).select(
        F.when(F.size("l") > n, F.concat(F.slice("l", 1, n), F.array(F.lit("...")))).otherwise(F.col("l")).alias("l"))
    return shown.select(F.posexplode("l").alias("pos", "title"))


def report_lines(articles: DataFrame) -> DataFrame:
    """Sections of the written report: heading, summary and picture note per article, in section order."""
    settled = F.coalesce(C.normalize_category(F.col("category")), F.lit(V.DEFAULT_CATEGORY))
    order = F.array(*[F.lit(c) for c, _ in V.REPORT_SECTIONS])
    rows = articles.withColumn("_cat", F.when(F.array_contains(order, settled), settled).otherwise(F.lit(V.DEFAULT_CATEGORY)))
    title = F.coalesce("title", F.lit(""))
    shown = T.first_filled(F.col("title_cn"), title)
    shown = F.coalesce(shown, F.lit(""))
    translated = ~T.is_blank(F.col("title_cn")) & (F.col("title_cn") != title)
    note = F.col("vl_desc") if "vl_desc" in articles.columns else F.lit("")
    summary = F.coalesce("summary_cn", F.lit(V.R_NO_SUMMARY))
    has_note = ~T.is_blank(note) & (note != V.NO_PICTURE) & ~F.contains(summary, F.lit(V.PICTURE_NOTE))
    return rows.select(
        F.array_position(order, F.col("_cat")).cast("int").alias("section_order"),
        F.concat(F.lit("## "), labels.lookup(F.col("_cat"), dict(V.REPORT_SECTIONS))).alias("section"), "id",
        F.concat(F.lit("### ["), F.when(translated, F.lit("[译] ")).otherwise(F.lit("")), shown, F.lit("]("),
                 F.coalesce("url", F.lit("")), F.lit(")")).alias("heading"),
        F.concat(F.lit("- **摘要**: "), summary).alias("summary_line"),
        F.when(has_note, F.concat(F.lit(f"- **👀 {V.PICTURE_NOTE}**: "), note)).alias("picture_line"),
        "created_at").orderBy("section_order", *newest_first())


def report_document(articles: DataFrame, as_of: datetime, name: str = DIGEST_NAME) -> DataFrame:
    """The written report, one row a line, in order. Of any size: nothing is gathered but the number of articles."""
    rows = report_lines(articles)
    parts = F.filter(F.array("heading", "summary_line", "picture_line", F.lit("")), lambda x: x.isNotNull())
    newest = [F.col("created_at"), F.col("id").cast("bigint").alias("id")]
    body = rows.select("section_order", F.lit(1).alias("_body"), *newest, F.posexplode(parts).alias("_at", "line"))
    none = [F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("bigint").alias("id"), F.lit(0).alias("_at")]
    heads = rows.select("section_order", F.lit(0).alias("_body"), *none, F.col("section").alias("line")).distinct()
    top = F.array(F.lit(f"# 🌏 {name} ({as_of:%Y-%m-%d %H:%M})"), F.lit(""), F.lit("## 📊 分析概况"),
                  F.lit(f"- **生成时间**: {as_of:%Y-%m-%d %H:%M:%S}"), F.concat(F.lit("- **总文章数**: "), F.col("n").cast("string"), F.lit(" 篇")), F.lit(""))
    intro = articles.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("section_order"), F.lit(0).alias("_body"), *none[:2], F.posexplode(top).alias("_at", "line"))
    return (intro.unionByName(heads).unionByName(body)
            .orderBy("section_order", "_body", F.desc("created_at"), F.desc("id"), "_at").select("line"))


def write_report(articles: DataFrame, as_of: datetime, path: str, name: str = DIGEST_NAME) -> None:
    """Write the report as text files whose names keep the order."""
    report_document(articles, as_of, name).write.mode("overwrite").text(path)


def audit_table(audit: DataFrame) -> DataFrame:
    """Audit rows in display form; seq is the row number."""
    def flag(name: str) -> Column:
        return T.yes_no(F.coalesce(F.col(name), F.lit(False))) if name in audit.columns else F.lit("否")

    name = T.first_filled(F.col("title_cn"), F.col("title")) if "title_cn" in audit.columns else F.col("title")
    return audit.select(
        "seq", T.sanitize_cell(F.col("site")).alias("site"), T.sanitize_cell(name).alias("name"),
        dates.format_date(F.col("pub_date")).alias("day"), flag("keep").alias("keep"), flag("text_ok").alias("text_ok"),
        flag("vl_ok").alias("vl_ok"), labels.source_label(F.col("source_type")).alias("source"),
        T.sanitize_remark(F.col("remark")).alias("remark"), T.sanitize_link(F.col("link")).alias("link"))


def audit_line(table: DataFrame) -> Column:
    """One pipe-table line per row of ``audit_table``."""
    cells = [F.col("seq").cast("string"), *[F.col(c) for c in
             ("site", "name", "day", "keep", "text_ok", "vl_ok", "source", "remark", "link")]]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
