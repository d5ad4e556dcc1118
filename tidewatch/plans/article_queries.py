"""Registered queries over stored articles: scalars, filters, counts, reports."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions import categories as C, dates, labels, text as T
from tidewatch.functions.urls import normalize_url as normalize
from tidewatch.operators import analysis as A, dedup as D, filters, items as I, reports as R, stats
from tidewatch.plans.registry import query
from tidewatch.plans.views import AS_OF, Views

LATER = AS_OF + timedelta(days=25)
START, END = datetime(2024, 1, 20, 8), datetime(2024, 1, 25, 18)


def variants(i: Column, *options) -> Column:
    """Pick the option number id % n."""
    chain = None
    for k, option in enumerate(options):
        value = option if isinstance(option, Column) else F.lit(option).cast("string")
        chain = F.when(i % len(options) == k, value) if chain is None else chain.when(i % len(options) == k, value)
    return chain


def day_text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


# --- scans and look-ups ---


@query
def scan_articles(v):
    return v.articles.select("id", "url", "title", "title_cn", "pub_date", "source_type", "source_name", "category",
                             "is_hidden", "valid", "is_retained", "created_at")


@query
def article_by_id(v):
    return filters.article_by_id(v.articles, 42).select(
        "id", "title", "url", "pub_date", "created_at", "category", F.array_join("categories", ",").alias("categories"))


@query
def articles_by_urls(v):
    wanted = v.raw_items.where(F.col("source_type") == "rss").select(normalize(F.col("link")).alias("url"))
    return filters.articles_in(v.articles, wanted).select("id", "url", "title")


@query
def in_list(v):
    flagged = v.table("labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    return filters.articles_in(v.articles, flagged, "id").select("id", "url")


# --- scalars ---


@query
def normalize_url(v):
    links = v.raw_items.select(F.col("seq").alias("key"), F.lit("item").alias("kind"), "link").unionByName(
        v.pages.select(F.col("page_id").alias("key"), F.lit("page").alias("kind"), F.col("url").alias("link")))
    return links.select("key", "kind", normalize(F.col("link")).alias("url"))


@query
def normalize_item(v):
    entries = v.raw_items.select("seq", F.when(F.col("seq") % 3 != 0, F.col("title")).alias("title"), "link", "pub_date")
    return I.normalize_item(entries, F.lit("rss"), F.lit("feed"), AS_OF)


@query
def complete_item_fields(v):
    s = F.col("seq")
    gaps = v.raw_items.select(
        "seq", F.when(s % 2 == 0, F.col("pub_date")).alias("pub_date"), F.when(s % 4 == 1, F.lit("2024-01-15")).alias("date"),
        F.when(s % 3 == 0, F.col("source_name")).alias("source_name"), F.when(s % 3 != 2, F.lit("acc")).alias("source"),
        F.when(s % 5 == 0, F.col("source_type")).alias("source_type"))
    return I.complete_item_fields(gaps)


@query
def rss_content_fallback(v):
    content = F.when(F.col("seq") % 2 == 0, F.col("title"))
    return v.raw_items.select("seq", I.rss_content(content, F.col("summary_raw"), F.col("source_type")).alias("content"))


def date_texts(v: Views) -> DataFrame:
    """Publication times in every accepted form, and some that are not."""
    t = F.col("created_at")
    rfc = F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss")
    text = variants(
        F.col("id"), F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.'123'"),
        F.date_format(t, "yyyy-MM-dd HH:mm"), F.concat(rfc, F.lit(" +0000")), F.date_format(t, "yyyy年M月d日"), "n/a", "",
        None, F.concat(rfc, F.lit(" +0800")), F.concat(F.lit("published "), F.date_format(t, "yyyy/MM/dd")))
    return v.articles.select("id", text.alias("text"))


@query
def parse_pub_datetime(v):
    return date_texts(v).select("id", dates.parse_pub_datetime(F.col("text")).alias("parsed"))


@query
def parse_event_datetime(v):
    ts, date_only = dates.parse_event_datetime(F.col("text"))
    return date_texts(v).select("id", ts.alias("parsed"), date_only.alias("is_date_only"))


@query
def extract_ymd(v):
    return date_texts(v).select("id", dates.extract_ymd(F.col("text")).alias("ymd"))


@query
def feed_entry_date(v):
    published = F.when(F.col("id") % 3 != 0, F.col("text"))
    at = dates.feed_entry_date(published, F.lit("2024-02-01"))
    return date_texts(v).select("id", at.alias("entry_at"))


@query
def format_date(v):
    return date_texts(v).select("id", dates.format_date(F.col("text")).alias("day"))


@query
def date_of_text(v):
    return date_texts(v).select("id", dates.date_of_text(F.col("text")).cast("string").alias("day"))


@query
def trim_dates(v):
    return date_texts(v).select("id", dates.cut_fraction(F.col("text")).alias("text"))


@query
def categories_array(v):
    cats = filters.categories_array(F.col("category"))
    return v.articles.select("id", F.size(cats).alias("n"), F.array_join(cats, ",").alias("categories"))


@query
def clean_article_text(v):
    menu = F.concat(F.lit("  Home \rAbout us\r"), F.col("text"), F.lit("\n\n Contact and privacy policy \n"))
    return v.documents.select("doc_id", T.clean_article_text(menu).alias("text"))


@query
def sanitize_cell(v):
    dirty = F.concat(F.lit("a|b\r\n"), F.col("summary_cn"))
    return v.articles.select("id", T.sanitize_cell(dirty).alias("cell"), T.sanitize_remark(dirty).alias("remark"),
                             T.sanitize_link(F.concat("url", F.lit("|x\n"))).alias("link"))


@query
def source_label(v):
    kind = variants(F.col("id"), F.col("source_type"), "RSSHub", "official", "", None)
    return v.articles.select("id", labels.source_label(kind).alias("label"))


@query
def title_key(v):
    return v.articles.select("id", T.title_key(F.concat(F.lit("集团公司 宣布! "), "title")).alias("key"))


@query
def cut_title(v):
    return v.articles.select("id", T.cut_title(F.concat(F.lit(" "), "summary_cn"), 10).alias("short"))


@query
def yes_no(v):
    return v.articles.select("id", T.yes_no(F.col("is_retained") == 1).alias("flag"))


@query
def display_title(v):
    i = F.col("id")
    contractor, place = variants(i, "ACME", "", None), variants(i, "Port, Delta , Ghent ", "Ghent", None, "")
    return v.articles.select("id", labels.display_title(
        F.col("title_cn"), F.col("summary_cn"), F.col("title"), F.col("category"), contractor, place).alias("shown"))


@query
def category_label(v):
    c = F.col("category")
    return v.articles.select("id", labels.category_label(c, "Project").alias("digest"), labels.category_label(c).alias("history"),
                             labels.category_label_any_case(F.lower(c)).alias("audit"))


@query
def strip_json_fence(v):
    i = F.col("id")
    body = F.to_json(F.struct(F.lit(False).alias("is_junk"), F.col("category"), F.col("title").alias("title_cn"),
                              F.date_format("created_at", "yyyy 年 M 月 d").alias("publish_time")))
    reply = variants(i, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n``` done")), F.concat(F.lit("```\n"), body, F.lit("\n```")),
                     body, F.lit("no result"))
    r = A.parse_model_reply(reply)
    return v.articles.select("id", r["is_junk"].alias("is_junk"), r["category"].alias("category"),
                             r["title_cn"].alias("title_cn"), r["publish_time"].alias("publish_time"))


@query
def normalize_llm_result(v):
    body = F.to_json(F.struct(F.lit(True).alias("is_junk"), F.lit("Bid").alias("category"), F.lit("t").alias("title_cn")))
    reply = variants(F.col("id"), F.concat(F.lit("["), body, F.lit("]")), F.concat(F.lit("["), body, F.lit(","), body, F.lit("]")),
                     body, F.lit("{broken"))
    r = A.normalize_model_result(reply, F.col("title"), F.col("pub_date"))
    return v.articles.select("id", r["is_junk"].alias("is_junk"), r["category"].alias("category"),
                             r["title_cn"].alias("title_cn"), r["publish_time"].alias("publish_time"))


# --- filters ---


@query
def visible_valid(v):
    return v.articles.where(filters.visible_valid()).select("id")


@query
def freshness(v):
    return filters.freshness(v.raw_items, AS_OF).select("seq", "pub_ts", "is_stale")


@query
def valid_title(v):
    title = F.when(F.col("seq") % 9 == 4, F.lit("About Us")).when(F.col("seq") % 9 == 5, F.lit("hi")).when(
        F.col("seq") % 9 == 6, F.lit("Back to top")).otherwise(F.col("title"))
    link = F.when(F.col("seq") % 10 == 3, F.lit("JavaScript:void(0)")).otherwise(F.col("link"))
    return v.raw_items.select("seq", T.title_verdict(title, link).alias("verdict"))


@query
def obvious_junk_title(v):
    return v.raw_items.select("seq", T.is_obvious_junk_title(F.col("title")).alias("is_junk"))


@query
def article_filter(v):
    return filters.article_filter(v.articles, valid=1, is_retained=1, start=date(2024, 1, 5), end=date(2024, 1, 28),
                                  keyword="dredg").select("id")


@query
def article_filter_fields(v):
    return filters.article_filter(v.articles, category="Equipment", source_type="wechat", source_name="src9").select("id")


@query
def keyword_search(v):
    return v.articles.where(filters.keyword_search("TERMINAL")).select("id", "title")


@query
def needs_enrichment(v):
    return filters.needs_enrichment(v.articles, AS_OF, created_after=START).select("id")


@query
def needs_analysis(v):
    return filters.needs_analysis(v.articles).select("id")


@query
def is_processed(v):
    return v.articles.select("id", filters.is_processed().alias("is_processed"))


@query
def time_range(v):
    return v.articles.where(filters.created_between(START, END)).select("id", "created_at")


@query
def recent_retained(v):
    return filters.recent_retained(v.articles, AS_OF, 48).select("id", "pub_date")


@query
def publish_window_filter(v):
    return filters.publish_window_filter(v.articles, START, END).select("id")


@query
def stale_on_insert(v):
    return filters.with_stale_flags(v.articles, LATER).select("id", "is_hidden", "valid", "remark")


@query
def post_enrich_validity(v):
    rows = v.articles.withColumn("remark", F.when(F.col("id") % 2 == 0, F.lit("seen")))
    return filters.post_enrich_validity(rows, AS_OF).select("id", "valid", "remark")


# --- classification ---


def category_texts(v: Views) -> DataFrame:
    return v.articles.select("id", variants(
        F.col("id"), F.col("category"), " R and D ", "R & D", "news", "新闻", F.col("title"), "", None, "RD!",
        "Research, Development", "Other").alias("text"))


@query
def normalize_category(v):
    return category_texts(v).select("id", C.normalize_category(F.col("text")).alias("category"))


@query
def infer_category(v):
    return v.documents.select("doc_id", C.infer_category(F.col("text")).alias("category"))


@query
def resolve_category(v):
    return v.articles.select("id", C.resolve_category(F.col("category"), F.col("title"), F.col("title_cn"),
                                                      F.col("summary_cn"), F.lit("")).alias("category"))


@query
def resolve_category_keep_other(v):
    return v.articles.select("id", C.resolve_category(F.col("category"), F.col("title"), F.col("title_cn"), F.col("summary_cn"),
                                                      keep_other=True).alias("category"))


@query
def primary_category(v):
    other = F.element_at(F.array(*[F.lit(c) for c in V.CATEGORIES]), (F.col("id") % 7 + 1).cast("int"))
    cats = F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(F.col("category"), other)))
    return v.articles.select("id", C.primary_category(cats).alias("category"))


def _relevance(v: Views) -> DataFrame:
    known = F.when(F.col("id") % 3 == 0, F.col("category"))
    return C.with_relevance(v.articles, known, F.col("title"), F.col("title_cn"), F.col("summary_cn"), F.lit(""), F.col("content"))


@query
def relevance(v):
    return _relevance(v).select("id", "is_relevant")


@query
def retention_flags(v):
    rows = C.with_normalized_category(_relevance(v), "known_category", F.col("category"))
    flags = C.retention_flags(F.col("is_relevant"), F.col("known_category"))
    return rows.select("id", *[c.alias(n) for n, c in flags.items()])


@query
def result_pub_date(v):
    return v.articles.select("id", C.result_pub_date(variants(F.col("id"), "2024-01-09", "2024", "", None),
                                                     F.col("pub_date")).alias("pub_date"))


@query
def contains_any(v):
    return v.documents.select("doc_id", T.text_contains_any(F.col("text"), V.SECONDARY_WORDS).alias("hit"))


@query
def contains_any_word(v):
    return v.documents.select("doc_id", T.text_contains_any(F.col("text"), ["the", "of", "und", "là", "+1"], word_boundary=True).alias("hit"))


# --- counts ---


@query
def daily_counts(v):
    return stats.daily_counts(v.articles, AS_OF, 7).select(day_text("day"), "articles")


@query
def total_count(v):
    return stats.total_count(v.articles)


@query
def category_counts(v):
    return stats.category_counts(v.articles)


@query
def category_trend(v):
    return stats.category_trend(v.articles).select("category", day_text("day"), "articles", "label")


@query
def source_top20(v):
    return stats.source_top(v.articles)


@query
def top_sources(v):
    return stats.source_top(v.articles, 5)


@query
def digest_category_counts(v):
    return stats.digest_category_counts(v.articles.where(filters.created_between(START, END)))


@query
def group_by_source(v):
    return stats.group_by_source(v.articles.select("id", "source_name", "created_at"))


@query
def group_by_category(v):
    return stats.group_by_category(v.articles.select("id", "category", "created_at")).select("id", "category", "section_order")


@query
def all_dates_union(v):
    return stats.all_dates(v.articles).select(day_text("day"))


@query
def statistics_bundle(v):
    return stats.statistics_long(v.articles, AS_OF).select("part", "key", day_text("day"), "n")


@query
def run_history(v):
    """Runs out of pipe-table lines, one run per day of collection."""
    run = F.date_format("created_at", "yyyyMMdd_'000000'")
    table = R.audit_table(v.articles.select(
        run.alias("run_id"), F.col("id").alias("seq"), F.col("source_name").alias("site"), "title", F.col("url").alias("link"),
        "pub_date", "source_type", (F.col("is_retained") == 1).alias("keep"), F.lit("").alias("remark")).drop("run_id"))
    runs = v.articles.select(F.col("id").alias("seq"), F.concat(run, F.lit(".md")).alias("file_name"))
    lines = table.join(runs, "seq").select("file_name", R.audit_line(table).alias("value"))
    heads = runs.select("file_name").distinct().select("file_name", F.explode(F.array(*[F.lit(h) for h in R.AUDIT_HEADER])).alias("value"))
    from tidewatch.sources.files import audit_lines

    return stats.run_history(audit_lines(lines.unionByName(heads))).select("run_id", "run_at", "searched", "kept", "summary")


# --- paging, reports ---


@query
def paged_articles(v):
    rows = filters.article_filter(v.articles, valid=1)
    return filters.present_article(filters.page_of(rows, page=2, page_size=50)).select(
        "id", "title", "pub_date", "source_type", "created_at", "category")


@query
def paged_after(v):
    """The second page, found from the last row of the first one."""
    rows = filters.article_filter(v.articles, valid=1)
    last = filters.page_of(rows, page_size=50).select("created_at", "pub_date", "id").tail(1)
    page = filters.page_after(rows, *last[0], page_size=50) if last else rows.limit(0)
    return filters.present_article(page).select("id", "title", "pub_date", "source_type", "created_at", "category")


@query
def paged_total(v):
    return filters.count_rows(filters.article_filter(v.articles, valid=1))


@query
def report_order(v):
    return R.report_order(R.window_articles(v.articles, START, END)).select("id", "created_at")


@query
def events_window(v):
    return R.events_window(v.articles, AS_OF).select("id", "title", "created_at")


@query
def hot_titles(v):
    return R.hot_titles(v.articles.where(filters.created_between(START, END)))


@query
def title_dedup_top5(v):
    return D.title_dedup_top(v.articles.where(filters.created_between(START, END))).select("id", "shown_title")


@query
def report_dedup(v):
    twice = v.articles.unionByName(v.articles.where(F.col("id") % 2 == 0).withColumn(
        "created_at", F.col("created_at") - F.make_dt_interval(hours=F.lit(1))))
    return D.report_dedup(twice).select("id", "category", "created_at")


@query
def dedup_market_titles(v):
    return D.dedup_market_titles(v.articles).select("id", "category")


@query
def push_window(v):
    start, end, label = R.push_window_columns(F.col("created_at"))
    return v.articles.select("id", start.alias("window_start"), end.alias("window_end"), label.alias("label"))


@query
def report_range(v):
    kind = variants(F.col("id"), "morning", "evening")
    start, end = R.report_range_columns(kind, F.to_date("created_at"))
    return v.articles.select("id", start.alias("window_start"), end.alias("window_end"))


@query
def daily_digest(v):
    return R.daily_digest(v.articles, AS_OF)


@query
def digest_cover(v):
    return R.digest_cover(v.articles, AS_OF)


@query
def markdown_report(v):
    rows = v.articles.withColumn("vl_desc", variants(F.col("id"), "a quay", "无视觉分析", "", None))
    return R.report_lines(rows).select("id", "section_order", "section", "heading", "summary_line", "picture_line")


# --- writes ---


@query
def write_articles(v):
    """Two writes: the second replaces its own days only."""
    from tidewatch.session import scratch_dir
    from tidewatch.sources import sinks

    path = scratch_dir(v.spark, "articles")
    rows = v.articles.select("id", "url", "title", "valid", "created_at")
    sinks.write_articles(rows, path)
    late = rows.where(F.col("created_at") >= filters.ts(START.replace(hour=0)))
    sinks.write_articles(late.withColumn("title", F.concat(F.lit("2 "), "title")), path)
    return sinks.read_table(v.spark, path).select("id", "url", "title", "valid", "created_at", day_text("created_date"))
