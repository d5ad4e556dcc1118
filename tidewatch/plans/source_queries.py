"""Registered queries over landed pages, feeds, account pages and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import text as T
from tidewatch.functions.urls import normalize_url
from tidewatch.operators.skew import top_n_per_key
from tidewatch.plans.article_queries import variants
from tidewatch.plans.registry import query
from tidewatch.plans.views import AS_OF, Views
from tidewatch.session import scratch_dir
from tidewatch.sources import files, pages as P
from tidewatch.sources.registry import SourceRegistry

BATCH, LANDED = 200, 25


# --- pages ---


def linked_pages(v: Views) -> DataFrame:
    """Pages whose menu entries read like news links."""
    html = F.replace("html", F.lit("</a>"), F.lit(" and <b>more</b> news &amp; views</a>"))
    return v.pages.select("page_id", "url", html.alias("html"))


def site_pages(v: Views) -> DataFrame:
    """Two in three pages list their links in a news block, the others only link into /news/."""
    html = F.replace("html", F.lit("</a>"), F.lit(" with more of the news</a>"))
    listed = F.replace(F.replace(html, F.lit("<nav>"), F.lit('<section class="top news">')), F.lit("</nav>"), F.lit("</section>"))
    other = F.replace(html, F.lit('href="/'), F.lit('href="/news/'))
    return v.pages.select("page_id", "url", F.when(F.col("page_id") % 3 == 0, other).otherwise(listed).alias("html"))


def dated_pages(v: Views) -> DataFrame:
    """Pages with a publication date in each of the known places."""
    n, day = F.col("page_id"), (F.col("page_id") % 27 + 1).cast("string")
    head = variants(n, F.concat(F.lit('<head><meta property="article:published_time" content="2024-1-'), day, F.lit('T08:00:00Z">')),
                    F.concat(F.lit('<head><meta name="date" content="2024年1月'), day, F.lit('日">')),
                    F.concat(F.lit('<head><time datetime="2024/01/'), day, F.lit('"></time>')), "<head>")
    return v.pages.select("page_id", "url", F.replace("html", F.lit("<head>"), head).alias("html"))


@query
def extract_links(v):
    return P.extract_links(linked_pages(v))


@query
def extract_links_plain(v):
    return P.extract_links(v.pages, selector="nav")


@query
def extract_links_custom(v):
    return P.extract_links_custom(site_pages(v), include=["example.org"])


@query
def extract_content(v):
    return P.extract_content(v.pages)


@query
def extract_page_date(v):
    return P.extract_page_date(dated_pages(v))


@query
def security_interstitial(v):
    title = F.when(F.col("page_id") % 5 == 0, "Privacy error").when(F.col("page_id") % 5 == 1, "Oops net::ERR_CERT_DATE_INVALID").otherwise(
        P.page_title())
    url = F.when(F.col("page_id") % 5 == 2, "chrome-error://chromewebdata/").otherwise(F.col("url"))
    return P.outline(v.pages).select("page_id", T.is_security_page(title, url).alias("is_blocked"))


def configured_links(v: Views) -> DataFrame:
    """Links with the settings of the source they were found on."""
    links = P.extract_links(linked_pages(v)).withColumn("source_name", F.concat(F.lit("S"), (F.col("page_id") % 25).cast("string")))
    n = F.col("n_nationkey")
    barred = F.when(n % 2 == 0, F.array(F.lit("/TH"), F.lit("/en"))).otherwise(F.array().cast("array<string>"))
    sources = v.table("nation").select(F.concat(F.lit("S"), n.cast("string")).alias("name"), F.lit("body").alias("selector"),
                                       (2 + n % 4).cast("int").alias("max_links"), barred.alias("blacklist"))
    return P.link_to_source_config(links, sources)


@query
def link_to_source_config(v):
    return configured_links(v).select("page_id", "pos", "source_name", "selector", "max_links", F.array_join("blacklist", ",").alias("barred"))


@query
def first_n_links(v):
    return P.first_n_links(configured_links(v)).select("page_id", "pos", "url")


@query
def valid_link(v):
    cut = P.first_n_links(configured_links(v))
    return cut.select("page_id", "pos", T.is_valid_link(F.col("url"), F.col("title"), F.col("blacklist")).alias("is_valid"))


@query
def valid_link_custom(v):
    links = P.extract_links(linked_pages(v))
    return links.select("page_id", "pos", T.is_valid_site_link(F.col("url"), F.col("title")).alias("is_valid"))


# --- feeds and accounts ---


def safe_title() -> Column:
    """Title text that may stand in markup as it is."""
    return F.trim(F.regexp_replace("title", r"[<>&\x00-\x1f]", " "))


def feed_documents(v: Views, extra: list[str]) -> DataFrame:
    """Feed documents of at most BATCH entries each, built from the collected items."""
    s = F.col("seq")
    when = F.to_timestamp_ntz(F.when(F.col("pub_date").rlike("^2024"), F.col("pub_date")), F.lit("yyyy-MM-dd"))
    stamp = F.coalesce(F.date_format(when, "EEE, dd MMM yyyy 06:30:00 +0000"), F.lit("unknown"))
    item = F.concat(
        F.lit("<item>"), F.when(s % 6 == 5, "").otherwise(F.concat(F.lit("<title>"), safe_title(), F.lit("</title>"))),
        F.lit("<link>"), F.replace("link", F.lit("&"), F.lit("&amp;")), F.lit("</link>"),
        F.when(s % 8 == 7, F.concat(F.lit("<updated>"), F.col("pub_date"), F.lit("</updated>"))).otherwise(
            F.concat(F.lit("<pubDate>"), stamp, F.lit("</pubDate>"))),
        F.lit("<description>text "), s.cast("string"), F.lit("</description></item>"))
    rows = v.raw_items.select(F.floor(s / BATCH).alias("batch"), F.col("source_name").alias("account"), *extra,
                              F.struct("seq", item.alias("xml")).alias("i"))
    docs = rows.groupBy("batch", "account", *extra).agg(F.array_sort(F.collect_list("i")).alias("l"))
    body = F.array_join(F.transform("l", lambda i: i["xml"]), "")
    return docs.select("batch", "account", *extra, F.concat(F.lit("<rss><channel><title>f</title>"), body, F.lit("</channel></rss>")).alias("doc"))


@query
def read_feed_items(v):
    return files.feed_items(files.feed_entries(feed_documents(v, [])), AS_OF, hours=72).select(
        F.col("account").alias("source_name"), "title", "link", "pub_date", "summary_raw", "source_type")


def account_pages(v: Views) -> DataFrame:
    """Replies of the account listing, one per account and page; some replies report a failure."""
    s = F.col("seq")
    msg = F.struct("title", "link", (1706000000 + s * 600).alias("update_time"), F.lit("d").alias("digest"),
                   F.concat(F.lit("c"), s.cast("string")).alias("cover"))
    rows = v.raw_items.select(F.col("source_name").alias("account"), F.floor(s / BATCH).alias("page"), F.struct("seq", msg.alias("m")).alias("i"))
    docs = rows.groupBy("account", "page").agg(F.array_sort(F.collect_list("i")).alias("l"))
    ret = F.when((F.col("page") == 1) & (F.substring("account", -1, 1) == "3"), 200003).otherwise(0)
    return docs.select("account", "page", F.to_json(F.struct(
        F.struct(ret.alias("ret")).alias("base_resp"), F.transform("l", lambda i: i["m"]).alias("app_msg_list"))).alias("payload"))


@query
def read_wechat_json(v):
    return files.wechat_items(account_pages(v), count=25, zone_hours=8).select(
        "account", "title", "link", "pub_date", "summary_raw", "source_type", "cover")


@query
def first_n_per_account(v):
    rows = v.raw_items.withColumnRenamed("source_name", "account")
    return top_n_per_key(rows, ["account"], [F.asc("seq")], 10, ["seq"]).select("account", "seq")


@query
def read_wechat_feed(v):
    """Accounts with an even last digit have the listing; all of them have feeds, some at the second base only."""
    listing = files.wechat_items(account_pages(v).where(F.substring("account", -1, 1).isin("0", "2", "4", "6", "8")), count=5)
    based = feed_documents(v, []).withColumn("base", F.when(F.substring("account", -1, 1) == "1", 1).otherwise(0))
    empty = based.where(F.col("base") == 1).select("account", F.lit(0).alias("base"), "batch", F.lit("<rss><channel></channel></rss>").alias("doc"))
    second = files.wechat_feed_items(based.select("account", "base", "batch", "doc").unionByName(empty), count=25)
    return files.wechat_with_fallback(listing, second).select("account", "title", "link", "pub_date", "source_type")


@query
def load_sources(v):
    """Configuration documents of 500 entries each, built from the suppliers."""
    s = F.col("s_suppkey")
    entry = F.struct(
        F.when(s % 11 != 3, F.col("s_name")).alias("name"), F.concat(F.lit("https://x.example/"), s.cast("string")).alias("url"),
        variants(s, "rss", "web", "wechat", None).alias("type"), F.when(s % 5 == 0, ".news").alias("selector"),
        F.when(s % 7 == 0, (s % 40).cast("int")).alias("max_links"), F.when(s % 6 == 0, F.array(F.lit("/a"), F.lit("/b"))).alias("blacklist"),
        F.when(s % 4 == 2, F.concat(F.lit("f"), F.floor(s / 12).cast("string"))).alias("fakeid"))
    rows = v.table("supplier").select(F.floor(s / 500).alias("part"), F.struct(s.alias("k"), entry.alias("e")).alias("i"))
    docs = rows.groupBy("part").agg(F.array_sort(F.collect_list("i")).alias("l")).select(
        "part", F.to_json(F.transform("l", lambda i: i["e"])).alias("doc"))
    return files.source_configs(docs, order=["part"]).select(
        "name", "url", "type", "selector", "max_links", F.array_join("blacklist", ",").alias("blacklist"), "fakeid")


@query
def source_plugin(v):
    """Two named readers and one known only by its type, read as one table."""
    known = SourceRegistry()
    columns = ["title", "link", "pub_date"]
    known.register("Feed Alpha", "rss", lambda spark, config: v.raw_items.where(F.col("source_type") == "rss").select(*columns))
    known.register("Account Beta", "wechat", lambda spark, config: v.raw_items.where(F.col("source_type") == "wechat").select(*columns))
    known.register_type("web", lambda spark, config: v.raw_items.where(F.col("source_type") == config["kind"]).select("title", "link"))
    return known.read_all(v.spark, {"Feed Alpha": {}, "Account Beta": {}, "Site Gamma": {"type": "web", "kind": "web"}, "Lost": {"type": "ftp"}})


@query
def clean_vessel_row(v):
    i = F.col("id")
    raw = v.ships.select(F.concat(i.cast("string"), F.lit(".0")).alias("id"), variants(i, "413000001.0", " 41x ", "nan", "", None).alias("mmsi"),
                         F.col("imo"), F.concat(F.lit(" "), "name").alias("name"), variants(i, "nan", " A ", None).alias("company"),
                         F.lit("t").alias("type"), "region", "country", "status", F.lit(None).cast("string").alias("status_date"),
                         F.lit("nan").alias("remarks"))
    return files.clean_vessel_rows(raw)


@query
def read_feed_files(v):
    """Feed documents landed as files, those of LANDED neighbouring batches in one, and read entry by entry."""
    path = scratch_dir(v.spark, "feeds")
    landed = feed_documents(v, []).groupBy(F.floor(F.col("batch") / LANDED)).agg(F.array_join(F.collect_list("doc"), "").alias("docs"))
    landed.select(F.concat(F.lit("<feeds>"), "docs", F.lit("</feeds>"))).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_feed_files(v.spark, path).select(normalize_url(F.col("link")).alias("link"), "title", "published", "updated", "summary_raw")
