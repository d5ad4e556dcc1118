"""Readers for landed files and payload text: registry CSV, feeds, account pages, configs, positions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch import schemas as S
from tidewatch.functions import dates, text as T
from tidewatch.operators.filters import ts
from tidewatch.operators.items import ITEM_COLUMNS
from tidewatch.operators.skew import top_n_per_key, unnest

# header of the registry file (fixed values)
VESSEL_CSV = {"序号": "id", "MMSI": "mmsi", "IMO": "imo", "船名": "name", "公司": "company", "船舶类型": "type",
              "区域": "region", "位置": "country", "目前状态": "status", "日期": "status_date", "备注": "remarks"}
NO_TITLE = "无标题"


def number_text(c: Column) -> Column:
    """'413.0' -> '413'; other text is trimmed; nothing stays NULL."""
    number = F.trim(c).try_cast("double")
    return F.when(T.is_blank(F.trim(c)) | (F.lower(F.trim(c)) == "nan"), F.lit(None)).otherwise(
        F.coalesce(number.try_cast("bigint").cast("string"), F.trim(c)))


def clean_vessel_rows(raw: DataFrame) -> DataFrame:
    """Rows of the registry file: ids as integer text, trimmed text, 'nan' as empty, nameless rows out."""
    def text(name: str) -> Column:
        value = F.trim(F.coalesce(F.col(name), F.lit("")))
        return F.when(value == "nan", F.lit("")).otherwise(value).alias(name)

    named = raw.where((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim("name") != "nan"))
    return named.select(F.trim("id").try_cast("double").try_cast("bigint").alias("id"),
                        number_text(F.col("mmsi")).alias("mmsi"), number_text(F.col("imo")).alias("imo"),
                        *[text(c) for c in ("name", "company", "type", "region", "country", "status", "status_date",
                                            "remarks")])


def read_vessel_csv(spark: SparkSession, path: str, encoding: str = "GBK") -> DataFrame:
    """Registry import. The place text goes to country; it is no coordinate pair."""
    schema = ", ".join(f"`{h}` STRING" for h in VESSEL_CSV)
    raw = spark.read.option("encoding", encoding).option("header", True).schema(schema).csv(path)
    return clean_vessel_rows(raw.select(*[F.col(f"`{h}`").alias(c) for h, c in VESSEL_CSV.items()]))


def feed_entries(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Entries of feed documents (one document text per row), with their position."""
    parsed = docs.withColumn("_rss", F.from_xml(F.col(doc), S.RSS_DOC)).drop(doc)
    rows = unnest(parsed, ["*"], F.col("_rss.channel.item"), "pos", "_item")
    return rows.select(*[c for c in parsed.columns if c != "_rss"], "pos", F.col("_item.title").alias("title"),
                       F.col("_item.link").alias("link"), F.col("_item.pubDate").alias("published"),
                       F.col("_item.updated").alias("updated"), F.col("_item.description").alias("summary_raw"))


def read_feed_files(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of landed feed files, one row per entry; the file name tells the source."""
    schema = "title STRING, link STRING, pubDate STRING, updated STRING, description STRING"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return raw.select("title", "link", F.col("pubDate").alias("published"), "updated",
                      F.col("description").alias("summary_raw"), F.col("_metadata.file_name").alias("file_name"))


def feed_items(entries: DataFrame, as_of: datetime, hours: int = 24, zone_hours: float = 0.0) -> DataFrame:
    """Dated entries newer than ``hours`` as items."""
    at = dates.feed_entry_date(F.col("published"), F.col("updated"), zone_hours)
    keep = [c for c in entries.columns if c not in ("published", "updated", "pos", *ITEM_COLUMNS)]
    return (entries.withColumn("_at", at).where(F.col("_at") > ts(as_of - timedelta(hours=hours)))
            .select(*keep, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("link", F.lit("")).alias("link"),
                    F.date_format("_at", "yyyy-MM-dd").alias("pub_date"),
                    F.coalesce("summary_raw", F.lit("")).alias("summary_raw"), F.lit("rss").alias("source_type")))


def wechat_items(pages: DataFrame, count: int = 10, zone_hours: float = 0.0) -> DataFrame:
    """Account pages (account, page, payload) as items, the first ``count`` of every account.

    Pages after a failed or empty one are not read; the reply status tells. Such a page goes along as
    one row that stands before its page, so each payload is parsed once and no account is looked up again.
    """
    parsed = pages.withColumn("_p", F.from_json("payload", S.WECHAT_PAGE))
    ok = F.coalesce((F.col("_p.base_resp.ret") == 0) & (F.size("_p.app_msg_list") > 0), F.lit(False))
    stop = F.when(F.col("page").isNotNull(), F.array(F.lit(None).cast(parsed.select("_p.app_msg_list").schema[0].dataType.elementType)))
    listed = parsed.select("account", "page", ok.alias("_ok"), F.when(ok, F.col("_p.app_msg_list")).otherwise(stop).alias("_list"))
    rows = unnest(listed, ["account", "page", "_ok"], F.col("_list"), "pos", "m")
    first = top_n_per_key(rows, ["account"], [F.asc("page"), F.asc("_ok"), F.asc("pos")], count, ["page", "pos"])
    so_far = Window.partitionBy("account").orderBy("page", "_ok", "pos")
    first = first.withColumn("_open", F.min("_ok").over(so_far.rowsBetween(Window.unboundedPreceding, 0))).where("_open")
    return first.select(
        "account", "page", "pos", F.col("m.title").alias("title"), F.col("m.link").alias("link"),
        dates.epoch_date(F.col("m.update_time"), zone_hours).alias("pub_date"),
        F.coalesce("m.digest", F.lit("")).alias("summary_raw"), F.lit("wechat").alias("source_type"),
        F.col("account").alias("source_name"), F.col("m.cover").alias("cover"))


def wechat_feed_items(feeds: DataFrame, count: int = 10) -> DataFrame:
    """Account feeds (account, base, doc): first base of an account with entries, first ``count`` of them.

    A base may have several documents, in the order of a column `batch`.
    """
    if "batch" not in feeds.columns:
        feeds = feeds.withColumn("batch", F.lit(0))
    order = F.struct("base", "batch", "pos")  # the least base alone has the first entries, as long as it has any
    first = top_n_per_key(feed_entries(feeds), ["account"], [order], count, ["batch", "pos"])
    rows = first.withColumn("_best", F.min("base").over(Window.partitionBy("account"))).where(F.col("base") == F.col("_best"))
    rfc = F.when(F.col("published").rlike(r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"),
                 F.col("published"))
    # the day as written, without moving it to another zone
    day = dates.parse_rfc_datetime(F.regexp_replace(rfc, r" [+-]\d{4}$", ""))
    return rows.select("account", "batch", "pos", F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
                       F.coalesce("link", F.lit("")).alias("link"),
                       F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")).alias("pub_date"),
                       F.lit("").alias("summary_raw"), F.lit("wechat").alias("source_type"),
                       F.col("account").alias("source_name"))


def wechat_with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Items of the first reader; accounts it has nothing for come from the second."""
    rest = secondary.join(primary.select("account").distinct(), "account", "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def source_configs(docs: DataFrame, doc: str = "doc", order: list[str] | None = None) -> DataFrame:
    """Entries of configuration documents (a JSON array each) with defaults; accounts listed once.

    ``order`` names columns of ``docs`` that put several documents in order.
    """
    order = order or []
    rows = unnest(docs, order, F.from_json(doc, f"ARRAY<STRUCT<{_struct(S.SOURCE)}>>"), "pos", "c")
    rows = rows.select(*order, "pos", "c.*").where(~T.is_blank(F.col("name")))
    rows = rows.select(*order, "pos", "name", "url", F.coalesce("type", F.lit("web")).alias("type"),
                       F.coalesce("selector", F.lit("body")).alias("selector"),
                       F.coalesce("max_links", F.lit(10)).alias("max_links"),
                       F.coalesce("blacklist", F.array().cast("array<string>")).alias("blacklist"), "fakeid")
    account = (F.col("type") == "wechat") & ~T.is_blank(F.col("fakeid"))
    first = top_n_per_key(rows.where(account), ["fakeid"], [*[F.asc(c) for c in order], F.asc("pos")], 1, ["pos"])
    return first.unionByName(rows.where(~F.coalesce(account, F.lit(False))))


def _struct(ddl: str) -> str:
    return ", ".join(p.replace(" ", ": ", 1) for p in ddl.split(", "))


def read_source_config(spark: SparkSession, path: str) -> DataFrame:
    """Configuration files in the order of their paths."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("file"))
    return source_configs(docs, order=["file"]).drop("file")


def fleet_positions(payloads: DataFrame, order: str = "batch") -> DataFrame:
    """Last reported row per mmsi out of position payloads (batch, payload); only replies that are ok."""
    parsed = payloads.withColumn("_p", F.from_json("payload", S.FLEET_PAYLOAD)).where(F.col("_p.result") == "ok")
    rows = unnest(parsed, [order], F.col("_p.list"), "pos", "v").where(F.col("v.mmsi") != "")
    last = rows.groupBy(F.col("v.mmsi").alias("mmsi")).agg(F.max_by("v", F.struct(order, "pos")).alias("v"))
    zero = F.lit(0.0)
    return last.select("mmsi", F.coalesce("v.lat", zero).alias("lat"), F.coalesce("v.lon", zero).alias("lng"),
                       F.coalesce("v.speed", zero).alias("speed"), F.coalesce("v.heading", zero).alias("heading"),
                       F.coalesce("v.status", F.lit("Unknown")).alias("status_raw"),
                       dates.parse_track_ts(F.col("v.updatetime")).alias("timestamp"),
                       F.col("v.shipname").alias("shipname"), F.col("v.name").alias("name"))


def audit_lines(lines: DataFrame) -> DataFrame:
    """Rows (run_id, keep) out of pipe-table lines (file_name, value); heading lines are skipped."""
    body = lines.where((F.trim("value") != "") & ~F.startswith(F.col("value"), F.lit("| 序号 |"))
                       & ~F.startswith(F.col("value"), F.lit("| --- |")))
    cell = F.try_element_at(F.split("value", r"\|"), F.lit(6))
    return body.select(F.substring_index("file_name", ".", 1).alias("run_id"),
                       F.coalesce(F.contains(cell, F.lit("是")), F.lit(False)).alias("keep"))


def read_audit_files(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return audit_lines(lines)
