"""The engine's tables as expressions over the sample tables; nothing is stored."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch import schemas as S

AS_OF = datetime(2024, 1, 30, 18)
PHRASES = ["Contract award for ", "New dredger delivery to ", "Quarterly revenue of ", "Beach restoration underway at ",
           "Permit approval for ", "Soil research by ", "Skip to main content ", "River and estuary near ",
           "Agreement signed with ", "疏浚 航道 ", "Hello ", "Port terminal berth ", "Back to ", "404 Not Found ",
           "Strike plan at ", "About us "]
STORED_CATEGORIES = ["Bid", "Equipment", "Market", "Project", "Regulation", "R&D", "Other"]


def _case(c: Column, table: dict, default=None) -> Column:
    chain = None
    for key, value in table.items():
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(c == key, value) if chain is None else chain.when(c == key, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def _text(c: Column) -> Column:
    return c.cast("string")


def as_of() -> Column:
    return F.lit(str(AS_OF)).cast("timestamp_ntz")


def tracks_from_events(events: DataFrame) -> DataFrame:
    amp = _case(F.col("user_id") % 4, {0: 0.0002, 1: 0.8, 2: 4.0}, 30.0)
    e = F.col("event_id")
    return events.select(
        e.alias("id"), _text(F.col("user_id")).alias("mmsi"),
        F.concat(F.lit("Vessel "), _text(F.col("user_id"))).alias("vessel_name"),
        (30.0 + amp * ((e * 7919) % 1000 / 1000.0)).alias("lat"),
        (120.0 + amp * ((e * 104729) % 1000 / 1000.0)).alias("lng"),
        (F.col("value") / 10.0).alias("speed"), ((e * 37) % 360).cast("double").alias("heading"),
        _case(F.col("event_type"), {"click": "Dredging", "view": "Underway using engine", "purchase": "At anchor",
                                    "signup": "施工作业"}, "Unknown").alias("status_raw"),
        F.col("ts").alias("timestamp"), (F.col("ts") + F.make_dt_interval(mins=F.lit(1))).alias("created_at"))


def _page_of(d: Column) -> Column:
    return F.when(d % 7 == 6, d - 3).otherwise(d)


def _pub_date(d: Column) -> Column:
    day = F.date_format(F.date_sub(F.lit(AS_OF.date()), (d % 9).cast("int")), "yyyy-MM-dd")
    return F.when(d % 11 == 0, "").when(d % 13 == 0, "n/a").otherwise(day)


def _raw_columns() -> dict[str, Column]:
    d, k = F.col("doc_id"), _page_of(F.col("doc_id"))
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (d % 16 + 1).cast("int"))
    head = F.substring_index("text", "\n", 1)
    joint = F.when(k % 4 == 0, "&").otherwise("?")
    tail = F.when(d % 5 == 0, F.concat(joint, F.lit("utm_source=feed"))).when(d % 5 == 1, "#top").when(
        d % 5 == 2, F.concat(joint, F.lit("ref=x"))).otherwise("")
    return {
        "seq": d, "title": F.when(d % 41 == 0, "").otherwise(F.concat(phrase, head)),
        "link": F.concat(_url(k), tail), "pub_date": _pub_date(d), "summary_raw": F.col("text"),
        "source_type": F.when(d % 10 < 3, "rss").when(d % 10 < 9, "web").otherwise("wechat"),
        "source_name": F.col("source"), "fetched_at": as_of()}


def raw_from_documents(documents: DataFrame) -> DataFrame:
    return documents.select(*[c.alias(name) for name, c in _raw_columns().items()])


def _url(k: Column) -> Column:
    return F.concat(F.lit("https://news"), _text(k % 7), F.lit(".example.org/item/"), _text(k),
                    F.when(k % 4 == 0, "?page=2").otherwise(""))


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """One row per page. The item and its document are the same row, so no join is needed."""
    n, raw = F.col("doc_id"), _raw_columns()
    base = documents.where(n % 7 != 6).select("doc_id", "text", "source", *[
        raw[c].alias(f"r_{c}") for c in ("title", "pub_date", "source_type")])
    return base.select(
        n.alias("id"), _url(n).alias("url"), F.col("r_title").alias("title"),
        F.when(n % 3 == 0, F.concat(F.lit("译 "), F.col("r_title"))).alias("title_cn"), F.col("r_pub_date").alias("pub_date"),
        F.col("r_source_type").alias("source_type"), F.when(n % 23 != 0, F.col("source")).alias("source_name"),
        F.when(n % 4 == 0, "").otherwise(F.col("text")).alias("summary_cn"),
        F.when(n % 6 == 0, "").otherwise(F.col("text")).alias("content"),
        F.when(n % 2 == 0, F.concat(F.lit("assets/"), _text(n), F.lit(".jpg"))).otherwise("").alias("screenshot_path"),
        F.when(n % 8 != 7, F.element_at(F.array(*[F.lit(c) for c in STORED_CATEGORIES]), F.least(n % 8 + 1, F.lit(7)).cast("int"))).alias("category"),
        F.when(n % 29 == 0, 1).when(n % 31 == 0, F.lit(None)).otherwise(0).alias("is_hidden"),
        F.when(n % 17 == 0, 0).when(n % 19 == 0, F.lit(None)).otherwise(1).alias("valid"),
        F.when(n % 5 < 3, 1).otherwise(0).alias("is_retained"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(mins=((n * 211) % 42840).cast("int"))).alias("created_at"))


class Views:
    """All tables of one sample folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def tracks(self) -> DataFrame:
        return tracks_from_events(self.table("events"))

    @cached_property
    def ships(self) -> DataFrame:
        s = F.col("s_suppkey")
        places = (self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                  .select("n_nationkey", "n_name", "r_name"))
        return self.table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
            s.alias("id"), _text(9000000 + s).alias("imo"),
            F.when(s % 10 == 0, F.lit(None)).when(s % 10 == 1, "").otherwise(_text(s)).alias("mmsi"),
            F.col("s_name").alias("name"),
            _case(s % 9, {0: "上航局", 1: "天航局", 2: "广航局", 3: "Boskalis", 4: "DEME", 5: "JanDeNUL", 6: "Van Oord",
                          7: F.col("n_name")}).alias("company"),
            F.col("r_name").alias("region"), _case(s % 4, {0: "0.0, 0.0", 1: "31.5, 121.25", 2: "Rotterdam"}).alias("location"),
            _case(s % 3, {0: "offline", 1: "Dredging"}, "锚泊").alias("status"),
            (as_of() - F.make_dt_interval(hours=(s % 48).cast("int"))).alias("updated_at"),
            F.col("n_name").alias("country"), F.col("r_name").alias("continent"),
            F.when(s % 5 != 0, (s % 5) / 10.0).alias("speed"), ((s * 53) % 360).cast("double").alias("heading"))

    @cached_property
    def gazetteer(self) -> DataFrame:
        n = F.col("n_nationkey")
        return (self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_name").alias("place"), F.col("r_name").alias("admin1"), _text(n).alias("cc"),
            F.col("r_name").alias("continent"), (30.0 + (n % 5) * 6.0).alias("lat"),
            (120.0 + F.floor(n / 5) * 6.0).alias("lng")))

    @cached_property
    def raw_items(self) -> DataFrame:
        return raw_from_documents(self.documents)

    @cached_property
    def articles(self) -> DataFrame:
        return articles_from_documents(self.documents)

    @cached_property
    def store(self) -> DataFrame:
        return self.articles.where(F.col("id") % 3 != 2)

    @cached_property
    def analysis(self) -> DataFrame:
        """Model results per article: url, text_res, vl_res."""
        a = self.articles
        labels = self.table("labels").select(F.col("doc_id").alias("id"), "quality")
        rows = a.join(labels, "id", "left")
        has_text, i = F.col("quality").isNotNull(), F.col("id")
        has_image = (F.col("screenshot_path") != "") & (i % 3 != 0)
        nothing = F.lit(None).cast("string")
        text_res = F.struct(
            (F.col("quality") == 0).alias("is_junk"), F.col("category").alias("category"),
            F.when(i % 4 != 1, F.concat(F.lit("文 "), F.col("title"))).alias("title_cn"),
            F.col("content").alias("summary_cn"), nothing.alias("full_text_cn"),
            F.when(i % 4 != 2, F.col("pub_date")).alias("publish_time"), nothing.alias("image_desc"))
        vl_res = F.struct(
            (i % 5 == 0).alias("is_junk"), F.lit("Project").alias("category"),
            F.concat(F.lit("图 "), F.col("title")).alias("title_cn"), nothing.alias("summary_cn"),
            nothing.alias("full_text_cn"), F.lit("2024-01-28").alias("publish_time"),
            F.concat(F.lit("image "), _text(i)).alias("image_desc"))
        return rows.select("url", F.when(has_text, text_res).alias("text_res"), F.when(has_image, vl_res).alias("vl_res"))


EVENTS_DDL, DOCUMENTS_DDL = S.EVENTS_FILE, S.DOCUMENTS_FILE
