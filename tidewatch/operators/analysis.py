"""Joining articles with the results of the text and the image model."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schemas as S, vocab as V
from tidewatch.functions import categories as C, dates, text as T
from tidewatch.operators import filters

# lines of the analysis log (fixed values)
LOG_JUNK_TITLE = "4. **前置检查**: 标题命中垃圾关键词"
LOG_TEXT = "4. **Text分析 (优先)**: 成功 ("
LOG_IMAGE_HELP = "4.1. **VL辅助**: 补充图片描述与时间"
LOG_NO_IMAGE = "4.1. **VL辅助**: 无有效视觉内容"
LOG_IMAGE = "4. **VL分析 (兜底)**: 成功 ("
LOG_NONE = "4. **分析结论**: "
LOG_IRRELEVANT = "4.2. **相关性判断**: 非疏浚主题，标记为无效并归入'其他'"


def parse_model_reply(reply: Column) -> Column:
    """Model reply text as a result struct: fence removed, dates cleaned, NULL when unreadable."""
    body = T.strip_json_fence(reply)
    parsed = F.from_json(body, S.MODEL_RESULT, {"mode": "PERMISSIVE"})
    day = F.coalesce(dates.extract_ymd(parsed["publish_time"], spaced=True), parsed["publish_time"])
    readable = F.try_parse_json(body).isNotNull()
    return F.when(readable & T.strip(body).startswith("{"), parsed.withField("publish_time", day))


def normalize_model_result(body: Column, title: Column, pub_date: Column) -> Column:
    """An object, or the one object of a list; any other list becomes a plain Market result."""
    text = T.strip(body)
    listed = F.from_json(F.when(text.startswith("["), text), f"ARRAY<STRUCT<{_ddl_fields()}>>")
    single = F.from_json(F.when(text.startswith("{"), text), S.MODEL_RESULT)
    plain = F.struct(F.lit(False).alias("is_junk"), F.lit("Market").alias("category"), title.alias("title_cn"),
                     F.lit("").alias("summary_cn"), F.lit("").alias("full_text_cn"),
                     F.coalesce(pub_date, F.lit("")).alias("publish_time"), F.lit(None).cast("string").alias("image_desc"))
    only = F.try_element_at(listed, F.lit(1))
    return (F.when(F.try_parse_json(text).isNull(), F.lit(None))
            .when(text.startswith("["), F.when((F.size(listed) == 1) & only.isNotNull(), only).otherwise(plain))
            .otherwise(single))


def _ddl_fields() -> str:
    return ", ".join(f"{p.split()[0]}: {p.split()[1]}" for p in S.MODEL_RESULT.split(", "))


def merge_results(articles: DataFrame, results: DataFrame) -> DataFrame:
    """One final row per article from text_res and vl_res of ``results`` (unique per url).

    The text result comes first and the image result fills its gaps; the image result alone is the
    second choice; otherwise the article is junk or failed.
    """
    rows = articles.join(results.select("url", "text_res", "vl_res"), "url", "left")
    text, image = F.col("text_res"), F.col("vl_res")
    junk_title = T.is_obvious_junk_title(F.col("title"))
    text_ok = text.isNotNull() & ~F.coalesce(text["is_junk"], F.lit(False))
    image_ok = image.isNotNull() & ~F.coalesce(image["is_junk"], F.lit(False))
    any_junk = F.coalesce(text["is_junk"], F.lit(False)) | F.coalesce(image["is_junk"], F.lit(False))
    way = (F.when(junk_title, F.lit("junk_title")).when(text_ok, F.lit("text")).when(image_ok, F.lit("image"))
           .when(any_junk, F.lit("junk")).otherwise(F.lit("failed")))
    rows = rows.withColumn("way", way).withColumn("_image_ok", image_ok)
    title = F.coalesce("title", F.lit(""))
    item_pub = F.coalesce("pub_date", F.lit(""))
    is_way = lambda *names: F.col("way").isin(*names)
    by_text, by_image, no_result = is_way("text"), is_way("image"), is_way("junk", "failed")
    reason = F.when(is_way("junk"), F.lit(V.R_JUNK_RESULT)).otherwise(F.lit(V.R_FAILED_RESULT))
    helped = by_text & F.col("_image_ok")

    best = {
        "_category": F.when(by_text, text["category"]).when(by_image, image["category"]),
        "_title_cn": (F.when(by_text, F.coalesce(T.blank_to_null(text["title_cn"]),
                                            F.when(helped, image["title_cn"]), text["title_cn"], title))
                      .when(by_image, F.coalesce(image["title_cn"], title))),
        "_summary_cn": (F.when(by_text, F.coalesce(text["summary_cn"], F.lit(V.R_NO_SUMMARY)))
                        .when(by_image, F.coalesce(image["summary_cn"], F.lit(V.R_NO_SUMMARY)))),
        "_full_text_cn": F.when(by_text, F.coalesce(text["full_text_cn"], F.lit(""))).otherwise(F.lit("")),
        "_publish_time": (F.when(by_text, F.coalesce(T.blank_to_null(text["publish_time"]),
                                                F.when(helped, image["publish_time"])))
                          .when(by_image, image["publish_time"])),
    }
    rows = rows.withColumns(best)
    rows = C.with_relevance(rows, F.col("_category"), F.col("title"), F.col("_title_cn"), F.col("_summary_cn"),
                            F.col("_full_text_cn"), F.col("content"))
    kept = C.retention_flags(F.col("is_relevant"), F.col("known_category"))
    settled = by_text | by_image
    log = F.array_compact(F.array(
        F.when(~T.is_blank(F.col("url")), F.concat(F.lit("1. **访问目标**: ["), title, F.lit("]("), F.col("url"), F.lit(")"))),
        F.when(is_way("junk_title"), F.lit(LOG_JUNK_TITLE)),
        F.when(by_text, F.concat(F.lit(LOG_TEXT), F.coalesce("_category", F.lit("None")), F.lit(")"))),
        F.when(by_text, F.when(F.col("_image_ok"), F.lit(LOG_IMAGE_HELP)).otherwise(F.lit(LOG_NO_IMAGE))),
        F.when(by_image, F.concat(F.lit(LOG_IMAGE), F.coalesce("_category", F.lit("None")), F.lit(")"))),
        F.when(no_result, F.concat(F.lit(LOG_NONE), reason)),
        F.when(settled & ~F.col("is_relevant"), F.lit(LOG_IRRELEVANT))))
    has_any = image.isNotNull() | text.isNotNull()
    fallback_title = F.when(image.isNotNull(), image["title_cn"]).otherwise(text["title_cn"])
    fallback_summary = F.when(image.isNotNull(), image["summary_cn"]).otherwise(text["summary_cn"])
    return rows.select(
        "id", "url", "title",
        F.when(is_way("junk_title"), title).when(no_result, F.coalesce(F.when(has_any, fallback_title), title))
        .otherwise(F.col("_title_cn")).alias("title_cn"),
        F.when(settled, C.result_pub_date(F.col("_publish_time"), item_pub)).otherwise(item_pub).alias("pub_date"),
        F.when(is_way("junk_title"), F.lit(V.R_JUNK_SUMMARY))
        .when(no_result, F.coalesce(F.when(has_any, fallback_summary), reason)).otherwise(F.col("_summary_cn")).alias("summary_cn"),
        "_full_text_cn", F.coalesce("content", F.lit("")).alias("content"),
        F.when(settled, kept["category"]).otherwise("Other").alias("category"),
        F.when(settled, kept["valid"]).otherwise(0).alias("valid"),
        F.when(settled, kept["is_retained"]).otherwise(0).alias("is_retained"),
        no_result.alias("is_junk"),
        F.when(is_way("junk_title"), F.lit(V.R_JUNK_TITLE)).when(no_result, reason).otherwise(kept["remark"]).alias("remark"),
        F.when(helped | by_image | no_result, F.coalesce(image["image_desc"], F.lit(""))).otherwise(F.lit("")).alias("image_desc"),
        F.coalesce("screenshot_path", F.lit("")).alias("screenshot_path"), log.alias("analysis_log"),
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
        F.coalesce("source_name", F.lit("")).alias("source_name"), "way",
    ).withColumnRenamed("_full_text_cn", "full_text_cn")


def run_date_gate(results: DataFrame, run_items: DataFrame, as_of: datetime, date_source: str = "run") -> DataFrame:
    """Un-retain results whose date is missing or too old.

    The date is that of this run's first listing of the link (``run``) or the result's own
    (``result``). Adds is_dropped; kept results without a date take the listing's.
    """
    listed = (run_items.where(~T.is_blank(F.col("title")) & ~T.is_blank(F.col("link"))).groupBy(F.col("link").alias("url"))
              .agg(F.min_by("pub_date", "seq").alias("_run_date")))
    rows = results.join(listed, "url", "left")
    judged = F.col("_run_date") if date_source == "run" else F.col("pub_date")
    rows = rows.withColumn("_ts", dates.parse_pub_datetime(judged))
    rows = rows.withColumn("is_dropped", F.col("_ts").isNull() | filters.is_stale(F.col("_ts"), as_of))
    undone = F.col("is_dropped") & (F.col("is_retained") == 1)
    return (rows.withColumn("remark", F.when(undone, F.lit(V.R_OLD_RUN)).otherwise(F.col("remark")))
            .withColumn("is_retained", F.when(undone, 0).otherwise(F.col("is_retained")))
            .withColumn("pub_date", F.when(~F.col("is_dropped"), T.first_filled(F.col("pub_date"), F.col("_run_date")))
                        .otherwise(F.col("pub_date")))
            .drop("_run_date", "_ts"))


def outcome_flags(results: DataFrame) -> DataFrame:
    """Per result: did the text model and the image model deliver, and was the article kept."""
    text_ok = ~T.is_blank(F.col("full_text_cn")) | ~T.is_blank(F.col("summary_cn"))
    return (results.withColumn("text_ok", text_ok)
            .withColumn("vl_ok", F.when(~T.is_blank(F.col("screenshot_path")), ~T.is_blank(F.col("image_desc"))))
            .withColumn("kept", ~F.coalesce(F.col("is_junk"), F.lit(False))))


def audit_outcome(audit: DataFrame, gated: DataFrame) -> DataFrame:
    """Write the outcome of the analysis into the pending audit rows."""
    res = gated.select(F.col("url").alias("link"), F.lit(True).alias("_hit"), "is_dropped", "is_retained", "is_junk",
                       F.col("valid").alias("_valid"), F.col("title_cn").alias("_title_cn"),
                       (~T.is_blank(F.col("title_cn")) | ~T.is_blank(F.col("summary_cn"))
                        | ~T.is_blank(F.col("full_text_cn"))).alias("_text"),
                       (~T.is_blank(F.col("screenshot_path"))).alias("_shot"))
    rows = audit.join(res, "link", "left")
    pending = F.col("remark") == V.R_PENDING
    kept = pending & F.coalesce(~F.col("is_dropped") & (F.col("is_retained") == 1), F.lit(False))
    remark = (F.when(~pending, F.col("remark")).when(F.col("_hit").isNull(), F.lit(V.A_NO_RESULT))
              .when(F.col("is_dropped"), F.lit(V.R_OLD_RUN)).when(F.col("is_retained") == 1, F.lit(V.R_KEPT))
              .when(F.col("is_junk"), F.lit(V.A_UNRELATED)).when(F.col("_valid") == 0, F.lit(V.A_INVALID))
              .otherwise(F.lit(V.A_NOT_KEPT)))
    return rows.select(
        "seq", "site", "title", F.when(kept, T.first_filled(F.col("_title_cn"), F.col("title"))).alias("title_cn"), "link",
        "pub_date", "source_type", kept.alias("keep"), (kept & F.coalesce("_text", F.lit(False))).alias("text_ok"),
        (kept & F.coalesce("_shot", F.lit(False))).alias("vl_ok"), remark.alias("remark"))
