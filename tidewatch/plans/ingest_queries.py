"""Registered queries over collection, merging, model results and whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.urls import normalize_url as normalize
from tidewatch.operators import analysis as A, dedup as D, items as I, reports as R, stats, upsert as U
from tidewatch.plans import jobs
from tidewatch.plans.article_queries import LATER
from tidewatch.plans.registry import query
from tidewatch.plans.views import AS_OF, Views
from tidewatch.session import scratch_dir
from tidewatch.sources import sinks, store


def collected(v: Views) -> DataFrame:
    """Raw items with normalised links; some carry a reason the collector refused them."""
    return I.normalize_links(v.raw_items).withColumn(
        "filtered_reason", F.when(F.col("seq") % 37 == 0, F.lit("栏目页")))


@query
def dedup_in_run(v):
    return D.dedup_in_run(collected(v)).select("seq", "link", "is_duplicate")


@query
def new_minus_store(v):
    return D.new_minus_store(collected(v), v.store).select("seq", "link")


@query
def insert_new_only(v):
    return D.insert_new_only(collected(v), v.store, AS_OF).drop("id")


@query
def insert_counts(v):
    return D.insert_counts(collected(v), v.store)


@query
def processed_lookup(v):
    return D.processed_lookup(collected(v), v.store).select("seq", "is_processed")


@query
def ingest_disposition(v):
    return D.ingest_disposition(collected(v), v.store, AS_OF).select("seq", "link", "disposition", "remark", "new_valid", "new_hidden")


@query
def audit_projection(v):
    return D.audit_projection(D.ingest_disposition(collected(v), v.store, AS_OF))


def updates(v: Views) -> DataFrame:
    """Several partial updates per url, with gaps in every column."""
    s = F.col("seq")
    return v.raw_items.select(
        normalize(F.col("link")).alias("url"), "seq", "title", "pub_date", "source_type", "source_name",
        F.when(s % 5 == 0, F.col("summary_raw")).otherwise("").alias("summary_cn"),
        F.when(s % 7 == 0, "Other").when(s % 7 == 1, "news").alias("category"),
        F.when(s % 4 == 0, 0).when(s % 4 == 1, 1).alias("valid"), F.when(s % 6 == 0, 1).alias("is_hidden"),
        F.when(s % 3 == 0, 1).alias("is_retained"),
        F.when(s % 8 == 0, F.concat(F.lit("备注"), s.cast("string"))).otherwise("").alias("remark"))


STORE_COLUMNS = ["url", "title", "title_cn", "pub_date", "source_type", "source_name", "summary_cn", "category", "valid",
                 "is_hidden", "is_retained", "remark", "created_at"]


@query
def upsert_articles(v):
    store = v.store.withColumn("remark", F.lit(None).cast("string"))
    return U.upsert_articles(store, updates(v), LATER).select(*STORE_COLUMNS)


@query
def upsert_store(v):
    """The same updates written into a bucketed store."""
    path = scratch_dir(v.spark, "store")
    store.write(v.store.withColumn("remark", F.lit(None).cast("string")), path, 16)
    store.upsert(v.spark, path, updates(v), LATER)
    return store.read(v.spark, path).select(*STORE_COLUMNS)


@query
def ingest_into_store(v):
    """The ingest job on a stored table."""
    path = scratch_dir(v.spark, "store")
    store.write(v.store.withColumn("remark", F.lit(None).cast("string")), path, 16)
    jobs.ingest_into(v.spark, v.raw_items, path, AS_OF)
    return store.read(v.spark, path).select(*STORE_COLUMNS)


@query
def ingest_job(v):
    return jobs.ingest(v.raw_items, v.store, AS_OF)["store"].select(*STORE_COLUMNS)


@query
def union_sources(v):
    pages = v.pages.select(F.col("page_id").alias("seq"), F.col("url").alias("link"), F.lit("page").alias("source_type"))
    return I.union_sources(v.raw_items.select("seq", "title", "link", "source_type"), pages)


@query
def source_fetch_stats(v):
    sources = v.table("supplier").select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("name"),
        F.when(F.col("s_suppkey") % 9 == 4, F.lit("timeout")).alias("error"))
    return I.source_fetch_stats(sources, v.raw_items)


@query
def source_fetch_totals(v):
    sources = v.raw_items.select(F.col("source_name").alias("name")).distinct().withColumn(
        "error", F.when(F.col("name") == "src3", F.lit("timeout")))
    return I.source_fetch_totals(I.source_fetch_stats(sources, v.raw_items))


# --- model results ---


def merged(v: Views) -> DataFrame:
    return A.merge_results(v.articles, v.analysis)


@query
def analysis_merge(v):
    return merged(v).select("id", "url", "title", "title_cn", "pub_date", "summary_cn", "category", "valid", "is_retained", "is_junk",
                            "remark", "image_desc", "way", F.array_join("analysis_log", "\n").alias("log"))


@query
def result_outcome_flags(v):
    return A.outcome_flags(merged(v)).select("id", "text_ok", "vl_ok", "kept")


def gated(v: Views, source: str = "run") -> DataFrame:
    return A.run_date_gate(merged(v), I.normalize_links(v.raw_items), AS_OF, source)


@query
def run_date_gate(v):
    return gated(v).select("id", "is_dropped", "is_retained", "remark", "pub_date")


@query
def run_date_gate_result(v):
    return gated(v, "result").select("id", "is_dropped", "is_retained", "remark", "pub_date")


def run_audit(v: Views) -> DataFrame:
    return D.audit_projection(D.ingest_disposition(collected(v), v.store, AS_OF))


def outcome(v: Views) -> DataFrame:
    return A.audit_outcome(run_audit(v), gated(v))


@query
def audit_outcome_join(v):
    return outcome(v).select("seq", "title_cn", "keep", "text_ok", "vl_ok", "remark")


@query
def audit_table(v):
    return R.audit_table(outcome(v))


@query
def write_audit(v):
    path = scratch_dir(v.spark, "audit")
    sinks.write_audit(R.audit_table(outcome(v)), "20240130_180000", path)
    return sinks.read_table(v.spark, path).select("seq", "name", "keep", "remark", F.col("run_id").cast("string").alias("run_id"))


@query
def run_summary(v):
    return stats.run_summary(D.ingest_disposition(collected(v), v.store, AS_OF), A.outcome_flags(merged(v)))


@query
def analysis_job(v):
    store = v.store.withColumn("remark", F.lit(None).cast("string")).withColumn("full_text_cn", F.lit(None).cast("string"))
    return jobs.analyse(store, v.analysis, I.normalize_links(v.raw_items), run_audit(v), AS_OF)["store"].select(*STORE_COLUMNS)


@query
def analysis_job_audit(v):
    store = v.store.withColumn("remark", F.lit(None).cast("string")).withColumn("full_text_cn", F.lit(None).cast("string"))
    return jobs.analyse(store, v.analysis, I.normalize_links(v.raw_items), run_audit(v), AS_OF)["audit"].select(
        "seq", "keep", "text_ok", "vl_ok", "remark")
