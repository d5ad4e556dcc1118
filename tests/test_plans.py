"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tidewatch.plans.catalog import QUERIES

WRITES = {"append_tracks", "upsert_store", "ingest_into_store", "read_vessel_csv", "write_articles", "write_audit", "read_feed_files", "track_store_retention"}
NAMES = sorted(n for n in QUERIES if n not in WRITES and not n.startswith("stream_"))


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_and_no_global_window(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window [^\n]*\n[^\n]*(?:Sort [^\n]*\n[^\n]*)?Exchange SinglePartition", text)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "scan_tracks")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "props" not in schema and "value" in schema
    assert "text" not in re.search(r"ReadSchema: (\S+)", plan(spark, sf_dir, "category_counts")).group(1)


def test_rows_beyond_the_cut_do_not_reach_the_shuffle(spark, sf_dir):
    assert plan(spark, sf_dir, "track_retention").count("WindowGroupLimit") >= 2
    text = plan(spark, sf_dir, "vessel_status")
    assert len(re.findall("FileScan", text)) <= 4 and len(re.findall("Exchange ", text)) <= 7


def test_stored_tracks_are_read_by_day(spark, sf_dir):
    """Whoever asks for a time range reads the days of the range, also the fleet job."""
    from datetime import timedelta

    from tidewatch.operators import tracks as T
    from tidewatch.plans import jobs, track_queries as Q
    from tidewatch.plans.views import AS_OF, Views
    from tidewatch.session import scratch_dir
    from tidewatch.sources import files, sinks

    v, path = Views(spark, sf_dir), scratch_dir(spark, "tracks")
    sinks.append_tracks(v.tracks, path)
    stored = sinks.read_table(spark, path)
    fleet = jobs.fleet_job(files.fleet_positions(Q.payloads(v)), v.ships, stored, v.gazetteer, AS_OF, 2)
    for df, want in ((T.recent_tracks(stored, AS_OF, 2), T.recent_tracks(v.tracks, AS_OF, 2)), (T.track_history(stored, "7", AS_OF, 5), T.track_history(v.tracks, "7", AS_OF, 5)),
                     (T.has_track(stored, AS_OF, 5), T.has_track(v.tracks, AS_OF, 5)), (fleet["ships"], None)):
        text = df._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in text.split("FileScan")[1:] if "track_date" in x]
        assert scans and all(re.search(r"PartitionFilters: \[[^\]]*track_date#\d+ >= 20", x) for x in scans)
        assert want is None or (df.count() == want.count() and sorted(df.columns) == sorted(want.columns))
    days = {r[0].split("track_date=")[1][:10] for r in T.recent_tracks(stored, AS_OF, 2).select(F.input_file_name()).distinct().collect()}
    assert days <= {str((AS_OF - timedelta(days=d)).date()) for d in range(3)}


@pytest.mark.parametrize("name", ["category_trend", "statistics_bundle"])
def test_statistics_share_one_scan(spark, sf_dir, name):
    """All parts read one table of counts, and no row gathers the cells of several categories."""
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\*\(\d+\) ColumnarToRow", text)) == 1  # scans that ran; planned ones carry no number
    assert "ReusedExchange" in text and "collect_set(category" not in text


def test_run_summary_counts_everything_at_once(spark, sf_dir):
    """One aggregate over items and results; no second grouping of the links."""
    text = plan(spark, sf_dir, "run_summary")
    assert len(re.findall("Exchange SinglePartition", text)) == 1


def test_account_pages_are_parsed_once(spark):
    from tidewatch.sources import files

    rows = [("a", i, '{"base_resp": {"ret": 0}, "app_msg_list": [{"title": "t", "link": "l"}]}') for i in range(3)]
    df = files.wechat_items(spark.createDataFrame(rows, "account string, page bigint, payload string").repartition(2))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Scan ExistingRDD", text)) == 1 and text.count("from_json") == 1


@pytest.mark.parametrize("name", ["stationary_window", "stationary_fallback"])
def test_stationarity_takes_no_speeds(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "percentile" not in text and "collect_list" not in text
