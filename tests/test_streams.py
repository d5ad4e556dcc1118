"""Streams over many small files end where the batch operators end."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_rules import STORE, UPDATE, random_updates
from tidewatch import schemas as S
from tidewatch.operators import tracks as T, upsert as U
from tidewatch.plans.views import AS_OF, Views, tracks_from_events
from tidewatch.session import scratch_dir
from tidewatch.sources import folders
from tidewatch.streaming import articles as SA, seen, tracks as ST
from tidewatch.streaming.sinks import all_runs, fold, latest_per_key, next_fold, read_batches, run_path, runs


def land(spark, df, order, parts=5):
    """Write rows as files that arrive one after the other in order; returns the folder."""
    path = scratch_dir(spark, "land")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def open_stream(spark, path, schema, per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def places(spark):
    base = scratch_dir(spark, "s")
    return f"{base}/out", f"{base}/cp"


def test_daily_counts_over_batches(spark, sf_dir):
    arts = Views(spark, sf_dir).articles
    path, (out, cp) = land(spark, arts, F.xxhash64("id")), places(spark)
    SA.start_counts(open_stream(spark, path, arts.schema), SA.daily_counts, out, cp).awaitTermination()
    got = {r.day: r.articles for r in SA.read_counts(spark, out, ["day"]).collect()}
    want = arts.where("coalesce(is_hidden, 0) = 0 and coalesce(valid, 1) = 1").groupBy(F.to_date("created_at").alias("d")).count()
    assert got == {r.d: r["count"] for r in want.collect()}


def test_shift_digest_over_batches(spark, sf_dir):
    arts = Views(spark, sf_dir).articles
    path, (out, cp) = land(spark, arts, F.xxhash64("id")), places(spark)
    SA.start_counts(open_stream(spark, path, arts.schema), SA.shift_digest, out, cp).awaitTermination()
    got = SA.read_counts(spark, out, ["shift_start", "category"]).agg(F.sum("articles")).first()[0]
    assert got == arts.where("coalesce(is_hidden, 0) = 0 and coalesce(valid, 1) = 1 and is_retained = 1").count()


def test_links_stay_unique_over_batches(spark, sf_dir):
    v = Views(spark, sf_dir)
    path, (out, cp) = land(spark, v.raw_items, "seq"), places(spark)
    SA.start_article_dedup(open_stream(spark, path, v.raw_items.schema), v.store, out, cp).awaitTermination()
    links = [r.link for r in read_batches(spark, out).collect()]
    assert len(links) == len(set(links)) > 0
    assert read_batches(spark, out).join(v.store, F.col("link") == F.col("url"), "left_semi").count() == 0


def test_updates_log_equals_one_batch(spark):
    import random

    store = spark.createDataFrame([(i, f"u{i}", "old", None, "", "rss", "s", None, None, 1, 0, 0, None, AS_OF) for i in range(9)], STORE)
    updates = spark.createDataFrame(random_updates(random.Random(5), 200), UPDATE)
    path, (out, cp) = land(spark, updates, "seq"), places(spark)
    SA.start_updates_log(open_stream(spark, path, UPDATE), out, cp).awaitTermination()
    key = lambda df: sorted(map(str, df.drop("id").collect()))
    assert key(SA.current_store(spark, store, out, AS_OF)) == key(U.upsert_articles(store, updates, AS_OF))
    done = SA.compact(spark, store, out, scratch_dir(spark, "compact"), AS_OF)
    assert done.count() == U.upsert_articles(store, updates, AS_OF).count()


def test_restart_does_not_repeat_batches(spark):
    updates = spark.createDataFrame([("a", i, "t", "", "", None, None, None, None, "") for i in range(20)], UPDATE)
    path, (out, cp) = land(spark, updates, "seq"), places(spark)
    for _ in range(2):
        SA.start_updates_log(open_stream(spark, path, UPDATE), out, cp).awaitTermination()
    assert read_batches(spark, out).count() == 20


def test_vessel_status_of_shuffled_reports_equals_batch(spark, sf_dir):
    """Reports arrive in no order over five batches; each vessel is judged as in batch at its own newest point."""
    tracks = tracks_from_events(Views(spark, sf_dir).table("events"))
    path, (out, cp) = land(spark, tracks, F.xxhash64("id")), places(spark)
    ST.start_vessel_status(open_stream(spark, path, S.TRACK), out, cp, days=10, fold_every=3).awaitTermination()
    assert runs(spark, out)[0] == (0, 2) and len(runs(spark, out)) >= 3
    as_of = tracks.agg(F.max("timestamp")).first()[0]
    got = {r.mmsi: r for r in ST.current_status(spark, out, days=10, offline_hours=24).collect()}
    newest = {r.mmsi: r.t for r in tracks.groupBy("mmsi").agg(F.max("timestamp").alias("t")).collect()}
    assert got.keys() == {m for m, t in newest.items() if t >= as_of - timedelta(days=10)}
    for mmsi in sorted(got)[:5]:
        own = tracks.where((F.col("mmsi") == mmsi) & (F.col("timestamp") >= newest[mmsi] - timedelta(days=10)))
        want = T.vessel_status(own, as_of, 10_000, 24).first()
        assert got[mmsi].status == want.status and got[mmsi].status_date == want.status_date and got[mmsi].location == want.location
        assert got[mmsi].speed_kn == (want.speed_kn if want.speed_kn is None else pytest.approx(want.speed_kn, rel=1e-6))


def test_silent_vessels_leave_no_state(spark):
    start = AS_OF
    rows = [(1, "a", 1.0, 2.0, 3.0, 4.0, start), (2, "b", 1.0, 2.0, 3.0, 4.0, start + timedelta(days=5)), (3, "b", 1.0, 2.0, 3.0, 4.0, start + timedelta(days=10)),
            (4, "b", 1.0, 2.0, 3.0, 4.0, start + timedelta(days=10, hours=1)), (5, "a", 1.0, 2.0, None, None, start + timedelta(days=11))]
    schema = "id long, mmsi string, lat double, lng double, speed double, heading double, timestamp timestamp_ntz"
    path = scratch_dir(spark, "land")
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
    out, cp = places(spark)
    query = ST.start_vessel_status(open_stream(spark, path, schema), out, cp, days=2)
    query.awaitTermination()
    kept = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    assert kept
    facts = {r.mmsi: r for r in latest_per_key(read_batches(spark, out), ["mmsi"]).collect()}
    # the second report of `a` finds nothing left of the first: no step, one point
    assert facts["a"]._step_m is None and facts["a"]._in_window == 1 and facts["b"]._in_window == 2
    got = {r.mmsi: r.status for r in ST.current_status(spark, out, days=2, offline_hours=2).collect()}
    assert got == {"a": "offline", "b": "offline"} or set(got) == {"a", "b"}


def test_repeated_and_late_reports_count_once(spark):
    schema = "id long, mmsi string, lat double, lng double, speed double, heading double, timestamp timestamp_ntz"
    point = lambda i, minutes: (i, "a", 10.0, 20.0 + i / 1000, 1.0, 0.0, AS_OF + timedelta(minutes=minutes))
    path = scratch_dir(spark, "land")
    for batch in ([point(5, 500)], [point(1, 0), point(5, 500)], [point(3, 250), point(3, 250)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    out, cp = places(spark)
    ST.start_vessel_status(open_stream(spark, path, schema), out, cp).awaitTermination()
    last = latest_per_key(read_batches(spark, out), ["mmsi"]).first()
    assert last._gap_s == 250 * 60 and last.latest_ts == AS_OF + timedelta(minutes=500)


def test_seen_links_read_only_what_concerns_a_batch(spark):
    """However many batches there were, a batch looks into the buckets of its own links."""
    links = lambda *names: spark.createDataFrame([(x,) for x in names], "link string")
    index = seen.SeenLinks(spark, scratch_dir(spark, "seen"), per_bucket=8, fold_every=4)
    index.seed(spark.createDataFrame([(f"stored{i}",) for i in range(100)], "url string"))
    index.seed(spark.createDataFrame([("other",)], "url string"))  # written once
    read = []
    for batch in range(17):
        new = [f"b{batch}x{i}" for i in range(40)]
        ask = links(*new[:2], "stored7", f"b{batch // 2}x5")
        want = set(new[:2]) | ({f"b{batch // 2}x5"} if batch // 2 >= batch else set())
        assert {r.link for r in index.unseen(ask, batch).collect()} == want
        read.append(len(index.files(ask, batch)))
        for _ in range(1 + (batch == 5)):  # a repeated batch replaces itself
            index.add(links(*new), batch)
        if (batch + 1) % 4 == 0:
            index.fold(batch + 1)
            index.fold(batch + 1)
    assert len(runs(spark, index.path)) <= 3 and runs(spark, index.path)[0] == (-1, -1)
    # four links, at most a file for each in every run
    assert max(read) <= 4 * 8 and read[16] <= 4 * 2
    assert {r.link for r in index.unseen(links("b0x0", "b16x39", "new"), 17).collect()} == {"new"}


def test_folds_change_nothing_whenever_they_stop(spark):
    path = scratch_dir(spark, "runs")
    put = lambda i: spark.createDataFrame([("k", i, 1), (f"d{i % 3}", 0, 2)], "day string, shift int, articles long").write.parquet(run_path(path, i, i))
    total = lambda: {(r.day, r["shift"]): r.articles for r in SA.added(read_batches(spark, path)).collect()}
    for i in range(9):
        put(i)
    want = total()
    # a fold that has been written, but not swept: its parts are covered
    SA.added(spark.read.parquet(*[run_path(path, i, i) for i in range(3)])).write.parquet(run_path(path, 0, 2))
    assert total() == want and runs(spark, path)[0] == (0, 2) and (1, 1) in all_runs(spark, path)
    # a fold that was cut off has no marker
    spark.createDataFrame([("wrong", 1, 99)], "day string, shift int, articles long").write.parquet(run_path(path, 3, 5))
    folders.delete(spark, f"{run_path(path, 3, 5)}/_SUCCESS")
    assert total() == want
    fold(spark, path, 3, SA.added, before=9)
    assert total() == want and runs(spark, path) == [(0, 8)] and all_runs(spark, path) == [(0, 8)]
    assert fold(spark, path, 3, SA.added, before=9) == 0 and total() == want


def test_folders_stay_few(spark):
    found, most = [], 0
    for i in range(1000):
        found.append((i, i))
        while (due := next_fold(found, 10)) is not None:
            found = sorted([r for r in found if not (due[0] <= r[0] and r[1] <= due[1])] + [(due[0], due[1])])
        most = max(most, len(found))
    assert most <= 28 and found == [(0, 999)]


def test_counts_over_many_batches_are_folded(spark, sf_dir):
    arts = Views(spark, sf_dir).articles
    path, (out, cp) = land(spark, arts, F.xxhash64("id"), 7), places(spark)
    SA.start_counts(open_stream(spark, path, arts.schema), SA.daily_counts, out, cp, fold_every=3).awaitTermination()
    assert runs(spark, out) == [(0, 2), (3, 5), (6, 6)]
    got = {r.day: r.articles for r in SA.read_counts(spark, out, ["day"]).collect()}
    want = arts.where("coalesce(is_hidden, 0) = 0 and coalesce(valid, 1) = 1").groupBy(F.to_date("created_at").alias("d")).count()
    assert got == {r.d: r["count"] for r in want.collect()}


def test_log_is_applied_to_the_stored_table(spark):
    import random

    from tidewatch.sources import store as table

    store = spark.createDataFrame([(i, f"u{i}", "old", None, "", "rss", "s", None, None, 1, 0, 0, None, AS_OF) for i in range(9)], STORE)
    updates = spark.createDataFrame(random_updates(random.Random(5), 60), UPDATE)
    path, (out, cp) = land(spark, updates, "seq"), places(spark)
    table.write(store, kept := scratch_dir(spark, "kept"), 4)
    assert SA.apply_log(spark, kept, out, AS_OF) == -1
    SA.start_updates_log(open_stream(spark, path, UPDATE), out, cp, fold_every=3).awaitTermination()
    want = sorted(map(str, U.upsert_articles(store, updates, AS_OF).drop("id").collect()))
    for _ in range(2):
        assert SA.apply_log(spark, kept, out, AS_OF) == 4
        assert sorted(map(str, table.read(spark, kept).select(*store.columns).drop("id").collect())) == want


def test_track_ingest_over_batches(spark, sf_dir):
    v = Views(spark, sf_dir)
    path, (out, cp) = land(spark, v.tracks, "id", 3), places(spark)
    ST.start_track_ingest(open_stream(spark, path, S.TRACK), v.gazetteer, out, cp).awaitTermination()
    rows = read_batches(spark, out)
    assert rows.count() == v.tracks.count() and rows.where("city = ''").count() == 0



def sample_documents(spark, ids):
    """A sample folder with documents of the given ids only."""
    base = scratch_dir(spark, "sample")
    rows = [(i, f"Title {i}\nwords of {i}", "en", f"src{abs(i) % 20}", 20) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    return base



def test_article_dedup_keeps_the_first_item_of_all_batches(spark):
    from tidewatch.plans.registry import QUERIES
    import tidewatch.plans.catalog  # noqa: F401

    # 7k + 6 repeats the link of 7k + 3, far apart in a file that holds the later ones first
    base = sample_documents(spark, [7 * k + 6 for k in range(0, 60)] + [7 * k + 3 for k in range(59, -1, -1)])
    got = {r.seq: r.times for r in QUERIES["stream_article_dedup"](spark, base).collect()}
    assert got == {7 * k + 3: 1 for k in range(60) if (7 * k + 3) % 3 == 2}



def test_arriving_files_follow_the_table(spark, monkeypatch):
    """More files for a larger table, in four batches all the same; by a column, no file holds less than one before it."""
    from tidewatch.plans import stream_queries as Q

    base = sample_documents(spark, range(4000))
    landed = []
    monkeypatch.setattr(Q, "scratch_dir", lambda s, name: landed.append(scratch_dir(s, name)) or landed[-1])
    monkeypatch.setattr(Q, "FILE_BYTES", 1 << 11)
    for order in (None, "doc_id"):
        rows, (out, cp) = Q.documents(Views(spark, base), order), places(spark)
        SA.start_updates_log(rows.selectExpr("cast(doc_id as string) as url", "doc_id as seq"), out, cp).awaitTermination()
        assert len([x for x in folders.children(spark, landed[-1]) if x.startswith("part-")]) > 8
        per_batch = read_batches(spark, out).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("batch_id").collect()
        assert 2 <= len(per_batch) <= 4 and sum(r.n for r in per_batch) == 4000
        if order:
            assert all(x.b < y.a for x, y in zip(per_batch, per_batch[1:]))



def test_vessel_state_is_a_few_chunks(spark):
    schema = "id long, mmsi string, lat double, lng double, speed double, heading double, timestamp timestamp_ntz"
    rows = [(i, "a", 10.0, 20.0 + i / 1000, 1.0, None, AS_OF + timedelta(minutes=20 * i)) for i in range(400)]
    path, (out, cp) = land(spark, spark.createDataFrame(rows, schema), "id"), places(spark)
    query = ST.start_vessel_status(open_stream(spark, path, schema), out, cp)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"] and p["numInputRows"]]
    assert held and max(held) <= 12
    last = latest_per_key(read_batches(spark, out), ["mmsi"]).first()
    assert last.latest_ts == rows[-1][-1] and last._in_window == 7 and last.heading is None and last._gap_s == 1200
