"""Operators against row-by-row models on random rows, including very uneven keys."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import analysis as A, dedup as D, filters, geocode, skew, tracks as T, upsert as U
from tidewatch.plans.views import AS_OF

NAMES = ["id", "mmsi", "vessel_name", "lat", "lng", "speed", "heading", "status_raw", "timestamp", "created_at"]


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def make_tracks(seed, vessels=25, hot=1500):
    """Vessels of very different length; vessel 0 holds most of the rows. Some positions are missing."""
    rnd, rows = random.Random(seed), []
    for v in range(vessels):
        lat, lng, t = 50.0 + v, 4.0 + v, AS_OF - timedelta(hours=rnd.choice([1, 2, 3, 30, 60]))
        step = rnd.choice([0.0, 0.00002, 0.0005, 0.01, 0.2])
        for _ in range(hot if v == 0 else rnd.randint(1, 40)):
            lost = rnd.random() < 0.1
            rows.append((len(rows), str(v), "n", None if lost else lat, None if lost else lng, rnd.choice([None, -1.0, 0.2, 3.0, 9.0]),
                         float(rnd.randint(0, 359)), "x", t, t))
            lat, lng = lat + rnd.uniform(-step, step), lng + rnd.uniform(-step, step)
            t -= timedelta(seconds=rnd.choice([0, 1, 60, 600, 7200, 7201]) if v else 20)
    rnd.shuffle(rows)
    return rows


def model_status(points, offline_hours):
    if not points:
        return None
    newest = points[-1]
    if AS_OF - newest["timestamp"] > timedelta(hours=offline_hours):
        return "offline", None
    good = [p for p in points if p["lat"] is not None]
    near = [p for p in good if p["timestamp"] >= newest["timestamp"] - timedelta(hours=2)]
    if len(near) >= 2:
        still = max(metres(near[-1]["lat"], near[-1]["lng"], p["lat"], p["lng"]) for p in near) <= 80
    elif len(good) >= 2:
        a, b = good[-1], good[-2]
        still = (a["timestamp"] - b["timestamp"]).total_seconds() >= 7200 and metres(a["lat"], a["lng"], b["lat"], b["lng"]) <= 80
    else:
        still = False
    if still:
        return "moored", 0.0
    speeds = []
    for a, b in zip(good, good[1:]):
        dt = (b["timestamp"] - a["timestamp"]).total_seconds()
        if dt > 0 and metres(a["lat"], a["lng"], b["lat"], b["lng"]) / dt <= 15:
            speeds.append(metres(a["lat"], a["lng"], b["lat"], b["lng"]) / dt)
    knots = [p["speed"] for p in points if p["speed"] is not None and p["speed"] >= 0]
    ms = statistics.median(speeds[-24:]) if speeds else statistics.median(knots) * 0.514444 if knots else None
    if ms is None:
        return "offline", None
    return ("moored" if ms < 0.3 else "dredging" if ms <= 3 else "underway"), ms / 0.514444


@pytest.mark.parametrize("seed,limit,salts", [(1, None, None), (2, 30, 4), (3, 30, 1)])
def test_vessel_status_model(spark, seed, limit, salts):
    rows = make_tracks(seed)
    df = spark.createDataFrame(rows, S.TRACK).repartition(7)
    got = {r.mmsi: (r.status, r.speed_kn) for r in T.vessel_status(df, AS_OF, 3, 24, limit, salts).collect()}
    want = {}
    for v in {r[1] for r in rows}:
        pts = [dict(zip(NAMES, r)) for r in rows if r[1] == v and AS_OF - timedelta(days=3) <= r[8] <= AS_OF]
        pts = sorted(pts, key=lambda p: (p["timestamp"], p["id"]))[-(limit or 0):]
        if pts:
            want[v] = model_status(pts, 24)
    assert got.keys() == want.keys()
    for v in want:
        assert got[v][0] == want[v][0], v
        assert got[v][1] == pytest.approx(want[v][1], rel=1e-6) if want[v][1] is not None else got[v][1] is None


def test_slow_drift_is_moored_by_speed(spark):
    """Drifts beyond 80 m in two hours, yet slower than 0.3 m/s."""
    rows = [(i, "9", "n", 50.0 + i * 0.0003, 4.0, None, 0.0, "x", AS_OF - timedelta(minutes=30 * (5 - i)), AS_OF) for i in range(6)]
    r = T.vessel_status(spark.createDataFrame(rows, S.TRACK), AS_OF).first()
    assert r.status == "moored" and 0 < r.speed_kn < 0.6


@pytest.mark.parametrize("gap,want", [(7200, "moored"), (7199, "underway")])
def test_two_points_two_hours_apart(spark, gap, want):
    """Exactly two hours: both points are in the window. The first case drifts little, the second far."""
    far = 0.0 if want == "moored" else 0.5
    rows = [(0, "9", "n", 50.0 + far, 4.0, None, 0.0, "x", AS_OF - timedelta(seconds=gap), AS_OF), (1, "9", "n", 50.0, 4.0, None, 0.0, "x", AS_OF, AS_OF)]
    assert T.vessel_status(spark.createDataFrame(rows, S.TRACK), AS_OF).first().status == want


def test_offline_is_strictly_older(spark):
    rows = [(0, "a", "n", 1.0, 1.0, 5.0, 0.0, "x", AS_OF - timedelta(hours=2), AS_OF),
            (1, "b", "n", 1.0, 1.0, 5.0, 0.0, "x", AS_OF - timedelta(hours=2, seconds=1), AS_OF)]
    got = {r.mmsi: r.status for r in T.vessel_status(spark.createDataFrame(rows, S.TRACK), AS_OF).collect()}
    assert got == {"a": "dredging", "b": "offline"}


@pytest.mark.parametrize("n,salts", [(1, 1), (3, 5), (50, 4), (5000, None)])
def test_top_n_is_exact_and_bounded(spark, n, salts):
    rnd = random.Random(n)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 50)}", rnd.randint(0, 99)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, k string, v int")
    for parts in (1, 50):
        got = sorted(r.id for r in skew.top_n_per_key(df.repartition(parts), ["k"], [F.desc("v"), F.desc("id")], n, ["id"], salts).collect())
        want = []
        for k in {r[1] for r in rows}:
            want += [r[0] for r in sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], -r[0]))[:n]]
        assert got == sorted(want)


@pytest.mark.parametrize("bucket", [1, 60, 3600, 10**7])
def test_previous_row_across_buckets(spark, bucket):
    rows = make_tracks(5, vessels=6, hot=400)
    df = spark.createDataFrame(rows, S.TRACK).select("id", "mmsi", "timestamp", "lat")
    got = {r.id: (r.prev.timestamp if r.prev else None) for r in skew.with_previous(df, "mmsi", "timestamp", "id", ["lat"], bucket).collect()}
    want = {}
    for v in {r[1] for r in rows}:
        pts = sorted(((r[8], r[0]) for r in rows if r[1] == v))
        want.update({b[1]: a[0] for a, b in zip(pts, pts[1:])})
        want[pts[0][1]] = None
    assert got == want


@pytest.mark.parametrize("tasks", [1, 7, 64])
def test_previous_row_by_range(spark, tasks):
    """Keys that span many tasks, several keys in one task, ties in time, empty keys and times, no rows."""
    rows = [(r[0], r[1] if r[1] != "3" else None, r[8] if r[0] % 11 else None, r[3]) for r in make_tracks(7, vessels=12, hot=600)]
    df = spark.createDataFrame(rows, "id bigint, mmsi string, timestamp timestamp_ntz, lat double")
    got = {r.id: (r.prev.timestamp, r.prev.lat) if r.prev else None for r in skew.ranged_previous(df, "mmsi", "timestamp", "id", ["lat"], tasks).collect()}
    want = {}
    for v in {r[1] for r in rows}:
        pts = sorted((r for r in rows if r[1] == v), key=lambda r: (r[2] or datetime.min, r[0]))
        want.update({b[0]: (a[2], a[3]) for a, b in zip(pts, pts[1:])})
        want[pts[0][0]] = None
    assert got == want
    none = skew.ranged_previous(df.where("id < 0"), "mmsi", "timestamp", "id", ["lat"], tasks)
    assert none.collect() == [] and none.columns == [*df.columns, "prev"]


def test_three_million_points_in_one_hour(spark):
    """One vessel's hot hour spreads over all tasks, and its length is that of the steps in their order."""
    n = 3_000_000
    at = F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") / F.lit(1000)).cast("decimal(18,6)"))
    hot = spark.range(n).select("id", F.lit("hot").alias("mmsi"), at.alias("timestamp"), (F.col("id") % 1000 / 1e5).alias("lat"), F.lit(0.0).alias("lng"))
    tasks = skew.dealt_by_range(hot, ["mmsi", "timestamp", "id"], 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and max(r[1] for r in tasks) < 2 * n / 8
    got = T.path_length(hot, by_range=True).first()
    up, back = metres(0.0, 0.0, 1e-5, 0.0), metres(999e-5, 0.0, 0.0, 0.0)
    assert got.total_m == pytest.approx(up * (n - n // 1000) + back * (n // 1000 - 1), rel=1e-6)
    assert got.last_step_m == pytest.approx(up, rel=1e-6)


def test_path_length_model(spark):
    rows = make_tracks(6, vessels=8, hot=500)
    got = {r.mmsi: r.total_m for r in T.path_length(spark.createDataFrame(rows, S.TRACK), 600).collect()}
    ranged = {r.mmsi: r.total_m for r in T.path_length(spark.createDataFrame(rows, S.TRACK), by_range=True).collect()}
    assert ranged == pytest.approx(got, rel=1e-9, abs=1e-6)
    for v in got:
        pts = [r for r in sorted((r for r in rows if r[1] == v), key=lambda r: (r[8], r[0])) if r[3] is not None]
        assert got[v] == pytest.approx(sum(metres(a[3], a[4], b[3], b[4]) for a, b in zip(pts, pts[1:])), rel=1e-9, abs=1e-6)


def test_nearest_place_everywhere(spark):
    """Poles, date line, empty oceans, and a crowd of places around one spot."""
    rnd = random.Random(4)
    places = [(f"p{i}", "a", f"{i % 7}", "c", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(150)]
    places += [(f"q{i}", "a", "0", "c", 51 + rnd.uniform(-.3, .3), 4 + rnd.uniform(-.3, .3)) for i in range(150)]
    points = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(250)]
    points += [(1000 + i, 51 + rnd.uniform(-.4, .4), 4 + rnd.uniform(-.4, .4)) for i in range(150)]
    points += [(2000, 89.99, 10.0), (2001, -89.99, -170.0), (2002, 10.0, 179.99), (2003, 10.0, -179.99), (2004, 0.0, 5.0)]
    gaz = spark.createDataFrame(places, "place string, admin1 string, cc string, continent string, lat double, lng double")
    got = {r.id: r for r in geocode.reverse_geocode(spark.createDataFrame(points, "id int, lat double, lng double"), gaz).collect()}
    assert len(got) == len(points)
    for i, lat, lng in points:
        if i == 2004:
            assert got[i].city == "" and got[i].country == ""
            continue
        best = min(metres(lat, lng, p[4], p[5]) for p in places)
        assert got[i].place_distance_m == pytest.approx(best, abs=0.01)


def test_far_cells_meet_few_places(spark):
    """Land, coast and open sea: a cell meets a small part of the places, before any filter."""
    n, h = 20_000, [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_000)) / 1_000_000 for k in (1, 2)]
    gaz = spark.range(n).select(F.concat(F.lit("p"), F.col("id")).alias("place"), F.lit("a").alias("admin1"), F.lit("c").alias("cc"),
                                F.lit("c").alias("continent"), (h[0] * 30 + 30).alias("lat"), (h[1] * 60).alias("lng"))
    cells = spark.createDataFrame([(450, 300), (299, 300), (100, -300)], "cell_lat bigint, cell_lng bigint")
    coarse = geocode._coarse_candidates(cells, geocode.index_places(gaz), geocode.LEVELS[0])
    met = geocode.met_in_parents(cells, coarse, 1, geocode.LEVELS[0]).groupBy("cell_lat").count().collect()
    assert len(met) == 3 and all(r["count"] < n * 0.1 for r in met), met


def test_unknown_country_code_keeps_the_code(spark):
    gaz = spark.createDataFrame([("X", "A", "NL", None, 52.0, 4.0), ("Y", "B", "ZZ", None, -10.0, 100.0)],
                                "place string, admin1 string, cc string, continent string, lat double, lng double")
    dim = spark.createDataFrame([("NL", "Netherlands", "EU"), ("QQ", "Nowhere", "?")], "cc string, country string, code string")
    dim = dim.select("cc", "country", geocode.continent_name(F.col("code")).alias("continent"))
    assert {r.cc: r.continent for r in dim.collect()} == {"NL": "Europe", "QQ": "Unknown"}
    pts = spark.createDataFrame([(1, 51.0, 4.0), (2, -9.0, 99.0)], "id int, lat double, lng double")
    got = {r.id: (r.country, r.continent) for r in geocode.reverse_geocode(pts, gaz, dim).collect()}
    assert got == {1: ("Netherlands", "Europe"), 2: ("ZZ", "Unknown")}


def test_disposition_is_the_sequential_loop(spark):
    rnd = random.Random(8)
    store = [(f"u{i}", rnd.choice([None, 0, 1]), rnd.choice([0, 1, None]), rnd.choice([None, "", "short", "a long summary"])) for i in range(20)]
    items = [(i, rnd.choice(["", "t", None]), "hot" if rnd.random() < .35 else f"u{rnd.randint(0, 30)}", rnd.choice(["", "2024-01-29", "2024-01-01", None]),
              rnd.choice(["rss", "web", "wechat", None]), rnd.choice([None, None, "nav"])) for i in range(600)]
    done = {u: v == 0 or r == 1 or (s is not None and len(s) > 5) for u, v, r, s in store}
    seen, want = set(), {}
    for seq, title, link, pub, kind, reason in items:
        if not title:
            want[seq], done[link] = "empty", True
            continue
        if link in seen:
            want[seq] = "duplicate"
            continue
        seen.add(link)
        if done.get(link):
            want[seq] = "processed"
        elif reason:
            want[seq] = "filtered"
        elif not pub:
            want[seq] = "pending" if kind == "web" else "no_date"
        else:
            want[seq] = "old" if pub < "2024-01-25" else "pending"
    s = spark.createDataFrame(store, "url string, valid int, is_retained int, summary_cn string")
    i = spark.createDataFrame(items, "seq bigint, title string, link string, pub_date string, source_type string, filtered_reason string")
    for parts in (1, 20):
        got = {r.seq: r.disposition for r in D.ingest_disposition(i.repartition(parts), s, AS_OF).collect()}
        assert got == want


STORE = ("id bigint, url string, title string, title_cn string, pub_date string, source_type string, source_name string, summary_cn string, "
         "category string, valid int, is_hidden int, is_retained int, remark string, created_at timestamp_ntz")
UPDATE = ("url string, seq bigint, title string, pub_date string, summary_cn string, category string, valid int, is_hidden int, is_retained int, "
          "remark string")


def sequential_upsert(store, updates):
    rows = {r[1]: dict(zip([c.split()[0] for c in STORE.split(", ")], r)) for r in store}
    names = [c.split()[0] for c in UPDATE.split(", ")]
    for u in sorted(updates, key=lambda u: u[1]):
        u = dict(zip(names, u))
        text = " ".join(u[c] or "" for c in ("title", "summary_cn")).lower()
        cat = {"news": "Market", "Bid": "Bid"}.get(u["category"]) or ("Bid" if "contract" in text else "Equipment" if "ship" in text else "Market")
        if u["url"] in rows:
            row = rows[u["url"]]
            for c in ("title", "pub_date", "summary_cn", "remark"):
                row[c] = u[c] or row[c]
            for c in ("valid", "is_hidden", "is_retained"):
                row[c] = row[c] if u[c] is None else u[c]
            row["category"] = cat
        else:
            stale = bool(u["pub_date"]) and (AS_OF - datetime.fromisoformat(u["pub_date"])).days > 30
            rows[u["url"]] = dict(url=u["url"], title=u["title"] or "", pub_date=u["pub_date"] or "", summary_cn=u["summary_cn"] or "", category=cat,
                                  valid=0 if stale else 1 if u["valid"] is None else u["valid"], is_hidden=int(stale),
                                  is_retained=u["is_retained"] or 0, remark="过期" if stale else u["remark"] or "")
    return {k: tuple(v[c] for c in ("title", "pub_date", "summary_cn", "category", "valid", "is_hidden", "is_retained", "remark")) for k, v in rows.items()}


def random_updates(rnd, n):
    pick = rnd.choice
    return [("hot" if rnd.random() < .3 else f"u{rnd.randint(0, 25)}", i, pick(["", None, "contract", "ship x", "zz"]), pick(["", None, "2024-01-20", "2023-11-01"]),
             pick(["", None, "sum"]), pick([None, "", "news", "Bid", "Other"]), pick([None, 0, 1]), pick([None, 0, 1]), pick([None, 0, 1]),
             pick(["", None, "r1", "r2"])) for i in range(n)]


def test_upsert_is_the_sequential_loop_and_folds(spark):
    rnd = random.Random(3)
    store = [(i, f"u{i}", "old", None, "2024-01-02", "rss", "s", None, None, 1, 0, 0, None, AS_OF) for i in range(12)]
    updates = random_updates(rnd, 400)
    s = spark.createDataFrame(store, STORE)
    u = spark.createDataFrame(updates, UPDATE)
    cols = ["title", "pub_date", "summary_cn", "category", "valid", "is_hidden", "is_retained", "remark"]
    whole = U.upsert_articles(s, u.repartition(9), AS_OF)
    got = {r.url: tuple(r[c] for c in cols) for r in whole.collect()}
    assert got == sequential_upsert(store, updates)
    halves = U.upsert_articles(U.upsert_articles(s, u.where("seq < 170"), AS_OF), u.where("seq >= 170"), AS_OF)
    assert {r.url: tuple(r[c] for c in cols) for r in halves.collect()} == got
    again = U.upsert_articles(whole, u.where("seq >= 170"), AS_OF)
    assert {r.url: r.title for r in again.collect()} == {r.url: r.title for r in whole.collect()}


def test_category_only_if_given(spark):
    s = spark.createDataFrame([(1, "a", "t", None, "", "rss", "s", None, "Bid", 1, 0, 0, None, AS_OF)], STORE)
    u = spark.createDataFrame([("a", 1, None, None, None, None, 1, None, None, None)], UPDATE)
    assert U.upsert_articles(s, u, AS_OF).first().category == "Market"
    assert U.upsert_articles(s, u, AS_OF, category_only_if_given=True).first().category == "Bid"


def test_ship_import_keeps_speed(spark):
    reg = spark.createDataFrame([(1, "i", "m", "old", 5.0, 90.0, AS_OF)], "id bigint, imo string, mmsi string, name string, speed double, heading double, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, 1, "a", 7.0), (1, 2, "b", 8.0), (2, 3, "c", 1.0), (2, 4, "d", 2.0)], "id bigint, seq bigint, name string, speed double")
    got = {r.id: (r.name, r.speed, r.imo) for r in U.upsert_ships(reg, new, AS_OF).collect()}
    assert got == {1: ("b", 5.0, None), 2: ("d", 1.0, None)}


def test_first_rows_do_not_depend_on_partitions(spark):
    rnd = random.Random(2)
    rows = [(i, f"u{i}", "Market" if i % 2 else "Bid", f"公司 t{rnd.randint(0, 9)}", None, None, AS_OF - timedelta(hours=rnd.randint(0, 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, url string, category string, title string, title_cn string, summary_cn string, created_at timestamp_ntz")
    one, many = (sorted(r.id for r in D.dedup_market_titles(df.repartition(n)).collect()) for n in (1, 40))
    assert one == many and len(one) == 150 + 10
    assert [r.id for r in D.title_dedup_top(df.repartition(3)).collect()] == [r.id for r in D.title_dedup_top(df).collect()]


def test_text_result_first_then_image(spark):
    art = "id bigint, url string, title string, pub_date string, source_type string, source_name string, content string, screenshot_path string"
    rows = [(i, f"u{i}", "A proper title", "2024-01-29", "web", "x", "body", "a.jpg") for i in range(6)] + [(9, "u9", "Cookie notice", "", "web", "x", "", "")]
    t = lambda junk, pub="": (junk, "Bid", "文", "s", "full", pub, None)
    im = lambda junk: (junk, "Project", "图", None, None, "2024-01-28", "img")
    res = [("u0", t(False), im(False)), ("u1", t(False, "2024-01-30"), im(True)), ("u2", t(True), im(False)), ("u3", t(True), im(True)),
           ("u4", None, None), ("u5", None, im(False)), ("u9", t(False), None)]
    st = f"STRUCT<{A._ddl_fields()}>"
    got = {r.id: r for r in A.merge_results(spark.createDataFrame(rows, art),
                                            spark.createDataFrame(res, f"url string, text_res {st}, vl_res {st}")).collect()}
    assert [got[i].way for i in (0, 1, 2, 3, 4, 5, 9)] == ["text", "text", "image", "junk", "failed", "image", "junk_title"]
    assert got[0].pub_date == "2024-01-28" and got[0].image_desc == "img" and got[0].category == "Bid"
    assert got[1].pub_date == "2024-01-30" and got[1].image_desc == ""
    assert got[2].title_cn == "图" and got[2].full_text_cn == "" and got[2].summary_cn == "暂无摘要"
    assert got[3].is_junk and got[3].title_cn == "图" and got[3].image_desc == "img"
    assert got[4].remark == "分析失败" and got[4].title_cn == "A proper title"
    assert not got[9].is_junk and got[9].valid == 0


def test_checkpointed_ingest_is_the_same(spark, sf_dir):
    from tidewatch.plans import jobs
    from tidewatch.plans.views import Views
    from tidewatch.session import scratch_dir

    v = Views(spark, sf_dir)
    scratch_dir(spark, "x")  # makes sure the test session has a checkpoint folder
    plain, stored = (jobs.ingest(v.raw_items, v.store, AS_OF, store_once=c)["store"] for c in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, stored.collect()))


def test_written_report(spark, sf_dir):
    from tidewatch.operators import reports as R
    from tidewatch.plans.views import Views

    few = Views(spark, sf_dir).articles.where("id < 12")
    text = "\n".join(r.line for r in R.report_document(few, AS_OF, "Harbour news").collect())
    assert text.startswith("# 🌏 Harbour news (2024-01-30 18:00)") and text.count("### [") == few.count()
    sections = [line for line in text.split("\n") if line.startswith("## ")]
    assert len(sections) == len(set(sections))
    assert text.index("分析概况") < text.index("### [")


def test_status_update_runs_on_its_own_output(spark, sf_dir):
    from tidewatch.operators import fleet
    from tidewatch.plans.views import Views

    v = Views(spark, sf_dir)
    once = fleet.fleet_status_update(v.ships, v.tracks, AS_OF, 10, 24)
    again = fleet.fleet_status_update(once, v.tracks, AS_OF, 10, 24)
    assert again.columns == once.columns and sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_long_track_is_read_whole(spark):
    """Ten thousand points of one vessel: medians and windows see all of them."""
    rows = [(i, "9", "n", 50.0 + i * 1e-5, 4.0, float(i % 7), 0.0, "x", AS_OF - timedelta(seconds=20 * (10_000 - i)), AS_OF) for i in range(10_000)]
    tracks = spark.createDataFrame(rows, S.TRACK)
    assert T.segment_speeds(T.recent_tracks(tracks, AS_OF)).count() == 9_999
    assert T.fallback_speed(T.recent_tracks(tracks, AS_OF)).first().speed_ms == pytest.approx(3 * 0.514444)
    assert T.vessel_status(tracks, AS_OF).first().status == "moored"


def test_fleet_job_runs_on_its_own_output(spark, sf_dir):
    from tidewatch.plans import jobs, track_queries as Q
    from tidewatch.plans.views import Views
    from tidewatch.sources import files

    v = Views(spark, sf_dir)
    payload = files.fleet_positions(Q.payloads(v))
    once = jobs.fleet_job(payload, v.ships, v.tracks, v.gazetteer, AS_OF, 10, 24)
    store = v.tracks.unionByName(once["new_tracks"])
    again = jobs.fleet_job(payload, once["ships"], store.dropDuplicates(["mmsi", "timestamp", "lat", "lng"]), v.gazetteer, AS_OF, 10, 24)
    key = lambda df: {r.id: (r.mmsi, r.location, r.country) for r in df.collect()}
    assert again["ships"].columns == once["ships"].columns and key(again["ships"]) == key(once["ships"])


def parquet_files(path):
    import os

    root = path.removeprefix("file:")
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def store_rows(spark, n):
    return spark.createDataFrame([(i, f"u{i}", "old", None, "", "rss", "s", None, None, 1, 0, 0, None, AS_OF) for i in range(n)], STORE)


def test_only_touched_buckets_are_written(spark):
    from tidewatch.operators import upsert as U
    from tidewatch.session import scratch_dir
    from tidewatch.sources import store as table

    store, path = store_rows(spark, 200), scratch_dir(spark, "store")
    updates = spark.createDataFrame(random_updates(random.Random(5), 4), UPDATE)
    table.write(store, path, 64)
    before = parquet_files(path)
    table.upsert(spark, path, updates, AS_OF)
    assert len(before & parquet_files(path)) >= len(before) - 4 and before != parquet_files(path)
    want = U.upsert_articles(store, updates, AS_OF)
    got = table.read(spark, path).select(*want.columns)
    assert sorted(map(str, got.drop("id").collect())) == sorted(map(str, want.drop("id").collect()))


def test_store_keeps_its_layout(spark):
    from tidewatch.session import scratch_dir
    from tidewatch.sources import store as table

    path = scratch_dir(spark, "store")
    one = spark.createDataFrame([("u7", 1, "new", "", "", None, None, None, None, "")], UPDATE)
    with pytest.raises(ValueError, match="no store"):
        table.upsert(spark, path, one, AS_OF)
    table.write(store_rows(spark, 115), path, 64)
    with pytest.raises(ValueError, match="64 buckets, not 16"):
        table.upsert(spark, path, one, AS_OF, buckets=16)
    with pytest.raises(ValueError, match="64 buckets, not 16"):
        table.write(store_rows(spark, 3), path, 16)
    before = parquet_files(path)
    table.upsert(spark, path, one, AS_OF)
    changed = {f.rsplit("/", 2)[1] for f in before ^ parquet_files(path) if "/_jobs/" not in f}
    assert len(changed) == 1 and table.read(spark, path).count() == 115
    assert table.read(spark, path).where("url = 'u7'").first().title == "new"
    assert [table.buckets_for(n) for n in (0, 1, 100_000, 100_001, 250_000, 10**12)] == [1, 1, 1, 2, 4, 1 << 16]
    plan = table.touched(spark, path, one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_a_cut_off_write_is_finished_and_not_repeated(spark):
    from tidewatch.session import scratch_dir
    from tidewatch.sources import folders, store as table

    path = scratch_dir(spark, "store")
    table.write(store_rows(spark, 40), path, 4)
    updates = spark.createDataFrame([("new", 1, "n", "", "", None, 1, 1, 1, ""), ("u3", 2, "t", "", "", None, 0, None, None, "")], UPDATE)
    text = lambda: sorted(map(str, table.read(spark, path).collect()))
    plain = text()
    # staged as a whole, then the writer ended: half of the buckets are replaced
    rows = table.touched(spark, path, updates)
    table.write(table.upsert_articles(rows, updates, AS_OF), other := scratch_dir(spark, "other"), 4)
    spark.read.parquet(other).write.partitionBy("bucket").parquet(f"{path}/_staged_j1")
    table.recover(spark, path)
    once = text()
    assert once != plain and table.applied(spark, path, "j1") and "_staged_j1" not in folders.children(spark, path)
    table.upsert(spark, path, updates, AS_OF, job="j1")
    assert text() == once
    # a stage that was cut off goes
    spark.read.parquet(other).write.partitionBy("bucket").parquet(f"{path}/_staged_j2")
    folders.delete(spark, f"{path}/_staged_j2/_SUCCESS")
    table.recover(spark, path)
    assert text() == once and not table.applied(spark, path, "j2")


def test_jobs_write_through_the_store(spark, sf_dir):
    from tidewatch.plans import ingest_queries as Q, jobs
    from tidewatch.plans.views import Views
    from tidewatch.session import scratch_dir
    from tidewatch.sources import store as table

    v, path = Views(spark, sf_dir), scratch_dir(spark, "store")
    old = v.store.withColumn("remark", F.lit(None).cast("string"))
    table.write(old, path, 64)
    before = parquet_files(path)
    few = v.raw_items.where("seq < 4")
    out = jobs.ingest_into(spark, few, path, AS_OF)
    assert out.keys() == {"decided", "audit"} and out["decided"].count() == few.count()
    assert len(before - parquet_files(path)) <= 4
    whole = jobs.ingest(few, old, AS_OF)["store"].select(*old.columns)
    text = lambda df: sorted(map(str, df.drop("id").collect()))
    assert text(table.read(spark, path).select(*old.columns)) == text(whole)
    table.write(v.articles, other := scratch_dir(spark, "articles"), 16)
    both = (jobs.analyse_into(spark, other, v.analysis, v.raw_items, Q.audit(v), AS_OF) if hasattr(Q, "audit") else None)
    assert both is None or both.keys() == {"merged", "gated", "audit"}


def test_newest_speeds_and_gaps_against_plain_rules(spark):
    """Vessel facts with rows without a position, hot hours and gaps of empty hours."""
    import numpy as np
    import pandas as pd

    from tidewatch.operators import tracks as T
    from tidewatch.streaming.tracks import _measured

    r = random.Random(11)
    rows = []
    for vessel in range(6):
        at = AS_OF - timedelta(hours=60)
        for i in range(r.choice([1, 2, 40, 160])):
            at += timedelta(seconds=r.choice([0, 5, 60, 600, 9000]))
            lat, lng = (None, None) if r.random() < 0.2 else (30 + r.random() / 50, 120 + r.random() / 50)
            rows.append((vessel * 1000 + i, str(vessel), lat, lng, r.choice([None, -1.0, 3.5, 7.0]), 90.0, at))
    df = spark.createDataFrame(rows, "id long, mmsi string, lat double, lng double, speed double, heading double, timestamp timestamp_ntz").repartition(5)
    for f in T._facts(df, 2, 80, 2).collect():
        mine = sorted((x[6], x[0], x) for x in rows if x[1] == f.mmsi)
        want = _measured(np.array([pd.Timestamp(t).value // 1000 for t, _, _ in mine]), np.array([[np.nan if v is None else v for v in x[2:6]] for _, _, x in mine], float), 2)
        for name in ("_in_window", "_drift", "_step_m", "_gap_s", "_median_ms", "_median_kn"):
            assert (f[name] is None) == (want[name] is None) and (want[name] is None or f[name] == pytest.approx(want[name], rel=1e-6, abs=1e-6)), (f.mmsi, name)


def track_points(spark, rows):
    return spark.createDataFrame([(i, m, None if t is None else AS_OF + timedelta(minutes=t)) for i, m, t in rows], "id long, mmsi string, timestamp timestamp_ntz")


def test_track_store_rewrites_what_loses_points(spark):
    """Only folders with points too old change; ties, no vessel and no time have defined results."""
    from tidewatch.session import scratch_dir
    from tidewatch.sources import track_store

    path = scratch_dir(spark, "track_store")
    first = [(i, "long", i) for i in range(30)] + [(100 + i, f"v{i}", i) for i in range(40)] + [(200 + i, None, i) for i in range(9)] + [(300, "long", None)]
    second = [(400 + i, "long", 100 + i % 3) for i in range(6)] + [(500 + i, f"v{i}", 50) for i in range(40)]
    track_store.append(track_points(spark, first), path, "007", 8)
    track_store.append(track_points(spark, second), path, "2024-01-30")
    track_store.append(track_points(spark, second), path, "2024-01-30")
    whole = first + second
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    before, rows = files(), lambda: sorted((r.id, r.mmsi) for r in track_store.read(spark, path).collect())
    assert len(rows()) == len(whole)
    for keep in (10, 4):
        track_store.retain(spark, path, keep)
        got = sorted(r.id for r in track_store.read(spark, path).collect())
        cut = T.track_retention(track_points(spark, whole).where("mmsi is not null"), keep)
        assert got == sorted([r.id for r in cut.collect()] + [i for i, m, _ in whole if m is None])
    after = files()
    place = lambda name: name.split("/bucket=")[1].split("/")[0]
    changed = {place(x) for x in before ^ after}
    assert len(changed) == 1 and len({place(x) for x in before}) > 4
    track_store.retain(spark, path, 4)
    assert files() == after
    # all points of the vessel's first run are gone; its folder holds other vessels' points or is gone as well
    track_store.retain(spark, path, 1)
    assert len(rows()) == 41 + 9
    for wrong in ("", "a/b", "x y"):
        with pytest.raises(ValueError):
            track_store.append(track_points(spark, first), path, wrong)


def test_track_store_finishes_a_writer_that_ended(spark, monkeypatch):
    """A writer may end after the stage, inside the overwrite, or before the stage is whole."""
    from tidewatch.session import scratch_dir
    from tidewatch.sources import folders, track_store

    path = scratch_dir(spark, "track_store")
    track_store.append(track_points(spark, [(i, "a", i) for i in range(5)]), path, "one", 4)
    track_store.append(track_points(spark, [(10 + i, "a", 10 + i) for i in range(5)]), path, "two")
    ids = lambda: sorted(r.id for r in track_store.read(spark, path).collect())
    with monkeypatch.context() as m:
        m.setattr(track_store, "recover", lambda *a: None)
        track_store.retain(spark, path, 3)
    assert ids() == [*range(5), *range(10, 15)]
    with monkeypatch.context() as m:  # ends before the emptied folder of the first run goes
        m.setattr(folders, "delete", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            track_store.recover(spark, path)
    track_store.recover(spark, path)
    assert ids() == [12, 13, 14]
    track_points(spark, [(99, "z", 1)]).withColumn("bucket", F.lit(0)).withColumn("run_id", F.lit("r-x")).write.partitionBy("bucket", "run_id").parquet(f"{path}/_staged_cut/points")
    track_store.append(track_points(spark, [(20, "a", 20)]), path, "three")
    assert ids() == [12, 13, 14, 20] and "_staged_cut" not in folders.children(spark, path)


def test_pages_after_a_row_give_every_row_once(spark):
    """Empty times and dates come last, as on numbered pages."""
    rnd = random.Random(9)
    rows = [(rnd.choice([None, AS_OF, AS_OF + timedelta(hours=1)]), rnd.choice([None, "", "2024-01-01", "2024-01-02"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, pub_date string, id long")
    want = [r.id for r in filters.page_of(df, 1, 100).collect()]
    got, page = [], filters.page_of(df, 1, 17).collect()
    while page:
        got += [r.id for r in page]
        page = filters.page_after(df, *page[-1], page_size=17).collect()
    assert got == want and len(got) == 60
