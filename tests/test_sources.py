"""Readers, sinks and page extraction on hand-written input."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import stats
from tidewatch.plans.views import AS_OF
from tidewatch.session import scratch_dir
from tidewatch.sources import files, pages as P, sinks

PAGE = """<html><head><title>T</title><meta name="date" content="x 2024.3.9 y"></head><body><nav><a href="/press/one">A headline that is long enough</a>
<a href="/press/one">A headline that is long enough again</a><a href="x.html">short</a><a href="mailto:a@b.c">Write to the whole editorial office</a></nav>
<div class="wide post-content x"><p>{body}</p><script>var a = "<p>no</p>";</script></div></body></html>"""


def page_df(spark, body="word " * 60):
    return spark.createDataFrame([(1, "https://h.x/dir/p", PAGE.replace("{body}", body))], "page_id bigint, url string, html string")


def test_page_extraction(spark):
    df = page_df(spark)
    assert P.extract_content(df).first().content == ("word " * 60).strip()
    assert P.extract_content(df, max_chars=10).first().content == "word word "
    assert P.extract_page_date(df).first().pub_date == "2024-03-09"
    got = [(r.pos, r.title, r.url) for r in P.extract_links(df).collect()]
    assert got == [(0, "A headline that is long enough", "https://h.x/press/one")]
    short = P.extract_content(page_df(spark, "few")).first().content
    assert short.endswith("few") and "no" not in short.split()


def test_site_links_fall_back(spark):
    df = page_df(spark)
    assert [r.url for r in P.extract_links_custom(df, include=["h.x"]).collect()] == ["https://h.x/press/one"]
    inside = P.extract_links_custom(df, include=["h.x"], selectors=["nav"])
    assert [r.url for r in inside.collect()] == ["https://h.x/press/one"]


def hand_page(spark, html):
    return spark.createDataFrame([(1, "https://h.x/dir/p", html)], "page_id bigint, url string, html string")


def test_nested_and_repeated_containers(spark):
    main = "main words " * 30
    df = hand_page(spark, f'<body><div class="content"><div>intro</div><p>{main}</p></div><div class=content>second</div></body>')
    assert P.extract_content(df).first().content == f"intro\n{main.strip()}"
    link = '<div class="card"><a href="/press/{0}">Headline number {0} of the day</a></div>'
    df = hand_page(spark, "".join(link.format(i) for i in range(3)))
    assert [r.url for r in P.extract_links_custom(df, include=["h.x"]).collect()] == [f"https://h.x/press/{i}" for i in range(3)]
    df = hand_page(spark, '<div class="latest-news-box"><a href="/press/a">A headline that is long enough</a></div><a href="/b">Another headline, outside of it</a>')
    assert [r.url for r in P.extract_links_custom(df, include=["h.x"]).collect()] == ["https://h.x/press/a"]


@pytest.mark.parametrize("href", ["'/press/one'", '"/press/one"', "/press/one"])
def test_every_quote_style(spark, href):
    df = hand_page(spark, f"<body><a class=x href={href}>It&#8217;s a headline &amp; long enough</a>")
    assert [(r.title, r.url) for r in P.extract_links(df).collect()] == [("It’s a headline & long enough", "https://h.x/press/one")]


def test_dates_in_any_attribute_order(spark):
    df = hand_page(spark, "<head><meta name=date content='no date'><meta content='2024-1-5T08:00Z' property='article:published_time'></head><time datetime=2023/1/1>")
    assert P.extract_page_date(df).first().pub_date == "2024-01-05"
    assert P.extract_page_date(hand_page(spark, "<time datetime='soon'><time datetime=2023/1/1>")).first().pub_date == "2023-01-01"
    assert P.extract_page_date(hand_page(spark, None)).first().pub_date == ""


def test_source_config_file(spark, tmp_path):
    entries = [{"name": "A", "url": "u", "type": "rss"}, {"url": "nameless"}, {"name": "W1", "type": "wechat", "fakeid": "f"},
               {"name": "W2", "type": "wechat", "fakeid": "f"}, {"name": "B", "max_links": 3, "blacklist": ["/x"]}]
    (tmp_path / "sources.json").write_text(json.dumps(entries))
    got = {r.name: r for r in files.read_source_config(spark, str(tmp_path / "sources.json")).collect()}
    assert set(got) == {"A", "W1", "B"}
    assert got["A"].selector == "body" and got["A"].max_links == 10 and got["A"].blacklist == []
    assert got["B"].type == "web" and got["B"].max_links == 3 and got["B"].blacklist == ["/x"]


def test_vessel_csv(spark, tmp_path):
    text = "序号,MMSI,IMO,船名,公司,船舶类型,区域,位置,目前状态,日期,备注\n1,413000001.0,,浚洋1, 上航局 ,耙吸,华东,上海,施工,2024/1/2,\n2,,9.5x,nan,,,,,,,\n,41,9000001, B ,nan,,,,,,好\n"
    (tmp_path / "v.csv").write_bytes(text.encode("gbk"))
    got = files.read_vessel_csv(spark, str(tmp_path / "v.csv")).collect()
    assert [(r.id, r.mmsi, r.imo, r.name, r.company, r.country, r.remarks) for r in got] == [
        (1, "413000001", None, "浚洋1", "上航局", "上海", ""), (None, "41", "9000001", "B", "", "", "好")]


def test_fleet_payload(spark):
    v = lambda mmsi, lat, **kw: {"mmsi": mmsi, "lat": lat, "lon": 4.0, **kw}
    rows = [(1, json.dumps({"result": "ok", "list": [v("a", 1.0), v("a", 2.0), v("", 9.0)]})), (2, json.dumps({"result": "no", "list": [v("b", 1.0)]})),
            (3, json.dumps({"result": "ok", "list": [v("c", 3.0, status="At anchor", updatetime="2024-01-01T00:00:00Z")]})), (4, "broken")]
    got = {r.mmsi: r for r in files.fleet_positions(spark.createDataFrame(rows, "batch int, payload string")).collect()}
    assert set(got) == {"a", "c"} and got["a"].lat == 2.0 and got["a"].status_raw == "Unknown" and got["a"].speed == 0.0
    assert str(got["c"].timestamp) == "2024-01-01 00:00:00" and got["c"].status_raw == "At anchor"


def test_audit_files(spark, tmp_path):
    from tidewatch.operators.reports import AUDIT_HEADER

    line = "| {} | s | t | 2024-01-01 | {} | 否 | 否 | Web | r | u |"
    (tmp_path / "20240102_080000.md").write_text("\n".join([*AUDIT_HEADER, line.format(1, "是"), "", line.format(2, "否")]) + "\n", encoding="utf-8")
    (tmp_path / "notes.md").write_text("\n".join(AUDIT_HEADER + [line.format(1, "是")]), encoding="utf-8")
    got = stats.run_history(files.read_audit_files(spark, str(tmp_path))).collect()
    assert [(r.run_id, r.searched, r.kept, r.summary) for r in got] == [("20240102_080000", 2, 1, "(搜2条，入1条)")]


def test_failed_account_page_stops_reading(spark):
    def page(ret, *titles):
        return json.dumps({"base_resp": {"ret": ret}, "app_msg_list": [{"title": t, "link": t, "update_time": 0} for t in titles]})

    rows = [("a", 0, page(0, "1", "2")), ("a", 1, page(-1)), ("a", 2, page(0, "3")), ("b", 0, page(0)), ("c", 5, page(0, "late"))]
    df = spark.createDataFrame(rows, "account string, page int, payload string")
    assert sorted((r.account, r.title) for r in files.wechat_items(df).collect()) == [("a", "1"), ("a", "2"), ("c", "late")]


def test_day_partitions_are_replaced(spark):
    path = scratch_dir(spark, "t")
    df = spark.range(10).select(F.col("id"), F.col("id").cast("string").alias("url"), F.lit("x").alias("title"),
                                (F.lit(str(AS_OF)).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("id") % 2).cast("int"))).alias("created_at"))
    sinks.write_articles(df, path)
    sinks.write_articles(df.where("id % 2 = 0").withColumn("title", F.lit("y")), path)
    got = sinks.read_table(spark, path)
    assert got.count() == 10 and got.where("title = 'y'").count() == 5


def test_scratch_follows_the_cluster_setting():
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/tmp/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert scratch_dir(Session(), "x").startswith("hdfs://shared/tmp/x-")


def test_scratch_refuses_a_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(RuntimeError):
        scratch_dir(Session(), "x")


def test_account_pages_stop_at_the_first_bad_one(spark):
    """Random replies against a plain loop: failed, empty and unreadable pages, cuts before, at and behind them."""
    import json
    import random

    rnd, rows, want = random.Random(3), [], {}
    for n in range(60):
        kind, at = f"a{n}", rnd.randint(0, 6)
        titles, stopped = [], False
        for page in range(rnd.randint(1, 6)):
            msgs = [{"title": f"{page}.{i}", "link": "l"} for i in range(rnd.randint(1, 4))]
            bad = page == at
            payload = rnd.choice([json.dumps({"base_resp": {"ret": 5}, "app_msg_list": msgs}), json.dumps({"base_resp": {"ret": 0}, "app_msg_list": []}),
                                  json.dumps({"base_resp": {"ret": 0}}), "no json", None]) if bad else json.dumps({"base_resp": {"ret": 0}, "app_msg_list": msgs})
            stopped |= bad
            titles += [] if stopped else [m["title"] for m in msgs]
            rows.append((kind, page, payload))
        want[kind] = titles[:5]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "account string, page bigint, payload string").repartition(5)
    got = {}
    for r in sorted(files.wechat_items(df, count=5).collect(), key=lambda r: (r.account, r.page, r.pos)):
        got.setdefault(r.account, []).append(r.title)
    assert got == {k: t for k, t in want.items() if t}



def test_pages_are_parsed_a_portion_at_a_time(spark):
    assert list(P._portions([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(P._portions([], 6)) == [] and list(P._portions([0, 0], 6)) == [(0, 2)] and list(P._portions([7], 6)) == [(0, 1)]
    rows = [(i, "https://h.x/", None if i % 7 == 0 else f"<p>{'word ' * (300_000 if i == 3 else 1)}{i}</p>") for i in range(40)]
    got = P.outline(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)).select("page_id", F.length("whole").alias("n")).collect()
    assert {r.page_id: r.n for r in got} == {i: 0 if h is None else len(h) - 7 + 2 for i, _, h in rows}



def test_feed_documents_share_files(spark, monkeypatch):
    """Files grow with the collected items, not with accounts."""
    from tidewatch.plans import source_queries as Q
    from tidewatch.plans.views import Views
    from tidewatch.sources import folders

    base, landed = scratch_dir(spark, "sample"), []
    rows = [(i, f"Title & <{i}>\nwords", "en", None if i == 5 else f"src {i % 40}", 20) for i in range(0, 12_000, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    monkeypatch.setattr(Q, "scratch_dir", lambda s, name: landed.append(scratch_dir(s, name)) or landed[-1])
    assert Q.read_feed_files(Views(spark, base)).select("summary_raw").distinct().count() == len(rows)
    files = [x for x in folders.children(spark, landed[0]) if x.startswith("part-")]
    assert 1 < len(files) <= 4
