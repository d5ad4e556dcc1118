"""Hand-written rows for the column functions."""

from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewatch import vocab as V
from tidewatch.functions import categories as C, dates as D, geo as G, labels as L, text as T, urls as U
from tidewatch.operators import analysis as A


def run(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("r")).collect()]


def test_normalize_url(spark):
    table = {
        "https://a.b/c?utm_source=x&id=1#top": "https://a.b/c?id=1", "https://a.b/c?UTM_x=1": "https://a.b/c",
        "https://a.b/c?id=&gclid=2&b": "https://a.b/c?id=&b", "https://a.b/c#x": "https://a.b/c", "https://a.b/c": "https://a.b/c",
        "https://a.b/c?spm=1&&share=2": "https://a.b/c", "https://a.b/?reference=1": "https://a.b/?reference=1", "": "", None: None,
        "https://a.b/?q=what?": "https://a.b/?q=what?", "https://a.b/?q=x?utm_a=1": "https://a.b/?q=x?utm_a=1", "https://a.b/c&ref=1": "https://a.b/c&ref=1",
        "https://a.b/?ref=1&": "https://a.b/", "https://a.b/?x=1&from=2": "https://a.b/?x=1",
    }
    assert run(spark, list(table), U.normalize_url) == list(table.values())


def test_normalize_url_strict_reencodes(spark):
    assert run(spark, ["http://x/?a&b=%7E*&c=a b&d=%E7%96%8F"], lambda c: U.normalize_url(c, strict=True)) == [
        "http://x/?a=&b=~%2A&c=a+b&d=%E7%96%8F"]


def plain_url(url):
    """The same rule pair by pair."""
    base, mark, query = url.split("#")[0].partition("?")
    pairs = [p for p in query.split("&") if p and not (p.split("=")[0].lower().startswith("utm_") or p.split("=")[0].lower() in V.TRACKING_PARAMS)]
    return base + ("?" + "&".join(pairs) if pairs else "")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "=", "&", "?", "#", "utm_x", "ref", "REF=1", "/", "é"]), max_size=9).map("".join), min_size=20, max_size=60))
def test_normalize_url_model(spark, tails):
    urls = ["https://h.example/" + t for t in tails]
    assert run(spark, urls, U.normalize_url) == [plain_url(u) for u in urls]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abutm_=&?#%/", max_size=25), min_size=5, max_size=20))
def test_normalize_url_is_idempotent(spark, tails):
    urls = ["https://h.example/" + t for t in tails]
    once = run(spark, urls, U.normalize_url)
    assert run(spark, once, U.normalize_url) == once


def test_pub_datetime(spark):
    table = {
        "2024-01-05": datetime(2024, 1, 5), "2024-01-05T10:00:00.123": datetime(2024, 1, 5, 10, 0, 0, 123000),
        "2024-01-05 10:00": datetime(2024, 1, 5, 10), "Tue, 05 Mar 2024 10:11:12 +0000": datetime(2024, 3, 5, 10, 11, 12),
        "Tue, 05 Mar 2024 10:11:12 GMT": datetime(2024, 3, 5, 10, 11, 12), "Fri, 5 Jan 2024 23:30:00 -0130": datetime(2024, 1, 6, 1),
        "2024-01-05T10:00:00Z": datetime(2024, 1, 5, 10), "2024年1月5日": None, "n/a": None, "": None, None: None,
        "2024-02-30": None, "Thursday": None, "2024-01-05 and more": datetime(2024, 1, 5), "2024-13-01 10:00": None,
    }
    assert run(spark, list(table), D.parse_pub_datetime) == list(table.values())
    assert run(spark, ["Tue, 05 Mar 2024 20:11:12 +0000"], lambda c: D.parse_pub_datetime(c, 8)) == [datetime(2024, 3, 6, 4, 11, 12)]


def test_event_datetime(spark):
    values = ["2024-01-05", "2024-1-5", "2024-01-05T10:00", "2024-01-05 10:00:01", "2024-01-05x", None]
    assert run(spark, values, lambda c: D.parse_event_datetime(c)[0]) == [
        datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(2024, 1, 5, 10), datetime(2024, 1, 5, 10, 0, 1), None, None]
    assert run(spark, values, lambda c: D.parse_event_datetime(c)[1]) == [True, True, False, False, False, False]


def test_ymd(spark):
    values = ["on 2024/3/7.", "2024年1月5日", "2024 - 1 . 5", "no", None]
    assert run(spark, values, D.extract_ymd) == ["2024-03-07", "2024-01-05", None, None, None]
    assert run(spark, values, lambda c: D.extract_ymd(c, spaced=True))[2] == "2024-01-05"
    assert run(spark, ["2024-13-41", "2024-2-9"], lambda c: D.extract_valid_date(c).cast("string")) == [None, "2024-02-09"]


def test_epoch_date(spark):
    assert run(spark, [1704067199, 1704067200], D.epoch_date, "bigint") == ["2023-12-31", "2024-01-01"]
    assert run(spark, [1704038400], lambda c: D.epoch_date(c, 8), "bigint") == ["2024-01-01"]


def test_status_text(spark):
    table = {"Dredging": "dredging", " Underway ": "underway", "AT ANCHOR": "moored", "stopped": "moored", "Unknown": "offline",
             "正在施工": "dredging", "操纵能力受限": "dredging", "Restricted Maneuverability": "dredging", "机动船在航": "underway",
             "调遣中": "underway", "moving fast": "underway", "锚泊": "moored", "anchored": "moored", "离线": "offline", "??": "offline",
             "": "offline", None: "offline", "施工离线": "dredging"}
    assert run(spark, list(table), G.map_status_text) == list(table.values())


def test_speed_status(spark):
    assert run(spark, [0.0, 0.299, 0.3, 3.0, 3.001, 15.0, None], G.speed_status, "double") == [
        "moored", "moored", "dredging", "dredging", "underway", "underway", "offline"]


def test_location(spark):
    assert run(spark, ["31.5, 121.25", "1,2,3", "x, 2", "Rotterdam", None], G.parse_location) == [
        (31.5, 121.25), None, None, None, None]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-90, 90), st.floats(-180, 180)] * 2), min_size=1, max_size=20))
def test_haversine_is_symmetric(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    a, b, c, d = (F.col(x) for x in "abcd")
    for there, back, same in df.select(G.haversine_m(a, b, c, d), G.haversine_m(c, d, a, b), G.haversine_m(a, b, a, b)).collect():
        assert there == pytest.approx(back, abs=1e-3) and same == 0.0 and there <= 20015087


def test_categories(spark):
    table = {"bid": "Bid", " R&D ": "R&D", "r and d": "R&D", "R D": "R&D", "Research/Development": "R&D", "新闻": "Market",
             "Other": None, "": None, None: None, "new vessel contract": "Bid", "impact": "Regulation", "zzz": None}
    assert run(spark, list(table), C.normalize_category) == list(table.values())
    assert run(spark, ["Port strike", "hard", "quiet", None], C.infer_category) == ["Market", "R&D", None, None]


def test_redundant_words_do_not_change_the_answer(spark):
    texts = ["the planning act", "guidelines", "a programme", "dredged", "nothing", "five-year", "SHIP"]
    for _, words in V.CATEGORY_KEYWORDS:
        assert run(spark, texts, lambda c: T.contains_any(F.lower(c), words)) == [
            any(w in t.lower() for w in words) for t in texts]
    assert run(spark, texts + ["port harbour river"], lambda c: T.count_hits(c, V.SECONDARY_WORDS))[-1] == 3


def test_clean_text(spark):
    assert run(spark, ["Home\r Main menu \n\nBody text that is long enough to stay here even with the word about in it\nSubscribe now"],
               T.clean_article_text) == ["Body text that is long enough to stay here even with the word about in it"]


def test_junk_titles(spark):
    assert run(spark, ["", None, "Hi", "Read more here", "A sound title", "   abcd  "], T.is_obvious_junk_title) == [
        True, True, True, True, False, True]


def test_title_verdict(spark):
    rows = [("Home", "x", "junk_title"), ("ab", "x", "too_short"), ("", "x", "empty"), ("fine title", "", "empty"),
            ("page not found!", "x", "error_page:Page Not Found"), ("Back to list", "x", "back_to"),
            ("Back to work after the storm", "x", None), ("fine title", "javascript:go()", "script_link")]
    df = spark.createDataFrame(rows, "t string, u string, want string")
    assert all(r.got == r.want for r in df.select("want", T.title_verdict(F.col("t"), F.col("u")).alias("got")).collect())


def test_links(spark):
    df = spark.createDataFrame([("https://x/governance", "A long enough title", ["/GOVERN"], False),
                                ("https://x/a", "Skip to content", [], False),
                                ("https://x/a", "Harbour works at home and abroad continue", [], True),
                                ("https://x/a", "Plain news title", None, True)], "u string, t string, b array<string>, want boolean")
    got = df.select("want", T.is_valid_link(F.col("u"), F.col("t"), F.col("b")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_hrefs(spark):
    table = {"/a": "https://h.x/a", "b.html": "https://h.x/dir/b.html", "//c.y/d": "https://c.y/d", "#f": "https://h.x/dir/p#f",
             "mailto:x": "mailto:x", "https://z/": "https://z/", "?q=1": "https://h.x/dir/p?q=1"}
    assert run(spark, list(table), lambda c: U.resolve_href(c, F.lit("https://h.x/dir/p"))) == list(table.values())


def test_model_replies(spark):
    values = ['```json\n{"is_junk": false, "publish_time": "2024 年 1 月 5 日"}\n```', '{"category": "Bid"}', "oops", None, "```\n[1]\n```"]
    got = run(spark, values, A.parse_model_reply)
    assert got[0].publish_time == "2024-01-05" and got[1].category == "Bid" and got[2] is None and got[3] is None and got[4] is None


def test_labels(spark):
    assert run(spark, ["RSS", "official", None, "x"], L.source_label) == ["RSS", "公众号", "Web", "Web"]
    assert run(spark, ["CHEC Shanghai", "Van Oord NV", "x", None], L.fleet_key) == ["上航局", "VanOORD", "其他", "其他"]
    assert run(spark, ["Asia", "Unknown", "Moon", None], lambda c: L.translate_place(c, V.CONTINENT_LABELS)) == ["亚洲", "", "Moon", ""]


def test_primary_category(spark):
    df = spark.createDataFrame([(["Market", "Bid"],), (["Other"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(C.primary_category(F.col("c"))).collect()] == ["Bid", "Other", "Market"]
