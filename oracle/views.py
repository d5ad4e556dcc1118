"""The sample views in SQL, and helpers to assemble statements from common table expressions."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-30 18:00:00'"

VIEWS = {
    "tracks": ([], """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS mmsi, 'Vessel ' || CAST(user_id AS VARCHAR) AS vessel_name,
       30.0::DOUBLE + amp * (((event_id * 7919) % 1000) / 1000.0::DOUBLE) AS lat,
       120.0::DOUBLE + amp * (((event_id * 104729) % 1000) / 1000.0::DOUBLE) AS lng,
       value / 10.0::DOUBLE AS speed, CAST((event_id * 37) % 360 AS DOUBLE) AS heading,
       CASE event_type WHEN 'click' THEN 'Dredging' WHEN 'view' THEN 'Underway using engine'
            WHEN 'purchase' THEN 'At anchor' WHEN 'signup' THEN '施工作业' ELSE 'Unknown' END AS status_raw,
       ts AS "timestamp", ts + INTERVAL 1 MINUTE AS created_at
FROM (SELECT *, CASE user_id % 4 WHEN 0 THEN 0.0002::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 4.0::DOUBLE
             ELSE 30.0::DOUBLE END AS amp FROM events)"""),
    "ships": ([], f"""
SELECT s_suppkey AS id, CAST(9000000 + s_suppkey AS VARCHAR) AS imo,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN '' ELSE CAST(s_suppkey AS VARCHAR) END AS mmsi,
       s_name AS name,
       CASE s_suppkey % 9 WHEN 0 THEN '上航局' WHEN 1 THEN '天航局' WHEN 2 THEN '广航局' WHEN 3 THEN 'Boskalis'
            WHEN 4 THEN 'DEME' WHEN 5 THEN 'JanDeNUL' WHEN 6 THEN 'Van Oord' WHEN 7 THEN n_name ELSE NULL END AS company,
       r_name AS region,
       CASE s_suppkey % 4 WHEN 0 THEN '0.0, 0.0' WHEN 1 THEN '31.5, 121.25' WHEN 2 THEN 'Rotterdam' ELSE NULL END AS location,
       CASE s_suppkey % 3 WHEN 0 THEN 'offline' WHEN 1 THEN 'Dredging' ELSE '锚泊' END AS status,
       {NOW} - to_hours(CAST(s_suppkey % 48 AS INTEGER)) AS updated_at,
       n_name AS country, r_name AS continent,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 5) / 10.0::DOUBLE END AS speed,
       CAST((s_suppkey * 53) % 360 AS DOUBLE) AS heading
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "gazetteer": ([], """
SELECT n_name AS place, r_name AS admin1, CAST(n_nationkey AS VARCHAR) AS cc, r_name AS continent,
       30.0::DOUBLE + (n_nationkey % 5) * 6.0::DOUBLE AS lat, 120.0::DOUBLE + (n_nationkey // 5) * 6.0::DOUBLE AS lng
FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "raw_items": ([], f"""
SELECT doc_id AS seq,
       CASE WHEN doc_id % 41 = 0 THEN '' ELSE
         ['Contract award for ', 'New dredger delivery to ', 'Quarterly revenue of ', 'Beach restoration underway at ', 'Permit approval for ',
          'Soil research by ', 'Skip to main content ', 'River and estuary near ', 'Agreement signed with ', '疏浚 航道 ', 'Hello ',
          'Port terminal berth ', 'Back to ', '404 Not Found ', 'Strike plan at ', 'About us '][CAST(doc_id % 16 AS INTEGER) + 1]
         || split_part(text, chr(10), 1) END AS title,
       'https://news' || CAST(k % 7 AS VARCHAR) || '.example.org/item/' || CAST(k AS VARCHAR)
         || CASE WHEN k % 4 = 0 THEN '?page=2' ELSE '' END
         || CASE doc_id % 5 WHEN 0 THEN (CASE WHEN k % 4 = 0 THEN '&' ELSE '?' END) || 'utm_source=feed'
                            WHEN 1 THEN '#top' WHEN 2 THEN (CASE WHEN k % 4 = 0 THEN '&' ELSE '?' END) || 'ref=x' ELSE '' END AS link,
       CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'n/a'
            ELSE strftime({NOW} - to_days(CAST(doc_id % 9 AS INTEGER)), '%Y-%m-%d') END AS pub_date,
       text AS summary_raw,
       CASE WHEN doc_id % 10 < 3 THEN 'rss' WHEN doc_id % 10 < 9 THEN 'web' ELSE 'wechat' END AS source_type,
       source AS source_name, {NOW} AS fetched_at
FROM (SELECT *, CASE WHEN doc_id % 7 = 6 THEN doc_id - 3 ELSE doc_id END AS k FROM documents)"""),
    "articles": (["raw_items"], """
SELECT r.seq AS id, 'https://news' || CAST(r.seq % 7 AS VARCHAR) || '.example.org/item/' || CAST(r.seq AS VARCHAR)
         || CASE WHEN r.seq % 4 = 0 THEN '?page=2' ELSE '' END AS url, r.title,
       CASE WHEN r.seq % 3 = 0 THEN '译 ' || r.title END AS title_cn, r.pub_date,
       r.source_type, CASE WHEN r.seq % 23 = 0 THEN NULL ELSE r.source_name END AS source_name,
       CASE WHEN r.seq % 4 = 0 THEN '' ELSE d.text END AS summary_cn,
       CASE WHEN r.seq % 6 = 0 THEN '' ELSE d.text END AS content,
       CASE WHEN r.seq % 2 = 0 THEN 'assets/' || CAST(r.seq AS VARCHAR) || '.jpg' ELSE '' END AS screenshot_path,
       CASE WHEN r.seq % 8 = 7 THEN NULL
            ELSE ['Bid','Equipment','Market','Project','Regulation','R&D','Other'][CAST(r.seq % 8 AS INTEGER) + 1] END AS category,
       CASE WHEN r.seq % 29 = 0 THEN 1 WHEN r.seq % 31 = 0 THEN NULL ELSE 0 END AS is_hidden,
       CASE WHEN r.seq % 17 = 0 THEN 0 WHEN r.seq % 19 = 0 THEN NULL ELSE 1 END AS valid,
       CASE WHEN r.seq % 5 < 3 THEN 1 ELSE 0 END AS is_retained,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((r.seq * 211) % 42840 AS BIGINT)) AS created_at
FROM raw_items r JOIN documents d ON d.doc_id = r.seq
WHERE r.seq % 7 <> 6"""),
    "store": (["articles"], "SELECT * FROM articles WHERE id % 3 <> 2"),
    "analysis": (["articles"], """
SELECT a.url, l.doc_id IS NOT NULL AS has_text, l.quality = 0 AS t_is_junk,
       CASE WHEN l.doc_id IS NOT NULL THEN a.category END AS t_category,
       CASE WHEN l.doc_id IS NOT NULL AND a.id % 4 <> 1 THEN '文 ' || a.title END AS t_title_cn,
       CASE WHEN l.doc_id IS NOT NULL THEN a.content END AS t_summary_cn,
       CASE WHEN l.doc_id IS NOT NULL AND a.id % 4 <> 2 THEN a.pub_date END AS t_publish_time,
       a.screenshot_path <> '' AND a.id % 3 <> 0 AS has_vl,
       CASE WHEN a.screenshot_path <> '' AND a.id % 3 <> 0 THEN a.id % 5 = 0 END AS v_is_junk,
       CASE WHEN a.screenshot_path <> '' AND a.id % 3 <> 0 THEN 'Project' END AS v_category,
       CASE WHEN a.screenshot_path <> '' AND a.id % 3 <> 0 THEN '图 ' || a.title END AS v_title_cn,
       CASE WHEN a.screenshot_path <> '' AND a.id % 3 <> 0 THEN '2024-01-28' END AS v_publish_time,
       CASE WHEN a.screenshot_path <> '' AND a.id % 3 <> 0 THEN 'image ' || CAST(a.id AS VARCHAR) END AS image_desc
FROM articles a LEFT JOIN labels l ON l.doc_id = a.id"""),
}


def define(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


def statement(needs: str, body: str) -> str:
    """``body`` preceded by the named views, and by what these need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order) + "\n" + body.strip()


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def word_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def any_word(expr: str, words) -> str:
    """Is any of the words a substring of the expression?"""
    return "(" + " OR ".join(f"contains({expr}, {quoted(w)})" for w in words) + ")"


def hits(expr: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {quoted(w)}) AS INTEGER)" for w in words) + ")"


def choose(key: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (f"2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) "
            f"* cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)))")


def seconds(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start})) / 1000000.0::DOUBLE"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"
