"""SQL for the track and registry queries."""

from __future__ import annotations

from oracle.views import NOW, any_word, choose, define, haversine, quoted, seconds, statement, word_list
from tidewatch import vocab as V

SQL: dict[str, str] = {}


def add(name: str, needs: str, body: str) -> None:
    SQL[name] = statement(needs, body)


TS = '"timestamp"'
define("since10", ["tracks"], f"SELECT * FROM tracks WHERE {TS} BETWEEN {NOW} - INTERVAL 10 DAY AND {NOW}")
define("recent", ["since10"], "SELECT * FROM since10")


def status_views(prefix: str, source: str) -> str:
    """Define the rule chain over a table of recent points; returns the name of the facts view."""
    p = prefix
    define(f"{p}step", [source], f"""
SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag({TS}) OVER w AS pts,
       row_number() OVER (PARTITION BY mmsi ORDER BY {TS} DESC, id DESC) AS rk
FROM {source} WINDOW w AS (PARTITION BY mmsi ORDER BY {TS}, id)""")
    define(f"{p}seg", [f"{p}step"], f"""
SELECT *, CASE WHEN dt > 0 AND dist / dt <= 15 THEN dist / dt END AS ms
FROM (SELECT *, {seconds('pts', TS)} AS dt, {haversine('plat', 'plng', 'lat', 'lng')} AS dist FROM {p}step)""")
    define(f"{p}speeds", [f"{p}seg"], f"""
SELECT mmsi, id, ms, row_number() OVER (PARTITION BY mmsi ORDER BY {TS} DESC, id DESC) AS age FROM {p}seg WHERE ms IS NOT NULL""")
    define(f"{p}med", [f"{p}speeds"], f"SELECT mmsi, median(ms) AS ms FROM {p}speeds WHERE age <= 24 GROUP BY mmsi")
    define(f"{p}knots", [source], f"SELECT mmsi, median(speed) AS kn FROM {source} WHERE speed >= 0 GROUP BY mmsi")
    define(f"{p}newest", [f"{p}seg"], f"SELECT * FROM {p}seg WHERE rk = 1")
    define(f"{p}win", [f"{p}seg", f"{p}newest"], f"""
SELECT p.mmsi, count(*) AS points, max({haversine('l.lat', 'l.lng', 'p.lat', 'p.lng')}) AS drift
FROM {p}seg p JOIN {p}newest l USING (mmsi) WHERE p.{TS} >= l.{TS} - INTERVAL 2 HOUR GROUP BY p.mmsi""")
    define(f"{p}facts", [f"{p}newest", f"{p}win", f"{p}med", f"{p}knots"], f"""
SELECT l.mmsi, l.{TS} AS latest_ts, l.lat, l.lng, l.heading, w.points, w.drift,
       w.points >= 2 AND w.drift <= 80 AS by_window,
       w.points < 2 AND coalesce(l.dt / 3600 >= 2 AND l.dist <= 80, false) AS by_fallback,
       coalesce(m.ms, k.kn * 0.514444::DOUBLE) AS speed_ms
FROM {p}newest l JOIN {p}win w USING (mmsi) LEFT JOIN {p}med m USING (mmsi) LEFT JOIN {p}knots k USING (mmsi)""")
    for hours in (2, 24):
        define(f"{p}status{hours}", [f"{p}facts"], f"""
SELECT mmsi,
       CASE WHEN off THEN 'offline' WHEN still THEN 'moored' WHEN speed_ms IS NULL THEN 'offline' WHEN speed_ms < 0.3 THEN 'moored'
            WHEN speed_ms <= 3.0 THEN 'dredging' ELSE 'underway' END AS status,
       round(CASE WHEN off THEN NULL WHEN still THEN 0.0 ELSE speed_ms / 0.514444::DOUBLE END, 6) AS speed_kn, heading,
       CASE WHEN NOT off THEN printf('%.6f, %.6f', lat, lng) END AS location, latest_ts AS status_date
FROM (SELECT *, latest_ts < {NOW} - INTERVAL {hours} HOUR AS off, by_window OR by_fallback AS still FROM {p}facts)""")
    return f"{p}facts"


status_views("", "recent")

add("scan_tracks", "tracks", f"""
SELECT mmsi, {TS}, round(lat, 6) AS lat, round(lng, 6) AS lng, round(speed, 6) AS speed FROM tracks
WHERE {TS} >= {NOW} - INTERVAL 10 DAY""")
add("scan_ships", "ships", "SELECT * FROM ships")
for key, keep in (("track_retention", 5000), ("track_retention_short", 40), ("track_store_retention", 40)):
    add(key, "tracks", f"""
SELECT id, mmsi, {TS} FROM tracks
QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY {TS} DESC, id DESC) <= {keep}""")
add("recent_tracks", "recent", f"SELECT id, mmsi, {TS} FROM recent")
add("recent_tracks_short", "since10", f"""
SELECT id, mmsi, {TS} FROM since10 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY {TS} DESC, id DESC) <= 5""")
add("track_history", "tracks", f"""
SELECT round(lat, 6) AS lat, round(lng, 6) AS lng, round(speed, 6) AS speed, heading, {TS} FROM tracks
WHERE mmsi = '7' AND {TS} > {NOW} - INTERVAL 30 DAY AND {TS} <= {NOW}""")
add("segment_speed", "speeds", "SELECT mmsi, id, round(ms, 6) AS speed_ms FROM speeds")
add("segment_speed_by_range", "speeds", "SELECT mmsi, id, round(ms, 6) AS speed_ms FROM speeds")
add("last_24_speeds", "speeds", "SELECT mmsi, id, age, round(ms, 6) AS speed_ms FROM speeds WHERE age <= 24")
add("median_speed", "med", "SELECT mmsi, round(ms, 6) AS speed_ms FROM med")
add("fallback_speed", "knots", "SELECT mmsi, round(kn * 0.514444::DOUBLE, 6) AS speed_ms FROM knots")
define("last_point", ["tracks"], f"""
SELECT * FROM tracks QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY {TS} DESC, id DESC) = 1""")
add("latest_point", "last_point", f"""
SELECT mmsi, id, {TS}, round(lat, 6) AS lat, round(lng, 6) AS lng, heading, status_raw FROM last_point""")
add("latest_position", "last_point", "SELECT mmsi, round(lat, 6) AS lat, round(lng, 6) AS lng FROM last_point")
add("recent_window", "tracks", f"""
SELECT t.id, t.mmsi, t.{TS} FROM tracks t JOIN (SELECT mmsi, max({TS}) AS newest FROM tracks GROUP BY mmsi) USING (mmsi)
WHERE t.{TS} >= newest - INTERVAL 12 HOUR""")
add("stationary_window", "win", """
SELECT mmsi, points, round(drift, 3) AS max_drift_m, drift <= 80 AS is_stationary FROM win WHERE points >= 2""")
add("stationary_fallback", "facts", "SELECT mmsi, by_fallback AS is_stationary FROM facts WHERE points < 2")
add("offline_rule", "ships recent", f"""
SELECT s.id, trim(s.mmsi) AS mmsi, n.latest_ts, n.latest_ts IS NULL OR n.latest_ts < {NOW} - INTERVAL 24 HOUR AS is_offline
FROM ships s LEFT JOIN (SELECT mmsi, max({TS}) AS latest_ts FROM recent GROUP BY mmsi) n ON trim(s.mmsi) = n.mmsi
WHERE trim(s.mmsi) <> ''""")
add("vessel_status", "status24", "SELECT * FROM status24")
add("vessel_status_2h", "status2", "SELECT * FROM status2")
add("fleet_status_update", "ships status24", f"""
SELECT s.id, s.mmsi, CASE WHEN has THEN coalesce(t.status, 'offline') ELSE s.status END AS status,
       CASE WHEN has THEN coalesce(t.status_date, {NOW}) END AS status_date,
       CASE WHEN has THEN coalesce(t.location, s.location) ELSE s.location END AS location, s.region,
       CASE WHEN has THEN {NOW} ELSE s.updated_at END AS updated_at,
       round(coalesce(t.speed_kn, s.speed), 6) AS speed, coalesce(t.heading, s.heading) AS heading
FROM (SELECT *, coalesce(trim(mmsi) <> '', false) AS has FROM ships) s LEFT JOIN status24 t ON trim(s.mmsi) = t.mmsi""")
define("whole_step", ["tracks"], f"""
SELECT *, {haversine('plat', 'plng', 'lat', 'lng')} AS dist FROM (
  SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM tracks WINDOW w AS (PARTITION BY mmsi ORDER BY {TS}, id))""")
for name in ("path_length", "path_length_by_range"):
    add(name, "whole_step", f"""
SELECT mmsi, round(coalesce(sum(dist), 0), 2) AS total_m,
       round(coalesce(arg_max(dist, ({TS}, id)), 0), 2) AS last_step_m FROM whole_step GROUP BY mmsi""")
add("track_extent", "tracks", """
SELECT mmsi, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lng), 6) AS min_lng,
       round(max(lng), 6) AS max_lng, min(lat) = max(lat) AND min(lng) = max(lng) AS is_single_spot FROM tracks GROUP BY mmsi""")
add("has_track", "tracks", f"""
SELECT mmsi, count(*) AS points FROM tracks WHERE {TS} > {NOW} - INTERVAL 3 DAY AND {TS} <= {NOW}
GROUP BY mmsi HAVING count(*) >= 2""")
add("haversine_m", "tracks", f"""
SELECT id, round({haversine('31.23::DOUBLE', '121.47::DOUBLE', 'lat', 'lng')}, 3) AS metres FROM tracks""")
add("speed_status", "tracks", """
SELECT id, CASE WHEN ms < 0.3 THEN 'moored' WHEN ms <= 3.0 THEN 'dredging' WHEN ms IS NULL THEN 'offline' ELSE 'underway' END AS status
FROM (SELECT id, speed * 0.514444::DOUBLE AS ms FROM tracks)""")
add("knots_ms", "tracks", "SELECT id, round(speed * 0.514444::DOUBLE, 6) AS ms, round(speed, 6) AS knots FROM tracks")
add("parse_track_ts", "tracks", f"SELECT id, CASE WHEN id % 4 < 2 THEN {TS} END AS parsed FROM tracks")
add("location_text", "tracks", "SELECT id, printf('%.6f, %.6f', lat, lng) AS location FROM tracks")
add("nonzero_position", "tracks", """
SELECT id, round(lat - 30, 6) AS lat, round(lng - 120, 6) AS lng FROM tracks
WHERE NOT (abs(lat - 30) < 0.01 AND abs(lng - 120) < 0.01)""")


def status_case(expr: str) -> str:
    exact = " ".join(f"WHEN {quoted(k)} THEN {quoted(x)}" for k, x in V.STATUS_EXACT.items())
    parts = " ".join(f"WHEN {any_word(f'lower({expr})', words)} THEN {quoted(key)}" for words, key in V.STATUS_PARTS)
    return f"coalesce(CASE trim(lower({expr})) {exact} END, CASE {parts} ELSE 'offline' END)"


add("map_status_text", "tracks", f"""
SELECT id, txt AS text, {status_case('txt')} AS status_key
FROM (SELECT id, status_raw || ['', ' ', '离线', '（锚泊中）', '机动船在航'][CAST(id % 5 AS INTEGER) + 1] AS txt FROM tracks)""")
define("keyed_ships", ["ships"], f"""
SELECT *, CASE WHEN coalesce(mmsi, '') = '' THEN 'untracked' WHEN k = 'offline' AND speed > 0.2 THEN 'underway' ELSE k END AS status_key
FROM (SELECT *, {status_case('status')} AS k FROM ships)""")
add("effective_status", "keyed_ships", "SELECT id, status_key FROM keyed_ships")
add("status_label", "keyed_ships", f"SELECT id, {choose('status_key', V.STATUS_LABELS, quoted(V.STATUS_LABEL_DEFAULT))} AS label FROM keyed_ships")
add("tracked_vessel", "ships", r"""
SELECT id, coalesce(regexp_matches(mmsi, '\d'), false) AS server, coalesce(trim(mmsi) <> '', false) AS client FROM ships""")
add("active_vessel", "ships", f"SELECT id, updated_at >= {NOW} - INTERVAL 24 HOUR AS is_active FROM ships")
add("vessel_search", "ships", """
SELECT id, name, mmsi, company FROM ships
WHERE contains(lower(name), 'nation_1') OR contains(lower(coalesce(mmsi, '')), 'nation_1') OR contains(lower(coalesce(company, '')), 'nation_1')""")
rules = " ".join(f"WHEN {any_word('lower(company)', words)} THEN {quoted(fleet)}" for words, fleet in V.FLEET_RULES)
add("fleet_key", "ships", f"SELECT id, CASE {rules} ELSE '其他' END AS fleet FROM ships")
countries, continents = list(V.COUNTRY_LABELS) + ["Atlantis"], list(V.CONTINENT_LABELS) + ["Moon"]
add("translate_place", "ships", f"""
SELECT id, {choose('c', V.COUNTRY_LABELS, 'c')} AS country, {choose('k', V.CONTINENT_LABELS, 'k')} AS continent
FROM (SELECT id, {word_list(countries)}[CAST(id % {len(countries)} AS INTEGER) + 1] AS c,
             {word_list(continents)}[CAST(id % {len(continents)} AS INTEGER) + 1] AS k FROM ships)""")
define("own_place", ["ships"], """
SELECT *, CASE WHEN len(string_split(location, ',')) = 2 THEN try_cast(trim(split_part(location, ',', 1)) AS DOUBLE) END AS own_lat,
       CASE WHEN len(string_split(location, ',')) = 2 THEN try_cast(trim(split_part(location, ',', 2)) AS DOUBLE) END AS own_lng FROM ships""")
add("parse_location", "own_place", "SELECT id, own_lat AS lat, own_lng AS lng FROM own_place")
define("overview", ["own_place", "last_point"], f"""
SELECT s.*, CASE WHEN own THEN own_lat WHEN seen THEN t_lat END AS lat, CASE WHEN own THEN own_lng WHEN seen THEN t_lng END AS lng,
       updated_at >= {NOW} - INTERVAL 24 HOUR AS is_active, coalesce(regexp_matches(mmsi, '[0-9]'), false) AS is_tracked
FROM (SELECT o.*, p.lat AS t_lat, p.lng AS t_lng, coalesce(abs(own_lat) > 0.01 OR abs(own_lng) > 0.01, false) AS own,
             coalesce(abs(p.lat) > 0.01 OR abs(p.lng) > 0.01, false) AS seen
      FROM own_place o LEFT JOIN last_point p ON trim(o.mmsi) = p.mmsi) s""")
add("vessel_position_resolve", "overview", "SELECT id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM overview")
add("fleet_overview", "overview", """
SELECT id, mmsi, name, status, updated_at, round(lat, 6) AS lat, round(lng, 6) AS lng, is_active, is_tracked FROM overview""")
add("fleet_counts", "overview", """
SELECT count(*) AS total, count(*) FILTER (is_tracked) AS tracked, count(*) FILTER (is_active) AS active, count(lat) AS visible FROM overview""")
add("status_counts", "keyed_ships", """
SELECT status_key, count(*) AS vessels FROM keyed_ships WHERE trim(mmsi) <> '' GROUP BY status_key""")
add("plottable", "overview", """
SELECT id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM overview WHERE lat IS NOT NULL AND lng IS NOT NULL AND trim(mmsi) <> ''""")
add("vessel_bbox", "overview", """
SELECT round(s - 0.2 * (n - s), 6) AS south, round(w - 0.2 * (e - w), 6) AS west, round(n + 0.2 * (n - s), 6) AS north,
       round(e + 0.2 * (e - w), 6) AS east
FROM (SELECT min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM overview
      WHERE lat IS NOT NULL AND lng IS NOT NULL AND trim(mmsi) <> '')""")
add("fleet_group_sort", "keyed_ships", f"""
SELECT id, g AS company_group, CASE WHEN p > 0 THEN p - 1 WHEN g = '其他' THEN 9 ELSE 8 END AS group_rank,
       CASE WHEN coalesce(mmsi, '') = '' THEN 4 ELSE CASE status_key WHEN 'dredging' THEN 0 WHEN 'underway' THEN 1 WHEN 'moored' THEN 2
            WHEN 'offline' THEN 3 ELSE 2 END END AS vessel_rank, name
FROM (SELECT *, coalesce(list_position({word_list(V.FLEET_ORDER)}, g), 0)::INTEGER AS p FROM
      (SELECT *, coalesce(nullif(company, ''), '其他') AS g FROM keyed_ships))""")
define("payload", ["tracks"], f"""
SELECT mmsi, lat, lng, speed, heading, status_raw, {NOW} - to_minutes(CAST(CAST(mmsi AS BIGINT) % 120 AS BIGINT)) AS {TS},
       CASE WHEN id % 3 = 0 THEN '' ELSE vessel_name END AS shipname, CASE WHEN id % 2 = 0 THEN 'N' || mmsi END AS name
FROM tracks WHERE (id // 500) % 5 <> 4 AND id % 50 <> 7
QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY id DESC) = 1""")
add("fleet_payload", "payload", f"""
SELECT mmsi, round(lat, 6) AS lat, round(lng, 6) AS lng, round(speed, 6) AS speed, heading, status_raw, {TS}, shipname, name FROM payload""")
define("matched", ["ships", "payload"], "SELECT p.*, s.name AS registry_name FROM payload p JOIN ships s USING (mmsi) WHERE mmsi <> ''")
add("fleet_position_join", "matched", "SELECT mmsi, registry_name, round(lat, 6) AS lat, round(lng, 6) AS lng FROM matched")
add("vessel_name_choice", "matched", """
SELECT mmsi, coalesce(nullif(shipname, ''), nullif(name, ''), nullif(registry_name, '')) AS vessel_name FROM matched""")


def nearest(source: str, key: str) -> str:
    """Nearest place by comparing with every place; the sample has 25 of them."""
    dist = haversine("t.lat", "t.lng", "g.lat", "g.lng")
    return f"""
SELECT {key}, n.* FROM (SELECT {key}, min((round(d, 3), place, admin1, cc, continent)) AS m FROM
  (SELECT t.{key}, {dist} AS d, g.place, g.admin1, g.cc, g.continent FROM {source} t, gazetteer g) GROUP BY {key}),
  LATERAL (SELECT m[1] AS metres, m[2] AS city, m[3] AS province, m[4] AS country, m[5] AS continent) n"""


define("placed_points", ["tracks", "gazetteer"], nearest("tracks", "id"))
add("reverse_geocode", "placed_points", "SELECT id, city, province, country, continent, round(metres, 1) AS metres FROM placed_points")
define("placed_ships", ["matched", "gazetteer"], nearest("matched", "mmsi"))
define("moved", ["ships", "matched", "placed_ships"], f"""
SELECT s.* EXCLUDE (location, updated_at, country, continent, speed, heading, status),
       CASE WHEN m.mmsi IS NULL THEN s.location ELSE CAST(m.lat AS VARCHAR) || ', ' || CAST(m.lng AS VARCHAR) END AS location,
       CASE WHEN m.mmsi IS NULL THEN s.updated_at ELSE {NOW} END AS updated_at,
       CASE WHEN m.mmsi IS NULL THEN s.country ELSE g.country END AS country,
       CASE WHEN m.mmsi IS NULL THEN s.continent ELSE g.continent END AS continent, g.province, g.city,
       CASE WHEN m.mmsi IS NULL THEN s.speed ELSE m.speed END AS speed,
       CASE WHEN m.mmsi IS NULL THEN s.heading ELSE m.heading END AS heading,
       CASE WHEN m.mmsi IS NULL THEN s.status ELSE m.status_raw END AS status
FROM ships s LEFT JOIN matched m ON s.mmsi = m.mmsi LEFT JOIN placed_ships g ON g.mmsi = m.mmsi""")
add("position_update", "moved", """
SELECT id, mmsi, location, updated_at, country, continent, province, city, round(speed, 6) AS speed, heading, status FROM moved""")
add("update_status_by_mmsi", "ships status24", f"""
SELECT s.id, s.mmsi, CASE WHEN h THEN t.status ELSE s.status END AS status, t.status_date,
       CASE WHEN h THEN t.location ELSE s.location END AS location, CASE WHEN h THEN 'sea' ELSE s.region END AS region,
       round(coalesce(t.speed_kn, s.speed), 6) AS speed, coalesce(t.heading, s.heading) AS heading,
       CASE WHEN h THEN {NOW} ELSE s.updated_at END AS updated_at
FROM ships s LEFT JOIN (SELECT *, true AS h FROM status24) t ON s.mmsi = t.mmsi""")
add("upsert_ships", "ships", f"""
SELECT id, imo, mmsi, CASE WHEN id % 4 <> 1 THEN name || ' II' ELSE name END AS name, company,
       CASE WHEN id % 4 <> 1 THEN NULL ELSE country END AS country, location, round(speed, 6) AS speed, heading, {NOW} AS updated_at FROM ships""")
define("grown", ["tracks", "matched"], f"""
SELECT id, mmsi, lat, lng, speed, heading, {TS} FROM tracks UNION ALL
SELECT -1, mmsi, lat, lng, speed, heading, {TS} FROM matched""")
define("grown_recent", ["grown"], f"SELECT * FROM grown WHERE {TS} BETWEEN {NOW} - INTERVAL 10 DAY AND {NOW}")
status_views("job_", "grown_recent")
add("fleet_job", "moved job_status24", f"""
SELECT s.id, s.mmsi, CASE WHEN has THEN coalesce(t.status, 'offline') ELSE s.status END AS status,
       CASE WHEN has THEN coalesce(t.status_date, {NOW}) END AS status_date,
       CASE WHEN has THEN coalesce(t.location, s.location) ELSE s.location END AS location, s.country, s.continent, s.province, s.city,
       round(coalesce(t.speed_kn, s.speed), 6) AS speed, coalesce(t.heading, s.heading) AS heading,
       CASE WHEN has THEN {NOW} ELSE s.updated_at END AS updated_at
FROM (SELECT *, coalesce(trim(mmsi) <> '', false) AS has FROM moved) s LEFT JOIN job_status24 t ON trim(s.mmsi) = t.mmsi""")
add("append_tracks", "tracks", f"""
SELECT id, mmsi, round(lat, 6) AS lat, round(lng, 6) AS lng, {TS}, CAST(CAST({TS} AS DATE) AS VARCHAR) AS track_date FROM tracks""")
add("read_vessel_csv", "ships", """
SELECT id, nullif(mmsi, '') AS mmsi, imo, name, coalesce(company, '') AS company, '耙吸' AS type, region, country, status,
       CAST(updated_at AS VARCHAR) AS status_date, '' AS remarks FROM ships WHERE id % 13 <> 0""")
