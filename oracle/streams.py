"""SQL for the final state of the streams."""

from __future__ import annotations

from oracle import articles, ingest, tracks  # noqa: F401  (they define the views used here)
from oracle.articles import BUCKET, VISIBLE
from oracle.views import define, statement
from oracle.tracks import TS, status_views

SQL: dict[str, str] = {}


def add(name: str, needs: str, body: str) -> None:
    SQL[name] = statement(needs, body)


add("stream_track_ingest", "tracks placed_points", f"""
SELECT id, t.mmsi, round(t.lat, 6) AS lat, round(t.lng, 6) AS lng, t.{TS}, city, p.country FROM tracks t JOIN placed_points p USING (id)""")
# the look-back of a vessel ends at its own newest point; vessels are listed and called offline as of the newest report of all
define("own_recent", ["tracks"], f"""
SELECT * EXCLUDE (newest) FROM (SELECT *, max({TS}) OVER (PARTITION BY mmsi) AS newest FROM tracks)
WHERE {TS} >= newest - INTERVAL 10 DAY""")
status_views("own_", "own_recent")
add("stream_vessel_status", "tracks own_facts", f"""
SELECT mmsi, CASE WHEN off THEN 'offline' WHEN by_window OR by_fallback THEN 'moored' WHEN speed_ms IS NULL THEN 'offline' WHEN speed_ms < 0.3 THEN 'moored'
            WHEN speed_ms <= 3.0 THEN 'dredging' ELSE 'underway' END AS status,
       round(CASE WHEN off THEN NULL WHEN by_window OR by_fallback THEN 0.0 ELSE speed_ms / 0.514444::DOUBLE END, 6) AS speed_kn, heading,
       CASE WHEN NOT off THEN printf('%.6f, %.6f', lat, lng) END AS location, latest_ts AS status_date
FROM (SELECT *, latest_ts < (SELECT max({TS}) FROM tracks) - INTERVAL 24 HOUR AS off FROM own_facts)
WHERE latest_ts >= (SELECT max({TS}) FROM tracks) - INTERVAL 10 DAY""")
add("stream_article_dedup", "items store", "SELECT link, min(seq) AS seq, CAST(1 AS BIGINT) AS times FROM items WHERE link NOT IN (SELECT url FROM store) GROUP BY link")
add("stream_daily_counts", "articles", f"""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS articles FROM articles WHERE {VISIBLE} GROUP BY 1""")
add("stream_shift_digest", "articles", f"""
SELECT CAST(CAST(created_at AS DATE) AS TIMESTAMP) + CASE WHEN hour(created_at) < 8 THEN INTERVAL (-6) HOUR WHEN hour(created_at) < 18 THEN INTERVAL 8 HOUR
       ELSE INTERVAL 18 HOUR END AS shift_start, {BUCKET} AS category, count(*) AS articles
FROM articles WHERE {VISIBLE} AND is_retained = 1 GROUP BY ALL""")
SQL["stream_upsert"] = ingest.SQL["upsert_articles"]
