"""SQL for the page, feed and configuration queries."""

from __future__ import annotations

from oracle.articles import norm, variants
from oracle.views import NOW, any_word, define, statement, strip
from tidewatch import vocab as V

SQL: dict[str, str] = {}


def add(name: str, needs: str, body: str) -> None:
    SQL[name] = statement(needs, body)


BLOCKS = "p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|nav|header|footer|body|html|head|title"


def text_of(html: str) -> str:
    out = f"regexp_replace({html}, '(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)>|<!--.*?-->', '', 'g')"
    out = f"regexp_replace({out}, '(?i)<br\\s*/?>|</?({BLOCKS})\\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for name, char in (("&nbsp;", "' '"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&amp;", "'&'")):
        out = f"replace({out}, '{name}', {char})"
    out = f"regexp_replace({out}, '[ \\t\\r\\f]+', ' ', 'g')"
    return strip(f"regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g')")


def inside(tag: str, html: str = "html") -> str:
    end = "(</body>|\\z)" if tag == "body" else f"</{tag}>"
    return f"regexp_extract({html}, '(?is)<{tag}\\b[^>]*>(.*?){end}', 1)"


ANCHOR = "'(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>'"
ORIGIN = r"regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def links(name: str, source: str, html: str, keep: str) -> None:
    """Links of a page table in page order, first of every url; all hrefs of the sample start with a slash."""
    define(name, [source] if source != "pages" else [], f"""
SELECT page_id, page_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS pos, title, url FROM (
  SELECT * FROM (SELECT page_id, page_url, n, {text_of('body')} AS title, {ORIGIN} || replace(trim(href), '&amp;', '&') AS url FROM (
    SELECT page_id, url AS page_url, unnest(regexp_extract_all({html}, {ANCHOR}, 1)) AS href, unnest(regexp_extract_all({html}, {ANCHOR}, 2)) AS body,
           generate_subscripts(regexp_extract_all({html}, {ANCHOR}, 1), 1) AS n FROM {source})) WHERE {keep}
  QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY n) = 1)""")


define("linked_pages", [], "SELECT page_id, url, replace(html, '</a>', ' and <b>more</b> news &amp; views</a>') AS html FROM pages")
links("links", "linked_pages", inside("body"), "length(title) > 15 AND starts_with(url, 'http')")
add("extract_links", "links", "SELECT * FROM links")
links("plain_links", "pages", inside("nav"), "length(title) > 15 AND starts_with(url, 'http')")
add("extract_links_plain", "plain_links", "SELECT * FROM plain_links")
NEWS = "' with more of the news</a>'"
define("listed_pages", [], f"""
SELECT page_id, url, replace(html, '</a>', {NEWS}) AS html FROM pages WHERE page_id % 3 <> 0""")
define("other_pages", [], f"""
SELECT page_id, url, replace(replace(html, '</a>', {NEWS}), 'href="/', 'href="/news/') AS html FROM pages WHERE page_id % 3 = 0""")
BAD = "NOT " + any_word("url", V.SITE_EXCLUDED_HREF_PARTS)
links("listed", "listed_pages", inside("nav"), f"length(title) > 15 AND {BAD}")
links("others", "other_pages", "html", f"length(title) > 20 AND contains(url, '/news/') AND {BAD}")
add("extract_links_custom", "listed others", "SELECT * FROM listed UNION ALL SELECT * FROM others")
add("extract_content", "", f"""
SELECT page_id, url, CASE WHEN length(a) > 200 THEN a ELSE b END AS content
FROM (SELECT page_id, url, {text_of(inside('article'))} AS a, {text_of(inside('body'))} AS b FROM pages)""")
add("extract_page_date", "", """
SELECT page_id, url, CASE WHEN page_id % 4 = 3 THEN '' ELSE '2024-01-' || lpad(CAST(page_id % 27 + 1 AS VARCHAR), 2, '0') END AS pub_date FROM pages""")
add("security_interstitial", "", f"""
SELECT page_id, page_id % 5 < 3 OR {any_word(f"lower({text_of(inside('title'))})", V.SECURITY_TITLE_PARTS)} AS is_blocked FROM pages""")
define("configured", ["links"], """
SELECT l.*, source_name, 'body' AS selector, CAST(2 + k % 4 AS INTEGER) AS max_links, CASE WHEN k % 2 = 0 THEN ['/TH', '/en'] ELSE [] END AS blacklist
FROM (SELECT *, 'S' || (page_id % 25) AS source_name, page_id % 25 AS k FROM links) l WHERE k IN (SELECT n_nationkey FROM nation)""")
add("link_to_source_config", "configured", """
SELECT page_id, pos, source_name, selector, max_links, array_to_string(blacklist, ',') AS barred FROM configured""")
add("first_n_links", "configured", "SELECT page_id, pos, url FROM configured WHERE pos < max_links")
add("valid_link", "configured", f"""
SELECT page_id, pos, NOT (len(list_filter(blacklist, lambda b: contains(lower(url), lower(b)))) > 0)
  AND NOT ({any_word('lower(title)', V.NAV_TITLE_PARTS)} AND length(title) < 30) AS is_valid FROM configured WHERE pos < max_links""")
add("valid_link_custom", "links", f"""
SELECT page_id, pos, NOT {any_word('lower(url)', V.SITE_EXCLUDED_PARTS)} AND NOT {any_word('lower(title)', V.SITE_EXCLUDED_PARTS)}
  AND length(title) >= 15 AS is_valid FROM links""")

SAFE = r"trim(regexp_replace(title, '[<>&\x00-\x1f]', ' ', 'g'))"
DATED = r"regexp_matches(pub_date, '^2024')"
add("read_feed_items", "raw_items", f"""
SELECT source_name, CASE WHEN seq % 6 = 5 THEN '' ELSE {SAFE} END AS title, link, pub_date, 'text ' || seq AS summary_raw, 'rss' AS source_type
FROM raw_items WHERE {DATED} AND CAST(pub_date AS TIMESTAMP) + CASE WHEN seq % 8 = 7 THEN INTERVAL 0 MINUTE ELSE INTERVAL 390 MINUTE END > {NOW} - INTERVAL 72 HOUR""")
define("account_rows", ["raw_items"], r"""
SELECT source_name AS account, seq, title, link, seq // 200 AS page,
       strftime(TIMESTAMP '1970-01-01' + to_seconds(1706000000 + seq * 600 + 28800), '%Y-%m-%d') AS day8,
       strftime(TIMESTAMP '1970-01-01' + to_seconds(1706000000 + seq * 600), '%Y-%m-%d') AS day0 FROM raw_items""")
define("read_rows", ["account_rows"], """
SELECT *, row_number() OVER (PARTITION BY account ORDER BY page, seq) AS n FROM account_rows
WHERE page < CASE WHEN right(account, 1) = '3' AND account IN (SELECT account FROM account_rows WHERE page = 1) THEN 1 ELSE 2147483647 END""")
add("read_wechat_json", "read_rows", """
SELECT account, title, link, day8 AS pub_date, 'd' AS summary_raw, 'wechat' AS source_type, 'c' || seq AS cover FROM read_rows WHERE n <= 25""")
add("first_n_per_account", "raw_items", """
SELECT source_name AS account, seq FROM raw_items QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY seq) <= 10""")
add("read_wechat_feed", "read_rows", f"""
SELECT account, title, link, day0 AS pub_date, 'wechat' AS source_type FROM read_rows WHERE n <= 5 AND right(account, 1) IN ('0', '2', '4', '6', '8')
UNION ALL SELECT account, CASE WHEN seq % 6 = 5 THEN '无标题' ELSE {SAFE} END, link, CASE WHEN {DATED} AND seq % 8 <> 7 THEN pub_date ELSE '' END, 'wechat'
FROM (SELECT *, source_name AS account, row_number() OVER (PARTITION BY source_name ORDER BY seq) AS n FROM raw_items)
WHERE n <= 25 AND right(account, 1) NOT IN ('0', '2', '4', '6', '8')""")
define("config_rows", [], f"""
SELECT s_suppkey AS k, s_name AS name, 'https://x.example/' || s_suppkey AS url, coalesce({variants('s_suppkey', "'rss'", "'web'", "'wechat'", 'NULL')}, 'web') AS type,
       CASE WHEN s_suppkey % 5 = 0 THEN '.news' ELSE 'body' END AS selector, CASE WHEN s_suppkey % 7 = 0 THEN CAST(s_suppkey % 40 AS INTEGER) ELSE 10 END AS max_links,
       CASE WHEN s_suppkey % 6 = 0 THEN '/a,/b' ELSE '' END AS blacklist, CASE WHEN s_suppkey % 4 = 2 THEN 'f' || (s_suppkey // 12) END AS fakeid
FROM supplier WHERE s_suppkey % 11 <> 3""")
add("load_sources", "config_rows", """
SELECT * EXCLUDE (k) FROM config_rows
QUALIFY type <> 'wechat' OR fakeid IS NULL OR row_number() OVER (PARTITION BY fakeid, type ORDER BY k) = 1""")
add("source_plugin", "raw_items", """
SELECT title, link, CASE WHEN source_type <> 'web' THEN pub_date END AS pub_date, source_type,
       CASE source_type WHEN 'rss' THEN 'Feed Alpha' WHEN 'wechat' THEN 'Account Beta' ELSE 'Site Gamma' END AS source_name FROM raw_items""")
add("clean_vessel_row", "ships", f"""
SELECT id, {variants('id', "'413000001'", "'41x'", 'NULL', 'NULL', 'NULL')} AS mmsi, imo, name, {variants('id', "''", "'A'", "''")} AS company, 't' AS type, region,
       country, status, '' AS status_date, '' AS remarks FROM ships""")
add("read_feed_files", "raw_items", f"""
SELECT {norm('link')} AS link, CASE WHEN seq % 6 <> 5 THEN {SAFE} END AS title,
       CASE WHEN seq % 8 <> 7 THEN CASE WHEN {DATED} THEN strftime(CAST(pub_date AS DATE), '%a, %d %b %Y') || ' 06:30:00 +0000' ELSE 'unknown' END END AS published,
       CASE WHEN seq % 8 = 7 THEN pub_date END AS updated, 'text ' || seq AS summary_raw FROM raw_items""")
