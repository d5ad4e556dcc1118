"""SQL for the article queries."""

from __future__ import annotations

from oracle.views import NOW, any_word, choose, define, hits, quoted, statement, strip, word_list
from tidewatch import vocab as V

SQL: dict[str, str] = {}
LATER = "TIMESTAMP '2024-02-24 18:00:00'"
START, END = "TIMESTAMP '2024-01-20 08:00:00'", "TIMESTAMP '2024-01-25 18:00:00'"
VISIBLE = "coalesce(is_hidden, 0) = 0 AND coalesce(valid, 1) = 1"


def add(name: str, needs: str, body: str) -> None:
    SQL[name] = statement(needs, body)


def norm(link: str) -> str:
    whole = f"split_part({link}, '#', 1)"
    base = f"split_part({whole}, '?', 1)"
    params = ", ".join(quoted(p) for p in V.TRACKING_PARAMS)
    key = "lower(split_part(p, '=', 1))"
    kept = (f"array_to_string(list_filter(string_split(substr({whole}, length({base}) + 2), '&'), "
            f"lambda p: p <> '' AND NOT (starts_with({key}, 'utm_') OR {key} IN ({params}))), '&')")
    return f"({base} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END)"


def infer(text: str) -> str:
    whens = " ".join(f"WHEN {any_word(f'lower({text})', words)} THEN {quoted(c)}" for c, words in V.CATEGORY_KEYWORDS)
    return f"CASE {whens} END"


def norm_cat(text: str) -> str:
    low = f"lower(trim({text}))"
    compact = rf"regexp_replace({low}, '[^\p{{L}}\p{{N}}]', '', 'g')"
    return (f"CASE WHEN coalesce({low}, '') = '' THEN NULL ELSE coalesce({choose(low, V.CATEGORY_ALIASES)}, "
            f"{choose(compact, V.CATEGORY_COMPACT_ALIASES)}, {infer(low)}) END")


def resolve(category: str, *texts: str) -> str:
    joined = " || ' ' || ".join(f"coalesce({t}, '')" for t in texts)
    return f"coalesce({norm_cat(category)}, {infer(f'({joined})')}, 'Market')"


def variants(key: str, *options: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options))
    return f"CASE {key} % {len(options)} {whens} END"


def parsed_day(text: str) -> str:
    """Publication day of the sample texts, all of which are plain dates or unusable."""
    return rf"CASE WHEN regexp_matches({text}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN CAST({text} AS TIMESTAMP) END"


add("scan_articles", "articles", """
SELECT id, url, title, title_cn, pub_date, source_type, source_name, category, is_hidden, valid, is_retained, created_at FROM articles""")
add("article_by_id", "articles", """
SELECT id, title, url, pub_date, CAST(created_at AS VARCHAR) AS created_at, category, coalesce(category, '') AS categories
FROM articles WHERE id = 42""")
add("articles_by_urls", "articles", f"""
SELECT id, url, title FROM articles WHERE url IN (SELECT {norm('link')} FROM raw_items WHERE source_type = 'rss')""")
add("in_list", "articles", "SELECT id, url FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
add("normalize_url", "raw_items", f"""
SELECT seq AS key, 'item' AS kind, {norm('link')} AS url FROM raw_items UNION ALL
SELECT page_id, 'page', {norm('url')} FROM pages""")
add("normalize_item", "raw_items", f"""
SELECT seq, CASE WHEN seq % 3 <> 0 THEN title ELSE '' END AS title, link, pub_date, '' AS summary_raw, 'rss' AS source_type,
       'feed' AS source_name, {NOW} AS fetched_at FROM raw_items""")
add("complete_item_fields", "raw_items", """
SELECT seq, coalesce(CASE WHEN seq % 2 = 0 THEN nullif(pub_date, '') END, CASE WHEN seq % 4 = 1 THEN '2024-01-15' END) AS pub_date,
       CASE WHEN seq % 3 = 0 THEN source_name WHEN seq % 3 = 1 THEN 'acc' END AS source_name,
       CASE WHEN seq % 5 = 0 THEN source_type WHEN seq % 3 <> 2 THEN 'wechat' END AS source_type FROM raw_items""")
add("rss_content_fallback", "raw_items", """
SELECT seq, CASE WHEN seq % 2 = 0 AND title <> '' THEN title WHEN source_type = 'rss' THEN summary_raw ELSE '' END AS content FROM raw_items""")
RFC = "strftime(created_at, '%a, %d %b %Y %H:%M:%S')"
define("date_texts", ["articles"], "SELECT id, created_at, " + variants(
    "id", "strftime(created_at, '%Y-%m-%d')", "strftime(created_at, '%Y-%m-%dT%H:%M:%S.123')", "strftime(created_at, '%Y-%m-%d %H:%M')",
    f"{RFC} || ' +0000'", "strftime(created_at, '%Y年%-m月%-d日')", "'n/a'", "''", "NULL", f"{RFC} || ' +0800'",
    "'published ' || strftime(created_at, '%Y/%m/%d')") + " AS text FROM articles")
DAY = "date_trunc('day', created_at)::TIMESTAMP"
define("date_parsed", ["date_texts"], f"""
SELECT *, CASE id % 10 WHEN 0 THEN {DAY} WHEN 1 THEN created_at + INTERVAL 123 MILLISECOND WHEN 2 THEN created_at WHEN 3 THEN created_at
     WHEN 8 THEN created_at - INTERVAL 8 HOUR END AS parsed FROM date_texts""")
add("parse_pub_datetime", "date_parsed", "SELECT id, parsed FROM date_parsed")
add("parse_event_datetime", "date_parsed", """
SELECT id, CASE WHEN id % 10 < 3 THEN parsed END AS parsed, id % 10 = 0 AS is_date_only FROM date_parsed""")
add("extract_ymd", "date_texts", """
SELECT id, CASE WHEN id % 10 IN (0, 1, 2, 4, 9) THEN strftime(created_at, '%Y-%m-%d') END AS ymd FROM date_texts""")
add("feed_entry_date", "date_parsed", f"""
SELECT id, CASE WHEN id % 3 = 0 OR id % 10 IN (5, 6, 7) THEN TIMESTAMP '2024-02-01' WHEN id % 10 IN (4, 9) THEN TIMESTAMP '2024-02-01'
     ELSE parsed END AS entry_at FROM date_parsed""")
add("format_date", "date_texts", """
SELECT id, CASE WHEN contains(t, 'T') THEN split_part(t, 'T', 1) WHEN contains(t, ' ') AND contains(t, ':') THEN split_part(t, ' ', 1)
     ELSE substr(t, 1, 10) END AS day FROM (SELECT id, coalesce(trim(text), '') AS t FROM date_texts)""")
add("date_of_text", "date_texts", "SELECT id, CASE WHEN id % 10 < 3 THEN strftime(created_at, '%Y-%m-%d') END AS day FROM date_texts")
add("trim_dates", "date_texts", "SELECT id, CASE WHEN text = '' THEN '' ELSE split_part(text, '.', 1) END AS text FROM date_texts")
add("categories_array", "articles", """
SELECT id, CASE WHEN category IS NULL THEN 0 ELSE 1 END AS n, coalesce(category, '') AS categories FROM articles""")
short = f"length(l) <= 50 AND len(regexp_split_to_array(l, '\\s+')) <= 6 AND {any_word('lower(l)', V.BOILERPLATE_WORDS)}"
add("clean_article_text", "", f"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(
         replace('  Home ' || chr(13) || 'About us' || chr(13) || text || chr(10) || chr(10) || ' Contact and privacy policy ' || chr(10), chr(13), chr(10)),
         chr(10)), lambda x: {strip('x')}), lambda l: l <> '' AND NOT ({short})), chr(10)) AS text FROM documents""")
DIRTY = "('a|b' || chr(13) || chr(10) || summary_cn)"
add("sanitize_cell", "articles", f"""
SELECT id, replace(replace(replace({DIRTY}, '|', ' '), chr(10), ' '), chr(13), '') AS cell,
       replace(replace(replace({DIRTY}, '|', ' '), chr(10), ' '), chr(13), ' ') AS remark, url || '%7Cx' AS link FROM articles""")
add("source_label", "articles", "SELECT id, " + choose(
    "lower(" + variants("id", "source_type", "'RSSHub'", "'official'", "''", "NULL") + ")", V.SOURCE_LABELS, "'Web'") + " AS label FROM articles")


def key_of(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for word in V.TITLE_STOPWORDS:
        out = f"replace({out}, {quoted(word)}, '')"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]', '', 'g')"


ONE_LINE = "replace(replace({}, chr(10), ' '), chr(13), ' ')".format
add("title_key", "articles", f"SELECT id, {key_of(chr(39) + '集团公司 宣布! ' + chr(39) + ' || title')} AS key FROM articles")
add("cut_title", "articles", f"SELECT id, substr({ONE_LINE(strip('summary_cn'))}, 1, 10) AS short FROM articles")
add("yes_no", "articles", "SELECT id, CASE WHEN is_retained = 1 THEN '是' ELSE '否' END AS flag FROM articles")
add("display_title", "articles", f"""
SELECT id, CASE WHEN category = 'Bid' AND coalesce(c, '') <> '' THEN '[中标: ' || c || '] ' || t
     WHEN category = 'Project' AND coalesce(p, '') <> '' THEN '[' || CASE WHEN contains(p, ',') THEN trim(split_part(p, ',', -1)) ELSE p END || '] ' || t
     ELSE t END AS shown
FROM (SELECT *, CASE WHEN length(f) > 50 THEN substr(f, 1, 50) || '...' ELSE f END AS t FROM (
  SELECT id, category, {variants('id', "'ACME'", "''", 'NULL')} AS c, {variants('id', "'Port, Delta , Ghent '", "'Ghent'", 'NULL', "''")} AS p,
         coalesce(nullif(title_cn, ''), nullif(summary_cn, ''), title) AS f FROM articles))""")
add("category_label", "articles", f"""
SELECT id, {choose('category', V.CATEGORY_DISPLAY_LABELS, "'项目信息'")} AS digest, {choose('category', V.CATEGORY_DISPLAY_LABELS, "'其他信息'")} AS history,
       {choose('category', V.CATEGORY_DISPLAY_LABELS, "'其他'")} AS audit FROM articles""")
add("strip_json_fence", "articles", """
SELECT id, CASE WHEN ok THEN false END AS is_junk, CASE WHEN ok THEN category END AS category, CASE WHEN ok THEN title END AS title_cn,
       CASE WHEN ok THEN strftime(created_at, '%Y-%m-%d') END AS publish_time FROM (SELECT *, id % 4 <> 3 AS ok FROM articles)""")
add("normalize_llm_result", "articles", """
SELECT id, CASE id % 4 WHEN 1 THEN false WHEN 3 THEN NULL ELSE true END AS is_junk,
       CASE id % 4 WHEN 1 THEN 'Market' WHEN 3 THEN NULL ELSE 'Bid' END AS category,
       CASE id % 4 WHEN 1 THEN title WHEN 3 THEN NULL ELSE 't' END AS title_cn, CASE id % 4 WHEN 1 THEN pub_date END AS publish_time FROM articles""")

add("visible_valid", "articles", f"SELECT id FROM articles WHERE {VISIBLE}")
add("freshness", "raw_items", f"""
SELECT seq, p AS pub_ts, coalesce(p < {NOW} - INTERVAL 5 DAY, false) AS is_stale FROM (SELECT seq, {parsed_day('pub_date')} AS p FROM raw_items)""")
errors = " ".join(f"WHEN contains(lower(t), {quoted(w.lower())}) THEN {quoted('error_page:' + w)}" for w in V.ERROR_TITLE_PARTS)
add("valid_title", "raw_items", f"""
SELECT seq, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 3 THEN 'too_short' WHEN list_contains({word_list(V.JUNK_TITLES)}, t) THEN 'junk_title'
     {errors} WHEN starts_with(lower(t), 'back to') AND length(t) < 20 THEN 'back_to' WHEN contains(lower(u), 'javascript') THEN 'script_link' END AS verdict
FROM (SELECT seq, {strip("CASE seq % 9 WHEN 4 THEN 'About Us' WHEN 5 THEN 'hi' WHEN 6 THEN 'Back to top' ELSE title END")} AS t,
             CASE WHEN seq % 10 = 3 THEN 'JavaScript:void(0)' ELSE link END AS u FROM raw_items)""")
JUNK = f"(title = '' OR {any_word('lower(title)', V.JUNK_TITLE_PARTS)} OR length({strip('title')}) < 5)"
add("obvious_junk_title", "raw_items", f"SELECT seq, {JUNK} AS is_junk FROM raw_items")
add("article_filter", "articles", """
SELECT id FROM articles WHERE coalesce(is_hidden, 0) = 0 AND valid = 1 AND is_retained = 1
AND CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-28'
AND (title ILIKE '%dredg%' OR coalesce(title_cn, '') ILIKE '%dredg%' OR summary_cn ILIKE '%dredg%')""")
add("article_filter_fields", "articles", """
SELECT id FROM articles WHERE coalesce(is_hidden, 0) = 0 AND category = 'Equipment' AND source_type = 'wechat' AND source_name = 'src9'""")
add("keyword_search", "articles", """
SELECT id, title FROM articles WHERE title ILIKE '%TERMINAL%' OR coalesce(title_cn, '') ILIKE '%TERMINAL%' OR summary_cn ILIKE '%TERMINAL%'""")
add("needs_enrichment", "articles", f"""
SELECT id FROM articles WHERE valid = 1 AND (pub_date >= '2024-01-25' OR coalesce(pub_date, '') = '')
AND (coalesce(content, '') = '' OR coalesce(screenshot_path, '') = '') AND created_at >= {START}""")
NEEDS = "valid = 1 AND coalesce(content, '') <> '' AND coalesce(summary_cn, '') = ''"
add("needs_analysis", "articles", f"SELECT id FROM articles WHERE {NEEDS}")
DONE = "(coalesce(valid = 0, false) OR coalesce(is_retained = 1, false) OR coalesce(length(summary_cn) > 5, false))"
add("is_processed", "articles", f"SELECT id, {DONE} AS is_processed FROM articles")
add("time_range", "articles", f"SELECT id, created_at FROM articles WHERE created_at BETWEEN {START} AND {END}")
add("recent_retained", "articles", f"SELECT id, pub_date FROM articles WHERE is_retained = 1 AND created_at >= {NOW} - INTERVAL 48 HOUR")
add("publish_window_filter", "articles", f"""
SELECT id FROM articles WHERE created_at BETWEEN {START} AND {END}
OR coalesce(CAST({parsed_day('pub_date')} AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-25', false)""")
STALE30 = f"coalesce(date_diff('day', CAST({parsed_day('pub_date')} AS DATE), CAST({LATER} AS DATE)) > 30, false)"
add("stale_on_insert", "articles", f"""
SELECT id, CASE WHEN s THEN 1 ELSE 0 END AS is_hidden, CASE WHEN s THEN 0 ELSE coalesce(valid, 1) END AS valid,
       CASE WHEN s THEN '过期' ELSE '' END AS remark FROM (SELECT *, {STALE30} AS s FROM articles)""")
add("post_enrich_validity", "articles", f"""
SELECT id, CASE WHEN p IS NULL OR p < {NOW} - INTERVAL 5 DAY THEN 0 ELSE valid END AS valid,
       CASE WHEN p IS NULL THEN coalesce(r, '') || ' (补充采集仍无时间)' WHEN p < {NOW} - INTERVAL 5 DAY THEN '补充采集后判定过期' ELSE r END AS remark
FROM (SELECT *, {parsed_day('pub_date')} AS p, CASE WHEN id % 2 = 0 THEN 'seen' END AS r FROM articles)""")

add("normalize_category", "articles", f"SELECT id, {norm_cat('t')} AS category FROM (SELECT id, " + variants(
    "id", "category", "' R and D '", "'R & D'", "'news'", "'新闻'", "title", "''", "NULL", "'RD!'", "'Research, Development'", "'Other'") + " AS t FROM articles)")
add("infer_category", "", f"SELECT doc_id, {infer('text')} AS category FROM documents")
add("resolve_category", "articles", f"SELECT id, {resolve('category', 'title', 'title_cn', 'summary_cn', chr(39) * 2)} AS category FROM articles")
add("primary_category", "articles", f"""
SELECT id, coalesce(list_filter({word_list(V.PRIMARY_CATEGORY_ORDER)}, lambda c: list_contains(cats, c))[1], cats[1], 'Market') AS category
FROM (SELECT id, CASE WHEN id % 5 = 0 THEN [] ELSE list_filter([category, {word_list(V.CATEGORIES)}[CAST(id % 7 AS INTEGER) + 1]], lambda x: x IS NOT NULL) END AS cats FROM articles)""")


def relevant(source: str, url: str, category: str, *texts: str) -> str:
    body = "lower(concat_ws(' ', " + ", ".join(f"nullif({t}, '')" for t in texts) + "))"
    known = norm_cat(category)
    return (f"(coalesce({any_word(f'lower({source})', V.RELEVANT_SOURCE_WORDS)}, false) OR coalesce({any_word(f'lower({url})', V.RELEVANT_URL_WORDS)}, false) "
            f"OR coalesce({known}, 'Other') <> 'Other' OR {any_word(body, V.STRONG_WORDS)} OR {hits(body, V.SECONDARY_WORDS)} >= 2)")


define("judged", ["articles"], "SELECT *, " + relevant("source_name", "url", "CASE WHEN id % 3 = 0 THEN category END", "title", "title_cn",
                                                      "summary_cn", "content") + " AS is_relevant FROM articles")
add("relevance", "judged", "SELECT id, is_relevant FROM judged")
add("retention_flags", "judged", f"""
SELECT id, CASE WHEN is_relevant THEN 1 ELSE 0 END AS valid, c AS category, CASE WHEN is_relevant AND c <> 'Other' THEN 1 ELSE 0 END AS is_retained,
       CASE WHEN NOT is_relevant THEN '无效数据' WHEN c <> 'Other' THEN '保留' ELSE 'AI判定无关' END AS remark
FROM (SELECT *, CASE WHEN is_relevant THEN coalesce({norm_cat('category')}, 'Market') ELSE 'Other' END AS c FROM judged)""")
add("result_pub_date", "articles", "SELECT id, CASE WHEN id % 4 = 0 THEN '2024-01-09' ELSE pub_date END AS pub_date FROM articles")
add("resolve_category_keep_other", "articles", f"""
SELECT id, CASE WHEN lower(trim(category)) = 'other' THEN 'Other' ELSE {resolve('category', 'title', 'title_cn', 'summary_cn')} END AS category FROM articles""")
add("contains_any_word", "", r"""
SELECT doc_id, coalesce(regexp_matches(lower(text), '(^|[^a-z0-9])(the|of|und|là|\+1)([^a-z0-9]|$)'), false) AS hit FROM documents""")
add("contains_any", "", f"SELECT doc_id, {any_word('lower(text)', V.SECONDARY_WORDS)} AS hit FROM documents")

add("daily_counts", "articles", f"""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS articles FROM articles
WHERE created_at >= {NOW} - INTERVAL 7 DAY AND {VISIBLE} GROUP BY 1""")
add("total_count", "articles", f"SELECT count(*) AS total FROM articles WHERE {VISIBLE}")
CAT = "CASE WHEN coalesce(category, '') IN ('', 'None') THEN 'Unknown' ELSE category END"
LABEL = choose("category", V.CATEGORY_CHART_LABELS, "category")
define("cat_counts", ["articles"], f"SELECT {CAT} AS category, count(*) AS articles FROM articles GROUP BY 1")
add("category_counts", "cat_counts", f"SELECT *, {LABEL} AS label FROM cat_counts")
DAYTEXT = r"substr(coalesce(nullif(pub_date, ''), CAST(created_at AS VARCHAR)), 1, 10)"
define("trend_cells", ["articles"], f"""
SELECT category, day, count(*) AS n FROM (SELECT {CAT} AS category, CASE WHEN regexp_matches({DAYTEXT}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {DAYTEXT} END AS day
FROM articles) GROUP BY ALL""")
define("trend", ["trend_cells"], """
SELECT c.category, d.day, coalesce(n, 0) AS articles FROM (SELECT DISTINCT category FROM trend_cells) c
CROSS JOIN (SELECT DISTINCT day FROM trend_cells WHERE day IS NOT NULL) d LEFT JOIN trend_cells t ON t.category = c.category AND t.day = d.day""")
add("category_trend", "trend", f"SELECT category, day, articles, {LABEL} AS label FROM trend")
SRC = "CASE WHEN coalesce(source_name, '') IN ('', 'None') THEN source_type ELSE source_name END"
for name, n in (("source_top20", 20), ("top_sources", 5)):
    add(name, "articles", f"SELECT {SRC} AS source, count(*) AS articles FROM articles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}")
DIGEST = [c for c, _ in V.DIGEST_LABELS]
places = " UNION ALL ".join(f"SELECT {quoted(c)} AS category, {i} AS place" for i, c in enumerate(DIGEST))
BUCKET = f"CASE WHEN list_contains({word_list(DIGEST)}, category) THEN category ELSE 'Market' END"
add("digest_category_counts", "articles", f"""
SELECT l.category, l.place, coalesce(n, 0) AS articles FROM ({places}) l LEFT JOIN
(SELECT {BUCKET} AS category, count(DISTINCT id) AS n FROM articles WHERE created_at BETWEEN {START} AND {END} GROUP BY 1) c USING (category)""")
add("group_by_source", "articles", """
SELECT id, source_name, created_at, g AS source_group, count(*) OVER (PARTITION BY g) AS group_size
FROM (SELECT *, coalesce(nullif(source_name, ''), '其他来源') AS g FROM articles)""")
SECTION = "list_position(" + word_list([c for c, _ in V.REPORT_SECTIONS]) + ", {})::INTEGER"
add("group_by_category", "articles", f"""
SELECT id, category, {SECTION.format('category')} AS section_order FROM articles WHERE list_contains({word_list([c for c, _ in V.REPORT_SECTIONS])}, category)""")
add("all_dates_union", "trend_cells", "SELECT DISTINCT day FROM trend_cells WHERE day IS NOT NULL")
define("in_range", ["articles"], "SELECT * FROM articles WHERE created_at BETWEEN TIMESTAMP '2023-12-31 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59'")
add("statistics_bundle", "in_range cat_counts trend", f"""
SELECT 'category' AS part, {LABEL} AS key, CAST(NULL AS VARCHAR) AS day, articles AS n FROM cat_counts
UNION ALL SELECT 'trend', {LABEL}, day, articles FROM trend
UNION ALL SELECT 'source', source, NULL, articles FROM (SELECT {SRC} AS source, count(*) AS articles FROM in_range GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""")
add("run_history", "articles", """
SELECT run_id, CAST(strptime(run_id, '%Y%m%d_%H%M%S') AS TIMESTAMP) AS run_at, searched, kept,
       '(搜' || searched || '条，入' || kept || '条)' AS summary
FROM (SELECT strftime(created_at, '%Y%m%d_000000') AS run_id, count(*) AS searched, count(*) FILTER (is_retained = 1) AS kept FROM articles GROUP BY 1)""")

PAGE = "coalesce(is_hidden, 0) = 0 AND valid = 1"
for name in ("paged_articles", "paged_after"):
    add(name, "articles", f"""
SELECT id, title, pub_date, source_type, CAST(created_at AS VARCHAR) AS created_at, category FROM articles WHERE {PAGE}
ORDER BY articles.created_at DESC, articles.pub_date DESC, id DESC LIMIT 50 OFFSET 50""")
add("paged_total", "articles", f"SELECT count(*) AS total FROM articles WHERE {PAGE}")
add("report_order", "articles", f"SELECT id, created_at FROM articles WHERE created_at BETWEEN {START} AND {END} AND {VISIBLE}")
add("events_window", "articles", f"""
SELECT id, title, created_at FROM articles WHERE created_at BETWEEN {NOW} - INTERVAL 1 DAY AND {NOW} AND {VISIBLE} AND is_retained = 1""")
TITLE = "coalesce(nullif(title_cn, ''), nullif(title, ''))"
add("hot_titles", "articles", f"""
SELECT CAST(p - 1 AS INTEGER) AS pos, CASE WHEN p = 5 THEN '...' ELSE short END AS title FROM (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS p FROM (
    SELECT id, created_at, substr({ONE_LINE(strip(TITLE))}, 1, 10) AS short FROM articles WHERE created_at BETWEEN {START} AND {END}) WHERE short <> '') WHERE p <= 5""")
add("title_dedup_top5", "articles", f"""
SELECT id, shown AS shown_title FROM (SELECT id, created_at, {TITLE} AS shown FROM articles WHERE created_at BETWEEN {START} AND {END}
  QUALIFY row_number() OVER (PARTITION BY shown ORDER BY created_at DESC, id DESC) = 1) ORDER BY created_at DESC, id DESC LIMIT 5""")
add("report_dedup", "articles", "SELECT id, category, created_at FROM articles")
WHOLE_KEY = key_of("coalesce(nullif(title_cn, ''), nullif(title, ''), nullif(summary_cn, ''))")
add("dedup_market_titles", "articles", f"""
SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY coalesce(category, ''),
  CASE WHEN category = 'Market' THEN coalesce(nullif({WHOLE_KEY}, ''), url) ELSE CAST(id AS VARCHAR) END ORDER BY created_at DESC, id DESC) AS rn FROM articles) WHERE rn = 1""")
D0 = "CAST(CAST(created_at AS DATE) AS TIMESTAMP)"
add("push_window", "articles", f"""
SELECT id, {D0} + CASE WHEN m THEN INTERVAL (-6) HOUR ELSE INTERVAL 8 HOUR END AS window_start,
       {D0} + CASE WHEN m THEN INTERVAL 8 HOUR ELSE INTERVAL 18 HOUR END AS window_end,
       month(created_at) || '月' || day(created_at) || '日' || CASE WHEN m THEN '早报' ELSE '晚报' END AS label
FROM (SELECT *, hour(created_at) <= 8 AS m FROM articles)""")
add("report_range", "articles", f"""
SELECT id, {D0} + CASE WHEN id % 2 = 0 THEN INTERVAL (-6) HOUR ELSE INTERVAL 8 HOUR END AS window_start,
       {D0} + CASE WHEN id % 2 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 18 HOUR END AS window_end FROM articles""")
WINDOW = f"created_at BETWEEN TIMESTAMP '2024-01-30 08:00:00' AND TIMESTAMP '2024-01-30 18:00:00' AND {VISIBLE} AND is_retained = 1"
line = " || ' | ' || ".join(f"{quoted(n)} || count(DISTINCT id) FILTER (b = {quoted(c)})" for c, n in V.DIGEST_LABELS)
add("daily_digest", "articles", f"""
SELECT '1月30日晚报' AS label, total, category_line, '【情报简报 1月30日晚报】' || chr(10) ||
       CASE WHEN total = 0 THEN '截至目前，暂无最新情报更新。' ELSE '本次更新: ' || total || ' 条' || chr(10) || chr(10) || category_line END AS message
FROM (SELECT count(*) AS total, {line} AS category_line FROM (SELECT *, {BUCKET} AS b FROM articles WHERE {WINDOW}))""")
add("digest_cover", "articles", f"""
SELECT path, split_part(path, '/', -1) AS file FROM (SELECT arg_max(screenshot_path, (created_at, id)) AS path FROM articles
WHERE {WINDOW} AND screenshot_path <> '')""")
names = {c: "## " + t for c, t in V.REPORT_SECTIONS}
add("markdown_report", "articles", f"""
SELECT id, {SECTION.format('c')} AS section_order, {choose('c', names)} AS section,
       '### [' || CASE WHEN coalesce(title_cn, '') <> '' AND title_cn <> title THEN '[译] ' ELSE '' END || coalesce(nullif(title_cn, ''), title) || '](' || url || ')' AS heading,
       '- **摘要**: ' || summary_cn AS summary_line, CASE WHEN id % 4 = 0 THEN '- **👀 视觉补充**: a quay' END AS picture_line
FROM (SELECT *, CASE WHEN coalesce({norm_cat('category')}, 'Market') = 'Other' THEN 'Market' ELSE coalesce({norm_cat('category')}, 'Market') END AS c FROM articles)""")
add("write_articles", "articles", """
SELECT id, url, CASE WHEN created_at >= TIMESTAMP '2024-01-20' THEN '2 ' || title ELSE title END AS title, valid, created_at,
       strftime(created_at, '%Y-%m-%d') AS created_date FROM articles""")
