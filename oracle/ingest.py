"""SQL for collection, merging and model results."""

from __future__ import annotations

from oracle.articles import DONE, JUNK, NEEDS, norm, norm_cat, parsed_day, relevant, resolve
from oracle.views import NOW, choose, define, statement
from tidewatch import vocab as V

SQL: dict[str, str] = {}


def add(name: str, needs: str, body: str) -> None:
    SQL[name] = statement(needs, body)


define("items", ["raw_items"], f"""
SELECT * EXCLUDE (link), {norm('link')} AS link, CASE WHEN seq % 37 = 0 THEN '栏目页' END AS filtered_reason FROM raw_items""")
add("dedup_in_run", "items", "SELECT seq, link, row_number() OVER (PARTITION BY link ORDER BY seq) > 1 AS is_duplicate FROM items")
add("new_minus_store", "items store", "SELECT seq, link FROM items WHERE link NOT IN (SELECT url FROM store)")
define("inserted", ["items", "store"], f"""
SELECT link AS url, title, pub_date, source_type, source_name, CASE WHEN source_type = 'rss' THEN summary_raw ELSE '' END AS content,
       '' AS remark, 0 AS is_hidden, 1 AS valid, 0 AS is_retained, {NOW} AS created_at
FROM items WHERE link NOT IN (SELECT url FROM store) QUALIFY row_number() OVER (PARTITION BY link ORDER BY seq) = 1""")
add("insert_new_only", "inserted", "SELECT * FROM inserted")
define("scan_counts", ["items", "inserted"], """
SELECT (SELECT count(*) FROM items) AS scanned, (SELECT count(*) FROM inserted) AS inserted""")
add("insert_counts", "scan_counts", "SELECT * FROM scan_counts")
add("processed_lookup", "items store", f"""
SELECT i.seq, coalesce(s.done, false) AS is_processed FROM items i LEFT JOIN (SELECT url, {DONE} AS done FROM store) s ON i.link = s.url""")


def decide(name: str, reason: str) -> None:
    define(name, ["items", "store"], f"""
SELECT *, CASE d WHEN 'empty' THEN '标题或链接为空' WHEN 'duplicate' THEN '重复链接(任务内)' WHEN 'processed' THEN '已存在且已处理'
     WHEN 'filtered' THEN '采集阶段过滤: ' || reason WHEN 'no_date' THEN '发布时间缺失' WHEN 'old' THEN '发布时间早于5天(已入库)' ELSE '待分析' END AS remark,
     CASE WHEN d IN ('empty', 'filtered', 'no_date', 'old') THEN 0 WHEN d = 'pending' THEN 1 END AS new_valid,
     CASE WHEN d = 'filtered' THEN 1 END AS new_hidden
FROM (SELECT *, CASE WHEN is_empty THEN 'empty' WHEN rn > 1 THEN 'duplicate' WHEN done OR empty_before THEN 'processed'
     WHEN reason IS NOT NULL THEN 'filtered' WHEN p IS NULL AND source_type NOT IN ('web', 'official', 'rsshub') THEN 'no_date'
     WHEN p < {NOW} - INTERVAL 5 DAY THEN 'old' ELSE 'pending' END AS d
  FROM (SELECT i.*, {reason} AS reason, {parsed_day('pub_date')} AS p, i.title = '' AS is_empty, coalesce(s.done, false) AS done,
        row_number() OVER (PARTITION BY link, i.title = '' ORDER BY seq) AS rn,
        coalesce(bool_or(i.title = '') OVER (PARTITION BY link ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS empty_before
    FROM items i LEFT JOIN (SELECT url, {DONE} AS done FROM store) s ON i.link = s.url))""")


decide("decided", "filtered_reason")
decide("decided_plain", "CAST(NULL AS VARCHAR)")
add("ingest_disposition", "decided", "SELECT seq, link, d AS disposition, remark, new_valid, new_hidden FROM decided")
define("audit", ["decided"], """
SELECT seq, source_name AS site, title, link, pub_date, source_type, false AS keep, remark FROM decided""")
add("audit_projection", "audit", "SELECT * FROM audit")

TEXTS = ["title", "title_cn", "pub_date", "source_type", "source_name", "summary_cn"]


def upsert(base: str, updates: str, now: str, inserts: bool) -> str:
    """Final store of ``updates`` (url, seq, columns, cat) over ``base``."""
    last = ", ".join(f"arg_max({c}, seq) FILTER ({c} <> '') AS n_{c}" for c in [*TEXTS, "remark"])
    flags = ", ".join(f"arg_max({c}, seq) FILTER ({c} IS NOT NULL) AS n_{c}, max(seq) FILTER ({c} IS NOT NULL) AS at_{c}"
                      for c in ("valid", "is_hidden", "is_retained"))
    stale = f"coalesce(date_diff('day', CAST({parsed_day('m.first_pub')} AS DATE), CAST({now} AS DATE)) > 30, false)"

    def text(c: str) -> str:
        empty = "'unknown'" if c == "source_type" else "''"
        new = f"coalesce(m.n_{c}, {empty})"
        return f"CASE WHEN b.url IS NULL THEN {new} ELSE coalesce(m.n_{c}, b.{c}) END AS {c}"

    def flag(c: str, first: str) -> str:
        later = f"CASE WHEN m.at_{c} > m.first_seq THEN m.n_{c} END"
        return f"CASE WHEN b.url IS NULL THEN coalesce({later}, {first}) ELSE coalesce(m.n_{c}, b.{c}) END AS {c}"

    return f"""
SELECT coalesce(b.url, m.url) AS url, {', '.join(text(c) for c in TEXTS)}, coalesce(m.cat, b.category) AS category,
       {flag('valid', f'CASE WHEN {stale} THEN 0 ELSE coalesce(m.first_valid, 1) END')},
       {flag('is_hidden', f'CASE WHEN {stale} THEN 1 ELSE 0 END')},
       CASE WHEN b.url IS NULL THEN coalesce(m.n_is_retained, 0) ELSE coalesce(m.n_is_retained, b.is_retained) END AS is_retained,
       CASE WHEN b.url IS NULL THEN coalesce(CASE WHEN m.at_remark > m.first_seq THEN m.n_remark END, CASE WHEN {stale} THEN '过期' END, m.n_remark, '')
            ELSE coalesce(m.n_remark, b.remark) END AS remark,
       coalesce(b.created_at, {now}) AS created_at
FROM {base} b FULL OUTER JOIN (SELECT url, min(seq) AS first_seq, arg_max(cat, seq) AS cat, first(valid ORDER BY seq) AS first_valid,
       first(pub_date ORDER BY seq) AS first_pub, max(seq) FILTER (remark <> '') AS at_remark, {last}, {flags} FROM {updates} GROUP BY url) m ON b.url = m.url"""


define("store_r", ["store"], "SELECT *, CAST(NULL AS VARCHAR) AS remark FROM store")
define("upd_raw", ["items"], """
SELECT link AS url, seq, title, CAST(NULL AS VARCHAR) AS title_cn, pub_date, source_type, source_name,
       CASE WHEN seq % 5 = 0 THEN summary_raw ELSE '' END AS summary_cn,
       CASE seq % 7 WHEN 0 THEN 'Other' WHEN 1 THEN 'news' END AS category, CASE seq % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS valid,
       CASE WHEN seq % 6 = 0 THEN 1 END AS is_hidden, CASE WHEN seq % 3 = 0 THEN 1 END AS is_retained,
       CASE WHEN seq % 8 = 0 THEN '备注' || seq ELSE '' END AS remark FROM items""")
define("upd", ["upd_raw"], f"SELECT *, {resolve('category', 'title', 'title_cn', 'summary_cn')} AS cat FROM upd_raw")
add("upsert_articles", "store_r upd", upsert("store_r", "upd", "TIMESTAMP '2024-02-24 18:00:00'", True))
define("grown_store", ["store_r", "inserted"], """
SELECT url, title, title_cn, pub_date, source_type, source_name, summary_cn, category, valid, is_hidden, is_retained, remark, created_at FROM store_r
UNION ALL SELECT url, title, NULL, pub_date, source_type, source_name, NULL, NULL, valid, is_hidden, is_retained, remark, created_at FROM inserted""")
define("run_updates", ["decided_plain"], """
SELECT link AS url, seq, '' AS title, '' AS title_cn, pub_date, source_type, source_name, '' AS summary_cn, 'Market' AS cat, new_valid AS valid,
       new_hidden AS is_hidden, CAST(NULL AS INTEGER) AS is_retained, CASE WHEN new_valid = 0 THEN remark END AS remark
FROM decided_plain WHERE new_valid IS NOT NULL""")
add("ingest_job", "grown_store run_updates", upsert("grown_store", "run_updates", NOW, True))
add("union_sources", "raw_items", """
SELECT seq, title, link, source_type FROM raw_items UNION ALL SELECT page_id, NULL, url, 'page' FROM pages""")
add("source_fetch_stats", "raw_items", """
SELECT name, CASE WHEN bad THEN 'failed' ELSE 'success' END AS status, CASE WHEN bad THEN 0 ELSE coalesce(n, 0) END AS count
FROM (SELECT 'src' || s_suppkey AS name, s_suppkey % 9 = 4 AS bad FROM supplier) LEFT JOIN
     (SELECT source_name AS name, count(*) AS n FROM raw_items GROUP BY 1) USING (name)""")
add("source_fetch_totals", "raw_items", """
SELECT count(*) FILTER (source_name <> 'src3') AS total_fetched, count(DISTINCT source_name) FILTER (source_name <> 'src3') AS total_success,
       count(DISTINCT source_name) FILTER (source_name = 'src3') AS total_failed FROM raw_items""")

define("judgement", ["articles", "analysis"], f"""
SELECT *, CASE WHEN jt THEN 'junk_title' WHEN text_ok THEN 'text' WHEN vl_ok THEN 'image'
     WHEN coalesce(t_is_junk, false) OR coalesce(v_is_junk, false) THEN 'junk' ELSE 'failed' END AS way
FROM (SELECT a.*, n.* EXCLUDE (url), {JUNK} AS jt, has_text AND NOT t_is_junk AS text_ok, coalesce(has_vl AND NOT v_is_junk, false) AS vl_ok
      FROM articles a JOIN analysis n USING (url))""")
define("best", ["judgement"], """
SELECT *, CASE way WHEN 'text' THEN t_category WHEN 'image' THEN v_category END AS b_category,
     CASE way WHEN 'text' THEN coalesce(nullif(t_title_cn, ''), CASE WHEN vl_ok THEN v_title_cn END, t_title_cn, title) WHEN 'image' THEN coalesce(v_title_cn, title) END AS b_title,
     CASE way WHEN 'text' THEN coalesce(t_summary_cn, '暂无摘要') WHEN 'image' THEN '暂无摘要' END AS b_summary,
     CASE way WHEN 'text' THEN coalesce(nullif(t_publish_time, ''), CASE WHEN vl_ok THEN v_publish_time END) WHEN 'image' THEN v_publish_time END AS b_time
FROM judgement""")
define("settled", ["best"], "SELECT *, " + relevant("source_name", "url", "b_category", "title", "b_title", "b_summary", "content") +
       " AS rel, way IN ('text', 'image') AS has FROM best")
define("merged", ["settled"], f"""
SELECT id, url, title, CASE WHEN way = 'junk_title' THEN title WHEN has THEN b_title WHEN has_vl THEN coalesce(v_title_cn, title)
            WHEN has_text THEN coalesce(t_title_cn, title) ELSE title END AS title_cn,
       CASE WHEN has AND length(b_time) >= 10 THEN b_time ELSE coalesce(pub_date, '') END AS pub_date,
       CASE WHEN way = 'junk_title' THEN '垃圾信息/非新闻页面' WHEN has THEN b_summary WHEN has_vl THEN reason
            WHEN has_text THEN coalesce(t_summary_cn, reason) ELSE reason END AS summary_cn,
       c AS category, CASE WHEN has AND rel THEN 1 ELSE 0 END AS valid, CASE WHEN has AND rel AND c <> 'Other' THEN 1 ELSE 0 END AS is_retained,
       way IN ('junk', 'failed') AS is_junk,
       CASE WHEN way = 'junk_title' THEN '标题命中垃圾关键词' WHEN NOT has THEN reason WHEN NOT rel THEN '无效数据' WHEN c <> 'Other' THEN '保留' ELSE 'AI判定无关' END AS remark,
       CASE WHEN way = 'junk_title' OR (way = 'text' AND NOT vl_ok) THEN '' ELSE coalesce(image_desc, '') END AS image_desc, way,
       '1. **访问目标**: [' || title || '](' || url || ')' || chr(10) || CASE way WHEN 'junk_title' THEN '4. **前置检查**: 标题命中垃圾关键词'
         WHEN 'text' THEN '4. **Text分析 (优先)**: 成功 (' || coalesce(b_category, 'None') || ')' || chr(10) ||
           CASE WHEN vl_ok THEN '4.1. **VL辅助**: 补充图片描述与时间' ELSE '4.1. **VL辅助**: 无有效视觉内容' END
         WHEN 'image' THEN '4. **VL分析 (兜底)**: 成功 (' || b_category || ')' ELSE '4. **分析结论**: ' || reason END ||
         CASE WHEN has AND NOT rel THEN chr(10) || '4.2. **相关性判断**: 非疏浚主题，标记为无效并归入''其他''' ELSE '' END AS log,
       screenshot_path, source_type, coalesce(source_name, '') AS source_name
FROM (SELECT *, CASE way WHEN 'junk' THEN '判定为垃圾信息' ELSE '分析失败' END AS reason,
             CASE WHEN has AND rel THEN coalesce({norm_cat('b_category')}, 'Market') ELSE 'Other' END AS c FROM settled)""")
add("analysis_merge", "merged", "SELECT * EXCLUDE (screenshot_path, source_type, source_name) FROM merged")
define("outcomes", ["merged"], """
SELECT id, summary_cn <> '' AS text_ok, CASE WHEN screenshot_path <> '' THEN image_desc <> '' END AS vl_ok, NOT is_junk AS kept FROM merged""")
add("result_outcome_flags", "outcomes", "SELECT * FROM outcomes")
define("run_dates", ["items"], "SELECT link AS url, first(pub_date ORDER BY seq) AS run_date FROM items WHERE title <> '' GROUP BY link")


def gate(name: str, source: str, judged: str) -> None:
    define(name, [source, "run_dates"], f"""
SELECT * EXCLUDE (is_retained, remark, pub_date, p, run_date), CASE WHEN is_dropped THEN 0 ELSE is_retained END AS is_retained,
       CASE WHEN is_dropped AND is_retained = 1 THEN '发布时间早于5天' ELSE remark END AS remark,
       CASE WHEN is_dropped THEN pub_date ELSE coalesce(nullif(pub_date, ''), run_date) END AS pub_date
FROM (SELECT *, p IS NULL OR p < {NOW} - INTERVAL 5 DAY AS is_dropped FROM
  (SELECT m.*, r.run_date, {parsed_day(judged)} AS p FROM {source} m LEFT JOIN run_dates r USING (url)))""")


gate("gated", "merged", "r.run_date")
gate("gated_own", "merged", "m.pub_date")
for key, table in (("run_date_gate", "gated"), ("run_date_gate_result", "gated_own")):
    add(key, table, f"SELECT id, is_dropped, is_retained, remark, pub_date FROM {table}")


def outcome(name: str, audit: str, results: str) -> None:
    define(name, [audit, results], f"""
SELECT a.seq, a.site, a.title, a.link, a.pub_date, a.source_type, k AS keep, CASE WHEN k THEN coalesce(nullif(g_title, ''), a.title) END AS title_cn,
       k AND coalesce(txt, false) AS text_ok, k AND coalesce(shot, false) AS vl_ok,
       CASE WHEN remark <> '待分析' THEN remark WHEN hit IS NULL THEN '分析未通过(可能提取失败)' WHEN is_dropped THEN '发布时间早于5天'
            WHEN is_retained = 1 THEN '保留' WHEN is_junk THEN 'AI判定无关: 非疏浚主题' WHEN valid = 0 THEN '无效数据 (valid=0)' ELSE '未保留 (is_retained=0)' END AS remark
FROM (SELECT a.* EXCLUDE (keep), g.*, a.remark = '待分析' AND coalesce(NOT is_dropped AND is_retained = 1, false) AS k FROM {audit} a LEFT JOIN
  (SELECT url, true AS hit, is_dropped, is_retained, is_junk, valid, title_cn AS g_title, title_cn <> '' OR summary_cn <> '' AS txt,
          screenshot_path <> '' AS shot FROM {results}) g ON a.link = g.url) a""")


outcome("outcome", "audit", "gated")
add("audit_outcome_join", "outcome", "SELECT seq, title_cn, keep, text_ok, vl_ok, remark FROM outcome")


def clean(expr: str) -> str:
    return f"replace(replace(replace(coalesce({expr}, ''), '|', ' '), chr(10), ' '), chr(13), '')"


YES = "CASE WHEN {} THEN '是' ELSE '否' END".format
define("table_rows", ["outcome"], f"""
SELECT seq, {clean('site')} AS site, {clean("coalesce(nullif(title_cn, ''), nullif(title, ''))")} AS name, substr(trim(pub_date), 1, 10) AS day, {YES('keep')} AS keep,
       {YES('text_ok')} AS text_ok, {YES('vl_ok')} AS vl_ok, {choose('source_type', V.SOURCE_LABELS, "'Web'")} AS source, remark, link FROM outcome""")
add("audit_table", "table_rows", "SELECT * FROM table_rows")
add("write_audit", "table_rows", "SELECT seq, name, keep, remark, '20240130_180000' AS run_id FROM table_rows")
add("run_summary", "scan_counts audit outcomes", """
SELECT s.*, a.*, o.*, round(coalesce(text_success * 100.0::DOUBLE / nullif(analysed, 0), 0), 6) AS text_rate,
       round(coalesce(image_success * 100.0::DOUBLE / nullif(image_success + image_failed, 0), 0), 6) AS image_rate
FROM scan_counts s, (SELECT count(*) FILTER (remark = '标题或链接为空') AS skipped, count(*) FILTER (remark = '重复链接(任务内)') AS duplicates,
  count(*) FILTER (remark = '已存在且已处理') AS processed, count(*) FILTER (remark IN ('发布时间缺失', '发布时间早于5天(已入库)')) AS outdated FROM audit) a,
  (SELECT count(*) AS analysed, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS junk, count(*) FILTER (text_ok) AS text_success,
   count(*) FILTER (vl_ok) AS image_success, count(*) FILTER (NOT vl_ok) AS image_failed FROM outcomes) o""")
define("todo_merged", ["merged", "store"], f"SELECT * FROM merged WHERE url IN (SELECT url FROM store WHERE {NEEDS})")
gate("todo_gated", "todo_merged", "r.run_date")
define("job_updates", ["todo_gated"], f"""
SELECT url, id AS seq, title, title_cn, pub_date, source_type, source_name, summary_cn, {resolve('category', 'title', 'title_cn', 'summary_cn')} AS cat,
       valid, CAST(NULL AS INTEGER) AS is_hidden, is_retained, remark FROM todo_gated""")
add("analysis_job", "store_r job_updates", upsert("store_r", "job_updates", NOW, False))
outcome("job_outcome", "audit", "todo_gated")
add("analysis_job_audit", "job_outcome", "SELECT seq, keep, text_ok, vl_ok, remark FROM job_outcome")
SQL["upsert_store"] = SQL["upsert_articles"]
SQL["ingest_into_store"] = SQL["ingest_job"]
