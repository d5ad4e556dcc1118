"""The operators' results in SQL, where SQL can express them."""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, {_LOWER.format(f'trim(line, {_BLANK})')} AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, coalesce(doc_id < last, false) AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

LEAKS = f"""
WITH item_words AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_WORDS}'), []) AS w FROM documents),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM item_windows))),
hits AS (SELECT doc_id, i, k, item_id FROM doc_windows JOIN item_windows USING (k, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

SUBSTRINGS = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN first USING (h) WHERE first < doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) FILTER (g IS NULL) AS text, count(g) AS n_removed
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words)
  LEFT JOIN (SELECT doc_id, p, 1 AS g FROM gone) USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""

SUFFIXES = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
windows AS (SELECT doc_id, i, x[i:i + 49] AS w FROM (SELECT doc_id, x, unnest(range(1, n - 48)) AS i FROM raw WHERE n >= 50)),
first AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (SELECT DISTINCT doc_id, i FROM windows JOIN first USING (w) WHERE first < doc_id),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM gone),
numbered AS (SELECT doc_id, i, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 49 AS e FROM numbered GROUP BY doc_id, run),
parts AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM spans),
kept AS (
  SELECT doc_id, sum(e - s + 1)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(CASE WHEN s - 1 > before THEN hex(x[before + 1:s - 1]) ELSE '' END, '' ORDER BY s)
      || CASE WHEN max(e) < any_value(n) THEN hex(any_value(x)[max(e) + 1:any_value(n)]) ELSE '' END AS b
  FROM parts JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_removed IS NULL THEN x ELSE unhex(b) END) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_split_to_array(piece, '[ \\x09]+') AS w0
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
words AS (SELECT p, lang, list_filter(w0, lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS parts
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, any_value(parts) AS parts, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, k, phrase, parts, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
valued AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.parts[1:cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.parts[cut + 1:cuts.k], ' ')),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, f, array_to_string(parts[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, f, parts, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM f WHERE k > 2))),
longer AS (SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY lang, phrase),
left_over AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN total USING (lang) QUALIFY rank <= 2000"""


def _assignment(k: int) -> str:
    """Nearest entry of each part, lowest index first, for the codebooks of round k."""
    return f"""
d{k} AS (SELECT row, p, e, any_value(n) AS n, sum((x - y) * (x - y)) AS d FROM (
  SELECT parts.row, parts.p, parts.j, parts.x, b{k}.e, b{k}.y, 0 AS n FROM parts JOIN b{k} USING (p, j)) GROUP BY row, p, e),
a{k} AS (SELECT row, p, e, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, e) = 1)"""


def _update(k: int) -> str:
    """Entries of round k + 1: floor of sum by count; unused ones stay."""
    return f"""
b{k + 1} AS (SELECT b{k}.p, b{k}.e, b{k}.j, coalesce((s - ((s % n) + n) % n) // n, b{k}.y) AS y FROM b{k} LEFT JOIN (
  SELECT p, e, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM parts JOIN a{k} USING (row, p) GROUP BY p, e, j) USING (p, e, j))"""


_KEPT = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT row, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) // 8 AS size FROM kept),
parts AS (SELECT row, i // size AS p, i % size AS j, floor(4096 * x::DOUBLE)::HUGEINT AS x FROM flat),
b0 AS (SELECT p, row AS e, j, x AS y FROM parts WHERE row < 16)"""

VECTOR_CODES = _KEPT + "".join("," + _assignment(k) + "," + _update(k) for k in range(6)) + "," + _assignment(6) + """,
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY row),
book AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), book"""
