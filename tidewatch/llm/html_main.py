"""Main text of web pages: what a host repeats, found in the order of its token windows, then a check by markup.

A page becomes a stream of text blocks of three kinds. Text inside navigation, footers, asides, forms, adverts,
notices, comments and the like is chrome, by tag, by the attributes class, id, role and style, and by
being hidden; a name counts as a whole, or if all its parts are names of such places or words of position.
Other text inside an article or main element is marked, the rest is open; scripts, styles and titles are no text.

The token windows of all chrome and open blocks of a host, from every page, are brought into the order of
their tokens by Spark (the ranges of the host's suffix array that agree on `window` tokens), and ranges that
enough distinct pages share are boilerplate, see `main_text`. They are looked up in the marked and open blocks
of every page; covered tokens are told from the unique runs. Pages with equal marked and open blocks count as
one, so copies of an article don't make it boilerplate. A hot host spreads over all tasks, as its windows do.

The check: articles carry lines that footers and adverts of their host carry too, so marked blocks get their
covered tokens back, unless the host repeats all of a page's marked text (a teaser in an article element) and
its open blocks have unique runs, which then are the text. Chrome goes, unique or not, and so do open blocks
beside a marked text. Without marked blocks the unique runs of the open ones are the text.

Defined cases: null or empty html gives empty text; unclosed or stray tags and cut-off pages are read
as far as they go; tags in comments and scripts are no tags; a block of fewer tokens than the window is
one window; repeated rows get equal results; a page of any length is one row; an empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import NOT_SPACE, PIECE_BYTES, covered, materialised, prepare, word_hash, spans, window_hash

_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|template|svg|noembed|noframes)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)"
    rf"|<[!?][^>]*>|<(/?)([a-z][^\s/>]*)({_ATTRS})>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_NAME_PART = re.compile(r"[a-z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
MAIN = frozenset(["article", "main"])
CHROME = frozenset("nav footer aside form dialog menu button select".split())
CHROME_NAMES = frozenset("""ad ads advert adverts advertisement adsense alert banner breadcrumb breadcrumbs comment comments complementary consent
    contentinfo cookie cookies dialog disqus menu modal nav navbar navigation newsletter notice pagination popup promo recommended
    related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget footer""".split())
PLACES = frozenset("""area bar block body bottom box btn button center column container content footer form global header inner item items left link links list
    main mobile module page panel posts primary right secondary section site sticky text top widget widgets wrap wrapper""".split())
PAGE = "page_id long, url string, text string, n_chars long"
PARSED = "page_id long, url string, host long, marked array<string>, open array<string>, windows array<struct<key: long, open: boolean>>"


def blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """Text blocks in page order: marked by an article or main element, open, and chrome."""
    stack: list[tuple[str, int, int]] = []
    depth: dict[str, int] = {}
    chrome = main = at = 0
    kept: tuple[list[list[str]], ...] = ([[]], [[]], [[]])

    def text(raw: str) -> None:
        if raw:
            kept[2 if chrome else 0 if main else 1][-1].append(html.unescape(raw))

    def cut() -> None:
        for side in kept:
            if side[-1]:
                side.append([])

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = m[3] and m[3].lower()
        if not tag:
            continue
        if tag in BLOCK:
            cut()
        if m[2]:
            if depth.get(tag):
                while True:
                    name, c, a = stack.pop()
                    depth[name] -= 1
                    chrome, main = chrome - c, main - a
                    if name == tag:
                        break
        elif tag not in VOID and not m[4].endswith("/"):
            a = int(tag in MAIN)
            c = int(tag in CHROME or tag == "header" and not main or _names_chrome(tag, m[4], main))
            if tag in ("p", "li", "option", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
                name, c_, a_ = stack.pop()
                depth[name] -= 1
                chrome, main = chrome - c_, main - a_
            stack.append((tag, c, a))
            depth[tag] = depth.get(tag, 0) + 1
            chrome, main = chrome + c, main + a
    tail = page[at:]
    if "<" in tail:  # a tag that the page's end cuts off
        tail = tail[:tail.rindex("<")] if re.search(r"<[/!?a-zA-Z][^>]*\Z", tail) else tail
    text(tail)
    marked, open_, around = ([x for x in (" ".join("".join(part).split()) for part in parts) if x] for parts in kept)
    return marked, open_, around


def is_chrome_name(name: str, main: int) -> bool:
    """Whether a class, id or role names something around the article: `nav`, `cookie-notice`, `site-footer`, not `share-price-table`."""
    if name in CHROME_NAMES or not main and name == "header":
        return True
    parts = _NAME_PART.findall(name)
    return (len(parts) > 1 and any(p in CHROME_NAMES or not main and p == "header" for p in parts)
            and all(p in CHROME_NAMES or p in PLACES or p.isdigit() for p in parts))


def _names_chrome(tag: str, attributes: str, main: int) -> bool:
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
        if name in ("class", "id", "role") and any(is_chrome_name(x, main) for x in value.split()):
            return True
    return False


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about PIECE_BYTES together."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > PIECE_BYTES:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _windows(parts: list[str], window: int) -> tuple[np.ndarray, ...]:
    """(block, first word, words, hash) of each token window and the first word of each block; words count through all blocks."""
    texts = [x.encode() for x in parts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, end, row = spans(NOT_SPACE[data], at)
    words = np.bincount(row, minlength=len(parts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    wide = np.minimum(words, window)
    many = np.where(words > 0, words - wide + 1, 0)
    block = np.repeat(np.arange(len(parts)), many)
    word = first[block] + np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    n, key = wide[block], np.zeros(len(block), np.uint64)
    hashes = word_hash(data, start, end)
    for k in np.unique(n).tolist():
        key[n == k] = window_hash(hashes, k)[word[n == k]]
    return block, word, n, key.view(np.int64), first


def _parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Marked and open blocks of every page, and the distinct token windows of its chrome and open blocks; `open` are those in a page without marked ones."""
    for b in batches:
        pages = b.column(2).to_pylist()
        for lo, hi in _runs([len(x or "") for x in pages]):
            marked, open_, parts, page, is_open = [], [], [], [], []
            for i, x in enumerate(pages[lo:hi]):
                own, other, around = blocks(x) if x else ([], [], [])
                marked.append(own)
                open_.append(other)
                parts += other + around
                page += [i] * (len(other) + len(around))
                is_open += [not own] * len(other) + [False] * len(around)
            block, _, _, key, _ = _windows(parts, window)
            page, is_open = np.array(page, np.int64)[block], np.array(is_open, bool)[block]
            order = np.lexsort((~is_open, key, page))
            page, key, is_open = page[order], key[order], is_open[order]
            once = np.ones(len(key), bool)
            once[1:] = (page[1:] != page[:-1]) | (key[1:] != key[:-1])
            ends = np.searchsorted(page[once], np.arange(hi - lo + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(key[once]), pa.array(is_open[once])], ["key", "open"])
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], b.column(3)[lo:hi], pa.array(marked, pa.list_(pa.string())),
                                              pa.array(open_, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends), found)],
                                             ["page_id", "url", "host", "marked", "open", "windows"])


def _unique(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Text of each page by its host's ranges (`keys`, ascending) and the check by markup."""
    for b in batches:
        pages = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
        keys, ends = b.column(4).values.to_numpy(zero_copy_only=False), b.column(4).offsets.to_numpy()
        parts = [x for own, other in pages for x in own + other]
        at = np.cumsum([0] + [len(own) + len(other) for own, other in pages])
        gone, first = [np.zeros(0, bool)], [np.zeros(1, np.int64)]
        for lo, hi in _runs([len(x) for x in parts]):
            block, word, n, key, starts = _windows(parts[lo:hi], window)
            hit = np.zeros(len(key), bool)
            for i in range(int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi))):
                common, mine = keys[ends[i]:ends[i + 1]], slice(*np.searchsorted(block, at[i:i + 2] - lo))
                if len(common):
                    hit[mine] = common[np.minimum(np.searchsorted(common, key[mine]), len(common) - 1)] == key[mine]
            gone.append(covered(int(starts[-1]), word[hit], word[hit] + n[hit]))
            first.append(starts[1:] + first[-1][-1])
        gone, first, out = np.concatenate(gone), np.concatenate(first), []
        for (own, other), lo, hi in zip(pages, at.tolist(), at[1:].tolist()):
            split = lo + len(own)
            if own and not (gone[first[lo]:first[split]].all() and not gone[first[split]:first[hi]].all()):
                out.append("\n".join(own))
                continue
            left = [" ".join([w for w, g in zip(x.split(" "), gone[f:]) if not g]) for x, f in zip(other, first[split:hi].tolist())]
            out.append("\n".join([x for x in left if x]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, window: int = 6, least_pages: int = 3, least_share: float = 0.1) -> DataFrame:
    """(page_id, url, text, n_chars).

    Boilerplate are windows that stand outside marked text on `least_pages` pages of a host and on `least_share` of
    them; or in open blocks of as many of its pages without marked text, and on that share of these.
    """
    prepare(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"))
    parsed = materialised(pages.withColumn("host", F.xxhash64(host)).mapInArrow(lambda it: _parsed(it, window), PARSED)
                          # pages of equal marked and open blocks are one page here
                          .withColumn("page", F.xxhash64(F.size("marked"), "marked", "open")), "parsed-pages")
    is_open = (F.size("marked") == 0) & (F.size("open") > 0)
    total = parsed.select("host", "page", is_open.alias("open")).distinct().groupBy("host").agg(F.count("*").alias("of"), F.count_if("open").alias("of_open"))
    rows = parsed.select("host", "page", F.explode("windows").alias("w")).groupBy("host", "w.key", "page").agg(F.max("w.open").alias("open"))
    count = rows.groupBy("host", "key").agg(F.count("*").alias("on"), F.count_if("open").alias("on_open")).filter(F.col("on") >= least_pages)
    shared = ((F.col("on") >= least_share * F.col("of"))
              | (F.col("on_open") >= least_pages) & (F.col("on_open") >= least_share * F.col("of_open")))
    common = count.join(total, "host").filter(shared).groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    # written, so that its size is known and pages are dealt by host only if it is too large to be told to all tasks
    looked_up = parsed.select("page_id", "url", "marked", "open", "host").join(materialised(common, "host-ranges"), "host", "left")
    told = looked_up.select("page_id", "url", "marked", "open", F.coalesce("keys", F.array().cast("array<long>")).alias("keys"))
    return told.mapInArrow(lambda it: _unique(it, window), PAGE)
