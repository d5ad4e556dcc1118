"""Links, text and dates out of landed HTML pages.

One pass over the markup (``outline``, batch by batch inside the tasks) turns a page into its text,
its elements as ranges of that text, its links and its date marks; selectors, limits and the choice
between containers are column expressions over that. No shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions import dates, text as T
from tidewatch.functions.urls import resolve_href
from tidewatch.operators.skew import unnest

QUIET = {"script", "style", "noscript"}
BLOCKS = set("p div li ul ol h1 h2 h3 h4 h5 h6 tr table section article nav header footer body br html head title".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
PARSED_AT_ONCE = 1 << 19
DATE_METAS = ["article:published_time", "publishdate", "date"]
OUTLINE = ("whole STRING, elements ARRAY<STRUCT<tag: STRING, id: STRING, classes: STRING, `from`: INT, `to`: INT>>, "
           "links ARRAY<STRUCT<href: STRING, `from`: INT, `to`: INT>>, marks ARRAY<STRUCT<name: STRING, value: STRING>>")


class _Outline(HTMLParser):
    """Events of one page: text with line breaks at blocks, and what the selectors need to know."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.at, self.quiet = [], 0, 0
        self.open, self.depth, self.elements, self.links, self.marks = [], {}, [], [], []

    def _put(self, piece: str) -> None:
        self.text.append(piece)
        self.at += len(piece)

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in QUIET
        if tag in BLOCKS:
            self._put("\n")
        known = dict(reversed(attrs))
        if tag == "meta":
            self.marks.append(((known.get("property") or known.get("name") or "").lower(), known.get("content") or ""))
        if tag == "time" and known.get("datetime"):
            self.marks.append(("time", known["datetime"]))
        if tag not in VOID:
            self.open.append((tag, known, len(self.elements)))
            self.depth[tag] = self.depth.get(tag, 0) + 1
            self.elements.append((tag, known.get("id") or "", f" {' '.join((known.get('class') or '').split())} ", self.at, None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.quiet = max(self.quiet - (tag in QUIET), 0)
        if self.depth.get(tag):
            while True:
                name, known, n = self.open.pop()
                self.depth[name] -= 1
                self._end(name, known, n)
                if name == tag:
                    break
        if tag in BLOCKS:
            self._put("\n")

    def _end(self, name, known, n):
        self.elements[n] = (*self.elements[n][:4], self.at)
        if name == "a" and known.get("href") is not None:
            self.links.append((known["href"], self.elements[n][3], self.at))

    def handle_data(self, data):
        if not self.quiet:
            self._put(data)

    def finish(self) -> tuple:
        self.close()
        while self.open:
            self._end(*self.open.pop())
        return "".join(self.text), self.elements, sorted(self.links, key=lambda x: (x[1], x[2])), self.marks


def _portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows (from, to) of at most ``most`` together; a larger row stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def outline(pages: DataFrame) -> DataFrame:
    """(page_id, url, whole, elements, links, marks) of every page; null markup is empty.

    Outlines are far larger than their markup, so a task holds those of about PARSED_AT_ONCE characters at a time.
    """
    def run(batches):
        for pdf in batches:
            for lo, hi in _portions([len(html or "") for html in pdf["html"]], PARSED_AT_ONCE):
                part, found = pdf.iloc[lo:hi], []
                for html in part["html"]:
                    page = _Outline()
                    page.feed(html or "")
                    found.append(page.finish())
                whole, elements, links, marks = zip(*found)
                yield part[["page_id", "url"]].assign(whole=list(whole), elements=list(elements), links=list(links), marks=list(marks))

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id BIGINT, url STRING, {OUTLINE}")


def tidy(text: Column) -> Column:
    """Spaces drawn together, blank lines dropped."""
    return T.strip(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x{00A0}]+", " "), r" ?\n[ \n]*", "\n"))


def matching(selector: str) -> Column:
    """Elements for a tag, .class, #id or [class*="part"], in page order."""
    part = re.fullmatch(r"\[class\*=[\"']?([^\"'\]]+)[\"']?\]", selector)

    def fits(e: Column) -> Column:
        if part:
            return F.contains(e["classes"], F.lit(part[1]))
        if selector[0] == ".":
            return F.contains(e["classes"], F.lit(f" {selector[1:]} "))
        return e["id"] == selector[1:] if selector[0] == "#" else e["tag"] == selector

    return F.filter("elements", fits)


def inner_text(element: Column) -> Column:
    return tidy(F.substring(F.col("whole"), element["from"] + 1, element["to"] - element["from"]))


def page_title() -> Column:
    """Text of the first title element of an outline."""
    return F.coalesce(inner_text(F.get(matching("title"), 0)), F.lit(""))


def _link_list(rows: DataFrame, scopes: Column, keep, out: str) -> DataFrame:
    """Add the wanted links inside any of the scopes (elements; NULL is the whole page), first of every url."""
    inside = lambda a: scopes.isNull() | F.exists(scopes, lambda e: (e["from"] <= a["from"]) & (a["to"] <= e["to"]))
    found = F.transform(F.filter("links", inside), lambda a: F.struct(
        inner_text(a).alias("title"), resolve_href(F.trim(a["href"]), F.col("url")).alias("url"), a["href"].alias("href")))
    first = F.filter("_wanted", lambda x, i: F.array_position(F.col("_wanted.url"), x["url"]) == i + 1)
    return (rows.withColumn("_found", found).withColumn("_wanted", F.filter("_found", keep))
            .withColumn(out, first).drop("_found", "_wanted"))


def _one_row_per_link(rows: DataFrame, links: Column) -> DataFrame:
    rows = unnest(rows, ["page_id", F.col("url").alias("page_url")], links, "pos", "_l")
    return rows.select("page_id", "page_url", "pos", F.col("_l.title").alias("title"), F.col("_l.url").alias("url"))


def extract_links(pages: DataFrame, selector: str = "body", min_text: int = 15) -> DataFrame:
    """(page_id, page_url, pos, title, url): http links with a text longer than ``min_text``, each url once per page.

    Links come from all elements of the selector, or from the whole page if there is none.
    """
    rows = outline(pages).withColumn("_scopes", matching(selector))
    rows = rows.withColumn("_scopes", F.when(F.size("_scopes") > 0, F.col("_scopes")))
    rows = _link_list(rows, F.col("_scopes"), lambda x: (F.length(x["title"]) > min_text) & F.startswith(x["url"], F.lit("http")), "_links")
    return _one_row_per_link(rows, F.col("_links"))


def extract_links_custom(pages: DataFrame, include: list[str], exclude: list[str] | None = None,
                         selectors: list[str] | None = None, min_text: int = 15,
                         fallback_parts: list[str] | None = None, fallback_min_text: int = 20) -> DataFrame:
    """Site variant: several containers, href parts required or barred, a wider second try for pages without a hit."""
    exclude = V.SITE_EXCLUDED_HREF_PARTS if exclude is None else exclude
    fallback_parts = fallback_parts or ["/press/", "/news/"]

    def wanted(parts: list[str], length: int, relative: bool):
        def keep(x: Column) -> Column:
            inside = T.contains_any(x["url"], parts)
            if relative:
                inside = inside | F.startswith(x["href"], F.lit("/"))
            return (F.length(x["title"]) > length) & (x["href"] != "") & inside & ~T.contains_any(x["url"], exclude)
        return keep

    scopes = F.concat(*[matching(s) for s in (selectors or V.SITE_LINK_SELECTORS)])
    rows = outline(pages).withColumn("_scopes", scopes)
    rows = _link_list(rows, F.col("_scopes"), wanted(include, min_text, True), "_first")
    # pages with a hit are not searched a second time
    rows = rows.withColumn("_scopes", F.when(F.size("_first") > 0, F.slice("_scopes", 1, 0)))
    rows = _link_list(rows, F.col("_scopes"), wanted(fallback_parts, fallback_min_text, False), "_second")
    return _one_row_per_link(rows, F.when(F.size("_first") > 0, F.col("_first")).otherwise(F.col("_second")))


def extract_content(pages: DataFrame, selectors: list[str] | None = None, min_chars: int = 200,
                    max_chars: int | None = None) -> DataFrame:
    """Text of the first container longer than ``min_chars``, else of the body; whole unless ``max_chars`` is given.

    Of each selector the first element counts.
    """
    tries = []
    for selector in selectors or V.CONTENT_SELECTORS:
        tries.append(T.bind(inner_text(F.get(matching(selector), 0)), lambda t: F.when(F.length(t) > min_chars, t)))
    text = F.coalesce(*tries, inner_text(F.get(matching("body"), 0)), F.lit(""))
    return outline(pages).select("page_id", "url", (text if max_chars is None else F.substring(text, 1, max_chars)).alias("content"))


def page_date() -> Column:
    """First usable date of the known places of an outline, empty text if none."""
    def first(name: str) -> Column:
        values = F.transform(F.filter("marks", lambda m: m["name"] == name), lambda m: dates.extract_ymd(m["value"]))
        return F.get(F.filter(values, lambda x: x.isNotNull()), 0)

    return F.coalesce(*[first(name) for name in (*DATE_METAS, "time")], F.lit(""))


def extract_page_date(pages: DataFrame) -> DataFrame:
    return outline(pages).select("page_id", "url", page_date().alias("pub_date"))


def link_to_source_config(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach selector, blacklist and max_links of the source a link was found on."""
    return links.join(sources.select(F.col("name").alias("source_name"), "selector", "blacklist", "max_links"),
                      "source_name")


def first_n_links(links: DataFrame, n: int | None = None) -> DataFrame:
    """The first links of every page, before any validity check; pos is the place on the page."""
    return links.where(F.col("pos") < (F.col("max_links") if n is None else n))
