"""Text predicates and clean-ups as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from tidewatch import vocab as V


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


_SEP = "\x1f"


def word_array(words: list[str]) -> Column:
    """A constant array; the optimiser folds the split, so it is built once, not per row."""
    return F.split(F.lit(_SEP.join(words)), _SEP)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(lowered: Column, words: list[str], word_boundary: bool = False) -> Column:
    """Any of the words as a substring. Pass text that is already lower case.

    A word that contains another word of the list cannot change the answer and is not searched for.
    With ``word_boundary`` a word counts only where no Latin letter or digit touches it.
    """
    if word_boundary:
        any_of = "|".join(re.escape(w) for w in dict.fromkeys(words))
        return F.rlike(lowered, F.lit(rf"(?<![a-z0-9])(?:{any_of})(?![a-z0-9])"))
    needed = [w for w in dict.fromkeys(words) if not any(o in w for o in words if o != w)]
    def any_of_them(t: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in needed])

    return any_of_them(lowered) if len(needed) <= 3 else bind(lowered, any_of_them)


def count_hits(lowered: Column, words: list[str]) -> Column:
    """How many different words occur in the text."""
    return bind(lowered, lambda t: F.size(F.filter(word_array(words), lambda w: F.contains(t, w))))


def text_contains_any(text: Column, words: list[str], word_boundary: bool = False) -> Column:
    return F.coalesce(contains_any(F.lower(text), words, word_boundary), F.lit(False))


def clean_article_text(text: Column) -> Column:
    """Drop blank lines and short navigation lines, one kept line per row."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), strip)

    def keep(line: Column) -> Column:
        words = F.size(F.split(line, r"\s+"))
        short = (F.length(line) <= 50) & (words <= 6)
        return (line != "") & ~(short & contains_any(F.lower(line), V.BOILERPLATE_WORDS))

    return F.array_join(F.filter(lines, keep), "\n")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_obvious_junk_title(title: Column) -> Column:
    return F.when(is_blank(title), True).otherwise(
        contains_any(F.lower(title), V.JUNK_TITLE_PARTS) | (F.length(strip(title)) < 5))


def title_verdict(title: Column, link: Column) -> Column:
    """Reason a listing is refused, or NULL when it passes the coarse check."""
    t, u = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(link, F.lit("")))
    low = F.lower(t)
    verdict = (F.when((t == "") | (u == ""), F.lit("empty"))
               .when(F.length(t) < 3, F.lit("too_short"))
               .when(t.isin(V.JUNK_TITLES), F.lit("junk_title")))
    for part in V.ERROR_TITLE_PARTS:
        verdict = verdict.when(F.contains(low, F.lit(part.lower())), F.lit("error_page:" + part))
    return (verdict.when(F.startswith(low, F.lit("back to")) & (F.length(t) < 20), F.lit("back_to"))
            .when(F.contains(F.lower(u), F.lit("javascript")), F.lit("script_link")))


def is_security_page(title: Column, url: Column) -> Column:
    t, u = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return (F.startswith(u, F.lit("chrome-error://")) | F.contains(t, F.lit("net::err_cert"))
            | contains_any(t, V.SECURITY_TITLE_PARTS))


def is_valid_link(url: Column, title: Column, blacklist: Column) -> Column:
    """Blacklist substrings on the url, navigation words in short titles."""
    u, t = F.lower(url), F.lower(title)
    barred = F.exists(F.coalesce(blacklist, F.array().cast("array<string>")),
                      lambda b: F.contains(u, F.lower(b)))
    nav = contains_any(t, V.NAV_TITLE_PARTS) & (F.length(title) < 30)
    return F.when(is_blank(url) | is_blank(title), False).otherwise(~barred & ~nav)


def is_valid_site_link(url: Column, title: Column) -> Column:
    barred = contains_any(F.lower(url), V.SITE_EXCLUDED_PARTS) | contains_any(F.lower(title), V.SITE_EXCLUDED_PARTS)
    return F.when(is_blank(url) | is_blank(title), False).otherwise(~barred & (F.length(title) >= 15))


def sanitize_cell(c: Column) -> Column:
    """Make a value safe for one cell of a pipe table."""
    return F.replace(F.translate(F.coalesce(c, F.lit("")), "|\n", "  "), F.lit("\r"), F.lit(""))


def sanitize_remark(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), "|\n\r", "   ")


def sanitize_link(c: Column) -> Column:
    return F.translate(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("%7C")), "\n\r", "")


def title_key(text: Column) -> Column:
    """Comparison key of a title: lower case, no stop words, letters and digits only."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for word in V.TITLE_STOPWORDS:
        out = F.replace(out, F.lit(word), F.lit(""))
    return F.regexp_replace(out, r"[^\p{L}\p{N}]", "")


def cut_title(text: Column, n: int) -> Column:
    return F.substring(F.translate(strip(F.coalesce(text, F.lit(""))), "\n\r", "  "), 1, n)


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("是")).otherwise(F.lit("否"))


def strip_json_fence(text: Column) -> Column:
    """Body of the first ```json or ``` fence, else the text itself."""
    tagged = F.split(text, "```json", -1)
    plain = F.split(text, "```", -1)
    return (F.when(F.contains(text, F.lit("```json")), strip(F.element_at(F.split(F.element_at(tagged, 2), "```", -1), 1)))
            .when(F.contains(text, F.lit("```")), strip(F.element_at(plain, 2)))
            .otherwise(text))
