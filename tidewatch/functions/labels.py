"""Label look-ups and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch import vocab as V


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL when the key is missing. The map is a folded constant."""
    pairs = F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in table.items()))
    return F.try_element_at(F.str_to_map(pairs, F.lit("\x1e"), F.lit("\x1f")), key)


def source_label(source_type: Column) -> Column:
    return F.coalesce(lookup(F.lower(source_type), V.SOURCE_LABELS), F.lit("Web"))


def category_chart_label(category: Column) -> Column:
    return F.coalesce(lookup(category, V.CATEGORY_CHART_LABELS), category)


def category_label(category: Column, fallback: str = "Other") -> Column:
    """Display label; ``fallback`` is a category key or, if unknown, the label itself."""
    return F.coalesce(lookup(category, V.CATEGORY_DISPLAY_LABELS),
                      F.lit(V.CATEGORY_DISPLAY_LABELS.get(fallback, fallback)))


def category_label_any_case(category: Column, fallback: str = "其他") -> Column:
    lowered = {k.lower(): v for k, v in V.CATEGORY_DISPLAY_LABELS.items()}
    return F.coalesce(lookup(F.lower(category), lowered), F.lit(fallback))


def status_label(key: Column) -> Column:
    return F.coalesce(lookup(key, V.STATUS_LABELS), F.lit(V.STATUS_LABEL_DEFAULT))


def translate_place(name: Column, table: dict[str, str]) -> Column:
    return F.coalesce(lookup(name, table), name, F.lit(""))


def fleet_key(company: Column) -> Column:
    from tidewatch.functions.text import contains_any

    low = F.lower(company)
    chain = None
    for parts, fleet in V.FLEET_RULES:
        hit = contains_any(low, parts)
        chain = F.when(hit, F.lit(fleet)) if chain is None else chain.when(hit, F.lit(fleet))
    return chain.otherwise(F.lit(V.FLEET_OTHER))


def display_title(title_cn: Column, summary_cn: Column, title: Column, category: Column, contractor: Column,
                  location: Column) -> Column:
    from tidewatch.functions.text import first_filled

    text = F.coalesce(first_filled(title_cn, summary_cn, title), F.lit(""))
    text = F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
    place = F.trim(F.element_at(F.split(location, ","), -1))
    return (F.when((category == "Bid") & (contractor != ""), F.concat(F.lit("[中标: "), contractor, F.lit("] "), text))
            .when((category == "Project") & (location != ""),
                  F.concat(F.lit("["), F.when(F.contains(location, F.lit(",")), place).otherwise(location),
                           F.lit("] "), text))
            .otherwise(text))
