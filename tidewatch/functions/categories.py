"""Topic classification and relevance as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions.labels import lookup
from tidewatch.functions.text import bind, blank_to_null, contains_any, count_hits, is_blank


def _bucket(lowered: Column) -> Column:
    def first_hit(t: Column) -> Column:
        chain = None
        for category, words in V.CATEGORY_KEYWORDS:
            hit = contains_any(t, words)
            chain = F.when(hit, F.lit(category)) if chain is None else chain.when(hit, F.lit(category))
        return chain

    return bind(lowered, first_hit)


def infer_category(text: Column) -> Column:
    """First bucket, in order, with any keyword inside the text."""
    return _bucket(F.lower(text))


def _normalized(low: Column, compact: Column) -> Column:
    alias = F.coalesce(lookup(low, V.CATEGORY_ALIASES), lookup(compact, V.CATEGORY_COMPACT_ALIASES))
    return F.when(~is_blank(low), F.coalesce(alias, _bucket(low)))


def _compact(low: Column) -> Column:
    return F.regexp_replace(low, r"[^\p{L}\p{N}]", "")


def normalize_category(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return _normalized(low, _compact(low))


def resolve_category(category: Column, *texts: Column, keep_other: bool = False) -> Column:
    """Given category if it can be normalised, else inferred from the texts, else the default.

    "Other" is no topic and is derived anew, unless ``keep_other``.
    """
    text = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    derived = F.coalesce(normalize_category(category), infer_category(text), F.lit(V.DEFAULT_CATEGORY))
    return F.when(F.lower(F.trim(category)) == "other", F.lit("Other")).otherwise(derived) if keep_other else derived


def with_normalized_category(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add the normalised category; the lower-case text is built once per row, not once per keyword."""
    return (df.withColumn("_low", F.lower(F.trim(value))).withColumn("_compact", _compact(F.col("_low")))
            .withColumn(name, _normalized(F.col("_low"), F.col("_compact"))).drop("_low", "_compact"))


def with_resolved_category(df: DataFrame, name: str, category: Column, *texts: Column) -> DataFrame:
    """``resolve_category`` as a column, with every text prepared once per row."""
    df = with_normalized_category(df, "_given", category)
    df = df.withColumn("_text", F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])))
    return (df.withColumn(name, F.coalesce("_given", _bucket(F.col("_text")), F.lit(V.DEFAULT_CATEGORY)))
            .drop("_given", "_text"))


def primary_category(categories: Column) -> Column:
    order = F.array(*[F.lit(c) for c in V.PRIMARY_CATEGORY_ORDER])
    known = F.filter(order, lambda c: F.array_contains(categories, c))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.try_element_at(categories, F.lit(1)),
                      F.lit(V.DEFAULT_CATEGORY))


def is_relevant(source_name: Column, url: Column, known_category: Column, lowered_body: Column) -> Column:
    """Relevance from the source, the url, a normalised category and the lower-case text."""
    def has(c: Column, words: list[str]) -> Column:
        return F.coalesce(contains_any(F.lower(c), words), F.lit(False))

    return (has(source_name, V.RELEVANT_SOURCE_WORDS) | has(url, V.RELEVANT_URL_WORDS)
            | F.coalesce(known_category != "Other", F.lit(False))
            | contains_any(lowered_body, V.STRONG_WORDS) | (count_hits(lowered_body, V.SECONDARY_WORDS) >= 2))


def with_relevance(df: DataFrame, category: Column, *texts: Column) -> DataFrame:
    """Add known_category and is_relevant to rows with source_name and url."""
    df = with_normalized_category(df, "known_category", category)
    df = df.withColumn("_body", F.lower(F.concat_ws(" ", *[blank_to_null(t) for t in texts])))
    return df.withColumn("is_relevant", is_relevant(F.col("source_name"), F.col("url"), F.col("known_category"),
                                                    F.col("_body"))).drop("_body")


def retention_flags(relevant: Column, known_category: Column) -> dict[str, Column]:
    """Columns valid, category, is_retained and remark of an analysed article; the category is normalised."""
    settled = F.when(relevant, F.coalesce(known_category, F.lit(V.DEFAULT_CATEGORY))).otherwise("Other")
    retained = relevant & (settled != "Other")
    return {
        "valid": F.when(relevant, 1).otherwise(0),
        "category": settled,
        "is_retained": F.when(retained, 1).otherwise(0),
        "remark": F.when(~relevant, F.lit(V.R_INVALID)).when(retained, F.lit(V.R_KEPT)).otherwise(F.lit(V.R_IRRELEVANT)),
    }


def result_pub_date(publish_time: Column, item_pub_date: Column) -> Column:
    return F.when(F.length(publish_time) >= 10, publish_time).otherwise(F.coalesce(item_pub_date, F.lit("")))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
