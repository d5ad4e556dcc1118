"""Merging updates into the stores: aggregate the updates per key, then one full outer join.

The updates of a key are folded by partial aggregates before the shuffle, so a key updated very
often does not pile up in one task, and both sides of the join are unique on the key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schemas as S, vocab as V
from tidewatch.functions.categories import with_resolved_category
from tidewatch.functions import text as T
from tidewatch.operators import filters


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _last(value: Column, when: Column) -> Column:
    """Value of the last update for which the condition holds."""
    return F.max_by(value, F.when(when, F.col("seq")))


def upsert_articles(store: DataFrame, updates: DataFrame, as_of: datetime,
                    category_only_if_given: bool = False) -> DataFrame:
    """Apply ordered updates (url, seq, any store columns) to the store.

    Text columns take the last non-empty value, flags the last non-NULL one. The category is derived
    from every update anew, so the last update decides it; with ``category_only_if_given`` only
    updates that carry a category do. The first update of an unknown url inserts it.
    """
    texts = [c for c in S.ARTICLE_TEXT_COLUMNS if c in store.columns]
    flags = [c for c in S.ARTICLE_FLAG_COLUMNS if c in store.columns]
    updates = updates.where(~T.is_blank(F.col("url")))
    updates = with_resolved_category(updates, "_category", _col(updates, "category"), _col(updates, "title"),
                                     _col(updates, "title_cn"), _col(updates, "summary_cn"), _col(updates, "full_text_cn"))
    ready = updates.select(
        "url", "seq", "_category", T.is_blank(_col(updates, "category")).alias("_no_category"),
        *[_col(updates, c).alias(c) for c in texts],
        *[_col(updates, c, "boolean" if c == "is_significant" else "int").alias(c) for c in flags])
    counted = ~F.col("_no_category") if category_only_if_given else F.lit(True)
    merged = ready.groupBy("url").agg(
        F.min("seq").alias("_first_seq"),
        _last(F.col("_category"), counted).alias("_category"),
        F.min_by("_category", "seq").alias("_first_category"),
        F.min_by("valid", "seq").alias("_first_valid"),
        F.min_by("pub_date", "seq").alias("_first_pub"),
        *[_last(F.col(c), F.col(c) != "").alias(f"_new_{c}") for c in texts],
        *[_last(F.col(c), F.col(c).isNotNull()).alias(f"_new_{c}") for c in flags],
        *[F.max(F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_at_{c}") for c in flags],
        F.max(F.when(F.col("remark") != "", F.col("seq"))).alias("_at_remark"))
    known = store.withColumn("_known", F.lit(True))
    rows = known.join(merged, "url", "full_outer")
    is_new = F.col("_known").isNull()
    stale = filters.stale_on_insert(F.col("_first_pub"), as_of)

    def later(name: str) -> Column:
        """The new value, unless it came with the inserting update itself."""
        return F.when(F.col(f"_at_{name}") > F.col("_first_seq"), F.col(f"_new_{name}"))

    inserted = {
        "valid": F.when(stale, 0).otherwise(F.coalesce("_first_valid", F.lit(1))),
        "is_hidden": F.when(stale, 1).otherwise(0),
        "is_retained": F.lit(0),
        "is_significant": F.lit(False),
    }
    out = []
    for name in store.columns:
        if name in ("valid", "is_hidden"):
            fresh = F.coalesce(later(name), inserted[name])
        elif name == "remark":
            fresh = F.coalesce(later("remark"), F.when(stale, F.lit(V.R_STALE)), F.col("_new_remark"), F.lit(""))
        elif name in flags:
            fresh = F.coalesce(F.col(f"_new_{name}"), inserted[name])
        elif name == "source_type":
            fresh = F.coalesce(F.col("_new_source_type"), F.lit("unknown"))
        elif name in texts:
            fresh = F.coalesce(F.col(f"_new_{name}"), F.lit(""))
        elif name == "category":
            fresh = F.coalesce("_category", "_first_category")
        elif name == "id":
            fresh = F.xxhash64("url")
        elif name == "created_at":
            fresh = filters.ts(as_of)
        else:
            fresh = F.col(name)
        if name == "category":
            old = F.coalesce("_category", "category")
        elif name in texts or name in flags:
            old = F.coalesce(f"_new_{name}", name)
        else:
            old = F.col(name)
        out.append(F.col("url") if name == "url" else F.when(is_new, fresh).otherwise(old).alias(name))
    return rows.select(*out)


def upsert_ships(registry: DataFrame, updates: DataFrame, as_of: datetime) -> DataFrame:
    """Replace ships by id, the last update wins; speed and heading of a known ship stay.

    Columns the updates do not carry become NULL.
    """
    columns = [c for c in S.SHIP_COLUMNS if c in registry.columns]
    types = dict(registry.dtypes)
    replaced = [c for c in columns if c not in ("id", "updated_at", *S.SHIP_KEPT_ON_UPDATE)]
    ready = updates.select("id", "seq", *[_col(updates, c, types[c]).alias(c) for c in columns
                                          if c not in ("id", "updated_at")])
    merged = ready.groupBy("id").agg(
        *[F.max_by(c, "seq").alias(f"_new_{c}") for c in replaced],
        *[F.min_by(c, "seq").alias(f"_new_{c}") for c in S.SHIP_KEPT_ON_UPDATE]).withColumn("_hit", F.lit(True))
    rows = registry.withColumn("_known", F.lit(True)).join(merged, "id", "full_outer")
    out = [F.col("id")]
    for name in columns[1:]:
        if name == "updated_at":
            value = F.when(F.col("_hit"), filters.ts(as_of)).otherwise(F.col(name))
        elif name in S.SHIP_KEPT_ON_UPDATE:
            value = F.when(F.col("_known"), F.col(name)).otherwise(F.col(f"_new_{name}"))
        else:
            value = F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name))
        out.append(value.alias(name))
    return rows.select(*out)


ALWAYS_SET = ["status", "status_date", "location", "region"]


def update_status_by_mmsi(ships: DataFrame, status: DataFrame, as_of: datetime) -> DataFrame:
    """Write status rows (unique per mmsi) into the registry.

    status, status_date, location and region are set as given; other columns only when not NULL.
    """
    given = [c for c in status.columns if c != "mmsi"]
    new = status.select("mmsi", *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    rows = ships.join(new, "mmsi", "left")
    if "status_date" not in ships.columns:
        rows = rows.withColumn("status_date", F.lit(None).cast("timestamp_ntz"))
    out = []
    for name in [*ships.columns, *(["status_date"] if "status_date" not in ships.columns else [])]:
        if name == "updated_at":
            value = F.when(F.col("_hit"), filters.ts(as_of)).otherwise(F.col(name))
        elif name in given and name in ALWAYS_SET:
            value = F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name))
        elif name in given:
            value = F.coalesce(F.col(f"_new_{name}"), F.col(name))
        else:
            value = F.col(name)
        out.append(value.alias(name))
    return rows.select(*out)
