"""Merges of observed cards into the listing table, its price history and its retention, as joins over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, batch: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """SNK1: the new state with is_new and changed.

    Both tables: id, title, price_eur, site_old_price, image, deal, price_note, area_m2, last_seen; ``current`` has first_price and detail_at too.
    Title only while no details were read; price only if it moved by more than the tolerance or was null; deal, note and area only
    while no details were read; image and struck-through price if the card has them.
    """
    c, b = current.alias("c"), batch.alias("b")
    joined = c.join(b, F.col("c.id") == F.col("b.id"), "full_outer")
    old, new = F.col("c.id").isNotNull(), F.col("b.id").isNotNull()
    unread = F.col("c.detail_at").isNull()
    moved = old & new & F.col("b.price_eur").isNotNull() & (F.col("c.price_eur").isNull() | (F.abs(F.col("b.price_eur") - F.col("c.price_eur")) > tolerance))
    pick = lambda x, when: F.when(~old, F.col(f"b.{x}")).when(new & when, F.coalesce(f"b.{x}", f"c.{x}")).otherwise(F.col(f"c.{x}")).alias(x)
    return joined.select(
        F.coalesce("c.id", "b.id").alias("id"), pick("title", unread), F.when(~old, F.col("b.price_eur")).when(moved, F.col("b.price_eur")).otherwise(F.col("c.price_eur")).alias("price_eur"),
        pick("site_old_price", F.lit(True)), pick("image", F.lit(True)), pick("deal", unread), pick("price_note", unread), pick("area_m2", unread),
        F.when(old, F.col("c.first_price")).otherwise(F.coalesce("b.site_old_price", "b.price_eur")).alias("first_price"), F.when(new, F.greatest("b.last_seen", "c.last_seen")).otherwise(F.col("c.last_seen")).alias("last_seen"),
        F.col("c.detail_at").alias("detail_at"), (~old).alias("is_new"), F.coalesce(moved, F.lit(False)).alias("changed"))


def history_rows(merged: DataFrame) -> DataFrame:
    """SNK3: what the merge adds to the price history."""
    return merged.where("(is_new or changed) and price_eur is not null").select(F.col("id").alias("listing_id"), F.col("last_seen").alias("seen_at"), "price_eur")


def partial_update(current: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """SNK2: named columns replaced where an update exists; a null in the update replaces too."""
    u = updates.select("id", F.lit(True).alias("hit"), *[F.col(c).alias(f"new {c}") for c in columns])
    return current.join(u, "id", "left").withColumns({c: F.when(F.col("hit"), F.col(f"new {c}")).otherwise(F.col(c)) for c in columns}).select(*current.columns)


def append_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """SNK4, SNK12: insert if the key is not there."""
    return current.unionByName(rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def price_changes(history: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Observations whose price moved against the one before."""
    w = Window.partitionBy("listing_id").orderBy("seen_at", "price_eur")
    return history.withColumn("before", F.lag("price_eur").over(w)).where(F.abs(F.col("price_eur") - F.col("before")) > tolerance)


def prune(rows: DataFrame, children: DataFrame, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """SNK8: listings seen within ``days``, and the children (listing_id) that still have theirs."""
    kept = rows.where(F.col("last_seen") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp"))
    return kept, children.join(kept.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")


def changed_urls(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Entries that are new, or whose non-empty lastmod differs from the stored one."""
    k = known.select("url", F.col("lastmod").alias("stored"), F.lit(True).alias("hit"))
    return entries.join(k, "url", "left").where(F.col("hit").isNull() | ((F.coalesce("lastmod", F.lit("")) != "") & ~F.col("lastmod").eqNullSafe(F.col("stored")))).select("url", "lastmod")


def due_urls(entries: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """The ``most`` changed entries to read next, the newest first, then by url; entries without a date come last."""
    return changed_urls(entries, known).orderBy(F.desc_nulls_last("lastmod"), "url").limit(most)
