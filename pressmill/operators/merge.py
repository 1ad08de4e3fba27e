"""Set-based writes: pure functions from stored and incoming tables to the new stored table.

Time is an argument, never taken inside. A key's last sighting in the stream's order wins; rows are folded by key before
they meet the stored table, so each function costs one shuffle on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an update of an article writes; the summary, its status and the time of creation stay.
UPDATED = ("title", "url", "source", "authors", "published_at", "content", "content_hash")


def last_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key. Partial aggregates keep a hot key's rows from meeting in one task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def upsert_feeds(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Feeds by feed_id: all columns but the time of creation are overwritten; feeds that are no longer named stay."""
    values = ["feed_type", "feed_value", "query", "enabled"]
    new = incoming.select("feed_id", F.struct(*values).alias("_new"))
    old = stored.select("feed_id", F.struct(*values).alias("_old"), "created_at")
    both = old.join(new, "feed_id", "full_outer")
    return both.select("feed_id", *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values), F.coalesce("created_at", now).alias("created_at"))


def upsert_articles(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Articles by article_key, incoming folded already (each key once, with the columns in UPDATED).

    A conflict overwrites UPDATED, with nulls too, and updated_at. New articles are pending.
    """
    new = incoming.select("article_key", F.struct(*UPDATED).alias("_new"))
    old = stored.select("article_key", F.struct(*UPDATED).alias("_old"), "summary", "processing_status", "created_at", "updated_at")
    both = old.join(new, "article_key", "full_outer")
    changed = F.col("_new").isNotNull()
    value = {c: F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in UPDATED}
    return both.select(
        "article_key",
        *(value[c] for c in UPDATED),
        "summary",
        F.coalesce("processing_status", F.lit("pending")).alias("processing_status"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def add_links(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links by (article_key, feed_id): those already stored stay as they are, new ones keep their first sighting."""
    new = incoming.groupBy("article_key", "feed_id").agg(F.min("first_seen_at").alias("first_seen_at"))
    return stored.unionByName(new.join(stored, ["article_key", "feed_id"], "left_anti").select(stored.columns))


def update_summary(stored: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Sets summaries (article_key, summary), marks the articles summarized; unknown keys do nothing."""
    new = updates.select("article_key", F.col("summary").alias("_summary"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    return _updated(stored, new, {"summary": F.when(hit, F.col("_summary")).otherwise(F.col("summary")), "processing_status": F.when(hit, "summarized").otherwise(F.col("processing_status"))}, hit, now)


def update_status(stored: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Sets processing_status (article_key, processing_status), any text; unknown keys do nothing."""
    new = updates.select("article_key", F.col("processing_status").alias("_status"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    return _updated(stored, new, {"processing_status": F.when(hit, F.col("_status")).otherwise(F.col("processing_status"))}, hit, now)


def _updated(stored: DataFrame, new: DataFrame, values: dict[str, Column], hit: Column, now: Column) -> DataFrame:
    return stored.join(new, "article_key", "left").withColumns(values | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(stored.columns)


def new_keys(incoming: DataFrame, stored: DataFrame, key: str = "article_key") -> DataFrame:
    """The keys that aren't stored yet, each once."""
    return incoming.select(key).distinct().join(stored.select(key), key, "left_anti")


def messages(keys: DataFrame) -> DataFrame:
    """One message for each key."""
    return keys.select("article_key", F.to_json(F.struct("article_key")).alias("message"))


def with_existing(incoming: DataFrame, stored: DataFrame, key: str = "article_key") -> DataFrame:
    """incoming with is_known: whether its key is stored."""
    return incoming.join(stored.select(key, F.lit(True).alias("_known")), key, "left").withColumn("is_known", F.col("_known").isNotNull()).drop("_known")


def valid_links(links: DataFrame, articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Links whose article and feed both exist."""
    return links.join(articles.select("article_key"), "article_key", "left_semi").join(feeds.select("feed_id"), "feed_id", "left_semi").select(links.columns)


def cascade_delete(links: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Links without those of the deleted articles or feeds."""
    return links.join(deleted.select(key), key, "left_anti").select(links.columns)
