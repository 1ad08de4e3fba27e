"""Reads of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed_by_id(feeds: DataFrame, feed_id: str) -> DataFrame:
    return feeds.where(F.col("feed_id") == feed_id)


def all_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.orderBy("feed_id")


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.where("enabled").orderBy("feed_id")


def article_by_key(articles: DataFrame, key: str) -> DataFrame:
    return articles.where(F.col("article_key") == key)


def pending_articles(articles: DataFrame, limit: int = 100) -> DataFrame:
    """The articles waiting longest; ties by key."""
    if limit <= 0:
        raise ValueError("limit must be greater than zero.")
    return articles.where("processing_status = 'pending'").orderBy(F.col("created_at").asc_nulls_last(), "article_key").limit(limit)


def feeds_of_article(links: DataFrame, key: str) -> DataFrame:
    return links.where(F.col("article_key") == key).select("feed_id").orderBy("feed_id")


def feeds_of_articles(links: DataFrame) -> DataFrame:
    """Every article with its feeds."""
    return links.groupBy("article_key").agg(F.array_sort(F.collect_set("feed_id")).alias("feed_ids"))


def link_exists(links: DataFrame, key: str, feed_id: str) -> bool:
    return not links.where((F.col("article_key") == key) & (F.col("feed_id") == feed_id)).limit(1).isEmpty()


def existing_links(asked: DataFrame, links: DataFrame) -> DataFrame:
    return asked.join(links, ["article_key", "feed_id"], "left_semi")
