"""The run: feeds to articles, links and messages, as one plan.

Everything up to the normalised entries is one DataFrame. It is written once to a staging folder, and all results are
taken from there, so pages are never fetched or extracted again. The messages of new articles are added to an outbox table
before the articles are stored, and leave it only when they have been published: a stop at any point publishes late, or
twice, and never loses a message. What is in the outbox without an article waits for the article.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import merge as M
from ..sources import rss
from ..sources.feeds import FeedRegistry
from .sinks import COUNTERS, QueueSink
from .store import SnapshotStore

def stream_order() -> Column:
    """Where an entry stands in the stream: feeds in file order, entries in document order."""
    return F.struct("feed_ord", "entry_ord")


def sync_feeds(store: SnapshotStore, registry: FeedRegistry, now: Column) -> int:
    """Store all configured feeds, disabled ones too."""
    store.rewrite("feeds", lambda rows: M.upsert_feeds(rows, registry.frame(store.spark), now))
    return registry.count()


def entries_to_articles(payloads: DataFrame, publishers: DataFrame, pages: DataFrame, primary=None) -> DataFrame:
    return A.normalise(A.extract(A.resolve(rss.parse(payloads), publishers), pages, primary))


def incoming(staged: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The last sighting of each article of a staged stream, and the links that it makes."""
    good = staged.where("failure is null")
    columns = ("article_key", *M.UPDATED)
    last = M.last_per_key(good.select(*columns, "feed_ord", "entry_ord"), ["article_key"], stream_order()).select(*columns)
    return last, good.select("article_key", "feed_id", now.alias("first_seen_at"))


def fold(staged: DataFrame, stored_articles: DataFrame, stored_links: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The new articles, links and messages that a staged stream makes of the stored tables."""
    last, links = incoming(staged, now)
    return {
        "articles": M.upsert_articles(stored_articles, last, now),
        "article_feeds": M.add_links(stored_links, links),
        "messages": M.messages(M.new_keys(last, stored_articles)),
    }


def commit(store: SnapshotStore, staged: DataFrame, now: Column) -> None:
    """Store what a staged stream makes of the store's tables; only buckets that its keys fall in are read and rewritten."""
    last, links = incoming(staged, now)
    known = store.read("articles", store.touched("articles", last))
    # The outbox goes first: what is stored as an article always has its message.
    store.rewrite("outbox", lambda waiting: waiting.unionByName(M.messages(M.new_keys(M.new_keys(last, known), waiting))))
    store.merge("article_feeds", links, lambda rows: M.add_links(rows, links))
    store.merge("articles", last, lambda rows: M.upsert_articles(rows, last, now))


def publish_waiting(store: SnapshotStore, sink: QueueSink) -> None:
    """Publish the messages of stored articles, and take them out of the outbox when that is done."""

    def publish(waiting: DataFrame) -> DataFrame:
        known = store.read("articles", store.touched("articles", waiting)).select("article_key")
        sink.publish(waiting.join(known, "article_key", "left_semi").select(waiting.columns))
        return waiting.join(known, "article_key", "left_anti").select(waiting.columns)

    store.rewrite("outbox", publish)


def counters(staged: DataFrame, feeds_processed: int, stored_articles: DataFrame) -> DataFrame:
    """One row of counters. Entries are discovered or failed; discovered ones are inserted or updated."""
    inserted = M.new_keys(staged.where("failure is null"), stored_articles).agg(F.count("*").alias("articles_inserted"))
    counts = staged.agg(F.count("*").alias("rss_entries"), F.count_if(F.col("failure").isNull()).alias("articles_discovered"), F.count_if(F.col("failure").isNotNull()).alias("articles_failed"))
    return counts.crossJoin(F.broadcast(inserted)).select(  # one row each
        F.lit(feeds_processed).cast("long").alias("feeds_processed"),
        "rss_entries",
        "articles_discovered",
        "articles_inserted",
        (F.col("articles_discovered") - F.col("articles_inserted")).alias("articles_updated"),
        "articles_failed",
        F.col("articles_inserted").alias("messages_published"),
    )


def ingest(spark: SparkSession, store: SnapshotStore, payloads: DataFrame, publishers: DataFrame, pages: DataFrame, feeds_processed: int, now: Column, sink: QueueSink | None = None, primary=None) -> dict[str, int]:
    """One bounded run over the payloads of the enabled feeds; a feed without a payload only counts as processed."""
    path = f"{store.root}/staging/{uuid.uuid4().hex}"
    entries_to_articles(payloads, publishers, pages, primary).write.parquet(path)
    staged = spark.read.parquet(path)
    known = store.read("articles", store.touched("articles", staged.where("failure is null")))
    stats = counters(staged, feeds_processed, known).first().asDict()
    commit(store, staged, now)
    if sink is not None:
        publish_waiting(store, sink)
    return {k: int(stats[k]) for k in COUNTERS}
