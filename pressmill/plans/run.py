"""The whole run, from configuration to report: registry, feeds, wrapper links, articles, tables, messages.

Every step outside the store can be another: `fetch` takes a table of requests (url, key, form) and gives a row of
sources.http.RESULT with the key for each. Feeds and pages that can't be fetched never end a run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bytes_as_text
from ..functions.url import DECODER, decoded_url, decoding_parameters, decoding_request, is_wrapper, wrapper_token
from ..sources import http, rss
from ..sources.feeds import FeedRegistry, Settings, with_url
from .ingest import ingest, sync_feeds
from .sinks import QueueSink
from .store import SnapshotStore

Fetch = Callable[[DataFrame], DataFrame]


def fetch_feeds(spark: SparkSession, feeds: DataFrame, settings: Settings) -> DataFrame:
    """feed_id, feed_ord and content of the feeds (with feed_url) that answer with success; requests to one host are paced.

    Feeds of one address are fetched together, once, and each has its payload."""
    wanted = feeds.select(F.col("feed_url").alias("url")).distinct()
    got = http.fetched(wanted, http.FEED_HEADERS, settings.request_timeout, delay=settings.request_delay_seconds)
    return feeds.join(got.where("content is not null"), F.col("feed_url") == F.col("url")).select("feed_id", "feed_ord", "content")


def resolve_wrappers(links: DataFrame, fetch: Fetch, decoder: str = DECODER) -> DataFrame:
    """wrapper_url and publisher_url of the wrapper links (column wrapper_link) that can be resolved.

    A wrapper's page carries a signature and a time; with its token these ask the decoder for the address.
    """
    wrappers = links.where(is_wrapper(F.col("wrapper_link"))).select(F.col("wrapper_link").alias("url")).distinct()
    pages = fetch(wrappers).where("content is not null").select("url", decoding_parameters(bytes_as_text(F.col("content"), F.lit("utf-8"))).alias("p"))
    asked = pages.where("p is not null").select(F.lit(decoder).alias("url"), F.col("url").alias("key"), F.create_map(F.lit("f.req"), decoding_request(wrapper_token(F.col("url")), F.col("p.signature"), F.col("p.timestamp"))).alias("form"))
    answers = fetch(asked).where("content is not null")
    return answers.select(F.col("key").alias("wrapper_url"), decoded_url(bytes_as_text(F.col("content"), F.lit("utf-8"))).alias("publisher_url")).where("publisher_url is not null")


def as_pages(fetched: DataFrame) -> DataFrame:
    """Fetched articles as url, html, http_status and fetch_error. The encoding is what the header of the answer names, or
    else what the page does, or else UTF-8."""
    content = F.col("content")
    header = F.col("content_type") if "content_type" in fetched.columns else F.lit(None).cast("string")
    named = r"""(?i)charset\s*=\s*["']?([A-Za-z0-9_.:-]+)"""
    own = F.make_valid_utf8(F.substring(content, 1, 2048).cast("string"))
    declared = F.coalesce(*(F.nullif(F.regexp_extract(x, named, 1), F.lit("")) for x in (header, own)))
    return fetched.select("url", bytes_as_text(content, declared).alias("html"), "http_status", F.when(F.col("http_status").isNull(), F.col("fetch_error")).alias("fetch_error"))


def run(
    spark: SparkSession, registry: FeedRegistry, store: SnapshotStore, now: Column, sink: QueueSink | None = None, settings: Settings | None = None,
    feeds: Callable[[SparkSession, DataFrame, Settings], DataFrame] = fetch_feeds, fetch: Fetch | None = None, decoder: str = DECODER, primary=None,
) -> dict[str, int]:
    """Fetch the enabled feeds of the registry, and fold what they lead to into the store; the counters of the run.

    Payloads that are no feed are kept in the store's folder quarantine.
    """
    settings = settings or Settings()
    prepare(store, registry, now, sink)
    enabled = with_url(registry.frame(spark).where("enabled"), settings)
    return follow(spark, store, feeds(spark, enabled, settings), len(registry.enabled()), now, sink, settings, fetch, decoder, primary)


def prepare(store: SnapshotStore, registry: FeedRegistry, now: Column, sink: QueueSink | None = None) -> None:
    """What a run needs before its first feed: tables, the configured feeds, queues."""
    store.initialise()
    sync_feeds(store, registry, now)
    if sink is not None:
        sink.declare()


def follow(
    spark: SparkSession, store: SnapshotStore, payloads: DataFrame, feeds_processed: int, now: Column, sink: QueueSink | None = None,
    settings: Settings | None = None, fetch: Fetch | None = None, decoder: str = DECODER, primary=None,
) -> dict[str, int]:
    """From payloads (feed_id, feed_ord, content) to stored articles; the counters."""
    settings = settings or Settings()
    fetch = fetch or (lambda wanted: http.fetched(wanted, timeout=settings.article_timeout, delay=settings.request_delay_seconds))
    folder = f"{store.root}/fetched/{uuid.uuid4().hex}"

    def kept(name: str, df: DataFrame) -> DataFrame:
        """Written once, so that nothing is fetched twice."""
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    payloads = kept("feeds", payloads)
    rss.quarantined(payloads).select("feed_id", "content").write.mode("append").parquet(f"{store.root}/quarantine")
    links = rss.parse(payloads).select("wrapper_link").where("wrapper_link is not null").distinct()
    publishers = kept("publishers", resolve_wrappers(links, fetch, decoder))
    resolved = links.join(publishers, F.col("wrapper_link") == F.col("wrapper_url"), "left").select(F.coalesce("publisher_url", "wrapper_link").alias("url")).distinct()
    pages = kept("pages", as_pages(fetch(resolved)))
    return ingest(spark, store, payloads, publishers, pages, feeds_processed, now, sink, primary)
