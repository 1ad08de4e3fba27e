"""The whole run as a stream: micro-batches of the feeds that have changed, each folded into the store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.url import DECODER
from ..plans.run import Fetch, follow, prepare
from ..plans.sinks import QueueSink
from ..plans.store import SnapshotStore
from ..sources.feed_stream import FeedStream
from ..sources.feeds import FeedRegistry, Settings, with_url


def changed(spark: SparkSession, feeds: DataFrame, settings: Settings) -> DataFrame:
    """A stream of feed_id, feed_ord and content of the feeds (with feed_url) whose version changes.

    The addresses are an option of the source, as the registry is a configuration. Feeds of one address are fetched once.
    """
    spark.dataSource.register(FeedStream)
    urls = [r[0] for r in feeds.select("feed_url").distinct().collect()]
    options = {"urls": json.dumps(urls), "timeout": str(settings.request_timeout), "delay": str(settings.request_delay_seconds)}
    got = spark.readStream.format("feeds").options(**options).load().where("content is not null")
    return got.join(feeds, F.col("feed_url") == F.col("url")).select("feed_id", "feed_ord", "content")


def start(
    spark: SparkSession, registry: FeedRegistry, store: SnapshotStore, checkpoint: str, sink: QueueSink | None = None, settings: Settings | None = None,
    every: str | None = None, fetch: Fetch | None = None, decoder: str = DECODER, primary=None,
) -> StreamingQuery:
    """Follow the enabled feeds of the registry. every: the interval between polls; without one, one poll is made.

    A micro-batch that is run again finds its articles stored, so it adds no article, link or message.
    """
    settings = settings or Settings()
    prepare(store, registry, F.current_timestamp(), sink)
    payloads = changed(spark, with_url(registry.frame(spark).where("enabled"), settings), settings)

    def fold(batch: DataFrame, batch_id: int) -> None:
        follow(spark, store, batch, len(registry.enabled()), F.current_timestamp(), sink, settings, fetch, decoder, primary)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return payloads.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**trigger).start()
