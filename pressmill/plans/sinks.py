"""Message sinks: queues as folders of JSON lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.feeds import Settings


@dataclass(frozen=True)
class QueueSink:
    """The main queue and its retry and dead-letter queues below one address."""

    spark: SparkSession
    address: str
    settings: Settings = Settings()

    def __post_init__(self) -> None:
        if not self.address:
            raise ValueError("The broker's address is not configured.")

    @property
    def queues(self) -> tuple[str, str, str]:
        return self.settings.article_queue, self.settings.retry_queue, self.settings.dead_letter_queue

    def declare(self) -> None:
        """Make the three queues; again does nothing."""
        for queue in self.queues:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.address.rstrip('/')}/{queue}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)

    def publish(self, messages: DataFrame, queue: str | None = None) -> None:
        """Append messages, one JSON object a line."""
        messages.select("message").write.mode("append").text(f"{self.address.rstrip('/')}/{queue or self.settings.article_queue}")


COUNTERS = ("feeds_processed", "rss_entries", "articles_discovered", "articles_inserted", "articles_updated", "articles_failed", "messages_published")


def report(stats: dict[str, int]) -> str:
    return "\n".join(f"{name.replace('_', ' ').capitalize()}: {stats.get(name, 0)}" for name in COUNTERS)
