"""First and last sightings with state: what a micro-batch costs depends on its own rows, not on what is stored.

The state of a key is the order of the sighting that counts and the feeds that have named it. A micro-batch adds one row to the log of
changes for each key that it changes, through Spark's file sink, which writes each micro-batch once. The log gives the
rows that the batch fold gives (operators.merge), in whatever order the sightings arrive: a sighting counts if no later one, by
the order column, has been seen.

- A row without a key is left out; a null feed makes no link; a null order comes before all others.
- Of a key's sightings of the same order the one that is seen last counts, as in a store that is overwritten.
- With expire_ms, a key that hasn't been seen for so long is forgotten, and is new when it comes again; the log still has its
  old rows, so readers of the log can tell. Without it, state grows with the number of keys.
- Rows are folded by key and feed within each Arrow batch before they are shuffled, so a hot key doesn't bring all its rows to its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.merge import last_per_key, messages

KEY, FEED, ORDER = "article_key", "feed_id", "sighted"
#: Settings of the session for these queries.
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: The order of a sighting without one.
LOWEST = -(2**63)


def prefolded(entries: DataFrame) -> DataFrame:
    """The last sighting of each key and feed within each Arrow batch."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.select([KEY, FEED, ORDER]).to_pandas().sort_values(ORDER, kind="stable").drop_duplicates([KEY, FEED], keep="last").index
            yield batch.take(pa.array(sorted(at), pa.int64()))

    rows = entries.where(F.col(KEY).isNotNull()).withColumn(ORDER, F.coalesce(F.col(ORDER).cast("long"), F.lit(LOWEST)))
    return rows.mapInArrow(fold, rows.schema)


class Sightings(StatefulProcessor):
    """values: the columns that a sighting that counts writes."""

    def __init__(self, values: list[str], expire_ms: int | None = None):
        self.values, self.expire_ms = values, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sighted long", self.expire_ms)
        self.feeds = handle.getMapState("feeds", "feed_id string", "seen boolean", self.expire_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()
        highest, best, new = (None if known is None else known[0]), None, set()
        for row in rows:
            if highest is None or row[ORDER] >= highest:
                highest, best = row[ORDER], row
            feed = row[FEED]
            if feed is not None and feed not in new:
                if not self.feeds.containsKey((feed,)):
                    new.add(feed)
                self.feeds.updateValue((feed,), (True,))  # which also puts off its expiry
        self.last.update((highest,))
        if known is None or best is not None or new:
            values = {c: None if best is None else best[c] for c in self.values}
            yield Row(**{KEY: key[0], "is_new": known is None, "new_feeds": sorted(new), ORDER: None if best is None else highest}, **values)

    def close(self) -> None:
        pass


def changes(entries: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """A stream of changes from a stream of article_key, feed_id, sighted (a number that grows with time) and other columns.

    is_new: the key wasn't known; new_feeds: the feeds that name it for the first time; sighted and the other columns are
    null where a later sighting has been seen before.
    """
    values = [c for c in entries.columns if c not in (KEY, FEED, ORDER)]
    nullable = [T.StructField(c, entries.schema[c].dataType) for c in values]
    out = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("is_new", T.BooleanType()), T.StructField("new_feeds", T.ArrayType(T.StringType())), T.StructField(ORDER, T.LongType()), *nullable])
    timing = "none" if expire_ms is None else "processingTime"
    return prefolded(entries).groupBy(KEY).transformWithState(Sightings(values, expire_ms), out, "append", timing)


def start(entries: DataFrame, log: str, checkpoint: str, expire_ms: int | None = None, every: str | None = None) -> StreamingQuery:
    """Add the changes that entries make to the log. every: the interval of micro-batches; without one, takes what has arrived.

    The state store of this query is RocksDB, as its kind of state asks for it. It makes no micro-batches without rows: expiry by
    the clock would ask for them without end, and what has expired isn't read in any case.
    """
    spark = entries.sparkSession
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        trigger = {"processingTime": every} if every else {"availableNow": True}
        writer = changes(entries, expire_ms).writeStream.format("parquet").outputMode("append").trigger(**trigger)
        return writer.option("path", log).option("checkpointLocation", checkpoint).start()
    finally:  # a query keeps the settings that it starts with
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest(spark: SparkSession, log: str) -> DataFrame:
    """The rows that count: what an upsert of all sightings stores, with the order of each."""
    rows = spark.read.parquet(log).where(f"{ORDER} is not null").drop("is_new", "new_feeds")
    return last_per_key(rows, [KEY], F.col(ORDER))


def links(spark: SparkSession, log: str) -> DataFrame:
    """article_key and feed_id, each pair once."""
    return spark.read.parquet(log).select(KEY, F.explode("new_feeds").alias(FEED)).distinct()


def new_messages(spark: SparkSession, log: str) -> DataFrame:
    """A message for each first sighting; a key that was forgotten has another when it comes again."""
    return messages(spark.read.parquet(log).where("is_new").select(KEY))
