"""Feeds as a stream: a local server's log shows what is fetched, and when it isn't."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pressmill.plans.sinks import QueueSink
from pressmill.plans.store import SnapshotStore
from pressmill.sources.feed_stream import FeedStream, FeedStreamReader
from pressmill.sources.feeds import FeedRegistry, Settings
from pressmill.streaming import feeds as stream


class Site(BaseHTTPRequestHandler):
    """Feeds by path: version, headers and body; a log of methods and paths."""

    feeds: dict = {}
    log: list = []
    protocol_version = "HTTP/1.1"

    def log_message(self, *args):
        pass

    def answer(self):
        path = self.path.split("?")[0]
        self.log.append((self.command, path))
        feed = self.feeds.get(path, {"status": 404})
        status = feed.get(self.command, feed.get("status", 200))
        body = feed.get("body", b"") if status == 200 else b""
        self.send_response(status)
        for k, v in feed.get("headers", {}).items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    do_HEAD = do_GET = answer


@pytest.fixture
def site():
    Site.feeds, Site.log = {}, []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def gets():
    found = Counter(path for method, path in Site.log if method == "GET")
    Site.log.clear()
    return found


def polled(spark, urls, folder):
    """One run of a query from its checkpoint: the rows that it adds."""
    spark.dataSource.register(FeedStream)
    before = Counter(rows(spark, folder))
    df = spark.readStream.format("feeds").option("urls", json.dumps(urls)).load().select("url", F.col("content").cast("string").alias("content"), "http_status")
    df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination(120)
    return sorted((Counter(rows(spark, folder)) - before).elements())


def rows(spark, folder):
    try:
        return [(r["url"].rsplit("/", 1)[1], r["content"], r["http_status"]) for r in spark.read.parquet(f"{folder}/out").collect()]
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)
        return []


def test_a_restart_fetches_what_has_changed_and_nothing_else(spark, site, tmp_path):
    Site.feeds = {
        "/tag": {"body": b"t1", "headers": {"ETag": '"1"'}},
        "/date": {"body": b"d1", "headers": {"Last-Modified": "Thu, 01 Jan 2026 00:00:00 GMT"}},
        "/nohead": {"body": b"n1", "headers": {"ETag": '"n"'}, "HEAD": 405},
        "/down": {"status": 500},
        "/none": {"status": 404},
    }
    urls = [site + p for p in Site.feeds]
    assert polled(spark, urls, tmp_path) == [("date", "d1", 200), ("nohead", "n1", 200), ("tag", "t1", 200)]
    assert gets()["/tag"] == 1
    assert polled(spark, urls, tmp_path) == [] and not gets().keys() & {"/tag", "/date"}
    Site.feeds["/tag"] = {"body": b"t2", "headers": {"ETag": '"2"'}}
    Site.feeds["/down"] = {"body": b"up", "headers": {"ETag": '"u"'}}
    assert polled(spark, urls, tmp_path) == [("down", "up", 200), ("tag", "t2", 200)]
    found = gets()
    assert found["/tag"] == found["/down"] == 1 and "/date" not in found
    assert polled(spark, [*urls, site + "/more"], tmp_path) == []


def test_feeds_without_a_version_are_fetched_each_time(spark, site, tmp_path):
    Site.feeds = {"/plain": {"body": b"p"}}
    assert polled(spark, [site + "/plain"], tmp_path) == polled(spark, [site + "/plain"], tmp_path) == [("plain", "p", 200)]


def test_no_feeds(spark, tmp_path):
    assert polled(spark, [], tmp_path) == []


def test_offsets(site):
    """A silent feed keeps its version; only changed ones are read, by host; what was promised isn't passed over."""
    Site.feeds = {"/a": {"body": b"a", "headers": {"ETag": "1"}}, "/b": {"body": b"b", "headers": {"ETag": "1"}}}
    a, b = site + "/a", site + "/b"
    reader = FeedStreamReader({"urls": json.dumps([b, a, a])})
    first = reader.latestOffset()
    assert first == {a: {"etag": "1"}, b: {"etag": "1"}} and [p.value for p in reader.partitions({}, first)] == [[a, b]]
    assert reader.partitions(first, first) == []
    Site.feeds["/a"]["status"] = 503
    assert reader.latestOffset() == first
    with pytest.raises(OSError, match="503"):
        list(reader.read(reader.partitions({}, first)[0]))
    Site.feeds["/a"]["status"] = 410
    assert [(r[0], r[1], r[2]) for r in reader.read(reader.partitions({}, first)[0])] == [(a, None, 410), (b, b"b", 200)]
    Site.feeds["/b"]["headers"] = {"ETag": "2"}
    second = reader.latestOffset()
    assert [p.value for p in reader.partitions(first, second)] == [[b]]
    # After a restart the start of the first micro-batch is the only thing known, and is enough.
    again = FeedStreamReader({"urls": json.dumps([a, b])})
    Site.feeds["/a"]["status"] = 200
    assert again.partitions(second, again.latestOffset()) == []


def test_the_whole_run_as_a_stream(spark, site, tmp_path):
    text = "This sentence is certainly longer than forty characters in all."

    def feed(*pages):
        return "".join(("<rss><channel>", *(f"<item><title>{p}</title><link>{site}/{p}</link></item>" for p in pages), "</channel></rss>")).encode()

    Site.feeds = {f"/{p}": {"body": f"<article><p>{text} {p}</p></article>".encode()} for p in ("one", "two")}
    Site.feeds["/feed"] = {"body": feed("one"), "headers": {"ETag": "1"}}
    registry = FeedRegistry([{"feed_id": "market_india", "feed_type": "market", "feed_value": "india", "query": "q", "enabled": True}])
    settings = Settings(base_url=f"{site}/feed", request_delay_seconds=0.0)
    store, sink = SnapshotStore(spark, f"file://{tmp_path}/store", 2), QueueSink(spark, f"file://{tmp_path}/queues")

    def run():
        stream.start(spark, registry, store, f"file://{tmp_path}/checkpoint", sink, settings).awaitTermination(300)
        return store.read("articles").count(), spark.read.text(f"{sink.address}/{sink.queues[0]}").count()

    assert run() == (1, 1) and gets()["/feed"] == 1
    assert run() == (1, 1) and not gets()
    Site.feeds["/feed"] = {"body": feed("one", "two"), "headers": {"ETag": "2"}}
    assert run() == (2, 2) and gets() == {"/feed": 1, "/one": 1, "/two": 1}
    assert {r["feed_id"] for r in store.read("article_feeds").collect()} == {"market_india"}
