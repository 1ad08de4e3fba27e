"""Targets outside: a database through JDBC, and a broker over HTTP, both local."""

import base64
import datetime as dt
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pressmill.operators import merge as M
from pressmill.plans.database import DERBY, Database
from pressmill.schemas import ARTICLE_FEEDS, ARTICLES
from pressmill.sources.broker import Broker, BrokerSink

NOW, LATER = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
NEW = "article_key string, title string, url string, source string, authors array<string>, published_at timestamp, content string, content_hash string"


class Receiver(BaseHTTPRequestHandler):
    """Queues of a broker: what was published, by queue. Every message named in fail_once is refused once."""

    queues: dict = {}
    fail_once: set = set()
    lock = threading.Lock()
    protocol_version = "HTTP/1.1"

    def log_message(self, *args):
        pass

    def answer(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status, said = 200, {}
        with self.lock:
            if self.headers["Authorization"] != "Basic " + base64.b64encode(b"me:pw").decode():
                status = 401
            elif self.command == "PUT" and self.path.startswith("/api/queues/%2F/"):
                assert body["durable"]
                self.queues.setdefault(self.path.rsplit("/", 1)[1], [])
                status = 201
            elif self.command == "POST" and self.path == "/api/exchanges/%2F/amq.default/publish":
                if body["payload"] in self.fail_once:
                    self.fail_once.discard(body["payload"])
                    status = 500
                elif said := {"routed": body["routing_key"] in self.queues}:
                    if said["routed"]:
                        self.queues[body["routing_key"]].append((body["payload"], body["properties"]))
            else:
                status = 404
        out = json.dumps(said).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    do_PUT = do_POST = answer


@pytest.fixture
def broker():
    Receiver.queues, Receiver.fail_once = {}, set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_messages_reach_the_queue(spark, broker):
    sink = BrokerSink(spark, broker, options=(("user", "me"), ("password", "pw")))
    sink.declare()
    sink.declare()
    assert sorted(Receiver.queues) == sorted(sink.queues)
    keys = spark.range(50).select(F.concat(F.lit("k"), "id").alias("article_key"))
    sink.publish(M.messages(keys))
    got = Receiver.queues[sink.queues[0]]
    assert sorted(json.loads(m)["article_key"] for m, _ in got) == sorted(f"k{i}" for i in range(50))
    assert all(p == {"delivery_mode": 2, "content_type": "application/json", "message_id": json.loads(m)["article_key"]} for m, p in got)
    sink.publish(M.messages(keys.limit(0)))
    assert len(got) == 50
    with pytest.raises(Exception, match="no queue nowhere"):
        sink.publish(M.messages(keys), "nowhere")
    with pytest.raises(Exception, match="401"):
        BrokerSink(spark, broker).declare()
    with pytest.raises(ValueError, match="not configured"):
        BrokerSink(spark, "")


def test_a_stream_of_messages(spark, broker, tmp_path):
    spark.dataSource.register(Broker)
    sink = BrokerSink(spark, broker, options=(("user", "me"), ("password", "pw")))
    sink.declare()
    options = {"address": broker, "queue": sink.queues[0], "user": "me", "password": "pw", "checkpointLocation": f"file://{tmp_path}/checkpoint"}
    for lot in range(2):
        M.messages(spark.range(lot * 5, lot * 5 + 5).select(F.col("id").cast("string").alias("article_key"))).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("article_key string, message string").parquet(f"{tmp_path}/in")
        stream.writeStream.format("broker").options(**options).trigger(availableNow=True).start().awaitTermination(120)
    assert Counter(p["message_id"] for _, p in Receiver.queues[sink.queues[0]]) == Counter(str(i) for i in range(10))
    # A message that fails stops the query; a restart sends what that task had sent again, under the same ids, and nothing else.
    M.messages(spark.range(10, 15).select(F.col("id").cast("string").alias("article_key"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("article_key string, message string").parquet(f"{tmp_path}/in").writeStream.format("broker").options(**options).trigger(availableNow=True)
    Receiver.fail_once = {'{"article_key":"13"}'}
    with pytest.raises(Exception, match="500"):
        stream.start().awaitTermination(120)
    stream.start().awaitTermination(120)
    sent = Counter(p["message_id"] for _, p in Receiver.queues[sink.queues[0]])
    assert sent == Counter([*map(str, range(15)), "10", "11", "12"])


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path_factory.mktemp('log')}/derby.log")
    db = Database(spark, f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true", DERBY)
    db.initialise()
    db.initialise()
    return db


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_upserts_and_links_as_the_merges_make_them(spark, database):
    db, long = database, "text " * 20_000

    def key(i):
        return f"{i * 7919 % 256:02x}" + "0" * 60 + f"{i:02x}"

    def sightings(ids, word):
        made = [(key(i), None if i % 5 == 0 else f"{word} {i} é", f"https://a.example/{i}", "s", [f"a{i}", 'q"'] if i % 2 else [], NOW if i % 3 else None, long if i == 1 else word, "h" * 64) for i in ids]
        return spark.createDataFrame(made, NEW)

    first, second = sightings(range(40), "one"), sightings(range(20, 60), "two")
    assert db.upsert_articles(first, F.lit(NOW)) == 40
    db.execute([f"UPDATE articles SET summary = 'S', processing_status = 'summarized' WHERE article_key = '{key(30)}'"])
    assert db.upsert_articles(second, F.lit(LATER)) == 40
    stored = M.upsert_articles(spark.createDataFrame([], ARTICLES), first, F.lit(NOW))
    stored = M.update_summary(stored, spark.createDataFrame([(key(30), "S")], "article_key string, summary string"), F.lit(NOW))
    expected = M.upsert_articles(stored, second, F.lit(LATER))
    got = db.read("articles")
    assert got.rdd.getNumPartitions() == 16 and rows(got) == rows(expected)
    feeds = spark.createDataFrame([(f, "market", f, "q", f == "x") for f in "xy"], "feed_id string, feed_type string, feed_value string, query string, enabled boolean")
    assert db.upsert_feeds(feeds, F.lit(NOW)) == 2 and db.upsert_feeds(feeds.withColumn("query", F.lit("r")), F.lit(LATER)) == 2
    assert {(r["query"], r["created_at"], r["enabled"]) for r in db.read("feeds").collect()} == {("r", NOW, True), ("r", NOW, False)}
    links = spark.createDataFrame([(key(i), f, t) for i in range(10) for f in "xy" for t in (LATER, NOW)], ARTICLE_FEEDS)
    assert db.add_links(links) == 20 and db.add_links(links.withColumn("first_seen_at", F.lit(LATER))) == 0
    assert rows(db.read("article_feeds")) == rows(M.add_links(spark.createDataFrame([], ARTICLE_FEEDS), links))
    # A link to nothing fails the whole merge; deletes cascade.
    with pytest.raises(Exception, match="(?i)foreign key"):
        db.add_links(spark.createDataFrame([(key(11), "x", NOW), (key(12), "nobody", NOW)], ARTICLE_FEEDS))
    assert db.read("article_feeds").count() == 20
    db.execute(["DELETE FROM feeds WHERE feed_id = 'y'"])
    assert db.read("article_feeds").count() == 10


def test_what_breaks_a_rule_changes_nothing(spark, database):
    before = database.read("articles").count()
    bad = spark.createDataFrame([("e" * 64, "t", "u", "s", [], None, "c", "h"), ("f" * 64, "t", None, "s", [], None, "c", "h")], NEW)
    with pytest.raises(Exception, match="(?i)null"):
        database.upsert_articles(bad, F.lit(NOW))
    assert database.read("articles").count() == before
    assert database.upsert_articles(bad.limit(0), F.lit(NOW)) == 0
    with pytest.raises(ValueError, match="not configured"):
        Database(spark, "")
