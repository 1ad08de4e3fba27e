import datetime as dt
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from pressmill.operators import merge as M
from pressmill.operators import reads as R
from pressmill.plans import ingest as run
from pressmill.plans import run as whole
from pressmill.plans.sinks import QueueSink, report
from pressmill.plans.store import SnapshotStore, ddl
from pressmill.schemas import ARTICLES
from pressmill.sources.feeds import FeedRegistry, Settings
from pressmill.streaming.ingest import fold_batch, start

NOW = dt.datetime(2024, 1, 1)
LONG = "This sentence is certainly longer than forty characters in all."


def now():
    return F.lit(NOW)


FEEDS = [{"feed_id": f"{k}_{v}", "feed_type": k, "feed_value": v, "query": v, "enabled": e} for k, v, e in (("company", "tcs", True), ("sector", "it", True), ("etf", "gold", False))]


def payload(*links):
    items = "".join(f"<item><title>t {i}</title><link>{link}</link><pubDate>Fri, 05 Sep 2026 10:00:00 GMT</pubDate></item>" if link else "<item><title>none</title></item>" for i, link in enumerate(links))
    return bytearray(f"<rss><channel>{items}</channel></rss>", "utf-8")


@pytest.fixture
def store(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.initialise()
    store.initialise()
    return store


def frames(spark, *payloads):
    docs = spark.createDataFrame([(FEEDS[i]["feed_id"], i, p) for i, p in enumerate(payloads)], "feed_id string, feed_ord int, content binary")
    publishers = spark.createDataFrame([("https://n/rss/articles/1", "https://p.example/one?utm_source=x")], "wrapper_url string, publisher_url string")
    urls = ["https://p.example/one?utm_source=x", "https://p.example/one", "https://p.example/two/", "https://p.example/bad"]
    pages = spark.createDataFrame([(u, f"<article><p>{LONG} {u}</p></article>" if "bad" not in u else "<p>x</p>", 200, None) for u in urls], "url string, html string, http_status int, fetch_error string")
    return docs, publishers, pages


def test_run(spark, store, tmp_path):
    assert run.sync_feeds(store, FeedRegistry(FEEDS), now()) == 3 and store.read("feeds").count() == 3
    sink = QueueSink(spark, f"file://{tmp_path}/queues")
    sink.declare()
    sink.declare()
    # One article in two feeds, once through a wrapper; a link without a page; an entry without a link; a bad page.
    args = frames(spark, payload("https://n/rss/articles/1", "https://p.example/two/", None), payload("https://p.example/one", "https://p.example/bad", "https://p.example/unknown"))
    stats = run.ingest(spark, store, *args, feeds_processed=3, now=now(), sink=sink)
    assert stats == {"feeds_processed": 3, "rss_entries": 6, "articles_discovered": 3, "articles_inserted": 2, "articles_updated": 1, "articles_failed": 3, "messages_published": 2}
    articles = {r["url"]: r for r in store.read("articles").collect()}
    assert set(articles) == {"https://p.example/one", "https://p.example/two"}
    one = articles["https://p.example/one"]
    assert one["content"] == f"{LONG} https://p.example/one" and one["processing_status"] == "pending" and one["authors"] == [] and one["published_at"] == dt.datetime(2026, 9, 5, 10)
    assert R.feeds_of_article(store.read("article_feeds"), one["article_key"]).count() == 2
    assert R.link_exists(store.read("article_feeds"), one["article_key"], "sector_it") and not R.link_exists(store.read("article_feeds"), one["article_key"], "etf_gold")
    sent = [json.loads(r["value"]) for r in spark.read.text(f"file://{tmp_path}/queues/article.processing").collect()]
    assert sorted(x["article_key"] for x in sent) == sorted(r["article_key"] for r in articles.values())
    # Again: nothing is new.
    store.write("articles", M.update_summary(store.read("articles"), spark.createDataFrame([(one["article_key"], "S"), ("nobody", "S")], "article_key string, summary string"), now()))
    stats = run.ingest(spark, store, *args, feeds_processed=3, now=now() + F.expr("interval 1 day"), sink=None)
    assert stats["articles_inserted"] == stats["messages_published"] == 0 and stats["articles_updated"] == 3
    again = R.article_by_key(store.read("articles"), one["article_key"]).first()
    assert again["summary"] == "S" and again["processing_status"] == "summarized" and again["created_at"] == NOW and again["updated_at"] == NOW + dt.timedelta(1)
    assert store.read("article_feeds").count() == 3 and "Articles updated: 3" in report(stats)


def test_stream(spark, store, tmp_path):
    args = frames(spark, payload("https://p.example/one", "https://p.example/two/"))
    staged = run.entries_to_articles(*args)
    staged.write.parquet(f"file://{tmp_path}/staged")
    entries = spark.readStream.schema(staged.schema).parquet(f"file://{tmp_path}/staged")
    for _ in range(2):
        start(entries, store, f"file://{tmp_path}/checkpoint").awaitTermination(120)
        assert store.read("articles").count() == 2


class Broken(QueueSink):
    def publish(self, messages, queue=None):
        raise OSError("no broker")


def test_nothing_is_lost_when_publishing_fails(spark, store, tmp_path):
    args = frames(spark, payload("https://p.example/one", "https://p.example/two/"))
    with pytest.raises(OSError, match="no broker"):
        run.ingest(spark, store, *args, feeds_processed=1, now=now(), sink=Broken(spark, f"file://{tmp_path}/queues"))
    assert store.read("articles").count() == 2 and store.read("outbox").count() == 2
    sink = QueueSink(spark, f"file://{tmp_path}/queues")
    stats = run.ingest(spark, store, *args, feeds_processed=1, now=now(), sink=sink)
    assert stats["articles_inserted"] == 0 and store.read("outbox").isEmpty()
    sent = {r["value"] for r in spark.read.text(f"file://{tmp_path}/queues/article.processing").collect()}
    assert sent == {json.dumps({"article_key": r["article_key"]}, separators=(",", ":")) for r in store.read("articles").collect()}


def test_a_stop_between_outbox_and_articles(spark, store, tmp_path, monkeypatch):
    staged = run.entries_to_articles(*frames(spark, payload("https://p.example/one")))
    merge = store.merge
    monkeypatch.setattr(store, "merge", lambda table, *rest: (_ for _ in ()).throw(OSError("stop")) if table == "articles" else merge(table, *rest))
    with pytest.raises(OSError, match="stop"):
        run.commit(store, staged, now())
    monkeypatch.undo()
    sink = QueueSink(spark, f"file://{tmp_path}/queues")
    # A message without its article waits; the run that stores the article adds no second one.
    run.publish_waiting(store, sink)
    assert store.read("outbox").count() == 1 and store.read("articles").isEmpty()
    run.commit(store, staged, now())
    run.publish_waiting(store, sink)
    assert store.read("outbox").isEmpty() and spark.read.text(f"file://{tmp_path}/queues/article.processing").count() == 1


def test_a_repeated_stream_batch(spark, store, tmp_path):
    batch = run.entries_to_articles(*frames(spark, payload("https://p.example/one", "https://p.example/two/")))
    with pytest.raises(OSError):
        fold_batch(store, Broken(spark, f"file://{tmp_path}/queues"))(batch, 0)
    for _ in range(2):
        fold_batch(store, QueueSink(spark, f"file://{tmp_path}/queues"))(batch, 0)
    assert spark.read.text(f"file://{tmp_path}/queues/article.processing").count() == 2 and store.read("articles").count() == 2


def test_store_after_a_stop(spark, store, monkeypatch):
    rows = spark.createDataFrame([("k", "f", NOW)], "article_key string, feed_id string, first_seen_at timestamp")
    store.write("article_feeds", rows)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("stop")))
        with pytest.raises(OSError, match="stop"):
            store.write("article_feeds", rows.limit(0))
    store.initialise()
    assert store.read("article_feeds").count() == 1
    # Two writers that start from one manifest: the second fails, and nothing of the first is lost.
    late = store._numbers("article_feeds")
    store.write("article_feeds", rows.unionAll(rows))
    monkeypatch.setattr(store, "_numbers", lambda _: late)
    with pytest.raises(OSError, match="meanwhile"):
        store._commit("article_feeds", {"buckets": 16, "folders": {}})
    monkeypatch.undo()
    assert store.read("article_feeds").count() == 2 and store.vacuum() >= 1 and store.read("article_feeds").count() == 2


def test_interleaved_writers_lose_nothing(spark, store):
    """Another run writes between a merge's reading and its commit: the merge fails whole, and can be made again."""

    def links(*keys):
        return spark.createDataFrame([(k, "f", NOW) for k in keys], "article_key string, feed_id string, first_seen_at timestamp")

    other = SnapshotStore(spark, store.root)

    def add(into, rows, before=lambda: None):
        def change(stored):
            before()
            return M.add_links(stored, rows)

        into.merge("article_feeds", rows, change)

    keys = lambda: {r["article_key"] for r in store.read("article_feeds").collect()}
    with pytest.raises(OSError, match="meanwhile"):
        add(store, links("a"), lambda: add(other, links("b")))
    assert keys() == {"b"}
    add(store, links("a"))
    assert keys() == {"a", "b"}
    # So it is for whole tables, and where the other run wrote twice.
    message = spark.createDataFrame([("k", "m")], "article_key string, message string")
    with pytest.raises(OSError, match="meanwhile"):
        store.rewrite("outbox", lambda rows: [other.rewrite("outbox", lambda x: x.unionAll(message)) for _ in range(2)] and rows)
    assert store.read("outbox").count() == 2
    assert not [x for x in store._names("article_feeds") + store._names("outbox") if x.startswith(".") and not x.endswith(".crc")]


def test_feeds_of_one_address_are_fetched_once(spark, tmp_path):
    """Two feeds with one address: one request, an entry in each; the second sighting is an update with a link of its own."""
    Site.seen = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    twice = [f | {"query": "tcs", "enabled": True} for f in FEEDS[:2]]
    try:
        here = f"http://127.0.0.1:{server.server_port}"
        store = SnapshotStore(spark, f"file://{tmp_path}/store")
        stats = whole.run(spark, FeedRegistry(twice), store, now(), None, Settings(base_url=f"{here}/feed", request_delay_seconds=0.01), decoder=f"{here}/decode")
    finally:
        server.shutdown()
    assert stats == {"feeds_processed": 2, "rss_entries": 8, "articles_discovered": 4, "articles_inserted": 2, "articles_updated": 2, "articles_failed": 4, "messages_published": 2}
    assert sum(x[1].startswith("/feed") for x in Site.seen) == 1 and store.read("article_feeds").count() == 4


def test_a_merge_rewrites_touched_buckets_only(spark, store):
    links = spark.createDataFrame([(f"k{i}", "f", NOW) for i in range(200)], "article_key string, feed_id string, first_seen_at timestamp")
    store.merge("article_feeds", links, lambda rows: M.add_links(rows, links))
    before = store._manifest("article_feeds")["folders"]
    new = links.where("article_key = 'k7'").withColumn("feed_id", F.lit("g"))
    store.merge("article_feeds", new, lambda rows: M.add_links(rows, new))
    after = store._manifest("article_feeds")["folders"]
    assert len(before) == 16 and sum(before[k] != after[k] for k in before) == 1 and store.read("article_feeds").count() == 201


def test_schema_statements(spark):
    for statement in ddl():
        spark.sql(statement.replace(" EXISTS ", " EXISTS ddl_"))
    try:
        assert [f.name for f in spark.table("ddl_articles").schema] == ARTICLES.fieldNames() and len(ddl()) == 4
    finally:
        for name in ("feeds", "articles", "article_feeds", "outbox"):
            spark.sql(f"DROP TABLE IF EXISTS ddl_{name}")


class Site(BaseHTTPRequestHandler):
    """Two feeds, a wrapper and its decoder, and articles; every request is noted."""

    seen: list = []

    def log_message(self, *args):
        pass

    def answer(self, status, body):
        self.seen.append((self.command, self.path, self.headers["User-Agent"], self.headers["Accept"]))
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        here, path = f"http://{self.headers['Host']}", self.path
        if path.startswith("/feed?q=tcs"):
            links = (f"{here}/rss/articles/TOKEN?oc=5", f"{here}/two", f"{here}/gone", f"{here}/rss/read/DEAD")
            self.answer(200, bytes(payload(*links)))
        elif path.startswith("/feed"):
            self.answer(503, bytes(payload(f"{here}/two")))
        elif path.startswith("/rss/articles/TOKEN"):
            self.answer(200, b'<c-wiz data-n-a-sg="SIG" data-n-a-ts="123">')
        elif path in ("/one", "/two"):
            self.answer(200, f"<article><p>{LONG} {path}</p></article>".encode())
        else:
            self.answer(403 if path == "/gone" else 404, b"<p>" + LONG.encode())

    def do_POST(self):
        form = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
        call = json.loads(form["f.req"][0])[0]
        good = call[0] == "Fbv4je" and call[2:] == [None, "generic"] and json.loads(call[1]) == [["TOKEN", "SIG", "123"]]
        body = json.dumps([["wrb.fr", f"http://{self.headers['Host']}/one"]]) if good else "[]"
        self.answer(200, (")]}'\n" + body).encode())


def test_whole_run(spark, tmp_path):
    Site.seen = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        here = f"http://127.0.0.1:{server.server_port}"
        store = SnapshotStore(spark, f"file://{tmp_path}/store")
        sink = QueueSink(spark, f"file://{tmp_path}/queues")
        settings = Settings(base_url=f"{here}/feed", request_delay_seconds=0.0)
        stats = whole.run(spark, FeedRegistry(FEEDS), store, now(), sink, settings, decoder=f"{here}/decode")
    finally:
        server.shutdown()
    # The second feed fails and only counts as processed; of four entries two lead to articles.
    assert stats == {"feeds_processed": 2, "rss_entries": 4, "articles_discovered": 2, "articles_inserted": 2, "articles_updated": 0, "articles_failed": 2, "messages_published": 2}
    assert {r["url"] for r in store.read("articles").collect()} == {f"{here}/one", f"{here}/two"}
    assert spark.read.text(f"file://{tmp_path}/queues/article.processing").count() == 2 and store.read("feeds").count() == 3
    asked = [x[1].split("?")[0] for x in Site.seen]
    assert sorted(asked) == sorted(["/feed", "/feed", "/rss/articles/TOKEN", "/rss/read/DEAD", "/decode", "/one", "/two", "/gone", "/rss/read/DEAD"])
    accepts = {x[1]: x[3] for x in Site.seen if x[0] == "GET"}
    assert accepts["/two"].startswith("text/html") and next(v for k, v in accepts.items() if k.startswith("/feed")).startswith("application/rss+xml")
    assert all(x[2].startswith("pressmill/") for x in Site.seen)


def test_decoding_request(spark):
    from pressmill.functions.url import decoding_request

    got = spark.createDataFrame([('t"]', "s\\", "1"), (None, "s", "1")], "a string, b string, c string").select(decoding_request(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert json.loads(got[0]["x"]) == [["Fbv4je", json.dumps([['t"]', "s\\", "1"]], separators=(",", ":")), None, "generic"]] and got[1]["x"] is None


def test_fold_matches_a_sequence(spark):
    rng = random.Random(3)
    old = [(f"k{i}", f"old{i}", f"s{i}" if i % 2 else None) for i in range(10)]
    stream = [(rng.randrange(6), i, f"k{rng.randrange(25)}", rng.choice(["a", "b", None])) for i in range(200)]
    stored = spark.createDataFrame([(k, t, f"u{k}", None, [], None, None, None, s, "summarized" if s else "pending", NOW, NOW) for k, t, s in old], ARTICLES)
    staged = spark.createDataFrame([(f"f{o}", o, i, k, t) for o, i, k, t in stream], "feed_id string, feed_ord int, entry_ord int, article_key string, title string").selectExpr("*", "'u' url", "cast(null as string) source", "cast(array() as array<string>) authors", "cast(null as timestamp) published_at", "title content", "title content_hash", "cast(null as string) failure")
    out = run.fold(staged, stored, spark.createDataFrame([], "article_key string, feed_id string, first_seen_at timestamp"), now())
    expected, sent, links = {k: (t, s) for k, t, s in old}, [], set()
    for o, _, k, t in sorted(stream, key=lambda x: x[:2]):
        if k not in expected:
            sent.append(k)
        expected[k] = (t, expected.get(k, (None, None))[1])
        links.add((k, f"f{o}"))
    assert {r["article_key"]: (r["title"], r["summary"]) for r in out["articles"].collect()} == expected
    assert sorted(json.loads(r["message"])["article_key"] for r in out["messages"].collect()) == sorted(sent)
    assert {(r["article_key"], r["feed_id"]) for r in out["article_feeds"].collect()} == links
    stats = run.counters(staged, 6, stored).first()
    assert (stats["articles_inserted"], stats["articles_updated"]) == (len(sent), 200 - len(sent))


def test_reads(spark):
    feeds = spark.createDataFrame([("b", True), ("a", False), ("c", True)], "feed_id string, enabled boolean")
    assert [r[0] for r in R.all_feeds(feeds).collect()] == ["a", "b", "c"] and [r[0] for r in R.enabled_feeds(feeds).collect()] == ["b", "c"]
    assert R.feed_by_id(feeds, "x").isEmpty()
    articles = spark.createDataFrame([("k2", "pending", 2), ("k1", "pending", 2), ("k0", "pending", 1), ("k3", "done", 0)], "article_key string, processing_status string, created_at int")
    assert [r[0] for r in R.pending_articles(articles, 2).collect()] == ["k0", "k1"]
    for n in (0, -1):
        with pytest.raises(ValueError):
            R.pending_articles(articles, n)


def test_integrity(spark):
    links = spark.createDataFrame([("a", "f"), ("b", "f"), ("a", "g")], "article_key string, feed_id string")
    assert M.valid_links(links, spark.createDataFrame([("a",)], "article_key string"), spark.createDataFrame([("f",)], "feed_id string")).collect() == [links.first()]
    assert M.cascade_delete(links, spark.createDataFrame([("a",)], "article_key string"), "article_key").count() == 1


def test_configuration(spark, tmp_path):
    with pytest.raises(ValueError):
        SnapshotStore(spark, "")
    with pytest.raises(ValueError):
        QueueSink(spark, "")
    with pytest.raises(FileNotFoundError):
        SnapshotStore(spark, f"file://{tmp_path}/none").read("feeds")
    assert len(ddl()) == 4
