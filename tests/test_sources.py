import pytest
from pyspark.sql import functions as F

from pressmill.functions.html import FAILED, extraction, paragraphs_of, self_described
from pressmill.sources import feeds as S
from pressmill.sources import rss

LONG = "This sentence is certainly longer than forty characters in all."


def feed(**changes):
    return {"feed_id": "company_tcs", "feed_type": "company", "feed_value": "tcs", "query": "TCS", "enabled": True} | changes


def test_vocabulary(spark):
    assert S.vocabulary(spark).count() == 25 and len(S.ALLOWED) == 8


@pytest.mark.parametrize(
    "bad, said",
    [
        ("x", "object"),
        ({"feed_id": "a"}, "required"),
        (feed(feed_type="x"), "feed_type:"),
        (feed(feed_value="x"), "feed_value:"),
        (feed(feed_id="x"), "feed_id:"),
        (feed(query=" "), "query:"),
        (feed(query=3), "query:"),
        (feed(enabled="yes"), "enabled:"),
    ],
)
def test_violations(bad, said):
    assert said in S.violation(0, bad, set())


def test_registry(tmp_path, spark):
    import yaml

    path = tmp_path / "feeds.yaml"
    with pytest.raises(FileNotFoundError):
        S.load(path)
    for content in ("- a", "feeds: 3", yaml.safe_dump({"feeds": [feed(), feed()]})):
        path.write_text(content)
        with pytest.raises(ValueError):
            S.load(path)
    path.write_text(yaml.safe_dump({"other": {}, "feeds": [feed(), feed(feed_id="sector_it", feed_type="sector", feed_value="it", enabled=False)]}))
    registry = S.FeedRegistry.from_yaml(path)
    assert registry.count() == 2 and len(registry.all()) == 2 and [f["feed_id"] for f in registry.enabled()] == ["company_tcs"]
    assert registry.get("sector_it")["enabled"] is False
    with pytest.raises(KeyError):
        registry.get("none")
    rows = S.with_url(registry.frame(spark)).orderBy("feed_ord").collect()
    assert rows[0]["feed_url"] == "https://news.google.com/rss/search?q=TCS&hl=en-IN&gl=IN&ceid=IN%3Aen"


def test_settings(monkeypatch):
    """The defaults, and what the environment changes."""
    names = "APP_NAME ENVIRONMENT GOOGLE_NEWS_BASE_URL GOOGLE_NEWS_LANGUAGE GOOGLE_NEWS_COUNTRY GOOGLE_NEWS_CEID REQUEST_TIMEOUT ARTICLE_TIMEOUT REQUEST_DELAY_SECONDS MAX_ARTICLES_PER_FEED DATABASE_URL RABBITMQ_URL ARTICLE_QUEUE ARTICLE_RETRY_QUEUE ARTICLE_DLQ"
    for name in names.split():
        monkeypatch.delenv(name, raising=False)
    s = S.Settings()
    assert (s.request_timeout, s.article_timeout, s.request_delay_seconds, s.max_articles_per_feed) == (15, 20, 1.0, 20)
    assert (s.language, s.country, s.edition) == ("en-IN", "IN", "IN:en") and s.base_url.endswith("/rss/search") and s.database_url == s.broker_url == ""
    assert (s.article_queue, s.retry_queue, s.dead_letter_queue) == ("article.processing", "article.processing.retry", "article.processing.dlq")
    monkeypatch.setenv("REQUEST_TIMEOUT", "3")
    monkeypatch.setenv("ARTICLE_QUEUE", "q")
    assert S.Settings().request_timeout == 3 and S.Settings().article_queue == "q" and s.request_timeout == 15
    monkeypatch.setenv("REQUEST_DELAY_SECONDS", "soon")
    with pytest.raises(ValueError):
        S.Settings()


def test_feed_rows(spark):
    rows = [(0, "company_tcs", "company", "tcs", "q", True), (1, "company_tcs", "company", "tcs", "q", True), (2, "x_y", "x", "y", "q", True), (3, "company_y", "company", "y", "q", True), (4, "z", "sector", "it", "q", True), (5, "etf_gold", "etf", "gold", " ", True), (6, "macro_rbi", "macro", "rbi", "q", None)]
    checked = S.validate(spark.createDataFrame(rows, "feed_ord int, feed_id string, feed_type string, feed_value string, query string, enabled boolean"), S.vocabulary(spark))
    assert [r["violation"] for r in checked.orderBy("feed_ord").collect()] == [None, "duplicate", "feed_type", "feed_value", "feed_id", "query", "enabled"]


ITEM = "<item><title> One &amp; two </title><link>https://a/1</link><pubDate>Fri, 05 Sep 2026 10:00:00 GMT</pubDate><source url='http://s'>\n Example News \n</source></item>"


def test_rss(spark):
    docs = [
        f"<?xml version='1.0'?><rss version='2.0'><channel><title>c</title>{ITEM}<item><title> </title></item></channel></rss>",
        "<rss><channel><title>empty</title></channel></rss>",
        "<rss><channel><item>",
        "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A</title><updated>2026-09-05T10:00:00Z</updated><link rel='self' href='https://no'/><link href='https://a/2'/></entry></feed>",
    ]
    payloads = spark.createDataFrame([(f"f{i}", i, bytearray(d, "utf-8")) for i, d in enumerate(docs)], "feed_id string, feed_ord int, content binary")
    rows = [r.asDict() for r in rss.parse(payloads).orderBy("feed_ord", "entry_ord").collect()]
    assert rows[0] == {"feed_id": "f0", "feed_ord": 0, "entry_ord": 0, "rss_title": "One & two", "rss_published": "Fri, 05 Sep 2026 10:00:00 GMT", "rss_source": "Example News", "wrapper_link": "https://a/1"}
    assert rows[1]["entry_ord"] == 1 and rows[1]["rss_title"] is None and rows[1]["rss_source"] is None and rows[1]["wrapper_link"] is None
    assert [(r["feed_id"], r["rss_title"], r["wrapper_link"]) for r in rows[2:]] == [("f3", "A", "https://a/2")]


def test_rss_in_other_forms(spark):
    rdf = "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/'><item><title>R</title><link>https://a/3</link><dc:date>2026-09-05T10:00:00Z</dc:date></item></rdf:RDF>"
    latin = "<?xml version='1.0' encoding='ISO-8859-1'?><rss><channel><item><title>caf\u00e9</title></item></channel></rss>"
    docs = [rdf.encode(), latin.encode("latin-1"), latin.replace("ISO-8859-1", "UTF-16").encode("utf-16"), b"<rss><channel><item><title>a\xffb</title></item></channel></rss>", b"\xff\xfe\x00", b"no feed", None]
    payloads = spark.createDataFrame([(f"f{i}", i, None if d is None else bytearray(d)) for i, d in enumerate(docs)], "feed_id string, feed_ord int, content binary")
    rows = {r["feed_id"]: r for r in rss.parse(payloads).collect()}
    assert rows["f0"]["rss_title"] == "R" and rows["f0"]["rss_published"] == "2026-09-05T10:00:00Z" and rows["f0"]["wrapper_link"] == "https://a/3"
    assert rows["f1"]["rss_title"] == rows["f2"]["rss_title"] == "caf\u00e9" and rows["f3"]["rss_title"].startswith("a") and set(rows) == {"f0", "f1", "f2", "f3"}
    assert {r["feed_id"] for r in rss.quarantined(payloads).collect()} == {"f4", "f5", "f6"}


BROKEN = {
    "<rss><channel><title>c</title><item><title>Q&A &nbsp;&eacute; 1 < 2</title><link>https://a/1?x=1&y=2</link></item></channel></rss>": [("Q&A \u00a0\u00e9 1 < 2", None, None, "https://a/1?x=1&y=2")],
    "<rss><channel><item><title>one<link>https://a/1<item><title>two</title><link>https://a/2</link></channel></rss>": [("one", None, None, "https://a/1"), ("two", None, None, "https://a/2")],
    "<rss><channel><item><title>one</title></item><item><title>two</title><link>https://a/2ha": [("one", None, None, None), ("two", None, None, None)],
    "<rss><channel><item><title>one</title></item><item>": [("one", None, None, None)],
    "<rss><channel><item></channel>": [(None, None, None, None)],
    "<rss><channel><item></b><title><![CDATA[a <b> & c]]></title><!-- <title>no</title> --><pubDate> d </pubDate><source url=x>S</source></item>": [("a <b> & c", "d", "S", None)],
    "<feed><title>f</title><entry><title type=text>A & B</title><updated>u</updated><link rel=self href=no><link href='https://a/2?b&c'/><source><title>S</title></source></entry></feed>": [("A & B", "u", "S", "https://a/2?b&c")],
    "<feed><entry><updated>u</updated><published>p</published><title/><title>later</title></entry><title>not & this</title></feed>": [("later", "p", None, None)],
    "<feed><entry><title>a</title></entry><entry><title>b & c</title></entry><entry><title>d</title></entry></feed>": [("a", None, None, None), ("b & c", None, None, None), ("d", None, None, None)],
    "<rdf:RDF><item><title>R & r</title><dc:date>d</dc:date><dc:source>s</dc:source><link>l</link></item></rdf:RDF>": [("R & r", "d", "s", "l")],
    "<rss><channel><title>empty & open": [],
    "<item><title> </title><link>https://a/1</link><link>https://a/2</link></item> & <item/>": [(None, None, None, "https://a/1"), (None, None, None, None)],
    "<RSS><Channel><Item><Title>up</Title></Item>": [("up", None, None, None)],
}


def test_broken_feeds(spark):
    """Entries that can be recovered from each broken payload; none of these payloads is put away."""
    payloads = spark.createDataFrame([(f"f{i}", i, bytearray(x, "utf-8")) for i, x in enumerate(BROKEN)], "feed_id string, feed_ord int, content binary")
    rows = rss.parse(payloads).orderBy("feed_ord", "entry_ord").collect()
    for i, (payload, wanted) in enumerate(BROKEN.items()):
        got = [r for r in rows if r["feed_ord"] == i]
        assert [(r["rss_title"], r["rss_published"], r["rss_source"], r["wrapper_link"]) for r in got] == wanted, payload
        assert [r["entry_ord"] for r in got] == list(range(len(wanted)))
    assert rss.quarantined(payloads).count() == 0
    # Rows with one id are payloads of their own, and their entries aren't mixed.
    both = payloads.where("feed_ord = 1").union(payloads.where("feed_ord = 1"))
    assert sorted(r["rss_title"] for r in rss.parse(both).collect()) == ["one", "one", "two", "two"]


def test_broken_feeds_as_any_cut(spark):
    """However a feed is cut, what comes before the cut is as it was, and nothing is made up."""
    items = "".join(f"<item><title>T{i} &amp; x</title><link>https://a/{i}</link><source url='u'>S{i}</source></item>" for i in range(3))
    whole = f"<rss><channel><title>c</title>{items}</channel></rss>"
    payloads = spark.createDataFrame([(str(n), n, bytearray(whole[:n], "utf-8")) for n in range(len(whole) + 1)], "feed_id string, feed_ord int, content binary")
    rows = rss.parse(payloads).collect()
    for n in range(len(whole) + 1):
        got = sorted((r for r in rows if r["feed_ord"] == n), key=lambda r: r["entry_ord"])
        done = whole[:n].count("</item>")
        assert done <= len(got) <= done + 1
        for i, r in enumerate(got):
            want = (f"T{i} & x", f"https://a/{i}", f"S{i}")
            assert all(g == w or (g is None and i == done) for g, w in zip((r["rss_title"], r["wrapper_link"], r["rss_source"]), want, strict=True))


def test_paragraphs():
    page = f"<html><head><title> My <b>t</b> </title><meta property='og:image' content='i.png'></head><body><nav><p>{LONG} nav</p></nav><div class='x article-body'><p>{LONG}</p><p>short</p><p>{'x' * 39}</p><p>{'y' * 40}</p></div><footer><p>{LONG}</p></footer></body></html>"
    found = paragraphs_of(page)
    assert found["content"] == f"{LONG}\n\n{'y' * 40}" and found["title"] == "My t" and found["top_image"] == "i.png"


def test_containers_and_nesting():
    assert paragraphs_of(f"<div class='entry-content'><p>{LONG} a</p></div><div itemprop='articleBody'><p>{LONG} b</p></div>")["content"] == f"{LONG} b"
    assert paragraphs_of(f"<article><p>{LONG}<p>{LONG} two</article>")["content"] == f"{LONG} {LONG} two\n\n{LONG} two"
    assert paragraphs_of(f"<form><p>{LONG}</p></form><noscript><p>{LONG}</p></noscript><aside><p>{LONG}</p></aside>") is None
    assert paragraphs_of("") is None and paragraphs_of("<p>" * 3000) is None


def test_extraction(spark):
    rows = [("u1", f"<p>{LONG}</p>", 200, None), ("u2", None, 403, None), ("u3", None, 429, None), ("u4", None, None, "Connection failed"), ("u5", "<p>no</p>", 200, None), ("u6", "", 500, None)]
    pages = spark.createDataFrame(rows, "url string, html string, http_status int, fetch_error string")
    x = extraction()("url", "html", "http_status", "fetch_error")
    got = {r["url"]: r["x"] for r in pages.select("url", x.alias("x")).collect()}
    assert got["u1"]["status"] == "success" and got["u1"]["content"] == LONG and got["u1"]["authors"] == []
    assert "HTTP 403" in got["u2"]["error"] and "HTTP 429" in got["u3"]["error"] and got["u4"]["error"] == "Connection failed"
    assert got["u5"]["status"] == "failed" and got["u5"]["error"] == FAILED and got["u5"]["content"] is None and "500" in got["u6"]["error"]
    plan = pages.select("url", x.alias("x")).where("x.status = 'success'").select("x.title")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_primary_extractor(spark):
    primary = lambda url, html: {"title": "T", "authors": ["A"], "published_at": None, "content": "C", "top_image": None} if url == "u1" else None
    pages = spark.createDataFrame([("u1", ""), ("u2", f"<p>{LONG}</p>")], "url string, html string")
    x = extraction(primary)("url", "html", F.lit(200), F.lit(None).cast("string"))
    assert [(r["x"]["content"], r["x"]["authors"]) for r in pages.select(x.alias("x"), "url").orderBy("url").collect()] == [("C", ["A"]), (LONG, [])]


def test_self_described_pages(spark):
    head = "<meta property='og:title' content='The &amp; title'><meta name='author' content='A. One, B. Two and C. Three'/><meta name='author' content='https://no.example/x'><meta property='article:published_time' content='2026-09-05T10:00:00+05:30'>"
    rows = [("u1", f"<html><head><title>t</title>{head}</head><p>{LONG}</p></html>"), ("u2", f"<title>t</title><meta name=date content='some day'><p>{LONG}</p>"), ("u3", "<p>short</p>"), ("u4", None)]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {r["x"]["url"]: r["x"] for r in pages.select(extraction(self_described)("url", "html", F.lit(200), F.lit(None).cast("string")).alias("x")).collect()}
    assert got["u1"]["title"] == "The & title" and got["u1"]["authors"] == ["A. One", "B. Two", "C. Three"] and got["u1"]["published_at"].isoformat().startswith("2026-09-05T04:30:00")
    assert got["u2"]["title"] == "t" and got["u2"]["authors"] == [] and got["u2"]["published_at"] is None and got["u3"]["error"] == got["u4"]["error"] == FAILED
