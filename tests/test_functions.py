import datetime as dt
import re
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from pressmill.functions import text as X
from pressmill.functions import url as U


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(column(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


GOLDEN = {
    "HTTPS://Example.COM/article/?utm_source=google&utm_medium=news&id=123#section": "https://example.com/article?id=123",
    "https://example.com/article/": "https://example.com/article",
    "https://example.com/article?z=3&a=1&b=2": "https://example.com/article?a=1&b=2&z=3",
    "https://example.com/article?id=123#comments": "https://example.com/article?id=123",
    "http://h": "http://h/",
    "http://h//": "http://h",
    "http://h/a;x=1": "http://h/a",
    "http://h/a;x=1/b;y": "http://h/a;x=1/b",
    "http://h:80/a": "http://h/a",
    "http://h:8080/a": "http://h:8080/a",
    "http://h:0/a": "http://h/a",
    "https://h:443/": "https://h/",
    "ftp://h:21/a;type=i": "ftp://h/a",
    "gopher://h:70/a;b": "gopher://h/a;b",
    "http://h/a?b&=&c=%20+x&&d=1;e=2": "http://h/a?=&b=&c=++x&d=1%3Be%3D2",
    "not a url": "not a url",
    "  http://User:Pa@H/x ": "http://User:Pa@h/x",
    "http://[::1]:81/x": "http://::1:81/x",
    "http://h/a?k=a%zz%20b&UTM_Source=1&utm_id=2": "http://h/a?k=a%25zz+b&utm_id=2",
    "http://h/a?q=~*-_.%E9%C3%A9": None,
    "//h/a?x=1": "//h/a?x=1",
    "http://www.Ünï.de/Päth?x=é": "http://www.ünï.de/Päth?x=%C3%A9",
}


def model(url):
    """The canonical form in terms of the standard library."""
    url = url.strip()
    p = urlparse(url)
    host = (p.hostname or "").lower()
    if not host:
        return url
    port = f":{p.port}" if p.port and (p.scheme, p.port) in {(s, p.port) for s, d in (("http", 80), ("https", 443)) if d != p.port} else ""
    user = p.username or ""
    user += f":{p.password}" if p.password else ""
    path = p.path or "/"
    query = urlencode(sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in U.TRACKING))
    return urlunparse((p.scheme, (f"{user}@" if user else "") + host + port, path if path == "/" else path.rstrip("/"), "", query, ""))


def test_canonical_url(spark):
    got = one(spark, list(GOLDEN), U.canonical_url)
    for url, x in zip(GOLDEN, got, strict=True):
        assert x == model(url), url
        assert GOLDEN[url] in (None, x), url


def test_canonical_url_of_blank_and_malformed(spark):
    assert one(spark, [None, "", "  ", "http://h:99999/", "http://h:x/", "http://[::1/"], U.canonical_url) == [None] * 6
    assert one(spark, ["http://h:99999/", "http://h:1/", None], U.malformed_url) == [True, False, False]


def test_canonical_url_of_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url", U.canonical_url(F.col("url")).alias("x")).collect()
    assert rows and all(r["x"] == model(r["url"]) for r in rows)


def test_space_is_that_of_python(spark):
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    got = one(spark, [f"a{chr(c)}b" for c in points], X.collapse_space)
    wrong = [c for c, x in zip(points, got, strict=True) if x != re.sub(r"\s+", " ", f"a{chr(c)}b")]
    assert not wrong


def test_texts(spark):
    assert one(spark, ["\n  TCS reported\n\t strong   quarterly results. ", " \n", None], X.collapse_space) == ["TCS reported strong quarterly results.", None, None]
    digests = one(spark, ["a", "a", "b", None], X.sha256_hex)
    assert digests[0] == digests[1] != digests[2] and len(digests[0]) == 64 and digests[3] is None
    assert one(spark, ["", " x ", None], lambda c: X.first_filled(c, F.lit("y"))) == ["y", " x ", "y"]


def test_feed_time(spark):
    said = ["Fri, 05 Sep 2026 10:00:00 GMT", "Mon, 01 Sep 2026 10:00:00 GMT", "5 Sep 2026 10:00:00 +0530", "2026-09-05T10:00:00Z", "soon", None]
    at = lambda *x: dt.datetime(2026, 9, *x)
    assert one(spark, said, lambda c: F.date_format(X.feed_time(c), "yyyy-MM-dd HH:mm")) == [f"{x:%Y-%m-%d %H:%M}" if x else None for x in (at(5, 10), at(1, 10), at(5, 4, 30), at(5, 10), None, None)]


@pytest.mark.parametrize(
    "url, token",
    [
        ("https://news.google.com/rss/articles/example_token_123", "example_token_123"),
        ("https://news.google.com/rss/read/x?oc=5", "x"),
        ("https://other.example/rss/articles/y/z", "y"),
        ("https://news.google.com/articles/x", None),
        ("https://example.com/article", None),
        (None, None),
    ],
)
def test_wrappers(spark, url, token):
    assert one(spark, [url], U.wrapper_token) == [token]
    assert one(spark, [url], U.is_wrapper) == [token is not None]


def test_decoded_url(spark):
    bodies = {
        ")]}'\n\n[[\"wrb\", [\"https://publisher.com/a\"], \"http://b\"]]": "https://publisher.com/a",
        '[{"u": "https://x"}]': None,
        '["see https://x"]': None,
        "no json": None,
        '"https:\\/\\/x\\u0026y"': "https://x&y",
        "[" * 5000: None,
    }
    assert one(spark, [*bodies, None], U.decoded_url) == [*bodies.values(), None]


def test_resolved(spark):
    rows = spark.createDataFrame([("https://n/rss/articles/t", "https://p"), ("https://n/rss/articles/t", None), ("https://n/rss/articles/t", ""), ("https://e", "https://p"), ("", None)], "u string, p string")
    assert [r[0] for r in rows.select(U.resolved(F.col("u"), F.col("p"))).collect()] == ["https://p", "https://n/rss/articles/t", "https://n/rss/articles/t", "https://e", ""]


def test_decoding_parameters(spark):
    got = one(spark, ['<a data-n-a-sg="S" data-n-a-ts="9">', '<a data-n-a-sg="S">', None], U.decoding_parameters)
    assert got[0].asDict() == {"signature": "S", "timestamp": "9"} and got[1:] == [None, None]
