"""The queries over the shared tables, and SQL that gives the same rows.

The shared tables stand in for feeds, articles and links; every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..operators import articles as A
from ..operators import merge as M
from ..operators import reads as R
from ..sources import feeds as feed_source
from ..sources import rss
from .ingest import counters, stream_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Time of the runs that the queries stand for.
NOW = "2024-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# SQL for the canonical form of the URLs in pages: http and https, no ports, no user, no ;parameters.
CANONICAL = r"""
  (WITH u AS (SELECT *, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
      regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
  k AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''),
      lambda x: {'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))}),
      lambda p: lower(p.k) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','mc_cid','mc_eid'))) AS pairs FROM u)
  SELECT page_id, url, html, lower(scheme) || '://' || lower(host) || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END
    || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_transform(pairs, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') ELSE '' END AS canonical
  FROM k)"""
SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
COLLAPSED = f"nullif(trim(regexp_replace(text, '{SPACES}', ' ', 'g')), '')"


def keyed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last page of each article key, in page order; html stays out of the exchange."""
    pages = _table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))
    return M.last_per_key(pages.withColumn("article_key", X.sha256_hex(F.col("url"))), ["article_key"], F.col("page_id"))


@query(f"SELECT sha256(canonical) AS article_key, max(page_id) AS page_id, any_value(canonical) AS url FROM {CANONICAL} GROUP BY canonical")
def articles_from_pages(spark, sf_dir):
    return keyed_pages(spark, sf_dir).select("article_key", "page_id", "url")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_pages(spark, sf_dir)


@query(f"SELECT page_id, canonical AS canonical_url FROM {CANONICAL}")
def url_canonical(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"SELECT page_id, sha256(canonical) AS article_key FROM {CANONICAL}")
def article_key(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.sha256_hex(U.canonical_url(F.col("url"))).alias("article_key"))


@query(f"SELECT doc_id, {COLLAPSED} AS text FROM documents")
def text_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.collapse_space(F.col("text")).alias("text"))


@query(f"SELECT content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256({COLLAPSED}) AS content_hash FROM documents) GROUP BY content_hash")
def content_hash(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", X.sha256_hex(X.collapse_space(F.col("text"))).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE strftime(CASE WHEN event_id % 6 = 3 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') END AS published_at FROM events")
def published_time(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    ts, form = F.col("ts"), F.col("event_id") % 6
    # Weekdays are wrong on purpose: they must not matter.
    said = (
        F.when(form == 0, F.concat(F.lit("Fri, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(form == 1, F.concat(F.date_format(ts + F.expr("INTERVAL '05:30' HOUR TO MINUTE"), "d MMM yyyy HH:mm:ss"), F.lit(" +0530")))
        .when(form == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(form == 3, F.concat(F.lit(" Monday, "), F.date_format(ts, "dd MMM yyyy HH:mm"), F.lit(" UT ")))
        .when(form == 4, F.concat(F.date_format(ts - F.expr("INTERVAL '08:00' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-08:00")))
        .otherwise("some time ago")
    )
    return events.select("event_id", F.date_format(X.feed_time(said), "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS naive, strftime(ts - CASE WHEN event_id % 2 = 0 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') AS aware FROM events")
def datetime_normalize(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    local = events["ts"].cast("timestamp_ntz")
    zoned = F.when(F.col("event_id") % 2 == 0, F.convert_timezone(F.lit("Asia/Kolkata"), F.lit("UTC"), local)).otherwise(local)
    return events.select("event_id", *(F.date_format(X.as_utc(c), "yyyy-MM-dd HH:mm:ss").alias(name) for name, c in (("naive", local), ("aware", zoned))))


def _links(pages: DataFrame) -> DataFrame:
    """Even pages are reached through a wrapper."""
    return pages.select("page_id", "url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://news.google.com/rss/articles/T"), F.col("page_id"), F.lit("?oc=5"))).otherwise(F.col("url")).alias("link"))


@query("SELECT page_id, page_id % 2 = 0 AS is_wrapper, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id END AS token FROM pages")
def wrapper_token(spark, sf_dir):
    return _links(_table(spark, sf_dir, "pages")).select("page_id", U.is_wrapper(F.col("link")).alias("is_wrapper"), U.wrapper_token(F.col("link")).alias("token"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 4 <> 0 THEN 'https://news.google.com/rss/articles/T' || page_id || '?oc=5' ELSE url END AS article_url FROM pages")
def resolve_fallback(spark, sf_dir):
    links = _links(_table(spark, sf_dir, "pages"))
    # Every second wrapper resolves.
    publishers = links.where("page_id % 4 = 0").select(F.col("link").alias("wrapper_url"), F.col("url").alias("publisher_url"))
    return A.resolve(links.withColumnRenamed("link", "wrapper_link"), publishers).select("page_id", "article_url")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS decoded FROM pages")
def decode_response(spark, sf_dir):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(")]}'\n"), F.to_json(F.array(F.array(F.lit("wrb.fr"), F.col("url"), F.lit("http://later"))))))
    body = body.when(F.col("page_id") % 3 == 1, F.concat(F.lit(")]}'\n["), F.to_json(F.struct("url")), F.lit("]"))).otherwise("no json")
    return _table(spark, sf_dir, "pages").select("page_id", U.decoded_url(body).alias("decoded"))


@query(
    "SELECT page_id, nullif(regexp_extract(html, 'charset=\"([^\"]+)\"', 1), '') AS signature, CAST(page_id AS VARCHAR) AS timestamp FROM pages WHERE page_id % 2 = 0"
)
def decoding_parameters(spark, sf_dir):
    charset = F.regexp_extract("html", 'charset="([^"]+)"', 1)
    page = F.concat(F.lit('<c-wiz data-n-a-sg="'), charset, F.lit('" '), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('data-n-a-ts="'), F.col("page_id"), F.lit('"'))).otherwise(""), F.lit(">"))
    found = _table(spark, sf_dir, "pages").select("page_id", U.decoding_parameters(page).alias("p")).where("p is not null")
    return found.select("page_id", "p.signature", "p.timestamp")


@query("SELECT doc_id, 'https://news.google.com/rss/search?q=' || replace(url_encode(text), '%20', '+') || '&hl=en-IN&gl=IN&ceid=IN%3Aen' AS feed_url FROM documents")
def rss_build_url(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"))
    return feed_source.with_url(docs, feed_source.Settings()).select("doc_id", "feed_url")


@query(f"""
  SELECT 'feed' || doc_id AS feed_id, n AS entry_ord, nullif(regexp_replace(CASE WHEN n = 0 THEN text ELSE lang END, '^{SPACES}|{SPACES}$', '', 'g'), '') AS rss_title,
    CASE WHEN n = 0 THEN 'Fri, 05 Sep 2026 10:00:00 GMT' END AS rss_published, CASE WHEN n = 0 THEN source END AS rss_source, 'https://a.example/' || doc_id || '/' || n AS wrapper_link
  FROM documents, (VALUES (0), (1)) AS v(n)""")
def rss_parse(spark, sf_dir):
    def escaped(c):
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def item(n: int):
        more = F.concat(F.lit("<pubDate>Fri, 05 Sep 2026 10:00:00 GMT</pubDate><source url='http://s.example'> "), escaped(F.col("source")), F.lit("\n</source>")) if n == 0 else F.lit("")
        title = F.concat(F.lit("<title>"), escaped(F.col("lang" if n else "text")), F.lit("</title>"))
        return F.concat(F.lit("<item>"), title, F.lit("<link>https://a.example/"), F.col("doc_id").cast("string"), F.lit(f"/{n}</link>"), more, F.lit("</item>"))

    content = F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>c</title>"), item(0), item(1), F.lit("</channel></rss>"))
    payloads = _table(spark, sf_dir, "documents").select(F.concat(F.lit("feed"), F.col("doc_id")).alias("feed_id"), F.lit(0).alias("feed_ord"), F.encode(content, "UTF-8").alias("content"))
    return rss.parse(payloads).drop("feed_ord")


@query(f"""
  WITH d AS (SELECT doc_id, doc_id % 6 AS form, nullif(regexp_replace(text, '^{SPACES}|{SPACES}$', '', 'g'), '') AS text, lang, source FROM documents),
  s AS (SELECT doc_id, form, n, 'https://a.example/' || doc_id || '/' || n || '?a=1&b=2' AS link, text, lang, source FROM d, (VALUES (0), (1)) AS v(n))
  SELECT 'feed' || doc_id AS feed_id, n AS entry_ord, CASE n WHEN 0 THEN CASE form WHEN 0 THEN 'R&D ' || chr(233) || ' ' || coalesce(text, '') ELSE text END ELSE lang END AS rss_title,
    CASE WHEN n = 0 THEN 'Fri, 05 Sep 2026 10:00:00 GMT' END AS rss_published, CASE WHEN n = 0 THEN source END AS rss_source, CASE WHEN n = 1 AND form = 3 THEN NULL ELSE link END AS wrapper_link
  FROM s WHERE form <> 5""")
def rss_recover(spark, sf_dir):
    """A feed of every document, broken in one of five ways by its id; every sixth is no feed."""
    docs = _table(spark, sf_dir, "documents")
    form, ident = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    raw = F.concat(F.lit("<![CDATA["), F.replace("text", F.lit("]]>"), F.lit("]]&gt;")), F.lit("]]>"))
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.when(form == 0, F.concat(F.lit("R&D &eacute; "), escaped)).when(form == 4, raw).otherwise(escaped)
    link = [F.concat(F.lit("https://a.example/"), ident, F.lit(f"/{n}?a=1&b=2")) for n in (0, 1)]
    date, source = F.lit("<pubDate>Fri, 05 Sep 2026 10:00:00 GMT</pubDate>"), F.concat(F.lit("<source url=http://s.example> "), F.col("source"), F.lit("\n</source>"))
    # 1: tags that don't match; 2: items and titles that aren't closed; 3: a cut end.
    ends = F.when(form == 1, "</b></TITLE>").when(form == 2, "").otherwise("</title>")
    first = F.concat(F.lit("<item><title>"), title, ends, F.lit("<link>"), link[0], F.lit("</link>"), date, source, F.when(form == 2, "").otherwise("</item>"))
    second = F.concat(F.lit("<item><title>"), F.col("lang"), ends, F.lit("<link>"), link[1])
    payload = F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>of all</title>"), first, second, F.when(form == 3, "").otherwise("</link></item></channel></rss>"))
    content = F.when(form == 5, F.col("text")).otherwise(payload)
    return rss.parse(docs.select(F.concat(F.lit("feed"), ident).alias("feed_id"), F.lit(0).alias("feed_ord"), F.encode(content, "UTF-8").alias("content"))).drop("feed_ord")


@query("""SELECT page_id, CASE WHEN page_id % 3 > 0 THEN '[["Fbv4je","[[\\"T' || page_id || '\\",\\"s' || page_id || '\\",\\"' || page_id * 7 || '\\"]]",null,"generic"]]' END AS form FROM pages""")
def decoding_form(spark, sf_dir):
    page = F.col("page_id").cast("string")
    form = U.decoding_request(F.concat(F.lit("T"), page), F.concat(F.lit("s"), page), F.when(F.col("page_id") % 3 > 0, (F.col("page_id") * 7).cast("string")))
    return _table(spark, sf_dir, "pages").select("page_id", form.alias("form"))


def unescaped(c: str) -> str:
    """SQL for the character references that the pages hold."""
    return f"replace(replace(regexp_replace({c}, '&amp;?', '&', 'g'), '&quot;', chr(34)), '&lt;', '<')"


# SQL for the paragraphs of the articles in pages. A paragraph ends with its own end tag, or with the article.
EXTRACTED = rf"""
  (WITH a AS (SELECT page_id, url, html, regexp_extract_all(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>|[^<]+') AS parts FROM pages),
  d AS (SELECT page_id, i, parts[i] AS t, sum(CASE parts[i] WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM a, unnest(range(1, len(parts) + 1)) AS u(i)),
  p AS (SELECT o.page_id, o.i AS lo, min(c.i) AS hi FROM d o LEFT JOIN d c ON c.page_id = o.page_id AND c.i > o.i AND c.t = '</p>' AND c.depth < o.depth WHERE o.t = '<p>' GROUP BY ALL),
  s AS (SELECT page_id, i, regexp_replace({unescaped("t")}, '^{SPACES}|{SPACES}$', '', 'g') AS t FROM d WHERE NOT starts_with(t, '<')),
  x AS (SELECT p.page_id, lo, string_agg(t, ' ' ORDER BY i) AS text FROM p JOIN s ON s.page_id = p.page_id AND i > lo AND (hi IS NULL OR i < hi) WHERE t <> '' GROUP BY p.page_id, lo),
  c AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY lo) AS content FROM x WHERE length(text) >= 40 GROUP BY page_id)
  SELECT a.page_id, url, html, page_id % 10 = 9 AS refused, CASE WHEN page_id % 10 <> 9 THEN content END AS content,
    CASE WHEN page_id % 10 <> 9 AND content IS NOT NULL THEN regexp_replace({unescaped("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, '^{SPACES}|{SPACES}$', '', 'g') END AS title
  FROM a LEFT JOIN c USING (page_id))"""


@query(f"""
  SELECT page_id, title, content, NULL::VARCHAR AS top_image, CASE WHEN content IS NULL THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN refused THEN 'Publisher returned HTTP 403.' WHEN content IS NULL THEN 'Article content extraction failed.' END AS error FROM {EXTRACTED}""")
def html_extract(spark, sf_dir):
    from ..functions.html import extraction

    pages = _table(spark, sf_dir, "pages")
    x = extraction()("url", "html", F.when(F.col("page_id") % 10 == 9, 403).otherwise(200), F.lit(None).cast("string"))
    return pages.select("page_id", x.alias("x")).select("page_id", "x.title", "x.content", "x.top_image", "x.status", "x.error")


# SQL for the scored blocks of the advert and of the article of each page, which are containers side by side.
SCORED = rf"""
  (WITH a AS (SELECT page_id, 0 AS container, regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS held FROM pages UNION ALL
    SELECT page_id, 1, regexp_extract(html, '<article>(.*?)</article>', 1, 's') FROM pages),
  b AS (SELECT page_id, container, i, nullif(trim(regexp_replace({unescaped("regexp_replace(replace(parts[i], '<br>', ' '), '<[^>]*>', '', 'g')")}, '{SPACES}', ' ', 'g')), '') AS text
    FROM (SELECT page_id, container, string_split_regex(regexp_replace(held, '<h1>.*?</h1>', '<p>', 'gs'), '</?p>') AS parts FROM a), unnest(range(1, len(parts) + 1)) AS u(i))
  SELECT page_id, container, sum(1 + length(text) - length(replace(text, ',', '')) + least(length(text) // 100, 3)) AS score, string_agg(text, chr(10) || chr(10) ORDER BY i) AS content
  FROM b WHERE length(text) >= 25 GROUP BY page_id, container)"""


@query(f"""
  WITH s AS (SELECT page_id, coalesce(max(score) FILTER (container = 0), 0) AS ad, coalesce(max(score) FILTER (container = 1), 0) AS article,
    max(content) FILTER (container = 0) AS ad_text, max(content) FILTER (container = 1) AS text FROM {SCORED} GROUP BY page_id)
  SELECT page_id, nullif(trim(regexp_replace({unescaped("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, '{SPACES}', ' ', 'g')), '') AS title,
    CASE WHEN article > ad THEN text WHEN ad > article THEN ad_text ELSE ad_text || chr(10) || chr(10) || text END AS content FROM s JOIN pages USING (page_id)""")
def primary_extract(spark, sf_dir):
    """Pages without article tags and class names, so that scores alone choose between the advert and the article."""
    from ..operators.content import primary

    bare = F.regexp_replace(F.regexp_replace("html", "(</?)article>", "$1div>"), ' class="[^"]*"', "")
    return primary(_table(spark, sf_dir, "pages").select("page_id", bare.alias("html")), "page_id").select("page_id", "title", "content")


#: Pages that one feed of the registered runs names.
FEED_PAGES = 50


def _run(spark, sf_dir):
    """A run over pages as feeds of FEED_PAGES entries, half of them through wrappers: the store, the queues and the counters."""
    from .ingest import ingest
    from .sinks import QueueSink
    from .store import SnapshotStore
    from .work import work_folder

    pages = _table(spark, sf_dir, "pages")
    links = _links(pages)
    item = F.concat(F.lit("<item><title>Page "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("link", F.lit("&"), F.lit("&amp;")), F.lit("</link></item>"))
    feeds = links.select((F.col("page_id") / FEED_PAGES).cast("int").alias("feed_ord"), F.struct("page_id", item.alias("item")).alias("x")).groupBy("feed_ord").agg(F.array_sort(F.collect_list("x")).alias("x"))
    payloads = feeds.select(F.concat(F.lit("feed"), F.col("feed_ord")).alias("feed_id"), "feed_ord", F.encode(F.concat(F.lit("<rss><channel>"), F.array_join("x.item", ""), F.lit("</channel></rss>")), "UTF-8").alias("content"))
    publishers = links.where("page_id % 2 = 0").select(F.col("link").alias("wrapper_url"), F.col("url").alias("publisher_url"))
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    fetched = first.select("url", "html", F.when(F.col("page_id") % 10 == 9, 403).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("fetch_error"))
    folder = work_folder(spark)
    store, sink = SnapshotStore(spark, f"{folder}/store", buckets=4), QueueSink(spark, f"{folder}/queues")
    store.initialise()
    sink.declare()
    sink.declare()
    counts = ingest(spark, store, payloads, publishers, fetched, feeds.count(), F.lit(NOW).cast("timestamp"), sink)
    return store, sink, counts


RUN = f"""
  (WITH e AS (SELECT * FROM {EXTRACTED}), f AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url),
  s AS (SELECT p.page_id, p.page_id // {FEED_PAGES} AS feed_ord, sha256(k.canonical) AS article_key, coalesce(nullif(e.title, ''), 'Page ' || p.page_id) AS title, e.content
    FROM pages p JOIN {CANONICAL} k USING (page_id) JOIN f ON f.url = p.url JOIN e ON e.page_id = f.page_id)
  SELECT * FROM s)"""


@query(f"""
  SELECT article_key, nullif(trim(regexp_replace(max_by(title, page_id), '{SPACES}', ' ', 'g')), '') AS title, sha256(nullif(trim(regexp_replace(max_by(content, page_id), '{SPACES}', ' ', 'g')), '')) AS content_hash,
    'pending' AS processing_status, count(DISTINCT feed_ord) AS n_feeds FROM {RUN} WHERE content IS NOT NULL GROUP BY article_key""")
def ingest_run(spark, sf_dir):
    store, _, _ = _run(spark, sf_dir)
    feeds = store.read("article_feeds").groupBy("article_key").agg(F.count("*").alias("n_feeds"))
    return store.read("articles").join(feeds, "article_key").select("article_key", "title", "content_hash", "processing_status", "n_feeds")


@query(f"""SELECT DISTINCT '{{"article_key":"' || article_key || '"}}' AS message FROM {RUN} WHERE content IS NOT NULL""")
def ingest_messages(spark, sf_dir):
    _, sink, _ = _run(spark, sf_dir)
    return spark.read.text(f"{sink.address}/{sink.queues[0]}").select(F.col("value").alias("message"))


@query(f"""
  WITH r AS (SELECT count(*) AS entries, count(content) AS good, count(DISTINCT CASE WHEN content IS NOT NULL THEN article_key END) AS fresh, count(DISTINCT feed_ord) AS feeds FROM {RUN})
  SELECT unnest(['Feeds processed: ' || feeds, 'Rss entries: ' || entries, 'Articles discovered: ' || good, 'Articles inserted: ' || fresh,
    'Articles updated: ' || (good - fresh), 'Articles failed: ' || (entries - good), 'Messages published: ' || fresh]) AS line FROM r""")
def ingest_report(spark, sf_dir):
    from .sinks import report

    _, _, counts = _run(spark, sf_dir)
    return spark.createDataFrame([(x,) for x in report(counts).splitlines()], "line string")


@query("SELECT unnest(['article.processing', 'article.processing.dlq', 'article.processing.retry']) AS queue")
def queue_topology(spark, sf_dir):
    from .sinks import QueueSink
    from .work import work_folder

    sink = QueueSink(spark, work_folder(spark))
    for _ in range(2):
        sink.declare()
    folder = spark._jvm.org.apache.hadoop.fs.Path(sink.address)
    found = [x.getPath().getName() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return spark.createDataFrame([(x,) for x in found], "queue string")


@query("""
  SELECT doc_id, coalesce(nullif(CASE WHEN quality = 1 THEN text END, ''), source) AS title, lang AS source
  FROM documents LEFT JOIN labels USING (doc_id)""")
def field_precedence(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    null = F.lit(None).cast("string")
    fields = A.precedence(F.when(F.col("quality") == 1, F.col("text")), F.col("source"), null, F.col("lang"), null.cast("timestamp"), null)
    return rows.select("doc_id", fields["title"].alias("title"), fields["source"].alias("source"))


PAIRS = [(k, v) for k, vs in feed_source.ALLOWED.items() for v in vs]
PAIRS_SQL = f"(SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(PAIRS))}) AS v(n, feed_type, feed_value))"


@query(f"SELECT feed_type, feed_value FROM {PAIRS_SQL}")
def feed_vocabulary(spark, sf_dir):
    return feed_source.vocabulary(spark)


def _registry(spark, sf_dir):
    """A feed for each allowed pair, with a nation as its query, from a file of YAML."""
    import tempfile
    from pathlib import Path

    import yaml

    nations = _table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(len(PAIRS)).collect()
    feeds = [{"feed_id": f"{k}_{v}", "feed_type": k, "feed_value": v, "query": n["n_name"], "enabled": n["n_regionkey"] % 2 == 0} for (k, v), n in zip(PAIRS, nations, strict=True)]
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "feeds.yaml"
        path.write_text(yaml.safe_dump({"other": {"language": "x"}, "feeds": feeds}))
        return feed_source.FeedRegistry.from_yaml(path)


CONFIGURED = f"(SELECT n AS feed_ord, feed_type || '_' || feed_value AS feed_id, feed_type, feed_value, n_name AS query, n_regionkey % 2 = 0 AS enabled FROM {PAIRS_SQL} JOIN nation ON n_nationkey = n)"


@query(f"SELECT feed_ord::INTEGER AS feed_ord, feed_id, feed_type, feed_value, query, enabled FROM {CONFIGURED}")
def feed_config(spark, sf_dir):
    return _registry(spark, sf_dir).frame(spark)


@query(f"SELECT feed_id, feed_type, feed_value, query, enabled, 25 AS n_synced FROM {CONFIGURED}")
def feed_sync(spark, sf_dir):
    from .ingest import sync_feeds
    from .store import SnapshotStore
    from .work import work_folder

    store = SnapshotStore(spark, work_folder(spark))
    store.initialise()
    synced = [sync_feeds(store, _registry(spark, sf_dir), F.lit(NOW).cast("timestamp")) for _ in range(2)]
    return store.read("feeds").select("feed_id", "feed_type", "feed_value", "query", "enabled", F.lit(synced[-1]).alias("n_synced"))


@query(f"""
  SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'entry has no link' WHEN page_id % 5 = 0 THEN 'HTTP 500' END AS failure,
    canonical AS url, sha256(canonical) AS article_key FROM {CANONICAL}""")
def reject_entries(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    link = F.when(F.col("page_id") % 7 == 0, " \t").otherwise(F.col("url"))
    failed = F.col("page_id") % 5 == 0
    out = A.normalised(F.col("url"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    failure = A.rejection(link, F.when(failed, "failed").otherwise("success"), F.when(failed, "HTTP 500"), out["article_key"])
    return pages.select("page_id", failure.alias("failure"), out["url"].alias("url"), out["article_key"].alias("article_key"))


@query("""
  SELECT p_partkey, CASE WHEN p_type NOT IN (SELECT p_type FROM part WHERE p_partkey % 50 = 0) THEN 'feed_type'
      WHEN (p_type, p_brand) NOT IN (SELECT (p_type, p_brand) FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 3 = 0) THEN 'feed_value'
      WHEN p_partkey > min(p_partkey) OVER (PARTITION BY p_type, p_brand) THEN 'duplicate' WHEN p_size < 10 THEN 'query' END AS violation
  FROM part""")
def feed_validate(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    allowed = part.where("p_partkey % 50 = 0 or p_partkey % 3 = 0").join(F.broadcast(part.where("p_partkey % 50 = 0").select("p_type").distinct()), "p_type", "left_semi")
    feeds = part.select(
        F.col("p_partkey").alias("feed_ord"), F.concat_ws("_", "p_type", "p_brand").alias("feed_id"), F.col("p_type").alias("feed_type"), F.col("p_brand").alias("feed_value"),
        F.when(F.col("p_size") < 10, "  ").otherwise(F.col("p_name")).alias("query"), F.lit(True).alias("enabled"),
    )
    checked = feed_source.validate(feeds, allowed.select(F.col("p_type").alias("feed_type"), F.col("p_brand").alias("feed_value")))
    return checked.select(F.col("feed_ord").alias("p_partkey"), "violation")


def _customers(spark, sf_dir):
    """Customers as feeds: those with money are enabled."""
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("c_"), F.col("c_custkey")).alias("feed_id"), F.lower("c_mktsegment").alias("feed_type"), F.col("c_name").alias("query"), (F.col("c_acctbal") > 0).alias("enabled"))


CUSTOMERS = "(SELECT 'c_' || c_custkey AS feed_id, lower(c_mktsegment) AS feed_type, c_name AS query, c_acctbal > 0 AS enabled FROM customer)"


@query(f"SELECT * FROM {CUSTOMERS} ORDER BY feed_id")
def feed_all(spark, sf_dir):
    return R.all_feeds(_customers(spark, sf_dir))


@query(f"SELECT * FROM {CUSTOMERS} WHERE enabled ORDER BY feed_id")
def feed_enabled(spark, sf_dir):
    return R.enabled_feeds(_customers(spark, sf_dir))


@query(f"SELECT * FROM {CUSTOMERS} WHERE feed_id = 'c_7'")
def feed_get(spark, sf_dir):
    return R.feed_by_id(_customers(spark, sf_dir), "c_7")


@query(f"SELECT count(*) AS n_feeds FROM {CONFIGURED}")
def feed_count(spark, sf_dir):
    return spark.createDataFrame([(_registry(spark, sf_dir).count(),)], "n_feeds long")


@query(f"""
  SELECT coalesce(n.feed_id, o.feed_id) AS feed_id, CASE WHEN n.feed_id IS NULL THEN 'old' ELSE 'supplier' END AS feed_type,
    CASE WHEN n.feed_id IS NULL THEN 'v' ELSE n.s_name END AS feed_value, CASE WHEN n.feed_id IS NULL THEN 'q' ELSE n.s_name END AS query,
    CASE WHEN n.feed_id IS NULL THEN true ELSE n.s_acctbal > 0 END AS enabled, coalesce(o.created_at, TIMESTAMP '{NOW}') AS created_at
  FROM (SELECT 's_' || s_suppkey AS feed_id, * FROM supplier WHERE s_suppkey % 2 = 0) n
  FULL JOIN (SELECT 's_' || s_suppkey AS feed_id, TIMESTAMP '2020-01-01' AS created_at FROM supplier WHERE s_suppkey % 3 = 0) o ON n.feed_id = o.feed_id""")
def feed_upsert(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").withColumn("feed_id", F.concat(F.lit("s_"), F.col("s_suppkey")))
    old = s.where("s_suppkey % 3 = 0").select("feed_id", F.lit("old").alias("feed_type"), F.lit("v").alias("feed_value"), F.lit("q").alias("query"), F.lit(True).alias("enabled"), F.lit("2020-01-01").cast("timestamp_ntz").alias("created_at"))
    new = s.where("s_suppkey % 2 = 0").select("feed_id", F.lit("supplier").alias("feed_type"), F.col("s_name").alias("feed_value"), F.col("s_name").alias("query"), (F.col("s_acctbal") > 0).alias("enabled"))
    return M.upsert_feeds(old, new, now())


def _sightings(spark, sf_dir):
    """Documents as sightings of 300 articles, in the order of their ids; and the articles stored before."""
    docs = _table(spark, sf_dir, "documents")
    time = F.lit("2020-01-01").cast("timestamp_ntz")
    fields = (F.concat(F.lit("k"), F.col("doc_id") % 300).alias("article_key"), F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("title"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.col("source"), F.array("source").alias("authors"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.sha2("text", 256).alias("content"), F.lit(None).cast("string").alias("content_hash"))
    new = docs.where("doc_id >= 100").select(*fields, "doc_id")
    old = docs.where("doc_id < 100").select(*fields, F.when(F.col("doc_id") % 2 == 0, F.lit("s")).alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.lit("summarized")).otherwise("pending").alias("processing_status"), time.alias("created_at"), time.alias("updated_at"))
    return new, old


SEEN = "(SELECT 'k' || doc_id % 300 AS article_key, CASE WHEN doc_id % 11 <> 0 THEN lang END AS title, 'u' || doc_id AS url, source, sha256(text) AS content, doc_id FROM documents)"


@query(f"""
  WITH n AS (SELECT article_key, max_by({{'title': title, 'url': url, 'source': source, 'content': content}}, doc_id) AS x FROM {SEEN} WHERE doc_id >= 100 GROUP BY article_key),
  o AS (SELECT * FROM {SEEN} WHERE doc_id < 100)
  SELECT coalesce(n.article_key, o.article_key) AS article_key, CASE WHEN n.x IS NULL THEN o.title ELSE n.x.title END AS title,
    CASE WHEN n.x IS NULL THEN o.url ELSE n.x.url END AS url, CASE WHEN n.x IS NULL THEN o.source ELSE n.x.source END AS author, CASE WHEN n.x IS NULL THEN o.content ELSE n.x.content END AS content,
    CASE WHEN o.doc_id % 2 = 0 THEN 's' END AS summary, CASE WHEN o.doc_id % 2 = 0 THEN 'summarized' ELSE 'pending' END AS processing_status,
    CASE WHEN o.doc_id IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2020-01-01' END AS created_at, CASE WHEN n.x IS NULL THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '{NOW}' END AS updated_at
  FROM n FULL JOIN o ON n.article_key = o.article_key""")
def article_upsert(spark, sf_dir):
    new, old = _sightings(spark, sf_dir)
    out = M.upsert_articles(old.drop("doc_id"), M.last_per_key(new, ["article_key"], F.col("doc_id")), now())
    return out.select("article_key", "title", "url", F.element_at("authors", 1).alias("author"), "content", "summary", "processing_status", "created_at", "updated_at")


@query(f"""SELECT article_key, '{{"article_key":"' || article_key || '"}}' AS message FROM (SELECT DISTINCT article_key FROM {SEEN} WHERE doc_id >= 100 AND article_key NOT IN (SELECT article_key FROM {SEEN} WHERE doc_id < 100))""")
def publish_new(spark, sf_dir):
    new, old = _sightings(spark, sf_dir)
    return M.messages(M.new_keys(new, old))


@query(f"SELECT doc_id, article_key, article_key IN (SELECT article_key FROM {SEEN} WHERE doc_id < 100) AS is_known FROM {SEEN} WHERE doc_id >= 100")
def article_exists(spark, sf_dir):
    new, old = _sightings(spark, sf_dir)
    return M.with_existing(new, old).select("doc_id", "article_key", "is_known")


def _event_links(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("article_key"), F.col("event_type").alias("feed_id"), F.col("ts").alias("first_seen_at"), "event_id")


EVENT_LINKS = "(SELECT 'u' || user_id AS article_key, event_type AS feed_id, ts AS first_seen_at, event_id FROM events)"


@query(f"""
  WITH o AS (SELECT article_key, feed_id, max(first_seen_at) AS first_seen_at FROM {EVENT_LINKS} WHERE event_id % 10 = 0 GROUP BY ALL),
  n AS (SELECT article_key, feed_id, min(first_seen_at) AS first_seen_at FROM {EVENT_LINKS} WHERE event_id % 10 <> 0 GROUP BY ALL)
  SELECT * FROM o UNION ALL SELECT * FROM n WHERE (article_key, feed_id) NOT IN (SELECT (article_key, feed_id) FROM o)""")
def link_insert_ignore(spark, sf_dir):
    links = _event_links(spark, sf_dir)
    old = links.where("event_id % 10 = 0").groupBy("article_key", "feed_id").agg(F.max("first_seen_at").alias("first_seen_at"))
    return M.add_links(old, links.where("event_id % 10 <> 0").drop("event_id"))


@query("""
  WITH e AS (SELECT *, 'u' || user_id AS k, event_type <> 'error' AS good FROM events), o AS (SELECT DISTINCT k FROM e WHERE event_id % 10 = 0), n AS (SELECT count(DISTINCT k) AS c FROM e WHERE good AND k NOT IN (SELECT k FROM o))
  SELECT 5::BIGINT AS feeds_processed, count(*)::BIGINT AS rss_entries, count(*) FILTER (good)::BIGINT AS articles_discovered, any_value(c)::BIGINT AS articles_inserted,
    (count(*) FILTER (good) - any_value(c))::BIGINT AS articles_updated, count(*) FILTER (NOT good)::BIGINT AS articles_failed, any_value(c)::BIGINT AS messages_published FROM e, n""")
def ingest_stats(spark, sf_dir):
    events = _event_links(spark, sf_dir)
    staged = events.withColumn("failure", F.when(F.col("feed_id") == "error", "failed"))
    return counters(staged, 5, events.where("event_id % 10 = 0").select("article_key").distinct())


def _orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("article_key"), F.lit(None).cast("string").alias("summary"), F.col("o_orderstatus").alias("processing_status"), F.col("o_orderdate").alias("updated_at"))


@query(f"""
  SELECT 'o' || o_orderkey AS article_key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS summary, CASE WHEN o_orderkey % 3 = 0 THEN 'summarized' ELSE o_orderstatus END AS processing_status,
    CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE o_orderdate END AS updated_at FROM orders""")
def update_summary(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("article_key"), F.col("o_orderpriority").alias("summary"))
    unknown = spark.createDataFrame([("nobody", "s")], orders.schema)
    return M.update_summary(_orders(spark, sf_dir), orders.unionAll(unknown), now())


@query(f"""
  SELECT 'o' || o_orderkey AS article_key, NULL::VARCHAR AS summary, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE o_orderstatus END AS processing_status,
    CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE o_orderdate END AS updated_at FROM orders""")
def update_status(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("article_key"), F.lit("failed").alias("processing_status"))
    return M.update_status(_orders(spark, sf_dir), orders, now())


def _event_articles(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id")).alias("article_key"), F.col("props").alias("content"), F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type")).alias("processing_status"), F.col("ts").alias("created_at"))


EVENT_ARTICLES = "(SELECT 'e' || event_id AS article_key, props AS content, CASE WHEN event_type = 'view' THEN 'pending' ELSE event_type END AS processing_status, ts AS created_at FROM events)"


@query(f"SELECT * FROM {EVENT_ARTICLES} WHERE article_key = 'e42'")
def article_get(spark, sf_dir):
    return R.article_by_key(_event_articles(spark, sf_dir), "e42")


@query(f"SELECT * FROM {EVENT_ARTICLES} WHERE processing_status = 'pending' ORDER BY created_at, article_key LIMIT 100")
def pending_topk(spark, sf_dir):
    return R.pending_articles(_event_articles(spark, sf_dir))


@query(f"SELECT article_key, array_to_string(list_sort(list(DISTINCT feed_id)), ',') AS feed_ids FROM {EVENT_LINKS} GROUP BY article_key")
def article_feeds(spark, sf_dir):
    return R.feeds_of_articles(_event_links(spark, sf_dir)).select("article_key", F.array_join("feed_ids", ",").alias("feed_ids"))


@query(f"SELECT DISTINCT feed_id FROM {EVENT_LINKS} WHERE article_key = 'u3' ORDER BY feed_id")
def feeds_of_article(spark, sf_dir):
    return R.feeds_of_article(_event_links(spark, sf_dir).select("article_key", "feed_id").distinct(), "u3")


@query(f"SELECT 'u' || c_custkey AS article_key, 'click' AS feed_id FROM customer WHERE ('u' || c_custkey, 'click') IN (SELECT (article_key, feed_id) FROM {EVENT_LINKS})")
def link_exists(spark, sf_dir):
    asked = _table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("article_key"), F.lit("click").alias("feed_id"))
    return R.existing_links(asked, _event_links(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def fk_validate(spark, sf_dir):
    links = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_key"), F.col("l_suppkey").alias("feed_id"), "l_linenumber")
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("article_key"))
    suppliers = _table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("feed_id"))
    return M.valid_links(links, orders, suppliers).select(F.col("article_key").alias("l_orderkey"), "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cascade_delete(spark, sf_dir):
    links = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_key"), "l_linenumber")
    deleted = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("article_key"))
    return M.cascade_delete(links, deleted, "article_key").select(F.col("article_key").alias("l_orderkey"), "l_linenumber")


@query(f"""
  SELECT 'k' || doc_id % 300 AS article_key, max(doc_id) AS last_doc, count(*) AS sightings, max_by(lang, doc_id) AS lang FROM documents GROUP BY ALL""")
def ordered_fold(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.concat(F.lit("k"), F.col("doc_id") % 300).alias("article_key"), (F.col("doc_id") / 300).cast("int").alias("feed_ord"), (F.col("doc_id") % 300).cast("int").alias("entry_ord"), F.col("doc_id"), "lang")
    last = M.last_per_key(rows, ["article_key"], stream_order())
    seen = rows.groupBy("article_key").agg(F.count("*").alias("sightings"))
    return last.join(seen, "article_key").select("article_key", F.col("doc_id").alias("last_doc"), "sightings", "lang")


@query("""
  SELECT 'k' || doc_id % 300 AS article_key, max(doc_id) AS last_doc, max_by({'title': lang}, doc_id).title AS title, count(DISTINCT source) AS n_feeds, 1::BIGINT AS n_new FROM documents GROUP BY ALL""")
def stream_sightings(spark, sf_dir):
    """Documents as a stream of sightings, with state: the order is that of their ids, whatever the order of arrival."""
    from ..streaming import sightings as S
    from .work import work_folder

    docs, folder = _table(spark, sf_dir, "documents"), work_folder(spark)
    # A pattern, as streams take no single file by its name.
    arriving = spark.readStream.schema(docs.schema).parquet(f"{sf_dir.rstrip('/')}/documents.parque[t]")
    entries = arriving.select(F.concat(F.lit("k"), F.col("doc_id") % 300).alias("article_key"), F.col("source").alias("feed_id"), F.col("doc_id").alias("sighted"), F.col("lang").alias("title"))
    S.start(entries, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    seen = S.links(spark, f"{folder}/log").groupBy("article_key").agg(F.count("*").alias("n_feeds"))
    new = S.new_messages(spark, f"{folder}/log").groupBy("article_key").agg(F.count("*").alias("n_new"))
    last = S.latest(spark, f"{folder}/log").select("article_key", F.col("sighted").alias("last_doc"), "title")
    return last.join(new, "article_key").join(seen, "article_key", "left").withColumn("n_feeds", F.coalesce("n_feeds", F.lit(0)))


@query(ORACLE_SQL["article_upsert"])
def bucketed_upsert(spark, sf_dir):
    """The upsert of articles through a bucketed table of the catalog."""
    from uuid import uuid4

    from .bucketed import BucketedTable
    from .work import work_folder

    new, old = _sightings(spark, sf_dir)
    table = BucketedTable(spark, f"articles_{uuid4().hex}", "article_key", work_folder(spark))
    table.create(old.drop("doc_id").schema)
    table.merge(old.drop("doc_id"), lambda stored, rows: rows)
    table.merge(M.last_per_key(new, ["article_key"], F.col("doc_id")), lambda stored, rows: M.upsert_articles(stored, rows, now()))
    return table.read().select("article_key", "title", "url", F.element_at("authors", 1).alias("author"), "content", "summary", "processing_status", "created_at", "updated_at")


@query("""
  WITH r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS nth, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS has_order,
    l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS has_supplier FROM lineitem)
  SELECT CASE WHEN nth > 1 THEN 'key' WHEN NOT has_order THEN 'reference l_orderkey' WHEN NOT has_supplier THEN 'reference l_suppkey' ELSE 'kept' END AS rule, count(*) AS n_rows, sum(l_linenumber)::BIGINT AS lines
  FROM r GROUP BY ALL""")
def constraint_violations(spark, sf_dir):
    """Line items as links: one of a supplier for each order, finished orders, suppliers in credit."""
    from ..operators.constraints import Rules, checked

    links = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    suppliers = _table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    found = checked(links, Rules((), ("l_orderkey", "l_suppkey"), {"l_orderkey": orders, "l_suppkey": suppliers}), F.col("l_linenumber"))
    return found.groupBy(F.coalesce("violation", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n_rows"), F.sum("l_linenumber").cast("long").alias("lines"))
