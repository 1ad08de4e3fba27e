"""The primary extractor: the main text of pages by scored blocks, as windows and aggregates over their tokens.

A page becomes a row for each tag and piece of text. The text between two block tags is a block; a block that is long enough
and has few of its characters in links scores, by its length and its commas, and passes its score up: whole to the
container that it stands in, half to the container around that one. A container loses the share of its text that lies in links. The text of a
page is that of the good blocks of its best container, one paragraph each.

How deep a token stands is a running sum of opened and closed containers that never falls below zero; the container around
a token is the last one opened at its depth. Headings, and whatever lies in elements that never hold an article, are left
out. Neither names of classes nor article tags matter, so pages without any are read as well.

Pages are told apart by a key that the caller names, which is unique. Blocks and containers are written once, in the shared folder, and all that follows reads
numbers only, but for the text of the blocks that are chosen.

Defined results: pages without a good block have no content; ties go to the container that starts first; text in no
container belongs to the page as a whole; null pages have no content, and null keys are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import REMOVED, extraction
from ..functions.text import collapse_space, unescaped
from ..plans.work import work_folder

#: Elements with end tags of their own that hold blocks, other elements that end a block, headings and titles.
CONTAINERS = ("article", "blockquote", "body", "center", "details", "div", "dl", "figure", "main", "ol", "section", "table", "ul")
BREAKS = ("address", "dd", "dt", "figcaption", "head", "hr", "html", "li", "p", "pre", "summary", "tbody", "td", "tfoot", "th", "thead", "tr")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "title")
#: Elements whose content is no markup, comments, tags, text.
TOKEN = r"(?is)<(script|style|noscript|template|textarea|iframe)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|</?[a-z!?][^<>]*>?|[^<]+|<"
#: A block scores with so many characters, and less than this share of them in links; every comma and every hundred
#: characters, up to three hundred, add to its score.
BLOCK_CHARS, LINK_SHARE, CHARS_A_POINT, MOST_POINTS = 25, 0.5, 100, 3
#: What the container around a block's container gets of its score.
PASSED_ON = 0.5
#: What pages say about themselves in meta elements, the first that is there.
META = {"title": ("og:title", "twitter:title"), "author": ("author", "article:author", "parsely-author"), "time": ("article:published_time", "datepublished", "date", "parsely-pub-date"), "image": ("og:image",)}


def _so_far():
    return Window.partitionBy("_page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _tokens(pages: DataFrame) -> DataFrame:
    """Tokens of pages (_page, html) with the depth of containers, and whether links or elements left out are open."""
    rows = pages.select("_page", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    rows = rows.withColumn("name", F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))).withColumn("closing", F.col("token").startswith("</"))
    kinds = {"depth": CONTAINERS, "away": REMOVED, "linked": ("a",), "headed": HEADINGS}
    # A token that is a whole element, as scripts are, opens nothing.
    one = F.when(F.col("token").rlike(r"(?i)^<(?:script|style|noscript)\b"), 0).when(F.col("closing"), -1).otherwise(1)
    rows = rows.select("*", *(F.sum(F.when(F.col("name").isin(*tags), one).otherwise(0)).over(_so_far()).alias(f"_{k}") for k, tags in kinds.items()))
    floors = {k: F.col(f"_{k}") - F.least(F.min(f"_{k}").over(_so_far()), F.lit(0)) for k in kinds}
    return rows.select("_page", "pos", "token", "name", "closing", *(v.alias(k) for k, v in floors.items()))


def _timeline(pages: DataFrame) -> DataFrame:
    """Opened and closed containers, and blocks, of each page in order. level: of a container, its own depth."""
    tokens = _tokens(pages)
    ends_block = F.col("name").isin(*CONTAINERS, *BREAKS, *HEADINGS, *REMOVED)
    tokens = tokens.withColumn("block", F.sum(ends_block.cast("int")).over(_so_far()))
    edges = tokens.where(F.col("name").isin(*CONTAINERS)).select(
        "_page", "pos", F.when(F.col("closing"), "close").otherwise("open").alias("kind"), (F.col("depth") + F.col("closing").cast("int")).alias("level"),
        F.lit(None).cast("string").alias("text"), F.lit(0).alias("chars"), F.lit(0).alias("in_links"), F.lit(0.0).alias("score"),
    )
    said = F.when(F.col("name") == "br", " ").when((F.col("name") == "") & ~F.col("token").rlike("^<[!?]"), F.col("token"))
    texts = tokens.where((F.col("away") == 0) & (F.col("headed") == 0)).withColumn("said", said).where("said is not null")
    pieces = F.array_sort(F.collect_list(F.struct("pos", "said", (F.col("linked") > 0).alias("linked"))))
    blocks = texts.groupBy("_page", "block").agg(F.min("pos").alias("pos"), F.max("depth").alias("level"), pieces.alias("pieces"))

    def joined(pieces: Column) -> Column:
        return collapse_space(unescaped(F.array_join(F.transform(pieces, lambda x: x["said"]), "")))

    blocks = blocks.select("_page", "pos", "level", joined(F.col("pieces")).alias("text"), joined(F.filter("pieces", lambda x: x["linked"])).alias("in_links"))
    blocks = blocks.where("text is not null").withColumns({"chars": F.length("text"), "in_links": F.coalesce(F.length("in_links"), F.lit(0))})
    good = (F.col("chars") >= BLOCK_CHARS) & (F.col("in_links") < F.col("chars") * LINK_SHARE)
    commas = F.length("text") - F.length(F.replace("text", F.lit(",")))
    score = 1 + commas + F.least(F.floor(F.col("chars") / CHARS_A_POINT), F.lit(MOST_POINTS))
    blocks = blocks.withColumn("score", F.when(good, score).otherwise(0).cast("double"))
    return edges.unionByName(blocks.select("_page", "pos", F.lit("block").alias("kind"), "level", "text", "chars", "in_links", "score"))


def _ended(timeline: DataFrame) -> DataFrame:
    """The timeline with, for containers, where they end and what texts and links they hold."""
    rows = timeline.withColumns({"chars_so_far": F.sum("chars").over(_so_far()), "links_so_far": F.sum("in_links").over(_so_far())})
    whole = Window.partitionBy("_page")
    rows = rows.withColumn("last", F.struct((F.max("pos").over(whole) + 1).alias("pos"), F.sum("chars").over(whole).alias("chars_so_far"), F.sum("in_links").over(whole).alias("links_so_far")))
    # The next container edge at its depth closes it; what is never closed ends with the page.
    after = Window.partitionBy("_page", "level").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    end = F.coalesce(F.first(F.when(F.col("kind") != "block", F.struct("pos", "chars_so_far", "links_so_far")), ignorenulls=True).over(after), F.col("last"))
    return rows.withColumn("end", end)


def _around(timeline: DataFrame) -> DataFrame:
    """The containers, by their place, that a block passes its score to; -1 is the page."""
    blocks = timeline.where("kind = 'block' and score > 0")
    asks = blocks.select("_page", "pos", F.explode(F.array(F.struct(F.col("level").alias("level"), F.col("score").alias("passed")), F.struct((F.col("level") - 1).alias("level"), (F.col("score") * PASSED_ON).alias("passed")))).alias("x"))
    asks = asks.select("_page", "pos", "x.level", "x.passed", F.lit(None).cast("int").alias("opened")).where("level >= 0")
    opened = timeline.where("kind = 'open'").select("_page", "pos", "level", F.lit(None).cast("double").alias("passed"), F.col("pos").alias("opened"))
    before = Window.partitionBy("_page", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asks.unionByName(opened).withColumn("container", F.when(F.col("level") == 0, -1).otherwise(F.coalesce(F.last("opened", ignorenulls=True).over(before), F.lit(-1))))
    return rows.where("passed is not null").groupBy("_page", "container").agg(F.sum("passed").alias("passed"))


def main_text(pages: DataFrame) -> DataFrame:
    """_page and content of pages (_page, html) that have any."""
    path = f"{work_folder(pages.sparkSession)}/blocks"
    blocks = _timeline(pages.where("_page is not null and html is not null"))
    blocks.write.parquet(path)
    blocks = pages.sparkSession.read.schema(blocks.schema).parquet(path)
    timeline = _ended(blocks.drop("text"))
    opened = timeline.where("kind = 'open'").select("_page", F.col("pos").alias("container"), F.col("end.pos").alias("stop"), (F.col("end.chars_so_far") - F.col("chars_so_far")).alias("chars"), (F.col("end.links_so_far") - F.col("links_so_far")).alias("in_links"))
    as_whole = timeline.groupBy("_page").agg(F.lit(-1).alias("container"), F.max("last.pos").alias("stop"), F.max("last.chars_so_far").alias("chars"), F.max("last.links_so_far").alias("in_links"))
    scored = _around(blocks).join(opened.unionByName(as_whole), ["_page", "container"])
    scored = scored.withColumn("score", F.col("passed") * (1 - F.col("in_links") / F.greatest("chars", F.lit(1))))
    best = scored.groupBy("_page").agg(F.max_by(F.struct("container", "stop"), F.struct("score", -F.col("container"))).alias("best"))
    good = blocks.where("kind = 'block' and score > 0").select("_page", "pos", "text").join(best, "_page").where("pos > best.container and pos < best.stop")
    return good.groupBy("_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("content"))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(found, """^["']|["']$""", "")


def _said(tags: Column, names: tuple[str, ...]) -> Column:
    """The contents of the meta elements of the first of these names that is there."""

    def of(name: str) -> Column:
        own = F.filter(tags, lambda t: F.array_contains(F.array(*(F.lower(_attribute(t, a)) for a in ("name", "property", "itemprop"))), name) & (F.trim(_attribute(t, "content")) != ""))
        return F.transform(own, lambda t: F.trim(_attribute(t, "content")))

    return F.coalesce(*(F.when(F.size(of(n)) > 0, of(n)) for n in names), F.array().cast("array<string>"))


def described(pages: DataFrame) -> DataFrame:
    """_page and what pages (_page, html) say about themselves: title, authors, published_at, top_image.

    Addresses are no authors; times without a zone are UTC, and what is no time is left out.
    """
    tags = pages.select("_page", "html", F.regexp_extract_all("html", F.lit(r"(?is)<meta\s[^<>]*>"), F.lit(0)).alias("tags"))
    said = tags.select("_page", F.regexp_extract("html", r"(?is)<title[^<>]*>(.*?)</title\s*>", 1).alias("title"), *(_said(F.col("tags"), names).alias(f"m_{k}") for k, names in META.items()))
    first = {k: unescaped(F.get(f"m_{k}", F.lit(0))) for k in META}
    names = F.split(unescaped(F.array_join("m_author", ";")), r"\s*(?:,|;|\band\b)\s*")
    authors = F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("://")))
    title = F.coalesce(first["title"], collapse_space(unescaped(F.col("title"))))
    return said.select("_page", title.alias("title"), authors.alias("authors"), first["time"].try_cast("timestamp").alias("published_at"), first["image"].alias("top_image"))


def primary(pages: DataFrame, key: str) -> DataFrame:
    """The key, and title, authors, published_at, content and top_image, of pages (key, html) with a main text."""
    texts = pages.select(F.col(key).alias("_page"), "html")
    return main_text(texts).join(described(texts), "_page").select(F.col("_page").alias(key), "title", "authors", "published_at", "content", "top_image")


def extracted(pages: DataFrame) -> DataFrame:
    """url and x, the extraction record, of pages (url, html, http_status, fetch_error): by scored blocks, and where these
    find nothing, from the paragraphs of the article container."""
    answered = F.col("fetch_error").isNull() & (F.coalesce("http_status", F.lit(200)) < 400)
    found = primary(pages.where(answered), "url")
    rows = pages.select("url", "html", "http_status", "fetch_error").join(found, "url", "left")
    other = extraction()("url", F.when(F.col("content").isNull(), F.col("html")), "http_status", "fetch_error")
    good = F.struct("url", "title", "authors", "published_at", "content", "top_image", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))
    return rows.withColumn("other", other).select("url", F.when(F.col("content").isNotNull(), good).otherwise(F.col("other")).alias("x"))
