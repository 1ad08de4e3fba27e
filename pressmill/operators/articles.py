"""Entries to normalised articles: resolution, extraction, precedence of fields, keys and rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import extraction
from ..functions.text import collapse_space, feed_time, first_filled, sha256_hex, strip_or_null
from ..functions.url import canonical_url, resolved
from . import content

#: The primary extractor that scores the blocks of pages.
SCORED = "scored"


def resolve(entries: DataFrame, publishers: DataFrame) -> DataFrame:
    """entries with article_url: publishers (wrapper_url, publisher_url) has what could be resolved."""
    known = publishers.select(F.col("wrapper_url").alias("wrapper_link"), "publisher_url").groupBy("wrapper_link").agg(F.min("publisher_url").alias("publisher_url"))
    return entries.join(known, "wrapper_link", "left").withColumn("article_url", resolved(F.col("wrapper_link"), F.col("publisher_url"))).drop("publisher_url")


def extract(entries: DataFrame, pages: DataFrame, primary=None) -> DataFrame:
    """entries with x, the extraction record of article_url. pages: url, html, http_status, fetch_error.

    Each page is extracted once, however many entries lead to it. primary: SCORED, or a function of a page's url and html.
    """
    wanted = pages.join(entries.select(F.col("article_url").alias("url")).distinct(), "url", "left_semi")
    if primary == SCORED:
        found = content.extracted(wanted).withColumnRenamed("url", "article_url")
    else:
        found = wanted.select(F.col("url").alias("article_url"), extraction(primary)("url", "html", "http_status", "fetch_error").alias("x"))
    return entries.join(found, "article_url", "left")


def precedence(title: Column, rss_title: Column, source: Column, rss_source: Column, published_at: Column, rss_published: Column) -> dict[str, Column]:
    """What the page says goes before what the feed says; empty counts as nothing."""
    return {"title": first_filled(title, rss_title), "source": first_filled(source, rss_source), "published_at": F.coalesce(published_at, feed_time(rss_published))}


def normalised(url: Column, title: Column, content: Column, source: Column) -> dict[str, Column]:
    """Clean texts, the canonical URL, and the two digests made of them."""
    return {
        "url": canonical_url(url),
        "title": collapse_space(title),
        "content": collapse_space(content),
        "source": collapse_space(source),
        "article_key": sha256_hex(canonical_url(url)),
        "content_hash": sha256_hex(collapse_space(content)),
    }


def rejection(link: Column, status: Column, error: Column, key: Column) -> Column:
    """Why an entry fails, or null: no link, no content, or a URL without a canonical form."""
    return (
        F.when(strip_or_null(link).isNull(), F.lit("entry has no link"))
        .when(F.coalesce(status, F.lit("failed")) != "success", F.coalesce(error, F.lit("page was not fetched")))
        .when(key.isNull(), F.lit("malformed url"))
    )


def normalise(entries: DataFrame) -> DataFrame:
    """Extracted entries as article rows with failure, null for those that go on."""
    x = {c: F.col(f"x.{c}") for c in ("title", "authors", "published_at", "content", "status", "error")}
    fields = precedence(x["title"], F.col("rss_title"), F.lit(None).cast("string"), F.col("rss_source"), x["published_at"], F.col("rss_published"))
    out = normalised(F.col("article_url"), fields["title"], x["content"], fields["source"])
    named = {k: out[k] for k in ("article_key", "title", "url", "source")} | {"authors": F.coalesce(x["authors"], F.array().cast("array<string>")), "published_at": fields["published_at"]} | {k: out[k] for k in ("content", "content_hash")}
    rows = entries.select("feed_id", "feed_ord", "entry_ord", "wrapper_link", *(v.alias(k) for k, v in named.items()), x["status"].alias("_status"), x["error"].alias("_error"))
    return rows.withColumn("failure", rejection(F.col("wrapper_link"), F.col("_status"), F.col("_error"), F.col("article_key"))).drop("_status", "_error")
