"""Schemas of every table and record; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


S, B, TS, I = T.StringType(), T.BooleanType(), T.TimestampType(), T.IntegerType()  # noqa: E741

FEED_CONFIG = _struct(("feed_ord", I, False), ("feed_id", S, False), ("feed_type", S, False), ("feed_value", S, False), ("query", S, False), ("enabled", B, False))
FEEDS = _struct(("feed_id", S, False), ("feed_type", S, False), ("feed_value", S, False), ("query", S, False), ("enabled", B, False), ("created_at", TS, True))
ENTRIES = _struct(("feed_id", S, False), ("feed_ord", I, False), ("entry_ord", I, False), ("rss_title", S, True), ("rss_published", S, True), ("rss_source", S, True), ("wrapper_link", S, True))
EXTRACTION = _struct(("url", S, True), ("title", S, True), ("authors", T.ArrayType(S), False), ("published_at", TS, True), ("content", S, True), ("top_image", S, True), ("status", S, False), ("error", S, True))
ARTICLES = _struct(
    ("article_key", S, False), ("title", S, True), ("url", S, False), ("source", S, True), ("authors", T.ArrayType(S), False), ("published_at", TS, True),
    ("content", S, True), ("content_hash", S, True), ("summary", S, True), ("processing_status", S, False), ("created_at", TS, True), ("updated_at", TS, True),
)
ARTICLE_FEEDS = _struct(("article_key", S, False), ("feed_id", S, False), ("first_seen_at", TS, True))
MESSAGES = _struct(("article_key", S, False), ("message", S, False))

#: RSS 2.0 and 1.0 and Atom, as much of them as an entry needs.
RSS = "struct<item: array<struct<title: string, pubDate: string, link: string, source: struct<_VALUE: string, _url: string>>>>"
ATOM_ENTRY = "array<struct<title: string, published: string, updated: string, link: array<struct<_href: string, _rel: string>>, source: struct<title: string>>>"
RDF_ITEM = "array<struct<title: string, pubDate: string, `dc:date`: string, link: string, `dc:source`: string>>"
FEED_XML = f"channel {RSS}, entry {ATOM_ENTRY}, item {RDF_ITEM}, _corrupt_record string"
