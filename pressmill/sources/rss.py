"""Feed payloads to entry rows: well-formed ones with Spark's own XML parser, broken ones from their tokens.

A broken payload (bare ampersands, unknown entities, tags that aren't closed or don't match, a cut end) becomes a row for
each token, and what a token belongs to is the last boundary before it, which window functions find: an entry lasts until its end tag,
the next entry or the end of the channel; a field until its end tag, the next field or the end of the entry. A field that
the end of the document cuts is left out, as its text may be half, and so is an entry that is cut before its first field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bytes_as_text, strip_or_null, unescaped, utf16_as_text
from ..schemas import FEED_XML


def _text() -> Column:
    """The payload's text in the encoding that it declares."""
    declared = F.nullif(F.regexp_extract(F.make_valid_utf8(F.substring("content", 1, 200).cast("string")), r"""<\?xml[^>]*encoding=["']([A-Za-z0-9_-]+)""", 1), F.lit(""))
    wide = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    text = F.coalesce(utf16_as_text(F.when(wide, F.col("content"))), bytes_as_text(F.col("content"), declared))
    # A byte order mark is no part of the document.
    return F.regexp_replace(text, r"^\ufeff", "")


def _read(payloads: DataFrame) -> DataFrame:
    """payloads: feed_id, feed_ord and content (bytes). Adds the text and the parsed document; null fields where it is malformed."""
    # Generators are made once: a filter on what is parsed isn't moved below them, which would parse again for each use.
    texts = payloads.withColumn("_text", F.explode(F.array(_text())))
    return texts.withColumn("_feed", F.explode(F.array(F.from_xml("_text", FEED_XML, {"mode": "PERMISSIVE", "rowTag": "rss"}))))


def _broken() -> Column:
    """Whether the XML parser gave up, at the start or on the way, or found no feed."""
    return F.col("_feed._corrupt_record").isNotNull() | F.col("_feed.channel").isNull() & F.col("_feed.entry").isNull() & F.col("_feed.item").isNull()


#: The elements that make a document a feed, those that are entries, and the fields of an entry.
FEED_TAGS = r"(?i)<(?:rss|rdf:rdf|feed|channel|item|entry)[\s/>]"
ENTRIES = ("item", "entry")
ENDS = (*(f"/{x}" for x in ENTRIES), "/channel", "/feed", "/rss", "/rdf:rdf")
FIELDS = {"title": "title", "link": "link", "pubdate": "time", "published": "time", "dc:date": "time", "updated": "late time", "source": "source", "dc:source": "source"}
#: Character data, comments, tags (a missing > is forgiven), text.
TOKEN = r"<!\[CDATA\[[\s\S]*?(?:\]\]>|$)|<!--[\s\S]*?(?:-->|$)|</?[A-Za-z!?][^<>]*>?|[^<]+|<"


def _attribute(token: Column, name: str) -> Column:
    found = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.coalesce(*(F.nullif(F.regexp_extract(token, found, i), F.lit("")) for i in (1, 2, 3)))


def _tokens(payloads: DataFrame) -> DataFrame:
    """The tokens of payloads (with _text) in order: what each says, and the entry and field that it stands in."""
    # The key is made before the rows are exploded, so that all tokens of a payload share it.
    rows = payloads.select(F.monotonically_increasing_id().alias("_row"), "feed_id", "feed_ord", "_text")
    rows = rows.select("_row", "feed_id", "feed_ord", F.posexplode(F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.nullif(F.lower(F.regexp_extract("token", r"^<(/?[A-Za-z][\w:.-]*)", 1)), F.lit(""))
    rows = rows.withColumn("name", name).withColumn("alone", F.col("name").isNotNull() & F.col("token").endswith("/>"))
    so_far = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("name").isin(*ENTRIES)
    bound = F.when(starts, F.struct(F.lit(1).alias("inside"), F.col("alone"))).when(F.col("name").isin(*ENDS), F.struct(F.lit(0).alias("inside"), F.lit(False).alias("alone")))
    mark = F.when(starts | F.col("name").isin(*ENDS, *FIELDS, *(f"/{x}" for x in FIELDS)), F.struct("name", "alone", "pos"))
    rows = rows.select("*", bound.alias("bound"), mark.alias("mark"))
    rows = rows.select(
        "*",
        F.sum(starts.cast("int")).over(so_far).alias("entry"),
        F.last("bound", ignorenulls=True).over(so_far).alias("scope"),
        F.last("mark", ignorenulls=True).over(so_far).alias("opened"),
        F.last("mark", ignorenulls=True).over(before).alias("opened_before"),
        F.max(F.when(F.col("mark").isNotNull(), F.col("pos"))).over(Window.partitionBy("_row")).alias("last_mark"),
    )
    in_entry = (F.col("scope.inside") == 1) & ~F.col("scope.alone")
    return rows.withColumn("in_entry", F.coalesce(in_entry, F.lit(False)))


def recovered(payloads: DataFrame) -> DataFrame:
    """The entries of broken payloads (with _text), as parse gives them."""
    tokens = _tokens(payloads.where(F.col("_text").rlike(FEED_TAGS)))
    # A source of Atom says its name in a title of its own.
    own_title = (F.col("mark.name") == "title") & (F.col("opened_before.name") == "source") & ~F.col("opened_before.alone")
    kind = F.when(F.coalesce(own_title, F.lit(False)), "source").otherwise(F.coalesce(*(F.when(F.col("mark.name") == k, v) for k, v in FIELDS.items())))
    in_order = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = tokens.withColumn("field", F.last(F.when(F.col("mark").isNotNull(), F.struct(F.when(F.col("in_entry"), kind).alias("kind"), F.col("pos"), F.col("alone"))), ignorenulls=True).over(in_order))
    raw = F.col("token").startswith("<![CDATA[")
    said = F.when(raw, F.regexp_replace("token", r"^<!\[CDATA\[|\]\]>$", "")).when(F.col("name").isNull() & ~F.col("token").rlike("^<[!?]"), unescaped(F.col("token")))
    # Of links, the address may be an attribute; links to other things than the article don't count.
    href = F.when((F.col("mark.name") == "link") & (F.coalesce(_attribute(F.col("token"), "rel"), F.lit("alternate")) == "alternate"), unescaped(_attribute(F.col("token"), "href")))
    inside = F.col("in_entry") & F.col("field.kind").isNotNull() & ((F.col("pos") == F.col("field.pos")) | ~F.col("field.alone"))
    # What the last mark opens is cut by the end of the document.
    whole = (F.col("field.pos") < F.col("last_mark")) | F.col("field.alone")
    pieces = tokens.where("entry > 0").select(
        "_row", "feed_id", "feed_ord", "entry", "pos", "name", "alone", F.when(inside & whole, F.col("field.kind")).alias("kind"), F.col("field.pos").alias("at"), F.coalesce(said, href).alias("said"),
        (F.col("name").isin(*ENDS) | F.col("name").isin(*ENTRIES) & F.col("alone")).alias("ends"),
    )
    key = ("_row", "feed_id", "feed_ord", "entry")
    parts = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("pos", "said"))))
    values = pieces.groupBy(*key, "at", "kind").agg(F.array_join(F.transform(parts, lambda x: x["said"]), "").alias("said"), F.max(F.coalesce("ends", F.lit(False))).alias("ends"))
    values = values.withColumn("said", strip_or_null(F.col("said")))

    def first(kind: str) -> Column:
        return F.min_by("said", F.when((F.col("kind") == kind) & F.col("said").isNotNull(), F.col("at")))

    entries = values.groupBy(*key).agg(
        first("title").alias("rss_title"), F.coalesce(first("time"), first("late time")).alias("rss_published"), first("source").alias("rss_source"), first("link").alias("wrapper_link"),
        (F.max("ends") | (F.count("kind") > 0)).alias("there"),
    )
    order = Window.partitionBy("_row").orderBy("entry")
    return entries.where("there").select("feed_id", "feed_ord", (F.row_number().over(order) - 1).alias("entry_ord"), "rss_title", "rss_published", "rss_source", "wrapper_link")


def parse(payloads: DataFrame) -> DataFrame:
    """One row for each entry, in document order: items of RSS 2.0 or 1.0, or Atom entries. Titles, dates, links and sources are
    stripped, and null if blank. Empty channels have no rows, and broken payloads those that can be recovered."""
    atom = F.transform(
        "_feed.entry",
        lambda e: F.struct(
            e["title"].alias("title"),
            F.coalesce(e["published"], e["updated"]).alias("pubDate"),
            F.try_element_at(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(1)).getField("_href").alias("link"),
            F.struct(e["source"]["title"].alias("_VALUE"), F.lit(None).cast("string").alias("_url")).alias("source"),
        ),
    )
    rdf = F.transform(
        "_feed.item",
        lambda e: F.struct(e["title"].alias("title"), F.coalesce(e["pubDate"], e["dc:date"]).alias("pubDate"), e["link"].alias("link"), F.struct(e["dc:source"].alias("_VALUE"), F.lit(None).cast("string").alias("_url")).alias("source")),
    )
    read = _read(payloads)
    whole = (
        read.where(~_broken())
        .select("feed_id", "feed_ord", F.posexplode(F.coalesce("_feed.channel.item", rdf, atom)).alias("entry_ord", "e"))
        .select(
            "feed_id",
            "feed_ord",
            "entry_ord",
            strip_or_null(F.col("e.title")).alias("rss_title"),
            strip_or_null(F.col("e.pubDate")).alias("rss_published"),
            strip_or_null(F.col("e.source._VALUE")).alias("rss_source"),
            strip_or_null(F.col("e.link")).alias("wrapper_link"),
        )
    )
    return whole.unionByName(recovered(read.where(_broken())))


def quarantined(payloads: DataFrame) -> DataFrame:
    """The payloads that are no feed at all, so that they can be counted and kept."""
    return _read(payloads).where(_broken() & ~F.coalesce(F.col("_text").rlike(FEED_TAGS), F.lit(False))).drop("_feed", "_text")
