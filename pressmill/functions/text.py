"""Text, digest and time expressions. All of them are built-in expressions, and null in gives null out."""

from __future__ import annotations

import codecs
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str methods and \s have it; Java's \s misses many of these.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def strip_or_null(text: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space, the ends are stripped, and what is left empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, rf"{SPACE}+", " ")), F.lit(""))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def feed_time(text: Column) -> Column:
    """A feed's date (RFC 822, or ISO 8601) as a timestamp. Weekdays are decoration, and often wrong: never checked."""
    bare = F.regexp_replace(strip(text), r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    spaced = F.regexp_replace(zoned, r"\s+", " ")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), bare.try_cast("timestamp"))
    return F.coalesce(*(F.try_to_timestamp(spaced, F.lit(f)) for f in forms), iso)


def as_utc(time: Column) -> Column:
    """An instant; times without a zone are read in the session's zone, which the engine pins to UTC."""
    return time.cast("timestamp")


def bytes_as_text(content: Column, declared: Column) -> Column:
    """Text of bytes in a declared encoding, or else UTF-8; what isn't text is replaced.

    UTF-8 and Latin-1 are decoded by built-in expressions; other encodings that are known, and only those, go to Python.
    """
    name = F.lower(F.coalesce(declared, F.lit("")))
    latin = name.isin("iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii")
    utf8 = name.isin("", "utf-8", "utf8")
    other = F.pandas_udf(lambda found, names: pd.Series([_decoded(b, n) for b, n in zip(found, names, strict=True)], dtype=object), T.StringType())
    plain = F.make_valid_utf8(content.cast("string"))
    return F.when(latin, F.decode(content, "ISO-8859-1")).when(utf8, plain).otherwise(F.coalesce(other(F.when(~latin & ~utf8, content), name), plain))


def _decoded(content: bytes | None, name: str) -> str | None:
    """None where there is nothing, or nobody knows the encoding."""
    if content is None:
        return None
    try:
        return bytes(content).decode(name, "replace") if codecs.lookup(name)._is_text_encoding else None
    except (LookupError, ValueError):
        return None


def utf16_as_text(content: Column) -> Column:
    """Text of bytes in UTF-16, by their mark or else the smaller byte first; Spark's own decoding fails where they aren't."""

    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda b: None if b is None else bytes(b).decode("utf-16", "replace"))

    return F.pandas_udf(run, T.StringType())(content)


def unescaped(text: Column) -> Column:
    """Character references decoded, those of HTML too; bare ampersands stay. Only texts with an ampersand go to Python."""
    run = F.pandas_udf(lambda found: found.map(lambda x: None if x is None else html.unescape(x)), T.StringType())
    return F.when(text.contains("&"), run(F.when(text.contains("&"), text))).otherwise(text)
