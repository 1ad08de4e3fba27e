"""URL expressions: canonical form, wrapper links and feed addresses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

#: Query parameters that don't change what a URL shows.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")
#: Schemes whose last path segment may carry ;parameters.
WITH_PARAMETERS = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")
#: Fixed value: links that lead to an article through an aggregator.
WRAPPER = r"/rss/(?:articles|read)/([^/?]+)"


def _encode(text: Column) -> Column:
    """Form encoding with ~ as it is and * encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(text: Column) -> Column:
    """Form decoding that leaves a % which starts no escape as it is."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _query(query: Column) -> Column:
    """Parameters without tracking, sorted by name and value."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(_decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"), _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def _parts(url: Column) -> dict[str, Column]:
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.when(scheme != "", F.regexp_replace(bare, r"^[^:]*:", "")).otherwise(bare)
    net = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    after = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"(?s)^([^#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^([^?]*)", 1)
    path = F.when(scheme.isin(*WITH_PARAMETERS), F.regexp_replace(path, r"(?s)^((?:.*/)?[^/;]*);[^/]*$", "$1")).otherwise(path)
    user, at = F.regexp_extract(net, r"^(.*)@", 1), F.regexp_replace(net, r"^.*@", "")
    bracketed = at.contains("[")
    host = F.when(bracketed, F.regexp_extract(at, r"\[([^\]]*)", 1)).otherwise(F.regexp_extract(at, r"^([^:]*)", 1))
    port = F.when(bracketed, F.regexp_extract(at, r"\][^:]*:(.*)$", 1)).otherwise(F.regexp_extract(at, r"^[^:]*:(.*)$", 1))
    return {"scheme": scheme, "net": net, "user": user, "host": F.lower(host), "port": port, "path": path, "query": F.regexp_extract(after, r"(?s)^[^?]*\?(.*)$", 1)}


def malformed_url(url: Column) -> Column:
    """Whether a URL has no canonical form: a port that is no number up to 65535, or half a bracket."""
    p = _parts(strip(url))
    bad_port = (p["port"] != "") & ~(p["port"].rlike(r"^[0-9]+$") & (p["port"].try_cast("decimal(38,0)") <= 65535))
    return F.coalesce((p["net"].contains("[") != p["net"].contains("]")) | ((p["host"] != "") & F.coalesce(bad_port, F.lit(True))), F.lit(False))


def canonical_url(url: Column) -> Column:
    """The canonical form: one string for all spellings of a page's address.

    Scheme and host in lower case, default ports, fragments, ;parameters, tracking parameters and trailing slashes
    dropped, the rest of the query sorted and encoded in one way. Blank gives null, a text without a host is returned
    stripped, and a malformed URL gives null. Brackets of IPv6 hosts are dropped and ports kept on http and https
    alone, as stored keys depend on it.
    """
    stripped = strip(url)
    p = _parts(stripped)
    number = p["port"].try_cast("int")
    kept_port = F.when(((p["scheme"] == "http") & (number != 80) | (p["scheme"] == "https") & (number != 443)) & (number != 0), F.concat(F.lit(":"), number.cast("string"))).otherwise("")
    name, password = F.regexp_extract(p["user"], r"^([^:]*)", 1), F.regexp_extract(p["user"], r"^[^:]*:(.*)$", 1)
    user = F.when((name != "") | (password != ""), F.concat(name, F.when(password != "", F.concat(F.lit(":"), password)).otherwise(""), F.lit("@"))).otherwise("")
    path = F.when(p["path"] == "", "/").when(p["path"] == "/", "/").otherwise(F.regexp_replace(p["path"], "/+$", ""))
    query = _query(p["query"])
    whole = F.concat(
        F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""), F.lit("//"), user, p["host"], F.coalesce(kept_port, F.lit("")), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    )
    return F.when(stripped == "", None).when(malformed_url(url), None).when(p["host"] == "", stripped).otherwise(whole)


def is_wrapper(url: Column) -> Column:
    return F.coalesce(url.rlike(WRAPPER), F.lit(False))


def wrapper_token(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, WRAPPER, 1), F.lit(""))


def decoding_parameters(page: Column) -> Column:
    """signature and timestamp that a wrapper page carries; null unless it carries both."""
    signature = F.nullif(F.regexp_extract(page, r'data-n-a-sg="([^"]+)"', 1), F.lit(""))
    timestamp = F.nullif(F.regexp_extract(page, r'data-n-a-ts="([^"]+)"', 1), F.lit(""))
    return F.when(signature.isNotNull() & timestamp.isNotNull(), F.struct(signature.alias("signature"), timestamp.alias("timestamp")))


#: The address that decodes wrapper links, and the name of the call.
DECODER = "https://news.google.com/_/DotsSplashUi/data/batchexecute"
DECODER_CALL = "Fbv4je"


def decoding_request(token: Column, signature: Column, timestamp: Column) -> Column:
    """The form field that asks for a wrapper's address: JSON in JSON, as the decoder takes it; null if a part is missing."""
    call = F.array(F.to_json(F.array(F.lit(DECODER_CALL), F.to_json(F.array(F.array(token, signature, timestamp))))))
    # What follows the arguments is a null and a word, which an array of strings can't hold.
    inner = F.regexp_replace(F.element_at(call, 1), r"\]$", ',null,"generic"]')
    return F.when(token.isNotNull() & signature.isNotNull() & timestamp.isNotNull(), F.concat(F.lit("["), inner, F.lit("]")))


def feed_url(base: Column, query: Column, language: Column, country: Column, edition: Column) -> Column:
    """The address of a feed for a search query."""
    values = (("q", query), ("hl", language), ("gl", country), ("ceid", edition))
    return F.concat(base, F.lit("?"), F.concat_ws("&", *(F.concat(F.lit(f"{k}="), _encode(v)) for k, v in values)))


def _first_address(value) -> str | None:
    """The first string in nested lists that is an address; objects are not entered."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str) and x.startswith(("http://", "https://")):
            return x
        if isinstance(x, list):
            todo += reversed(x)
    return None


def _decoded(body: str | None) -> str | None:
    if body is None:
        return None
    try:
        return _first_address(json.loads(body.lstrip().removeprefix(")]}'")))
    except (ValueError, RecursionError):
        return None


def decoded_url(body: Column) -> Column:
    """The publisher's address in a decoding response (JSON after a guard); null if there is none.

    Which strings count depends on whether lists or objects hold them, which no built-in expression can tell.
    """

    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(_decoded)

    return F.pandas_udf(run, T.StringType())(body)


def resolved(url: Column, publisher_url: Column) -> Column:
    """The publisher's address where a wrapper could be resolved, else the link itself."""
    return F.when(is_wrapper(url), F.coalesce(F.nullif(publisher_url, F.lit("")), url)).otherwise(url)
