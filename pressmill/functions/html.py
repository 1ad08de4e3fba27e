"""Article text out of HTML: the paragraphs of the page's article container."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EXTRACTION

#: Elements that are taken out before anything else.
REMOVED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")
#: Containers in order of preference, as (tag), (attribute, value) or (class).
CONTAINER_TAG = "article"
CONTAINER_ATTRIBUTE = ("itemprop", "articleBody")
CONTAINER_CLASSES = ("article-body", "article-content", "story-body", "story-content", "post-content", "entry-content", "article__body", "story__body")
#: Shorter paragraphs are left out; statuses that mean that a publisher refuses.
LEAST_CHARS = 40
REFUSALS = (401, 403, 429)
FAILED = "Article content extraction failed."
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())


class _Outline(HTMLParser):
    """Texts of a page in order, and for elements that matter the range of texts they span.

    An element stays open until an end tag of its name closes it, so a paragraph without an end tag holds the
    paragraphs after it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.open: list[tuple[str, list | None]] = []
        self.paragraphs: list[list[int]] = []
        self.containers: dict[int, list[int]] = {}
        self.title: list[int] | None = None
        self.image: str | None = None
        self.has_image = False
        self.removed = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in REMOVED:
            self.removed += 1
        spans: list[list[int]] = []
        if not self.removed:
            first = {k: v for k, v in reversed(attrs)}
            span = [len(self.texts), -1]
            if tag == "p":
                self.paragraphs.append(span)
                spans.append(span)
            if tag == "title" and self.title is None:
                self.title = span
                spans.append(span)
            if tag == "meta" and first.get("property") == "og:image" and not self.has_image:
                self.has_image, self.image = True, first.get("content")
            classes = (first.get("class") or "").split()
            ranks = [0] if tag == CONTAINER_TAG else []
            ranks += [1] if first.get(CONTAINER_ATTRIBUTE[0]) == CONTAINER_ATTRIBUTE[1] else []
            ranks += [2 + i for i, c in enumerate(CONTAINER_CLASSES) if c in classes]
            for rank in ranks:
                if rank not in self.containers:
                    self.containers[rank] = span
                    spans.append(span)
        if tag in VOID:
            self._close(tag, spans)
        else:
            self.open.append((tag, spans))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, spans: list) -> None:
        for span in spans:
            span[1] = len(self.texts)
        if tag in REMOVED:
            self.removed -= 1

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _ in self.open):
            while self.open:
                name, spans = self.open.pop()
                self._close(name, spans)
                if name == tag:
                    return

    def handle_data(self, data: str) -> None:
        if not self.removed and (text := data.strip()):
            self.texts.append(text)

    def finish(self) -> None:
        self.close()
        while self.open:
            self._close(*self.open.pop())

    def text(self, span: list[int]) -> str:
        return " ".join(self.texts[span[0] : span[1]])


def paragraphs_of(source: str) -> dict | None:
    """title, content and top_image of a page; None without a paragraph that is long enough."""
    page = _Outline()
    page.feed(source)
    page.finish()
    a, b = page.containers[min(page.containers)] if page.containers else (0, len(page.texts))
    inside = (p for p in page.paragraphs if a <= p[0] and p[1] <= b)
    content = "\n\n".join(t for t in map(page.text, inside) if len(t) >= LEAST_CHARS).strip()
    if not content:
        return None
    return {"title": page.text(page.title) if page.title else None, "authors": [], "published_at": None, "content": content, "top_image": page.image}


#: What pages say about themselves in meta elements, the first that is there.
META_TITLE = ("og:title", "twitter:title")
META_AUTHOR = ("author", "article:author", "parsely-author")
META_TIME = ("article:published_time", "datepublished", "date", "parsely-pub-date")


class _Meta(HTMLParser):
    """The contents of meta elements by name, property or itemprop, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "meta":
            a = {k: v or "" for k, v in attrs}
            for key in ("name", "property", "itemprop"):
                if a.get(key) and a.get("content", "").strip():
                    self.found.setdefault(a[key].lower(), []).append(a["content"].strip())

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)


def self_described(url: str, source: str) -> dict | None:
    """A primary extractor: the paragraphs of the article container, with the title, authors and time that the page's meta
    elements name. Addresses are no authors; times without a zone are UTC, and what is no time is left out."""
    found = paragraphs_of(source)
    if found is None:
        return None
    page = _Meta()
    page.feed(source)
    page.close()
    first = lambda names: next((page.found[n] for n in names if n in page.found), [])
    authors = [x.strip() for text in first(META_AUTHOR) for x in re.split(r"\s*(?:,|;|\band\b)\s*", text)]
    time = pd.to_datetime(next(iter(first(META_TIME)), None), utc=True, errors="coerce")
    return found | {
        "title": next(iter(first(META_TITLE)), found["title"]),
        "authors": list(dict.fromkeys(x for x in authors if x and "://" not in x)),
        "published_at": None if time is None or pd.isna(time) else time,
    }


def extraction(primary: Callable[[str, str], dict | None] | None = None) -> Callable[..., Column]:
    """A function of columns (url, html, http_status, fetch_error) that gives the extraction record.

    primary is tried first where given: a heuristic extractor of the caller's (url, html) -> record or None, which may
    also find authors and a time (self_described is one). The built-in one reads the paragraphs of the article container. It runs once a row:
    being declared nondeterministic, it is not repeated when a field of its result is filtered on.
    """

    def one(url, source, status, error) -> dict:
        out = {"url": url, "title": None, "authors": [], "published_at": None, "content": None, "top_image": None, "status": "failed", "error": None}
        if status is not None and not pd.isna(status) and int(status) in REFUSALS:
            return out | {"error": f"Publisher returned HTTP {int(status)}."}
        if error is not None and not pd.isna(error):
            return out | {"error": str(error)}
        if status is not None and not pd.isna(status) and int(status) >= 400:
            return out | {"error": f"HTTP {int(status)} for url: {url}"}
        try:
            found = (primary(url, source or "") if primary else None) or paragraphs_of(source or "")
        except Exception as e:  # a page never ends a run
            return out | {"error": str(e)}
        return out | (found | {"status": "success"} if found else {"error": FAILED})

    @F.pandas_udf(EXTRACTION)
    def run(url: pd.Series, source: pd.Series, status: pd.Series, error: pd.Series) -> pd.DataFrame:
        rows = [one(*x) for x in zip(url, source, status, error, strict=True)]
        return pd.DataFrame(rows, columns=[f.name for f in EXTRACTION.fields]).assign(published_at=lambda d: pd.to_datetime(d["published_at"], utc=True))

    return run.asNondeterministic()
