"""The scored blocks of pages, against a loop over a tree of nodes."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from pressmill.functions.html import REMOVED
from pressmill.operators import articles as A
from pressmill.operators import content as C

LONG = "This sentence is certainly longer than forty characters, and it has commas, in all."


def by_loop(source):
    """The main text by a walk over the tokens with a stack of containers."""
    stack, away, linked, headed, blocks, opened, ended = [], 0, 0, 0, [], {}, {}
    text = link = ""
    first = None

    def end_block():
        nonlocal text, link, first
        clean, in_links = (" ".join(html.unescape(x).split()) for x in (text, link))
        if clean:
            blocks.append((first, list(stack), clean, len(in_links)))
        text, link, first = "", "", None

    tokens = [m.group(0) for m in re.finditer(C.TOKEN.replace(r"\z", r"\Z"), source)]
    for pos, token in enumerate(tokens):
        m = re.match(r"</?([A-Za-z][A-Za-z0-9:-]*)", token)
        name, closing, whole = m.group(1).lower() if m else "", token.startswith("</"), bool(re.match(r"(?i)<(?:script|style|noscript)\b", token))
        step = 0 if whole else -1 if closing else 1
        if name in (*C.CONTAINERS, *C.BREAKS, *C.HEADINGS, *REMOVED):
            end_block()
        if name in C.CONTAINERS and not closing:
            stack.append(pos)
            opened[pos] = away
        elif name in C.CONTAINERS and stack:
            ended[stack.pop()] = pos
        away = max(0, away + step * (name in REMOVED))
        headed = max(0, headed + step * (name in C.HEADINGS))
        linked = max(0, linked + step * (name == "a"))
        said = " " if name == "br" else token if not name and not re.match("<[!?]", token) else None
        if said is not None and not away and not headed:
            first = pos if first is None else first
            text += said
            link += said if linked else ""
    end_block()
    scores, good = {}, []
    for pos, around, clean, in_links in blocks:
        if len(clean) >= C.BLOCK_CHARS and in_links < C.LINK_SHARE * len(clean):
            score = 1 + clean.count(",") + min(len(clean) // C.CHARS_A_POINT, C.MOST_POINTS)
            good.append((pos, clean))
            path = [-1, *around]
            scores[path[-1]] = scores.get(path[-1], 0) + score
            if len(path) > 1:
                scores[path[-2]] = scores.get(path[-2], 0) + score * C.PASSED_ON
    if not good:
        return None

    def inside(c, pos):
        return c < pos < ended.get(c, len(tokens) + 1)

    def final(c):
        chars, links = (sum(b[i] if i == 3 else len(b[2]) for b in blocks if inside(c, b[0])) for i in (2, 3))
        return scores[c] * (1 - links / max(chars, 1)), -c

    best = max(scores, key=final)
    return "\n\n".join(t for p, t in good if inside(best, p))


PAGES = [
    f"<body><div><p>{LONG}</p><p>{LONG} two</p></div><div><a href=x>{LONG}</a></div><ul><li><a>menu, menu, menu, menu, menu, and more</a></li></ul></body>",
    f"<div><div><p>{LONG}<p>{LONG} unclosed</div><div><p>{LONG} {LONG} {LONG} {LONG}</p></div></div>",
    f"{LONG}<br>without any container &amp; <b>bold</b> &eacute;",
    f"<nav><p>{LONG} {LONG}</p></nav><aside><div><p>{LONG}</p></div></aside><div><p>{LONG} kept</p></div><footer>{LONG}</footer>",
    f"<div><script>var a = '<p>{LONG}</p>';</script><style>p, a, b, c, d, e, f, g</style><p>{LONG}</p><!-- <p>{LONG}</p> --></div>",
    f"</div></div><div><p>{LONG}</p></div></div><div><p>{LONG} {LONG}</p></div>",
    f"<h1>{LONG} heading</h1><div><h2>{LONG}</h2><p>short</p></div>",
    f"<table><tr><td>{LONG}<td>{LONG} cell<tr><td>x</table><blockquote>{LONG}</blockquote>",
    f"<div>{'<div>' * 400}<p>{LONG}</p>{'</div>' * 400}</div>",
    f"<DIV CLASS=a><P>{LONG}</P></DIV><div><p>{LONG}</p></div>",
    "", "   ", "<p>short</p>", None, "<div", "< 5 & 6 >",
]


def random_page(rng):
    tags = [*C.CONTAINERS, "p", "li", "h2", "a", "b", "nav", "footer", "td", "br", "form"]
    out = []
    for _ in range(rng.randrange(1, 60)):
        kind = rng.random()
        if kind < 0.45:
            out.append(f"<{rng.choice(tags)}>")
        elif kind < 0.75:
            out.append(f"</{rng.choice(tags)}>")
        else:
            out.append(" ".join(rng.choice(["word", "comma,", "&amp;", "é", "longerword,"]) for _ in range(rng.randrange(1, 40))))
    return "".join(out)


def test_against_a_loop(spark):
    rng = random.Random(7)
    pages = PAGES + [random_page(rng) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(pages)), "key int, html string")
    got = {r["key"]: r["content"] for r in C.primary(frame, "key").collect()}
    for i, page in enumerate(pages):
        assert got.get(i) == (by_loop(page) if page else None), page


def test_menus_and_notices_lose(spark):
    texts = {r["key"]: r["content"] for r in C.primary(spark.createDataFrame(list(enumerate(PAGES)), "key int, html string"), "key").collect()}
    assert texts[0] == f"{LONG}\n\n{LONG} two" and texts[3] == f"{LONG} kept" and texts[4] == LONG
    assert texts[2] == f"{LONG} without any container & bold é" and not {6, 10, 11, 12, 13, 14, 15} & set(texts)


def test_what_pages_say_about_themselves(spark):
    head = "<meta property='og:title' content='The &amp; title'><META name=author content='A. One, B. Two and C. Three'/><meta name='author' content='https://no.example/x'><meta content='2026-09-05T10:00:00+05:30' property=\"article:published_time\"><meta property=og:image content=i.png>"
    rows = [(1, f"<html><head><title>t</title>{head}</head><p>{LONG}</p></html>"), (2, f"<title> a\n &lt;b </title><meta name=date content='some day'><p>{LONG}</p>"), (3, f"<p>{LONG}</p>")]
    one, two, three = C.primary(spark.createDataFrame(rows, "key int, html string"), "key").orderBy("key").collect()
    assert (one["title"], one["authors"], one["top_image"]) == ("The & title", ["A. One", "B. Two", "C. Three"], "i.png") and one["published_at"].isoformat() == "2026-09-05T04:30:00"
    assert (two["title"], two["authors"], two["published_at"]) == ("a <b", [], None) and (three["title"], three["content"]) == (None, LONG)


@pytest.mark.parametrize("primary", [None, A.SCORED])
def test_extraction_record(spark, primary):
    """A page without an article container is read whole by the fallback; failures are told alike."""
    rows = [("u1", f"<div><p>{LONG}</p></div><div><ul><li>{'item, ' * 3}</li></ul></div>", 200, None), ("u2", None, 403, None), ("u3", None, None, "Connection failed"), ("u4", "<p>no</p>", 200, None), ("u5", f"<p>{LONG}</p>", 500, None), ("u6", "", None, None)]
    pages = spark.createDataFrame(rows, "url string, html string, http_status int, fetch_error string")
    entries = spark.createDataFrame([(u, i) for i, u in enumerate(["u1", "u1", "u2", "u3", "u4", "u5", "u6", "u7"])], "article_url string, n int")
    got = A.extract(entries, pages, primary).orderBy("n").collect()
    x = {r["article_url"]: r["x"] for r in got}
    assert len(got) == 8 and x["u1"]["content"] == LONG and x["u1"]["status"] == "success" and x["u1"]["error"] is None and x["u7"] is None
    assert "403" in x["u2"]["error"] and x["u3"]["error"] == "Connection failed" and "500" in x["u5"]["error"]
    assert [x[u]["status"] for u in ("u2", "u3", "u4", "u5", "u6")] == ["failed"] * 5


def test_pages_travel_once(spark):
    """Tokens are shuffled once, by page, and nothing is sent to one task."""
    pages = spark.range(10).select(F.col("id").alias("_page"), F.lit(f"<div><p>{LONG}</p></div>").alias("html"))
    plan = C._timeline(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_page") <= 2 and "SinglePartition" not in plan
