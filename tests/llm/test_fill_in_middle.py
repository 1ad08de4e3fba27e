import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pressmill.llm import fill_in_middle as fim
from pressmill.llm.common import table


def by_rule(doc_id, text, seed=1):
    """The contract's rule over Python's code points."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_select_finds_each_rank():
    rng = random.Random(3)
    for width in (1, 2, 63, 64, 65, 130, 1000, 4097):
        bits = rng.getrandbits(width) | 1
        places = [i for i in range(width) if bits >> i & 1]
        assert [fim.select(bits, width, k) for k in range(len(places))] == places


@pytest.mark.parametrize("units", ["chars", "words", "lines"])
def test_units_begin_where_a_loop_says(units):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "\n", "\t", "é", "漢", "😀"]) for _ in range(rng.randrange(0, 40)))
        data = text.encode()
        if units == "chars":
            at = range(len(text))
        elif units == "lines":
            at = [0, *(i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text))]
        else:
            words = [i for i, c in enumerate(text) if c not in " \n\t" and (i == 0 or text[i - 1] in " \n\t")]
            at = [0, *words[1:]]
        wanted = sorted({len(text[:i].encode()) for i in at}) if text else []
        got = fim.unit_starts(data[::-1], units)
        assert [i for i in range(len(data)) if got >> i & 1] == wanted


def test_sentinels_are_found_anywhere():
    for text, there in ((b"<P>", True), (b"x<S>", True), (b"<<M>>", True), (b"<P <S <M", False), (b"P>", False), (b"", False), (b"<p>", False)):
        assert fim.holds(text[::-1], fim.PREFIX, fim.SUFFIX, fim.MIDDLE) is there


def test_query_follows_the_rule(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = fim.op11_fill_in_middle(spark, sf).collect()
    assert len(rows) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        n, form, p, m, output = by_rule(r["doc_id"], text)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, sha(output), sha(text))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows(odd):
    rows = fim.transform(odd, keep=tuple(odd.columns)).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = r["text"] or ""
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_rule(r["doc_id"], r["text"])
        assert r["again"] == text


def test_clashing_columns_sentinels_and_edges(spark):
    texts = ["<P>", "a<S>b", "<P", "x", "<<<>>>PSM", "é" * 70, "\0\n", "a\r\nb"]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts * 40)], "doc_id long, text string, n string, output string")
    rows = fim.transform(docs, keep=tuple(docs.columns)).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_rule(r["doc_id"], r["text"])
        assert r["again"] == r["text"]
    assert {r["form"] for r in rows if r["text"] == "x"} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("units", ["words", "lines"])
def test_other_units_come_back_and_cut_at_units(spark, sf, units):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = fim.transform(docs, units=units, keep=("doc_id", "text")).withColumn("again", fim.restored(F.col("output"), F.col("form"))).where("text is not null").collect()
    assert all(r["again"] == r["text"] for r in rows)
    for r in rows:
        if r["form"] != "plain" and 0 < r["prefix_chars"] < len(r["text"]):
            before, after = r["text"][r["prefix_chars"] - 1], r["text"][r["prefix_chars"]]
            assert before == "\n" if units == "lines" else before in " \t\n\v\f\r" and after not in " \t\n\v\f\r"
