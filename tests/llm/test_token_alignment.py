import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressmill.llm import token_alignment as ta
from pressmill.llm.common import table


@pytest.fixture(scope="module")
def both():
    from pathlib import Path

    return ta.Tokenizers(*(Path(ta.TOKENIZERS, x).read_bytes() for x in (ta.BYTE_BPE, ta.PIECES)))


def byte_table():
    """The vocabulary's characters for bytes, read from the tokenizer itself."""
    from tokenizers.pre_tokenizers import ByteLevel

    return sorted(ByteLevel.alphabet())


def whole(both, text):
    """Ids and bytes of a text encoded whole, by the libraries; None where they don't give it back."""
    if not text:
        return None
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    a_bytes = [both.a_bytes[i] for i in a]
    b_bytes = []
    for i in b:
        p = both.b.id_to_piece(i)
        b_bytes.append(bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    return a, b, a_bytes, b_bytes


def by_rule(both, texts):
    """Rows by comparing the byte ranges of tokens one by one."""
    found, counts = [], Counter()
    for text in texts:
        tokens = whole(both, text)
        if tokens is None:
            found.append(None)
            continue
        a, b, a_bytes, b_bytes = tokens
        ranges = []
        for parts in (a_bytes, b_bytes):
            at, out = 0, []
            for x in parts:
                out.append((at, at + len(x)))
                at += len(x)
            ranges.append(out)
        links, j = [], 0
        for i, (s, e) in enumerate(ranges[0]):
            while ranges[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and ranges[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        sides = [[[] for _ in ends] for _ in ranges]
        for side, ids, r in zip(sides, (a, b), ranges, strict=True):
            g = 0
            for i, (_, e) in zip(ids, r, strict=True):
                side[g].append(str(i))
                g += e == ends[g]
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True))
        counts.update(links)
        found.append((len(a), len(b), len(ends), links, text))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, text = x
            rows.append((n_a, n_b, n_groups, len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "plain words", " leading", "trailing ", "two  spaces   three", "tab\tand\nline\r\n", "don't we'll I'm", "naïve café ÄÖ", "漢字 かな 混じり", "😀😀 emoji 👩‍👩‍👧", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", " nbsp  em",
    "x" * 500, "1234567890 12 3", "https://a.b/c?d=e&f=g#h", "   ", " ", "\n\n\n", ". . . !!! ,,, ", "mixedCASE snake_case kebab-case", "\u0000\u0001", "é combining", "a" * 40 + " " + "b" * 40, "", None, "same", "same", "ab " * 90,
]


def test_alphabet():
    assert sorted(ta.byte_of_char()) == byte_table()
    assert sorted(ta.byte_of_char().values()) == list(range(256))


def test_vocabulary_lets_texts_be_divided(both):
    assert both.divides


def test_pieces_have_the_tokens_of_the_whole(both, spark, sf, rng):
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").collect()] + ODD
    marks = ["a", "B", " ", " ", "  ", "\n", "\t", "é", "漢", "'s", "1", ".", "<", " ", "😀", "́", "word"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for text in texts:
        if not text:
            continue
        pieces = [x for span in ta.spans(text, True) for x in span]
        of_a, of_b, same = both.encode(pieces)
        assert [i for a in of_a for i in a] == both.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for b in of_b for i in b] == both.b.encode(text)
        assert bool(same.all()) == (whole(both, text) is not None)
        assert " ".join(pieces) == text


def test_odd_texts_follow_the_rule(spark, both):
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in enumerate(ODD)], "doc_id long, text string, n_a string, row_key string, times string")
    rows = ta.scored(docs, keep=tuple(docs.columns)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == by_rule(both, ODD)
    assert rows[ODD.index("a▁b")]["n_a"] == 0


def test_groups_are_written(spark, both):
    docs = spark.createDataFrame([(0, "don't naïve"), (1, None)], "doc_id long, text string")
    first, second = ta.align(docs, write_groups=True).orderBy("doc_id").collect()
    assert hashlib.sha256(first["groups"].encode()).hexdigest() == first["groups_sha256"]
    ids = [tuple([int(x) for x in side.split(",")] for side in g.split("|")) for g in first["groups"].split(";")]
    assert [i for g in ids for i in g[0]] == whole(both, "don't naïve")[0]
    assert [i for g in ids for i in g[1]] == whole(both, "don't naïve")[1]
    for a, b in ids:
        assert b"".join(both.a_bytes[i] for i in a) == b"".join(both.b_bytes[i] for i in b)
    assert (second["groups"], second["groups_sha256"], second["linked_a"]) == ("", "", [])


@pytest.mark.parametrize("share", [1, 1000, 1 << 40])
def test_query_follows_the_rule_with_any_heavy_share(spark, sf, both, monkeypatch, share):
    monkeypatch.setattr(ta, "HEAVY_SHARE", share)
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    wanted = {d["doc_id"]: w for d, w in zip(docs, by_rule(both, [d["text"] for d in docs]), strict=True)}
    rows = ta.op13_token_alignment(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == wanted[r["doc_id"]]


def test_long_texts_in_spans_and_forgotten_pieces(spark, both, monkeypatch):
    texts = ["word naïve don't  two\n" * 40 + "x" * 300, "short", "漢字" * 200 + " end"]
    before = by_rule(both, texts)
    tokenizers = ta.Tokenizers(both.a.to_str().encode(), both.b.serialized_model_proto())
    monkeypatch.setattr(ta, "SPAN_CHARS", 50)
    monkeypatch.setattr(ta, "CHUNK_CHARS", 100)
    monkeypatch.setattr(ta, "KEPT_PIECES", 2)
    rows = ta._rows(texts, tokenizers, ta._Pieces(tokenizers), True)
    assert [x[:4] for x in rows] == [x[:4] for x in before]
    assert all(hashlib.sha256(x[5].encode()).hexdigest() == x[4] for x in rows)
    assert [x[4] for x in rows] == [x[6] for x in before]


def test_odd_rows_and_empty_tables(odd, both):
    rows = ta.scored(odd, keep=("doc_id", "text", "score")).collect()
    assert len(rows) == odd.count()
    wanted = by_rule(both, [r["text"] for r in rows])
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == wanted
    assert ta.scored(odd.limit(0)).count() == 0
    assert ta.scored(odd.where(F.col("text").isNull())).first()["groups_sha256"] == ""
