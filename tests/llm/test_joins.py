import re
from collections import Counter

import pytest

from pressmill.llm import decontaminate as D
from pressmill.llm import jaccard as J
from pressmill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = J.join(docs).collect()
    expected = brute(rows)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all((r["n_shingles"], r["component_id"]) == (expected[r["doc_id"]] if r["doc_id"] is not None else (r["n_shingles"], None)) for r in got)


def test_jaccard_query(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_jaccard_of_odd_documents(spark, odd):
    check(odd)
    assert J.join(odd.limit(0)).isEmpty()


@pytest.mark.parametrize(("block", "size", "hot"), [(4, 4096, 20), (128, J.BLOCK_BYTES, J.HOT_SHINGLE)])
def test_jaccard_of_near_copies(spark, rng, monkeypatch, block, size, hot):
    monkeypatch.setattr(J, "FAMILY_BLOCK", block)
    monkeypatch.setattr(J, "BLOCK_BYTES", size)
    monkeypatch.setattr(J, "HOT_SHINGLE", hot)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=120)
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[: rng.randrange(85, 120)] + rng.choices(vocabulary, k=rng.randrange(30)))) for i in range(40)]
    rows += [(3000 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(40)]
    # Just at and just below the bound: 12 of 16 shingles shared, and 11 of 15.
    rows += [(4000, " ".join(f"a{i}" for i in range(20))), (4001, " ".join(f"a{i}" for i in range(16))), (4002, " ".join(f"b{i}" for i in range(19))), (4003, " ".join(f"b{i}" for i in range(15)))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_tree():
    import numpy as np

    rng, tree, sets = np.random.default_rng(1), J._Tree(), {}
    base = np.sort(rng.choice(10_000, 80, replace=False)).astype(np.uint64)
    for i in range(60):
        x = base[rng.random(80) > rng.random() * 0.3]
        sets[i] = np.unique(np.concatenate([x, rng.choice(10_000, rng.integers(0, 15)).astype(np.uint64)]))
        tree.add(i, sets[i])
    probes = [base, sets[7], sets[20], base[:3]]
    wanted = [(1 << 60) - 1, (1 << 60) - 1, 0b1010101010 << 20, 1 << 4]
    expected = []
    for i, probe in enumerate(probes):
        held = set(probe.tolist())
        expected += [(i, k) for k, x in sets.items() if wanted[i] >> k & 1 and 100 * len(held & set(x.tolist())) >= 75 * len(held | set(x.tolist()))]
    assert sorted(tree.similar(probes, wanted)) == expected and len(expected) > 40


def test_components(spark, rng):
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)]
    expected = roots({x for p in links for x in p if p[0] != p[1]}, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == expected and components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_edit_distance(rng):
    import numpy as np

    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item):
            new = [i + 1]
            for j, y in enumerate(text):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(50):
        item, text = ([rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        left, right = (np.array([x + [0] * (9 - len(x))], np.uint64) for x in (item, text))
        assert D.distances(left, np.array([len(item)]), right)[0][0] == plain(item, text + [0] * (9 - len(text)))


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_leaks(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r["doc_id"]: " " + " ".join(ITEM.findall(r["text"].lower())) + " " for r in docs.collect()}
    exact = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if " " + " ".join(ITEM.findall(r["text"].lower())) + " " in t}
    got = {(r["doc_id"], r["item_id"]): r for r in D.op8_decontamination(spark, sf).collect()}
    assert exact and exact <= set(got) and all(r["edits"] <= D.EDIT_SHARE * r["n_words"] for r in got.values())
    assert all(got[p]["edits"] == 0 for p in exact)


def test_recall_of_edited_leaks(spark, sf, rng):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    source = [r["text"].split() for r in items.orderBy("item_id").collect()]
    vocabulary = [w for t in source for w in t]
    rows, truth = [], set()
    for k in range(300):
        i = rng.randrange(len(source))
        words = list(source[i])
        for _ in range(int(0.2 * len(words))):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 0)] = [] if kind == 2 else [rng.choice(vocabulary)]
        rows.append((k, " ".join(["before"] * rng.randrange(40) + words + ["after"] * rng.randrange(40))))
        truth.add((k, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()}
    assert len(truth & got) / len(truth) >= 0.97


def all_pairs(docs, items):
    """The least edits of every (document, item) within the bound, by the whole computation for every pair."""
    import numpy as np

    number = {}
    coded = lambda t: [number.setdefault(w, len(number) + 1) for w in ITEM.findall((t or "").lower())]
    docs, items = ([(i, coded(t)) for i, t in rows] for rows in (docs, items))
    out = {}
    for d, text in docs:
        held = set(text)
        for i, item in items:
            # No text within the bound lacks more of the item's words than the bound has edits.
            if item and sum(w not in held for w in item) <= D.max_edits(len(item)):
                edits = int(D.distances(np.array([item], np.uint64), np.array([len(item)]), np.array([text + [0]], np.uint64))[0][0])
                if edits <= D.max_edits(len(item)):
                    out[d, i] = min(edits, out.get((d, i), 99))
    return out


def edited(rng, words, n, kind, vocabulary):
    words = list(words)
    for at in sorted(rng.sample(range(len(words)), n), reverse=True):
        do = rng.choice(("out", "in", "other")) if kind == "mixed" else kind
        words[at : at + (do != "in")] = [] if do == "out" else [rng.choice(vocabulary)]
    return words


def test_leaks_against_all_pairs(spark, sf, rng):
    source = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()][:40]
    vocabulary = [w for _, t in source for w in t.split()]
    short = [(900, "Zebra"), (901, "quiet zebra"), (902, "a b c"), (903, "one two three four"), (904, "zebra"), (905, "!!"), (906, None)]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(10, 60))
        if d % 3:
            _, text = rng.choice(source)
            item = text.split()
            words[5:5] = edited(rng, item, rng.randrange(0, len(item) // 3), "mixed", vocabulary)
        if d % 10 == 0:
            words[3:3] = rng.choice(["quiet ZEBRA", "zebra", "a b, c", "one two three", "one two three four", "one two x four"]).split()
        docs.append((d, " ".join(words)))
    items = source + short
    expected = all_pairs(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    of_short = lambda found: {p for p in found if p[1] >= 900}
    assert set(got) <= set(expected) and of_short(got) == of_short(expected) and all(got[p] == 0 for p in of_short(got))
    assert {p for p, e in expected.items() if e == 0} <= set(got) and len(expected) > 60
    assert len(got) / len(expected) >= 0.99 and all(got[p] >= expected[p] for p in got)


@pytest.mark.parametrize("kind", ["out", "in", "other", "mixed"])
def test_recall_at_the_bound(spark, rng, kind):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    source = [(r["item_id"], r["text"].split()) for r in items.orderBy("item_id").collect()]
    vocabulary = [w for _, t in source for w in t]
    rows, truth = [], set()
    for k in range(400):
        i, words = rng.choice(source)
        words = edited(rng, words, int(0.25 * len(words)), kind, vocabulary)
        rows.append((k, " ".join(rng.choices(vocabulary, k=rng.randrange(40)) + words + rng.choices(vocabulary, k=rng.randrange(40)))))
        truth.add((k, i))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert len(truth & got) / len(truth) >= 0.99


def test_leaks_by_row(spark, sf):
    source = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    miss = " ".join(w if i % 2 else "other" for i, w in enumerate(source[0].split()))
    rows = [(1, miss)] * 50 + [(1, source[0]), (1, source[1]), (None, source[0]), (None, "clean"), (2, miss), (3, None), (3, "")]
    items = spark.createDataFrame([(5, source[0]), (5, source[1]), (None, source[0])], "item_id long, text string")
    found = []
    for order in (rows, rows[::-1], rows[25:] + rows[:25]):
        docs = spark.createDataFrame(order, "doc_id long, text string").selectExpr("*", "'clash' as place", "0 as row_file", "0 as item_row")
        found.append(sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in D.find_leaks(docs.repartition(3), items).collect()), key=repr))
    assert found[0] == found[1] == found[2] == sorted([(1, 5, 0), (1, None, 0), (None, 5, 0), (None, None, 0)], key=repr)


def test_long_items_are_verified_in_bounded_pieces(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    items = [rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (3000, 40, 5, 4, 2, 700)]
    around = [np.concatenate([rng.integers(1, 1 << 62, 10).astype(np.uint64), np.delete(x, [0]) if len(x) > 4 else x]) for x in items]
    whole = D._verified(items, around)
    monkeypatch.setattr(D, "VERIFY_CELLS", 10)
    pieces = D._verified(items, around)
    assert list(whole[0]) == [1, 1, 1, 0, 0, 1] == list(pieces[0]) and list(whole[1]) == list(pieces[1])


def test_leaks_of_odd_tables(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "the same text twice over"), (4, "the same text twice over"), (5, "lorem ipsum dolor sit amet"), (6, "one"), (None, "words here")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in D.find_leaks(odd, items).collect()), key=repr)
    assert got == [(4, 5, 0), (6, 6, 0), (7, 4, 0), (None, None, 0)]
    assert D.find_leaks(odd.limit(0), items).isEmpty() and D.find_leaks(odd, items.limit(0)).isEmpty()


def stretch_edits(item, words, first):
    """The least edits between the item and a stretch that begins at this word."""
    row = list(range(len(words) - first + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words[first:], 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("kind", ["out", "in", "other", "mixed", "none"])
def test_places_of_leaks(spark, rng, kind):
    """first_word begins a stretch with the reported edits, however words were left out or put in."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    source = {r["item_id"]: re.findall("[a-z0-9\x80-\uffff]+", r["text"].lower()) for r in items.collect()}
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in source.items()], "item_id long, text string")
    plain = list(source.items())
    rows = []
    for k in range(60):
        _, words = plain[k % len(plain)]
        words = words if kind == "none" else edited(rng, words, int(0.2 * len(words)), kind, [f"new{i}" for i in range(50)])
        rows.append((k, [f"lead{rng.randrange(99)}" for _ in range(100)] + words + [f"tail{i}" for i in range(30)]))
    got = D.find_leaks(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string"), items).collect()
    words_of = dict(rows)
    assert len({r["doc_id"] for r in got}) >= 59
    for r in got:
        assert stretch_edits(source[r["item_id"]], words_of[r["doc_id"]], r["first_word"]) == r["edits"]
        assert kind != "none" or r["edits"] or r["first_word"] == 100
