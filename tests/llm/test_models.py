import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import ann, language, quality


def test_language(spark, odd):
    got = language.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all() and len(got) > 200
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(language.training_rows(docs))
    assert [x for x, _ in model.dictionaries] and set(dict(model.dictionaries)) <= {"en", "de", "fr", "es"}
    rows = language.identify(odd, model, keep=("doc_id", "score")).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == {"doc_id", "lang_pred", "score", "accepted"}
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and not by[i]["accepted"] and by[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert language.accepted_only(odd, model).columns == odd.columns and language.identify(odd.limit(0), model).isEmpty()
    nothing = language.fit(odd.where("doc_id = 1"))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


def test_every_part_of_a_long_text_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'fr')")
    sizer = language._Sizer(language.fit(language.training_rows(docs)))
    prose = {k: " ".join(r["text"] for r in docs.where(docs.lang == k).orderBy("doc_id").select("text").collect() if r["text"]) for k in ("en", "fr")}
    text = {k: (v * (1 + 1_000_000 // len(v)))[:1_000_000] for k, v in prose.items()}
    for first, main in (("fr", "en"), ("en", "fr")):
        name, _, accepted = sizer.predict(text[first][:130_000] + " " + text[main])
        assert (name, accepted) == (main, True)
    for k, v in text.items():
        name, score, accepted = sizer.predict(v)
        assert (name, accepted) == (k, True) and score > 0.5 * sizer.predict(v[:30_000])[1]


def test_languages_are_all_learned_within_the_bound(spark):
    words = {f"x{i:02}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in ("alo", "beri", "condu", "dask", "ento")] for i in range(70)}
    rows = [(i, " ".join(w[(i + j) % 5] for j in range(60)), k) for i in range(6) for k, w in words.items()]
    # One id on many rows, and one long text, take no more than their share.
    rows += [(1000, " ".join(words["x00"] * 40), "x00")] * 500 + [(1001, "zz " * 50_000, "x01")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(train, docs_per_language=8, dictionary_bytes=4096)
    assert len(model.dictionaries) == 70 and all(len(d) <= 4096 for _, d in model.dictionaries) and model.dictionaries[0][0] == "x00"
    assert dict(model.dictionaries)["x01"].count(b"zz") < 1100
    assert sum(len(d) for _, d in language.fit(train, model_bytes=20_000).dictionaries) <= 20_000
    docs = spark.createDataFrame([(i, " ".join(w[:3] * 9)) for i, w in enumerate(words.values())], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert [got[i] for i in range(70)] == list(words)


def test_mixed_texts_are_rejected_before_clean_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    sizer = language._Sizer(language.fit(language.training_rows(docs)))
    by = {k: [r["text"] for r in docs.where(docs.lang == k).orderBy("doc_id").limit(60).collect()] for k in ("en", "fr", "de", "es")}
    clean = [sizer.predict(t)[2] for k in by for t in by[k]]
    mixed = [sizer.predict(f"{a[:400]} {b[:400]}") for a, b in zip(by["en"], by["fr"], strict=True)]
    assert sum(clean) >= 0.99 * len(clean) and sum(1 for x in mixed if x[1] < 0.1) > 0 and sizer.predict("zq xw")[1] <= 1.0
    # Equal sizes are a tie: the language with the most texts, without a margin.
    tie = language._Sizer(language.LanguageModel((("aa", b"one two three"), ("bb", b"one two three"))))
    assert tie.predict("one two three four") == ("aa", 0.0, False)


def test_quality_bound_holds_for_repeated_ids(spark, monkeypatch):
    rows = [(1, f"text {i % 7} of one id " * (1 + i % 3), i % 2) for i in range(3000)] + [(i, f"other {i}", i % 2) for i in range(2, 11)]
    seen = []
    fit_arrays = quality.fit_arrays
    monkeypatch.setattr(quality, "fit_arrays", lambda x, y, names: seen.append((x.copy(), y.copy())) or fit_arrays(x, y, names))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    quality.fit(labelled, max_rows=10)
    quality.fit(labelled.repartition(7).orderBy(F.desc("text")), max_rows=10)
    assert all(len(y) == 10 for _, y in seen) and np.array_equal(seen[0][0], seen[1][0]) and np.array_equal(seen[0][1], seen[1][1])


def plain_statistics(text):
    """The statistics by loops over characters."""
    t = text or ""
    n, tokens, lines = max(len(t), 1), re.split("[ \n]", t), t.split("\n")
    count = lambda kept: sum(1 for c in t if kept(c)) / n
    runs, inside = 0, 0
    for c in t + " ":
        inside = inside + 1 if c in "#*$%&!?" else 0 * (runs := runs + (inside >= 2))
    return {
        "log_chars": math.log1p(len(t)), "token_length": n / len(tokens), "line_length": math.log1p(n / len(lines)), "distinct_tokens": len(set(tokens)) / len(tokens),
        "distinct_lines": len(set(lines)) / len(lines), "symbols": count(lambda c: c in "#*$%&|~^_=+<>{}[]\\@"), "marks": count(lambda c: c in "!?"), "stops": count(lambda c: c in ".,;:"),
        "digits": count(lambda c: c in "0123456789"), "capitals": count(lambda c: unicodedata.category(c) == "Lu"), "quotes": count(lambda c: c in "\"'()"), "symbol_runs": runs / len(tokens), "bars": count(lambda c: c == "|"),
    }


def test_quality_scores_against_loops(spark, odd):
    """Every score of a table, by the rules read one by one."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs.join(labels, "doc_id").select("doc_id", "text", "quality"))
    assert model.rules
    for table in (docs, odd):
        texts = [(r["doc_id"], r["text"]) for r in table.collect()]
        expected = []
        for i, t in texts:
            x = plain_statistics(t)
            z = model.intercept + sum(r.weight for r in model.rules if all((x[name] > cut) == above for name, above, cut in r.conditions))
            expected.append((i, round(1 / (1 + math.exp(-z)), 9)))
        got = [(r["doc_id"], round(r["score"], 9)) for r in quality.score(table, model).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_quality(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = quality.op2_quality_rules(spark, sf)
    assert got.count() == 1000
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs.join(labels, "doc_id").select("doc_id", "text", "quality"))
    assert model.rules and all(r.conditions for r in model.rules)
    out = quality.score(odd, model, keep=("doc_id", "labels", "score"))
    assert out.columns == ["doc_id", "labels", "score", "predicted"] and out.count() == odd.count()
    assert out.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()
    assert quality.score(odd.limit(0), model).isEmpty()


def test_quality_with_poor_labels(spark):
    rows = [(1, "a", 1), (1, "a", 1), (2, None, 1), (3, "b", None), (4, "c", 7)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    assert model.rules == () and 0.5 < 1 / (1 + np.exp(-model.intercept)) < 1


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, size=(1500, 1))
    x[100:400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(20, x[20].tolist()), (None, x[0].tolist()), (9000, None), (9020, [0.0] * 16), (9001, [float("nan")] * 16), (9002, [None] * 16), (9003, [1.0]), (9004, [float("inf")] * 16)]
    vectors = spark.createDataFrame(rows + odd, "id long, vector array<double>")
    got = ann.search(vectors, lambda i: i % 20 == 0, block_rows=400, query_rows=30).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        found = found.sort_values("rank")
        scores = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        hits += len(set(best) & set(found["vec_id"]))
        assert list(found["rank"]) == list(range(1, 21)) and np.array_equal(found["score"], [(x[i] * x[q]).sum() for i in found["vec_id"]])
        assert list(found["vec_id"]) == sorted(found["vec_id"], key=lambda i: (-scores[i], i))
    assert got["query_id"].nunique() == 75 and hits / (75 * 20) >= 0.9
    assert ann.search(vectors.withColumn("dim", F.lit("clash")).withColumn("block", F.lit(0)), lambda i: i % 20 == 0).count() == 75 * 20
    # A second dimension is searched on its own.
    plane = spark.createDataFrame([(20_000 + i, [float(i), 1.0]) for i in range(1, 31)] + [(20_000, [1.0, 0.0])], "id long, vector array<double>")
    both = ann.search(vectors.unionByName(plane), lambda i: i % 20 == 0).toPandas()
    assert list(both[both["query_id"] == 20_000].sort_values("rank")["vec_id"]) == [20_030 - i for i in range(20)] and both["query_id"].nunique() == 77
    few = ann.search(vectors.where("id in (20, 40, 41)"), lambda i: i % 20 == 0)
    assert sorted((r["query_id"], r["vec_id"]) for r in few.collect()) == [(20, 40), (20, 41), (40, 20), (40, 41)]
    assert ann.search(vectors.limit(0), lambda i: i % 20 == 0).isEmpty()


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(4).normal(size=(800, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.train(x, codebooks=4, words=32)
    error = {}
    for beam in (1, 8):
        codes, norms = ann.AdditiveQuantiser(model.books, beam).encode(x)
        decoded = sum(model.books[m][codes[:, m]] for m in range(4))
        assert np.allclose(np.linalg.norm(decoded, axis=1), norms, atol=1e-4)
        error[beam] = ((x - decoded) ** 2).sum(1).mean()
    assert error[8] <= error[1] < 0.8


def test_recall_of_the_query(spark):
    """All queries of a table of 10,000 vectors against the whole computation."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float64)
    got = ann.op7_additive_quantisation(spark, sf).toPandas()
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        order = np.lexsort((ids, -scores))
        best = [ids[j] for j in order if j != i][:20]
        hits += len(set(best) & set(got.loc[got["query_id"] == ids[i], "vec_id"]))
    assert len(got) == 20 * (ids % 20 == 0).sum() and hits / len(got) >= 0.97


def test_ann_query(spark, sf):
    got = ann.op7_additive_quantisation(spark, sf)
    assert got.count() == 25 * 20 and got.where(F.col("query_id") == F.col("vec_id")).isEmpty()


@pytest.mark.parametrize("repeated", [20, 7])
def test_ids_count_once_before_the_shortlist_is_cut(spark, repeated):
    """300 rows of one id, of a query or not, and of different vectors: every query has its 20 nearest ids."""
    rng = np.random.default_rng(repeated)
    rows = [(i, rng.normal(size=8)) for i in range(200)] + [(repeated, rng.normal(size=8)) for _ in range(300)] + [(40, rng.normal(size=8)) for _ in range(3)]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "id long, vector array<double>")
    for block_rows, query_rows in ((16_384, 512), (100, 4)):
        got = ann.search(vectors, lambda i: i % 20 == 0, block_rows=block_rows, query_rows=query_rows, shortlist=200).toPandas()
        for q in range(0, 200, 20):
            scores = {}
            for i, x in rows:
                for j, y in rows:
                    if j == q and i != q:
                        scores[i] = max(scores.get(i, -np.inf), float(x @ y))
            wanted = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:20]
            own = got[got["query_id"] == q].sort_values("rank")
            assert own["vec_id"].tolist() == [i for i, _ in wanted] and np.allclose(own["score"], [s for _, s in wanted])
    few = ann.search(vectors, lambda i: i % 20 == 0, shortlist=96).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in few} == dict.fromkeys(range(0, 200, 20), 20)


@pytest.mark.parametrize("rows", ["even", "unseen groups", "lengths", "signs"])
def test_no_neighbour_is_lost_where_codes_fit_badly(spark, rows):
    """Vectors that codebooks describe badly: without structure, in groups outside the sample, of any length, with ties."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 96))
    if rows == "unseen groups":
        x[:1500] = rng.normal(size=(10, 96))[rng.integers(0, 10, 1500)] + 0.01 * rng.normal(size=(1500, 96))
    elif rows == "lengths":
        x *= 10.0 ** rng.uniform(-160, 140, size=(4000, 1))
    elif rows == "signs":
        x = np.sign(x)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = ann.search(vectors, lambda i: i % 20 == 0, train_rows=512, block_rows=1500, query_rows=150).toPandas().sort_values("rank")
    found = {q: own for q, own in got.groupby("query_id")}
    for q in range(0, 4000, 20):
        scores = (x * x[q]).sum(1)
        wanted = [i for i in np.lexsort((np.arange(4000), -scores)) if i != q][:20]
        assert found[q]["vec_id"].tolist() == wanted and np.array_equal(found[q]["score"], scores[wanted])


def test_bounds_hold_and_exclude():
    """Scores by code are off by the bound at most; where codes fit, bounds leave few vectors to check."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] * rng.uniform(0.1, 9, size=(3000, 1)) + 0.05 * rng.normal(size=(3000, 32))
    model = ann.train(x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True), codebooks=6, words=64)
    codes, factor, bound, fine, fine_factor, fine_bound = model.bounded(x)
    q = x[::20] / np.linalg.norm(x[::20], axis=1, keepdims=True)
    exact = q @ x.T
    rough = sum(model.tables(q.astype(np.float32))[:, m].take(codes[:, m], axis=1) for m in range(6)) * factor
    finer = rough + sum(model.fine_tables(q.astype(np.float32))[:, m].take(fine[:, m], axis=1) for m in range(16)) * fine_factor
    for scores, off, left in ((rough, bound, 0.1), (finer, fine_bound, 0.02)):
        assert (np.abs(scores - exact) <= off).all()
        assert (scores + off >= np.sort(exact, axis=1)[:, -20:][:, :1]).mean() < left
