import hashlib
from collections import Counter

from pyspark.sql import functions as F

from pressmill.llm import line_dedup
from pressmill.llm.common import Steps, table

WHITE = " \t\n\v\f\r"


def key_of(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(WHITE))


def by_rule(texts, min_docs, min_chars=1):
    """For each text: lines, dropped lines and the text that is left."""
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for lines in split for k in {key_of(x) for x in lines} if len(k) >= min_chars)
    out = []
    for lines in split:
        kept = [x for x in lines if not (len(key_of(x)) >= min_chars and seen[key_of(x)] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_query_follows_the_rule(spark, sf):
    texts = dict(table(spark, sf, "documents").select("doc_id", "text").collect())
    wanted = dict(zip(texts, by_rule(texts.values(), 10), strict=True))
    rows = line_dedup.op12_line_dedup(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, dropped, kept = wanted[r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r["n_dropped"] for r in rows)


def test_thresholds_over_odd_lines(spark, rng):
    pool = ["menu", " Menu\t", "MENU", "", " ", "\r", "É", "é", "a b", "a  b", " menu", "漢字", "x" * 3000, "one", "two", "<b>", "\\n"]
    texts = ["\n".join(rng.choice(pool + [f"own {rng.random()}"]) for _ in range(rng.randrange(0, 9))) for _ in range(120)] + [None, "", "\n", "menu", "menu\n" * 500]
    docs = spark.createDataFrame([(i // 2, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string, kept string").withColumn("at", F.monotonically_increasing_id())
    for min_docs, min_chars, batches, fanout in ((1, 1, 1, 2), (2, 1, 5, 2), (10, 1, 7, 3), (10, 5, 3, 2), (40, 0, 4, 9)):
        rows = line_dedup.drop_frequent(docs, min_docs, min_chars, batches, fanout, keep=("at", "kept", "doc_id")).orderBy("at").collect()
        assert [(r["n_lines"], r["n_dropped"], r["kept"]) for r in rows] == by_rule(texts, min_docs, min_chars)


def test_odd_rows(odd):
    rows = line_dedup.drop_frequent(odd, 2, keep=("doc_id", "text")).collect()
    texts = [r["text"] for r in rows]
    assert len(rows) == odd.count()
    assert [(r["n_lines"], r["n_dropped"], r["kept"]) for r in rows] == by_rule(texts, 2)


def test_empty_table(spark):
    assert line_dedup.drop_frequent(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_keys_are_spread(spark, monkeypatch):
    texts = [f"hot\nrare {i}\npair {i // 2}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for share in (2, 10**9):  # few keys are hot; every key is
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        rows = line_dedup.drop_frequent(docs, 2).orderBy("doc_id").collect()
        assert [(r["n_lines"], r["n_dropped"], r["kept"]) for r in rows] == by_rule(texts, 2)


def test_runs_are_levelled_sorted_and_settled(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    batches = [["a", "a", "a", "b"], ["a", "b", "c"], ["a", "b", "c"], ["c", "d"], ["d"]]
    sizes = []
    for batch in batches:
        keys = spark.createDataFrame([(k,) for k in batch], "key string")
        runs.add(keys.select(*line_dedup.key_hash(F.col("key"))))
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    hashes = {spark.createDataFrame([(k,)], "key string").select(*line_dedup.key_hash(F.col("key"))).first(): k for k in "abcd"}
    # a was settled by the first batch and isn't counted again; d has been seen twice.
    assert {hashes[r["hi"], r["lo"]]: r["n"] for r in runs.frequent().collect()} == {"a": 3, "b": 3, "c": 3}
    for run in runs.runs():
        parts = run.select("hi", "lo").withColumn("file", F.input_file_name()).collect()
        for file in {r["file"] for r in parts}:
            keys = [(r["hi"], r["lo"]) for r in parts if r["file"] == file]
            assert keys == sorted(keys)


def test_no_python_in_the_plans(spark, sf, monkeypatch):
    plans = []
    store = Steps.store

    def spy(self, df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(self, df, *args, **kw)

    monkeypatch.setattr(Steps, "store", spy)
    made = line_dedup.op12_line_dedup(spark, sf)
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8
    assert not any(word in plan for plan in plans for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))
    # A batch merges with the runs; the only broadcast table is that of hot keys, or of few places.
    assert any("SortMergeJoin" in plan and "LeftAnti" in plan for plan in plans)
