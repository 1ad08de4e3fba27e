import hashlib
import re
import sys
import uuid
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as P
from pressmill.llm import language, mixture, secret_scan
from pressmill.llm.common import ROW_KEY, keyed, scratch_dir, stored, table
from pressmill.llm.mixture import Target

sys.path.insert(0, str(Path(__file__).parent))
import test_joins  # noqa: E402

COLUMNS = ["doc_id", "domain", "language", "source_name", "n_tokens", "epoch"]


def level(budget, children):
    """Water level by bisection: (weight, capacity) by name to amounts."""
    lo, hi = 0.0, max((c / w for w, c in children.values() if w), default=0)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, w * mid) for w, c in children.values()) < budget:
            lo = mid
        else:
            hi = mid
    return {k: min(c, w * hi) for k, (w, c) in children.items()}


def brute(rows, t):
    """rows: (doc_id, domain, language, source, tokens)."""
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[1:4]].append(r)
    have = {k: sum(r[4] for r in v) for k, v in leaves.items()}
    cap = {k: v * t.max_epochs * (t.sources.get(k[2], 1.0) > 0) for k, v in have.items()}
    cap2 = {k[:2]: sum(c for m, c in cap.items() if m[:2] == k[:2]) * (t.languages.get(k[1], 1.0) > 0) for k in have}
    cap1 = {k[0]: sum(c for m, c in cap2.items() if m[0] == k[0]) for k in have}
    top = level(t.share * sum(have.values()), {d: (t.domains.get(d, 1.0), c) for d, c in cap1.items()})
    out = []
    for d, b1 in top.items():
        for (_, lang), b2 in level(b1, {k: (t.languages.get(k[1], 1.0), c) for k, c in cap2.items() if k[0] == d}).items():
            for leaf, b3 in level(b2, {k: (t.sources.get(k[2], 1.0), c) for k, c in cap.items() if k[:2] == (d, lang)}).items():
                b3 += 1e-6  # the level is a little low
                whole, rest = int(b3 // have[leaf]), int(b3 % have[leaf])
                out += [(r[0], *leaf, r[4], e) for r in leaves[leaf] for e in range(whole)]
                at = lambda r: int(hashlib.md5(f"{t.seed}-{whole}-{r[0]}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
                total = 0
                for r in sorted(leaves[leaf], key=at):
                    total += r[4]
                    if total > rest:
                        break
                    out.append((r[0], *leaf, r[4], whole))
    return sorted(out)


@pytest.mark.parametrize("target", [mixture.TARGET, Target(share=0.9, max_epochs=2, domains={"domain0": 9.0, "domain1": 0.1}, sources={"src3": 0.0, "src4": 7.5}), Target(share=5.0, max_epochs=2), Target(share=0.0)])
def test_budgets(spark, sf, target):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in mixture.select(docs, target).collect())
    rows = [(r["doc_id"], f"domain{int(r['source'][3:]) % 4}", r["lang"], r["source"], max(1, (len(r["text"].encode()) + 3) // 4)) for r in docs.collect()]
    expected = brute(rows, target)
    assert got == expected
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.sql(mixture.oracle(target)).fetchall()) == got


def test_odd(spark, odd):
    rows = mixture.select(odd, Target(share=1.0, max_epochs=1)).collect()
    assert len(rows) == odd.count() and {r["domain"] for r in rows} <= {f"domain{i}" for i in range(4)} and {r["epoch"] for r in rows} == {0}
    assert mixture.select(odd.limit(0)).isEmpty()


def plainly_accepted(model, text):
    """Whether a text is accepted, by plain compression with every dictionary."""
    import zstandard

    if text is None or not any(c.isalpha() for c in text):
        return False

    def share(level):
        data = f" {text.lower()} ".encode()
        n = -(-len(data) // language.PIECE_BYTES)
        sizes = []
        for _, dictionary in model.dictionaries:
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=max(len(d) for _, d in model.dictionaries), write_content_size=0, write_checksum=0, write_dict_id=0)
            made = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes.append(sum(len(made.compress(data[len(data) * i // n : len(data) * (i + 1) // n])) for i in range(n)))
        best, second = sorted(sizes)[:2]
        return (second - best) / second

    first = share(model.level)
    return (share(model.recheck_level) if first < model.recheck else first) >= model.margin


def plainly_redacted(text):
    """A text without its secrets, by regular expressions and a look at every pair of parts."""
    if text is None:
        return None
    parts = []
    for k, (name, pattern) in enumerate(secret_scan.KINDS):
        pattern = re.compile(pattern.replace("(?<![A-Za-z0-9+/_.-]|==)", "(?<![A-Za-z0-9+/_.-])(?<!==)"), re.A)
        parts += [(m.start(), m.end(), name) for m in pattern.finditer(text) if k or len(m[1]) >= secret_scan.LEAST_VALUE]
    near = lambda x, names: [y for y in parts if y[2] in names and (0 <= y[0] - x[1] <= secret_scan.LINK_CHARS or 0 <= x[0] - y[1] <= secret_scan.LINK_CHARS)]
    strong = [k for k, _ in secret_scan.STRONG]
    kept = [x for x in parts if x[2] in strong]
    kept += [x for x in parts if x[2] == "id" and near(x, secret_scan.SECRETS)] + [x for x in parts if x[2] == "key" and near(x, secret_scan.IDS)]
    kept += [x for x in parts if x[2] == "url" and near(x, secret_scan.SECRETS) and any(near(y, secret_scan.SECRETS) for y in near(x, secret_scan.IDS))]
    out, end = [], 0
    for a, b, _ in sorted(kept):
        if a >= end:
            out += [text[end:a], secret_scan.MARK]
        end = max(end, b)
    return "".join([*out, text[end:]])


def test_pipeline(spark, sf):
    """Each stage against a plain form of it, row by row."""
    docs = table(spark, sf, "documents")
    again = docs.where("doc_id < 10").selectExpr("doc_id + 10000 as doc_id", "concat('token = abcdefgh1234 client_id=abc12345 ', substring(text, 1, length(text) div 2)) as text", "lang", "source", "n_chars")
    docs = docs.unionByName(again)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    columns, names = docs.columns, []
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, sf))
        names.append(name)
        before, after = ({r["doc_id"]: r for r in df.collect()} for df in (docs, out))
        gone = set(before) - set(after)
        if name != "mixture":
            assert out.columns == columns and out.count() == len(after)
        if name == "language":
            model = language.fit(language.training_rows(docs))
            assert gone == {i for i, r in before.items() if not plainly_accepted(model, r["text"])}
            assert len(gone) <= 0.03 * len(before)
        if name == "near_duplicates":
            groups = test_joins.brute([(i, r["text"]) for i, r in before.items()])
            assert gone == {i for i, (_, group) in groups.items() if group != i} and gone
        if name == "decontamination":
            assert gone == {d for d, _ in test_joins.all_pairs([(i, r["text"]) for i, r in before.items()], items)} and gone
        if name == "secrets":
            assert not gone and {i: r["text"] for i, r in after.items()} == {i: plainly_redacted(r["text"]) for i, r in before.items()}
            assert all(len(r["text"]) == r["n_chars"] for r in after.values()) and any(secret_scan.MARK in r["text"] for r in after.values())
        if name == "mixture":
            rows = [(r["doc_id"], f"domain{int(r['source'][3:]) % 4}", r["lang"], r["source"], max(1, (len(r["text"].encode()) + 3) // 4)) for r in before.values()]
            assert sorted(tuple(r[c] for c in COLUMNS) for r in out.collect()) == brute(rows, mixture.TARGET)
        docs = out
    assert names == ["language", "near_duplicates", "decontamination", "secrets", "mixture"]
    assert 0 < P.run(spark, sf).count()


def test_stages_decide_on_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_file string"
    copy, other = " ".join(f"word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))
    rows = [(1, copy), (1, copy), (None, copy), (None, copy), (2, copy), (1, other), (None, None), (None, ""), (3, None)]
    docs = spark.createDataFrame([(*r, "en", "src1", 0, "clash") for r in rows], schema)
    kept = sorted(((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, sf).collect()), key=repr)
    assert kept == sorted([(1, copy), (1, other), (None, None), (None, ""), (3, None)], key=repr)
    assert {r["row_file"] for r in P.drop_near_duplicates(spark, docs, sf).collect()} == {"clash"}
    only = docs.where("doc_id is null and text <> ''")
    assert P.drop_near_duplicates(spark, only, sf).count() == 1
    item = table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    rows = [(1, item), (1, "clean text"), (None, f"before {item} after"), (None, "clean too"), (2, None)]
    docs = spark.createDataFrame([(*r, "en", "src1", 0, "clash") for r in rows], schema)
    kept = sorted(((r["doc_id"], r["text"]) for r in P.drop_benchmark_leaks(spark, docs, sf).collect()), key=repr)
    assert kept == sorted([(1, "clean text"), (None, "clean too"), (2, None)], key=repr)
    # Rows of a file: the key is the file and the place in it.
    path = f"{scratch_dir(spark)}/rows-{uuid.uuid4().hex}"
    docs.repartition(3).write.parquet(path)
    read = keyed(spark.read.parquet(path))
    assert read.select(*ROW_KEY).distinct().count() == len(rows) and "ExistingRDD" not in read._jdf.queryExecution().executedPlan().toString()
    assert P.drop_benchmark_leaks(spark, spark.read.parquet(path), sf).count() == 3


def test_ties_of_one_id_are_taken_together(spark):
    rows = [(i // 2, "word " * (5 + i % 7), "en", "src1") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share in (0.2, 0.5, 0.8):
        got = Counter(r["doc_id"] for r in mixture.select(docs, Target(share=share, max_epochs=1)).collect())
        assert set(got.values()) <= {2} and 0 < len(got) < 30


def test_pipeline_of_odd_documents(spark, odd, sf):
    docs = odd
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, sf))
        assert name == "mixture" or docs.columns == odd.columns
    empty = odd.limit(0)
    for _, stage in P.STAGES:
        empty = stored(stage(spark, empty, sf))
    assert empty.isEmpty()
