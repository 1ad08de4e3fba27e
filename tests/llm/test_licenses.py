from pressmill.llm import licenses as L


def brute(text):
    words, starts, labels = L.phrase_words(text or ""), [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(docs):
    rows = sorted(((r["doc_id"] is None, r["doc_id"], *brute(r["text"])) for r in docs.select("doc_id", "text").collect()), key=repr)
    got = L.scan(docs).collect()
    assert sorted(((r["doc_id"] is None, *r[:6]) for r in got), key=repr) == rows
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    return {r["doc_id"]: r for r in got}


def test_base(spark, sf, odd):
    check(odd)
    check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert L.scan(odd.limit(0)).isEmpty()


def test_phrases(spark):
    texts = ["cc by cc-by MIT License", "mit  LICENSE apache\nlicense", "gnu general public licence", "the GNU General Public License gnu general public license", "émit license", "cc bycc by", "cc"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_notices(spark, rng):
    notice, label = L.NOTICES[5]
    words = notice.split()
    edited = words[:7] + ["really", "well"] + words[7:12] + words[13:]
    texts = [f"intro {notice} outro", " ".join(edited), " ".join(words[:4]), " ".join(rng.sample(words, len(words)))]
    got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [got[i]["labels"] for i in range(4)] == [label, label, "", ""] and got[0]["score"] == 1.0 and 0.5 <= got[1]["score"] < 1


def test_runs_must_differ_and_be_in_order(spark, rng):
    texts = []
    for notice, _ in L.NOTICES:
        words = notice.split()
        for at in range(0, len(words) - 5, 3):
            texts.append(" ".join(words[at : at + 5] * 14))
        texts.append(" ".join(reversed(words)))
        # The same runs in another order.
        runs = [words[i : i + 5] for i in range(0, len(words), 5)]
        texts.append(" ".join(w for r in reversed(runs) for w in r))
    got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(set(r["labels"].split(",")) - {""} <= set(r["base_labels"].split(",")) for r in got.values())


def test_every_notice_is_found_in_other_words(spark):
    rows, truth = [], []
    for i, (notice, label) in enumerate(L.NOTICES):
        words = notice.split()
        rows.append((2 * i, "Some words. " + notice.upper() + "; and more"))
        # A word put in and one left out, far from each other, keep more than half of the runs in order.
        rows.append((2 * i + 1, " ".join([*words[: len(words) // 3], "dear", *words[len(words) // 3 : -5], *words[-4 - (len(words) < 25) :]])))
        truth += [label, label]
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(truth[i] in got[i]["labels"].split(",") for i in got) and all(got[2 * i]["score"] == 1.0 for i in range(len(L.NOTICES)))
