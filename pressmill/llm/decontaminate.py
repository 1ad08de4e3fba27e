"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words in lower case. Windows of about an item's length are embedded by random walks (CGK): a walk reads a word
at each step and moves on by a random bit of word and step, so that a small edit distance becomes a small Hamming
distance of what two walks read. Each repetition samples SAMPLED steps of a walk; a window and an item that agree in all
sampled words of a repetition are a candidate pair. Pairs are verified by the exact edit distance between the item and
any stretch of the window's surroundings.

A window is embedded only if it holds as many word pairs of items of its own length as the q-gram lemma asks of any text
within the edit bound, so this loses no match. A table of fixed largest size answers for a pair of words in which lengths
of items it occurs, with false alarms but no misses. Of windows that start within a twentieth of their length of each
other the one that holds most pairs is embedded. The number of repetitions follows from the target recall and the share of
steps on which walks agree at the edit bound, as measured with such windows for the kind of edit that upsets walks most.

Items of fewer than MIN_WORDS words have no edit bound: they match where their words stand consecutively, found by the
hash of the run.

Every row of the documents is a key of its own, so rows with one id, or with none, are searched and verified each.

Bounds: the table has at most 2**MAX_BITS entries of 64 bits; items are broadcast only if they are measured to be at most
BROADCAST_ITEMS, and are else joined by shuffle; pairs are verified VERIFY_CELLS words of surroundings at a time.

Defined results: null items and items without words are not searched; null and empty documents match nothing; a pair of
document id and item id is reported once, at its best place, whichever rows have these ids; extra columns are ignored;
rows with a null id are reported under null; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import ROW_KEY, Steps, keyed, map_arrow, table

MIN_WORDS = 5
#: A stretch matches an item of n words within this share of n edits (words put in, left out or replaced).
EDIT_SHARE = 0.25
#: Lengths of windows grow by this factor.
LADDER = 1.1
SAMPLED = 2
#: Repetitions that sample the same walk.
PER_WALK = 3
TARGET_RECALL = 0.99
#: Share of steps on which the walks of a text and of an edited copy agree: about 0.33 where a quarter of the words is left
#: out, and more for other edits; a little less is taken.
AGREEMENT = 0.29
MAX_BITS = 22
BROADCAST_ITEMS = 20_000
VERIFY_CELLS = 1 << 19


def repetitions(target: float = TARGET_RECALL, agreement: float = AGREEMENT) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - agreement**SAMPLED))


def max_edits(n_words):
    n_words = np.asarray(n_words)
    return np.where(n_words < MIN_WORDS, 0, np.floor(EDIT_SHARE * n_words)).astype(int)


def ladder(n_words: int) -> int:
    """The window length for items of so many words: the largest rung up to it, or all of a shorter item."""
    if n_words < MIN_WORDS:
        return n_words
    rung = MIN_WORDS
    while (step := max(rung + 1, int(rung * LADDER))) <= n_words:
        rung = step
    return rung


def embed(rows: np.ndarray, rung: int, n_repetitions: int) -> np.ndarray:
    """Signatures (row, repetition) of sequences of word hashes, padded by 0 on the right."""
    n, width = rows.shape
    padded = np.concatenate([rows, np.zeros((n, 1), np.uint64)], 1)
    steps = 3 * rung
    out = np.empty((n, n_repetitions), np.uint64)
    every = np.arange(n)
    for walk in range(0, n_repetitions, PER_WALK):
        rng = np.random.default_rng(1000 + walk)
        salts = rng.integers(1, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Walks move on by one on every second step: 2 * rung steps keep them inside the text. Every other walk is sampled in
        # its first half, where edits have not upset it much yet.
        sampled = rung * (1 + walk // PER_WALK % 2)
        chosen = [rng.choice(sampled, SAMPLED, replace=False).tolist() for _ in range(walk, min(walk + PER_WALK, n_repetitions))]
        last = max(max(c) for c in chosen)
        at = np.zeros(n, np.int64)
        signatures = [np.full(n, np.uint64((walk + i) * 65_537 + rung)) for i in range(len(chosen))]
        for j in range(last + 1):
            word = padded[every, np.minimum(at, width)]
            for i, c in enumerate(chosen):
                if j in c:
                    with np.errstate(over="ignore"):
                        signatures[i] = signatures[i] * words.PLACES[1] + word
            # Hashes of words are mixed already: the top bit of a product with an odd number is as good as random.
            with np.errstate(over="ignore"):
                at += ((word * salts[j]) >> np.uint64(63)).astype(np.int64)
        for i, signature in enumerate(signatures):
            out[:, walk + i] = words.mix(signature)
    return out


def distances(items: np.ndarray, lengths: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the least edit distance between the item and a stretch of around, and where the best one ends.

    items is padded on the right (lengths has the true lengths); around is padded by 0.
    """
    n, m = around.shape
    columns = np.arange(m + 1)
    row = np.zeros((n, m + 1), np.int64)
    final = row.copy()
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (around != items[:, i : i + 1]), out=new[:, 1:])
        new = np.minimum.accumulate(new - columns, axis=1) + columns
        row = new
        final = np.where((lengths == i + 1)[:, None], row, final)
    return final.min(1), final.argmin(1)


def _items(texts: DataFrame, key: str) -> DataFrame:
    """key, the words' hashes as bytes, their number, the window length and the number of pairs of words that occurred
    before in the item. Items without words are left out."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in words.chunks(batch.column("text"), words.LETTER_DIGIT):
                rows = [found.hashes[a:b] for a, b in zip(found.first, found.first[1:], strict=False)]
                pairs = [words.grams(x, 2) for x in rows]
                repeated = pa.array([len(x) - len(np.unique(x)) for x in pairs], pa.int64())
                columns = [batch.column(key).slice(at, len(found)), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(np.diff(found.first)), pa.array([ladder(len(x)) for x in rows], pa.int32()), repeated]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "item_words", "n_item_words", "rung", "n_repeated"])

    return map_arrow(texts.select(key, "text"), run, f"{key} {kind}, item_words binary, n_item_words long, rung int, n_repeated long").where("n_item_words > 0")


def _bit(rung: int) -> np.uint64:
    """The bit of a window length; lengths far apart may share one, which only lets more windows through."""
    if rung < MIN_WORDS:
        return np.uint64(1) << np.uint64(64 - rung)
    return np.uint64(1) << np.uint64(round(math.log(rung / MIN_WORDS, LADDER)) % (65 - MIN_WORDS))


def _pair_table(items: DataFrame, bits: int) -> np.ndarray:
    """For each slot that a pair of neighbouring words falls in, the bits of the lengths of items that hold the pair.

    A short item has the one slot of all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, marks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for x, rung in zip(batch.column("item_words"), batch.column("rung").to_pylist(), strict=True):
                found = words.grams(np.frombuffer(x.as_py(), np.uint64), 2 if rung >= MIN_WORDS else rung)
                slots.append(np.unique(found >> np.uint64(64 - bits)).astype(np.int64))
                marks.append(np.full(len(slots[-1]), _bit(rung)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots)), pa.array(np.concatenate(marks).view(np.int64))], names=["slot", "bits"])

    whole = np.zeros(1 << bits, np.uint64)
    found = map_arrow(items.select("item_words", "rung"), run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    whole[found["slot"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return whole


def _windows(docs: DataFrame, rungs: dict[int, tuple[int, int]], pair_table: np.ndarray, bits: int, n_repetitions: int) -> DataFrame:
    """The row key, doc_id, place, rung, around (words about a window, as bytes) and its signatures.

    rungs: the longest item of each, and how many of an item's pairs may be repeats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pair_table)
    least = {c: c - 1 - 2 * int(max_edits(longest)) for c, (longest, _) in rungs.items() if c >= MIN_WORDS}
    short = [c for c in rungs if c < MIN_WORDS]

    def runs_of_chunk(found: words.Words) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """The first place of every run of words that may be a short item, in each row."""
        for c in short:
            runs = words.grams(found.hashes, c)
            starts = np.flatnonzero(shared.value[(runs >> np.uint64(64 - bits)).astype(np.int64)] & _bit(c))
            doc = np.searchsorted(found.first, starts, side="right") - 1
            inside = starts + c <= found.first[doc + 1]
            starts, doc = starts[inside], doc[inside]
            _, once = np.unique(np.stack([doc.astype(np.uint64), runs[starts]]), axis=1, return_index=True)
            for i in once:
                yield int(doc[i]), int(starts[i] - found.first[doc[i]]), c, found.hashes[starts[i] : starts[i] + c], runs[starts[i] : starts[i] + 1]

    def of_chunk(found: words.Words) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        n = len(found.hashes)
        if n < 2:
            return
        slots = words.grams(found.hashes, 2) >> np.uint64(64 - bits)
        of_lengths = shared.value[slots.astype(np.int64)]
        last = found.first[1:] - 1
        of_lengths[last[(last >= 0) & (last < n - 1)]] = 0
        known, none = np.flatnonzero(of_lengths), np.uint64((1 << 64) - 1)
        of_known = of_lengths[known]
        for c, at_least in least.items():
            # Where at_least pairs stand within one window of the same document.
            hits = known[(of_known & _bit(c)) != 0]
            t = max(1, at_least)
            if len(hits) < t:
                continue
            left, right = hits[: len(hits) - t + 1], hits[t - 1 :]
            near = np.flatnonzero(right - left <= c - 2)
            if not len(near):
                continue
            left, right = left[near], right[near]
            doc = np.searchsorted(found.first, left, side="right") - 1
            same = right < found.first[doc + 1]
            left, right, doc = left[same], right[same], doc[same]
            if not len(left):
                continue
            # All starts of windows that cover such a run, each once: before the first pair may be words that edits cut off.
            lo = np.maximum(found.first[doc], right - c + 2)
            size = left - lo + 1
            starts = np.unique(np.repeat(left - np.cumsum(size) + 1, size) + np.arange(size.sum()))
            held = np.searchsorted(hits, starts + c - 1) - np.searchsorted(hits, starts)
            doc_end = found.first[np.searchsorted(found.first, starts, side="right")]
            # Of near starts the one that holds most.
            stride = max(1, c // 20)
            group = np.flatnonzero(np.concatenate([[True], (starts[1:] // stride != starts[:-1] // stride) | (doc_end[1:] != doc_end[:-1])]))
            best = np.maximum.reduceat(held, group)
            size = np.diff(np.append(group, len(starts)))
            is_best = np.flatnonzero(held == np.repeat(best, size))
            chosen = is_best[np.unique(np.repeat(np.arange(len(group)), size)[is_best], return_index=True)[1]]
            starts, doc_end = starts[chosen], doc_end[chosen]
            # What repeats in the window but not in an item doesn't count twice.
            at = np.minimum(starts[:, None] + np.arange(c - 1), n - 2)
            inside = ((of_lengths[at] & _bit(c)) != 0) & (starts[:, None] + np.arange(c - 1) < doc_end[:, None] - 1)
            pairs = np.sort(np.where(inside, slots[at], none), axis=1)
            distinct = (pairs[:, 0] != none).astype(np.int64) + ((pairs[:, 1:] != pairs[:, :-1]) & (pairs[:, 1:] != none)).sum(1)
            enough = distinct >= t - rungs[c][1]
            starts, doc_end = starts[enough], doc_end[enough]
            if not len(starts):
                continue
            columns = starts[:, None] + np.arange(c)
            inside = columns < doc_end[:, None]
            rows = np.where(inside, found.hashes[np.minimum(columns, n - 1)], np.uint64(0))
            signatures = embed(rows, c, n_repetitions)
            pad = int(max_edits(rungs[c][0])) + stride + 2
            doc = np.searchsorted(found.first, starts, side="right") - 1
            for i, s in enumerate(starts):
                lo, hi = max(found.first[doc[i]], s - pad), min(doc_end[i], s + rungs[c][0] + pad)
                yield int(doc[i]), int(lo - found.first[doc[i]]), c, found.hashes[lo:hi], signatures[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in words.chunks(batch.column("text"), words.LETTER_DIGIT):
                out = [*of_chunk(found), *runs_of_chunk(found)]
                if out:
                    rows = pa.array([at + x[0] for x in out])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).take(rows) for c in (*ROW_KEY, "doc_id")),
                            pa.array([x[1] for x in out], pa.int64()),
                            pa.array([x[2] for x in out], pa.int32()),
                            pa.array([x[3].tobytes() for x in out], pa.binary()),
                            pa.array([x[4].view(np.int64).tolist() for x in out], pa.list_(pa.int64())),
                        ],
                        names=[*ROW_KEY, "doc_id", "place", "rung", "around", "signatures"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select(*ROW_KEY, "doc_id", "text"), run, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, doc_id {kind}, place long, rung int, around binary, signatures array<long>")


def _item_signatures(items: DataFrame, n_repetitions: int, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, c in zip(batch.column("item_words"), batch.column("rung").to_pylist(), strict=True):
                row = np.frombuffer(x.as_py(), np.uint64)
                found.append((embed(row[None, :c], c, n_repetitions)[0] if c >= MIN_WORDS else words.grams(row, c)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "item_signatures"])

    return map_arrow(items, run, items.schema.simpleString()[7:-1].replace(":", " ") + ", item_signatures array<long>")


def _verified(wanted: list[np.ndarray], around: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each item the least edits to a stretch of its surroundings, and where it ends; the item's length where an item
    can't be within its bound."""
    lengths = np.array([len(x) for x in wanted], np.int64)
    edits, end = lengths.copy(), np.zeros(len(lengths), np.int64)
    # An item within the bound has most of its words there: few pairs need the whole computation.
    common = np.array([np.isin(a, b).sum() for a, b in zip(wanted, around, strict=True)], np.int64)
    hopeful = np.flatnonzero(common >= lengths - max_edits(lengths))
    hopeful = hopeful[np.argsort([len(around[i]) for i in hopeful], kind="stable")]
    at = 0
    while at < len(hopeful):
        # Sorted by size, so the last of a slice is its widest.
        stop = at + 1
        while stop < len(hopeful) and (stop + 1 - at) * len(around[hopeful[stop]]) <= VERIFY_CELLS:
            stop += 1
        now = hopeful[at:stop]
        left = np.zeros((len(now), lengths[now].max()), np.uint64)
        right = np.zeros((len(now), len(around[now[-1]])), np.uint64)
        for i, k in enumerate(now):
            left[i, : lengths[k]], right[i, : len(around[k])] = wanted[k], around[k]
        edits[now], end[now] = distances(left, lengths[now], right)
        at = stop
    return edits, end


def _begin(wanted: list[np.ndarray], around: list[np.ndarray]) -> np.ndarray:
    """Where the stretch with the least edits begins that ends first, of surroundings cut at the end of one: read from
    behind, it is a stretch that ends first."""
    _, back = _verified([x[::-1] for x in wanted], [x[::-1] for x in around])
    return np.array([len(x) for x in around], np.int64) - back


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """doc_id, item id, first_word, n_words (of the item) and edits, for each document and item that it holds.

    first_word is where a stretch of the document's words with so many edits begins, the shortest that ends there."""
    spark = docs.sparkSession
    n_repetitions = repetitions()
    docs = keyed(docs).select(*ROW_KEY, "doc_id", F.lower("text").alias("text"))
    # Items are few beside documents, but are stored where they could be many: their words, once.
    items, _ = Steps(spark).store(_items(benchmark.select(key, F.lower("text").alias("text")), key).withColumn("item_row", F.xxhash64("item_words")))
    measured = items.groupBy("rung").agg(F.max("n_item_words").alias("longest"), F.count("*").alias("n"), F.sum("n_item_words").alias("words"), F.max("n_repeated").alias("repeated")).collect()
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, key)))
    schema = f"doc_id {doc_kind}, {key} {item_kind}, first_word long, n_words long, edits long"
    if not measured:
        return spark.createDataFrame([], schema)
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(64 * sum(r["words"] for r in measured)))))
    rungs = {r["rung"]: (r["longest"], r["repeated"]) for r in sorted(measured, key=lambda r: r["rung"])}
    windows = _windows(docs, rungs, _pair_table(items, bits), bits, n_repetitions)
    asked = _item_signatures(items, n_repetitions, key).select(key, "item_row", "item_words", "rung", F.posexplode("item_signatures").alias("repetition", "signature"))
    if sum(r["n"] for r in measured) <= BROADCAST_ITEMS:
        asked = F.broadcast(asked)
    exploded = windows.select(*ROW_KEY, "doc_id", "place", "rung", "around", F.posexplode("signatures").alias("repetition", "signature"))
    # A window is known by its row and place, an item by its id and words: what is taken first is the same in all rows.
    pairs = exploded.join(asked, ["rung", "repetition", "signature"]).groupBy(*ROW_KEY, "place", "rung", key, "item_row").agg(*(F.first(c).alias(c) for c in ("doc_id", "around", "item_words")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, around = ([np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("item_words", "around"))
            lengths = np.array([len(x) for x in wanted], np.int64)
            edits, end = _verified(wanted, around)
            kept = np.flatnonzero(edits <= max_edits(lengths))
            first = batch.column("place").to_numpy()[kept] + _begin([wanted[i] for i in kept], [around[i][: end[i]] for i in kept])
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column(key), pa.array(first), pa.array(lengths[kept]), pa.array(edits[kept])], names=["doc_id", key, "first_word", "n_words", "edits"])

    verified = map_arrow(pairs.select("doc_id", "place", key, "around", "item_words"), verify, schema)
    best = F.min(F.struct("edits", "first_word", "n_words")).alias("b")
    return verified.groupBy("doc_id", key).agg(best).select("doc_id", key, "b.first_word", "b.n_words", "b.edits")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
