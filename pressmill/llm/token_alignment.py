"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes of a text, and where both can be cut.

Byte-owner arrays: for each tokenizer np.repeat writes over every byte the index of the token that owns it. Where the pair
of owners changes from one byte to the next, a new link of an A token and a B token begins; where both owners change at
once, both tokenizers end a token, and a new group begins. From the links of all texts comes how often each pair of ids is
linked, and from that how many links of a text are the best that their B id has.

The tokenizers are a byte-level BPE (A) and a BPE of pieces with byte fallback that adds a space (B); their files are read
on the driver, once, and broadcast, a few MB of fixed size. Both see a text as pieces that end before a space which follows a visible ASCII
character. Neither ever merges over such a place, as A's words and B's pieces have white space at their start only (a test
compares with whole texts; with a vocabulary where that isn't so, texts are not divided). So a piece has the same tokens
wherever it stands, pieces that were seen lately aren't encoded again, and a long text never is in memory as tokens whole.

The counts of pairs are joined to the links in two ways: pairs with more than one in HEAVY_SHARE of all links, of which
there are fewer than HEAVY_SHARE whatever the size of the table, are broadcast; the others are shuffled, so no pair's links
fill a task. The highest count of each B id is a table of the vocabulary's size.

Defined results: null and empty texts, and texts whose tokens don't give back the text (a literal U+2581), have no tokens,
zeros and groups ''; strings of special tokens are plain text; repeated rows count each and have rows of their own; ties for
the highest count are all best; columns named as results are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, few_tasks, map_arrow, table

#: Where the files of the tokenizers are; a parameter of the operator.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A text is cut at such spaces; the space belongs to the piece that follows, which isn't empty.
CUT = re.compile(r"(?<=[!-~]) (?=[\s\S])")
#: Characters of a text whose owners are written at once, or more up to the next cut.
SPAN_CHARS = 1 << 18
#: Characters and pieces of a batch that are encoded at once; of pieces seen before, so many are kept.
CHUNK_CHARS, KEPT_CHARS, KEPT_PIECES = 1 << 20, 8 << 20, 1 << 19
#: A pair of ids is heavy with more than one in so many of all links: fewer pairs than this can be.
HEAVY_SHARE = 1 << 16


def byte_of_char() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: visible ones for themselves, others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(visible)]
    return {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, from the contents of their files, with the bytes of every token."""

    def __init__(self, byte_bpe: bytes, pieces: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_buffer(byte_bpe), SentencePieceProcessor(model_proto=pieces)
        self.a.encode_special_tokens = True
        of_char, vocab = byte_of_char(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of_char[c] for c in token)
        ids = range(self.b.get_piece_size())
        self.b_bytes = [self._piece(self.b.id_to_piece(i), self.b.is_byte(i)) for i in ids]
        #: Whether no piece of B has a space after something else.
        self.divides = all("▁" not in self.b.id_to_piece(i).lstrip("▁") for i in ids)

    @staticmethod
    def _piece(piece: str, is_byte: bool) -> bytes:
        return bytes((int(piece[3:-1], 16),)) if is_byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """The ids of A and B for each text, and whether both give back the text after a space."""
        of_a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        of_b = self.b.encode(texts, num_threads=1)
        data = [b" " + t.encode() for t in texts]
        return of_a, of_b, self._same(data, of_a, self.a_bytes) & self._same(data, of_b, self.b_bytes)

    @staticmethod
    def _same(data: list[bytes], ids: list[list[int]], token: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes are each text's; seldom they aren't, so all are compared together first."""
        tokens = [token[i] for i in chain.from_iterable(ids)]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *map(len, ids)])]
        if np.array_equal(ends[1:], np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))) and b"".join(tokens) == b"".join(data):
            return np.ones(len(data), bool)
        return np.array([b"".join(map(token.__getitem__, x)) == d for x, d in zip(ids, data, strict=True)], bool)


@lru_cache(maxsize=1)
def _open(byte_bpe: bytes, pieces: bytes) -> tuple[Tokenizers, _Pieces]:
    """Python workers live on between tasks, so the tokenizers and the pieces seen lately do."""
    made = Tokenizers(byte_bpe, pieces)
    return made, _Pieces(made)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(max(len(values), len(self.room)), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Ids:
    """Ids of many pieces, end to end."""

    def __init__(self) -> None:
        self.values, self.ends = _Grown(np.int32), _Grown(np.int64)
        self.ends.add(np.zeros(1, np.int64))

    def add(self, ids: list[list[int]]) -> None:
        self.ends.add(self.values.n + np.cumsum([len(x) for x in ids]))
        self.values.add(np.fromiter(chain.from_iterable(ids), np.int32))

    def of(self, pieces: np.ndarray) -> np.ndarray:
        """The ids of these pieces, one after the other."""
        begin = self.ends.room[pieces]
        n = self.ends.room[pieces + 1] - begin
        before = np.cumsum(n) - n
        return self.values.room[np.repeat(begin - before, n) + np.arange(int(n.sum()))]


class _Pieces:
    """The tokens of pieces, numbered as they were first seen; forgotten when there are too many."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.a, self.b, self.same, self.chars = _Ids(), _Ids(), _Grown(bool), 0

    def learn(self, pieces: set[str]) -> None:
        if self.chars > KEPT_CHARS or len(self.number) > KEPT_PIECES:
            self._forget()
        new = [x for x in pieces if x not in self.number]
        if new:
            of_a, of_b, same = self.tokenizers.encode(new)
            self.number.update(zip(new, range(self.same.n, self.same.n + len(new)), strict=True))
            self.a.add(of_a)
            self.b.add(of_b)
            self.same.add(same)
            self.chars += sum(map(len, new))


def spans(text: str, divides: bool) -> Iterator[list[str]]:
    """The pieces of a text, those of a bounded part of it at a time."""
    at = 0
    while divides and (cut := CUT.search(text, at + SPAN_CHARS)):
        yield CUT.split(text[at : cut.start()])
        at = cut.end()
    yield CUT.split(text[at:]) if divides else [text]


def links_and_cuts(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of these numbers of bytes: the A and the B token of every link, and the group of every A and B token."""
    a_owner, b_owner = (np.repeat(np.arange(len(n), dtype=np.int32), n) for n in (a_lengths, b_lengths))
    a_new, b_new = (np.concatenate(([True], x[1:] != x[:-1])) for x in (a_owner, b_owner))
    at = np.flatnonzero(a_new | b_new)
    group = np.cumsum(a_new & b_new) - 1
    return a_owner[at], b_owner[at], group[a_new], group[b_new]


@lru_cache(maxsize=1)
def _digits() -> np.ndarray:
    """The decimal digits of the numbers below 100,000, behind zero bytes; the sixth byte is for what follows a number."""
    number = np.arange(100_000)
    out = np.zeros((len(number), 6), np.uint8)
    for place in range(5):
        shown = (number >= 10**place) | (place == 0)
        out[:, 4 - place] = np.where(shown, number // 10**place % 10 + 48, 0)
    return out


def group_text(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group's A tokens and B tokens."""
    if max(a.max(), b.max()) >= 100_000:
        raise ValueError("ids of five digits at most are written")
    side = np.concatenate([2 * a_group, 2 * b_group + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    marks = np.full(len(side), ord(","), np.uint8)
    ends = np.flatnonzero(side[1:] != side[:-1])
    marks[ends] = np.where(side[ends] & 1, ord(";"), ord("|"))
    out = _digits()[np.concatenate([a, b])[order]]
    out[:, 5] = marks
    flat = out.ravel()
    return flat[flat != 0][:-1].tobytes()


class _Text:
    """What is known of one text, as its spans come."""

    def __init__(self) -> None:
        self.n = np.zeros(4, np.int64)
        self.digest, self.groups = hashlib.sha256(), []
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.any, self.same = False, True

    def add(self, a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray, write: bool) -> None:
        linked_a, linked_b, a_group, b_group = links_and_cuts(a_lengths[a], b_lengths[b])
        self.n += (len(a), len(b), a_group[-1] + 1, len(linked_a))
        text = group_text(a, b, a_group, b_group)
        for x in (b";", text) if self.any else (text,):
            self.digest.update(x)
            if write:
                self.groups.append(x)
        self.any = True
        pairs, times = np.unique(a[linked_a].astype(np.int64) << 32 | b[linked_b], return_counts=True)
        if len(self.pairs):
            pairs, at = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            times = np.bincount(at, np.concatenate([self.times, times])).astype(np.int64)
        self.pairs, self.times = pairs, times

    def row(self, write: bool) -> tuple:
        if not (self.any and self.same):
            return 0, 0, 0, 0, "", "" if write else None, *(np.empty(0, np.int64),) * 2
        return *self.n.tolist(), self.digest.hexdigest(), b"".join(self.groups).decode() if write else None, self.pairs, self.times


def _rows(texts: list[str | None], tokenizers: Tokenizers, pieces: _Pieces, write: bool) -> list[tuple]:
    a_lengths, b_lengths = (np.array([len(x) for x in of], np.int64) for of in (tokenizers.a_bytes, tokenizers.b_bytes))
    known = [_Text() for _ in texts]
    waiting: list[tuple[int, list[str]]] = []
    chars = 0

    def flush() -> None:
        pieces.learn({x for _, span in waiting for x in span})
        for i, span in waiting:
            at = np.fromiter(map(pieces.number.__getitem__, span), np.int64, len(span))
            text = known[i]
            text.same = text.same and bool(pieces.same.room[at].all())
            if text.same:
                text.add(pieces.a.of(at), pieces.b.of(at), a_lengths, b_lengths, write)
        waiting.clear()

    for i, text in enumerate(texts):
        for span in spans(text, tokenizers.divides) if text else ():
            waiting.append((i, span))
            chars += sum(map(len, span)) + len(span)
            if chars > CHUNK_CHARS:
                flush()
                chars = 0
    flush()
    return [x.row(write) for x in known]


ALIGNED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType())]
    + [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in ("linked_a", "linked_b", "times")]
)


def align(docs: DataFrame, folder: str = TOKENIZERS, write_groups: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with ALIGNED: numbers of tokens, groups and links; the groups, as text if they are to be written,
    and their digest; every pair of ids that is linked, with how often it is."""
    files = docs.sparkSession.sparkContext.broadcast(tuple(Path(folder, name).read_bytes() for name in (BYTE_BPE, PIECES)))
    kept = [c for c in keep if c not in ALIGNED.names]
    schema = T.StructType([docs.schema[c] for c in kept] + ALIGNED.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, pieces = _open(*files.value)
        for batch in batches:
            rows = _rows(batch.column("_text").to_pylist(), tokenizers, pieces, write_groups)
            *numbers, digest, groups, pairs, times = zip(*rows, strict=True) if rows else ((),) * 8
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            of_pairs, of_times = (np.concatenate([np.empty(0, np.int64), *x]) for x in (pairs, times))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (of_pairs >> 32, of_pairs & 0xFFFFFFFF, of_times)]
            made = [*(pa.array(x, pa.int64()) for x in numbers), pa.array(digest, pa.string()), pa.array(groups, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=schema.names)

    return map_arrow(docs.select(*kept, F.col("text").alias("_text")), run, schema)


PAIR = ("a", "b")
SCORES = ("n_best", "count_sum")


def _links(aligned: DataFrame, *columns: str) -> DataFrame:
    pairs = F.arrays_zip(F.col("linked_a").alias("a"), F.col("linked_b").alias("b"), F.col("times").alias("times"))
    return aligned.select(*columns, F.inline(pairs).alias(*PAIR, "times"))


def pair_counts(aligned: DataFrame, steps: Steps) -> tuple[DataFrame, int]:
    """How often each pair of ids is linked (count), whether that is its B id's highest (best), and the number of links."""
    counted = _links(aligned).groupBy(*PAIR).agg(F.sum("times").alias("count"))
    counts, found = steps.store(counted, few_tasks(aligned.sparkSession), links=F.sum("count"))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # as many rows as B has ids
    counts = counts.join(F.broadcast(highest), "b").select(*PAIR, "count", (F.col("count") == F.col("highest")).alias("best"))
    return counts, found["links"] or 0


def scored(docs: DataFrame, folder: str = TOKENIZERS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with the numbers of align, and SCORES: how many of a text's links are the best of their B id, and
    the sum of their pairs' counts."""
    kept = [c for c in keep if c not in (*ALIGNED.names, *SCORES, "row_key")]
    steps = Steps(docs.sparkSession)
    aligned, _ = steps.store(align(docs.withColumn("row_key", F.monotonically_increasing_id()), folder, keep=("row_key", *kept)))
    counts, links = pair_counts(aligned, steps)
    is_heavy = F.col("count") * HEAVY_SHARE > links
    heavy = F.broadcast(counts.where(is_heavy))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    each = _links(aligned, "row_key")
    common = each.join(heavy, list(PAIR)).groupBy("row_key").agg(*sums)
    others = each.join(heavy, list(PAIR), "left_anti").join(counts.where(~is_heavy).hint("merge"), list(PAIR)).groupBy("row_key").agg(*sums)
    totals = common.unionAll(others).groupBy("row_key").agg(*(F.sum(c).alias(c) for c in SCORES))
    numbers = aligned.select("row_key", *kept, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return numbers.join(totals.hint("merge"), "row_key", "left").select(*kept, "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in SCORES), "groups_sha256")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
