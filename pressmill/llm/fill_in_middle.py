"""Fill-in-middle examples: a text's units are cut at two drawn places, and the parts reordered about sentinels.

Big-integer bit-parallelism over the text's UTF-8 bytes: ``bytes.translate`` turns a text into the bit mask of a class of
bytes (bit i: byte i), shifted boolean operations on masks mark where units begin and where sentinels stand, ``bit_count``
gives the number of units, and recursive halving finds the byte at which the unit of a drawn rank begins.

Units are code points, words (a word with the white space after it) or lines. The draws come from a digest of seed and id,
so they depend on neither partitions nor other rows. A text that is empty, holds a sentinel, or is drawn to stay plain,
stays as it is; ``restored`` rebuilds each text from its output and form, exactly.

Defined results: null texts are empty, empty texts plain with no units; rows with a null id are drawn as id ''; repeated
rows give repeated results; both cuts may fall together, at the start or at the end; white space before a text's first word
belongs to that word's unit; texts of any length are taken whole; columns named as results are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bits in which ranks are counted one by one.
WORD = 64
RESULTS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)
_DRAWS = ("_h1", "_h2", "_h3", "_h4")


@lru_cache(maxsize=64)
def _digits(members: bytes) -> bytes:
    """A table for translate: the digit 1 for bytes of the class, 0 for others."""
    return bytes(49 if x in members else 48 for x in range(256))


#: All bytes but those that continue a code point.
LEAD = bytes(x for x in range(256) if x & 0xC0 != 0x80)
SPACE = bytes((0x20, *range(0x09, 0x0E)))


def mask(backwards: bytes, members: bytes) -> int:
    """Bit i is set where byte i belongs to the class; the text comes with its last byte first."""
    return int(backwards.translate(_digits(members)) or b"0", 2)


def holds(backwards: bytes, *words: bytes) -> bool:
    """Whether one of the byte strings stands anywhere."""
    classes = {x: mask(backwards, bytes((x,))) for x in set(b"".join(words))}
    for word in words:
        places = classes[word[0]]
        for j, x in enumerate(word[1:], 1):
            places &= classes[x] >> j
        if places:
            return True
    return False


def unit_starts(backwards: bytes, units: str) -> int:
    """The mask of the bytes at which units begin; the first byte always begins one."""
    if units == "chars":
        starts = mask(backwards, LEAD)
    elif units == "words":
        spaces = mask(backwards, SPACE)
        inside = ~spaces & ((1 << len(backwards)) - 1)
        starts = inside & (spaces << 1)
        first = inside & -inside
        starts &= ~first  # white space before the first word is that word's
    elif units == "lines":
        starts = (mask(backwards, b"\n") << 1) & ((1 << len(backwards)) - 1)
    else:
        raise ValueError(f"units are chars, words or lines, not {units}")
    return starts | 1 if backwards else 0


def select(bits: int, width: int, rank: int) -> int:
    """The place of the set bit with that rank (from 0), by halving: the lower half's count says in which half it is."""
    below = 0
    while width > WORD:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, rank, below, width = bits >> half, rank - n, below + half, width - half
    for _ in range(rank):
        bits &= bits - 1
    return below + (bits & -bits).bit_length() - 1


def cut(data: bytes, h1: int, h2: int, h3: int, h4: int, units: str, plain_from: int, spm_below: int) -> tuple:
    """n, form, code points of prefix and middle, and the output of one text."""
    backwards, width = data[::-1], len(data)
    starts = unit_starts(backwards, units)
    n = starts.bit_count()
    if not data or h3 % 100 >= plain_from or holds(backwards, PREFIX, SUFFIX, MIDDLE):
        return n, PLAIN, None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (select(starts, width, k) if k < n else width for k in (low, high))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    lead = starts if units == "chars" else mask(backwards, LEAD)
    in_prefix = (lead & ((1 << a) - 1)).bit_count()
    in_middle = (lead & ((1 << b) - 1)).bit_count() - in_prefix
    if h4 % 100 < spm_below:
        return n, SPM, in_prefix, in_middle, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, PSM, in_prefix, in_middle, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def transform(docs: DataFrame, seed: int = 1, units: str = "chars", plain_from: int = 90, spm_below: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with RESULTS. Of a hundred texts those drawn from plain_from on stay plain; of the others those
    drawn below spm_below have their suffix first."""
    kept = [c for c in keep if c not in RESULTS.names]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(_DRAWS)]
    schema = T.StructType([docs.schema[c] for c in kept] + RESULTS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # As bytes: whatever a text holds goes through unchanged.
            texts = batch.column("_text").to_pylist()
            rows = [cut(data, *h, units, plain_from, spm_below) for data, *h in zip(texts, *(batch.column(c).to_pylist() for c in _DRAWS), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            numbers = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
            made = [numbers[0], pa.array(form, pa.string()), *numbers[1:], pa.array(output, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=schema.names)

    return map_arrow(docs.select(*kept, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"), *draws), run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text in another form than plain holds a sentinel, so the marks are certain."""
    marks = "|".join(x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    part = F.split(output, marks, -1)
    return F.when(form == PSM, F.concat(part[1], part[3], part[2])).when(form == SPM, F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
