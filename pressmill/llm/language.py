"""Language identification by compression.

Each learned language has a raw-content zstandard dictionary made of its training texts. A text is compressed in
consecutive pieces with every dictionary, each piece afresh, so that all parts of a long text count alike; the
dictionary with the smallest sum of sizes names the language. Narrow results are compressed again at a stronger level,
and are rejected if the margin stays narrow. Texts and dictionaries are compared in lower case.

Every language of the training texts is learned. Bounds: of each language at most ``docs_per_language`` training rows are
read (those with the smallest hash of their id), an equal share of each, ``dictionary_bytes`` in all, or less where all
languages together would be beyond ``model_bytes``: so the model that is collected and broadcast is bounded. GROUP dictionaries are in use at once. Everything else covers all rows and whole texts.

Defined results: null texts and texts without a letter give ``und``, score 0 and are rejected; equal sizes go to the
language with the most training texts; a text that is rejected still has the best language as its prediction; repeated
rows give repeated results; columns named as results are left out; an empty table gives an empty result; without any
training text every row gives ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, few_tasks, in_fold, map_arrow, small

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Dictionaries that are in use at once; their tables take some 4 MB each.
GROUP = 48
#: Texts are compressed in pieces of at most this, so that the dictionary stays in the window all through a piece.
PIECE_BYTES = 32 * 1024


@dataclass(frozen=True)
class LanguageModel:
    """dictionaries: (language, raw content), languages with the most training texts first."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 6
    #: Texts whose two best sizes differ by less than this share are compressed again.
    recheck: float = 0.05
    recheck_level: int = 12
    #: A text is accepted if the second best language needs this much more than the best.
    margin: float = 0.005


def fit(train: DataFrame, docs_per_language: int = 160, dictionary_bytes: int = 64 * 1024, model_bytes: int = 32 << 20) -> LanguageModel:
    """Learn from columns doc_id, text and lang; rows with null text or lang teach nothing."""
    known = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.xxhash64("doc_id")
    # Ranked without texts first, which gives each language a last place; only rows up to it are ranked with their texts.
    ranked = known.select("lang", place.alias("place")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    cuts = ranked.where(F.col("rank") <= docs_per_language).groupBy("lang").agg(F.max("place").alias("cut"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n_texts")).join(cuts, "lang")
    steps = Steps(train.sparkSession)
    counts, found = steps.store(counts, few_tasks(train.sparkSession), n=F.count(F.lit(1)))
    dictionary_bytes = max(64, min(dictionary_bytes, model_bytes // max(1, found["n"])))
    rows = known.join(small(counts, found["n"]), "lang").where(place <= F.col("cut"))
    # Of rows with one id those with the smallest hash of their text, so that the bound holds however ids repeat.
    own = Window.partitionBy("lang").orderBy("place", "digest")
    rows = rows.select("lang", "n_texts", place.alias("place"), F.xxhash64("text").alias("digest"), F.col("text").substr(1, dictionary_bytes).alias("text"))
    rows = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= docs_per_language)
    share = F.greatest(F.lit(1), F.lit(4 * dictionary_bytes) / F.least("n_texts", F.lit(docs_per_language))).cast("int")
    texts: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for row in rows.select("lang", "n_texts", "place", "digest", F.col("text").substr(F.lit(1), share).alias("text")).orderBy("lang", "place", "digest").collect():
        texts.setdefault(row["lang"], []).append(row["text"].lower())
        sizes[row["lang"]] = row["n_texts"]
    steps.clear()
    by_size = sorted(texts, key=lambda k: (-sizes[k], k))
    return LanguageModel(tuple((k, _shares([t.encode() for t in texts[k]], dictionary_bytes)) for k in by_size))


def _shares(texts: list[bytes], size: int) -> bytes:
    """So many bytes of the texts together, an equal share of each; what short texts leave goes to longer ones."""
    room, out = size, {}
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        out[i] = texts[i][: max(0, room // (len(texts) - done) - 1)]
        room -= len(out[i]) + 1
    return b"\n".join(out[i] for i in range(len(texts)))


class _Sizer:
    """Predictions with a model's dictionaries, kept between batches where they are one group."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.names = [name for name, _ in model.dictionaries]
        self._kept: dict[tuple[int, int], list] = {}

    def _compressors(self, level: int, first: int) -> list:
        import zstandard

        if (level, first) in self._kept:
            return self._kept[level, first]
        # Parameters for a dictionary of this size: short matches count, and tables take some 2 MB each.
        flags = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        size = max(len(d) for _, d in self.model.dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=size, **flags)
        raw = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, d in self.model.dictionaries[first : first + GROUP]]
        made = [zstandard.ZstdCompressor(compression_params=params, dict_data=d) for d in raw]
        if len(self.names) <= GROUP:
            self._kept[level, first] = made
        return made

    @staticmethod
    def _pieces(data: bytes) -> list[bytes]:
        n = -(-len(data) // PIECE_BYTES)
        cuts = [len(data) * i // n for i in range(n + 1)]
        return [data[a:b] for a, b in pairwise(cuts)]  # of equal length, as short ones tell languages apart more widely

    def _sizes(self, texts: list[bytes], level: int) -> list[list[int]]:
        """The sizes of each text with every dictionary."""
        out: list[list[int]] = [[] for _ in texts]
        for first in range(0, len(self.names), GROUP):
            made = self._compressors(level, first)
            for sizes, data in zip(out, texts, strict=True):
                pieces = self._pieces(data)
                sizes += [sum(len(c.compress(x)) for x in pieces) for c in made]
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predictions([text])[0]

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether the margin is wide enough, of each text."""
        out = [(UNDETERMINED, 0.0, False)] * len(texts)
        asked = [i for i, x in enumerate(texts) if self.names and x is not None and LETTER.search(x)]
        # Spaces let the first and last word match.
        data = {i: f" {texts[i].lower()} ".encode("utf-8", "surrogatepass") for i in asked}
        sizes = dict(zip(asked, self._sizes([data[i] for i in asked], self.model.level), strict=True))
        narrow = [i for i in asked if self._share(sizes[i]) < self.model.recheck]
        sizes |= dict(zip(narrow, self._sizes([data[i] for i in narrow], self.model.recheck_level), strict=True))
        for i in asked:
            share = self._share(sizes[i])
            out[i] = (self.names[sizes[i].index(min(sizes[i]))], min(1.0, 4 * share), share >= self.model.margin)
        return out

    @staticmethod
    def _share(sizes: list[int]) -> float:
        """How much more the second best needs, as a share of its size."""
        best, second = (*sorted(sizes)[:2], 2 * min(sizes))[:2]
        return (second - best) / second


def _predictions(model: LanguageModel, texts: pa.Array, sizer: list) -> tuple[list, list, list]:
    if not sizer:
        sizer.append(_Sizer(model))
    found = sizer[0].predictions(texts.to_pylist())
    return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with lang_pred, score and accepted; a kept column with one of those names is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep if c not in ("lang_pred", "score", "accepted")]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer: list = []
        for batch in batches:
            lang, score, accepted = _predictions(shared.value, batch.column("_text"), sizer)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=[*kept, "lang_pred", "score", "accepted"],
            )

    return map_arrow(docs.select(*kept, F.col("text").alias("_text")), run, schema)


def accepted_only(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language is accepted, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer: list = []
        for batch in batches:
            _, _, accepted = _predictions(shared.value, batch.column("text"), sizer)
            yield batch.filter(pc.fill_null(pa.array(accepted, pa.bool_()), False))

    return map_arrow(docs, run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """All but the held-out quarter."""
    return docs.where(~in_fold(F.col("doc_id"), 4, 2))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_rows(docs))
    return identify(docs, model).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "accepted")
