"""Nearest neighbours by additive quantisation, with bounds that make the result whole.

A unit vector is coded as a sum of one word from each of several full-dimensional codebooks, found by beam search over
residuals; what is still missing, as a direction, by further words that are zero but for two axes each (one such book for
each pair of axes). Beside either code are stored the factor that brings its sum nearest to what it stands for, and the length
of what remains missing. A query's inner products with all words form a lookup table; a sum of entries times its factor is
off by that length times the query's at most. In each block the ``shortlist`` best by code are scored exactly; the k-th of
these scores excludes every vector that can't reach it even with all of its bound. The further words are looked up for
vectors that the first leave, and what these leave as well is checked by exact inner products in double precision. So no true
neighbour is lost, whatever the vectors are: codes that fit badly cost time only.

Vectors and queries are dealt into blocks by a hash of their id; each block of queries meets each block of vectors in one
task of bounded rows and bytes, so a task's memory doesn't grow with the table. What travels to these tasks is codes (a byte
a codebook and pair of axes) and original vectors, once for each block of queries, and k ids and scores for each query and
block back. The comparisons, and for tables of more than one block of queries what travels, grow with queries times
candidates, as the query set is a fixed share of the table.

Bounds: codebooks are trained on at most ``train_rows`` vectors of each dimension (those with the smallest hash of their
id); they are of fixed size for a dimension, and nothing else is broadcast. Every vector is coded and searched.

Defined results: rows whose id is null, and vectors that are null, zero, or hold null or non-finite components, take no
part; vectors of different dimensions have no inner product, so a query finds those of its own; rows with a query's id are
its own; an id that occurs again counts once, with its best score; ties go to the smaller id, where equal vectors have equal
scores (of the ids of one vector a block keeps the k + 1 smallest, as the others can't be found); with fewer candidates all
are returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, table


@dataclass(frozen=True)
class AdditiveQuantiser:
    """books: (codebooks, words, dimension); fine: (pairs of axes, words, 2), for directions of what books miss."""

    books: np.ndarray
    beam: int = 6
    fine: np.ndarray | None = None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of unit vectors, and the norms of what they decode to."""
        codes, decoded = [], []
        for at in range(0, len(x), 512):
            c, d = self._encode(x[at : at + 512])
            codes.append(c)
            decoded.append(np.linalg.norm(d, axis=1))
        if not codes:
            return np.empty((0, len(self.books)), np.uint8), np.empty(0, np.float32)
        return np.concatenate(codes), np.concatenate(decoded)

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, d = x.shape
        rest = x[:, None, :]
        codes = np.empty((n, 1, 0), np.uint8)
        for book in self.books:
            beams = rest.shape[1]
            half_sq = 0.5 * (book * book).sum(1)
            # Squared error of each beam after each word, but for the factor 2.
            cost = (0.5 * (rest * rest).sum(2))[:, :, None] - (rest.reshape(-1, d) @ book.T).reshape(n, beams, -1) + half_sq
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            beam, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, beam[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        return codes[:, 0], x - rest[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums of words, in double precision."""
        return sum(book[codes[:, m]].astype(np.float64) for m, book in enumerate(self.books))

    def missed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of unit vectors, factors of their sums, and what these miss."""
        codes, _ = self.encode(unit.astype(np.float32))
        factor, rest = _fitted(unit, self.decode(codes))
        return codes, factor, rest

    def bounded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes of vectors in double precision, the factors of their sums, and how far a score may be off; then the same of
        the fine codes, whose sums are added.

        That is for queries of length 1: the length of what is missing, and what rounding adds in the lookup tables, in sums
        of their entries and in exact products.
        """
        size = norms(x)
        unit = x / size[:, None]
        codes, factor, rest = self.missed(unit)
        rounded = (x.shape[1] + len(self.books) + 8) * (np.abs(factor) * _longest(self.books) * 2.0**-23 + 2.0**-50)
        length = np.sqrt((rest * rest).sum(1))
        first = codes, factor * size, (length + rounded) * size
        if self.fine is None:
            return *first, np.empty((len(x), 0), np.uint8), np.zeros(len(x)), first[2]
        pairs = _pairs(rest / np.maximum(length, 1e-30)[:, None])
        fine = np.stack([np.argmin(0.5 * (book * book).sum(1) - own @ book.T, axis=1) for book, own in zip(self.fine, pairs.astype(np.float32), strict=True)], axis=1).astype(np.uint8)
        decoded = np.stack([book[word] for book, word in zip(self.fine, fine.T, strict=True)]).astype(np.float64)
        flat = lambda parts: parts.transpose(1, 0, 2).reshape(len(x), -1)
        factor, rest = _fitted(flat(pairs) * length[:, None], flat(decoded))
        rounded = rounded + (len(self.fine) + 8) * np.abs(factor) * _longest(self.fine) * 2.0**-23
        return *first, fine, factor * size, (np.sqrt((rest * rest).sum(1)) + rounded) * size

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, codebooks, words): inner products."""
        return np.einsum("qd,mkd->qmk", queries, self.books, optimize=True).astype(np.float32)

    def fine_tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, pairs of axes, words): inner products."""
        return np.einsum("gqd,gkd->qgk", _pairs(queries), self.fine, optimize=True).astype(np.float32)


def _fitted(x: np.ndarray, decoded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The factor that brings each decoded sum nearest to its vector, and what is missing then."""
    factor = (x * decoded).sum(1) / np.maximum((decoded * decoded).sum(1), 1e-30)
    return factor, x - factor[:, None] * decoded


def _longest(books: np.ndarray) -> float:
    """No sum of words, and no sum of their lengths, is longer."""
    return np.linalg.norm(books.astype(np.float64), axis=2).max(1).sum()


def _pairs(x: np.ndarray) -> np.ndarray:
    """(pairs of axes, rows, 2); an odd last axis is paired with zeros."""
    x = np.pad(x, ((0, 0), (0, x.shape[1] % 2)))
    return x.reshape(len(x), -1, 2).transpose(1, 0, 2)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows that aren't zero, where squares would be too large or too small as well."""
    most = np.abs(x).max(1)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def _k_means(rng: np.random.Generator, rows: np.ndarray, words: int, rounds: int) -> np.ndarray:
    book = rows[rng.choice(len(rows), words, replace=False)].copy()
    for _ in range(rounds):
        word = np.argmin(0.5 * (book * book).sum(1) - rows @ book.T, axis=1)
        n = np.bincount(word, minlength=words)
        order = np.argsort(word, kind="stable")
        sums = np.add.reduceat(rows[order], np.concatenate([[0], np.cumsum(n)[:-1]]).clip(0, len(rows) - 1), axis=0)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book).astype(np.float32)
    return book


def train(sample: np.ndarray, codebooks: int = 12, words: int = 256, rounds: int = 6) -> AdditiveQuantiser:
    """Codebooks of a sample of unit vectors: k-means on residuals, one joint least-squares update, then the fine books."""
    rng = np.random.default_rng(3)
    words = max(1, min(words, len(sample)))
    books, rest = [], sample.astype(np.float32).copy()
    for _ in range(codebooks):
        book = _k_means(rng, rest, words, rounds)
        rest = rest - book[np.argmin(0.5 * (book * book).sum(1) - rest @ book.T, axis=1)]
        books.append(book)
    model = AdditiveQuantiser(np.stack(books))
    if len(sample) >= 4 * words:
        codes, _ = model.encode(sample)
        cells = codes.astype(np.int64) + np.arange(codebooks) * words
        gram = np.zeros((codebooks * words, codebooks * words))
        for i in range(codebooks):
            for j in range(codebooks):
                np.add.at(gram, (cells[:, i], cells[:, j]), 1.0)
        target = np.zeros((codebooks * words, sample.shape[1]))
        for i in range(codebooks):
            np.add.at(target, cells[:, i], sample)
        gram[np.diag_indices_from(gram)] += 1.0
        target += model.books.reshape(-1, sample.shape[1])
        model = AdditiveQuantiser(np.linalg.solve(gram, target).reshape(model.books.shape).astype(np.float32))
    rest = model.missed(sample[: 16 * words])[2]
    length = np.sqrt((rest * rest).sum(1))
    rest = rest[length > 1e-6] / length[length > 1e-6][:, None]
    if not len(rest):
        return model
    return replace(model, fine=np.stack([_k_means(rng, own, min(words, len(rest)), rounds) for own in _pairs(rest.astype(np.float32))]))


def usable(vectors: DataFrame) -> DataFrame:
    """id, vector (array of double) and dim, its length, of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.withColumn("dim", F.size("vector"))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _blocks(n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")


def _models(rows: DataFrame, dims: list[int], train_rows: int) -> dict[int, AdditiveQuantiser]:
    """A quantiser for each dimension."""
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "vector"))
    chosen = rows.withColumn("_place", place).where(F.col("_place") <= train_rows).select("dim", "_place", "vector").toArrow()
    out = {}
    for dim in dims:
        own = chosen.filter(pa.compute.equal(chosen["dim"], dim)).sort_by("_place")
        sample = _matrix(own["vector"].combine_chunks(), np.float64)
        out[dim] = train(sample / norms(sample)[:, None])
    return out


#: What travels of a block, as bytes.
PACKED = ("ids", "vectors", "codes", "factors", "bounds", "fine", "fine_factors", "fine_bounds")

#: Bytes of a block's vectors in double precision.
BLOCK_BYTES = 16 << 20


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids, each with its best score; ties go to the smaller id."""
    order = np.lexsort((ids, -scores))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]


def _findable(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places, ordered by id, of the rows that can be among k nearest: the k + 1 smallest ids of each vector, once each."""
    _, same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    new_vector = np.diff(same[order], prepend=-1) != 0
    order = order[new_vector | (np.diff(ids[order], prepend=0) != 0)]
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    order = order[place <= k]
    return order[np.argsort(ids[order], kind="stable")]


def _looked_up(luts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, vectors): for each vector the sum of its words' entries. Those of all queries for one word lie together."""
    luts = np.ascontiguousarray(luts.transpose(1, 2, 0))
    total = luts[0].take(codes[0], axis=0)
    for m in range(1, len(codes)):
        total += luts[m].take(codes[m], axis=0)
    return np.ascontiguousarray(total.T)


class _Block:
    """Vectors of one block, with what ``bounded`` gives for them."""

    def __init__(self, model: AdditiveQuantiser, ids: np.ndarray, vectors: np.ndarray, coded: tuple[np.ndarray, ...], k: int, shortlist: int):
        at = _findable(ids, vectors, k)
        self.model, self.k, self.shortlist = model, k, max(k, shortlist)
        self.ids, self.vectors = ids[at], vectors[at].astype(np.float64)
        codes, self.factor, self.bound, fine, self.fine_factor, self.fine_bound = (x[at] for x in coded)
        self.codes, self.fine = (np.ascontiguousarray(x.T).astype(np.int64) for x in (codes, fine))
        self.rounded = (vectors.shape[1] + 8) * 2.0**-51 * norms(self.vectors)

    def reached(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The k-th largest score of ids, which are in order, for each row of scores; of fewer ids, -inf."""
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if len(starts) < self.k:
            return np.full(len(scores), -np.inf)
        if len(starts) < len(ids):
            scores = np.maximum.reduceat(scores, starts, axis=1)
        return np.partition(scores, len(starts) - self.k, axis=1)[:, len(starts) - self.k]

    def least(self, near: np.ndarray, at: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """A score that each query's k-th nearest has at least: the k-th exact one of those that are best by code."""
        out = np.full(len(unit), -np.inf)
        if self.shortlist < len(at):
            for i, first in enumerate(np.argpartition(near, -self.shortlist, axis=1)[:, -self.shortlist :]):
                first = first[near[i, first] > -np.inf]
                scores = (self.vectors[at[first]] * unit[i]).sum(1)
                best = _best(self.ids[at[first]], scores, self.k)
                if len(best) == self.k:
                    out[i] = scores[best[-1]]
        return out

    def nearest(self, asked: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, places and scores of the nearest."""
        unit = wanted / norms(wanted)[:, None]
        near = _looked_up(self.model.tables(unit.astype(np.float32)), self.codes) * self.factor
        stay = np.ones(near.shape, bool)
        for i, (a, b) in enumerate(zip(np.searchsorted(self.ids, asked), np.searchsorted(self.ids, asked, "right"), strict=True)):
            near[i, a:b], stay[i, a:b] = -np.inf, False
        at = np.arange(len(self.ids))
        least = self.least(near, at, unit)
        # Comparisons that don't hold of NaN: where numbers are too large for a bound, vectors stay.
        stay &= ~(near + self.bound < least[:, None])
        at = np.flatnonzero(stay.any(0))
        stay = stay[:, at]
        if len(self.fine) and len(at):
            near = near[:, at] + _looked_up(self.model.fine_tables(unit.astype(np.float32)), self.fine[:, at]) * self.fine_factor[at]
            least = np.maximum(least, self.least(near, at, unit))
            stay &= ~(near + self.fine_bound[at] < least[:, None])
            some = stay.any(0)
            at, stay = at[some], stay[:, some]
        if not len(at):
            return iter([(at, np.empty(0))] * len(asked))
        # Exact but for the order of additions; those that may be among the k best are added up alike below.
        some = self.vectors if len(at) == len(self.ids) else self.vectors[at]
        scores = np.where(stay, unit @ some.T, -np.inf)
        stay &= ~(scores + self.rounded[at] < self.reached(scores - self.rounded[at], self.ids[at])[:, None])

        def best(i: int) -> tuple[np.ndarray, np.ndarray]:
            rows = at[np.flatnonzero(stay[i])]
            exact = (self.vectors[rows] * wanted[i]).sum(1)
            chosen = _best(self.ids[rows], exact, self.k)
            return rows[chosen], exact[chosen]

        return map(best, range(len(asked)))


def search(vectors: DataFrame, is_query, k: int = 20, train_rows: int = 8192, block_rows: int = 16_384, query_rows: int = 4096, shortlist: int = 96) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (id, vector) that is_query holds for, its k nearest."""
    spark = vectors.sparkSession
    kind = np.float32 if vectors.schema["vector"].dataType.elementType.typeName() == "float" else np.float64
    rows = usable(vectors)
    counted = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query(F.col("id"))).alias("q")).where("q > 0").collect()
    if not counted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = [r["dim"] for r in counted]
    rows = rows.where(F.col("dim").isin(dims))
    shared = spark.sparkContext.broadcast(_models(rows, dims, train_rows))
    # Blocks by rows and bytes; of a table of few blocks more, so that all cores have one.
    few = lambda r, size: -(-r // max(1, size))
    bounded = lambda dim, size: min(size, max(64, BLOCK_BYTES // (8 * dim)))
    blocks = {r["dim"]: max(few(r["n"], bounded(r["dim"], block_rows)), min(spark.sparkContext.defaultParallelism, few(r["n"], 4096))) for r in counted}
    query_blocks = {r["dim"]: few(r["q"], bounded(r["dim"], query_rows)) for r in counted}
    number = lambda of: F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("dim"))
    n_blocks, n_query_blocks = number(blocks), number(query_blocks)

    def pack(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each block and batch: ids and vectors, and codes, factors and bounds of those that are searched."""
            for batch in batches:
                out: dict[str, list] = {c: [] for c in ("dim", "block", "others", "asks", *PACKED)}
                every, cells = batch.column("dim").to_numpy(), batch.column("block").to_numpy()
                for dim in np.unique(every):
                    own = np.flatnonzero(every == dim)
                    full = _matrix(batch.column("vector").take(pa.array(own)), np.float64)
                    ids = batch.column("id").to_numpy(zero_copy_only=False)[own].astype(np.int64)
                    parts = [ids, full.astype(kind)]
                    if not asks:
                        with np.errstate(all="ignore"):
                            parts += shared.value[int(dim)].bounded(full)
                    for b in np.unique(cells[own]):
                        at = np.flatnonzero(cells[own] == b)
                        packed = [x[at].tobytes() for x in parts] + [None] * (len(PACKED) - len(parts))
                        for column, x in zip(out.values(), (int(dim), int(b), batch.column("others")[int(own[0])].as_py(), asks, *packed), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("others", pa.int32()), ("asks", pa.bool_()), *((c, pa.binary()) for c in PACKED)]))

        return run

    packed = "dim int, block int, others int, asks boolean, " + ", ".join(f"{c} binary" for c in PACKED)
    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    candidates = map_arrow(rows.select("id", "vector", "dim", _blocks(n_blocks, 0).alias("block"), n_query_blocks.cast("int").alias("others")), pack(False), packed)
    queries = map_arrow(rows.where(is_query(F.col("id"))).select("id", "vector", "dim", _blocks(n_query_blocks, 1).alias("block"), n_blocks.cast("int").alias("others")), pack(True), packed)
    met = candidates.select("dim", F.col("block").alias("c"), every.alias("q"), "asks", *PACKED).unionByName(queries.select("dim", every.alias("c"), F.col("block").alias("q"), "asks", *PACKED))

    def nearest(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        sides = group.filter(pa.compute.invert(group["asks"])), group.filter(group["asks"])
        read = lambda side, c, dtype: np.frombuffer(b"".join(x.as_py() for x in sides[side][c]), dtype)
        ids, asked = read(0, "ids", np.int64), read(1, "ids", np.int64)
        out: tuple[list, list, list] = ([], [], [])
        if len(ids) and len(asked):
            with np.errstate(all="ignore"):
                # All rows of an id are in this block.
                coded = [read(0, c, np.uint8).reshape(len(ids), -1) if c in ("codes", "fine") else read(0, c, np.float64) for c in PACKED[2:]]
                block = _Block(shared.value[dim], ids, read(0, "vectors", kind).reshape(-1, dim), tuple(coded), k, shortlist)
                wanted = read(1, "vectors", kind).reshape(-1, dim)
                for at in range(0, len(asked), 16):
                    some = asked[at : at + 16]
                    for q, (places, scores) in zip(some, block.nearest(some, wanted[at : at + 16].astype(np.float64)), strict=True):
                        for column, x in zip(out, (np.full(len(places), q), block.ids[places], scores), strict=True):
                            column.append(x)
        flat = [np.concatenate(x) if x else np.empty(0, of) for x, of in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), flat, strict=True)))

    found = met.groupBy("dim", "c", "q").applyInArrow(nearest, "query_id long, vec_id long, score double")
    # Rows of a query's id, and dimensions of one id, were searched apart.
    scored = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return search(vectors, lambda i: i % 20 == 0)
