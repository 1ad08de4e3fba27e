"""Line dedup over levelled sorted runs of line hashes, in built-in expressions only.

A line's key is the line without white space at its ends, in lower case; a key is kept as two 64-bit hashes. `LineRuns`
holds how many documents have each key, as sorted runs in levels. A new batch merge-anti-joins the runs, which leaves the
keys that no run knows as frequent yet, and adds these with their counts as a run of the lowest level; whenever a level has
`fanout` runs they are merged into one run of the next level, so that a batch meets a number of runs that grows with the
logarithm of the batches. Keys that have reached the threshold in a run are settled there and never counted again.

`drop_frequent` gives every document of a table without its frequent lines: the batches of the table go through the runs
one after the other, and the frequent keys are then joined to the lines. Lines travel as hashes; texts travel once, to
their dropped places. A key that stands in a large share of the documents is spread over
SALTS tasks; there are at most HOT_SHARE such keys, whatever the size of the table, so that list is broadcast.

Defined results: a null or empty text is one empty line; a key shorter than `min_chars` (1, so the empty one) is never
dropped; a line that a document repeats counts once for it and goes everywhere; each row is a document of its own, however
ids repeat; a text that loses all lines is empty; texts of any length are taken whole; columns named as results are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, Steps, few_tasks, keyed, lower_ascii, table

#: Fixed value: what is stripped at the ends of a line.
WHITE = " \t\n\v\f\r"
KEY = ("hi", "lo")
#: A key is hot where it has more than one in so many of all pairs of document and key: fewer keys than this can be.
HOT_SHARE = 10_000
SALTS = 64
SEED = 0x5EED


def line_keys(text: Column) -> Column:
    """The keys of all lines, in order."""
    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))


def key_hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("hi"), F.xxhash64(F.lit(SEED), key).alias("lo")]


def document_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """For each row, by ROW_KEY, and each of its keys: the key's hash and all places of its lines."""
    lines = docs.select(*ROW_KEY, F.posexplode(line_keys(F.col("text"))).alias("place", "key")).where(F.length("key") >= min_chars)
    return lines.select(*ROW_KEY, "place", *key_hash(F.col("key"))).groupBy(*ROW_KEY, *KEY).agg(F.collect_list("place").alias("places"))


class LineRuns:
    """How many documents have each key, in levelled sorted runs; levels[0] has the latest."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.steps, self.levels = Steps(spark), [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _run(self, counts: DataFrame) -> DataFrame:
        return self.steps.store(counts.sortWithinPartitions(*KEY), few_tasks(self.spark))[0]

    def _settled(self) -> DataFrame | None:
        settled = [run.where(F.col("n") >= self.min_docs).select(*KEY) for run in self.runs()]
        return reduce(DataFrame.unionAll, settled) if settled else None

    def add(self, lines: DataFrame) -> None:
        """Add a batch: rows of hi and lo, one for each document and key."""
        counts = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        settled = self._settled()
        if settled is not None:
            counts = counts.join(settled.hint("merge"), list(KEY), "left_anti")
        self.levels[0].append(self._run(counts))
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._run(self._merged(level)))
            self.levels[i] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, runs).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """Keys that have reached the threshold, with their counts up to the batch that settled them."""
        if not self.runs():
            return self.spark.createDataFrame([], "hi long, lo long, n long")
        return self._merged(self.runs()).where(F.col("n") >= self.min_docs)


def _dropped_places(lines: DataFrame, frequent: DataFrame, pairs: int) -> DataFrame:
    """For each row with frequent lines the places of these. pairs: the number of rows of lines."""
    hot = F.broadcast(frequent.where(F.col("n") * HOT_SHARE > pairs).select(*KEY, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*ROW_KEY), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = frequent.join(hot, list(KEY), "left").select(*KEY, F.explode(salts).alias("salt"))
    found = lines.join(hot, list(KEY), "left").withColumn("salt", salt).join(spread.hint("merge"), [*KEY, "salt"], "left_semi")
    return found.groupBy(*ROW_KEY).agg(F.flatten(F.collect_list("places")).alias("dropped"))


RESULTS = ("n_lines", "n_dropped", "kept")


def drop_frequent(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 6, fanout: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with RESULTS: the number of lines, that of dropped ones, and the others joined again."""
    spark = docs.sparkSession
    kept = [c for c in keep if c not in RESULTS]
    rows = keyed(docs)
    runs = LineRuns(spark, min_docs, fanout)
    lines, found = runs.steps.store(document_lines(rows, min_chars), n=F.count(F.lit(1)))
    for i in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64(*ROW_KEY), F.lit(batches)) == i))
    frequent, _ = runs.steps.store(runs.frequent(), few_tasks(spark))
    dropped = _dropped_places(lines, frequent, found["n"])
    # Lines are split below the join, so that each is reached by its place and not by splitting the text again.
    split = rows.select(*ROW_KEY, *kept, F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("_lines"))
    joined = split.join(dropped.hint("merge"), list(ROW_KEY), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return joined.select(*kept, F.size("_lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), text.alias("kept"))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    made = drop_frequent(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
