"""A training corpus from documents: five stages, each on what the one before it kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; the last adds the columns that say where and how often a document is taken.

Stages decide on rows, not on ids: a row is known by the file and place that it is read from, so rows with one id, or
with none, each have a decision of their own. Empty tables pass every stage as empty tables, and extra columns go through
all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm import decontaminate, jaccard, language, mixture, secret_scan
from pressmill.llm.common import ROW_KEY, keyed, stored, table, without


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, or two languages that compress them alike.

    Null and empty texts have no letters and go. Every part of a long text counts. Repeated rows are decided alike.
    """
    model = language.fit(language.training_rows(docs))
    return language.accepted_only(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays: that with the smallest id, rows without an id last.

    Of rows with one id the first in file order stays. Null and empty texts are like nothing, and all stay.
    """
    rows = keyed(docs)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW_KEY)
    groups = jaccard.join(rows.select(place.alias("doc_id"), "text"))
    return without(rows, groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go.

    Null and empty texts hold nothing and stay. Of rows with one id, or with none, those go whose own text leaks.
    """
    rows = keyed(docs)
    leaks = decontaminate.find_leaks(rows.select(F.struct(*ROW_KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, leaks.select("doc_id.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; the secrets in their texts are replaced, and n_chars follows the text (null texts: null).

    Repeated rows are redacted each; a null id is no hindrance.
    """
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the target mixture, once for each epoch that takes them.

    Null texts have one token; null languages and sources are a leaf of their own; rows with one id are taken together.
    """
    return mixture.select(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
]

#: Compression, edit distance and span joins aren't expressible in SQL; tests compare each stage with a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
