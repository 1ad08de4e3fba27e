"""License scans by diagonal voting.

Templates are short phrases and longer notices. Every run of k words of a document is hashed and joined by Spark with
the positions of such runs in the templates: a hit at document word i and template word j votes for the diagonal
i - j. Votes are counted by document, template and diagonal; neighbouring diagonals of a notice (words put in or left
out) are merged; a merged span is verified by the share of the notice's runs that it holds in order: going through the
span's hits by document word, a hit counts if it stands later in the notice than all hits before it. A run that is
repeated counts once, and runs out of order don't count.

A phrase counts only where its diagonal holds all of its runs, so that its words stand consecutively.

Runs are compared by hashes of 64 bits of their words; a span takes half of a notice's runs, so equal hashes of different
words can't make one.

Bounds: the templates are fixed, so their positions are the only thing that is broadcast. A diagonal has at most one hit
for each run of its template.

Defined results: null and empty texts have no words and no labels; repeated rows are scanned each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import map_arrow, table

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
PHRASE_K = 2
#: Sentences of public license notices and their labels.
NOTICES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        "apache",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version",
        "gpl",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation",
        "lgpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "bsd",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
        "bsd-3-clause",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
        "mpl",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software",
        "unlicense",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software",
        "boost",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software",
        "zlib",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
        "public license as published by the free software foundation",
        "agpl",
    ),
    (
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "epl",
    ),
    (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "cc0",
    ),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl"),
)
NOTICE_K = 4
#: A notice is verified if a span holds this share of its runs of words.
COVERAGE = 0.5
#: Diagonals of one notice at most so many words apart are merged.
DRIFT = 6


def _hashes(text: str) -> np.ndarray:
    return next(words.chunks(pa.array([text]), words.LETTER_DIGIT))[1].hashes


def positions(spark: SparkSession) -> DataFrame:
    """gram, and where it stands: an array of (template, tpos). Of fixed size."""
    found: dict[int, list[tuple[int, int]]] = {}
    for t, (text, _) in enumerate((*PHRASES, *NOTICES)):
        k = PHRASE_K if t < len(PHRASES) else NOTICE_K
        for j, h in enumerate(words.grams(_hashes(text), k).view(np.int64)):
            found.setdefault(int(h), []).append((t, j))
    return spark.createDataFrame(sorted(found.items()), "gram long, places array<struct<template:int,tpos:int>>")


def templates(spark: SparkSession) -> DataFrame:
    """template, its label, its number of runs and of words, and whether it is a phrase."""
    rows = []
    for t, (text, label) in enumerate((*PHRASES, *NOTICES)):
        k = PHRASE_K if t < len(PHRASES) else NOTICE_K
        rows.append((t, label, len(text.split()) - k + 1, len(text.split()), t < len(PHRASES)))
    return spark.createDataFrame(rows, "template int, label string, n_grams int, n_template_words int, phrase boolean")


def rolling_grams(docs: DataFrame) -> DataFrame:
    """For each row a key of its own, doc_id, n_words and the hashes of all runs of PHRASE_K and of NOTICE_K words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Inputs are split and read in one order, so that a task run again gives the same keys.
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, found in words.chunks(batch.column("text"), words.LETTER_DIGIT):
                n = np.diff(found.first)
                columns = []
                for k in (PHRASE_K, NOTICE_K):
                    have = np.maximum(n - k + 1, 0)
                    ends = np.concatenate([[0], np.cumsum(have)])
                    every = words.grams(found.hashes, k).view(np.int64)
                    of_row = np.repeat(found.first[:-1] - ends[:-1], have) + np.arange(ends[-1])
                    columns.append(pa.LargeListArray.from_arrays(pa.array(ends), pa.array(every[of_row] if len(of_row) else np.empty(0, np.int64))))
                ids = batch.column("doc_id").slice(at, len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + len(found))), ids, pa.array(n), *(c.cast(pa.list_(pa.int64())) for c in columns)],
                    names=["row_key", "doc_id", "n_words", "short_grams", "long_grams"],
                )
                key += len(found)

    schema = f"row_key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, short_grams array<long>, long_grams array<long>"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans, and one row with template -1 for each row of docs.

    Columns: row_key, doc_id, n_words, template, label, phrase, first_word, last_word (exclusive), score.
    """
    spark = docs.sparkSession
    # One row for each run of words; place -1 stands for the document itself, so that none is lost.
    grams = rolling_grams(docs).select(
        "row_key",
        "doc_id",
        "n_words",
        F.explode(F.array(F.struct(F.lit(-1).alias("shift"), F.array(F.lit(None).cast("long")).alias("g")), F.struct(F.lit(0).alias("shift"), F.col("short_grams").alias("g")), F.struct(F.lit(0).alias("shift"), F.col("long_grams").alias("g")))).alias("x"),
    )
    grams = grams.select("row_key", "doc_id", "n_words", "x.shift", F.posexplode("x.g").alias("pos", "gram"))
    hits = (
        grams.join(F.broadcast(positions(spark)), "gram", "left")
        .where(F.col("places").isNotNull() | (F.col("shift") == -1))
        .select("row_key", "doc_id", "n_words", "pos", F.explode(F.coalesce("places", F.array(F.struct(F.lit(-1).alias("template"), F.lit(0).alias("tpos"))))).alias("p"))
        .select("row_key", "doc_id", "n_words", "p.template", "p.tpos", "pos", (F.col("pos") - F.col("p.tpos")).alias("diagonal"))
    )
    votes = hits.groupBy("row_key", "template", "diagonal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("*").alias("votes"), F.collect_list("tpos").alias("places"))
    votes = votes.join(F.broadcast(templates(spark)), "template", "left")
    # A notice's neighbouring diagonals become one span; those of a phrase and a document's own row stay apart.
    by_diagonal = Window.partitionBy("row_key", "template").orderBy("diagonal")
    notice = F.coalesce(~F.col("phrase"), F.lit(False))
    apart = F.when(notice, F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > DRIFT).otherwise(True)
    of_span = F.flatten(F.collect_list(F.transform("places", lambda t: F.struct((F.col("diagonal") + t).alias("pos"), (-t).alias("back")))))
    merged = (
        votes.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int"))
        .withColumn("_group", F.sum("_new").over(by_diagonal))
        .groupBy("row_key", "template", "_group")
        .agg(*(F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "phrase", "n_grams")), F.sum("votes").alias("votes"), F.array_sort(of_span).alias("_hits"))
        .withColumn("lo", F.col("_hits")[0]["pos"])
        .withColumn("hi", F.element_at("_hits", -1)["pos"])
    )
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    later = lambda x, h: F.when(-h["back"] > x["last"], F.struct((-h["back"]).alias("last"), (x["n"] + 1).alias("n"))).otherwise(x)
    in_order = F.aggregate("_hits", start, later, lambda x: x["n"])
    # A phrase's span is one diagonal, which holds each run once.
    merged = merged.withColumn("score", F.when(F.col("template") == -1, 0.0).otherwise(in_order / F.col("n_grams")))
    whole = (F.col("template") == -1) | (F.col("phrase") & (F.col("votes") == F.col("n_grams")))
    verified = notice & (F.col("score") >= COVERAGE)
    k = F.when(notice, NOTICE_K).otherwise(PHRASE_K)
    return merged.where(whole | verified).select("row_key", "doc_id", "n_words", "template", "label", "phrase", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + k).cast("long").alias("last_word"), "score")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.coalesce(F.col("phrase"), F.lit(False))
    return (
        spans(docs)
        .groupBy("row_key")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("score"))), F.lit(0.0)).alias("score"),
        )
        .drop("row_key")
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def phrase_words(text: str) -> list[str]:
    """Words as the operator takes them, for tests."""
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
