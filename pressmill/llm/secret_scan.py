"""Secret scans with multipart credential linking, in built-in expressions only.

Three strong kinds are reported wherever they match. Weak parts (other identifiers, bare 40-character keys, endpoints)
are reported only where parts that complete them stand near: within one document, the scope, the parts are joined by
interval where the gap from the end of one to the start of the other is at most LINK_CHARS, as the nearest in a range of
the points at which parts start and end. Parts that overlap don't complete each other. An identifier needs a secret, a
bare key an identifier; an endpoint needs a secret, and an identifier that a secret completes.

Positions are in code points, end exclusive. A text is split at the matches of a kind, so that a match starts at the
sum of all pieces and matches before it; those sums are window sums over a document's matches.

Defined results: null and empty texts have no spans and the digest of an empty string; overlapping kinds are all
reported; repeated rows are scanned each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order that breaks ties, and their patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = (
    ("assign", ASSIGN),
    # As the run after AKIA is maximal, a minimum length in the pattern drops what a later test would drop.
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]{32,}"),
)
WEAK = (
    ("id", r"""(?i:client_?id|access_?key_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""),
    # NAME=key, and a key before a full stop, count; parts of longer runs, and what follows or bears padding, don't.
    ("key", r"(?<![A-Za-z0-9+/_.-]|==)[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-]|\.[A-Za-z0-9+/=_.-])"),
    ("url", r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"),
)
KINDS = (*STRONG, *WEAK)
LEAST_VALUE = 8
LINK_CHARS = 240
MARK = "[REDACTED]"


def _parts(text: Column) -> Column:
    """For each kind that occurs, its matches and the pieces between them; a part of kind -1 stands for the document."""
    t = F.coalesce(text, F.lit(""))
    head = F.struct(F.lit(-1).alias("kind"), F.array(F.lit("")).alias("found"), F.array(F.lit("")).alias("pieces"))
    of_kind = [
        F.when(
            t.rlike(pattern),
            F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("pieces")),
        )
        for k, (_, pattern) in enumerate(KINDS)
    ]
    return F.filter(F.array(head, *of_kind), lambda x: x.isNotNull())


def _matches(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text_hash and kind, start and end of every match; a row of kind -1 for each row of docs."""
    # The key is made before the rows are exploded, so that all parts of a document share it.
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", F.xxhash64("text").alias("text_hash"), _parts(F.col("text")).alias("parts"))
    rows = rows.select("row_key", "doc_id", "text_hash", F.explode("parts").alias("p"))
    rows = rows.select("row_key", "doc_id", "text_hash", "p.kind", F.posexplode(F.arrays_zip("p.found", "p.pieces")).alias("i", "x"))
    found, piece = F.col("x.found"), F.col("x.pieces")
    rows = rows.select(
        "row_key",
        "doc_id",
        "text_hash",
        "kind",
        "i",
        F.length(piece).cast("long").alias("gap"),
        F.length(found).cast("long").alias("size"),
        F.when(F.col("kind") == 0, F.length(F.regexp_extract(found, ASSIGN, 1)) >= LEAST_VALUE).otherwise(True).alias("passes"),
    ).where(F.col("size").isNotNull())
    # One exchange: the windows and the grouping below all follow from being dealt by row_key.
    rows = rows.repartition("row_key")
    so_far = Window.partitionBy("row_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return rows.withColumn("end", end).where("passes").select("row_key", "doc_id", "text_hash", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


#: What the parts of a secret are: the kinds that identify, and those that are secret.
IDS, SECRETS = ("access", "id"), ("assign", "hex", "key")
NAME = {kind: k for k, (kind, _) in enumerate(KINDS)}


def _nearest(matches: DataFrame, **kinds: Column) -> DataFrame:
    """matches with, for each name, the nearest part (kind, start, end) whose row the condition holds for and that lies
    within LINK_CHARS before or after, or null."""
    points = matches.select("*", F.posexplode(F.array("start", "end")).alias("_is_end", "_at"))
    by_point = Window.partitionBy("row_key").orderBy("_at")
    before, after = by_point.rangeBetween(-LINK_CHARS, 0), by_point.rangeBetween(0, LINK_CHARS)
    for name, wanted in kinds.items():
        # At a part's start the last end before it, at its end the first start after it.
        earlier = F.max(F.when((F.col("_is_end") == 1) & wanted, F.struct("end", "start", "kind"))).over(before)
        later = F.min(F.when((F.col("_is_end") == 0) & wanted, F.struct("start", "end", "kind"))).over(after)
        part = F.when(F.col("_is_end") == 0, F.struct((F.col("start") - earlier["end"]).alias("gap"), earlier["kind"].alias("kind"), earlier["start"].alias("start"), earlier["end"].alias("end")))
        part = part.otherwise(F.struct((later["start"] - F.col("end")).alias("gap"), later["kind"].alias("kind"), later["start"].alias("start"), later["end"].alias("end")))
        points = points.withColumn(name, F.when(part["gap"].isNotNull(), part))
    # Both points of a part are in one partition of row_key; equal parts of a row are one part.
    return points.groupBy(*matches.columns).agg(*(F.min(name).alias(name) for name in kinds))


def _reported(matches: DataFrame) -> DataFrame:
    """Without the weak parts that nothing near completes; with id_part and secret_part, the nearest that do."""
    kind = F.col("kind")
    of = lambda names: kind.isin(*(NAME[k] for k in names))
    near = _nearest(matches, id_part=of(IDS), secret_part=of(SECRETS))
    near = _nearest(near, linked_part=of(IDS) & F.col("secret_part").isNotNull())
    has_id, has_secret = F.col("id_part").isNotNull(), F.col("secret_part").isNotNull()
    keep = (kind < len(STRONG)) | ((kind == NAME["id"]) & has_secret) | ((kind == NAME["key"]) & has_id) | ((kind == NAME["url"]) & F.col("linked_part").isNotNull() & has_secret)
    return near.where(keep).withColumn("id_part", F.when(kind == NAME["url"], F.col("linked_part")).otherwise(F.col("id_part"))).drop("linked_part")


def links(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start and end of every reported part, and the nearest identifier and secret that it goes with
    (structs of kind, start and end, or null)."""
    names = F.array(*(F.lit(k) for k, _ in KINDS))
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.element_at(names, F.col(c)["kind"] + 1).alias("kind"), F.col(c)["start"].alias("start"), F.col(c)["end"].alias("end")))
    found = _reported(_matches(docs)).where("kind >= 0")
    return found.select("doc_id", F.element_at(names, F.col("kind") + 1).alias("kind"), "start", "end", named("id_part").alias("id_part"), named("secret_part").alias("secret_part"))


def _listing(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, _ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, counts of the strong kinds, base_sha256, spans."""
    found = _reported(_matches(docs))
    kind = F.col("kind")
    grouped = found.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count_if(kind == k).alias(f"n_{name}") for k, (name, _) in enumerate(STRONG)),
        F.array_sort(F.collect_list(F.when(kind >= 0, F.struct("start", "kind", "end")))).alias("_spans"),
    )
    base = F.filter("_spans", lambda s: s["kind"] < len(STRONG))
    return grouped.select("doc_id", *(f"n_{name}" for name, _ in STRONG), F.sha2(_listing(base), 256).alias("base_sha256"), _listing(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every reported span of text replaced by MARK; rows without a span don't move."""
    text = F.coalesce(F.col("text"), F.lit(""))
    may_hold = F.lit(False)
    for _, pattern in KINDS:
        may_hold = may_hold | text.rlike(pattern)
    suspects = docs.where(may_hold)
    by_start = Window.partitionBy("row_key").orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        _reported(_matches(suspects))
        .where("kind >= 0")
        .withColumn("_new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
        .withColumn("_island", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("row_key", "_island")
        .agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row_key")
        .agg(F.first("doc_id").alias("_doc"), F.first("text_hash").alias("_hash"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
        # Rows with one id and text have the same spans: one of them is enough.
        .groupBy("_doc", "_hash")
        .agg(F.first("_cuts").alias("_cuts"))
    )
    joined = suspects.join(islands, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left")
    n = F.size("_cuts")
    piece = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            F.col("text"),
            F.coalesce(F.try_element_at(F.col("_cuts"), F.when(i > 0, i)).getField("end"), F.lit(0)).cast("int") + 1,
            (F.coalesce(F.try_element_at(F.col("_cuts"), i + 1).getField("start"), F.length("text").cast("long")) - F.coalesce(F.try_element_at(F.col("_cuts"), F.when(i > 0, i)).getField("end"), F.lit(0))).cast("int"),
        ),
    )
    cleaned = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(piece, MARK))
    return docs.where(~may_hold).unionByName(joined.withColumn("text", cleaned).select(docs.columns))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
