"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the (domain, language, source) triples of a corpus. A token budget goes down the tree: each node divides its
own among its children by weight, and none gets more than the tokens below it can give in MAX epochs. What a child can't
use goes to its siblings by weight first; only what a whole node can't use goes to the node's own siblings. For a set of
children this is one water level, found by window sums over the children in the order of capacity to weight.

A leaf's budget is taken as whole epochs and a prefix of one more, in an order seeded by epoch: documents while the sum
of their tokens stays within the budget. The prefix ends at one cut value of the order, found from sums over ranges of
it and then inside one range, so that a leaf with most of the rows isn't ordered in one task; documents are then
compared with their leaf's cut and never shuffled.

Tokens are estimated as a quarter of the UTF-8 bytes, at least 1.

Bound: leaves are broadcast only if there are at most BROADCAST_LEAVES, and are else joined by shuffle.

Defined results: null texts have one token; null languages and sources are a value of their own (empty); weights that
are not named are 1, and a weight of 0 takes nothing; rows with one id tie and are taken or left together; extra columns
are kept, but those named as the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_tasks, stored, table

LEVELS = ("domain", "language", "source_name")
ADDED = ("domain", "language", "source_name", "n_tokens", "epoch")
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Target:
    """share of all tokens to take, and weights by name on each level."""

    share: float = 0.6
    max_epochs: int = 3
    seed: int = 17
    domains: dict[str, float] = field(default_factory=dict)
    languages: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)


#: The targets of the registered query and of the pipeline.
TARGET = Target(domains={"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}, languages={"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0})


def domain_of(source: Column) -> Column:
    """Sources carry no domain here: their number, modulo four, stands for one."""
    return F.concat(F.lit("domain"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int") % 4, F.lit(0)).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("long")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch's order: 60 bits of a digest."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _weight(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def _divide(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds given, each child's part of budget (the parent's): children have weight and capacity."""
    within = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = within.orderBy((F.col("capacity") / F.col("weight")).asc_nulls_first(), children.columns[len(parent)])
    before = F.coalesce(F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        children.where("weight > 0")
        .withColumn("_level", (F.col("budget") - before) / still)
        .withColumn("given", F.least(F.col("capacity"), F.col("weight") * F.max("_level").over(within)))
        .drop("_level")
    )


def budgets(leaves: DataFrame, target: Target) -> DataFrame:
    """The leaves (with available tokens) and given, the tokens to take from each."""
    d, l, s = LEVELS  # noqa: E741
    leaf = leaves.select(*LEVELS, "available", _weight(F.col(s), target.sources).alias("weight"), (F.col("available") * float(target.max_epochs)).alias("capacity"))
    language = leaf.where("weight > 0").groupBy(d, l).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col(l), target.languages))
    domain = language.where("weight > 0").groupBy(d).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col(d), target.domains))
    whole = leaves.agg((F.coalesce(F.sum("available"), F.lit(0)) * target.share).alias("budget"))
    top = _divide(domain.join(F.broadcast(whole)), []).select(d, F.col("given").alias("budget"))
    middle = _divide(language.join(top, d).select(d, l, "capacity", "weight", "budget"), [d]).select(d, l, F.col("given").alias("budget"))
    return _divide(leaf.join(middle, [d, l]).select(d, l, s, "available", "capacity", "weight", "budget"), [d, l]).select(*LEVELS, "available", "given")


def select(docs: DataFrame, target: Target = TARGET) -> DataFrame:
    """The rows of docs, once for each epoch that takes them, with the columns in ADDED."""
    names = [F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("source_name")]
    light = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), *names, tokens_of(F.col("text")).alias("n_tokens"))
    leaves = stored(light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_docs")), few_tasks(docs.sparkSession))
    given = budgets(leaves, target).join(leaves.select(*LEVELS, "n_docs"), list(LEVELS))
    whole = F.floor(F.col("given") / F.col("available"))
    given = stored(
        given.select(
            *LEVELS,
            whole.cast("int").alias("whole_epochs"),
            F.floor(F.col("given") - whole * F.col("available")).cast("long").alias("rest"),
            # As many ranges as documents in a range.
            F.ceil(F.sqrt("n_docs")).cast("long").alias("ranges"),
        ),
        few_tasks(docs.sparkSession),
    )
    hint = F.broadcast if given.count() <= BROADCAST_LEAVES else (lambda df: df)
    at = place(target.seed, F.col("whole_epochs"), F.col("doc_id"))
    placed = light.join(hint(given.where("rest > 0")), list(LEVELS)).withColumn("at", at)
    width = F.floor(F.lit(float(1 << 60)) / F.col("ranges")).cast("long") + 1
    placed = placed.withColumn("range", F.floor(F.col("at") / width))
    sums = placed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(upto))
    # The range in which the budget ends, and what is left of it there.
    split = sums.where("upto > rest").groupBy(*LEVELS).agg(F.min("range").alias("range"), F.min_by(F.col("rest") - F.col("upto") + F.col("n"), "range").alias("left_over"))
    inside = placed.join(hint(split), [*LEVELS, "range"]).groupBy(*LEVELS, "range", "at").agg(F.sum("n_tokens").alias("n"), F.first("left_over").alias("left_over"))
    in_order = Window.partitionBy(*LEVELS, "range").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.sum("n").over(in_order)).where("upto > left_over").groupBy(*LEVELS).agg(F.min("at").alias("cut"))
    cuts = stored(given.drop("rest", "ranges").join(last, list(LEVELS), "left").join(given.where("rest > 0").select(*LEVELS, F.lit(True).alias("partial")), list(LEVELS), "left"), few_tasks(docs.sparkSession))
    kept = [c for c in docs.columns if c not in ADDED]
    wide = docs.select(*kept, domain_of(F.col("source")).alias("domain"), *names, tokens_of(F.col("text")).alias("n_tokens"))
    wide = wide.join(hint(cuts), list(LEVELS))
    # Without a cut, a partial epoch takes all (its budget lies between the last sum and the whole).
    in_part = F.col("partial").isNotNull() & F.coalesce(at < F.col("cut"), F.lit(True))
    times = F.col("whole_epochs") + in_part.cast("int")
    return wide.where(times > 0).select(*kept, "domain", "language", "source_name", "n_tokens", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"))


def op10_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return select(docs).select("doc_id", "domain", "language", "source_name", "n_tokens", "epoch")


def _case(name: str, weights: dict[str, float]) -> str:
    return f"CASE {' '.join(f"WHEN {name} = '{k}' THEN {float(v)!r}::DOUBLE" for k, v in weights.items())} ELSE 1.0::DOUBLE END" if weights else "1.0::DOUBLE"


def _level_sql(children: str, parent: str, name: str) -> str:
    """given of each child, as _divide has it."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
      SELECT * EXCLUDE (lv), least(capacity, weight * max(lv) OVER ({part})) AS given FROM (
        SELECT *, (budget - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER ({part} ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
        FROM ({children}) WHERE weight > 0)"""


def oracle(target: Target = TARGET, docs: str = "documents", columns: str = "doc_id, domain, language, source_name, n_tokens, epoch") -> str:
    return f"""
    WITH light AS (
      SELECT d.*, 'domain' || coalesce((try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER) % 4)::VARCHAR, '0') AS domain,
        coalesce(lang, '') AS language, coalesce(source, '') AS source_name, greatest(1, (strlen(coalesce(text, '')) + 3) // 4)::BIGINT AS n_tokens
      FROM {docs} d),
    leaves AS (SELECT domain, language, source_name, sum(n_tokens)::BIGINT AS available FROM light GROUP BY ALL),
    leaf AS (SELECT *, {_case("source_name", target.sources)} AS weight, available * {float(target.max_epochs)}::DOUBLE AS capacity FROM leaves),
    lng AS (SELECT domain, language, sum(capacity) AS capacity, {_case("language", target.languages)} AS weight FROM leaf WHERE weight > 0 GROUP BY domain, language),
    dom AS (SELECT domain, sum(capacity) AS capacity, {_case("domain", target.domains)} AS weight FROM lng WHERE weight > 0 GROUP BY domain),
    d1 AS ({_level_sql(f"SELECT dom.*, (SELECT sum(available) * {target.share!r}::DOUBLE FROM leaves) AS budget FROM dom", "", "domain")}),
    d2 AS ({_level_sql("SELECT lng.*, d1.given AS budget FROM lng JOIN d1 USING (domain)", "domain", "language")}),
    d3 AS ({_level_sql("SELECT leaf.*, d2.given AS budget FROM leaf JOIN d2 USING (domain, language)", "domain, language", "source_name")}),
    plan AS (SELECT domain, language, source_name, floor(given / available)::INTEGER AS whole_epochs,
        floor(given - floor(given / available) * available)::BIGINT AS rest FROM d3),
    placed AS (SELECT *, ('0x' || md5('{target.seed}-' || whole_epochs || '-' || coalesce(doc_id::VARCHAR, 'null'))[1:15])::BIGINT AS place_at
      FROM light JOIN plan USING (domain, language, source_name)),
    summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source_name ORDER BY place_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
    times AS (SELECT *, whole_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n_times FROM summed),
    taken AS (SELECT *, unnest(range(n_times))::INTEGER AS epoch FROM times WHERE n_times > 0)
    SELECT {columns} FROM taken"""


ORACLE_SQL = oracle()
