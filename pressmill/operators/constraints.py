"""What a database's constraints say, for tables that are files: defaults, required columns, keys and references.

Rows that break a rule are kept apart, with the first rule that they break, and are counted by the write that stores the
rows, so nothing is read again. A layout by ranges of some columns does what an index does: readers skip the row groups whose
ranges don't meet their filter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """defaults: taken where a column is null, before the rules. key: columns that no two rows share.

    references: a column, or several joined by commas, and the rows that it refers to, whose columns have the same names; a
    null refers to nothing, and breaks no reference.
    """

    required: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    references: dict[str, DataFrame] = field(default_factory=dict)
    defaults: dict[str, Column] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*(f"null {c}" for c in (*self.required, *(k for k in self.key if k not in self.required))), *(["key"] if self.key else []), *(f"reference {c}" for c in self.references)]


def checked(rows: DataFrame, rules: Rules, order: Column) -> DataFrame:
    """rows with defaults and the column violation: the first rule of rules.names that a row breaks, or null.

    Of rows with one key the first in order has it, and the others break the rule; order has to tell them apart (of equal
    ones, none breaks it). Keys are folded by partial aggregates, so a hot key's rows don't meet before they are counted.
    """
    out = rows.withColumns({c: F.coalesce(c, v) for c, v in rules.defaults.items()}).withColumn("_order", order)
    nulls = [c for c in (*rules.required, *(k for k in rules.key if k not in rules.required))]
    rule = F.lit(None).cast("string")
    for c, referred in reversed(rules.references.items()):
        names, hit = c.split(","), f"_refers_{c.replace(',', '_')}"
        out = out.join(referred.select(*names).distinct().withColumn(hit, F.lit(True)), names, "left")
        complete = F.lit(True)
        for n in names:
            complete &= F.col(n).isNotNull()
        rule = F.when(complete & F.col(hit).isNull(), F.lit(f"reference {c}")).otherwise(rule)
    if rules.key:
        out = out.join(out.groupBy(*rules.key).agg(F.min("_order").alias("_first")), list(rules.key), "left")
        rule = F.when(F.col("_order") > F.col("_first"), F.lit("key")).otherwise(rule)
    for c in reversed(nulls):
        rule = F.when(F.col(c).isNull(), F.lit(f"null {c}")).otherwise(rule)
    return out.withColumn("violation", rule).select(*rows.columns, "violation")


def store(rows: DataFrame, rules: Rules, path: str, sorted_by: tuple[str, ...] = (), files: int = 16) -> dict[str, int]:
    """Write checked rows below path, as kept=1 and kept=0; the number of rows for each rule, and for none.

    sorted_by: kept rows are laid out by ranges of these columns, in about so many files.
    """
    seen = Observation()
    counts = [F.count_if(F.col("violation") == name).alias(name) for name in rules.names]
    out = rows.withColumn("kept", F.col("violation").isNull().cast("int"))
    if sorted_by:
        out = out.repartitionByRange(files, "kept", *sorted_by).sortWithinPartitions("kept", *sorted_by)
    # After the exchange, as ranges are found by a pass over the rows that would be counted too.
    out = out.observe(seen, F.count_if(F.col("violation").isNull()).alias("kept"), *counts)
    out.write.partitionBy("kept").mode("errorifexists").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def kept(rows: DataFrame) -> DataFrame:
    """The rows of a stored table (read from store's path) that break no rule."""
    return rows.where("kept = 1").drop("kept", "violation")
