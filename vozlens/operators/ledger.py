"""Exclusion accounting: every row has at most one reason, and counts must balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT = "kept"


def tagged(df: DataFrame, reasons: Sequence[tuple[Column, str | Column]], column: str = "drop_reason") -> DataFrame:
    """Adds the reason of the first condition that holds; null where none does. A null condition doesn't hold."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(reasons):
        out = F.when(condition, F.lit(reason) if isinstance(reason, str) else reason).otherwise(out)
    return df.withColumn(column, out)


def ledger(df: DataFrame, column: str = "drop_reason") -> DataFrame:
    """(reason, n): one aggregation over the tagged rows, with the kept ones under ``KEPT``."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(KEPT)).alias("reason")).agg(F.count("*").alias("n"))


def kept(df: DataFrame, column: str = "drop_reason") -> DataFrame:
    return df.where(F.col(column).isNull()).drop(column)


def assert_balanced(counts: dict[str, int], total: int) -> None:
    """The reasons and the kept rows must add up to ``total``."""
    if sum(counts.values()) != total:
        raise ValueError(f"the ledger holds {sum(counts.values())} rows of {total}: {counts}")


def manifest_ledger(results: DataFrame, column: str = "status") -> DataFrame:
    """(status, n, share) of a manifest's rows."""
    counts = results.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    total = results.agg(F.count("*").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("status", "n", (F.col("n") / F.col("total")).alias("share"))


def joined_whole(left: DataFrame, right: DataFrame, on: str, agree: Sequence[str] = ()) -> DataFrame:
    """The inner join of two tables that must lose no row of ``left`` and agree on the columns named.

    A row without a partner, or with one that differs, raises where the row is computed, so no
    separate pass is made; partners must be unique by ``on``.
    """
    there = right.select(on, *[F.col(c).alias(f"_other_{c}") for c in agree], *[c for c in right.columns if c != on and c not in left.columns], F.lit(True).alias("_there"))
    both = left.join(there, on, "left")
    lost = F.raise_error(F.concat(F.lit(f"no partner for {on}="), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    out = both.withColumn(on, F.when(F.col("_there").isNull(), lost.cast(left.schema[on].dataType)).otherwise(F.col(on)))
    for c in agree:
        differs = F.raise_error(F.concat(F.lit(f"{c} differs for {on}="), F.col(on).cast("string"))).cast(left.schema[c].dataType)
        out = out.withColumn(c, F.when(~F.col(c).eqNullSafe(F.col(f"_other_{c}")), differs).otherwise(F.col(c)))
    return out.drop("_there", *[f"_other_{c}" for c in agree])
