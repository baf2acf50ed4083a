"""Representatives, exposure filters and anti-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranks import hash_rank


def representative(rows: DataFrame, group: str, order: str, tie: str) -> DataFrame:
    """The row with the smallest ``order`` of each group, by an aggregate: no sort, and hot groups combine early."""
    best = rows.groupBy(F.col(group).alias("_group")).agg(F.min(F.struct(order, tie)).alias("_best"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col(order) == F.col("_best")[order]) & (F.col(tie) == F.col("_best")[tie])
    return rows.join(best, same).select(*rows.columns)


def drop_consumed(rows: DataFrame, consumed: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows none of whose keys was consumed; each of (table, its key, the rows' key) is its own anti-join.

    One condition with OR would compare every row with every consumed one.
    """
    for table, theirs, ours in consumed:
        keys = table.where(F.col(theirs).isNotNull()).select(F.col(theirs).alias("_used")).distinct()
        rows = rows.join(keys, F.col(ours) == F.col("_used"), "left_anti")
    return rows


def duplicate_groups(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Groups of more than one row with an equal key: size and smallest member."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("first"))
    return out.where(F.col("n") > 1)


def overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Keys that both sides have, with their counts; copies are not multiplied out."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_n"), F.min(left_id).alias("left_first"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_n"), F.min(right_id).alias("right_first"))
    return a.join(b, key)


def identity_mismatch(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of counts: identities on one side only, and on both."""
    a = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    b = observed.select(*keys).distinct().withColumn("_o", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(
        F.count_if(F.col("_o").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("unexpected"),
        F.count_if(F.col("_e").isNotNull() & F.col("_o").isNotNull()).alias("matched"),
    )


def numbered_representatives(rows: DataFrame, group: str, order: str, tie: str) -> DataFrame:
    """Rank and population size of each row in its group; ``order`` is a hex digest, by which large groups are split."""
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("population"))
    ranked = hash_rank(rows, [group], order, tie)
    return ranked.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
