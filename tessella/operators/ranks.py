"""Ranks and positions without a task that holds a whole stratum or the whole table.

Rows are put into buckets that follow the order, buckets are counted, and a row's rank is the number of
rows in the buckets before plus its place in its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.staging import stage_table

#: Rows of a range of ``positions``, about.
RANGE_ROWS = 1_000_000


def _ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bases = bases.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(bases, same).withColumn(name, F.col("_base") + local).select(*[c for c in rows.columns if c != "_bucket"], name)


def hash_rank(rows: DataFrame, groups: Sequence[str], digest: str, tie: str, name: str = "rank", digits: int = 3) -> DataFrame:
    """Rank from 1 by a hex digest within each group; buckets are the digest's first digits."""
    return _ranked(rows.withColumn("_bucket", F.substring(digest, 1, digits)), groups, [F.col(digest), F.col(tie)], name)


def value_rank(rows: DataFrame, groups: Sequence[str], value: str, tie: str, name: str = "rank", ranges: int = 64) -> DataFrame:
    """Rank from 1 by a number, the largest first, within each group; buckets are ranges of the number."""
    at = [k / ranges for k in range(1, ranges)]
    borders = sorted(set(rows.agg(F.percentile_approx(value, at, 10_000).alias("b")).first()["b"] or []))
    table = F.array(*[F.lit(b) for b in borders]) if borders else F.array().cast(f"array<{dict(rows.dtypes)[value]}>")
    above = F.size(F.filter(table, lambda b: b > F.col(value)))
    return _ranked(rows.withColumn("_bucket", above), groups, [F.col(value).desc(), F.col(tie)], name)


def positions(rows: DataFrame, key: str | Column, ranges: int | None = None, name: str = "position") -> DataFrame:
    """Zero-based position in the order of a key.

    Rows are dealt into ranges of the key, as many as their number asks for, sorted and staged; a staged row's
    number says its range and its place there, so only the sizes of the ranges, one row each, are added up.
    """
    if ranges is None:
        ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    laid = rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    laid = stage_table(laid, "positions").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    bases = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(bases), F.col("_range") == F.col("_of")).select(*rows.columns, (F.col("_base") + place).alias(name))


def shard_of(position: Column, rows: int, shards: int) -> Column:
    """Contiguous shards of near-equal size; the first ``rows % shards`` have one more."""
    size, more = divmod(rows, shards)
    head = more * (size + 1)
    late = F.floor((position - head) / F.lit(max(size, 1))) + more
    return F.when(position < head, F.floor(position / F.lit(size + 1))).otherwise(late).cast("long")
