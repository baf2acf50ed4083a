"""Lookups that add columns, and the counters that prove they changed nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrich(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str, add: Sequence[str], after: str) -> DataFrame:
    """``rows`` with the lookup's columns placed behind ``after``; a key without a match gets nulls.

    A key that the lookup has twice would multiply rows, which ``integrity`` counts.
    """
    theirs = lookup.select(F.col(lookup_key).alias("_key"), *add)
    at = rows.columns.index(after) + 1
    return rows.join(theirs, F.col(key) == F.col("_key"), "left").select(*rows.columns[:at], *add, *rows.columns[at:])


def integrity(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str, agree: Column | None = None) -> DataFrame:
    """One row of counters: input rows, null keys, unmatched rows, repeated lookup keys, mismatches among matches."""
    others = [c for c in lookup.columns if c != lookup_key]
    # Of rows that repeat a key the smallest speaks, in whatever order they lie.
    least = [F.min(F.struct(*others)).alias("_row")] if others else []
    per = lookup.groupBy(F.col(lookup_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), *least)
    per = per.select("_key", "_n", *[F.col("_row")[c].alias(f"_{c}") for c in others])
    joined = rows.join(per, F.col(key) == F.col("_key"), "left")
    wrong = ~F.coalesce(agree, F.lit(False)) & F.col("_n").isNotNull() if agree is not None else F.lit(False)
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.count_if(F.col("_n").isNull()).alias("unmatched"),
        F.count_if(F.col("_n") > 1).alias("ambiguous"),
        F.count_if(wrong).alias("mismatched"),
    )


def unchanged(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the projection on one side only, with multiplicity; both counts are 0 if nothing changed."""
    hashed = lambda df, sign: df.select(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g"), F.lit(sign).alias("s"))
    net = hashed(before, 1).unionAll(hashed(after, -1)).groupBy("h", "g").agg(F.sum("s").alias("d"))
    return net.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("gained"))


def aligned(parts: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Mean of a value over several tables joined by key, never by position; keys that not all have are left out."""
    out = parts[0].select(key, F.col(value).alias("_v0"))
    for k, part in enumerate(parts[1:], 1):
        out = out.join(part.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), F.col(key) == F.col(f"_k{k}")).drop(f"_k{k}")
    total = F.col("_v0")
    for k in range(1, len(parts)):
        total = total + F.col(f"_v{k}")
    return out.select(key, (total / len(parts)).alias(value))


def linked(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """Left rows with the sorted members of the right that share the key."""
    own = right.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return left.join(own, F.col(key) == F.col("_key"), "left").drop("_key")


def merge_checked(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Outer merge of two arms; ``conflicts`` counts columns on which both have values that differ."""
    theirs = right.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = left.select(key, *columns).join(theirs, F.col(key) == F.col("_key"), "full_outer")
    clash = F.lit(0)
    for c in columns:
        clash = clash + F.coalesce((F.col(c) != F.col(f"_{c}")).cast("int"), F.lit(0))
    return both.select(
        F.coalesce(key, "_key").alias(key), *[F.coalesce(c, f"_{c}").alias(c) for c in columns], clash.cast("long").alias("conflicts")
    )
