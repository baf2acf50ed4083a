"""Weighted ratio estimates with cluster-robust errors, and the unpivot that feeds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a caller may group by; anything else is refused before a plan is built.
GROUPABLE = frozenset({"period", "month", "year", "segment", "status", "source", "target", "kind"})


def unpivot_targets(wide: DataFrame, keys: Sequence[str], targets: Sequence[str], relevance: str, parts: Sequence[str]) -> DataFrame:
    """One row per key and target from columns ``<target>_<part>``, in a single scan.

    ``weight`` is the relevance times the target's presence, the first of ``parts``.
    """
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("target"),
            (F.col(relevance) * F.col(f"{t}_{parts[0]}")).alias("weight"),
            *[F.col(f"{t}_{p}").alias(p) for p in parts],
        )
        for t in targets
    ])
    return wide.select(*keys, F.inline(rows))


def ratio_estimate(rows: DataFrame, groups: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Weighted mean of ``positive - negative`` per group from ``rows(cluster, weight, positive, negative)``.

    Sums are taken per cluster first; with R the ratio of sums and k clusters the squared error is
    k/(k-1) times the sum of squared residuals n - R d over the squared denominator. A group of weight 0
    has no score, one of a single cluster the error 0.
    """
    unknown = set(groups) - GROUPABLE
    if unknown:
        raise ValueError(f"not a grouping column: {sorted(unknown)}")
    signed = F.col("weight") * (F.col("positive") - F.col("negative"))
    per = rows.groupBy(*groups, cluster).agg(
        F.sum(signed).alias("n"),
        F.sum("weight").alias("d"),
        F.sum(F.col("weight") * F.col("positive")).alias("p"),
        F.sum(F.col("weight") * F.col("negative")).alias("m"),
        F.count(F.lit(1)).alias("r"),
    )
    moments = per.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("r").alias("records"),
        *[F.sum(c).alias(f"s_{c}") for c in "ndpm"],
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.col("d")).alias("nd"),
        F.sum(F.col("d") * F.col("d")).alias("dd"),
    )
    ratio = F.try_divide("s_n", "s_d")
    spread = F.try_divide(F.col("clusters"), F.col("clusters") - 1) * (F.col("nn") - 2 * ratio * F.col("nd") + ratio * ratio * F.col("dd"))
    error = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(spread, F.col("s_d") * F.col("s_d"))))
    return moments.select(
        *groups,
        "clusters",
        "records",
        F.round("s_d", 6).alias("total_weight"),
        F.round(ratio, 6).alias("score"),
        F.round(F.try_divide("s_p", "s_d"), 6).alias("positive_share"),
        F.round(F.try_divide("s_m", "s_d"), 6).alias("negative_share"),
        F.round(error, 6).alias("standard_error"),
    )


def hard_ratio(rows: DataFrame, groups: Sequence[str], qualifies: str, cluster: str = "cluster") -> DataFrame:
    """The same on labels: rows that qualify weigh 1, and clusters without one don't count."""
    kept = rows.where(qualifies).withColumn("weight", F.lit(1.0))
    labelled = kept.withColumn("positive", (F.col("label") > 0).cast("double")).withColumn("negative", (F.col("label") < 0).cast("double"))
    return ratio_estimate(labelled, groups, cluster)
