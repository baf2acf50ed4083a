"""Time series, standardisation and decomposition over cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_groups(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``weight`` and the weighted mean ``score`` of ``rows(weight, score)`` per group."""
    out = rows.groupBy(*groups).agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("score")).alias("_ws"))
    return out.select(*groups, "weight", F.try_divide("_ws", "weight").alias("score"))


def equal_weight_mean(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unweighted mean of the cells' scores."""
    return cells.groupBy(*by).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("cells"))


def standardise(cells: DataFrame, period: str, keys: Sequence[str]) -> DataFrame:
    """Observed, fixed-composition and composition-only score per period.

    Reference shares and means pool all periods; the fixed composition is scaled to the cells that a
    period has.
    """
    pooled = cells.groupBy(*keys).agg(F.sum("weight").alias("pw"), F.sum(F.col("weight") * F.col("score")).alias("ps"))
    total = pooled.agg(F.sum("pw").alias("all_weight"))
    pooled = pooled.crossJoin(F.broadcast(total)).select(*keys, (F.col("pw") / F.col("all_weight")).alias("share"), F.try_divide("ps", "pw").alias("mean"))
    joined = cells.join(pooled, list(keys))
    sums = joined.groupBy(period).agg(
        F.sum("weight").alias("w"),
        F.sum(F.col("weight") * F.col("score")).alias("ws"),
        F.sum("share").alias("available"),
        F.sum(F.col("share") * F.col("score")).alias("fixed"),
        F.sum(F.col("weight") * F.col("mean")).alias("composed"),
        F.count(F.lit(1)).alias("cells"),
    )
    return sums.select(
        period,
        F.try_divide("ws", "w").alias("observed"),
        F.try_divide("fixed", "available").alias("fixed_composition"),
        F.try_divide("composed", "w").alias("composition_only"),
        "cells",
    )


def contributions(cells: DataFrame, period: str, keys: Sequence[str], start: int, end: int) -> DataFrame:
    """Symmetric within and composition contributions of the cells that both periods have.

    A cell's share is its part of the weight of all cells of the period, shared or not.
    """

    def one(value: int, name: str) -> DataFrame:
        own = cells.where(F.col(period) == value)
        total = own.agg(F.sum("weight").alias("t"))
        return own.crossJoin(F.broadcast(total)).select(*keys, (F.col("weight") / F.col("t")).alias(f"{name}_share"), F.col("score").alias(f"{name}_score"))

    both = one(start, "start").join(one(end, "end"), list(keys))
    within = 0.5 * (F.col("start_share") + F.col("end_share")) * (F.col("end_score") - F.col("start_score"))
    composition = 0.5 * (F.col("start_score") + F.col("end_score")) * (F.col("end_share") - F.col("start_share"))
    return both.withColumn("within", within).withColumn("composition", composition).withColumn("total", F.col("within") + F.col("composition"))


def decomposition(parts: DataFrame) -> DataFrame:
    """One row of totals and shares of change from ``contributions``."""
    out = parts.agg(F.sum("total").alias("change"), F.sum("within").alias("within"), F.sum("composition").alias("composition"), F.count(F.lit(1)).alias("shared_cells"))
    return out.select("*", F.try_divide("within", "change").alias("within_share"), F.try_divide("composition", "change").alias("composition_share"))


def contribution_rollup(parts: DataFrame, by: str) -> DataFrame:
    """Contributions summed by one key."""
    return parts.groupBy(by).agg(F.sum("within").alias("within"), F.sum("composition").alias("composition"), F.sum("total").alias("total"))


def linear_trend(series: DataFrame, order: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope per step and per 12 steps, and R squared (0 for a constant series)."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order)) - 1
    numbered = series.select(*groups, place.cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    out = numbered.groupBy(*groups).agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("points"))
    return out.select(*groups, "points", F.col("slope").alias("slope_per_month"), (F.col("slope") * 12).alias("slope_per_year"), F.when(F.col("v") == 0, 0.0).otherwise(F.col("r2")).alias("r_squared"))


def trailing_mean(series: DataFrame, order: str, value: str, width: int, groups: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``width`` periods; the first ones average what there is."""
    frame = Window.partitionBy(*groups).orderBy(order).rowsBetween(1 - width, 0)
    return series.withColumn("trailing", F.avg(value).over(frame))


def index_to_first(series: DataFrame, order: str, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Value over the first period's, times 100."""
    first = F.first(value).over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return series.withColumn("index", F.try_divide(F.col(value).cast("double") * 100, first))


def endpoint_change(series: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Last minus first value of each group."""
    out = series.groupBy(group).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return out.withColumn("change", F.col("last") - F.col("first"))
