"""From probabilities to labels: decoding, gating, checks, consensus and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import first_argmax, softmax


def binary_decode(p: Column, threshold: float, margin: float) -> tuple[Column, Column]:
    """Full and selective decision; within the margin of the threshold the selective one abstains."""
    full = p >= threshold
    return full, F.when(F.abs(p - threshold) >= margin, full)


def categorical_decode(distribution: Column, names: Sequence[str], least: float) -> tuple[Column, Column]:
    """Full and selective state of a distribution; the first of equal maxima wins."""
    state = F.get(F.array(*[F.lit(n) for n in names]), first_argmax(distribution))
    return state, F.when(F.array_max(distribution) >= least, state)


def two_bit_distribution(a: Column, b: Column) -> Column:
    """Distribution over (neither, first, second, both) from two independent bits."""
    return F.array((1 - a) * (1 - b), a * (1 - b), (1 - a) * b, a * b)


def three_class(logits: Column, dropped: int, temperature: float = 1.0) -> Column:
    """Softmax over the logits without one of them."""
    return softmax(F.filter(logits, lambda _, k: k != dropped), temperature)


def forced_targets(material: Column, present: Column, probabilities: Column) -> Column:
    """Indexes of present targets of a material row; if there is none, the most probable one."""
    chosen = F.filter(F.sequence(F.lit(0), F.size(present) - 1), lambda k: F.get(present, k))
    forced = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(first_argmax(probabilities)))
    return F.when(material, forced).otherwise(F.array().cast("array<int>"))


def gated(material: Column, present: Column, state: Column) -> tuple[Column, Column]:
    """Presence only for material rows, state only where present."""
    on = material & present
    return on, F.when(on, state)


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(name, violations)``: rows for which a check is not true; a null outcome violates."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("violations")) for n in checks])
    return counts.select(F.inline(pairs))


def require(rows: DataFrame, checks: dict[str, Column]) -> None:
    """Raise if any check is violated."""
    broken = {r["name"]: r["violations"] for r in violations(rows, checks).collect() if r["violations"]}
    if broken:
        raise ValueError(f"checks violated: {broken}")


def encode_label(label: Column, targets: Sequence[str], states: Sequence[str]) -> Column:
    """State index of each target from a map of target to state; -1 where a target is absent."""
    index = lambda t: F.coalesce(F.array_position(F.array(*[F.lit(s) for s in states]), F.element_at(label, F.lit(t))) - 1, F.lit(-1)).cast("int")
    return F.array(*[index(t) for t in targets])


def consensus(human: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """Two of three: the label and how it came about."""
    label = F.when(human == first, human).when(human == second, human).when(first == second, first)
    tier = (
        F.when((human == first) & (first == second), "unanimous")
        .when((human == first) | (human == second), "human_supported")
        .when(first == second, "reviewers_override")
        .otherwise("unresolved")
    )
    return label, tier


def reconcile(a: Column, b: Column, tie_break: Column, adjudicated: Column) -> tuple[Column, Column]:
    """Two blind passes, then a tie-break that must side with one, then adjudication."""
    sided = tie_break.isNotNull() & ((tie_break == a) | (tie_break == b))
    label = F.when(a == b, a).when(sided, tie_break).otherwise(adjudicated)
    tier = F.when(a == b, "exact_consensus").when(sided, "blind_majority").when(adjudicated.isNotNull(), "adjudicated").otherwise("open")
    return label, tier


def class_weights(rows: DataFrame, label: str, least: float, most: float) -> DataFrame:
    """Square root of N/n, scaled to mean 1 and capped at both ends."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    raw = F.sqrt(F.sum("n").over(every) / F.col("n"))
    scaled = counts.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.avg("_raw").over(every))
    return scaled.select(label, "n", F.round(F.least(F.greatest(F.col("weight"), F.lit(least)), F.lit(most)), 6).alias("weight"))


def rarest_anchor(cells: DataFrame, key: str, cell: str) -> DataFrame:
    """Each row's rarest cell: support, then name, decide; ``cells(key, cell)`` has a row per cell of a row."""
    support = cells.groupBy(F.col(cell).alias("_cell")).agg(F.count(F.lit(1)).alias("support"))
    joined = cells.join(support, F.col(cell) == F.col("_cell"))
    return joined.groupBy(key).agg(F.min(F.struct("support", cell)).alias("a")).select(key, F.col(f"a.{cell}").alias("anchor"), "a.support")
