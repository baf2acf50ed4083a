"""Label evaluation: counts, agreement, selective risk, proper scores, calibration and design checks.

Every measure takes an optional weight: 1 gives plain counts, inverse inclusion probabilities give the
design-weighted (Hajek) forms. A null prediction abstains: it is a miss for a positive reference, never a
true negative, and stays in the denominator of accuracy. Undefined ratios are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import seeded_hash

EPSILON = 1e-15
#: Rows that one bootstrap draw stands for, at most.
CHUNK = 4096


def _r(value: Column) -> Column:
    return F.round(value, 6)


def binary_metrics(rows: DataFrame, reference: str, predicted: str, weight: str | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Support, error counts and rates of a boolean prediction."""
    w = F.col(weight) if weight else F.lit(1)
    ref, pred = F.col(reference), F.col(predicted)
    said = F.coalesce(pred, F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), (w * 0 if weight is None else F.lit(0.0)))
    sums = rows.groupBy(*groups).agg(
        F.sum(w).alias("support"),
        total(ref & said).alias("tp"),
        total(~ref & said).alias("fp"),
        total(ref & ~said).alias("fn"),
        total(~ref & (pred == F.lit(False))).alias("tn"),
        total(pred.isNull()).alias("abstained"),
    )
    ratio = F.try_divide
    return sums.select(
        *groups,
        *[(_r(F.col(c)) if weight else F.col(c)).alias(c) for c in ("support", "tp", "fp", "fn", "tn", "abstained")],
        _r(ratio(F.col("tp") + F.col("tn"), F.col("support"))).alias("accuracy"),
        _r(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        _r(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"),
        _r(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
    )


def confusion(rows: DataFrame, reference: str, predicted: str) -> DataFrame:
    """Rows per reference and prediction; abstention is a class of its own."""
    return rows.groupBy(F.col(reference).alias("reference"), F.coalesce(F.col(predicted), F.lit("abstained")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def one_versus_rest(rows: DataFrame, reference: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Binary metrics of each class."""
    each = rows.select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("state"), F.col(reference).alias("r"), F.col(predicted).alias("p"))
    return binary_metrics(each.select("state", (F.col("r") == F.col("state")).alias("ref"), (F.col("p") == F.col("state")).alias("pred")), "ref", "pred", groups=["state"])


def macro_f1(per_class: DataFrame) -> DataFrame:
    """Mean F1 of the classes that have one."""
    return per_class.agg(_r(F.avg("f1")).alias("macro_f1"), F.count("f1").alias("defined"))


def kappa(rows: DataFrame, reference: str, predicted: str) -> DataFrame:
    """Cohen's kappa; null if chance agreement is complete."""
    pairs = rows.groupBy(F.col(reference).alias("a"), F.col(predicted).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))).alias("s")).select("s.*")
    chance = every.groupBy("label").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("products"))
    totals = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreed")).crossJoin(chance)
    observed, expected = F.col("agreed") / F.col("n"), F.col("products") / (F.col("n") * F.col("n"))
    return totals.select("n", _r(observed).alias("observed"), _r(expected).alias("chance"), _r(F.try_divide(observed - expected, 1 - expected)).alias("kappa"))


def tuple_f1(reference: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set comparison of distinct tuples."""
    a = reference.select(*keys).distinct().withColumn("_r", F.lit(True))
    b = predicted.select(*keys).distinct().withColumn("_p", F.lit(True))
    both = a.join(b, list(keys), "full_outer").select(F.coalesce("_r", F.lit(False)).alias("r"), F.coalesce("_p", F.lit(False)).alias("p"))
    return binary_metrics(both, "r", "p").select("tp", "fp", "fn", "precision", "recall", "f1")


def selective(rows: DataFrame, reference: str, predicted: str, weight: str | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Coverage and risk among accepted rows and in the population."""
    w = F.col(weight) if weight else F.lit(1)
    out = rows.groupBy(*groups).agg(
        F.sum(w).alias("support"),
        F.sum(F.when(F.col(predicted).isNotNull(), w).otherwise(w * 0)).alias("accepted"),
        F.sum(F.when(F.col(predicted) == F.col(reference), w).otherwise(w * 0)).alias("correct"),
    )
    shown = (lambda c: _r(c)) if weight else (lambda c: c)
    errors = F.col("accepted") - F.col("correct")
    return out.select(
        *groups,
        shown(F.col("support")).alias("support"),
        shown(F.col("accepted")).alias("accepted"),
        shown(F.col("correct")).alias("correct"),
        shown(errors).alias("errors"),
        _r(F.try_divide("accepted", "support")).alias("coverage"),
        _r(F.try_divide(errors, F.col("accepted"))).alias("accepted_risk"),
        _r(F.try_divide(F.col("support") - F.col("correct"), F.col("support"))).alias("population_risk"),
    )


def proper_scores(rows: DataFrame, label: str, probability: str, weight: str | None = None) -> DataFrame:
    """Brier score and negative log likelihood of a binary probability; missing ones count against coverage only."""
    w = F.col(weight) if weight else F.lit(1.0)
    y, p = F.col(label).cast("double"), F.col(probability)
    have = p.isNotNull()
    nll = -(y * F.ln(F.greatest(p, F.lit(EPSILON))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(EPSILON))))
    mean = lambda c: _r(F.try_divide(F.sum(F.when(have, c * w)), F.sum(F.when(have, w))))
    return rows.agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(have).alias("available"),
        mean(F.pow(p - y, 2)).alias("brier"),
        mean(nll).alias("nll"),
    )


def categorical_scores(rows: DataFrame, label_index: str, distribution: str) -> DataFrame:
    """Brier score and negative log likelihood of a distribution; the label is a zero-based index."""
    squares = F.aggregate(F.transform(distribution, lambda p, k: F.pow(p - (k == F.col(label_index)).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    own = F.get(F.col(distribution), F.col(label_index))
    return rows.agg(F.count(F.lit(1)).alias("support"), _r(F.avg(squares)).alias("brier"), _r(F.avg(-F.ln(F.greatest(own, F.lit(EPSILON))))).alias("nll"))


def calibration_error(rows: DataFrame, label: str, probability: str, weight: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    own = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).alias("bin")
    per = rows.groupBy(own).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(probability)).alias("p"), F.sum(F.col(weight) * F.col(label)).alias("y"))
    return per.agg(F.count(F.lit(1)).alias("bins"), _r(F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum("w"))).alias("ece"))


def temperature_grid(rows: DataFrame, label: str, logit: str, weight: str, grid: Sequence[float]) -> DataFrame:
    """Weighted NLL at each temperature and the best: smallest loss, then nearest to 1, then lower."""
    from tessella.functions.scalars import sigmoid

    each = rows.select("*", F.explode(F.array(*[F.lit(t) for t in grid])).alias("temperature"))
    p = sigmoid(F.col(logit) / F.col("temperature"))
    y = F.col(label).cast("double")
    loss = -(y * F.ln(F.greatest(p, F.lit(EPSILON))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(EPSILON))))
    out = each.groupBy("temperature").agg(F.round(F.sum(F.col(weight) * loss) / F.sum(weight), 6).alias("nll"))
    best = F.row_number().over(Window.orderBy("nll", F.abs(F.col("temperature") - 1), "temperature")) == 1
    return out.withColumn("chosen", best)


def threshold_grid(rows: DataFrame, label: str, probability: str, weight: str, grid: Sequence[float]) -> DataFrame:
    """Weighted F1 and recall at each threshold and the best: F1, recall, distance from one half, value."""
    each = rows.select("*", F.explode(F.array(*[F.lit(t) for t in grid])).alias("threshold"))
    each = each.withColumn("_ref", F.col(label) == 1).withColumn("_pred", F.col(probability) >= F.col("threshold"))
    out = binary_metrics(each, "_ref", "_pred", weight, ["threshold"]).select("threshold", F.coalesce("f1", F.lit(0.0)).alias("f1"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
    order = Window.orderBy(F.col("f1").desc(), F.col("recall").desc(), F.abs(F.col("threshold") - 0.5), "threshold")
    return out.withColumn("chosen", F.row_number().over(order) == 1)


def design_health(rows: DataFrame, stratum: str, probability: str, population: str) -> DataFrame:
    """Per stratum: weighted support against the population, effective sample size, ratio of extreme weights."""
    w = 1 / F.col(probability)
    return rows.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"),
        _r(F.sum(w)).alias("weighted"),
        F.max(population).alias("population"),
        _r(F.pow(F.sum(w), 2) / F.sum(w * w)).alias("effective_n"),
        _r(F.max(w) / F.min(w)).alias("weight_ratio"),
    )


def horvitz_thompson_recall(rows: DataFrame, hit: str, inside: str, probability: str) -> DataFrame:
    """Recall of an arm: inside total over all, both from inverse-probability sums."""
    total = lambda c: F.sum(F.when(c & F.col(hit), 1 / F.col(probability)).otherwise(0.0))
    out = rows.agg(total(F.col(inside)).alias("inside"), total(~F.col(inside)).alias("outside"))
    return out.select(_r(F.col("inside")).alias("inside"), _r(F.col("outside")).alias("outside"), _r(F.try_divide(F.col("inside"), F.col("inside") + F.col("outside"))).alias("recall"))


def poisson_steps(mean: int, bits: int = 52) -> tuple[int, list[int]]:
    """The least number of a Poisson draw that matters, and the uniform numbers of ``bits`` bits from which it is one more, and so on."""
    reach = int(8 * sqrt(mean)) + 8
    low, total, steps = max(0, mean - reach), 0.0, []
    for k in range(low, mean + reach):
        total += exp(k * log(mean) - mean - lgamma(k + 1))
        steps.append(int(min(total, 1.0) * (1 << bits)))
    return low, steps


def bootstrap_interval(rows: DataFrame, value: str, replicates: int, seed: str, chunk: int = CHUNK) -> DataFrame:
    """Observed mean of ``value``, for a paired comparison each row's difference, and its percentile interval over resamples.

    In a replicate a row counts as often as a Poisson draw of mean 1 says, which is how often a row is drawn from
    many. Rows of one value then count as often as a single draw says whose mean is their number, so draws are made
    for values, up to ``chunk`` rows at a time, not for rows, and nothing is joined. A draw is a hash of seed, replicate, value and chunk; sums by replicate combine before the shuffle.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.select("_v", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))).alias("_c"))
    parts = parts.select("_v", "_c", F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("_c") * chunk).alias("_m"))
    means = [r["_m"] for r in parts.select("_m").distinct().collect()]  # at most as many as a chunk has rows
    steps = {m: (low, np.array(own)) for m in means for low, own in [poisson_steps(m)]}
    drawn = parts.select("_v", "_c", "_m", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("i"))
    uniform = F.conv(F.substring(seeded_hash(seed, F.col("i"), F.col("_v"), F.col("_c")), 1, 13), 16, 10).cast("long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, drawn_at = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            times = np.zeros(len(of), dtype=np.int64)
            for m in np.unique(of).tolist():
                low, own = steps[m]
                times[of == m] = low + np.searchsorted(own, drawn_at[of == m], side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(times)], names=["i", "_v", "_w"])

    weighed = drawn.select("i", "_v", "_m", uniform.alias("_u")).mapInArrow(weigh, "i int, _v double, _w long")
    means = weighed.groupBy("i").agg(F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w")).alias("m"))
    ends = [_r(F.percentile("m", F.lit(q))).alias(n) for q, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))]
    return rows.agg(_r(F.avg(value)).alias("observed")).crossJoin(means.agg(F.count("m").alias("replicates"), *ends))


def spread_by(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and sample standard deviation; null for a single row."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(value)).alias("mean"), _r(F.stddev_samp(value)).alias("sd"))


def paired_deltas(rows: DataFrame, pair: str, arm: str, value: str, base: str) -> DataFrame:
    """Each arm against the base arm of the same pair: mean difference, its deviation and the number of pairs."""
    first = rows.where(F.col(arm) == base).select(F.col(pair).alias("_p"), F.col(value).alias("_v"))
    both = rows.where(F.col(arm) != base).join(first, F.col(pair) == F.col("_p"))
    return both.groupBy(arm).agg(F.count(F.lit(1)).alias("pairs"), _r(F.avg(F.col(value) - F.col("_v"))).alias("mean_delta"), _r(F.stddev_samp(F.col(value) - F.col("_v"))).alias("sd_delta"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``metrics(name, value)`` against ``thresholds(name, least)``: each gate, and whether all hold; a missing metric fails."""
    joined = thresholds.join(metrics, "name", "left").withColumn("passes", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))
    return joined.withColumn("all_pass", F.bool_and("passes").over(Window.partitionBy()))


def agreement(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Share of common rows on which two raters agree, by column and on all of them."""
    b = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = left.join(b, F.col(key) == F.col("_k"))
    same = {c: F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns}
    every = F.lit(True)
    for s in same.values():
        every = every & s
    rate = lambda c: _r(F.try_divide(F.count_if(c), F.count(F.lit(1))))
    return both.agg(F.count(F.lit(1)).alias("n"), rate(every).alias("exact"), *[rate(s).alias(c) for c, s in same.items()])
