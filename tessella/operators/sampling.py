"""Quotas, deterministic hash samples and greedy selection.

Every draw orders rows by a seeded hash, so a sample depends on ids alone, never on how rows lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import first_uint64, seeded_hash
from tessella.operators.near_dup import is_near, prints_near
from tessella.operators.ranks import hash_rank, positions
from tessella.staging import stage_table


def largest_remainder(strata: DataFrame, total: int, minimum: int = 0, tie: str = "stratum") -> DataFrame:
    """``strata(stratum, population)`` with ``quota``: a minimum each, the rest by remaining capacity.

    Floors are taken in whole numbers; what they leave goes to the largest fractions, ties by ``tie``. One
    pass is enough, as a floor never exceeds a capacity. Variants: minimum k with ties by key; none with ties
    by hash; one each with ties by hash.
    """
    every = Window.partitionBy()
    base = F.least(F.col("population"), F.lit(minimum))
    rows = strata.withColumn("_base", base).withColumn("_room", F.col("population") - base)
    rows = rows.withColumn("_rest", F.lit(total) - F.sum("_base").over(every)).withColumn("_all", F.sum("_room").over(every))
    exact = (F.col("_rest") * F.col("_room")).cast("decimal(38,0)")
    divisor = F.greatest(F.col("_all"), F.lit(1)).cast("decimal(38,0)")
    rows = rows.withColumn("_floor", F.floor(exact / divisor).cast("long")).withColumn("_over", F.pmod(exact, divisor))
    rows = rows.withColumn("_left", F.col("_rest") - F.sum("_floor").over(every))
    turn = F.row_number().over(Window.partitionBy().orderBy(F.col("_over").desc(), tie))
    quota = F.col("_base") + F.col("_floor") + F.when(turn <= F.col("_left"), 1).otherwise(0)
    return rows.select(*strata.columns, quota.cast("long").alias("quota"))


def bottom_k(rows: DataFrame, quotas: DataFrame, digest: str, key: str) -> DataFrame:
    """The ``quota`` rows with the smallest digests of each stratum, with rank and inclusion probability."""
    ranked = hash_rank(rows, ["stratum"], digest, key)
    kept = ranked.join(quotas.select("stratum", "population", "quota"), "stratum").where(F.col("rank") <= F.col("quota"))
    return kept.withColumn("inclusion_probability", F.col("quota") / F.col("population"))


def bernoulli(rows: DataFrame, digest: Column, expected: int, population: int) -> DataFrame:
    """Rows whose first eight digest bytes lie below floor(expected * 2^64 / population)."""
    limit = expected * (1 << 64) // population
    return rows.where(first_uint64(digest) < F.lit(str(limit)).cast("decimal(20,0)"))


def banded(rows: DataFrame, score: str, bands: Sequence[tuple[str, float, float]]) -> DataFrame:
    """The name of the half-open band a score falls in; bands must be contiguous."""
    for (_, _, high), (_, low, _) in zip(bands, bands[1:], strict=False):
        if high != low:
            raise ValueError("score bands must be contiguous")
    out = F.lit(None).cast("string")
    for name, low, high in bands:
        out = F.when((F.col(score) >= low) & (F.col(score) < high), name).otherwise(out)
    return rows.withColumn("band", out)


def greedy_buckets(pool: DataFrame, buckets: Sequence[tuple[str, str, int]], key: str, cluster: str) -> DataFrame:
    """Top-k for each of (name, score column, k) in order, no row and no cluster twice; scores are numbers.

    Ranks count skipped rows too: ``bucket_rank`` is the place in the whole pool. What a bucket chose, ``k`` rows,
    passes through the driver, so a bucket's plan has one anti-join however many came before.
    """
    session, kinds = pool.sparkSession, dict(pool.dtypes)
    schema = f"{key} {kinds[key]}, {cluster} {kinds[cluster]}, bucket string, score double, bucket_rank long"
    ledger: list[tuple] = []
    for name, score, quota in buckets:
        taken = session.createDataFrame([(r[1],) for r in ledger], f"_taken {kinds[cluster]}")
        free = pool.join(F.broadcast(taken), F.col(cluster) == F.col("_taken"), "left_anti") if ledger else pool
        # Within a cluster only the best row can be taken; an aggregate finds it without sorting the cluster.
        down = (-F.col(score)).alias("down")
        best = free.groupBy(cluster).agg(F.min(F.struct(down, F.col(key).alias("key"))).alias("best")).select(cluster, "best.*")
        chosen = best.orderBy("down", "key").limit(quota).collect()
        # The place in the whole pool: a row lies behind as many chosen ones as come before it, and those numbers are counted.
        ends = session.createDataFrame([(k, r["down"], r["key"]) for k, r in enumerate(chosen)], f"n int, down {dict(best.dtypes)['down']}, key {kinds[key]}")
        marks = F.broadcast(ends.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "down", "key"))), lambda x: F.struct(x["down"], x["key"])).alias("_marks")))
        own = F.struct(down, F.col(key).alias("key"))
        behind = pool.crossJoin(marks).groupBy(F.size(F.filter("_marks", lambda m: m < own)).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
        rows = {r["n"]: r["rows"] for r in behind.collect()}
        rank = 0
        for k, r in enumerate(chosen):
            rank += rows.get(k, 0)
            ledger.append((r["key"], r[cluster], name, float(-r["down"]), rank))
    return session.createDataFrame(ledger, schema)


def greedy_accept(
    rows: DataFrame, prints: Callable[[DataFrame], DataFrame], cell: str, rank: str, key: str, quotas: dict[str, int], reserve: int = 12, reference: DataFrame | None = None
) -> DataFrame:
    """Rows of each cell in rank order unless near a ``reference(print, chars)`` row or one accepted before, up to the cell's quota.

    ``prints`` gives rows their own ``print`` and ``chars``; equal texts are near like any others. Order decides,
    so the loop runs in one place over the bounded reserve, ``quota + reserve`` rows of each cell.
    """
    limits = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    held = stage_table(prints(rows.where(F.col(rank) <= F.element_at(limits, F.col(cell)) + reserve)).select(key, cell, rank, "print", "chars"), "reserve")
    barred: set = set()
    if reference is not None:
        own = held.select(F.col(key).alias("_key"), F.col("print").alias("_print"), F.col("chars").alias("_chars"))
        near = is_near(F.col("_print"), F.col("_chars"), F.col("print"), F.col("chars"))
        barred = {r["_key"] for r in reference.join(F.broadcast(own), near).select("_key").distinct().collect()}
    accepted, counts = [], dict.fromkeys(quotas, 0)
    done: list[tuple[int, int]] = []
    for r in held.orderBy(rank, cell, key).collect():
        own = (r["print"], r["chars"])
        if counts[r[cell]] < quotas[r[cell]] and r[key] not in barred and not any(prints_near(own, other) for other in done):
            counts[r[cell]] += 1
            done.append(own)
            accepted.append((r[key], r[cell], counts[r[cell]]))
    kinds = dict(rows.dtypes)
    return rows.sparkSession.createDataFrame(accepted, f"{key} {kinds[key]}, {cell} {kinds[cell]}, place int")


def interleave(left: DataFrame, right: DataFrame, order: str, seed: str) -> DataFrame:
    """Two arms row by row: a hash coin for each pair says which arm goes first; ``(place, arm, id)``."""
    a = left.select(F.col(order).alias("n"), F.col("id").alias("x"))
    b = right.select(F.col(order).alias("n"), F.col("id").alias("y"))
    both = a.join(b, "n", "full_outer")
    heads = F.conv(F.substring(seeded_hash(seed, F.col("n")), 1, 2), 16, 10).cast("int") % 2 == 0
    one = lambda arm, c, first: F.struct((F.col("n") * 2 + F.when(first, 0).otherwise(1)).alias("slot"), F.lit(arm).alias("arm"), F.col(c).alias("id"))
    rows = both.select(F.inline(F.array(one("a", "x", heads), one("b", "y", ~heads)))).where(F.col("id").isNotNull())
    return positions(rows, "slot", name="place").select((F.col("place") + 1).alias("place"), "arm", "id")


def length_batches(rows: DataFrame, length: str, key: str, batch: int, per_bucket: int, seed: str) -> DataFrame:
    """A seeded shuffle cut into buckets of ``per_bucket`` batches, each sorted by length and chunked; batches are ordered by hash."""
    shuffled = hash_rank(rows.withColumn("_d", seeded_hash(seed, F.col(key))), [], "_d", key)
    bucketed = shuffled.withColumn("bucket", F.floor((F.col("rank") - 1) / F.lit(batch * per_bucket)))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(length, key)) - 1
    chunked = bucketed.withColumn("chunk", F.floor(within / F.lit(batch)))
    return chunked.select(key, length, "bucket", "chunk", seeded_hash(seed, F.col("bucket"), F.col("chunk")).alias("batch_order"))


def promote(trials: DataFrame, guard: Column, score: str, key: str, keep: int) -> DataFrame:
    """The ``keep`` best trials that pass the guard, ties by key."""
    return trials.where(guard).orderBy(F.col(score).desc(), F.col(key)).limit(keep)


def early_stop(curve: DataFrame, run: str, epoch: str, score: str, first: int, gain: float, patience: int) -> DataFrame:
    """Best epoch of each run: scanning in order, a new best must gain ``gain``; stop after ``patience`` epochs without."""
    points = F.array_sort(F.collect_list(F.struct(epoch, score)))
    start = F.struct(F.lit(None).cast("long").alias("best"), F.lit(float("-inf")).alias("top"), F.lit(0).alias("idle"), F.lit(False).alias("over"))

    def step(s: Column, p: Column) -> Column:
        counts = ~s["over"] & (p[epoch] >= first)
        better = counts & (p[score] > s["top"] + gain)
        idle = F.when(better, 0).when(counts, s["idle"] + 1).otherwise(s["idle"])
        return F.struct(
            F.when(better, p[epoch].cast("long")).otherwise(s["best"]).alias("best"),
            F.when(better, p[score]).otherwise(s["top"]).alias("top"),
            idle.alias("idle"),
            (s["over"] | (idle >= patience)).alias("over"),
        )

    out = curve.groupBy(run).agg(F.aggregate(points, start, step).alias("s"))
    return out.select(run, F.col("s.best").alias("epoch"), F.col("s.top").alias("score"), F.col("s.over").alias("stopped"))


def stratified_folds(rows: list[tuple[object, frozenset]], folds: int, limit: int = 10_000) -> dict[object, int]:
    """Iterative stratification of a bounded set of multilabel rows on the driver: rarest label first, to the fold that wants it most."""
    if len(rows) > limit:
        raise ValueError(f"at most {limit} rows are stratified on the driver")
    left = {key: labels for key, labels in sorted(rows, key=lambda r: str(r[0]))}
    room = [len(left) / folds] * folds
    totals: dict = {}
    for labels in left.values():
        for label in labels:
            totals[label] = totals.get(label, 0) + 1
    wants = [{label: n / folds for label, n in totals.items()} for _ in range(folds)]
    out: dict[object, int] = {}
    while left:
        open_counts: dict = {}
        for labels in left.values():
            for label in labels:
                open_counts[label] = open_counts.get(label, 0) + 1
        label = min(open_counts, key=lambda x: (open_counts[x], str(x))) if open_counts else None
        for key in [k for k, labels in left.items() if label is None or label in labels]:
            fold = max(range(folds), key=lambda f: (wants[f].get(label, 0), room[f], -f))
            for own in left.pop(key):
                wants[fold][own] -= 1
            room[fold] -= 1
            out[key] = fold
    return out


def fold_counts(sets: dict[frozenset, int], folds: int) -> dict[frozenset, list[int]]:
    """How many rows of each label set go to each fold: iterative stratification of the histogram of label sets.

    The rarest open label first, each row of its sets to the fold that wants the label most. Rows of a set are
    alike, so all but the last few are dealt evenly and only those that level the folds are placed one by one.
    """
    room = [sum(sets.values()) / folds] * folds
    totals: dict = {}
    for own, n in sets.items():
        for label in own:
            totals[label] = totals.get(label, 0) + n
    wants = [{label: n / folds for label, n in totals.items()} for _ in range(folds)]
    left, out = dict(sorted(sets.items(), key=lambda kv: sorted(map(str, kv[0])))), {}
    while left:
        open_counts: dict = {}
        for own, n in left.items():
            for label in own:
                open_counts[label] = open_counts.get(label, 0) + n
        label = min(open_counts, key=lambda x: (open_counts[x], str(x))) if open_counts else None
        for own in [s for s in left if label is None or label in s]:
            n = left.pop(own)
            even = max(0, n // folds - folds)
            given = [even] * folds
            for f in range(folds):
                room[f] -= even
                for x in own:
                    wants[f][x] -= even
            for _ in range(n - even * folds):
                f = max(range(folds), key=lambda f: (wants[f].get(label, 0), room[f], -f))
                given[f] += 1
                room[f] -= 1
                for x in own:
                    wants[f][x] -= 1
            out[own] = given
    return out


def label_set_folds(rows: DataFrame, labels: Sequence[str], digest: str, key: str, folds: int) -> DataFrame:
    """``(key, fold)`` for every row: the driver sees the label sets' numbers, rows are dealt by hash rank within a set."""
    named = rows.select(key, digest, F.concat_ws(",", *[F.when(F.col(x).cast("boolean"), x) for x in labels]).alias("_set"))
    found = {r["_set"]: r["n"] for r in named.groupBy("_set").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = fold_counts({frozenset(filter(None, s.split(","))): n for s, n in found.items()}, folds)
    fold = F.lit(None).cast("int")
    for s in found:
        ends = [sum(dealt[frozenset(filter(None, s.split(",")))][: f + 1]) for f in range(folds)]
        before = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("rank")))
        fold = F.when(F.col("_set") == s, before).otherwise(fold)
    return hash_rank(named, ["_set"], digest, key).select(key, fold.alias("fold"))
