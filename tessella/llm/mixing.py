"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / source size`` times on average. The whole
part of that ratio is certain; the fraction is what gets rounded. The mass of a document is the
fraction counted in words. A pivotal step takes two documents and moves mass from one to the
other, in a direction drawn so that no expectation changes, until one of them holds none or all
of its words. Its decision is then final and the other one goes on. As words only move, the sum
over a source stays what it was, and just the last residual of a source is rounded, to the
nearer whole copy.

The steps form a reduction tree: documents of a source are dealt by hash into blocks of a
bounded size, each block is folded inside one row by Spark's ``aggregate``, and the residuals
of the blocks are dealt into blocks again. A source with a third of all rows simply has more
blocks. All draws are hashes of ids and texts, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.text import free_names, unit_interval, words_in
from tessella.staging import stage_table

BLOCK = 256
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
LIMIT = 2.0

#: A row by what tells it from all others: its id, a hash of its text and its number among rows equal in both.
_ROW = ("doc_id", "mark", "nth")
_DONE = "array<struct<doc_id: bigint, mark: bigint, nth: bigint, size: bigint, copy: int>>"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from ``(source, size)``, one row per source.

    Sources in code-point order, null last, carry ``weights`` in turn and share ``budget`` times all
    words. A target stops at ``limit`` times its source; the excess goes to the others by weight until
    none is above. In order of ``limit * size / weight`` the sources that stop are a prefix, so running
    sums find the same point as the repeated resharing. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("share", F.sum("source_size").over(every) * F.lit(float(budget))).withColumn("weights", F.sum("weight").over(every))
    level = (F.col("share") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("stops", F.col("cap") <= level * F.col("weight"))
    stopped = lambda c: F.sum(F.when(F.col("stops"), F.col(c)).otherwise(0.0)).over(every)
    final = F.try_divide(F.col("share") - stopped("cap"), F.col("weights") - stopped("weight"))
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.coalesce(final, F.lit(0.0)) * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _fold(items: Column, level: int) -> Column:
    """Pivotal steps along an array of items: struct of what is decided and the residual, if one is left."""
    long_none = F.lit(None).cast("bigint")
    named = lambda of: [of[c].alias(c) for c in _ROW]
    start = F.struct(*[long_none.alias(c) for c in (*_ROW, "size")], F.lit(None).cast("double").alias("mass"), F.array().cast(_DONE).alias("done"))

    def item(of: Column, mass: Column, done: Column) -> Column:
        return F.struct(*named(of), of["size"].alias("size"), mass.alias("mass"), done.alias("done"))

    def entry(of: Column, copy: int) -> Column:
        return F.struct(*named(of), of["size"].alias("size"), F.lit(copy).alias("copy"))

    def decided(state: Column, of: Column, copy: int) -> Column:
        return F.concat(state["done"], F.array(entry(of, copy)))

    def both(s: Column, x: Column, first: int, second: int) -> Column:
        done = F.concat(s["done"], F.array(entry(s, first), entry(x, second)))
        return F.struct(*[long_none.alias(c) for c in (*_ROW, "size")], F.lit(None).cast("double").alias("mass"), done.alias("done"))

    def step(s: Column, x: Column) -> Column:
        a, b = s["mass"], x["mass"]
        room_a, room_b = s["size"] - a, x["size"] - b
        gain, loss = F.least(room_a, b), F.least(a, room_b)
        rises = unit_interval(*[of[c] for of in (s, x) for c in _ROW], F.lit(level)) * (gain + loss) < loss
        up = (
            F.when(room_a < b, item(x, b - room_a, decided(s, s, 1)))
            .when(room_a > b, item(s, a + b, decided(s, x, 0)))
            .otherwise(both(s, x, 1, 0))
        )
        down = (
            F.when(a < room_b, item(x, a + b, decided(s, s, 0)))
            .when(a > room_b, item(s, a - room_b, decided(s, x, 1)))
            .otherwise(both(s, x, 0, 1))
        )
        return F.when(s["size"].isNull(), item(x, x["mass"], s["done"])).when(rises, up).otherwise(down)

    return F.aggregate(items, start, step)


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT, block: int = BLOCK
) -> DataFrame:
    """How often the mix takes each row of ``docs(doc_id, text, source)``.

    Returns ``doc_id, source, size, source_size, target, copies, taken`` with one row per input row;
    ``taken = copies * size`` and ``copies`` never exceeds ``limit`` rounded up to a whole copy that the
    target allows. Null texts and texts without words have size 0 and are taken 0 times, a text of any length
    is taken whole; the null source is a source of its own; rows that repeat a doc_id, null or not, are
    documents of their own, also if their texts are equal; an empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    return _mixed(docs, weights, budget, limit, block).drop("mark", "nth")


def _mixed(docs: DataFrame, weights: Sequence[float], budget: float, limit: float, block: int) -> DataFrame:
    """What ``mix_sources`` returns, with ``mark, nth``."""
    rows = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), _mark(F.col("text")).alias("mark"))
    # Equal rows are counted before they are numbered, so they don't meet one by one.
    counted = rows.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.select("doc_id", "source", "size", "mark", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    sizes = stage_table(sizes, "mix-sizes")
    targets = stage_table(source_targets(sizes, weights, budget, limit), "mix-targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = (
        sizes.withColumnRenamed("source", "_source")
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("whole", F.floor(ratio).cast("int"))
        .withColumn("mass", (ratio - F.floor(ratio)) * F.col("size"))
        .select(*_ROW, "source", "size", "source_size", "target", "n_docs", "whole", "mass")
    )
    settled = (F.col("size") == 0) | (F.col("mass") <= 0)
    per_source = ["source", "source_size", "target", "n_docs", "whole"]
    parts = [rows.where(settled).select(*per_source, *_ROW, "size", F.when(F.col("size") == 0, -F.col("whole")).otherwise(0).alias("copy"))]
    left, level, span = rows.where(~settled), 0, block
    while True:
        blocks = F.ceil(F.col("n_docs") / F.lit(span))
        items = F.sort_array(F.collect_list(F.struct(*_ROW, "size", "mass")))
        folded = (
            left.groupBy(*per_source, F.pmod(F.xxhash64(*_ROW, F.lit(level)), blocks).alias("block"))
            .agg(items.alias("items"))
            .select(*per_source, _fold(F.col("items"), level).alias("out"))
        )
        own = [F.col(f"out.{c}").alias(c) for c in (*_ROW, "size")]
        open_row = F.struct(*own, F.lit(None).cast("int").alias("copy"), F.col("out.mass").alias("mass"))
        done_rows = F.transform("out.done", lambda d: F.struct(*[d[c].alias(c) for c in (*_ROW, "size", "copy")], F.lit(0.0).alias("mass")))
        entries = F.concat(done_rows, F.filter(F.array(open_row), lambda x: x["size"].isNotNull()))
        level_rows = stage_table(folded.select(*per_source, F.inline(entries)), f"mix-level{level}")
        parts.append(level_rows.where("copy is not null").select(*per_source, *_ROW, "size", "copy"))
        left = level_rows.where("copy is null").drop("copy")
        if largest <= span:
            break
        level, span = level + 1, span * block
    nearer = F.when(F.col("mass") * 2 >= F.col("size"), 1).otherwise(0)
    parts.append(left.select(*per_source, *_ROW, "size", nearer.alias("copy")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    copies = F.col("whole") + F.col("copy")
    return out.select(*_ROW, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT, block: int = BLOCK
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows taken 0 times are gone.

    So are null texts and texts without words; a text of any length comes back whole; of rows that repeat doc_id,
    source and text each is taken as often as any other or once more; an empty table gives an empty result. All
    columns come back as they are, whatever their names.
    """
    key_name, total_name, rows_name, nth_name, copy_name = free_names(docs, "key", "total", "rows", "nth", "copy")
    # A null has its own first letter, so no id or source can look like one.
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0"))
    named = lambda mark: F.concat_ws("|", mark, part("doc_id"), part("source"))
    taken = _mixed(docs, weights, budget, limit, block)
    taken = taken.select(named(F.col("mark")).alias(key_name), "copies").groupBy(key_name)
    taken = taken.agg(F.sum("copies").alias(total_name), F.count(F.lit(1)).alias(rows_name)).where(F.col(total_name) > 0)
    # One key column serves the join and the numbering of repeated rows, so texts are dealt once.
    joined = docs.withColumn(key_name, named(_mark(F.col("text")))).join(taken, key_name)
    nth = F.row_number().over(Window.partitionBy(key_name).orderBy(F.lit(1)))
    over = F.when(nth <= F.col(total_name) % F.col(rows_name), 1).otherwise(0)
    dealt = joined.withColumn(nth_name, F.floor(F.col(total_name) / F.col(rows_name)) + over).where(F.col(nth_name) > 0)
    return dealt.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(nth_name))).alias(copy_name)).drop(copy_name)
