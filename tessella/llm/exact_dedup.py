"""Exact dedup by a tree-merge of sorted digest runs.

Every text is reduced to the SHA-256 of its normalised form. Rows are dealt evenly over the leaves of the
tree; a leaf's sorted run holds one entry per digest with the smallest id and the number of rows. Then
partitions exchange runs in binomial rounds, ``LEVELS`` of them in one shuffle: the ``2**LEVELS`` nodes whose
numbers differ in those binary digits swap runs, each keeping one slice of the digest range, and a task
merges the sorted runs that meet in it. After all rounds each slice is whole, and no task ever holds more
than runs the size of one leaf. A run travels as one row of packed arrays, so its entries are never sorted again.
A text that fills a third of all rows enters the rounds as one entry per leaf.

Each merge verifies the entries it joins: equal digests must agree in the length of the normalised
text and in a second, independent hash, otherwise the job fails rather than drop a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.text import SPACES, free_names
from tessella.staging import stage_table

LEVELS = 3
LEAF_ROWS = 20_000
#: An entry: the digest as four numbers, most significant first, then what is known of its rows.
_ENTRY = np.dtype([
    ("digest", "<u8", 4), ("n_bytes", "<i8"), ("second", "<i8"), ("unnamed", "?"), ("keep_id", "<i8"), ("keep_row", "<i8"), ("n_rows", "<i8")
])
_RUN = "node long, slice long, run binary"


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several, with one entry per digest.

    The stable sort finds the runs that are there and merges them; only digests that share their first
    64 bits are told apart by the rest.
    """
    run = np.concatenate(runs) if runs else np.zeros(0, _ENTRY)
    if not len(run):
        return run
    words = run["digest"]
    order = np.argsort(words[:, 0], kind="stable")
    run, words = run[order], words[order]
    alike = words[1:, 0] == words[:-1, 0]
    if (words[1:][alike] != words[:-1][alike]).any():
        order = np.lexsort(words.T[::-1])
        run, words = run[order], words[order]
    starts = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(run)))
    for column in ("n_bytes", "second"):
        if (np.minimum.reduceat(run[column], starts) != np.maximum.reduceat(run[column], starts)).any():
            raise ValueError("two different texts have the same SHA-256 digest")
    out = run[starts]
    largest = np.iinfo(np.int64).max
    first = np.ones(len(run), dtype=bool)
    for column in ("unnamed", "keep_id", "keep_row"):
        values = run[column].astype(np.int64)
        least = np.minimum.reduceat(np.where(first, values, largest), starts)
        first &= values == np.repeat(least, sizes)
        out[column] = least
    out["n_rows"] = np.add.reduceat(run["n_rows"], starts)
    return out


def _cut(node: int, run: np.ndarray, level: int) -> Iterator[pa.RecordBatch]:
    """The slices of a node's run that the nodes of the next exchange keep, by the leading bits of the digest."""
    bits = LEVELS * level
    of = (run["digest"][:, 0] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            columns = [pa.array([node >> LEVELS], pa.int64()), pa.array([int(of[a])], pa.int64()), pa.array([run[a:b].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "slice", "run"])


def _leaf_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leaf and digest to the leaf's run, cut for the first exchange."""
    held: list[np.ndarray] = []
    leaf = -1
    for batch in batches:
        leaves = batch.column("leaf").to_numpy()
        found = np.zeros(batch.num_rows, _ENTRY)
        digests = pa.concat_arrays([batch.column("digest")])
        found["digest"] = np.frombuffer(b"".join(digests.to_pylist()), dtype=">u8").reshape(-1, 4)
        ids = batch.column("doc_id")
        found["unnamed"] = ids.is_null().to_numpy(zero_copy_only=False)
        found["keep_id"] = ids.fill_null(0).to_numpy()
        for name, column in (("n_bytes", "n_bytes"), ("second", "second"), ("keep_row", "row")):
            found[name] = batch.column(column).to_numpy()
        found["n_rows"] = 1
        cuts = [0, *(np.flatnonzero(leaves[1:] != leaves[:-1]) + 1).tolist(), len(leaves)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and leaf != leaves[a]:
                yield from _cut(leaf, merge_runs(held), 1)
                held = []
            leaf = int(leaves[a])
            held.append(found[a:b])
    if held:
        yield from _cut(leaf, merge_runs(held), 1)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Runs sorted by node and slice to each node with its merged run."""
    held: list[np.ndarray] = []
    at: tuple[int, int] | None = None
    for batch in batches:
        for node, part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and at != (node, part):
                yield at[0], merge_runs(held)
                held = []
            at = node, part
            held.append(np.frombuffer(packed.as_buffer(), _ENTRY))
    if held:
        yield at[0], merge_runs(held)


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, run in _met(batches):
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(run), [None, pa.py_buffer(run["digest"].astype(">u8").tobytes())]).cast(pa.binary())
        keep_id = pa.array(run["keep_id"].astype(np.int64), mask=run["unnamed"])
        columns = [digests, keep_id, pa.array(run["keep_row"].astype(np.int64)), pa.array(run["n_rows"].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["d", "keep_id", "keep_row", "group_size"])


def _resolved(docs: DataFrame, leaves: int | None) -> DataFrame:
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    text = normalised(F.col("text"))
    # Numbers of rows are drawn once, when they are written.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("second"),
    )
    rows = stage_table(rows, "dedup-rows")
    wanted = leaves or -(-rows.count() // LEAF_ROWS)
    rounds = 1
    while 1 << LEVELS * rounds < wanted:
        rounds += 1
    dealt = rows.withColumn("leaf", F.pmod(F.xxhash64("row"), F.lit(1 << LEVELS * rounds)))
    met = dealt.repartition(partitions, "leaf").sortWithinPartitions("leaf", "digest")
    runs = met.mapInArrow(_leaf_runs, _RUN)

    def exchanged(level: int):
        return lambda batches: (piece for node, run in _met(batches) for piece in _cut(node, run, level + 1))

    exchange = lambda: runs.repartition(partitions, "node", "slice").sortWithinPartitions("node", "slice")
    for level in range(1, rounds):
        runs = exchange().mapInArrow(exchanged(level), _RUN)
    winners = exchange().mapInArrow(_winners, "d binary, keep_id long, keep_row long, group_size long")
    # A very common text goes to its winner once per leaf, and its rows to their leaf's entry.
    winners = stage_table(winners, "dedup-winners")
    by_leaf = dealt.select("leaf", "digest").distinct().join(winners, F.col("digest") == F.col("d"))
    by_leaf = by_leaf.select(F.col("leaf").alias("_leaf"), "d", "keep_id", "keep_row", "group_size")
    joined = dealt.join(by_leaf, (F.col("leaf") == F.col("_leaf")) & (F.col("digest") == F.col("d")))
    return joined.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("keep_id").cast(kind).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
    )


def resolve_duplicates(docs: DataFrame, leaves: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, text_sha256, keep_id, group_size, kept``.

    Texts, of any length, are equal if their normalised forms are. ``keep_id`` is the smallest doc_id, an integer,
    of the group and exactly one row with it is ``kept``, also if rows repeat; a null doc_id is larger than any
    other, and in a group of null ids ``keep_id`` is null and one row is kept. Null texts equal the empty one. An
    empty table gives an empty result; other columns are not read.
    """
    return _resolved(docs, leaves)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller doc_id has; one of rows that repeat doc_id and text.

    Null texts equal empty ones and a null doc_id is larger than any other; texts may have any length; an empty
    table gives an empty result. All columns come back as they are, whatever their names.
    """
    key_name, nth_name = free_names(docs, "key", "nth")
    # One key column serves the join and the numbering of repeated rows, so texts are dealt once.
    named = lambda sha: F.concat_ws("|", F.col("doc_id").cast("string"), sha)
    kept = resolve_duplicates(docs).where("kept").select(named(F.col("text_sha256")).alias(key_name))
    keyed = docs.withColumn(key_name, named(F.sha2(normalised(F.col("text")), 256)))
    nth = F.row_number().over(Window.partitionBy(key_name).orderBy(F.lit(1)))
    return keyed.join(kept, key_name, "left_semi").withColumn(nth_name, nth).where(F.col(nth_name) == 1).select(*docs.columns)
