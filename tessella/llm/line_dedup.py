"""Line dedup through a sharded minimal perfect hash.

Pass 1 hashes the key of every line to 128 bits and reduces the corpus to one entry per distinct key:
the number of documents that hold it and the smallest and largest of their ids, with partial
aggregation before the shuffle. Entries are dealt to shards by their hash. Each shard builds a minimal
perfect hash over its keys (cascaded bit arrays with rank counts) that indexes three arrays: a 32-bit
fingerprint, a saturated count and the owner, the smallest document id.

Pass 2 sends the hashes of lines, never their text, to the shard's arrays, probes them there and
collects for each document the numbers of the lines it loses. A shard that many documents ask is
copied and its probes are dealt over the copies, so a line in a third of all documents doesn't
gather them in one task. A shard's arrays come before its probes in the sorted stream of a task;
nothing but the arrays of one shard is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.arrow import slices
from tessella.llm.text import SPACE_CHARS
from tessella.staging import stage_table

MIN_CHARS = 10
SHARD_KEYS = 1 << 16
PROBES = 400_000
#: Rows of two integers that may be broadcast; beyond that the table of copies is joined by a shuffle.
BROADCAST_ROWS = 10_000
_STRIP = SPACE_CHARS.encode()
_GAMMA = 2
_COUNT_MAX = 255


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case (bytes.lower leaves all others)."""
    return line.strip(_STRIP).lower()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, row) to one row per document and distinct long key: both halves of its hash and its lines."""
    digest = xxhash.xxh3_128_digest
    for part in slices(batches, 1):
        docs, rows, lists, blob = [], [], [], []
        for doc, row, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
            own: dict[bytes, list[int]] = {}
            for n, line in enumerate(text.split(b"\n")):
                key = line_key(line)
                if len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode(errors="replace")) >= MIN_CHARS):
                    own.setdefault(digest(key), []).append(n)
            docs += [doc] * len(own)
            rows += [row] * len(own)
            lists += own.values()
            blob += own
        halves = np.frombuffer(b"".join(blob), dtype="<i8").reshape(-1, 2)
        columns = [pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(lists, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "high", "low", "lines"])


def _mix(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of both halves for each level of the cascade."""
    with np.errstate(over="ignore"):
        x = high.astype(np.uint64) ^ (low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by cascaded bit arrays: a key rests at the first level where it is alone."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.bits = [np.unpackbits(b, bitorder="little").view(bool) for b in levels]
        self.below = np.cumsum([0, *(int(b.sum()) for b in self.bits)])
        self.ranks = [np.cumsum(b) - 1 for b in self.bits]

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """Keys must be distinct pairs."""
        levels, level = [], 0
        while len(high):
            size = max(64, -(-_GAMMA * len(high) // 64) * 64)
            at = (_mix(high, low, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = ~alone[at]
            high, low, level = high[left], low[left], level + 1
        return cls(levels)

    def __call__(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of each key, in 0..n-1; -1 for a key that rests nowhere. Keys not built from may get any index."""
        out = np.full(len(high), -1, dtype=np.int64)
        left = np.arange(len(high))
        for level, bits in enumerate(self.bits):
            at = (_mix(high[left], low[left], level) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = self.below[level] + self.ranks[level][at[here]]
            left = left[~here]
            if not len(left):
                break
        return out


def _pack_shard(high: np.ndarray, low: np.ndarray, owner: np.ndarray, count: np.ndarray) -> bytes:
    index = PerfectHash.build(high, low)
    at = index(high, low)
    prints, owners, counts = np.zeros(len(at), "<u4"), np.zeros(len(at), "<i8"), np.zeros(len(at), "u1")
    prints[at], owners[at], counts[at] = low.astype(np.uint64) >> np.uint64(32), owner, np.minimum(count, _COUNT_MAX)
    sizes = np.array([len(at), len(index.levels), *(len(b) for b in index.levels)], dtype="<i8")
    return b"".join([sizes.tobytes(), *(b.tobytes() for b in index.levels), prints.tobytes(), owners.tobytes(), counts.tobytes()])


class _Shard:
    def __init__(self, packed: bytes) -> None:
        n, depth = np.frombuffer(packed, "<i8", 2).tolist()
        sizes = np.frombuffer(packed, "<i8", depth, 16).tolist()
        at, levels = 16 + 8 * depth, []
        for size in sizes:
            levels.append(np.frombuffer(packed, "u1", size, at))
            at += size
        self.index = PerfectHash(levels)
        self.prints = np.frombuffer(packed, "<u4", n, at)
        self.owners = np.frombuffer(packed, "<i8", n, at + 4 * n)
        self.counts = np.frombuffer(packed, "u1", n, at + 12 * n)

    def loses(self, high: np.ndarray, low: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> np.ndarray:
        """Whether each document loses its lines of this key: others hold it and the owner, which has an id then, is another one."""
        at = self.index(high, low)
        known = (at >= 0) & (self.prints[at] == (low.astype(np.uint64) >> np.uint64(32)))
        return known & (self.counts[at] > 1) & (unnamed | (self.owners[at] != doc))


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by shard to one packed row per shard; only the entries of one shard are held."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        shard, high, low, owner, count = (pc.fill_null(whole.column(k), 0).to_numpy() for k in range(5))
        return pa.RecordBatch.from_arrays([pa.array(shard[:1]), pa.array([_pack_shard(high, low, owner, count)], pa.binary())], names=["shard", "packed"])

    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != shards[a]:
                yield packed()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield packed()


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shard's arrays, then its probes; out come the lines to drop."""
    shard: _Shard | None = None
    for batch in batches:
        packed, doc, high, low = batch.column("packed"), *(pc.fill_null(batch.column(c), 0).to_numpy() for c in ("id", "high", "low"))
        unnamed = batch.column("id").is_null().to_numpy(zero_copy_only=False)
        arrays = np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([-1, *arrays], [*arrays, len(doc)], strict=True):
            if a >= 0:
                shard = _Shard(packed[a].as_py())
            if b - a <= 1:
                continue
            lost = shard.loses(high[a + 1 : b], low[a + 1 : b], doc[a + 1 : b], unnamed[a + 1 : b])
            drop = pa.array(np.flatnonzero(lost) + a + 1)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(drop) for c in ("id", "row", "lines")], names=["id", "row", "lines"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for each row of ``docs(doc_id, text)``.

    A text splits at newlines. Lines whose key has at least ``MIN_CHARS`` code points and is found in at
    least two documents go, except in the document with the smallest id that holds it. Rows that repeat a
    doc_id, an integer, are one document in this, a null doc_id is one that comes last. A null or empty text is one
    empty line; texts and lines may have any length; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("row"))
    lines = stage_table(rows.select("id", "text", "row").mapInArrow(_hash_lines, "id long, row long, high long, low long, lines array<int>"), "lines")
    per_key = lines.groupBy("high", "low").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("id").alias("named"), F.count(F.lit(1)).alias("n"))
    per_key = stage_table(per_key, "line-keys")
    shards = max(1, -(-per_key.count() // SHARD_KEYS))
    shard = F.pmod(F.col("high"), F.lit(shards)).alias("shard")
    # An entry of one document, even if its rows repeat, counts 1.
    one = (F.col("named") == 0) | ((F.col("named") == F.col("n")) & (F.col("owner") == F.col("last")))
    count = F.when(one, 1).otherwise(F.greatest(F.col("n"), F.lit(2)))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = per_key.select(shard, "high", "low", "owner", count.alias("count"))
    packed = entries.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(_build_shards, "shard long, packed binary")
    # How many copies of a shard its probes are dealt over: several for the shard of a very common line.
    asked = per_key.groupBy(shard).agg(F.ceil(F.sum("n") / F.lit(PROBES)).alias("copies"))
    copies = stage_table(asked, "line-copies")
    bounded = F.broadcast(copies) if shards <= BROADCAST_ROWS else copies
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    asks = lines.withColumn("shard", F.pmod(F.col("high"), F.lit(shards))).join(bounded, "shard")
    asks = asks.select("shard", F.pmod(F.xxhash64("id"), F.col("copies")).alias("copy"), "id", "row", "high", "low", "lines")
    served = packed.join(bounded, "shard").select("shard", copy, "packed")
    stream = served.unionByName(asks, allowMissingColumns=True).repartition(partitions, "shard", "copy")
    stream = stream.sortWithinPartitions("shard", "copy", F.col("packed").isNull())
    lost = stream.mapInArrow(_probe, "id long, row long, lines array<int>").groupBy(F.col("id").alias("_id"), F.col("row").alias("_row"))
    lost = lost.agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lost"))
    joined = rows.join(lost, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    joined = joined.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(kept)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n").alias("kept_text"),
    )
