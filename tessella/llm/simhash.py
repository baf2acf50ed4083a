"""SimHash near-dedup by anchor-point covering.

Two fingerprints that differ in at most 4 of 64 bits differ in at most one bit of some third of the
word. Each third has a covering code as its anchors: the perfect Hamming code on 15 bits times all
values of the rest, with covering radius 1. Every fingerprint is replicated to all anchors of each
third within radius plus threshold, 1 + 1, of its bits; the one nearest to it is its home. If x and y
are within one bit there, y is within two bits of the home of x, so comparing at each anchor those at
home with all that reach it meets every pair, and whole words decide.

Equal fingerprints are one before that. An anchor emits a spanning set of links, never all pairs, and
an anchor that very many fingerprints reach is searched breadth first, where members of a component
leave the set that later ones are compared with: a dense group costs about its size. What meets at an
anchor are distinct fingerprints of 8 bytes each. Components come from rounds of staged tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.arrow import ragged_arange, slices
from tessella.llm.text import free_names
from tessella.operators.components import connected_components
from tessella.staging import stage_table

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Shingles whose bits are unpacked at a time.
STRETCH = 1 << 16
#: First bit and width of each third; 15 bits of each carry the Hamming code.
THIRDS = ((0, 22), (22, 21), (43, 21))
PAIRS = 1 << 21
LARGE = 1 << 24


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the shingle hashes; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    size = min(SHINGLE, len(words))
    stops = ends[size - 1 :].tolist()
    begins = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(stops), STRETCH):
        spans = zip(begins[at : at + STRETCH], stops[at : at + STRETCH], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view("u1"), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(stops), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        prints = [fingerprint(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
        found = pa.array(np.array(prints, dtype="<u8").view("<i8"))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), found], names=["doc_id", "mark", "print"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, print`` for each row of ``docs(doc_id, text)``: a hash of the text and the 64 bits, as signed longs."""
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(_fingerprints, f"doc_id {kind}, mark long, print long")


class AnchorCode:
    """The anchors of one third: words of its bits whose lowest 15 have syndrome 0."""

    def __init__(self, width: int) -> None:
        points = np.arange(1 << 15, dtype=np.int64)
        self.syndrome = np.zeros(1 << 15, dtype=np.int64)
        for bit in range(15):
            self.syndrome ^= np.where(points >> bit & 1, bit + 1, 0)
        light = [0, *(1 << i for i in range(width)), *(1 << i | 1 << j for i in range(width) for j in range(i))]
        by = [[m for m in light if self.syndrome[m & 0x7FFF] == s] for s in range(16)]
        # The nearest anchor first: the lightest change that reaches one.
        self.changes = [np.array(sorted(m, key=lambda x: (x.bit_count(), x)), dtype=np.int64) for m in by]
        self.home_change = np.array([m[0] for m in self.changes], dtype=np.int64)

    def home(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.home_change[self.syndrome[words & 0x7FFF]]

    def reached(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``words`` and anchor, for all anchors within two bits."""
        kinds = self.syndrome[words & 0x7FFF]
        index, anchors = [], []
        for s, changes in enumerate(self.changes):
            own = np.flatnonzero(kinds == s)
            index.append(np.repeat(own, len(changes)))
            anchors.append((words[own][:, None] ^ changes[None, :]).ravel())
        return np.concatenate(index), np.concatenate(anchors)


_CODES = tuple(AnchorCode(width) for _, width in THIRDS)


def _third(prints: np.ndarray, k: int) -> np.ndarray:
    first, width = THIRDS[k]
    return (prints.astype(np.uint64) >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), 20_000):
            own = prints[at : at + 20_000]
            for k, code in enumerate(_CODES):
                index, anchors = code.reached(_third(own, k))
                yield pa.RecordBatch.from_arrays([pa.array(anchors | k << 32), pa.array(own[index])], names=["anchor", "print"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes a root of its component in the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        for side in (a, b):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
        open_links = root[a] != root[b]
        a, b = a[open_links], b[open_links]
    return root


def _search(prints: np.ndarray) -> np.ndarray:
    """Roots among many fingerprints, breadth first."""
    root, free = np.arange(len(prints)), np.arange(len(prints))
    while len(free):
        seed, free = free[0], free[1:]
        front = [seed]
        while front and len(free):
            hit = _near(prints[free], prints[front.pop()])
            found, free = free[hit], free[~hit]
            root[found] = seed
            front.extend(found.tolist())
    return root


def _links(anchors: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links found at the anchors of a sorted, complete stretch of rows."""
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    sizes = np.diff(np.append(starts, len(anchors)))
    third, words = anchors >> 32, anchors & 0xFFFFFFFF
    home = np.zeros(len(anchors), dtype=bool)
    for k, code in enumerate(_CODES):
        own = third == k
        home[own] = code.home(_third(prints[own], k)) == words[own]
    homes = np.add.reduceat(home.astype(np.int64), starts)
    left, right = [], []
    for b in np.flatnonzero(homes * sizes > LARGE).tolist():
        own = prints[starts[b] : starts[b] + sizes[b]]
        root = _search(own)
        moved = np.flatnonzero(root != np.arange(len(own)))
        left.append(own[moved])
        right.append(own[root[moved]])
        home[starts[b] : starts[b] + sizes[b]] = False
    at = np.flatnonzero(home)
    bucket = np.searchsorted(starts, at, side="right") - 1
    costs = np.cumsum(sizes[bucket])
    done = 0
    while done < len(at):
        stop = max(done + 1, int(np.searchsorted(costs, (costs[done - 1] if done else 0) + PAIRS, side="right")))
        own, of = at[done:stop], bucket[done:stop]
        a = np.repeat(own, sizes[of])
        b = np.repeat(starts[of], sizes[of]) + ragged_arange(sizes[of])
        near = _near(prints[a], prints[b]) & (a != b)
        a, b = a[near], b[near]
        if len(a):
            nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _spanning(len(nodes), back[: len(a)], back[len(a) :])
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            left.append(prints[nodes[moved]])
            right.append(prints[nodes[root[moved]]])
        done = stop
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; the last anchor of a batch waits for its other rows."""
    held_anchors, held_prints = [], []
    for batch in batches:
        anchors, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(anchors):
            continue
        cut = int(np.searchsorted(anchors, anchors[-1]))
        if cut or (held_anchors and held_anchors[-1][-1] != anchors[0]):
            whole = np.concatenate([*held_anchors, anchors[:cut]]), np.concatenate([*held_prints, prints[:cut]])
            a, b = _links(*whole)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held_anchors, held_prints = [], []
        held_anchors.append(anchors[cut:])
        held_prints.append(prints[cut:])
    if held_anchors:
        a, b = _links(np.concatenate(held_anchors), np.concatenate(held_prints))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, print, root, component_id`` for each row; the root is a fingerprint and tells components apart."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = stage_table(document_fingerprints(docs), "simhash-prints")
    distinct = stage_table(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    replicas = distinct.select("print").mapInArrow(_replicate, "anchor long, print long")
    met = replicas.repartition(partitions, "anchor").sortWithinPartitions("anchor")
    roots = connected_components(met.mapInArrow(_compare, "a long, b long"))
    labelled = distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    smallest = labelled.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    by_print = labelled.join(smallest, F.col("root") == F.col("of")).select(F.col("print").alias("of_print"), "root", "component_id")
    return prints.join(by_print, F.col("print") == F.col("of_print")).select("doc_id", "mark", "print", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    Texts, of any length, link if their fingerprints differ in at most ``DISTANCE`` bits; ``component_id`` is the
    smallest doc_id that links reach. Words are lower-cased A-Z only; texts of fewer than ``SHINGLE`` words hash as
    one shingle; null texts and texts without words have fingerprint 0, which links like any other. A null
    doc_id is no smallest id unless a component has no other. Rows that repeat are returned each; an
    empty table gives an empty result; other columns are not read.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one row, with the smallest doc_id, of each.

    Null texts and texts without words are one component; a null doc_id is larger than any other, a component of
    null ids keeps one row; of rows that repeat a component's smallest doc_id the one whose text hashes lowest
    stays; texts may have any length; an empty table gives an empty result. All columns come back as they are,
    whatever their names.
    """
    key_name, nth_name = free_names(docs, "key", "nth")
    named = lambda mark: F.concat_ws("|", F.col("doc_id").cast("string"), mark)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("best")
    kept = _grouped(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(best)
    kept = kept.select(F.concat_ws("|", F.col("best.doc_id").cast("string"), F.col("best.mark")).alias(key_name))
    keyed = docs.withColumn(key_name, named(F.xxhash64(F.coalesce("text", F.lit("")))))
    # One key column serves the join and the numbering of repeated rows, so texts are dealt once.
    nth = F.row_number().over(Window.partitionBy(key_name).orderBy(F.lit(1)))
    return keyed.join(kept, key_name, "left_semi").withColumn(nth_name, nth).where(F.col(nth_name) == 1).select(*docs.columns)
