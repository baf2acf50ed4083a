"""Packing documents into training sequences: shortest pack first over the length histogram.

A document's token ids are cut at multiples of the sequence length. Only the histogram of piece
lengths, at most one count per length, reaches the driver. Lengths are placed longest first; a
length goes to the open packing pattern that is shortest, all equal packs at once, so patterns and
their counts stay few however many pieces there are. Pieces are then ranked within their length and
a rank says which pattern slot, and so which sequence and offset, a piece has.

Ranking doesn't gather a length in one task: the pieces of a length are dealt by hash into as many blocks
as their number asks for, numbered within a block, and moved up by the number of pieces in the blocks before.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm.arrow import ragged_arange, slices
from tessella.staging import stage_table

VOCABULARY = "byte_bpe_50k"
SEQUENCE = 2048
END_ID = 1
REMEMBERED = 300_000
BLOCK_ROWS = 1024

# A space between words: a token boundary always lies before it. Others stay inside a unit.
_PLAIN = re.compile(r" (?:\s|$)")
_BOUNDARY = re.compile(r"(?= \S)")


class UnitIds:
    """Token ids of texts by way of their space-separated units, each distinct one encoded once.

    The vocabulary's pre-tokens never cross the place before a space with a non-space behind it, so the ids
    of a text are those of its units in order. The ids of known units lie in one array; a full table
    keeps the units met most often. Units are encoded by the library that reads the same vocabulary as ranks; a text that
    holds a special token's string goes through ``tokenizers`` as a whole, which knows how to cut there.
    """

    def __init__(self, vocabulary: str) -> None:
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.spaced[[n for token, n in ranks.items() if token[:1] == b" "]] = True
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        #: A unit in the middle of a text is a string; a first one or a whole text is a pair, so no text can look like one.
        self.index: defaultdict[str | tuple[bool, str], int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.pool = np.zeros(0, dtype="<u4")
        self.starts = self.lengths = self.hits = np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        """Keep the half of the units that was met most often."""
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: REMEMBERED // 2])
        units, lengths = list(self.index), self.lengths[keep]
        self.pool = self.pool[np.repeat(self.starts[keep], lengths) + ragged_arange(lengths)]
        self.starts, self.lengths, self.hits = np.cumsum(lengths) - lengths, lengths, self.hits[keep] // 2
        self.index.clear()
        self.index.update((units[k], at) for at, k in enumerate(keep.tolist()))

    def _add(self, units: list[str | tuple[bool, str]]) -> None:
        """Ids of new units. Those without a space inside are encoded as one text, whose ids begin a unit where they begin with a space."""
        lengths, fresh = np.zeros(len(units), dtype=np.int64), [[]] * len(units)
        plain = [k for k, u in enumerate(units) if isinstance(u, str) and u and " " not in u]
        for k in set(range(len(units))).difference(plain):
            fresh[k] = self._encoded(units[k])
            lengths[k] = len(fresh[k])
        together = np.array(self.encode("".join(" " + units[k] for k in plain)), dtype="<u4")
        lengths[plain] = np.diff(np.flatnonzero(self.spaced[together]), append=len(together))
        rest = np.fromiter(chain.from_iterable(fresh), dtype="<u4")
        inner = np.zeros(len(units), dtype=bool)
        inner[plain] = True
        inner = np.repeat(inner, lengths)
        fresh = np.empty(len(inner), dtype="<u4")
        fresh[inner], fresh[~inner] = together, rest
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.hits = np.concatenate([self.hits, np.zeros(len(units), dtype=np.int64)])
        self.pool = np.concatenate([self.pool, fresh])

    def units(self, text: str) -> list[str | tuple[bool, str]]:
        """Units in order: first ``(False, unit)``, then units without the space in front of them; or only ``(True, text)``."""
        if any(s in text for s in self.special):
            return [(True, text)]
        if _PLAIN.search(text):
            first, *rest = _BOUNDARY.split(text)
            first, rest = ("", [first[1:], *(r[1:] for r in rest)]) if first[:1] == " " and first[1:] and not first[1].isspace() else (first, [r[1:] for r in rest])
        else:
            first, *rest = text.split(" ")
        return [(False, first), *rest]

    def _encoded(self, unit: str | tuple[bool, str]) -> list[int]:
        if isinstance(unit, str):
            return self.encode(" " + unit)
        whole, text = unit
        return self.whole.encode(text, add_special_tokens=False).ids if whole else self.encode(text)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if len(self.index) > REMEMBERED:
            self._forget()
        cut = [self.units(t) for t in texts]
        known, per_text = len(self.index), np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(per_text.sum()))
        self._add(list(islice(self.index, known, None)))
        self.hits += np.bincount(at, minlength=len(self.hits))
        lengths = self.lengths[at]
        flat = self.pool[np.repeat(self.starts[at], lengths) + ragged_arange(lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(per_text)]
        return flat, np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def _ids(vocabulary: str) -> UnitIds:
    return UnitIds(vocabulary)


def document_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked, ``ids``."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(vocabulary)
        for part in slices(batches, 1):
            flat, counts = ids.batch([t or "" for t in part.column(1).to_pylist()])
            counts = counts + 1
            ends = np.cumsum(counts)
            tokens = np.full(int(ends[-1]), end_id, dtype="<u4")
            inner = np.ones(len(tokens), dtype=bool)
            inner[ends - 1] = False
            tokens[inner] = flat
            pieces = -(-counts // sequence)
            doc = np.repeat(np.arange(len(counts)), pieces)
            start = ragged_arange(pieces) * sequence
            length = np.minimum(counts[doc] - start, sequence)
            begin = (ends - counts)[doc] + start
            crcs = [zlib.crc32(tokens[a : a + n].tobytes()) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(counts[doc])]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(tokens)).astype(np.int32)), pa.array(tokens.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Packing patterns, as the lengths in them, with the number of sequences of each.

    Longest lengths first; each piece goes into the shortest pack with room for it, also one that just took
    its like, and a new pack is opened when none has room. Packs with equal room move together.
    """
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    shortest: list[int] = []
    done: list[tuple[list[int], int]] = []

    def put(pattern: list[int], count: int, left: int) -> None:
        if not left:
            done.append((pattern, count))
            return
        if not room[left]:
            heappush(shortest, -left)
        room[left].append((pattern, count))

    for length in sorted(counts, reverse=True):
        waiting = counts[length]
        while waiting and shortest and -shortest[0] >= length:
            left = -shortest[0]
            pattern, count = room[left].pop()
            moved = min(count, waiting)
            if count > moved:
                room[left].append((pattern, count - moved))
            elif not room[left]:
                heappop(shortest)
            put([*pattern, length], moved, left - length)
            waiting -= moved
        if waiting:
            fits = min(sequence // length, waiting)
            many, over = divmod(waiting, fits)
            put([length] * fits, many, sequence - fits * length)
            if over:
                put([length] * over, 1, sequence - over * length)
    return done + [entry for left in sorted(room) for entry in room[left]]


def _slots(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per slot, in order of (length, first rank): its length, first rank, first sequence and offset."""
    slots, sequence, taken = [], 0, defaultdict(int)
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            slots.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(slots), strict=True)) if slots else (np.zeros(0, dtype=np.int64),) * 4


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: the piece, its ``sequence_id`` and its ``offset`` there.

    Sequence ids count from 0 without gaps. A null text is empty, and an empty text is a document of its
    end id alone; a text of any length is cut into pieces; rows that repeat, and pieces of equal length, are packed
    each, in the order of a hash; an empty table gives an empty result; other columns are not read.
    """
    pieces = stage_table(document_pieces(docs, vocabulary, sequence, end_id, with_ids), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths, ranks, firsts, offsets = _slots(pack_histogram(histogram, sequence))
    span = max(histogram.values(), default=0) + 1
    keys = lengths * span + ranks
    # At most one entry per length: how many blocks its pieces are dealt over.
    blocks = F.array(*[F.lit(-(-histogram.get(n, 1) // BLOCK_ROWS)) for n in range(1, sequence + 1)])
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", F.lit(7)), F.get(blocks, F.col("length").cast("int") - 1)))
    counted = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor(F.col("block") / BLOCK_ROWS))
    # Pieces before a block: those in the parts before its part, then those in the blocks before it there.
    before = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counted.groupBy("length", "part").agg(F.sum("n").alias("n"))
    parts = parts.select(F.col("length").alias("_l"), F.col("part").alias("_p"), before("part", "length").alias("above"))
    within = counted.withColumn("base", before("block", "length", "part")).join(parts, (F.col("length") == F.col("_l")) & (F.col("part") == F.col("_p")))
    bases = within.select(F.col("length").alias("_length"), F.col("block").alias("_block"), (F.col("above") + F.col("base")).alias("base"))
    numbered = dealt.join(bases, (F.col("length") == F.col("_length")) & (F.col("block") == F.col("_block")))
    local = F.row_number().over(Window.partitionBy("_length", "_block").orderBy("doc_id", "start", "ids_crc32"))
    ranked = numbered.select(*pieces.columns, (F.col("base") + local - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            columns = [*batch.columns[:-1], pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
