"""LM scoring by online logistic context mixing.

A text is its tokens: words of lower-cased bytes, each closed by a space, then one end. A token is either
spelled or repeated from its word context. Spelled, every bit is predicted from several hashed contexts: the
last one, two, three and four bytes and all of the word so far, always with the bit's place in its byte. A
predictor holds how often a bit was 0 and 1 in its context; the predictions are mixed in the logistic domain
with weights that a gate selects, the gate being how many contexts have been met before and how often the
longest was, and refined by an adaptive map from (gate, prediction) to observed frequency. The word context is
the token before: a token follows it as often as it did in the training part. Which of the two ways a text's
tokens take is learned online while the text is read, by adaptive counters that a gate selects: how often the
token before is known and how many tokens in a row the word context foretold. A text's score is the sum of its
tokens' log10 probabilities, and bits per byte follow.

All counts come from the whole training part, and what a training text adds to the counts that predict it is left
out, token by token, so training and held-out texts compare. Nothing that grows with the corpus is held in one
place. Texts become leaves: rows of about ``LEAF_BYTES`` of text as numbers into the leaf's own words. A leaf
asks shards about its words and its pairs of neighbours, as packed arrays:

- pair shards, by hash, count a pair over all leaves and answer with its number;
- word shards, by the first ``DEEP`` bytes, count words and hold the predictor of longer prefixes, which only such
  words share, in a table of their own size; they spell each distinct word once and answer with its count and
  probabilities.

Only the predictors of at most four bytes are common tables, whose contexts language bounds rather than the corpus.
The mixer is trained online in small batches in every shard, each bit with its own occurrence left out, and averaged.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from math import log10
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.arrow import ragged_arange
from tessella.llm.language_crf import remainder
from tessella.staging import stage_table

LEAF_BYTES = 6 << 20
#: Leaf entries that a shard answers, about.
PAIRS_PER_SHARD = 2 << 20
WORDS_PER_SHARD = 1 << 17
#: Bits of each common table and how many bytes of context it sees; the prefixes of a word up to ``DEEP`` bytes have one more.
TABLES = ((16, 1), (18, 2), (20, 3), (21, 4))
SHORT_BITS = 18
DEEP = 4
BLOCK_BITS = 16
#: Shards whose counters one task adds up, and that one task learns from.
COUNTED_SHARDS, LEARNED_SHARDS = 32, 8
PRIOR = 0.4
RATE = 0.02
BATCH_BITS = 60_000
#: Steps after which the refining map starts to count, with settled weights.
SETTLED = 30
LEVELS = 33
SEEN_STEPS = np.array([0, 1, 3, 8, 40], dtype=np.float32)
PREDICTORS = len(TABLES) + 1
GATES = (PREDICTORS + 1) * (len(SEEN_STEPS) + 1)
STRETCH = 8.0
#: The gates between spelling and word context: steps of how often the token before is known, and of the run of foretold tokens.
KNOWN_STEPS = np.array([2, 4, 16, 256], dtype=np.int64)
RUNS = 4
#: How many tokens an adaptive counter's first estimate is worth.
WORTH = 4.0
END = b"\n"
_BEGIN = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = "block long, counts binary"
_ASKED = "shard long, leaf string, payload binary"
_ANSWER = "leaf string, kind int, shard long, payload binary"
_WORDS, _PAIRS = 1, 2


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words and the end token, which no word equals as it is white space."""
    return [*text.lower().split(), END]


def _packed(values: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else values.tobytes())


def _unpacked(payload: bytes, kind: str | None = None) -> bytes | np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(payload)
    return data if kind is None else np.frombuffer(data, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ASKED_SCHEMA = pa.schema([("shard", pa.int64()), ("leaf", pa.string()), ("payload", pa.binary())])
_ANSWER_SCHEMA = pa.schema([("leaf", pa.string()), ("kind", pa.int32()), ("shard", pa.int64()), ("payload", pa.binary())])


# Leaves


@dataclass
class Leaf:
    """Texts as token numbers: ``words`` has each distinct token once, ``ids`` all tokens of all texts in order."""

    words: list[bytes]
    ids: np.ndarray
    sizes: np.ndarray
    training: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Leaf:
        """From a row of the leaves' table."""
        words = _unpacked(row["words"]).split(b" ")
        return cls(words, _unpacked(row["ids"], "<u4").astype(np.int64), np.array(row["sizes"], dtype=np.int64), ~np.array(row["held"], dtype=bool))

    def counts(self) -> np.ndarray:
        """Number of each word in training texts."""
        return np.bincount(self.ids[np.repeat(self.training, self.sizes)], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs' hashes in order, and which pair each token makes with the one before."""
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype=np.uint64, count=len(self.words))
        own = hashed[self.ids]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = _BEGIN
        with np.errstate(over="ignore"):
            both = (before * np.uint64(0xC2B2AE3D27D4EB4F) ^ own) * np.uint64(0x9E3779B97F4A7C15)
            both ^= both >> np.uint64(32)
            both *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(both, return_inverse=True)

    def word_shards(self, shards: int) -> list[np.ndarray]:
        """The numbers of the words that each shard answers."""
        of = np.fromiter((zlib.crc32(w[:DEEP]) for w in self.words), dtype=np.int64, count=len(self.words)) % shards
        order = np.argsort(of, kind="stable")
        return np.split(order, np.searchsorted(of[order], np.arange(1, shards)))


def _make_leaves(kind: str) -> tuple[Callable, str]:
    names = ["leaf", "doc_ids", "held", "sizes", "n_bytes", "n_words", "n_tokens", "ids", "words"]
    fields = f"leaf string, doc_ids array<{kind}>, held array<boolean>, sizes array<long>, n_bytes array<long>, n_words long, n_tokens long, ids binary, words binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, held_out) rows to leaves; a text longer than a leaf's is a leaf of its own."""
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids: list[np.ndarray] = []
        held: list[bool] = []
        n_bytes: list[int] = []
        doc_ids: list[pa.Scalar] = []
        kept = 0

        def leaf() -> pa.RecordBatch:
            sizes = list(map(len, ids))
            flat = np.concatenate(ids).astype("<u4")
            values = [uuid4().hex, None, held, sizes, n_bytes, len(number), len(flat), _packed(flat), _packed(b" ".join(number))]
            kinds = [pa.string(), None, pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 2, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            columns = [pa.array([v], t) if t is not None else None for v, t in zip(values, kinds, strict=True)]
            columns[1] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(doc_ids))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if ids and kept + len(text) > LEAF_BYTES:
                    yield leaf()
                    number.clear()
                    for held_list in (ids, held, n_bytes, doc_ids):
                        held_list.clear()
                    kept = 0
                own = tokens(text)
                ids.append(np.fromiter(map(number.__getitem__, own), dtype=np.uint32, count=len(own)))
                held.append(batch.column(2)[k].as_py())
                n_bytes.append(sum(map(len, own)) + len(own) - 1)
                doc_ids.append(batch.column(0).slice(k, 1))
                kept += len(text)
        if ids:
            yield leaf()

    return make, fields


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}


# Pairs


def _pair_cuts(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's stretch of sorted hashes begins and the last one ends."""
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(pairs, inner), [len(pairs)]])


def _ask_pairs(bits: int) -> Callable:
    """Leaves to questions: the leading 40 bits of each distinct pair's hash behind the shard's, and its training number."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            leaf = Leaf.of(row)
            pairs, at = leaf.pairs()
            counts = np.bincount(at[np.repeat(leaf.training, leaf.sizes)], minlength=len(pairs))
            keys = (pairs << np.uint64(bits)) >> np.uint64(24)
            five = keys.astype("<u8").view("u1").reshape(-1, 8)[:, :5]
            many = np.minimum(counts, 255).astype("u1")
            cuts = _pair_cuts(pairs, bits)
            out = []
            for shard, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a < b:
                    over = np.flatnonzero(counts[a:b] >= 255)
                    payload = [np.array([b - a, len(over)], "<u4"), five[a:b], many[a:b], over.astype("<u4"), counts[a:b][over].astype("<u4")]
                    out.append((shard, row["leaf"], b"".join(p.tobytes() for p in payload)))
            yield _batch(out, _ASKED_SCHEMA)

    return ask


def _read_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, more = np.frombuffer(payload, "<u4", 2).tolist()
    wide = np.zeros((n, 8), "u1")
    wide[:, :5] = np.frombuffer(payload, "u1", 5 * n, 8).reshape(-1, 5)
    counts = np.frombuffer(payload, "u1", n, 8 + 5 * n).astype(np.int64)
    counts[np.frombuffer(payload, "<u4", more, 8 + 6 * n)] = np.frombuffer(payload, "<u4", more, 8 + 6 * n + 4 * more)
    return wide.view("<u8").ravel(), counts


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """Questions sorted by shard, all of a shard together."""
    shard, held = -1, []
    for row in _rows(batches):
        if held and row["shard"] != shard:
            yield shard, held
            held = []
        shard = row["shard"]
        held.append((row["leaf"], row["payload"]))
    if held:
        yield shard, held


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf's answer, the number of each of its pairs; and without a leaf how many tokens repeat a pair, of how many."""
    for shard, asked in _by_shard(batches):
        parts = [_read_pairs(payload) for _, payload in asked]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, c in parts]), minlength=len(keys)).astype("<u4")
        ends = np.cumsum([len(k) for k, _ in parts])[:-1]
        out = [(leaf, _PAIRS, shard, _packed(total[own])) for (leaf, _), own in zip(asked, np.split(at, ends), strict=True)]
        known = f"{total[total > 1].sum(dtype=np.int64)} {total.sum(dtype=np.int64)}"
        yield _batch([*out, (None, _PAIRS, shard, known.encode())], _ANSWER_SCHEMA)


# Spelling


class Bits:
    """All bits of a list of words, closed by a space but for the end, with the slot of each in every table.

    Words that begin alike share the bits of their beginning: a byte behind the same prefix is one edge, which
    weighs as often as its words occur. The last slots are of the word so far: up to ``DEEP`` bytes in the common
    table, longer ones each in one of their own, ``deep_size`` in all, that follow it.
    """

    def __init__(self, words: list[bytes], numbers: np.ndarray) -> None:
        closed = [w if w == END else w + b" " for w in words]
        lengths = np.fromiter(map(len, closed), dtype=np.int64, count=len(closed))
        data = np.frombuffer(b"".join(closed), dtype=np.uint8).astype(np.uint64)
        place = ragged_arange(lengths)
        self.words = len(words)
        self.owner = np.repeat(np.arange(len(words)), lengths)
        shifts = np.arange(7, -1, -1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            whole = _prefixes(data, place, lengths)
            ends = (whole ^ (data + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9FB21C651E98DF25)
            _, first, self.edge = np.unique(ends, return_index=True, return_inverse=True)
            self.weight = np.repeat(np.bincount(self.edge, numbers[self.owner], minlength=len(first)), 8)
            byte, at = data[first], place[first]
            self.bit = ((byte[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.float32).ravel()
            node = (np.uint64(256) + byte)[:, None] >> (shifts + np.uint64(1))[None, :]
            node *= np.uint64(0xC2B2AE3D27D4EB4F)

            hashed = lambda context: ((context[:, None] + node) * np.uint64(0xFF51AFD7ED558CCD)).ravel()
            slots = lambda context, bits: (hashed(context) >> np.uint64(64 - bits)).astype(np.int32)
            self.slots = []
            for k, (bits, order) in enumerate(TABLES):
                context = np.zeros(len(first), dtype=np.uint64)
                for back in range(order, 0, -1):
                    seen = np.where(at >= back, data[np.maximum(first - back, 0)] + np.uint64(1), np.uint64(0))
                    context = (context + seen + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    context ^= context >> np.uint64(29)
                self.slots.append(slots(context, bits))
            self.deep = np.repeat(at >= DEEP, 8)
            prefix = slots(whole[first], SHORT_BITS)
            longer, prefix[self.deep] = np.unique(hashed(whole[first])[self.deep], return_inverse=True)
            prefix[self.deep] += 1 << SHORT_BITS
            self.slots.append(prefix)
            self.deep_size = len(longer)

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sums over the bits of each word."""
        return np.bincount(self.owner, values.reshape(-1, 8).sum(axis=1)[self.edge], minlength=self.words)

    def part(self, start: int, stop: int) -> Bits:
        """Some of the bits, in the order of a hash."""
        out = copy(self)
        out.bit, out.weight = self.bit[start:stop], self.weight[start:stop]
        out.slots = [s[start:stop] for s in self.slots]
        return out


def _prefixes(data: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of all bytes of the word before each byte: a prefix sum of mixed bytes, which a word border cancels."""
    power = np.cumprod(np.concatenate([[1], np.full(int(lengths.max(initial=1)), 0x100000001B3)]).astype(np.uint64), dtype=np.uint64)
    mixed = (data + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    terms = (mixed ^ (mixed >> np.uint64(32))) * power[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])[:-1]
    start = sums[np.cumsum(lengths) - lengths]
    out = (sums - np.repeat(start, lengths) + place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(31))


def _deep(found: Bits) -> np.ndarray:
    """The table of a shard's longer prefixes."""
    return _counters(found.slots[-1] - (1 << SHORT_BITS), found, found.deep_size, found.deep).astype(np.float32)


def _counters(slots: np.ndarray, found: Bits, size: int, only: np.ndarray | None = None) -> np.ndarray:
    """How often a bit was 0 and 1 in each slot."""
    bit, weight = found.bit, found.weight
    if only is not None:
        slots, bit, weight = slots[only], bit[only], weight[only]
    ones = np.bincount(slots, weight * bit, minlength=size)
    return np.stack([np.bincount(slots, weight, minlength=size) - ones, ones], axis=1)


@dataclass
class Shard:
    """The words of one shard in order, with their numbers in the training part."""

    words: list[bytes]
    numbers: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        return cls(_unpacked(row["words"]).split(b" "), _unpacked(row["numbers"], "<i8"))

    def bits(self) -> Bits:
        return Bits(self.words, self.numbers)


def _ask_words(shards: int) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            leaf = Leaf.of(row)
            counts = leaf.counts()
            out = []
            for shard, own in enumerate(leaf.word_shards(shards)):
                if len(own):
                    listed = b" ".join(leaf.words[k] for k in own.tolist())
                    out.append((shard, row["leaf"], _packed(np.uint32(len(own)).tobytes() + counts[own].astype("<u4").tobytes() + listed)))
            yield _batch(out, _ASKED_SCHEMA)

    return ask


def _read_words(payload: bytes) -> tuple[list[bytes], np.ndarray]:
    data = _unpacked(payload)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return data[4 + 4 * n :].split(b" "), np.frombuffer(data, "<u4", n, 4).astype(np.int64)


_SHARD_FIELDS = "shard long, n long, tokens long, distinct long, words binary, numbers binary"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All leaves' words to one row per shard."""
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary())])
    for shard, asked in _by_shard(batches):
        total: defaultdict[bytes, int] = defaultdict(int)
        for _, payload in asked:
            for word, n in zip(*(x if isinstance(x, list) else x.tolist() for x in _read_words(payload)), strict=True):
                total[word] += n
        words = sorted(total)
        numbers = np.fromiter(map(total.__getitem__, words), dtype="<i8", count=len(words))
        yield _batch([(shard, len(words), int(numbers.sum()), int((numbers > 0).sum()), _packed(b" ".join(words)), _packed(numbers))], schema)


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's part of the common tables, in blocks of slots."""
    tables = [np.zeros((1 << bits, 2), dtype=np.float32) for bits in _table_bits()]
    any_words = False
    for row in _rows(batches):
        any_words = True
        found = Shard.of(row).bits()
        for k, table in enumerate(tables):
            table += _counters(found.slots[k], found, len(table), ~found.deep if k == len(TABLES) else None)
    if any_words:
        span = 1 << BLOCK_BITS
        for k, table in enumerate(tables):
            for b in range(-(-len(table) // span)):
                yield _block(k << 32 | b, table[b * span : (b + 1) * span].ravel())


def _table_bits() -> list[int]:
    return [*(bits for bits, _ in TABLES), SHORT_BITS]


def _block(key: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([values.astype("<f4").tobytes()], pa.binary())], names=["block", "counts"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by key, added up."""
    key, total = -1, np.zeros(0)
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.frombuffer(packed.as_buffer(), dtype="<f4")
            if k == key:
                total += values
                continue
            if key >= 0:
                yield _block(key, total)
            key, total = k, values.astype(np.float64)
    if key >= 0:
        yield _block(key, total)


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))), -STRETCH, STRETCH)


class Mixer:
    """Counters of the common predictors, gated weights and the refining map."""

    def __init__(self, blocks: list[tuple[int, bytes]]) -> None:
        #: Per table how often a bit was 0 and 1 in each slot.
        self.counts = [np.zeros((1 << bits, 2), dtype=np.float32) for bits in _table_bits()]
        span = 1 << BLOCK_BITS
        for key, packed in blocks:
            k, b = key >> 32, key & 0xFFFFFFFF
            self.counts[k][b * span : (b + 1) * span] = np.frombuffer(packed, dtype="<f4").reshape(-1, 2)
        self.weights = np.full((GATES, PREDICTORS + 1), 0.3, dtype=np.float32)
        self.weights[:, -1] = 0
        self.refined: np.ndarray | None = None

    def seen(self, found: Bits, deep: np.ndarray) -> list[np.ndarray]:
        """Per predictor how often each bit's context was followed by 0 and by 1."""
        tables = [*self.counts[:-1], np.concatenate([self.counts[-1], deep])]
        # Both numbers of a slot in one look-up.
        return [t.view(np.uint64).ravel().take(s).view(np.float32).reshape(-1, 2) for t, s in zip(tables, found.slots, strict=True)]

    def inputs(self, seen: list[np.ndarray], bit: np.ndarray, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions with a constant, one row per predictor, and the gate of each bit.

        A predictor counts as met if it leans either way. Left out is one occurrence of the bit itself.
        """
        x = np.ones((PREDICTORS + 1, len(bit)), dtype=np.float32)
        met = np.zeros(len(bit), dtype=np.int64)
        for k, both in enumerate(seen):
            down, up = both[:, 0], both[:, 1]
            if leave_out:
                down, up = np.maximum(down - (1 - bit), 0), np.maximum(up - bit, 0)
            x[k] = _stretch(down, up)
            met += x[k] != 0
        return x, met * (len(SEEN_STEPS) + 1) + np.searchsorted(SEEN_STEPS, down + up)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape[1], dtype=np.float32)
        for k in range(len(x)):
            out += self.weights[:, k].astype(np.float32).take(gate) * x[k]
        return np.clip(out, -STRETCH, STRETCH)

    def learn(self, found: Bits, deep: np.ndarray, step: int, state: np.ndarray, tally: np.ndarray) -> None:
        """One online step, every bit weighing as often as it occurs.

        ``state`` has the running mean and mean square of the slopes, which scale the step; ``tally`` gains the
        sums of bits and rows by (gate, level).
        """
        x, gate = self.inputs(self.seen(found, deep), found.bit, leave_out=True)
        dot = self.mixed(x, gate)
        error = (found.bit - 1 / (1 + np.exp(-dot))) * found.weight
        mass = np.bincount(gate, found.weight, minlength=GATES) + 1e-9
        slope = np.stack([np.bincount(gate, error * row, minlength=GATES) / mass for row in x], axis=1)
        state[0] += 0.1 * (slope - state[0])
        state[1] += 0.01 * (slope * slope - state[1])
        scaled = state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
        self.weights = self.weights + RATE / (1 + step / 100) ** 0.5 * scaled
        level = np.round((dot + STRETCH) * ((LEVELS - 1) / (2 * STRETCH))).astype(np.int64)
        cell = gate * LEVELS + level
        tally[0] += np.bincount(cell, found.weight * found.bit, minlength=GATES * LEVELS)
        tally[1] += np.bincount(cell, found.weight, minlength=GATES * LEVELS)

    def refine(self, tally: np.ndarray) -> None:
        """Observed frequency by (gate, level), pulled to the level's own probability where little was seen."""
        own = 1 / (1 + np.exp(-np.tile(np.linspace(-STRETCH, STRETCH, LEVELS), GATES)))
        self.refined = ((tally[0] + 20 * own) / (tally[1] + 20)).astype(np.float32)

    def probability(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a 1, refined."""
        dot = self.mixed(x, gate)
        p = 1 / (1 + np.exp(-dot))
        if self.refined is not None:
            at = (dot + STRETCH) * ((LEVELS - 1) / (2 * STRETCH))
            low = np.minimum(at.astype(np.int64), LEVELS - 2)
            part = at - low
            cell = gate * LEVELS + low
            p = (p + (1 - part) * self.refined[cell] + part * self.refined[cell + 1]) / 2
        return p

    def spelled(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word of a shard, with all counts and with one occurrence of its own left out."""
        found = shard.bits()
        seen = self.seen(found, _deep(found))
        out = []
        for leave_out in (False, True):
            p = self.probability(*self.inputs(seen, found.bit, leave_out))
            out.append(found.per_word(np.log10(np.clip(np.where(found.bit == 1, p, 1 - p), 1e-6, 1))))
        return out[0], out[1]


def train_mixer(words: DataFrame) -> Mixer:
    """Fit to the word shards: common counters summed over all tasks, weights and map learned online in each and averaged."""
    context = words.sparkSession.sparkContext
    shards = words.count()
    parts = words.coalesce(max(1, -(-shards // COUNTED_SHARDS))).mapInArrow(_add_counters, _BLOCKS)
    summed = parts.repartition(8, "block").sortWithinPartitions("block").mapInArrow(_sum_blocks, _BLOCKS)
    # As many blocks as the common tables have, whatever the corpus.
    mixer = Mixer([(r["block"], bytes(r["counts"])) for r in summed.collect()])
    shared = context.broadcast(mixer)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy(shared.value)
        state, tally, seen, step = np.zeros((2, *own.weights.shape)), np.zeros((2, GATES * LEVELS)), 0.0, 0
        for row in _rows(batches):
            found = Shard.of(row).bits()
            deep = _deep(found)
            for at in range(0, len(found.bit), BATCH_BITS):
                part = found.part(at, at + BATCH_BITS)
                mass = float(part.weight.sum())
                if mass:
                    step += 1
                    if step == SETTLED:
                        tally[:] = 0
                    own.learn(part, deep, step, state, tally)
                    seen += mass
        if seen:
            values = np.concatenate([own.weights.ravel() * seen, tally.ravel(), [seen]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    dealt = words.coalesce(max(1, -(-shards // LEARNED_SHARDS)))
    learned = dealt.mapInArrow(learn, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    if learned:
        total = np.zeros(mixer.weights.size + 2 * GATES * LEVELS + 1)
        total[[r["at"] for r in learned]] = [r["value"] for r in learned]
        mixer.weights = total[: mixer.weights.size].reshape(mixer.weights.shape) / total[-1]
        mixer.refine(total[mixer.weights.size : -1].reshape(2, -1))
    return mixer


def _answer_words(shared) -> Callable:
    """A shard's words, first of its rows, then the leaves' questions: counts and both probabilities of each word asked."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        for row in _rows(batches):
            if row["leaf"] is None:
                shard = Shard.of(row)
                whole, without = (x.astype("<f4") for x in shared.value.spelled(shard))
                index = dict(zip(shard.words, range(len(shard.words)), strict=True))
                continue
            asked, _ = _read_words(row["payload"])
            at = np.fromiter(map(index.__getitem__, asked), dtype=np.int64, count=len(asked))
            payload = shard.numbers[at].astype("<i8").tobytes() + whole[at].tobytes() + without[at].tobytes()
            yield _batch([(row["leaf"], _WORDS, row["shard"], _packed(payload))], _ANSWER_SCHEMA)

    return answer


# Texts


def online(word_context: np.ndarray, spelled: np.ndarray, known: np.ndarray, sizes: np.ndarray, first: float) -> np.ndarray:
    """log10 probability of every token of texts that lie one after the other.

    Per token: the probability by its word context, the log10 one by spelling, and how often the token before is
    known. Each text begins with the estimate ``first`` that a token comes from its word context, and learns its
    own, overall and by gate, from the share that the word context had in the tokens it has read. All texts are read in step.
    """
    out = np.empty(len(spelled))
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    active = np.bincount(sizes, minlength=int(sizes.max(initial=0)) + 1)[::-1].cumsum()[::-1][1:].tolist()
    n, gates = len(sizes), (len(KNOWN_STEPS) + 1) * RUNS
    gained, read = np.zeros(n), np.zeros(n)
    gate_gained, gate_read = np.zeros((n, gates)), np.zeros((n, gates))
    run = np.zeros(n, dtype=np.int64)
    bucket = np.searchsorted(KNOWN_STEPS, known, side="right") * RUNS
    plain = np.power(10.0, np.maximum(spelled, -300))
    rows = np.arange(n)
    for step, count in enumerate(active):
        at = starts[:count] + step
        own = rows[:count]
        context, spell = word_context[at], plain[at]
        gate = bucket[at] + run[:count]
        overall = (gained[:count] + WORTH * first) / (read[:count] + WORTH)
        share = (gate_gained[own, gate] + WORTH * overall) / (gate_read[own, gate] + WORTH)
        share = np.where(known[at] > 0, np.clip(share, 1e-4, 1 - 1e-4), 0.0)
        by_context, by_spelling = share * context, (1 - share) * spell
        both = by_context + by_spelling
        out[at] = np.where(context > 0, np.log10(both), np.log10(1 - share) + spelled[at])
        part, counts = by_context / both, (known[at] > 0).astype(float)
        gained[:count] += part * counts
        read[:count] += counts
        gate_gained[own, gate] += part * counts
        gate_read[own, gate] += counts
        run[:count] = np.where(context > 0, np.minimum(run[:count] + 1, RUNS - 1), 0)
    return out


def _score_leaves(names: list[str], kind: pa.DataType, total: int, distinct: int, first: float, word_shards: int) -> Callable:
    """A leaf, first of its rows, then the answers to its questions: its texts' scores."""
    below = log10(total + 0.1 * (distinct + 1))

    def scored(row: dict, answers: dict[int, dict[int, bytes]]) -> pa.RecordBatch:
        leaf = Leaf.of(row)
        numbers, whole, without = np.zeros(len(leaf.words), np.int64), np.zeros(len(leaf.words)), np.zeros(len(leaf.words))
        for shard, own in enumerate(leaf.word_shards(word_shards)):
            if len(own):
                data = _unpacked(answers[_WORDS][shard])
                n = len(own)
                numbers[own] = np.frombuffer(data, "<i8", n)
                whole[own], without[own] = np.frombuffer(data, "<f4", n, 8 * n), np.frombuffer(data, "<f4", n, 12 * n)
        _, pair = leaf.pairs()
        followed = np.concatenate([_unpacked(answers[_PAIRS][s], "<u4") for s in sorted(answers[_PAIRS])]).astype(np.int64)[pair]
        own = np.repeat(leaf.training, leaf.sizes)
        c = numbers[leaf.ids]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        # Every text follows its beginning, and every text has an end.
        begins = np.cumsum(leaf.sizes) - leaf.sizes
        before[begins] = numbers[leaf.words.index(END)]
        known = before - own
        context = np.where(known > 0, np.maximum(followed - own, 0) / np.maximum(known, 1), 0.0)
        tokens_lm = online(context, np.where(own, without[leaf.ids], whole[leaf.ids]), known, leaf.sizes, first)
        score = np.add.reduceat(tokens_lm, begins)
        base = np.add.reduceat(np.log10(c + 0.1), begins) - leaf.sizes * below
        n_known = np.add.reduceat((c > 0).astype(np.int64), begins)
        n_bytes = np.array(row["n_bytes"], dtype=np.int64)
        columns = [
            pa.array(row["doc_ids"], kind), pa.array(row["held"], pa.bool_()), pa.array(leaf.sizes), pa.array(n_known), pa.array(np.full(len(score), total)),
            pa.array(base), pa.array(score), pa.array(-score / log10(2) / n_bytes),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        answers: dict[int, dict[int, bytes]] = {}
        for row in _rows(batches):
            if row["kind"] == 0:
                if held is not None:
                    yield scored(held, answers)
                held, answers = row, {_WORDS: {}, _PAIRS: {}}
            else:
                answers[row["kind"]][row["shard"]] = row["payload"]
        if held is not None:
            yield scored(held, answers)

    return score


def score_documents(docs: DataFrame, held_out_of: int = 10) -> DataFrame:
    """Scores of each row of ``docs(doc_id, text)``, learned from those whose id doesn't hash to 0 modulo ``held_out_of``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``: ``base_score``
    is the smoothed unigram log10 probability of the tokens, ``score`` the model's, ``bits_per_byte`` the latter
    over the bytes of the closed tokens. Null and empty texts are the end token alone; texts may have any length;
    rows that repeat are scored each, equal texts of one part alike; an empty table gives an empty result; other
    columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    context = docs.sparkSession.sparkContext
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held_out = remainder(F.col("doc_id"), held_out_of) == 0
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    make, leaf_fields = _make_leaves(kind)
    leaves = stage_table(rows.mapInArrow(make, leaf_fields), "lm-leaves")
    asked = leaves.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    word_shards = max(1, -(-(asked["words"] or 0) // WORDS_PER_SHARD))
    pair_bits = max(0, int(asked["tokens"] or 0) // PAIRS_PER_SHARD).bit_length()

    def met(questions: DataFrame, *then: str) -> DataFrame:
        return questions.repartition(partitions, "shard").sortWithinPartitions("shard", *then)

    lines = leaves.select("leaf", "held", "sizes", "ids", "words")
    pairs = stage_table(met(lines.mapInArrow(_ask_pairs(pair_bits), _ASKED)).mapInArrow(_count_pairs, _ANSWER), "lm-pairs")
    said = F.split(F.col("payload").cast("string"), " ")
    repeats = pairs.where("leaf is null").agg(*[F.sum(said[k].cast("long")).alias(n) for k, n in enumerate(("repeated", "read"))]).first()
    first = ((repeats["repeated"] or 0) + 1) / ((repeats["read"] or 0) + 2)

    questions = lines.mapInArrow(_ask_words(word_shards), _ASKED)
    words = stage_table(met(questions).mapInArrow(_count_words, _SHARD_FIELDS), "lm-words")
    sums = words.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    total, distinct = sums["tokens"] or 0, sums["distinct"] or 0
    shared = context.broadcast(train_mixer(words))
    asks = words.select("shard", "words", "numbers").unionByName(questions, allowMissingColumns=True)
    spelled = met(asks, "leaf").select("shard", "words", "numbers", "leaf", "payload").mapInArrow(_answer_words(shared), _ANSWER)

    whole = leaves.drop("n_words", "n_tokens").withColumn("kind", F.lit(0))
    answered = whole.unionByName(pairs.where("leaf is not null"), allowMissingColumns=True).unionByName(spelled, allowMissingColumns=True)
    together = answered.repartition(partitions, "leaf").sortWithinPartitions("leaf", "kind", "shard")
    return together.mapInArrow(_score_leaves(names, to_arrow_type(docs.schema["doc_id"].dataType), total, distinct, first, word_shards), fields)
