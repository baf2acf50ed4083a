"""Near-duplicates by banded SimHash and by set similarity, and their components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessella.operators.components import connected_components
from tessella.staging import stage_table

# Fixed values of the near-duplicate rule.
MIN_CHARS, MAX_BITS, RATIO_LOW, RATIO_HIGH = 80, 3, 0.8, 1.25

#: How many of the most frequent shingles a set join orders by their frequency.
COMMON = 100_000
#: Shingles that are counted at a time, and the number beyond which one is reported: the order must be one for all sets, not exact.
STRETCH, SEVERAL = 2_000_000, 2
#: Tokens of an array of texts or lists, and the row of each.
Tokens = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: Shorter texts have no shingles.
MIN_SHINGLED = 30
#: Texts are made into sets in slices of about this many bytes.
SLICE_BYTES = 2 << 20
#: Ids and tokens of a block, of which two make a tile.
TILE_ROWS, TILE_TOKENS = 512, 250_000
#: A bitmap of ids has 2 to this many slots.
SLOT_BITS = 25
#: Buckets of at most so many rows are compared at once, larger ones breadth first.
FEW = 16


def simhash_of(surface: str) -> int:
    """64 bits over word trigrams (single words of short texts); a tied bit is set.

    A feature's hash is the first eight bytes of its SHA-256.
    """
    words = surface.split()
    features = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or words or [surface]
    digests = b"".join(sha256(f.encode()).digest()[:8] for f in features)
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(-1, 64)
    packed = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 >= len(features))
    return int(packed.view(">i8")[0])


@F.pandas_udf(LongType())
def simhash(surfaces: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in surfaces:
        yield part.map(simhash_of).astype("int64")


def is_near(print_a: Column, chars_a: Column, print_b: Column, chars_b: Column) -> Column:
    """The near-duplicate rule for two prints and lengths."""
    long_enough = (chars_a >= MIN_CHARS) & (chars_b >= MIN_CHARS)
    return long_enough & (F.bit_count(print_a.bitwiseXOR(print_b)) <= MAX_BITS) & (chars_a / chars_b).between(RATIO_LOW, RATIO_HIGH)


def prints_near(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """The same rule for (print, chars) on the driver."""
    if min(a[1], b[1]) < MIN_CHARS or not RATIO_LOW <= a[1] / b[1] <= RATIO_HIGH:
        return False
    return ((a[0] ^ b[0]) & ((1 << 64) - 1)).bit_count() <= MAX_BITS


def _keyed(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows(id, print, chars)`` under each of their join keys ``band, value``."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for choice in combinations(range(blocks), blocks - MAX_BITS):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in choice)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("print").bitwiseAND(m))
    return rows.select("id", "print", "chars", F.posexplode(keys).alias("band", "value"))


def near_pairs(rows: DataFrame, blocks: int = 6) -> DataFrame:
    """Pairs ``(a, b)``, a < b, within ``MAX_BITS`` of each other, from ``rows(id, print, chars)``.

    Rows should be class representatives: equal texts are one. The word is cut into ``blocks``; two words
    that differ in 3 bits agree in all but 3 of them, so every choice of ``blocks - 3`` is a join key. Six
    blocks make 20 keys of about 32 bits, which stay selective for billions of rows; four make 4 keys of 16.
    """
    keyed = _keyed(rows.where(F.col("chars") >= MIN_CHARS), blocks)
    other = keyed.select(F.col("id").alias("id2"), F.col("print").alias("print2"), F.col("chars").alias("chars2"), "band", "value")
    ratio = F.col("chars") / F.col("chars2")
    near = (F.bit_count(F.col("print").bitwiseXOR(F.col("print2"))) <= MAX_BITS) & ratio.between(RATIO_LOW, RATIO_HIGH)
    met = keyed.join(other, ["band", "value"]).where((F.col("id") < F.col("id2")) & near)
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def _near_rows(prints: np.ndarray, chars: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ratio = chars[a] / chars[b]
    return (np.bitwise_count((prints[a] ^ prints[b]).view(np.uint64)) <= MAX_BITS) & (ratio >= RATIO_LOW) & (ratio <= RATIO_HIGH)


def _reached(prints: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket breadth first; rows that were reached are compared with no further ones."""
    free, left, right = np.arange(len(prints)), [], []
    while len(free):
        front, free = [free[0]], free[1:]
        while front and len(free):
            own = front.pop()
            hit = _near_rows(prints, chars, np.array([own]), free)
            found, free = free[hit], free[~hit]
            left.append(np.full(len(found), own))
            right.append(found)
            front.extend(found.tolist())
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets, from rows ``band, value, id, print, chars`` sorted by the first two."""

    def links(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        band, value, ids, prints, chars = (np.concatenate(c) for c in zip(*parts, strict=True))
        starts = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (value[1:] != value[:-1])]))
        sizes = np.diff(np.append(starts, len(ids)))
        # Rows of small buckets are compared with those that follow, all buckets at once.
        later = np.repeat(starts + sizes, sizes) - np.arange(len(ids)) - 1
        later[np.repeat(sizes > FEW, sizes)] = 0
        a = np.repeat(np.arange(len(ids)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        near = _near_rows(prints, chars, a, b)
        left, right = [a[near]], [b[near]]
        for k in np.flatnonzero(sizes > FEW).tolist():
            whole = slice(starts[k], starts[k] + sizes[k])
            x, y = _reached(prints[whole], chars[whole])
            left.append(x + starts[k])
            right.append(y + starts[k])
        return pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(left)]), pa.array(ids[np.concatenate(right)])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        band, value = columns[:2]
        cut = int(np.argmax((band == band[-1]) & (value == value[-1])))
        if held and (cut or held[-1][0][-1] != band[-1] or held[-1][1][-1] != value[-1]):
            yield links([*held, [c[:cut] for c in columns]])
            held, columns = [], [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield links(held)


def near_links(rows: DataFrame, blocks: int = 6) -> DataFrame:
    """Links ``(a, b)`` that connect whatever ``near_pairs`` connects, without all pairs of a group.

    Rows equal in print and length, near by rule, are linked to the smallest id of them and only that goes on. What
    shares a key of ``near_pairs`` is searched breadth first, so a dense group costs about its size and gives fewer links
    than it has rows, or ``FEW`` / 2 a row at most if it is small. A key's distinct prints and lengths meet in one task.
    """
    long_enough = rows.where(F.col("chars") >= MIN_CHARS)
    entries = stage_table(long_enough.groupBy("print", "chars").agg(F.min("id").alias("id")), "near-entries")
    copies = long_enough.select(F.col("id").alias("b"), "print", "chars").join(entries.withColumnRenamed("id", "a"), ["print", "chars"])
    dealt = _keyed(entries, blocks).select("band", "value", "id", "print", "chars").repartition("band", "value").sortWithinPartitions("band", "value")
    kind = dict(rows.dtypes)["id"]
    return dealt.mapInArrow(_bucket_links, f"a {kind}, b {kind}").unionByName(copies.where("a <> b").select("a", "b"))


def near_clusters(rows: DataFrame, links: DataFrame, order: str) -> DataFrame:
    """``(id, representative)`` for all ``rows(id, <order>)``: of each component the member with the smallest ``order``."""
    roots = connected_components(links)
    labelled = rows.join(roots, F.col("id") == F.col("node"), "left").select("id", order, F.coalesce("root", "id").alias("root"))
    best = labelled.groupBy(F.col("root").alias("of")).agg(F.min_by("id", order).alias("representative"))
    return labelled.join(best, F.col("root") == F.col("of")).select("id", "representative")


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that texts or lists of ``column`` come to about ``SLICE_BYTES``; a longer one stands alone."""
    for batch in batches:
        held = batch.column(column)
        widths = pc.multiply(pc.list_value_length(held), 8) if pa.types.is_list(held.type) else pc.binary_length(held)
        ends = np.cumsum(pc.fill_null(widths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_tokens(surfaces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of word trigrams, or of five characters of texts under three words, and the row of each.

    Texts of under ``MIN_SHINGLED`` characters have none; repeats stay.
    """
    words = pc.split_pattern(surfaces, " ")
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = pc.fill_null(pc.greater_equal(pc.utf8_length(surfaces), MIN_SHINGLED), False).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    hashes = pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False), categorize=False)[flat.indices.to_numpy()]
    sizes = np.where(kept & (counts >= 3), counts - 2, 0)
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(counts) - counts - np.cumsum(sizes) + sizes, sizes)
    tokens = _mixed(hashes[at])
    for k in (1, 2):
        tokens = _mixed(tokens * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
    owners, parts = [owner], [tokens]
    for row in np.flatnonzero(kept & (counts < 3)).tolist():
        text = surfaces[row].as_py()
        pieces = np.array([text[k : k + 5] for k in range(len(text) - 4)], dtype=object)
        owners.append(np.full(len(pieces), row))
        parts.append(pd.util.hash_array(pieces, categorize=False))
    return np.concatenate(parts).view(np.int64), np.concatenate(owners)


def list_tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lists and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def _sets(tokens: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct tokens in order, and their number."""
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])[: len(tokens)]
    return tokens[new], np.bincount(owner[new], minlength=rows)


def _frequent(batches: Iterator[pa.RecordBatch], tokens_of: Tokens) -> Iterator[pa.RecordBatch]:
    """Tokens that a stretch of them has several times, with how often."""
    held: list[np.ndarray] = []

    def rows() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens[n > SEVERAL]), pa.array(n[n > SEVERAL].astype(np.int64))], names=["token", "n"])

    for batch in _slices(batches, 0):
        held.append(tokens_of(batch.column(0))[0])
        if sum(map(len, held)) > STRETCH:
            yield rows()
            held.clear()
    if held:
        yield rows()


def _alike(batches: Iterator[pa.RecordBatch], tokens_of: Tokens, threshold: float) -> Iterator[pa.RecordBatch]:
    """Similar pairs of ``tile, id, mark, others, held`` sorted by tile: a row with ``others`` is held against these ids of its tile."""

    def compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        tile, ids, marks, others, held = (c.combine_chunks() for c in pa.Table.from_batches(parts).columns)
        flat, sizes = _sets(*tokens_of(held), len(held))
        distinct, place = np.unique(flat, return_inverse=True)
        starts, common = np.cumsum(sizes) - sizes, np.zeros(len(distinct), dtype=bool)
        keys = list(zip(tile.to_pylist(), ids.to_pylist(), marks.to_pylist(), others.to_pylist(), strict=True))
        # By dictionary, so that repeated rows count once.
        left = {(k, own, mark): row for row, (k, own, mark, asked) in enumerate(keys) if asked is not None}
        right: dict[tuple, dict[int, int]] = {}
        for row, (k, own, mark, asked) in enumerate(keys):
            if asked is None:
                right.setdefault((k, own), {})[mark] = row
        found = []
        for (k, _, _), row in left.items():
            own = place[starts[row] : starts[row] + sizes[row]]
            common[own] = True
            for other in (x for key in keys[row][3] for x in right.get((k, key), {}).values()):
                shared = int(np.count_nonzero(common[place[starts[other] : starts[other] + sizes[other]]]))
                total = int(sizes[row] + sizes[other])
                if shared / (total - shared) >= threshold:
                    found.append((row, other, shared, total))
            common[own] = False
        a, b, s, t = np.array(found, dtype=np.int64).reshape(-1, 4).T
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s), pa.array(t)], names=["a", "b", "s", "t"])

    parts: list[pa.RecordBatch] = []
    for batch in _slices(batches, 4):
        tile = batch.column(0).to_numpy()
        cut = int(np.argmax(tile == tile[-1]))
        if parts and (cut or parts[-1].column(0)[-1].as_py() != tile[-1]):
            yield compared([*parts, batch.slice(0, cut)])
            parts, batch = [], batch.slice(cut)
        parts.append(batch)
    if parts:
        yield compared(parts)


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id may be one of ``ids(id)``: all that are and, by a bitmap of bounded size, few others, dropped where they lie."""
    slot = F.xxhash64("id").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    word, bit = F.shiftright(slot, 6), F.expr("shiftleft(1L, CAST(xxhash64(id) & 63 AS INT))")
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.join(F.broadcast(bits), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def similar_pairs(rows: DataFrame, sides: DataFrame, tokens_of: Tokens, threshold: float) -> DataFrame:
    """Pairs ``(a, b, jaccard)`` of different ids, ``a`` on the left and ``b`` on the right by ``sides(id, mark, left, right)``, at or above the threshold.

    The sets are what ``tokens_of`` makes of ``rows(id, mark, held)``; rows that ``sides`` doesn't name are left out. Rows of one id and
    ``mark`` are the same; an id with several marks stands for each of them.

    Exact by prefix filtering: with all tokens in one order, two sets that similar share one of their first
    p = n - ceil(threshold n) + 1. The order puts the ``COMMON`` tokens that are most frequent in stretches of rows last,
    the rarer of them first, and all others by hash before them, so a common token meets nobody unless a set has little else. Prefixes are
    cut where a row lies; only they are dealt out to be joined. What two prefixes share is counted: the tokens behind the prefix that
    ends first add n - p at most, so few pairs are left. These are verified in tiles: ids of one smallest token are a block, cut to
    ``TILE_ROWS`` and ``TILE_TOKENS``, and a value goes once to each pair of blocks that needs it, not once to each pair. Whole sets are
    neither staged nor dealt out: they are made again from what ``rows`` holds.
    """
    kind = dict(rows.dtypes)["id"]
    known_rows = _among(rows, sides.select("id"))
    parts = known_rows.select("held").mapInArrow(lambda batches: _frequent(batches, tokens_of), "token long, n long")
    common = parts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(COMMON).toArrow()
    tokens = common.column("token").to_numpy()
    order = np.argsort(tokens, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((tokens[order], common.column("n").to_numpy()[order]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in _slices(batches, 2):
            flat, sizes = _sets(*tokens_of(batch.column(2)), batch.num_rows)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            weight = np.where(known[at] == flat, often[at], 0) if len(known) else np.zeros(len(flat), np.int64)
            ordered = np.lexsort((weight, owner))
            starts = np.cumsum(sizes) - sizes
            width = np.where(sizes > 0, sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1, 0)
            prefix = flat[ordered[np.arange(len(flat)) - starts[owner] < width[owner]]]
            some = np.flatnonzero(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width[some])]).astype(np.int32)), pa.array(prefix))
            ids, marks = (batch.column(k).take(pa.array(some)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(sizes[some]), pa.array(flat[starts[some]]), lists], names=["id", "mark", "n", "least", "prefix"])

    prefixes = known_rows.select("id", "mark", "held").mapInArrow(cut, f"id {kind}, mark long, n long, least long, prefix array<long>")
    prefixes = stage_table(prefixes.join(sides, ["id", "mark"]), "jaccard-prefixes")
    dealt = lambda side, key: prefixes.where(side).select(F.col("id").alias(key), F.col("n").alias(f"n_{key}"), F.explode("prefix").alias("token"))
    met = dealt("left", "a").join(dealt("right", "b"), "token").where("a <> b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold))
    behind = F.ceil(F.greatest("n_a", "n_b") * F.lit(threshold) - 1e-9) - 1
    enough = F.count(F.lit(1)) + behind >= (F.col("n_a") + F.col("n_b")) * F.lit(threshold / (1 + threshold)) - 1e-6
    met = stage_table(met.groupBy("a", "b", "n_a", "n_b").agg(enough.alias("enough")).where("enough").select("a", "b"), "jaccard-met")

    ends = met.select(F.col("a").alias("id")).unionAll(met.select("b")).distinct()
    ends = ends.join(prefixes.select("id", "n", "least"), "id").groupBy("id").agg(F.max("n").alias("n"), F.min("least").alias("least"))
    wide = ends.groupBy("least").agg(F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum("n") / TILE_TOKENS).alias("wide"))
    blocks = ends.join(wide, "least").select("id", F.xxhash64("least", F.pmod(F.xxhash64("id"), F.ceil("wide"))).alias("block"))
    blocks = stage_table(blocks, "jaccard-blocks")
    block = lambda key: blocks.select(F.col("id").alias(key), F.col("block").alias(f"block_{key}"))
    tiles = stage_table(met.join(block("a"), "a").join(block("b"), "b").select("a", "b", F.xxhash64("block_a", "block_b").alias("tile")), "jaccard-tiles")
    asked = tiles.groupBy("tile", F.col("a").alias("id")).agg(F.collect_set("b").alias("others"))
    asked = asked.unionByName(tiles.select("tile", F.col("b").alias("id")).distinct().withColumn("others", F.lit(None)))
    named = asked.join(prefixes.select("id", "mark", "left", "right"), "id").where("CASE WHEN others IS NULL THEN right ELSE left END")
    named = named.select("tile", "id", "mark", "others")
    placed = _among(rows, blocks.select("id")).join(named, ["id", "mark"]).select("tile", "id", "mark", "others", "held").repartition("tile").sortWithinPartitions("tile")
    alike = placed.mapInArrow(lambda batches: _alike(batches, tokens_of, threshold), f"a {kind}, b {kind}, s long, t long")
    return alike.select("a", "b", F.round(F.col("s") / (F.col("t") - F.col("s")), 6).alias("jaccard"))


def jaccard_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``left(a, shingles)`` and ``right(b, shingles)`` with Jaccard index at or above the threshold, by ``similar_pairs``."""

    def rows(given: DataFrame, key: str) -> DataFrame:
        hashed = F.transform("shingles", lambda s: F.xxhash64(s))
        return given.select(F.concat(F.lit(key), F.col(key).cast("string")).alias("id"), F.xxhash64("shingles").alias("mark"), hashed.alias("held"))

    both = stage_table(rows(left, "a").unionAll(rows(right, "b")).where("id IS NOT NULL"), "jaccard-sets")
    is_left = F.col("id").startswith("a")
    pairs = similar_pairs(both, both.select("id", "mark", is_left.alias("left"), (~is_left).alias("right")), list_tokens, threshold)
    given = lambda frame, key: F.substring(key, 2, 1 << 30).cast(dict(frame.dtypes)[key]).alias(key)
    return pairs.select(given(left, "a"), given(right, "b"), "jaccard")
