"""Token counts by rank-synchronous merging of arrays.

The symbols of many pre-tokens stand one after the other in one array with the rank of each adjacent
pair beside them. A round finds the lowest rank of every sequence, applies the leftmost pair of that
rank in all sequences at once and looks up the pairs that arose; sequences without a mergeable pair
leave. What survives is counted, a character that is no piece as its UTF-8 bytes.

A pre-token is a run of spaces with what follows up to the next one. No piece has a space behind
another character, so no merge crosses such a cut. Each distinct pre-token is merged once per worker
and remembered in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrow import slices

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
REMEMBERED = 1_000_000
#: Sequences beyond this length take every safe occurrence of their lowest pair in a round.
LONG = 256
_NONE = np.iinfo(np.int32).max


class PairTable:
    """Characters, pairs and ranks of a byte-fallback BPE model."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = [model.is_control, model.is_unknown, model.is_byte, model.is_unused]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space behind another character: pre-tokens can't be cut at spaces")
        if not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("the model has no byte pieces")
        size = model.get_piece_size()
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        ids = {p: i for p, (i, _) in pieces.items()}
        for c in sorted({c for p in pieces for c in p}):
            if c not in ids:
                ids[c] = size = size + 1
        self.unknown = size + 1  # and the three after it: characters of 1 to 4 bytes that no piece has
        self.span = size + 6
        self.weight = np.ones(self.span, dtype=np.int64)
        self.weight[self.unknown : self.unknown + 4] = (1, 2, 3, 4)
        points = np.arange(0x110000)
        self.char = (self.unknown + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
                if p not in pieces:
                    self.weight[i] = len(p.encode())
        found = sorted(
            (ids[p[:k]] * self.span + ids[p[k:]], order[s], i) for p, (i, s) in pieces.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids
        )
        self.keys = np.array([k for k, _, _ in found], dtype=np.int64)
        self.ranks = np.array([r for _, r, _ in found], dtype=np.int32)
        self.into = np.array([i for _, _, i in found], dtype=np.int32)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the rank is ``_NONE`` where there is no piece."""
        keys = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], _NONE).astype(np.int32), self.into[at]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token (none is empty)."""
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        symbols = self.char[np.frombuffer("".join(tokens).encode("utf-32-le"), dtype="<u4")]
        counts = np.zeros(len(tokens), dtype=np.int64)
        rank, into = self._all_pairs(symbols, lengths)
        of = np.arange(len(tokens))
        while len(of):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest != _NONE
            if not live.all():
                counts[of[~live]] = np.add.reduceat(self.weight[symbols], starts)[~live]
                kept = np.repeat(live, lengths)
                symbols, rank, into = symbols[kept], rank[kept], into[kept]
                of, lengths, lowest = of[live], lengths[live], lowest[live]
                if not len(of):
                    break
            symbols, rank, into, lengths = self._round(symbols, rank, into, lengths, lowest)
        return counts

    def _all_pairs(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = self.pairs(symbols, np.append(symbols[1:], 0))
        rank[np.cumsum(lengths) - 1] = _NONE
        return rank, into

    def _round(self, symbols, rank, into, lengths, lowest):
        at = np.flatnonzero(rank == np.repeat(lowest, lengths))
        ends = np.cumsum(lengths)
        owner = np.searchsorted(ends, at, side="right")
        first = np.ones(len(at), dtype=bool)
        first[1:] = owner[1:] != owner[:-1]
        if (lengths > LONG).any():
            first |= self._safe(symbols, rank, into, at, owner, first, lengths, lowest)
        at, owner = at[first], owner[first]
        symbols[at] = into[at]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        rank[at + 1] = _NONE  # of the removed symbol; carried over below
        symbols, rank, into = symbols[keep], rank[keep], into[keep]
        at = at - np.arange(len(at))
        lengths = lengths - np.bincount(owner, minlength=len(lengths))
        last = np.zeros(len(symbols), dtype=bool)
        last[np.cumsum(lengths) - 1] = True
        touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[touched], into[touched] = self.pairs(symbols[touched], symbols[np.minimum(touched + 1, len(symbols) - 1)])
        rank[touched[last[touched]]] = _NONE
        return symbols, rank, into, lengths

    def _safe(self, symbols, rank, into, at, owner, first, lengths, lowest) -> np.ndarray:
        """For long sequences, the other occurrences that may be merged in the same round.

        That is exact as long as no pair that arises on the way ranks at or below the pair being merged: then one
        occurrence after the other would be next anyway. A sequence in which one does keeps to its first.
        """
        also = np.zeros(len(at), dtype=bool)
        ends = np.cumsum(lengths)
        for k in np.flatnonzero(lengths > LONG):
            own = np.flatnonzero(owner == k)
            if len(own) < 2:
                continue
            place = at[own]
            chosen, blocked = [0], place[0] + 1
            for j in range(1, len(place)):
                if place[j] > blocked:
                    chosen.append(j)
                    blocked = place[j] + 1
            take = place[chosen]
            merged = into[take]
            begin, end = ends[k] - lengths[k], ends[k]
            right = take + 2 < end
            left = take - 1 >= begin
            follows = np.zeros(len(take), dtype=bool)
            follows[1:] = take[1:] == take[:-1] + 2
            arising = [self.pairs(merged[right], symbols[take[right] + 2])[0], self.pairs(symbols[take[left] - 1], merged[left])[0]]
            arising.append(self.pairs(merged[follows], merged[follows])[0])
            if all((r > lowest[k]).all() for r in arising):
                also[own[chosen]] = True
        return also


@lru_cache(maxsize=2)
def _table(path: str) -> PairTable:
    return PairTable(path)


_known: dict[str, int] = {}


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, each without its first space mark; the library puts one space in front."""
    text = text.replace(SPACE, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    marked = (SPACE + text).replace(" ", SPACE) if text else ""
    return [t[1:] for t in re.findall(f"{SPACE}+[^{SPACE}]*", marked)]


def count_pieces(texts: list[str], path: str) -> list[int]:
    """Number of tokens of each text."""
    if len(_known) > REMEMBERED:
        _known.clear()
    cut = [pre_tokens(t) if t else [] for t in texts]
    new = set()
    for words in cut:
        new.update(words)
    new = list(new.difference(_known))
    if new:
        _known.update(zip(new, _table(path).count([SPACE + w for w in new]).tolist(), strict=True))
    return [sum(map(_known.__getitem__, words)) for words in cut]


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text)``.

    ``model`` names a vocabulary file on every machine. Null and empty texts have no bytes and no tokens;
    rows that repeat are counted each; an empty table gives an empty result; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(model)
        for part in slices(batches, 1):
            tokens = pa.array(count_pieces(part.column(1).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), tokens], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = dict(docs.dtypes)["doc_id"]
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
