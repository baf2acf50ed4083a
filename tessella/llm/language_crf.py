"""Language ID by a linear-chain conditional random field over words.

Words are letters with the letters and marks that follow them, lower-cased. A word's score for each language sums the weights of its
affixes and character n-grams (hashed) and of the lexicons it is in, those being the frequent words of
each language in the training sample. Learned transitions tie neighbouring words together, so a word
that several languages share takes the language of its surroundings and code-switched text is labelled
piece by piece. Forward-backward gives every word's posterior over the languages; a text's language has
the largest sum, and the score is its share.

Training is bounded: at most ``PER_LANGUAGE`` different labelled rows of each language and ``SAMPLE`` in all,
those with the smallest hash of their id, each with its whole text. To learn transitions, all texts are cut into
spans of words and spans of several texts, of equal or different languages, are joined into sequences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.arrow import ragged_arange, slices
from tessella.llm.text import unit_interval

PER_LANGUAGE = 300
SAMPLE = 3000
SPAN = 8
STEPS = 60
RATE = 0.1
SHRINK = 1e-5
WIDTH = 1 << 16
LEXICON = 300
REMEMBERED = 200_000
UNDETERMINED = "und"
SLICE = 3 << 20
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def hash_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of, and word index of, every n-gram: 2 and 3 characters of ``^word$`` and 4 at its ends."""
    marked = [f"^{w}$" for w in words]
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    place = ragged_arange(lengths)
    left = lengths[owner] - place
    features, of = [], []
    value = np.zeros(len(points), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3, 4):
            shifted = np.zeros(len(points), dtype=np.uint64)
            shifted[: max(0, len(points) - n + 1)] = points[n - 1 :]
            value = value * np.uint64(0x100000001B3) + shifted + np.uint64(n)
            if n == 1:
                continue
            here = left >= n
            if n == 4:
                here &= (place == 0) | (left == n)
            mixed = value[here] * np.uint64(0x9E3779B97F4A7C15)
            features.append((mixed >> np.uint64(48)).astype(np.int64) % WIDTH)
            of.append(owner[here])
    return np.concatenate(features), np.concatenate(of)


@dataclass
class Crf:
    """Weights of a trained model; ``table`` remembers the potentials of words it has met, up to a bound."""

    languages: list[str]
    lexicon: dict[str, int]
    grams: np.ndarray
    listed: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        features, of = hash_features(words)
        n = len(self.languages)
        out = np.stack([np.bincount(of, self.grams[features, k], minlength=len(words)) for k in range(n)], axis=1)
        lists = np.fromiter((self.lexicon.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        for k in range(n):
            out[(lists >> k & 1).astype(bool)] += self.listed[k]
        return out.astype(np.float32)

    def lookup(self, texts: list[list[str]]) -> np.ndarray:
        """Row of ``table`` for each word of all texts."""
        if self.table is None or len(self.known) > REMEMBERED:
            self.known, self.table = {}, np.zeros((0, len(self.languages)), dtype=np.float32)
        new = set()
        for words in texts:
            new.update(words)
        new = list(new.difference(self.known))
        if new:
            fresh = np.concatenate([_potentials(self.word_scores(new[k : k + 50_000])) for k in range(0, len(new), 50_000)])
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, fresh])
        get = self.known.__getitem__
        return np.array([k for words in texts for k in map(get, words)], dtype=np.int64)

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text of at least one word, the posterior of each word over the languages."""
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        flat = self.table_rows(texts)
        starts = np.cumsum(lengths) - lengths
        active = np.bincount(lengths, minlength=lengths.max() + 1)[::-1].cumsum()[::-1][1:]
        offsets = np.cumsum(active) - active
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        at = offsets[ragged_arange(lengths)] + np.repeat(rank, lengths)
        local = np.empty((len(at), len(self.languages)), dtype=np.float32)
        local[at] = flat
        joint = _forward_backward(local, offsets.tolist(), active.tolist(), self.moves, self.first)
        return [joint.take(at[s : s + n], axis=0) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]

    def table_rows(self, texts: list[list[str]]) -> np.ndarray:
        at = self.lookup(texts)
        return self.table.take(at, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [words_of(t) if t else [] for t in texts]
        held = [k for k, words in enumerate(cut) if words]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if held and self.languages:
            for k, joint in zip(held, self.posteriors([cut[k] for k in held]), strict=True):
                mass = joint.mean(axis=0, dtype=np.float64)
                best = int(mass.argmax())
                out[k] = (self.languages[best], float(min(1.0, max(0.0, mass[best]))))
        return out


def _potentials(score: np.ndarray) -> np.ndarray:
    """Scores as factors, the largest of a word 1; taken once a distinct word, as there are far fewer of them than words."""
    return np.exp(score - score.max(axis=1, keepdims=True))


def _forward_backward(local: np.ndarray, offsets: list[int], active: list[int], moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posteriors of ragged sequences, given potentials laid out step by step, longest sequence first within a step."""
    ones = np.ones((local.shape[1], 1), dtype=local.dtype)  # a product with it adds up short rows faster than a sum does
    step = np.exp(moves - moves.max()).astype(np.float32)
    ahead = np.empty_like(local)
    a = local[: active[0]] * np.exp(first - first.max()).astype(np.float32)
    ahead[: active[0]] = a = a / (a @ ones)
    for o, n in zip(offsets[1:], active[1:], strict=True):
        a = (a[:n] @ step) * local[o : o + n]
        a /= a @ ones
        ahead[o : o + n] = a
    back, joint = step.T.copy(), ahead
    b = np.ones((active[-1], local.shape[1]), dtype=np.float32)
    for t in range(len(active) - 2, -1, -1):
        n, o, after = active[t], offsets[t], active[t + 1]
        b = (b * local[o + n : o + n + after]) @ back
        b /= b @ ones
        joint[o : o + after] *= b
        if n > after:
            b = np.concatenate([b, np.ones((n - after, local.shape[1]), dtype=np.float32)])
    joint /= joint @ ones
    return joint


def train(rows: list[tuple[str, str]], seed: int = 7) -> Crf:
    """Fit a model to (text, language) rows by gradient steps on the conditional likelihood."""
    languages = sorted({lang for _, lang in rows})
    n = len(languages)
    code = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    spans: list[tuple[int, list[str]]] = []
    counts = [Counter() for _ in languages]
    for text, lang in rows:
        words = words_of(text)
        counts[code[lang]].update(words)
        spans += [(code[lang], words[a : a + SPAN]) for a in range(0, len(words), SPAN)]
    lexicon: dict[str, int] = {}
    for k, own in enumerate(counts):
        for word, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[word] = lexicon.get(word, 0) | 1 << k
    model = Crf(languages, lexicon, np.zeros((WIDTH, n)), np.zeros((n, n)), np.zeros((n, n)), np.zeros(n))
    if not spans:
        return model
    # Three spans make a sequence; about half of the joints go from one language to another.
    order = rng.permutation(len(spans))
    own_order = sorted(range(len(spans)), key=lambda k: (spans[k][0], k))
    groups = [order[k : k + 3].tolist() for k in range(0, len(order), 3)] + [own_order[k : k + 3] for k in range(0, len(own_order), 3)]
    sequences = [([w for k in g for w in spans[k][1]], [spans[k][0] for k in g for _ in spans[k][1]]) for g in groups]
    sequences.sort(key=lambda s: -len(s[0]))
    lengths = np.array([len(s[0]) for s in sequences])
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for words, _ in sequences for w in words))}
    active = np.bincount(lengths, minlength=lengths.max() + 1)[::-1].cumsum()[::-1][1:]
    offsets = np.cumsum(active) - active
    at = offsets[ragged_arange(lengths)] + np.repeat(np.arange(len(lengths)), lengths)
    word = np.empty(len(at), dtype=np.int64)
    word[at] = [vocabulary[w] for words, _ in sequences for w in words]
    gold = np.empty(len(at), dtype=np.int64)
    gold[at] = [y for _, labels in sequences for y in labels]
    features, of = hash_features(list(vocabulary))
    lists = np.array([lexicon.get(w, 0) for w in vocabulary])
    member = (lists[:, None] >> np.arange(n) & 1).astype(np.float64)
    weights = [model.grams, model.listed, model.moves, model.first]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    truth = np.stack([np.bincount(word[gold == k], minlength=len(vocabulary)) for k in range(n)], axis=1)
    gold_moves, gold_first = np.zeros((n, n)), np.bincount(gold[: active[0]], minlength=n).astype(float)
    for t in range(1, len(active)):
        np.add.at(gold_moves, (gold[offsets[t - 1] : offsets[t - 1] + active[t]], gold[offsets[t] : offsets[t] + active[t]]), 1)
    steps = offsets.tolist(), active.tolist()
    for step in range(1, STEPS + 1):
        emitted = np.stack([np.bincount(of, model.grams[features, k], minlength=len(vocabulary)) for k in range(n)], axis=1) + member @ model.listed
        local = _potentials(emitted.astype(np.float32)).take(word, axis=0)
        joint, first_moves = _expectations(local, *steps, model.moves, model.first)
        error = truth - np.stack([np.bincount(word, joint[:, k], minlength=len(vocabulary)) for k in range(n)], axis=1)
        slopes = [
            np.stack([np.bincount(features, error[of, k], minlength=WIDTH) for k in range(n)], axis=1),
            member.T @ error,
            gold_moves - first_moves,
            gold_first - joint[: active[0]].sum(axis=0),
        ]
        for w, g, m, s in zip(weights, slopes, means, squares, strict=True):
            g = g / len(at) - SHRINK * w
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return model


def _expectations(local: np.ndarray, offsets: list[int], active: list[int], moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors, as precise as the potentials, and the expected number of each transition."""
    ones = np.ones((local.shape[1], 1), dtype=local.dtype)
    step = np.exp(moves).astype(local.dtype)
    ahead, behind = np.empty_like(local), np.ones_like(local)
    a = local[: active[0]] * np.exp(first).astype(local.dtype)
    ahead[: active[0]] = a = a / (a @ ones)
    for o, n in zip(offsets[1:], active[1:], strict=True):
        a = (a[:n] @ step) * local[o : o + n]
        ahead[o : o + n] = a = a / (a @ ones)
    expected = np.zeros_like(moves)
    for t in range(len(active) - 2, -1, -1):
        o, after, p = offsets[t], active[t + 1], offsets[t + 1]
        right = behind[p : p + after] * local[p : p + after]
        b = right @ step.T
        # The pair's joint posterior is ahead * step * right, each row scaled to sum to 1.
        total = (ahead[o : o + after] * b) @ ones
        expected += step * (ahead[o : o + after].T @ (right / total))
        behind[o : o + after] = b / (b @ ones)
    ahead *= behind
    ahead /= ahead @ ones
    return ahead, expected


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """The bounded sample of (text, lang) from ``docs(doc_id, text, lang)``: rows are chosen by their ids, then their texts are read."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"))
    # One row per language. The border keeps all ids that can be among the first, and few more, from being ranked together.
    ids = usable.groupBy(F.col("lang").alias("_of")).agg(F.approx_count_distinct("doc_id").alias("ids"))
    borders = ids.select("_of", ((per_language + 8 * per_language**0.5 + 32) / F.col("ids")).alias("border"))
    low = usable.join(F.broadcast(borders), F.col("lang") == F.col("_of")).where(unit_interval(F.col("doc_id")) < F.col("border"))
    # Rows that repeat are one.
    rows = low.groupBy("lang", "doc_id", "mark").agg(F.first(unit_interval(F.col("doc_id"))).alias("order"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "mark"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= per_language).orderBy("nth", "lang").limit(sample)
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("mark").alias("_mark"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("mark") == F.col("_mark"))
    found = usable.join(F.broadcast(rows), same).groupBy("lang", "doc_id", "mark").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))]


def identify_languages(docs: DataFrame, held_out_of: int = 5, model: Crf | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs(doc_id, text, lang)``.

    Rows whose id hashes to 0 modulo ``held_out_of`` are held out of training. A text that is null or has no
    letter (Unicode category L) is ``und`` with score 0, as all are if there is nothing to train on; of languages
    with equal shares the first by name is predicted. Texts of any length are read whole; rows that repeat are
    predicted each; an empty table gives an empty result; other columns are not read.
    """
    held_out = remainder(F.col("doc_id"), held_out_of) == 0
    model = model or train(training_rows(docs.where(~held_out)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            found = shared.value.predict(part.column(1).to_pylist())
            columns = [part.column(0), part.column(2), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a language, by the score at least in ``least`` of it; the others go.

    Code-switched text stays: half of it in either of two languages is enough. Null texts and texts without letters
    go; texts of any length are read whole; rows that repeat are judged each; an empty table gives an empty result.
    All columns come back as they are, whatever their names.
    """
    held_out = remainder(F.col("doc_id"), 5) == 0
    shared = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs.where(~held_out))))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, SLICE):
            found = shared.value.predict(part.column(at).to_pylist())
            yield part.filter(pa.array([p != UNDETERMINED and s >= least for p, s in found]))

    return docs.mapInArrow(keep, docs.schema)
