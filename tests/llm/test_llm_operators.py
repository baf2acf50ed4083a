"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with odd rows throughout."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import chat, exact_dedup, language_crf, line_dedup, logistic_mix, mixing, packing, piece_counts, simhash, syncmers

CLASHING = ["_id", "_lang", "_sha", "_nth", "_kept", "_size", "_copy", "_KEY", "_key_", "_copies", "_total", "_times", "_row", "_d", "anchor"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies string, row string, print double, range int"
WORDS = {
    "en": "the of and to in that was his with for thing nothing other there weather".split(),
    "de": "der die und nicht ein schön über straße haus wasser zwischen geschichte für".split(),
}


def frame(spark, rows):
    """(doc_id, text, lang, source) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, l, s, len(t or ""), 7, "x", "y", 0.5, 3) for d, t, l, s in rows], SCHEMA)


def prose(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def odd_rows(seed=1, n=60):
    rnd = random.Random(seed)
    rows = [(k, prose(rnd, rnd.choice(["en", "de"]), rnd.randrange(3, 60)), "en", f"src{k % 4}") for k in range(n)]
    rows = [(d, t, "de" if "und" in t.split() or "der" in t.split() else "en", s) for d, t, _, s in rows]
    rows += [(100, None, None, None), (101, "", "en", "src1"), (102, " \t\n ", None, "src0"), (103, "12 34 !", "en", None), (104, "é" * 50, "fr", "src2")]
    rows += [(105, rows[3][1], "en", "src0"), (106, rows[3][1].replace(" ", "\n\t "), "en", "src1"), (5, rows[5][1], rows[5][2], rows[5][3]), (107, prose(rnd, "en", 9000), "en", "src3")]
    return rows + [(None, "a null id and the weather", "en", "src0"), (None, rows[3][1], "en", "src2")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def clashing_rows(spark):
    """Rows whose other columns bear names that an operator may want for itself, with values to find again."""
    rows = [(k, t, lang, f"s{k % 2}", *[100 * k + c for c in range(len(CLASHING))]) for k, (_, t, lang, _) in enumerate(odd_rows(17, 20)[:20])]
    rows += [((1 << 63) - 1, "the weather of the last id", "en", "s1", *range(len(CLASHING)))]
    fields = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in CLASHING)
    return rows, spark.createDataFrame(rows, fields)


def test_callers_columns_come_back(spark):
    rows, docs = clashing_rows(spark)
    by_id = {r[0]: r for r in rows}
    for operator in (language_crf.keep_identified, exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, mixing.mixed_documents):
        out = operator(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert {tuple(r) for r in got} <= {by_id[r["doc_id"]] for r in got}
        assert operator is mixing.mixed_documents or len(got) == len(rows)
    for operator in (language_crf.identify_languages, exact_dedup.resolve_duplicates, simhash.near_duplicates, mixing.mix_sources, line_dedup.dedup_lines, logistic_mix.score_documents):
        assert sorted(r["doc_id"] for r in operator(docs).collect()) == sorted(by_id)
    assert {r["keep_id"] for r in exact_dedup.resolve_duplicates(docs).collect()} == set(by_id)


# 1 mixing


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, limit=2.0):
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = budget * sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in capped)
        over = sum(weight[s] for s in order if s not in capped)
        target = {s: limit * sizes[s] if s in capped else left * weight[s] / over for s in order}
        above = {s for s in order if s not in capped and target[s] > limit * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mixing_meets_targets(spark):
    rows = odd_rows(2, 300)
    out = mixing.mix_sources(frame(spark, rows), block=16).collect()
    assert len(out) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, text, _, source in rows:
        sizes[source] += len(words(text))
        largest[source] = max(largest[source], len(words(text)))
    targets = brute_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= largest[source] / 2 + 1
    again = mixing.mix_sources(frame(spark, rows[::-1]).repartition(5), block=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixed_documents_repeat_rows(spark):
    docs = frame(spark, odd_rows(3, 80))
    copies = Counter()
    for r in mixing.mix_sources(docs, block=16).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})


# 2 language


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    score, moves, first = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mass = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = math.exp(first[path[0]] + sum(score[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for t, y in enumerate(path):
            mass[t, y] += p
    wanted = mass / mass.sum(axis=1, keepdims=True)
    got = language_crf._forward_backward(language_crf._potentials(score.astype(np.float32)), [0, 1, 2, 3], [1, 1, 1, 1], moves, first)
    assert np.allclose(got, wanted, atol=1e-4)
    joint, pairs = language_crf._expectations(language_crf._potentials(score), [0, 1, 2, 3], [1, 1, 1, 1], moves, first)
    assert np.allclose(joint, wanted, atol=1e-6) and pairs.sum() == pytest.approx(3)


def test_language_of_held_out_and_switched_text(spark):
    rnd = random.Random(4)
    rows = [(1000 + k, prose(rnd, lang, 30), lang, "s") for k in range(120) for lang in [rnd.choice(["en", "de"])]] + odd_rows(5, 10)[10:]
    out = language_crf.identify_languages(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    truth = {k: lang for k, _, lang, _ in rows[:120]}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    for r in out:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (102, 103):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    model = language_crf.train([(t, lang) for _, t, lang, _ in rows[:100]])
    mixed = language_crf.words_of(prose(rnd, "en", 15) + " " + prose(rnd, "de", 15))
    labels = model.posteriors([mixed])[0].argmax(axis=1)
    assert (labels[:13] == 1).all() and (labels[17:] == 0).all()
    kept = {r["doc_id"] for r in language_crf.keep_identified(frame(spark, rows)).collect()}
    assert not kept & {101, 102, 103} and set(truth) <= kept


def test_words_are_letters_with_their_marks(spark):
    assert language_crf.words_of("½ ② Ⅷ ٣ x́y हिन्दी, l'été_2") == ["x́y", "हिन्दी", "l", "été"]
    rows = [(k, prose(random.Random(k), "en", 20), "en", "s") for k in range(1, 30)] + [(40, "½ ②", "en", "s"), (41, "\u0301", "en", "s")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_crf.identify_languages(frame(spark, rows)).collect()}
    assert got[40] == got[41] == ("und", 0) and got[1] == ("en", 1)


def test_training_rows_are_bounded_and_whole(spark):
    rows = [(k, f"text {k} " * 400, lang, "s") for k in range(50) for lang in ("en", "de")] + [(3, "text 3 " * 400, "en", "s")] * 30
    found = language_crf.training_rows(frame(spark, rows), per_language=10, sample=15)
    assert len(found) == len(set(found)) == 15 and all(len(t) >= 2800 for t, _ in found)
    assert Counter(lang for _, lang in found) == {"de": 8, "en": 7}


def brute_posterior(model, text):
    """The share of each language by enumerating all label sequences."""
    own = language_crf.words_of(text)
    emit = []
    for w in own:
        total = [0.0] * len(model.languages)
        marked = f"^{w}$"
        features = [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
        features += {0: marked[:4], len(marked) - 4: marked[-4:]}.values() if len(marked) >= 4 else []
        for gram in features:
            value = 0
            for n, point in enumerate(map(ord, gram), 1):
                value = (value * 0x100000001B3 + point + n) % (1 << 64)
            slot = (value * 0x9E3779B97F4A7C15 % (1 << 64) >> 48) % language_crf.WIDTH
            total = [t + g for t, g in zip(total, model.grams[slot], strict=True)]
        for k in range(len(model.languages)):
            if model.lexicon.get(w, 0) >> k & 1:
                total = [t + g for t, g in zip(total, model.listed[k], strict=True)]
        emit.append(total)
    mass = np.zeros(len(model.languages))
    for path in itertools.product(range(len(model.languages)), repeat=len(own)):
        s = model.first[path[0]] + sum(emit[t][y] for t, y in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))
        mass += math.exp(s) * np.bincount(path, minlength=len(mass))
    return mass / mass.sum()


def test_prediction_matches_enumeration():
    rnd = random.Random(43)
    model = language_crf.train([(prose(rnd, lang, 12), lang) for lang in ("en", "de") * 15])
    for text in ("the und", "a", "nicht straße of weather zu", "xyz the der", "in war was"):
        wanted = brute_posterior(model, text)
        lang, score = model.predict([text])[0]
        assert lang == model.languages[int(wanted.argmax())] and score == pytest.approx(wanted.max(), abs=1e-3)


# 3 exact dedup


def test_exact_dedup_matches_brute_force(spark):
    rows = odd_rows(6)
    groups = defaultdict(list)
    for d, t, _, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = exact_dedup.resolve_duplicates(frame(spark, rows), leaves=20).collect()
    assert len(out) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = Counter()
    for r in out:
        members = by_sha[r["text_sha256"]]
        ids = [m for m in members if m is not None]
        assert r["keep_id"] == (min(ids) if ids else None) and r["group_size"] == len(members)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and set(kept) == set(by_sha)
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in left.collect()) == sorted(min((m for m in v if m is not None), default=-1) for v in groups.values())


def runs_of(rows):
    """(digest, n_bytes, second, id, row) rows as a run."""
    run = np.zeros(len(rows), exact_dedup._ENTRY)
    for k, (digest, n_bytes, second, keep_id, row) in enumerate(sorted(rows, key=lambda r: r[0])):
        run[k] = (np.frombuffer(digest, ">u8"), n_bytes, second, keep_id is None, keep_id or 0, row, 1)
    return run


def test_runs_merge_in_order():
    rnd = random.Random(31)
    digest = lambda: bytes([rnd.randrange(3)]) + b"x" * 7 + bytes([rnd.randrange(4)]) * 24
    rows = [(digest(), 5, 9, rnd.choice([None, 3, -4, 8]), k) for k in range(200)]
    whole = exact_dedup.merge_runs([runs_of(rows[k::5]) for k in range(5)])
    best = {}
    for d, _, _, i, row in rows:
        best[d] = min(best.get(d, (2, 0, 0)), (i is None, i or 0, row))
    assert [bytes(e["digest"].astype(">u8").tobytes()) for e in whole] == sorted(best)
    assert [(e["unnamed"], e["keep_id"], e["keep_row"]) for e in whole] == [best[d] for d in sorted(best)]
    assert whole["n_rows"].sum() == 200


def test_merge_refuses_colliding_digests():
    one, other = ([(b"x" * 32, 5, second, 1, 1)] for second in (9, 8))
    assert exact_dedup.merge_runs([runs_of(one)] * 4)["n_rows"].tolist() == [4]
    with pytest.raises(ValueError, match="same SHA-256"):
        exact_dedup.merge_runs([runs_of(one), runs_of(other)])


# 4 token counts


def test_piece_counts_match_the_library(spark):
    rnd = random.Random(7)
    path = public_tokenizers.path(piece_counts.MODEL)
    texts = ["", " ", "   ", "a  b\n\tc ", "</s><s>[INST]<unk>", "日本　語🙂", "a▁b", "\x00\xa0", "ab" * 700, "a" * 999, " " * 300 + "x", "0123456789" * 80, None]
    texts += ["".join(rnd.choice("ab \n▁é1.<s>the") for _ in range(rnd.randrange(400))) for _ in range(150)]
    rows = [(k, t, None, None) for k, t in enumerate(texts)]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {r["doc_id"]: r for r in piece_counts.token_counts(frame(spark, rows)).collect()}
    for k, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (out[k]["n_tokens"], out[k]["n_bytes"], out[k]["over_limit"]) == (n, len((t or "").encode()), n > 4096)


# 5 syncmers


ALONE = re.compile(r"([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def brute_anchors(text):
    """(place, hash) of each closed syncmer."""
    own = [0] * 4 + [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(ALONE.sub(r" \1 ", text))]
    pairs = [brute_hash(a, b) for a, b in itertools.pairwise(own)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    inner = [[signed(x) for x in pairs[i : i + 4]] for i in range(len(own) - 4)]
    return [(i, brute_hash(pairs[i], pairs[i + 2], own[i + 4])) for i, p in enumerate(inner) if min(p) in (p[0], p[3])]


def brute_hash(*values):
    """Chained XXH64: of longs, and of an int where the last value is an int in a list."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v[0].to_bytes(4, "little") if isinstance(v, list) else v.to_bytes(8, "little"), seed)
    return seed


def brute_entries(anchors):
    at = [brute_hash(h, [p]) for p, h in anchors]
    return at, {(g, h, q - p) for (p, g), (q, h) in itertools.pairwise(anchors)}


def brute_likeness(a, b):
    shares = [2 * len(set(x) & set(y)) / (len(x) + len(y)) for x, y in zip(brute_entries(a), brute_entries(b), strict=True) if x or y]
    return max(shares, default=1.0)


def test_fingerprints_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 9)
    rnd = random.Random(8)
    rows = odd_rows(8) + [(200 + k, "".join(rnd.choice("天地玄黄宇宙洪荒日月盈昃。かなのไทยข้อ") for _ in range(80)), None, None) for k in range(6)]
    rows += [(300, rows[7][1] + " " + rows[8][1], None, None), (299, rows[8][1] + " " + rows[7][1], None, None)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    wanted = []
    for k, (d, t, _, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = map(brute_anchors, (t, edited, after))
        text = lambda s: hashlib.sha256(" ".join(str(x - (1 << 64) if x >> 63 else x) for x in brute_entries(s)[0]).encode()).hexdigest()
        wanted.append((d, len(t), edited, text(a), text(b), brute_likeness(a, b), brute_likeness(a, c)))
    got = syncmers.compare_with_edits(frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    for r in got:
        if r["doc_id"] is not None and 200 <= r["doc_id"] < 206:
            assert 0.5 < r["near_edited"] < 0.85
        if r["doc_id"] == 300:  # the next document has its halves the other way round
            assert r["near_next"] > 0.5


def test_a_lone_row_follows_itself(spark):
    out = syncmers.compare_with_edits(frame(spark, [(9, "abcdef", None, None)])).collect()
    assert [(r["edited"], r["near_next"]) for r in out] == [("abcdab", 1.0)]


# 6 chat


def test_chats_read_back(spark):
    rnd = random.Random(9)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SEP]", "[ROLE]", "[/ROLE]", "\\", "[", "<", "[\\INST]", "<\\\\s>", "x", "\n", "é", ""]
    rows = [(c, t, rnd.choice(["user", "assistant", "[/ROLE]", None]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(9))) or None) for c in range(40) for t in range(rnd.randrange(1, 7))]
    rows += [(None, None, "user", "a"), (None, 1, "assistant", None), (1, 0, rows[0][2], rows[0][3]), (1, 0, rows[0][2], rows[0][3])]
    said = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    chats = chat.format_chats(said)
    got = chats.select("conv_id", "formatted", "mask", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((-1 if t is None else t), r or "", x or ""))
    assert len(got) == len(by)
    for r in got:
        turns = sorted(by[r["conv_id"]])
        assert [tuple(t) for t in r["turns"]] == [(role, text) for _, role, text in turns]
        assert r["loss"] == "".join(text for _, role, text in turns if role == "assistant")
        assert sum(m["n_chars"] for m in r["mask"]) == len(r["formatted"])
    assert chat.format_chats(said.limit(0)).count() == 0


def test_long_conversation(spark):
    said = spark.range(20_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é [SEP] "), "id").alias("text")
    )
    began = time.time()
    chats = chat.format_chats(said)
    out = chats.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert [t["text"] for t in out["turns"]] == [f"é [SEP] {k}" for k in range(20_000)]
    assert out["loss"] == "".join(f"é [SEP] {k}" for k in range(20_000) if k % 3)
    assert time.time() - began < 30


def test_a_mask_of_another_text_is_refused(spark):
    wrong = spark.sql("select '<s>[ROLE]user[/ROLE]ab</s>' as formatted, array(struct(3L as n_chars, false as loss)) as mask")
    with pytest.raises(Exception, match="mask"):
        wrong.select(chat.loss_text(F.col("formatted"), F.col("mask"))).collect()


# 7 packing


def test_packing_is_a_partition_of_the_ids(spark):
    rows = odd_rows(10) + [(300, "a <|endoftext|> b", None, None), (301, "  x \n y ", None, None)]
    rows += [(302, "a \0first\0b", None, None), (303, "a \0whole\0b", None, None), (304, "\0whole\0b", None, None)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(frame(spark, rows), sequence=64, with_ids=True).collect()
    wanted = Counter((d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for d, t, _, _ in rows)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r["ids"]) == r["length"] <= 64
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], tuple(r["ids"]), r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in {d for d, *_ in rows}:
        ids = Counter()
        for (x, whole), n in wanted.items():
            if x == d:
                for a in range(0, len(whole), 64):
                    ids[(a, whole[a : a + 64], len(whole))] += n
        assert Counter(pieces[d]) == ids
    for spans in places.values():
        assert [a for a, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 64
    assert set(places) == set(range(len(places)))
    by_length = Counter(r["length"] for r in out)
    assert Counter(tuple(sorted((n for _, n in spans), reverse=True)) for spans in places.values()) == Counter(
        tuple(lengths) for lengths, count in packing.pack_histogram(by_length, 64) for _ in range(count)
    )
    assert len(places) * 64 < 1.1 * sum(n * len(s) for (_, s), n in wanted.items()) + 64


def test_histogram_packing_places_all():
    rnd = random.Random(11)
    counts = {n: rnd.randrange(1, 500) for n in rnd.sample(range(1, 2049), 900)}
    placed = Counter()
    for lengths, count in packing.pack_histogram(counts):
        assert sum(lengths) <= 2048 and count > 0
        for n in lengths:
            placed[n] += count
    assert placed == counts


def test_histogram_packs_like_one_piece_at_a_time():
    rnd = random.Random(41)
    assert packing.pack_histogram({1000: 1, 400: 2}, 2000) == [([1000, 400, 400], 1)]
    for _ in range(300):
        room = rnd.choice([20, 64, 100])
        counts = {n: rnd.randrange(1, 9) for n in rnd.sample(range(1, room + 1), rnd.randrange(1, 12))}
        packs = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [k for k, used in enumerate(packs) if used + n <= room]
                if fits:
                    packs[min(fits, key=packs.__getitem__)] += n
                else:
                    packs.append(n)
        assert sorted(sum(lengths) for lengths, count in packing.pack_histogram(counts, room) for _ in range(count)) == sorted(packs)


# 8 scoring


def test_scores(spark):
    rows = odd_rows(12, 95)
    out = logistic_mix.score_documents(frame(spark, rows)).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for d, t, _, _ in rows if not held(d) for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    wanted = []
    for d, t, _, _ in rows:
        own = split(t)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        wanted.append((str(d), held(d), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out]
    assert sorted(got) == sorted(wanted)
    by_id = defaultdict(set)
    for r in out:
        # Left out of its own prediction, a text of bytes found nowhere else costs more than eight bits each.
        assert r["score"] < 0 and 0 < r["bits_per_byte"] < 16
        by_id[r["doc_id"]].add(round(r["score"], 6))
    assert len(by_id[5]) == 1  # the same row twice scores the same
    easy = [r["bits_per_byte"] for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 100]
    assert sum(easy) / len(easy) < 3


def brute_scores(rows, mixer):
    """Score of each row by loops over tokens, bytes and bits; slots of the common tables are the operator's own."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts, pairs = Counter(), Counter()
    for d, t, _, _ in rows:
        if not held(d):
            counts.update(split(t))
            pairs.update(zip([None, *split(t)], split(t), strict=False))
    counts[None] = counts[b"\n"]

    def events(word):
        closed = word if word == b"\n" else word + b" "
        own = logistic_mix.Bits([word], np.ones(1))
        for place, edge in enumerate(own.edge.tolist()):
            for k in range(8):
                node = closed[place] >> (8 - k) | 1 << k
                where = [(n, int(s[8 * edge + k])) for n, s in enumerate(own.slots[:-1])]
                where.append(("deep", closed[:place], node) if place >= logistic_mix.DEEP else ("short", int(own.slots[-1][8 * edge + k])))
                yield closed[place] >> (7 - k) & 1, where

    seen = defaultdict(lambda: [0, 0])
    for w, n in counts.items():
        if w is not None:
            for bit, where in events(w):
                for x in where:
                    seen[x][bit] += n

    def spelled(word, out):
        total = 0.0
        for bit, where in events(word):
            stretched, met = [], 0
            for x in where:
                both = [max(0, n - out * (b == bit)) for b, n in enumerate(seen[x])]
                stretched.append(max(-8.0, min(8.0, math.log((both[1] + 0.4) / (both[0] + 0.4)))))
                met += both[0] != both[1]
            gate = met * 6 + sum(sum(both) > s for s in (0, 1, 3, 8, 40))
            dot = max(-8.0, min(8.0, float(np.dot(mixer.weights[gate], [*stretched, 1.0]))))
            at = (dot + 8) * 2
            low = min(int(at), 31)
            refined = mixer.refined[gate * 33 + low : gate * 33 + low + 2]
            p = (1 / (1 + math.exp(-dot)) + refined[0] * (1 - at + low) + refined[1] * (at - low)) / 2
            total += math.log10(min(1.0, max(1e-6, p if bit else 1 - p)))
        return total

    repeated, read = sum(n for n in pairs.values() if n > 1), sum(pairs.values())
    first, scores = (repeated + 1) / (read + 2), []
    for d, t, _, _ in rows:
        out, before, run, total = not held(d), None, 0, 0.0
        every, gates = [0.0, 0], defaultdict(lambda: [0.0, 0])
        for w in split(t):
            known, followed = counts[before] - out, pairs[before, w] - out
            lm = spelled(w, out)
            if known > 0:
                gate = sum(known >= s for s in (2, 4, 16, 256)), run
                share = (gates[gate][0] + 4 * (every[0] + 4 * first) / (every[1] + 4)) / (gates[gate][1] + 4)
                share = min(1 - 1e-4, max(1e-4, share))
                by_context = share * max(0, followed) / known
                both = by_context + (1 - share) * 10**lm
                total += math.log10(both)
                for own in (every, gates[gate]):
                    own[0] += by_context / both
                    own[1] += 1
            else:
                total += lm
            run = min(3, run + 1) if known > 0 and followed > 0 else 0
            before = w
        scores.append(total)
    return scores


def test_scores_match_brute_force(spark, monkeypatch):
    """Several leaves and shards, words of more than four bytes, repeated passages, odd rows."""
    rnd = random.Random(51)
    rows = odd_rows(52, 60) + [(400 + k, "weather and otherwise " * 5 + prose(rnd, "de", 30) + " nevermet" * (k == 9), None, None) for k in range(12)]
    rows = [(d, " ".join(t.split()[:300]) if d == 107 else t, x, y) for d, t, x, y in rows]
    monkeypatch.setattr(logistic_mix, "LEAF_BYTES", 3000)
    monkeypatch.setattr(logistic_mix, "WORDS_PER_SHARD", 60)
    monkeypatch.setattr(logistic_mix, "PAIRS_PER_SHARD", 500)
    kept, fit = [], logistic_mix.train_mixer
    monkeypatch.setattr(logistic_mix, "train_mixer", lambda words: kept.append(fit(words)) or kept[0])
    out = logistic_mix.score_documents(frame(spark, rows)).collect()
    wanted = brute_scores(rows, kept[0])
    key = lambda d, s: (d is None, d or 0, s)
    got = sorted(key(r["doc_id"], r["score"]) for r in out)
    for a, b in zip(got, sorted(key(r[0], s) for r, s in zip(rows, wanted, strict=True)), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-3)


def test_probabilities_of_a_token_sum_to_at_most_one(spark):
    rnd = random.Random(53)
    words_there = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 7))) for _ in range(300)} | {b"\n"})
    shard = logistic_mix.Shard(words_there, np.array([rnd.randrange(4) for _ in words_there]))
    whole, without = logistic_mix.Mixer([]).spelled(shard)
    assert 0 < np.power(10, whole).sum() <= 1 and (without <= whole + 1e-6).mean() > 0.9


def test_bits_of_equal_contexts_share_slots():
    found = logistic_mix.Bits([b"then", b"thence", b"other", b"\n"], np.array([3, 2, 1, 7]))
    assert len(found.edge) == 5 + 7 + 6 + 1 and len(found.bit) == 8 * (len(found.edge) - 4)
    assert found.per_word(np.ones(len(found.bit))).tolist() == [40, 56, 48, 8]
    assert found.weight.reshape(-1, 8)[found.edge, 0].tolist() == [5, 5, 5, 5, 3, 5, 5, 5, 5, 2, 2, 2, 1, 1, 1, 1, 1, 1, 7]
    e_of = lambda at: slice(8 * found.edge[at], 8 * found.edge[at] + 8)
    # "e" behind "th" in "then" and in "other": one context of one and two bytes, not of three.
    same = [(s[e_of(2)] == s[e_of(5 + 7 + 3)]).all() for s in found.slots]
    assert same == [True, True, False, False, False]


# 9 lines


def test_line_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "PROBES", 15)
    rnd = random.Random(13)
    pool = [prose(rnd, "en", 4) for _ in range(30)] + ["short", "ÄÖ" * 5, "x" * 9, "é" * 10]
    rows = [(k, "\n".join(rnd.choice(["", " \t", "  "]) + rnd.choice([str.upper, str])(rnd.choice(pool)) for _ in range(rnd.randrange(8))) or None, None, None) for k in range(60)]
    rows += [(200 + k, "one very common line\n" + prose(rnd, "de", 6), None, None) for k in range(60)] + [(200, "one very common line\nand another here", None, None), (None, "one very common line", None, None)]
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    top = 1 << 62
    holders = defaultdict(set)
    for d, t, _, _ in rows:
        for line in (t or "").split("\n"):
            holders[strip(line)].add(top if d is None else d)
    wanted = []
    for d, t, _, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(strip(x)) < 10 or len(holders[strip(x)]) < 2 or min(holders[strip(x)]) == (top if d is None else d)]
        wanted.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == sorted(wanted)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    high, low = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(-(1 << 62), 1 << 62, 5000)
    index = line_dedup.PerfectHash.build(high, low)
    assert sorted(index(high, low).tolist()) == list(range(5000))


# 10 simhash


def test_anchor_code_covers():
    rng = np.random.default_rng(2)
    for (_, width), code in zip(simhash.THIRDS, simhash._CODES, strict=True):
        points = rng.integers(0, 1 << width, 200)
        homes = code.home(points)
        assert (np.bitwise_count(homes ^ points) <= 1).all() and (code.syndrome[homes & 0x7FFF] == 0).all()
        index, anchors = code.reached(points)
        near = [1 << a for a in range(width)]
        for k in range(5):
            own = set(anchors[index == k].tolist())
            assert len(own) == (index == k).sum()
            for a in [0, *near]:
                assert int(code.home(np.array([int(points[k]) ^ a]))[0]) in own


def test_links_match_brute_force(spark, monkeypatch):
    rnd = random.Random(14)
    base = [rnd.getrandbits(64) for _ in range(10)]
    words64 = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4, 5, 6, 8, 10) for _ in range(3)})
    prints = np.array(words64, dtype=np.uint64).view(np.int64)
    root = list(range(len(words64)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(words64)), 2):
        if (words64[i] ^ words64[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    for large in (simhash.LARGE, 10):
        monkeypatch.setattr(simhash, "LARGE", large)
        rows = [r for b in simhash._replicate(iter([pa.RecordBatch.from_arrays([pa.array(prints)], names=["print"])])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort()
        batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows[k : k + 700]]), pa.array([p for _, p in rows[k : k + 700]])], names=["anchor", "print"]) for k in range(0, len(rows), 700)]
        got = list(range(len(words64)))
        at = {int(p): k for k, p in enumerate(prints)}

        def look(x):
            while got[x] != x:
                x = got[x]
            return x

        for b in simhash._compare(iter(batches)):
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                assert (words64[at[x]] ^ words64[at[y]]).bit_count() <= 64
                got[look(at[x])] = look(at[y])
        for i, j in itertools.combinations(range(len(words64)), 2):
            assert (find(i) == find(j)) == (look(i) == look(j))


def brute_print(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not own:
        return 0
    shingles = [" ".join(own[k : k + 4]) for k in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(15)
    rows = odd_rows(16, 40)
    for k in range(6):
        long = prose(rnd, "en", 900).split()
        for j in range(5):
            long[rnd.randrange(900)] = "changed"
            rows.append((1000 + 10 * k - j, " ".join(long).upper() if j == 2 else " ".join(long), None, None))
    prints = [(d, brute_print(t)) for d, t, _, _ in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if group[i] != group[j] and (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
                changed = True
    smallest = {g: min((d for (d, _), h in zip(prints, group, strict=True) if h == g and d is not None), default=None) for g in set(group)}
    wanted = sorted(str((d, f"{p:016x}", smallest[g])) for (d, p), g in zip(prints, group, strict=True))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == wanted
    left = [r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()]
    assert Counter(left) == Counter(smallest.values())


@pytest.mark.parametrize(
    "operator",
    [
        mixing.mix_sources, mixing.mixed_documents, language_crf.identify_languages, language_crf.keep_identified, exact_dedup.resolve_duplicates,
        exact_dedup.drop_exact_duplicates, piece_counts.token_counts, syncmers.compare_with_edits, syncmers.fingerprints, packing.pack_documents,
        logistic_mix.score_documents, line_dedup.dedup_lines, simhash.near_duplicates, simhash.drop_near_duplicates,
    ],
)
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0
