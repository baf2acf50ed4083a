"""Closed forms, invariances and fail-closed behaviour of the relational operators."""

import hashlib
import json
import random
import time
import unicodedata
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessella import staging
from tessella.functions import scalars
from tessella.operators import aggregates, canonical, components, decode, dedup, enrich, evaluation, lexical, near_dup, ranks, ratio, sampling, series, triage
from tessella.plans import duplicates, samples
from tessella.sources import records, sinks
from tessella.streaming import ingest


def test_one_cluster_has_no_error_and_weightless_groups_no_score(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 1.0, 0.0), ("a", 1, 1.0, 0.0, 0.5), ("b", 2, 0.0, 1.0, 0.0)], "segment string, cluster int, weight double, positive double, negative double")
    out = {r["segment"]: r for r in ratio.ratio_estimate(rows, ["segment"]).collect()}
    assert (out["a"]["score"], out["a"]["standard_error"]) == (0.25, 0.0)
    assert out["b"]["score"] is None


def test_unknown_grouping_is_refused(spark):
    with pytest.raises(ValueError, match="grouping"):
        ratio.ratio_estimate(spark.range(1), ["password"])


def test_decomposition_closes(spark):
    cells = spark.createDataFrame([(2020, "x", 1.0, 0.0), (2020, "y", 1.0, 0.4), (2021, "x", 1.0, 0.2), (2021, "y", 3.0, 0.8)], "year int, k string, weight double, score double")
    total = series.decomposition(series.contributions(cells, "year", ["k"], 2020, 2021)).first()
    assert total["change"] == pytest.approx(0.65 - 0.2)
    assert total["within"] + total["composition"] == pytest.approx(total["change"])


def test_trend_of_a_line(spark):
    rows = spark.createDataFrame([("2020-01", 0.0), ("2020-02", 1.0), ("2020-03", 2.0)], "month string, v double")
    out = series.linear_trend(rows, "month", "v").first()
    assert (out["slope_per_month"], out["slope_per_year"], out["r_squared"]) == (pytest.approx(1), pytest.approx(12), pytest.approx(1))


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    for x in nodes:
        for y in nodes:
            assert (got[x] == got[y]) == (find(x) == find(y))


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_pairs_match_brute_force(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(12)]
    words = base + [b ^ sum(1 << x for x in rnd.sample(range(64), k)) for b in base for k in (1, 2, 3, 4)]
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    rows = [(i, w, rnd.choice([70, 100, 110, 200])) for i, w in enumerate(signed)]
    brute = {
        (a[0], b[0])
        for a in rows
        for b in rows
        if a[0] < b[0] and min(a[2], b[2]) >= 80 and 0.8 <= a[2] / b[2] <= 1.25 and ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() <= 3
    }
    for blocks in (4, 6):
        got = near_dup.near_pairs(spark.createDataFrame(rows, "id long, print long, chars int"), blocks)
        assert {(r["a"], r["b"]) for r in got.collect()} == brute and brute


def test_near_links_connect_what_pairs_connect(spark):
    """Dense and sparse groups, equal prints of equal and different lengths, buckets over several batches."""
    rnd = random.Random(6)
    words = [rnd.getrandbits(64) for _ in range(20)]
    words += [words[0] ^ sum(1 << x for x in rnd.sample(range(12), rnd.randrange(4))) for _ in range(150)]
    words += [w ^ sum(1 << x for x in rnd.sample(range(64), k)) for w in words[1:20] for k in (0, 2, 4)] + [words[5]] * 60
    rows = [(i * 7, w - (1 << 64) if w >> 63 else w, rnd.choice([70, 90, 100, 115, 200, 320])) for i, w in enumerate(words)]
    near = lambda a, b: near_dup.prints_near((a[1], a[2]), (b[1], b[2]))
    graph = {a[0]: {b[0] for b in rows if a[0] != b[0] and near(a, b)} for a in rows}

    def groups(links):
        seen, out = set(), set()
        for start in links:
            if start not in seen:
                group, front = {start}, [start]
                while front:
                    new = links[front.pop()] - group
                    group |= new
                    front += new
                seen |= group
                out.add(frozenset(group))
        return out

    frame = spark.createDataFrame(rows, "id long, print long, chars int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for blocks in (4, 6):
                got = {k: set() for k in graph}
                found = near_dup.near_links(frame, blocks).collect()
                for r in found:
                    assert r["b"] in graph[r["a"]]
                    got[r["a"]].add(r["b"])
                    got[r["b"]].add(r["a"])
                assert groups(got) == groups(graph) and max(map(len, groups(got))) > 16
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert near_dup.near_links(frame.limit(0)).count() == 0


def test_jaccard_matches_brute_force(spark):
    rnd = random.Random(2)
    base = [[str(rnd.randrange(30)) for _ in range(20)] for _ in range(5)]
    sets = [b[:k] + [f"n{i}" for i in range(20 - k)] for b in base for k in (20, 19, 18, 10)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "a long, shingles array<string>")
    brute = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}
    got = near_dup.jaccard_pairs(rows, rows.withColumnRenamed("a", "b"), 0.8)
    assert {(r["a"], r["b"]) for r in got.collect()} == brute


def test_case_folding_is_full(spark):
    points = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]  # the JVM may know newer letters
    rows = spark.createDataFrame([(c,) for c in [*points, "Straße ΟΔΟΣ ﬁn", "", None]], "s string")
    for r in rows.select("s", scalars.casefolded(F.col("s")).alias("got")).collect():
        if r["s"] is None:
            assert r["got"] is None
        elif r["s"] != "\u0131":
            assert r["got"] == scalars.fold_phrase(r["s"]), hex(ord(r["s"][0]))


def test_compatible_surface(spark):
    texts = ["Ｆｕｌｌ  ｗｉｄｔｈ", "ﬁ ① x²", " plain\tASCII ", "e\u0301\u00a0Ä", "", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string").orderBy("k").select(scalars.folded_surface(F.col("s"))).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts]


def test_terms_match_folded_text(spark):
    rows = spark.createDataFrame([(1, "Die STRASSE"), (2, "die Straße"), (3, "die Strase")], "id long, text string")
    for term in ("Straße", "strasse"):
        terms = [lexical.Term("s", term)]
        for out in (lexical.hits(rows, "text", terms, full=True), lexical.hits_by_automaton(rows, "id", "text", terms, full=True)):
            assert [r["term_ids"] for r in out.orderBy("id").collect()] == [["s"], ["s"], []]


def test_lexical_edges(spark):
    terms = [lexical.Term("it", "it is"), lexical.Term("us", "us", ("contact us",)), lexical.Term("zh", "zh")]
    texts = ["It \n IS", "it_is it is9", "contact us", "contact us or us", "你zh好", None, "", "İT is"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expected = [["it"], [], [], ["us"], ["zh"], [], [], ["it"]]
    fast = {r["id"]: r["term_ids"] for r in lexical.hits(rows, "text", terms).collect()}
    slow = {r["id"]: r["term_ids"] for r in lexical.hits_by_automaton(rows, "id", "text", terms).collect()}
    assert [fast[i] or [] for i in range(len(texts))] == expected
    assert [slow[i] for i in range(len(texts))] == expected


def test_quotas_conserve_and_respect_populations(spark):
    rnd = random.Random(3)
    strata = spark.createDataFrame([(f"s{i}", rnd.randrange(1, 60)) for i in range(12)], "stratum string, population long")
    for total, minimum in ((12, 1), (40, 2), (100, 0)):
        out = sampling.largest_remainder(strata, total, minimum).collect()
        assert sum(r["quota"] for r in out) == total
        assert all(min(minimum, r["population"]) <= r["quota"] <= r["population"] for r in out)


def test_ranks_and_positions_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 1000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("d"), (F.col("id") % 3).alias("g"))
    one = sorted(ranks.hash_rank(rows.repartition(1), ["g"], "d", "k").collect())
    assert one == sorted(ranks.hash_rank(rows.repartition(7), ["g"], "d", "k").collect())
    placed = [r["k"] for r in sorted(ranks.positions(rows, "k", 16).collect(), key=lambda r: r["position"])]
    assert placed == sorted(placed) and len(placed) == 500


def test_exposed_row_falls_back_to_the_next(spark):
    rows = spark.createDataFrame([(1, "t", "a"), (2, "t", "b")], "id long, thread string, order string")
    used = spark.createDataFrame([(1,), (None,)], "id long")
    left = dedup.drop_consumed(rows, [(used, "id", "id")])
    assert [r["id"] for r in dedup.representative(left, "thread", "order", "id").collect()] == [2]


def test_abstention_counts_as_a_miss(spark):
    rows = spark.createDataFrame([(True, True), (True, None), (False, None), (False, False)], "r boolean, p boolean")
    out = evaluation.binary_metrics(rows, "r", "p").first()
    assert (out["tp"], out["fn"], out["tn"], out["abstained"], out["accuracy"], out["recall"]) == (1, 1, 1, 2, 0.5, 0.5)


def test_softmax_and_ties(spark):
    row = spark.range(1).select(
        scalars.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"), scalars.first_argmax(F.array(F.lit(0.5), F.lit(0.5))).alias("k"), scalars.binary_entropy(F.lit(0.5)).alias("h")
    ).first()
    assert (row["s"], row["k"], row["h"]) == ([0.5, 0.5], 0, pytest.approx(1))


def test_head_tail_is_exact(spark):
    text = "ab😀" * 100
    cut = spark.createDataFrame([(text,)], "t string").select(scalars.head_tail(F.col("t"), 50, "[...]").alias("c")).first()["c"]
    assert len(cut) == 50 and cut == text[:23] + "[...]" + text[-22:]


def test_checks_fail_closed(spark):
    rows = spark.range(3)
    decode.require(rows, {"fine": F.col("id") >= 0})
    with pytest.raises(ValueError, match="odd"):
        decode.require(rows, {"odd": F.col("id") < 2})
    with pytest.raises(ValueError, match="private"):
        triage.assert_public(rows.select(F.struct(F.col("id").alias("author")).alias("x")))


def test_integrity_does_not_depend_on_the_order_of_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "x")], "k int, v string")
    lookup = spark.createDataFrame([(1, "x"), (1, "a"), (2, "y")], "id int, w string")
    for own in (lookup.coalesce(1), lookup.orderBy("w").coalesce(1)):
        assert tuple(enrich.integrity(rows, own, "k", "id", F.col("v") == F.col("_w")).first()) == (4, 1, 2, 1, 1)


def test_staged_tables_go(spark):
    kept = staging.stage_table(spark.range(5), "kept")
    folder = Path(staging.staging_root(spark).removeprefix("file://"))
    names = lambda: {p.name.split("-")[0] for p in folder.iterdir()}

    def made():
        inner = staging.stage_table(kept, "inner")
        return inner.join(staging.stage_result(lambda: staging.stage_table(inner, "deeper"), "deep"), "id")

    out = staging.stage_result(made, "whole")
    assert out.count() == 5 and {"kept", "whole"} <= names() and not names() & {"inner", "deep", "deeper"}
    staging.unstage(out, kept, spark.range(1))
    assert not names() & {"kept", "whole"}


def test_unchanged_counts_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    assert tuple(enrich.unchanged(a, b, ["k", "v"]).first()) == (1, 1)


def test_json_lines_keep_malformed_rows(spark, tmp_path):
    lines = [json.dumps({"id": "a1", "created_utc": 1600000000, "subreddit": "Pics", "body": "  hello\r\nworld "}), "[1]", "{broken", "", json.dumps({"id": "b2", "created_utc": True, "body": "[deleted]"})]
    (tmp_path / "pics_comments.jsonl").write_text("\n".join(lines))
    rows = records.read_json_lines(spark, str(tmp_path))
    assert rows.where("malformed").count() == 2 and rows.count() == 4
    raw = rows.select(
        F.col("id").alias("record_id"), F.col("created_utc").alias("created"), F.col("subreddit").alias("community"), canonical.community_of(F.col("file")).alias("expected_community"),
        F.lit("main").alias("stratum"), canonical.kind_of(F.col("file")).alias("kind"), "title", "body", "malformed", "file",
    )
    reasons = {r["reason"]: r["n"] for r in canonical.reason_counts(raw).collect()}
    assert reasons == {"retained": 1, "malformed_json": 2, "community_mismatch": 1}
    kept = canonical.with_reasons(raw).where("reason IS NULL").first()
    assert (kept["record"], kept["text"]) == ("t1_a1", "hello\nworld")
    judged = canonical.with_reasons(raw).select("record_id", "file", "kind", "reason")
    sinks.write_split(judged, str(tmp_path / "kept"), str(tmp_path / "_rejects"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() + spark.read.parquet(str(tmp_path / "_rejects")).count() == 4


def test_manifest_is_checked(spark, tmp_path):
    entry = {"name": "a_comments.zst", "bytes": 5, "sha256": "0" * 64}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"total_bytes": 5, "files": [entry]}))
    assert records.read_manifest(spark, str(path), 1).count() == 1
    path.write_text(json.dumps({"total_bytes": 6, "files": [entry]}))
    with pytest.raises(ValueError, match="total"):
        records.read_manifest(spark, str(path))


def test_partitioned_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2020, "a"), (2, 2021, "b"), (3, 2021, "b")], "id int, year int, kind string")
    sinks.write_partitioned(rows, str(tmp_path / "t"), ["year", "kind"])
    back = records.read_partitioned(spark, str(tmp_path / "t"), rows.schema, ["year", "kind"])
    assert sorted(map(tuple, back.select("id", "year", "kind").collect())) == sorted(map(tuple, rows.collect()))
    assert any((tmp_path / "t").glob("year=2021/kind=b/*.parquet"))


RAW_ROW = "record_id string, created string, community string, expected_community string, stratum string, kind string, title string, body string, malformed boolean, link_id string, parent_id string, file string"


def raw_row(**other):
    base = dict(
        record_id="A1", created="1600000000", community=" Pics ", expected_community=" pics ", stratum="main", kind="comment", title=None, body=" hello\r\nworld ", malformed=False,
        link_id="T3_zz", parent_id=" b2 ", file="/landed/pics_comments.zst",
    )
    return tuple((base | other).values())


def test_canonical_record_has_every_column(spark):
    rows = [raw_row(), raw_row(record_id="s1", kind="submission", title="[removed]", body="text", link_id=None, parent_id=None, file="x/pics_submissions.zst"), raw_row(parent_id="t3_zz")]
    out = canonical.canonical(spark.createDataFrame(rows, RAW_ROW))
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == list(canonical.RECORD)
    got = {(r["record_id"], r["parent_id"]): r for r in out.collect()}
    comment, submission = got["t1_a1", "t1_b2"], got["t3_s1", None]
    assert (comment["submission_id"], comment["subreddit"], comment["text"], comment["source_file"]) == ("t3_zz", "Pics", "hello\nworld", "pics_comments.zst")
    assert (submission["submission_id"], submission["content_type"], submission["text"], submission["year"], submission["month"]) == ("t3_s1", "submission", "text", 2020, 9)
    assert ("t1_a1", "t3_zz") in got and comment["schema_version"] == "1.0.2" and comment["text_sha256"] == hashlib.sha256(b"hello\nworld").hexdigest()


def test_contradictory_ids_are_excluded(spark):
    rows = [raw_row(link_id="t1_zz"), raw_row(parent_id="t5_zz"), raw_row(record_id="t3_a1"), raw_row(parent_id=None), raw_row(link_id="no/id"), raw_row(body="[deleted]", parent_id=None)]
    out = canonical.with_reasons(spark.createDataFrame(rows, RAW_ROW)).select("reason").collect()
    assert [r["reason"] for r in out] == ["invalid_id"] * 5 + ["deleted"]


def test_sentinel_list_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("[deleted]", "a"), ("[deleted] ", "a"), ("x", "b")], "text string, source string").write.parquet(str(tmp_path / "t"))
    out = canonical.sentinel_counts(spark.read.parquet(str(tmp_path / "t")), "text", ["[deleted]", "[removed]"], "source")
    assert [tuple(r) for r in out.collect()] == [("a", "[deleted]", 1)]
    assert "PushedFilters: [In(text, [[deleted],[removed]])]" in out._jdf.queryExecution().toString()


def test_landed_files_are_verified(spark, tmp_path):
    (tmp_path / "in").mkdir()
    whole = {"a_comments.zst": b"x" * 20_000_000, "b_comments.zst": b"two", "c_comments.zst": b"new"}
    for name, data in whole.items():
        (tmp_path / "in" / name).write_bytes(data)
    manifest = [("a_comments.zst", 20_000_000, hashlib.sha256(whole["a_comments.zst"]).hexdigest()), ("b_comments.zst", 3, "0" * 64), ("d_comments.zst", 1, "0" * 64)]
    out = records.verify_files(spark, str(tmp_path / "in"), spark.createDataFrame(manifest, "name string, bytes long, sha256 string"))
    assert {r["name"][0]: r["status"] for r in out.collect()} == {"a": "ok", "b": "differs", "c": "unexpected", "d": "missing"}


def test_publish_is_all_or_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(k, 2020 + k % 2, "a b" if k % 3 else "c") for k in range(30)], "id int, year int, kind string")
    path = str(tmp_path / "table")
    with pytest.raises(ValueError, match="30 rows were written, not 31"):
        sinks.publish(rows, path, ["year", "kind"], 31)
    assert list(tmp_path.iterdir()) == []
    receipt = sinks.publish(rows, path, ["year", "kind"], 30, {"source": "s"})
    assert receipt == sinks.verify_published(spark, path) and receipt["rows"] == 30 and len(receipt["files"]) >= 4
    for f in receipt["files"]:
        data = (tmp_path / "table" / f["name"]).read_bytes()
        assert (f["bytes"], f["sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    with pytest.raises(ValueError, match="before"):
        sinks.publish(rows, path, ["year", "kind"], 30)
    with pytest.raises(ValueError, match="must not"):
        sinks.verify_published(spark, path, ["kind"])
    victim = tmp_path / "table" / receipt["files"][0]["name"]
    victim.write_bytes(victim.read_bytes() + b"0")
    (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="differ from the receipt"):
        sinks.verify_published(spark, path)


def test_export_keeps_the_predecessor(spark, tmp_path):
    before = spark.createDataFrame([(1, "x"), (2, "y")], "id int, state string")
    after = before.withColumn("score", F.lit(0.5))
    assert sinks.export_public(after, str(tmp_path / "a"), before)["columns"] == ["id", "state", "score"]
    with pytest.raises(ValueError, match="1 rows of the predecessor are gone and 1 are new"):
        sinks.export_public(after.withColumn("state", F.lit("x")), str(tmp_path / "b"), before)
    with pytest.raises(ValueError, match="private"):
        sinks.write_public(after.withColumn("author", F.lit("z")), str(tmp_path / "c"))


def test_small_sinks_and_shards(spark, tmp_path):
    rows = spark.range(23).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    sinks.write_csv(rows, str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_text().splitlines()[0] == "k,v" and len(part.read_text().splitlines()) == 24
    sinks.write_sorted(rows.repartition(5), str(tmp_path / "sorted"), "k")
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "sorted")).where("k between 5 and 9").orderBy("k").collect()] == [5, 6, 7, 8, 9]
    sinks.write_shards(rows.repartition(4), str(tmp_path / "shards"), "k", 4)
    back = spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").agg(F.count("k").alias("n"), F.min("position").alias("a"), F.max("k").alias("b")).orderBy("shard").collect()
    assert [tuple(r) for r in back] == [(0, 6, 0, 5), (1, 6, 6, 11), (2, 6, 12, 17), (3, 5, 18, 22)]


def test_policies_and_sheets(spark, tmp_path):
    policy = {"version": "1", "terms": [{"id": "us", "pattern": "us"}, {"id": "it", "pattern": "it is"}], "ambiguity_rules": [{"term_ids": ["us"], "phrases": ["contact us"]}], "record_exclusion_rules": [{"texts": ["bot"]}]}
    lines = ['version = "1"', f'digest = "{records.policy_digest(policy | {"digest": ""}, "digest")}"', "[[terms]]", 'id = "us"', 'pattern = "us"', "[[terms]]", 'id = "it"', 'pattern = "it is"']
    lines += ["[[ambiguity_rules]]", 'term_ids = ["us"]', 'phrases = ["contact us"]', "[[record_exclusion_rules]]", 'texts = ["bot"]']
    (tmp_path / "p.toml").write_text("\n".join(lines))
    keys = ["version", "digest", "terms", "ambiguity_rules", "record_exclusion_rules"]
    read = records.read_policy(spark, str(tmp_path / "p.toml"), keys, "digest")
    terms, excluded = records.policy_terms(read)
    assert terms == [lexical.Term("us", "us", ("contact us",)), lexical.Term("it", "it is")] and excluded == ["bot"]
    with pytest.raises(ValueError, match="keys"):
        records.read_policy(spark, str(tmp_path / "p.toml"), keys[1:])
    (tmp_path / "p.toml").write_text("\n".join(lines).replace("contact us", "call us"))
    with pytest.raises(ValueError, match="digest"):
        records.read_policy(spark, str(tmp_path / "p.toml"), keys, "digest")
    (tmp_path / "s.csv").write_text('a,b\n1,"x\ny"\n , \n,2\n')
    assert [tuple(r) for r in records.read_sheet(spark, str(tmp_path / "s.csv"), ["a", "b"]).collect()] == [("1", "x\ny"), (None, "2")]
    with pytest.raises(ValueError, match="header"):
        records.read_sheet(spark, str(tmp_path / "s.csv"), ["a", "c"])


def test_annotations_are_validated_by_schema(spark, tmp_path):
    schema = {
        "required": ["id", "label"], "additionalProperties": False,
        "properties": {"id": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2}, "label": {"enum": ["x", "y"]}, "score": {"type": ["number", "null"], "minimum": 0, "maximum": 1}, "v": {"const": 1}, "n": {"type": "integer"}},
    }
    good = [{"id": "ab", "label": "x"}, {"id": "ab", "label": "y", "score": None, "v": 1, "n": -3}, {"label": "y", "id": "abc", "score": 0.5}]
    bad = ["", "[1]", "{broken", '{"id": "ab"}', '{"id": "A", "label": "z"}', '{"id": 5, "label": "x", "score": 2}', '{"id": "ab", "label": "x", "more": 1, "n": 1.5, "v": 2}', '{"id": null, "label": "x", "score": "0.5"}']
    (tmp_path / "good.jsonl").write_text("\n".join(map(json.dumps, good)) + "\n")
    (tmp_path / "bad.jsonl").write_text("\n".join([json.dumps(good[0]), *bad]) + "\n")
    (tmp_path / "none.jsonl").write_text("")
    got = {}
    for r in records.validate_json_lines(spark, str(tmp_path), schema).collect():
        got.setdefault((r["file"], r["line"]), set()).add(r["problem"])
    wanted = [{"blank"}, {"malformed"}, {"malformed"}, {"label: required"}, {"id: pattern", "id: minLength", "label: enum"}, {"id: type", "score: maximum"}, {"not allowed: more", "n: type", "v: const"}, {"id: type", "score: type"}]
    assert got == {("bad.jsonl", k + 2): w for k, w in enumerate(wanted)} | {("none.jsonl", 1): {"empty"}}
    with pytest.raises(ValueError, match="not checked"):
        records.validate_json_lines(spark, str(tmp_path), {"properties": {"a": {"format": "date"}}})


def test_wire_schema_and_unsigned_numbers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    schema = StructType([StructField("id", LongType(), False), StructField("s", StringType(), True)])
    assert records.wire(rows, schema).schema == schema and records.wire(rows, schema).count() == 2
    with pytest.raises(Exception, match="nulls in non-null columns"):
        records.wire(rows, StructType([schema[0], StructField("s", StringType(), False)])).collect()
    big = spark.createDataFrame([(str((1 << 64) - 1),), (str(1 << 63),), ("5",), (None,)], "u string").select(F.col("u").cast("decimal(20,0)").alias("u"))
    both = big.select("u", records.signed(F.col("u")).alias("i")).select("u", "i", records.unsigned(F.col("i")).alias("back")).collect()
    assert [r["i"] for r in both] == [-1, -(1 << 63), 5, None] and all(r["u"] == r["back"] for r in both)


def test_views_and_ingest_rate(spark, tmp_path):
    spark.sql("select 1 as id, timestamp'2020-03-31 23:59:59' as created_utc").write.parquet(str(tmp_path / "y=1"))
    spark.sql("select 2 as id, timestamp'2021-01-01 00:00:00' as created_utc").write.parquet(str(tmp_path / "y=2"))
    records.parquet_view(spark, str(tmp_path / "y=*"), "landed")
    records.register_rows(spark, "wanted", [(1, "one")], "id int, name string")
    records.register_rows(spark, "arrow_rows", pa.table({"id": [2], "name": ["two"]}))
    out = spark.sql("select month, name from landed join (select * from wanted union all select * from arrow_rows) using (id) order by month")
    assert [tuple(r) for r in out.collect()] == [("2020-03-01", "one"), ("2021-01-01", "two")]
    rate = records.ingest_rate(spark.createDataFrame([raw_row()] * 50, RAW_ROW), canonical.canonical, 20)
    assert rate["lines"] == 20 and rate["lines_per_second"] > 0


def test_windows_close_behind_the_watermark(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    made = lambda rows: spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    made([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 5.0)]).write.parquet(str(tmp_path / "in"))
    stream = ingest.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    run = lambda: ingest.windowed_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("append").start().awaitTermination(60)
    run()
    made([("2024-01-01 00:20:00", "a", 9.0), ("2024-01-01 03:20:00", "b", 1.0)]).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.hour("w.start").alias("h"), "event_type", "n", "value").collect()
    # What comes 2 hours and 40 minutes late is left out of a window that has closed.
    assert [tuple(r) for r in got] == [(0, "a", 2, 3.0)]


def test_bootstrap_interval_brackets_the_mean(spark):
    rnd = random.Random(8)
    values = [rnd.choice([-1.0, 0.0, 0.0, 1.0, 1.0]) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    out = evaluation.bootstrap_interval(rows, "v", 2000, "s").first()
    apart = evaluation.bootstrap_interval(rows, "v", 2000, "s", chunk=1).first()
    assert apart["low"] == pytest.approx(out["low"], abs=0.05) and apart["high"] == pytest.approx(out["high"], abs=0.05)
    mean = sum(values) / 80
    error = (sum((v - mean) ** 2 for v in values) / 80) ** 0.5 / 80**0.5
    assert out["observed"] == pytest.approx(mean, abs=1e-6) and out["replicates"] == 2000 and out["middle"] == pytest.approx(mean, abs=0.02)
    assert out["low"] == pytest.approx(mean - 1.96 * error, abs=0.05) and out["high"] == pytest.approx(mean + 1.96 * error, abs=0.05)


def test_greedy_buckets_match_the_loop(spark):
    rnd = random.Random(9)
    pool = [(k, rnd.randrange(12), float(rnd.randrange(6)), float(rnd.randrange(6))) for k in range(60)]
    buckets = [("one", "x", 4), ("two", "y", 3), ("three", "x", 9)]
    taken, wanted = set(), []
    for name, column, quota in buckets:
        at, n = {"x": 2, "y": 3}[column], 0
        for place, r in enumerate(sorted(pool, key=lambda r: (-r[at], r[0])), 1):
            if n < quota and r[1] not in taken:
                taken.add(r[1])
                n += 1
                wanted.append((r[0], r[1], name, r[at], place))
    out = sampling.greedy_buckets(spark.createDataFrame(pool, "k int, c int, x double, y double"), buckets, "k", "c")
    assert [tuple(r) for r in out.collect()] == wanted


def test_long_sequences_are_digested_in_rounds(spark):
    rows = spark.range(2500).select(F.col("id").alias("p"), F.concat(F.lit("v"), "id").alias("v"))
    level = [f"v{k}" for k in range(2500)]
    while len(level) > 1:
        level = [hashlib.sha256(",".join(level[k : k + 10]).encode()).hexdigest() for k in range(0, len(level), 10)]
    out = aggregates.sequence_digest(rows.repartition(7), "p", "v", 10).first()
    assert (out["chunks"], out["digest"]) == (250, level[0])


def test_digests_of_chunks_meet_in_one_digest(spark):
    values = [None if 40 <= k < 60 or k == 7 else f"v{k}" for k in range(2500)]
    sha = lambda found: hashlib.sha256(",".join(found).encode()).hexdigest()
    chunks = [[v for v in values[k : k + 10] if v] for k in range(0, 2500, 10)]
    rows = spark.createDataFrame(list(enumerate(values)), "p long, v string").repartition(7)
    assert tuple(aggregates.two_level_digest(rows, "p", "v", 10).first()) == (250, sha([sha(c) for c in chunks if c]))
    assert tuple(aggregates.two_level_digest(rows.where("v IS NULL AND p >= 50 AND p < 60"), "p", "v", 10).first()) == (1, None)
    assert tuple(aggregates.two_level_digest(rows.where("p < 0"), "p", "v", 10).first()) == (0, None)


def test_receipts_conserve(spark):
    rows = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x"), ("b", "y")], "file string, reason string")
    receipts = sinks.receipt(rows, "file")
    assert {r["file"]: (r["physical"], r["retained"], r["excluded"], r["reasons"]) for r in receipts.collect()} == {"a": (2, 1, 1, {"x": 1}), "b": (2, 0, 2, {"x": 1, "y": 1})}
    total = sinks.rollup_receipts(receipts.withColumn("s", F.lit(1)), ["s"]).first()
    assert (total["sources"], total["physical"], total["reasons"]) == (2, 4, {"x": 2, "y": 1})


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.createDataFrame(
        [("a", "1600000000", "p", "p", "m", "comment", None, "hi", False), ("b", "true", "p", "p", "m", "comment", None, "hi", False)],
        "record_id string, created string, community string, expected_community string, stratum string, kind string, title string, body string, malformed boolean",
    )
    raw.write.parquet(str(tmp_path / "in"))
    stream = ingest.event_stream(spark, str(tmp_path / "in"), raw.schema)
    for _ in range(2):  # the second run finds nothing new
        ingest.canonical_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("record", "reason").collect()), key=str)
    assert got == sorted(map(tuple, canonical.with_reasons(raw).select("record", "reason").collect()), key=str)


def test_folds_are_balanced():
    rows = [(k, frozenset(["a"] if k % 2 else ["b"])) for k in range(100)]
    folds = sampling.stratified_folds(rows, 5)
    sizes = [sum(f == k for f in folds.values()) for k in range(5)]
    assert sizes == [20] * 5
    assert all(sum(folds[k] == f for k in range(1, 100, 2)) == 10 for f in range(5))


def test_every_labelled_row_gets_a_fold(spark, tmp_path):
    labels = spark.range(12_007).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("long").alias("quality"), (F.col("id") % 50 == 0).cast("long").alias("toxic"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = samples.f18_folds(spark, str(tmp_path)).join(labels, "doc_id").collect()
    assert len({r["doc_id"] for r in out}) == len(out) == 12_007
    for of in (lambda r: True, lambda r: r["quality"], lambda r: r["toxic"]):
        sizes = Counter(r["fold"] for r in out if of(r))
        assert sorted(sizes) == list(range(10)) and max(sizes.values()) - min(sizes.values()) <= 2


def test_fold_counts_equal_the_row_by_row_deal():
    rnd = random.Random(3)
    for _ in range(20):
        sets = {frozenset(s): rnd.randrange(1, 300) for s in ([], ["a"], ["b"], ["a", "b"])}
        rows = [(f"{''.join(sorted(s))}{k}", s) for s, n in sets.items() for k in range(n)]
        dealt = sampling.fold_counts(sets, 5)
        for label in ("a", "b", None):
            of = lambda s: label is None or label in s
            rowwise = Counter(f for k, f in sampling.stratified_folds(rows, 5).items() if of(dict(rows)[k]))
            assert max(abs(sum(g[f] for s, g in dealt.items() if of(s)) - rowwise[f]) for f in range(5)) <= 1
        assert all(sum(dealt[s]) == n for s, n in sets.items())


def documents(spark, folder, rows):
    made = [(d, t, "en", s, len(t)) for d, t, s in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_jaccard_pairs_see_late_copies_and_long_words(spark, tmp_path):
    long, rnd = " ".join(f"word{k}" for k in range(40)), random.Random(4)
    letters = "".join(rnd.choice("abcdefghijklmnop") for _ in range(60))
    rows = [(1, long, "src1"), (2, long, "src16"), (3, long + " more", "src1"), (4, letters, "src1"), (5, letters + " b", "src17")]
    rows += [(6, "short one", "src1"), (7, "short ones", "src17")]
    got = {(r["a"], r["b"]) for r in duplicates.c20_jaccard_pairs(spark, documents(spark, tmp_path, rows)).collect()}
    # 1 and 2 are one class with a member on either side, so 3 meets it on the right.
    assert got == {(3, 1), (4, 5)}


def near_copies(rnd, n, words):
    """Texts that differ from one another in a few of their words."""
    base = [f"word{rnd.randrange(10**6)}" for _ in range(words)]
    return [" ".join([*base[:at], f"new{k}", *base[at + 1 :]]) for k, at in enumerate(rnd.sample(range(words), n))]


def shuffled_bytes(spark):
    time.sleep(1)  # the store is brought up to date ten times a second
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_jaccard_pairs_of_a_group_deal_out_its_texts_not_its_pairs(spark, tmp_path):
    texts = near_copies(random.Random(5), 160, 2000)
    folder = documents(spark, tmp_path, [(k, t, f"src{1 + k % 2 * 15}") for k, t in enumerate(texts)])
    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are large
    try:
        got = duplicates.c20_jaccard_pairs(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in range(0, 160, 2) for b in range(1, 160, 2)}
    # A set for each of the 6,400 pairs would be 102 MB (54.7 MB as compressed), the texts are 3.5 MB.
    assert shuffled_bytes(spark) - before < 4 * sum(map(len, texts))


def test_jaccard_pairs_of_ids_with_several_texts(spark, tmp_path):
    (x, x2), (y, y2) = near_copies(random.Random(7), 2, 200), near_copies(random.Random(8), 2, 240)
    # Id 5 has two texts on the left and one on the right that is near nothing there; the class of x3 is named by id 4.
    x3 = x + " x3"
    rows = [(5, x, "src1"), (5, y, "src1"), (5, "z " * 40, "src16"), (7, x2, "src16"), (8, y2, "src16"), (5, x3, "src1"), (4, x3, "src1"), (9, "z " * 41 + "end", "src1")]
    got = [tuple(r) for r in duplicates.c20_jaccard_pairs(spark, documents(spark, tmp_path, rows)).select("a", "b").collect()]
    assert sorted(got) == [(4, 7), (5, 7), (5, 8)]


def test_jaccard_pairs_match_brute_force_whatever_the_tiles(spark, tmp_path, monkeypatch):
    rnd = random.Random(6)
    texts = near_copies(rnd, 20, 140) + near_copies(rnd, 6, 25) + ["", "x" * 29, "\u00e9" * 30, "\u00e9" * 31, "two " + "abcdefghij" * 4, "two " + "abcdefghij" * 5, None, "a b c", "a  b " * 20]
    texts += [" ".join(["same"] * k) for k in (10, 11, 40)] + [t + " more words here" for t in texts[:8]] + [texts[0].upper()]
    rows = [(k, t, rnd.choice(["src1", "src16", None])) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in [*rows, *rows[:5]]], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))  # some rows twice
    classes = {}
    for d, t, s in rows:
        if t is not None:
            at = classes.setdefault(" ".join(t.lower().split()), [d, set()])
            at[0] = min(at[0], d)
            at[1].add(s and s < "src15")

    def shingles(t):
        w = t.split(" ")
        return set() if len(t) < 30 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {t[k : k + 5] for k in range(len(t) - 4)}

    sets = [(d, sides, shingles(t)) for t, (d, sides) in classes.items()]
    like = lambda x, y: len(x & y) / max(1, len(x | y))
    wanted = {(a, b, round(like(x, y), 6)) for a, p, x in sets for b, q, y in sets if a != b and True in p and False in q and like(x, y) >= 0.9}
    assert len(wanted) > 30
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, tile_rows, slots in ((before, near_dup.TILE_ROWS, near_dup.SLOT_BITS), ("3", 2, 6)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            monkeypatch.setattr(near_dup, "TILE_ROWS", tile_rows)
            monkeypatch.setattr(near_dup, "SLOT_BITS", slots)
            got = [tuple(r) for r in duplicates.c20_jaccard_pairs(spark, str(tmp_path)).select("a", "b", "jaccard").collect()]
            assert len(got) == len(set(got)) and set(got) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    (tmp_path / "none").mkdir()
    frame.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert duplicates.c20_jaccard_pairs(spark, str(tmp_path / "none")).count() == 0


def test_greedy_accept_sees_copies_and_the_reference(spark, tmp_path):
    text = lambda seed: " ".join(random.Random(seed).choice("lorem ipsum dolor sit amet elit sed do".split()) + str(seed) for _ in range(30))
    rows = [(k, text(0), "src1") for k in range(4)] + [(9, text(1), "src2"), (10, text(2), "src2"), (11, "tiny", "src2"), (12, "tiny", "src2")]
    folder = documents(spark, tmp_path, rows)
    spark.createDataFrame([(1, text(2).upper())], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    taken = {r["doc_id"] for r in samples.f12_greedy_accept(spark, folder).collect()}
    # Under 80 characters nothing is near, not even a copy.
    assert len(taken & set(range(4))) == 1 and taken - set(range(4)) == {9, 11, 12}


def test_members_and_clusters_have_a_row_per_document(spark, tmp_path):
    base = " ".join(f"word{k}" for k in range(60))
    folder = documents(spark, tmp_path, [(1, base, "src1"), (2, base.upper(), "src2"), (3, base, "src3"), (4, "alone", "src1")])
    assert {(r["doc_id"], r["id"]) for r in duplicates.c18_members(spark, folder).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    got = {r["doc_id"]: r["representative"] for r in duplicates.c19_document_clusters(spark, folder).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[4] == 4 and got[1] == got[2] == got[3] in {1, 2, 3}
