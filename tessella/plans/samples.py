"""Samples, quotas, shards and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import dot, seeded_hash, surface
from tessella.operators import near_dup, ranks, sampling
from tessella.session import table

SEED = "sample-v1"
_HASH = f"sha256('{SEED}' || chr(31) || doc_id)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "lang", "source").alias("stratum"), "n_chars", seeded_hash(SEED, F.col("doc_id")).alias("digest"))


def _strata(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("population"))
    return counts.withColumn("tie", F.sha2(F.concat(F.lit(f"{SEED}\x1fquota\x1f"), F.col("stratum")), 256))


def d7_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(_rows(spark, sf_dir)).select("stratum", "population")


def f7_quota_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.largest_remainder(_strata(_rows(spark, sf_dir)), 400, minimum=2).select("stratum", "population", "quota")


def f8_quota_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.largest_remainder(_strata(_rows(spark, sf_dir)), 300, tie="tie").select("stratum", "population", "quota")


def f9_quota_min_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.largest_remainder(_strata(_rows(spark, sf_dir)), 250, minimum=1, tie="tie").select("stratum", "population", "quota")


def f3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    quotas = sampling.largest_remainder(_strata(rows), 400, minimum=2)
    return sampling.bottom_k(rows, quotas, "digest", "doc_id").select("doc_id", "stratum", "rank")


def f10_srswor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    quotas = sampling.largest_remainder(_strata(rows), 250, minimum=1, tie="tie")
    out = sampling.bottom_k(rows, quotas, "digest", "doc_id")
    return out.select("doc_id", "stratum", F.round("inclusion_probability", 9).alias("inclusion_probability"))


def f4_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return sampling.bernoulli(rows, F.col("digest"), 1, 7).select("doc_id")


BANDS = (("low", -1.01, 0.0), ("middle", 0.0, 0.15), ("high", 0.15, 1.01))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest inner product of each embedding with the three fixed queries: vectors 0, 1 and 2."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id < 3").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("queries"))
    score = F.array_max(F.transform("queries", lambda q: dot(F.col("embedding"), q)))
    return vectors.crossJoin(F.broadcast(queries)).select("vec_id", "label", F.round(score, 6).alias("score"))


def j3_max_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def f5_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the vectors by hash, scored and banded; then each band at its own rate."""
    first = _scored(spark, sf_dir).withColumn("h1", seeded_hash("phase1", F.col("vec_id"))).withColumn("h2", seeded_hash("phase2", F.col("vec_id")))
    phase1 = sampling.banded(sampling.bernoulli(first, F.col("h1"), 1, 2), "score", BANDS)
    parts = [sampling.bernoulli(phase1.where(F.col("band") == b), F.col("h2"), 1, n).withColumn("rate", F.lit(n)) for b, n in (("low", 4), ("middle", 2), ("high", 1))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("vec_id", "band", (1 / (F.lit(2.0) * F.col("rate"))).alias("inclusion_probability"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.col("o_custkey").alias("cluster"), F.col("o_totalprice").alias("price"), (-F.col("o_totalprice")).alias("cheap"), F.length("o_orderpriority").cast("double").alias("width"))


BUCKETS = (("uncertain", "price", 40), ("rare", "width", 30), ("context", "cheap", 20), ("random", "price", 10))


def f11_multi_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.greedy_buckets(_pool(spark, sf_dir), BUCKETS, "o_orderkey", "cluster").select("o_orderkey", "cluster", "bucket")


def e8_prefilter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.greedy_buckets(_pool(spark, sf_dir), BUCKETS, "o_orderkey", "cluster").select("o_orderkey", "bucket", "bucket_rank")


def e5_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return ranks.positions(orders, "o_orderkey")


def a20_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    placed = ranks.positions(orders, "o_orderkey")
    return placed.withColumn("shard", ranks.shard_of(F.col("position"), orders.count(), 7)).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("start"), F.max("position").alias("stop")
    )


def a12_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contiguous slice by explicit position."""
    placed = ranks.positions(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return placed.where(F.col("position").between(1000, 1999)).select("position", "o_orderkey", "o_totalprice")


def f16_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.col("item_id").alias("id"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_nationkey").cast("long").alias("id"))
    return sampling.interleave(benchmark, nation, "n", "coin")


def f16_even_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous near-equal chunks of each source by id, and ten evenly spaced members of the whole."""
    placed = ranks.positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    n = placed.count()
    spots = [round(k * (n - 1) / 9) for k in range(10)]
    return placed.where(F.col("position").isin(spots)).select("doc_id", "position")


def f6_thread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn per conversation by hash, then quotas by role and at least one of each."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("stratum"), seeded_hash(SEED, F.col("conv_id"), F.col("turn")).alias("digest"))
    best = turns.groupBy("conv_id").agg(F.min(F.struct("digest", "turn", "stratum")).alias("b")).select("conv_id", "b.turn", "b.stratum", "b.digest")
    quotas = sampling.largest_remainder(_strata(best), 40, minimum=1, tie="tie")
    return sampling.bottom_k(best, quotas, "digest", "conv_id").select("conv_id", "turn", "stratum")


def f13_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive pools in priority order, each with a quota."""
    labels, rows = table(spark, sf_dir, "labels"), _rows(spark, sf_dir).drop("stratum")
    pool = F.when(F.col("toxic") == 1, "rare").when(F.col("quality") == 0, "context").when(F.col("n_chars") > 4000, "long")
    pooled = rows.join(labels, "doc_id").withColumn("stratum", pool).where(F.col("stratum").isNotNull())
    quotas = _strata(pooled).withColumn("quota", F.expr("CASE stratum WHEN 'rare' THEN 10L WHEN 'context' THEN 20L ELSE 15L END"))
    return sampling.bottom_k(pooled, quotas, "digest", "doc_id").select("doc_id", F.col("stratum").alias("pool"), "rank")


def f14_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return sampling.promote(parts, F.col("p_size") >= 10, "p_retailprice", "p_partkey", 25).select("p_partkey", "p_retailprice")


def f15_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows routed by a reason, and a hash-ranked audit of the others."""
    rows = _rows(spark, sf_dir).drop("stratum").join(table(spark, sf_dir, "labels"), "doc_id")
    reasons = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low_quality")))
    routed = rows.withColumn("reasons", reasons)
    rest = ranks.hash_rank(routed.where(F.size("reasons") == 0), [], "digest", "doc_id").where("rank <= 25").withColumn("reasons", F.array(F.lit("audit")))
    both = routed.where(F.size("reasons") > 0).select("doc_id", "reasons").unionByName(rest.select("doc_id", "reasons"))
    return both.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def f17_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by date as a training curve, prices as scores."""
    curve = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("epoch"), (F.col("o_totalprice") / 1e6).alias("score"))
    out = sampling.early_stop(curve, "o_custkey", "epoch", "score", 0, 0.01, 3)
    return out.withColumn("score", F.round("score", 6))


def f19_length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sampling.length_batches(rows, "n_chars", "doc_id", 16, 5, "batches").select("doc_id", "bucket", "chunk", "batch_order")


def f12_greedy_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language in hash order unless near a benchmark text or one accepted before."""

    def prints(rows: DataFrame) -> DataFrame:
        return rows.select("*", near_dup.simhash("surface").alias("print"), F.length("surface").alias("chars"))

    docs = _rows(spark, sf_dir).withColumn("cell", F.split("stratum", "/")[0])
    ranked = ranks.hash_rank(docs, ["cell"], "digest", "doc_id").select("doc_id", "cell", "rank")
    texts = table(spark, sf_dir, "documents").select("doc_id", surface(F.col("text")).alias("surface"))
    reference = prints(table(spark, sf_dir, "benchmark").select(surface(F.col("text")).alias("surface")))
    own = lambda held: prints(texts.join(F.broadcast(held), "doc_id"))
    return sampling.greedy_accept(ranked, own, "cell", "rank", "doc_id", {"en": 40, "de": 15, "fr": 15, "es": 10}, reference=reference)


def f18_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of all labelled documents."""
    labels = table(spark, sf_dir, "labels").withColumn("digest", seeded_hash("folds", F.col("doc_id")))
    return sampling.label_set_folds(labels, ["quality", "toxic"], "digest", "doc_id", 10)


QUERIES = {
    f.__name__: f
    for f in (
        d7_strata, f3_bottom_k, f4_bernoulli, f5_two_phase, f6_thread_sample, f7_quota_min, f8_quota_lr, f9_quota_min_one, f10_srswor, f11_multi_bucket, f12_greedy_accept,
        f13_pools, f14_promotion, f15_audit_sample, f16_interleave, f16_even_spacing, f17_early_stop, f18_folds, f19_length_batches, e5_positions, e8_prefilter_rank,
        a12_slice, a20_shards, j3_max_cosine,
    )
}


def _quota_sql(total: int, minimum: int, tie: str, strata: str = "strata") -> str:
    return f"""base AS (SELECT *, least(population, {minimum}) AS b, population - least(population, {minimum}) AS room FROM {strata}),
        sums AS (SELECT *, {total} - sum(b) OVER () AS rest, sum(room) OVER () AS allroom FROM base),
        floors AS (SELECT *, CAST((rest * room) // allroom AS BIGINT) AS f, (rest * room) % allroom AS over FROM sums),
        turns AS (SELECT *, rest - sum(f) OVER () AS lefts, row_number() OVER (ORDER BY over DESC, {tie}) AS turn FROM floors),
        quotas AS (SELECT stratum, population, CAST(b + f + CASE WHEN turn <= lefts THEN 1 ELSE 0 END AS BIGINT) AS quota FROM turns)"""


_ROWS = f"rows AS (SELECT doc_id, lang || '/' || source AS stratum, n_chars, {_HASH} AS digest FROM documents)"
_STRATA = f"strata AS (SELECT stratum, count(*) AS population, sha256('{SEED}' || chr(31) || 'quota' || chr(31) || stratum) AS tie FROM rows GROUP BY stratum)"
_UNIT = "('0x' || left({}, 16))::UBIGINT"
_QUERY_DOT = "list_inner_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = {}) AS DOUBLE[]))"
_SCORED = f"scored AS (SELECT vec_id, label, round(greatest({', '.join(_QUERY_DOT.format(k) for k in range(3))}), 6) AS score FROM embeddings)"
_POOL = "pool AS (SELECT o_orderkey, o_custkey AS cluster, o_totalprice AS price, -o_totalprice AS cheap, CAST(length(o_orderpriority) AS DOUBLE) AS width FROM orders)"


def _ledger_sql() -> str:
    steps, taken = [_POOL], ""
    for k, (name, score, quota) in enumerate(BUCKETS):
        skip = f"WHERE cluster NOT IN ({taken})" if taken else ""
        steps.append(f"r{k} AS (SELECT *, row_number() OVER (ORDER BY {score} DESC, o_orderkey) AS bucket_rank FROM pool)")
        steps.append(f"""t{k} AS (
            SELECT o_orderkey, cluster, '{name}' AS bucket, bucket_rank FROM (
                SELECT * FROM r{k} {skip} QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {score} DESC, o_orderkey) = 1)
            ORDER BY bucket_rank LIMIT {quota})""")
        taken = " UNION ALL ".join(f"SELECT cluster FROM t{j}" for j in range(k + 1))
    return ", ".join(steps) + ", ledger AS (" + " UNION ALL ".join(f"SELECT * FROM t{j}" for j in range(len(BUCKETS))) + ")"


SQL = {
    "f17_early_stop": """WITH RECURSIVE curve AS (
            SELECT o_custkey, o_orderkey AS epoch, o_totalprice / 1e6::DOUBLE AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders),
        scan AS (
            SELECT o_custkey, step, epoch AS best, score AS top, 0 AS idle, FALSE AS over FROM curve WHERE step = 1
            UNION ALL
            SELECT c.o_custkey, c.step, CASE WHEN better THEN c.epoch ELSE best END, CASE WHEN better THEN c.score ELSE top END,
                CASE WHEN better THEN 0 WHEN over THEN idle ELSE idle + 1 END, over OR (NOT better AND idle + 1 >= 3)
            FROM (SELECT s.*, c.step AS next, NOT s.over AND c.score > s.top + 0.01 AS better FROM scan s JOIN curve c ON c.o_custkey = s.o_custkey AND c.step = s.step + 1) s
            JOIN curve c ON c.o_custkey = s.o_custkey AND c.step = s.next)
        SELECT o_custkey, arg_max(best, step) AS epoch, round(arg_max(top, step), 6) AS score, arg_max(over, step) AS stopped FROM scan GROUP BY o_custkey""",
    "d7_strata": f"WITH {_ROWS} SELECT stratum, count(*) AS population FROM rows GROUP BY ALL",
    "f7_quota_min": f"WITH {_ROWS}, {_STRATA}, {_quota_sql(400, 2, 'stratum')} SELECT * FROM quotas",
    "f8_quota_lr": f"WITH {_ROWS}, {_STRATA}, {_quota_sql(300, 0, 'tie')} SELECT * FROM quotas",
    "f9_quota_min_one": f"WITH {_ROWS}, {_STRATA}, {_quota_sql(250, 1, 'tie')} SELECT * FROM quotas",
    "f3_bottom_k": f"""WITH {_ROWS}, {_STRATA}, {_quota_sql(400, 2, 'stratum')},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id) AS rank FROM rows)
        SELECT doc_id, stratum, rank FROM ranked JOIN quotas USING (stratum) WHERE rank <= quota""",
    "f10_srswor": f"""WITH {_ROWS}, {_STRATA}, {_quota_sql(250, 1, 'tie')},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id) AS rank FROM rows)
        SELECT doc_id, stratum, round(quota / population, 9) AS inclusion_probability FROM ranked JOIN quotas USING (stratum) WHERE rank <= quota""",
    "f4_bernoulli": f"SELECT doc_id FROM documents WHERE {_UNIT.format(_HASH)} < {(1 << 64) // 7}::UBIGINT",
    "j3_max_cosine": f"WITH {_SCORED} SELECT vec_id, label, score FROM scored",
    "f5_two_phase": f"""WITH {_SCORED},
        banded AS (SELECT *, CASE WHEN score < 0 THEN 'low' WHEN score < 0.15 THEN 'middle' ELSE 'high' END AS band FROM scored
            WHERE {_UNIT.format("sha256('phase1' || chr(31) || vec_id)")} < {(1 << 64) // 2}::UBIGINT),
        rated AS (SELECT *, CASE band WHEN 'low' THEN 4 WHEN 'middle' THEN 2 ELSE 1 END AS rate, {_UNIT.format("sha256('phase2' || chr(31) || vec_id)")} AS u FROM banded)
        SELECT vec_id, band, 1 / (2.0::DOUBLE * rate) AS inclusion_probability FROM rated
        WHERE CASE band WHEN 'low' THEN u < {(1 << 64) // 4}::UBIGINT WHEN 'middle' THEN u < {(1 << 64) // 2}::UBIGINT ELSE TRUE END""",
    "f6_thread_sample": f"""WITH said AS (
            SELECT conv_id, turn, role AS stratum, sha256('{SEED}' || chr(31) || conv_id || chr(31) || turn) AS digest FROM conversations),
        rows AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY digest, turn) = 1), {_STRATA}, {_quota_sql(40, 1, 'tie')},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest, conv_id) AS rank FROM rows)
        SELECT conv_id, turn, stratum FROM ranked JOIN quotas USING (stratum) WHERE rank <= quota""",
    "f11_multi_bucket": f"WITH {_ledger_sql()} SELECT o_orderkey, cluster, bucket FROM ledger",
    "e8_prefilter_rank": f"WITH {_ledger_sql()} SELECT o_orderkey, bucket, bucket_rank FROM ledger",
    "f13_pools": f"""WITH {_ROWS},
        pooled AS (SELECT doc_id, digest, CASE WHEN toxic = 1 THEN 'rare' WHEN quality = 0 THEN 'context' WHEN n_chars > 4000 THEN 'long' END AS pool FROM rows JOIN labels USING (doc_id)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY digest, doc_id) AS rank FROM pooled WHERE pool IS NOT NULL)
        SELECT doc_id, pool, rank FROM ranked WHERE rank <= CASE pool WHEN 'rare' THEN 10 WHEN 'context' THEN 20 ELSE 15 END""",
    "f14_promotion": "SELECT p_partkey, p_retailprice FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    "f15_audit_sample": f"""WITH {_ROWS}, routed AS (
            SELECT doc_id, digest, concat_ws(',', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END) AS reasons FROM rows JOIN labels USING (doc_id))
        SELECT doc_id, reasons FROM routed WHERE reasons <> ''
        UNION ALL (SELECT doc_id, 'audit' FROM routed WHERE reasons = '' ORDER BY digest, doc_id LIMIT 25)""",
    "f16_interleave": """WITH both_arms AS (
            SELECT coalesce(b.item_id, n.n_nationkey) AS n, b.item_id AS x, CAST(n.n_nationkey AS BIGINT) AS y FROM benchmark b FULL OUTER JOIN nation n ON b.item_id = n.n_nationkey),
        coins AS (SELECT *, ('0x' || left(sha256('coin' || chr(31) || n), 2))::UBIGINT % 2 AS c FROM both_arms),
        slots AS (SELECT 2 * n + c AS slot, 'a' AS arm, x AS id FROM coins UNION ALL SELECT 2 * n + 1 - c, 'b', y FROM coins)
        SELECT row_number() OVER (ORDER BY slot) AS place, arm, id FROM slots WHERE id IS NOT NULL""",
    "f16_even_spacing": """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)
        SELECT doc_id, position FROM p WHERE position IN (SELECT CAST(round_even(k * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT) FROM range(10) t(k))""",
    "f19_length_batches": """WITH s AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY sha256('batches' || chr(31) || doc_id), doc_id) AS rank FROM documents),
        b AS (SELECT *, (rank - 1) // 80 AS bucket FROM s), c AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) - 1) // 16 AS chunk FROM b)
        SELECT doc_id, bucket, chunk, sha256('batches' || chr(31) || bucket || chr(31) || chunk) AS batch_order FROM c""",
    "e5_positions": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders",
    "a12_slice": """WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)
        SELECT position, o_orderkey, o_totalprice FROM p WHERE position BETWEEN 1000 AND 1999""",
    "a20_shards": """WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS shard FROM orders)
        SELECT shard, count(*) AS n, min(position) AS start, max(position) AS stop FROM p GROUP BY shard""",
}
