"""Evaluation, calibration, decoding and consensus over labels and derived scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import binary_entropy, entropy, jensen_shannon, softmax
from tessella.operators import decode, evaluation
from tessella.session import table

STATES = ("good", "plain", "toxic")
GRID_T = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)
GRID_P = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score from their length, states from language and length, and design weights."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    logit = (F.col("n_chars") - 2000) / 1500.0
    p = 1 / (1 + F.exp(-logit))
    state = F.expr(
        "CASE WHEN lang = 'es' THEN NULL WHEN lang = 'en' THEN CASE WHEN n_chars > 2500 THEN 'good' ELSE 'plain' END WHEN n_chars < 600 THEN 'toxic' ELSE 'good' END"
    )
    return both.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        "quality",
        "toxic",
        logit.alias("logit"),
        p.alias("p"),
        (F.col("quality") == 1).alias("ref"),
        F.when(F.abs(p - 0.5) >= 0.05, p >= 0.5).alias("pred"),
        F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END").alias("state"),
        state.alias("said"),
        F.expr("CASE lang WHEN 'en' THEN 1.5D WHEN 'es' THEN 5.0D ELSE 4.0D END").alias("w"),
    )


_ROWS = """rows AS (
    SELECT doc_id, lang, source, n_chars, quality, toxic, (n_chars - 2000) / 1500.0::DOUBLE AS logit, 1 / (1 + exp(-((n_chars - 2000) / 1500.0::DOUBLE))) AS p,
        quality = 1 AS ref, CASE WHEN abs(1 / (1 + exp(-((n_chars - 2000) / 1500.0::DOUBLE))) - 0.5) >= 0.05 THEN 1 / (1 + exp(-((n_chars - 2000) / 1500.0::DOUBLE))) >= 0.5 END AS pred,
        CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS state,
        CASE WHEN lang = 'es' THEN NULL WHEN lang = 'en' THEN CASE WHEN n_chars > 2500 THEN 'good' ELSE 'plain' END WHEN n_chars < 600 THEN 'toxic' ELSE 'good' END AS said,
        CASE lang WHEN 'en' THEN 1.5::DOUBLE WHEN 'es' THEN 5.0::DOUBLE ELSE 4.0::DOUBLE END AS w
    FROM labels JOIN documents USING (doc_id))"""


def _binary_sql(source: str, ref: str, pred: str, w: str = "", groups: str = "") -> str:
    weight = w or "1"
    total = lambda c: f"coalesce(sum({weight}) FILTER (WHERE {c}), 0)"
    shown = (lambda c: f"round({c}, 6)") if w else (lambda c: f"CAST({c} AS BIGINT)")
    lead = f"{groups}, " if groups else ""
    return f"""sums AS (
            SELECT {lead}sum({weight}) AS support, {total(f'{ref} AND coalesce({pred}, FALSE)')} AS tp, {total(f'NOT {ref} AND coalesce({pred}, FALSE)')} AS fp,
                {total(f'{ref} AND NOT coalesce({pred}, FALSE)')} AS fn, {total(f'NOT {ref} AND {pred} = FALSE')} AS tn, {total(f'{pred} IS NULL')} AS abstained
            FROM {source} {'GROUP BY ALL' if groups else ''})
        SELECT {lead}{', '.join(f'{shown(c)} AS {c}' for c in ('support', 'tp', 'fp', 'fn', 'tn', 'abstained'))}, round((tp + tn) / nullif(support, 0), 6) AS accuracy,
            round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM sums"""


def d22_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.binary_metrics(rows(spark, sf_dir), "ref", "pred", groups=["lang"])


def d25_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.binary_metrics(rows(spark, sf_dir), "ref", "pred", "w")


def d18_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(rows(spark, sf_dir), "state", "said")


def d18_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.one_versus_rest(rows(spark, sf_dir), "state", "said", STATES)


def d18_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro_f1(evaluation.one_versus_rest(rows(spark, sf_dir), "state", "said", STATES))


def d19_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.kappa(rows(spark, sf_dir).withColumn("said", F.coalesce("said", F.lit("missing"))), "state", "said")


def d21_fixed_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States on the reference's own targets, an absent prediction being the class ``missing``; and accepted-only precision."""
    base = rows(spark, sf_dir).withColumn("got", F.coalesce("said", F.lit("missing")))
    return base.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("got") == "missing").alias("missing"),
        F.round(F.try_divide(F.count_if(F.col("got") == F.col("state")), F.count_if(F.col("got") != "missing")), 6).alias("accepted_precision"),
    )


def d20_tuple_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir)
    return evaluation.tuple_f1(base.select("doc_id", "lang", "state"), base.where("said IS NOT NULL").select("doc_id", "lang", F.col("said").alias("state")), ["doc_id", "lang", "state"])


def d23_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.selective(rows(spark, sf_dir), "state", "said", groups=["lang"])


def d25_weighted_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.selective(rows(spark, sf_dir), "ref", "pred", "w")


def d24_proper_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir).withColumn("p", F.when(F.col("lang") != "es", F.col("p")))
    return evaluation.proper_scores(base, "quality", "p")


def d25_weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.proper_scores(rows(spark, sf_dir), "quality", "p", "w")


def _distribution() -> Column:
    return softmax(F.array(F.col("logit"), F.lit(0.5) - F.col("logit") / 2, F.lit(-1.0)))


def d24_categorical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir).withColumn("dist", _distribution()).withColumn("k", F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state")).cast("int") - 1)
    return evaluation.categorical_scores(base, "k", "dist")


def d26_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.calibration_error(rows(spark, sf_dir), "quality", "p", "w")


def d27_temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.temperature_grid(rows(spark, sf_dir), "quality", "logit", "w", GRID_T)


def d28_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_grid(rows(spark, sf_dir), "quality", "p", "w", GRID_P)


def d29_design_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir).select("lang", (1 / F.col("w") * F.when(F.col("n_chars") > 2000, 0.5).otherwise(1.0)).alias("pi"))
    people = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("population"))
    return evaluation.design_health(base.join(people, F.col("lang") == F.col("l")), "lang", "pi", "population")


def d41_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir).select((F.col("toxic") == 1).alias("hit"), (F.col("lang") == "en").alias("inside"), (1 / F.col("w")).alias("pi"))
    return evaluation.horvitz_thompson_recall(base, "hit", "inside", "pi")


def d30_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more often a length rule is right on quality than the states are on theirs, document by document."""
    right = (F.col("n_chars") >= 2000) == F.col("ref")
    paired = right.cast("int") - F.coalesce(F.col("said") == F.col("state"), F.lit(False)).cast("int")
    return evaluation.bootstrap_interval(rows(spark, sf_dir).select("doc_id", paired.alias("v")), "v", 10_000, "boot")


def d31_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.spread_by(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


def d31_paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("arm")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return evaluation.paired_deltas(months, "month", "arm", "v", "1-URGENT")


def d33_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir)
    left = base.select("doc_id", (F.col("toxic") == 1).alias("relevant"), F.col("state").alias("label"))
    right = base.select("doc_id", (F.col("said") == "toxic").alias("relevant"), F.col("said").alias("label"))
    return evaluation.agreement(left, right, "doc_id", ["relevant", "label"])


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.expr("CASE WHEN n_chars > 3000 THEN 'good' WHEN n_chars > 1500 THEN 'plain' ELSE 'toxic' END")
    return rows(spark, sf_dir).select("doc_id", "state", F.coalesce("said", F.lit("plain")).alias("first"), second.alias("second"), "said", "lang")


def d34_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, tier = decode.consensus(F.col("state"), F.col("first"), F.col("second"))
    return _three(spark, sf_dir).select("doc_id", label.alias("label"), tier.alias("tier"))


def d34_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, tier = decode.reconcile(F.col("first"), F.col("second"), F.col("said"), F.when(F.col("lang") == "en", F.col("state")))
    out = _three(spark, sf_dir).select(label.alias("label"), tier.alias("tier"))
    eligible = F.col("tier").isin("exact_consensus", "blind_majority") & F.col("label").isNotNull()
    return out.groupBy("tier", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(eligible).alias("eligible"))


def d32_rare_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir)
    cells = base.select("doc_id", F.explode(F.array_distinct(F.array(F.concat_ws("/", F.lit("state"), "state"), F.concat_ws("/", F.lit("lang"), "lang")))).alias("cell"))
    return decode.rarest_anchor(cells, "doc_id", "cell")


def d35_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.class_weights(rows(spark, sf_dir), "state", 0.5, 1.4)


def d38_slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-versus-rest counts over the slots of rows that matter, an absent prediction being ``absent``."""
    base = rows(spark, sf_dir).where("quality = 1").withColumn("got", F.coalesce("said", F.lit("absent")))
    return evaluation.one_versus_rest(base, "state", "got", (*STATES, "absent")).select("state", "tp", "fp", "fn", "tn")


def d39_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = evaluation.binary_metrics(rows(spark, sf_dir), "ref", "pred")
    long = metrics.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("precision", "recall", "f1")])))
    least = spark.sql("SELECT * FROM VALUES ('precision', 0.5D), ('recall', 0.2D), ('f1', 0.99D), ('coverage', 0.1D) AS t(name, least)")
    return evaluation.gates(long, least)


def d40_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir).withColumn("dist", _distribution()).withColumn("other", softmax(F.array(F.lit(0.2), F.col("logit"), F.lit(0.0))))
    return base.select(
        "doc_id",
        F.round(binary_entropy(F.col("p")), 6).alias("relevance_entropy"),
        F.round(entropy(F.col("dist")), 6).alias("state_entropy"),
        F.round(jensen_shannon(F.array("dist", "other")), 6).alias("disagreement"),
        F.round(4 * F.col("p") * (1 - F.col("p")), 6).alias("boundary"),
    )


def b21_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, kept = decode.binary_decode(F.col("p"), 0.6, 0.1)
    state, sure = decode.categorical_decode(F.col("dist"), STATES, 0.6)
    return rows(spark, sf_dir).withColumn("dist", _distribution()).select("doc_id", full.alias("full"), kept.alias("selective"), state.alias("state"), sure.alias("sure"))


def b22_gated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    on, state = decode.gated(F.col("ref"), F.col("toxic") == 0, F.col("said"))
    return rows(spark, sf_dir).select("doc_id", on.alias("present"), state.alias("state"))


def b23_forced_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = F.transform("dist", lambda x: x >= 0.55)
    base = rows(spark, sf_dir).withColumn("dist", _distribution())
    return base.select("doc_id", F.array_join(decode.forced_targets(F.col("ref"), present, F.col("dist")), ",").alias("targets"))


def b24_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four components of each embedding as logits; the last of them is dropped before the softmax."""
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", decode.three_class(logits, 3, 0.5).alias("d"))
    return out.select("vec_id", *[F.round(F.get("d", F.lit(k)), 6).alias(f"p{k}") for k in range(3)])


def b31_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("dist", F.lit(0.0), lambda a, x: a + x)
    base = rows(spark, sf_dir).withColumn("dist", _distribution())
    return decode.violations(base, {"sums_to_one": F.abs(total - 1) < 1e-6, "has_prediction": F.col("said").isNotNull(), "known_language": F.col("lang").isin("en", "de", "fr")})


def j6_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.create_map(F.lit("a"), F.col("state"), F.lit("b"), F.coalesce("said", F.lit("none")))
    return rows(spark, sf_dir).select("doc_id", F.array_join(decode.encode_label(label, ["a", "b", "c"], STATES), ",").alias("code"))


QUERIES = {
    f.__name__: f
    for f in (
        d18_confusion, d18_per_class, d18_macro_f1, d19_kappa, d20_tuple_f1, d21_fixed_reference, d22_abstain, d23_selective, d24_proper_scores, d24_categorical_scores,
        d25_weighted, d25_weighted_selective, d25_weighted_scores, d26_ece, d27_temperature_grid, d28_threshold_grid, d29_design_health, d30_bootstrap, d31_spread,
        d31_paired_deltas, d32_rare_cells, d33_agreement, d34_consensus, d34_tie_break, d35_class_weights, d38_slot_counts, d39_gates, d40_uncertainty, d41_recall,
        b21_decode, b22_gated_rows, b23_forced_targets, b24_softmax, b31_violations, j6_encoded,
    )
}

_NLL = "-(quality * ln(greatest({p}, 1e-15)) + (1 - quality) * ln(greatest(1 - {p}, 1e-15)))"
_EACH = "each AS (SELECT *, unnest(['good', 'plain', 'toxic']) AS c FROM rows), pairs AS (SELECT c AS state, state = c AS r, said = c AS q FROM each)"


def _softmax_sql(logits: list[str], name: str) -> str:
    top = f"greatest({', '.join(logits)})"
    parts = [f"exp({x} - {top})" for x in logits]
    return f"list_transform([{', '.join(parts)}], lambda x: x / ({' + '.join(parts)})) AS {name}"


_DIST = _softmax_sql(["logit", "(0.5 - logit / 2)", "(-1.0::DOUBLE)"], "dist")
_OTHER = _softmax_sql(["0.2::DOUBLE", "logit", "0.0::DOUBLE"], "other")
_PER_CLASS = _binary_sql("pairs", "r", "q", groups="state")
SQL = {
    "d22_abstain": f"WITH {_ROWS}, " + _binary_sql("rows", "ref", "pred", groups="lang"),
    "d25_weighted": f"WITH {_ROWS}, " + _binary_sql("rows", "ref", "pred", "w"),
    "d18_confusion": f"WITH {_ROWS} SELECT state AS reference, coalesce(said, 'abstained') AS predicted, count(*) AS n FROM rows GROUP BY ALL",
    "d18_per_class": f"WITH {_ROWS}, {_EACH}, {_PER_CLASS}",
    "d18_macro_f1": f"SELECT round(avg(f1), 6) AS macro_f1, count(f1) AS defined FROM (WITH {_ROWS}, {_EACH}, {_PER_CLASS})",
    "d19_kappa": f"""WITH {_ROWS}, p AS (SELECT state AS a, coalesce(said, 'missing') AS b FROM rows), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agreed FROM p),
        l AS (SELECT a AS label FROM p UNION SELECT b FROM p),
        c AS (SELECT sum((SELECT count(*) FROM p WHERE a = label) * (SELECT count(*) FROM p WHERE b = label)) AS products FROM l)
        SELECT n, round(agreed / n, 6) AS observed, round(products / (n * n), 6) AS chance,
            round((agreed / n - products / (n * n)) / nullif(1 - products / (n * n), 0), 6) AS kappa FROM n, c""",
    "d20_tuple_f1": f"""WITH {_ROWS}, a AS (SELECT DISTINCT doc_id, lang, state FROM rows), b AS (SELECT DISTINCT doc_id, lang, said AS state FROM rows WHERE said IS NOT NULL),
        c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS tp, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a) AS na)
        SELECT tp, nb - tp AS fp, na - tp AS fn, round(tp / nullif(nb, 0), 6) AS precision, round(tp / nullif(na, 0), 6) AS recall, round(2 * tp / nullif(na + nb, 0), 6) AS f1 FROM c""",
    "d21_fixed_reference": f"""WITH {_ROWS}
        SELECT state, count(*) AS n, count(*) FILTER (WHERE said IS NULL) AS missing,
            round(count(*) FILTER (WHERE said = state) / nullif(count(said), 0), 6) AS accepted_precision FROM rows GROUP BY state""",
    "d23_selective": f"""WITH {_ROWS}, s AS (SELECT lang, count(*) AS support, count(said) AS accepted, count(*) FILTER (WHERE said = state) AS correct FROM rows GROUP BY lang)
        SELECT *, accepted - correct AS errors, round(accepted / support, 6) AS coverage, round((accepted - correct) / nullif(accepted, 0), 6) AS accepted_risk,
            round((support - correct) / support, 6) AS population_risk FROM s""",
    "d25_weighted_selective": f"""WITH {_ROWS}, s AS (
            SELECT sum(w) AS support, sum(w) FILTER (WHERE pred IS NOT NULL) AS accepted, sum(w) FILTER (WHERE pred = ref) AS correct FROM rows)
        SELECT round(support, 6) AS support, round(accepted, 6) AS accepted, round(correct, 6) AS correct, round(accepted - correct, 6) AS errors,
            round(accepted / support, 6) AS coverage, round((accepted - correct) / accepted, 6) AS accepted_risk, round((support - correct) / support, 6) AS population_risk FROM s""",
    "d24_proper_scores": f"""WITH {_ROWS}
        SELECT count(*) AS support, count(*) FILTER (WHERE lang <> 'es') AS available, round(avg((p - quality) ** 2) FILTER (WHERE lang <> 'es'), 6) AS brier,
            round(avg({_NLL.format(p='p')}) FILTER (WHERE lang <> 'es'), 6) AS nll FROM rows""",
    "d25_weighted_scores": f"""WITH {_ROWS}
        SELECT count(*) AS support, count(p) AS available, round(sum(w * (p - quality) ** 2) / sum(w), 6) AS brier, round(sum(w * {_NLL.format(p='p')}) / sum(w), 6) AS nll FROM rows""",
    "d24_categorical_scores": f"""WITH {_ROWS}, d AS (SELECT *, {_DIST}, list_position(['good', 'plain', 'toxic'], state) AS k FROM rows)
        SELECT count(*) AS support, round(avg((dist[1] - (k = 1)::INT) ** 2 + (dist[2] - (k = 2)::INT) ** 2 + (dist[3] - (k = 3)::INT) ** 2), 6) AS brier,
            round(avg(-ln(greatest(dist[k], 1e-15))), 6) AS nll FROM d""",
    "d26_ece": f"""WITH {_ROWS}, b AS (SELECT least(floor(p * 10), 9) AS bin, sum(w) AS w, sum(w * p) AS p, sum(w * quality) AS y FROM rows GROUP BY 1)
        SELECT count(*) AS bins, round(sum(abs(p - y)) / sum(w), 6) AS ece FROM b""",
    "d27_temperature_grid": f"""WITH {_ROWS}, g AS (SELECT *, unnest([{', '.join(f'{t}::DOUBLE' for t in GRID_T)}]) AS temperature FROM rows),
        l AS (SELECT temperature, round(sum(w * {_NLL.format(p='(1 / (1 + exp(-logit / temperature)))')}) / sum(w), 6) AS nll FROM g GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY nll, abs(temperature - 1), temperature) = 1 AS chosen FROM l""",
    "d28_threshold_grid": f"""WITH {_ROWS}, g AS (SELECT *, unnest([{', '.join(f'{t}::DOUBLE' for t in GRID_P)}]) AS threshold FROM rows), m AS (
            SELECT threshold, coalesce(round(2 * sum(w) FILTER (WHERE ref AND p >= threshold) / (2 * sum(w) FILTER (WHERE ref AND p >= threshold)
                + coalesce(sum(w) FILTER (WHERE NOT ref AND p >= threshold), 0) + coalesce(sum(w) FILTER (WHERE ref AND p < threshold), 0)), 6), 0) AS f1,
                coalesce(round(sum(w) FILTER (WHERE ref AND p >= threshold) / sum(w) FILTER (WHERE ref), 6), 0) AS recall FROM g GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY f1 DESC, recall DESC, abs(threshold - 0.5), threshold) = 1 AS chosen FROM m""",
    "d29_design_health": f"""WITH {_ROWS}, x AS (SELECT lang, 1 / (1 / w * CASE WHEN n_chars > 2000 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS v FROM rows)
        SELECT lang, count(*) AS n, round(sum(v), 6) AS weighted, (SELECT count(*) FROM documents d WHERE d.lang = x.lang) AS population,
            round(sum(v) ** 2 / sum(v * v), 6) AS effective_n, round(max(v) / min(v), 6) AS weight_ratio FROM x GROUP BY lang""",
    "d41_recall": f"""WITH {_ROWS}, s AS (SELECT coalesce(sum(w) FILTER (WHERE toxic = 1 AND lang = 'en'), 0) AS i, coalesce(sum(w) FILTER (WHERE toxic = 1 AND lang <> 'en'), 0) AS o FROM rows)
        SELECT round(i, 6) AS inside, round(o, 6) AS outside, round(i / nullif(i + o, 0), 6) AS recall FROM s""",
    "d30_bootstrap": f"""WITH {_ROWS},
        x AS (SELECT doc_id, CAST((n_chars >= 2000) = ref AS INTEGER) - CAST(coalesce(said = state, FALSE) AS INTEGER) AS v FROM rows),
        counted AS (SELECT CAST(v AS DOUBLE) AS v, count(*) AS n FROM x GROUP BY v),
        parts AS (SELECT v, c, least(4096, n - 4096 * c) AS m FROM counted, range(1000) t(c) WHERE 4096 * c < n),
        spans AS (SELECT DISTINCT m, CAST(floor(8 * sqrt(m)) AS BIGINT) + 8 AS reach FROM parts),
        ks AS (SELECT m, unnest(range(greatest(0, m - reach), m + reach)) AS k, greatest(0, m - reach) AS lowest FROM spans),
        steps AS (
            SELECT m, k, lowest, CAST(floor(least(1.0::DOUBLE, sum(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY m ORDER BY k)) * 4503599627370496) AS BIGINT) AS step FROM ks),
        draws AS (SELECT i, v, m, CAST(('0x' || left(sha256('boot' || chr(31) || i || chr(31) || v || chr(31) || c), 13))::UBIGINT AS BIGINT) AS u FROM parts, range(10000) t(i)),
        weighed AS (
            SELECT d.i, d.v, coalesce(t.k + 1, (SELECT min(lowest) FROM steps s WHERE s.m = d.m)) AS w FROM draws d ASOF LEFT JOIN steps t ON d.m = t.m AND d.u >= t.step),
        means AS (SELECT i, sum(v * w) / sum(w) AS m FROM weighed GROUP BY i)
        SELECT (SELECT round(avg(v), 6) FROM x) AS observed, count(m) AS replicates, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS middle,
            round(quantile_cont(m, 0.975), 6) AS high FROM means""",
    "d31_spread": "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd FROM orders GROUP BY 1",
    "d31_paired_deltas": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS arm, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL)
        SELECT a.arm, count(*) AS pairs, round(avg(a.v - b.v), 6) AS mean_delta, round(stddev_samp(a.v - b.v), 6) AS sd_delta
        FROM m a JOIN m b ON a.month = b.month AND b.arm = '1-URGENT' WHERE a.arm <> '1-URGENT' GROUP BY 1""",
    "d33_agreement": f"""WITH {_ROWS}, x AS (SELECT (toxic = 1) IS NOT DISTINCT FROM (said = 'toxic') AS r, state IS NOT DISTINCT FROM said AS l FROM rows)
        SELECT count(*) AS n, round(count(*) FILTER (WHERE r AND l) / count(*), 6) AS exact, round(count(*) FILTER (WHERE r) / count(*), 6) AS relevant,
            round(count(*) FILTER (WHERE l) / count(*), 6) AS label FROM x""",
    "d34_consensus": f"""WITH {_ROWS}, x AS (SELECT doc_id, state AS h, coalesce(said, 'plain') AS a,
            CASE WHEN n_chars > 3000 THEN 'good' WHEN n_chars > 1500 THEN 'plain' ELSE 'toxic' END AS b FROM rows)
        SELECT doc_id, CASE WHEN h = a THEN h WHEN h = b THEN h WHEN a = b THEN a END AS label,
            CASE WHEN h = a AND a = b THEN 'unanimous' WHEN h = a OR h = b THEN 'human_supported' WHEN a = b THEN 'reviewers_override' ELSE 'unresolved' END AS tier FROM x""",
    "d34_tie_break": f"""WITH {_ROWS}, x AS (SELECT state, lang, said, coalesce(said, 'plain') AS a,
            CASE WHEN n_chars > 3000 THEN 'good' WHEN n_chars > 1500 THEN 'plain' ELSE 'toxic' END AS b FROM rows),
        y AS (SELECT CASE WHEN a = b THEN a WHEN said = a OR said = b THEN said WHEN lang = 'en' THEN state END AS label,
            CASE WHEN a = b THEN 'exact_consensus' WHEN said = a OR said = b THEN 'blind_majority' WHEN lang = 'en' THEN 'adjudicated' ELSE 'open' END AS tier FROM x)
        SELECT tier, label, count(*) AS n, count(*) FILTER (WHERE tier IN ('exact_consensus', 'blind_majority') AND label IS NOT NULL) AS eligible FROM y GROUP BY ALL""",
    "d32_rare_cells": f"""WITH {_ROWS}, c AS (SELECT doc_id, 'state/' || state AS cell FROM rows UNION ALL SELECT doc_id, 'lang/' || lang FROM rows),
        s AS (SELECT cell, count(*) AS support FROM c GROUP BY cell)
        SELECT doc_id, cell AS anchor, support FROM c JOIN s USING (cell) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY support, cell) = 1""",
    "d35_class_weights": f"""WITH {_ROWS}, c AS (SELECT state, count(*) AS n FROM rows GROUP BY state), r AS (SELECT *, sqrt(sum(n) OVER () / n) AS raw FROM c)
        SELECT state, n, round(least(greatest(raw / avg(raw) OVER (), 0.5), 1.4), 6) AS weight FROM r""",
    "d38_slot_counts": f"""WITH {_ROWS}, e AS (SELECT *, unnest(['good', 'plain', 'toxic', 'absent']) AS c FROM rows WHERE quality = 1)
        SELECT c AS state, count(*) FILTER (WHERE state = c AND coalesce(said, 'absent') = c) AS tp, count(*) FILTER (WHERE state <> c AND coalesce(said, 'absent') = c) AS fp,
            count(*) FILTER (WHERE state = c AND coalesce(said, 'absent') <> c) AS fn, count(*) FILTER (WHERE state <> c AND coalesce(said, 'absent') <> c) AS tn FROM e GROUP BY c""",
    "d39_gates": f"""WITH m AS (WITH {_ROWS}, {_binary_sql("rows", "ref", "pred")}),
        long AS (SELECT 'precision' AS name, precision AS value FROM m UNION ALL SELECT 'recall', recall FROM m UNION ALL SELECT 'f1', f1 FROM m),
        t AS (SELECT * FROM (VALUES ('precision', 0.5::DOUBLE), ('recall', 0.2::DOUBLE), ('f1', 0.99::DOUBLE), ('coverage', 0.1::DOUBLE)) v(name, least)),
        j AS (SELECT name, least, value, coalesce(value >= least, FALSE) AS passes FROM t LEFT JOIN long USING (name))
        SELECT *, bool_and(passes) OVER () AS all_pass FROM j""",
    "d40_uncertainty": f"""WITH {_ROWS}, d AS (SELECT *, {_DIST}, {_OTHER} FROM rows), m AS (SELECT *, list_transform(range(1, 4), lambda k: (dist[k] + other[k]) / 2) AS mean FROM d)
        SELECT doc_id, round(-(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2.0::DOUBLE), 6) AS relevance_entropy,
            round(-list_sum(list_transform(dist, lambda x: x * ln(x))) / ln(3.0::DOUBLE), 6) AS state_entropy,
            round(least(1, greatest(0, (list_sum(list_transform(range(1, 4), lambda k: dist[k] * ln(dist[k] / mean[k]))) + list_sum(list_transform(range(1, 4), lambda k: other[k] * ln(other[k] / mean[k]))))
                / 2 / ln(2.0::DOUBLE))), 6) AS disagreement, round(4 * p * (1 - p), 6) AS boundary FROM m""",
    "b21_decode": f"""WITH {_ROWS}, d AS (SELECT *, {_DIST} FROM rows), s AS (SELECT *, list_max(dist) AS top FROM d)
        SELECT doc_id, p >= 0.6 AS "full", CASE WHEN abs(p - 0.6) >= 0.1 THEN p >= 0.6 END AS selective, (['good', 'plain', 'toxic'])[list_position(dist, top)] AS state,
            CASE WHEN top >= 0.6 THEN (['good', 'plain', 'toxic'])[list_position(dist, top)] END AS sure FROM s""",
    "b22_gated_rows": f"WITH {_ROWS} SELECT doc_id, ref AND toxic = 0 AS present, CASE WHEN ref AND toxic = 0 THEN said END AS state FROM rows",
    "b23_forced_targets": f"""WITH {_ROWS}, d AS (SELECT *, {_DIST} FROM rows), c AS (SELECT *, list_filter(range(0, 3), lambda k: dist[k + 1] >= 0.55) AS chosen FROM d)
        SELECT doc_id, CASE WHEN NOT ref THEN '' WHEN len(chosen) > 0 THEN array_to_string(chosen, ',') ELSE CAST(list_position(dist, list_max(dist)) - 1 AS VARCHAR) END AS targets FROM c""",
    "b24_softmax": """WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings),
        x AS (SELECT vec_id, list_transform(l, lambda v: exp((v - list_max(l)) / 0.5)) AS q FROM e)
        SELECT vec_id, round(q[1] / list_sum(q), 6) AS p0, round(q[2] / list_sum(q), 6) AS p1, round(q[3] / list_sum(q), 6) AS p2 FROM x""",
    "b31_violations": f"""WITH {_ROWS} SELECT 'sums_to_one' AS name, 0::BIGINT AS violations
        UNION ALL SELECT 'has_prediction', count(*) FILTER (WHERE said IS NULL) FROM rows UNION ALL SELECT 'known_language', count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr')) FROM rows""",
    "j6_encoded": f"""WITH {_ROWS}
        SELECT doc_id, (list_position(['good', 'plain', 'toxic'], state) - 1) || ',' || coalesce(list_position(['good', 'plain', 'toxic'], said) - 1, -1) || ',-1' AS code FROM rows""",
}
