"""Canonical rows, lexical retrieval, thread expansion and bounded context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import head_tail
from tessella.operators import canonical, context, lexical, threads
from tessella.session import table
from tessella.sources import records

# Terms that the generated prose has, with phrases that suppress some of them.
TERMS = (
    lexical.Term("de_und", "und"),
    lexical.Term("en_of_the", "of the"),
    lexical.Term("en_the", "the"),
    lexical.Term("en_was_not", "was"),
    lexical.Term("es_los", "los"),
    lexical.Term("fr_elle", "elle"),
)
# A policy of 114 terms made by rule: two pieces of the generated words, and two words in a row.
POLICY = {
    "terms": [{"id": f"{a}{b}", "pattern": f"{a}{b}"} for a in ("th", "er", "on", "an", "re", "he", "in", "en", "le") for b in ("er", "on", "an", "re", "he", "in", "nd", "ea", "or", "st", "ti", "it")]
    + [{"id": f"{a}_{b}", "pattern": f"{a} {b}"} for a, b in (("of", "the"), ("in", "the"), ("de", "la"), ("und", "der"), ("it", "is"), ("to", "be"))],
}
SUPPRESSED = (lexical.Term("en_the", "the", ("of the", "and the", "the to")), lexical.Term("de_der", "der", ("und der",)))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of raw records; ages, kinds and ids follow from their other columns."""
    docs = table(spark, sf_dir, "documents")
    comment = F.col("n_chars") % 2 == 0
    opening = (F.col("doc_id") % 50).cast("string")
    return docs.select(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t3_"), opening)).otherwise(opening).alias("link_id"),
        F.expr("""CASE WHEN doc_id % 29 = 0 THEN concat('t5_', doc_id) WHEN doc_id % 4 = 0 THEN concat('t3_', doc_id % 50) WHEN doc_id % 4 = 1 THEN concat('T1_', doc_id)
            ELSE concat(' ', doc_id) END""").alias("parent_id"),
        F.concat(F.lit("/landed/"), "source", F.when(comment, "_comments.zst").otherwise("_submissions.zst")).alias("file"),
        F.when(F.col("n_chars") > 9000, F.concat(F.lit("t9_"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string")).alias("record_id"),
        F.when(F.col("n_chars") < 300, "true").otherwise((F.lit(1577836800 - 20000000) + F.col("n_chars") * 50000).cast("string")).alias("created"),
        F.col("source").alias("community"),
        F.when((F.col("lang") == "es") & (F.col("n_chars") > 3000), "elsewhere").otherwise(F.upper("source")).alias("expected_community"),
        F.expr("CASE lang WHEN 'en' THEN 'main' WHEN 'de' THEN 'second' WHEN 'es' THEN 'second' END").alias("stratum"),
        F.when(comment, "comment").otherwise("submission").alias("kind"),
        F.when(~comment, F.substring_index("text", "\n", 1)).alias("title"),
        F.when(F.col("n_chars") < 500, "[deleted]").when(F.col("n_chars") < 600, " [removed] ").otherwise(F.col("text")).alias("body"),
        F.lit(False).alias("malformed"),
    )


_RAW = r"""raw AS (
    SELECT CASE WHEN n_chars > 9000 THEN 't9_' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS record_id, 't3_' || (doc_id % 50) AS link,
        CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 't3_' || (doc_id % 50) ELSE 't1_' || doc_id END AS parent,
        CASE WHEN n_chars < 300 THEN NULL ELSE 1577836800 - 20000000 + n_chars * 50000 END AS seconds, source AS community,
        CASE WHEN lang = 'es' AND n_chars > 3000 THEN 'elsewhere' ELSE upper(source) END AS expected_community,
        CASE lang WHEN 'en' THEN 'main' WHEN 'de' THEN 'second' WHEN 'es' THEN 'second' END AS stratum,
        CASE WHEN n_chars % 2 = 0 THEN 'comment' ELSE 'submission' END AS kind, split_part(text, chr(10), 1) AS title,
        CASE WHEN n_chars < 500 THEN '[deleted]' WHEN n_chars < 600 THEN '[removed]' ELSE regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS body
    FROM documents),
    texts AS (
        SELECT *, CASE WHEN kind = 'comment' THEN CASE WHEN body NOT IN ('[deleted]', '[removed]') THEN body END
            ELSE concat_ws(chr(10) || chr(10), CASE WHEN regexp_replace(title, '^\s+|\s+$', '', 'g') <> '' THEN regexp_replace(title, '^\s+|\s+$', '', 'g') END,
                CASE WHEN body NOT IN ('[deleted]', '[removed]') AND body <> '' THEN body END) END AS text
        FROM raw),
    judged AS (
        SELECT *, CASE WHEN lower(community) <> lower(expected_community) THEN 'community_mismatch' WHEN stratum IS NULL THEN 'unknown_stratum'
            WHEN seconds IS NULL THEN 'missing_required_field'
            WHEN seconds < 1577836800 OR seconds >= 1767225600 THEN 'outside_time_window'
            WHEN coalesce(text, '') = '' AND body = '[deleted]' THEN 'deleted' WHEN coalesce(text, '') = '' AND body = '[removed]' THEN 'removed'
            WHEN coalesce(text, '') = '' THEN 'empty_text' WHEN NOT regexp_full_match(record_id, '[0-9a-z]+') OR (kind = 'comment' AND parent IS NULL) THEN 'invalid_id' END AS reason
        FROM texts)"""


def b1_canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = canonical.canonical(_raw(spark, sf_dir))
    return out.withColumn("created_utc", F.unix_timestamp("created_utc"))


def d12_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.reason_counts(_raw(spark, sf_dir), "kind")


def a4_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, those of error events cut off: what doesn't parse to an object is malformed."""
    events = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).when(F.col("event_type") == "view", F.lit("[1]")).otherwise(F.col("props"))
    parsed = F.from_json(line, "k BIGINT, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = events.select("event_type", parsed.alias("j")).withColumn("reason", F.when(F.col("j._corrupt").isNotNull(), canonical.MALFORMED).otherwise("retained"))
    return rows.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("j.k").alias("k_sum"))


# Whole texts that stand for something else, and some that the generated tables have.
MARKS = ("[deleted]", "[removed]", "That it.", "Reorea. Nd.", "Die tz.")


def d13_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts that are marks, by source; the scan gets the list of marks."""
    return canonical.sentinel_counts(table(spark, sf_dir, "documents"), "text", list(MARKS), "source")


def b11_lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexical.hits(table(spark, sf_dir, "documents"), "text", TERMS)
    return out.select("doc_id", F.array_join("term_ids", ",").alias("term_ids"))


def b11_lexical_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexical.hits_by_automaton(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return out.select("doc_id", F.array_join("term_ids", ",").alias("term_ids"))


def b11_policy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy's terms, over a hundred, in one pass over each text."""
    terms, _ = records.policy_terms(POLICY)
    out = lexical.hits_by_automaton(table(spark, sf_dir, "documents"), "doc_id", "text", terms)
    return out.select("doc_id", F.array_join("term_ids", ",").alias("term_ids"))


def b12_suppressed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexical.hits(table(spark, sf_dir, "conversations"), "text", SUPPRESSED)
    return out.select("conv_id", "turn", F.array_join("term_ids", ",").alias("term_ids"))


def b13_record_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; a line equal to an excluded one has no terms."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    out = lexical.hits(lines, "text", TERMS[:3], ("the", "of the.", "und"))
    return out.groupBy(F.array_join("term_ids", ",").alias("term_ids")).agg(F.count(F.lit(1)).alias("lines"))


def _low(column: str) -> str:
    return rf"trim(regexp_replace(lower(translate({column}, 'İı', 'ii')), '\s+', ' ', 'g'))"


def _hit(low: str, phrase: str) -> str:
    return f"regexp_matches({low}, '(^|[^A-Za-z0-9_]){phrase}([^A-Za-z0-9_]|$)')"


def _ids(low: str, terms: tuple[lexical.Term, ...]) -> str:
    items = ", ".join(f"CASE WHEN {_hit(low, t.phrase)} THEN '{t.term_id}' END" for t in terms)
    return f"coalesce(array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ','), '')"


def _masked(low: str, phrases: tuple[str, ...]) -> str:
    one = f"'(^|[^A-Za-z0-9_])({'|'.join(sorted(phrases, key=lambda p: (-len(p), p)))})($|[^A-Za-z0-9_])', '\\1 # \\3', 'g'"
    return f"regexp_replace(regexp_replace({low}, {one}), {one})"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: turn 0 opens, each turn replies to the one before."""
    at = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    rows = table(spark, sf_dir, "conversations").select(
        at(F.col("turn")).alias("record"), at(F.lit(0)).alias("thread"), F.when(F.col("turn") > 0, at(F.col("turn") - 1)).alias("parent"), "role", "text"
    )
    return lexical.hits(rows, "text", THREAD_TERMS)


THREAD_TERMS = (lexical.Term("de_und", "und der"), lexical.Term("en_it", "it is"), lexical.Term("fr_elle", "elle"))
_RECORDS = f"""records AS (
    SELECT conv_id || '-' || turn AS record, conv_id || '-0' AS thread, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent, role, text,
        {_ids(_low("text"), THREAD_TERMS)} AS terms FROM conversations),
    direct AS (SELECT record, 'direct_lexical' AS channel, record AS anchor, 0::BIGINT AS depth, terms FROM records WHERE terms <> ''),
    by_thread AS (
        SELECT r.record, 'submission_expansion' AS channel, h.record AS anchor, 1::BIGINT AS depth, h.terms
        FROM records r JOIN records h ON r.thread = h.record WHERE r.record <> r.thread AND h.terms <> ''),
    by_reply AS (
        SELECT r.record, 'direct_reply_expansion' AS channel, h.record AS anchor, 1::BIGINT AS depth, h.terms
        FROM records r JOIN records h ON r.parent = h.record WHERE h.record <> h.thread AND h.terms <> ''),
    every AS (SELECT * FROM direct UNION SELECT * FROM by_thread UNION SELECT * FROM by_reply),
    merged AS (
        SELECT record, list_sort(list(DISTINCT channel)) AS channels, list_sort(list(DISTINCT concat_ws(':', channel, anchor, depth, terms))) AS evidence FROM every GROUP BY record)"""


def _shown(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("term_ids", F.array_join("term_ids", ","))


def c9_thread_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return _shown(threads.thread_expansion(records, records.select("record", "term_ids")))


def c10_reply_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return _shown(threads.reply_expansion(records, records.select("record", "term_ids")))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    hits = records.select("record", "term_ids")
    return threads.merge_evidence(threads.direct_evidence(hits), threads.thread_expansion(records, hits), threads.reply_expansion(records, hits))


def g5_merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda e: F.concat_ws(":", e["channel"], e["anchor"], e["depth"], F.array_join(e["term_ids"], ","))
    return _merged(spark, sf_dir).select(
        "record", F.array_join("channels", "|").alias("channels"), F.array_join(F.array_sort(F.transform("evidence", one)), "|").alias("evidence"), "mode", "bucket"
    )


def d37_channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.channel_counts(_merged(spark, sf_dir))


def b16_b17_modes_and_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).groupBy("mode", "bucket").agg(F.count(F.lit(1)).alias("records"))


def b18_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = head_tail(F.col("text"), 1200, context.MARKER)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(cut).cast("long").alias("n"), F.sha2(cut, 256).alias("cut_sha256"), (F.length("text") > 1200).alias("truncated")
    )


_CUT = lambda c, n: (
    f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {(n - 7 + 1) // 2}) || chr(10) || '[...]' || chr(10) || right({c}, {(n - 7) // 2}) END"
)


def b20_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shown = context.render([("source", "source", 20), ("lang", "lang", 10), ("text", "text", 900)], 700)
    return docs.select("doc_id", F.length(shown).cast("long").alias("n"), F.sha2(shown, 256).alias("sha"))


def _hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).select("record", "thread", "parent", "text", "role")
    texts = records.where("role <> 'system'").select("record", "thread", "text")
    return context.hydrate(records, texts, 160, 120)


def c7_hydrated_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hash_of = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256).alias(c)
    return _hydrated(spark, sf_dir).select("record", "opening_status", "parent_status", hash_of("opening_context"), hash_of("parent_context"), "opening_cut", "parent_cut")


def c8_join_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hydrated(spark, sf_dir).groupBy("opening_status", "parent_status").agg(F.count(F.lit(1)).alias("n"))


def b19_context_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hydrated(spark, sf_dir)
    missing = (F.col("opening_status") == "missing") | (F.col("parent_status") == "missing")
    return rows.groupBy(context.condition(missing, F.col("opening_cut") | F.col("parent_cut")).alias("condition")).agg(F.count(F.lit(1)).alias("n"))


_HYDRATED = f"""{_RECORDS},
    texts AS (SELECT record, thread, text FROM records WHERE role <> 'system'),
    joined AS (
        SELECT r.*, o.record AS o, o.text AS otext, p.record AS p, p.thread AS pthread, p.text AS ptext
        FROM records r LEFT JOIN texts o ON r.thread = o.record AND r.record <> r.thread
        LEFT JOIN texts p ON r.parent = p.record AND r.parent <> r.thread),
    stated AS (
        SELECT *, CASE WHEN record = thread THEN 'same_as_target' WHEN o IS NULL THEN 'missing' ELSE 'present' END AS opening_status,
            CASE WHEN record = thread OR parent IS NULL THEN 'not_applicable' WHEN parent = thread THEN 'same_as_submission' WHEN p IS NULL THEN 'missing'
                WHEN pthread <> thread THEN 'invalid_relation' ELSE 'present' END AS parent_status
        FROM joined),
    hydrated AS (
        SELECT *, coalesce(opening_status = 'present' AND length(otext) > 160, FALSE) AS opening_cut,
            coalesce(parent_status = 'present' AND length(ptext) > 120, FALSE) AS parent_cut FROM stated)"""

QUERIES = {
    f.__name__: f
    for f in (
        b1_canonical_rows, d12_reason_counts, a4_reject_reasons, d13_sentinels, b11_lexical_hits, b11_lexical_automaton, b11_policy_hits, b12_suppressed_hits, b13_record_exclusion,
        c9_thread_expansion, c10_reply_expansion, g5_merged_evidence, d37_channel_counts, b16_b17_modes_and_buckets, b18_head_tail, b20_render,
        c7_hydrated_context, c8_join_status, b19_context_condition,
    )
}

_HITS = f"SELECT doc_id, {_ids(_low('text'), TERMS)} AS term_ids FROM documents"
SQL = {
    "b1_canonical_rows": f"""WITH {_RAW}, named AS (SELECT *, CASE WHEN kind = 'comment' THEN 't1_' ELSE 't3_' END || record_id AS id FROM judged WHERE reason IS NULL)
        SELECT '1.0.2' AS schema_version, id AS record_id, id AS source_id, kind AS content_type, community AS subreddit, stratum, seconds AS created_utc,
            CAST(year(to_timestamp(seconds) AT TIME ZONE 'UTC') AS INTEGER) AS year, CAST(month(to_timestamp(seconds) AT TIME ZONE 'UTC') AS TINYINT) AS month,
            'unclassified' AS language_status, text, sha256(text) AS text_sha256, CASE WHEN kind = 'comment' THEN link ELSE id END AS submission_id,
            CASE WHEN kind = 'comment' THEN parent END AS parent_id, community || CASE WHEN kind = 'comment' THEN '_comments.zst' ELSE '_submissions.zst' END AS source_file
        FROM named""",
    "d12_reason_counts": f"WITH {_RAW} SELECT kind, coalesce(reason, 'retained') AS reason, count(*) AS n FROM judged GROUP BY ALL",
    "a4_reject_reasons": """WITH lines AS (
            SELECT event_type, CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'view' THEN '[1]' ELSE props END AS line FROM events),
        parsed AS (SELECT *, json_valid(line) AND left(line, 1) = '{' AS ok FROM lines)
        SELECT event_type, CASE WHEN ok THEN 'retained' ELSE 'malformed_json' END AS reason, count(*) AS n,
            CAST(sum(CASE WHEN ok THEN CAST(json_extract(line, '$.k') AS BIGINT) END) AS BIGINT) AS k_sum
        FROM parsed GROUP BY ALL""",
    "d13_sentinels": f"SELECT source, text AS mark, count(*) AS n FROM documents WHERE text IN {MARKS} GROUP BY ALL",
    "b11_lexical_hits": _HITS,
    "b11_lexical_automaton": _HITS,
    "b11_policy_hits": f"""WITH low AS (SELECT doc_id, {_low("text")} AS low FROM documents)
        SELECT doc_id, {_ids("low", tuple(sorted(records.policy_terms(POLICY)[0], key=lambda t: t.term_id)))} AS term_ids FROM low""",
    "b12_suppressed_hits": f"""WITH low AS (SELECT conv_id, turn, {_low("text")} AS low FROM conversations),
        masked AS (SELECT *, {_masked("low", SUPPRESSED[0].unless)} AS m1, {_masked("low", SUPPRESSED[1].unless)} AS m2 FROM low)
        SELECT conv_id, turn, concat_ws(',', CASE WHEN {_hit("m2", "der")} THEN 'de_der' END, CASE WHEN {_hit("m1", "the")} THEN 'en_the' END) AS term_ids FROM masked""",
    "b13_record_exclusion": f"""WITH lines AS (SELECT {_low("l")} AS low FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents))
        SELECT CASE WHEN low IN ('the', 'of the.', 'und') THEN '' ELSE {_ids("low", TERMS[:3])} END AS term_ids, count(*) AS lines FROM lines GROUP BY 1""",
    "c9_thread_expansion": f"WITH {_RECORDS} SELECT record, channel, anchor, depth, terms AS term_ids FROM by_thread",
    "c10_reply_expansion": f"WITH {_RECORDS} SELECT record, channel, anchor, depth, terms AS term_ids FROM by_reply",
    "g5_merged_evidence": f"""WITH {_RECORDS}
        SELECT record, array_to_string(channels, '|') AS channels, array_to_string(evidence, '|') AS evidence,
            CASE WHEN list_contains(channels, 'direct_lexical') THEN 'direct' ELSE 'expanded_only' END AS mode,
            CASE WHEN len(channels) = 1 THEN channels[1] ELSE 'multi_channel' END AS bucket FROM merged""",
    "d37_channel_counts": f"""WITH {_RECORDS}
        SELECT channel, count(*) AS records, count(*) FILTER (WHERE several) AS multi_channel
        FROM (SELECT unnest(channels) AS channel, len(channels) > 1 AS several FROM merged) GROUP BY channel""",
    "b16_b17_modes_and_buckets": f"""WITH {_RECORDS}
        SELECT CASE WHEN list_contains(channels, 'direct_lexical') THEN 'direct' ELSE 'expanded_only' END AS mode,
            CASE WHEN len(channels) = 1 THEN channels[1] ELSE 'multi_channel' END AS bucket, count(*) AS records FROM merged GROUP BY ALL""",
    "b18_head_tail": f"SELECT doc_id, length({_CUT('text', 1200)}) AS n, sha256({_CUT('text', 1200)}) AS cut_sha256, length(text) > 1200 AS truncated FROM documents",
    "b20_render": """WITH shown AS (
            SELECT doc_id, left('source: ' || left(source, 20) || chr(10) || chr(10) || 'lang: ' || left(lang, 10) || chr(10) || chr(10) || 'text: ' || left(text, 900), 700) AS t FROM documents)
        SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM shown""",
    "c7_hydrated_context": f"""WITH {_HYDRATED}
        SELECT record, opening_status, parent_status, sha256(CASE WHEN opening_status = 'present' THEN {_CUT("otext", 160)} ELSE '' END) AS opening_context,
            sha256(CASE WHEN parent_status = 'present' THEN {_CUT("ptext", 120)} ELSE '' END) AS parent_context, opening_cut, parent_cut FROM hydrated""",
    "c8_join_status": f"WITH {_HYDRATED} SELECT opening_status, parent_status, count(*) AS n FROM hydrated GROUP BY ALL",
    "b19_context_condition": f"""WITH {_HYDRATED}, m AS (SELECT opening_status = 'missing' OR parent_status = 'missing' AS missing, opening_cut OR parent_cut AS cut FROM hydrated)
        SELECT CASE WHEN missing AND cut THEN 'missing_and_truncated' WHEN missing THEN 'missing' WHEN cut THEN 'truncated' ELSE 'ordinary' END AS condition, count(*) AS n
        FROM m GROUP BY 1""",
}
