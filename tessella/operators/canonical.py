"""Raw records to canonical ones, each dropped row with exactly one reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import line_ends

# The study's half-open window and the reasons in the order of their checks.
WINDOW_START, WINDOW_END = "2020-01-01 00:00:00", "2026-01-01 00:00:00"
MALFORMED = "malformed_json"
SCHEMA_VERSION, LANGUAGE_STATUS = "1.0.2", "unclassified"
# A canonical record's columns in order with their types.
RECORD = (
    ("schema_version", "string"), ("record_id", "string"), ("source_id", "string"), ("content_type", "string"), ("subreddit", "string"), ("stratum", "string"),
    ("created_utc", "timestamp"), ("year", "int"), ("month", "tinyint"), ("language_status", "string"), ("text", "string"), ("text_sha256", "string"),
    ("submission_id", "string"), ("parent_id", "string"), ("source_file", "string"),
)
SENTINELS = {"[deleted]": "deleted", "[removed]": "removed"}


def epoch_seconds(value: Column) -> Column:
    """Unix seconds given as text or number; null for what is neither, booleans among them."""
    return F.when(F.lower(value).isin("true", "false"), F.lit(None)).otherwise(value.try_cast("double"))


def instant(seconds: Column) -> Column:
    """The timestamp of Unix seconds, null beyond what a timestamp can hold."""
    return F.when(F.abs(seconds) < 1e11, F.timestamp_micros((seconds * 1000000).cast("long")))


def full_name(value: Column, prefix: str, either: bool = False) -> Column:
    """An id with its kind prefix; null if the id is malformed or has the other kind's prefix."""
    bare = F.lower(F.trim(value))
    kinds = "t[13]_" if either else prefix
    named = F.when(bare.rlike(f"^{kinds}[0-9a-z]+$"), bare)
    return F.coalesce(named, F.when(bare.rlike("^[0-9a-z]+$"), F.concat(F.lit(prefix), bare)))


def kind_of(file: Column) -> Column:
    """Content kind from an archive name."""
    name = F.regexp_extract(file, r"([^/]+)$", 1)
    return F.when(name.rlike(r"_comments\.(zst|jsonl)"), "comment").when(name.rlike(r"_submissions\.(zst|jsonl)"), "submission")


def community_of(file: Column) -> Column:
    """Community from an archive name."""
    return F.nullif(F.regexp_extract(file, r"([^/]+)_(?:comments|submissions)\.(?:zst|jsonl)", 1), F.lit(""))


def with_reasons(raw: DataFrame) -> DataFrame:
    """``raw(record_id, created, community, expected_community, stratum, kind, title, body)`` with canonical columns and a ``reason``.

    The first check that fails gives the reason: malformed, community, stratum, time, text, ids. Kept rows
    have a null reason. A comment's text is its body; a submission's, title and body. Where ``raw`` has them, a
    comment's ``link_id`` and ``parent_id`` become its submission and its parent, which may be of either kind and
    must be valid; a submission is its own and has no parent.
    """
    linked = {"link_id", "parent_id"} <= set(raw.columns)
    given = lambda c: F.col(c) if linked else F.lit(None).cast("string")
    comment = F.col("kind") == "comment"
    # Cleaned once: what is built from these parts names them several times.
    parts = raw.withColumns({"_seconds": epoch_seconds(F.col("created")), "_title": line_ends(F.col("title")), "_body": line_ends(F.col("body"))})
    parts = parts.withColumns({"_title_mark": _mark_of("_title"), "_body_mark": _mark_of("_body"), "created_utc": instant(F.col("_seconds"))})
    shown = lambda c: F.when((F.length(c) > 0) & F.col(f"{c}_mark").isNull(), F.col(c))
    text = F.when(comment, F.when(F.col("_body_mark").isNull(), F.col("_body"))).otherwise(F.concat_ws("\n\n", shown("_title"), shown("_body")))
    record = F.when(comment, full_name(F.col("record_id"), "t1_")).otherwise(full_name(F.col("record_id"), "t3_"))
    parts = parts.withColumns({
        "record": record,
        "text": text,
        "submission": F.when(comment, full_name(given("link_id"), "t3_")).otherwise(record),
        "parent": F.when(comment, full_name(given("parent_id"), "t1_", either=True)),
        "_marks": F.coalesce(F.when(~comment, F.col("_title_mark")), F.col("_body_mark")),
    })
    start, end = F.lit(WINDOW_START).cast("timestamp"), F.lit(WINDOW_END).cast("timestamp")
    when, empty = F.col("created_utc"), F.coalesce(F.length("text"), F.lit(0)) == 0
    unlinked = comment & (F.col("submission").isNull() | F.col("parent").isNull()) if linked else F.lit(False)
    reason = (
        F.when(F.col("malformed"), MALFORMED)
        .when(~F.lower("community").eqNullSafe(F.lower("expected_community")), "community_mismatch")
        .when(F.col("stratum").isNull(), "unknown_stratum")
        .when(F.col("_seconds").isNull() | when.isNull(), "missing_required_field")
        .when((when < start) | (when >= end), "outside_time_window")
        .when(empty & F.col("_marks").isNotNull(), F.col("_marks"))
        .when(empty, "empty_text")
        .when(F.col("record").isNull() | unlinked, "invalid_id")
    )
    return parts.withColumn("reason", reason).drop("_seconds", "_title", "_body", "_title_mark", "_body_mark", "_marks")


def _mark_of(cleaned: str) -> Column:
    """The reason that a cleaned text stands for if it is a sentinel."""
    out = F.lit(None).cast("string")
    for mark, reason in SENTINELS.items():
        out = F.when(F.lower(cleaned) == mark, reason).otherwise(out)
    return out


def canonical(raw: DataFrame) -> DataFrame:
    """The kept rows of ``raw``, which also has ``link_id, parent_id, file``, as canonical records: the columns of ``RECORD``."""
    kept = with_reasons(raw).where(F.col("reason").isNull())
    made = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "record_id": F.col("record"),
        "source_id": F.col("record"),
        "content_type": F.col("kind"),
        "subreddit": F.trim("community"),
        "year": F.year("created_utc"),
        "month": F.month("created_utc"),
        "language_status": F.lit(LANGUAGE_STATUS),
        "text_sha256": F.sha2("text", 256),
        "submission_id": F.col("submission"),
        "parent_id": F.col("parent"),
        "source_file": F.substring_index("file", "/", -1),
    }
    return kept.select(*[made.get(name, F.col(name)).cast(kind).alias(name) for name, kind in RECORD])


def reason_counts(raw: DataFrame, *groups: str) -> DataFrame:
    """Rows per reason, with ``retained`` for kept ones; the counts add up to all rows."""
    named = with_reasons(raw).withColumn("reason", F.coalesce("reason", F.lit("retained")))
    return named.groupBy(*groups, "reason").agg(F.count(F.lit(1)).alias("n"))


def sentinel_counts(rows: DataFrame, text: str, marks: list[str], *groups: str) -> DataFrame:
    """How often each mark is the whole text; the membership test reaches the scan."""
    return rows.where(F.col(text).isin(*marks)).groupBy(*groups, F.col(text).alias("mark")).agg(F.count(F.lit(1)).alias("n"))
