"""Row-wise classifications, hashes, blinding and quarantine."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that no public output may have.
PRIVATE = frozenset({"author", "text", "body", "title", "selftext", "html", "record_id", "source_file"})


def provisional_status(code: Column, confidence: Column, least: float = 0.8) -> Column:
    """Language triage: unsure, provisionally English, or not English."""
    unsure = confidence.isNull() | (confidence < least) | code.isNull() | (code == "und")
    return F.when(unsure, "uncertain").when(code == "en", "provisional_english").otherwise("non_english")


def agreement_bucket(code: Column, confidence: Column, other: Column, other_confidence: Column, least: float = 0.8) -> Column:
    """Two detectors: disagreement, then agreement by the lower confidence."""
    return F.when(~code.eqNullSafe(other), "disagreement").when(F.least(confidence, other_confidence) < least, "low_confidence_agreement").otherwise("high_confidence_agreement")


def chronological_split(year: Column, last_training: int, last_development: int) -> Column:
    return F.when(year <= last_training, "training").when(year <= last_development, "development").otherwise("locked")


def stratum_of(name: Column, strata: dict[str, Sequence[str]]) -> Column:
    """Stratum of a name, whatever its case; null for a name in none."""
    out = F.lit(None).cast("string")
    for stratum, names in strata.items():
        out = F.when(F.lower(name).isin(*[n.lower() for n in names]), stratum).otherwise(out)
    return out


def row_hash(*columns: str) -> Column:
    """SHA-256 of the named fields as canonical JSON, keys in order; nulls stay visible."""
    fields = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(fields, 256)


def pseudonym(prefix: str, salt: str, value: Column, digits: int = 24) -> Column:
    """A salted, truncated id."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(salt), value.cast("string")), 256), 1, digits))


def assert_public(df: DataFrame, private: Iterable[str] = PRIVATE) -> DataFrame:
    """``df`` itself, if no field at any depth has a private name."""
    banned = set(private)

    def names(kind) -> set[str]:
        kind = getattr(kind, "elementType", kind)
        return {f.name for f in getattr(kind, "fields", [])} | {n for f in getattr(kind, "fields", []) for n in names(f.dataType)}

    found = names(df.schema) & banned
    if found:
        raise ValueError(f"private columns in a public output: {sorted(found)}")
    return df


def assert_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """``df`` itself, if its columns are exactly the expected ones in order."""
    if df.columns != list(expected):
        raise ValueError(f"columns are {df.columns}, not {list(expected)}")
    return df


def blinded(rows: DataFrame, key: str, salt: str, public: Sequence[str], private: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A public packet in an order that tells nothing, and the private mapping of its ids."""
    named = rows.withColumn("opaque_id", pseudonym("P", salt, F.col(key)))
    if set(public) & set(private):
        raise ValueError("a column can't be both public and private")
    return named.select("opaque_id", *public), named.select("opaque_id", key, *private)


def quarantine(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``rows`` with the codes of all reasons that hold; an empty list means the row is fine."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])))
