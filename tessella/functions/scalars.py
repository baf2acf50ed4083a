"""Scalar expressions that several operators share."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rounded(value: Column, digits: int = 6) -> Column:
    """Computed doubles are rounded so that engines agree whatever their order of summation."""
    return F.round(value, digits)


def stripped(text: Column) -> Column:
    """Unicode white space gone from both ends, as Python's ``strip`` does; ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def line_ends(text: Column) -> Column:
    """CRLF and CR become LF, then the ends are stripped."""
    return stripped(F.regexp_replace(text, r"\r\n?", "\n"))


def surface(text: Column) -> Column:
    """The normalised surface: lower case, runs of white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def casefolded(text: Column) -> Column:
    """Full Unicode case folding, so that the sharp s is ss and a final sigma a sigma; without a UDF.

    Lower case of upper case, with what that leaves apart. Equal to Python's ``casefold`` for every code point of one
    Unicode version but the dotless i, which becomes i, and Cherokee, which folds to its small letters (``fold_phrase`` does the same).
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    # The inner translations also keep the optimiser from merging the two case mappings into one.
    upper = F.translate(F.upper(F.translate(text, "\u1e9e", "\u00df")), "\u0345", "\u0399")
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(F.lower(upper), "\u03c2", "\u03c3"))


def fold_phrase(phrase: str) -> str:
    """``casefolded`` for a phrase given in code."""
    return phrase.casefold().lower()


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode normal form KC. ASCII texts are in it already and never leave the JVM; the others go in Arrow batches."""
    other = F.octet_length(text) != F.char_length(text)
    return F.coalesce(_compatible(F.when(other, text)), text)


def folded_surface(text: Column) -> Column:
    """Compatible characters as one, case folded, runs of Unicode white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(casefolded(nfkc(text)), r"(?U)\s+", " "))


def seeded_hash(seed: str, *parts: Column) -> Column:
    """Hex SHA-256 of the seed and the parts, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def tuple_hash(*parts: Column) -> Column:
    """Hex SHA-256 of the parts as a canonical JSON array of strings."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def first_uint64(digest: Column) -> Column:
    """The first eight bytes of a hex digest as an unsigned number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def signed64(digest: Column) -> Column:
    """The same eight bytes as the bit pattern of a signed long."""
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def head_tail(text: Column, limit: int, marker: str) -> Column:
    """At most ``limit`` code points: the larger half of the budget from the front, the rest from the back."""
    budget = limit - len(marker)
    head, tail = (budget + 1) // 2, budget // 2
    cut = F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array, the largest score subtracted first."""
    shifted = F.transform(scores, lambda x: F.exp((x - F.array_max(scores)) / F.lit(temperature)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def first_argmax(values: Column) -> Column:
    """Zero-based place of the largest value; the first one wins ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def binary_entropy(p: Column) -> Column:
    """Entropy of a coin in bits; 0 at the ends."""
    inner = -(p * F.ln(p) + (1 - p) * F.ln(1 - p)) / F.ln(F.lit(2.0))
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(inner)


def entropy(distribution: Column) -> Column:
    """Entropy of a distribution divided by the log of its width; null if a part is null."""
    terms = F.aggregate(distribution, F.lit(0.0), lambda a, x: a + F.when(x <= 0, 0.0).otherwise(x * F.ln(x)))
    return -terms / F.ln(F.size(distribution))


def jensen_shannon(distributions: Column) -> Column:
    """Jensen-Shannon divergence of an array of distributions over its largest possible value.

    A part so small that its mean underflows to zero adds nothing.
    """
    n, width = F.size(distributions), F.size(F.get(distributions, F.lit(0)))
    means = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda k: F.aggregate(distributions, F.lit(0.0), lambda a, d: a + F.get(d, k)) / n,
    )
    one = lambda d: F.aggregate(
        F.zip_with(d, means, lambda x, m: F.when((x > 0) & (m > 0), x * F.ln(x / m)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x
    )
    total = F.aggregate(distributions, F.lit(0.0), lambda a, d: a + one(d))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / n / F.ln(F.least(n, width))))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
