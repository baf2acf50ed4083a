"""Word rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: The same characters as bytes, for str.strip and bytes.split.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words_in(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_interval(*columns: Column) -> Column:
    """A reproducible number in [0, 1) drawn from the hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def free_names(rows: DataFrame, *wanted: str) -> list[str]:
    """A column name for each of ``wanted`` that ``rows`` doesn't have, whatever its case."""
    taken = {c.lower() for c in rows.columns}
    found = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
