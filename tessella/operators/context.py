"""Bounded context of records: their thread's opening text and their parent's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import head_tail

MARKER = "\n[...]\n"


def hydrate(records: DataFrame, texts: DataFrame, opening_limit: int, parent_limit: int) -> DataFrame:
    """``records(record, thread, parent, text)`` with bounded texts of thread and parent and how each join went.

    ``texts(record, thread, text)`` may lack records: that is ``missing``. A parent in another thread is
    ``invalid_relation``; an opening record has no thread context, and a parent that opens the thread is
    ``same_as_submission``.
    """
    opening = texts.select(F.col("record").alias("o"), F.col("text").alias("opening_text"))
    parent = texts.select(F.col("record").alias("p"), F.col("thread").alias("p_thread"), F.col("text").alias("parent_raw"))
    opens = F.col("record") == F.col("thread")
    joined = records.join(opening, (F.col("thread") == F.col("o")) & ~opens, "left").join(
        parent, (F.col("parent") == F.col("p")) & (F.col("parent") != F.col("thread")), "left"
    )
    opening_status = F.when(opens, "same_as_target").when(F.col("o").isNull(), "missing").otherwise("present")
    parent_status = (
        F.when(opens | F.col("parent").isNull(), "not_applicable")
        .when(F.col("parent") == F.col("thread"), "same_as_submission")
        .when(F.col("p").isNull(), "missing")
        .when(F.col("p_thread") != F.col("thread"), "invalid_relation")
        .otherwise("present")
    )
    return joined.select(
        *records.columns,
        opening_status.alias("opening_status"),
        parent_status.alias("parent_status"),
        F.when(opening_status == "present", head_tail(F.col("opening_text"), opening_limit, MARKER)).alias("opening_context"),
        F.when(parent_status == "present", head_tail(F.col("parent_raw"), parent_limit, MARKER)).alias("parent_context"),
        F.coalesce((opening_status == "present") & (F.length("opening_text") > opening_limit), F.lit(False)).alias("opening_cut"),
        F.coalesce((parent_status == "present") & (F.length("parent_raw") > parent_limit), F.lit(False)).alias("parent_cut"),
    )


def condition(row_missing: Column, row_cut: Column) -> Column:
    """One word for what happened to a record's context."""
    return F.when(row_missing & row_cut, "missing_and_truncated").when(row_missing, "missing").when(row_cut, "truncated").otherwise("ordinary")


def render(parts: Sequence[tuple[str, str, int]], total: int, separator: str = "\n\n") -> Column:
    """Labelled parts (label, column, limit) joined in order under a running budget of ``total`` code points."""
    pieces = [F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), F.left(F.col(c), F.lit(limit)))) for label, c, limit in parts]
    return F.left(F.concat_ws(separator, *pieces), F.lit(total))
