"""Thread and reply expansion of direct hits, and the merge of their evidence.

A thread is two levels: records of one ``thread`` and the ``parent`` of each. Expansion goes one step and
never recurses, so both are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT, BY_THREAD, BY_REPLY = "direct_lexical", "submission_expansion", "direct_reply_expansion"
EVIDENCE = "channel", "anchor", "depth", "term_ids"


def _evidence(rows: DataFrame, channel: str, anchor: str, depth: int, terms: str) -> DataFrame:
    return rows.select("record", F.lit(channel).alias("channel"), F.col(anchor).alias("anchor"), F.lit(depth).cast("long").alias("depth"), F.col(terms).alias("term_ids"))


def direct_evidence(hits: DataFrame) -> DataFrame:
    """Evidence of the hits themselves, from ``hits(record, term_ids)``."""
    return _evidence(hits.where(F.size("term_ids") > 0), DIRECT, "record", 0, "term_ids")


def thread_expansion(records: DataFrame, hits: DataFrame) -> DataFrame:
    """Replies of a thread whose opening record is a hit; ``records(record, thread, parent)``."""
    anchors = hits.where(F.size("term_ids") > 0).select(F.col("record").alias("anchor"), F.col("term_ids").alias("anchor_terms"))
    replies = records.where(F.col("record") != F.col("thread"))
    return _evidence(replies.join(anchors, F.col("thread") == F.col("anchor")), BY_THREAD, "anchor", 1, "anchor_terms")


def reply_expansion(records: DataFrame, hits: DataFrame) -> DataFrame:
    """Replies to a reply that is a hit; a parent that opens the thread belongs to the other expansion."""
    own = records.where(F.col("record") != F.col("thread")).select("record")
    anchors = hits.where(F.size("term_ids") > 0).join(own, "record", "left_semi").select(F.col("record").alias("anchor"), F.col("term_ids").alias("anchor_terms"))
    return _evidence(records.join(anchors, F.col("parent") == F.col("anchor")), BY_REPLY, "anchor", 1, "anchor_terms")


def merge_evidence(*parts: DataFrame) -> DataFrame:
    """One row per record with its sorted channels and the set of its evidence, sorted."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("record").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.array_sort(F.collect_set(F.struct(*EVIDENCE))).alias("evidence"))
    return merged.withColumn("mode", retrieval_mode(F.col("channels"))).withColumn("bucket", channel_bucket(F.col("channels")))


def retrieval_mode(channels: Column) -> Column:
    return F.when(F.array_contains(channels, DIRECT), "direct").otherwise("expanded_only")


def channel_bucket(channels: Column) -> Column:
    """The only channel, or ``multi_channel``."""
    return F.when(F.size(F.array_distinct(channels)) == 1, F.get(channels, F.lit(0))).otherwise("multi_channel")


def channel_counts(merged: DataFrame) -> DataFrame:
    """Records by channel, with those of several channels apart."""
    by = merged.select(F.explode("channels").alias("channel"), (F.size("channels") > 1).alias("several"))
    return by.groupBy("channel").agg(F.count(F.lit(1)).alias("records"), F.count_if("several").alias("multi_channel"))
