"""Writing tables with receipts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.ranks import positions, shard_of
from tessella.operators.triage import assert_public
from tessella.sources.records import bare_path, file_digests
from tessella.staging import file_system


def write_partitioned(rows: DataFrame, path: str, partitions: Sequence[str], files_per_partition: int = 1) -> None:
    """Zstandard Parquet by partition columns; rows are dealt first so that a partition isn't spread over all tasks.

    A large partition gets several files by a hash of the row, so it doesn't meet in one task.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(files_per_partition))
    dealt = rows.repartition(*[F.col(c) for c in partitions], salt)
    dealt.write.mode("errorifexists").partitionBy(*partitions).option("compression", "zstd").parquet(path)


def write_split(judged: DataFrame, kept: str, rejects: str, reason: str = "reason") -> None:
    """Rows without a reason to one table, the others' ids and reasons to another."""
    judged.where(F.col(reason).isNull()).drop(reason).write.mode("errorifexists").option("compression", "zstd").parquet(kept)
    judged.where(F.col(reason).isNotNull()).select("record_id", "file", reason).write.mode("errorifexists").parquet(rejects)


def receipt(judged: DataFrame, group: str, reason: str = "reason") -> DataFrame:
    """Per group: physical, retained and excluded rows and the count of each reason; physical is always their sum."""
    counted = judged.groupBy(group, F.coalesce(reason, F.lit("")).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("_r", "_n")), lambda e: e["_r"] != "")))
    return counted.groupBy(group).agg(
        F.sum("_n").alias("physical"),
        F.sum(F.when(F.col("_r") == "", F.col("_n")).otherwise(0)).alias("retained"),
        F.sum(F.when(F.col("_r") != "", F.col("_n")).otherwise(0)).alias("excluded"),
        entries.alias("reasons"),
    )


def rollup_receipts(receipts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Receipts of many sources added up by ``by``, the maps of reasons merged."""
    flat = receipts.select(*by, "physical", "retained", "excluded", "reasons")
    sums = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("sources"), *[F.sum(c).alias(c) for c in ("physical", "retained", "excluded")])
    each = flat.select(*by, F.explode("reasons").alias("reason", "n")).groupBy(*by, "reason").agg(F.sum("n").alias("n"))
    merged = each.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return sums.join(merged, same, "left").drop(*[f"_{b}" for b in by])


def _files(spark: SparkSession, path: str) -> list[dict]:
    """Relative name, bytes and digest of each data file, in order of names."""
    found = file_digests(spark, path, ".parquet").collect()
    root = bare_path(path).rstrip("/") + "/"
    return sorted(({"name": bare_path(r["path"]).removeprefix(root), "bytes": r["bytes"], "sha256": r["sha256"]} for r in found), key=lambda f: f["name"])


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    system, at = file_system(spark, path)
    out = system.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    """Of a small file; Spark's readers pass over names with an underscore."""
    system, at = file_system(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(rows: DataFrame, path: str, partitions: Sequence[str], expected: int, about: dict | None = None) -> dict:
    """Write ``rows`` beside ``path``, check them, and only then give them the name: readers see all of a table or nothing.

    ``expected`` rows must have been written. The receipt, which is returned and stored as ``_receipt.json``, has the
    number of rows, every file with its bytes and SHA-256, and what ``about`` adds.
    """
    spark = rows.sparkSession
    system, final = file_system(spark, path)
    if system.exists(final):
        raise ValueError(f"{path} has been published before")
    staging = f"{path.rstrip('/')}.staging-{uuid4().hex}"
    write_partitioned(rows, staging, partitions)
    try:
        written = spark.read.parquet(staging).count()
        if written != expected:
            raise ValueError(f"{written} rows were written, not {expected}")
        receipt = {**(about or {}), "rows": written, "files": _files(spark, staging)}
        _write_text(spark, f"{staging}/_receipt.json", json.dumps(receipt, sort_keys=True))
        if not system.rename(file_system(spark, staging)[1], final):
            raise ValueError(f"{path} could not be named")
    except Exception:
        system.delete(file_system(spark, staging)[1], True)
        raise
    return receipt


def verify_published(spark: SparkSession, path: str, forbidden: Sequence[str] = ()) -> dict:
    """The receipt of a published table, if its files are exactly the receipt's, bit by bit, and its rows as many.

    No column may have a ``forbidden`` name.
    """
    receipt = json.loads(_read_text(spark, f"{path}/_receipt.json"))
    found = _files(spark, path)
    if found != receipt["files"]:
        differing = {f["name"] for f in found if f not in receipt["files"]} | {f["name"] for f in receipt["files"] if f not in found}
        raise ValueError(f"files differ from the receipt: {sorted(differing)}")
    rows = spark.read.option("basePath", path).parquet(path)
    if set(rows.columns) & set(forbidden):
        raise ValueError(f"columns that must not be there: {sorted(set(rows.columns) & set(forbidden))}")
    if rows.count() != receipt["rows"]:
        raise ValueError("the number of rows differs from the receipt")
    return receipt


def export_public(rows: DataFrame, path: str, predecessor: DataFrame | None = None) -> dict:
    """Publish a table without private names; columns it shares with its predecessor must be unchanged, row by row."""
    from tessella.operators.enrich import unchanged

    assert_public(rows)
    if predecessor is not None:
        shared = [c for c in predecessor.columns if c in rows.columns]
        lost, gained = unchanged(predecessor, rows, shared).first()
        if lost or gained:
            raise ValueError(f"{lost} rows of the predecessor are gone and {gained} are new")
    return publish(rows, path, [], rows.count(), {"columns": rows.columns})


def write_shards(rows: DataFrame, path: str, key: str, shards: int) -> None:
    """Parquet in contiguous shards of near-equal size by the order of ``key``, a folder each, with explicit positions."""
    placed = positions(rows, key)
    placed.withColumn("shard", shard_of(F.col("position"), rows.count(), shards)).repartition("shard").sortWithinPartitions("shard", "position").write.mode(
        "errorifexists"
    ).partitionBy("shard").option("compression", "zstd").parquet(path)


def write_public(rows: DataFrame, path: str) -> None:
    """Parquet of a table whose schema has no private name."""
    assert_public(rows).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    rows.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_sorted(rows: DataFrame, path: str, key: str, row_group: int = 128 << 20) -> None:
    """Parquet ranged and sorted by a key, so that readers can skip row groups."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", row_group).parquet(path)
