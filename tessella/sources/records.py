"""Reading raw records and side inputs, and checking what was read."""

from __future__ import annotations

import json
import re
import time
import tomllib
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.operators.decode import require
from tessella.operators.lexical import Term
from tessella.staging import file_system

CORRUPT = "_corrupt"
#: Bytes of a file that are held at a time.
PIECE = 8 << 20

#: The fields of a raw record that any kind may have; numbers arrive as text and are judged later.
RAW = StructType([StructField(n, StringType()) for n in ("id", "created_utc", "subreddit", "body", "title", "selftext", "link_id", "parent_id")])


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType = RAW) -> DataFrame:
    """JSON lines, plain or compressed (``.zst``, ``.gz``), typed by ``schema`` with file and malformed lines kept.

    A line that isn't a JSON object has ``malformed`` true and null fields; no line is dropped.
    """
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.where(F.length(F.trim("value")) > 0).select("file", parsed.alias("r"))
    return rows.select("file", "r.*").withColumn("malformed", F.col(CORRUPT).isNotNull()).drop(CORRUPT)


def read_manifest(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A JSON manifest ``{total_bytes, files: [{name, bytes, sha256}]}`` as rows, after its checks."""
    schema = "total_bytes BIGINT, files ARRAY<STRUCT<name: STRING, bytes: BIGINT, sha256: STRING>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    rows = whole.select("total_bytes", F.inline("files"))
    summary = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.sum("bytes").alias("bytes"), F.max("total_bytes").alias("declared"),
        F.count_if(~F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("bad"), F.count_if(~F.col("name").rlike(r"_(comments|submissions)\.zst$")).alias("odd"),
    )
    checks = {"unique_names": F.col("n") == F.col("names"), "total": F.col("bytes") == F.col("declared"), "digests": F.col("bad") == 0, "names": F.col("odd") == 0}
    if files is not None:
        checks["count"] = F.col("n") == files
    require(summary, checks)
    return rows.drop("total_bytes")


def bare_path(path: str) -> str:
    """A path without scheme and authority."""
    return re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "", path)


def file_digests(spark: SparkSession, path: str, extension: str = "") -> DataFrame:
    """``(path, bytes, sha256)`` of every file under ``path``, hidden ones left out; a file is read in pieces, whatever its size.

    Listing and reading go through the file system of the path, so both must be reachable from every executor.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}").load(path)
    # One task per file: a file's digest can't be shared out.
    files = found.select("path", F.col("length").alias("bytes")).collect()
    listed = spark.createDataFrame([(r["path"], r["bytes"]) for r in files], "path string, bytes long").repartition(max(1, min(len(files), 10_000)), "path")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                own = sha256()
                system, inner = FileSystem.from_uri(bare_path(name) if name.startswith("file:") else name)
                with system.open_input_stream(inner, compression=None) as stream:
                    while piece := stream.read(PIECE):
                        own.update(piece)
                sums.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])

    return listed.mapInArrow(digest, "path string, bytes long, sha256 string")


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Name, size and digest of landed files against the manifest: ``ok``, ``missing``, ``unexpected`` or ``differs``."""
    found = file_digests(spark, path).select(F.substring_index("path", "/", -1).alias("_name"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    both = manifest.join(found, F.col("name") == F.col("_name"), "full_outer")
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha"))
    status = F.when(F.col("_name").isNull(), "missing").when(F.col("name").isNull(), "unexpected").when(same, "ok").otherwise("differs")
    return both.select(F.coalesce("name", "_name").alias("name"), status.alias("status"))


def policy_digest(policy: dict, field: str = "policy_digest") -> str:
    """SHA-256 of a policy as canonical JSON without its own digest."""
    rest = {k: v for k, v in policy.items() if k != field}
    return sha256(json.dumps(rest, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def read_policy(spark: SparkSession, path: str, required: Sequence[str], digest_field: str | None = None) -> dict:
    """A TOML policy whose top-level keys must be exactly the required ones; with ``digest_field`` its declared digest must hold."""
    policy = tomllib.loads(spark.read.text(path, wholetext=True).first()["value"])
    if set(policy) != set(required):
        raise ValueError(f"policy keys are {sorted(policy)}, not {sorted(required)}")
    if digest_field and policy[digest_field] != policy_digest(policy, digest_field):
        raise ValueError("the policy's declared digest doesn't match its content")
    return policy


def policy_terms(policy: dict) -> tuple[list[Term], list[str]]:
    """Terms with the phrases that suppress them, and the texts that are excluded whole, from a policy's tables.

    ``terms`` have ``id, pattern``; ``ambiguity_rules`` have ``term_ids, phrases``; ``record_exclusion_rules`` have ``texts``.
    """
    unless: dict[str, list[str]] = {}
    for rule in policy.get("ambiguity_rules", []):
        for term in rule["term_ids"]:
            unless.setdefault(term, []).extend(rule["phrases"])
    ids = [t["id"] for t in policy["terms"]]
    if len(set(ids)) != len(ids) or not set(unless) <= set(ids):
        raise ValueError("term ids must be unique and rules must name terms that are there")
    terms = [Term(t["id"], t["pattern"], tuple(unless.get(t["id"], ()))) for t in policy["terms"]]
    return terms, [text for rule in policy.get("record_exclusion_rules", []) for text in rule["texts"]]


def read_sheet(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """A sheet exported as CSV with exactly this header, up to blank rows."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    if rows.columns != list(header):
        raise ValueError(f"the header is {rows.columns}, not {list(header)}")
    filled = F.lit(False)
    for c in header:
        filled = filled | (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    return rows.where(filled)


def _broken_rules(value: Column, rules: dict, name: str) -> list[Column]:
    """What a field's JSON-Schema rules object to: type, const, enum, pattern, minLength, minimum and maximum."""
    kind = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
    plain, quoted = kind, F.startswith(value, F.lit('"'))
    number = plain.try_cast("double")
    is_of = {
        "string": quoted, "integer": ~quoted & plain.rlike(r"^-?\d+$"), "number": ~quoted & number.isNotNull(), "boolean": value.isin("true", "false"),
        "null": value == "null", "object": F.startswith(value, F.lit("{")), "array": F.startswith(value, F.lit("[")),
    }
    holds: dict[str, Column] = {}
    if "type" in rules:
        kinds = [rules["type"]] if isinstance(rules["type"], str) else rules["type"]
        holds["type"] = F.greatest(*[is_of[k] for k in kinds], F.lit(False))
    if "const" in rules:
        holds["const"] = value == json.dumps(rules["const"], ensure_ascii=False)
    if "enum" in rules:
        holds["enum"] = value.isin(*[json.dumps(v, ensure_ascii=False) for v in rules["enum"]])
    if "pattern" in rules:
        holds["pattern"] = ~quoted | plain.rlike(rules["pattern"])
    if "minLength" in rules:
        holds["minLength"] = ~quoted | (F.length(plain) >= rules["minLength"])
    if "minimum" in rules:
        holds["minimum"] = ~is_of["number"] | (number >= rules["minimum"])
    if "maximum" in rules:
        holds["maximum"] = ~is_of["number"] | (number <= rules["maximum"])
    unknown = set(rules) - set(holds) - {"description", "title"}
    if unknown:
        raise ValueError(f"rules that are not checked: {sorted(unknown)}")
    return [F.when(value.isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit(f"{name}: {rule}")) for rule, ok in holds.items()]


def validate_json_lines(spark: SparkSession, path: str, schema: dict) -> DataFrame:
    """Problems of annotation files against a JSON Schema as ``(file, line, problem)``; empty if all is valid.

    Lines count from 1 within their file. A line is blank, malformed (not an object), lacks a required field, has
    one that the schema doesn't allow, or breaks a field's rules; a file without lines is empty. Schemas may use
    ``required``, ``additionalProperties: false`` and the rules of ``_broken_rules``. A file is read as one text.
    """
    whole = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), F.decode("content", "UTF-8").alias("value"))
    # Spark's readers pass over files without a byte, which are a problem here.
    system, at = file_system(spark, path)
    bare = [(f.getPath().getName(), "") for f in system.listStatus(at) if f.isFile() and f.getLen() == 0]
    whole = whole.unionByName(spark.createDataFrame(bare, "file string, value string"))
    ends = F.regexp_replace("value", r"\r?\n$", "")
    lines = whole.select("file", "value", F.posexplode(F.split(ends, r"\r?\n", -1)).alias("at", "text"))
    parsed = lines.select("file", (F.col("at") + 1).alias("line"), "text", F.length("value").alias("size"), F.try_parse_json("text").alias("_v"))
    objects = F.col("_v").isNotNull() & F.startswith(F.ltrim("text"), F.lit("{"))
    listed = parsed.select("*", objects.alias("ok"), F.json_object_keys(F.when(objects, F.col("text"))).alias("keys"))
    has = lambda name: F.array_contains("keys", name)
    value = lambda name: F.to_json(F.try_variant_get("_v", f"$['{name}']", "variant"))
    found = [F.when(~has(name), F.lit(f"{name}: required")) for name in schema.get("required", [])]
    for name, rules in schema.get("properties", {}).items():
        found += _broken_rules(F.when(has(name), F.coalesce(value(name), F.lit("null"))), rules, name)
    if schema.get("additionalProperties") is False:
        extra = F.array_except("keys", F.array(*[F.lit(n) for n in schema.get("properties", {})]))
        found.append(F.when(F.size(extra) > 0, F.concat(F.lit("not allowed: "), F.array_join(F.array_sort(extra), ","))))
    broken = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    problems = (
        F.when(F.col("size") == 0, F.array(F.lit("empty")))
        .when(F.length(F.trim("text")) == 0, F.array(F.lit("blank")))
        .when(~F.coalesce("ok", F.lit(False)), F.array(F.lit("malformed")))
        .otherwise(broken)
    )
    return listed.select("file", F.col("line").cast("long").alias("line"), F.explode(problems).alias("problem"))


def read_partitioned(spark: SparkSession, root: str, schema: StructType, partitions: Sequence[str]) -> DataFrame:
    """A Hive-partitioned table with its exact schema; the path's value of a partition column is the one that counts."""
    rows = spark.read.schema(schema).option("basePath", root).parquet(root)
    if [c for c in rows.columns if c in partitions] != list(partitions):
        raise ValueError(f"partition columns are not {list(partitions)}")
    return rows


def parquet_view(spark: SparkSession, pattern: str, name: str, instant: str = "created_utc") -> DataFrame:
    """The Parquet files that a glob matches as a temporary view, with ``month`` as the first day of the instant's UTC month."""
    rows = spark.read.parquet(pattern).withColumn("month", F.date_format(instant, "yyyy-MM-01"))
    rows.createOrReplaceTempView(name)
    return rows


def register_rows(spark: SparkSession, name: str, rows, schema: StructType | str | None = None) -> DataFrame:
    """Python rows or an Arrow table as a temporary view, to be joined by name."""
    made = spark.createDataFrame(rows, schema) if schema is not None else spark.createDataFrame(rows)
    made.createOrReplaceTempView(name)
    return made


def wire(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` with exactly the columns and types of ``schema``; a null in a field that it declares non-null is an error.

    The result's schema keeps the declarations, which readers of the engine's own files would lose.
    """
    required = [f.name for f in schema.fields if not f.nullable]
    cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = [name for name in required if batch.column(batch.schema.get_field_index(name)).null_count]
            if empty:
                raise ValueError(f"nulls in non-null columns: {empty}")
            yield batch

    return cast.mapInArrow(check, schema)


def signed(value: Column) -> Column:
    """An unsigned 64-bit number, which Parquet readers give as a decimal, as the long with the same bits."""
    wide = value.cast("decimal(20,0)")
    return F.when(wide >= F.lit("9223372036854775808").cast("decimal(20,0)"), wide - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("long")


def unsigned(value: Column) -> Column:
    """A long as the unsigned number with the same bits."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)


def ingest_rate(raw: DataFrame, judge, max_lines: int | None = None) -> dict[str, float]:
    """Lines and seconds of parsing and judging records without keeping anything; ``max_lines`` bounds a quick run."""
    began = time.perf_counter()
    seen = judge(raw.limit(max_lines) if max_lines else raw)
    lines = Observation("ingest")
    seen.observe(lines, F.count(F.lit(1)).alias("lines")).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return {"lines": lines.get["lines"], "seconds": took, "lines_per_second": lines.get["lines"] / took}
