"""Observation tables from JSON lines, read strictly, and from verified pairs of data and manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.contracts import OBSERVATION
from routeloom.operators.validation import field_violations, validate_history
from routeloom.sources import sealed

# The keys that a manifest must have.
REQUIRED = ("source_kind", "data_version", "generator_version", "seed", "quality_score_range", "cost_unit", "latency_unit", "coverage_kind", "quality_definition", "sha256")


def _problem(value: Column) -> Column:
    """What is wrong with a line, or null: it must be an object of exactly the columns, texts as texts and numbers as numbers."""
    parsed = F.try_parse_json(value)
    keys = F.json_object_keys(value)
    names = [f.name for f in OBSERVATION]
    problem = F.when(parsed.isNull() | keys.isNull(), "not a JSON object")
    problem = problem.when(F.size(F.array_except(F.array(*[F.lit(n) for n in names]), keys)) > 0, "missing key")
    problem = problem.when(F.size(keys) != len(names), "unknown or repeated key")
    for field in OBSERVATION:
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field.name}", "variant"))
        wanted = kind == "STRING" if field.dataType.simpleString() == "string" else kind.rlike(r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$")
        problem = problem.when(~F.coalesce(wanted, F.lit(False)), f"{field.name} has the wrong type")
    return problem


def first_problem(spark: SparkSession, path: str) -> tuple[str, int, str] | None:
    """(file, line from 1, problem) of the first bad line of one or many files, files in the order of their paths.

    A file may be read in several blocks, and lines have no numbers. Rows of a block are numbered by
    the task that reads it, and the blocks of a file are counted, so a line's number is its place in
    its block and the lines of the blocks before. One aggregate; what is sorted is blocks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    judged = lines.select("file", "start", "row", _problem(F.col("value")).alias("problem"))
    bad = F.min(F.when(F.col("problem").isNotNull(), F.struct("row", "problem"))).alias("bad")
    blocks = judged.groupBy("file", "start").agg(F.count("*").alias("lines"), F.min("row").alias("first"), bad)
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = blocks.withColumn("before", before).where("bad IS NOT NULL").orderBy("file", "start").first()
    return None if found is None else (found["file"], found["before"] + found["bad"]["row"] - found["first"] + 1, found["bad"]["problem"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The observations of JSON lines, in one file or many; the first bad line, with its number from 1 and its file, is an error."""
    found = first_problem(spark, path)
    if found is not None:
        file, number, problem = found
        raise ValueError(f"invalid history at line {number} of {file.rsplit('/', 1)[-1]}: {problem}")
    return spark.read.text(path).select(F.from_json("value", OBSERVATION).alias("row")).select("row.*")


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a JSON lines file, all rules checked."""
    rows = read_lines(spark, path)
    bad = field_violations(rows).orderBy("key").first()
    if bad is not None:
        raise ValueError(f"invalid history: {bad['detail']} of {bad['key']}")
    return validate_history(rows)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A small JSON file through Spark, so that it may be in any store."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def check_manifest(manifest: dict) -> None:
    missing = sorted(set(REQUIRED) - manifest.keys())
    if missing:
        raise ValueError(f"manifest lacks {missing}")
    # What a manifest must say.
    if manifest["source_kind"] != "synthetic" or manifest["coverage_kind"] != "full" or manifest["quality_score_range"] != [0.0, 1.0] or manifest["latency_unit"] != "ms":
        raise ValueError("a synthetic table of full coverage with quality in [0, 1] and latency in ms is needed")


def load_sealed(spark: SparkSession, path: str, model_ids: list[str]) -> tuple[DataFrame, dict]:
    """Observations of a sealed data set whose files are as they were written and which cover every query and model."""
    manifest = sealed.verify(spark, path)
    check_manifest(manifest)
    return validate_history(load_history(spark, f"{path}/data/part-*"), model_ids, full_coverage=True), manifest


def load_verified(spark: SparkSession, data_path: str, manifest_path: str, model_ids: list[str]) -> tuple[DataFrame, dict]:
    """The same of one file (2 GB at most, read by one task) with its manifest, whose digest is that of the file's bytes."""
    manifest = read_manifest(spark, manifest_path)
    check_manifest(manifest)
    if [r["sha256"] for r in sealed.leaves(spark, data_path).collect()] != [manifest["sha256"]]:
        raise ValueError("the data doesn't match the manifest's SHA-256")
    return validate_history(load_history(spark, data_path), model_ids, full_coverage=True), manifest


def load_parquet(spark: SparkSession, path: str, model_ids: list[str] | None = None, full_coverage: bool = False) -> DataFrame:
    """Observations from Parquet, the form for large tables."""
    return validate_history(spark.read.parquet(path).select([F.col(f.name).cast(f.dataType) for f in OBSERVATION]), model_ids, full_coverage)
