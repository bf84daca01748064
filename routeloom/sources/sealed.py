"""Data sets of many files that can be verified, and that appear as a whole or not at all.

Digests of files are made by executors. They are the leaves of a tree of hashes: files are dealt to
buckets by the hash of their name, a bucket's digest covers its files, and the root covers all
buckets. The manifest holds the root, a table beside the data the leaves; so a changed byte is a
changed leaf, which names its file, and a changed leaf is a changed root.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the tree, as so many hexadecimal digits of a name's hash: 4,096.
DIGITS = 3
#: Rows of a file, at most: a file is held whole by the task that digests it.
FILE_ROWS = 1_000_000
#: Fixed value: the form of the tree, named in manifests.
FORM = "sha256-tree-1"


class ChangedData(ValueError):
    """``problems`` has (file, what is wrong with it), sorted."""

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("the data doesn't match the manifest's SHA-256: " + "; ".join(f"{f} {p}" for f, p in problems[:20]))
        self.problems = problems


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a folder, by their names; or of one file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def root(digests: DataFrame) -> str:
    """The root of the tree over (file, bytes, sha256); what comes to the driver is one digest for each bucket."""
    own = digests.select(F.sha2(F.col("file").cast("binary"), 256).alias("name"), F.concat_ws(":", "file", "bytes", "sha256").alias("leaf"))
    buckets = own.groupBy(F.substring("name", 1, DIGITS).alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("leaf")), "\n").cast("binary"), 256).alias("digest"))
    return buckets.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "digest"))), "\n").cast("binary"), 256).alias("root")).first()["root"]


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()), at


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """A small file with this text in one step: readers see the old one or the new one."""
    staged = f"{path}.{uuid.uuid4().hex}"
    context, at = _filesystem(spark, staged)
    hadoop = spark._jvm.org.apache.hadoop
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    overwrite[0] = hadoop.fs.Options.Rename.OVERWRITE
    context.rename(at, hadoop.fs.Path(path), overwrite)


def seal(rows: DataFrame, folder: str, manifest: dict, file_rows: int = FILE_ROWS) -> str:
    """Write ``rows`` as JSON lines in a new folder below ``folder``, with its digests and manifest, and make it the current one.

    Rows are written by executors, nulls included. The pointer is replaced last, so a failure leaves
    the data set that was current. Returns the path of the new folder.
    """
    spark, path = rows.sparkSession, f"{folder.rstrip('/')}/dataset-{uuid.uuid4().hex[:12]}"
    rows.write.option("maxRecordsPerFile", file_rows).option("ignoreNullFields", "false").option("compression", "none").json(f"{path}/data")
    leaves(spark, f"{path}/data/part-*").write.parquet(f"{path}/digests")
    sealed = {**manifest, "digest_form": FORM, "sha256": root(spark.read.parquet(f"{path}/digests"))}
    _replace(spark, f"{path}/manifest.json", json.dumps(sealed, ensure_ascii=False, indent=2, allow_nan=False) + "\n")
    _replace(spark, f"{folder.rstrip('/')}/CURRENT", path.rsplit("/", 1)[1])
    return path


def current(spark: SparkSession, folder: str) -> str:
    """The path of the data set that is current in a folder."""
    return f"{folder.rstrip('/')}/{spark.read.text(f'{folder}/CURRENT', wholetext=True).first()['value'].strip()}"


def differences(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) of a sealed data set: files that were changed, are missing, or weren't there."""
    kept = spark.read.parquet(f"{path}/digests").withColumnsRenamed({"bytes": "old_bytes", "sha256": "old"})
    both = kept.join(leaves(spark, f"{path}/data/part-*"), "file", "full")
    problem = F.when(F.col("sha256").isNull(), "is missing").when(F.col("old").isNull(), "wasn't there").when((F.col("old") != F.col("sha256")) | (F.col("old_bytes") != F.col("bytes")), "was changed")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest of a sealed data set whose files are those that were written; ChangedData names what isn't."""
    manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()["value"])
    if manifest.get("digest_form") != FORM:
        raise ValueError(f"not a sealed data set: {path}")
    if root(spark.read.parquet(f"{path}/digests")) != manifest["sha256"]:
        raise ChangedData([("digests", "was changed")])
    problems = [(r["file"], r["problem"]) for r in differences(spark, path).orderBy("file").limit(1000).collect()]
    if problems:
        raise ChangedData(problems)
    return manifest
