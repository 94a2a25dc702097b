"""Files in and out: raw documents, question sets, measured artifacts, logs, ledgers, manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.ingest import route

LOG_SCHEMA = "ts timestamp, level string, logger string, msg string, request_id string, method string, route string, status int, duration_ms double, verdict string, error_code string"
QUESTION_SCHEMA = "id string, style string, shape string, block int, document string, question string, expected_section_prefix string, label_reason string"


def scan_directory(spark: SparkSession, directory: str, registry: DataFrame | None = None) -> DataFrame:
    """Files that some loader accepts, by name (path, filename, length, content, loader), without those that a registry
    (filename, status) holds as probe candidates."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
    head = F.decode(F.substring("content", 1, 65536), "ISO-8859-1")
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content", route(head, F.col("path")).alias("loader")).where("loader is not null")
    if registry is not None:
        rows = rows.join(registry.where("status = 'probe-candidate'").select("filename"), "filename", "left_anti")
    return rows.orderBy("filename")


def decoded(rows: DataFrame, column: str = "content") -> DataFrame:
    """`rows` with text and encoding: strict UTF-8, else the Windows Western code page, never a replacement.

    Valid UTF-8 is told and decoded by built-in functions; bytes that neither has give a null text."""

    @F.pandas_udf("string")
    def western(content: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else bytes(x).decode("cp1252")
            except UnicodeDecodeError:
                return None

        return content.map(one)

    valid = F.is_valid_utf8(F.col(column).cast("string"))
    other = western(F.when(~valid, F.col(column)))
    text = F.when(valid, F.col(column).cast("string")).otherwise(other)
    return rows.withColumn("text", text).withColumn("encoding", F.when(valid, "utf-8").when(F.col("text").isNotNull(), "cp1252"))


def question_set(spark: SparkSession, path: str, schema: str = QUESTION_SCHEMA) -> DataFrame:
    """One JSON object a line; blank lines are skipped and what is no object is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("q")).select("q.*")


def artifact_cases(spark: SparkSession, path: str, schema: str, cases: str) -> DataFrame:
    """The cases of nested artifacts as rows, with the name of their file."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.input_file_name().alias("artifact"), F.explode(cases).alias("case")).select("artifact", "case.*")


def log_lines(lines: DataFrame) -> DataFrame:
    """Structured log records of a text table or stream (value); a line that is no object keeps its text as msg."""
    parsed = F.from_json("value", LOG_SCHEMA)
    rows = lines.withColumn("_p", parsed)
    return rows.select(*(F.col(f"_p.{c}").alias(c) if c != "msg" else F.coalesce("_p.msg", "value").alias("msg") for c in (x.split()[0] for x in LOG_SCHEMA.split(", "))))


def append_ledger(rows: DataFrame, path: str) -> None:
    """One row a request, by UTC day, so that spend windows read only their days."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def write_manifest(manifest: DataFrame, config: str, path: str) -> None:
    """Reports by document with the run's configuration."""
    manifest.withColumn("config", F.lit(config)).write.mode("overwrite").json(path)


def write_once(artifact: DataFrame, path: str) -> None:
    """A measured artifact: what is there is never overwritten."""
    artifact.write.mode("errorifexists").json(path)


def version_name(number: int) -> str:
    """Names of versions in the order of their numbers."""
    return f"version-{number:012d}"


def replace_corpus(documents: DataFrame, chunks: DataFrame, path: str, version: str) -> None:
    """A new version of documents and chunks side by side; readers follow the newest version whose marker is there, and the
    marker is written last. What a run that broke off left of the version is written over; a complete one never is."""
    spark = documents.sparkSession
    if version in complete_versions(spark, path):
        raise ValueError(f"{version} is complete")
    documents.write.mode("overwrite").parquet(f"{path}/{version}/documents")
    chunks.write.mode("overwrite").parquet(f"{path}/{version}/chunks")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}/{version}/complete")


def complete_versions(spark: SparkSession, path: str) -> list[str]:
    """The versions of a corpus that have been written as a whole, oldest first; on any file system that Spark reads."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "*/complete/_SUCCESS")) or []
    return sorted(f.getPath().getParent().getParent().getName() for f in found)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Documents and chunks of the newest complete version; None before the first."""
    versions = complete_versions(spark, path)
    return (spark.read.parquet(f"{path}/{versions[-1]}/documents"), spark.read.parquet(f"{path}/{versions[-1]}/chunks")) if versions else None
