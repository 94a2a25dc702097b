"""What the operators of this subpackage share: tables, scratch tables, byte-exact word splitting."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch of whole texts: a batch of long texts must fit in a Python worker.
TEXT_ROWS_PER_BATCH, TEXT_BYTES_PER_BATCH = 2000, 8 << 20

#: The six bytes between words in `[^\x20\x09-\x0D]+`.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


#: Scratch paths that this process has handed out and that are still there, as far as it knows.
MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, most_bytes: int = TEXT_BYTES_PER_BATCH) -> None:
    """Keep the session's Arrow batches small, in rows and in bytes; a smaller setting stays. A batch holds one row at least."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS_PER_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, most)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share; a temporary folder in local mode where none is configured, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(scratch, "own", None) or tempfile.mkdtemp(prefix="spark-")
        scratch.own = base
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this process. For when the results that read them have been written."""
    drop(spark, MADE)
    MADE.clear()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = java(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of jobs whose tables nothing refers to any more: Spark does so once the driver's
    collectors have run, which on a driver with room to spare may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it: what follows starts from files, not from this lineage. Options are the writer's."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def hashable(df: DataFrame) -> list[str]:
    """The columns of a table that Spark can hash: those without maps and variants."""
    return [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
