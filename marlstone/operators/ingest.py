"""Idempotent replacement of documents and chunks, integrity, embeddings, drift between snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: price of a million embedded tokens.
EMBEDDING_PRICE = 0.02


def embedding_cost(tokens: Column) -> Column:
    return F.round(tokens / 1_000_000 * EMBEDDING_PRICE, 6)


def verdicts(incoming: DataFrame, stored: DataFrame, dry_run: bool = False) -> DataFrame:
    """unchanged: the hash is stored under any uri, or came earlier in this batch; replace: the uri is stored; else new.
    In a dry run everything that is not unchanged is called so."""
    seen = stored.select("content_hash").distinct().withColumn("_seen", F.lit(True))
    known = stored.select("source_uri").distinct().withColumn("_known", F.lit(True))
    repeat = F.row_number().over(Window.partitionBy("content_hash").orderBy("source_uri")) > 1
    rows = incoming.withColumn("_repeat", repeat).join(seen, "content_hash", "left").join(known, "source_uri", "left")
    verdict = F.when(F.col("_seen") | F.col("_repeat"), "unchanged").when(F.lit(dry_run), "dry-run").when(F.col("_known"), "replace").otherwise("new")
    return rows.withColumn("verdict", verdict).drop("_seen", "_known", "_repeat")


def replace_by_uri(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored documents without those whose uri comes again changed, and the incoming ones that are new or changed."""
    fresh = verdicts(incoming, stored).where("verdict <> 'unchanged'").drop("verdict")
    return stored.join(fresh.select("source_uri"), "source_uri", "left_anti").unionByName(fresh.select(*stored.columns))


def replace_chunks(stored_chunks: DataFrame, incoming_chunks: DataFrame, stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The same for chunks (source_uri, ...): those of replaced documents go with them, those of new or changed ones come."""
    fresh = verdicts(incoming, stored).where("verdict <> 'unchanged'").select("source_uri").distinct()
    return stored_chunks.join(fresh, "source_uri", "left_anti").unionByName(incoming_chunks.join(fresh, "source_uri", "left_semi").select(*stored_chunks.columns))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """created, deleted or modified by path (path, sha256)."""
    a, b = before.select("path", F.col("sha256").alias("_a")), after.select("path", F.col("sha256").alias("_b"))
    change = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def integrity(documents: DataFrame, chunks: DataFrame, dims: int) -> DataFrame:
    """(rule, n): repeated hashes and ordinals, chunks without a document, vectors of another length, missing texts."""
    count = F.count(F.lit(1)).alias("n")

    def rule(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(count).select(F.lit(name).alias("rule"), "n")

    return (
        rule("hash not unique", documents.groupBy("content_hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        .union(rule("ordinal not unique", chunks.groupBy("document_id", "ordinal").agg(F.count(F.lit(1)).alias("k")).where("k > 1")))
        .union(rule("no document", chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")))
        .union(rule("vector length", chunks.where(F.size("embedding") != dims)))
        .union(rule("text missing", chunks.where("text is null")))
    )


def hash_embedding(text: Column, dims: int) -> Column:
    """Value k is byte k modulo 32 of the text's SHA-256, by 255. For tests and dry runs."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.conv(F.substring(digest, (k % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


#: What a failed call is tried again for.
PASSING = (ConnectionError, TimeoutError)


def _tried(call: Callable, attempts: int, pause: float):
    """The result of a call; after a passing failure it is made again, up to `attempts` times, after twice the pause each time."""
    for turn in range(attempts):
        try:
            return call()
        except PASSING:
            if turn == attempts - 1:
                raise
            time.sleep(pause * 2**turn)


def embed(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], identity: str, batch: int = 128, attempts: int = 3, at_once: int = 4, pause: float = 0.5) -> DataFrame:
    """`rows` with embedding and embedding_model, by calls of up to `batch` texts, of which a task makes `at_once` at the same
    time; vectors stand in the order of the texts. A failed call is made again after a pause that doubles, up to `attempts`
    times in all."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embedding_model", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for part in parts:
                texts = part["text"].tolist()
                calls = [texts[at : at + batch] for at in range(0, len(texts), batch)]
                vectors = [v for found in pool.map(lambda some: _tried(lambda: provider(some), attempts, pause), calls) for v in found]
                yield part.assign(embedding=vectors, embedding_model=identity)

    return rows.mapInPandas(run, schema)


def complete(rows: DataFrame, provider: Callable[[str, str, int], tuple[str, int, int, str]], identity: str, most_tokens: int = 1024, attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """`rows` (system, user, ...) with completion (text, prompt_tokens, completion_tokens, stop) and model, by a call a row.

    The provider is a function of system text, user text and token limit that returns the four parts; whatever calls a
    model goes there. A failed connection is tried again after a pause that doubles."""
    from pyspark.sql import types as T

    parts = T.StructType.fromDDL("text string, prompt_tokens long, completion_tokens long, stop string")
    schema = T.StructType([*rows.schema.fields, T.StructField("completion", parts), T.StructField("model", T.StringType())])

    def call(system: str, user: str):
        return dict(zip(parts.names, _tried(lambda: provider(system, user, most_tokens), attempts, pause)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(completion=[call(s or "", u or "") for s, u in zip(batch["system"], batch["user"])], model=identity)

    return rows.mapInPandas(run, schema)


def embedding_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (text, identity) that the cache does not hold."""
    return texts.select("text", "identity").distinct().join(cache, ["text", "identity"], "left_anti")


def route(content: Column, path: Column) -> Column:
    """The loader of a file by its name and its first 65536 characters; null for none."""
    head = F.substring(content, 1, 65536)
    html = F.lower(path).rlike(r"\.html?$")
    return F.when(F.lower(path).endswith(".pdf"), "pdf").when(html & head.contains("eli-subdivision"), "regulation").when(html & (head.contains("ix:") | F.lower(head).contains("xbrl")), "filing").when(html, "page")


def fetch_quality(files: DataFrame, registry: DataFrame, status: str = "status", content: str = "content") -> DataFrame:
    """Files (filename, status, content) with `quality` by the floor that the registry (filename, min_bytes) sets for each:
    a challenge page, too small, or present; unregistered where it sets none."""
    floors = registry.select("filename", F.col("min_bytes").alias("_floor"))
    blocked = (F.col(status) == 202) | F.substring(content, 1, 4096).contains("awsWaf")
    quality = F.when(F.col("_floor").isNull(), "unregistered").when(blocked, "challenge").when(F.octet_length(content) < F.col("_floor"), "too small").otherwise("present")
    return files.join(floors, "filename", "left").withColumn("quality", quality).drop("_floor")
