"""From raw documents to token files: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; `run` writes each result as
Parquet in the folder that all executors share and reads it as the next stage's documents. All stages but the last
return the columns of documents.

Edge cases: rows without text fail the base test and go in the first stage; repeated rows are one document in
near_duplicates, rows of one id (or none) with different texts are several; empty tables give an empty result; an empty
benchmark hits nothing; further columns pass through up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import MADE, drop, release, scratch, table, text_batches
from marlstone.llm.decontaminate import decontaminated
from marlstone.llm.jaccard import one_per_component
from marlstone.llm.mixing import mixed_documents
from marlstone.llm.quality import filter_quality
from marlstone.llm.tokens import read_token_files, token_index, write_token_files


#: Stages run in the same executors and workers, which keep the memory that one of them took. An Arrow batch is several
#: buffers of up to twice its size on either side, and the ids that a worker remembers stay until it ends.
BATCH_BYTES, REMEMBERED = 2 << 20, 120_000

#: Scratch tables of the stage before: its result has been written by the time that the next stage begins.
_LEFT: list[str] = []


def _stage(run):
    """Drop what the stage before left in the shared folder and on executors, and note what this one leaves; batches are small."""

    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _LEFT)
        _LEFT.clear()
        release(spark)
        text_batches(spark, BATCH_BYTES)
        before = len(MADE)
        out = run(spark, docs, sf_dir)
        _LEFT.extend(MADE[before:])
        del MADE[before:]
        return out

    staged.__name__, staged.__doc__ = run.__name__, run.__doc__
    return staged


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules call good and that pass the base test."""
    return filter_quality(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by 0.8 of their five-word shingles."""
    return one_per_component(docs, n=5, percent=80)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark passages are cut from the others."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


@_stage
def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixed_documents(docs)


@_stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = scratch(spark, "pipeline-tokens")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, remembered=REMEMBERED)
    return token_index(read_token_files(spark, path))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_to_weights", mix_to_weights),
    ("token_files", token_files),
]

#: Expectation-maximisation and the tokenizer are no SQL; tests run the stages over planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
