"""Raw completions to verdicts, clean text and resolved citations.

All of it is string and array functions over (request_id, raw); lists of retrieved chunks join by request and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a line that is a verdict says, and the verdict it stands for.
TOKENS = {"ANSWERED": "answered", "INSUFFICIENT_EVIDENCE": "insufficient_evidence"}
LONGEST_HEADER = 200
MARKER = r"\[(\d{1,6})\]"


def verdict_of(line: Column) -> Column:
    out = None
    for token, verdict in TOKENS.items():
        out = F.when(F.trim(line) == token, verdict) if out is None else out.when(F.trim(line) == token, verdict)
    return out


def parsed(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """provisional (first line), trailing (last line that is a token), verdict, reconciled, and the body's lines.

    A first line that is no token is an error whose text stays; a completion of one line has no text at all."""
    text = F.col(raw)
    has_break = F.instr(text, "\n") > 0
    first = F.substring_index(text, "\n", 1)
    header = F.coalesce(F.when(has_break & (F.length(first) <= LONGEST_HEADER), verdict_of(first)), F.lit("error"))
    body = F.when(has_break, F.expr(f"substring({raw}, instr({raw}, '\n') + 1)")).otherwise("")
    body = F.when(has_break & (F.length(first) > LONGEST_HEADER), text).otherwise(body)
    out = rows.withColumn("provisional", header).withColumn("_lines", F.split(body, "\n", -1))
    token = lambda x: F.trim(x).isin(*TOKENS)
    out = out.withColumn("_tokens", F.filter("_lines", token)).withColumn("_kept", F.filter("_lines", lambda x: ~token(x)))
    out = out.withColumn("trailing", F.when(F.size("_tokens") > 0, verdict_of(F.element_at("_tokens", -1))))
    out = out.withColumn("verdict", F.coalesce("trailing", "provisional"))
    return out.withColumn("reconciled", F.col("trailing").isNotNull() & (F.col("trailing") != F.col("provisional")))


def markers(rows: DataFrame) -> DataFrame:
    """(request_id, place, marker) of each [n] of one to six digits in the kept lines, in order."""
    found = F.regexp_extract_all(F.array_join("_kept", "\n"), F.lit(MARKER), F.lit(1))
    return rows.select("request_id", F.posexplode(found).alias("place", "_m")).select("request_id", F.col("place").cast("long").alias("place"), F.col("_m").cast("long").alias("marker"))


def citations(found: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Markers that name a retrieved rank, once each, in order of first appearance, with the chunk of that rank."""
    first = found.groupBy("request_id", "marker").agg(F.min("place").alias("_p"))
    hit = first.join(retrieved, (first["request_id"] == retrieved["request_id"]) & (first["marker"] == retrieved["rank"])).select(first["request_id"], "marker", "_p", "chunk_id", "doc_type")
    order = Window.partitionBy("request_id").orderBy("_p")
    return hit.withColumn("position", F.row_number().over(order).cast("long")).select("request_id", "position", "marker", "chunk_id", F.coalesce("doc_type", F.lit("")).alias("doc_type"))


def clean_text(n_retrieved: Column) -> Column:
    """The kept lines without markers beyond the retrieved ranks; `[0]` and others out of range go."""
    text = F.array_join("_kept", "\n")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)))
    bad = F.filter(found, lambda m: ~m.cast("long").between(F.lit(1), n_retrieved))
    return F.aggregate(bad, text, lambda t, m: F.replace(t, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))


def stop_verdict(stop: Column, usage: Column, verdict: Column) -> Column:
    """A refusal by the provider, a cut by length, then what the text says; an answer without usage was cut off."""
    return F.when(stop == "refusal", "provider_refused").when(stop == "max_tokens", "truncated").when(~usage & (verdict == "answered"), "truncated").otherwise(verdict)
