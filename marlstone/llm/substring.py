"""Substring dedup by hashing of lines and sentences.

A unit is what stands up to the next line break or sentence mark, with the marks and white space behind it; units follow
one another without gaps, so they are the text. A unit is normalised (A-Z to lower case, runs of ASCII white space to
one space) and hashed to 128 bits. Over the whole corpus the earliest unit of each digest, in order of document id, text
hash, copy of the row and unit number, is its first occurrence; every other one is a repeat and is removed, whatever its
length. Offsets in the original are kept.

Lines cut at sentences, as passages are often put into the middle of a line. Short sentences are the same by chance or as
a form of words, though, so what the text of a corpus should lose may be less: `passages` are the runs of consecutive
repeats of at least `passage_chars` code points together, given as further columns with the text that is left without them.

Digests meet by partial aggregation, so a line that a third of all documents hold costs each task one row; only digests
that occur twice are joined back. Units are written once to the shared folder, as both steps need them.

Edge cases: a null text is empty; a unit without words is no repeat and stays; a null id ranks first; of rows with the same
id and the same text (or none) one stands for the first, the others lose every unit with a word; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import stored, text_batches, utf8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Units; in SQL without the possessive mark, which changes no match.
UNIT = "[^.!?。！？\n]*+[.!?。！？\n][.!?。！？\x09-\x0d ]*|[^.!?。！？\n]+"
_UNIT = re.compile(UNIT)


def digests(text: str) -> list[tuple[int, int, int]]:
    """Unit number and the two halves of the digest of each unit that has a word."""
    from xxhash import xxh3_128_digest

    out = []
    for k, unit in enumerate(_UNIT.findall(text)):
        words = unit.encode().translate(_LOWER).split()
        if words:
            d = xxh3_128_digest(b" ".join(words))
            out.append((k, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
    return out


def runs_of(units: list[str], repeats: set[int]) -> list[tuple[int, int, int]]:
    """(start, end, units) of each run of consecutive repeats, in code points."""
    runs, at = [], 0
    for k, unit in enumerate(units):
        if k in repeats:
            if k - 1 in repeats:
                runs[-1] = (runs[-1][0], at + len(unit), runs[-1][2] + 1)
            else:
                runs.append((at, at + len(unit), 1))
        at += len(unit)
    return runs


def without(text: str, runs: list[tuple[int, int, int]]) -> str:
    edges = [0, *(x for a, b, _ in runs for x in (a, b)), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def cut(text: str, repeats: set[int] | None, passage_chars: int) -> tuple:
    """The result columns of a text whose units of these numbers are repeats; None for all that have a word."""
    units = _UNIT.findall(text)
    runs = runs_of(units, {k for k, _, _ in digests(text)} if repeats is None else repeats)
    long = [r for r in runs if r[1] - r[0] >= passage_chars]
    spans = lambda some: ",".join(f"{a}-{b}" for a, b, _ in some)
    return len(units), sum(n for *_, n in runs), spans(runs), without(text, runs), len(long), sum(b - a for a, b, _ in long), spans(long), without(text, long)


def _texts(column) -> list[str]:
    return [t.decode("utf-8", "replace") for t in utf8(column)]


def _units(text_col: str):
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            found = [digests(t) for t in _texts(batch.column(names.index(text_col)))]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 3)
            ids = batch.column(names.index("_id")).take(at)
            marks = batch.column(names.index("_mark")).take(at)
            yield pa.RecordBatch.from_arrays([ids, marks, *(pa.array(flat[:, k]) for k in range(3))], ["_id", "_mark", "_unit", "_hi", "_lo"])

    return run


#: What `dedup_units` returns besides the id.
RESULT = "n_units long, n_removed long, removed_spans string, text string, n_passages long, passage_chars long, passage_spans string, text_without_passages string"
#: Rows that leave a worker at once for a row that stands many times.
COPIES = 1000


def _cut(id_col: str, passage_chars: int):
    import pyarrow as pa

    fields = [f.split() for f in RESULT.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[k] for _, k in fields]

    def made(ids, rows):
        columns = zip(*rows) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], [id_col, *(n for n, _ in fields)])

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(1))
            yield made(batch.column(0), [cut(t, set(g or ()), passage_chars) for t, g in zip(texts, batch.column(2).to_pylist())])
            for k, n in enumerate(batch.column(3).to_pylist()):
                again = cut(texts[k], None, passage_chars) if n > 1 else None
                for a in range(1, n, COPIES):
                    some = min(COPIES, n - a)
                    yield made(batch.column(0).take(pa.array([k] * some)), [again] * some)

    return run


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_chars: int = 150) -> DataFrame:
    """One row a document: id, n_units, n_removed (repeated units), removed_spans ("start-end" of each run of them, in code
    points of the original, by commas), text (what stays), n_passages, passage_chars and passage_spans of the long runs, and
    text_without_passages, in which only these are removed."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_mark"))
    units = stored(marked.mapInArrow(_units("_text"), f"_id {kind}, _mark long, _unit long, _hi long, _lo long"), "units")
    place = F.struct("_id", "_mark", "_unit")
    firsts = units.groupBy("_hi", "_lo").agg(F.min(place).alias("_first"), F.max(place).alias("_final")).where("_first <> _final or (_first._id is null) <> (_final._id is null)")
    firsts = stored(firsts.select("_hi", "_lo", "_first"), "unit-firsts")
    repeats = units.join(firsts, ["_hi", "_lo"]).where(~place.eqNullSafe(F.col("_first")))
    gone = repeats.groupBy(F.col("_id").alias("_g"), F.col("_mark").alias("_m")).agg(F.collect_set("_unit").alias("_gone"))
    #: rows of one id and text: one of them for all, with their number
    again = stored(marked.groupBy("_id", "_mark").agg(F.count("*").alias("_copies")).where("_copies > 1").select(F.col("_id").alias("_r"), F.col("_mark").alias("_rm"), "_copies"), "repeated-rows")
    same = F.col("_id").eqNullSafe(F.col("_r")) & (F.col("_mark") == F.col("_rm"))
    rows = marked.withColumn("_copies", F.lit(1).cast("long"))
    if not again.isEmpty():
        one = marked.join(again.drop("_copies"), same, "left_semi").groupBy("_id", "_mark").agg(F.min("_text").alias("_text"), F.count("*").alias("_copies"))
        rows = rows.join(again, same, "left_anti").unionByName(one)
    full = rows.join(gone, F.col("_id").eqNullSafe(F.col("_g")) & (F.col("_mark") == F.col("_m")), "left").select("_id", "_text", "_gone", "_copies")
    return full.mapInArrow(_cut(id_col, passage_chars), f"`{id_col}` {kind}, {RESULT}")
