"""Normalising lines and pages, assembling sections, cutting chunks. All by functions, windows and joins; the chunk fold is a grouped function."""

from __future__ import annotations

import bisect
import collections

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dehyphenate(text: Column) -> Column:
    """Join words that a line break parts after a hyphen; letters of all scripts count."""
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def nfkc(text: Column) -> Column:
    """Compatibility composition, which has no built-in function."""

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        from unicodedata import normalize

        return texts.map(lambda t: None if t is None else normalize("NFKC", t))

    return compose(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def normalize_lines(text: Column) -> Column:
    """Lines collapsed, empty ones dropped."""
    lines = F.transform(F.split(text, "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_furniture(lines: DataFrame) -> DataFrame:
    """Lines (doc, page, line_no, text) without the modal first and last line of the pages where it stands on over half of
    them, blank pages counted, and without bare numbers of up to three digits. Ties of the mode: seen first."""
    pages = lines.groupBy("doc", "page").agg(
        F.min_by("text", F.when(F.col("text") != "", F.col("line_no"))).alias("first"), F.max_by("text", F.when(F.col("text") != "", F.col("line_no"))).alias("last")
    )
    total = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"))

    def modal(edge: str) -> DataFrame:
        seen = pages.where(F.col(edge).isNotNull()).groupBy("doc", F.col(edge).alias("text")).agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("since"))
        best = seen.groupBy("doc").agg(F.max_by("text", F.struct("n", -F.col("since"))).alias("text"), F.max("n").alias("n"))
        return best.join(total, "doc").where("2 * n > pages").select("doc", "text")

    gone = modal("first").union(modal("last")).distinct()
    return lines.join(gone, ["doc", "text"], "left_anti").where(~F.col("text").rlike(r"^\s*\d{1,3}\s*$"))


def heading_key(text: Column) -> Column:
    """The number of an item heading; empty for other text."""
    return F.upper(F.regexp_extract(text, r"(?i)^Item\s+(\d+[A-C]?)\.", 1))


def last_headings(blocks: DataFrame, longest: int = 120) -> DataFrame:
    """The last block of each item heading by document: (doc, key, block_no)."""
    return blocks.where(F.length("text") <= longest).withColumn("key", heading_key(F.col("text"))).where("key <> ''").groupBy("doc", "key").agg(F.max("block_no").alias("block_no"))


def is_subheading(text: Column, bold_only: Column, shortest: int = 5, longest: int = 90) -> Column:
    """A block of a few words that is one bold span as a whole."""
    return bold_only & F.length(F.trim(text)).between(shortest, longest)


def assemble_sections(blocks: DataFrame, is_heading: Column) -> DataFrame:
    """Bodies under the heading before them; what stands before the first heading goes, as do headings without a body."""
    w = Window.partitionBy("doc").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumn("_h", is_heading).withColumn("section", F.sum(F.when(F.col("_h"), 1).otherwise(0)).over(w)).withColumn("heading", F.last(F.when(F.col("_h"), F.col("text")), ignorenulls=True).over(w))
    body = rows.where("section > 0 and not _h")
    text = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    return body.groupBy("doc", "section", "heading").agg(F.array_join(text, "\n").alias("body"))


def asof_context(blocks: DataFrame, chapter: Column, section: Column) -> DataFrame:
    """The nearest chapter before each block, and the nearest section since that chapter."""
    upto = lambda *by: Window.partitionBy(*by).orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumn("_c", chapter).withColumn("_s", section).withColumn("_n", F.sum(F.when(F.col("_c").isNotNull(), 1).otherwise(0)).over(upto("doc")))
    return rows.withColumn("chapter", F.last("_c", ignorenulls=True).over(upto("doc"))).withColumn("in_section", F.last("_s", ignorenulls=True).over(upto("doc", "_n"))).drop("_c", "_s", "_n")


def capital(letter: Column) -> Column:
    """One letter as one capital: a letter whose capital is spelt with several (ß as SS) has its own single one or stays."""
    return F.when(F.length(F.upper(letter)) == F.length(letter), F.upper(letter)).when(letter == "ß", "ẞ").when(F.length(F.initcap(letter)) == F.length(letter), F.initcap(letter)).otherwise(letter)


def small(text: Column) -> Column:
    """Each letter as one small letter, wherever it stands in a word."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def sentences(text: Column) -> Column:
    """Lines are hard ends; within a line a sentence ends at . ! or ? before white space."""
    per_line = F.transform(F.split(text, "\n"), lambda line: F.split(line, r"(?<=[.!?])\s+"))
    return F.filter(F.transform(F.flatten(per_line), lambda s: F.trim(s)), lambda s: s != "")


def token_count(text: Column) -> Column:
    """Words and marks; a stand-in for a model's own counter."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")).cast("long")


def common_path(a: Column, b: Column, separator: str = " › ") -> Column:
    """Common ancestors of two paths (arrays), then both leaves."""
    n = F.aggregate(F.zip_with(a, b, lambda x, y: x == y), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, same: F.struct((s["on"] & F.coalesce(same, F.lit(False))).alias("on"), F.when(s["on"] & F.coalesce(same, F.lit(False)), s["n"] + 1).otherwise(s["n"]).alias("n")), lambda s: s["n"])
    label = F.concat_ws(" – ", F.element_at(a, -1), F.element_at(b, -1))
    return F.when(a == b, F.array_join(a, separator)).otherwise(F.concat_ws(separator, F.concat(F.slice(a, F.lit(1), n), F.array(label))))


def locate_headings(outline: DataFrame, lines: DataFrame, widest: int = 3) -> DataFrame:
    """The first run of one to `widest` lines that spells each title, numbered or not, at or after its page and never before
    the end of the heading before it: (doc, entry_no, start, end), in line positions.

    outline: doc, entry_no, title, page_no; lines: doc, page_no, line_no (positions in the document), text. The floor is a
    sequence over a document's entries, so a document is a group; its lines come along only once."""

    def plain(value: str) -> str:
        return " ".join(str(value).split()).casefold()

    def find(titles: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        texts, pages = [plain(t) for t in rows["text"]], rows["page_no"].tolist()
        floor, out = 0, []
        #: the places (start, width) of every run of lines, by what it spells with and without its number
        spelt = collections.defaultdict(list)
        for k in range(len(texts)):
            for width in range(1, widest + 1):
                run = " ".join(t for t in texts[k : k + width] if t)
                for key in {run, run.lstrip("0123456789. ")}:
                    spelt[key].append((k, width))
        for entry in titles.sort_values("entry_no").itertuples():
            at = max(floor, bisect.bisect_left(pages, entry.page_no))
            places = spelt.get(plain(entry.title), [])
            first = bisect.bisect_left(places, (at, 0))
            hit = (places[first][0], sum(places[first])) if first < len(places) else None
            if hit:
                floor = hit[1]
                out.append((entry.doc, entry.entry_no, *hit))
        return pd.DataFrame(out, columns=["doc", "entry_no", "start", "end"])

    return outline.groupBy("doc").cogroup(lines.groupBy("doc")).applyInPandas(find, "doc long, entry_no long, start long, end long")
