"""Mixing sources to target weights by hash thresholds.

A document's place in its source's order is a 60-bit hash of its id and text. Words are summed by source and the first 12 bits;
the bucket in which a source's budget ends is summed again by 24 bits, and what is left of it by whole hashes. The hash
where a budget ends is the threshold: a filter against it takes the documents, and nothing is sorted. Thresholds are
nested: a smaller budget takes a subset of a larger one's documents.

A target of more than the source's size takes every document once and the part beyond by threshold. The document on the
boundary is taken where that brings the sum nearer to the target. Exact repeats (of id and text) share a hash; where the
boundary falls among them, they are counted, and as many of them are taken as bring the sum nearest.

Edge cases: a null text has no words and is taken as 0; a null source is a source of its own, the last one; rows of one id
or of none that differ in text have different hashes; in `mixed_documents` the repeats on a boundary all have the further
columns of one of them; a source without words has the target 0; an empty table gives an empty result; columns of the
same names as results are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import hashable, stored

_KEY = ["_none", "_src"]
_BITS, _LEVELS = 60, (12, 24, 60)
#: Copies of a row that one task makes at once.
_AT_ONCE = 10_000


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """Id, source, size in words and hash of every row, and `more`."""
    digest = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).isNull().alias("_none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"),
        F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("_size"),
        F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long").alias("_hash"),
        *more,
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share_percent: int = 150, most: int = 2) -> DataFrame:
    """`sources` (_none, _src, _total) with _target: `share_percent` of all words shared by weight, none above `most` times a source's words.

    The weights repeat over the sources in code point order, null last. Sources are capped in ascending order of cap per
    weight until the share of the next is within its cap; that is where resharing the excess ends. One row a source goes
    through one task here, never a row a document."""
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every.orderBy("_none", "_src")) - 1) % len(weights) + 1).cast("int"))
    exact = lambda c: c.cast("decimal(38,0)")
    rows = sources.withColumn("_w", w).withColumn("_all", F.sum("_total").over(every))
    ranked = every.orderBy(F.col("_total") / F.col("_w"), "_none", "_src")
    rows = (
        rows.withColumn("_rank", F.row_number().over(ranked))
        .withColumn("_capped", most * (F.sum("_total").over(ranked.rowsBetween(Window.unboundedPreceding, -1))))
        .withColumn("_capped", F.coalesce("_capped", F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(ranked.rowsBetween(0, Window.unboundedFollowing)))
    )
    left = exact(F.lit(share_percent)) * exact(F.col("_all")) - 100 * exact(F.col("_capped"))
    rows = rows.withColumn("_above", exact(F.col("_w")) * left > exact(F.lit(100 * most)) * exact(F.col("_total")) * exact(F.col("_weights")))
    first = F.min(F.when(~F.col("_above"), F.struct("_rank", "_capped", "_weights"))).over(every)
    rows = rows.withColumn("_first", first)
    rest = F.col("_w") * (F.lit(share_percent / 100) * F.col("_all") - F.col("_first._capped")) / F.col("_first._weights")
    is_free = F.col("_first").isNotNull() & (F.col("_rank") >= F.col("_first._rank"))
    return rows.select(*_KEY, "_total", F.when(is_free, rest).otherwise((most * F.col("_total")).cast("double")).alias("_target"))


def thresholds(rows: DataFrame, budgets: DataFrame, budget_col: str) -> DataFrame:
    """For each source of `budgets` the hash at which its budget ends (_edge), rows of smaller hashes being taken, and the
    words that are left for the rows of just this hash (_room); no row for a budget that holds all.

    Each level sums only the bucket in which the budget ended one level above."""
    ended = budgets.select(*_KEY, F.col(budget_col).alias("_budget"), F.lit(0).cast("long").alias("_bucket"), F.lit(0).cast("long").alias("_before"))
    done = 0
    for bits in _LEVELS:
        bucket = lambda b: F.shiftright("_hash", _BITS - b)
        within = rows if not done else rows.join(ended.select(*_KEY, F.col("_bucket").alias("_at")), _KEY).where(bucket(done) == F.col("_at"))
        sums = within.groupBy(*_KEY, bucket(bits).alias("_bucket")).agg(F.sum("_size").alias("_words"))
        order = Window.partitionBy(*_KEY).orderBy("_bucket")
        summed = sums.join(ended.select(*_KEY, "_budget", "_before"), _KEY)
        summed = summed.withColumn("_upto", F.col("_before") + F.sum("_words").over(order))
        passed = summed.where(F.col("_upto") > F.col("_budget"))
        ended = passed.groupBy(*_KEY, "_budget").agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_end"))
        ended = ended.select(*_KEY, "_budget", "_end._bucket", "_end._before")
        done = bits
    return ended.select(*_KEY, F.col("_bucket").alias("_edge"), (F.col("_budget") - F.col("_before")).alias("_room"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...], share_percent: int, most: int) -> DataFrame:
    """One row a source: _total, _target, _whole (times that all its documents are taken), _edge and _room (of one time more).

    Written to the shared folder: its size is then known, and Spark broadcasts it only where it is small."""
    totals = rows.groupBy(*_KEY).agg(F.sum("_size").alias("_total"))
    plan = targets(totals, weights, share_percent, most)
    plan = plan.withColumn("_whole", F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0))
    plan = stored(plan.withColumn("_part", F.col("_target") - F.col("_whole") * F.col("_total")), "mix-plan")
    return stored(plan.join(thresholds(rows, plan, "_part"), _KEY, "left"), "mix-thresholds")


def _on_edge() -> Column:
    return F.coalesce(F.col("_hash") == F.col("_edge"), F.lit(False))


def _times() -> Column:
    """How often a row that is not on the edge is taken."""
    return (F.col("_whole") + F.when(F.col("_hash") < F.col("_edge"), 1).otherwise(0)).cast("int")


def _edge_times(rows: DataFrame) -> DataFrame:
    """Groups of `_copies` equal rows on the edge, as rows (_times) again: of all copies as many once more as bring the sum
    nearest. Copies are spread in blocks, as a group may hold a third of all rows."""
    fit = F.floor(F.col("_room") / F.col("_size"))
    left = F.col("_room") - fit * F.col("_size")
    more = F.when(F.col("_size") > 0, fit + F.when(F.col("_size") - left < left, 1).otherwise(0)).otherwise(0)
    blocks = rows.withColumn("_more", more).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / _AT_ONCE)))).repartition("_block")
    place = F.explode(F.sequence(F.col("_block") * _AT_ONCE + 1, F.least((F.col("_block") + 1) * _AT_ONCE, F.col("_copies"))))
    return blocks.withColumn("_place", place).withColumn("_times", (F.col("_whole") + (F.col("_place") <= F.col("_more")).cast("int")).cast("int"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share_percent: int = 150, most: int = 2) -> DataFrame:
    """One row a document: id, size, source_size, target (its source's) and taken, the words that the mix takes of it."""
    rows = stored(sized(docs, id_col, text_col, source_col), "mix-sizes")
    out = rows.join(mix_plan(rows, weights, share_percent, most), _KEY)
    on_edge = out.where(_on_edge()).groupBy("_id", "_size", "_total", "_target", "_whole", "_room").agg(F.count("*").alias("_copies"))
    names = ["_id", "_size", "_total", "_target", "_times"]
    out = out.where(~_on_edge()).withColumn("_times", _times()).select(*names).unionAll(_edge_times(on_edge).select(*names))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_times")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share_percent: int = 150, most: int = 2) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with all their columns; rows without words are not taken.

    The decision depends only on source and hash, so it joins by source, never by document."""
    names = docs.columns
    plan = mix_plan(stored(sized(docs, id_col, text_col, source_col), "mix-sizes"), weights, share_percent, most)
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    plain = [F.col(f"`{c}`") for c in hashable(docs)]
    keyed = sized(docs, id_col, text_col, source_col, row, F.xxhash64(*plain).alias("_print")).where("_size > 0").join(plan, _KEY)
    on_edge = keyed.where(_on_edge()).groupBy("_id", *_KEY, "_size", "_whole", "_room").agg(F.min_by("_row", "_print").alias("_row"), F.count("*").alias("_copies"))
    taken = keyed.where(~_on_edge()).withColumn("_times", _times()).select("_row", "_times").unionAll(_edge_times(on_edge).select("_row", "_times"))
    return taken.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
