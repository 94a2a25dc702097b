"""Exact vector search with deterministic order, filters before ranks, fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.lexical import best_items

RRF_K = 60
MOST_K = 50
#: Bytes of an Arrow batch of pairs of matrix blocks, of which a Python worker holds one or two.
PAIRS_BYTES = 8 << 20
#: Bytes of text that leave a worker at once, or one text.
TEXT_BYTES = 8 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A float array as doubles of length one."""
    wide = F.transform(v, lambda x: x.cast("double"))
    return F.get(F.transform(F.array(wide), lambda w: F.get(F.transform(F.array(F.sqrt(dot(w, w))), lambda n: F.transform(w, lambda x: x / n)), F.lit(0))), F.lit(0))


def filtered(corpus: DataFrame, filters: dict[str, list | None]) -> DataFrame:
    """Fields are and-ed, values or-ed; None is no filter, an empty list matches nothing."""
    for field, values in filters.items():
        if values is not None:
            corpus = corpus.where(F.col(field).isin(values)) if values else corpus.where(F.lit(False))
    return corpus


def _packed(block_rows: int):
    """Rows (id, vector) of a task as blocks: ids, and their vectors of length one as one matrix. Rows without a vector go; a
    vector of length zero stays, and is like nothing."""
    import numpy as np
    import pyarrow as pa

    def made(ids, rows, name):
        #: the smaller of two equally near items is found first
        order = pa.compute.sort_indices(ids)
        matrix = np.stack(rows).astype(np.float64)[order.to_numpy()]
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        held = ids.take(order)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], [name, "dims", "matrix"])

    def packer(name):
        def run(batches):
            import pyarrow.compute  # noqa: F401

            waiting: dict[int, tuple[list, list]] = {}
            for batch in batches:
                for k, v in enumerate(batch.column(1)):
                    if v.is_valid:
                        row = np.array(v.values, dtype=np.float64)
                        ids, rows = waiting.setdefault(len(row), ([], []))
                        ids.append(batch.column(0)[k])
                        rows.append(row)
                        if len(rows) == block_rows:
                            yield made(pa.array([i.as_py() for i in ids], batch.schema.field(0).type), rows, name)
                            del waiting[len(row)]
                kind = batch.schema.field(0).type
            for ids, rows in waiting.values():
                yield made(pa.array([i.as_py() for i in ids], kind), rows, name)

        return run

    return packer


def _best_of_blocks(k: int, but_itself: bool):
    import numpy as np

    def run(batches):
        import pyarrow as pa

        #: numbers are compared as such, anything else as Python objects
        own = lambda a: a.to_numpy() if pa.types.is_integer(a.type) and not a.null_count else np.array(a.to_pylist(), object)
        for batch in batches:
            for q_ids, q_matrix, ids, matrix, dims in zip(*(batch.column(c) for c in ("q_ids", "q_matrix", "ids", "matrix", "dims"))):
                asked, held = q_ids.values, ids.values
                a, b = (np.frombuffer(m.as_buffer(), np.float64).reshape(-1, dims.as_py()) for m in (q_matrix, matrix))
                near = np.round(a @ b.T, 6) + 0.0
                if but_itself:
                    near[own(asked)[:, None] == own(held)] = -np.inf
                best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(asked)), best.shape[1])
                score, at = near[rows, best.ravel()], best.ravel()
                fine = score > -np.inf
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(rows[fine])), held.take(pa.array(at[fine])), pa.array(score[fine])], ["query_id", "item_id", "similarity"])

    return run


def _small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).removesuffix("b")) <= PAIRS_BYTES:
        spark.conf.set(key, PAIRS_BYTES)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 8, filters: dict[str, list | None] | None = None, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", but_itself: bool = False, block_rows: int = 512) -> DataFrame:
    """The k nearest items of each query by cosine: query id, item id, rank, similarity (six places), score 1 / (60 + rank).

    Every query is held against every item, block by block: one matrix product for each two blocks, of which only the k best
    of each query leave the task, and the best of all blocks are ranked then. Spark broadcasts the blocks of queries if
    their size is below its threshold and deals out both sides otherwise. Filters apply before ranking. Ties go to the
    smaller item id. With `but_itself` an item of the query's own id is left out. Vectors of different lengths never meet."""
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be between 1 and {MOST_K}")
    corpus = filtered(corpus, filters or {})
    _small_batches(corpus.sparkSession)
    q_kind, kind = queries.schema[query_id].dataType.simpleString(), corpus.schema[item_id].dataType.simpleString()
    pack = _packed(block_rows)
    asked = queries.select(query_id, vector).mapInArrow(pack("q_ids"), f"q_ids array<{q_kind}>, dims int, matrix binary").withColumnsRenamed({"dims": "q_dims", "matrix": "q_matrix"})
    items = corpus.select(item_id, vector).mapInArrow(pack("ids"), f"ids array<{kind}>, dims int, matrix binary")
    #: a condition that no hash join takes, as all blocks of one length are one key
    pairs = items.join(asked, (F.col("dims") <= F.col("q_dims")) & (F.col("dims") >= F.col("q_dims")))
    scored = pairs.mapInArrow(_best_of_blocks(k, but_itself), f"query_id {q_kind}, item_id {kind}, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "similarity", rank_score(F.col("rank")).alias("score"))


#: What a search returns of each chunk.
CANDIDATE = ("chunk_id", "document_id", "document_title", "source_uri", "doc_type", "section_path", "ordinal", "text")


def candidates(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (query_id, item_id, rank, ...) with the columns of their chunks (id, document_id, section_path, ordinal, text) and
    of those chunks' documents (id, title, source_uri, doc_type). Hits of chunks that are gone are left out."""
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "section_path", "ordinal", "text")
    d = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "source_uri", "doc_type")
    kept = [x for x in hits.columns if x != "item_id"]
    return hits.withColumnRenamed("item_id", "chunk_id").join(c, "chunk_id").join(d, "document_id").select(*kept, *CANDIDATE)


def rank_score(rank: Column) -> Column:
    return 1 / (F.lit(RRF_K) + rank)


def rerank(candidates: DataFrame, score: Column, k: int, window: int = 4) -> DataFrame:
    """Candidates of rank up to window * k in the order of a new score; ties keep the old order; the best k stay."""
    order = Window.partitionBy("query_id").orderBy(F.desc("_s"), "rank")
    near = candidates.where(F.col("rank") <= window * k).withColumn("_s", score)
    return near.withColumn("new_rank", F.row_number().over(order).cast("long")).where(F.col("new_rank") <= k).drop("_s")


def fuse(*lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, item_id, rank): by score, then best single rank, then id."""
    all_rows = lists[0].select("query_id", "item_id", "rank")
    for one in lists[1:]:
        all_rows = all_rows.unionByName(one.select("query_id", "item_id", "rank"))
    #: lists that are dealt by the query already must be dealt anew: as a union they may have more partitions than it says
    fused = all_rows.repartition("query_id", "item_id").groupBy("query_id", "item_id").agg(F.sum(rank_score(F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    fused = fused.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "item_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


def ungated(candidates: DataFrame, flag: str = "via_fallback") -> DataFrame:
    """The candidates that a gate lets into a fusion: none that a search found only by falling back."""
    return candidates.where(~F.coalesce(F.col(flag), F.lit(False)))


def embedder_identities(corpus: DataFrame, column: str = "embedding_model") -> DataFrame:
    """How many rows each identity has; a corpus that may be searched has one."""
    return corpus.groupBy(F.col(column).alias("identity")).agg(F.count(F.lit(1)).alias("n"))


def check_identity(corpus: DataFrame, expected: str, column: str = "embedding_model") -> None:
    """Raise unless the whole corpus, whatever filters a search has, carries one expected identity."""
    found = [r[0] for r in corpus.select(column).distinct().limit(3).collect()]
    if not found:
        raise ValueError("the corpus is empty")
    if found != [expected]:
        raise ValueError(f"the corpus was embedded by {sorted(map(str, found))}, the query by {expected}")


def distinct_section_rate(results: DataFrame, queries: DataFrame, section: str = "section") -> DataFrame:
    """Distinct sections by results of each query; 0 for queries without results."""
    rate = results.groupBy("query_id").agg(F.countDistinct(section).alias("d"), F.count(F.lit(1)).alias("n"))
    return queries.select("query_id").join(rate, "query_id", "left").select("query_id", F.coalesce(F.col("d") / F.col("n"), F.lit(0.0)).alias("rate"))


def matches_section(prefix: Column, path: Column) -> Column:
    """The path is the node or below it: the prefix must end where a word ends."""
    following = F.substring(path, F.length(prefix) + 1, F.lit(1))
    return path.startswith(prefix) & ~following.rlike(r"[\p{L}\p{N}_]")


def straddles(prefix: Column, path: Column) -> Column:
    """The prefix matches as text but ends inside a word."""
    return path.startswith(prefix) & ~matches_section(prefix, path)


def section_prefixes(path: Column) -> Column:
    """The labels that name a path or something above it: its beginnings that end where a word does."""
    ends = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: ~F.substr(path, i + 1, F.lit(1)).rlike(r"[\p{L}\p{N}_]"))
    return F.when(F.length(path) > 0, F.transform(ends, lambda i: F.substr(path, F.lit(1), i)))


def match_labels(labels: DataFrame, chunks: DataFrame, label: str = "label", path: str = "section_path") -> DataFrame:
    """Labels with the chunks of their section or below it. Paths are spelt out into their prefixes, each distinct path once,
    so labels meet paths, and paths their chunks, by equal keys; a label's root needn't be known."""
    paths = chunks.select(F.col(path).alias("_path")).where("_path is not null").distinct()
    named = paths.select("_path", F.explode(section_prefixes(F.col("_path"))).alias("_label"))
    return labels.join(named, F.col(label) == F.col("_label")).join(chunks, F.col("_path") == F.col(path)).drop("_label", "_path")


def pin_golds(labels: DataFrame, chunks: DataFrame, label: str = "label", path: str = "section_path", chunk_id: str = "chunk_id", separator: str = " › ") -> DataFrame:
    """What each distinct label stands for: n_chunks, n_paths, the sorted paths and chunk ids, and whether it is unresolved (no
    chunk), truncated (it ends inside a part of every path that it matches) or ambiguous (several paths)."""
    distinct = labels.select(F.col(label).alias("label")).distinct()
    found = match_labels(distinct, chunks.select(F.col(path).alias("_at"), F.col(chunk_id).alias("_id")), "label", "_at")
    exact = is_exact_anchor(F.col("label"), F.col("_at"), separator)
    held = found.groupBy("label").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_set("_at")).alias("paths"), F.array_sort(F.collect_set("_id")).alias("chunk_ids"), F.max(exact).alias("_exact"))
    kind = chunks.schema[chunk_id].dataType.simpleString()
    n = F.coalesce("n_chunks", F.lit(0))
    return distinct.join(held, "label", "left").select(
        "label", n.alias("n_chunks"), F.coalesce(F.size("paths"), F.lit(0)).cast("long").alias("n_paths"), (n == 0).alias("unresolved"), F.coalesce(~F.col("_exact"), F.lit(False)).alias("truncated"),
        F.coalesce(F.size("paths") > 1, F.lit(False)).alias("ambiguous"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), F.coalesce("chunk_ids", F.array().cast(f"array<{kind}>")).alias("chunk_ids"),
    )


def _row_by_row(spark: SparkSession, column: str) -> None:
    """For a column whose values may be as large as a corpus: Parquet writers look at their size after every row, not after a
    hundred, and keep neither a dictionary of the column nor the least and greatest value of each row group."""
    for key, value in (("parquet.page.size.row.check.min", 1), (f"parquet.enable.dictionary#{column}", "false"), (f"parquet.column.statistics.enabled#{column}", "false")):
        spark.conf.set(key, value)


def _with_text(columns: list[str]):
    """Rows (_gold, _text, _case), the lines of a label in order before its cases, as cases with the label's text.

    A worker holds the text of one label once; it is passed on with each case, in batches of TEXT_BYTES or one row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        at, held, found = None, None, False
        for batch in batches:
            gold, lines, cases = (batch.column(c) for c in ("_gold", "_text", "_case"))
            ends = [*(pc.indices_nonzero(pc.fill_null(pc.not_equal(gold[1:], gold[:-1]), True)).to_numpy() + 1).tolist(), batch.num_rows]
            for a, b in zip([0, *ends], ends):
                label = gold[a].as_py()
                if held is None or label is None or label != at:
                    at, held, found = label, bytearray(), False
                more = lines[a:b].drop_null()
                if len(more):
                    held += b"\n" * found + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(more)], pa.int32()), more.cast(pa.binary())), b"\n")[0].as_buffer()
                    found = True
                asked = cases[a:b].drop_null()
                step = max(TEXT_BYTES // max(len(held), 1), 1)
                for k in range(0, len(asked), step):
                    some = asked[k : k + step]
                    text = pa.nulls(len(some), pa.string())
                    if found:
                        whole = pa.py_buffer(held) if len(some) == 1 else pa.py_buffer(bytes(held) * len(some))
                        text = pa.StringArray.from_buffers(len(some), pa.array([len(held) * i for i in range(len(some) + 1)], pa.int32()).buffers()[1], whole)
                    yield pa.RecordBatch.from_arrays([*(pc.struct_field(some, c) for c in columns), text], [*columns, "gold_text"])

    return run


def discordant_worksheet(cases: DataFrame, chunks: DataFrame, order: list[str], label: str = "label", path: str = "section_path", text: str = "text") -> DataFrame:
    """Cases (case_id, label, ...) with the text of the chunks that hold their answer, in order; null where none does.

    Lines and cases of a label meet in one task, sorted by Spark, lines first. The text of a label is put together once, is
    held once by that task, and leaves it with one case after the other."""
    spark = cases.sparkSession
    _small_batches(spark)
    _row_by_row(spark, "gold_text")
    labels = cases.select(F.col(label).alias("_gold")).where("_gold is not null").distinct()
    lines = match_labels(labels, chunks, "_gold", path).select("_gold", F.struct(*order).alias("_at"), F.col(text).alias("_text"))
    asked = cases.select(F.col(label).alias("_gold"), F.struct(*cases.columns).alias("_case"))
    both = lines.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    #: a number of parts that stays, as Spark would put small labels beside large ones
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "_gold").sortWithinPartitions("_gold", "_asks", "_at", "_text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema.fields)
    return dealt.select("_gold", "_text", "_case").mapInArrow(_with_text(cases.columns), f"{kinds}, gold_text string")


def is_exact_anchor(label: Column, path: Column, separator: str = " › ") -> Column:
    return (path == label) | path.startswith(F.concat(label, F.lit(separator)))


def lexical_search(terms: DataFrame, postings: DataFrame, every_term: bool = True, k: int | None = 50) -> DataFrame:
    """Items that hold the terms (all, or any) of each query: query_id, item_id, matched, score, rank; without `k` all of them, and no rank.

    terms: query_id, term; postings: item_id, term, n, one row for each item and term. The score sums n / (1 + n) by
    inverse document frequency. With `k` no row is made for what meets by term (`lexical.best_items`). Without, rows are made
    for all that a query finds; where every term is needed, only items that hold a query's rarest term are looked at."""
    if k is not None:
        held = F.collect_list(F.struct("term", F.col("n").cast("long").alias("n")))
        items = postings.where("term is not null").groupBy("item_id").agg(held.alias("p")).select("item_id", F.col("p.term").alias("words"), F.col("p.n").alias("counts"))
        return best_items(terms, items, k, every_term, not every_term).drop("via_fallback")
    terms = terms.distinct()
    items = postings.agg(F.countDistinct("item_id").alias("items"))
    asked = postings.join(terms.select("term").distinct(), "term", "left_semi")
    held = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = terms.join(held, "term", "left")
    weight = F.ln(1 + F.col("items") / F.col("df")) * F.col("n") / (1 + F.col("n"))
    if every_term:
        #: a term that no item holds leaves its query without an item
        rarest = weighed.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"), F.count("df").alias("known"), F.min(F.struct("df", "term")).alias("r")).where("need = known")
        near = rarest.select("query_id", "need", F.col("r.term").alias("term")).join(asked.select("term", "item_id"), "term").select("query_id", "need", "item_id")
        rows = near.join(weighed, "query_id").join(asked, ["item_id", "term"])
    else:
        rows = weighed.withColumn("need", F.lit(1)).join(asked, "term")
    found = rows.crossJoin(F.broadcast(items)).groupBy("query_id", "item_id", "need").agg(F.count(F.lit(1)).alias("matched"), F.round(F.sum(weight), 6).alias("score"))
    return (found.where("matched = need") if every_term else found).drop("need")


def prune_terms(terms: DataFrame, postings: DataFrame, share: float = 0.25) -> DataFrame:
    """Terms without those that more than `share` of all items hold."""
    total = postings.agg(F.countDistinct("item_id").alias("items"))
    common = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).where(F.col("df") > share * F.col("items"))
    return terms.join(common.select("term"), "term", "left_anti")
