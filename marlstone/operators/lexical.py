"""Lexical search by shards: items are dealt out and packed as columns, and every query is held against every shard.

What meets by term never becomes rows. A shard's postings are arrays of numbers, a query's scores are added up in one array
over the shard's items, and only its best items leave the task. So what is shuffled is the items once, the queries once a
shard, and a few results of each query and shard; the work is queries x items, in numpy, in memory that a shard bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which items are dealt; each query travels to all of them.
SHARDS = 128
QUERIES_AT_ONCE = 256
#: Scores are rounded to six places afterwards, so what is this near to the last place may still hold it.
NEAR = 3e-6


def _lists(values, ends):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _numbers(column, kind):
    import numpy as np

    return np.frombuffer(column.as_buffer(), kind)


def _blocks_of_items(shards: int):
    """Rows (item_id, words array, counts array or none) as blocks: ids, distinct words, and postings in the items' order."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        import pyarrow.compute as pc
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() % shards
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("words")), 0), 0))
            if not batch.num_rows:
                continue
            ids, words = batch.column("item_id"), batch.column("words")
            held = words.flatten().dictionary_encode()
            owner = np.repeat(np.arange(len(ids)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            key = owner * len(held.dictionary) + held.indices.to_numpy(zero_copy_only=False)
            found, place = np.unique(key, return_inverse=True)
            weights = batch.column("counts").flatten().to_numpy(zero_copy_only=False) if "counts" in batch.schema.names else None
            n = np.bincount(place, weights, len(found)).astype(np.int64)
            owner, code = np.divmod(found, len(held.dictionary))
            packed = [np.bincount(owner, minlength=len(ids)).astype(np.int32), code.astype(np.int32), n, np.bincount(code, minlength=len(held.dictionary)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), _lists(ids, [0, len(ids)]), _lists(held.dictionary, [0, len(held.dictionary)]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)],
                ["shard", "ids", "words", "sizes", "codes", "n", "held"],
            )

    return run


def _held(batches):
    """How many items of a block hold each of its words; without a word, how many items with an id it has."""
    import pyarrow as pa

    for batch in batches:
        for ids, words, held in zip(*(batch.column(c) for c in ("ids", "words", "held"))):
            terms = pa.concat_arrays([words.values, pa.array([None], words.values.type)])
            yield pa.RecordBatch.from_arrays([terms, pa.array([*_numbers(held, "int64"), len(ids.values) - ids.values.null_count], pa.int64())], ["term", "held"])


def _blocks_of_queries(batches):
    import numpy as np
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, QUERIES_AT_ONCE):
            batch = whole.slice(at, QUERIES_AT_ONCE)
            words = batch.column("words").flatten().dictionary_encode()
            sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            packed = [sizes, words.indices.to_numpy(zero_copy_only=False).astype(np.int32), batch.column("weights").flatten().to_numpy(zero_copy_only=False).astype(np.float64)]
            lists = [_lists(x, [0, len(x)]) for x in (batch.column("query_id"), batch.column("but"), words.dictionary)]
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["queries", "but", "words", "sizes", "codes", "n"])


class Shard:
    """The postings of some blocks of items, by item and by term."""

    def __init__(self, blocks: list):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.ids = pa.concat_arrays([b["ids"].values for b in blocks])
        words = pa.concat_arrays([b["words"].values for b in blocks]).dictionary_encode()
        self.words, renamed = words.dictionary, words.indices.to_numpy()
        ends = np.cumsum([0, *(len(b["words"].values) for b in blocks)])
        self.code = np.concatenate([renamed[a:][_numbers(b["codes"], np.int32)] for a, b in zip(ends, blocks)])
        n = np.concatenate([_numbers(b["n"], np.int64) for b in blocks])
        self.weight = n / (1.0 + n)
        sizes = np.concatenate([_numbers(b["sizes"], np.int32) for b in blocks])
        self.at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        order = np.argsort(self.code, kind="stable")
        self.holders, self.held = np.repeat(np.arange(len(sizes)), sizes)[order], self.weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.code, minlength=len(self.words)))])
        self.most = np.maximum.reduceat(self.held, self.start[:-1])
        place = np.empty(len(self.ids), np.int64)
        place[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.place, self.scores, self.worth = place, np.zeros(len(sizes)), np.zeros(len(self.words))

    def size(self, codes):
        return self.start[codes + 1] - self.start[codes]

    def postings(self, items):
        """Of some items: which of them each posting belongs to, and where the postings stand."""
        import numpy as np

        n = self.at[items + 1] - self.at[items]
        row = np.repeat(np.arange(len(items)), n)
        return row, np.arange(len(row)) + np.repeat(self.at[items] - np.cumsum(n) + n, n)

    def with_all(self, codes, weights):
        """Items that hold every term, and their scores; the terms stand from the rarest to the most frequent one."""
        import numpy as np

        items, scores = self.holders[self.start[codes[0]] : self.start[codes[0] + 1]], weights[0] * self.held[self.start[codes[0]] : self.start[codes[0] + 1]]
        for c, w in zip(codes[1:].tolist(), weights[1:].tolist()):
            if not len(items):
                break
            a, b = self.start[c], self.start[c + 1]
            spot = np.minimum(np.searchsorted(self.holders[a:b], items), b - a - 1) + a
            fine = self.holders[spot] == items
            items, scores = items[fine], scores[fine] + w * self.held[spot[fine]]
        return items, scores

    def with_any(self, codes, weights, k, own):
        """Items that may be among the k best that hold a term, and their scores; terms from the rarest on.

        Terms that few items hold come first. Where what the others can add at most is less than the k-th best score so far,
        they are looked up only for items that can still reach that score."""
        import numpy as np

        scores = self.scores
        scores[:] = 0
        few = int(np.searchsorted(self.size(codes), max(len(scores) // 32, 1)))
        self._add(codes[:few], weights[:few])
        bound, rest = self._kth(k, own), float((weights[few:] * self.most[codes[few:]]).sum())
        if bound > rest + NEAR:
            items = np.flatnonzero(scores >= bound - rest - NEAR)
            if len(items) < len(scores) // 16:
                return items, scores[items] + self._looked_up(items, codes[few:], weights[few:])
        self._add(codes[few:], weights[few:])
        items = np.flatnonzero(scores >= max(self._kth(k, own) - NEAR, 1e-300))
        return items, scores[items]

    def _add(self, codes, weights):
        import numpy as np

        for a, b, w in zip(self.start[codes].tolist(), self.start[codes + 1].tolist(), weights.tolist()):
            #: one pass, in half the time of reading, adding and writing back by index
            np.add.at(self.scores, self.holders[a:b], w * self.held[a:b])

    def _looked_up(self, items, codes, weights):
        """What terms add to the scores of some items, which stand in order."""
        import numpy as np

        more = np.zeros(len(items))
        #: few items are sought among each term's holders; of many, all postings are read
        if len(items) * len(codes) * 8 < len(self.scores):
            for c, w in zip(codes.tolist(), weights.tolist()):
                a, b = self.start[c], self.start[c + 1]
                spot = np.minimum(np.searchsorted(self.holders[a:b], items), b - a - 1) + a
                fine = self.holders[spot] == items
                more[fine] += w * self.held[spot[fine]]
            return more
        row, spot = self.postings(items)
        self.worth[codes] = weights
        more = np.bincount(row, self.worth[self.code[spot]] * self.weight[spot], len(items))
        self.worth[codes] = 0
        return more

    def _kth(self, k, own):
        """A score that at least k items but the own one have: the k-th best of the best of some runs of items."""
        import numpy as np

        kept = self.scores[own] if own >= 0 else 0.0
        if own >= 0:
            self.scores[own] = 0
        run = max(len(self.scores) // (8 * k), 1)
        best = np.maximum.reduceat(self.scores, np.arange(0, len(self.scores), run))
        if own >= 0:
            self.scores[own] = kept
        return float(np.partition(best, -k)[-k]) if len(best) >= k else 0.0

    def matched(self, items, codes):
        import numpy as np

        row, spot = self.postings(items)
        self.worth[codes] = 1
        n = np.bincount(row, self.worth[self.code[spot]], len(items)).astype(np.int64)
        self.worth[codes] = 0
        return n

    def best(self, items, scores, k):
        """Those that can be among the k best after rounding; of equal scores the k first ids."""
        import numpy as np

        if len(items) > k:
            near = scores >= np.partition(scores, -k)[-k] - NEAR
            items, scores = items[near], scores[near]
        if len(items) > k:
            order = np.lexsort((self.place[items], scores))
            items, scores = items[order], scores[order]
            first = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
            fine = np.arange(len(items)) - np.repeat(first, np.diff([*first, len(items)])) < k
            items, scores = items[fine], scores[fine]
        return items, scores


def _searched(k: int, every_term: bool, fall_back: bool):
    import numpy as np
    import pyarrow as pa

    def asked(shard: Shard, block: dict):
        import pyarrow.compute as pc

        codes = pc.fill_null(pc.index_in(block["words"].values, value_set=shard.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[_numbers(block["codes"], np.int32)]
        weights, ends = _numbers(block["n"], np.float64), np.cumsum(_numbers(block["sizes"], np.int32))
        #: an id that is missing is no item's own
        but = block["but"].values
        own = np.where(but.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.index_in(but, value_set=shard.ids), -1).to_numpy(zero_copy_only=False), -1)
        found = []
        for q, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            known = codes[a:b] >= 0
            c, w, mine = codes[a:b][known], weights[a:b][known], int(own[q])
            if not len(c):
                continue
            order = np.lexsort((c, shard.size(c)))
            c, w = c[order], w[order]
            items, strict = np.zeros(0, np.int64), True
            if every_term and known.all():
                items, scores = shard.with_all(c, w)
                items, scores = items[items != mine], scores[items != mine]
            if not len(items) and fall_back:
                strict, (items, scores) = False, shard.with_any(c, w, k, mine)
                items, scores = items[items != mine], scores[items != mine]
            if len(items):
                items, scores = shard.best(items, scores, k)
                found.append((np.full(len(items), q), items, shard.matched(items, c), scores, np.full(len(items), strict)))
        q, items, matched, scores, strict = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [], [], [])
        kinds = pa.int64(), pa.float64(), pa.bool_()
        return pa.RecordBatch.from_arrays(
            [block["queries"].values.take(pa.array(q, pa.int64())), shard.ids.take(pa.array(items, pa.int64())), *(pa.array(x, t) for x, t in zip((matched, scores, strict), kinds))],
            ["query_id", "item_id", "matched", "score", "strict"],
        )

    def run(batches):
        at, blocks, shard = None, [], None
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {c: batch.column(c)[k_row] for c in batch.schema.names}
                if row["shard"].as_py() != at:
                    at, blocks, shard = row["shard"].as_py(), [], None
                if row["asks"].as_py():
                    if blocks:
                        shard, blocks = Shard(blocks), []
                    if shard is not None:
                        yield asked(shard, row)
                else:
                    blocks.append(row)

    return run


def best_items(terms: DataFrame, items: DataFrame, k: int, every_term: bool = True, fall_back: bool = False, but: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """The k best items (item_id, words array<string>, perhaps counts array<long> beside the words) of each query of terms
    (query_id, term): query_id, item_id, matched, score, via_fallback, rank.

    An item must hold every term, or any; with both `every_term` and `fall_back`, any if no item holds every term. `but`, made
    of query_id, is an item that does not count for its query. The score sums n / (1 + n) by inverse document frequency,
    rounded to six places; equal scores are in the items' order."""
    if not (every_term or fall_back):
        raise ValueError("items must hold every term, or any")
    query, item = terms.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    columns = ["item_id", "words"] + (["counts"] if "counts" in items.columns else [])
    blocks = items.select(*columns).mapInArrow(_blocks_of_items(shards), f"shard int, ids array<{item}>, words array<string>, sizes binary, codes binary, n binary, held binary")
    held = blocks.mapInArrow(_held, "term string, held long").groupBy("term").agg(F.sum("held").alias("held"))
    #: each query asks for the number of all items too, which has no term
    every = terms.select("query_id", "term").where("term is not null").distinct()
    wanted = every.unionByName(every.select("query_id", F.lit(None).cast("string").alias("term")).distinct())
    h = held.withColumnRenamed("term", "_term")
    rows = wanted.join(h, F.col("term").eqNullSafe(F.col("_term")), "left").groupBy("query_id").agg(F.max(F.when(F.col("term").isNull(), F.col("held"))).alias("items"), F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "held")))).alias("t"))
    weight = F.transform("t", lambda x: F.ln(1 + F.col("items") / x["held"]))
    asked = rows.select("query_id", (F.lit(None) if but is None else but).cast(item).alias("but"), F.col("t.term").alias("words"), weight.alias("weights"))
    packed = asked.mapInArrow(_blocks_of_queries, f"queries array<{query}>, but array<{item}>, words array<string>, sizes binary, codes binary, n binary")
    each = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), F.lit(None).cast(f"array<{item}>").alias("ids"), "*")
    both = blocks.drop("held").withColumn("asks", F.lit(False)).unionByName(each, allowMissingColumns=True)
    found = both.repartition(shards, "shard").sortWithinPartitions("shard", "asks").mapInArrow(_searched(k, every_term, fall_back), f"query_id {query}, item_id {item}, matched long, score double, strict boolean")
    best = found.withColumn("score", F.round("score", 6)).withColumn("via_fallback", ~F.col("strict"))
    #: items that hold every term stand before all others, which count only where there are none
    order = Window.partitionBy("query_id").orderBy("via_fallback", F.desc("score"), "item_id")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    least = F.min("via_fallback").over(Window.partitionBy("query_id"))
    return ranked.withColumn("_least", least).where("via_fallback = _least").select("query_id", "item_id", "matched", "score", "via_fallback", "rank")
