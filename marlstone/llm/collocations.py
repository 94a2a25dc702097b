"""Phrase collocation mining by direct-address tiles.

Texts are cut into pieces and words, and words into the next level's units again and again: a phrase of k+1 words is a
pair of neighbouring phrases of k words that overlap in k-1. So every level counts pairs of codes in stored sequences:

* A frequent unit has a code: its rank by frequency for the most frequent ones, and otherwise a number below zero made
  of its 62-bit hash. Units that are not frequent have none, and a sequence breaks there and at the end of a piece.
* A task sorts pairs of ranks into tiles of TILE by TILE. A tile with many pairs is counted by bincount at the pair's own
  address; pairs of other tiles, and those with a hash, are sorted and counted as coordinates. Spark adds up the counts
  of all tasks.
* Pairs that reach the bound are ranked anew and become the codes of the next level.

What workers hold is bounded whatever the corpus: RANKED ranks and a bitmap of BITMAP_BITS over the hashes of all
frequent units. A unit that shares a bit with a frequent one gets a code too, which costs room in the sequences, but no
pair that has it can reach the bound. Two units of one level that share all 62 bits would be taken as one; among a
million units with codes the chance of that is one in nine million.

Edge cases: a null text is empty; a null lang is `und`, as is the lang of that name; repeated rows count as often as they
stand there; no document or no frequent phrase gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import MADE, drop, stored, text_batches

#: Units of a level that are known by rank, and the side of a tile of pairs.
RANKED, TILE = 1 << 16, 512
#: Bits of the bitmap over the hashes of frequent units.
BITMAP_BITS = 26
#: A tile that holds this part of its addresses in pairs is counted densely.
DENSE = 1 / 8
#: Pairs that a task counts at once, and bytes of text that it splits at once. Spark adds up the counts of a task's windows.
PAIRS, WINDOW = 1 << 18, 2 << 20
#: A row of a stored sequence ends at the first break behind so many codes, and a row group of such rows has about so many
#: bytes: Spark's reader takes all rows of a row group, 4096 at most, at once and on the heap.
ROW, GROUP = 1 << 16, 4 << 20
#: Where a sequence breaks.
NONE = -(1 << 63)
#: Bins a doubling of the frequency, from which the ranked units are chosen.
BINS = 64

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words are 0, blanks between them 1, marks that end a piece 2.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


# --- words


def _windows(kind: np.ndarray):
    """Ranges of about WINDOW bytes that end where no word goes on."""
    a = 0
    while a < len(kind):
        b = min(a + WINDOW, len(kind))
        while b < len(kind) and kind[b] == 0:
            away = np.flatnonzero(kind[b : b + WINDOW])
            b = b + int(away[0]) if len(away) else min(b + WINDOW, len(kind))
        yield a, b
        a = b


def split_words(texts):
    """For an Arrow array of strings, window by window: the words in lower case as an Arrow array, the text of each, and
    the number of pieces that ended before each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind, first = _KIND[data], np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    ended = 0
    for a, b in _windows(kind):
        word = kind[a:b] == 0
        before = np.concatenate([[False], word[:-1]]) & ~first[a:b]
        starts = np.flatnonzero(word & ~before)
        upto = np.cumsum(word, dtype=np.int64)
        edges = np.concatenate([upto[starts] - 1, upto[-1:]])
        letters = _LOWER[data[a:b][word]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(letters)])
        marks = ended + np.cumsum(kind[a:b] == 2, dtype=np.int64)
        yield words, np.searchsorted(at, a + starts, side="right") - 1, marks[starts]
        ended = int(marks[-1])


def _units(words, texts: np.ndarray, langs):
    """Distinct (lang, word) of a window: lang, word, 62-bit hash and count of each, and the unit of every word."""
    from xxhash import xxh64_intdigest

    coded, named = words.dictionary_encode(), langs.dictionary_encode()
    names, spelt = [x.as_py().encode() for x in named.dictionary], coded.dictionary.to_pylist()
    both = named.indices.to_numpy()[texts].astype(np.int64) * max(len(spelt), 1) + coded.indices.to_numpy()
    found, place, counts = np.unique(both, return_inverse=True, return_counts=True)
    lang, word = [names[k] for k in found // max(len(spelt), 1)], [spelt[k] for k in found % max(len(spelt), 1)]
    seeds = {x: xxh64_intdigest(x) for x in names}
    hashes = np.array([xxh64_intdigest(w, seeds[x]) >> 2 for x, w in zip(lang, word)], np.int64)
    return lang, word, hashes, counts, place


def _word_counts(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        langs = pc.fill_null(batch.column(0), "und")
        for words, texts, _ in split_words(batch.column(1)):
            if len(words):
                lang, word, hashes, counts, _ = _units(words, texts, langs)
                #: one more row a lang without a word: all words of the window
                totals: dict[bytes, int] = {}
                for x, n in zip(lang, counts.tolist()):
                    totals[x] = totals.get(x, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*lang, *totals], pa.binary()),
                        pa.array([*word, *[None] * len(totals)], pa.binary()),
                        pa.array([*hashes.tolist(), *[0] * len(totals)], pa.int64()),
                        pa.array([*counts.tolist(), *totals.values()], pa.int64()),
                    ],
                    ["lang", "word", "h", "n"],
                )


# --- codes and pairs


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """62-bit hash of a pair of codes."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x ^= x >> np.uint64(32)
        x = (x + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(2)).astype(np.int64)


class Codes:
    """The codes of a level's frequent units by their hash."""

    def __init__(self, ranked: np.ndarray, words: np.ndarray, bits: np.ndarray):
        """Hashes by rank, and the bitmap as the numbers and contents of its 64-bit words that are not empty."""
        self.order = np.argsort(ranked).astype(np.int64)
        self.keys = ranked[self.order]
        self.words, self.bits = words, bits
        self.bitmap = None

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self.bitmap is None:
            self.bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
            self.bitmap[self.words] = self.bits.view(np.uint64)
        low = hashes & ((1 << BITMAP_BITS) - 1)
        there = np.flatnonzero((self.bitmap[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1))
        some = hashes[there]
        out = np.full(len(hashes), NONE, np.int64)
        out[there] = -2 - some
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            same = self.keys[at] == some
            out[there[same]] = self.order[at[same]]
        return out

    def __getstate__(self):
        return self.__dict__ | {"bitmap": None}


def shortened(codes: np.ndarray) -> np.ndarray:
    """The stretches of two codes and more, with one break between them."""
    there = np.concatenate([[False], codes != NONE, [False]])
    kept = there[1:-1] & (there[:-2] | there[2:])
    after = ~kept & np.concatenate([[False], kept[:-1]])
    return np.where(kept, codes, NONE)[kept | after]


def pair_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbours in a sequence with breaks, and how often each stands there; a pair may come from one tile only."""
    a, b = codes[:-1], codes[1:]
    fine = (a != NONE) & (b != NONE)
    a, b = a[fine], b[fine]
    ranks = (a >= 0) & (b >= 0)
    out = [(x, y, n) for x, y, n in (_tiles(a[ranks], b[ranks]), _coordinates(a[~ranks], b[~ranks]))]
    return tuple(np.concatenate(c) for c in zip(*out))


def _tiles(a: np.ndarray, b: np.ndarray):
    """Counts of pairs of ranks: full tiles by bincount, the rest as sorted coordinates."""
    side = RANKED // TILE
    tile = (a // TILE * side + b // TILE).astype(np.int32)
    pairs = np.bincount(tile, minlength=side * side)
    full = np.flatnonzero(pairs >= DENSE * TILE * TILE)
    dense = np.isin(tile, full)
    keys, counts = np.unique((a * RANKED + b)[~dense], return_counts=True)
    out = [(keys // RANKED, keys % RANKED, counts)]
    order = np.argsort(tile[dense], kind="stable")
    x, y = a[dense][order], b[dense][order]
    edges = np.concatenate([[0], np.cumsum(pairs[full])])
    for t, start, end in zip(full.tolist(), edges, edges[1:]):
        cells = np.bincount(x[start:end] % TILE * TILE + y[start:end] % TILE, minlength=TILE * TILE)
        hit = np.flatnonzero(cells)
        out.append((t // side * TILE + hit // TILE, t % side * TILE + hit % TILE, cells[hit]))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out))


def _coordinates(a: np.ndarray, b: np.ndarray):
    """Counts of pairs of any codes, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    return a[new], b[new], np.diff(np.append(new, len(a)))


def _sequences(codes: Codes):
    """Texts as sequences of the codes of their frequent words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            langs = pc.fill_null(batch.column(0), "und")
            last, parts = None, []
            for words, texts, marks in split_words(batch.column(1)):
                if len(words):
                    _, _, hashes, _, place = _units(words, texts, langs)
                    row = codes(hashes)[place]
                    ends = np.flatnonzero((np.diff(texts) != 0) | (np.diff(marks) != 0)) + 1
                    if last not in (None, (texts[0], marks[0])):
                        parts.append(np.array([NONE], np.int64))
                    parts.append(np.insert(row, ends, NONE))
                    last = (texts[-1], marks[-1])
            if parts:
                yield from _rows(np.concatenate(parts))

    return run


def _rows(codes: np.ndarray):
    """A sequence as rows that end at breaks, if something is left of it."""
    import pyarrow as pa

    codes = shortened(codes)
    if len(codes):
        breaks = np.flatnonzero(codes == NONE) + 1
        #: the first break behind each ROW codes; without one the row goes on, as no pair may be lost
        ends = np.append(breaks[np.searchsorted(breaks, np.arange(ROW, breaks[-1], ROW))], len(codes)) if len(breaks) else np.array([len(codes)])
        edges = np.unique(np.append(0, ends)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges), pa.array(codes))], ["codes"])


def _kept(sequences: DataFrame) -> DataFrame:
    return stored(sequences, "sequences", **{"parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1})


def _joined(codes: Codes):
    """Sequences of one level as sequences of the next: neighbours become one code."""

    def run(batches):
        for batch in batches:
            for row in _arrays(batch):
                if len(row) > 1:
                    a, b = row[:-1], row[1:]
                    fine = np.flatnonzero((a != NONE) & (b != NONE))
                    out = np.full(len(a), NONE, np.int64)
                    out[fine] = codes(mixed(a[fine], b[fine]))
                    yield from _rows(out)

    return run


def _arrays(batch):
    lists = batch.column(0)
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _count(batches):
    import pyarrow as pa

    held, size = [], 0

    def counted():
        for a in range(0, size, PAIRS):
            #: a window of codes and the first of the next, so that no pair is lost or counted twice
            x, y, n = pair_counts(whole[a : a + PAIRS + 1])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(mixed(x, y)), pa.array(n.astype(np.int64))], ["a", "b", "h", "n"])

    for batch in batches:
        for row in _arrays(batch):
            held += [row, np.array([NONE], np.int64)]
            size += len(row) + 1
            if size >= PAIRS:
                whole = np.concatenate(held)
                yield from counted()
                held, size = [], 0
    if held:
        whole = np.concatenate(held)
        yield from counted()


# --- levels


def _codes(units: DataFrame) -> tuple[Codes, DataFrame]:
    """The codes of a stored level (h, f): for the workers, and as a column `code`.

    Ranks go to the bins of most frequency that hold RANKED units together at most; so many rows reach the driver, and the
    words of the bitmap."""
    spark = units.sparkSession
    bin_of = F.floor(F.log2("f") * BINS)
    bins = sorted(((r["bin"], r["units"]) for r in units.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("units")).collect()), reverse=True)
    least, total = None, 0
    for b, n in bins:
        if total + n > RANKED:
            break
        least, total = b, total + n
    top = units.where(bin_of >= least).select("h", "f").toArrow() if least is not None else None
    hashes = np.zeros(0, np.int64)
    if top is not None:
        h, f = (top.column(c).to_numpy() for c in ("h", "f"))
        hashes = h[np.lexsort((h, -f))]
    low = F.col("h").bitwiseAND((1 << BITMAP_BITS) - 1)
    bits = units.groupBy(F.shiftright(low, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    codes = Codes(hashes, bits.column("word").to_numpy(), bits.column("bits").to_numpy())
    ranks = spark.createDataFrame([(int(h), k) for k, h in enumerate(hashes)], "h long, rank long")
    return codes, units.join(F.broadcast(ranks), "h", "left").withColumn("code", F.coalesce("rank", F.lit(-2) - F.col("h"))).drop("rank")


def _scores(phrases: DataFrame, k: int) -> DataFrame:
    """The lowest score of a phrase of k words over its cuts, with the counts of both parts; exact. Needs a, n, and the
    counts of its beginnings `firsts` and ends `lasts` by length."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    cuts = []
    for j in range(1, k):
        left, right = F.col("firsts")[j - 1], F.col("lasts")[k - j - 1]
        above = (wide(F.col("a")) * wide(F.col("n"))).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
        cuts.append(F.struct(F.call_function("div", above.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")).alias("score"), F.lit(j).alias("cut"), left.alias("l"), right.alias("r")))
    return phrases.withColumn("_cut", F.array_min(F.array(*cuts))).select("*", "_cut.score", "_cut.l", "_cut.r").drop("_cut")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, share: int = 100, top: int = 2000) -> DataFrame:
    """Each lang's best phrases of 2 to `longest` words with at least `min_count` occurrences: lang, rank, phrase, a, l, r,
    n, score. A phrase goes where a longer one around it has `share` percent of its occurrences."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    spark: SparkSession = docs.sparkSession
    text_batches(spark, WINDOW)
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    words = texts.mapInArrow(_word_counts, "lang binary, word binary, h long, n long")
    words = stored(words.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("f")).where((F.col("f") >= min_count) | F.col("word").isNull()), "words")
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    codes, units = _codes(words.where(f"word is not null and f >= {int(min_count)}"))
    level = stored(units.select("code", "lang", F.col("word").alias("phrase"), F.col("word").alias("ending"), F.array("f").alias("firsts"), F.array("f").alias("lasts")), "phrases")
    rows = _kept(texts.mapInArrow(_sequences(codes), "codes array<long>"))
    candidates, path = None, MADE[-1]
    for k in range(2, longest + 1):
        counted = rows.mapInArrow(_count, "a long, b long, h long, n long").groupBy("a", "b").agg(F.first("h").alias("h"), F.sum("n").alias("f"))
        codes, units = _codes(stored(counted.where(F.col("f") >= min_count), "pairs"))
        left = level.select(F.col("code").alias("a"), "lang", "phrase", "firsts")
        right = level.select(F.col("code").alias("b"), F.col("ending"), "lasts")
        whole = units.join(left, "a").join(right, "b").select(
            "code", "lang", "a", "b", "f", F.concat("phrase", F.lit(b" "), "ending").alias("phrase"), "ending",
            F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"),
        )
        longer = stored(whole, "phrases")
        if k > 2:
            #: a longer phrase of enough occurrences has one of k+1 words inside that has as many at least
            around = longer.select(F.col("a").alias("code"), "f").unionAll(longer.select(F.col("b").alias("code"), "f"))
            around = around.groupBy("code").agg(F.max("f").alias("most"))
            candidates = _with(candidates, _free(level, around, share), k - 1)
        level = longer
        if k < longest:
            rows, old = _kept(rows.mapInArrow(_joined(codes), "codes array<long>")), path
            path = MADE[-1]
            drop(spark, [old])
            MADE.remove(old)
    return _best(_with(candidates, level, longest), totals, top, longest)


def _free(level: DataFrame, around: DataFrame, share: int) -> DataFrame:
    """Phrases that no longer one stands for."""
    last = F.element_at("firsts", -1)
    return level.join(around, "code", "left").where(F.col("most").isNull() | (100 * F.col("most") < share * last)).drop("most")


def _with(candidates, level: DataFrame, k: int):
    found = level.select("lang", "phrase", F.element_at("firsts", -1).alias("a"), "firsts", "lasts", F.lit(k).alias("k"))
    return found if candidates is None else candidates.unionByName(found)


def _best(candidates: DataFrame, totals: DataFrame, top: int, longest: int) -> DataFrame:
    """Scores, and each lang's first `top`. A lang's phrases are first cut to `top` within 64 shares of them."""
    from pyspark.sql import Window

    counted = candidates.join(totals, "lang")
    parts = [_scores(counted.where(F.col("k") == k), k) for k in range(2, longest + 1)]
    names = ["lang", "phrase", "a", "l", "r", "n", "score"]
    scored = parts[0].select(*names)
    for p in parts[1:]:
        scored = scored.unionAll(p.select(*names))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shared = scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = shared.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select(F.col("lang").cast("string").alias("lang"), "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
