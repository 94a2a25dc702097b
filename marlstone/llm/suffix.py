"""Suffix-array dedup: every byte inside a string of `length` bytes that also starts elsewhere is removed.

Dealing. A start's key is the least hash of the `gram`-byte strings inside its `length`-byte string, so equal strings
have equal keys. Consecutive starts of one key make a segment: its starts and the length - 1 bytes behind the last one.
Segments whose key occurs once are done. Equal segments are one; where a segment occurs twice, all of its starts are
repeated. The text of the different segments of a key meets in one task, once each.

Counting. A task puts the segments of some keys behind one another, each closed by its own separator, sorts the
suffixes, and derives common prefixes from the Burrows-Wheeler transform: from the interval of the empty string,
backward extension by every preceding byte, breadth first, gives the intervals of strings of 1, 2, 3... bytes; an
interval that ends where no common prefix is known sets it to the length before, and only such intervals are extended.
Expansion stops at `length`: boundaries that are then unknown lie between suffixes that share at least `length` bytes.

Keys with more than `block` bytes of different segments are split into blocks, and every two blocks meet in a task.

Passages. A passage of over 50 words may have fewer than `length` bytes and stays then, and `length` bytes that repeat may
stand in one document alone. So runs of `passage_words` consecutive words that another document (another row) holds too are
told in further columns; nothing is removed for them. They are dealt as bytes are, by segments of starts that share the
least hash of `passage_gram` words, and take the same ways; keys of words are odd, of bytes even. Different segments of
a key send the hash of each window instead of text, and a task finds the windows of several documents by sorting; those of
a key with much text are dealt by the hash, each to one task. Words are `[^\x20\x09-\x0D]+`; the space between does not count.

Edge cases: a null text is empty; texts shorter than `length` lose nothing; repeated rows are separate documents, so
their long texts go; a null id is an id of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import ASCII_SPACE, stored, text_batches, utf8

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Starts of a text that are hashed at a time.
SLAB = 1 << 19


def _powers(base: int, n: int, held: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if base not in held or len(held[base]) < n:
        out = np.full(max(n, 1 << 16), base, _U)
        out[0] = 1
        held[base] = np.multiply.accumulate(out)
    return held[base][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of `gram` bytes."""
    n = len(data)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, n), out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, from running minima to the left and right of every width-th value."""
    n = len(x) - width + 1
    whole = np.full(-(-len(x) // width) * width, np.iinfo(_U).max, _U)
    whole[: len(x)] = x
    grid = whole.reshape(-1, width)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


_WORD = np.ones(256, bool)
_WORD[list(ASCII_SPACE)] = False


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    solid = np.zeros(len(text) + 2, bool)
    solid[1:-1] = _WORD[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; of long ones by another function, as the sums of some long strings agree."""
    from xxhash import xxh3_64_intdigest

    out = np.empty(len(begin), _U)
    first = 0
    while first < len(begin):
        low = int(begin[first])
        last = max(first + 1, int(np.searchsorted(end, low + SLAB, "right")))
        n = int(end[last - 1]) - low
        if n <= SLAB:
            sums = np.zeros(n + 1, _U)
            np.cumsum((np.frombuffer(text, np.uint8, n, low).astype(_U) + _U(1)) * _powers(_BASE, n), out=sums[1:])
            at = begin[first:last] - low
            x = (sums[end[first:last] - low] - sums[at]) * _powers(_INVERSE, n)[at]
            x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
            out[first:last] = x ^ (x >> _U(32))
        first = last
    for k in np.flatnonzero(end - begin > 256).tolist():
        out[k] = xxh3_64_intdigest(text[begin[k] : end[k]])
    return out


def word_segments(hashes: np.ndarray, words: int, gram: int):
    """(first start, number of starts, key) of each segment of a text, in words."""
    for slab in range(0, len(hashes) - words + 1, SLAB):
        keys = sliding_least(gram_hashes(hashes[slab : slab + SLAB + words - 1], gram), words - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield from zip((first + slab).tolist(), np.diff(np.append(first, len(keys))).tolist(), keys[first].view(np.int64).tolist())


def segments(text: bytes, length: int, gram: int):
    """(first start, number of starts, key, whether the key's string may occur twice inside) of each segment of a text."""
    data = np.frombuffer(text, np.uint8)
    width = length - gram + 1
    for slab in range(0, len(data) - length + 1, SLAB):
        piece = data[slab : slab + SLAB + length - 1]
        hashes = gram_hashes(piece, gram)
        keys = sliding_least(hashes, width)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        key = keys[first]
        low = hashes[hashes <= key.max()]
        low.sort()
        twice = low[1:][low[1:] == low[:-1]]
        inside = np.isin(key, twice) if len(twice) else np.zeros(len(key), bool)
        yield from zip((first + slab).tolist(), np.diff(np.append(first, len(keys))).tolist(), key.view(np.int64).tolist(), inside.tolist())


def suffix_ranks(symbols: np.ndarray, seg: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place of every suffix in order, by prefix doubling from seven symbols.

    symbols: 0 for separators, bytes + 1; seg: the segment of each place; left: places up to its separator. Separators
    are ordered by segment, so no comparison goes beyond one."""
    n, start = len(symbols), 7
    wide = np.zeros(n + start, np.int64)
    wide[:n] = symbols
    key = np.zeros(n, np.int64)
    for k in range(start):
        key <<= 9
        key += np.where(left >= k, wide[k : k + n], 0)
    closed = left < start
    order = np.lexsort((np.where(closed, seg + 1, 0), key))
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | closed[order[1:]]
    group = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    size = np.diff(np.append(group, n))
    todo = order[np.repeat(size > 1, size)]
    step = start
    while len(todo):
        by = rank[todo] * n + rank[todo + step]
        turn = np.argsort(by, kind="stable")
        todo, by = todo[turn], by[turn]
        old = rank[todo]
        place = np.arange(len(todo))
        begin = np.concatenate([[True], old[1:] != old[:-1]])
        within = place - np.maximum.accumulate(np.where(begin, place, 0))
        new = np.concatenate([[True], by[1:] != by[:-1]])
        rank[todo] = old + np.maximum.accumulate(np.where(new, place, 0)) - place + within
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(todo)))
        todo = todo[np.repeat(size > 1, size)]
        step *= 2
    return rank


def long_prefixes(symbols: np.ndarray, rank: np.ndarray, seg: np.ndarray, length: int, few: int = 16) -> np.ndarray:
    """Whether each suffix in order shares at least `length` symbols with the one before, by interval expansion."""
    n = len(symbols)
    places = np.empty(n, np.int64)
    places[rank] = np.arange(n)
    before = places - 1
    #: where backward extension leads; -1 in front of a segment
    back = np.where((before >= 0) & (symbols[before] > 0), rank[before], -1)
    initial = symbols[places].astype(np.int64)
    initial[: (symbols == 0).sum()] -= np.arange((symbols == 0).sum()) + 1  # separators differ
    begin = np.flatnonzero(np.concatenate([[True], initial[1:] != initial[:-1]]))
    low, high = begin, np.append(begin[1:], n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    known[high] = True
    bwt = np.where(back >= 0, symbols[before], 0)
    present = [c for c in np.unique(bwt).tolist() if c]
    at = {c: np.flatnonzero(bwt == c) for c in present}
    #: suffixes that begin with c are consecutive; those with a predecessor c are among them in the same order
    base = {c: back[at[c][0]] for c in present}
    for _ in range(1, length):
        if not len(low):
            break
        size = high - low
        one = size == 1
        to = back[low[one]]
        to = to[to >= 0]
        lows, highs = [to], [to + 1]
        some = ~one & (size <= few)
        if some.any():
            lo, sz = low[some], size[some]
            owner = np.repeat(np.arange(len(lo)), sz)
            j = np.arange(len(owner)) - np.repeat(np.cumsum(sz) - sz, sz) + lo[owner]
            to = back[j]
            ok = to >= 0
            code = np.sort(owner[ok] * (n + 1) + to[ok])
            if len(code):
                own, to = code // (n + 1), code % (n + 1)
                char = initial[to]
                first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (char[1:] != char[:-1])]))
                lows.append(to[first])
                highs.append(to[np.append(first[1:], len(to)) - 1] + 1)
        many = size > few
        if many.any():
            lo, hi = low[many], high[many]
            for c in present:
                a, b = np.searchsorted(at[c], lo), np.searchsorted(at[c], hi)
                ok = b > a
                lows.append(base[c] + a[ok])
                highs.append(base[c] + b[ok])
        low, high = np.concatenate(lows), np.concatenate(highs)
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return ~known[:n]


def repeated_runs(texts: list[bytes], length: int) -> list[list[int]]:
    """For each text the runs (start, end, start, end...) of bytes inside a string of `length` bytes that starts twice."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + 1
    symbols[ends - 1] = 0
    seg = np.repeat(np.arange(len(texts)), sizes)
    left = ends[seg] - 1 - np.arange(len(symbols))
    rank = suffix_ranks(symbols, seg, left)
    shared = long_prefixes(symbols, rank, seg, length)
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    hit = np.flatnonzero(shared)
    starts = np.unique(np.concatenate([order[hit], order[hit - 1]]))
    out: list[list[int]] = [[] for _ in texts]
    if not len(starts):
        return out
    owner = seg[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) > length) | (np.diff(owner) > 0)]))
    last = np.append(first[1:], len(starts)) - 1
    offset = ends - sizes
    for s, a, b in zip(owner[first].tolist(), starts[first].tolist(), starts[last].tolist()):
        out[s] += [int(a - offset[s]), int(b - offset[s]) + length]
    return out


def shared_runs(windows: list[np.ndarray], least: list[int], most: list[int], words: int) -> list[list[int]]:
    """For each segment the runs (start, end, start, end...) of words inside a window that several documents hold.

    windows: hashes and places of a segment's windows; least, most: of the numbers of the documents that hold the segment."""
    size = [w.shape[1] for w in windows]
    owner = np.repeat(np.arange(len(windows)), size)
    hashes, place = np.concatenate(windows, axis=1)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    low = np.minimum.reduceat(np.array(least)[owner[order]], first)
    high = np.maximum.reduceat(np.array(most)[owner[order]], first)
    hit = np.sort(order[np.repeat(low != high, np.diff(np.append(first, len(order))))])
    out: list[list[int]] = [[] for _ in windows]
    if not len(hit):
        return out
    owner, place = owner[hit], place[hit].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(place) > words) | (np.diff(owner) > 0)]))
    last = np.append(first[1:], len(hit)) - 1
    for s, a, b in zip(owner[first].tolist(), place[first].tolist(), place[last].tolist()):
        out[s] += [a, b + words]
    return out


def _segment_rows(length: int, gram: int, words: int, word_gram: int):
    import pyarrow as pa

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            names = batch.schema.names
            owner, rows, digest = [], [], []
            for k, text in enumerate(utf8(batch.column(names.index("_text")))):
                if len(text) >= length:
                    for start, n, key, inside in segments(text, length, gram):
                        owner.append(k)
                        rows.append((start, n, key & -2, inside))
                        digest.append(xxh3_64_intdigest(text[start : start + n + length - 1]))
                if len(text) >= 2 * words - 1:
                    begin, end = word_places(text)
                    for start, n, key in word_segments(word_hashes(text, begin, end), words, word_gram):
                        owner.append(k)
                        rows.append((start, n, key | 1, False))
                        digest.append(xxh3_64_intdigest(text[begin[start] : end[start + n + words - 2]]))
            at = pa.array(owner, pa.int32())
            flat = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)).take(at) for c in ("_id", "_mark", "_row")), *(pa.array(flat[:, k]) for k in range(3)), pa.array(np.array(digest, _U).view(np.int64)), pa.array(flat[:, 3] > 0)],
                ["_id", "_mark", "_row", "_start", "_n", "_key", "_digest", "_inside"],
            )

    return run


#: A different segment as it is dealt: its text, or hashes and places of its windows of words.
_DEALT = "_key long, _digest long, _lo long, _hi long, _blocks int, _slice int, _bytes binary"


def _texts_of(length: int, words: int):
    """The bytes, or windows of words, of the wanted segments of each document."""
    import pyarrow as pa

    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            rows = []
            for text, wanted in zip(utf8(batch.column(names.index("_text"))), batch.column(names.index("_wanted")).to_pylist()):
                windows = None
                for w in wanted:
                    start, n = w["_start"], w["_n"]
                    head = (w["_key"], w["_digest"], w["_lo"], w["_hi"])
                    if not w["_key"] & 1:
                        rows.append((*head, w["_blocks"], 0, text[start : start + n + length - 1]))
                        continue
                    if windows is None:
                        windows = gram_hashes(word_hashes(text, *word_places(text)), words)
                    mine = np.array([windows[start : start + n], np.arange(n, dtype=_U)])
                    if w["_blocks"] is None:
                        rows.append((*head, None, 0, mine.tobytes()))
                        continue
                    part = mine[0] % _U(w["_blocks"])
                    for x in np.unique(part).tolist():
                        rows.append((*head, None, x, mine[:, part == x].tobytes()))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _DEALT.split(", ")])

    return run


def _compared(length: int, words: int, block: int):
    """Segments sorted by group: the repeated runs of each; whole groups are put together up to about `block` bytes."""
    import pyarrow as pa

    def run(batches):
        group, held = None, 0
        texts, windows = [], []

        def done():
            found = list(zip(texts, repeated_runs([b for *_, b in texts], length))) if texts else []
            if windows:
                pairs = [np.frombuffer(b, _U).reshape(2, -1) for *_, b in windows]
                found += zip(windows, shared_runs(pairs, [w[2] for w in windows], [w[3] for w in windows], words))
            some = [(w[0], w[1], r) for w, r in found if r]
            key, digest, runs = zip(*some) if some else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], ["_key", "_digest", "_runs"])

        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)).to_pylist() for c in ("_key", "_x", "_y", "_digest", "_lo", "_hi", "_bytes")]
            for k, x, y, d, lo, hi, b in zip(*columns):
                #: two pairs of blocks of one key hold the same segments, so they never stand in one comparison
                if group is not None and (k, x, y) != group and (held > block or k == group[0]):
                    yield done()
                    texts, windows, held = [], [], 0
                group = (k, x, y)
                (windows if k & 1 else texts).append((k, d, lo, hi, b))
                held += len(b) + 1
        if texts or windows:
            yield done()

    return run


def _merged(runs) -> list[list[int]]:
    spans: list[list[int]] = []
    for a, b in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return spans


def _cut():
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            rows = []
            for text, found in zip(utf8(batch.column(names.index("_text"))), batch.column(names.index("_found")).to_pylist()):
                runs = [(f["_words"], f["_start"] + a, f["_start"] + b) for f in found or () for a, b in zip(f["_runs"][::2], f["_runs"][1::2])]
                spans = _merged((a, b) for words, a, b in runs if not words)
                passages = _merged((a, b) for words, a, b in runs if words)
                if passages:
                    begin, end = word_places(text)
                    passages = [(int(begin[a]), int(end[b - 1])) for a, b in passages]
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(rest), [x for s in spans for x in s], rest, [x for s in passages for x in s]))
            n, removed, spans, rest, passages = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("_id")), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string()), pa.array(rest, pa.binary()),
                 pa.array([len(s) // 2 for s in passages], pa.int64()), pa.array([sum(s[1::2]) - sum(s[::2]) for s in passages], pa.int64()), pa.array(passages, pa.list_(pa.int64()))],
                ["_id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256", "kept", "n_passages", "passage_bytes", "passages"],
            )

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 128, block: int = 1_500_000, passage_words: int = 51, passage_gram: int = 16) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, removed (start and end of each removed run, in turn),
    kept_sha256 and kept, the bytes that stay; n_passages, passage_bytes and passages (start and end of each in bytes of
    the text, in turn), the runs of `passage_words` words and more that another document holds, which are not removed."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_mark"), F.col(text_col).alias("_text"))
    doc = lambda t: docs["_id"].eqNullSafe(t["_i"]) & (docs["_mark"] == t["_m"])
    owner = (F.col("_id").alias("_i"), F.col("_mark").alias("_m"))

    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows.mapInArrow(_segment_rows(length, gram, passage_words, passage_gram), f"_id {kind}, _mark long, _row long, _start long, _n long, _key long, _digest long, _inside boolean"), "segments")
    words = F.col("_key").bitwiseAND(1) == 1
    #: bytes repeat where they start twice, words where two documents hold them
    again = F.when(words, F.col("_lo") != F.col("_hi"))
    span = (F.min("_row").alias("_lo"), F.max("_row").alias("_hi"))
    keys = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_k"), F.max("_inside").alias("_in"), F.min("_digest").alias("_low"), F.max("_digest").alias("_high"), *span)
    keys = keys.where(again.otherwise(F.expr("_k > 1 or _in"))).select("_key", (F.col("_low") != F.col("_high")).alias("_differ"))
    met = stored(rows.join(keys, "_key"), "met-segments")
    place = F.struct("_id", "_mark", "_start", "_n")
    groups = met.groupBy("_key", "_digest").agg(F.count(F.lit(1)).alias("_k"), F.max("_inside").alias("_in"), F.max("_differ").alias("_differ"), F.min(place).alias("_at"), *span)
    groups = stored(groups, "segment-groups")
    open_groups = groups.where("_differ or (_in and _k = 1)").select("_key", "_digest", "_lo", "_hi", "_at._id", "_at._mark", "_at._start", "_at._n")
    #: one row for each key with too much text for a task: how many blocks
    sizes = open_groups.groupBy("_key").agg(F.sum(F.when(words, F.col("_n") * 16).otherwise(F.col("_n") + length)).alias("_bytes")).where(F.col("_bytes") > 2 * block).select("_key", F.ceil(F.col("_bytes") / block).cast("int").alias("_blocks"))
    open_groups = open_groups.join(stored(sizes, "large-keys"), "_key", "left")
    wanted = open_groups.groupBy(*owner).agg(F.collect_set(F.struct("_start", "_n", "_key", "_digest", "_lo", "_hi", "_blocks")).alias("_wanted"))
    #: a repeated row of the same document gives its segments twice
    texts = docs.join(wanted, doc(wanted)).select("_text", "_wanted").mapInArrow(_texts_of(length, passage_words), _DEALT)
    mine = F.pmod("_digest", "_blocks").cast("int")
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    pairs = F.when(F.col("_blocks").isNull(), F.array(F.struct(F.col("_slice").alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(others, lambda o: F.struct(F.least(mine, o).alias("x"), F.greatest(mine, o).alias("y"))))
    dealt = texts.withColumn("_p", F.explode(pairs)).select("_key", "_digest", "_lo", "_hi", "_bytes", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
    dealt = dealt.repartition("_key", "_x", "_y").sortWithinPartitions("_key", "_x", "_y", "_digest")
    runs = dealt.mapInArrow(_compared(length, passage_words, block), "_key long, _digest long, _runs array<long>").groupBy("_key", "_digest").agg(F.flatten(F.collect_list("_runs")).alias("_runs"))
    whole = F.when(again.otherwise(F.col("_k") > 1), F.array(F.lit(0).cast("long"), F.col("_at._n") + F.when(words, passage_words - 1).otherwise(length - 1)))
    marked = groups.join(runs, ["_key", "_digest"], "left").select("_key", "_digest", F.coalesce(whole, "_runs").alias("_runs")).where("_runs is not null")
    found = met.join(stored(marked, "repeated-segments"), ["_key", "_digest"]).groupBy(*owner).agg(F.collect_set(F.struct("_start", "_runs", words.alias("_words"))).alias("_found"))
    out = docs.join(found, doc(found), "left").select("_id", "_text", "_found").mapInArrow(_cut(), f"_id {kind}, n_bytes long, n_removed long, n_spans long, removed array<long>, kept_sha256 string, kept binary, n_passages long, passage_bytes long, passages array<long>")
    return out.withColumnRenamed("_id", id_col)
