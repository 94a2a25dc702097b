"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are hashed word n-grams. The columns are cut into blocks by hash
range; a row's entries in a block are its part there. Two rows whose Jaccard similarity is at least t differ in at most
D(n) = (1 - t) / t * n entries, n the size of either, so in at most D(n) blocks. Of the first D(n) + 1 blocks where a row
has entries at least one is therefore equal in both rows, and the first equal one is among the other row's first
D + 1 as well: only pairs of rows that meet in an equal block can qualify, and only these blocks are dealt out (about a
fifth of the entries). The number of blocks follows the size class of a row; rows near the upper bound of their class
use the next class too. Rows that leave too many blocks empty deal out their first entries one by one as well (the same
bound, with blocks of one column).

Pairs that meet are first held against size-derived bounds. Each row has a sketch, the parities of its entries by column
modulo a power of two; every parity in which two rows differ is an entry in which they differ, so more of them than the
two sizes allow rule a pair out. For what remains, overlap counts are accumulated over column ranges, and a pair is
dropped as soon as what is left can't reach the bound.

Only components are asked for, so pairs that are already connected need no count. In each meeting, rows are first
counted against the row that the sketches put closest and against the row with the most others within its bounds, and once
more for what is still apart; then, among rows of one meeting that are still in different
components, every pair within the bounds is counted. Each round names the rows of a meeting of which it left pairs within
the bounds uncounted, and only these are dealt out again. No link between different sets is lost. Equal sets are one row of
the matrix, and meetings of the same rows are one meeting.

Hashes have 64 bits, digests of sets 128.

Edge cases: null texts and texts without words are empty sets, linked with nothing; a text of fewer words than n is one
n-gram; rows that repeat an id are one document, linked through any of their texts; a null id is an id of its own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import hashable, stored, text_batches, utf8
from marlstone.llm.graph import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_NO_ID = -(1 << 63)

#: Ids up to this many are broadcast (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members that are counted against one row in one task.
MEMBERS = 2_000
#: Members of a meeting of which a task holds all pairs against the bounds; larger meetings are split into blocks.
MEETING = 8_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def incidence(text: bytes, n: int) -> np.ndarray:
    """The sorted hashes of the distinct n-grams of a text's words."""
    from xxhash import xxh3_64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, _U)
    each = np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))
    width = min(n, len(words))
    key = np.full(len(words) - width + 1, width, _U)
    for k in range(width):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + each[k : k + len(key)])
    return np.unique(key)


def differing(n: int, percent: int) -> int:
    """The most entries in which a row of n entries differs from one of at least `percent` similarity."""
    return (100 - percent) * (100 * n // percent) // 100


def size_class(n: int) -> int:
    return n.bit_length() - 1


def column_blocks(cls: int, percent: int) -> int:
    most = differing((2 << cls) - 1, percent)
    return 1 if not most else (most + 1) * 27 // 25 + 8


def parts(row: np.ndarray, percent: int) -> np.ndarray:
    """The keys of the blocks that a row deals out."""
    n = len(row)
    if not n:
        return np.zeros(0, _U)
    need = differing(n, percent) + 1
    cls = size_class(n)
    classes = [cls, cls + 1] if 100 * n // percent >= 2 << cls else [cls]
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(row + _U(0x632BE59BD9B4E019)), dtype=_U)])
    out, scarce = [], False
    for c in classes:
        blocks = column_blocks(c, percent)
        at = ((row >> _U(32)) * _U(blocks)) >> _U(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        end = np.append(first[1:], n)
        scarce |= len(first) < need
        first, end = first[:need], end[:need]
        out.append(mixed(sums[end] - sums[first] + mixed(at[first] * _U(64) + _U(c + 1))))
    if scarce:
        out.append(mixed(row[:need] ^ _U(0xD6E8FEB86659FD93)))
    return np.unique(np.concatenate(out))


def sketch(row: np.ndarray) -> bytes:
    """Parities of a row's entries by column modulo a power of two of two to four times its size, 64 at least."""
    bits = max(64, 4 << size_class(len(row))) if len(row) else 64
    odd = np.bincount((row & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_differing(a, b, percent: int):
    """The most entries in which similar rows of a and b entries differ."""
    return a + b - 2 * -(-percent * (a + b) // (100 + percent))


def halved(sketches: np.ndarray) -> np.ndarray:
    """Sketches for half as many columns."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


class Meeting:
    """Rows that meet: their sizes, components and sketches, by sketch width."""

    def __init__(self, nodes, comps, sizes, sketches):
        self.nodes, self.comps, self.sizes = np.array(nodes, np.int64), np.array(comps, np.int64), np.array(sizes, np.int64)
        width = np.array([len(x) for x in sketches]) // 8
        self.groups = {w: (at := np.flatnonzero(width == w), np.frombuffer(b"".join(sketches[k] for k in at), _U).reshape(len(at), w)) for w in np.unique(width).tolist()}

    def _against(self, i: int, one: np.ndarray, at: np.ndarray, table: np.ndarray, percent: int):
        """Of the rows `at` those within the bounds of row i and in another component, and by how much they are within."""
        a, b = self.sizes[i], self.sizes[at]
        ok = (self.comps[at] != self.comps[i]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        at, table, b = at[ok], table[ok], b[ok]
        over = np.bitwise_count(table ^ one).sum(1, dtype=np.int64) - most_differing(a, b, percent)
        return at[over <= 0], over[over <= 0]

    def pairs(self, percent: int, side: np.ndarray | None = None):
        """(i, others, by how much) within the bounds and of different components, each pair once; with `side`, only of different sides."""
        for w, (at, table) in self.groups.items():
            double = self.groups.get(2 * w)
            wider = (double[0], halved(double[1])) if double else None
            for k, i in enumerate(at.tolist()):
                found = [self._against(i, table[k], at[k + 1 :], table[k + 1 :], percent)]
                if wider:
                    found.append(self._against(i, table[k], *wider, percent))
                j, over = (np.concatenate(x) for x in zip(*found))
                if side is not None:
                    j, over = j[side[j] != side[i]], over[side[j] != side[i]]
                if len(j):
                    yield i, j, over

    def row(self, i: int, percent: int, side: np.ndarray | None = None) -> np.ndarray:
        """The others within the bounds of row i and in another component; with `side`, only of the other side."""
        found = [np.zeros(0, np.int64)]
        width, one = next((w, table[at == i][0]) for w, (at, table) in self.groups.items() if (at == i).any())
        for w, (at, table) in self.groups.items():
            if w == width:
                found.append(self._against(i, one, at, table, percent)[0])
            elif w == 2 * width:
                found.append(self._against(i, one, at, halved(table), percent)[0])
            elif width == 2 * w:
                found.append(self._against(i, halved(one[None])[0], at, table, percent)[0])
        j = np.concatenate(found)
        return j if side is None else j[side[j] != side[i]]

    def best(self, percent: int, side: np.ndarray | None = None):
        """(pairs, rows of other pairs that are left): the closest row of each row, and all of the row with the most within its bounds."""
        n = len(self.nodes)
        closest, least, degree = np.full(n, -1), np.full(n, 1), np.zeros(n, np.int64)
        for i, j, over in self.pairs(percent, side):
            degree[i] += len(j)
            degree[j] += 1
            k = int(over.argmin())
            if over[k] < least[i]:
                closest[i], least[i] = j[k], over[k]
            nearer = over < least[j]
            closest[j[nearer]], least[j[nearer]] = i, over[nearer]
        if not degree.any():
            return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(closest >= 0)
        hub = int(degree.argmax())
        others = self.row(hub, percent, side)
        taken = np.concatenate([np.stack([some, closest[some]], 1), np.stack([np.full(len(others), hub), others], 1)])
        taken = np.unique(np.sort(taken, axis=1), axis=0)
        return taken, np.flatnonzero(degree > np.bincount(taken.ravel(), minlength=n))


def overlap(a: np.ndarray, b: np.ndarray, percent: int, ranges: int = 4) -> bool:
    """Whether two rows are similar; counts by column range and stops where the bound is out of reach."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    #: least overlap i with 100 * i >= percent * (len(a) + len(b) - i)
    bound = -(-percent * (len(a) + len(b)) // (100 + percent))
    count, done = 0, 0
    for k in range(1, ranges + 1):
        upto = len(small) * k // ranges
        piece = small[done:upto]
        at = np.searchsorted(large, piece)
        count += int((large[np.minimum(at, len(large) - 1)] == piece).sum())
        done = upto
        if count + len(small) - done < bound:
            return False
    return count >= bound


def _rows(n: int, percent: int):
    import pyarrow as pa

    def run(batches):
        from xxhash import xxh3_128_digest

        seen = set()
        for batch in batches:
            names = batch.schema.names
            sizes, high, low, keys, prints = [], [], [], [], []
            for text in utf8(batch.column(names.index("_text"))):
                row = incidence(text, n)
                d = xxh3_128_digest(row.tobytes())
                sizes.append(len(row))
                high.append(int.from_bytes(d[:8], "big", signed=True))
                low.append(int.from_bytes(d[8:], "big", signed=True))
                keys.append(parts(row, percent).view(np.int64) if d not in seen else np.zeros(0, np.int64))
                seen.add(d)
                prints.append(sketch(row))
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("_id")), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["_id", "_n", "_hi", "_lo", "_sketch", "_keys"],
            )

    return run


def _bounded(percent: int, near: bool):
    """Rows sorted by meeting: the pairs within the bounds; with `near`, only the closest of each row and those of the row
    with the most, and the rows, with their meeting's key, of which pairs are left."""
    import pyarrow as pa

    def run(batches):
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        more: list[np.ndarray] = []
        group, members = None, []

        def close():
            if len(members) < 2:
                return
            nodes, comps, sizes, prints, blocks = zip(*members)
            met = Meeting(nodes, comps, sizes, prints)
            side = np.array(blocks) if group[1] != group[2] else None
            if near:
                taken, others = met.best(percent, side)
                left.append(met.nodes[taken[:, 0]])
                right.append(met.nodes[taken[:, 1]])
                keys.append(np.full(len(others), group[0]))
                more.append(met.nodes[others])
                return
            for i, j, _ in met.pairs(percent, side):
                left.append(np.full(len(j), met.nodes[i]))
                right.append(met.nodes[j])

        def flush():
            a, b, k, node = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right, keys, more))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            none = pa.nulls(len(both), pa.int64())
            columns = [[both[:, 0], node], [both[:, 1], node], [none, pa.array(k)]]
            for held in (left, right, keys, more):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(map(pa.array, x)) for x in columns], ["a", "b", "key"])

        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("_key", "_x", "_y", "_node", "_comp", "_n", "_sketch", "_own")]
            for k, x, y, *member in zip(*columns):
                if (k, x, y) != group:
                    close()
                    group, members = (k, x, y), []
                    if sum(map(len, left)) + sum(map(len, more)) > 100_000:
                        yield flush()
                members.append(member)
        close()
        yield flush()

    return run


def bounded_pairs(met: DataFrame, rows: DataFrame, found: DataFrame | None, percent: int, near: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b, distinct) of the meetings `met` (_key, _node) that the bounds of `rows` (_node, _n, _sketch) allow and
    that are in different components of `found`; and the rows of `met` of which such pairs are left, none unless `near`."""
    placed = met
    if found is not None:
        placed = met.join(found.select(F.col("node").alias("_node"), F.col("component").alias("_comp")), "_node", "left").withColumn("_comp", F.coalesce("_comp", "_node"))
        apart = placed.groupBy("_key").agg(F.min("_comp").alias("_l"), F.max("_comp").alias("_h")).where("_l <> _h").select("_key")
        placed = placed.join(apart, "_key", "left_semi")
    else:
        placed = placed.withColumn("_comp", F.col("_node"))
    blocks = placed.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("_blocks"))
    placed = placed.join(blocks, "_key").withColumn("_own", F.pmod(F.xxhash64("_node"), "_blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least(F.col("_own"), o).alias("x"), F.greatest(F.col("_own"), o).alias("y")))
    dealt = placed.select("_key", "_node", "_comp", "_own", F.explode(others).alias("_p")).select("_key", "_node", "_comp", "_own", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
    dealt = dealt.join(rows, "_node").repartition("_key", "_x", "_y").sortWithinPartitions("_key", "_x", "_y", "_n", "_node")
    out = stored(dealt.mapInArrow(_bounded(percent, near), "a long, b long, key long"), "bounded")
    return out.where("key is null").select("a", "b").distinct(), out.where("key is not null").select(F.col("key").alias("_key"), F.col("a").alias("_node")).distinct()


def _counted(n: int, percent: int):
    """Rows sorted by block, the block's own row first: the pairs that are similar."""
    import pyarrow as pa

    def run(batches):
        block, own = None, []
        for batch in batches:
            names = batch.schema.names
            a, salt, b = (batch.column(names.index(c)).to_pylist() for c in ("_a", "_salt", "_b"))
            texts = utf8(batch.column(names.index("_text")))
            left, right = [], []
            for x, s, y, t in zip(a, salt, b, texts):
                if (x, s) != block:
                    block, own = (x, s), []
                row = incidence(t, n)
                if x == y:
                    own.append(row)
                elif any(overlap(o, row, percent) for o in own):
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def links(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The `pairs` (a < b) whose texts in `docs` (_id, _text) are similar; stored.

    A block is a row and at most about MEMBERS others that it is counted against; rows with more have several blocks."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    ids = stored(ids, "paired")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "_id", "left_semi")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("_salts"))
    member = pairs.join(salts, "a").select(F.col("a").alias("_a"), F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int").alias("_salt"), F.col("b").alias("_id"))
    own = salts.select(F.col("a").alias("_a"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.col("a").alias("_id"))
    rows = member.unionByName(own).join(texts, "_id").select("_a", "_salt", F.col("_id").alias("_b"), "_text")
    dealt = rows.repartition("_a", "_salt").sortWithinPartitions("_a", "_salt", F.col("_a") != F.col("_b"))
    return stored(dealt.mapInArrow(_counted(n, percent), "a long, b long"), "links")


def component_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row a document: _id, _n (entries of its row) and _component."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.col(text_col).alias("_text"))
    rows = stored(docs.mapInArrow(_rows(n, percent), "_id long, _n long, _hi long, _lo long, _sketch binary, _keys array<long>"), "incidence")
    full = rows.where("_n > 0")
    #: equal sets: one row of the matrix stands for all
    equal = full.groupBy("_hi", "_lo").agg(F.min("_id").alias("_rep"), F.max("_id").alias("_last")).where("_rep <> _last").drop("_last")
    equal = stored(equal, "equal-sets")
    named = stored(full.select("_id", "_hi", "_lo").join(equal, ["_hi", "_lo"]).where("_id <> _rep").select("_id", "_rep").distinct(), "copies")
    #: an id of several sets keeps its own name where it meets others: the name of one of its sets says nothing of the rest
    several = full.groupBy("_id").agg(F.min(F.struct("_hi", "_lo")).alias("_l"), F.max(F.struct("_hi", "_lo")).alias("_h")).where("_l <> _h").select("_id")
    copies = named.join(several, "_id", "left_anti")

    #: meetings of the same rows are one; they have equal counts, sums and exclusive ors of hashed ids
    met = full.select(F.explode("_keys").alias("_key"), "_id")
    at = Window.partitionBy("_key")
    met = met.withColumn("_size", F.count(F.lit(1)).over(at)).where("_size > 1").withColumn("_sum", F.struct(F.sum(F.shiftright(F.xxhash64("_id"), 33)).over(at).alias("s"), F.bit_xor(F.xxhash64("_id")).over(at).alias("x")))
    met = stored(met, "meetings")
    kept = met.groupBy("_size", "_sum").agg(F.min("_key").alias("_key")).select("_key")
    met = met.select("_key", "_id").join(kept, "_key", "left_semi").join(copies, "_id", "left").select("_key", F.coalesce("_rep", "_id").alias("_node")).distinct()
    met = stored(met, "met-rows")
    nodes = met.select("_node").distinct()
    prints = stored(full.select(F.col("_id").alias("_node"), "_n", "_sketch").join(nodes, "_node", "left_semi"), "sketches")

    #: an id that stands in several sets joins them
    own = named.join(full.groupBy("_id").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1"), "_id").select(F.col("_id").alias("a"), F.col("_rep").alias("b"))
    pairs, left = bounded_pairs(met, prints, None, percent, True)
    edges = links(pairs, docs, n, percent).union(own)
    found = components(edges)
    for near in (True, False):
        if left.isEmpty():
            break
        pairs, left = bounded_pairs(left, prints, found, percent, near)
        more = links(pairs, docs, n, percent)
        if not more.isEmpty():
            edges = edges.union(more)
            found = components(edges)
    out = rows.select("_id", "_n", "_hi", "_lo").join(equal, ["_hi", "_lo"], "left").withColumn("node", F.when(F.col("_n") > 0, F.coalesce("_rep", "_id")).otherwise(F.col("_id")))
    return out.join(found, "node", "left").select("_id", "_n", F.coalesce("component", "node").alias("_component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id that links lead to, its own included)."""
    rows = component_rows(docs, id_col, text_col, n, percent)
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).cast(docs.schema[id_col].dataType)
    return rows.select(back("_id").alias(id_col), F.col("_n").alias("n_shingles"), back("_component").alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row of `docs` for each component, all columns kept: the one of the least id, rows without an id last.

    Rows are told apart by id and text, not by id alone: rows that share an id, or have none, but differ in text are
    different documents; rows with the same id and text are one, of which one stays. Each has 64 bits of a hash of both as
    its name."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    named = docs.select(row, F.xxhash64(id_col, text_col, F.col(id_col).isNull()).alias("_name"), F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))
    found = component_rows(named.select("_name", "_text"), "_name", "_text", n, percent).select(F.col("_id").alias("_name"), "_component").distinct()
    order = F.min(F.struct(F.col("_own").isNull().alias("none"), "_own", "_name"))
    ids = named.select("_name", "_own").distinct()
    kept = stored(found.join(ids, "_name").groupBy("_component").agg(order.alias("_least")).select("_least._name"), "kept")
    #: exact repeats of a row share its name
    again = stored(named.groupBy("_name").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_name"), "repeated-rows")
    #: of repeats the one whose further columns have the least hash; maps and variants have none
    plain = [F.col(f"_row.`{c}`") for c in hashable(docs)]
    rows = named.select("_row", "_name").join(kept, "_name", "left_semi")
    if again.isEmpty():
        return rows.select("_row.*")
    single = rows.join(again, "_name", "left_anti")
    one = rows.join(again, "_name", "left_semi").groupBy("_name").agg(F.min_by("_row", F.xxhash64(*plain)).alias("_row"))
    return single.select("_row.*").union(one.select("_row.*"))
