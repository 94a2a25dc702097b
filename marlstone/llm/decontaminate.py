"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items make one automaton. Each document's words are streamed through it with the
length of the longest match that ends at each word, held at `width`: at that length the automaton's state is a window
of some items, and shorter items are found on the state's suffix links. Words inside a window or a whole short item are
hit; runs of hit words are the spans to remove.

Stretches of a document without enough consecutive item trigrams can't hold a window and aren't streamed.

The automaton is built by the driver and broadcast for at most `words_per_automaton` benchmark words (about 0.7 kB a word
in each worker); a larger benchmark is split by item, and the documents are read against one automaton after the other.

Edge cases: null texts and texts without words have no hits; items without words are ignored; repeated items count once;
a null item id counts as an empty string; repeated documents are judged row by row; an empty benchmark hits nothing;
other columns pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import MADE, drop, stored, text_batches, utf8

#: Bytes that are no part of a word become spaces and A-Z becomes lower case; offsets stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, and where windows and whole short items stand in it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width, self.ids, self.next, self.link, self.length = width, {}, [{}], [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.windows: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for name, codes in coded:
            state = size = 0
            for c in codes:
                state, size = self.step(state, size, c)
                if size == width:
                    self.windows.setdefault(state, set()).add(name)
            if len(codes) < width:
                self.whole.setdefault(state, []).append((len(codes), name))
        self.shortest = min([width, *(len(codes) for _, codes in coded)]) if coded else 0
        self.short_above = [False] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_above[s] = s in self.whole or self.short_above[self.link[s]]
        self.grams = np.zeros(1 << 20, bool)
        self.gram = min(3, self.shortest)
        for _, codes in coded:
            if len(codes) >= self.gram:
                self.grams[self._gram_keys(np.array(codes, np.int64))] = True

    def _gram_keys(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - self.gram + 1
        key = np.zeros(max(n, 0), np.int64)
        for k in range(self.gram):
            key = key * 1_000_003 + codes[k : k + max(n, 0)] + 1
        return (key ^ (key >> 21)) & (len(self.grams) - 1)

    def _new(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for q's string through p, which q must give up."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        here, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = here
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[here] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return here

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The longest match, of at most `width` words, after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        if c not in self.next[state]:
            return 0, 0
        state, size = self.next[state][c], min(size + 1, self.width)
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state, size

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Parts of a document that may hold a window: runs of item n-grams, long enough."""
        if not self.shortest or len(codes) < self.shortest:
            return []
        known = self.grams[self._gram_keys(codes)]
        if self.gram > 1:
            inside = codes >= 0
            for k in range(self.gram):
                known = known & inside[k : k + len(known)]
        else:
            known = known & (codes >= 0)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        return [(a, b + self.gram - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a + self.gram - 1 >= self.shortest]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words as (first, end), merged, and the items that hit."""
        codes = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        runs: list[list[int]] = []
        items: set[str] = set()

        def hit(start: int, end: int) -> None:
            while runs and start <= runs[-1][1]:
                last = runs.pop()
                start, end = min(start, last[0]), max(end, last[1])
            runs.append([start, end])

        for a, b in self.stretches(codes):
            state = size = 0
            for i, c in enumerate(codes[a:b].tolist(), a + 1):
                state, size = self.step(state, size, c)
                if size == self.width:
                    items |= self.windows.get(state, set())
                    hit(i - size, i)
                up = state
                while up and self.short_above[up]:
                    for n, name in self.whole.get(up, ()):
                        if n <= size:
                            items.add(name)
                            hit(i - n, i)
                    up = self.link[up]
        return [tuple(r) for r in runs], items


def item_parts(benchmark: DataFrame, item_col: str, text_col: str, words_per_automaton: int):
    """The items, (name, text), in parts of about `words_per_automaton` words; one part is fetched at a time."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // (6 * words_per_automaton)) or 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k).collect() if parts > 1 else items.collect()
        yield k == parts - 1, sorted((r[0], words_of(r[1].encode())) for r in rows)


def _union(runs) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without(text: bytes, runs) -> str:
    """The text without the words of `runs` and what stands between them."""
    if not runs:
        return text.decode("utf-8", "replace")
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def _scan(table, text_col: str, cut: bool):
    import pyarrow as pa

    def run(batches):
        automaton = table.value
        for batch in batches:
            names = batch.schema.names
            columns = {n: batch.column(k) for k, n in enumerate(names)}
            texts = utf8(columns["row"].field(text_col))
            before = columns["runs"].to_pylist() if "runs" in columns else repeat([])
            others = columns["items"].to_pylist() if "items" in columns else repeat([])
            runs, items, counts = [], [], []
            for text, r, i in zip(texts, before, others):
                words = words_of(text)
                here, found = automaton.match(words)
                runs.append(_union([*zip(r[::2], r[1::2]), *here]))
                items.append(sorted({*i, *found}, key=str.encode))
                counts.append(len(words))
            rest = [without(t, r) if cut and r else None for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays(
                [
                    columns["row"],
                    pa.array(counts, pa.int64()),
                    pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                    pa.array([[x for run in r for x in run] for r in runs], pa.list_(pa.int64())),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(rest, pa.string()),
                ],
                ["row", "n_words", "n_hit", "runs", "items", "rest"],
            )

    return run


def matched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, words_per_automaton: int = 200_000, cut: bool = False) -> DataFrame:
    """For each row of `docs`: row (all of its columns), n_words, n_hit (words hit), runs (first word and end of each run of
    hit words, in turn), items (that occur) and, with `cut`, rest (the text without these runs; null where there are none).

    Of several automatons one is held at a time: the result of a part is written before the next part is built."""
    spark = docs.sparkSession
    text_batches(spark)
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    fields = f"row {out.schema['row'].dataType.simpleString()}, n_words long, n_hit long, runs array<long>, items array<string>, rest string"
    written: list[str] = []
    for last, items in item_parts(benchmark, item_col, item_text_col, words_per_automaton):
        table = spark.sparkContext.broadcast(Automaton(items, width))
        out = out.mapInArrow(_scan(table, text_col, cut and last), fields)
        if not last:
            out = stored(out, "matched-part")
            table.unpersist()
            drop(spark, written)
            written = MADE[-1:]
    return out


def contaminated(cover: int = 20):
    return (F.col("n_hit") > 0) & (cover * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, cover: int = 20) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = matched(docs.select(id_col, text_col), benchmark, text_col, width=width)
    return rows.select(
        F.col("row").getField(id_col).alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(cover).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 13, cover: int = 20, length_col: str | None = None) -> DataFrame:
    """The rows of `docs` that are not contaminated; hit runs are cut from their texts (`length_col` then gets the new length)."""
    rows = matched(docs, benchmark, text_col, width=width, cut=True).where(~contaminated(cover))
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    if length_col:
        columns[length_col] = F.coalesce(F.length("rest").cast(docs.schema[length_col].dataType), columns[length_col])
    columns[text_col] = F.coalesce("rest", columns[text_col])
    return rows.select(*(value.alias(c) for c, value in columns.items()))
