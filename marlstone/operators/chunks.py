"""Cutting sections into chunks, as a stream over the units of a document.

Sections are dealt by document and sorted by Spark, and each becomes units (sentences, long ones cut between tokens) that
carry its path and its size, as it comes. Units are worked off in one pass: runs of sibling sections, chunks within a run,
small chunks taken in by their neighbours. Each step holds back only what may still change: a section, a run below its
limit, the last two chunks of a run, the last few chunks of a document. So a document of any length takes a task's time, not
its memory.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.sections import in_groups

TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
_tokens = re.compile(TOKEN).findall
_sentence_ends = re.compile(r"[.!?]\s+").finditer
Spans = Callable[[str], list[tuple[int, int]]]
#: Chunks of a document that may still take in the next one.
HELD = 8


def token_spans(text: str) -> list[tuple[int, int]]:
    """Where the tokens of a text stand; the default counter, the same as `token_count`."""
    return [m.span() for m in re.finditer(TOKEN, text)]


def _count(text: str, spans: Spans) -> int:
    return len(_tokens(text)) if spans is token_spans else len(spans(text))


@lru_cache(4096)
def _path_count(text: str, spans: Spans) -> int:
    """Tokens of a path or of a part of one, of which there are few."""
    return _count(text, spans)


@dataclass(frozen=True)
class ChunkSizes:
    """Token limits of chunks: packing stops at `most`, sibling sections join below `enough`, no chunk should be under
    `least`, and a continued section repeats at least `overlap` of the most. `spare` and `range_spare` are kept free for
    the path line of one section, and of a range of sections."""

    most: int = 800
    enough: int = 500
    least: int = 120
    overlap: float = 0.15
    spare: int = 16
    range_spare: int = 8


class Unit(NamedTuple):
    section: int
    path: tuple[str, ...]
    section_tokens: int
    text: str
    tokens: int


def _sentences(text: str) -> Iterator[str]:
    """A text cut at line breaks and at white space behind a sentence mark."""
    for line in text.split("\n"):
        start = 0
        for m in _sentence_ends(line):
            yield line[start : m.start() + 1].strip()
            start = m.end()
        yield line[start:].strip()


def section_units(path: list[str], text: str | None, sizes: ChunkSizes, spans: Spans, separator: str) -> list[tuple[str, int]]:
    """Sentences with their tokens: lines are hard ends, and none has more tokens than the path line leaves."""
    room = max(sizes.most - _path_count(separator.join(path), spans) - sizes.spare, 1)
    out = []
    for sentence in _sentences(text or ""):
        n = _count(sentence, spans) if sentence else 0
        if n > room:
            at = spans(sentence)
            out += [(sentence[at[a][0] : at[min(a + room, n) - 1][1]], min(room, n - a)) for a in range(0, n, room)]
        elif n:
            out.append((sentence, n))
    return out


def _sums(units: list[Unit]) -> list[int]:
    """Tokens of the first k units, for each k."""
    return [0, *accumulate(u.tokens for u in units)]


class Packer:
    """Chunks of the documents that go through it, as lists of units."""

    def __init__(self, sizes: ChunkSizes, spans: Spans, separator: str):
        self.sizes, self.spans, self.separator = sizes, spans, separator

    # --- runs of sections

    def runs(self, units: Iterable[Unit]) -> Iterator[tuple[int, Iterator[Unit]]]:
        """Runs with the tokens that a chunk of them may have. A section joins the run before it where both have one parent,
        the run has not enough yet and both together are within the most; a run that has enough needs no waiting."""
        coming = _Ahead(units)
        while (first := coming.peek()) is not None:
            taken: list[Unit] = []
            total, section = first.section_tokens, first.section
            paths = [first.path]
            while total < self.sizes.enough:
                taken += coming.while_in(section)
                following = coming.peek()
                if following is None or following.path[:-1] != first.path[:-1] or total + following.section_tokens > self.sizes.most:
                    section = None
                    break
                total, section = total + following.section_tokens, following.section
                paths.append(following.path)
            line = max(self._tokens(self.separator.join(p)) for p in paths) + max(self._tokens("".join(p[-1:])) for p in paths)
            room = max(self.sizes.most - line - self.sizes.range_spare, self.sizes.least)
            rest = iter(()) if section is None else coming.while_in(section)
            yield room, chain(taken, rest)

    def _tokens(self, text: str) -> int:
        return _path_count(text, self.spans)

    # --- chunks of a run

    def packed(self, room: int, units: Iterator[Unit]) -> Iterator[list[Unit]]:
        """Chunks of at most `room` tokens; the last one gets its share of the one before it."""
        before: list[Unit] | None = None
        chunk: list[Unit] = []
        total = 0
        for u in units:
            if chunk and total + u.tokens > room:
                if before is not None:
                    yield before
                before, chunk = chunk, self.opening(chunk, u, room)
                total = sum(x.tokens for x in chunk)
            chunk.append(u)
            total += u.tokens
        if before is not None:
            cut = self.share(before, chunk)
            yield before[:cut]
            chunk = before[cut:] + chunk
        yield chunk

    def opening(self, chunk: list[Unit], unit: Unit, room: int) -> list[Unit]:
        """What the next chunk repeats: the shortest end of this one that has the overlap, of the section that goes on and
        without the first unit; less, from the front, where the next unit would not fit behind it."""
        sums = _sums(chunk)
        own = next((k + 1 for k in range(len(chunk) - 1, -1, -1) if chunk[k].section != unit.section), 0)
        wanted = sums[-1] - int(self.sizes.overlap * self.sizes.most)
        start = max(1, own, bisect_right(sums, wanted) - 1)
        return chunk[max(start, bisect_left(sums, sums[-1] + unit.tokens - room)) :]

    def share(self, donor: list[Unit], tail: list[Unit]) -> int:
        """Where to cut the chunk before the last one: its end goes to the last one if that is too small, as little as makes
        it large enough, as long as the donor stays so itself; nothing where the last one repeats the donor's end."""
        if donor[-1] is tail[0]:
            return len(donor)
        sums = _sums(donor)
        missing = self.sizes.least - sum(u.tokens for u in tail)
        kept = max(bisect_left(sums, self.sizes.least), 1)
        return len(donor) if missing <= 0 else max(min(kept, len(donor)), bisect_right(sums, sums[-1] - missing) - 1)

    # --- small chunks

    def settled(self, chunks: Iterable[list[Unit]]) -> Iterator[list[Unit]]:
        """Small chunks join the one before them, or else the one behind, where the result renders within the most."""
        done: list[list[Unit]] = []
        coming = _Ahead(chunks)
        while (chunk := coming.take()) is not None:
            while sum(u.tokens for u in chunk) < self.sizes.least:
                if done and self.fits(done[-1] + chunk):
                    chunk = done.pop() + chunk
                elif (following := coming.peek()) is not None and self.fits(chunk + following):
                    chunk = chunk + coming.take()
                else:
                    break
            done.append(chunk)
            while len(done) > HELD:
                yield done.pop(0)
        yield from done

    def fits(self, chunk: list[Unit]) -> bool:
        return self._size(chunk, self.label(chunk)) <= self.sizes.most

    def _size(self, chunk: list[Unit], path: str) -> int:
        """Tokens of a chunk as it is written. The default counter's tokens end at white space, so they add up."""
        if self.spans is token_spans:
            return self._tokens(path) + sum(u.tokens for u in chunk)
        return len(self.spans(self._text(chunk, path)))

    @staticmethod
    def _text(chunk: list[Unit], path: str) -> str:
        return f"{path}\n" + " ".join(u.text for u in chunk)

    def label(self, chunk: list[Unit]) -> str:
        """The path of a chunk's section; of several, what their paths share and the range from the first to the last."""
        paths = [list(p) for _, p in dict.fromkeys((u.section, u.path) for u in chunk)]
        if len(paths) == 1:
            return self.separator.join(paths[0])
        shared = os.path.commonprefix(paths)
        first, last = ((p[len(shared) :] or p[-1:])[0] for p in (paths[0], paths[-1]))
        return self.separator.join([*shared, f"{first} – {last}"])

    def rendered(self, chunk: list[Unit]) -> tuple[str, str, int]:
        path = self.label(chunk)
        return path, self._text(chunk, path), self._size(chunk, path)

    def chunks(self, units: Iterable[Unit]) -> Iterator[list[Unit]]:
        return self.settled(c for room, run in self.runs(units) for c in self.packed(room, run))


class _Ahead:
    """An iterator that shows its next item."""

    def __init__(self, items: Iterable):
        self.items, self.next = iter(items), []

    def peek(self):
        if not self.next:
            self.next = [next(self.items, None)]
        return self.next[0]

    def take(self):
        item = self.peek()
        if item is not None:
            self.next = []
        return item

    def while_in(self, section: int):
        while (u := self.peek()) is not None and u.section == section:
            yield self.take()


def pack_chunks(sections: DataFrame, sizes: ChunkSizes = ChunkSizes(), spans: Spans = token_spans, separator: str = " › ") -> DataFrame:
    """Chunks of sections (doc, section_no, heading_path array<string>, text): doc, ordinal, section_path, text, token_count.

    Sentences are packed greedily within runs of sibling sections; each chunk's text opens with its path on a line of its
    own, which counts. `spans` gives the tokens of a text as (start, end); it takes any tokenizer. A sentence too long for a
    chunk is cut between tokens. A document without sentences has no chunks; a null path is empty. Sections of one document
    and number are one after the other in no given order."""
    doc = sections.schema["doc"].dataType.simpleString()

    def fold(rows):
        packer = Packer(sizes, spans, separator)
        doc_id = None

        def units():
            nonlocal doc_id
            for doc_id, number, path, text in rows:
                found = section_units(path or [], text, sizes, spans, separator)
                total, path = sum(n for _, n in found), tuple(path or ())
                yield from (Unit(number, path, total, t, n) for t, n in found)

        for k, chunk in enumerate(packer.chunks(units())):
            yield (doc_id, k, *packer.rendered(chunk))

    return in_groups(sections.select("doc", "section_no", "heading_path", "text"), ["doc"], ["section_no"], fold, f"doc {doc}, ordinal long, section_path string, text string, token_count long")


def chunk_violations(chunks: DataFrame, sizes: ChunkSizes = ChunkSizes(), band: tuple[int, int] = (500, 800), share: float = 0.02, of_at_least: int = 1) -> DataFrame:
    """What each document's chunks break: over the most, text without its path line, ordinals with gaps, more than `share`
    of them too small, median outside of `band` (for documents of `of_at_least` chunks and more)."""
    n = F.count(F.lit(1))
    small = F.avg(F.when(F.col("token_count") < sizes.least, 1.0).otherwise(0.0))
    return chunks.groupBy("doc").agg(
        n.alias("chunks"),
        F.count(F.when(F.col("token_count") > sizes.most, 1)).alias("too_large"),
        F.count(F.when(~F.col("text").startswith(F.concat("section_path", F.lit("\n"))), 1)).alias("without_path"),
        ((F.min("ordinal") != 0) | (F.max("ordinal") != n - 1) | (F.countDistinct("ordinal") != n)).alias("gaps"),
        (small > share).alias("too_many_small"),
        ((n >= of_at_least) & ~F.median("token_count").between(*band)).alias("out_of_band"),
    )
