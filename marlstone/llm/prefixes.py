"""Token counts of every prefix.

A byte-pair encoder cuts a text into pretokens and merges bytes within each. The last token of the encoding of any byte
prefix of a pretoken is the one token that ends there and that, put behind the last token of the prefix before it,
encodes to just these two; so one pass over the bytes finds the exact count of every prefix from the counts before it.
A pretoken's counts are found once and remembered.

The pretokens of a prefix of a text are those of the text but at its end: white space at the end is one pretoken, where
in the text its last blank goes with the next word; a contraction cut short is a mark and a letter; and the name of a
special token cut short is ordinary text. So `prefix_counts` has the count of each prefix as the library gives it for
that prefix alone, and from then on truncation and budgets are lookups.

Pretokens are found by the published pattern; texts with code points that this Python does not know go to the library's
own splitter, as its Unicode tables may be newer or older than those of the pattern.

Edge cases: a null text is empty and has no tokens; null and repeated ids are rows of their own; names of special tokens
inside a text are one token each, as the library has it by default; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, takewhile

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import text_batches, utf8

#: Pretokens whose counts a worker remembers in each of two generations, and the longest remembered, in characters.
REMEMBERED, LONGEST = 300_000, 64
#: Pretokens before the end of a budget among which the longest prefix is looked for first.
NEAR = 32
#: Pairs of tokens whose verdicts a worker remembers.
PAIRS = 1_000_000
#: Bytes of text whose counts leave a worker at once.
PIECE_BYTES = 2 << 20
#: The pattern of byte-level models, and its contractions of more than one letter.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'re", "'ve", "'ll")

_COUNTERS: dict[str, Counter] = {}


def byte_characters() -> dict[int, str]:
    """How byte-level models write bytes: printable ones of Latin-1 as themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Counts of whole pretokens; the oldest generation is forgotten."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter, self.before = counter, {}

    def __missing__(self, word: str) -> int:
        n = self.before.get(word)
        if n is None:
            n = self.counter.byte_counts(word)[-1]
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


class Counter:
    """Counts the tokens of texts and of their prefixes under a byte-level byte-pair tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import re

        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        check_settings(settings)
        written = {c: chr(b) for b, c in byte_characters().items()}
        self.names: list[str] = []
        #: every token by its bytes, written as the characters of Latin-1
        self.tokens = ahocorasick.Automaton()
        for name in settings["model"]["vocab"]:
            token = "".join(written[c] for c in name)
            self.tokens.add_word(token, (len(token), len(self.names)))
            self.names.append(name)
        self.tokens.make_automaton()
        pattern = regex.compile(PATTERN)
        self.split, self.found = pattern.findall, pattern.finditer
        self.blank = regex.compile(r"\s+").fullmatch
        special = sorted((t["content"] for t in settings["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.unknown = _unknown()
        self.verdicts: dict[int, bool] = {}
        self.known = _Known(self)

    @classmethod
    def of(cls, path: str) -> Counter:
        """The counter of this worker process, which outlives a task."""
        if path not in _COUNTERS:
            _COUNTERS[path] = cls(path)
        _COUNTERS[path].known.forget()
        return _COUNTERS[path]

    # --- pretokens

    def known_only(self, piece: str) -> bool:
        return piece.isascii() or not self.unknown[np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)].any()

    def words(self, piece: str) -> list[str]:
        """The pretokens of a text without special tokens."""
        return self.split(piece) if self.known_only(piece) else self._split_by_library(piece)

    def some_words(self, piece: str) -> Iterator[str]:
        """The same one by one, as far as they are asked for."""
        return (m.group() for m in self.found(piece)) if self.known_only(piece) else iter(self._split_by_library(piece))

    def _split_by_library(self, piece: str) -> list[str]:
        return [piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """The stretches between special tokens, one more than those, and the special tokens."""
        if self.special is None:
            return [text], []
        found = self.special.findall(text)
        return (self.special.split(text), found) if found else ([text], [])

    # --- counts

    def follows(self, before: int, token: int) -> bool:
        """Whether a token can stand behind another (or, behind -1, first): both together encode to just these."""
        names = [self.names[t] for t in (before, token) if t >= 0]
        return [t.value for t in self.tokenizer.model.tokenize("".join(names))] == names

    def byte_counts(self, word: str) -> list[int]:
        """Tokens of each byte prefix of a pretoken, that of no byte first."""
        raw = word if word.isascii() else word.encode("utf-8", "replace").decode("latin-1")
        verdicts = self.verdicts
        if len(verdicts) > PAIRS:
            verdicts.clear()
        last, counts = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        for end, (size, token) in self.tokens.iter(raw):
            if last[end + 1] < 0:
                before = last[end + 1 - size]
                key = before << 32 | token
                verdict = verdicts.get(key)
                if verdict is None:
                    verdict = verdicts[key] = self.follows(before, token)
                if verdict:
                    last[end + 1] = token
                    counts[end + 1] = counts[end + 1 - size] + 1
        return counts

    def word_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a pretoken by characters, from the first on."""
        counts = self.byte_counts(word)
        if word in CONTRACTIONS:
            counts[2] = sum(self.known[w] for w in self.split(word[:2]))
        if word.isascii():
            return counts[1:]
        ends = accumulate(len(c.encode("utf-8", "replace")) for c in word)
        return [counts[e] for e in ends]

    def count(self, text: str) -> int:
        pieces, special = self.pieces(text)
        known = self.known
        return len(special) + sum(sum(map(known.__getitem__, self.words(p))) for p in pieces)

    def stretches(self, text: str):
        """The text as stretches in order: start, tokens before it, the word, and a function of it that gives how many
        tokens more each prefix up to each of its characters has; one at least."""
        at = total = 0
        pieces, special = self.pieces(text)
        for piece, name in zip(pieces, [*special, None]):
            tail, before = "", total
            for at, before, tail, counts in self._stretches(self.some_words(piece), at, total):
                yield at, before, tail, counts
            if tail:
                at, total = self._end(at, before, tail, counts)
            if name is not None:
                #: cut short, the name is text behind the last pretoken
                cut = [sum(map(self.known.__getitem__, self.words(tail + name[:j]))) for j in range(1, len(name))]
                yield at, before, name, lambda w, c=(*cut, total + 1 - before): list(c)
                at, total = at + len(name), total + 1

    def _stretches(self, words: Iterator[str], at: int, total: int):
        """The stretches of a text without special tokens."""
        for blank, word in _with_blanks(words, self.blank):
            joined = bool(blank) and word.startswith(" ")
            if blank:
                #: white space is one pretoken as long as a prefix ends in it; then its last blank goes with the word
                yield at, total, "".join(blank) + " " * joined, self.word_counts
                at, total = at + sum(map(len, blank)), total + sum(map(self.known.__getitem__, blank))
            if word:
                yield at + joined, total, word, self._behind_blank if joined else self.word_counts
                at, total = at + len(word), total + self.known[word]

    def _end(self, at: int, before: int, word: str, counts) -> tuple[int, int]:
        """Where the text and its tokens stand behind its last stretch."""
        found = counts(word)
        return at + len(found), before + found[-1]

    def _behind_blank(self, word: str) -> list[int]:
        return self.word_counts(word)[1:]

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text and characters of its longest prefix within the budget; texts without special tokens are split
        once for both."""
        if self.special is not None and self.special.search(text):
            n = self.count(text)
            return n, len(text) if n <= budget else self.longest_prefix(text, budget)
        words = self.words(text)
        upto = list(accumulate(map(self.known.__getitem__, words)))
        n = upto[-1] if upto else 0
        if n <= budget:
            return n, len(text)
        #: the last pretokens that begin within the budget, from one on that stands behind no white space
        end = bisect_left(upto, budget) + 1
        first = max(end - NEAR, 0)
        while first and self.blank(words[first - 1]):
            first -= 1
        tail = self._stretches(iter(words[first:]), sum(map(len, words[:first])), upto[first - 1] if first else 0)
        return n, self._within(tail, budget) or self.longest_prefix(text, budget)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix of the text by characters, from the first on."""
        out = np.zeros(len(text), np.int32)
        for at, before, word, counts in self.stretches(text):
            found = counts(word)
            out[at : at + len(found)] = found
            out[at : at + len(found)] += before
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens. Every prefix that ends in a stretch has more
        tokens than stand before it, so the last stretches with less than the budget before them are enough."""
        return self._within(self.stretches(text), budget)

    def _within(self, stretches, budget: int) -> int:
        for at, before, word, counts in reversed(list(takewhile(lambda s: s[1] < budget, stretches))):
            found = counts(word)
            for j in range(len(found), 0, -1):
                if before + found[j - 1] <= budget:
                    return at + j
        return 0


def _with_blanks(words: Iterator[str], is_blank) -> Iterator[tuple[list[str], str]]:
    """Pretokens with those of white space before them; an empty one behind white space at the end."""
    blank: list[str] = []
    for word in words:
        if is_blank(word):
            blank.append(word)
        else:
            yield blank, word
            blank = []
    if blank:
        yield blank, ""


def _unknown() -> np.ndarray:
    """Which code points have no entry in this Python's tables."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def check_settings(settings: dict) -> None:
    """Refuse a tokenizer that is no plain byte-level byte-pair encoder."""
    model, splitter = settings["model"], settings.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and settings.get("normalizer") is None
        and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
        and not any(t.get(k) for t in settings.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
        and set(byte_characters().values()) <= set(model["vocab"])
    )
    if not plain:
        raise ValueError("the tokenizer must be a byte-level byte-pair encoder without normaliser, with the usual pattern and a token for each byte")


# --- over documents


def _texts(column) -> list[str]:
    return [t.decode("utf-8", "replace") for t in utf8(column)]


def _totals(path: str, id_col: str, budget: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            counter = Counter.of(path)
            raw = utf8(batch.column(1))
            texts = [t.decode("utf-8", "replace") for t in raw]
            tokens, kept = zip(*(counter.measure(t, budget) for t in texts)) if texts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > budget for n in tokens]), pa.array(kept, pa.int64())],
                [id_col, "n_bytes", "n_tokens", "over_limit", "fitting_chars"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens, over_limit (more than `budget` tokens) and fitting_chars, the
    code points of its longest prefix within the budget."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    return docs.select(id_col, text_col).mapInArrow(_totals(tokenizer_path, id_col, budget), schema)


def _prefixes(path: str, id_col: str, text_col: str):
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            raw = utf8(whole.column(1))
            upto = np.cumsum([len(r) for r in raw])
            edges = [0, *(np.flatnonzero(np.diff(upto // PIECE_BYTES)) + 1).tolist(), len(raw)]
            for a, b in zip(edges, edges[1:]):
                counter = Counter.of(path)
                counts = [counter.prefix_counts(r.decode("utf-8", "replace")) for r in raw[a:b]]
                at = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)
                values = np.concatenate([*counts, np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [
                        whole.column(0).slice(a, b - a), whole.column(1).slice(a, b - a),
                        pa.array([int(c[-1]) if len(c) else 0 for c in counts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(values, pa.int32())),
                    ],
                    [id_col, text_col, "n_tokens", "prefix_tokens"],
                )

    return run


def prefix_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n_tokens and prefix_tokens, the tokens of each prefix by code points. Written once, it answers every
    question below without encoding again; neighbouring counts differ by little, so files of it are small."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_prefixes(tokenizer_path, id_col, text_col), f"`{id_col}` {kind}, `{text_col}` string, n_tokens long, prefix_tokens array<int>")


def tokens_of(chars: Column | int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the prefix of so many code points; all of a shorter text."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(prefix_tokens)).cast("int")
    return F.when(at > 0, F.element_at(prefix_tokens, at)).otherwise(0).cast("long")


def fitting_chars(budget: int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Code points of the longest prefix with at most `budget` tokens."""
    fits = F.reverse(F.transform(prefix_tokens, lambda n: n <= budget))
    found = F.array_position(fits, True)
    return F.when(found > 0, F.size(prefix_tokens) + 1 - found).otherwise(0).cast("long")


def truncated(table: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """The table with each text cut to its longest prefix within the budget."""
    cut = fitting_chars(budget)
    return table.withColumns({text_col: F.substring(F.coalesce(F.col(text_col), F.lit("")), F.lit(1), cut.cast("int")), "n_tokens": tokens_of(cut)}).drop("prefix_tokens")


def budget_totals(table: DataFrame, budgets: list[int]) -> DataFrame:
    """For each budget a document may have: the documents above it, and the tokens and code points that all keep."""
    asked = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("budget"), (F.col("n_tokens") > b).alias("over"), fitting_chars(b).alias("chars")) for b in budgets]))
    rows = table.select("prefix_tokens", asked.alias("q")).select("q.budget", "q.over", "q.chars", tokens_of(F.col("q.chars")).alias("tokens"))
    return rows.groupBy("budget").agg(F.count_if("over").alias("n_over"), F.sum("tokens").alias("kept_tokens"), F.sum("chars").alias("kept_chars"))
