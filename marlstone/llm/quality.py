"""Quality rules as weak supervision.

Each rule looks at one document and votes good (2), bad (1) or abstains (0). The votes of all documents are counted by
pattern; expectation-maximisation over these counts estimates how often each rule votes each way on good and on bad
documents; the posterior of a document's own pattern then decides. No rule rejects a document alone, except the base
test that the caller asks for.

Edge cases: a null text counts as empty and has no words; a document without words fails the base test; repeated rows
are judged one by one; other columns, whatever their names, are neither read nor needed. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import ASCII_SPACE, stored, text_batches, utf8

GOOD, BAD, ABSTAIN = 2, 1, 0

RULES = ("symbols", "capitals", "shouting", "repeats", "duplicate_lines", "one_word", "word_length", "enough_words", "full_stops", "function_words")

#: Frequent function words of the languages that the corpus is expected to hold.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "a an and are as at be by for from in is it of on or that the this to was with "
        "au dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
        "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
        "al con del el en es la las los no o para por que se su un una y"
    ).split()
)

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_STRIP = b".,;:!?\"'()"
_ENDS = (b".", b"!", b"?", b'"', b"'", b")", b":", "…".encode(), "»".encode(), "”".encode())

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more in the same text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (key >> np.uint64(29))
        key += each[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def features(text: bytes) -> tuple[list[int], list[int]]:
    """The base features and the votes of one text."""
    words = text.split()
    n = len(words)
    spaces = len(text) - len(text.translate(None, ASCII_SPACE))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    #: a UTF-8 code point has one byte that is not a continuation byte
    chars = len(text.translate(None, bytes(range(0x80, 0xC0)))) - spaces
    lines = [x for x in text.split(b"\n") if x.strip(ASCII_SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    base = [n, chars, symbols, dup, repeat]
    if not n:
        return base, [ABSTAIN] * len(RULES)

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    letters = len(text) - len(text.translate(None, _LETTERS))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    counts = Counter(words)
    top = max(counts.values())
    ended = sum(x.rstrip(ASCII_SPACE).endswith(_ENDS) for x in lines)
    plain = sum(c for w, c in counts.items() if w.strip(_STRIP).lower() in FUNCTION_WORDS)
    foreign = len(text) - len(text.translate(None, bytes(range(128, 256)))) > 0.3 * len(text)
    votes = [
        vote(symbols > 0.15 * n, symbols <= 0.02 * n),
        vote(letters > 20 and capitals > 0.5 * letters, letters > 0 and capitals < 0.3 * letters),
        vote(text.count(b"!") > 0.3 * n, text.count(b"!") <= 0.1 * n),
        vote(100 * repeat > 20 * n, n >= 5 and 100 * repeat <= 10 * n),
        vote(2 * dup > len(lines), len(lines) > 1 and 4 * dup <= len(lines)),
        vote(n >= 20 and top > 0.35 * n, n >= 20 and top < 0.25 * n),
        vote(not 2 * n <= chars <= 15 * n, 3 * n <= chars <= 12 * n),
        vote(n < 10, n >= 30),
        vote(n >= 30 and 10 * ended < len(lines), 2 * ended >= len(lines)),
        vote(n >= 30 and not foreign and 100 * plain < n, 100 * plain >= 8 * n),
    ]
    return base, votes


def _measure(text_col: str):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            kept = batch.column(0)
            rows = [features(x) for x in utf8(batch.column(1) if batch.num_columns > 1 else kept.field(text_col))]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(FEATURES))
            votes = np.array([r[1] for r in rows], np.int64).reshape(-1, len(RULES))
            pattern = votes @ (3 ** np.arange(len(RULES), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([kept, *(pa.array(base[:, k]) for k in range(len(FEATURES))), pa.array(pattern)], ["_q_kept", *(f"_q_{f}" for f in FEATURES), "_q_pattern"])

    return run


def measured(docs: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """`_q_kept` (the id, or without one the whole row as a struct, so that no name can clash) of each row with its base
    features (`_q_...`) and its pattern of votes."""
    text_batches(docs.sparkSession)
    if id_col is None:
        read = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_q_kept"))
    else:
        read = docs.select(F.col(id_col).alias("_q_kept"), F.col(text_col).alias("_q_text"))
    schema = f"_q_kept {read.schema['_q_kept'].dataType.simpleString()}, {', '.join(f'_q_{f} long' for f in FEATURES)}, _q_pattern long"
    return read.mapInArrow(_measure(text_col), schema)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9):
    """Posterior probability of good by pattern, and each rule's accuracy, for votes that are independent given the class.

    patterns: votes by rule, one row a pattern; counts: documents of each. Starts from the share of good votes, so that
    good means what most rules call good."""
    votes = patterns[:, :, None] == np.array([BAD, GOOD])  # an abstention says nothing
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    post = np.where(bad == 0, 0.95, np.where(bad == 1, 0.4, 0.05)) * (good + 1) / (good + 1.5)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        table = np.einsum("cp,prv->crv", weight, votes) + 0.5
        table /= table.sum(2, keepdims=True)
        score = np.log(prior)[:, None] + np.einsum("crv,prv->cp", np.log(table), votes)
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        done = np.abs(new - post).max(initial=0) < tolerance
        post = new
        if done:
            break
    weight = np.stack([counts * (1 - post), counts * post])
    right = np.einsum("p,pr->r", weight[1], patterns == GOOD) + np.einsum("p,pr->r", weight[0], patterns == BAD)
    voted = np.einsum("p,pr->r", counts.astype(float), patterns != ABSTAIN)
    return post, (right + 0.5) / (voted + 1)


def posteriors(rows: DataFrame) -> DataFrame:
    """(_q_pattern, _q_posterior) for every pattern that occurs; at most 3 ** len(RULES) rows, so the driver may hold them."""
    found = rows.groupBy("_q_pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("_q_pattern").collect()
    codes = np.array([r[0] for r in found], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(RULES), dtype=np.int64)) % 3
    post = expectation_maximisation(patterns, np.array([r[1] for r in found], np.int64))[0] if found else []
    return rows.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "_q_pattern long, _q_posterior double")


def base_failed():
    return (F.col("_q_n_words") < 10) | (100 * F.col("_q_n_repeat_words") > 20 * F.col("_q_n_words"))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: id, base features, base_failed, posterior, kept.

    The features are written once to the shared folder, as the counts and the decision both need them."""
    rows = stored(measured(docs, text_col, id_col), "quality")
    out = rows.join(F.broadcast(posteriors(rows)), "_q_pattern", "left")
    return out.select(
        F.col("_q_kept").alias(id_col),
        *(F.col(f"_q_{f}").alias(f) for f in FEATURES),
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("_q_posterior") >= threshold)).alias("kept"),
        F.col("_q_posterior").alias("posterior"),
    )


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns; texts are measured twice instead of being joined."""
    table = posteriors(measured(docs, text_col, id_col))
    full = measured(docs, text_col).join(F.broadcast(table), "_q_pattern", "left")
    return full.where(~base_failed() & (F.col("_q_posterior") >= threshold)).select("_q_kept.*")
