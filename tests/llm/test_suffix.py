"""Substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from marlstone.llm.suffix import dedup_substrings, repeated_runs


def brute(texts, length):
    starts = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            starts.setdefault(t[p : p + length], []).append((i, p))
    cover = [bytearray(len(t)) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for i, p in places:
                cover[i][p : p + length] = b"\1" * length
    out = []
    for t, c in zip(texts, cover):
        kept = bytes(x for x, y in zip(t, c) if not y)
        spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        out.append((len(t), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    return out


def joined(runs):
    out = []
    for a, b in zip(runs[::2], runs[1::2]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_interval_expansion(seed):
    rnd = random.Random(seed)
    length = rnd.choice([3, 5, 9, 20])
    alphabet = bytes(rnd.sample(range(256), rnd.choice([1, 2, 3, 10])))
    texts = [bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(rnd.randrange(1, 8))]
    texts += rnd.choice([[], [texts[0]], [texts[0][:20] + b"x" + texts[-1]], [(texts[0][:4] or b"a") * 20]])
    for text, runs, (_, removed, spans, _) in zip(texts, repeated_runs(texts, length), brute(texts, length)):
        runs = joined(runs)
        assert (sum(runs[1::2]) - sum(runs[::2]), len(runs) // 2) == (removed, spans)


def rows_of(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, _id long").repartition(3)
    out = dedup_substrings(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in out)


@pytest.mark.parametrize("block", [1_500_000, 60])
def test_documents(spark, block):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "short", "a" * 300, passage, passage, f"x {passage} y", f"{passage[:60]}z{passage[60:]}", "é" * 100, "tail " + passage[10:80]]
    texts += [" ".join(word() for _ in range(rnd.randrange(5, 60))) + passage[rnd.randrange(40) :] for _ in range(12)]
    rows = [(k, t, "clash", 7) for k, t in enumerate(texts)]
    rows += [(None, passage, "clash", 7), (4, passage, "clash", 7), (4, "other " + passage, "clash", 7)]
    got = rows_of(spark, rows, length=40, gram=13, block=block)
    want = brute([(r[1] or "").encode() for r in rows], 40)
    assert got == sorted((r[0] is not None, r[0] or 0, *w) for r, w in zip(rows, want))


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def passages_of(texts, words):
    """Start and end in bytes of each run of words inside a window of `words` words that another text holds."""
    split = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    window = lambda i, p: tuple(texts[i][a:b] for a, b in split[i][p : p + words])
    holders = {}
    for i, w in enumerate(split):
        for p in range(len(w) - words + 1):
            holders.setdefault(window(i, p), set()).add(i)
    out = []
    for i, w in enumerate(split):
        runs = []
        for p in range(len(w) - words + 1):
            if len(holders[window(i, p)]) > 1:
                runs += [] if runs and p <= runs[-1] else [p, p]
                runs[-1] = p + words
        out.append([w[x][0] if k % 2 == 0 else w[x - 1][1] for k, x in enumerate(runs)])
    return out


@pytest.mark.parametrize("seed, block", [(0, 1_500_000), (1, 1_500_000), (2, 60), (3, 60)])
def test_passages_of_other_documents(spark, seed, block):
    rnd = random.Random(seed)
    some = lambda n: [rnd.choice(["a", "bé", "c,", "dd", "e" * 30]) for _ in range(n)]
    space = lambda words: "".join(w + rnd.choice([" ", "\n", "\t ", " \r\n"]) for w in words)
    passage = some(30)
    alone = ["once"] + some(12)
    texts = [None, "", " ", "one", space(passage[:9]), space(passage), space(passage), space(alone * 3), space(some(5) + passage[3:20] + some(6) + passage[15:])]
    texts += [space(some(rnd.randrange(40)) + passage[rnd.randrange(30) :] + some(rnd.randrange(9))) for _ in range(14)]
    rows = [(k, t, "clash", 7) for k, t in enumerate(texts)]
    row = space(["row"] + some(11))
    rows += [(None, texts[5], "clash", 7), (4, row, "clash", 7), (4, row, "clash", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, _id long").repartition(3)
    out = dedup_substrings(docs, length=40, gram=13, block=block, passage_words=10, passage_gram=4)
    got = out.select("doc_id", "n_passages", "passage_bytes", "passages", "n_bytes").collect()
    want = passages_of([(r[1] or "").encode() for r in rows], 10)
    full = [(r[0] is None, r[0] or 0, len(w) // 2, sum(w[1::2]) - sum(w[::2]), w, len((r[1] or "").encode())) for r, w in zip(rows, want)]
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == sorted(full)
    assert not want[7] and want[-1] == want[-2] != []


def test_passage_of_over_50_words_under_400_bytes(spark, tmp_path):
    """The contract's 400 bytes leave it in place; it is told all the same, in both documents and nowhere else."""
    from marlstone.llm.registry import op1_suffix_dedup

    rnd = random.Random(9)
    other = lambda: " ".join(str(rnd.random()) for _ in range(60))
    passage = " ".join(f"w{k}" for k in range(55))
    line = " ".join(str(rnd.random()) for _ in range(70))
    texts = [f"{other()} {passage} {other()}", other(), f"{passage}\n{other()}", f"{line}\n{line}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_removed > 0, r.n_passages, r.passage_bytes, r.passages) for r in op1_suffix_dedup(spark, str(tmp_path)).collect())
    at = texts[0].index(passage)
    n = len(passage)
    assert n < 400
    assert got == [(0, False, 1, n, [at, at + n]), (1, False, 0, 0, []), (2, False, 1, n, [0, n]), (3, True, 0, 0, [])]
