"""Suffix automaton against brute force."""

import random
import re

import pytest

from marlstone.llm.decontaminate import Automaton, decontaminated, matched, report, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(words, items, width=13):
    hit, names = set(), set()
    for name, text in items:
        w = plain_words(text)
        n = min(len(w), width)
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else ()
        for i in range(len(words) - n + 1) if w else ():
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(words), len(hit), len(names)


@pytest.mark.parametrize("seed", range(30))
def test_matches(seed):
    rnd = random.Random(seed)
    words = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    items = [(str(k), words(rnd.choice([0, 1, 2, 3, 4, 5, 9, 20]))) for k in range(rnd.randrange(1, 6))]
    automaton = Automaton([(n, words_of(t.encode())) for n, t in items], 4)
    for _ in range(20):
        text = words(rnd.randrange(30)).upper().replace(" ", "-. ")
        runs, names = automaton.match(words_of(text.encode()))
        assert (len(plain_words(text)), sum(b - a for a, b in runs), len(names)) == brute(plain_words(text), items, 4)


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_table(spark, most):
    passage = " ".join(f"Wörd{k}" for k in range(20))
    items = [(2, passage), (10, "tiny Item"), (None, passage[:90]), (3, None), (4, "..."), (2, passage)]
    texts = [None, "", "x " * 3000 + passage + " end", "a, tiny-item!", passage.upper().replace("WÖRD", "wörd"), "clean words only", "y " * 50_000]
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t in enumerate(texts)] + [(4, texts[4], "x", 5)], "doc_id long, text string, items string, _hit_runs int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else str(i), t) for i, t in items]
    rows = matched(docs, bench, words_per_automaton=most).collect()
    for r in rows:
        assert (r.n_words, r.n_hit, len(r["items"])) == brute(plain_words(texts[r.row.doc_id]), named)
        assert (r.row["items"], r.row._hit_runs) == ("x", 5)
    assert sorted(r.doc_id for r in report(docs, bench).where("contaminated").collect()) == [3, 4, 4]
    kept = {r.doc_id: r.text for r in decontaminated(docs, bench).collect()}
    assert sorted(kept) == [0, 1, 2, 5, 6] and kept[0] is None and kept[5] == texts[5]
    assert kept[2] == "x " * 3000 + " end"
    assert decontaminated(docs, bench).columns == docs.columns
    assert report(docs.where("false"), bench).count() == 0
    assert report(docs, bench.where("false")).where("n_hit > 0").count() == 0
