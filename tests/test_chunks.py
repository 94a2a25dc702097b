"""Chunks of sections: runs of siblings, packing, repeated ends, shared tails, small chunks, labels, limits."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunks as C

PACKER = C.Packer(C.ChunkSizes(), C.token_spans, " › ")


def prose(n, words=11, tag="kite"):
    """n sentences of words + 1 tokens."""
    return " ".join(" ".join(f"{tag}{k}n{i}" for i in range(words)) + "." for k in range(n))


def chunks(spark, sections, **options):
    rows = [(7, k, list(path), text) for k, (path, text) in enumerate(sections)]
    df = spark.createDataFrame(rows, "doc long, section_no int, heading_path array<string>, text string")
    return C.pack_chunks(df, **options).orderBy("ordinal").collect()


def units(sections, packer=PACKER):
    for k, (path, text) in enumerate(sections):
        found = C.section_units(path, text, packer.sizes, packer.spans, packer.separator)
        yield from (C.Unit(k, tuple(path), sum(n for _, n in found), t, n) for t, n in found)


def test_small_siblings_share_a_chunk(spark):
    got = chunks(spark, [(("Manual", f"Rule {k}"), prose(2)) for k in range(1, 5)])
    assert [(r.ordinal, r.section_path) for r in got] == [(0, "Manual › Rule 1 – Rule 4")]
    assert got[0].text.startswith("Manual › Rule 1 – Rule 4\n") and got[0].token_count == len(C.token_spans(got[0].text))


def test_cousins_do_not(spark):
    got = chunks(spark, [(("Manual", "Sails", "Cut"), prose(12)), (("Manual", "Lines", "Cut"), prose(12))])
    assert [r.section_path for r in got] == ["Manual › Sails › Cut", "Manual › Lines › Cut"]


def test_a_run_ends_when_it_has_enough_or_the_next_is_too_much():
    sections = [(("M", "a"), prose(20)), (("M", "b"), prose(21)), (("M", "c"), prose(30)), (("M", "d"), prose(30)), (("M", "e"), prose(70))]
    runs = [[u.section for u in run] for _, run in PACKER.runs(units(sections))]
    assert [sorted(set(r)) for r in runs] == [[0, 1], [2, 3], [4]]


def test_remainders_join_their_neighbours(spark):
    got = chunks(spark, [(("Manual", "Long", "First"), prose(30)), (("Manual", "Short", "Second"), "Nil.")])
    assert [r.section_path for r in got] == ["Manual › Long – Short"]
    got = chunks(spark, [(("Manual", "Short", "First"), "Nil."), (("Manual", "Long", "Second"), prose(30))])
    assert len(got) == 1 and got[0].text.split("\n", 1)[1].startswith("Nil.")


def test_what_a_continuation_repeats(spark):
    got = chunks(spark, [(("Manual", "Wind"), prose(200))])
    assert len(got) > 3 and all(120 <= r.token_count <= 800 for r in got)
    for before, after in itertools.pairwise(got):
        a, b = (re.findall(r"[^.]+\.", r.text.split("\n", 1)[1]) for r in (before, after))
        n = next(k for k in range(len(b), 0, -1) if [x.strip() for x in a[-k:]] == [x.strip() for x in b[:k]])
        assert n < len(a) and 120 <= 12 * n < 120 + 12


def test_nothing_is_repeated_across_sections(spark):
    got = chunks(spark, [(("Manual", "Up"), prose(60, tag="up")), (("Manual", "Down"), prose(40, tag="down"))])
    assert [r for r in got if r.section_path == "Manual › Down"] and all("up0" not in r.text and "up59" not in r.text for r in got if r.section_path == "Manual › Down")


def test_a_sentence_beyond_all_limits(spark):
    got = chunks(spark, [(("Manual",), " ".join(f"gust{k}" for k in range(3333)))])
    assert all(r.token_count <= 800 for r in got) and {w for r in got for w in re.findall(r"gust\d+", r.text)} == {f"gust{k}" for k in range(3333)}


@pytest.mark.parametrize("n", range(60, 140, 7))
def test_tails_get_their_share(n):
    found = list(PACKER.chunks(units([(("M", "x"), prose(n))])))
    assert all(sum(u.tokens for u in c) >= 120 for c in found)
    texts = [[u.text for u in c] for c in found]
    assert list(dict.fromkeys(t for c in texts for t in c)) == [u.text for u in units([(("M", "x"), prose(n))])]


def test_shares_and_openings_by_hand():
    def made(*tokens, section=0):
        return [C.Unit(section, ("M",), sum(tokens), str(k), n) for k, n in enumerate(tokens)]

    p = C.Packer(C.ChunkSizes(most=100, least=20, overlap=0.3), C.token_spans, " › ")
    donor = made(30, 8, 9, 7)
    assert p.share(donor, made(5)) == 2 and p.share(donor, made(20)) == 4 and p.share(made(21, 8), made(1)) == 1 and p.share(made(12, 8), made(1)) == 2
    assert p.share(donor, donor[-1:]) == 4
    assert [u.tokens for u in p.opening(donor, made(10)[0], 100)] == [8, 9, 7] and [u.tokens for u in p.opening(made(50, 20, 20, 15), made(10)[0], 100)] == [20, 15]
    assert [u.tokens for u in p.opening(donor, made(80)[0], 100)] == [9, 7] and p.opening(donor, made(101)[0], 100) == [] and p.opening(donor, made(5, section=1)[0], 100) == []
    assert p.opening(donor[:1], made(5)[0], 100) == []


def test_labels():
    def chunk(*paths):
        return [C.Unit(k, tuple(p.split("/")), 1, "x", 1) for k, p in enumerate(paths)]

    assert PACKER.label(chunk("M/a/x")) == "M › a › x" and PACKER.label(chunk("M/a/x", "M/a/y", "M/a/z")) == "M › a › x – z"
    assert PACKER.label(chunk("M/a/x", "M/b/y")) == "M › a – b" and PACKER.label(chunk("M", "M/b")) == "M › M – b" and PACKER.label(chunk("A", "B")) == "A – B"


def test_lines_end_sentences_and_empty_documents_have_no_chunks(spark):
    assert C.section_units(["M"], "one;\n two;\n\nthree. Four? five", C.ChunkSizes(), C.token_spans, " › ") == [("one;", 2), ("two;", 2), ("three.", 2), ("Four?", 2), ("five", 1)]
    assert chunks(spark, [(("M",), ""), (("N",), None), ((), " \n ")]) == []
    assert chunks(spark, [((), "Text without a path.")])[0].text == "\nText without a path."


def test_another_counter(spark):
    words = lambda t: [m.span() for m in re.finditer(r"\S+", t)]
    got = chunks(spark, [(("M",), prose(40))], sizes=C.ChunkSizes(most=100, enough=60, least=10), spans=words)
    assert all(r.token_count == len(r.text.split()) <= 100 for r in got)


def test_documents_share_partitions(spark):
    """Each document's chunks are those that it has alone, whatever stands beside it."""
    chance = random.Random(2)
    docs = {d: [(("M", chance.choice("ab"), f"s{k}"), prose(chance.randint(0, 40))) for k in range(chance.randint(1, 8))] for d in (None, 1, 2, 3, 4)}
    rows = [(d, k, list(p), t) for d, sections in docs.items() for k, (p, t) in enumerate(sections)]
    got = C.pack_chunks(spark.createDataFrame(rows, "doc long, section_no int, heading_path array<string>, text string")).collect()
    want = [(d, k, *PACKER.rendered(c)) for d, sections in docs.items() for k, c in enumerate(PACKER.chunks(units(sections)))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_million_sentences_are_a_stream():
    read = 0

    def stream():
        nonlocal read
        for k in range(1_000_000):
            read += 1
            yield C.Unit(0, ("M", "x"), 20_000_000, f"s{k}", 20)

    n = last = 0
    for chunk in PACKER.chunks(stream()):
        assert sum(u.tokens for u in chunk) <= 800 and read - n * 33 <= 33 * 12
        n, last = n + 1, chunk[-1].text
    assert last == "s999999" and n > 25_000


def test_rules_are_noticed(spark):
    rows = [(1, 0, "p", "p\nx", 600), (1, 1, "p", "p\nx", 600), (2, 0, "p", "x", 900), (2, 2, "p", "p\nx", 5)]
    found = {r.doc: r for r in C.chunk_violations(spark.createDataFrame(rows, "doc long, ordinal long, section_path string, text string, token_count long")).collect()}
    assert tuple(found[1])[1:] == (2, 0, 0, False, False, False)
    assert tuple(found[2])[1:] == (2, 1, 1, True, True, True)


def test_chunks_of_the_documents_keep_the_rules(spark):
    from marlstone.plans.text import q_chunk_violations

    rows = q_chunk_violations(spark, "/root/testdata/sf0.001").where(F.expr("too_large > 0 or without_path > 0 or gaps")).collect()
    assert rows == []


def test_sections_are_dealt_as_they_are_and_tokens_counted_once(spark, monkeypatch):
    """Units never travel, and what is rendered is not counted again: both took most of the time."""
    sections = spark.createDataFrame([(1, 0, ["M"], "a b. c")], "doc long, section_no int, heading_path array<string>, text string")
    assert C.pack_chunks(sections)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    asked = []
    monkeypatch.setattr(C, "token_spans", lambda text: asked.append(text) or [m.span() for m in re.finditer(C.TOKEN, text)])
    packer = C.Packer(C.ChunkSizes(), C.token_spans, " › ")
    found = [packer.rendered(c) for c in packer.chunks(units([(("M", f"x{k}"), prose(60)) for k in range(9)] + [(("N",), "Nil.")], packer))]
    assert not asked and all(n == len(re.findall(C.TOKEN, text)) for _, text, n in found) and len(found) > 5


def test_sentences_end_where_one_pattern_said():
    chance = random.Random(4)
    for _ in range(3000):
        text = "".join(chance.choice(["a", "é", ".", "!", "?", " ", "\n", "\t", "\r", "\x0b", " ", "\xa0", "\x1f"]) for _ in range(chance.randint(0, 25)))
        want = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\s*\n\s*", text)]
        assert [t for t, _ in C.section_units(["M"], text, C.ChunkSizes(), C.token_spans, " › ")] == [s for s in want if s], repr(text)
