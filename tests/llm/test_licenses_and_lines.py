"""Licence scan against a search of the wording; line dedup against plain Python."""

import random
import re

import pytest

from marlstone.llm.licenses import TEMPLATES, scan_licenses
from marlstone.llm.substring import dedup_units

FILL = "some other words that stand around it in this text and say nothing about it at all "


def test_every_template_is_found(spark):
    texts = {k: FILL * 3 + v.replace(" ", "\n ") + " " + FILL for k, v in TEMPLATES.items()}
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts.values())], "doc_id long, text string, license string")
    rows = scan_licenses(docs).collect()
    found = {(r.doc_id, r.license): r for r in rows}
    assert len(found) == len(rows)
    for n, name in enumerate(texts):
        assert found[n, name].containment == 1.0
        assert found[n, name].first_word == len(re.findall("[a-z0-9]+", (FILL * 3).lower()))


def test_edited_long_texts_clean_texts_and_edges(spark):
    words = TEMPLATES["apache-2.0"].split()
    words[20], words[45] = "changed", "altered"
    rows = [(1, " ".join(words)), (2, FILL * 20), (3, None), (4, ""), (5, "MIT License"), (None, FILL * 2000 + TEMPLATES["mit"]), (7, "Released under the MIT License. " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = scan_licenses(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "apache-2.0"), (None, "mit"), (7, "mit-notice")} | {(1, "apache-2.0-notice")}
    assert sum(r.license == "mit-notice" for r in got) == 3
    edited = next(r for r in got if r.license == "apache-2.0")
    assert 0.8 <= edited.containment < 1
    assert scan_licenses(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(docs, templates={"x": "too short"})


def plainly(text, templates, contains=0.8):
    """Every begin at which a template has a shingle in its own place, verified; those closer than half a template are one."""
    w, out = re.findall("[a-z0-9]+", (text or "").lower()), []
    for name, wording in templates.items():
        t = re.findall("[a-z0-9]+", wording.lower())
        k = min(5, len(t))
        grams = lambda x, k=k: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
        g, h, slack, passed = grams(w), grams(t), max(2, -(-len(t) // 4)), []
        for b in sorted({i - j for i, x in enumerate(g) for j, y in enumerate(h) if x == y}):
            share = len(set(g[max(b - slack, 0) : max(b + len(h) + slack, 0)]) & set(h)) / len(set(h))
            if share >= contains:
                passed.append((sum(0 <= b + j < len(g) and g[b + j] == y for j, y in enumerate(h)), share, max(b, 0)))
        groups = []
        for p in sorted(passed, key=lambda p: p[2]):
            if groups and p[2] - groups[-1][-1][2] <= len(t) / 2:
                groups[-1].append(p)
            else:
                groups.append([p])
        out += [(name, same_share_begin[2], len(t), same_share_begin[1]) for x in groups for same_share_begin in [max(x, key=lambda p: (p[0], p[1], -p[2]))]]
    return out


def test_against_a_plain_scan(spark):
    rnd = random.Random(3)
    some = {k: TEMPLATES[k] for k in ("all-rights-reserved", "mit-notice", "mit", "isc", "apache-2.0", "bsd-warranty", "gpl-3.0-notice", "cc-by-nc-4.0-notice")}
    rows = []
    for n in range(40):
        parts = []
        for name in rnd.sample(sorted(some), rnd.randrange(4)):
            words = some[name].split()
            if len(words) > 20:
                for _ in range(rnd.randrange(3)):
                    words[rnd.randrange(len(words))] = "edited"
                words = words[rnd.choice([0, 0, 5]) :]
            parts += [" ".join(words)] * rnd.choice([1, 1, 2]) + rnd.choice([[], [FILL * rnd.randrange(1, 40)]])
        rows.append((rnd.choice([n, 7, None]), " ".join(parts), n))
    rows.append((50, FILL * 600 + some["mit"] + " " + FILL * 300 + some["isc"], 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int").repartition(4)
    got = sorted(((r.doc_id, r.license, r.first_word, r.n_words, round(r.containment, 9)) for r in scan_licenses(docs, templates=some).collect()), key=str)
    want = sorted(((i, *x[:3], round(x[3], 9)) for i, text in {(i, t) for i, t, _ in rows} for x in plainly(text, some)), key=str)
    assert len(got) > 40 and got == want


def test_rows_without_id_are_told_apart(spark):
    rows = [(None, f"{FILL * 2}All rights reserved. {x}") for x in ("one", "two", "two")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates={"arr": "All rights reserved."}).collect()
    assert [tuple(r) for r in got] == [(None, "arr", 34, 3, 1.0)] * 2


def test_every_licence_line_of_the_documents(spark):
    """Against a search for each wording in the words of each document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {(r.doc_id, r.license, r.first_word) for r in scan_licenses(docs).collect()}
    for name in ("all-rights-reserved", "mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-nc-4.0-notice"):
        wanted = re.findall("[a-z0-9]+", TEMPLATES[name].lower())
        plain = set()
        for i, text in rows:
            w = re.findall("[a-z0-9]+", (text or "").lower())
            plain |= {(i, name, k) for k in range(len(w)) if w[k : k + len(wanted)] == wanted}
        assert plain and plain <= got
        if len(wanted) < 5:
            assert plain == {r for r in got if r[1] == name}


def test_templates_shorter_than_a_shingle(spark):
    rows = [(1, "All rights reserved."), (2, "all RIGHTS  reserved, all rights\nreserved " + FILL * 3), (3, FILL * 9 + "All rights reserved"), (4, "All rights are reserved."), (5, "rights reserved"), (6, "four words of it"), (7, "Acme (c) 2020 All rights reserved.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in scan_licenses(docs, templates=TEMPLATES | {"four": "Four words of it."}).collect())
    name = "all-rights-reserved"
    n = 9 * len(FILL.split())
    assert got == [(1, name, 0, 3, 1.0), (2, name, 0, 3, 1.0), (2, name, 3, 3, 1.0), (3, name, n, 3, 1.0), (6, "four", 0, 4, 1.0), (7, name, 3, 3, 1.0)]


def plain_units(rows, passage_chars):
    """The result columns of each row of (id, text), ids ascending."""
    seen, out = set(), []
    for _, text in rows:
        units = re.findall("[^.!?。！？\n]*[.!?。！？\n][.!?。！？\t-\r ]*|[^.!?。！？\n]+", text or "")
        again = []
        for u in units:
            norm = b" ".join(bytes(b + 32 if 65 <= b <= 90 else b for b in u.encode()).split())
            again.append(norm != b"" and norm in seen)
            seen.add(norm)
        both = []
        for least in (1, passage_chars):
            at, spans, kept, removed, k, chars = 0, [], "", 0, 0, 0
            while k < len(units):
                j = k
                while j < len(units) and again[j] == again[k]:
                    j += 1
                piece = "".join(units[k:j])
                if again[k] and len(piece) >= least:
                    spans.append(f"{at}-{at + len(piece)}")
                    removed, chars = removed + j - k, chars + len(piece)
                else:
                    kept += piece
                at, k = at + len(piece), j
            both.append((removed, spans, kept, chars))
        (removed, spans, kept, _), (_, long, without, chars) = both
        out.append((len(units), removed, ",".join(spans), kept, len(long), chars, ",".join(long), without))
    return out


@pytest.mark.parametrize("passage_chars", [1, 40])
def test_units(spark, passage_chars):
    rnd = random.Random(passage_chars)
    pool = [" ".join(rnd.choice(["the", "Of", "été", "x", "word"]) for _ in range(rnd.randrange(1, 9))) + rnd.choice([". ", ".\n", "!", "\n\n", " ", "。", "..."]) for _ in range(60)]
    rows = [(n, "".join(rnd.choice(pool) for _ in range(rnd.randrange(12)))) for n in range(60)]
    rows += [(60, None), (61, ""), (62, "  \n "), (63, "\n\n. a"), (64, "no end " * 30_000), (65, "No  END " * 30_000), (66, "same. " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_units int").repartition(3)
    got = sorted(dedup_units(docs, passage_chars=passage_chars).collect())
    assert [tuple(r)[1:] for r in got] == plain_units(rows, passage_chars)
    assert dedup_units(docs.where("false")).count() == 0


def test_every_repeat_goes_whatever_its_length(spark):
    """Over the given documents no unit with a word is left twice."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    left = [norm for r in dedup_units(docs).collect() for u in re.findall("[^.!?。！？\n]*[.!?。！？\n][.!?。！？\t-\r ]*|[^.!?。！？\n]+", r.text) if (norm := b" ".join(bytes(b + 32 if 65 <= b <= 90 else b for b in u.encode()).split()))]
    #: what stood apart before may meet in what is left, but no unit was made of two
    assert len(left) > 1000 and len(left) - len(set(left)) <= len(left) // 200
    lines = [(k, f"A common line.\nLine {k} alone.") for k in range(6)]
    got = sorted(dedup_units(spark.createDataFrame(lines, "doc_id long, text string")).collect())
    assert [(r.n_removed, r.removed_spans, r.text, r.n_passages) for r in got] == [(0, "", lines[0][1], 0)] + [(1, "0-15", f"Line {k} alone.", 0) for k in range(1, 6)]


def test_repeated_rows_and_ids(spark):
    a, b = "One sentence stands here twice over. ", "And another one is in two documents. "
    rows = [(None, a + b), (None, b), (4, a + b), (4, a + b), (4, "new. " + b)]
    got = sorted(((r.doc_id is not None, r.n_removed, r.text) for r in dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    null = [r for r in got if not r[0]]
    #: rows of no id rank by the hash of their text
    assert null in ([(False, 0, a + b), (False, 1, "")], [(False, 0, b), (False, 1, a)])
    assert [r for r in got if r[0]] == [(True, 1, "new. "), (True, 2, ""), (True, 2, "")]


@pytest.mark.parametrize("same", [None, 1])
def test_copies_of_one_row_meet(spark, same):
    """Of two rows of one id, or none, and one text, one keeps it; so do many, and a row of another id keeps nothing of it."""
    rows = [(same, "Two rows are one. \n Here."), (same, "Two rows are one. \n Here."), (2, "Two rows are one. Other.")]
    got = sorted((str(r.doc_id), r.n_units, r.n_removed, r.text) for r in dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(str(same), 2, 0, rows[0][1]), (str(same), 2, 2, ""), ("2", 2, 1, "Other.")])
    many = [(same, None)] * 3 + [(same, "x. \n\n y")] * 2500
    got = dedup_units(spark.createDataFrame(many, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == 2503 and sorted(r.text for r in got)[-1] == "x. \n\n y" and sum(r.n_removed for r in got) == 2 * 2499


def test_passages_go_and_other_documents_stay(spark):
    """Passages of over 50 words that an earlier document holds, against documents without one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    removed = {r.doc_id: r.n_passages for r in dedup_units(docs).collect()}
    seen, caught, left = set(), [], []
    for i, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        w = text.split()
        windows = {tuple(w[k : k + 51]) for k in range(len(w) - 50)}
        (caught if windows & seen else left).append(removed[i] > 0)
        seen |= windows
    assert sum(caught) >= 0.9 * len(caught) > 0
    assert sum(left) <= 0.1 * len(left)
