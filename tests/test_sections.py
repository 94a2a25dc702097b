"""Nodes, blocks and sections of pages; outline paths and spans."""

import random

import pytest

from marlstone.operators import sections as S
from marlstone.operators import text as X

REGULATION = """<!DOCTYPE html><html><body>
<p class="oj-doc-ti">RULES ON KITES</p>
<div class="eli-subdivision" id="pbl_1">
 <div class="eli-subdivision" id="cit_1"><p>Having regard to the wind,</p></div>
 <div class="eli-subdivision" id="rct_1"><p>(1) Kites please people. They are light.</p></div>
 <div class="eli-subdivision" id="rct_2">no paragraph <b>here</b></div>
</div>
<p class="oj-ti-section-1" id="cpt_I">CHAPTER I</p><p class="oj-ti-section-2">GENERAL <i>MATTERS</i></p>
<div class="eli-subdivision" id="art_1">
 <p class="oj-ti-art">Article 1</p><p class="oj-sti-art">Subject</p>
 <p class="x oj-normal">Kites are ruled.</p>
 <table><tr><td><p>(a)</p></td><td><p>lines of 10 m;</p><table><tr><td>(i) silk</td></tr></table></td></tr><tr><td><p>(b)</p><td><p>tails</p></table>
</div>
<p class="oj-ti-section-1">SECTION 1</p><p class="oj-ti-section-2">Shapes</p>
<div class="eli-subdivision" id="art_2"><p class="oj-ti-art">Article 2</p><p>Shape counts.</p></div>
<p class="oj-ti-section-1">CHAPTER II</p>
<div class="eli-subdivision" id="art_3"><p class="oj-sti-art">Untitled</p><p>Third.</p></div>
<div class="eli-subdivision" id="art_4"><p class="oj-ti-art">Article 4</p></div>
<p class="oj-doc-ti">ANNEX I</p><p class="oj-doc-ti">List of winds</p><p>North <b>and</b> south.</p><p>West.</p>
<p class="oj-doc-ti">ANNEX II</p><script>no()</script><p>Calm.</p>
<div class="eli-subdivision" id="fnp_1"><p>OJ L 1, p. 2.</p></div><p>Behind the notes.</p>
</body></html>"""

FILING = """<body><div style="display:none"><ix:header><ix:hidden>HIDDEN</ix:hidden></ix:header></div><div>Contents</div>
<table><tr><td>Item 1.</td><td>Business</td><td>3</td></tr></table><p>Item 1. Early mention</p>
<div id="i1"><span style="font-weight:700">Item 1. Business</span></div>
<p>We make <ix:nonfraction>12</ix:nonfraction> kites.<p>An open paragraph
<div><span style="color:red;font-weight: bold">Our Markets</span></div><div>Loose <div>Inner block</div> tail</div>
<table><tr><td>Class</td><td>Place</td></tr><tr><td> </td><td>Hill</td></tr></table><table></table>
<div><span style="font-weight:700">Item 1A. Risk</span></div>
<table><tr><th>Sales</th><td>1,204</td><td>75.0%</td></tr><tr><td>(12)</td><td>$ 3</td></tr></table><p>Wind may <span style="font-weight:700">drop</span>.</p></body>"""


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_regulation(spark):
    rows = S.regulation_sections(S.page_nodes(pages(spark, REGULATION, None, ""))).orderBy("open").collect()
    chapter = "CHAPTER I — GENERAL MATTERS"
    assert [(r.kind, r.number, r.heading_path, r.text) for r in rows] == [
        ("rct", "1", ["Preamble", "Recital (1)"], "(1) Kites please people. They are light."),
        ("rct", "2", ["Preamble", "Recital (2)"], "no paragraph here"),
        ("art", "1", [chapter, "Article 1 — Subject"], "Kites are ruled.\n(a) lines of 10 m; (i) silk\n(b) tails"),
        ("art", "2", [chapter, "SECTION 1 — Shapes", "Article 2"], "Shape counts."),
        ("art", "3", ["CHAPTER II", "art_3 — Untitled"], "Third."),
    ]
    annexes = S.annex_sections(S.page_nodes(pages(spark, REGULATION))).orderBy("open").collect()
    assert [(r.heading_path, r.text) for r in annexes] == [(["Annex I — ANNEX I"], "North\nand\nsouth.\nWest."), (["Annex Ii — ANNEX II"], "Calm.")]


def test_filing(spark):
    blocks = S.html_blocks(S.without_subtrees(S.page_nodes(pages(spark, FILING))))
    got = [(r.tag, r.text, r.bold_only, r.table_no) for r in blocks.orderBy("block_no").collect()]
    assert got == [
        ("div", "Contents", False, None), ("table", "Item 1. | Business | 3", False, 0), ("p", "Item 1. Early mention", False, None), ("div", "Item 1. Business", True, None),
        ("p", "We make 12 kites.", False, None), ("p", "An open paragraph", False, None), ("div", "Our Markets", True, None), (None, "Loose", False, None), ("div", "Inner block", False, None),
        (None, "tail", False, None), ("table", "Class | Place\nHill", False, 1), ("div", "Item 1A. Risk", True, None), ("table", "Sales | 1,204 | 75.0%\n(12) | $ 3", False, 3), ("p", "Wind may drop .", False, None),
    ]
    sections = [(r.heading_path, r.text) for r in S.filing_sections(blocks).orderBy("section_no").collect()]
    assert sections == [
        (["Item 1. Business"], "We make 12 kites.\nAn open paragraph"),
        (["Item 1. Business", "Our Markets"], "Loose\nInner block\ntail\nClass | Place\nHill"),
        (["Item 1A. Risk"], "Wind may drop ."),
    ]
    dropped = S.filing_dropped_tables(blocks).collect()
    assert [tuple(r) for r in dropped] == [(0, "Item 1A. Risk", 3, 0.8, 5, "numeric_table_threshold")]


def test_intervals_hold_what_a_walk_over_the_tree_holds():
    """Every place inside of an element, and the nearest block, row and table, by brute force over parents."""
    chance = random.Random(4)
    tags = ["div", "p", "b", "span", "table", "tr", "td", "li", "ul", "br", "script"]
    for _ in range(200):
        html = "".join(chance.choice([f"<{t}>", f"</{t}>", " x ", f"<{t} id=a>"]) for t in chance.choices(tags, k=40))
        nodes = [dict(zip([f.split()[0] for f in S.NODE_FIELDS.split(", ")], n)) for n in S.scanned(html)]
        by = {n["open"]: n for n in nodes}
        assert [n["open"] for n in nodes] == sorted(by)
        for n in nodes:
            up, at = [], n["parent"]
            while at is not None:
                up.append(by[at])
                at = by[at]["parent"]
            assert [m["open"] for m in up] == sorted((m["open"] for m in nodes if m["open"] < n["open"] < m["close"]), reverse=True) and n["depth"] == len(up)
            assert n["block"] == next((m["open"] for m in up if m["tag"] in S.BLOCK_TAGS), None)
            assert n["table"] == next((m["open"] for m in reversed(up) if m["tag"] == "table"), None)
            assert n["row"] == next((m["open"] for m in reversed(up) if m["tag"] == "tr"), None)
            assert n["cell"] == next((m["open"] for m in up if m["tag"] in ("td", "th")), None)


def paths(entries):
    stack, out = [], []
    for title, depth in entries:
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, title))
        out.append(" › ".join(t for _, t in stack))
    return out


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_outline_paths_by_slices(spark, size):
    chance = random.Random(size)
    docs = {d: [(f"t{k}", chance.randint(-2, 4)) for k in range(n)] for d, n in ((1, 40), (2, 1), (None, 7))}
    rows = [(d, k * 10, t, depth) for d, entries in docs.items() for k, (t, depth) in enumerate(entries)]
    got = S.outline_paths(spark.createDataFrame(rows, "doc long, entry_no long, title string, depth int"), slice_entries=size).collect()
    want = {(d, 10 * k): p for d, entries in docs.items() for k, p in enumerate(paths(entries))}
    assert {(r.doc, r.entry_no): r.path for r in got} == want and len(got) == len(want)


def test_a_long_outline(spark):
    df = spark.range(100_000).selectExpr("1L as doc", "id as entry_no", "concat('t', id) as title", "cast(pmod(id * 7919, 6) as int) as depth")
    got = {r.entry_no: r.path for r in S.outline_paths(df).collect()}
    assert [got[k] for k in range(100_000)] == paths([(f"t{k}", k * 7919 % 6) for k in range(100_000)])


def test_spans_and_front_matter(spark):
    outline = spark.createDataFrame([(1, 0, "Cover", 0), (1, 1, "Start", 0), (1, 2, "Part", 1), (1, 3, "Lost", 1), (1, 4, "End", 0), (2, 0, "Only", 0)], "doc long, entry_no long, title string, depth int")
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["Cover", "by us", "Start", "a", "b", "Part", "two", "c", "", "End"])] + [(2, 0, "x"), (2, 1, "Only"), (2, 2, "y")], "doc long, line_no long, text string")
    heads = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 3), (1, 2, 5, 7), (1, 3, 7, 7), (1, 4, 9, 10), (2, 0, 1, 2)], "doc long, entry_no long, start long, end long")
    spans = sorted((r.doc, r.entry_no, r.line_no) for r in S.span_lines(heads, lines).collect())
    assert spans == [(1, 0, 1), (1, 1, 3), (1, 1, 4), (1, 3, 7), (1, 3, 8), (2, 0, 2)]
    got = sorted((r.doc, r.entry_no, r.path, r.text) for r in S.outline_sections(outline, heads, lines, first_title="Start").collect())
    assert got == [(1, 1, "Start", "a b"), (1, 3, "Start › Lost", "c"), (2, 0, "Only", "y")]
    assert X.locate_headings is not None
