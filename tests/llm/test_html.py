"""Main text of pages: fixtures by part, and the article of every page of a table."""

import re
import time
from html import unescape

import pytest

from marlstone.llm.html import extract, extract_pages

LONG = "This is a long paragraph, with commas, and enough words that it counts as prose of an article."

PAGES = [
    ("", ""),
    ("<p>", ""),
    ("plain text only", "plain text only"),
    (f"<body><nav><a href=/>Home</a></nav><header><h1>Site</h1></header><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>&copy; x</footer>", f"Title\n{LONG}\nShort."),
    (f"<div id=content><h2>T</h2><p>{LONG}</p><p>{LONG}</p><aside>side</aside><div class='ad-slot'>buy</div><form>f</form></div><div class=sidebar><p>{LONG}</p></div>", f"T\n{LONG}\n{LONG}"),
    (f"<div class='post no-sidebar content-with-comments'><p>a &lt;b&gt;\n &amp; c&nbsp;&#233;<br>d</p><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", f"a <b> & c é d\n{LONG}"),
    (f"<script>var x='<p>no</p>'</script><style>p{{}}</style><main><p>{LONG}<!-- gone --></p><ul><li>one<li>two</ul></main><div class='cookie-notice'>{LONG}</div>", f"{LONG}\none\ntwo"),
    (f"<article><p><b>Bold<br><p>{LONG}</p><p>tail<div hidden>x</div></article>", f"Bold\n{LONG}\ntail"),
    (f"<article><p>{LONG}</p><p>cut off <a href='x", f"{LONG}\ncut off"),
    ("<p>" + "word, " * 50_000 + "</p>", ("word, " * 50_000).strip()),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_parts(html, text):
    assert extract(html) == text


def test_nested_depth():
    assert extract("<div>" * 5000 + LONG) == LONG


def test_time_follows_length():
    """Deep trees, many open inline elements, stray ends: no walk through the tree for each block."""
    n = 30_000
    pages = ["<div><p>a b</p>" * n, "<span>x" * n, "<div>" * n + "</p></b></td>" * n, "<b><table><td>" + "<i>x" * n + "</b>" * n, "<ul><li>x" * n, "<p>x<a>y" * n]
    began = time.time()
    for page in pages:
        extract(page)
    assert time.time() - began < 30


SIX = "".join(f"<p>{LONG} Number {k}.</p>" for k in range(6))
SIX_TEXT = "\n".join(f"{LONG} Number {k}." for k in range(6))
CLASSES = [
    "content sidebar-right", "layout-sidebar-left", "story alert-level-2", "post social-science", "ad-free entry", "page nav-collapsed",
    "search-results-article story", "related-to-x post", "modal-open page", "comment-enabled post", "no-sidebar", "has-comments wide", "sidebar", "alert",
]
NOISE = "<nav><a href=/>Home</a> <a href=/b>News</a></nav>"
LAYOUTS = [
    f"{NOISE}<div class='entry-content'>{SIX}</div><div class='sidebar'><p>{LONG}</p></div>",
    f"{NOISE}<table><tr><td>{SIX}</td><td class=sidebar>{LONG}</td></tr></table>",
    f"<div id=page><div id=main-column>{SIX}</div><div id=side><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div></div>",
    f"<main>{SIX}<div class='newsletter signup'>{LONG}</div></main>",
    f"<article>{SIX}</article><section id=comments><article class=comment><p>{LONG}</p></article><article class=comment><p>{LONG}</p></article></section>",
    f"<div class=post>{SIX}</div><div class=post-comments>{'<p>' + LONG + '</p>'}</div>",
    f"<div class=story>{SIX}<div class='ad-slot'>Buy <b>now</b></div></div><footer>{LONG}</footer>",
    f"<div><div><div>{SIX}</div></div></div><div class='cookie-consent'><p>{LONG}</p><p>{LONG}</p></div>",
    f"<body class='has-sidebar modal-open'><div class=wrapper>{SIX}</div><aside>{LONG}</aside></body>",
    f"<section>{SIX}</section><div role=complementary>{LONG}</div><div role=contentinfo>{LONG}</div>",
    f"<div class='article-body'>{SIX}</div><ul class='related'><li><a href=1>{LONG}</a></li><li><a href=2>{LONG}</a></li></ul>",
    f"<div class=text>{SIX}</div><form><p>{LONG}</p></form><dialog>{LONG}</dialog>",
]


@pytest.mark.parametrize("name", CLASSES)
def test_the_only_container_is_never_dropped(name):
    assert extract(f"<body>{NOISE}<div class='{name}'>{SIX}</div><footer>x</footer></body>") == SIX_TEXT
    assert extract(f"<body>{NOISE}<h2>Site</h2><div id='{name}'><div>{SIX}</div></div></body>").endswith(SIX_TEXT)


@pytest.mark.parametrize("page", LAYOUTS)
def test_layouts(page):
    assert extract(page) == SIX_TEXT


def deep(k):
    return f"<div class=outer><div><div><div><p>{LONG} Part {k}.</p><p>Short {k}.</p></div></div></div></div>"


DEEP_TEXT = "\n".join(f"{LONG} Part {k}.\nShort {k}." for k in range(5))


def test_a_form_round_the_page():
    """Server frameworks write the whole page into a form; a form to fill in goes all the same."""
    footer = f"<div class=end><p>{LONG}</p></div>"
    for page in (f"<form id=aspnet>{NOISE}{SIX}</form>", f"<body><form id=f method=post>{NOISE}<div class=x>{SIX}</div><form><p>{LONG}</p></form></form><footer>{LONG}</footer>", f"<form><div>{SIX}</div></form>{footer.replace('class=end', 'class=footer')}"):
        assert extract(page) == SIX_TEXT
    assert extract(f"<div>{SIX}</div><form action=/s><label>Mail</label><p>{LONG}</p><input><button>Go</button></form>") == SIX_TEXT
    assert extract(f"<article>{SIX}<form class=poll><p>{LONG}</p></form></article>") == SIX_TEXT


def test_articles_in_scattered_sections():
    sections = [f"<section>{deep(k)}</section>" for k in range(5)]
    for page in ("".join(sections), f"<div class=wrap>{''.join(sections)}</div><div class=teasers><p><a href=x>{LONG}</a></p></div>", f"{NOISE}<div><div>{''.join(sections)}</div></div><footer>{LONG}</footer>", "".join(deep(k) for k in range(5))):
        assert extract(page) == DEEP_TEXT
    headed = "<h1>Title</h1>" + "".join(f"<h2>Head {k}</h2>{s}" for k, s in enumerate(sections))
    assert extract(f"<div>{NOISE}{headed}</div>") == "Title\nHead 0\n" + "".join(f"{LONG} Part {k}.\nShort {k}.\nHead {k + 1}\n" for k in range(4)) + f"{LONG} Part 4.\nShort 4."
    #: parts of another make, or without prose, are no parts of the article
    other = f"<section class=promoted>{deep(8)}</section><section><div><a href=x>{LONG}</a></div></section>"
    assert extract("".join(sections) + other) == DEEP_TEXT


def test_names_in_camel_case():
    for name in ("cookieBanner", "mainSidebar", "SiteFooter", "newsletterSignup", "adSlot"):
        assert extract(f"<div class={name}><p>{LONG}</p><p>{LONG}</p></div><div id=articleBody>{SIX}</div>") == SIX_TEXT
    assert extract(f"<div class=noSidebar>{SIX}</div><div class=x>y</div>") == SIX_TEXT


def test_short_articles_beside_long_comments():
    comments = f"<div id=comments>{SIX * 4}</div>"
    assert extract(f"<div class=post><p>{LONG}</p></div>{comments}") == LONG
    assert extract(f"<div><p>{LONG}</p><p>Short end.</p></div>{comments}") == f"{LONG}\nShort end."


def test_left_out_inside_a_block():
    assert extract(f"<article><p>{LONG} One <span hidden>x</span>two <span class='ad'>buy</span>three.</p></article>") == f"{LONG} One two three."
    assert extract(f"<article><p>{LONG} A <a class='popup-link' href=x>term</a> stays.</p></article>") == f"{LONG} A term stays."


def test_table(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "v", PAGES[3][0], "x"), (3, "v", PAGES[3][0], "x"), (None, "w", "<p>é", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_pages(pages).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id != 3] == [(1, "u", "", 0), (2, None, "", 0), (None, "w", "é", 1)]
    assert [r.text for r in got if r.page_id == 3] == [PAGES[3][1]] * 2
    assert extract_pages(pages.where("false")).count() == 0


def test_articles(spark):
    rows = extract_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in rows:
        inner = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", inner))
        assert r.text == "\n".join(p for p in parts if p)
