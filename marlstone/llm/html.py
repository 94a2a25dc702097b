"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements and a list of text blocks. Blocks give points for their length and commas to the
containers above them, less at each level, discounted by the share of their text that stands in links. The container
with the most points and the siblings that score alike are the article; all their blocks are kept, short ones too.
An article may be spread over parts of one make, each deep in its own boxes: from the best container up to the page,
siblings with the same element and class as what holds it are kept too, with what stands between them. Elements that
are never part of an article (scripts, menus, footers, fields...) are left out. So are forms that don't hold most of the
prose, and elements that their class, id or role calls adverts, notices, comments and the like, unless another class
calls them an article or hardly any prose would be left. The time that a page takes follows its length, whatever its
depth.

Edge cases: null or empty html gives an empty text; unclosed, misnested and cut-off markup is read as browsers do for
the common cases; a page without scored blocks gives the text of its article, main or body element; repeated rows are
separate pages; other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import takewhile

from pyspark.sql import DataFrame

from marlstone.llm.common import text_batches

#: Element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style noscript template head title nav footer aside button select option textarea input iframe object embed svg canvas dialog menu noembed noframes audio video map datalist".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLING_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section main body div blockquote".split())
#: Words in class, id and role that mark a part as no article text.
UNLIKELY = frozenset(
    "ad ads advert advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar comment comments commentlist disqus respond replies "
    "cookie cookies consent gdpr notice popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended "
    "newsletter subscribe subscription signup login footer masthead toolbar widget widgets pagination pager skip complementary contentinfo search alert".split()
)
LIKELY = frozenset("article main post entry content story text body".split())
#: Of the former, those whose parts may hold long prose of others.
OTHERS_PROSE = frozenset("comment comments commentlist disqus respond replies related recommended cookie cookies consent gdpr".split())
#: Of the former, those that mark an inline element, or an article element, all the same.
SURE_INLINE = frozenset("ad ads advert advertisement sponsor sponsored share sharing".split())
SURE_ARTICLE = frozenset("ad ads advert advertisement sponsor sponsored promo promotion comment comments related recommended".split())
#: Words behind which a class tells of something else, and last words by which it tells of a state of the page.
ELSEWHERE = frozenset("no has with without layout".split())
STATES = frozenset("free open closed enabled disabled collapsed expanded on off".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CELL_ENDS = frozenset("table tr tbody thead tfoot div section article body html".split())
_CELLS = ("td", "th", "table")
_LEAVES = frozenset("p pre li dd dt td th h1 h2 h3 h4 h5 h6 blockquote figcaption".split())


class Node:
    """An element. drop: never article text; side: its class says that it is none (2: perhaps long prose of others);
    aside: it or an element around it is such; block: the nearest element that is not inline."""

    __slots__ = ("tag", "parent", "drop", "inline", "block", "side", "aside", "within", "score", "bonus", "size", "linked", "kept", "look", "points")

    def __init__(self, tag, parent, drop=False, side=0, bonus=0.0, look=""):
        self.tag, self.parent, self.drop, self.side, self.bonus, self.look = tag, parent, drop, side, bonus, look
        self.inline = tag in INLINE
        self.block = parent.block if self.inline and parent is not None else self
        self.aside = side or (parent.aside if parent is not None else 0)
        self.within = tag in ("article", "main") or parent is not None and parent.within
        self.score = self.points = 0.0
        self.size = self.linked = 0
        self.kept = False


def _side_words(token: str) -> list[str]:
    """The words of a class by which an element is no article text; none where the class is about something else."""
    words = _SPLIT.split(token)
    if words[-1] in STATES:
        return []
    return [w for w in takewhile(lambda w: w not in ELSEWHERE, words) if w in UNLIKELY]


def _judge(tag: str, attributes: str, parent: Node) -> tuple[bool, int, float, str]:
    """Whether an element is never article text, whether its class calls it none, the points that it starts with, and its
    class."""
    bonus = {"article": 25.0, "main": 10.0, "div": 2.0, "section": 2.0, "td": 1.0, "blockquote": 1.0}.get(tag, 0.0)
    form = 1 if tag == "form" else 0
    if tag in NEVER or tag == "header" and not parent.within:
        return True, 0, bonus, ""
    if not attributes:
        return False, form, bonus, ""
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)}
    look = found.get("class", "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True, 0, bonus, look
    tokens = [_CAMEL.sub("-", x).lower() for k in ("class", "id", "role") for x in found.get(k, "").split()]
    side = [_side_words(x) for x in tokens]
    likely = any(not s and LIKELY & set(_SPLIT.split(x)) for x, s in zip(tokens, side))
    words = {w for s in side for w in s}
    if tag in INLINE:
        return bool(words & SURE_INLINE), 0, bonus, look
    if tag in ("article", "main"):
        words &= SURE_ARTICLE
    if tag in ("body", "html") or likely or not words:
        return False, form, bonus + 5.0 * (likely and not words), look
    return False, 2 if words & OTHERS_PROSE else 1, bonus, look


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements in page order, and the text blocks as (container, text, characters in links)."""
    root = Node("#", None)
    stack, nodes = [root], [root]
    #: places in the stack of the open elements of each name
    opened: dict[str, list[int]] = {}
    blocks: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    links: list[str] = []

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((stack[-1].block, text, min(len(text), len(" ".join("".join(links).split())))))
            pieces.clear()
            links.clear()

    def say(raw: str) -> None:
        if raw and not stack[-1].drop:
            text = unescape(raw)
            pieces.append(text)
            if opened.get("a"):
                links.append(text)

    def close(upto: int) -> None:
        if any(not x.inline for x in stack[upto:]):
            flush()
        for x in stack[upto:]:
            opened[x.tag].pop()
        del stack[upto:]

    def close_open(tags, scope) -> None:
        at = last(tags)
        if at and at >= last(scope):
            close(at)

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            k = last((tag,))
            if k and (tag in _CELL_ENDS or k >= last(_CELLS)):
                close(k)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in ENDS_P:
            close_open(("p",), ("table", "td", "th", "button"))
        if tag in SIBLING_END:
            for _ in range(3):
                close_open(SIBLING_END[tag], SCOPE)
        if tag == "a":
            close_open(("a",), ())
        attributes = m[3] or m[6] or ""
        drop, side, bonus, look = _judge(tag, attributes, stack[-1])
        node = Node(tag, stack[-1], drop or stack[-1].drop, side, bonus, look)
        if not node.inline:
            flush()
        if tag in VOID:
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = over.end() if over else end
            continue
        if attributes.rstrip().endswith("/") and tag not in ENDS_P and not node.inline:
            continue
        nodes.append(node)
        opened.setdefault(tag, []).append(len(stack))
        stack.append(node)
    flush()
    return nodes, blocks


def _score(nodes: list[Node], blocks) -> None:
    for n in nodes:
        n.score, n.points, n.size, n.linked = 0.0, 0.0, 0, 0
    for holder, text, linked in blocks:
        holder.size += len(text)
        holder.linked += linked
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        holder.points += points
        container = holder if holder.tag not in _LEAVES else holder.parent or holder
        level = 0
        while container is not None and level < 4:
            container.score += points / (1, 2, 6, 9)[level]
            container, level = container.parent, level + 1
    #: elements stand behind those around them
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.linked += n.linked
            n.parent.points += n.points
    for n in nodes:
        if n.score:
            n.score = (n.score + n.bonus) * (1 - n.linked / max(n.size, 1))


def _best(nodes: list[Node]) -> Node:
    return max(nodes, key=lambda n: (n.score, n.tag in ("article", "main"), n.size))


def _open_forms(nodes: list[Node], blocks) -> None:
    """A form that holds most of the page's prose is no form to fill in, but how the page was written."""
    forms = [n for n in nodes if n.tag == "form" and n.side == 1]
    if forms:
        _score(nodes, blocks)
        held = sum(n.points for n in nodes if n.parent is None)
        for n in forms:
            if 2 * n.points > held:
                n.side = 0
        for n in nodes:
            n.aside = n.side or (n.parent.aside if n.parent is not None else 0)


def _article_blocks(nodes: list[Node], blocks) -> list:
    """The blocks outside of elements whose class calls them no article text. Where hardly any prose is left so, such
    an element holds the article: then the elements around the best container of all are no longer left out."""
    _open_forms(nodes, blocks)
    prose = lambda rows: sum(len(t) - k for _, t, k in rows if len(t) >= 80)
    left = [b for b in blocks if not b[0].aside]
    if len(left) == len(blocks):
        return left
    own = [b for b in blocks if b[0].aside != 2]
    if prose(left) < 250 and prose(own) > 4 * prose(left) or not left:
        _score(nodes, own if prose(own) or not blocks else blocks)
        up = _best(nodes)
        while up is not None:
            up.side, up = 0, up.parent
        for n in nodes:
            n.aside = n.side or (n.parent.aside if n.parent is not None else 0)
        left = [b for b in blocks if not b[0].aside]
    return left


def extract(html: str) -> str:
    """The blocks of the best container and of its siblings that score alike, in page order."""
    nodes, blocks = parse(html)
    blocks = _article_blocks(nodes, blocks)
    if not blocks:
        return ""
    _score(nodes, blocks)
    best = _best(nodes)
    if best.score <= 0:
        best = next((n for n in nodes if n.tag in ("article", "main")), nodes[0])
    around = _outermost(best)
    around.kept = True
    if around.parent is not None:
        for n in nodes:
            if n.parent is around.parent and n is not around and not n.inline:
                dense = n.linked / max(n.size, 1)
                alike = n.score >= max(10.0, 0.2 * around.score)
                prose = n.tag == "p" and dense < 0.25 and n.size > 80
                n.kept = bool(n.size and (alike and dense < 0.5 or prose))
    _keep_parts(nodes, around)
    for n in nodes:
        n.kept = n.kept or n.parent is not None and n.parent.kept
    return "\n".join(text for holder, text, _ in blocks if holder.kept)


def _keep_parts(nodes: list[Node], around: Node) -> None:
    """Keep the parts of one make with what holds the article, at each level, and what stands between them or is the heading
    in front of the first."""
    path = []
    while around.parent is not None:
        path.append(around)
        around = around.parent
    children: dict[int, list[Node]] = {id(n.parent): [] for n in path}
    for n in nodes:
        if id(n.parent) in children and not n.inline and n.size:
            children[id(n.parent)].append(n)
    for own in path:
        family = children[id(own.parent)]
        loose = lambda n: n.linked < 0.25 * n.size
        parts = [k for k, n in enumerate(family) if n is own or n.tag == own.tag and n.look == own.look and n.points >= 0.2 * own.points and loose(n)]
        if own.tag not in _LEAVES and len(parts) > 1:
            first = parts[0] - 1 if parts[0] and re.fullmatch("h[1-6]", family[parts[0] - 1].tag) else parts[0]
            for n in family[first : parts[-1] + 1]:
                n.kept = n.kept or 2 * n.linked < n.size


def _outermost(best: Node) -> Node:
    """The article or main element around the best container, where there is one: an article is not cut to a part."""
    found, up = best, best.parent
    while up is not None:
        if up.tag in ("article", "main"):
            found = up
            if up.tag == "article":
                break
        up = up.parent
    return found


def _run(keep: list[str], html_col: str):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = [extract(h) if h else "" for h in batch.column(names.index(html_col)).to_pylist()]
            columns = [batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars. Pages are read one by one, without a shuffle."""
    text_batches(pages.sparkSession)
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    return pages.select(id_col, url_col, html_col).mapInArrow(_run([id_col, url_col], html_col), f"{fields}, text string, n_chars long")
