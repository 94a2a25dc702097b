"""Sections from raw pages and outlines.

One scan of a page gives its nodes: elements as intervals (`open` and `close` in the order of the page) and the texts in
them. Everything else is windows and equal-key joins over nodes: since elements nest, an element holds a place when it is
the last one opened before it and closes behind it, so no range join is needed. Pages are told apart by `page`, which
must be a key. A null page is empty and gives no nodes.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby, islice
from unicodedata import normalize

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import text as X

BLOCK_TAGS = ("div", "p", "td", "li", "h1", "h2", "h3", "h4", "h5", "h6")
#: Tags that close an open paragraph, and the tags that each table or list part closes up to its container.
ENDS_PARAGRAPH = frozenset((*BLOCK_TAGS, "ul", "ol", "table", "section", "article", "header", "footer", "nav", "form", "pre", "blockquote", "tr", "th")) - {"td"}
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "p": ({"p"}, set())}
BARRIERS = {"td", "th", "table"}
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOLD = re.compile(r"font-weight\s*:\s*(700|bold)")
#: Tags as most are, without attributes; of elements whose content is no markup the parser takes care itself.
PLAIN_START, PLAIN_END = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)>"), re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
NODE_FIELDS = "open long, close long, depth int, parent long, tag string, css string, element_id string, bold boolean, block long, line long, cell long, row long, table long, text string"


class _Scan(HTMLParser):
    """Nodes of one page. A stack entry is (tag, number of its node, what encloses its content)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at, self.nodes, self.stack = 0, [], []

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if plain is None or (tag := plain[1].lower()) in RAW_TAGS:
            return super().parse_starttag(i)
        self.handle_starttag(tag, ())
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i)
        if plain is None or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def updatepos(self, i, j):
        """Lines and columns are not asked for."""
        return j

    def _around(self) -> dict:
        return self.stack[-1][2] if self.stack else {"parent": None, "block": None, "line": None, "cell": None, "row": None, "table": None}

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close_up_to({"p"}, BARRIERS)
        if tag in CLOSES:
            self._close_up_to(*CLOSES[tag])
        attributes, around = dict(attrs), self._around()
        number, self.at = self.at, self.at + 1
        bold = tag == "span" and bool(BOLD.search(attributes.get("style") or ""))
        self.nodes.append([number, number, len(self.stack), *around.values(), tag, attributes.get("class") or "", attributes.get("id") or "", bold, None])
        if tag in EMPTY_TAGS:
            return
        inside = around | {"parent": number}
        if tag in BLOCK_TAGS:
            inside["block"] = number
        if tag in ("td", "th"):
            inside["cell"] = number
        if tag == "tr":
            inside["row"] = number if inside["row"] is None else inside["row"]
        if tag == "table" and inside["table"] is None:
            inside["table"] = number
        #: a line is an outermost row or, outside of rows, a paragraph
        if tag == "tr" and around["row"] is None or tag == "p" and around["row"] is None:
            inside["line"] = number
        self.stack.append((tag, len(self.nodes) - 1, inside))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close_up_to({tag}, set() if tag in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html") else BARRIERS)

    def _close_up_to(self, tags, barriers):
        """Close the innermost element of these tags and all in it, unless a barrier stands in between."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in barriers:
                return

    def _pop(self):
        self.nodes[self.stack.pop()[1]][1] = self.at
        self.at += 1

    def handle_data(self, data):
        text = " ".join(normalize("NFKC", data).split())
        if text:
            self.nodes.append([self.at, self.at, len(self.stack), *self._around().values(), None, "", "", False, text])
            self.at += 1


def scanned(html: str) -> list[list]:
    """The nodes of a page in order, as lists of NODE_FIELDS."""
    scan = _Scan()
    scan.feed(html)
    scan.close()
    while scan.stack:
        scan._pop()
    return [[a, b, d, parent, tag, css, name, bold, block, line, cell, row, table, text] for a, b, d, parent, block, line, cell, row, table, tag, css, name, bold, text in scan.nodes]


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, NODE_FIELDS): elements (`tag` set) and texts (`text` set) of each page, by one scan that takes unclosed and
    crossed markup as browsers do in the plain cases. For each node: the nearest block element around it, the line (outermost
    table row, or paragraph outside of rows), the cell, the outermost row and the outermost table, by where they open."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in NODE_FIELDS.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in NODE_FIELDS.split(", ")]
        for batch in batches:
            for k, html in enumerate(batch.column(1).to_pylist()):
                nodes = scanned(html or "")
                if nodes:
                    page = batch.column(0).take(pa.array([k] * len(nodes)))
                    yield pa.RecordBatch.from_arrays([page, *(pa.array(c, t) for c, t in zip(zip(*nodes), kinds))], ["page", *names])

    return pages.select(id_col, html_col).mapInArrow(run, f"page {kind}, {NODE_FIELDS}")


def _upto(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("open").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def without_subtrees(nodes: DataFrame, tags: tuple[str, ...] = ("ix:header", "script", "style")) -> DataFrame:
    """Nodes outside of the elements of these tags: the furthest end of those opened so far lies before the node."""
    end = F.max(F.when(F.col("tag").isin(*tags), F.col("close"))).over(_upto("page"))
    return nodes.withColumn("_end", end).where("_end is null or open > _end").drop("_end")


def inside(nodes: DataFrame, holder: Column) -> DataFrame:
    """Nodes with `held`, where the element around them opens that `holder` is true for. Such elements must not nest."""
    w = _upto("page")
    rows = nodes.withColumn("held", F.last(F.when(holder, F.col("open")), ignorenulls=True).over(w)).withColumn("_until", F.last(F.when(holder, F.col("close")), ignorenulls=True).over(w))
    return rows.where("open > held and open < _until").drop("_until")


def _spelt(order: str, what: str, separator: str, where: Column | None = None) -> Column:
    part = F.struct(order, what)
    return F.array_join(F.transform(F.array_sort(F.collect_list(part if where is None else F.when(where, part))), lambda x: x[what]), separator)


def _latest(which: Column, *fields: str | Column) -> Column:
    """These fields of the last node so far that `which` is true for."""
    return F.last(F.when(which, F.struct(*fields)), ignorenulls=True).over(_upto("page"))


def _is_in(holder: str) -> Column:
    return (F.col("open") > F.col(f"{holder}.open")) & (F.col("open") < F.col(f"{holder}.close"))


def has_class(name: str) -> Column:
    return F.array_contains(F.split("css", r"\s+"), name)


def html_blocks(nodes: DataFrame) -> DataFrame:
    """Blocks in the order of the page: (page, block_no, tag, css, element_id, bold_only, text, table_no, n_cells,
    digit_ratio).

    A block element without a block element in it is one block, whatever its inline markup; text that hangs directly under
    other elements is a block for itself; a table is one block of lines of cells. `bold_only`: one bold span spells the whole
    block. `table_no` counts the tables of the page, empty ones too; a nested table belongs to the outermost one.

    Nodes are read once and dealt by page once: whether the block element around a node holds no other one is known by the
    last one opened before the node and the next one behind it."""
    block = F.coalesce(F.col("tag").isin(*BLOCK_TAGS), F.lit(False))
    behind = Window.partitionBy("page").orderBy(F.desc("open")).rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("_last", _latest(block, "open", "close", "tag", "css", "element_id"))
    rows = rows.withColumn("_next", F.last(F.when(block, F.col("open")), ignorenulls=True).over(behind))
    leaf = F.coalesce((F.col("_last.open") == F.col("block")) & (F.col("_next").isNull() | (F.col("_next") > F.col("_last.close"))), F.lit(False))
    plain, worded = F.col("table").isNull(), F.col("text").isNotNull()
    table = plain & F.col("tag").eqNullSafe("table")
    place = F.when(table | (plain & worded & ~leaf), F.col("open")).when(plain & leaf & (worded | F.col("bold")), F.col("block")).when(worded & F.col("cell").isNotNull(), F.col("table"))
    head = F.when(table, F.struct("tag", "css", "element_id")).when(plain & leaf, F.struct("_last.tag", "_last.css", "_last.element_id"))
    within = lambda name: F.when(~plain, F.col(name)).alias(name)
    rows = rows.select("page", place.alias("place"), within("row"), within("cell"), head.alias("head"), table.alias("is_table"), "open", "close", "bold", "text").where("place is not null")
    cells = rows.groupBy("page", "place", "row", "cell").agg(
        F.first("head", ignorenulls=True).alias("head"), F.max("is_table").alias("is_table"), _spelt("open", "text", " ", worded).alias("text"), F.min(F.when(worded, F.col("open"))).alias("first"),
        F.max(F.when(worded, F.col("open"))).alias("final"), F.collect_list(F.when(F.col("bold") & ~worded, F.struct("open", "close"))).alias("bolds"),
    )
    bold_only = F.exists("bolds", lambda x: (x["open"] < F.col("first")) & (x["close"] > F.col("final")))
    filled, cell = F.col("text") != "", F.col("cell").isNotNull()
    numeric = F.col("text").rlike(r"^[\d,.\s$%()—–-]*\d[\d,.\s$%()—–-]*$")
    lines = cells.groupBy("page", "place", "row").agg(
        F.first("head", ignorenulls=True).alias("head"), F.max("is_table").alias("is_table"), F.max(F.coalesce(bold_only, F.lit(False))).alias("bold_only"),
        _spelt("cell", "text", " | ", filled).alias("line"), F.count_if(filled & cell).alias("n"), F.count_if(filled & cell & numeric).alias("figures"),
    )
    blocks = lines.groupBy("page", "place").agg(
        F.first("head", ignorenulls=True).alias("head"), F.max("is_table").alias("is_table"), F.max("bold_only").alias("bold_only"), _spelt("row", "line", "\n", F.col("line") != "").alias("text"), F.sum("n").alias("n"), F.sum("figures").alias("figures")
    )
    order = Window.partitionBy("page").orderBy("place")
    of_table = lambda x: F.when(F.col("is_table"), x)
    blocks = blocks.withColumn("table_no", of_table(F.sum(F.col("is_table").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1))
    return blocks.where("text <> ''").select(
        "page", F.col("head.tag").alias("tag"), F.coalesce("head.css", F.lit("")).alias("css"), F.coalesce("head.element_id", F.lit("")).alias("element_id"), (F.col("bold_only") & ~F.col("is_table")).alias("bold_only"), "text",
        "table_no", of_table(F.col("n")).alias("n_cells"), of_table(F.when(F.col("n") > 0, F.col("figures") / F.col("n")).otherwise(0.0)).alias("digit_ratio"), (F.row_number().over(order) - 1).cast("long").alias("block_no"),
    )


def filing_blocks(blocks: DataFrame, longest: int = 120) -> DataFrame:
    """Blocks with the item and the bold sub-heading they stand under, and the number of their section; headings themselves
    and what stands before the first item are left out. Of an item's headings the last one counts."""
    rows = blocks.withColumnRenamed("page", "doc")
    rows = rows.withColumn("_key", F.when(F.col("table_no").isNull() & (F.length("text") <= longest), F.nullif(X.heading_key(F.col("text")), F.lit(""))))
    rows = rows.withColumn("_head", F.when(F.col("_key").isNotNull() & (F.col("block_no") == F.max("block_no").over(Window.partitionBy("doc", "_key"))), True))
    order = Window.partitionBy("doc").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, sub = F.col("_head").isNotNull(), F.col("_head").isNull() & F.col("table_no").isNull() & X.is_subheading(F.col("text"), F.col("bold_only"))
    rows = rows.withColumn("_item", F.sum(head.cast("int")).over(order)).where("_item > 0").withColumn("item", F.last(F.when(head, F.col("text")), ignorenulls=True).over(order))
    within = Window.partitionBy("doc", "_item").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sub_heading", F.last(F.when(sub, F.col("text")), ignorenulls=True).over(within)).withColumn("section", F.sum((head | sub).cast("int")).over(order))
    return rows.where(~head & ~sub).withColumnRenamed("doc", "page").drop("_head", "_item", "_key")


def filing_sections(blocks: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(page, section_no, heading_path, text) of a filing: items and their bold sub-headings. Tables whose share of numeric
    cells reaches the threshold are left out; `filing_dropped_tables` has them."""
    body = filing_blocks(blocks).where(F.col("table_no").isNull() | (F.col("digit_ratio") < threshold))
    found = body.groupBy("page", "section", "item", "sub_heading").agg(_spelt("block_no", "text", "\n").alias("text"))
    path = F.filter(F.array("item", "sub_heading"), lambda x: x.isNotNull())
    return found.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("section")) - 1).cast("long").alias("section_no"), path.alias("heading_path"), "text")


def filing_dropped_tables(blocks: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(page, item, table_no, digit_ratio, n_cells, reason) of the tables that `filing_sections` leaves out."""
    gone = filing_blocks(blocks).where(F.col("digit_ratio") >= threshold)
    return gone.select("page", "item", "table_no", F.round("digit_ratio", 4).alias("digit_ratio"), "n_cells", F.lit("numeric_table_threshold").alias("reason"))


def regulation_sections(nodes: DataFrame, preamble: str = "Preamble") -> DataFrame:
    """(page, open, kind, number, heading_path, text) of the recitals and articles of a regulation.

    Subdivisions are known by the prefix of their id, which is parsed to kind and number. An article stands under the nearest
    chapter before it and the nearest section since that chapter, each with the subtitle that follows it. A subdivision's text
    has one line a paragraph or outermost table row, without the article's own titles; without paragraphs it is one line."""
    nodes = without_subtrees(nodes)
    key = r"^(rct|art)_(.*)$"
    element, worded = F.col("tag").isNotNull(), F.col("text").isNotNull()
    unit = element & has_class("eli-subdivision") & F.col("element_id").rlike(key)
    heading, subtitle = element & has_class("oj-ti-section-1"), element & has_class("oj-ti-section-2")
    siblings = Window.partitionBy("page", "parent", "_element").orderBy("open")
    rows = nodes.withColumn("_element", element).withColumn("_of", F.lag(F.when(heading, F.col("open"))).over(siblings))
    rows = rows.withColumns({"_unit": _latest(unit, "open", "close", "element_id"), "_heading": _latest(heading, "open", "close"), "_subtitle": _latest(subtitle, "open", "close", "_of")})
    titled = lambda name: F.coalesce(F.col("tag").eqNullSafe("p") & has_class(name), F.lit(False))
    label, under = titled("oj-ti-art"), titled("oj-sti-art")
    line = F.when(~worded, F.col("open")).when(F.col("line") > F.col("_unit.open"), F.col("line"))
    none = F.lit(None).cast("string")
    role = lambda at, line, name: F.struct(at.alias("at"), line.alias("line"), name.alias("name"))
    roles = F.array_compact(F.array(
        F.when(_is_in("_unit") & (worded | label | under), role(F.col("_unit.open"), line, F.col("_unit.element_id"))),
        #: of a heading, line 0 is what it says and line 1 the subtitle that follows it
        F.when(_is_in("_heading") & worded, role(F.col("_heading.open"), F.lit(0).cast("long"), none)),
        F.when(_is_in("_subtitle") & worded & F.col("_subtitle._of").isNotNull(), role(F.col("_subtitle._of"), F.lit(1).cast("long"), none)),
    ))
    rows = rows.select("page", "open", "text", label.alias("label"), under.alias("under"), F.explode(roles).alias("r")).select("page", "open", "text", "label", "under", "r.*")
    lines = rows.groupBy("page", "at", "name", "line").agg(F.min(F.when(worded, F.col("open"))).alias("first"), _spelt("open", "text", " ", worded).alias("text"), F.max("label").alias("label"), F.max("under").alias("under"))
    first = lambda flag: F.min(F.when(F.col(flag), F.col("line"))).alias(flag)
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("first", "line", "text")))).alias("parts")
    found = lines.groupBy("page", "at", "name").agg(parts, first("label"), first("under"))
    of_line = lambda at: F.get(F.filter("parts", lambda x: x["line"] == at), F.lit(0))["text"]
    same = lambda x, flag: F.coalesce(x["line"] == F.col(flag), F.lit(False))
    joined = lambda parts, by: F.array_join(F.transform(parts, lambda x: x["text"]), by)
    found = found.withColumn("body", F.filter("parts", lambda x: ~same(x, "label") & ~same(x, "under"))).withColumn("lined", F.filter("body", lambda x: x["line"].isNotNull()))
    text = F.when(F.size("lined") > 0, joined(F.col("lined"), "\n")).otherwise(joined(F.col("body"), " "))
    held, sub = F.col("name").isNotNull(), of_line(F.lit(1))
    whole = F.when(~held, F.when(sub.isNotNull(), F.concat(of_line(F.lit(0)), F.lit(" — "), sub)).otherwise(of_line(F.lit(0))))
    kind = F.when(~held, F.upper(of_line(F.lit(0))))
    found = found.select(F.col("page").alias("doc"), F.col("at").alias("block_no"), "name", of_line(F.col("label")).alias("label"), of_line(F.col("under")).alias("subtitle"), text.alias("text"), whole.alias("whole"), kind.alias("head"))
    found = X.asof_context(found, F.when(F.col("head").startswith("CHAPTER"), F.col("whole")), F.when(F.col("head").startswith("SECTION"), F.col("whole")))
    found = found.where("name is not null and text <> ''").withColumns({"kind": F.regexp_extract("name", key, 1), "number": F.regexp_extract("name", key, 2)})
    label = F.coalesce("label", F.col("name"))
    label = F.when(F.col("subtitle").isNotNull(), F.concat(label, F.lit(" — "), F.col("subtitle"))).otherwise(label)
    article = F.filter(F.array("chapter", "in_section", label), lambda x: x.isNotNull())
    recital = F.array(F.lit(preamble), F.concat(F.lit("Recital ("), F.col("number"), F.lit(")")))
    path = F.when(F.col("kind") == "rct", recital).otherwise(article)
    return found.select(F.col("doc").alias("page"), F.col("block_no").alias("open"), "kind", "number", path.alias("heading_path"), "text")


def annex_sections(nodes: DataFrame, footnotes: str = "fnp_1") -> DataFrame:
    """(page, open, annex_no, heading_path, text) of the annexes of a regulation, which no element holds: an annex goes from
    its heading to the next one's, or to the panel of footnotes, which ends it without beginning another. Other headings of
    the document's kind are no text of an annex. The label is the heading in title case, and the heading as it stands;
    `annex_no` counts the annexes of the page, those without text too."""
    nodes = without_subtrees(nodes)
    worded = F.col("text").isNotNull()
    title, notes = F.col("tag").eqNullSafe("p") & has_class("oj-doc-ti"), F.coalesce(F.col("element_id") == footnotes, F.lit(False))
    rows = nodes.withColumns({"_title": _latest(title, "open", "close"), "_mark": _latest(title | notes, "open")})
    #: the nodes of a page fall into stretches, each from a heading or a panel on; those of no annex go to the annex before
    own = F.coalesce(F.col("parent") == F.col("_title.open"), F.lit(False))
    role = lambda at, of: F.struct(at.alias("at"), F.lit(of).alias("of"))
    roles = F.array_compact(F.array(
        F.when(title | notes, role(F.col("open"), "mark")), F.when(worded & _is_in("_title"), role(F.col("_title.open"), "label")), F.when(worded & ~own & F.col("_mark").isNotNull(), role(F.col("_mark.open"), "body"))
    ))
    rows = rows.select("page", "open", "text", notes.alias("notes"), F.explode(roles).alias("r")).select("page", "open", "text", "notes", "r.*")
    label, body = F.col("of") == "label", F.col("of") == "body"
    parts = rows.groupBy("page", "at").agg(
        _spelt("open", "text", " ", label).alias("label"), F.min_by("text", F.when(label, F.col("open"))).alias("first_text"), _spelt("open", "text", "\n", body).alias("text"), F.max("notes").alias("notes")
    )
    head = F.col("label").rlike(r"^ANNEX\s+[IVXLC]+$")
    upto = Window.partitionBy("page").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.concat(F.initcap("label"), F.lit(" — "), F.col("first_text"))
    parts = parts.withColumn("open", F.last(F.when(head, F.col("at")).when(F.col("notes"), F.lit(-1)), ignorenulls=True).over(upto)).withColumn("annex_no", F.sum(head.cast("long")).over(upto) - 1)
    found = parts.where("open >= 0").groupBy("page", "open").agg(F.min("annex_no").alias("annex_no"), F.min_by(heading, "at").alias("heading"), _spelt("at", "text", "\n", F.col("text") != "").alias("text"))
    return found.where("text <> ''").select("page", "open", "annex_no", F.array("heading").alias("heading_path"), "text")


# --- outlines


def in_groups(rows: DataFrame, keys: list[str], order: list[str], fold, schema: str, at_once: int = 1024) -> DataFrame:
    """Work off the rows of each group in order: `fold` takes them one by one and yields result rows. Groups share partitions,
    and nothing is held of a group but what `fold` holds."""
    names, fields = rows.columns, [f.split() for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
        read = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names)))
        results = (out for _, group in groupby(read, key=lambda row: row[: len(keys)]) for out in fold(group))
        while some := list(islice(results, at_once)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*some), fields)], [n for n, _ in fields])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _pushed(stack: list, depth: int, title: str) -> None:
    while stack and stack[-1][0] >= depth:
        stack.pop()
    stack.append((depth, title))


def outline_paths(outline: DataFrame, separator: str = " › ", slice_entries: int = 4096) -> DataFrame:
    """(doc, entry_no, path): the titles above each entry of (doc, entry_no, title, depth), of each smaller depth the last
    one since a shallower one.

    A stack of open titles is what a run of entries leaves of another: the entries of less depth than its least stay, its own
    stack comes on top. So slices of a document are summed up each for itself, the summaries of a document are run through
    in order, and each slice is worked off from the stack that it meets: linear, and no task holds more than a slice."""
    doc, entry = (outline.schema[c].dataType.simpleString() for c in ("doc", "entry_no"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("entry_no")) - 1
    rows = outline.select("doc", F.floor(place / slice_entries).alias("slice"), "entry_no", F.col("depth").cast("long").alias("depth"), "title")
    stacks = f"doc {doc}, slice long, depths array<long>, titles array<string>"

    def summary(entries):
        stack: list = []
        for doc_id, part, _, depth, title in entries:
            _pushed(stack, depth, title)
        yield doc_id, part, [d for d, _ in stack], [t for _, t in stack]

    def meeting(summaries):
        stack: list = []
        for doc_id, part, depths, titles in summaries:
            yield doc_id, part, [d for d, _ in stack], [t for _, t in stack]
            for depth, title in zip(depths, titles):
                _pushed(stack, depth, title)

    def paths(entries):
        stack: list = []
        for doc_id, _, number, depth, title, depths, titles in entries:
            if depths is not None:
                stack = list(zip(depths, titles))
            else:
                _pushed(stack, depth, title)
                yield doc_id, number, separator.join(t for _, t in stack)

    before = in_groups(in_groups(rows, ["doc", "slice"], ["entry_no"], summary, stacks), ["doc"], ["slice"], meeting, stacks)
    none = F.lit(None)
    both = before.select("doc", "slice", none.cast(entry).alias("entry_no"), none.cast("long").alias("depth"), none.cast("string").alias("title"), "depths", "titles")
    both = both.unionByName(rows, allowMissingColumns=True)
    #: nulls first, so a slice begins with the stack that it meets
    return in_groups(both, ["doc", "slice"], ["entry_no"], paths, f"doc {doc}, entry_no {entry}, path string")


def from_entry(outline: DataFrame, first_title: str) -> DataFrame:
    """Entries from the first one of this title on; of a document without it, all."""
    w = Window.partitionBy("doc")
    start = F.min(F.when(F.col("title") == first_title, F.col("entry_no"))).over(w)
    return outline.withColumn("_start", start).where("_start is null or entry_no >= _start").drop("_start")


def span_lines(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (doc, line_no, text) with the heading (doc, entry_no, start, end) whose body they are in: those from its end up
    to the start of the next one. Headings and lines run together by place, and the last heading that began holds a line."""
    marks = headings.select("doc", F.col("start").alias("line_no"), F.lit(None).cast("string").alias("text"), "entry_no", F.col("end").alias("_end"))
    rows = lines.select("doc", "line_no", "text", F.lit(None).cast(headings.schema["entry_no"].dataType).alias("entry_no"), F.lit(None).cast("long").alias("_end")).withColumn("_line", F.lit(1))
    both = marks.withColumn("_line", F.lit(0)).unionByName(rows)
    #: entries without lines of their own stand at one place: the last of them goes on
    w = Window.partitionBy("doc").orderBy("line_no", "_line", "entry_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("held", F.last("entry_no", ignorenulls=True).over(w)).withColumn("_from", F.last("_end", ignorenulls=True).over(w))
    return held.where("_line = 1 and line_no >= _from").select("doc", F.col("held").alias("entry_no"), "line_no", "text")


def outline_sections(outline: DataFrame, headings: DataFrame, lines: DataFrame, first_title: str | None = None, separator: str = " › ") -> DataFrame:
    """(doc, entry_no, path, text): each located entry with its path and the text of its lines, entries without text left
    out. `first_title` drops the front matter: what stands before the entry of that name."""
    kept = outline if first_title is None else from_entry(outline, first_title)
    paths = outline_paths(kept, separator)
    located = headings.join(kept.select("doc", "entry_no"), ["doc", "entry_no"], "left_semi")
    held = span_lines(located, lines).groupBy("doc", "entry_no").agg(X.collapse(_spelt("line_no", "text", " ")).alias("text"))
    return held.where("text <> ''").join(paths, ["doc", "entry_no"]).select("doc", "entry_no", "path", "text")
