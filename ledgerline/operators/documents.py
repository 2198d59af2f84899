"""Filing documents: markup to blocks, blocks to chunks, table cells to figures."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHUNK_CHARS = 1500
NO_HEADING = "(no heading)"
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT_BLOCKS = _HEADINGS | {"p", "div"}
_HIDDEN = {"script", "style", "ix:header", "ix:hidden"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}
# Fixed value: how an item's title begins.
_ITEM = re.compile(r"item\s+\d+[a-z]?\s*[.:-]", re.I)
BLOCK_SCHEMA = "doc string, block_order int, kind string, section string, text string, caption string, rows array<array<string>>, complex_layout boolean"


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Tree(HTMLParser):
    """A forgiving element tree: a block start closes an open paragraph, a cell or row start its predecessor."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _TEXT_BLOCKS | {"table", "ul", "ol"}:
            self._close({"p"}, {"td", "th", "table", "div"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        node = _Node(tag, dict(attrs))
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].kids.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return


def _strings(node: _Node) -> list[str]:
    """Texts below a node, in order, without hidden elements; its own stack, as markup may nest deeply."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                out.append(x.strip())
        elif x.tag not in _HIDDEN:
            todo.extend(reversed(x.kids))
    return out


def _below(node: _Node) -> Iterator[_Node]:
    todo = [k for k in reversed(node.kids) if not isinstance(k, str)]
    while todo:
        x = todo.pop()
        if x.tag in _HIDDEN:
            continue
        yield x
        todo.extend(k for k in reversed(x.kids) if not isinstance(k, str))


def parse_blocks(html: str | None) -> list[tuple]:
    """(kind, section, text, caption, rows, complex_layout) of a document's prose and tables, in order."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out: list[tuple] = []
    section, caption = NO_HEADING, None
    todo: list[_Node] = [tree.root]
    while todo:
        x = todo.pop()
        kids = [k for k in x.kids if not isinstance(k, str) and k.tag not in _HIDDEN]
        if x.tag == "table":
            inner = list(_below(x))
            rows = [r for r in ([" ".join("".join(_strings(c)).split()) for c in _below(tr) if c.tag in ("td", "th")] for tr in inner if tr.tag == "tr") if any(r)]
            if rows:
                spans = any(n.attrs.get(a, "1") != "1" for n in inner for a in ("colspan", "rowspan"))
                out.append(("table", section, None, caption, rows, spans or any(n.tag == "table" for n in inner)))
                caption = None
            continue
        if x.tag in _TEXT_BLOCKS and not (x.tag == "div" and any(n.tag in _TEXT_BLOCKS or n.tag == "table" for n in _below(x))):
            # A heading's parts are joined without blanks, and even an empty one ends the reach of a caption.
            text = " ".join(("" if x.tag in _HEADINGS else " ").join(_strings(x)).split())
            if x.tag in _HEADINGS:
                section, caption = text or section, None
            elif text and len(text) < 200 and _ITEM.match(text):
                section, caption = text, None
            elif text:
                out.append(("prose", section, text, None, None, False))
                caption = text
            if x.tag != "p":
                continue
            kids = [k for k in kids if k.tag == "table"]
        todo.extend(reversed(kids))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.bool_())
    names = ["doc", "block_order", "kind", "section", "text", "caption", "rows", "complex_layout"]
    for batch in batches:
        rows = [(doc, i, *b) for doc, html in zip(*(c.to_pylist() for c in batch.columns)) for i, b in enumerate(parse_blocks(html))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def html_blocks(docs: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """One row per block of each document; null and empty documents give none."""
    return docs.select(F.col(doc).cast("string").alias("doc"), html).mapInArrow(_blocks, BLOCK_SCHEMA)


def render_table(caption: Column, rows: Column) -> Column:
    """Caption line, then each row with its cells parted by ' | '."""
    return F.concat_ws("\n", caption, F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n"))


def _chunk_numbers(max_chars: int):
    @F.pandas_udf("array<int>")
    def number(sections: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for names, lengths in zip(sections, sizes):
            no, size, now, nos = 0, 0, None, []
            for name, n in zip(names, lengths):
                if size > 0 and (name != now or size + n > max_chars):
                    no, size = no + 1, 0
                size, now = size + int(n), name
                nos.append(no)
            out.append(nos)
        return pd.Series(out)

    return number


def pack_chunks(blocks: DataFrame, by: list[str], max_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Neighbouring prose blocks of one section greedily joined into chunks of at most max_chars (the joining blanks
    not counted): (…by, chunk_no, section, source_orders, text). A longer block stays whole.

    blocks: (…by, block_order, tie, section, text); tie tells blocks of one order apart. The fold runs in Python over the ordered lengths of a document's
    blocks only (a few bytes each); the texts are joined by chunk afterwards.
    """
    g = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("block_order", "tie", "section", F.length("text").alias("n")))).alias("b"))
    numbered = g.select(*by, F.explode(F.arrays_zip(F.col("b"), _chunk_numbers(max_chars)(F.col("b.section"), F.col("b.n")).alias("no"))).alias("z"))
    no = numbered.select(*by, F.col("z.no").alias("chunk_no"), F.col("z.b.block_order").alias("block_order"), F.col("z.b.tie").alias("tie"))
    one = blocks.join(no, [*by, "block_order", "tie"])
    parts = one.groupBy(*by, "chunk_no").agg(F.array_sort(F.collect_list(F.struct("block_order", "tie", "text"))).alias("p"), F.first("section").alias("section"))
    return parts.select(*by, "chunk_no", "section", F.col("p.block_order").alias("source_orders"), F.array_join(F.col("p.text"), " ").alias("text"))


def chunk_blocks(blocks: DataFrame, by: list[str], max_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Chunks of prose and tables: (…by, chunk_id, kind, section, source_orders, text).

    A table is a chunk of its own and ends the prose chunk before it; prose is packed as by pack_chunks. The id names the
    kind and the first block. blocks: (…by, block_order, tie, kind, section, text, caption, rows).
    """
    is_table = F.col("kind") == "table"
    text = F.when(is_table, render_table(F.col("caption"), F.col("rows"))).otherwise(F.col("text"))
    # A name of its own keeps each table apart from whatever stands beside it.
    name = F.when(is_table, F.concat_ws(":", F.lit("table"), "block_order", "tie", "section")).otherwise(F.concat(F.lit("prose:"), F.coalesce("section", F.lit(NO_HEADING))))
    c = pack_chunks(blocks.select(*by, "block_order", "tie", name.alias("section"), text.alias("text")), by, max_chars)
    kind = F.substring_index("section", ":", 1)
    section = F.when(kind == "table", F.regexp_replace("section", "^table:[^:]*:[^:]*:?", "")).otherwise(F.substring("section", 7, 1 << 30))
    return c.select(*by, F.concat(kind, F.lit("-"), F.get("source_orders", F.lit(0)).cast("string")).alias("chunk_id"), kind.alias("kind"), section.alias("section"), "source_orders", "text")


def numeric_cell(cell: Column) -> Column:
    """The figure in a table cell, parentheses for minus; null for anything else."""
    c = F.trim(cell)
    # Fixed value: what a figure looks like.
    ok = c.rlike(r"^\(?\$?\s*-?[\d,]+(\.\d+)?\)?$")
    v = F.regexp_replace(c, r"[(),$\s]", "").try_cast("double")
    return F.when(ok, F.when(c.startswith("(") & c.endswith(")"), -v).otherwise(v))


# Row labels by concept, tried in this order.
ROW_LABELS = [
    ("revenue", r"\btotal revenue|\bnet revenue|^revenue[s]?$"),
    ("net_income", r"\bnet income|\bnet loss"),
    ("gross_profit", r"\bgross profit"),
    ("operating_income", r"\boperating income|\bincome from operations"),
    ("total_debt", r"^total debt$|^total borrowings$"),
]
# Scale words, and currencies (as substrings) that rule a table out.
SCALES = [("thousands", 1e3), ("millions", 1e6), ("billions", 1e9)]
OTHER_CURRENCIES = ("eur", "euro", "gbp", "cad", "yen")


def row_concept(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(c)) for c, p in ROW_LABELS])


def table_scale(context: Column) -> Column:
    """1, 1e3, 1e6 or 1e9; null where several scale words or another currency make the table ambiguous."""
    low = F.lower(context)
    hits = [F.when(low.contains(w), F.lit(f)) for w, f in SCALES]
    found = F.array_compact(F.array(*hits))
    foreign = F.reduce(F.array(*[low.contains(w) for w in OTHER_CURRENCIES]), F.lit(False), lambda a, x: a | x)
    return F.when(foreign | (F.size(found) > 1), None).otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit(1.0)))


def table_facts(tables: DataFrame) -> DataFrame:
    """Facts of flat tables with one dated column: tables (doc, block_order, caption, rows, complex_layout, fiscal_period,
    period_end_date) to (doc, block_order, row_pos, concept, label, val).

    The column's header must name the period end, for flows also its duration; a table with spans, several scale words
    or another currency gives nothing.
    """
    header = F.get("rows", F.lit(0))
    context = F.concat_ws(" ", F.coalesce("caption", F.lit("")), F.array_join(header, " "))
    days = F.array(F.col("period_end_date").cast("string"), F.lower(F.date_format("period_end_date", "MMMM d, yyyy")))
    dated = lambda h: F.exists(days, lambda d: F.lower(h).contains(d))
    # Phrases for a year's and a quarter's duration.
    spans = F.when(F.col("fiscal_period") == "FY", F.array(*map(F.lit, ("year ended", "twelve months", "12 months")))).otherwise(F.array(*map(F.lit, ("three months", "3 months"))))
    lasting = lambda h: F.exists(spans, lambda d: F.lower(h).contains(d))
    cols = F.filter(F.transform(header, lambda h, i: F.when((i > 0) & dated(h), i)), lambda i: i.isNotNull())
    t = tables.where(~F.col("complex_layout") & (F.size("rows") > 0)).withColumns({"scale": table_scale(context), "cols": cols, "header": header})
    t = t.withColumn("flows", F.filter("cols", lambda i: lasting(F.get("header", i)))).where("scale is not null")
    rows = t.select("*", F.posexplode("rows").alias("row_pos", "r")).where(F.size("r") > 1).withColumn("concept", row_concept(F.get("r", F.lit(0)))).where("concept is not null")
    use = F.when(F.col("concept") == "total_debt", F.col("cols")).otherwise(F.col("flows"))
    rows = rows.where(F.size(use) == 1).withColumn("val", numeric_cell(F.get("r", F.get(use, F.lit(0)))) * F.col("scale")).where("val is not null")
    return rows.select("doc", "block_order", "row_pos", "concept", F.trim(F.get("r", F.lit(0))).alias("label"), "val")


def fill_gaps(facts: DataFrame, found: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts (doc, concept, val) joined by the first table figure of each target concept they lack; none is overwritten."""
    missing = targets.join(facts.select("doc", "concept").distinct(), ["doc", "concept"], "left_anti")
    first = found.join(missing, ["doc", "concept"], "left_semi").groupBy("doc", "concept").agg(F.min(F.struct("block_order", "row_pos", "val")).alias("f"))
    return facts.select("doc", "concept", "val", F.lit("xbrl").alias("source")).unionByName(first.select("doc", "concept", F.col("f.val").alias("val"), F.lit("html_table_fallback").alias("source")))
