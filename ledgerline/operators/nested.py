"""Deeply nested records as flat tables linked by interval labels.

A depth-first walk numbers every JSON node on the way down (pre) and on the way up (post). Node d lies below
node a exactly if a.pre < d.pre and d.post < a.post, so any level of nesting is found again from two integers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "record_no bigint, record_id bigint, pre int, post int, parent_pre int, depth int, path string, pos int, kind string, value string"
_ARROW = pa.schema([("record_no", pa.int64()), ("record_id", pa.int64()), ("pre", pa.int32()), ("post", pa.int32()), ("parent_pre", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
_FLUSH = 50_000


def _no_constant(name: str) -> None:
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*")


def loads_deep(text: str) -> object:
    """json.loads for any depth: the open lists and objects are on a stack of its own. ValueError for what is no JSON."""
    decode, space = json.JSONDecoder(parse_constant=_no_constant).raw_decode, lambda i: _SPACE.match(text, i).end()
    at, opened = space(0), []  # (list or dict, key at which it waits)
    while True:
        c = text[at : at + 1]
        if c in ("[", "{"):
            value: object = [] if c == "[" else {}
            at = space(at + 1)
            if text[at : at + 1] == ("]" if c == "[" else "}"):
                at += 1
            else:
                opened.append([value, None])
                if c == "{":
                    at = _member(text, at, opened[-1], decode, space)
                continue
        else:
            value, at = decode(text, at)
        while opened:  # value is complete: into what is open, and that in turn
            at, (into, key) = space(at), opened[-1]
            if key is None:
                into.append(value)
            else:
                into[key] = value
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = space(at)
                if key is not None:
                    at = _member(text, at, opened[-1], decode, space)
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(f"no JSON at {at - 1}")
            value = opened.pop()[0]
        else:
            if space(at) != len(text):
                raise ValueError(f"more than one value, at {at}")
            return value


def _member(text: str, at: int, into: list, decode, space) -> int:
    """Read a key and its colon; gives where the value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    into[1], at = decode(text, at)
    at = space(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return space(at + 1)


def _key(k: str) -> str:
    """A key as part of a path: dots and brackets of its own are marked, so that paths stay unambiguous."""
    return k.replace(".", "\\.").replace("[", "\\[") if "." in k or "[" in k else k


def _kind(x: object) -> str:
    if isinstance(x, dict):
        return "object"
    if isinstance(x, list):
        return "array"
    if isinstance(x, str):
        return "string"
    if x is None:
        return "null"
    return "bool" if isinstance(x, bool) else "number"


def label_nodes(payload: str | None) -> list[tuple] | None:
    """(pre, post, parent_pre, depth, path, pos, kind, value) of each node; None for what is no complete JSON.

    path has the keys from the root joined by '.', list levels as '[]'; pos is the place in the list, else null.
    A bare value at a list's place keeps its own path; readers accept both. Walk and, where
    Python's parser gives up, parser keep their own stack, so depth is not bounded by Python's.
    """
    if payload is None:
        return None
    try:
        try:
            root = json.loads(payload, parse_constant=_no_constant)
        except RecursionError:
            root = loads_deep(payload)
    except ValueError:
        return None
    out: list[list] = []
    pre = post = 0
    stack: list[tuple] = [(root, "", None, -1, 0)]
    while stack:
        item, path, pos, parent, depth = stack.pop()
        if path is None:  # way up
            out[parent][1] = post
            post += 1
            continue
        kind = _kind(item)
        value = item if kind == "string" else None if kind in ("object", "array", "null") else json.dumps(item)
        out.append([pre, -1, parent, depth, path, pos, kind, value])
        stack.append((None, None, None, pre, 0))
        if kind == "object":
            stack.extend((v, f"{path}.{_key(k)}" if path else _key(k), None, pre, depth + 1) for k, v in reversed(item.items()))
        elif kind == "array":
            stack.extend((item[i], path + "[]", i, pre, depth + 1) for i in range(len(item) - 1, -1, -1))
        pre += 1
    return [tuple(x) for x in out]


def _nodes(keep: frozenset[str] | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        for batch in batches:
            for no, rid, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for n in label_nodes(payload.as_py()) or ():
                    if keep is None or n[4] in keep:
                        rows.append((no, rid, *n))
                if len(rows) >= _FLUSH:
                    yield give()
                    rows = []
        if rows:
            yield give()

    return work


def node_table(records: DataFrame, payload: str, *paths: str) -> DataFrame:
    """The labelled nodes of each record's JSON payload; records needs the columns record_no and record_id.

    Damaged and null payloads give no node. Naming paths keeps only nodes of those types, before any shuffle.
    """
    keep = frozenset(paths) or None
    return records.select("record_no", "record_id", payload).mapInArrow(_nodes(keep), NODE_SCHEMA)


def numbered(records: DataFrame) -> DataFrame:
    """Give each row its own record_no, so repeated ids stay apart."""
    return records.withColumn("record_no", F.monotonically_increasing_id())


def enclosing(paths: tuple[str, ...], *wanted: str, kind: str = "object") -> Column:
    """For each node the fields of the innermost node of the paths and kind whose interval contains it, else null.

    One ordered pass per record instead of a range join. Nodes of one path have one depth and cannot lie in each other,
    so of each path only the last before a node can contain it; where paths nest, the one that begins last is innermost.
    """
    order = Window.partitionBy("record_no").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    found = []
    for p in paths:
        last = F.last(F.when((F.col("path") == p) & (F.col("kind") == kind), F.struct("pre", "post", *wanted)), ignorenulls=True).over(order)
        found.append(F.when((last["pre"] < F.col("pre")) & (last["post"] > F.col("post")), last))
    return found[0] if len(found) == 1 else F.greatest(*found)


def linked_nodes(records: DataFrame, payload: str, of: tuple[str, ...], within: tuple[str, ...], *also: str) -> DataFrame:
    """The table of one type of node with its parent's row: (record_id, record_no, pre, post, pos, value, parent_pre,
    parent_pos) of the nodes of the paths `of`, objects or bare values, that lie in an object of the paths `within`.

    pos and parent_pos count from 0, a bare value in a list's place is the first. Nodes outside have no row.
    """
    nodes = node_table(records, payload, *of, *within, *also).withColumn("up", enclosing(within, "pos"))
    return nodes.where(F.col("path").isin(*of) & ~F.col("kind").isin("array", "null") & F.col("up").isNotNull()).select(
        "record_id", "record_no", "pre", "post", F.coalesce("pos", F.lit(0)).alias("pos"), "value", F.col("up.pre").alias("parent_pre"), F.coalesce("up.pos", F.lit(0)).alias("parent_pos"))


ACCESSIONS = ("filings.recent.accessionNumber", "filings.recent.accessionNumber[]")
FORMS = ("filings.recent.form", "filings.recent.form[]")
CASES = ("numeric_cases", "numeric_cases[]")
FACTS = tuple(f"{c}.expected_facts{s}" for c in CASES for s in ("", "[]"))
CASE_IDS = tuple(f"{c}.case_id" for c in CASES)
CONCEPTS = tuple(f"{f}.concept" for f in FACTS)


def flat_children(records: DataFrame, id_col: str = "raw_id", payload: str = "payload") -> DataFrame:
    """Children of filing and benchmark payloads: (raw_id, case_pos, item_pos, item_key, item_label).

    Filings: one row per non-null accession number, case_pos -1, its position, and the form at that position.
    Expected facts: one row per element with a concept, by the positions of case and element. A bare value
    where a list is usual counts as position 0 of a list of one; missing or null form and case_id give ''.
    Damaged, null and empty payloads give no row; rows that repeat an id each give their own rows.
    """
    rec = numbered(records.select(F.col(id_col).alias("record_id"), F.col(payload).alias("payload")))
    nodes = node_table(rec, "payload", "filings.recent", *ACCESSIONS, *FORMS, *CASES, *FACTS, *CASE_IDS, *CONCEPTS)
    path, scalar = F.col("path"), ~F.col("kind").isin("object", "array", "null")
    linked = nodes.select(
        "*",
        enclosing(("filings.recent",)).alias("recent"),
        enclosing(CASES, "pos").alias("case"),
        enclosing(FACTS, "pos").alias("fact"),
    )
    # The case_id of a case, for all nodes in it; records are already together, so this and the grouping only sort.
    of_case = F.max(F.when(path.isin(*CASE_IDS) & scalar, F.col("value"))).over(Window.partitionBy("record_no", "case.pre"))
    is_fact = path.isin(*CONCEPTS) & F.col("fact").isNotNull()
    is_filing = path.isin(*ACCESSIONS, *FORMS) & F.col("recent").isNotNull()
    children = (
        linked.withColumn("case_id", of_case).where(scalar & (is_fact | is_filing))
        .groupBy(
            "record_no", "record_id", is_fact.alias("is_fact"), F.when(is_fact, F.col("fact.pre")).otherwise(F.col("recent.pre")).alias("up"),
            F.when(is_fact, F.coalesce("case.pos", F.lit(0))).otherwise(-1).alias("case_pos"), F.when(is_fact, F.coalesce("fact.pos", F.lit(0))).otherwise(F.coalesce("pos", F.lit(0))).alias("item_pos"),
        )
        .agg(
            F.max(F.when(is_fact, F.coalesce("case_id", F.lit(""))).when(path.isin(*ACCESSIONS), F.col("value"))).alias("item_key"),
            F.coalesce(F.max(F.when(is_fact | path.isin(*FORMS), F.col("value"))), F.lit("")).alias("item_label"),
        )
        .where("item_key is not null")
    )
    return children.select(F.col("record_id").alias("raw_id"), "case_pos", "item_pos", "item_key", "item_label")
