"""Rankings for query sets that grow with the data, by blocks: every block of queries meets every block of documents in one
task, which keeps the k best of each query. What is exchanged is the documents once and k rows, never pairs.

Terms are compared by 64-bit hashes. Parts of BM25 are rounded to nine digits, so as whole numbers their sums are exact
in doubles. A document or query whose id repeats counts as one, of the terms of all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.retrieval import IDF_FLOOR, K1, RRF_K, B, blank_tokens, statistics, top
from ledgerline.session import partitions_for

#: Documents and queries of a block; the queries' most frequent terms, multiplied as a dense matrix, for groups and for a
#: corpus; documents of one product; cells ranked at a time.
DOCS, QUERIES, DENSE, SLAB, CELLS = 1024, 1024, (256, 1024), 256, 2_000_000
#: Documents of the largest group that one task holds whole.
LARGE_GROUP = 100_000
#: A common term counts so much beside the whole numbers that are added; fewer than 1 / MARK of them stay below 1.
MARK = 2.0**-11

_DOC_BLOCK = "names array<string>, held array<bigint>, ids binary, null_ids binary, sizes binary, terms binary"
_QUERY_BLOCK = "query_ids binary, query_sizes binary, query_terms binary, times binary, idf binary, avgdl double"


def hashed(text: Column) -> Column:
    return F.transform(blank_tokens(text), lambda t: F.xxhash64(t))


def _pack_docs(whole: bool):
    """(grp, doc_id, terms) in order of grp and doc_id to blocks of whole groups; if not whole, of whole documents, without
    regard to groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def give() -> pa.RecordBatch:
            names, counts, ids, void, sizes, terms = (np.concatenate(x) for x in zip(*held))
            edge = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            held.clear()
            cells = [names[edge].tolist(), np.add.reduceat(counts, edge).tolist(), ids.tobytes(), void.tobytes(), sizes.tobytes(), terms.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["names", "held", "ids", "null_ids", "sizes", "terms"])

        last, waiting, seen, last_id = None, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, terms = batch.column(1), batch.column(2)
            size, at = np.diff(terms.offsets.to_numpy()).astype(np.int64), terms.offsets.to_numpy()
            value, void = terms.values.to_numpy(), np.array(ids.is_null())
            ids = ids.fill_null(0).to_numpy().astype(np.int64)
            if whole:
                name = np.array(batch.column(0).to_pylist(), object)
            else:
                place = seen + np.cumsum(np.r_[ids[0] != last_id, ids[1:] != ids[:-1]])
                name, seen, last_id = (place // DOCS).astype(str).astype(object), int(place[-1]), ids[-1]
            starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(name)]):
                if name[a] != last and waiting >= (DOCS if whole else 1):
                    yield give()
                    waiting = 0
                held.append((name[a : a + 1], np.array([z - a]), ids[a:z], void[a:z], size[a:z], value[at[a] : at[z]]))
                last, waiting = name[a], waiting + z - a
        if held:
            yield give()

    return work


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, terms (h, n, idf), avgdl), one row a query, to blocks. avgdl is null without statistics, and
    for queries that have no term of the corpus."""
    for batch in batches:
        for at in range(0, batch.num_rows, QUERIES):
            part = batch.slice(at, QUERIES)
            terms, flat = part.column(1), part.column(1).flatten()
            h, n, idf = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            cells = [x.tobytes() for x in (part.column(0).to_numpy().astype(np.int64), sizes, h.astype(np.int64), n.astype(np.int64), idf.astype(np.float64))]
            yield pa.RecordBatch.from_arrays([*(pa.array([c]) for c in cells), pa.array([pc.max(part.column(2)).as_py()], pa.float64())], names=["query_ids", "query_sizes", "query_terms", "times", "idf", "avgdl"])


class Queries:
    """A block of queries: its features (term, times) and which queries have them."""

    def __init__(self, ids: bytes, sizes: bytes, terms: bytes, times: bytes, idf: bytes, avgdl: float | None, kind: str = "bm25"):
        self.ids, self.sizes, self.avgdl = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), avgdl
        h, n, w = np.frombuffer(terms, np.int64), np.frombuffer(times, np.int64), np.frombuffer(idf, np.float64)
        n = np.ones_like(n) if kind == "overlap" else n
        self.terms, term = np.unique(h, return_inverse=True)
        keys, first, feature = np.unique((term.astype(np.int64) << 32) | n, return_index=True, return_inverse=True)
        self.n, self.idf = n[first].astype(np.float64), w[first]
        self.first = np.searchsorted(keys >> 32, np.arange(len(self.terms) + 1))  # features of each term
        owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        often = np.argsort(-np.bincount(feature, minlength=len(keys)), kind="stable")[: DENSE[avgdl is not None]]
        place = np.full(len(keys), -1)
        place[often] = np.arange(len(often))
        dense = place[feature] >= 0
        self.often, self.dense = often, np.zeros((len(often), len(self.ids)))
        self.dense[place[feature[dense]], owner[dense]] = 1
        self.owner, self.feature = owner[~dense], feature[~dense]  # in order of owner
        self.row, self.longest = np.full(len(keys), -1), max(self.sizes.tolist(), default=0)

    def sums(self, rows: np.ndarray, w: np.ndarray, a: int, z: int) -> np.ndarray:
        """Queries a to z by columns of w: sums of the rows of w whose features they have. rows: feature of each row of w."""
        self.row[rows] = np.arange(len(rows))
        top = self.row[self.often]
        out = self.dense[top >= 0, a:z].T @ w[top[top >= 0]]
        lo, hi = np.searchsorted(self.owner, (a, z))
        at = self.row[self.feature[lo:hi]]
        self.row[rows] = -1
        there = np.flatnonzero(at >= 0)
        step = max(1, CELLS // w.shape[1])
        for c in range(0, len(there), step):
            pick = there[c : c + step]
            own = self.owner[lo + pick] - a
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[edge]] += np.add.reduceat(w[at[pick]], edge, axis=0)
        return out


def _log_odds(n: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.log(n - df + 0.5) - np.log(df + 0.5)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Whole number of units of the last digit; halves away from 0."""
    y = x * 10.0**digits
    return np.copysign(np.floor(np.abs(y) + 0.5), y)


def _term_counts(unit: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, term, times) of tokens, in order of term."""
    sort = np.lexsort((unit, term))
    unit, term = unit[sort], term[sort]
    first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (term[1:] != term[:-1])])
    return unit[first], term[first], np.diff(np.r_[first, len(term)]).astype(np.float64)


def _group(q: Queries, ids: np.ndarray, void: np.ndarray, sizes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct ids, feature, document, weight) of a group's rows, which are in order of id. Statistics are the group's own,
    unless the queries bring those of the corpus."""
    n = len(ids)
    if not len(terms):
        return ids[:0], *(np.empty(0, np.int64),) * 3
    new_doc = np.r_[True, (ids[1:] != ids[:-1]) | (void[1:] != void[:-1])]
    doc = np.cumsum(new_doc) - 1
    # Rows of one id and length count as one text, those of other lengths add up.
    order = np.lexsort((sizes, doc))
    new_unit = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])]
    unit = np.empty(n, np.int64)
    unit[order] = np.cumsum(new_unit) - 1
    doc_of, dl_of = doc[order][new_unit], sizes[order][new_unit].astype(np.float64)
    u, t, tf = _term_counts(np.repeat(unit, sizes), terms)
    at = np.minimum(np.searchsorted(q.terms, t), max(0, len(q.terms) - 1))
    known = q.terms[at] == t if len(q.terms) else np.zeros(len(t), bool)
    if q.avgdl is None:
        if n == len(doc_of):
            r = t
        else:  # of rows, not units
            r = _term_counts(np.repeat(np.arange(n), sizes), terms)[1]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        df = np.diff(np.r_[start, len(r)])
        raw = _log_odds(float(n), df.astype(np.float64))
        mean = half_up(raw, 12).sum() / 1e12 / len(raw)
        idf, avgdl = np.where(raw < 0, mean * IDF_FLOOR, raw)[np.searchsorted(r[start], t[known])], float(sizes.sum()) / n
    else:
        idf, avgdl = q.idf[q.first[at[known]]], q.avgdl
    u, at, tf = u[known], at[known], tf[known]
    times = q.first[at + 1] - q.first[at]
    p = np.repeat(np.arange(len(u)), times)
    feature = q.first[at][p] + np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times)
    w = half_up(q.n[feature] * idf[p] * (tf[p] * (K1 + 1)) / (tf[p] + K1 * (1 - B + B * dl_of[u[p]] / avgdl)), 9)
    usable = ~void[new_doc][doc_of[u[p]]]
    return ids[new_doc], feature[usable], doc_of[u[p]][usable], w[usable]


def _scores(kind: str, q: Queries, feature: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights and numbers of common terms, of queries a to z by documents: both for fused, else what kind is ranked
    by, and whether there is a common term."""
    total, common = np.zeros((z - a, docs)), np.zeros((z - a, docs))
    plain = kind == "bm25" and len(weight) and weight.min() > 0
    cut = np.searchsorted(doc, np.arange(0, docs + SLAB, SLAB))
    for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if x == y:
            continue
        rows, row = np.unique(feature[x:y], return_inverse=True)
        wide = min(SLAB, docs - i * SLAB)
        cell = row * wide + doc[x:y] - i * SLAB
        w = np.bincount(cell, weight[x:y], len(rows) * wide).reshape(-1, wide)
        s = slice(i * SLAB, i * SLAB + wide)
        if plain:  # no common term without a sum
            total[:, s] = q.sums(rows, w, a, z)
            common[:, s] = total[:, s]
            continue
        mark = np.zeros(w.size)
        mark[cell] = MARK
        mark = mark.reshape(w.shape)
        if kind == "overlap":
            common[:, s] = q.sums(rows, mark / MARK, a, z)
            continue
        most, many = np.abs(weight[x:y]).max() * q.longest, q.longest
        if most >= 2.0**41:  # the product is a rough bound
            most = q.sums(rows, np.abs(w).max(1, keepdims=True), a, z).max()
        if most < 2.0**41 and many < 1 / MARK:
            both = q.sums(rows, w + mark, a, z)
            total[:, s] = np.floor(both)
            common[:, s] = (both - total[:, s]) / MARK
        else:
            total[:, s], common[:, s] = q.sums(rows, w, a, z), q.sums(rows, mark / MARK, a, z)
    return total, common


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank) of the k highest of each row that are not -inf; of equal ones the earlier column."""
    if score.shape[1] > 64 and k < 32:
        least = -np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, min(k, score.shape[1]) - 1]
        row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        sort = np.lexsort((col, -score[row, col], row))
        row, col = row[sort], col[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        return row[keep], col[keep], rank[keep]
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    row, rank = np.nonzero(np.take_along_axis(score, order, 1) > -np.inf)
    return row, order[row, rank], rank


def _ranks(score: np.ndarray) -> np.ndarray:
    order = np.argsort(-score, axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(score.shape[1]), score.shape), 1)
    return out


def _final(kind: str, q: Queries, total: np.ndarray, common: np.ndarray, a: int, z: int) -> np.ndarray:
    """What the documents are ranked by; -inf for those without a common term."""
    if kind == "bm25":
        return np.where(common > 0, half_up(total / 1e9, 6) / 1e6, -np.inf)
    shares = np.where(common > 0, common / np.maximum(q.sizes[a:z, None], 1), -np.inf)
    if kind == "overlap":
        return shares
    sparse = np.where(common > 0, half_up(total / 1e9, 6) / 1e6, -np.inf)
    parts = sum(half_up(1.0 / (RRF_K + _ranks(x)), 15) for x in (sparse, shares))
    return np.where(common > 0, half_up(parts / 1e15, 9) / 1e9, -np.inf)


def _rank(kind: str, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, held, ids, void, sizes, terms, *query in zip(*(c.to_pylist() for c in batch.columns)):
                q = Queries(*query, kind)
                ids, void, sizes, terms = np.frombuffer(ids, np.int64), np.frombuffer(void, bool), np.frombuffer(sizes, np.int64), np.frombuffer(terms, np.int64)
                row_at, found = 0, []
                for g, n in enumerate(held):
                    r = slice(row_at, row_at + n)
                    size = sizes[r]
                    got, feature, doc, weight = _group(q, ids[r], void[r], size, terms[: size.sum()])
                    terms, row_at = terms[size.sum() :], row_at + n
                    sort = np.argsort(doc, kind="stable")
                    feature, doc, weight = feature[sort], doc[sort], weight[sort]
                    step = max(1, CELLS // len(got)) if len(doc) else len(q.ids)
                    for a in range(0, len(q.ids) if len(doc) else 0, step):
                        z = min(a + step, len(q.ids))
                        total, common = _scores(kind, q, feature, doc, weight, len(got), a, z)
                        common[q.ids[a:z, None] == got[None, :]] = 0
                        score = _final(kind, q, total, common, a, z)
                        row, col, rank = _best(score, k)
                        found.append((np.full(len(row), g), q.ids[a:z][row], got[col], rank.astype(np.int64), score[row, col]))
                if found:
                    g, *rest = (np.concatenate(x) for x in zip(*found))
                    for c in range(0, len(g), 100_000):
                        grp = pa.DictionaryArray.from_arrays(pa.array(g[c : c + 100_000]), pa.array(names, pa.string())).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([grp, *(pa.array(x[c : c + 100_000]) for x in rest)], names=["grp", "query_id", "doc_id", "rank", "score"])

    return work


_RANKED = "grp string, query_id bigint, doc_id bigint, rank bigint, score double"


def _query_blocks(q: DataFrame) -> DataFrame:
    """q: (query_id, term, qn, idf, avgdl). Written out as blocks first, which every task of documents then reads."""
    terms = F.collect_list(F.struct(F.xxhash64("term").alias("h"), F.col("qn").alias("n"), F.col("idf")))
    rows = q.groupBy("query_id").agg(terms.alias("terms"), F.first("avgdl", ignorenulls=True).alias("avgdl"))
    return rows.mapInArrow(_pack_queries, _QUERY_BLOCK)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(blank_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))


def _blocks(docs: DataFrame, by: str, whole: bool) -> DataFrame:
    # Texts are exchanged, which their codec shortens, not hashes.
    rows = docs.repartition(partitions_for(docs), by).sortWithinPartitions(*["grp"] * whole, "doc_id")
    return rows.select(F.col("grp").cast("string").alias("grp"), F.col("doc_id").cast("bigint").alias("doc_id"), hashed(F.col("text")).alias("terms")).mapInArrow(_pack_docs(whole), _DOC_BLOCK)


def _meet(kind: str, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    # One partition of query blocks, behind an exchange: it is read, not computed, for each partition of documents.
    return docs.crossJoin(_query_blocks(queries).repartition(1)).mapInArrow(_rank(kind, k), _RANKED)


def rank_groups(kind: str, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(grp, query_id, doc_id, rank, score) of the k best of docs (grp, doc_id, text) in each group for queries (query_id,
    query), itself and those without a common term left out. kind: bm25, overlap, or fused, by reciprocal ranks of both
    whole rankings. A group is held whole by one task, which takes its statistics; see large_groups."""
    q = query_terms(queries).withColumns({"idf": F.lit(0.0), "avgdl": F.lit(None).cast("double")})
    return _meet(kind, _blocks(docs, "grp", True), q, k)


def rank_corpus(kind: str, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best of docs (grp, doc_id, text), all of one group of any size, by bm25 or
    overlap: blocks of documents are ranked by themselves, with the statistics of all, and then their best."""
    q = query_terms(queries)
    q = q.join(statistics(docs, q.select("term").distinct(), few=False), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    ranked = _meet(kind, _blocks(docs.where("doc_id is not null"), "doc_id", False), q, k)
    return top(ranked.select("query_id", "doc_id", "score"), k, ["query_id"])


def large_groups(docs: DataFrame, most: int = LARGE_GROUP) -> list[str]:
    """Groups of more than most documents; a collection has at most its size over most of them."""
    return [r.grp for r in docs.groupBy("grp").count().where(F.col("count") > most).select("grp").collect()]
