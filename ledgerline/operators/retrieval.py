"""Sparse and dense retrieval, fusion and reranking, as plans over whole corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, IDF_FLOOR, RRF_K, VOCABULARY = 1.5, 0.75, 0.25, 60, 256


def blank_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def statistics(docs: DataFrame, wanted: DataFrame, few: bool = True) -> DataFrame:
    """(grp, term, avgdl, idf) of the wanted terms (term) that docs (grp, doc_id, text) have; see bm25."""
    small = F.broadcast if few else lambda x: x
    toks = docs.select("grp", "doc_id", blank_tokens(F.col("text")).alias("t"))
    each = toks.select("grp", F.size("t").alias("dl"), F.posexplode(F.array_distinct("t")).alias("at", "term"))
    # The filter holds for every row; stated, it leaves the exchange the same for both uses of df.
    df = each.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("at") == 0, F.col("dl")).otherwise(0)).alias("tokens")).where("tokens >= 0")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # Terms of equal df have one idf, so the mean is over the few distinct df of a group.
    like = df.groupBy("grp", "df").agg(F.count(F.lit(1)).alias("m"), F.sum("tokens").alias("tokens")).join(docs.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")
    mean = F.sum(raw.cast("decimal(20,12)") * F.col("m").cast("decimal(10,0)")).cast("double") / F.sum("m")
    size = like.groupBy("grp").agg(F.first("n").alias("n"), (F.sum("tokens").cast("double") / F.first("n")).alias("avgdl"), mean.alias("mean"))
    return df.join(small(wanted), "term").join(size, "grp").select("grp", "term", "avgdl", F.when(raw < 0, F.col("mean") * IDF_FLOOR).otherwise(raw).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, few: bool = True) -> DataFrame:
    """(grp, query_id, doc_id, score) of docs (grp, doc_id, text) for queries (query_id, query), scores above none left out.

    Statistics are per grp. A negative idf is replaced by IDF_FLOOR times the mean idf over the group's terms; a term
    repeated in a query counts again. Only documents that share a term with the query come out; the rest score 0.
    few: the queries are a fixed list, whose terms are broadcast, so that only tokens they have are exchanged. grp must
    not be a literal: the planner folds joins on one into products.
    """
    small = F.broadcast if few else lambda x: x
    toks = docs.select("grp", "doc_id", blank_tokens(F.col("text")).alias("t"))
    q = queries.select("query_id", F.explode(blank_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
    wanted = q.select("term").distinct()
    idf = statistics(docs, wanted, few)
    tf = toks.select("grp", "doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(small(wanted), "term").groupBy("grp", "doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("qn") * F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        tf.join(idf, ["grp", "term"]).join(small(q), "term")
        .groupBy("grp", "query_id", "doc_id").agg(F.round(F.sum(F.round(part, 9).cast("decimal(28,9)")).cast("double"), 6).alias("score"))
    )


def top(scored: DataFrame, k: int, by: list[str], score: str = "score", item: str = "doc_id") -> DataFrame:
    """The k best per group with their rank from 0; ties by item."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(item))
    # The filter is on row_number itself, so that each task keeps no more than k per group before the shuffle.
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).withColumn("rank", F.col("_rn") - 1).drop("_rn")


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """The terms most frequent in the corpus: (term, n, df, idf), ties by term."""
    toks = docs.select("doc_id", word_tokens(F.col("text")).alias("t"))
    per_doc = toks.select("doc_id", F.explode("t").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    terms = per_doc.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")).orderBy(F.col("n").desc(), "term").limit(size)
    return terms.join(F.broadcast(total)).select("term", "n", "df", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Unit vectors as sparse rows (doc_id, term, weight) over the vocabulary, whose size is fixed."""
    toks = docs.select("doc_id", F.explode(word_tokens(F.col("text"))).alias("term")).join(F.broadcast(vocab.select("term", "idf")), "term")
    w = toks.groupBy("doc_id", "term").agg((F.count(F.lit(1)) * F.first("idf")).alias("w"))
    norm = F.sqrt(F.sum((F.col("w") * F.col("w")).cast("decimal(38,12)")).over(Window.partitionBy("doc_id")).cast("double"))
    return w.select("doc_id", "term", (F.col("w") / norm).alias("weight"))


def group_tfidf_scores(docs: DataFrame, queries: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(grp, query_id, doc_id, score): cosine of TF-IDF vectors, fitted on each group by itself, for the pairs that share
    a term; the others score 0.

    docs: (grp, doc_id, text), queries: (query_id, query), a fixed list. Vectors are over the size terms most frequent
    in the group, ties by term. Sums are of decimals, so the order of rows does not show.
    """
    exact = lambda c: F.round(c, 12).cast("decimal(38,12)")
    tf = docs.select("grp", "doc_id", F.explode(word_tokens(F.col("text"))).alias("term")).groupBy("grp", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"))
    terms = tf.groupBy("grp", "term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("grp").orderBy(F.col("n").desc(), "term")
    vocab = terms.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).join(total, "grp").select("grp", "term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    d = tf.join(vocab, ["grp", "term"]).select("grp", "doc_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    q = queries.select("query_id", F.explode(word_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
    q_norm = vocab.join(F.broadcast(q), "term").groupBy("grp", "query_id").agg(F.sum(exact((F.col("qn") * F.col("idf")) ** 2)).cast("double").alias("qq"))
    d_norm = d.groupBy("grp", "doc_id").agg(F.sum(exact(F.col("w") ** 2)).cast("double").alias("dd"))
    dot = d.join(F.broadcast(q), "term").groupBy("grp", "query_id", "doc_id").agg(F.sum(exact(F.col("w") * F.col("qn") * F.col("idf"))).cast("double").alias("dot"))
    return dot.join(d_norm, ["grp", "doc_id"]).join(q_norm, ["grp", "query_id"]).select("grp", "query_id", "doc_id", F.round(F.col("dot") / F.sqrt(F.col("dd") * F.col("qq")), 6).alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(grp, query_id, doc_id, rank, score, dense_rank, sparse_rank) of the k best documents of each group by reciprocal
    rank fusion of two rankings that both hold every document of the group, also those that share no term with the query.

    Dense is the cosine of group_tfidf_scores, ties by doc_id; sparse is BM25, ties by doc_id; fused ties keep the dense
    order. queries is a fixed list (a benchmark, the pipeline's own questions): what is ranked is documents times its
    length. A group is one index: a filing, or one of a corpus' shards.
    """
    keys = ["grp", "query_id", "doc_id"]
    pairs = docs.select("grp", "doc_id").join(F.broadcast(queries.select("query_id")))
    dense, sparse = (x.select(*keys, F.col("score").alias(n)) for x, n in ((group_tfidf_scores(docs, queries), "dense"), (bm25(docs, queries), "sparse")))
    both = pairs.join(dense, keys, "left").join(sparse, keys, "left")
    by = lambda c: F.row_number().over(Window.partitionBy("grp", "query_id").orderBy(F.coalesce(c, F.lit(0.0)).desc(), "doc_id")) - 1
    ranked = both.select(*keys, by("dense").alias("dense_rank"), by("sparse").alias("sparse_rank"))
    score = F.round(1.0 / (RRF_K + F.col("dense_rank")) + 1.0 / (RRF_K + F.col("sparse_rank")), 12)
    w = Window.partitionBy("grp", "query_id").orderBy(F.col("score").desc(), "dense_rank")
    return ranked.withColumn("score", score).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select(*keys, (F.col("_rn") - 1).alias("rank"), "score", "dense_rank", "sparse_rank")


def rerank_overlap(hits: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The hits (grp, query_id, doc_id, rank) of each query ordered by the share of its terms they have, then by the rank
    they came with: (grp, query_id, doc_id, rank, score). Of an empty query the first k stay as they are, without a score."""
    t = hits.select("grp", "query_id", "doc_id", F.col("rank").alias("came")).join(docs.select("grp", "doc_id", "text"), ["grp", "doc_id"]).join(F.broadcast(queries), "query_id")
    empty = F.size(blank_tokens(F.col("query"))) == 0
    t = t.withColumn("score", F.when(~empty, overlap(F.col("query"), F.col("text"))))
    w = Window.partitionBy("grp", "query_id").orderBy(F.col("score").desc_nulls_last(), "came")
    return t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select("grp", "query_id", "doc_id", (F.col("_rn") - 1).alias("rank"), "score")


def first_seen(hits: DataFrame) -> DataFrame:
    """(grp, doc_id, place) of the documents of several queries' hits, in the order they first come up."""
    one = hits.groupBy("grp", "doc_id").agg(F.min(F.struct("query_id", "rank")).alias("at"))
    return one.select("grp", "doc_id", (F.row_number().over(Window.partitionBy("grp").orderBy("at")) - 1).alias("place"))


_BLOCK = 4096


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of a task to blocks: ids and unit vectors as binaries."""
    ids: list[int] = []
    vecs: list[list[float]] = []

    def give() -> pa.RecordBatch:
        m = np.array(vecs, np.float64)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        out = pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([m.tobytes()])], names=["ids", "vectors"])
        ids.clear(), vecs.clear()
        return out

    for batch in batches:
        for i, v in zip(*(c.to_pylist() for c in batch.columns)):
            if v is not None and i is not None and all(x is not None for x in v):
                ids.append(i), vecs.append(v)
                if len(ids) >= _BLOCK:
                    yield give()
    if ids:
        yield give()


def _compare(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, di, dv in zip(*(c.to_pylist() for c in batch.columns)):
                qi, di = np.frombuffer(qi, np.int64), np.frombuffer(di, np.int64)
                q, d = np.frombuffer(qv).reshape(len(qi), -1), np.frombuffer(dv).reshape(len(di), -1)
                if q.shape[1] != d.shape[1]:
                    continue
                s = np.round(q @ d.T, 6)
                s[qi[:, None] == di[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(di, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                good = np.isfinite(best)
                rows = np.broadcast_to(qi[:, None], order.shape)[good], di[order][good], best[good]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["query_id", "doc_id", "score"])

    return work


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine neighbours of queries (id, vec) among vectors (id, vec), itself left out: (query_id, doc_id, score, rank).

    Both sides are packed into blocks; every query block meets every vector block once, as one matrix product that
    keeps k per query, so what is shuffled grows with queries times blocks. Null or ragged vectors take no part.
    """
    pack = lambda df, n: df.mapInArrow(_pack, "ids binary, vectors binary").withColumnsRenamed({"ids": n + "i", "vectors": n + "v"})
    blocks = pack(queries, "q").repartition(8).crossJoin(pack(vectors, "d"))
    near = blocks.mapInArrow(_compare(k), "query_id bigint, doc_id bigint, score double")
    return top(near, k, ["query_id"])


def fuse(lists: list[DataFrame], by: list[str], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (…by, doc_id, rank from 0): one aggregation over their union."""
    u = lists[0].select(*by, "doc_id", "rank")
    for x in lists[1:]:
        u = u.unionByName(x.select(*by, "doc_id", "rank"))
    s = u.groupBy(*by, "doc_id").agg(F.round(F.sum((1.0 / (RRF_K + F.col("rank"))).cast("decimal(28,15)")).cast("double"), 9).alias("score"))
    return top(s, k, by)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text has; 0 for an empty query."""
    q, d = F.array_distinct(blank_tokens(query)), F.array_distinct(blank_tokens(text))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def overlap_by_term(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(grp, query_id, doc_id, score) of docs (grp, doc_id, text) that share a term with queries (query_id, query): overlap
    as a join on terms, for query sets that grow with the data."""
    q = queries.select("query_id", F.array_distinct(blank_tokens(F.col("query"))).alias("t")).select("query_id", F.size("t").alias("size"), F.explode("t").alias("term"))
    d = docs.select("grp", "doc_id", F.explode(F.array_distinct(blank_tokens(F.col("text")))).alias("term"))
    return d.join(q, "term").groupBy("grp", "query_id", "doc_id").agg((F.count(F.lit(1)) / F.first("size")).alias("score"))


def precision_at_k(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Micro precision: relevant and returned over returned, of hits and relevant (query_id, doc_id)."""
    r = relevant.select("query_id", "doc_id").distinct().withColumn("ok", F.lit(1))
    return precision(hits.join(r, ["query_id", "doc_id"], "left"))


def precision(judged: DataFrame) -> DataFrame:
    """Micro precision of judged hits, a row each: ok is null for those that are not relevant."""
    return judged.agg(F.count(F.lit(1)).alias("returned"), F.count("ok").alias("relevant"), F.try_divide(F.count("ok") * F.lit(100.0), F.count(F.lit(1))).alias("precision_pct"))
