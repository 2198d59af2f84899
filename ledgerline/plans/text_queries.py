"""Queries over texts by filing: hybrid search and reranking, relevance, narrative flags, facts out of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.normalize import dashed_accession, label
from ledgerline.operators import filings, narrative, retrieval
from ledgerline.plans.domain_queries import _ACC, _FIL, _filings, _queries, _Q
from ledgerline.plans.registry import Registry
from ledgerline.session import materialize
from ledgerline.sources.tables import table

SEARCH, FLAGS = Registry(), Registry()
REGISTRIES = [SEARCH, FLAGS]

# ---- hybrid search -----------------------------------------------------------------------------------------------

_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')"
_BLANKS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


def _hybrid_sql(q: str, docs: str) -> str:
    """Both rankings over every document of each group, fused; d and q are the corpus and the queries."""
    return f"""WITH {q}, d AS ({docs}), pr AS (SELECT grp, query_id, doc_id FROM d CROSS JOIN q),
tf AS (SELECT grp, doc_id, term, count(*) tf FROM (SELECT grp, doc_id, unnest({_WORDS.format("text")}) term FROM d) GROUP BY ALL), nd AS (SELECT grp, count(*) docs FROM d GROUP BY grp),
vo AS (SELECT grp, term, ln((1 + docs)::DOUBLE / (1 + df)) + 1 idf FROM (SELECT grp, term, sum(tf) n, count(*) df FROM tf GROUP BY grp, term QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, term) <= 256) JOIN nd USING (grp)),
dw AS (SELECT grp, doc_id, term, idf, tf * idf w FROM tf JOIN vo USING (grp, term)), qw AS (SELECT query_id, term, count(*) qn FROM (SELECT query_id, unnest({_WORDS.format("query")}) term FROM q) GROUP BY ALL),
qq AS (SELECT grp, query_id, sum(round(pow(qn * idf, 2), 12)::DECIMAL(38, 12))::DOUBLE qq FROM vo JOIN qw USING (term) GROUP BY ALL), dd AS (SELECT grp, doc_id, sum(round(pow(w, 2), 12)::DECIMAL(38, 12))::DOUBLE dd FROM dw GROUP BY ALL),
de AS (SELECT grp, query_id, doc_id, round(dot / sqrt(dd * qq), 6) dense FROM (SELECT grp, query_id, doc_id, sum(round(w * qn * idf, 12)::DECIMAL(38, 12))::DOUBLE dot FROM dw JOIN qw USING (term) GROUP BY ALL) JOIN dd USING (grp, doc_id) JOIN qq USING (grp, query_id)),
tk AS (SELECT grp, doc_id, {_BLANKS.format("text")} t FROM d), sz AS (SELECT grp, count(*) n, sum(len(t))::DOUBLE / count(*) avgdl FROM tk GROUP BY grp), df AS (SELECT grp, term, count(*) df FROM (SELECT grp, unnest(list_distinct(t)) term FROM tk) GROUP BY ALL),
ir AS (SELECT grp, term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) raw FROM df JOIN sz USING (grp)), mn AS (SELECT grp, sum(raw::DECIMAL(28, 12))::DOUBLE / count(*) mean FROM ir GROUP BY grp),
qb AS (SELECT query_id, term, count(*) qn FROM (SELECT query_id, unnest({_BLANKS.format("query")}) term FROM q) GROUP BY ALL), ix AS (SELECT ir.grp, ir.term, CASE WHEN raw < 0 THEN mean * 0.25::DOUBLE ELSE raw END idf FROM ir JOIN mn USING (grp)),
tc AS (SELECT grp, doc_id, dl, term, count(*) tf FROM (SELECT grp, doc_id, len(t) dl, unnest(t) term FROM tk) WHERE term IN (SELECT term FROM qb) GROUP BY ALL),
sp AS (SELECT tc.grp, query_id, doc_id, round(sum(round(qn * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 9)::DECIMAL(28, 9))::DOUBLE, 6) sparse FROM tc JOIN ix ON tc.grp = ix.grp AND tc.term = ix.term JOIN sz ON sz.grp = tc.grp JOIN qb ON qb.term = tc.term GROUP BY ALL),
rk AS (SELECT grp, query_id, doc_id, row_number() OVER (PARTITION BY grp, query_id ORDER BY coalesce(dense, 0) DESC, doc_id) - 1 dr, row_number() OVER (PARTITION BY grp, query_id ORDER BY coalesce(sparse, 0) DESC, doc_id) - 1 sr FROM pr LEFT JOIN de USING (grp, query_id, doc_id) LEFT JOIN sp USING (grp, query_id, doc_id)),
hy AS (SELECT *, row_number() OVER (PARTITION BY grp, query_id ORDER BY score DESC, dr) - 1 rank FROM (SELECT *, round(1.0::DOUBLE / (60 + dr) + 1.0::DOUBLE / (60 + sr), 12) score FROM rk) QUALIFY rank < 10),
rr AS (SELECT *, row_number() OVER (PARTITION BY grp, query_id ORDER BY share DESC, rank) - 1 place FROM (SELECT hy.grp, hy.query_id, hy.doc_id, hy.rank, len(list_intersect(list_distinct({_BLANKS.format("query")}), list_distinct({_BLANKS.format("text")})))::DOUBLE / len(list_distinct({_BLANKS.format("query")})) share FROM hy JOIN d ON d.grp = hy.grp AND d.doc_id = hy.doc_id JOIN q USING (query_id)) QUALIFY place < 5)
"""


_FILED = f"SELECT {_ACC} grp, chunk_key doc_id, text FROM chunks WHERE lower(trim(kind)) = 'prose' AND {_ACC} IS NOT NULL"
#: Candidates of the fused list that are reranked, and how many of them stay.
POOL, KEPT = 10, 5


def _filed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose chunks by filing. Those without an accession number belong to no filing's index."""
    c = table(spark, sf_dir, "chunks", "chunk_key", "accession_number", "kind", "text").where(label("kind") == "prose")
    return c.select(dashed_accession("accession_number").alias("grp"), F.col("chunk_key").alias("doc_id"), "text").where("grp is not null")


@SEARCH.add("search_hybrid_filings", _hybrid_sql(_Q, _FILED) + "SELECT grp, query_id, doc_id, rank::INT rank, round(score, 9) score, dr::INT dense_rank, sr::INT sparse_rank FROM hy")
def search_hybrid_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(_filed_chunks(spark, sf_dir), _queries(spark), POOL).withColumn("score", F.round("score", 9))


@SEARCH.add("search_hybrid_reranked", _hybrid_sql(_Q, _FILED) + "SELECT grp, query_id, doc_id, place::INT rank, share score FROM rr")
def search_hybrid_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = _filed_chunks(spark, sf_dir), _queries(spark)
    return retrieval.rerank_overlap(retrieval.hybrid(docs, q, POOL), docs, q, KEPT)


# What a filing's own index is asked.
SCREEN_QUERIES = [(1, "lawsuit litigation regulatory investigation"), (2, "debt covenant liquidity default going concern")]
_SCREEN = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SCREEN_QUERIES) + ") v(query_id, query))"
_PASSED = f"SELECT {_ACC} grp, passage_id doc_id, text FROM narrative_passages WHERE {_ACC} IS NOT NULL"
_FIRST = "fs AS (SELECT grp, doc_id, row_number() OVER (PARTITION BY grp ORDER BY query_id, place) - 1 place FROM (SELECT grp, doc_id, min((query_id, place)) a, a[1] query_id, a[2] place FROM rr GROUP BY ALL))"


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, doc_id, place): passages of each filing in the order its index brings them up."""
    p = table(spark, sf_dir, "narrative_passages", "passage_id", "accession_number", "text")
    docs = p.select(dashed_accession("accession_number").alias("grp"), F.col("passage_id").alias("doc_id"), "text").where("grp is not null")
    q = spark.createDataFrame(SCREEN_QUERIES, "query_id int, query string")
    return retrieval.first_seen(retrieval.rerank_overlap(retrieval.hybrid(docs, q, POOL), docs, q, KEPT))


@SEARCH.add("search_relevance_order", _hybrid_sql(_SCREEN, _PASSED).rstrip() + f", {_FIRST} SELECT grp, doc_id, place::INT place FROM fs")
def search_relevance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir)


# ---- narrative flags ---------------------------------------------------------------------------------------------

_RULE = "CASE status " + " ".join(f"WHEN '{s}' THEN '{r.replace('{}', '')}'" for s, r, _, _ in narrative.STATUS_RULES) + " END"
_FLAGS = _hybrid_sql(_SCREEN, _PASSED).rstrip() + f""", {_FIRST}, {_FIL},
ch AS (SELECT passage_id, lower(trim(status)) status, CASE WHEN isnan(similarity) THEN NULL ELSE similarity END similarity, prior_chunk_id, diff_summary FROM passage_changes WHERE passage_id IS NOT NULL AND status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY lower(trim(status)), CASE WHEN isnan(similarity) THEN NULL ELSE similarity END NULLS FIRST, prior_chunk_id NULLS FIRST, diff_summary NULLS FIRST) = 1),
fl2 AS (SELECT {_ACC} acc, p.passage_id, chunk_id, unnest(list_distinct(topics)) topic, ch.status, ch.similarity, fs.place FROM narrative_passages p JOIN ch USING (passage_id) LEFT JOIN fs ON fs.doc_id = p.passage_id AND fs.grp = {_ACC}),
ra AS (SELECT *, row_number() OVER (PARTITION BY acc, topic ORDER BY CASE status WHEN 'new' THEN 0 WHEN 'revised' THEN 1 WHEN 'unestablished' THEN 2 ELSE 3 END, place ASC NULLS LAST, coalesce(similarity, 0) DESC, chunk_id ASC NULLS FIRST, passage_id) rank FROM fl2 WHERE acc IS NOT NULL AND status IN ('new', 'revised', 'unestablished', 'unchanged') QUALIFY rank <= 12)
SELECT acc accession_number, passage_id, topic, rank::INT rank, CASE status WHEN 'new' THEN 'NEW_' WHEN 'revised' THEN 'REVISED_' WHEN 'unestablished' THEN 'UNESTABLISHED_' ELSE 'UNCHANGED_' END || topic || '_LANGUAGE' rule_id, CASE WHEN status = 'unchanged' THEN 'routine' ELSE 'notable' END severity FROM ra"""


@FLAGS.add("narrative_flags", _FLAGS)
def narrative_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by the recorded verdicts, of several of a passage the least, ranked by the filing's own index."""
    return _flags(spark, sf_dir).select("accession_number", "passage_id", "topic", "rank", "rule_id", "severity")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = table(spark, sf_dir, "passage_changes", "passage_id", "status", "similarity", "prior_chunk_id", "diff_summary").where("passage_id is not null and status is not null")
    one = F.struct(label("status").alias("status"), F.when(~F.isnan("similarity"), F.col("similarity")).alias("similarity"), "prior_chunk_id", "diff_summary")
    ch = ch.groupBy("passage_id").agg(F.min(one).alias("c")).select("passage_id", "c.*")
    p = table(spark, sf_dir, "narrative_passages", "passage_id", "accession_number", "chunk_id", "section", "text", "topics").select(
        "passage_id", dashed_accession("accession_number").alias("accession_number"), "chunk_id", "section", "text", F.array_distinct("topics").alias("topics")).where("accession_number is not null")
    prior = filings.prior_filing(_filings(spark, sf_dir)).where("prior_accession is not null").groupBy("accession_number").agg(F.max(F.struct("prior_date", "prior_accession")).alias("p")).select("accession_number", "p.*")
    relevance = materialize(_relevance(spark, sf_dir), "relevance").select(F.col("grp").alias("accession_number"), F.col("doc_id").alias("passage_id"), F.col("place").alias("relevance"))
    return narrative.narrative_flags(p.join(ch, "passage_id").join(prior, "accession_number", "left").join(relevance, ["accession_number", "passage_id"], "left"))
