import difflib
import math
import random
import re
from datetime import date

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerline.operators import blocks, filings, narrative, records, retrieval
from ledgerline.plans import domain_queries


def test_topics_and_dates(spark):
    df = spark.createDataFrame([(1, "A Lawsuit over defaulted debt"), (2, None), (3, "On March 3, 2024 and 2024-01-02, fiscal year 2023 cost $5  M")], "i int, t string")
    r = df.select("i", narrative.topics_of(F.col("t")).alias("k"), narrative.comparable_text(F.col("t")).alias("n")).orderBy("i").collect()
    assert [x.k for x in r] == [["LIQUIDITY_REGULATORY", "LITIGATION"], [], []]
    assert r[2].n == "on <date> and <date> , <date> cost $5 m" and r[1].n is None


def test_sentences_fall_back_to_the_whole_text(spark):
    df = spark.createDataFrame([("one two three four five six. short. a b c d e f g!",), ("too short. also.",)], "t string")
    assert [r.s for r in df.select(narrative.sentences_of(F.col("t")).alias("s")).collect()] == [["one two three four five six.", "a b c d e f g!"], ["too short. also."]]


def test_matches_equal_a_naive_scan(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("alpha beta gamma delta kappa sigma omega lambda".split()) for _ in range(9)) for _ in range(12)]
    edit = lambda s: "".join(c for c in s if rnd.random() > 0.03)
    old, new = [edit(s) for s in base], [edit(s) for s in rnd.sample(base, 8)] + [base[0], "something entirely different from the rest"]
    rows = [("old", 1, "c", i, s) for i, s in enumerate(old)] + [("new", 2, "d", i, s) for i, s in enumerate(new)]
    s = spark.createDataFrame(rows, "accession_number string, passage_id bigint, chunk_id string, pos int, sentence string").withColumn("company", F.lit(1))
    pairs = spark.createDataFrame([("new", "old")], "accession_number string, prior_accession string")
    got = {r.pos: r.old_pos for r in narrative.matched_sentences(s.where("passage_id = 2"), pairs, s).collect()}
    want = {}
    for i, b in enumerate(new):
        hits = [j for j, a in enumerate(old) if difflib.SequenceMatcher(None, a, b, False).ratio() >= 0.9]
        exact = [j for j in hits if old[j] == b]
        if hits:
            want[i] = (exact or hits)[0]
    assert got == want


def test_changes_and_baselines(spark):
    long = "the company renewed its revolving credit facility on similar terms. "
    rows = [(1, 7, "a1", "c1", long * 2), (2, 7, "a2", "c9", long + "a wholly new sentence about an unexpected regulatory matter arose today."), (3, 7, "a2", "c8", long), (4, 8, "b1", "c1", long), (5, 7, "a2", "c7", None)]
    p = spark.createDataFrame(rows, "passage_id bigint, company bigint, accession_number string, chunk_id string, text string")
    f = spark.createDataFrame([(7, "periodic", "a1", date(2024, 1, 1)), (7, "periodic", "a2", date(2024, 4, 1)), (7, "event", "e1", date(2024, 3, 1)), (7, "periodic", "a3", date(2024, 4, 1)), (8, "periodic", "b1", date(2024, 4, 1))], "company bigint, class string, accession_number string, filing_date date")
    prior = filings.prior_filing(f)
    assert {r.accession_number: r.prior_accession for r in prior.collect()} == {"a1": None, "a2": "a1", "a3": "a1", "e1": None, "b1": None}
    got = {r.passage_id: (r.status, r.similarity, r.prior_chunk_id) for r in narrative.passage_changes(p, prior.select("accession_number", "prior_accession")).collect()}
    assert got == {1: ("unestablished", None, None), 2: ("revised", 0.5, "c1"), 3: ("unchanged", 1.0, "c1"), 4: ("unestablished", None, None)}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, 1, "Red apple red"), (0, 2, "green apple"), (0, 3, "apple pie"), (0, 4, None)], "grp int, doc_id bigint, text string")
    q = spark.createDataFrame([(1, "red"), (2, "apple apple")], "query_id int, query string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(docs, q).collect()}
    n, avg = 4, 7 / 4
    idf = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    raw = {"red": idf(1), "apple": idf(3), "green": idf(1), "pie": idf(1)}
    part = lambda tf, dl, w: w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    floor = 0.25 * sum(raw.values()) / 4
    assert abs(got[1, 1] - part(2, 3, raw["red"])) < 1e-5
    assert raw["apple"] < 0 and abs(got[2, 2] - 2 * part(1, 2, floor)) < 1e-5 and (1, 2) not in got


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    e = spark.createDataFrame(v, "id bigint, vec array<double>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.nearest_vectors(e.where("id < 3"), e, 4).collect()}
    m = np.array([x for i, x in v if i < 60])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        order = [i for i in np.argsort(-np.round(m @ m[q], 6), kind="stable") if i != q][:4]
        assert [got[q, k] for k in range(4)] == order


def test_fusion_overlap_precision(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id int, doc_id bigint, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "query_id int, doc_id bigint, rank int")
    assert [r.doc_id for r in retrieval.fuse([a, b], ["query_id"], 2).orderBy("rank").collect()] == [11, 10]
    o = spark.createDataFrame([("red red pie", "a RED fox"), ("", "x")], "q string, t string").select(retrieval.overlap(F.col("q"), F.col("t")).alias("o")).collect()
    assert [x.o for x in o] == [0.5, 0.0]
    p = retrieval.precision_at_k(a, spark.createDataFrame([(1, 10), (1, 10), (1, 99)], "query_id int, doc_id bigint")).first()
    assert (p.returned, p.relevant, p.precision_pct) == (2, 1, 50.0)


def test_records(spark):
    flags = lambda *s: [(x,) for x in s]
    r = spark.createDataFrame([("a1", "01", "10-K", date(2024, 1, 1), flags("notable")), ("a2", "01", "8-k", date(2024, 2, 1), flags("routine")), ("a3", "02", "10-K", date(2024, 3, 1), None)], "accession_number string, company_cik string, form string, filing_date date, flags array<struct<severity:string>>")
    n, rows = records.list_records(r, limit=1)
    assert n.first()[0] == 3 and [x.accession_number for x in rows.collect()] == ["a3"]
    assert [x.accession_number for x in records.list_records(r, form="8-K")[1].collect()] == ["a2"]
    assert [x.accession_number for x in records.list_records(r, notable_only=True)[1].collect()] == ["a1"]
    claims = spark.createDataFrame([(1, ["c1", "c2"], ["Red Fox", "pie"]), (2, ["c1", "zz"], ["red"]), (3, ["c1"], ["blue"])], "claim_id int, cited array<string>, phrases array<string>")
    chunks = spark.createDataFrame([("c1", "the red fox"), ("c2", "a pie")], "chunk_id string, text string")
    assert {x.claim_id: x.supported for x in records.citation_support(claims, chunks).collect()} == {1: True, 2: False, 3: False}
    assert {x.k: x.v for x in records.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), "k").collect()} == {1: "a", 2: "c"}


def test_citations_take_whole_phrases_of_every_change(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "A", "c1", "Revenue grew by ten percent in the year"), (2, "A", "c2", "Costs fell")], "passage_id bigint, accession_number string, chunk_id string, text string").write.parquet(f"{d}/narrative_passages.parquet")
    changes = [(7, "A", "c1", "revenue grew by ten percent"), (7, "A", "c1", "Revenue grew by ten percent in every year"), (7, "A", "c2", "costs fell"), (7, "A", "c2", "costs fell"), (8, "A", "c9", "costs"), (9, "A", None, "costs")]
    spark.createDataFrame(changes, "passage_id bigint, accession_number string, prior_chunk_id string, diff_summary string").write.parquet(f"{d}/passage_changes.parquet")
    rows = entry.queries()["eval_citation_whole_phrases"](spark, d).collect()
    assert sorted((r.claim_id.rpartition("#")[0], r.supported) for r in rows) == [("A/c1#7", False), ("A/c1#7", True), ("A/c2#7", True), ("A/c9#8", False)]


def test_searches_take_every_hundredth_row_as_query(spark, tmp_path):
    d = str(tmp_path)
    docs = [(100, "red apple pie"), (200, "blue whale"), (300, None), (1, "apple pie"), (2, "whale song"), (3, "pie"), (4, "stone")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, "A", "prose", x) for i, x in docs], "chunk_key bigint, accession_number string, kind string, text string").write.parquet(f"{d}/chunks.parquet")
    got = {n: {} for n in ("search_bm25_documents_rows", "search_bm25_filings_rows", "search_fused_filings_rows", "search_reranked_filings_rows")}
    for name, by in got.items():
        for r in entry.queries()[name](spark, d).orderBy("query_id", "rank").collect():
            by.setdefault(r.query_id, []).append(r.doc_id)
    assert all(x == {100: [1, 3], 200: [2]} for x in got.values())


def test_searches_of_one_corpus_join_by_keys(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "red apple"), (None, "revenue growth"), (3, "revenue growth and pie")], "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    df = entry.queries()["search_bm25_documents"](spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert {r.doc_id for r in df.where("query_id = 1").collect()} == {None, 3}


def _odd_corpus(spark, d):
    """Repeated, null and negative ids, null and empty texts, filings of one chunk, a document that repeats a term."""
    rng = np.random.default_rng(5)
    words = ["the", "of", "red", "blue", "pie", "whale", "stone", "Song", "tax", "lease", "note", "plan"]
    docs = [(i, "ABC"[i % 3], " ".join(rng.choice(words, rng.integers(1, 25)))) for i in range(-100, 330)]
    docs += [(None, "A", "red pie the"), (None, "D", "blue"), (7, "A", "whale whale"), (7, "A", "of red"), (200, "D", ""), (300, "D", None), (500, "E", "the the the plan"), (501, "E", "the plan")]
    spark.createDataFrame([(i, x) for i, _, x in docs], "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, None if g == "B" else g, "Prose", x) for i, g, x in docs if i not in (7, 200, 300)], "chunk_key bigint, accession_number string, kind string, text string").write.parquet(f"{d}/chunks.parquet")


@pytest.mark.parametrize("name", ["search_bm25_documents_rows", "search_bm25_filings_rows", "search_fused_filings_rows", "search_reranked_filings_rows"])
def test_searches_by_rows_agree_with_sql_and_exchange_no_pairs(spark, tmp_path, name):
    d = str(tmp_path)
    _odd_corpus(spark, d)
    df = entry.queries()[name](spark, d)
    assert not re.search(r"hashpartitioning\([^)]*query_id[^)]*doc_id", df._jdf.queryExecution().executedPlan().toString())
    con = duckdb.connect()
    for t in ("documents", "chunks"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert len(want) > 30 and sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("kind", ["bm25", "overlap", "fused"])
def test_groups_too_large_for_a_task_rank_alike(spark, tmp_path, kind):
    d = str(tmp_path)
    _odd_corpus(spark, d)
    corpus = domain_queries._chunk_corpus(spark, d)
    assert len(blocks.large_groups(corpus, 100)) == 3
    whole, parts = (sorted(map(tuple, domain_queries._rows_ranked(kind, corpus, 3, most).collect())) for most in (10**6, 100))
    assert whole == parts


def test_precision_joins_by_keys(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "revenue growth"), (2, "growth of revenue"), (3, "growth and pie"), (4, None)], "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    df = entry.queries()["search_precision"](spark, d)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    assert tuple(df.first())[:2] == (3, 2)


def test_precision_judges_hits_only_and_multiplies_nothing(spark, tmp_path):
    d = str(tmp_path)
    words = "revenue growth and gross profit litigation complaint pie of".split()
    docs = [(i, " ".join(words[(i * j) % 9] for j in range(1, 2 + i % 7))) for i in range(1, 60)]
    docs += [(None, "revenue growth gross profit"), (100, "litigation Complaint lease obligations"), (101, ""), (102, None), (103, "inventory turns export")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    df = entry.queries()["search_precision"](spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert not re.search(r"hashpartitioning\(query_id#\d+, doc_id", plan)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["search_precision"]).fetchone()
    assert 0 < want[1] < want[0] and tuple(df.first()) == want
    spark.createDataFrame([(1, "pie")], "doc_id bigint, text string").write.parquet(f"{d}/none/documents.parquet")
    assert tuple(entry.queries()["search_precision"](spark, f"{d}/none").first()) == (0, 0, None)
