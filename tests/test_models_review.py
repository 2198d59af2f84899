import pytest
from pyspark.errors import PySparkException

from ledgerline.operators import models, records, retrieval


def fake_encoder():
    return lambda texts: [[float(len(t)), float(t.count("a")) + 1.0] for t in texts]


def fake_pairs():
    return lambda pairs: [float(len(set(q) & set(t))) for q, t in pairs]


def test_injected_models(spark):
    t = spark.createDataFrame([(1, "aaaa"), (2, "bb"), (3, None)], "id bigint, text string")
    vecs = {r.id: r.vec for r in models.encode(t, fake_encoder, "q:").collect()}
    assert vecs == {1: [6.0, 5.0], 2: [4.0, 1.0], 3: [2.0, 1.0]}
    assert retrieval.nearest_vectors(models.encode(t, fake_encoder).where("id = 2"), models.encode(t, fake_encoder), 1).first().doc_id == 1
    hits = spark.createDataFrame([(1, 10, 0, "abc", "xyz"), (1, 11, 1, "abc", "cab"), (1, 12, 2, "abc", None), (1, 13, 60, "abc", "abc")], "query_id int, doc_id bigint, rank int, query string, text string")
    assert [(r.doc_id, r["rank"]) for r in models.rerank(hits, fake_pairs, 2).orderBy("rank").collect()] == [(11, 0), (10, 1)]


def test_stacks_are_told_apart():
    s = models.Stack("lexical", "tfidf", "overlap")
    s.require("lexical|tfidf|overlap")
    for bad in (lambda: s.require("semantic|m|r"), lambda: models.Stack("other", "", "")):
        with pytest.raises(ValueError):
            bad()


def test_review_tables(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("a", 5), ("b", 6)], "k string, w int")
    assert sorted((r.v, r.w) for r in records.required_join(left, right, ["k"], "label").collect()) == [(1, 5), (2, 6)]
    for bad in (right.where("k = 'a'"), right.unionByName(right)):
        with pytest.raises(PySparkException):
            records.required_join(left, bad, ["k"], "label").collect()
    labels = spark.createDataFrame([("x", "q1", "c1", True), ("x", "q1", "c2", None), ("x", "q2", "c1", False)], "accession_number string, query_id string, chunk_id string, relevant boolean")
    assert tuple(records.review_progress(labels).first()) == ("x", 3, 2, 2, 1)
    cases = spark.createDataFrame([(c, q) for c in range(5) for q in range(c * 6, c * 6 + 6)], "company int, query_id int")
    assert tuple(records.size_gate(cases).first()) == (5, 30, True, True)
    assert tuple(records.size_gate(cases.unionByName(cases.limit(1))).first()) == (5, 30, False, True)
