from datetime import date

import pytest

from ledgerline.operators import filing_run, narrative, records, retrieval
from ledgerline.sources import filings_io as io

EVENT = "accession_number string, company bigint, form string, filing_date date, report_date date"
FACT = "company bigint, concept string, fiscal_year int, fiscal_period string, val double, period_end_date date, filed_date date, accession_number string, priority int, fact_id bigint"
MARCH, MAY = date(2024, 3, 31), date(2024, 5, 1)


def fact(i, concept="revenue", year=2024, period="Q1", val=100.0, end=MARCH, filed=MAY, acc="a", company=1, priority=1):
    return (company, concept, year, period, val, end, filed, acc, priority, i)


def run(spark, events, rows):
    held = filing_run.with_year_end_debt(spark.createDataFrame(rows, FACT))
    periods = filing_run.filing_periods(spark.createDataFrame(events, EVENT), held)
    return periods, filing_run.filing_figures(periods, held)


def test_a_filing_needs_exactly_one_period(spark):
    events = [("a", 1, "10-Q", MAY, MARCH), ("none", 1, "10-Q", MAY, MARCH), ("two", 2, "10-Q", MAY, MARCH), ("k", 3, "10-K/A", MAY, MARCH), ("e", 1, "8-K", MAY, None), ("late", 4, "10-Q", MAY, MARCH)]
    rows = [fact(1), fact(2, company=2, acc="two"), fact(3, company=2, acc="two", year=2023), fact(4, company=3, acc="k", period="Q4"), fact(5, company=3, acc="k", period="FY"), fact(6, company=4, acc="late", filed=date(2024, 5, 2))]
    got = {r.accession_number: (r.fiscal_year, r.fiscal_period, r.error is None) for r in run(spark, events, rows)[0].collect()}
    assert got == {"a": (2024, "Q1", True), "none": (None, None, False), "two": (None, None, False), "k": (2024, "FY", True), "e": (None, None, True), "late": (None, None, False)}


def test_figures_are_those_known_and_the_filings_own(spark):
    rows = [
        fact(1), fact(2, "net_income", val=9.0, acc="older"),  # a figure of the same period out of another filing
        fact(3, year=2023, val=80.0, acc="x", filed=date(2023, 5, 1)), fact(4, year=2023, val=70.0, acc="y", filed=date(2024, 6, 1)),  # restated later
        fact(5, year=2023, period="Q4", val=50.0, acc="z", filed=date(2024, 2, 1)), fact(6, year=2023, val=1.0, acc="w", filed=None),
    ]
    periods, figures = run(spark, [("a", 1, "10-Q", MAY, MARCH)], rows)
    compared = {(r.concept, r.comparison): (r.prior_value, r.percent_change) for r in filing_run.filing_comparisons(figures).collect()}
    assert compared == {("revenue", "YoY"): (80.0, 25.0), ("revenue", "QoQ"): (50.0, 100.0)}
    flags = filing_run.metric_flags(filing_run.filing_comparisons(figures))
    assert sorted(r.detail for r in flags.collect()) == ["revenue changed +100.00% (QoQ)", "revenue changed +25.00% (YoY)"]
    r = filing_run.run_records(periods, figures, flags).first()
    assert (r.coverage_pct, r.notable, r.summary[0]) == (20.0, 2, "2 item(s) flagged for review this period.") and "net_income" in r.missing


def test_year_end_debt_and_margins(spark):
    rows = [fact(1, period="FY"), fact(2, "total_debt", period="Q4", val=7.0), fact(3, "net_income", period="FY", val=20.0)]
    rows += [fact(4, period="FY", year=2023, acc="o", filed=date(2023, 5, 1)), fact(5, "net_income", period="FY", year=2023, val=10.0, acc="o", filed=date(2023, 5, 1))]
    _, figures = run(spark, [("a", 1, "10-K", MAY, MARCH)], rows)
    assert {(r.role, r.concept): r.val for r in figures.collect()}["current", "total_debt"] == 7.0
    assert [r.detail for r in filing_run.margin_flags(figures).collect()] == ["Margin moved +10.00pp: 10.00% -> 20.00%"]


def test_hybrid_ranks_every_document_and_keeps_dense_order_on_ties(spark):
    docs = spark.createDataFrame([("g", 1, "alpha beta"), ("g", 2, "gamma"), ("g", 3, None), ("g", 4, "beta beta delta"), ("h", 5, "zeta")], "grp string, doc_id bigint, text string")
    q = spark.createDataFrame([(1, "beta delta"), (2, "")], "query_id int, query string")
    got = retrieval.hybrid(docs, q, 10)
    assert {(r.query_id, r.grp): r for r in got.groupBy("query_id", "grp").count().collect()}.keys() == {(1, "g"), (1, "h"), (2, "g"), (2, "h")}
    first = [r.doc_id for r in got.where("query_id = 1 and grp = 'g'").orderBy("rank").collect()]
    assert first[:2] == [4, 1] and sorted(first) == [1, 2, 3, 4]
    assert [r.doc_id for r in got.where("query_id = 2 and grp = 'g'").orderBy("rank").collect()] == [1, 2, 3, 4]
    top = retrieval.rerank_overlap(got, docs, q, 2)
    assert [(r.doc_id, r.score) for r in top.where("query_id = 1 and grp = 'g'").orderBy("rank").collect()] == [(4, 1.0), (1, 0.5)]
    assert [(r.doc_id, r.score) for r in top.where("query_id = 2 and grp = 'g'").orderBy("rank").collect()] == [(1, None), (2, None)]
    assert [(r.doc_id, r.place) for r in retrieval.first_seen(top.where("grp = 'g'")).orderBy("place").collect()] == [(4, 0), (1, 1), (2, 2)]


def test_common_length_bounds_the_matching_blocks():
    import difflib
    import random

    rnd = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 40))) for _ in "ab")
        masks = {}
        for k, c in enumerate(a):
            masks[c] = masks.get(c, 0) | (1 << k)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        n = narrative.common_length(a, b, masks)
        assert n == table[-1][-1] and n >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_narrative_flags_by_rule_rank_and_cap(spark):
    shape = "accession_number string, passage_id bigint, chunk_id string, section string, text string, topics array<string>, status string, similarity double, prior_chunk_id string, diff_summary string, prior_accession string, prior_date date, relevance int"
    row = lambda i, status, sim=None, rel=None, topics=("LITIGATION",): ("f", i, f"prose-{i}", "S", "t" * 500, list(topics), status, sim, "p" if status == "revised" else None, "d" if status == "revised" else None, "b", MARCH, rel)
    rows = [row(1, "unchanged", 1.0), row(2, "revised", 0.6), row(3, "new", 0.1), row(4, "new", 0.2, 5), row(5, "odd"), row(6, "new", 0.0, None, ())]
    got = narrative.narrative_flags(spark.createDataFrame(rows, shape), 3).orderBy("rank").collect()
    assert [(r.passage_id, r.rule_id, r.severity) for r in got] == [(4, "NEW_LITIGATION_LANGUAGE", "notable"), (3, "NEW_LITIGATION_LANGUAGE", "notable"), (2, "REVISED_LITIGATION_LANGUAGE", "notable")]
    assert got[2].rule_description == "Passage is a reworded version of prior-filing language (similarity 0.60, compared against b filed 2024-03-31)"
    assert got[2].citation == "S (prose-2); closest prior passage p" and got[2].detail == "t" * 400 + "\n\nChange: d"


def test_revised_passages_quote_what_is_new(spark):
    old = "The first of the old sentences stays as it is. The second of the old sentences stays as well."
    new = old + " " + " ".join(f"Sentence number {n} says a thing nobody ever said before." for n in ("one", "two"))
    p = spark.createDataFrame([(1, 7, "old", "prose-0", old), (2, 7, "new", "prose-1", new), (3, 7, "new", "prose-2", old)], "passage_id bigint, company bigint, accession_number string, chunk_id string, text string")
    pairs = spark.createDataFrame([("new", "old"), ("old", None)], "accession_number string, prior_accession string")
    got = {r.passage_id: r for r in narrative.passage_changes(p, pairs).collect()}
    assert (got[1].status, got[1].similarity) == ("unestablished", None) and (got[3].status, got[3].prior_chunk_id, got[3].diff_summary) == ("unchanged", "prose-0", None)
    assert got[2].status == "revised" and got[2].similarity == 0.5 and got[2].diff_summary.startswith('not in the prior filing: "sentence number one') and got[2].diff_summary.count('"') == 4


def test_report_memos_and_paths(spark, tmp_path):
    one = lambda n, d: spark.createDataFrame([(float(n), float(d))], "numerator double, denominator double")
    got = {r.metric: (r.value, r.passed) for r in records.evaluation_report(numeric_accuracy_pct=one(3, 4), coverage_pct=one(0, 0), latency_max_s=one(12, 1)).collect()}
    assert got == {"numeric_accuracy_pct": (75.0, False), "coverage_pct": (None, None), "latency_max_s": (12.0, True), "precision_pct": (None, None), "citation_support_pct": (None, None)}
    with pytest.raises(ValueError):
        records.evaluation_report(speed=one(1, 1))
    memos = lambda *rows: spark.createDataFrame(rows, "accession_number string, memo string")
    path = str(tmp_path / "memos")
    io.write_memos(memos(("0000000001-24-000001", "x"), ("0000000001-24-000002", "y")), path)
    io.write_memos(memos(("0000000001-24-000002", "z")), path)
    assert sorted((r.accession_number, r.value) for r in spark.read.text(path).collect()) == [("0000000001-24-000001", "x"), ("0000000001-24-000002", "z")]
    with pytest.raises(Exception, match="malformed accession"):
        io.write_memos(memos(("../up", "x")), path)
    assert io.below("/data/b", "x/../y.json") == "/data/b/y.json"
    for bad in ("../y", "/etc/x", "x/../../y"):
        with pytest.raises(ValueError):
            io.below("/data/b", bad)
