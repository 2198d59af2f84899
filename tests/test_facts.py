import json
from datetime import date

from pyspark.sql import functions as F

from ledgerline.operators import compare, facts


def obs(start, end, val, fy, fp, form="10-Q", filed=None, accn="a1"):
    return {"start": start, "end": end, "val": val, "fy": fy, "fp": fp, "form": form, "filed": filed, "accn": accn}


def document(revenue, income=(), debt=()):
    tag = lambda rows: {"label": "x", "units": {"USD": list(rows)}}
    return json.dumps({"cik": 77, "entityName": "X", "facts": {"us-gaap": {"Revenues": tag(revenue), "NetIncomeLoss": tag(income), "DebtLongtermAndShorttermCombinedAmount": tag(debt)}}})


REVENUE = [
    obs("2024-01-01", "2024-03-31", 100, 2024, "Q1", filed="2024-05-01", accn="q1"),
    obs("2024-04-01", "2024-06-30", 110, 2024, "Q2", filed="2024-08-01", accn="q2"),
    obs("2024-01-01", "2024-06-30", 210, 2024, "Q2", filed="2024-08-01", accn="q2"),
    obs("2024-07-01", "2024-09-30", 120, 2024, "Q3", filed="2024-11-01", accn="q3"),
    obs("2024-01-01", "2024-12-31", 470, 2024, "FY", "10-K", "2025-02-15", "k"),
    obs("2023-01-01", "2023-03-31", 90, 2024, "Q1", filed="2024-05-01", accn="q1"),
]


def parsed(spark, text, as_of=None):
    df = spark.createDataFrame([(text,)], "payload string")
    rows = facts.parse_facts(df, as_of=None if as_of is None else F.lit(as_of).cast("date")).collect()
    return {(r.concept, r.fiscal_year, r.fiscal_period): r.val for r in rows}


def test_year_to_date_vanishes_and_the_fourth_quarter_is_derived(spark):
    got = parsed(spark, document(REVENUE))
    assert got == {("revenue", 2024, "Q1"): 100, ("revenue", 2024, "Q2"): 110, ("revenue", 2024, "Q3"): 120, ("revenue", 2024, "FY"): 470, ("revenue", 2024, "Q4"): 140, ("revenue", 2023, "Q1"): 90}


def test_as_of_hides_later_revisions(spark):
    rows = [REVENUE[0], obs("2024-01-01", "2024-03-31", 95, 2024, "Q1", "10-Q/A", "2024-09-01", "q1a")]
    assert parsed(spark, document(rows), "2024-06-01") == {("revenue", 2024, "Q1"): 100}
    assert parsed(spark, document(rows)) == {("revenue", 2024, "Q1"): 95}
    assert parsed(spark, document([REVENUE[0] | {"filed": None}]), "2024-06-01") == {}


def test_bad_rows_and_stocks(spark):
    rows = [obs("2024-01-01", "2024-03-31", v, 2024, "Q1", form, "2024-05-01", "q1") for v, form in (("NaN", "10-Q"), (5, "8-K"))]
    debt = [obs(None, "2024-03-31", 7, 2024, "Q1", "10-Q", "2024-05-01", "q1"), obs("2024-01-01", "2024-03-31", 8, 2024, "Q1", "10-Q", "2024-05-01", "q1")]
    assert parsed(spark, document(rows, debt=debt)) == {("total_debt", 2024, "Q1"): 7}
    assert parsed(spark, "{broken") == {} and parsed(spark, None) == {}


def frame(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "company bigint, concept string, fiscal_year int, fiscal_period string, val double")


def test_comparisons(spark):
    f = frame(spark, [("revenue", 2023, "Q4", 100.0), ("revenue", 2024, "Q1", 150.0), ("revenue", 2024, "Q3", 9.0), ("revenue", 2024, "Q4", 0.0), ("revenue", 2025, "Q4", 5.0), ("net_income", 2024, "Q1", 15.0)])
    yoy = {(r.fiscal_year, r.fiscal_period): r.percent_change for r in compare.year_over_year(f).collect()}
    assert yoy == {(2024, "Q4"): -100.0, (2025, "Q4"): None}
    qoq = {(r.fiscal_year, r.fiscal_period): r.percent_change for r in compare.quarter_over_quarter(f).collect()}
    assert qoq == {(2024, "Q1"): 50.0, (2024, "Q4"): -100.0}
    assert [(r.concept, r.margin_pct) for r in compare.margins(f, ["net_income"]).collect()] == [("net_income", 10.0)]


def test_nearest_rows_edges(spark):
    d = lambda m, x: date(2024, m, x)
    rows = spark.createDataFrame([(1, 5, "Q", d(1, 1)), (2, 5, "Q", d(3, 1)), (3, 5, "FY", d(2, 1)), (4, 5, "Q", d(3, 1))], "row_id bigint, entity bigint, class string, day date")
    asks = spark.createDataFrame([(1, 5, "Q", d(1, 31)), (2, 5, "Q", d(4, 15)), (3, 5, "Q", d(4, 16)), (4, 6, "Q", d(1, 1)), (5, 5, "FY", d(1, 2))], "ask_id bigint, entity bigint, class string, day date")
    near = {r.ask_id: (r.row_id, r.offset_days) for r in compare.nearest_rows(asks, rows).collect()}
    assert near == {1: (1, -30), 2: (2, -45), 5: (3, 30)}
    far = {r.ask_id: (r.row_id, r.offset_days) for r in compare.nearest_rows(asks, rows, None).collect()}
    assert far == {1: (1, -30), 2: (2, -45), 3: (2, -46), 5: (3, 30)}
    got = {r.ask_id: r.reason for r in compare.align_peers(asks, rows).collect()}
    assert got[1] is None and got[3] == "no period within the window" and got[4] == "no period of this duration"


def test_restatements_look_at_the_first_tag_present(spark):
    shape = "company bigint, concept string, tag string, period_end_date date, duration string, accession_number string, val double, filed_date date, fact_id bigint"
    row = lambda i, tag, acc, val, dur="Q", co=1: (co, "revenue", tag, date(2024, 3, 31), dur, acc, val, date(2024, 5, i), i)
    tags = spark.createDataFrame([("revenue", "T", 1), ("revenue", "U", 2)], "concept string, tag string, priority int")
    got = lambda rows: [(r["values"], r.low, r.high, r.accessions) for r in facts.restatements(spark.createDataFrame(rows, shape), tags).collect()]
    assert got([row(1, "T", "a", 1.0), row(2, "T", "a", 2.0), row(3, "T", "b", 3.0)]) == [(2, 2.0, 3.0, ["a", "b"])]
    assert got([row(1, "T", "a", float("nan")), row(2, "U", "a", 2.0), row(3, "U", "b", 3.0)]) == []  # T is there, if without a figure
    assert got([row(2, "U", "a", 2.0), row(3, "U", "b", 3.0, "FY")]) == [] and got([row(1, "T", None, 1.0), row(2, "T", "b", 2.0)]) == []


def test_coverage_keeps_companies_without_facts(spark):
    targets, companies = spark.createDataFrame([("revenue",), ("net_income",)], "concept string"), spark.createDataFrame([(1,), (2,), (2,)], "company bigint")
    c = facts.coverage(frame(spark, [("revenue", 2024, "Q1", 1.0)]), targets, companies).orderBy("company").collect()
    assert [(r.total, r.resolved, r.missing, r.rate) for r in c] == [(2, 1, "net_income", 50.0), (2, 0, "net_income,revenue", 0.0)]
