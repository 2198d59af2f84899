import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import report
from ledgerline.sources import filings_io as io


def test_documents_watchlist_and_sheets(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"sector": "S", "companies": [{"name": "A", "ticker": "T", "cik": "12"}, {"name": "B", "ticker": "U", "cik": 13}]}))
    assert [(r.pos, r.cik) for r in io.watchlist(spark, str(tmp_path / "w.json")).orderBy("pos").collect()] == [(0, "0000000012"), (1, "0000000013")]
    assert json.loads(io.whole_documents(spark, str(tmp_path / "w.json")).first().payload)["sector"] == "S"
    (tmp_path / "r.csv").write_bytes("﻿accession,value\n0001,\"1,5\nx\"\n".encode())
    assert [tuple(r) for r in io.review_sheet(spark, str(tmp_path / "r.csv")).collect()] == [("0001", "1,5\nx")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"k": "a"}')
    (tmp_path / "j/b.json").write_text("{broken")
    assert [r.k for r in io.json_records(spark, str(tmp_path / "j"), "k string").collect()] == ["a"]


def test_keyed_store_keeps_the_last_save(spark, tmp_path):
    s = io.KeyedStore(spark, str(tmp_path / "s"), "k string, v int, version string", "k", "v1")
    assert s.load().count() == 0
    make = lambda *rows: spark.createDataFrame(rows, "k string, v int, version string")
    s.save(make(("a", 1, "v1"), ("a", 2, "v1"), ("b", 3, "v1")), 1)
    s.save(make(("a", 9, "v1"), ("c", 4, "v0")), 2)
    assert sorted((r.k, r.v) for r in s.load().collect()) == [("a", 9), ("b", 3)]
    assert sorted(r.k for r in s.keys().collect()) == ["a", "b", "c"]


def test_fetcher_spaces_requests_and_guards_names():
    now, slept, urls = [0.0], [], []
    f = io.Fetcher(lambda u, h: urls.append(u) or b"x", "me me@example.com", clock=lambda: now[0], sleep=slept.append)
    f.fetch("a"), f.fetch("b")
    assert slept == [pytest.approx(io.REQUEST_SPACING)]
    assert f.document("0000000012", "0000000001-24-000001", "d.htm") == b"x" and urls[-1].endswith("/12/000000000124000001/d.htm")
    for acc, name in (("1", "d.htm"), ("0000000001-24-000001", "../d")):
        with pytest.raises(ValueError):
            f.document("12", acc, name)
    with pytest.raises(ValueError):
        io.Fetcher(lambda u, h: b"", "nobody")


def test_flags_rows_and_memo(spark):
    c = spark.createDataFrame([(1, "revenue", 2024, "Q1", 150.0, 100.0, 50.0), (1, "net_income", 2024, "Q1", -5.0, 0.0, None)], "company bigint, concept string, fiscal_year int, fiscal_period string, current_value double, prior_value double, percent_change double")
    f = report.threshold_flags(c, F.col("percent_change"), 20.0, "METRIC_CHANGE_THRESHOLD", F.col("concept"), F.lit("src"), ["company"])
    assert [(r.rule_id, r.detail) for r in f.collect()] == [("METRIC_CHANGE_THRESHOLD", "revenue changed by +50.00")]
    facts = spark.createDataFrame([(1, "revenue", 2024, "Q1", 150.0), (1, "gross_profit", 2024, "Q1", 7.0)], "company bigint, concept string, fiscal_year int, fiscal_period string, val double")
    m = report.metric_rows(facts, c)
    assert {r.concept: r.note for r in m.collect()} == {"revenue": None, "net_income": None, "gross_profit": "No comparable prior figure"}
    memo = report.memo_markdown(m, f, "company").first().memo
    assert "| revenue | 2024 Q1 | $150 | $100 | +50.00% |" in memo and "-$5" in memo and "- METRIC_CHANGE_THRESHOLD: revenue changed by +50.00 [src]" in memo
    assert [(r.notable, r.lines) for r in report.alert_lines(f, "company").collect()] == [(1, ["METRIC_CHANGE_THRESHOLD: revenue changed by +50.00"])]
    p = spark.createDataFrame([("html_table_fallback", "t"), ("xbrl", "derived:x"), ("xbrl", "t"), (None, None)], "s string, t string").select(report.provenance(F.col("s"), F.col("t")).alias("p"))
    assert [r.p for r in p.collect()] == ["html_table_fallback", "derived", "xbrl", "unknown"]
