import importlib
import json
import re
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from ledgerline.operators import filings
from ledgerline.session import materialize, shared_root
from ledgerline.streaming import poll

ROOT = Path(__file__).resolve().parent.parent


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, accession_number string, form string")


def test_failed_filings_stay_open(spark, tmp_path):
    src, done, out, state = (str(tmp_path / x) for x in ("in", "done", "out", "state"))
    events(spark, [(1, "a", "10-K"), (2, "a", "10-K"), (3, "bad", "8-K"), (4, None, "8-K")]).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    process = lambda new: (new.where("accession_number <> 'bad'"), new)
    poll.poll_filings(stream(), process, done, out, state)
    assert [r[0] for r in poll.read_completed(spark, done).collect()] == ["a"]
    events(spark, [(5, "a", "10-K"), (6, "b", "10-Q"), (7, "bad", "8-K")]).write.mode("append").parquet(src)
    poll.poll_filings(stream(), lambda new: (new, new), done, out, state)
    assert sorted(r[0] for r in poll.read_completed(spark, done).collect()) == ["a", "b", "bad"]
    got = spark.read.option("basePath", out).parquet(out).collect()
    assert sorted((r.accession_number, r.event_id) for r in got) == [("a", 1), ("b", 6), ("bad", 7)]


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(200).select(F.timestamp_seconds(F.col("id") * 5000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("k")).write.parquet(path)
    s = poll.closed_windows(spark, path, "ts", "1 day", "k")
    batch = spark.read.parquet(path).groupBy(F.window("ts", "1 day").alias("w"), "k").count()
    assert {(r.w.start, r.k, r.n) for r in s.collect()} == {(r.w.start, r.k, r["count"]) for r in batch.collect()}


def test_submissions_and_new_filings(spark):
    doc = {"cik": "70", "name": "", "entityName": "E", "filings": {"recent": {"accessionNumber": ["a", "b", "c", "d", None], "form": ["10-Q", "8-K", "4", "10-K", "10-K"], "filingDate": ["2024-01-02", "2024-02-30", "2024-01-01", "2024-03-01", "2024-03-01"], "reportDate": ["", "2024-01-01"], "primaryDocument": ["x.htm"]}}}
    df = spark.createDataFrame([(json.dumps(doc),), ("{oops",), (None,)], "payload string")
    got = filings.recent_filings(df).orderBy("pos").collect()
    assert [(r.company_cik, r.company_name, r.accession_number, r.primary_document, r.report_date) for r in got] == [("0000000070", "E", "a", "x.htm", None), ("0000000070", "E", "d", "", None)]
    assert [r.accession_number for r in filings.unseen(filings.recent_filings(df), spark.createDataFrame([("a",)], "accession_number string")).collect()] == ["d"]


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and shared_root(spark).split(":")[-1].strip("/").split("/")[0] in df.inputFiles()[0]


def test_entry_registers_what_it_checks():
    e = importlib.import_module("__spark_entry__")
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 40
    if (ROOT / "ledgerline/llm/queries.py").exists():
        assert {n for n in q if re.match(r"p\d+_", n)} >= {f"p{i}_found" for i in (1, 2, 3, 4, 5, 6, 8, 9)} | {"p7_ids"}


def test_core_does_not_import_llm():
    for p in (ROOT / "ledgerline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "ledgerline.llm" not in p.read_text(), p


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace

    from ledgerline import session

    for master, local in (("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://h:7077", False)):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(master=master))
        if local:
            assert session._local_root(fake).startswith("file:")
        else:
            with pytest.raises(RuntimeError):
                session._local_root(fake)


def test_an_unreadable_store_is_no_empty_one(spark, tmp_path):
    assert poll.read_completed(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|cannot|failed"):
        poll.read_completed(spark, str(tmp_path / "bad")).collect()


def test_small_tables_are_dealt_out_and_others_left(spark):
    from ledgerline.session import spread

    few, cores = spark.range(100).coalesce(1), spark.sparkContext.defaultParallelism
    assert spread(few).rdd.getNumPartitions() == cores and sorted(r.id for r in spread(few).collect()) == list(range(100))
    many = spark.range(0, 100, 1, cores)
    assert spread(many) is many
    large = spark.range(1 << 30).coalesce(1)
    assert spread(large) is large


def test_working_tables_lie_in_the_folder_of_their_application(spark):
    from ledgerline.session import drop_path, path_exists, shared_path

    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a != b and f"/ledgerline/{spark.sparkContext.applicationId}/" in a and not path_exists(spark, a)
    spark.range(3).write.parquet(a)
    assert path_exists(spark, a)
    drop_path(spark, a, b)
    assert not path_exists(spark, a)
