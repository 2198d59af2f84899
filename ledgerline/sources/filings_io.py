"""Scans and sinks of filing data: documents on disk, review sheets, keyed stores, an optional live fetch."""

from __future__ import annotations

import posixpath
import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.normalize import ACCESSION_DASHED, padded_cik
from ledgerline.operators.records import upsert
from ledgerline.session import path_exists

#: Seconds between the starts of two requests to the archive, over all its endpoints.
REQUEST_SPACING = 0.11


def whole_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload) of whole text files: companyfacts and submissions JSON, filing markup."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """(sector, pos, name, ticker, cik) of a watchlist file; ciks padded."""
    shape = "sector string, companies array<struct<name:string,ticker:string,cik:string>>"
    rows = spark.read.schema(shape).json(path, multiLine=True)
    return rows.select("sector", F.posexplode("companies").alias("pos", "c")).select("sector", "pos", "c.name", "c.ticker", padded_cik("c.cik").alias("cik"))


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A review CSV with every cell kept as the string it is; a byte order mark in the header is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records; those that do not parse are left out."""
    df = spark.read.schema(schema + ", _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=True)
    return df.where("_bad is null").drop("_bad")


def write_memos(memos: DataFrame, path: str) -> None:
    """Memos (accession_number, memo) as text, a folder for each accession; written again, a memo takes the place of the
    one before. An accession that is none fails the write."""
    ok = F.assert_true(F.col("accession_number").rlike(ACCESSION_DASHED), F.concat(F.lit("malformed accession number: "), F.coalesce("accession_number", F.lit("none"))))
    memos.where(ok.isNull()).select("accession_number", "memo").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("accession_number").text(path)


def below(root: str, relative: str) -> str:
    """The path of a file a benchmark names; one that leaves the root is an error."""
    base = posixpath.normpath(root)
    path = posixpath.normpath(posixpath.join(base, relative))
    if posixpath.isabs(relative) or (path != base and not path.startswith(base.rstrip("/") + "/")):
        raise ValueError(f"path leaves {root}: {relative}")
    return path


class KeyedStore:
    """A parquet table with one current row (or set of rows) per key. Saves append under a growing version, so a save
    that fails leaves the stored state as it was, and a repeated save of the same version is the same state."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str | None = None):
        self.spark, self.path, self.schema, self.key, self.version = spark, path, schema, key, version

    def _all(self) -> DataFrame:
        if not path_exists(self.spark, self.path):  # nothing saved yet; what is there but cannot be read is an error
            return self.spark.createDataFrame([], self.schema + ", _save bigint")
        return self.spark.read.schema(self.schema + ", _save bigint").parquet(self.path)

    def save(self, rows: DataFrame, save_no: int) -> None:
        """All rows of the keys in rows take the place of what was saved for them before."""
        rows.withColumn("_save", F.lit(save_no).cast("bigint")).write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        """Current rows. Rows of another format version are skipped."""
        rows = self._all()
        if self.version is not None:
            rows = rows.where(F.col("version") == self.version)
        last = F.max("_save").over(Window.partitionBy(self.key))
        return rows.withColumn("_last", last).where("_save = _last").drop("_save", "_last")

    def compact(self, to: str) -> "KeyedStore":
        """The current rows of all versions as a store of their own at another path."""
        rows = self._all()
        last = F.max("_save").over(Window.partitionBy(self.key))
        rows.withColumn("_last", last).where("_save = _last").drop("_last").write.parquet(to)
        return KeyedStore(self.spark, to, self.schema, self.key, self.version)

    def keys(self) -> DataFrame:
        return self._all().select(self.key).distinct()


class Fetcher:
    """Requests on the driver, spaced out over all endpoints by one lock. The transport is injected."""

    def __init__(self, get: Callable[[str, dict], bytes], user_agent: str, spacing: float = REQUEST_SPACING, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if "@" not in user_agent:
            raise ValueError("the user agent must carry a contact address")
        self.get, self.headers, self.spacing, self.clock, self.sleep = get, {"User-Agent": user_agent}, spacing, clock, sleep
        self.lock, self.next = threading.Lock(), 0.0

    def fetch(self, url: str) -> bytes:
        with self.lock:
            wait = self.next - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.next = self.clock() + self.spacing
        return self.get(url, self.headers)

    def document(self, cik: str, accession: str, name: str) -> bytes:
        if not re.match(ACCESSION_DASHED, accession):
            raise ValueError("malformed accession number")
        if "/" in name or "\\" in name or ".." in name or not name:
            raise ValueError("malformed document name")
        return self.fetch(f"https://www.sec.gov/Archives/edgar/data/{int(cik)}/{accession.replace('-', '')}/{name}")


__all__ = ["Fetcher", "KeyedStore", "below", "json_records", "review_sheet", "upsert", "watchlist", "whole_documents", "write_memos", "write_sheet"]
