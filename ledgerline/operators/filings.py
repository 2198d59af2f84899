"""Filing events: parallel arrays to rows, form classes, new filings, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.normalize import json_list, padded_cik
from ledgerline.operators.facts import iso_date

# Forms that are watched, and the periodic ones among them.
EVENT_FORMS = ("10-K", "10-Q", "8-K", "10-K/A", "10-Q/A", "8-K/A")
PERIODIC = ("10-K", "10-Q")
_LISTS = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")
_RECENT = "struct<" + ",".join(f"{c}:string" for c in _LISTS) + ">"
SUBMISSIONS = f"struct<cik:string,name:string,entityName:string,filings:struct<recent:{_RECENT}>>"


def form_class(form: Column) -> Column:
    """'periodic' for annual and quarterly reports and their amendments, else 'event'."""
    return F.when(F.trim(F.replace(F.upper(form), F.lit("/A"), F.lit(""))).isin(*PERIODIC), "periodic").otherwise("event")


def recent_filings(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Submissions documents to filing events of the watched forms.

    The accession list sets the length; shorter lists give null or '', rows with a bad date or no form are left out. A bare
    value in place of a list is a list of one.
    """
    d = raw.select(F.from_json(payload, SUBMISSIONS).alias("d")).where("d.filings.recent.accessionNumber is not null")
    r = d.select(F.col("d.cik").alias("cik"), F.coalesce(F.nullif(F.col("d.name"), F.lit("")), F.nullif(F.col("d.entityName"), F.lit("")), F.lit("")).alias("company_name"), F.struct(*[json_list(f"d.filings.recent.{c}", "string").alias(c) for c in _LISTS]).alias("r"))
    at = lambda c: F.get(F.col(f"r.{c}"), F.col("i"))
    rows = r.select("*", F.posexplode("r.accessionNumber").alias("i", "accession_number"))
    return rows.select(
        padded_cik("cik").alias("company_cik"), "company_name", "accession_number", at("form").alias("form"), iso_date(at("filingDate")).alias("filing_date"),
        iso_date(at("reportDate")).alias("report_date"), F.coalesce(at("primaryDocument"), F.lit("")).alias("primary_document"), F.col("i").alias("pos"),
    ).where(F.col("form").isin(*EVENT_FORMS) & F.col("filing_date").isNotNull() & F.col("accession_number").isNotNull())


def unseen(events: DataFrame, seen: DataFrame, since: Column | None = None) -> DataFrame:
    """Events whose accession is not in seen and, with since, not filed before it. Null accessions are no events."""
    e = events.where(F.col("accession_number").isNotNull())
    e = e if since is None else e.where(F.col("filing_date") >= since)
    return e.join(seen.select("accession_number").distinct(), "accession_number", "left_anti")


def newest_periodic(events: DataFrame, depth: int, before: Column | None = None) -> DataFrame:
    """Per company the newest periodic filings (no amendments), strictly before a date if given."""
    e = events.where(F.upper(F.trim("form")).isin(*PERIODIC) & F.col("filing_date").isNotNull())
    e = e if before is None else e.where(F.col("filing_date") < before)
    w = Window.partitionBy("company").orderBy(F.col("filing_date").desc(), F.col("accession_number").desc())
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def prior_filing(filings: DataFrame) -> DataFrame:
    """Each filing (company, class, filing_date, accession_number) with its baseline: the latest filing of the same
    company and class filed on an earlier day, the greatest accession on a tie.

    One ordered window over days instead of a range join: the range frame ends a day before the row's own.
    """
    filings = filings.distinct()
    day = F.datediff("filing_date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("company", "class").orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct("filing_date", "accession_number")).over(w)
    return filings.withColumn("_b", best).select("*", F.col("_b.accession_number").alias("prior_accession"), F.col("_b.filing_date").alias("prior_date")).drop("_b")


def without_baseline(companies: DataFrame, stored: DataFrame) -> DataFrame:
    return companies.join(stored.select("company").distinct(), "company", "left_anti")
