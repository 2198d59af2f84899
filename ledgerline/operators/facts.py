"""Normalized financial facts: nested observations to typed facts, revisions, derived quarters, coverage, restatements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.normalize import bare_tag, company_number, dashed_accession, label, padded_cik, usable

# Tags that report each concept, best first; long-term debt by itself leaves out what is due within a year.
TAG_PRIORITY = [
    ("revenue", "RevenueFromContractWithCustomerExcludingAssessedTax", 1),
    ("revenue", "Revenues", 2),
    ("revenue", "SalesRevenueNet", 3),
    ("revenue", "RevenueFromContractWithCustomerIncludingAssessedTax", 4),
    ("net_income", "NetIncomeLoss", 1),
    ("net_income", "ProfitLoss", 2),
    ("gross_profit", "GrossProfit", 1),
    ("total_debt", "DebtLongtermAndShorttermCombinedAmount", 1),
    ("operating_income", "OperatingIncomeLoss", 1),
]
CONCEPTS = ("revenue", "net_income", "gross_profit", "total_debt", "operating_income")
PERIODIC_FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A")
STOCK_CONCEPTS = ("total_debt",)

OBSERVATION = "array<struct<start:string,end:string,val:string,fy:string,fp:string,form:string,filed:string,accn:string>>"
COMPANYFACTS = f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<label:string,units:map<string,{OBSERVATION}>>>>>"


def tag_priority(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAG_PRIORITY, "concept string, tag string, priority int")


def iso_date(c: Column) -> Column:
    """Strict yyyy-mm-dd to date, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def observations(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Flat observations of nested companyfacts documents: company, ns, tag, unit, pos and the observation's fields.

    Documents that do not parse give no row. tag_pos and pos keep the input order, by which ties resolve.
    """
    doc = raw.select(F.from_json(payload, COMPANYFACTS).alias("d")).where("d.facts is not null")
    tags = doc.select(F.expr("try_cast(d.cik as bigint)").alias("company"), F.col("d.entityName").alias("company_name"), F.explode("d.facts").alias("ns", "tags"))
    units = tags.select("company", "company_name", "ns", F.posexplode("tags").alias("tag_pos", "tag", "body"))
    entries = units.select("company", "company_name", "ns", "tag_pos", "tag", F.explode("body.units").alias("unit", "entries"))
    return entries.select("company", "company_name", "ns", "tag_pos", "tag", "unit", F.posexplode("entries").alias("pos", "o")).select(
        "company", "company_name", "ns", "tag_pos", "tag", "unit", "pos", F.col("o.start").alias("start"), iso_date(F.col("o.end")).alias("end"), F.expr("try_cast(o.val as double)").alias("val"),
        F.expr("try_cast(o.fy as int)").alias("fy"), F.col("o.fp").alias("fp"), F.col("o.form").alias("form"), iso_date(F.col("o.filed")).alias("filed"), F.col("o.accn").alias("accn"),
    )


def known_by(obs: DataFrame, as_of: Column | None, filed: str = "filed") -> DataFrame:
    """Only what had been filed by as_of; without it everything stays, undated rows included."""
    return obs if as_of is None else obs.where(F.col(filed) <= as_of)


def reporting_contexts(obs: DataFrame) -> DataFrame:
    """Per accession the latest period end it reports, with its fiscal year and period; the first row wins a tie."""
    ok = obs.where(F.col("form").isin(*PERIODIC_FORMS) & F.col("fp").isin("Q1", "Q2", "Q3", "Q4", "FY") & F.col("end").isNotNull() & F.col("fy").isNotNull() & F.col("accn").isNotNull())
    first = F.struct("end", (-F.col("tag_pos")).alias("t"), (-F.col("pos")).alias("p"))
    return ok.groupBy("company", "accn").agg(F.max_by(F.struct("end", "fy", "fp"), first).alias("context"))


def fiscal_period(end: Column, start: Column, report_end: Column, report_fy: Column, report_fp: Column) -> Column:
    """struct(fy, fp) of an observation from its filing's context; null where it fits no discrete quarter or year."""
    quarter = F.when(report_fp == "FY", 4).otherwise(F.substring(report_fp, 2, 1).try_cast("int"))
    back = F.datediff(report_end, end)
    quarters = F.round(back / F.lit(91.3125)).cast("int")
    on_calendar = (back >= 0) & (F.abs(back - quarters * F.lit(91.3125)) <= 25)
    index = report_fy * 4 + quarter - 1 - quarters
    fy, q = F.floor(index / 4).cast("int"), F.pmod(index, F.lit(4))
    span = F.datediff(end, iso_date(start))
    named = F.concat(F.lit("Q"), (q + 1).cast("string"))
    has_start = F.coalesce(start, F.lit("")) != ""
    fp = F.when(has_start & span.between(330, 380), F.when(q == 3, "FY")).when(has_start & span.between(75, 105), named).when(~has_start, named)
    return F.when(on_calendar & fp.isNotNull(), F.struct(fy.alias("fy"), fp.alias("fp")))


def latest_revision(rows: DataFrame, keys: list[str], filed: str, *ties: Column) -> DataFrame:
    """The row filed last per key (no date counts as earliest), ties by the given order."""
    w = Window.partitionBy(*keys).orderBy(F.col(filed).desc_nulls_last(), *ties)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def parse_facts(raw: DataFrame, payload: str = "payload", as_of: Column | None = None) -> DataFrame:
    """Companyfacts documents to facts: (company, concept, fiscal_year, fiscal_period, val, period_end_date, filed_date,
    source_tag, accession_number). Latest revision per tag, then the best tag per period, then derived fourth quarters."""
    obs = known_by(observations(raw, payload), as_of).where("ns = 'us-gaap'")
    ctx = reporting_contexts(obs)
    wanted = obs.where((F.col("unit") == "USD") & F.col("form").isin(*PERIODIC_FORMS) & usable("val") & F.col("end").isNotNull()).join(F.broadcast(tag_priority(raw.sparkSession)), "tag")
    flow = ~F.col("concept").isin(*STOCK_CONCEPTS)
    placed = (
        wanted.where(flow == (F.coalesce("start", F.lit("")) != ""))
        .join(ctx, ["company", "accn"])
        .withColumn("p", fiscal_period(F.col("end"), F.col("start"), F.col("context.end"), F.col("context.fy"), F.col("context.fp")))
        .where("p is not null")
        .select("company", "concept", F.col("p.fy").alias("fiscal_year"), F.col("p.fp").alias("fiscal_period"), "val", F.col("end").alias("period_end_date"), F.col("filed").alias("filed_date"),
                F.concat(F.lit("us-gaap:"), "tag").alias("source_tag"), F.col("accn").alias("accession_number"), "priority", "pos")
    )
    per_tag = latest_revision(placed, ["company", "concept", "fiscal_year", "fiscal_period", "priority"], "filed_date", F.col("pos"), F.col("accession_number"))
    w = Window.partitionBy("company", "concept", "fiscal_year", "fiscal_period").orderBy("priority")
    facts = per_tag.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "priority", "pos")
    return facts.unionByName(derived_fourth_quarters(facts))


def derived_fourth_quarters(facts: DataFrame) -> DataFrame:
    """FY - Q1 - Q2 - Q3 where Q4 is missing, the four ends are 75 to 105 days apart in turn, and the concept is a flow.

    One aggregation per (company, concept, year) in place of joins; a unit column, where there is one, must agree.
    """
    at = lambda p, c: F.max(F.when(F.col("fiscal_period") == p, F.col(c)))
    periods = ("Q1", "Q2", "Q3", "FY", "Q4")
    cols = [at(p, c).alias(f"{p}_{c}") for p in periods for c in ("val", "period_end_date")]
    whole = F.max(F.when(F.col("fiscal_period") == "FY", F.struct("period_end_date", "filed_date", "source_tag", "accession_number"))).alias("fy_row")
    units = [F.count_distinct(F.when(F.col("fiscal_period") != "Q4", F.coalesce("unit", F.lit("")))).alias("units")] if "unit" in facts.columns else []
    g = facts.where(~F.col("concept").isin(*STOCK_CONCEPTS)).groupBy("company", "concept", "fiscal_year").agg(*cols, whole, *units)
    gap = lambda a, b: F.datediff(F.col(f"{b}_period_end_date"), F.col(f"{a}_period_end_date")).between(75, 105)
    ok = F.col("Q4_val").isNull() & gap("Q1", "Q2") & gap("Q2", "Q3") & gap("Q3", "FY")
    if units:
        ok = ok & (F.col("units") == 1)
    out = g.where(ok).select(
        "company", "concept", "fiscal_year", F.lit("Q4").alias("fiscal_period"), (F.col("FY_val") - F.col("Q1_val") - F.col("Q2_val") - F.col("Q3_val")).alias("val"),
        F.col("fy_row.period_end_date").alias("period_end_date"), F.col("fy_row.filed_date").alias("filed_date"), F.lit("derived:FY-Q1-Q2-Q3").alias("source_tag"), F.col("fy_row.accession_number").alias("accession_number"),
    )
    return out.where(F.col("val").isNotNull())


def normalized_facts(facts: DataFrame, tag_map: DataFrame) -> DataFrame:
    """Usable rows of a facts table in compared form, with the priority of their tag; the tag table is joined by size."""
    prio = tag_map.select(label("concept").alias("concept"), F.col("source_tag").alias("tag"), "priority")
    rows = facts.where(usable("val")).select(
        company_number("company_cik").alias("company"), label("concept").alias("concept"), "fiscal_year", F.upper(label("fiscal_period")).alias("fiscal_period"), "val", "unit",
        "period_end_date", "filed_date", "source", "source_tag", bare_tag("source_tag").alias("tag"), dashed_accession("accession_number").alias("accession_number"), "fact_id",
    ).where("company is not null and fiscal_year is not null and fiscal_period is not null")
    return rows.join(prio, ["concept", "tag"], "left")


def best_fact_order() -> list[Column]:
    """Of several facts of one period the best tag comes first, then the one filed last, then the lowest id."""
    return [F.col("priority").asc_nulls_last(), F.col("filed_date").desc_nulls_last(), F.col("fact_id")]


def canonical_facts(facts: DataFrame, tag_map: DataFrame) -> DataFrame:
    """One fact per (company, concept, fiscal_year, fiscal_period) of a facts table, by one row_number pass."""
    w = Window.partitionBy("company", "concept", "fiscal_year", "fiscal_period").orderBy(*best_fact_order())
    return normalized_facts(facts, tag_map).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "tag", "priority")


def coverage(facts: DataFrame, targets: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company of companies, those without any fact included: how many target concepts have a fact, which are
    missing, and the rate (0 without targets). The targets are a fixed list."""
    have = facts.groupBy("company").agg(F.collect_set("concept").alias("have"))
    want = targets.agg(F.collect_set("concept").alias("want"))
    found = F.array_intersect("want", F.coalesce("have", F.array().cast("array<string>")))
    n, hit = F.size("want"), F.size(found)
    return companies.select("company").distinct().join(have, "company", "left").join(F.broadcast(want)).select(
        "company", n.alias("total"), hit.alias("resolved"), F.array_join(F.array_sort(F.array_except("want", found)), ",").alias("missing"),
        F.when(n == 0, 0.0).otherwise(hit / n * 100).alias("rate"),
    )


def restatements(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """Periods of a concept for which different accessions give different values.

    facts (company, concept, tag, period_end_date, duration, accession_number, val, filed_date, fact_id), usable or not;
    tags (concept, tag, priority). Of each concept only the best tag the company has any row of is looked at, whether its
    values are usable or not. Periods are told apart by end and duration (what the start says), not by label; an
    accession counts with its last usable value.
    """
    known = facts.join(tags.select("concept", "tag", "priority"), ["concept", "tag"])
    # The best tag by one aggregation beside the values, so a company's facts are shuffled once by (company, concept).
    best = F.min("priority").over(Window.partitionBy("company", "concept"))
    rows = known.withColumn("_best", best).where((F.col("priority") == F.col("_best")) & usable("val") & F.col("period_end_date").isNotNull() & F.col("accession_number").isNotNull())
    last = rows.groupBy("company", "concept", "tag", "period_end_date", "duration", "accession_number").agg(F.max_by("val", F.struct(F.coalesce("filed_date", F.lit("0001-01-01").cast("date")), "fact_id")).alias("val"))
    return (
        last.groupBy("company", "concept", "tag", "period_end_date", "duration")
        .agg(F.count_distinct("val").alias("values"), F.min("val").alias("low"), F.max("val").alias("high"), F.array_sort(F.collect_set("accession_number")).alias("accessions"))
        .where("values > 1")
    )


def citation(concept: Column, tag: Column, end: Column, unit: Column, cik: Column, accession: Column) -> Column:
    """Readable source of a fact, with the archive link where the accession is known."""
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), company_number(cik).cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-index.html"))
    link = F.when(accession.isNotNull(), F.concat(F.lit("["), accession, F.lit("]("), url, F.lit(")")))
    return F.concat_ws("; ", F.coalesce(tag, concept), F.concat(F.lit("period ending "), end.cast("string")), unit, link)


__all__ = ["canonical_facts", "citation", "coverage", "derived_fourth_quarters", "fiscal_period", "known_by", "latest_revision", "normalized_facts", "observations", "padded_cik", "parse_facts", "reporting_contexts", "restatements", "tag_priority"]
