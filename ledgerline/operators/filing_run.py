"""Processing of filings as one plan over all of them: period, known figures, comparisons, flags, records.

What a filing may use is what had been filed by its own filing date. Everything is an equi-join on (company, year,
period), so a company's history is never multiplied with its filings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.compare import percent_change
from ledgerline.operators.facts import CONCEPTS, STOCK_CONCEPTS, best_fact_order
from ledgerline.operators.filings import form_class

METRIC_CHANGE_PCT, MARGIN_CHANGE_POINTS = 20.0, 5.0
MARGINS = ("net_income", "gross_profit", "operating_income")
NO_PERIOD = "no single period of the filing's own facts"
_EVENT = ("accession_number", "company", "form", "filing_date", "report_date")


def with_year_end_debt(facts: DataFrame) -> DataFrame:
    """Facts with fourth-quarter balances listed for the year too, after any that are labelled so themselves."""
    debt = facts.where(F.col("concept").isin(*STOCK_CONCEPTS) & (F.col("fiscal_period") == "Q4")).withColumn("fiscal_period", F.lit("FY"))
    return facts.withColumn("copied", F.lit(0)).unionByName(debt.withColumn("copied", F.lit(1)))


def figures_known(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """The best fact of each concept in each period of wanted (accession_number, company, filing_date, fiscal_year,
    fiscal_period, …) among the facts filed by filing_date; undated facts are known to nobody."""
    held = facts.drop("company_name").withColumnsRenamed({"accession_number": "source_accession"})
    j = wanted.join(held, ["company", "fiscal_year", "fiscal_period"]).where(F.col("filed_date") <= F.col("filing_date"))
    keys = ["accession_number", "concept", "fiscal_year", "fiscal_period"] + (["role"] if "role" in wanted.columns else [])
    w = Window.partitionBy(*keys).orderBy("copied", *best_fact_order())
    return j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _own() -> Column:
    return (F.col("source_accession") == F.col("accession_number")) & (F.col("period_end_date") == F.col("report_date"))


def filing_periods(events: DataFrame, facts: DataFrame) -> DataFrame:
    """The one period each periodic filing reports: (…event, fiscal_year, fiscal_period, error).

    It is that of the filing's own facts at its report date, balances aside and of an annual report only the year; where
    there is none or more than one, error says so and the filing is to be taken up again later. Other filings have
    neither period nor error. events hold one row per accession; facts come from with_year_end_debt.
    """
    periodic = events.where(form_class(F.col("form")) == "periodic")
    plain = facts.where(~F.col("concept").isin(*STOCK_CONCEPTS))
    named = plain.select("company", "accession_number", F.col("period_end_date").alias("report_date"), "fiscal_year", "fiscal_period").distinct()
    maybe = periodic.join(named, ["company", "accession_number", "report_date"])
    own = figures_known(maybe, plain).where(_own() & (~F.col("form").startswith("10-K") | (F.col("fiscal_period") == "FY")))
    one = own.groupBy("accession_number").agg(F.count_distinct("fiscal_year", "fiscal_period").alias("n"), F.min(F.struct("fiscal_year", "fiscal_period")).alias("p"))
    j = events.join(one, "accession_number", "left").withColumn("p", F.when(F.col("n") == 1, F.col("p")))
    missing = (form_class(F.col("form")) == "periodic") & F.col("p").isNull()
    return j.select(*_EVENT, F.col("p.fiscal_year").alias("fiscal_year"), F.col("p.fiscal_period").alias("fiscal_period"), F.when(missing, F.lit(NO_PERIOD)).alias("error"))


def filing_figures(periods: DataFrame, facts: DataFrame) -> DataFrame:
    """Figures of each filing's period and of those it is compared with: (…event, role, concept, …fact), role current,
    year (the same period a year before) or quarter (the one before).

    A current figure counts only if it is the filing's own; one of an older filing would pass for new.
    """
    y, p = F.col("fiscal_year"), F.col("fiscal_period")
    q = F.substring(p, 2, 1).try_cast("int")
    role = lambda name, year, period, ok=F.lit(True): F.when(ok, F.struct(F.lit(name).alias("role"), year.alias("fiscal_year"), period.alias("fiscal_period")))
    before = role("quarter", F.when(q == 1, y - 1).otherwise(y), F.concat(F.lit("Q"), F.when(q == 1, 4).otherwise(q - 1).cast("string")), q.isNotNull())
    wanted = periods.where("fiscal_period is not null").select(*_EVENT, F.explode(F.array_compact(F.array(role("current", y, p), role("year", y - 1, p), before))).alias("r")).select(*_EVENT, "r.*")
    return figures_known(wanted, facts).where((F.col("role") != "current") | _own())


def filing_comparisons(figures: DataFrame) -> DataFrame:
    """(accession_number, concept, comparison, current_value, prior_value, percent_change, prior_year, prior_period) of each
    current figure with those of the year and the quarter before."""
    cur = figures.where("role = 'current'").select("accession_number", "concept", "fiscal_year", "fiscal_period", F.col("val").alias("current_value"))
    old = figures.where("role <> 'current'").select("accession_number", "concept", F.when(F.col("role") == "year", "YoY").otherwise("QoQ").alias("comparison"), F.col("val").alias("prior_value"), F.col("fiscal_year").alias("prior_year"), F.col("fiscal_period").alias("prior_period"))
    return cur.join(old, ["accession_number", "concept"]).withColumn("percent_change", percent_change(F.col("current_value"), F.col("prior_value")))


def metric_flags(compared: DataFrame, least: float = METRIC_CHANGE_PCT) -> DataFrame:
    """(accession_number, rule_id, severity, citation, detail) of the changes of at least so many percent."""
    period = lambda p, y: F.concat(F.col(p), F.lit(" FY"), F.col(y).cast("string"))
    return compared.where(F.abs("percent_change") >= least).select(
        "accession_number", F.lit("METRIC_CHANGE_THRESHOLD").alias("rule_id"), F.lit("notable").alias("severity"),
        F.concat(F.col("concept"), F.lit(": "), period("fiscal_period", "fiscal_year"), F.lit(" vs "), period("prior_period", "prior_year")).alias("citation"),
        F.concat(F.col("concept"), F.lit(" changed "), F.format_string("%+.2f%%", "percent_change"), F.lit(" ("), F.col("comparison"), F.lit(")")).alias("detail"))


def margin_flags(figures: DataFrame, least: float = MARGIN_CHANGE_POINTS) -> DataFrame:
    """Flags of margins that moved by at least so many points from the year before; one aggregation per filing."""
    at = lambda role, concept: F.max(F.when((F.col("role") == role) & (F.col("concept") == concept), F.col("val")))
    g = figures.where("role <> 'quarter'").groupBy("accession_number").agg(*[at(r, c).alias(f"{r}_{c}") for r in ("current", "year") for c in ("revenue", *MARGINS)])
    pct = lambda r, c: F.when(F.col(f"{r}_revenue") != 0, F.col(f"{r}_{c}") / F.col(f"{r}_revenue") * 100)
    m = g.select("accession_number", F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), pct("current", c).alias("now"), pct("year", c).alias("was")) for c in MARGINS])).alias("m")).select("accession_number", "m.*")
    return m.where(F.abs(F.col("now") - F.col("was")) >= least).select(
        "accession_number", F.lit("MARGIN_THRESHOLD").alias("rule_id"), F.lit("notable").alias("severity"), F.concat(F.col("concept"), F.lit("/revenue margin")).alias("citation"),
        F.format_string("Margin moved %+.2fpp: %.2f%% -> %.2f%%", F.col("now") - F.col("was"), "was", "now").alias("detail"))


def run_records(periods: DataFrame, figures: DataFrame, flags: DataFrame) -> DataFrame:
    """One record a filing: (…event, fiscal_year, fiscal_period, error, coverage_pct, missing, notable, routine, summary).

    Filings that failed keep their error and have no figures; filings of other forms have no coverage by nature.
    """
    have = figures.where("role = 'current'").groupBy("accession_number").agg(F.collect_set("concept").alias("have"))
    n = flags.groupBy("accession_number").agg(F.count_if(F.col("severity") != "routine").alias("notable"), F.count_if(F.col("severity") == "routine").alias("routine"))
    want = F.array(*map(F.lit, sorted(CONCEPTS)))
    found = F.array_intersect(want, F.coalesce("have", F.array().cast("array<string>")))
    r = periods.join(have, "accession_number", "left").join(n, "accession_number", "left").withColumns(
        {"coverage_pct": F.size(found) / F.lit(len(CONCEPTS)) * 100, "missing": F.array_except(want, found), "notable": F.coalesce("notable", F.lit(0)), "routine": F.coalesce("routine", F.lit(0))})
    told = F.when(F.col("notable") > 0, F.concat(F.col("notable").cast("string"), F.lit(" item(s) flagged for review this period."))).otherwise(F.lit("No items met the thresholds for flags this period."))
    cover = F.when(form_class(F.col("form")) == "periodic", F.format_string("Coverage of the current period: %.1f%%", "coverage_pct")).otherwise(F.lit("Event filing: narrative screening only."))
    gaps = F.when((form_class(F.col("form")) == "periodic") & (F.size("missing") > 0), F.concat(F.lit("Figures to be looked up: "), F.array_join("missing", ", ")))
    return r.select(*periods.columns, "coverage_pct", "missing", "notable", "routine", F.when(F.col("error").isNull(), F.array_compact(F.array(told, cover, gaps))).alias("summary"))
