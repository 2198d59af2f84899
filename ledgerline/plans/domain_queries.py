"""Queries of the disclosure domain, by family, each beside the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.normalize import collapse_space, company_number, dashed_accession, duration_class, json_list, label, padded_cik, usable
from ledgerline.operators import blocks, compare, documents, facts, filings, narrative, records, report, retrieval
from ledgerline.plans.registry import Registry
from ledgerline.session import materialize
from ledgerline.sources.tables import table
from ledgerline.streaming import poll

FACTS, PEERS, FILINGS, DOCS, NARRATIVE, RETRIEVAL, OTHER = (Registry() for _ in range(7))
REGISTRIES = [FACTS, PEERS, FILINGS, DOCS, NARRATIVE, RETRIEVAL, OTHER]

_ACC = """CASE WHEN regexp_full_match(trim(accession_number), '\\d{18}') THEN left(trim(accession_number), 10) || '-' || substr(trim(accession_number), 11, 2) || '-' || substr(trim(accession_number), 13) ELSE nullif(trim(accession_number), '') END"""
_CANON = f"""WITH pr AS (SELECT lower(trim(concept)) concept, source_tag tag, priority FROM tag_map),
fx AS (SELECT try_cast(trim(company_cik) AS BIGINT) company, lower(trim(concept)) concept, fiscal_year, upper(trim(fiscal_period)) fiscal_period, val, unit, period_end_date, filed_date, source, source_tag,
  string_split(source_tag, ':')[-1] tag, {_ACC} accession_number, fact_id FROM financial_facts WHERE val IS NOT NULL AND isfinite(val)),
cf AS (SELECT * EXCLUDE (rn) FROM (SELECT fx.*, row_number() OVER (PARTITION BY company, fx.concept, fiscal_year, fiscal_period ORDER BY priority ASC NULLS LAST, filed_date DESC NULLS LAST, fact_id) rn
  FROM fx LEFT JOIN pr ON fx.concept = pr.concept AND fx.tag = pr.tag WHERE company IS NOT NULL AND fiscal_year IS NOT NULL AND fiscal_period IS NOT NULL) WHERE rn = 1)
"""
_PCT = "CASE WHEN p.val <> 0 THEN (c.val - p.val) / abs(p.val) * 100 END percent_change"


def _canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.canonical_facts(table(spark, sf_dir, "financial_facts"), table(spark, sf_dir, "tag_map"))


# ---- facts -------------------------------------------------------------------------------------------------------


@FACTS.add("facts_canonical", _CANON + "SELECT company, concept, fiscal_year, fiscal_period, val, fact_id, accession_number FROM cf")
def facts_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canon(spark, sf_dir).select("company", "concept", "fiscal_year", "fiscal_period", "val", "fact_id", "accession_number")


@FACTS.add(
    "facts_year_over_year",
    _CANON + f"SELECT c.company, c.concept, c.fiscal_year, c.fiscal_period, c.val current_value, p.val prior_value, c.val - p.val absolute_change, {_PCT} FROM cf c JOIN cf p ON c.company = p.company AND c.concept = p.concept AND c.fiscal_period = p.fiscal_period AND c.fiscal_year = p.fiscal_year + 1",
)
def facts_year_over_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.year_over_year(_canon(spark, sf_dir)).drop("prior_year", "prior_period")


@FACTS.add(
    "facts_quarter_over_quarter",
    _CANON + f""", q AS (SELECT *, fiscal_year * 4 + substr(fiscal_period, 2, 1)::INT - 1 k FROM cf WHERE regexp_full_match(fiscal_period, 'Q[1-4]'))
SELECT c.company, c.concept, c.fiscal_year, c.fiscal_period, p.fiscal_year prior_year, p.fiscal_period prior_period, c.val current_value, p.val prior_value, c.val - p.val absolute_change, {_PCT} FROM q c JOIN q p ON c.company = p.company AND c.concept = p.concept AND c.k = p.k + 1""",
)
def facts_quarter_over_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.quarter_over_quarter(_canon(spark, sf_dir))


@FACTS.add(
    "facts_margins",
    _CANON + """SELECT n.company, n.fiscal_year, n.fiscal_period, n.concept, n.val / d.val * 100 margin_pct FROM cf n JOIN cf d ON n.company = d.company AND n.fiscal_year = d.fiscal_year AND n.fiscal_period = d.fiscal_period
WHERE d.concept = 'revenue' AND d.val <> 0 AND n.concept IN ('net_income', 'gross_profit', 'operating_income')""",
)
def facts_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.margins(_canon(spark, sf_dir), ["net_income", "gross_profit", "operating_income"])


@FACTS.add(
    "facts_derived_q4",
    _CANON + """, w AS (SELECT company, concept, fiscal_year, max(val) FILTER (WHERE fiscal_period = 'FY') fy, max(val) FILTER (WHERE fiscal_period = 'Q1') q1, max(val) FILTER (WHERE fiscal_period = 'Q2') q2, max(val) FILTER (WHERE fiscal_period = 'Q3') q3,
  max(val) FILTER (WHERE fiscal_period = 'Q4') q4, max(period_end_date) FILTER (WHERE fiscal_period = 'FY') fe, max(period_end_date) FILTER (WHERE fiscal_period = 'Q1') e1, max(period_end_date) FILTER (WHERE fiscal_period = 'Q2') e2,
  max(period_end_date) FILTER (WHERE fiscal_period = 'Q3') e3, count(DISTINCT coalesce(unit, '')) FILTER (WHERE fiscal_period <> 'Q4') u FROM cf WHERE concept <> 'total_debt' GROUP BY ALL)
SELECT company, concept, fiscal_year, fy - q1 - q2 - q3 val, fe period_end_date FROM w WHERE q4 IS NULL AND u = 1 AND e2 - e1 BETWEEN 75 AND 105 AND e3 - e2 BETWEEN 75 AND 105 AND fe - e3 BETWEEN 75 AND 105 AND fy - q1 - q2 - q3 IS NOT NULL""",
)
def facts_derived_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.derived_fourth_quarters(_canon(spark, sf_dir)).select("company", "concept", "fiscal_year", "val", "period_end_date")


_COVER = _CANON + """, t AS (SELECT DISTINCT concept FROM pr), co AS (SELECT DISTINCT try_cast(trim(company_cik) AS BIGINT) company FROM filing_events WHERE try_cast(trim(company_cik) AS BIGINT) IS NOT NULL),
c AS (SELECT co.company, count(*) total, count(h.concept) resolved, coalesce(string_agg(t.concept, ',' ORDER BY t.concept) FILTER (WHERE h.concept IS NULL), '') missing FROM co CROSS JOIN t LEFT JOIN (SELECT DISTINCT company, concept FROM cf) h ON h.company = co.company AND h.concept = t.concept GROUP BY co.company)
"""


@FACTS.add("facts_coverage", _COVER + "SELECT company, total::INT total, resolved::INT resolved, missing, resolved / total * 100 rate FROM c")
def facts_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = table(spark, sf_dir, "filing_events", "company_cik").select(company_number("company_cik").alias("company")).where("company is not null")
    return facts.coverage(_canon(spark, sf_dir), table(spark, sf_dir, "tag_map").select(label("concept").alias("concept")), watched)


@FACTS.add("facts_watchlist_coverage", _COVER + "SELECT sum(resolved)::BIGINT resolved, sum(total)::BIGINT total, sum(resolved) / sum(total) * 100 rate FROM c")
def facts_watchlist_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_coverage(spark, sf_dir).agg(F.sum("resolved").alias("resolved"), F.sum("total").alias("total"), (F.sum("resolved") / F.sum("total") * 100).alias("rate"))


# From the rule: first tag present of each concept, periods by end and duration, the last value of each accession.
_RESTATED = _CANON + f""", al AS (SELECT try_cast(trim(company_cik) AS BIGINT) company, lower(trim(concept)) concept, string_split(source_tag, ':')[-1] tag, period_end_date, CASE WHEN lower(trim(fiscal_period)) = 'fy' THEN 'FY' WHEN regexp_full_match(lower(trim(fiscal_period)), 'q[1-4]') THEN 'Q' END duration,
  {_ACC} accession_number, val, filed_date, fact_id FROM financial_facts WHERE source = 'xbrl'),
pt AS (SELECT al.*, priority FROM al JOIN pr ON al.concept = pr.concept AND al.tag = pr.tag),
fp AS (SELECT * FROM pt QUALIFY priority = min(priority) OVER (PARTITION BY company, concept)),
l AS (SELECT company, concept, tag, period_end_date, duration, accession_number, arg_max(val, (coalesce(filed_date, DATE '0001-01-01'), fact_id)) val FROM fp WHERE val IS NOT NULL AND isfinite(val) AND period_end_date IS NOT NULL AND accession_number IS NOT NULL GROUP BY ALL),
rs AS (SELECT company, concept, tag, period_end_date, duration, count(DISTINCT val) "values", min(val) low, max(val) high, list_sort(list(DISTINCT accession_number)) accessions FROM l GROUP BY ALL HAVING count(DISTINCT val) > 1)
"""


def _restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "financial_facts").where(F.col("source") == "xbrl").select(
        company_number("company_cik").alias("company"), label("concept").alias("concept"), F.substring_index("source_tag", ":", -1).alias("tag"), "period_end_date", duration_class("fiscal_period").alias("duration"),
        dashed_accession("accession_number").alias("accession_number"), "val", "filed_date", "fact_id")
    return facts.restatements(rows, table(spark, sf_dir, "tag_map").select(label("concept").alias("concept"), F.col("source_tag").alias("tag"), "priority"))


@FACTS.add("facts_restatements", _RESTATED + """SELECT company, concept, tag, period_end_date, duration, "values", low, high, array_to_string(accessions, ',') accessions FROM rs""")
def facts_restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restated(spark, sf_dir).withColumn("accessions", F.array_join("accessions", ","))


_AS_OF = "2020-12-31"


@FACTS.add(
    "facts_snapshot",
    f"""SELECT try_cast(trim(company_cik) AS BIGINT) company, lower(trim(concept)) concept, count(*) n, max(filed_date) last_filed, count(DISTINCT fiscal_year) AS years
FROM financial_facts WHERE filed_date <= DATE '{_AS_OF}' AND val IS NOT NULL AND isfinite(val) GROUP BY ALL""",
)
def facts_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = facts.known_by(table(spark, sf_dir, "financial_facts", "company_cik", "concept", "val", "filed_date", "fiscal_year"), F.lit(_AS_OF).cast("date"), "filed_date").where(usable("val"))
    return known.groupBy(company_number("company_cik").alias("company"), label("concept").alias("concept")).agg(F.count(F.lit(1)).alias("n"), F.max("filed_date").alias("last_filed"), F.count_distinct("fiscal_year").alias("years"))


@FACTS.add(
    "facts_latest_revision",
    """SELECT company_cik, concept, source_tag, fiscal_year, fiscal_period, fact_id, val FROM (SELECT *, row_number() OVER (PARTITION BY company_cik, concept, source_tag, fiscal_year, fiscal_period ORDER BY filed_date DESC NULLS LAST, fact_id) rn FROM financial_facts) WHERE rn = 1""",
)
def facts_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["company_cik", "concept", "source_tag", "fiscal_year", "fiscal_period"]
    return facts.latest_revision(table(spark, sf_dir, "financial_facts", *keys, "fact_id", "val", "filed_date"), keys, "filed_date", F.col("fact_id")).drop("filed_date")


@FACTS.add(
    "facts_citations",
    _CANON + """SELECT fact_id, concat_ws('; ', coalesce(source_tag, concept), 'period ending ' || period_end_date::VARCHAR, unit,
  '[' || accession_number || '](https://www.sec.gov/Archives/edgar/data/' || company::VARCHAR || '/' || replace(accession_number, '-', '') || '/' || accession_number || '-index.html)') citation FROM cf""",
)
def facts_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canon(spark, sf_dir).select("fact_id", facts.citation(F.col("concept"), F.col("source_tag"), F.col("period_end_date"), F.col("unit"), F.col("company").cast("string"), F.col("accession_number")).alias("citation"))


@FACTS.add(
    "facts_wide",
    _CANON + """SELECT company, fiscal_year, fiscal_period, max(val) FILTER (WHERE concept = 'revenue') revenue, max(val) FILTER (WHERE concept = 'net_income') net_income, max(val) FILTER (WHERE concept = 'gross_profit') gross_profit,
  max(val) FILTER (WHERE concept = 'total_debt') total_debt, max(val) FILTER (WHERE concept = 'operating_income') operating_income FROM cf GROUP BY ALL""",
)
def facts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canon(spark, sf_dir).groupBy("company", "fiscal_year", "fiscal_period").pivot("concept", list(facts.CONCEPTS)).agg(F.max("val"))


@FACTS.add(
    "facts_label_peers",
    _CANON + """SELECT a.comparison_id, a.peer, p.val peer_value FROM (SELECT comparison_id, try_cast(trim(peer_cik) AS BIGINT) peer, fiscal_year, upper(trim(fiscal_period)) fiscal_period FROM peer_comparisons) a
LEFT JOIN (SELECT * FROM cf WHERE concept = 'revenue') p ON p.company = a.peer AND p.fiscal_year = a.fiscal_year AND p.fiscal_period = a.fiscal_period""",
)
def facts_label_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "peer_comparisons", "comparison_id", "peer_cik", "fiscal_year", "fiscal_period").select("comparison_id", company_number("peer_cik").alias("peer"), "fiscal_year", F.upper(label("fiscal_period")).alias("fiscal_period"))
    return compare.peers_by_label(asked, _canon(spark, sf_dir), "revenue").select("comparison_id", "peer", "peer_value")


@FACTS.add(
    "facts_of_filing",
    _CANON + """, e AS (SELECT DISTINCT try_cast(trim(company_cik) AS BIGINT) company, """ + _ACC + """ accession_number, report_date FROM filing_events),
m AS (SELECT e.accession_number, cf.company, cf.concept, cf.fiscal_year, cf.fiscal_period, cf.val FROM e JOIN cf ON e.company = cf.company AND e.accession_number = cf.accession_number AND e.report_date = cf.period_end_date WHERE cf.concept <> 'total_debt')
SELECT accession_number, company, count(DISTINCT (fiscal_year, fiscal_period)) periods, count(*) n FROM m GROUP BY ALL""",
)
def facts_of_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "filing_events", "company_cik", "accession_number", "report_date").select(company_number("company_cik").alias("company"), dashed_accession("accession_number").alias("accession_number"), F.col("report_date").alias("period_end_date")).distinct()
    own = _canon(spark, sf_dir).where("concept <> 'total_debt'").join(events, ["company", "accession_number", "period_end_date"])
    return own.groupBy("accession_number", "company").agg(F.count_distinct(F.struct("fiscal_year", "fiscal_period")).alias("periods"), F.count(F.lit(1)).alias("n"))


# ---- peers -------------------------------------------------------------------------------------------------------

_CLS = "CASE WHEN lower(trim(fiscal_period)) = 'fy' THEN 'FY' WHEN regexp_full_match(lower(trim(fiscal_period)), 'q[1-4]') THEN 'Q' END"
_PEERS = f"""WITH c AS (SELECT comparison_id, try_cast(trim(subject_cik) AS BIGINT) subject, try_cast(trim(peer_cik) AS BIGINT) co, period_end_date d, {_CLS} cls FROM peer_comparisons),
r AS (SELECT peer_row_id, try_cast(trim(company_cik) AS BIGINT) co, period_end_date d, {_CLS} cls FROM peer_rows WHERE (revenue IS NOT NULL AND isfinite(revenue)) OR (net_income IS NOT NULL AND isfinite(net_income)) OR (gross_profit IS NOT NULL AND isfinite(gross_profit))),
a AS (SELECT comparison_id, peer_row_id, (r.d - c.d)::INT o, row_number() OVER (PARTITION BY comparison_id ORDER BY abs(r.d - c.d), r.d, peer_row_id) rn FROM c JOIN r ON c.co = r.co AND c.cls = r.cls),
al AS (SELECT c.comparison_id, c.subject, CASE WHEN abs(a.o) <= 45 THEN a.peer_row_id END peer_row_id, CASE WHEN abs(a.o) <= 45 THEN a.o END offset_days, a.o nearest_offset,
  CASE WHEN abs(a.o) <= 45 THEN NULL WHEN a.o IS NOT NULL THEN 'no period within the window' ELSE 'no period of this duration' END reason FROM c LEFT JOIN a ON a.comparison_id = c.comparison_id AND a.rn = 1)
"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, sf_dir, "peer_comparisons", "comparison_id", "subject_cik", "peer_cik", "period_end_date", "fiscal_period").select(
        F.col("comparison_id").alias("ask_id"), company_number("subject_cik").alias("subject"), company_number("peer_cik").alias("entity"), duration_class("fiscal_period").alias("class"), F.col("period_end_date").alias("day"))
    rows = table(spark, sf_dir, "peer_rows").where((usable("revenue") | usable("net_income") | usable("gross_profit")) & F.col("period_end_date").isNotNull()).select(
        F.col("peer_row_id").alias("row_id"), company_number("company_cik").alias("entity"), duration_class("fiscal_period").alias("class"), F.col("period_end_date").alias("day")).where("class is not null and entity is not null")
    return asked, rows


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = _asked(spark, sf_dir)
    whole = asked.where("entity is not null and class is not null and day is not null")
    return asked.select("ask_id", "subject").join(compare.align_peers(whole, rows), "ask_id", "left").withColumn("reason", F.when(F.col("row_id").isNull(), F.coalesce("reason", F.lit("no period of this duration"))))


@PEERS.add("peers_nearest", _PEERS + "SELECT comparison_id, peer_row_id, offset_days FROM al WHERE peer_row_id IS NOT NULL")
def peers_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.nearest_rows(*_asked(spark, sf_dir)).select(F.col("ask_id").alias("comparison_id"), F.col("row_id").alias("peer_row_id"), "offset_days")


@PEERS.add("peers_aligned", _PEERS + "SELECT comparison_id, peer_row_id, offset_days, nearest_offset, reason FROM al")
def peers_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select(F.col("ask_id").alias("comparison_id"), F.col("row_id").alias("peer_row_id"), "offset_days", "nearest_offset", "reason")


@PEERS.add("peers_alignment_summary", _PEERS + "SELECT subject, count(*) asked, count(peer_row_id) aligned, coalesce(max(abs(offset_days)), 0) widest, count(*) FILTER (WHERE abs(offset_days) > 30) wide FROM al GROUP BY subject")
def peers_alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.alignment_summary(_aligned(spark, sf_dir), "subject")


# ---- filings -----------------------------------------------------------------------------------------------------

_EV = f"ev AS (SELECT event_id, try_cast(trim(company_cik) AS BIGINT) company, {_ACC} accession_number, upper(trim(form)) form, filing_date FROM filing_events)"
_KIND = "CASE WHEN trim(replace(form, '/A', '')) IN ('10-K', '10-Q') THEN 'periodic' ELSE 'event' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "filing_events", "event_id", "company_cik", "accession_number", "form", "filing_date").select(
        "event_id", company_number("company_cik").alias("company"), dashed_accession("accession_number").alias("accession_number"), F.upper(F.trim("form")).alias("form"), "filing_date")


@FILINGS.add(
    "filings_parsed",
    """WITH j AS (SELECT payload::JSON j FROM raw_records WHERE json_valid(payload)),
l AS (SELECT j, """ + ", ".join(f"CASE json_type(j->'$.filings.recent.{c}') WHEN 'ARRAY' THEN j->'$.filings.recent.{c}' ELSE json_array(j->'$.filings.recent.{c}') END {c}" for c in ("accessionNumber", "form", "filingDate", "primaryDocument")) + """ FROM j WHERE json_type(j->'$.filings.recent') = 'OBJECT'),
a AS (SELECT *, unnest(range(json_array_length(accessionNumber)::BIGINT))::INT i FROM l),
r AS (SELECT lpad(try_cast(trim(j->>'$.cik') AS BIGINT)::VARCHAR, 10, '0') company_cik, accessionNumber->>i accession_number, form->>i form, filingDate->>i fd, primaryDocument->>i pd FROM a)
SELECT company_cik, accession_number, form, fd::DATE filing_date, coalesce(pd, '') primary_document FROM r WHERE form IN ('10-K', '10-Q', '8-K', '10-K/A', '10-Q/A', '8-K/A') AND regexp_full_match(fd, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(fd AS DATE) IS NOT NULL AND accession_number IS NOT NULL""",
)
def filings_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.recent_filings(table(spark, sf_dir, "raw_records", "payload")).select("company_cik", "accession_number", "form", "filing_date", "primary_document")


@FILINGS.add("filings_by_class", f"WITH {_EV} SELECT {_KIND} class, count(*) n, count(DISTINCT accession_number) filings, min(filing_date) first_date, max(filing_date) last_date FROM ev GROUP BY ALL")
def filings_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(filings.form_class(F.col("form")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("accession_number").alias("filings"), F.min("filing_date").alias("first_date"), F.max("filing_date").alias("last_date"))


@FILINGS.add("filings_unseen", f"WITH {_EV}, s AS (SELECT DISTINCT {_ACC} accession_number FROM narrative_passages) SELECT event_id, accession_number FROM ev WHERE accession_number IS NOT NULL AND filing_date >= DATE '2015-01-01' AND accession_number NOT IN (SELECT accession_number FROM s WHERE accession_number IS NOT NULL)")
def filings_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "narrative_passages", "accession_number").select(dashed_accession("accession_number").alias("accession_number"))
    return filings.unseen(_events(spark, sf_dir), seen, F.lit("2015-01-01").cast("date")).select("event_id", "accession_number")


@FILINGS.add(
    "filings_newest_periodic",
    f"WITH {_EV}, d AS (SELECT company, accession_number, max(filing_date) filing_date FROM ev WHERE form IN ('10-K', '10-Q') AND filing_date IS NOT NULL AND company IS NOT NULL GROUP BY ALL) SELECT company, accession_number, filing_date, rank::INT rank FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY filing_date DESC, accession_number DESC) rank FROM d) WHERE rank <= 2",
)
def filings_newest_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("form").isin("10-K", "10-Q") & F.col("company").isNotNull()).groupBy("company", "accession_number").agg(F.max("filing_date").alias("filing_date"), F.first("form").alias("form"))
    return filings.newest_periodic(e, 2).select("company", "accession_number", "filing_date", "rank")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings that have passages, one row each."""
    p = table(spark, sf_dir, "narrative_passages", "company_cik", "accession_number", "form", "filing_date")
    return p.select(company_number("company_cik").alias("company"), dashed_accession("accession_number").alias("accession_number"), filings.form_class(F.upper(F.trim("form"))).alias("class"), "filing_date").dropna().groupBy("company", "class", "accession_number").agg(F.min("filing_date").alias("filing_date"))


_FIL = f"""fl AS (SELECT company, class, accession_number, min(filing_date) filing_date FROM (SELECT try_cast(trim(company_cik) AS BIGINT) company, {_ACC} accession_number, CASE WHEN trim(replace(upper(trim(form)), '/A', '')) IN ('10-K', '10-Q') THEN 'periodic' ELSE 'event' END AS class, filing_date FROM narrative_passages)
  WHERE company IS NOT NULL AND accession_number IS NOT NULL AND filing_date IS NOT NULL GROUP BY ALL),
pf AS (SELECT c.company, c.class, c.accession_number, max((p.filing_date, p.accession_number)) b FROM fl c LEFT JOIN fl p ON p.company = c.company AND p.class = c.class AND p.filing_date < c.filing_date GROUP BY ALL)"""


@FILINGS.add("filings_prior", f"WITH {_FIL} SELECT company, class, accession_number, b[2] prior_accession, b[1] prior_date FROM pf")
def filings_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.prior_filing(_filings(spark, sf_dir)).select("company", "class", "accession_number", "prior_accession", "prior_date")


@FILINGS.add("filings_without_baseline", f"WITH {_EV}, {_FIL} SELECT DISTINCT company FROM ev WHERE company IS NOT NULL AND company NOT IN (SELECT company FROM fl WHERE class = 'periodic')")
def filings_without_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.without_baseline(_events(spark, sf_dir).select("company").dropna().distinct(), _filings(spark, sf_dir).where("class = 'periodic'"))


@FILINGS.add("filings_first_event", f"WITH {_EV} SELECT accession_number, min(event_id) event_id, arg_min(form, event_id) form FROM ev WHERE accession_number IS NOT NULL GROUP BY ALL")
def filings_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_row(_events(spark, sf_dir).where("accession_number is not null"), ["accession_number"], F.col("event_id")).select("accession_number", "event_id", "form")


@FILINGS.add("filings_polled", "SELECT accession_number, min(event_id) event_id FROM filing_events WHERE accession_number IS NOT NULL GROUP BY ALL")
def filings_polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poll.poll_events(spark, f"{sf_dir}/filing_events.parquet").select("accession_number", "event_id")


@FILINGS.add(
    "filings_accession_sets",
    f"""WITH e AS (SELECT DISTINCT {_ACC} a FROM filing_events), d AS (SELECT DISTINCT {_ACC} a FROM documents), p AS (SELECT DISTINCT {_ACC} a FROM narrative_passages)
SELECT 'both' part, count(*) n FROM (SELECT a FROM d INTERSECT SELECT a FROM p) WHERE a IS NOT NULL UNION ALL SELECT 'documents_only', count(*) FROM (SELECT a FROM d EXCEPT SELECT a FROM p) WHERE a IS NOT NULL
UNION ALL SELECT 'any', count(*) FROM (SELECT a FROM e UNION SELECT a FROM d UNION SELECT a FROM p) WHERE a IS NOT NULL""",
)
def filings_accession_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = lambda t: table(spark, sf_dir, t, "accession_number").select(dashed_accession("accession_number").alias("a")).where("a is not null").distinct()
    e, d, p = acc("filing_events"), acc("documents"), acc("narrative_passages")
    n = lambda name, x: x.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return n("both", d.intersect(p)).unionByName(n("documents_only", d.subtract(p))).unionByName(n("any", e.union(d).union(p).distinct()))


# ---- documents ---------------------------------------------------------------------------------------------------


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prose_blocks").where("text is not null and block_order is not null").select(F.coalesce(dashed_accession("accession_number"), F.lit("")).alias("doc"), "block_order", F.col("block_id").alias("tie"), F.coalesce("section", F.lit(documents.NO_HEADING)).alias("section"), "text")


@DOCS.add(
    "docs_chunks_packed",
    f"""WITH RECURSIVE b AS (SELECT coalesce({_ACC}, '') doc, block_order, block_id tie, coalesce(section, '(no heading)') section, text, length(text) n, row_number() OVER (PARTITION BY coalesce({_ACC}, '') ORDER BY block_order, block_id) rn FROM prose_blocks WHERE text IS NOT NULL AND block_order IS NOT NULL),
f AS (SELECT doc, rn, section, n::BIGINT size, 0 chunk_no FROM b WHERE rn = 1
  UNION ALL SELECT b.doc, b.rn, b.section, CASE WHEN f.size > 0 AND (f.section <> b.section OR f.size + b.n > 1500) THEN b.n ELSE f.size + b.n END, f.chunk_no + CASE WHEN f.size > 0 AND (f.section <> b.section OR f.size + b.n > 1500) THEN 1 ELSE 0 END FROM f JOIN b ON b.doc = f.doc AND b.rn = f.rn + 1)
SELECT f.doc, f.chunk_no, min(b.section) section, string_agg(b.block_order, ',' ORDER BY b.rn) orders, string_agg(b.text, ' ' ORDER BY b.rn) text FROM f JOIN b ON b.doc = f.doc AND b.rn = f.rn GROUP BY f.doc, f.chunk_no""",
)
def docs_chunks_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.pack_chunks(_blocks(spark, sf_dir), ["doc"]).select("doc", "chunk_no", "section", F.array_join(F.col("source_orders").cast("array<string>"), ",").alias("orders"), "text")


@DOCS.add(
    "docs_table_cells",
    r"""WITH l AS (SELECT chunk_key, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 row_pos FROM chunks WHERE lower(trim(kind)) = 'table' AND text IS NOT NULL),
c AS (SELECT chunk_key, row_pos, unnest(string_split(line, ' | ')) cell, generate_subscripts(string_split(line, ' | '), 1) - 1 cell_pos FROM l)
SELECT chunk_key, row_pos::INT row_pos, cell_pos::INT cell_pos, CASE WHEN trim(cell) LIKE '(%' AND trim(cell) LIKE '%)' THEN -1 ELSE 1 END * try_cast(regexp_replace(trim(cell), '[(),$\s]', '', 'g') AS DOUBLE) val
FROM c WHERE regexp_full_match(trim(cell), '\(?\$?\s*-?[\d,]+(\.\d+)?\)?') AND try_cast(regexp_replace(trim(cell), '[(),$\s]', '', 'g') AS DOUBLE) IS NOT NULL""",
)
def docs_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table_lines(spark, sf_dir)
    cells = lines.select("chunk_key", "row_pos", F.posexplode(F.split("line", r" \| ")).alias("cell_pos", "cell"))
    return cells.select("chunk_key", "row_pos", "cell_pos", documents.numeric_cell(F.col("cell")).alias("val")).where("val is not null")


def _table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "chunks", "chunk_key", "kind", "text").where((label("kind") == "table") & F.col("text").isNotNull())
    return t.select("chunk_key", F.posexplode(F.split("text", "\n")).alias("row_pos", "line"))


@DOCS.add(
    "docs_table_concepts",
    r"""WITH l AS (SELECT lower(trim(string_split(unnest(string_split(text, chr(10))), ' | ')[1])) lab FROM chunks WHERE lower(trim(kind)) = 'table' AND text IS NOT NULL)
SELECT concept, count(*) n FROM (SELECT CASE WHEN regexp_matches(lab, '\btotal revenue|\bnet revenue|^revenue[s]?$') THEN 'revenue' WHEN regexp_matches(lab, '\bnet income|\bnet loss') THEN 'net_income' WHEN regexp_matches(lab, '\bgross profit') THEN 'gross_profit'
  WHEN regexp_matches(lab, '\boperating income|\bincome from operations') THEN 'operating_income' WHEN regexp_matches(lab, '^total debt$|^total borrowings$') THEN 'total_debt' END concept FROM l) WHERE concept IS NOT NULL GROUP BY ALL""",
)
def docs_table_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_lines(spark, sf_dir).select(documents.row_concept(F.get(F.split("line", r" \| "), F.lit(0))).alias("concept")).where("concept is not null").groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@DOCS.add(
    "docs_html_blocks",
    f"""WITH b AS (SELECT coalesce({_ACC}, '') doc, block_order, block_id tie, section, trim(regexp_replace(text, '[\\s\\p{{Z}}\\x{{b}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+', ' ', 'g')) t FROM prose_blocks WHERE text IS NOT NULL AND block_order IS NOT NULL)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY block_order, tie) - 1)::INT block_order, coalesce(nullif(trim(section), ''), '(no heading)') section, t text FROM b WHERE t <> ''""",
)
def docs_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as markup, one document per accession, and read back."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.concat(F.lit("<h2>"), esc(F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit(documents.NO_HEADING))), F.lit("</h2><div><p>"), esc(F.col("text")), F.lit("</p></div>"))
    html = _blocks(spark, sf_dir).withColumn("part", part).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("block_order", "tie", "part"))).alias("p")).select("doc", F.concat(F.lit("<html><body>"), F.array_join("p.part", ""), F.lit("</body></html>")).alias("html"))
    return documents.html_blocks(html).where("kind = 'prose'").select("doc", "block_order", "section", "text")


# ---- narrative ---------------------------------------------------------------------------------------------------

_HAS = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
_TOPIC_SQL = f"WITH p AS (SELECT passage_id, lower(coalesce(text, '')) t, text FROM narrative_passages) SELECT passage_id, array_to_string(list_filter([CASE WHEN {_HAS(narrative.TOPICS['LIQUIDITY_REGULATORY'])} THEN 'LIQUIDITY_REGULATORY' END, CASE WHEN {_HAS(narrative.TOPICS['LITIGATION'])} THEN 'LITIGATION' END], lambda x: x IS NOT NULL), ',') topics FROM p"


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "narrative_passages", "passage_id", "company_cik", "accession_number", "chunk_id", "text").select("passage_id", company_number("company_cik").alias("company"), dashed_accession("accession_number").alias("accession_number"), "chunk_id", "text")


@NARRATIVE.add("narrative_topics", _TOPIC_SQL)
def narrative_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("passage_id", F.array_join(narrative.topics_of(F.col("text")), ",").alias("topics"))


_NORM = "text"
for _p in narrative.DATE_PATTERNS:  # the SQL ignores case in each pattern, the plan lowers the text first
    _NORM = f"regexp_replace({_NORM}, '(?i){_p}', ' <date> ', 'g')"
_NORM = f"lower(trim(regexp_replace({_NORM}, '[\\s\\p{{Z}}\\x{{b}}\\x{{85}}]+', ' ', 'g')))"
_SENT = f"""WITH n AS (SELECT passage_id, {_ACC} acc, chunk_id, {_NORM} t FROM narrative_passages WHERE text IS NOT NULL),
s AS (SELECT passage_id, acc, t, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') parts FROM n),
k AS (SELECT passage_id, acc, CASE WHEN len(list_filter(parts, lambda x: len(string_split(x, ' ')) >= 6)) > 0 THEN list_filter(parts, lambda x: len(string_split(x, ' ')) >= 6) WHEN t <> '' THEN [t] ELSE [] END sent FROM s)
"""


@NARRATIVE.add("narrative_comparable_text", f"SELECT passage_id, {_NORM} text FROM narrative_passages WHERE text IS NOT NULL")
def narrative_comparable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).where("text is not null").select("passage_id", narrative.comparable_text(F.col("text")).alias("text"))


@NARRATIVE.add("narrative_sentences", _SENT + "SELECT passage_id, len(sent)::INT sentences, list_max(list_transform(sent, lambda x: length(x)))::INT longest FROM k WHERE len(sent) > 0")
def narrative_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = narrative.sentence_table(_passages(spark, sf_dir))
    return s.groupBy("passage_id").agg(F.count(F.lit(1)).cast("int").alias("sentences"), F.max(F.length("sentence")).alias("longest"))


@NARRATIVE.add(
    "narrative_exact_coverage",
    _SENT.replace("WITH n AS", f"WITH {_FIL}, n AS") + """, x AS (SELECT passage_id, acc, unnest(sent) one FROM k), o AS (SELECT DISTINCT acc, one FROM x)
SELECT x.passage_id, count(*) total, count(o.one) matched FROM x JOIN pf ON pf.accession_number = x.acc AND pf.b IS NOT NULL AND pf.b[2] IS NOT NULL LEFT JOIN o ON o.acc = pf.b[2] AND o.one = x.one GROUP BY ALL""",
)
def narrative_exact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = materialize(narrative.sentence_table(_passages(spark, sf_dir)), "sentences")
    pairs = filings.prior_filing(_filings(spark, sf_dir)).where("prior_accession is not null").select("accession_number", "prior_accession")
    old = s.select(F.col("accession_number").alias("prior_accession"), "sentence", F.lit(1).alias("hit")).distinct()
    return s.join(pairs, "accession_number").join(old, ["prior_accession", "sentence"], "left").groupBy("passage_id").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = filings.prior_filing(_filings(spark, sf_dir)).select("accession_number", "prior_accession")
    return narrative.passage_changes(_passages(spark, sf_dir).where("accession_number is not null"), pairs)


@NARRATIVE.add("narrative_changes")
def narrative_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).drop("diff_summary")


_CAP = "SELECT accession_number, topic, passage_id, rank::INT rank FROM (SELECT *, row_number() OVER (PARTITION BY accession_number, topic ORDER BY CASE status WHEN 'new' THEN 0 WHEN 'revised' THEN 1 WHEN 'unestablished' THEN 2 ELSE 3 END, similarity ASC NULLS FIRST, chunk_id ASC NULLS FIRST, passage_id) rank FROM j) WHERE rank <= 12"


@NARRATIVE.add(
    "narrative_flags_capped",
    f"""WITH c AS (SELECT passage_id, lower(trim(min(status))) status, min(CASE WHEN isnan(similarity) THEN NULL ELSE similarity END) similarity FROM passage_changes GROUP BY passage_id),
j AS (SELECT {_ACC} accession_number, unnest(topics) topic, c.status, c.similarity, chunk_id, p.passage_id FROM narrative_passages p JOIN c USING (passage_id)) {_CAP}""",
)
def narrative_flags_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "passage_changes", "passage_id", "status", "similarity").groupBy("passage_id").agg(label(F.min("status")).alias("status"), F.min(F.when(~F.isnan("similarity"), F.col("similarity"))).alias("similarity"))
    p = table(spark, sf_dir, "narrative_passages", "passage_id", "accession_number", "chunk_id", "topics").select("passage_id", dashed_accession("accession_number").alias("accession_number"), "chunk_id", F.explode("topics").alias("topic"))
    return narrative.capped_by_topic(p.join(c, "passage_id")).select("accession_number", "topic", "passage_id", "rank")


@NARRATIVE.add(
    "narrative_litigation_preview",
    "WITH p AS (SELECT passage_id, text, lower(text) t FROM narrative_passages), f AS (SELECT passage_id, text, list_min(list_filter([" + ", ".join(f"instr(t, '{w}')" for w in narrative.TOPICS["LITIGATION"]) + "], lambda x: x > 0)) spot FROM p) SELECT passage_id, substr(text, greatest(spot - 100, 1), 400) preview FROM f WHERE spot IS NOT NULL",
)
def narrative_litigation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("passage_id", narrative.keyword_preview(F.col("text"), narrative.TOPICS["LITIGATION"]).alias("preview")).where("preview is not null")


@NARRATIVE.add("narrative_status_counts", "SELECT lower(trim(status)) status, count(*) n, count(DISTINCT passage_id) passages FROM passage_changes GROUP BY ALL")
def narrative_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "passage_changes", "status", "passage_id").groupBy(label("status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("passage_id").alias("passages"))


# ---- retrieval ---------------------------------------------------------------------------------------------------

QUERIES = [(1, "revenue growth and gross profit"), (2, "litigation complaint lease obligations"), (3, "inventory turns export licenses"), (4, "credit facility covenant waiver"), (5, "capital spending restructuring severance")]
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUERIES) + ") v(query_id, query))"


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def _bm25_sql(docs: str) -> str:
    return f"""WITH {_Q}, d AS ({docs}), tk AS (SELECT grp, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') t FROM d),
sz AS (SELECT grp, count(*) n, sum(len(t))::DOUBLE / count(*) avgdl FROM tk GROUP BY grp), df AS (SELECT grp, term, count(*) df FROM (SELECT grp, unnest(list_distinct(t)) term FROM tk) GROUP BY ALL),
ir AS (SELECT grp, term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) raw FROM df JOIN sz USING (grp)), mn AS (SELECT grp, sum(raw::DECIMAL(28, 12))::DOUBLE / count(*) mean FROM ir GROUP BY grp),
qt AS (SELECT query_id, term, count(*) qn FROM (SELECT query_id, unnest(string_split(query, ' ')) term FROM q) GROUP BY ALL), ix AS (SELECT ir.grp, ir.term, CASE WHEN raw < 0 THEN mean * 0.25::DOUBLE ELSE raw END idf FROM ir JOIN mn USING (grp)),
tf AS (SELECT grp, doc_id, dl, term, count(*) tf FROM (SELECT grp, doc_id, len(t) dl, unnest(t) term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
sc AS (SELECT tf.grp, query_id, doc_id, round(sum(round(qn * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 9)::DECIMAL(28, 9))::DOUBLE, 6) score FROM tf JOIN ix ON tf.grp = ix.grp AND tf.term = ix.term JOIN sz ON sz.grp = tf.grp JOIN qt ON qt.term = tf.term GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY grp, query_id ORDER BY score DESC, doc_id) - 1 rank FROM sc)
"""


_DOCS_SQL = "SELECT 0 grp, doc_id, text FROM documents"
_CHUNKS_SQL = f"SELECT coalesce({_ACC}, '') grp, chunk_key doc_id, text FROM chunks WHERE lower(trim(kind)) = 'prose'"


def _doc_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one group, 0 by an expression that the planner does not fold: it turns joins on a literal to products."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select(F.coalesce(F.pmod("doc_id", F.lit(1)), F.lit(0)).alias("grp"), "doc_id", "text")


def _chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks", "chunk_key", "accession_number", "kind", "text").where(label("kind") == "prose").select(F.coalesce(dashed_accession("accession_number"), F.lit("")).alias("grp"), F.col("chunk_key").alias("doc_id"), "text")


@RETRIEVAL.add("search_bm25_documents", _bm25_sql(_DOCS_SQL) + "SELECT query_id, doc_id, rank::INT rank, round(score, 4) score FROM tp WHERE rank < 10")
def search_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(retrieval.bm25(_doc_corpus(spark, sf_dir), _queries(spark)), 10, ["grp", "query_id"]).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@RETRIEVAL.add("search_bm25_filings", _bm25_sql(_CHUNKS_SQL) + "SELECT grp, query_id, doc_id, rank::INT rank FROM tp WHERE rank < 3")
def search_bm25_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(retrieval.bm25(_chunk_corpus(spark, sf_dir), _queries(spark)), 3, ["grp", "query_id"]).select("grp", "query_id", "doc_id", "rank")


_OVER = """ov AS (SELECT grp, query_id, doc_id, len(list_intersect(qs, ds))::DOUBLE / len(qs) score FROM (SELECT d.grp, q.query_id, d.doc_id, list_distinct(string_split(query, ' ')) qs, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) ds FROM d CROSS JOIN q)),
ot AS (SELECT *, row_number() OVER (PARTITION BY grp, query_id ORDER BY score DESC, doc_id) - 1 rank FROM ov WHERE score > 0)"""


def _overlap(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    s = corpus.join(F.broadcast(queries)).withColumn("score", retrieval.overlap(F.col("query"), F.col("text"))).where("score > 0")  # the query list is fixed
    return retrieval.top(s, 2**31 - 1, ["grp", "query_id"]).select("grp", "query_id", "doc_id", "score", "rank")


@RETRIEVAL.add(
    "search_fused_filings",
    _bm25_sql(_CHUNKS_SQL).rstrip() + f""", {_OVER}, u AS (SELECT grp, query_id, doc_id, rank FROM tp UNION ALL SELECT grp, query_id, doc_id, rank FROM ot),
f AS (SELECT grp, query_id, doc_id, round(sum((1.0::DOUBLE / (60 + rank))::DECIMAL(28, 15))::DOUBLE, 9) score FROM u GROUP BY ALL) SELECT grp, query_id, doc_id, rank::INT rank, score FROM (SELECT *, row_number() OVER (PARTITION BY grp, query_id ORDER BY score DESC, doc_id) - 1 rank FROM f) WHERE rank < 5""",
)
def search_fused_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, q = _chunk_corpus(spark, sf_dir), _queries(spark)
    sparse = retrieval.top(retrieval.bm25(corpus, q), 2**31 - 1, ["grp", "query_id"])
    return retrieval.fuse([sparse, _overlap(corpus, q)], ["grp", "query_id"], 5).select("grp", "query_id", "doc_id", "rank", "score")


@RETRIEVAL.add("search_reranked_filings", f"WITH {_Q}, d AS ({_CHUNKS_SQL}), {_OVER} SELECT grp, query_id, doc_id, rank::INT rank, score FROM ot WHERE rank < 5")
def search_reranked_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(_chunk_corpus(spark, sf_dir), _queries(spark)).where("rank < 5")


# The same searches with every row whose id is divisible by 100 as a query, against all rows but itself.

_BLANK = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


def _rows_sql(docs: str) -> str:
    """_bm25_sql with the queries taken from docs."""
    whole = _bm25_sql(docs).replace(_Q + ", ", "").replace("qt AS", "q AS (SELECT doc_id query_id, text query FROM d WHERE doc_id % 100 = 0), qt AS")
    return whole.replace("string_split(query, ' ')", _BLANK.format("query")).replace("FROM sc)", "FROM sc WHERE query_id <> doc_id)")


_ROWS_OVER = f"""qd AS (SELECT query_id, list_distinct({_BLANK.format("query")}) qs FROM q), dd AS (SELECT grp, doc_id, list_distinct({_BLANK.format("text")}) ds FROM d),
ov AS (SELECT grp, query_id, doc_id, len(list_intersect(qs, ds))::DOUBLE / len(qs) score FROM dd JOIN qd ON query_id <> doc_id WHERE len(qs) > 0),
ot AS (SELECT *, row_number() OVER (PARTITION BY grp, query_id ORDER BY score DESC, doc_id) - 1 rank FROM ov WHERE score > 0)"""


def _row_queries(corpus: DataFrame) -> DataFrame:
    return corpus.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _others(scored: DataFrame) -> DataFrame:
    return scored.where("query_id != doc_id")


def _rows_ranked(kind: str, corpus: DataFrame, k: int, most: int = blocks.LARGE_GROUP) -> DataFrame:
    """(grp, query_id, doc_id, rank, score) of the k best of each group for the corpus' own queries. Groups of more than
    most documents are ranked in parts; by fused, which takes whole rankings, as joins."""
    q, large = _row_queries(corpus), blocks.large_groups(corpus, most)
    cols = ["grp", "query_id", "doc_id", "rank", "score"]
    out = blocks.rank_groups(kind, corpus.where(~F.col("grp").isin(large)) if large else corpus, q, k).select(*cols)
    if large and kind == "fused":
        docs = corpus.where(F.col("grp").isin(large))
        ranked = [retrieval.top(_others(s), 2**31 - 1, ["grp", "query_id"]) for s in (retrieval.bm25(docs, q, few=False), retrieval.overlap_by_term(docs, q))]
        return out.unionByName(retrieval.fuse(ranked, ["grp", "query_id"], k).select(*cols))
    for grp in large:
        out = out.unionByName(blocks.rank_corpus(kind, corpus.where(F.col("grp") == grp), q, k).withColumn("grp", F.lit(grp)).select(*cols))
    return out


@RETRIEVAL.add("search_bm25_documents_rows", _rows_sql(_DOCS_SQL) + "SELECT query_id, doc_id, rank::INT rank, round(score::DECIMAL(28, 6), 4)::DOUBLE score FROM tp WHERE rank < 10")
def search_bm25_documents_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _doc_corpus(spark, sf_dir)
    best = blocks.rank_corpus("bm25", corpus, _row_queries(corpus), 10)
    return best.select("query_id", "doc_id", "rank", F.round(F.col("score").cast("decimal(28,6)"), 4).cast("double").alias("score"))


@RETRIEVAL.add("search_bm25_filings_rows", _rows_sql(_CHUNKS_SQL) + "SELECT grp, query_id, doc_id, rank::INT rank FROM tp WHERE rank < 3")
def search_bm25_filings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_ranked("bm25", _chunk_corpus(spark, sf_dir), 3).select("grp", "query_id", "doc_id", F.col("rank").cast("int").alias("rank"))


@RETRIEVAL.add(
    "search_fused_filings_rows",
    _rows_sql(_CHUNKS_SQL).rstrip() + f""", {_ROWS_OVER}, u AS (SELECT grp, query_id, doc_id, rank FROM tp UNION ALL SELECT grp, query_id, doc_id, rank FROM ot),
f AS (SELECT grp, query_id, doc_id, round(sum((1.0::DOUBLE / (60 + rank))::DECIMAL(28, 15))::DOUBLE, 9) score FROM u GROUP BY ALL) SELECT grp, query_id, doc_id, rank::INT rank, score FROM (SELECT *, row_number() OVER (PARTITION BY grp, query_id ORDER BY score DESC, doc_id) - 1 rank FROM f) WHERE rank < 5""",
)
def search_fused_filings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_ranked("fused", _chunk_corpus(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("int"))


@RETRIEVAL.add("search_reranked_filings_rows", f"WITH d AS ({_CHUNKS_SQL}), q AS (SELECT doc_id query_id, text query FROM d WHERE doc_id % 100 = 0), {_ROWS_OVER} SELECT grp, query_id, doc_id, rank::INT rank, score FROM ot WHERE rank < 5")
def search_reranked_filings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_ranked("overlap", _chunk_corpus(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("int"))


_VOCAB = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]{2,}')) term FROM documents), p AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY ALL),
v AS (SELECT term, sum(tf)::BIGINT n, count(*) df FROM p GROUP BY ALL ORDER BY n DESC, term LIMIT 256), vi AS (SELECT term, n, df, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1 idf FROM v)
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


@RETRIEVAL.add("search_tfidf_vocabulary", _VOCAB + "SELECT term, n, df, round(idf, 6) idf FROM vi")
def search_tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vocabulary(_texts(spark, sf_dir)).select("term", "n", "df", F.round("idf", 6).alias("idf"))


@RETRIEVAL.add(
    "search_tfidf_vectors",
    _VOCAB + ", w AS (SELECT p.doc_id, p.term, p.tf * vi.idf w FROM p JOIN vi USING (term)), m AS (SELECT *, sqrt((sum((w * w)::DECIMAL(38, 12)) OVER (PARTITION BY doc_id))::DOUBLE) norm FROM w) SELECT doc_id, count(*) terms, round(sum(round(w / norm, 9)::DECIMAL(28, 9))::DOUBLE, 5) total FROM m GROUP BY ALL",
)
def search_tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    v = retrieval.tfidf(docs, retrieval.vocabulary(docs))
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum(F.round("weight", 9).cast("decimal(28,9)")).cast("double"), 5).alias("total"))


@RETRIEVAL.add(
    "search_vectors",
    """WITH s AS (SELECT q.vec_id query_id, d.vec_id doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, doc_id, rank::INT rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 rank FROM s) WHERE rank < 10""",
)
def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.nearest_vectors(e.where("id % 100 = 0"), e, 10).select("query_id", "doc_id", "rank")


@RETRIEVAL.add(
    "search_precision",
    _bm25_sql(_DOCS_SQL) + """, r AS (SELECT query_id, doc_id FROM q CROSS JOIN (SELECT doc_id, lower(coalesce(text, '')) t FROM documents) WHERE contains(t, string_split(query, ' ')[1]) AND contains(t, string_split(query, ' ')[2]))
SELECT count(*) returned, count(r.doc_id) relevant, count(r.doc_id) * 100.0 / count(*) precision_pct FROM (SELECT * FROM tp WHERE rank < 10) h LEFT JOIN r ON r.query_id = h.query_id AND r.doc_id = h.doc_id""",
)
def search_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, q = _doc_corpus(spark, sf_dir), _queries(spark)
    hits = retrieval.top(retrieval.bm25(corpus, q), 10, ["grp", "query_id"]).select("query_id", F.col("doc_id").alias("hit"))
    words, low = F.split("query", " "), F.lower(F.coalesce("text", F.lit("")))
    # Only the hits, ten a query of the fixed list, are judged: relevant pairs of all documents grow with the corpus. Each hit is a document, so none is lost.
    found = corpus.join(F.broadcast(hits), F.col("doc_id").eqNullSafe(F.col("hit"))).join(F.broadcast(q), "query_id")
    relevant = low.contains(F.get(words, F.lit(0))) & low.contains(F.get(words, F.lit(1))) & F.col("hit").isNotNull()
    return retrieval.precision(found.groupBy("query_id", "hit").agg(F.max(F.when(relevant, 1)).alias("ok")))


# ---- evaluation, records, streams, general tables ----------------------------------------------------------------


_CASES = _CANON + """, jj AS (SELECT row_number() OVER () rn, payload::JSON j FROM raw_records WHERE json_valid(payload)), jc AS (SELECT rn, CASE json_type(j->'$.numeric_cases') WHEN 'ARRAY' THEN j->'$.numeric_cases' ELSE json_array(j->'$.numeric_cases') END cs FROM jj WHERE json_type(j) = 'OBJECT' AND json_type(j->'$.numeric_cases') IN ('ARRAY', 'OBJECT')),
ki AS (SELECT rn, cs, unnest(range(json_array_length(cs)::BIGINT))::INT i FROM jc), k AS (SELECT rn, i, cs->i one FROM ki WHERE json_type(cs->i) = 'OBJECT'),
kk AS (SELECT rn, i, one->>'$.case_id' case_id, try_cast(trim(one->>'$.cik') AS BIGINT) company, one->>'$.accession_number' accession_number, one->'$.required_concepts' rq, one->'$.expected_facts' ef FROM k),
xf AS (SELECT case_id, company, unnest(CASE WHEN json_type(ef) = 'ARRAY' AND json_array_length(ef) > 0 THEN ef->'$[*]' WHEN json_type(ef) = 'OBJECT' THEN [ef] ELSE [NULL::JSON] END) f FROM kk)
"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric cases of the benchmarks (case_no, case_id, company, accession_number, required, facts); bare values are
    lists of one."""
    d = table(spark, sf_dir, "raw_records", "payload").select(F.monotonically_increasing_id().alias("record_no"), F.from_json("payload", "struct<numeric_cases:string>").alias("d"))
    case = "struct<case_id:string,cik:string,accession_number:string,required_concepts:string,expected_facts:string>"
    k = d.select("record_no", F.posexplode(json_list("d.numeric_cases", case)).alias("at", "k")).where("k is not null")
    return k.select(F.struct("record_no", "at").alias("case_no"), "k.case_id", company_number("k.cik").alias("company"), F.col("k.accession_number").alias("accession_number"),
                    json_list("k.required_concepts", "string").alias("required"), json_list("k.expected_facts", "struct<concept:string,fiscal_year:string,fiscal_period:string,value:string>").alias("facts"))


@OTHER.add(
    "eval_numeric_accuracy",
    _CASES + """SELECT x.case_id, count(f->>'$.concept') expected, count(cf.val) found, count(*) FILTER (WHERE abs(cf.val - try_cast(f->>'$.value' AS DOUBLE)) <= 0.5) correct FROM xf x LEFT JOIN cf ON cf.company = x.company AND cf.concept = lower(trim(f->>'$.concept')) AND cf.fiscal_year = try_cast(f->>'$.fiscal_year' AS INT) AND cf.fiscal_period = upper(trim(f->>'$.fiscal_period')) GROUP BY x.case_id""",
)
def eval_numeric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir).select("case_id", "company", F.explode_outer("facts").alias("f"))
    expected = cases.select("case_id", "company", label("f.concept").alias("concept"), F.col("f.fiscal_year").try_cast("int").alias("fiscal_year"), F.upper(label("f.fiscal_period")).alias("fiscal_period"), F.col("f.value").try_cast("double").alias("expected"))
    return records.numeric_accuracy(expected, _canon(spark, sf_dir), 0.5)


@OTHER.add(
    "eval_case_coverage",
    _CASES + """, rc AS (SELECT rn, i, case_id, company, accession_number, unnest(CASE WHEN json_type(rq) = 'ARRAY' AND json_array_length(rq) > 0 THEN list_distinct(list_transform(rq->>'$[*]', lambda x: lower(trim(x)))) WHEN json_type(rq) = 'VARCHAR' THEN [lower(trim(rq->>'$'))] ELSE [NULL] END) concept FROM kk),
h AS (SELECT DISTINCT company, accession_number, concept FROM cf), g AS (SELECT rc.rn, rc.i, case_id, count(rc.concept) required, count(h.concept) available FROM rc LEFT JOIN h ON h.company = rc.company AND h.accession_number = rc.accession_number AND h.concept = rc.concept GROUP BY ALL)
SELECT case_id, required, available, CASE WHEN required = 0 THEN 0 ELSE available / required * 100 END::DOUBLE rate FROM g""",
)
def eval_case_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir).withColumn("required", F.array_distinct(F.array_compact(F.transform("required", label))))
    return records.case_coverage(cases, _canon(spark, sf_dir))


@OTHER.add(
    "eval_citation_support",
    """WITH c AS (SELECT passage_id, accession_number, chunk_id, text FROM narrative_passages WHERE chunk_id IS NOT NULL AND accession_number IS NOT NULL), k AS (SELECT accession_number || '/' || chunk_id cid, max(text) text FROM c GROUP BY ALL)
SELECT ch.accession_number || '/' || ch.chunk_id || '#' || ch.passage_id::VARCHAR claim_id, (k.text IS NOT NULL AND contains(lower(k.text), lower(left(ch.diff_summary, 20)))) supported FROM (SELECT passage_id, min(accession_number) accession_number, min(prior_chunk_id) chunk_id, min(diff_summary) diff_summary FROM passage_changes WHERE prior_chunk_id IS NOT NULL AND diff_summary IS NOT NULL GROUP BY passage_id) ch
LEFT JOIN k ON k.cid = ch.accession_number || '/' || ch.chunk_id WHERE ch.accession_number IS NOT NULL""",
)
def eval_citation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("accession_number", F.lit("/"), "chunk_id")
    chunks = table(spark, sf_dir, "narrative_passages", "accession_number", "chunk_id", "text").select(key.alias("chunk_id"), "text").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    ch = table(spark, sf_dir, "passage_changes", "passage_id", "accession_number", "prior_chunk_id", "diff_summary").where("prior_chunk_id is not null and diff_summary is not null").groupBy("passage_id").agg(F.min("accession_number").alias("accession_number"), F.min("prior_chunk_id").alias("chunk_id"), F.min("diff_summary").alias("d")).where("accession_number is not null")
    claims = ch.select(F.concat(key, F.lit("#"), F.col("passage_id").cast("string")).alias("claim_id"), F.array(key).alias("cited"), F.array(F.substring("d", 1, 20)).alias("phrases"))
    return records.citation_support(claims, chunks)


@OTHER.add(
    "eval_citation_whole_phrases",
    """WITH c AS (SELECT accession_number || '/' || chunk_id cid, string_agg(text, ' ' ORDER BY text) text FROM (SELECT DISTINCT accession_number, chunk_id, text FROM narrative_passages) WHERE text IS NOT NULL GROUP BY ALL),
ch AS (SELECT DISTINCT passage_id, accession_number || '/' || prior_chunk_id cid, diff_summary phrase FROM passage_changes WHERE accession_number IS NOT NULL AND prior_chunk_id IS NOT NULL AND diff_summary IS NOT NULL)
SELECT ch.cid || '#' || coalesce(passage_id::VARCHAR, '') || '#' || md5(phrase) claim_id, (c.text IS NOT NULL AND contains(lower(c.text), lower(phrase))) supported FROM ch LEFT JOIN c ON c.cid = ch.cid""",
)
def eval_citation_whole_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct change of a passage is a claim, its whole summary the phrase."""
    p = table(spark, sf_dir, "narrative_passages", "accession_number", "chunk_id", "text").distinct().where("text is not null")
    chunks = p.select(F.concat("accession_number", F.lit("/"), "chunk_id").alias("chunk_id"), "text").where("chunk_id is not null").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    ch = table(spark, sf_dir, "passage_changes", "passage_id", "accession_number", "prior_chunk_id", "diff_summary").where("accession_number is not null and prior_chunk_id is not null and diff_summary is not null").distinct()
    key = F.concat("accession_number", F.lit("/"), "prior_chunk_id")
    claims = ch.select(F.concat(key, F.lit("#"), F.coalesce(F.col("passage_id").cast("string"), F.lit("")), F.lit("#"), F.md5("diff_summary")).alias("claim_id"), F.array(key).alias("cited"), F.array("diff_summary").alias("phrases"))
    return records.citation_support(claims, chunks)


@OTHER.add(
    "eval_report",
    _CASES + """, na AS (SELECT count(f->>'$.concept') d, count(*) FILTER (WHERE abs(cf.val - try_cast(f->>'$.value' AS DOUBLE)) <= 0.5) n FROM xf x LEFT JOIN cf ON cf.company = x.company AND cf.concept = lower(trim(f->>'$.concept')) AND cf.fiscal_year = try_cast(f->>'$.fiscal_year' AS INT) AND cf.fiscal_period = upper(trim(f->>'$.fiscal_period'))),
rc AS (SELECT rn, i, company, accession_number, unnest(list_distinct(list_transform(rq->>'$[*]', lambda x: lower(trim(x))))) concept FROM kk WHERE json_type(rq) = 'ARRAY' UNION ALL SELECT rn, i, company, accession_number, lower(trim(rq->>'$')) FROM kk WHERE json_type(rq) = 'VARCHAR'),
h AS (SELECT DISTINCT company, accession_number, concept FROM cf), cv AS (SELECT count(rc.concept) d, count(h.concept) n FROM rc LEFT JOIN h ON h.company = rc.company AND h.accession_number = rc.accession_number AND h.concept = rc.concept)
SELECT 'numeric_accuracy_pct' metric, CASE WHEN d > 0 THEN n / d * 100 END::DOUBLE AS value, 100.0::DOUBLE target, n / d * 100 >= 100 passed, n::DOUBLE numerator, d::DOUBLE denominator FROM na UNION ALL SELECT 'coverage_pct', CASE WHEN d > 0 THEN n / d * 100 END::DOUBLE, 90.0::DOUBLE, n / d * 100 >= 90, n::DOUBLE, d::DOUBLE FROM cv
UNION ALL SELECT * FROM (VALUES ('precision_pct', NULL::DOUBLE, 85.0::DOUBLE, NULL::BOOLEAN, NULL::DOUBLE, NULL::DOUBLE), ('citation_support_pct', NULL, 90.0, NULL, NULL, NULL), ('latency_max_s', NULL, 600.0, NULL, NULL, NULL))""",
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and coverage of the benchmarks; what they carry no labels for stays unmeasured."""
    figures = eval_numeric_accuracy(spark, sf_dir).agg(F.sum("correct").alias("numerator"), F.sum("expected").alias("denominator"))
    cover = eval_case_coverage(spark, sf_dir).agg(F.sum("available").alias("numerator"), F.sum("required").alias("denominator"))
    return records.evaluation_report(numeric_accuracy_pct=figures, coverage_pct=cover)


_REC = f"""WITH {_EV}, one AS (SELECT accession_number, arg_min(company, event_id) company, arg_min(form, event_id) form, arg_min(filing_date, event_id) filing_date FROM ev WHERE accession_number IS NOT NULL GROUP BY ALL),
n AS (SELECT {_ACC} accession_number, count(*) FILTER (WHERE lower(trim(status)) <> 'unchanged') notable FROM passage_changes GROUP BY ALL)
SELECT one.accession_number, lpad(company::VARCHAR, 10, '0') company_cik, form, filing_date, coalesce(notable, 0) notable FROM one LEFT JOIN n USING (accession_number) WHERE coalesce(notable, 0) > 0 ORDER BY filing_date DESC NULLS LAST, accession_number DESC LIMIT 50"""


@OTHER.add("records_listing", _REC)
def records_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = records.first_row(_events(spark, sf_dir).where("accession_number is not null"), ["accession_number"], F.col("event_id"))
    severity = F.when(label("status") == "unchanged", "routine").otherwise("notable")
    flags = table(spark, sf_dir, "passage_changes", "accession_number", "status").where("status is not null").groupBy(dashed_accession("accession_number").alias("accession_number")).agg(F.collect_list(F.struct(severity.alias("severity"))).alias("flags"))
    rec = one.join(flags, "accession_number", "left").withColumn("company_cik", padded_cik(F.col("company").cast("string")))
    return records.list_records(rec, notable_only=True, limit=50)[1].select("accession_number", "company_cik", "form", "filing_date", F.col("notable").cast("bigint").alias("notable"))


@OTHER.add("stream_event_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) n FROM events GROUP BY ALL")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poll.closed_windows(spark, f"{sf_dir}/events.parquet", "ts", "1 day", "event_type").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


_QTR = """WITH b AS (SELECT s.s_nationkey company, c.concept, year(l.l_shipdate) fiscal_year, 'Q' || quarter(l.l_shipdate) fiscal_period, CASE c.concept WHEN 'revenue' THEN l.l_extendedprice ELSE l.l_extendedprice * l.l_discount END v FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey CROSS JOIN (VALUES ('revenue'), ('net_income')) c(concept)),
cf AS (SELECT company, concept, fiscal_year, fiscal_period, sum(round(v, 4)::DECIMAL(18, 4))::DOUBLE val FROM b GROUP BY ALL)
"""


@OTHER.add("orders_quarters_year_over_year", _QTR + f"SELECT c.company, c.concept, c.fiscal_year, c.fiscal_period, c.val current_value, p.val prior_value, round({_PCT.split(' percent_change')[0]}, 6) percent_change FROM cf c JOIN cf p ON c.company = p.company AND c.concept = p.concept AND c.fiscal_period = p.fiscal_period AND c.fiscal_year = p.fiscal_year + 1")
def orders_quarters_year_over_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s = table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate"), table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    both = F.explode(F.array(F.struct(F.lit("revenue").alias("concept"), F.col("l_extendedprice").alias("v")), F.struct(F.lit("net_income").alias("concept"), (F.col("l_extendedprice") * F.col("l_discount")).alias("v"))))
    q = l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("company"), F.year("l_shipdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("fiscal_period"), both.alias("b"))
    cf = q.groupBy("company", F.col("b.concept").alias("concept"), "fiscal_year", "fiscal_period").agg(F.sum(F.round("b.v", 4).cast("decimal(18,4)")).cast("double").alias("val"))
    return compare.year_over_year(cf).select("company", "concept", "fiscal_year", "fiscal_period", "current_value", "prior_value", F.round("percent_change", 6).alias("percent_change"))


@OTHER.add("docs_length_profile", "SELECT lower(trim(lang)) lang, count(*) n, count(text) texts, sum(length(trim(regexp_replace(text, '[\\s\\p{Z}\\x{b}\\x{85}]+', ' ', 'g'))))::BIGINT chars, count(*) FILTER (WHERE n_chars <> length(text)) stale FROM documents GROUP BY ALL")
def docs_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "lang", "text", "n_chars")
    return d.groupBy(label("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.sum(F.length(collapse_space("text"))).alias("chars"), F.count_if(F.col("n_chars") != F.length("text")).alias("stale"))


# ---- reports -----------------------------------------------------------------------------------------------------

_YOY = f"y AS (SELECT c.company, c.concept, c.fiscal_year, c.fiscal_period, c.val current_value, p.val prior_value, {_PCT} FROM cf c JOIN cf p ON c.company = p.company AND c.concept = p.concept AND c.fiscal_period = p.fiscal_period AND c.fiscal_year = p.fiscal_year + 1)"


@OTHER.add("report_large_changes", _CANON + f", {_YOY} SELECT company, concept, fiscal_year, fiscal_period, 'METRIC_CHANGE_THRESHOLD' rule_id, 'notable' severity FROM y WHERE abs(percent_change) >= 20")
def report_large_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = compare.year_over_year(_canon(spark, sf_dir))
    keys = ["company", "concept", "fiscal_year", "fiscal_period"]
    return report.threshold_flags(y, F.col("percent_change"), 20.0, "METRIC_CHANGE_THRESHOLD", F.col("concept"), F.col("fiscal_period"), keys).select(*keys, "rule_id", "severity")


@OTHER.add(
    "report_margin_moves",
    _CANON + """, m AS (SELECT n.company, n.fiscal_year, n.fiscal_period, n.concept, n.val / d.val * 100 pct FROM cf n JOIN cf d ON n.company = d.company AND n.fiscal_year = d.fiscal_year AND n.fiscal_period = d.fiscal_period WHERE d.concept = 'revenue' AND d.val <> 0 AND n.concept IN ('net_income', 'gross_profit', 'operating_income'))
SELECT c.company, c.concept, c.fiscal_year, c.fiscal_period, round(c.pct - p.pct, 6) points FROM m c JOIN m p ON c.company = p.company AND c.concept = p.concept AND c.fiscal_period = p.fiscal_period AND c.fiscal_year = p.fiscal_year + 1 WHERE abs(c.pct - p.pct) >= 5""",
)
def report_margin_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = compare.margins(_canon(spark, sf_dir), ["net_income", "gross_profit", "operating_income"]).withColumnRenamed("margin_pct", "val")
    return compare.year_over_year(m).where(F.abs("absolute_change") >= 5).select("company", "concept", "fiscal_year", "fiscal_period", F.round("absolute_change", 6).alias("points"))


@OTHER.add(
    "report_metric_rows",
    _CANON + f", {_YOY} SELECT company, concept, fiscal_year, fiscal_period, current_value, prior_value, NULL::VARCHAR note FROM y UNION ALL SELECT company, concept, fiscal_year, fiscal_period, val, NULL, 'No comparable prior figure' FROM cf WHERE (company, concept, fiscal_year, fiscal_period) NOT IN (SELECT (company, concept, fiscal_year, fiscal_period) FROM y)",
)
def report_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _canon(spark, sf_dir)
    return report.metric_rows(f, compare.year_over_year(f)).drop("percent_change")


@OTHER.add(
    "report_provenance",
    _CANON + "SELECT concept, CASE WHEN source = 'html_table_fallback' THEN 'html_table_fallback' WHEN starts_with(source_tag, 'derived:') THEN 'derived' WHEN source IS NOT NULL THEN 'xbrl' ELSE 'unknown' END provenance, count(*) n FROM cf GROUP BY ALL",
)
def report_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canon(spark, sf_dir).groupBy("concept", report.provenance(F.col("source"), F.coalesce("source_tag", F.lit(""))).alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


@OTHER.add("report_memos")
def report_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _canon(spark, sf_dir)
    y = compare.year_over_year(f)
    flags = report.threshold_flags(y, F.col("percent_change"), 20.0, "METRIC_CHANGE_THRESHOLD", F.col("concept"), F.concat_ws(" ", "fiscal_year", "fiscal_period"), ["company"])
    return report.memo_markdown(report.metric_rows(f, y), flags, "company")
