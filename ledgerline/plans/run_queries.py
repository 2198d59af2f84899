"""Queries over whole runs: filings processed by one plan, and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.normalize import bare_tag, company_number, dashed_accession, label, usable
from ledgerline.operators import compare, documents, facts, filing_run, filings, records, retrieval
from ledgerline.plans.domain_queries import _ACC, _CANON, _PEERS, _Q, _aligned, _blocks, _queries
from ledgerline.plans.registry import Registry
from ledgerline.plans.text_queries import _FILED, POOL, _filed_chunks, _hybrid_sql
from ledgerline.session import materialize, shared_path
from ledgerline.sources.tables import table
from ledgerline.streaming import poll

RUN = Registry()
REGISTRIES = [RUN]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each accession."""
    e = table(spark, sf_dir, "filing_events", "event_id", "company_cik", "accession_number", "form", "filing_date", "report_date").select(
        "event_id", company_number("company_cik").alias("company"), dashed_accession("accession_number").alias("accession_number"), F.upper(F.trim("form")).alias("form"), "filing_date", "report_date")
    return records.first_row(e.where("accession_number is not null"), ["accession_number"], F.col("event_id"))


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = filing_run.with_year_end_debt(facts.normalized_facts(table(spark, sf_dir, "financial_facts"), table(spark, sf_dir, "tag_map")).where(F.col("concept").isin(*facts.CONCEPTS)))
    periods = materialize(filing_run.filing_periods(_events(spark, sf_dir), held), "periods")  # used by figures and records
    return periods, filing_run.filing_figures(periods, held)


_RUN = _CANON.split("cf AS (")[0].rstrip().rstrip(",") + f""", nf0 AS (SELECT fx.*, priority FROM fx LEFT JOIN pr ON fx.concept = pr.concept AND fx.tag = pr.tag WHERE company IS NOT NULL AND fiscal_year IS NOT NULL AND fiscal_period IS NOT NULL AND fx.concept IN ('revenue', 'net_income', 'gross_profit', 'total_debt', 'operating_income')),
nf AS (SELECT *, 0 copied FROM nf0 UNION ALL SELECT * REPLACE ('FY' AS fiscal_period), 1 FROM nf0 WHERE concept = 'total_debt' AND fiscal_period = 'Q4'),
ev AS (SELECT event_id, try_cast(trim(company_cik) AS BIGINT) company, {_ACC} acc, upper(trim(form)) form, filing_date, report_date FROM filing_events),
e1 AS (SELECT * FROM ev WHERE acc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY acc ORDER BY event_id) = 1),
pe AS (SELECT * FROM e1 WHERE form IN ('10-K', '10-Q', '10-K/A', '10-Q/A')),
may AS (SELECT DISTINCT pe.acc, pe.company, pe.form, pe.filing_date, pe.report_date, nf.fiscal_year, nf.fiscal_period FROM pe JOIN nf ON nf.company = pe.company AND nf.accession_number = pe.acc AND nf.period_end_date = pe.report_date WHERE nf.concept <> 'total_debt'),
ow AS (SELECT may.*, nf.concept, nf.accession_number, nf.period_end_date FROM may JOIN nf ON nf.company = may.company AND nf.fiscal_year = may.fiscal_year AND nf.fiscal_period = may.fiscal_period AND nf.filed_date <= may.filing_date AND nf.concept <> 'total_debt'
  QUALIFY row_number() OVER (PARTITION BY may.acc, nf.concept, may.fiscal_year, may.fiscal_period ORDER BY copied, priority NULLS LAST, nf.filed_date DESC, fact_id) = 1),
ca AS (SELECT acc, count(DISTINCT (fiscal_year, fiscal_period)) n, min(fiscal_year) fy, min(fiscal_period) fp FROM ow WHERE accession_number = acc AND period_end_date = report_date AND (form NOT LIKE '10-K%' OR fiscal_period = 'FY') GROUP BY acc),
pd AS (SELECT e1.*, CASE WHEN n = 1 THEN fy END fy, CASE WHEN n = 1 THEN fp END fp, CASE WHEN e1.acc IN (SELECT acc FROM pe) AND coalesce(n, 0) <> 1 THEN 'no single period of the filing''s own facts' END error FROM e1 LEFT JOIN ca ON ca.acc = e1.acc),
wa AS (SELECT acc, company, filing_date, report_date, 'current' AS role, fy, fp FROM pd WHERE fp IS NOT NULL UNION ALL SELECT acc, company, filing_date, report_date, 'year', fy - 1, fp FROM pd WHERE fp IS NOT NULL
  UNION ALL SELECT acc, company, filing_date, report_date, 'quarter', CASE WHEN fp = 'Q1' THEN fy - 1 ELSE fy END, CASE fp WHEN 'Q1' THEN 'Q4' WHEN 'Q2' THEN 'Q1' WHEN 'Q3' THEN 'Q2' ELSE 'Q3' END FROM pd WHERE fp LIKE 'Q%'),
fg AS (SELECT * FROM (SELECT wa.*, nf.concept, nf.val, nf.accession_number, nf.period_end_date FROM wa JOIN nf ON nf.company = wa.company AND nf.fiscal_year = wa.fy AND nf.fiscal_period = wa.fp AND nf.filed_date <= wa.filing_date
  QUALIFY row_number() OVER (PARTITION BY wa.acc, wa.role, nf.concept ORDER BY copied, priority NULLS LAST, nf.filed_date DESC, fact_id) = 1) WHERE role <> 'current' OR (accession_number = acc AND period_end_date = report_date)),
cm AS (SELECT c.acc, c.concept, CASE p.role WHEN 'year' THEN 'YoY' ELSE 'QoQ' END comparison, c.val current_value, p.val prior_value, CASE WHEN p.val <> 0 THEN (c.val - p.val) / abs(p.val) * 100 END percent_change FROM fg c JOIN fg p ON c.acc = p.acc AND c.concept = p.concept WHERE c.role = 'current' AND p.role <> 'current'),
mg AS (SELECT n.acc, n.role, n.concept, n.val / r.val * 100 pct FROM fg n JOIN fg r ON r.acc = n.acc AND r.role = n.role AND r.concept = 'revenue' AND r.val <> 0 WHERE n.concept IN ('net_income', 'gross_profit', 'operating_income')),
mf AS (SELECT a.acc, a.concept FROM mg a JOIN mg b ON a.acc = b.acc AND a.concept = b.concept WHERE a.role = 'current' AND b.role = 'year' AND abs(a.pct - b.pct) >= 5)
"""


@RUN.add("pipeline_periods", _RUN + "SELECT acc accession_number, fy fiscal_year, fp fiscal_period, error FROM pd")
def pipeline_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0].select("accession_number", "fiscal_year", "fiscal_period", "error")


@RUN.add("pipeline_comparisons", _RUN + "SELECT acc accession_number, concept, comparison, current_value, prior_value, percent_change FROM cm")
def pipeline_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_run.filing_comparisons(_run(spark, sf_dir)[1]).select("accession_number", "concept", "comparison", "current_value", "prior_value", "percent_change")


@RUN.add("pipeline_flags", _RUN + "SELECT acc accession_number, 'METRIC_CHANGE_THRESHOLD' rule_id, count(*) n FROM cm WHERE abs(percent_change) >= 20 GROUP BY acc UNION ALL SELECT acc, 'MARGIN_THRESHOLD', count(*) FROM mf GROUP BY acc")
def pipeline_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(_run(spark, sf_dir)[1]).groupBy("accession_number", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def _flags(figures: DataFrame) -> DataFrame:
    return filing_run.metric_flags(filing_run.filing_comparisons(figures)).unionByName(filing_run.margin_flags(figures))


_RECORD = _RUN.rstrip() + """, hv AS (SELECT acc, list_sort(list(DISTINCT concept)) have FROM fg WHERE role = 'current' GROUP BY acc),
nt AS (SELECT acc, count(*) notable FROM (SELECT acc FROM cm WHERE abs(percent_change) >= 20 UNION ALL SELECT acc FROM mf) GROUP BY acc),
rc AS (SELECT pd.*, len(coalesce(have, [])) / 5 * 100 coverage_pct, array_to_string(list_filter(['gross_profit', 'net_income', 'operating_income', 'revenue', 'total_debt'], lambda x: NOT list_contains(coalesce(have, []), x)), ',') missing, coalesce(notable, 0) notable FROM pd LEFT JOIN hv ON hv.acc = pd.acc LEFT JOIN nt ON nt.acc = pd.acc)
SELECT acc accession_number, company, form, filing_date, fy fiscal_year, fp fiscal_period, error, coverage_pct, missing, notable FROM rc"""


@RUN.add("pipeline_records", _RECORD)
def pipeline_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods, figures = _run(spark, sf_dir)
    r = filing_run.run_records(periods, figures, _flags(figures))
    return r.select("accession_number", "company", "form", "filing_date", "fiscal_year", "fiscal_period", "error", "coverage_pct", F.array_join("missing", ",").alias("missing"), "notable")


@RUN.add("pipeline_polled", _RUN + "SELECT acc accession_number, error, error IS NULL acknowledged FROM pd")
def pipeline_polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run as a stream: every new accession processed, results written, and only those acknowledged that did not
    fail; the failed ones stay open for a later run."""
    held = filing_run.with_year_end_debt(facts.normalized_facts(table(spark, sf_dir, "financial_facts"), table(spark, sf_dir, "tag_map")).where(F.col("concept").isin(*facts.CONCEPTS)))

    def process(new: DataFrame) -> tuple[DataFrame, DataFrame]:
        e = new.select("accession_number", company_number("company_cik").alias("company"), F.upper(F.trim("form")).alias("form"), "filing_date", "report_date")
        p = filing_run.filing_periods(e, held).select("accession_number", "error")
        return p, p.where("error is null")

    events = poll.stream_table(spark, f"{sf_dir}/filing_events.parquet", 64).withColumn("accession_number", dashed_accession("accession_number"))
    done, out, state = (shared_path(spark, f"run-{x}") for x in ("done", "out", "state"))
    poll.poll_filings(events, process, done, out, state)
    told = spark.read.option("basePath", out).parquet(out).select("accession_number", "error")
    return told.join(poll.read_completed(spark, done).withColumn("ok", F.lit(True)), "accession_number", "left").select("accession_number", "error", F.coalesce("ok", F.lit(False)).alias("acknowledged"))


# ---- nested facts parsed -----------------------------------------------------------------------------------------

# The rules over flat rows: start from the label's duration, context from the accession's latest end, quarters counted back.
_PARSED = f"""WITH o AS (SELECT try_cast(trim(company_cik) AS BIGINT) company, {_ACC} accn, string_split(source_tag, ':')[-1] tag, upper(trim(fiscal_period)) fp, fiscal_year fy, period_end_date e, CASE WHEN lower(trim(concept)) = 'total_debt' THEN NULL ELSE period_end_date - CASE WHEN lower(trim(fiscal_period)) = 'fy' THEN 364 ELSE 90 END END s, val, filed_date filed, fact_id
  FROM financial_facts WHERE source_tag IS NOT NULL AND period_end_date IS NOT NULL AND fiscal_year IS NOT NULL AND upper(trim(fiscal_period)) IN ('FY', 'Q1', 'Q2', 'Q3', 'Q4')),
oo AS (SELECT *, row_number() OVER (PARTITION BY company, accn, tag ORDER BY fact_id) pos FROM o WHERE company IS NOT NULL AND accn IS NOT NULL),
cx AS (SELECT company, accn, e re, fy rfy, fp rfp FROM oo QUALIFY row_number() OVER (PARTITION BY company, accn ORDER BY e DESC, tag, pos) = 1),
tg AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{t}', {p})" for c, t, p in facts.TAG_PRIORITY)}) v(concept, tag, priority)),
b AS (SELECT oo.company, oo.accn, concept, oo.tag, priority, e, s, val, filed, pos, rfy * 4 + CASE WHEN rfp = 'FY' THEN 4 ELSE substr(rfp, 2, 1)::INT END - 1 - round((re - e) / 91.3125)::INT idx, (re - e) back FROM oo JOIN tg ON oo.tag = tg.tag JOIN cx ON cx.company = oo.company AND cx.accn = oo.accn
  WHERE val IS NOT NULL AND isfinite(val) AND (concept = 'total_debt') = (s IS NULL)),
p AS (SELECT *, (idx // 4)::INT fiscal_year, CASE WHEN s IS NOT NULL AND e - s BETWEEN 330 AND 380 THEN CASE WHEN idx % 4 = 3 THEN 'FY' END WHEN s IS NULL OR e - s BETWEEN 75 AND 105 THEN 'Q' || (idx % 4 + 1)::INT::VARCHAR END fiscal_period FROM b WHERE back >= 0 AND abs(back - round(back / 91.3125) * 91.3125) <= 25),
r AS (SELECT * FROM p WHERE fiscal_period IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company, concept, fiscal_year, fiscal_period, priority ORDER BY filed DESC NULLS LAST, pos, accn) = 1),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY company, concept, fiscal_year, fiscal_period ORDER BY priority) = 1),
q AS (SELECT company, concept, fiscal_year, max(val) FILTER (WHERE fiscal_period = 'FY') fv, max(e) FILTER (WHERE fiscal_period = 'FY') fe, max(val) FILTER (WHERE fiscal_period = 'Q1') v1, max(e) FILTER (WHERE fiscal_period = 'Q1') e1, max(val) FILTER (WHERE fiscal_period = 'Q2') v2, max(e) FILTER (WHERE fiscal_period = 'Q2') e2,
  max(val) FILTER (WHERE fiscal_period = 'Q3') v3, max(e) FILTER (WHERE fiscal_period = 'Q3') e3, max(val) FILTER (WHERE fiscal_period = 'Q4') v4 FROM f WHERE concept <> 'total_debt' GROUP BY ALL)
SELECT company, concept, fiscal_year, fiscal_period, val, e period_end_date FROM f UNION ALL
SELECT company, concept, fiscal_year, 'Q4', fv - v1 - v2 - v3, fe FROM q WHERE v4 IS NULL AND fv - v1 - v2 - v3 IS NOT NULL AND e2 - e1 BETWEEN 75 AND 105 AND e3 - e2 BETWEEN 75 AND 105 AND fe - e3 BETWEEN 75 AND 105"""


def _companyfacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as nested documents (payload), one for each company and accession: contexts are of accessions, so nothing
    needs a document larger than a filing."""
    t = table(spark, sf_dir, "financial_facts").where("source_tag is not null and period_end_date is not null and fiscal_year is not null")
    t = t.withColumns({"fp": F.upper(label("fiscal_period")), "accn": dashed_accession("accession_number"), "cik": company_number("company_cik"), "tag": bare_tag("source_tag")})
    t = t.where(F.col("fp").isin("FY", "Q1", "Q2", "Q3", "Q4") & F.col("cik").isNotNull() & F.col("accn").isNotNull())
    start = F.when(label("concept") == "total_debt", None).otherwise(F.date_sub("period_end_date", F.when(F.col("fp") == "FY", 364).otherwise(90)))
    one = F.struct(
        "fact_id", start.cast("string").alias("start"), F.col("period_end_date").cast("string").alias("end"), F.col("val").cast("string").alias("val"), F.col("fiscal_year").cast("string").alias("fy"), "fp",
        F.when(F.col("fp") == "FY", "10-K").otherwise("10-Q").alias("form"), F.col("filed_date").cast("string").alias("filed"), "accn")
    tags = t.groupBy("cik", "accn", "tag").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    body = F.struct("tag", F.struct(F.lit("x").alias("label"), F.create_map(F.lit("USD"), F.transform("rows", lambda r: r.dropFields("fact_id"))).alias("units")).alias("body"))
    docs = tags.groupBy("cik", "accn").agg(F.map_from_entries(F.array_sort(F.collect_list(body), lambda a, b: F.when(a["tag"] < b["tag"], -1).when(a["tag"] > b["tag"], 1).otherwise(0))).alias("m"))
    return docs.select(F.to_json(F.struct(F.col("cik").cast("string").alias("cik"), F.lit("").alias("entityName"), F.create_map(F.lit("us-gaap"), "m").alias("facts"))).alias("payload"))


@RUN.add("facts_parsed", _PARSED)
def facts_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents parsed: fiscal periods told from dates, revisions, tags, derived fourth quarters."""
    return facts.parse_facts(_companyfacts(spark, sf_dir)).select("company", "concept", "fiscal_year", "fiscal_period", "val", "period_end_date")


# ---- tables of documents -----------------------------------------------------------------------------------------

_HEAD = "Three months ended March 31, 2024"
_LABELLED = """CASE WHEN regexp_matches(lab, '\\btotal revenue|\\bnet revenue|^revenue[s]?$') THEN 'revenue' WHEN regexp_matches(lab, '\\bnet income|\\bnet loss') THEN 'net_income' WHEN regexp_matches(lab, '\\bgross profit') THEN 'gross_profit'
  WHEN regexp_matches(lab, '\\boperating income|\\bincome from operations') THEN 'operating_income' WHEN regexp_matches(lab, '^total debt$|^total borrowings$') THEN 'total_debt' END"""
_TABLED = f"""WITH t AS (SELECT chunk_key, {_ACC} doc, string_split(text, chr(10)) l FROM chunks WHERE lower(trim(kind)) = 'table' AND text IS NOT NULL),
s AS (SELECT *, lower(l[1] || ' {_HEAD}') cx FROM t), z AS (SELECT *, CASE WHEN contains(cx, 'thousands') THEN 1 ELSE 0 END + CASE WHEN contains(cx, 'millions') THEN 1 ELSE 0 END + CASE WHEN contains(cx, 'billions') THEN 1 ELSE 0 END k FROM s WHERE NOT (contains(cx, 'eur') OR contains(cx, 'gbp') OR contains(cx, 'cad') OR contains(cx, 'yen'))),
r AS (SELECT chunk_key, doc, CASE WHEN contains(cx, 'thousands') THEN 1e3 WHEN contains(cx, 'millions') THEN 1e6 WHEN contains(cx, 'billions') THEN 1e9 ELSE 1 END scale, i::INT row_pos, string_split(l[i + 1], ' | ') c FROM (SELECT *, unnest(range(1, len(l))) i FROM z WHERE k <= 1)),
v AS (SELECT chunk_key, doc, row_pos, lower(trim(c[1])) lab, trim(c[2]) cell, scale FROM r WHERE len(c) > 1),
g AS (SELECT chunk_key, doc, row_pos, {_LABELLED} concept, CASE WHEN cell LIKE '(%' AND cell LIKE '%)' THEN -1 ELSE 1 END * try_cast(regexp_replace(cell, '[(),$\\s]', '', 'g') AS DOUBLE) * scale val FROM v WHERE regexp_full_match(cell, '\\(?\\$?\\s*-?[\\d,]+(\\.\\d+)?\\)?')),
tf AS (SELECT * FROM g WHERE concept IS NOT NULL AND val IS NOT NULL)
"""


def _table_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the table chunks, each given the header its columns lack: (doc, block_order, row_pos, concept, val),
    block_order being the chunk's key."""
    t = table(spark, sf_dir, "chunks", "chunk_key", "accession_number", "kind", "text").where((label("kind") == "table") & F.col("text").isNotNull())
    lines = F.split("text", "\n")
    rows = F.concat(F.array(F.array(F.lit(""), F.lit(_HEAD))), F.transform(F.slice(lines, 2, 1 << 20), lambda x: F.split(x, r" \| ")))
    shaped = t.select(
        dashed_accession("accession_number").alias("doc"), F.col("chunk_key").alias("block_order"), F.get(lines, F.lit(0)).alias("caption"), rows.alias("rows"), F.lit(False).alias("complex_layout"),
        F.lit("Q1").alias("fiscal_period"), F.lit("2024-03-31").cast("date").alias("period_end_date"))
    return documents.table_facts(shaped)


@RUN.add("docs_table_facts", _TABLED + "SELECT chunk_key, row_pos, concept, val FROM tf")
def docs_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_figures(spark, sf_dir).select(F.col("block_order").alias("chunk_key"), "row_pos", "concept", "val")


@RUN.add("docs_gap_fill", _TABLED + f""", dc AS (SELECT DISTINCT doc FROM t WHERE doc IS NOT NULL), cn AS (SELECT DISTINCT lower(trim(concept)) concept FROM tag_map),
h AS (SELECT DISTINCT {_ACC} doc, lower(trim(concept)) concept FROM financial_facts WHERE val IS NOT NULL AND isfinite(val)),
ms AS (SELECT doc, concept FROM dc CROSS JOIN cn WHERE (doc, concept) NOT IN (SELECT (doc, concept) FROM h WHERE doc IS NOT NULL AND concept IS NOT NULL))
SELECT tf.doc, tf.concept, arg_min(val, (chunk_key, row_pos)) val FROM tf JOIN ms ON ms.doc = tf.doc AND ms.concept = tf.concept GROUP BY ALL""")
def docs_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tables of a filing add to its tagged facts."""
    found = _table_figures(spark, sf_dir).where("doc is not null")
    own = table(spark, sf_dir, "financial_facts", "accession_number", "concept", "val").where(usable("val")).select(dashed_accession("accession_number").alias("doc"), label("concept").alias("concept"), "val").where("doc is not null and concept is not null")
    docs = table(spark, sf_dir, "chunks", "accession_number", "kind", "text").where((label("kind") == "table") & F.col("text").isNotNull()).select(dashed_accession("accession_number").alias("doc")).where("doc is not null").distinct()
    targets = docs.select("doc", F.explode(F.array(*map(F.lit, facts.CONCEPTS))).alias("concept"))
    return documents.fill_gaps(own, found, targets).where("source = 'html_table_fallback'").select("doc", "concept", "val")


_MIXED = f"""WITH RECURSIVE u AS (SELECT coalesce({_ACC}, '') doc, block_order, block_id tie, 'prose' kind, coalesce(section, '(no heading)') section, text FROM prose_blocks WHERE text IS NOT NULL AND block_order IS NOT NULL
  UNION ALL SELECT coalesce({_ACC}, ''), source_orders[1], -chunk_key, 'table', coalesce(section, '(no heading)'), text FROM chunks WHERE lower(trim(kind)) = 'table' AND text IS NOT NULL AND len(source_orders) > 0 AND source_orders[1] IS NOT NULL),
b AS (SELECT *, length(text) n, CASE WHEN kind = 'table' THEN 'table:' || block_order || ':' || tie ELSE section END k, row_number() OVER (PARTITION BY doc ORDER BY block_order, tie) rn FROM u),
f AS (SELECT doc, rn, k, n::BIGINT size, 0 no FROM b WHERE rn = 1
  UNION ALL SELECT b.doc, b.rn, b.k, CASE WHEN f.size > 0 AND (f.k <> b.k OR f.size + b.n > 1500) THEN b.n ELSE f.size + b.n END, f.no + CASE WHEN f.size > 0 AND (f.k <> b.k OR f.size + b.n > 1500) THEN 1 ELSE 0 END FROM f JOIN b ON b.doc = f.doc AND b.rn = f.rn + 1)
SELECT f.doc, min(b.kind) || '-' || arg_min(b.block_order, b.rn)::VARCHAR chunk_id, min(b.kind) kind, min(b.section) section, string_agg(b.text, ' ' ORDER BY b.rn) text FROM f JOIN b ON b.doc = f.doc AND b.rn = f.rn GROUP BY f.doc, f.no"""


@RUN.add("docs_chunks_mixed", _MIXED)
def docs_chunks_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose blocks and the tables that stand among them, chunked again."""
    prose = _blocks(spark, sf_dir).select("doc", "block_order", "tie", F.lit("prose").alias("kind"), "section", "text", F.lit(None).cast("string").alias("caption"), F.lit(None).cast("array<array<string>>").alias("rows"))
    t = table(spark, sf_dir, "chunks", "chunk_key", "accession_number", "kind", "section", "text", "source_orders").where((label("kind") == "table") & F.col("text").isNotNull() & F.get("source_orders", F.lit(0)).isNotNull())
    lines = F.split("text", "\n")
    tables = t.select(
        F.coalesce(dashed_accession("accession_number"), F.lit("")).alias("doc"), F.get("source_orders", F.lit(0)).alias("block_order"), (-F.col("chunk_key")).alias("tie"), F.lit("table").alias("kind"), F.coalesce("section", F.lit(documents.NO_HEADING)).alias("section"), F.lit(None).cast("string").alias("text"),
        F.get(lines, F.lit(0)).alias("caption"), F.transform(F.slice(lines, 2, 1 << 20), lambda x: F.split(x, r" \| ")).alias("rows"))
    return documents.chunk_blocks(prose.unionByName(tables), ["doc"]).select("doc", "chunk_id", "kind", "section", "text")


# ---- peers with figures, listings, review ------------------------------------------------------------------------


@RUN.add("peers_table", _PEERS.rstrip() + """, fin AS (SELECT peer_row_id, any_value(CASE WHEN isfinite(revenue) THEN revenue END) revenue, any_value(CASE WHEN isfinite(net_income) THEN net_income END) net_income, any_value(CASE WHEN isfinite(gross_profit) THEN gross_profit END) gross_profit FROM peer_rows GROUP BY peer_row_id),
w AS (SELECT al.*, pc.accession_number acc, coalesce(pc.peer_ticker, pc.peer_cik) lab FROM al JOIN peer_comparisons pc USING (comparison_id))
SELECT comparison_id, w.peer_row_id, offset_days, revenue, net_income, gross_profit, CASE WHEN revenue <> 0 THEN net_income / revenue * 100 END net_margin_pct, CASE WHEN revenue <> 0 THEN gross_profit / revenue * 100 END gross_margin_pct,
  row_number() OVER (PARTITION BY subject, acc ORDER BY (w.peer_row_id IS NULL)::INT, coalesce(abs(offset_days), 0), lab NULLS FIRST, comparison_id)::INT place FROM w LEFT JOIN fin ON fin.peer_row_id = w.peer_row_id""")
def peers_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "peer_comparisons", "comparison_id", "accession_number", "peer_ticker", "peer_cik").select(F.col("comparison_id").alias("ask_id"), "accession_number", F.coalesce("peer_ticker", "peer_cik").alias("label"))
    finite = lambda c: F.first(F.when(usable(c), F.col(c)), True).alias(c)
    figures = table(spark, sf_dir, "peer_rows", "peer_row_id", "revenue", "net_income", "gross_profit").groupBy(F.col("peer_row_id").alias("row_id")).agg(finite("revenue"), finite("net_income"), finite("gross_profit"))
    t = compare.peer_table(_aligned(spark, sf_dir).join(names, "ask_id"), figures, ["subject", "accession_number"], F.col("label"))
    return t.select(F.col("ask_id").alias("comparison_id"), F.col("row_id").alias("peer_row_id"), "offset_days", "revenue", "net_income", "gross_profit", "net_margin_pct", "gross_margin_pct", "place")


@RUN.add("records_count", _RECORD.split("SELECT acc accession_number, company")[0] + "SELECT count(*) count FROM rc WHERE form = '10-Q' AND notable > 0")
def records_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records a listing of quarterly reports with findings has, before its limit."""
    periods, figures = _run(spark, sf_dir)
    flags = _flags(figures).groupBy("accession_number").agg(F.collect_list(F.struct("severity")).alias("flags"))
    r = periods.join(flags, "accession_number", "left").withColumn("company_cik", F.lpad(F.col("company").cast("string"), 10, "0"))
    return records.list_records(r, form="10-q", notable_only=True)[0]


@RUN.add("review_queue", _hybrid_sql(_Q, _FILED).rstrip() + f""", en AS (SELECT try_cast(trim(company_cik) AS BIGINT) company, {_ACC} acc, max(filing_date) filing_date FROM filing_events WHERE upper(trim(form)) IN ('10-K', '10-Q', '10-K/A', '10-Q/A') AND filing_date IS NOT NULL GROUP BY ALL),
nw AS (SELECT acc FROM en WHERE company IS NOT NULL AND acc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company ORDER BY filing_date DESC, acc DESC) <= 2)
SELECT grp accession_number, query_id, doc_id chunk_key, rank::INT rank FROM hy WHERE rank < 5 AND grp IN (SELECT acc FROM nw)""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages a reviewer is to label: the first hits of each benchmark query in the two newest periodic filings of each
    company, amendments included. Only those filings are indexed."""
    e = table(spark, sf_dir, "filing_events", "company_cik", "accession_number", "form", "filing_date").select(company_number("company_cik").alias("company"), dashed_accession("accession_number").alias("accession_number"), F.upper(F.trim("form")).alias("form"), "filing_date")
    e = e.where(F.col("form").isin(*facts.PERIODIC_FORMS)).dropna().groupBy("company", "accession_number").agg(F.max("filing_date").alias("filing_date")).withColumn("form", F.lit("10-K"))
    newest = filings.newest_periodic(e, 2).select(F.col("accession_number").alias("grp"))
    hits = retrieval.hybrid(_filed_chunks(spark, sf_dir).join(newest.distinct(), "grp", "left_semi"), _queries(spark), POOL)
    return hits.where("rank < 5").select(F.col("grp").alias("accession_number"), "query_id", F.col("doc_id").alias("chunk_key"), "rank")
