"""Queries of the general data problems: attributes as known at event time, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.normalize import company_number, label, usable
from ledgerline.operators.knowntime import as_known
from ledgerline.operators.nested import CASES, FACTS, flat_children, linked_nodes, numbered
from ledgerline.plans.registry import Registry
from ledgerline.sources.tables import table

R = Registry()

_FACTS = """f AS (SELECT try_cast(trim(company_cik) AS BIGINT) co, lower(trim(concept)) concept, period_end_date pe, filed_date fd, fact_id
  FROM financial_facts WHERE val IS NOT NULL AND isfinite(val) AND period_end_date IS NOT NULL AND filed_date IS NOT NULL)"""


@R.add(
    "p5_found",
    f"""WITH {_FACTS},
e AS (SELECT event_id, try_cast(trim(company_cik) AS BIGINT) co, filing_date d FROM filing_events WHERE filing_date IS NOT NULL)
SELECT event_id, concept, fact_id FROM (
  SELECT e.event_id, f.concept, f.fact_id, row_number() OVER (PARTITION BY e.event_id, f.concept ORDER BY f.pe DESC, f.fd DESC, f.fact_id) rn
  FROM e JOIN f ON e.co = f.co AND f.pe <= e.d AND f.fd <= e.d) WHERE rn = 1""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "filing_events", "event_id", "company_cik", "filing_date").select("event_id", company_number("company_cik").alias("entity"), F.col("filing_date").alias("day"))
    facts = (
        table(spark, sf_dir, "financial_facts", "fact_id", "company_cik", "concept", "val", "period_end_date", "filed_date")
        .where(usable("val"))
        .select(company_number("company_cik").alias("entity"), label("concept").alias("attr"), F.col("period_end_date").alias("valid"), F.col("filed_date").alias("known"), "fact_id")
    )
    return events.join(as_known(events, facts), ["entity", "day"]).select("event_id", F.col("attr").alias("concept"), "fact_id")


_P6_SQL = """WITH good AS (SELECT raw_id, row_number() OVER () rn, payload::JSON j FROM raw_records WHERE json_valid(payload)),
a AS (SELECT rn, raw_id, CASE WHEN json_type(j->'$.filings.recent.accessionNumber') = 'ARRAY' THEN j->'$.filings.recent.accessionNumber' ELSE json_array(j->'$.filings.recent.accessionNumber') END acc,
  CASE WHEN json_type(j->'$.filings.recent.form') = 'ARRAY' THEN j->'$.filings.recent.form' ELSE json_array(j->'$.filings.recent.form') END frm FROM good WHERE json_type(j->'$.filings.recent') = 'OBJECT'),
fil AS (SELECT raw_id, -1 case_pos, i::INT item_pos, acc->>i::INT item_key, coalesce(frm->>i::INT, '') item_label
  FROM (SELECT *, unnest(range(json_array_length(acc)::BIGINT)) i FROM a) WHERE json_type(acc->i::INT) NOT IN ('NULL', 'OBJECT', 'ARRAY')),
c AS (SELECT raw_id, CASE json_type(j->'$.numeric_cases') WHEN 'ARRAY' THEN j->'$.numeric_cases' ELSE json_array(j->'$.numeric_cases') END cs FROM good WHERE json_type(j) = 'OBJECT' AND json_type(j->'$.numeric_cases') IN ('ARRAY', 'OBJECT')),
c2 AS (SELECT raw_id, i, cs->i::INT one FROM (SELECT *, unnest(range(json_array_length(cs)::BIGINT)) i FROM c)),
e AS (SELECT raw_id, i, one, CASE json_type(one->'$.expected_facts') WHEN 'ARRAY' THEN one->'$.expected_facts' ELSE json_array(one->'$.expected_facts') END ef FROM c2 WHERE json_type(one) = 'OBJECT' AND json_type(one->'$.expected_facts') IN ('ARRAY', 'OBJECT')),
ex AS (SELECT raw_id, i::INT case_pos, k::INT item_pos, coalesce(one->>'$.case_id', '') item_key, (ef->k::INT)->>'$.concept' item_label FROM (SELECT *, unnest(range(json_array_length(ef)::BIGINT)) k FROM e))
SELECT * FROM fil UNION ALL SELECT * FROM ex WHERE item_label IS NOT NULL"""


@R.add("p6_found", _P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_children(table(spark, sf_dir, "raw_records", "raw_id", "payload"))


@R.add("p6_linked", _P6_SQL.split("ex AS (")[0].rstrip().rstrip(",") + " SELECT raw_id, i::INT case_pos, k::INT item_pos FROM (SELECT *, unnest(range(json_array_length(ef)::BIGINT)) k FROM e) WHERE json_type(ef->k::INT) = 'OBJECT'")
def p6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of cases and that of expected facts, each with its own labels, joined by the link from child to parent."""
    rec = numbered(table(spark, sf_dir, "raw_records", "raw_id", "payload").withColumnRenamed("raw_id", "record_id"))
    cases = linked_nodes(rec, "payload", CASES, ("",)).select("record_no", F.col("pre").alias("parent_pre"), F.col("pos").alias("case_pos"))
    facts = linked_nodes(rec, "payload", FACTS, CASES).where("value is null").select("record_no", "parent_pre", F.col("record_id").alias("raw_id"), F.col("pos").alias("item_pos"))
    return facts.join(cases, ["record_no", "parent_pre"]).select("raw_id", "case_pos", "item_pos")
