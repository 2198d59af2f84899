"""Run records, evaluation and storage of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in the given order, as one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of new in place of rows of the same key."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def list_records(records: DataFrame, cik: str | None = None, form: str | None = None, notable_only: bool = False, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(count before the limit, newest records first) of records (accession_number, company_cik, form, filing_date, flags
    array<struct<severity…>>) under the listing filters."""
    r = records.withColumn("notable", F.size(F.filter(F.coalesce("flags", F.array()), lambda f: f["severity"] != "routine")))
    if cik:
        r = r.where(F.col("company_cik") == cik)
    if form:
        r = r.where(F.upper("form") == form.upper())
    if notable_only:
        r = r.where("notable > 0")
    return r.agg(F.count(F.lit(1)).alias("count")), r.orderBy(F.col("filing_date").desc(), F.col("accession_number").desc()).limit(max(1, min(limit, 500)))


def numeric_accuracy(expected: DataFrame, actual: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per case: expected facts, found ones and those within tolerance, of (case_id, company, concept, fiscal_year,
    fiscal_period, expected) against actual facts of the same key. A case without any expected fact has one row whose
    concept is null; it counts none."""
    a = actual.select("company", "concept", "fiscal_year", "fiscal_period", F.col("val").alias("actual"))
    j = expected.join(a, ["company", "concept", "fiscal_year", "fiscal_period"], "left")
    ok = F.abs(F.col("actual") - F.col("expected")) <= tolerance
    return j.groupBy("case_id").agg(F.count("concept").alias("expected"), F.count("actual").alias("found"), F.count_if(ok).alias("correct"))


def case_coverage(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """Coverage of required concepts by the case's own filing: cases (case_no, case_id, company, accession_number, required
    array<string>) against facts (company, accession_number, concept). A case that requires nothing has the rate 0."""
    have = facts.select("company", "accession_number", "concept").distinct()
    need = cases.select("case_no", "case_id", "company", "accession_number", F.explode_outer(F.array_distinct("required")).alias("concept"))
    j = need.join(have.withColumn("hit", F.lit(1)), ["company", "accession_number", "concept"], "left").groupBy("case_no", "case_id").agg(F.count("concept").alias("required"), F.count("hit").alias("available"))
    return j.select("case_id", "required", "available", F.when(F.col("required") == 0, 0.0).otherwise(F.col("available") / F.col("required") * 100).alias("rate"))


def citation_support(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, supported): every cited chunk exists and every phrase occurs, whatever its case, in their joined text.
    claims: (claim_id, cited array<string>, phrases array<string>); chunks: (chunk_id, text)."""
    c = claims.select("claim_id", "phrases", F.size("cited").alias("n"), F.posexplode("cited").alias("at", "chunk_id"))
    j = c.join(chunks.select("chunk_id", "text"), "chunk_id", "left").groupBy("claim_id").agg(F.first("phrases").alias("phrases"), F.first("n").alias("n"), F.count("text").alias("have"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    text = F.lower(F.array_join(F.col("t.text"), " "))
    return j.select("claim_id", ((F.col("n") == F.col("have")) & F.forall("phrases", lambda p: text.contains(F.lower(p)))).alias("supported"))


def required_join(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Left join that fails the query where the right side has no row for a key, or several."""
    r = right.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    j = left.join(r, keys, "left")
    ok = F.assert_true(F.coalesce(F.col("_n"), F.lit(0)) == 1, F.concat(F.lit(f"{what}: no single row for "), F.concat_ws("/", *keys)))
    return j.where(ok.isNull()).drop("_n")


def review_progress(labels: DataFrame) -> DataFrame:
    """Per accession: labels, filled ones, queries, and queries whose filled labels have none relevant.
    labels: (accession_number, query_id, chunk_id, relevant boolean or null)."""
    per = labels.groupBy("accession_number", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count("relevant").alias("filled"), F.max("relevant").alias("any"))
    return per.groupBy("accession_number").agg(F.sum("n").alias("labels"), F.sum("filled").alias("filled"), F.count(F.lit(1)).alias("queries"), F.count_if(F.col("any") == F.lit(False)).alias("without_relevant"))


def size_gate(cases: DataFrame, companies: int = 5, queries: int = 30) -> DataFrame:
    """(companies, queries, unique, enough) of benchmark cases (company, query_id): large enough, and no query id twice."""
    n = cases.agg(F.count_distinct("company").alias("companies"), F.count_distinct("query_id").alias("queries"), F.count("query_id").alias("rows"))
    return n.select("companies", "queries", (F.col("queries") == F.col("rows")).alias("unique"), ((F.col("companies") >= companies) & (F.col("queries") >= queries)).alias("enough"))


# Metrics of an evaluation and the least (latency: the most) they are to reach.
TARGETS = {"numeric_accuracy_pct": 100.0, "coverage_pct": 90.0, "precision_pct": 85.0, "citation_support_pct": 90.0, "latency_max_s": 600.0}


def evaluation_report(**counted: DataFrame) -> DataFrame:
    """(metric, value, target, passed, numerator, denominator): one row a metric of TARGETS.

    Each DataFrame has one row (numerator, denominator), of latency_max_s (numerator, the longest time, and 1). What has
    nothing to count, or no DataFrame, is unmeasured: value and passed are null.
    """
    if unknown := set(counted) - set(TARGETS):
        raise ValueError(f"no such metric: {sorted(unknown)}")
    rows = None
    for name, target in TARGETS.items():
        if name not in counted:
            continue
        n, d = F.col("numerator").cast("double"), F.col("denominator").cast("double")
        value = F.when(d > 0, n if name == "latency_max_s" else n / d * 100)
        one = counted[name].select(F.lit(name).alias("metric"), value.alias("value"), F.lit(target).alias("target"), ((value <= target) if name == "latency_max_s" else (value >= target)).alias("passed"), n.alias("numerator"), d.alias("denominator"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("nothing to report")
    missing = [(n, TARGETS[n]) for n in TARGETS if n not in counted]
    if missing:
        null = F.lit(None).cast("double")
        rest = rows.sparkSession.createDataFrame(missing, "metric string, target double").select("metric", null.alias("value"), "target", F.lit(None).cast("boolean").alias("passed"), null.alias("numerator"), null.alias("denominator"))
        rows = rows.unionByName(rest)
    return rows
