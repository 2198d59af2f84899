"""Best representative of each group of duplicates, field by field.

One aggregation: every surviving field is the maximum of a composite struct (field present, quality..., value), so
partial aggregation on the map side reduces a group before the shuffle, whatever share of the rows it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.normalize import bare_tag, company_number, dashed_accession, label, usable


def best_record(rows: DataFrame, keys: list[str], quality: list[Column], fields: dict[str, Column]) -> DataFrame:
    """One row per group of equal keys: keys, n_rows, best (struct of the winning row's quality) and each field.

    quality is compared left to right, greater is better, null is worst; make its last element unique for a defined
    winner. Each field is taken from the best row that has it (not null); null if none has. Rows with a null key
    belong to no group. Equal rows are counted each, ties are settled by quality alone. An empty table gives none.
    """
    q = [c.alias(f"q{i}") for i, c in enumerate(quality)]
    pick = lambda v: F.max(F.struct(v.isNotNull().alias("present"), *q, v.alias("value")))["value"]
    return (
        rows.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.struct(*q)).alias("best"), *[pick(v).alias(k) for k, v in fields.items()])
    )


USABLE = 1 << 56


def packed_quality(trusted: Column) -> Column:
    """Usable value, trusted source, tag priority (32 bits, absent last) and day filed (22 bits, absent last) in one
    number that orders like them: every field's struct carries it."""
    bit = lambda c, n: F.when(c, F.lit(1 << n)).otherwise(F.lit(0))
    priority = F.when(F.col("priority").isNotNull(), F.lit(1 << 54) + (F.lit(2**31 - 1) - F.col("priority").cast("bigint")) * (1 << 22)).otherwise(F.lit(0))
    day = F.coalesce(F.greatest(F.datediff("filed_date", F.lit("0001-01-01").cast("date")) + 2, F.lit(1)), F.lit(0))
    return bit(usable("val"), 56) + bit(F.coalesce(trusted, F.lit(False)), 55) + priority + day


def best_facts(facts: DataFrame, tag_map: DataFrame) -> DataFrame:
    """Surviving financial fact per (company, concept, fiscal_year, fiscal_period) of two or more rows with a usable value.

    Order: usable value, source 'xbrl', lowest tag priority (unlisted or null tags last), latest filed_date (null last),
    lowest fact_id. fact_id, val, unit and source come from the winner; accession_number, filed_date, source_tag,
    period_end_date and company_ticker each from the first row in this order that has one ('' for no accession).
    """
    prio = tag_map.groupBy(label("concept").alias("concept"), F.trim("source_tag").alias("bare_tag")).agg(F.min("priority").alias("priority"))
    rows = (
        facts.select(
            company_number("company_cik").alias("company"), label("concept").alias("concept"), "fiscal_year", label("fiscal_period").alias("fiscal_period"),
            "fact_id", "val", "unit", "source", "source_tag", F.trim(bare_tag("source_tag")).alias("bare_tag"), "filed_date", "period_end_date", "company_ticker",
            dashed_accession("accession_number").alias("accession_number"),
        )
        .join(prio, ["concept", "bare_tag"], "left")
    )
    quality = [packed_quality(F.col("source") == "xbrl"), -F.col("fact_id")]
    own = F.struct("fact_id", "val", "unit", "source")
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    best = best_record(
        rows, ["company", "concept", "fiscal_year", "fiscal_period"], quality,
        {"own": own, "accession_number": F.col("accession_number"), "filed_date": F.col("filed_date"), "source_tag": blank("source_tag"), "period_end_date": F.col("period_end_date"), "company_ticker": blank("company_ticker")},
    )
    return best.where((F.col("n_rows") >= 2) & (F.col("best.q0") >= USABLE)).select(
        "company", "concept", "fiscal_year", "fiscal_period", "n_rows", "own.*", F.coalesce("accession_number", F.lit("")).alias("accession_number"), "filed_date", "source_tag", "period_end_date", "company_ticker",
    )
