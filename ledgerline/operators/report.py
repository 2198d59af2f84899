"""Cited flags, metric rows and their Markdown, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAG = "rule_id string, severity string, citation string, detail string"


def threshold_flags(rows: DataFrame, value: Column, threshold: float, rule_id: str, what: Column, citation: Column, keys: list[str]) -> DataFrame:
    """A notable flag for each row whose value is at least threshold in size; rows without a value give none."""
    return rows.where(F.abs(value) >= threshold).select(*keys, F.lit(rule_id).alias("rule_id"), F.lit("notable").alias("severity"), citation.alias("citation"), F.format_string("%s changed by %+.2f", what, value).alias("detail"))


def provenance(source: Column, tag: Column) -> Column:
    return F.when(source == "html_table_fallback", "html_table_fallback").when(tag.startswith("derived:"), "derived").when(source.isNotNull(), "xbrl").otherwise("unknown")


def metric_rows(facts: DataFrame, compared: DataFrame) -> DataFrame:
    """Compared facts and, for facts nothing was compared with, a row that says so."""
    keys = ["company", "concept", "fiscal_year", "fiscal_period"]
    rest = facts.join(compared.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("val").alias("current_value"), F.lit(None).cast("double").alias("prior_value"), F.lit(None).cast("double").alias("percent_change"), F.lit("No comparable prior figure").alias("note"))
    return compared.select(*keys, "current_value", "prior_value", "percent_change", F.lit(None).cast("string").alias("note")).unionByName(rest)


def money(v: Column) -> Column:
    return F.when(v.isNull(), "N/A").otherwise(F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(v), 0)))


def memo_markdown(metrics: DataFrame, flags: DataFrame, by: str) -> DataFrame:
    """(by, memo): one Markdown report per group, metric rows in key order, then notable and routine flags."""
    line = F.concat_ws(" | ", F.col("concept"), F.concat("fiscal_year", F.lit(" "), "fiscal_period"), money(F.col("current_value")), money(F.col("prior_value")), F.coalesce(F.format_string("%+.2f%%", "percent_change"), F.coalesce("note", F.lit("N/A"))))
    m = metrics.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("concept", "fiscal_year", "fiscal_period", line.alias("line")))).alias("m"))
    f = flags.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((F.col("severity") == "routine").alias("r"), "rule_id", "detail", "citation"))).alias("f"))
    rows = F.array_join(F.transform("m", lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |"))), "\n")
    told = F.array_join(F.transform(F.coalesce("f", F.array()), lambda x: F.concat(F.lit("- "), x["rule_id"], F.lit(": "), x["detail"], F.lit(" ["), x["citation"], F.lit("]"))), "\n")
    return m.join(f, by, "full").select(by, F.concat_ws("\n", F.lit("# Filing memo"), F.lit("| Concept | Period | Value | Prior | Change |"), F.lit("| --- | --- | --- | --- | --- |"), rows, F.lit("## Flags"), told).alias("memo"))


def alert_lines(flags: DataFrame, by: str, most: int = 5, width: int = 220) -> DataFrame:
    """(by, notable, lines): the first notable flags of each group, details in one line of at most width characters."""
    n = flags.where("severity <> 'routine'").select(by, "rule_id", F.substring(F.regexp_replace("detail", r"\s+", " "), 1, width).alias("d"))
    g = n.groupBy(by).agg(F.count(F.lit(1)).alias("notable"), F.array_sort(F.collect_list(F.struct("rule_id", "d"))).alias("a"))
    return g.select(by, "notable", F.transform(F.slice("a", 1, most), lambda x: F.concat(x["rule_id"], F.lit(": "), x["d"])).alias("lines"))
