"""Period and peer comparisons over canonical facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.normalize import duration_class, year_quarter_index

MAX_OFFSET_DAYS, WIDE_OFFSET_DAYS = 45, 30


def percent_change(current: Column, prior: Column) -> Column:
    return F.when(prior != 0, (current - prior) / F.abs(prior) * 100)


def _pairs(facts: DataFrame, shift: Column, keys: list[str], now: Column) -> DataFrame:
    """Self-join by an equi key: the prior side's key is shifted so that gaps give no row, which lag could not promise."""
    cur = facts.select(*keys, now.alias("_k"), "fiscal_year", "fiscal_period", F.col("val").alias("current_value"))
    old = facts.select(*keys, shift.alias("_k"), F.col("fiscal_year").alias("prior_year"), F.col("fiscal_period").alias("prior_period"), F.col("val").alias("prior_value"))
    return cur.join(old, [*keys, "_k"]).drop("_k").withColumns(
        {"absolute_change": F.col("current_value") - F.col("prior_value"), "percent_change": percent_change(F.col("current_value"), F.col("prior_value"))}
    )


def year_over_year(facts: DataFrame) -> DataFrame:
    """Each fact with the same period of the year before."""
    return _pairs(facts.withColumn("_p", F.col("fiscal_period")), F.col("fiscal_year") + 1, ["company", "concept", "_p"], F.col("fiscal_year")).drop("_p")


def quarter_over_quarter(facts: DataFrame) -> DataFrame:
    """Each quarter with the one before; first quarters with the fourth of the year before; annual facts take no part."""
    index = year_quarter_index(F.col("fiscal_year"), F.col("fiscal_period"))
    return _pairs(facts.where(index.isNotNull()), index + 1, ["company", "concept"], index)


def margins(facts: DataFrame, numerators: list[str], denominator: str = "revenue") -> DataFrame:
    """Numerators as a percentage of the denominator of the same period; null where it is missing or zero.

    One aggregation by period in place of a join per ratio.
    """
    g = facts.groupBy("company", "fiscal_year", "fiscal_period").agg(*[F.max(F.when(F.col("concept") == c, F.col("val"))).alias(c) for c in [denominator, *numerators]])
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("concept"), F.col(n).alias("numerator")) for n in numerators]))
    return g.select("company", "fiscal_year", "fiscal_period", F.col(denominator).alias("denominator"), one.alias("m")).select(
        "company", "fiscal_year", "fiscal_period", "m.concept", F.when(F.col("denominator") != 0, F.col("m.numerator") / F.col("denominator") * 100).alias("margin_pct")
    ).where(F.exists(F.array("margin_pct"), lambda x: x.isNotNull()))


def peers_by_label(asked: DataFrame, facts: DataFrame, concept: str) -> DataFrame:
    """Peer values of the same fiscal year and period label; null where the peer has none."""
    f = facts.where(F.col("concept") == concept).select(F.col("company").alias("peer"), "fiscal_year", "fiscal_period", F.col("val").alias("peer_value"))
    return asked.join(f, ["peer", "fiscal_year", "fiscal_period"], "left")


def nearest_rows(asked: DataFrame, rows: DataFrame, within: int | None = MAX_OFFSET_DAYS) -> DataFrame:
    """asked (ask_id, entity, class, day) with the row (row_id, entity, class, day) nearest in time.

    within days: an equi-join on day buckets that wide, each row listed in its own bucket and both beside it, so no
    range join is needed. Without a bound: the last row before and the first one after, by one ordered window over the
    union of both sides. Ties go to the earlier day, then the lowest row_id.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    offset = F.datediff("row_day", "day")
    r = rows.groupBy("entity", "class", "day").agg(F.min("row_id").alias("row_id"))
    if within is not None:
        r = r.select("entity", "class", F.col("day").alias("row_day"), "row_id", F.explode(F.array(*[F.floor(day("day") / within) + k for k in (-1, 0, 1)])).alias("bucket"))
        both = asked.withColumn("bucket", F.floor(day("day") / within)).join(r, ["entity", "class", "bucket"]).where(F.abs(offset) <= within)
        best = F.min(F.struct(F.abs(offset).alias("apart"), "row_day", "row_id"))
        return both.groupBy("ask_id").agg(best.alias("b"), F.first("day").alias("day")).select("ask_id", F.col("b.row_id").alias("row_id"), F.datediff("b.row_day", "day").alias("offset_days"))
    one = F.struct(F.col("day").alias("row_day"), F.col("row_id"))
    u = r.select("entity", "class", "day", F.lit(None).cast("bigint").alias("ask_id"), one.alias("r")).unionByName(asked.select("entity", "class", "day", "ask_id", F.lit(None).cast("struct<row_day:date,row_id:bigint>").alias("r")))
    w = Window.partitionBy("entity", "class").orderBy("day")
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    u = u.withColumns({"b": F.last("r", True).over(before), "a": F.first("r", True).over(after)}).where("ask_id is not null")
    use_b = F.col("b").isNotNull() & (F.col("a").isNull() | (F.datediff("day", "b.row_day") <= F.datediff("a.row_day", "day")))
    return u.withColumn("p", F.when(use_b, F.col("b")).otherwise(F.col("a"))).where("p is not null").select("ask_id", F.col("p.row_id").alias("row_id"), F.datediff("p.row_day", "day").alias("offset_days"))


def align_peers(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Every asked peer with its aligned row, or the reason there is none and the nearest period outside the window."""
    near, any_ = nearest_rows(asked, rows), nearest_rows(asked, rows, None)
    return (
        asked.join(near, "ask_id", "left")
        .join(any_.select("ask_id", F.col("offset_days").alias("nearest_offset")), "ask_id", "left")
        .withColumn("reason", F.when(F.col("row_id").isNotNull(), None).when(F.col("nearest_offset").isNotNull(), "no period within the window").otherwise("no period of this duration"))
        .select("ask_id", "row_id", "offset_days", "nearest_offset", "reason")
    )


def peer_table(aligned: DataFrame, figures: DataFrame, by: list[str], label: Column) -> DataFrame:
    """Aligned peers with their figures, margins and place: aligned ones first, the nearest first, then by label.

    aligned: (…by, ask_id, row_id, offset_days, reason, …); figures: (row_id, revenue, net_income, gross_profit). A figure
    the row lacks is null, as are the margins without a revenue other than 0.
    """
    ratio = lambda c: F.when(F.col("revenue") != 0, F.col(c) / F.col("revenue") * 100)
    w = Window.partitionBy(*by).orderBy(F.col("row_id").isNull(), F.coalesce(F.abs("offset_days"), F.lit(0)), label, "ask_id")
    return aligned.join(figures, "row_id", "left").withColumns({"net_margin_pct": ratio("net_income"), "gross_margin_pct": ratio("gross_profit"), "place": F.row_number().over(w)})


def alignment_summary(aligned: DataFrame, by: str) -> DataFrame:
    """Aligned and asked peers per subject, the widest offset among the aligned (0 if none) and how many are wide."""
    apart = F.abs("offset_days")
    return aligned.groupBy(by).agg(
        F.count(F.lit(1)).alias("asked"), F.count("row_id").alias("aligned"), F.coalesce(F.max(apart), F.lit(0)).alias("widest"), F.count_if(apart > WIDE_OFFSET_DAYS).alias("wide"))


__all__ = ["align_peers", "alignment_summary", "duration_class", "margins", "nearest_rows", "peer_table", "peers_by_label", "percent_change", "quarter_over_quarter", "year_over_year"]
