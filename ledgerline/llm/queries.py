"""Queries of the training-data problems and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.normalize import company_number, duration_class, usable
from ledgerline.llm.garble import garbled, restored
from ledgerline.llm.leakage import leaked
from ledgerline.llm.neardup import near_duplicate_classes, near_duplicates
from ledgerline.llm.nearest_time import nearest_in_time
from ledgerline.llm.splitting import LEVELS, LIMIT, OVERLAP, split_oversized
from ledgerline.llm.survivorship import best_facts
from ledgerline.llm.tokenize import encode_corpus
from ledgerline.plans.registry import Registry
from ledgerline.sources.tables import table

R = Registry()
REGISTRIES = [R]

_P1 = """WITH f AS (SELECT *, try_cast(trim(company_cik) AS BIGINT) co, lower(trim(concept)) con, lower(trim(fiscal_period)) fp,
    trim(string_split(source_tag, ':')[-1]) bare, (val IS NOT NULL AND isfinite(val)) ok,
    CASE WHEN regexp_full_match(trim(accession_number), '\\d{18}') THEN left(trim(accession_number), 10) || '-' || substr(trim(accession_number), 11, 2) || '-' || substr(trim(accession_number), 13)
         ELSE nullif(trim(accession_number), '') END acc FROM financial_facts),
t AS (SELECT lower(trim(concept)) con, trim(source_tag) bare, min(priority) prio FROM tag_map GROUP BY ALL),
g AS (SELECT f.*, row_number() OVER w rn, count(*) OVER (PARTITION BY co, con, fiscal_year, fp) n, bool_or(ok) OVER (PARTITION BY co, con, fiscal_year, fp) any_ok
  FROM f LEFT JOIN t USING (con, bare) WHERE co IS NOT NULL AND con IS NOT NULL AND fiscal_year IS NOT NULL AND fp IS NOT NULL
  WINDOW w AS (PARTITION BY co, con, fiscal_year, fp ORDER BY ok DESC, coalesce(source = 'xbrl', false) DESC, prio ASC NULLS LAST, filed_date DESC NULLS LAST, fact_id))"""


@R.add("p1_found", _P1 + """ SELECT arg_min(fact_id, rn) fact_id, coalesce(arg_min(acc, rn) FILTER (WHERE acc IS NOT NULL), '') accession_number
  FROM g WHERE n >= 2 AND any_ok GROUP BY co, con, fiscal_year, fp""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("fact_id", "accession_number")


@R.add("p1_survivors", _P1 + """ SELECT co company, con concept, fiscal_year, fp fiscal_period, count(*) n_rows, arg_min(fact_id, rn) fact_id,
  coalesce(arg_min(acc, rn) FILTER (WHERE acc IS NOT NULL), '') accession_number, arg_min(filed_date, rn) FILTER (WHERE filed_date IS NOT NULL) filed_date,
  arg_min(source_tag, rn) FILTER (WHERE trim(source_tag) <> '') source_tag FROM g WHERE n >= 2 AND any_ok GROUP BY co, con, fiscal_year, fp""")
def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("company", "concept", "fiscal_year", "fiscal_period", "n_rows", "fact_id", "accession_number", "filed_date", "source_tag")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_facts(table(spark, sf_dir, "financial_facts"), table(spark, sf_dir, "tag_map"))


_P2 = r"""WITH c AS (SELECT chunk_key, section, trim(regexp_replace(text, '[\s\p{Z}\x{b}\x{85}\x{1c}-\x{1f}]+', ' ', 'g')) t FROM chunks WHERE lower(trim(kind)) = 'prose'),
s AS (SELECT chunk_key, list_max(list_transform(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x))) longest_s,
  list_max(list_transform(string_split(t, ' '), lambda x: length(x))) longest_w FROM c WHERE length(t) > 1500)
SELECT chunk_key, CASE WHEN longest_s <= 1500 THEN 'sentence' WHEN longest_w <= 1500 THEN 'word' ELSE 'none' END boundary FROM s"""


@R.add("p2_found", _P2)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 0").select("chunk_key", "boundary")


@R.add("p2_pieces")
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "prose_blocks", "block_id", "accession_number", "section", "text", "block_order"))


@R.add("p2_checked", _P2.split("s AS (")[0].rstrip().rstrip(",") + " SELECT chunk_key, section, length(t) chars, true AS short, true AS joined, true AS onward FROM c WHERE length(t) > 1500")
def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of every chunk: they end where its text does, stay within the limit, leave nothing
    between them but a blank, overlap by 150 characters at most, and all move on. (Counted over chunk_key and section, as
    a chunk that is there twice gives its pieces twice.)"""
    end = F.col("start_pos") + F.length("piece")
    w = Window.partitionBy("chunk_key", "start_of").orderBy("piece_no")
    p = p2_pieces(spark, sf_dir).withColumn("end", end).withColumn("start_of", F.coalesce("section", F.lit("")))
    p = p.withColumns({"past": F.lag("end").over(w), "from": F.lag("start_pos").over(w)})
    moves = F.col("past").isNull() | ((F.col("start_pos") <= F.col("past") + 1) & (F.col("past") - F.col("start_pos") <= OVERLAP))
    on = F.col("past").isNull() | ((F.col("start_pos") > F.col("from")) & (F.col("end") > F.col("past")))
    return p.groupBy("chunk_key", "section").agg(
        F.max("end").cast("bigint").alias("chars"), F.bool_and(F.length("piece") <= LIMIT).alias("short"), F.bool_and(moves).alias("joined"), F.bool_and(on & (F.col("cut").isin(*LEVELS))).alias("onward"))


TOLERANCE_DAYS = 45
_P4 = """WITH c AS (SELECT comparison_id, try_cast(trim(peer_cik) AS BIGINT) co, period_end_date d, CASE WHEN lower(trim(fiscal_period)) = 'fy' THEN 'FY' WHEN regexp_full_match(lower(trim(fiscal_period)), 'q[1-4]') THEN 'Q' END cls FROM peer_comparisons),
r AS (SELECT peer_row_id, try_cast(trim(company_cik) AS BIGINT) co, period_end_date d, CASE WHEN lower(trim(fiscal_period)) = 'fy' THEN 'FY' WHEN regexp_full_match(lower(trim(fiscal_period)), 'q[1-4]') THEN 'Q' END cls
  FROM peer_rows WHERE (revenue IS NOT NULL AND isfinite(revenue)) OR (net_income IS NOT NULL AND isfinite(net_income)) OR (gross_profit IS NOT NULL AND isfinite(gross_profit))),
j AS (SELECT comparison_id, peer_row_id, (r.d - c.d)::INT end_offset_days, row_number() OVER (PARTITION BY comparison_id ORDER BY abs(r.d - c.d), r.d, peer_row_id) rn FROM c JOIN r ON c.co = r.co AND c.cls = r.cls AND abs(r.d - c.d) <= 45)
SELECT comparison_id, peer_row_id{} FROM j WHERE rn = 1"""


@R.add("p4_found", _P4.format(""))
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).select("comparison_id", "peer_row_id")


@R.add("p4_offsets", _P4.format(", end_offset_days"))
def p4_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir)


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comparison with the peer's nearest row of its duration class, and the signed offset of its end in days."""
    asked = table(spark, sf_dir, "peer_comparisons", "comparison_id", "peer_cik", "period_end_date", "fiscal_period").select(
        "comparison_id", company_number("peer_cik").alias("entity"), duration_class("fiscal_period").alias("class"), F.col("period_end_date").alias("day"))
    rows = (
        table(spark, sf_dir, "peer_rows", "peer_row_id", "company_cik", "period_end_date", "fiscal_period", "revenue", "net_income", "gross_profit")
        .where(usable("revenue") | usable("net_income") | usable("gross_profit"))
        .select(company_number("company_cik").alias("entity"), duration_class("fiscal_period").alias("class"), F.col("period_end_date").alias("day"), F.col("peer_row_id").alias("right_id"))
    )
    hit = nearest_in_time(asked, rows, TOLERANCE_DAYS)
    return asked.join(hit, ["entity", "class", "day"]).select("comparison_id", F.col("right_id").alias("peer_row_id"), F.datediff("right_day", "day").alias("end_offset_days"))


@R.add("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


# Every 12 consecutive words of either side as a string, joined.
_P8 = """WITH w AS (SELECT 'd' side, doc_id id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') FROM eval_items WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT side, id, array_to_string(w[i + 1:i + 12], ' ') gram FROM (SELECT side, id, w, unnest(range(len(w) - 11)) i FROM w WHERE len(w) >= 12))
SELECT DISTINCT d.id doc_id, i.id item_id FROM g d JOIN g i ON d.gram = i.gram WHERE d.side = 'd' AND i.side = 'i'"""


@R.add("p8_found", _P8)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "item_text"))


# Shingles in common by a join on them; common / (n_a + n_b - common) >= 0.6.
_P3 = """WITH w AS (SELECT passage_id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM narrative_passages WHERE passage_id IS NOT NULL),
s AS (SELECT row_number() OVER () rn, passage_id, w FROM w WHERE len(w) >= 3), g AS (SELECT DISTINCT rn, passage_id, array_to_string(w[i + 1:i + 3], ' ') gram FROM (SELECT rn, passage_id, w, unnest(range(len(w) - 2)) i FROM s)),
n AS (SELECT rn, count(*) n FROM g GROUP BY rn), c AS (SELECT a.rn ra, b.rn rb, a.passage_id passage_id_a, b.passage_id passage_id_b, count(*) c FROM g a JOIN g b ON a.gram = b.gram AND a.passage_id < b.passage_id GROUP BY ALL)
SELECT passage_id_a, passage_id_b FROM c JOIN n x ON x.rn = ra JOIN n y ON y.rn = rb WHERE 8 * c >= 3 * (x.n + y.n)"""


_P3_CLASSES = _P3.split("s AS (")[0] + """t AS (SELECT DISTINCT passage_id, list_sort(list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')))) gs, row_number() OVER () rn FROM w WHERE len(w) >= 3),
k AS (SELECT gs, min(passage_id) class_id, len(gs) n FROM t GROUP BY gs), g AS (SELECT class_id, n, unnest(gs) gram, hash(gs) hk FROM k),
c AS (SELECT a.hk x, b.hk y, any_value(a.n) nx, any_value(b.n) ny, count(*) c FROM g a JOIN g b ON a.gram = b.gram AND a.hk <> b.hk GROUP BY ALL), l AS (SELECT x, count(*) links FROM c WHERE 8 * c >= 3 * (nx + ny) GROUP BY x)
SELECT t.passage_id, k.class_id, coalesce(l.links, 0) links FROM t JOIN k ON k.gs = t.gs LEFT JOIN l ON l.x = hash(k.gs)"""


@R.add("p3_classes", _P3_CLASSES)
def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "narrative_passages", "passage_id", "text").select(F.col("passage_id").alias("id"), "text")
    return near_duplicate_classes(texts).select(F.col("id").alias("passage_id"), "class_id", "links")


@R.add("p3_found", _P3)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "narrative_passages", "passage_id", "text").select(F.col("passage_id").alias("id"), "text")
    return near_duplicates(texts).select(F.col("id_a").alias("passage_id_a"), F.col("id_b").alias("passage_id_b"))


@R.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "documents", "doc_id", "text"))


@R.add("p9_restored")
def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(table(spark, sf_dir, "documents", "doc_id", "text"))
