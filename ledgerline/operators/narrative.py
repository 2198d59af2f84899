"""Screening of passages and change detection between consecutive filings."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.normalize import collapse_space
from ledgerline.session import materialize, spread

# Words by topic, found anywhere in the lower-cased text.
TOPICS = {
    "LIQUIDITY_REGULATORY": ["covenant", "liquidity", "going concern", "default", "regulatory investigation", "material weakness"],
    "LITIGATION": ["lawsuit", "litigation", "complaint", "alleging", "breach of contract", "class action", "subpoena", "indictment", "settlement agreement"],
}
# Ways a date is written, each replaced in this order.
_MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
DATE_PATTERNS = [
    rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    rf"\b{_MONTH}\s+\d{{4}}\b",
    r"\bfiscal\s+(?:year\s+)?\d{4}\b",
]
# Thresholds.
SENTENCE_SIMILARITY, UNCHANGED, REVISED, MIN_WORDS = 0.90, 0.99, 0.50, 6
MAX_FLAGS_PER_TOPIC = 12


def topics_of(text: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """Sorted topics with any of their words in the text; none for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: F.reduce(F.array(*[low.contains(w) for w in words]), F.lit(False), lambda a, x: a | x)
    named = [F.when(hit(words), F.lit(t)) for t, words in sorted((topics or TOPICS).items())]
    return F.array_compact(F.array(*named))


def comparable_text(text: Column) -> Column:
    """Dates as a placeholder, lower case, single blanks; amounts stay."""
    text = F.lower(text)  # once, in place of patterns that ignore case
    for p in DATE_PATTERNS:
        text = F.regexp_replace(text, p, " <date> ")
    return collapse_space(text)


def sentences_of(text: Column) -> Column:
    """Comparable sentences of a normalized text: of at least MIN_WORDS words, or the whole text if none is."""
    return _comparable(F.split(text, _SENTENCE_GAP), text)


_SENTENCE_GAP = r"(?<=[.!?])\s+"


def _comparable(parts: Column, text: Column) -> Column:
    words = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
    long = F.filter(parts, lambda s: (s != "") & (words(s) >= MIN_WORDS))
    return F.coalesce(F.nullif(long, F.array().cast("array<string>")), F.filter(F.array(text), lambda s: s != ""))


def sentence_table(passages: DataFrame) -> DataFrame:
    """(company, accession_number, passage_id, chunk_id, pos, sentence) of passages (…, text)."""
    p = spread(passages.where(F.col("text").isNotNull())).withColumn("_t", comparable_text(F.col("text"))).withColumn("_p", F.split("_t", _SENTENCE_GAP))
    return p.select("company", "accession_number", "passage_id", "chunk_id", F.posexplode(_comparable(F.col("_p"), F.col("_t"))).alias("pos", "sentence"))


def _counts(texts: list[str]) -> np.ndarray:
    """Characters per text in 64 classes by code."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 63
        out[i] = np.bincount(codes, minlength=64)
    return out


def common_length(a: str, b: str, masks: dict[str, int]) -> int:
    """Length of the longest common subsequence; masks: for each character of a the places that hold it, as bits."""
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _close(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = difflib.SequenceMatcher(autojunk=False)
        for batch in batches:
            if not batch.num_rows:
                continue
            cur, old = (batch.column(batch.schema.get_field_index(c)).dictionary_encode() for c in ("sentence", "old_sentence"))
            a, b = cur.indices.to_numpy(), old.indices.to_numpy()
            cur, old = cur.dictionary.to_pylist(), old.dictionary.to_pylist()
            x, y = _counts(cur), _counts(old)
            # Shared characters, whatever their order, bound the ratio from above; classes only raise the bound.
            size = x.sum(1)[a] + y.sum(1)[b]
            near = np.flatnonzero(2.0 * np.minimum(x[a], y[b]).sum(1) >= threshold * size - 1e-9)
            keep, last, masks = [], -1, {}
            for i in near[np.argsort(a[near], kind="stable")].tolist():
                s, t = cur[a[i]], old[b[i]]
                if a[i] != last:
                    last, masks = a[i], {}
                    for k, c in enumerate(s):
                        masks[c] = masks.get(c, 0) | (1 << k)
                    m.set_seq2(s)
                # The matching blocks are a common subsequence, so the longest one bounds the ratio too, and far closer.
                if 2.0 * common_length(s, t, masks) < threshold * (len(s) + len(t)) - 1e-9:
                    continue
                m.set_seq1(t)
                if m.ratio() >= threshold:
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(sorted(keep))).drop_columns(["old_sentence"])

    return work


def matched_sentences(current: DataFrame, pairs: DataFrame, prior: DataFrame, threshold: float = SENTENCE_SIMILARITY) -> DataFrame:
    """(passage_id, pos, old_chunk, old_pos): for each current sentence the first prior sentence that is alike.

    pairs: (accession_number, prior_accession). Equal sentences are matched by hash first. Only those left over are
    compared by edit distance, and only with sentences whose length allows the threshold; both are reduced to distinct
    texts per filing before they meet.
    """
    p = prior.groupBy("accession_number", "sentence").agg(F.min(F.struct("passage_id", "pos", "chunk_id")).alias("old")).withColumnRenamed("accession_number", "prior_accession")
    cur = current.join(pairs, "accession_number")
    equal = cur.join(p, ["prior_accession", "sentence"]).select("passage_id", "pos", "old")
    rest = cur.join(p, ["prior_accession", "sentence"], "left_anti").groupBy("accession_number", "prior_accession", "sentence").agg(F.collect_list(F.struct("passage_id", "pos")).alias("at"))
    la, lb = F.length("sentence"), F.length("old_sentence")
    # Little data, much work: dealt by number, so that small partitions are not merged into a few tasks.
    rest = rest.repartition(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "prior_accession")
    cand = rest.join(p.withColumnRenamed("sentence", "old_sentence"), "prior_accession").where(2.0 * F.least(la, lb) >= threshold * (la + lb))
    near = cand.select("sentence", "old_sentence", "at", "old").mapInArrow(_close(threshold), "sentence string, at array<struct<passage_id:bigint,pos:int>>, old struct<passage_id:bigint,pos:int,chunk_id:string>")
    fuzzy = near.select(F.explode("at").alias("a"), "old").groupBy("a.passage_id", "a.pos").agg(F.min("old").alias("old"))
    return equal.unionByName(fuzzy).select("passage_id", "pos", F.col("old.chunk_id").alias("old_chunk"), F.col("old.pos").alias("old_pos"))


def change_status(total: Column, matched: Column, has_prior: Column) -> Column:
    share = matched / total
    return F.when(~has_prior, "unestablished").when(share >= UNCHANGED, "unchanged").when(share >= REVISED, "revised").otherwise("new")


#: Sentences a summary quotes, and characters of each.
QUOTED, QUOTE_CHARS = 3, 200


def diff_summary(unmatched: Column) -> Column:
    """What a revised passage says that its baseline does not: the first of its unmatched sentences, and how many more.
    unmatched: array<struct<pos, sentence>> in order."""
    shown = F.transform(F.slice(unmatched, 1, QUOTED), lambda s: F.concat(F.lit('"'), F.substring(s["sentence"], 1, QUOTE_CHARS), F.lit('"')))
    more = F.when(F.size(unmatched) > QUOTED, F.concat(F.lit(" (+"), (F.size(unmatched) - QUOTED).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(unmatched) == 0, "wording changed without a sentence-level difference").otherwise(F.concat(F.lit("not in the prior filing: "), F.array_join(shown, "; "), more))


def passage_changes(passages: DataFrame, pairs: DataFrame, threshold: float = SENTENCE_SIMILARITY) -> DataFrame:
    """(passage_id, status, similarity, prior_chunk_id, diff_summary): share of a passage's comparable sentences found in
    the baseline.

    Without a baseline filing with passages the status is 'unestablished' and similarity null. The prior chunk is the
    one most sentences come from, then the earliest; a summary is given of revised passages. Null and empty texts have
    no sentence and give no row.
    """
    # Used four times below; written once, as the regular expressions cost more than the table.
    s = materialize(sentence_table(passages), "sentences")
    stored = s.select(F.col("accession_number").alias("prior_accession")).distinct()
    usable_pairs = pairs.where("prior_accession is not null").join(stored, "prior_accession")
    m = matched_sentences(s, usable_pairs, s, threshold)
    told = s.join(m.withColumn("hit", F.lit(True)), ["passage_id", "pos"], "left")
    by_chunk = told.groupBy("passage_id", "accession_number", "old_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.min("old_pos").alias("first"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.struct("pos", "sentence")))).alias("rest"))
    source = F.max(F.when(F.col("hits") > 0, F.struct("hits", (-F.col("first")).alias("f"), "old_chunk")))
    per = by_chunk.groupBy("passage_id", "accession_number").agg(F.sum("n").alias("total"), F.sum("hits").alias("matched"), source["old_chunk"].alias("source"), F.array_sort(F.flatten(F.collect_list("rest"))).alias("rest"))
    j = per.join(usable_pairs.select("accession_number", F.lit(True).alias("has")).distinct(), "accession_number", "left")
    has = F.coalesce("has", F.lit(False))
    status = change_status(F.col("total"), F.col("matched"), has)
    return j.select(
        "passage_id", status.alias("status"), F.when(has, F.round(F.col("matched") / F.col("total"), 4)).alias("similarity"),
        F.when(status.isin("unchanged", "revised"), F.col("source")).alias("prior_chunk_id"), F.when(status == "revised", diff_summary(F.col("rest"))).alias("diff_summary"))


# Rule, severity and description by status, most telling first.
STATUS_RULES = [
    ("new", "NEW_{}_LANGUAGE", "notable", "Passage has no close counterpart in the prior filing"),
    ("revised", "REVISED_{}_LANGUAGE", "notable", "Passage is a reworded version of prior-filing language"),
    ("unestablished", "UNESTABLISHED_{}_LANGUAGE", "notable", "Passage contains screened language; no prior filing on record to compare against"),
    ("unchanged", "UNCHANGED_{}_LANGUAGE", "routine", "Passage repeats prior-filing language after rolling dates forward"),
]


def narrative_flags(changes: DataFrame, cap: int = MAX_FLAGS_PER_TOPIC) -> DataFrame:
    """(accession_number, passage_id, topic, rank, rule_id, rule_description, severity, citation, detail) of screened
    passages, at most cap per filing and topic.

    changes: (accession_number, passage_id, chunk_id, section, text, topics, status, similarity, prior_chunk_id,
    diff_summary, prior_accession, prior_date, relevance), one row a passage. Order: status, relevance (null last), the
    more similar, chunk_id, passage_id. Rows of no known status give no flag.
    """
    c = changes.select("*", F.explode("topics").alias("topic"))
    pick = lambda i, value=None: F.coalesce(*[F.when(F.col("status") == r[0], value(r) if value else F.lit(r[i])) for r in STATUS_RULES])
    order = F.coalesce(*[F.when(F.col("status") == r[0], F.lit(i)) for i, r in enumerate(STATUS_RULES)])
    w = Window.partitionBy("accession_number", "topic").orderBy(order, F.col("relevance").asc_nulls_last(), F.coalesce("similarity", F.lit(0.0)).desc(), "chunk_id", "passage_id")
    top = c.where(order.isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    like = F.coalesce(F.format_string("%.2f", F.col("similarity")), F.lit("none"))
    base = F.coalesce(F.concat(F.lit("compared against "), F.col("prior_accession"), F.lit(" filed "), F.col("prior_date").cast("string")), F.lit("no prior filing on record"))
    against = F.coalesce(F.concat(F.lit("; closest prior passage "), F.col("prior_chunk_id")), F.lit(""))
    return top.select(
        "accession_number", "passage_id", "topic", "rank", pick(1, lambda r: F.replace(F.lit(r[1]), F.lit("{}"), F.col("topic"))).alias("rule_id"),
        F.concat(pick(3), F.lit(" (similarity "), F.when(F.col("similarity").isNull(), "none").otherwise(like), F.lit(", "), base, F.lit(")")).alias("rule_description"), pick(2).alias("severity"),
        F.concat(F.coalesce("section", F.lit("(no heading)")), F.lit(" ("), F.coalesce("chunk_id", F.lit("")), F.lit(")"), against).alias("citation"),
        F.concat(F.substring("text", 1, 400), F.coalesce(F.concat(F.lit("\n\nChange: "), F.col("diff_summary")), F.lit(""))).alias("detail"))


def capped_by_topic(changes: DataFrame, cap: int = MAX_FLAGS_PER_TOPIC) -> DataFrame:
    """At most cap rows (accession_number, topic, status, similarity, chunk_id) per filing and topic, most telling first."""
    rank = F.when(F.col("status") == "new", 0).when(F.col("status") == "revised", 1).when(F.col("status") == "unestablished", 2).otherwise(3)
    w = Window.partitionBy("accession_number", "topic").orderBy(rank, F.col("similarity").asc_nulls_first(), "chunk_id", "passage_id")
    return changes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def keyword_preview(text: Column, words: list[str], width: int = 400, lead: int = 100) -> Column:
    """width characters from lead before the first of the words; null without one."""
    low = F.lower(text)
    first = F.array_min(F.array_compact(F.array(*[F.when(F.locate(w, low) > 0, F.locate(w, low)) for w in words])))
    return F.when(first.isNotNull(), F.substring(text, F.greatest(first - lead, F.lit(1)), F.lit(width)))
