"""Evaluation texts leaking into training text, by winnowed fingerprints.

Every text keeps, of each window of consecutive k-gram hashes, the smallest. With k + window - 1 = SPAN words, any
span of SPAN words two texts share shares a window, so both keep the same gram of it: no shared span is missed.
Fingerprints of both sides are joined, and each hit is extended word by word to decide it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import Words, column_words, gram_hashes
from ledgerline.session import spread

SPAN, GRAM = 12, 8
#: Bits of the filter that keeps corpus fingerprints no item has out of the shuffle, for each fingerprint of the items;
#: from and up to so many in all, half a megabyte and 16.
BITS_PER_PRINT, LEAST_BITS, MOST_BITS = 16, 1 << 22, 1 << 27
_SCHEMA = "id bigint, fp bigint, gram string, before array<string>, after array<string>"
_ARROW = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def winnow(w: Words, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which a kept k-gram starts, and its hash. Ties in a window are all kept."""
    n, width = len(w.hash), span - k + 1
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = gram_hashes(w.hash, k) | np.uint64(1)
    windows = n - span + 1
    least = grams[:windows].copy()
    for i in range(1, width):
        np.minimum(least, grams[i : i + windows], out=least)
    least[w.text[:windows] != w.text[span - 1 :]] = 0  # a window crossing two texts keeps nothing
    best = np.zeros(len(grams), np.uint64)
    for i in range(width):
        np.maximum(best[i : i + windows], least, out=best[i : i + windows])
    # best is the greatest of the window minima over a gram; only the minimum of one of them can equal it
    at = np.flatnonzero(best == grams)
    return at, grams[at]


def _slots(fp: np.ndarray, size: int) -> list[np.ndarray]:
    mask = np.uint64(size - 1)
    return [(fp >> np.uint64(8)) & mask, (fp >> np.uint64(36)) & mask]


def _prints(bits: bytes | None, span: int, k: int):
    """Fingerprints with the words around them; with bits, only those whose slots are set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        reach = span - k
        for batch in batches:
            ids = batch.column(0)
            rows = []
            for w in column_words(batch.column(1)):
                at, fp = winnow(w, span, k)
                if have is not None:
                    a, b = _slots(fp, len(have))
                    keep = have[a] & have[b]
                    at, fp = at[keep], fp[keep]
                signed = fp.view(np.int64)
                for i, h in zip(at.tolist(), signed.tolist()):
                    t, row = w.text[i], ids[w.first + int(w.text[i])].as_py()
                    lo, hi = i, i + k
                    while lo > max(0, i - reach) and w.text[lo - 1] == t:
                        lo -= 1
                    while hi < min(len(w.text), i + k + reach) and w.text[hi] == t:
                        hi += 1
                    rows.append((row, h, " ".join(map(w.word, range(i, i + k))), [w.word(j) for j in range(i - 1, lo - 1, -1)], [w.word(j) for j in range(i + k, hi)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return work


def _fill(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, bool)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in _slots(fp, size):
                have[s] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(have).tobytes()])], names=["bits"])

    return work


def _merge(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for b in batch.column(0):
                out |= np.frombuffer(b.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["bits"])

    return work


def filter_bits(prints: int) -> int:
    size = LEAST_BITS
    while size < min(MOST_BITS, prints * BITS_PER_PRINT):
        size *= 2
    return size


def _shared(a: Column, b: Column, most: int) -> Column:
    """Number of leading equal elements of two arrays of at most so many."""
    total, so_far = F.lit(0), F.lit(True)
    for i in range(most):
        so_far = so_far & F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False))
        total = total + so_far.cast("int")
    return total


def leaked(documents: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(doc_id, item_id) of each document that shares at least span consecutive words with an item.

    documents: (doc_id, text); items: (item_id, item_text). Null, empty and shorter texts share nothing; a pair is
    given once, however often and wherever it matches; repeated ids count as one document or item, null ids as none. The filter drops
    only fingerprints no item has, so it cannot lose a pair; items and documents of any number meet in a shuffled
    join (or a broadcast one, where the planner finds the items' side small).
    """
    item_prints = items.where("item_id is not null").select(F.col("item_id").cast("bigint"), "item_text").mapInArrow(_prints(None, span, k), _SCHEMA)
    size = filter_bits(item_prints.count())
    parts = item_prints.select("fp").mapInArrow(_fill(size), "bits binary")
    bits = parts.coalesce(1).mapInArrow(_merge(size), "bits binary").first()[0]
    doc_prints = spread(documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(_prints(bytes(bits), span, k), _SCHEMA)
    reach = span - k
    d, i = doc_prints.alias("d"), item_prints.alias("i")
    return (
        d.join(i, (F.col("d.fp") == F.col("i.fp")) & (F.col("d.gram") == F.col("i.gram")))
        .where(_shared(F.col("d.before"), F.col("i.before"), reach) + _shared(F.col("d.after"), F.col("i.after"), reach) >= reach)
        .select(F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"))
        .distinct()
    )
