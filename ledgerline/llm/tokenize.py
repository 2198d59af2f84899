"""Encoding of a corpus with a public byte-level BPE vocabulary, by recursive queries.

Per partition the texts are split into words by the vocabulary's pattern, and each distinct word is encoded once: a
DuckDB recursive query holds one row per token position, joins adjacent tokens with the merge table, and contracts
each word's leftmost pairs of minimum rank until nothing merges; an ordered aggregation gives the word's ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern of this vocabulary that splits text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept encoded per task; beyond it the store starts anew. Speed only.
STORE_WORDS = 400_000
#: Texts of about so many bytes are encoded at a time.
PORTION_BYTES = 4 << 20
#: The table keeps the last token of each position, -1 where one has gone into the one before it; a step sees which words
#: the step before changed. Of a word all leftmost pairs of its minimum rank are contracted at once: a merged token takes
#: part in later merges only, so nothing of lower rank can come between. In a run of equal tokens that is every other pair.
_RECURSION = """
WITH RECURSIVE step(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM start
  UNION
  SELECT w, CASE WHEN half = 0 THEN p ELSE np END, CASE WHEN half = 0 THEN new_id ELSE -1 END FROM (
    SELECT w, p, np, new_id, row_number() OVER (PARTITION BY w, k - h ORDER BY p) AS i FROM (
      SELECT *, row_number() OVER (PARTITION BY w ORDER BY p) AS h FROM (
        SELECT a.w, a.p, a.np, a.k, m.new_id, m.rank, min(m.rank) OVER (PARTITION BY a.w) AS least
        FROM (SELECT w, p, t, lead(t) OVER v AS nt, lead(p) OVER v AS np, row_number() OVER v AS k FROM recurring.step WHERE t >= 0 AND w IN (SELECT w FROM step) WINDOW v AS (PARTITION BY w ORDER BY p)) a
        JOIN merges m ON a.t = m.l AND a.nt = m.r) WHERE rank = least)), (VALUES (0), (1)) x(half)
  WHERE i % 2 = 1
)
SELECT w, list(t ORDER BY p) ids FROM step WHERE t >= 0 GROUP BY w ORDER BY w
"""


def load_vocabulary(path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the 256 single bytes, merges as rows left id, right id, merged id in order of rank)."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab = model["vocab"]
    # The file writes bytes as printable characters: those that print stand for themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32)
    return np.array([vocab[letter[b]] for b in range(256)], dtype=np.int32), merges


class WordEncoder:
    """Encodes words; keeps those it has seen."""

    def __init__(self, singles: np.ndarray, merges: np.ndarray):
        import duckdb

        self.singles, self.store = singles, {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        l, r, new_id = (pa.array(merges[:, i]) for i in range(3))
        table = pa.table({"l": l, "r": r, "new_id": new_id, "rank": pa.array(np.arange(len(merges), dtype=np.int32))})
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")

    def learn(self, words: set[str]) -> None:
        """Encode the words not in store."""
        if len(self.store) > STORE_WORDS:
            self.store.clear()
        new = [(w, w.encode("utf-8", "surrogatepass")) for w in words if w not in self.store]
        for i in range(0, len(new), 20_000):
            self._by_query(new[i : i + 20_000])

    def _by_query(self, words: list[tuple[str, bytes]]) -> None:
        size = np.array([len(b) for _, b in words])
        data = np.frombuffer(b"".join(b for _, b in words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        p = (np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self.db.register("given", pa.table({"w": w, "p": p, "t": self.singles[data]}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT * FROM given")
        got = self.db.sql(_RECURSION).to_arrow_table()
        for (word, _), ids in zip(words, got.column("ids").to_pylist(), strict=True):
            self.store[word] = ids


_encoder: dict[str, WordEncoder] = {}


def _encode(key: str, singles: np.ndarray, merges: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        if key not in _encoder:
            _encoder[key] = WordEncoder(singles, merges)
        enc = _encoder[key]
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION_BYTES, "right")))
                part, at = batch.slice(at, end - at), end
                texts = part.column(1).to_pylist()
                words = [split(t) if t else [] for t in texts]
                enc.learn(set(chain.from_iterable(words)))
                get = enc.store.__getitem__
                ids = [list(chain.from_iterable(map(get, w))) for w in words]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    return work


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each row of documents (doc_id, text), without special tokens.

    Null and empty texts give an empty list; a special token's string in a text is ordinary text; repeated rows each
    give a row; very long texts and words are encoded whole. The vocabulary is read on the driver and sent along (its
    size is fixed), so workers need no file. No shuffle.
    """
    singles, merges = load_vocabulary(vocabulary)
    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(_encode(vocabulary, singles, merges), "doc_id bigint, ids array<int>")
