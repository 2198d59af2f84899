"""Attributes as known at event time, by path-copied persistent search trees.

Every (entity, shard) has one search tree over its valid-time keys. Facts are inserted in known-time
order; an insertion copies only the nodes on its own path, so each insertion leaves behind a root that
still shows the tree as it stood then. An event picks the last root not younger than itself and looks for
the greatest valid-time key not after it. Nothing that became known later is reachable from that root.

All trees of a block of entities share one key space (entity, attribute, valid day), so building and
searching are numpy passes over whole levels rather than loops over facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known-time span of one shard. It bounds a shard by the calendar, whatever number of rows an entity has.
SHARD_DAYS = 8 * 365
#: Rows gathered before a block of whole entities is worked off.
BLOCK_ROWS = 200_000


class PersistentTree:
    """Path-copied binary search tree over key ranks 0..n_keys-1, one version per insertion.

    Level l of insertion i is node i * (depth + 1) + l; its on-path child is the next level of the same
    insertion, its other child the newest older node that passed through the sibling position.
    """

    def __init__(self, ranks: np.ndarray, n_keys: int):
        self.ranks = ranks = np.asarray(ranks, dtype=np.int64)
        self.depth = depth = max(1, int(n_keys - 1).bit_length()) if n_keys > 1 else 1
        n = len(ranks)
        order = np.arange(n, dtype=np.int64)
        self.left = np.full((depth, n), -1, dtype=np.int64)
        self.right = np.full((depth, n), -1, dtype=np.int64)
        for level in range(depth):
            child = ranks >> (depth - level - 1)
            keyed = np.sort(child * n + order)
            sibling = child ^ 1
            at = np.searchsorted(keyed, sibling * n + order) - 1
            found = keyed[np.maximum(at, 0)]
            other = np.where((at >= 0) & (found // n == sibling), found % n, -1)
            went_right = (child & 1).astype(bool)
            self.right[level] = np.where(went_right, order, other)
            self.left[level] = np.where(went_right, other, order)

    def predecessor(self, roots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For each (version, key rank): the insertion holding the greatest rank <= key there, or -1."""
        roots, keys = np.asarray(roots, dtype=np.int64), np.asarray(keys, dtype=np.int64)
        out = np.full(len(roots), -1, dtype=np.int64)
        if not len(self.ranks) or not len(roots):
            return out
        live = (roots >= 0) & (keys >= 0)
        node = np.where(live, roots, -1)
        keys = np.minimum(keys, (1 << self.depth) - 1)
        lower, lower_level = np.full(len(roots), -1, dtype=np.int64), np.zeros(len(roots), dtype=np.int64)
        for level in range(self.depth):
            inside, safe = node >= 0, np.maximum(node, 0)
            go_right = ((keys >> (self.depth - level - 1)) & 1).astype(bool)
            left = np.where(inside, self.left[level][safe], -1)
            turned = inside & go_right & (left >= 0)
            lower, lower_level = np.where(turned, left, lower), np.where(turned, level + 1, lower_level)
            node = np.where(inside, np.where(go_right, self.right[level][safe], left), -1)
        # Off the exact path: take the greatest key of the last subtree passed on the left.
        node, level_of = np.where(node >= 0, node, lower), np.where(node >= 0, self.depth, lower_level)
        for level in range(self.depth):
            step, safe = (node >= 0) & (level_of == level), np.maximum(node, 0)
            right = self.right[level][safe]
            down = np.where(right >= 0, right, self.left[level][safe])
            node, level_of = np.where(step, down, node), np.where(step, level + 1, level_of)
        return np.where(live, node, -1)


def _search(kind: np.ndarray, entity: np.ndarray, attr: np.ndarray, valid: np.ndarray, known: np.ndarray, fact: np.ndarray) -> tuple[np.ndarray, ...]:
    """kind 0 = fact, 1 = event (its day in known). Gives (event row, fact row) index pairs."""
    facts, events = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if not len(facts) or not len(events):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Within a day the lowest fact id is inserted last, so it is the one a root shows.
    facts = facts[np.lexsort((-fact[facts], known[facts]))]
    scope = np.stack([entity[facts], attr[facts]], 1)
    scopes, code = np.unique(scope, axis=0, return_inverse=True)
    code = code.reshape(-1)
    base, span = int(valid[facts].min()), int(valid[facts].max() - valid[facts].min()) + 2
    key = code * span + (valid[facts] - base)
    keys, ranks = np.unique(key, return_inverse=True)
    tree = PersistentTree(ranks, len(keys))
    # Each event asks once per attribute its entity has.
    first, last = np.searchsorted(scopes[:, 0], entity[events], "left"), np.searchsorted(scopes[:, 0], entity[events], "right")
    times = last - first
    ev = np.repeat(np.arange(len(events)), times)
    sc = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    day = known[events][ev]
    roots = np.searchsorted(known[facts], day, "right") - 1
    wanted = np.searchsorted(keys, sc * span + np.clip(day - base, -1, span - 2), "right") - 1
    wanted = np.where(day < base, -1, wanted)
    hit = tree.predecessor(roots, wanted)
    good = (hit >= 0) & (code[np.maximum(hit, 0)] == sc)
    return events[ev[good]], facts[hit[good]]


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["entity", "shard", "kind", "attr_code", "valid_day", "known_day", "fact_id", "attr"]
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        col = {n: table.column(n).to_numpy(zero_copy_only=False) for n in names[:7]}
        # one scope per entity and shard
        pair, entity = np.unique(np.stack([col["entity"], col["shard"]], 1), axis=0, return_inverse=True)
        e, f = _search(col["kind"], entity.reshape(-1), col["attr_code"], col["valid_day"], col["known_day"], col["fact_id"])
        return pa.RecordBatch.from_arrays(
            [pa.array(col["entity"][e]), table.column("attr").combine_chunks().take(pa.array(f)), pa.array(col["known_day"][e]), pa.array(col["valid_day"][f]), pa.array(col["known_day"][f]), pa.array(col["fact_id"][f])],
            names=["entity", "attr", "event_day", "valid_day", "known_day", "fact_id"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        e, s = whole.column("entity").to_numpy(), whole.column("shard").to_numpy()
        edge = np.flatnonzero((e[1:] != e[:-1]) | (s[1:] != s[:-1]))
        if not len(edge):
            continue
        cut = int(edge[-1]) + 1
        yield flush(whole.slice(0, cut))
        held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
    if held:
        yield flush(pa.Table.from_batches(held).combine_chunks())


def as_known(events: DataFrame, facts: DataFrame) -> DataFrame:
    """The attribute values each event could have known.

    events: (entity long, day date); facts: (entity long, attr string, valid date, known date, fact_id long).
    Gives (entity, day, attr, fact_id, valid, known): per event day and attribute, of the facts with valid and
    known on or before the day, the one with the latest valid, then latest known date, then lowest fact_id; no
    row if there is none. Rows with a null in any of those columns take no part. Repeated facts and event days
    count once; an empty side gives an empty result; extra columns are ignored.

    Both sides are reduced before they meet: facts to one per (entity, attr, valid, known), events to distinct
    days. So an entity that holds a third of all rows is bounded by the calendar, and its shards (known-time
    spans of SHARD_DAYS) spread over tasks. An event asks every shard begun by its day; the best answer wins.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    f = (
        facts.select("entity", "attr", "valid", "known", "fact_id").dropna()
        .groupBy("entity", "attr", "valid", "known").agg(F.min("fact_id").alias("fact_id"))
        .select("entity", F.floor(day("known") / SHARD_DAYS).alias("shard"), F.lit(0).alias("kind"), F.xxhash64("attr").alias("attr_code"), day("valid").alias("valid_day"), day("known").alias("known_day"), "fact_id", "attr")
    )
    shards = f.select("entity", "shard").distinct()
    e = (
        events.select("entity", "day").dropna().distinct().join(shards, "entity")
        .where(F.col("shard") <= F.floor(day("day") / SHARD_DAYS))
        .select("entity", "shard", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("attr_code"), F.lit(0).cast("bigint").alias("valid_day"), day("day").alias("known_day"), F.lit(0).cast("bigint").alias("fact_id"), F.lit(None).cast("string").alias("attr"))
    )
    blocks = f.unionByName(e).repartition("entity", "shard").sortWithinPartitions("entity", "shard")
    answers = blocks.mapInArrow(_work, "entity bigint, attr string, event_day bigint, valid_day bigint, known_day bigint, fact_id bigint")
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int"))
    return (
        answers.groupBy("entity", "event_day", "attr")
        .agg(F.max(F.struct("valid_day", "known_day", (-F.col("fact_id")).alias("minus_id"))).alias("best"))
        .select("entity", date("event_day").alias("day"), "attr", (-F.col("best.minus_id")).alias("fact_id"), date("best.valid_day").alias("valid"), date("best.known_day").alias("known"))
    )
