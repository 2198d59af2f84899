"""Pairing with the nearest row in time, as a stateful streaming join.

Both sides are fed in time order. Per share of the entities the state buffers left days that still wait and right days
that may still match. Once the watermark has passed a left day's tolerance horizon no nearer right row can arrive: the
pair is emitted and right rows out of reach of every later left row are evicted. So the state spans the tolerance, not
the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.session import drop_path, make_path, materialize, shared_path

DAY_MS = 86_400_000
#: Rows of a slice, which is one run of the stream.
ROWS_PER_SLICE = 20_000_000
LEAST_SLICES = 2
#: Entities whose buffers share one state, as each call of the state function has its price.
ENTITIES_PER_STATE = 2_000
#: Rows a state partition is meant for, of a slice or of what the state holds.
ROWS_PER_PARTITION, LEAST_PARTITIONS = 100_000, 4
_OUT = "entity bigint, class string, left_day int, right_day int, right_id bigint"
_LEFT, _RIGHT, _MARK = 0, 1, 2
#: A buffered row: right rows have an id, left rows wait.
_HELD = np.dtype([("entity", "<i8"), ("class", "<i4"), ("day", "<i4"), ("side", "<i4"), ("id", "<i8")])


def match(rows: np.ndarray, mark: int, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows that are decided, their right rows, rows still needed) when all rows before day mark are known.

    Nearest right row of the same entity and class within tolerance; the earlier day, then the lowest id on a tie. A
    decided left row without a partner is only dropped.
    """
    rows = rows[np.lexsort((rows["id"], rows["side"], rows["day"], rows["class"], rows["entity"]))]
    right = np.flatnonzero(rows["side"] == _RIGHT)
    r = rows[right]
    fresh = np.ones(len(r), bool)  # of equal days the lowest id comes first
    for f in ("entity", "class", "day"):
        fresh[1:] &= r[f][1:] == r[f][:-1]
    fresh[1:] = ~fresh[1:]
    right, r = right[fresh], r[fresh]
    left = np.flatnonzero(rows["side"] == _LEFT)
    done = left[rows["day"][left] + tolerance < mark]
    d = rows[done]
    # A left row sorts before the right row of its own day, so that one counts as coming after it, at no distance.
    at = np.searchsorted(right, done)
    best, apart = np.full(len(done), -1), np.full(len(done), tolerance + 1)
    for side in (at - 1, at):
        ok = (side >= 0) & (side < len(r))
        c = r[np.where(ok, side, 0)] if len(r) else np.zeros(len(done), _HELD)
        gap = np.abs(c["day"].astype(np.int64) - d["day"])
        better = ok & (c["entity"] == d["entity"]) & (c["class"] == d["class"]) & (gap < apart)
        best, apart = np.where(better, side, best), np.where(better, gap, apart)
    hit = best >= 0
    waiting = rows[left[rows["day"][left] + tolerance >= mark]]
    # Right rows within reach of a waiting left row or of one that may still come, which is no earlier than mark.
    low = min(mark, int(waiting["day"].min())) if len(waiting) else mark
    keep = r[r["day"] >= low - tolerance]
    return d[hit], r[best[hit]] if hit.any() else r[:0], np.concatenate([waiting, keep])


def _step(tolerance: int, shift: int, classes: list[str]):
    """shift: the day that the stream's first watermark stands for; classes: names by their number."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(state.get[0], _HELD)] if state.exists else []
        for f in frames:
            new = np.empty(len(f), _HELD)
            for name in _HELD.names:
                new[name] = f[name].to_numpy()
            parts.append(new[new["side"] != _MARK])
        mark = state.getCurrentWatermarkMs() // DAY_MS + shift  # whole days known to be over are those before it
        left, right, kept = match(np.concatenate(parts) if parts else np.empty(0, _HELD), mark, tolerance)
        if len(kept):
            state.update((kept.tobytes(),))
            waiting = kept["day"][kept["side"] == _LEFT]
            wake = int(waiting.min() if len(waiting) else kept["day"].max()) + tolerance + 1
            state.setTimeoutTimestamp(int(max((wake - shift) * DAY_MS, state.getCurrentWatermarkMs() + 1)))
        elif state.exists:
            state.remove()
        if len(left):
            yield pd.DataFrame({"entity": left["entity"], "class": [classes[c] for c in left["class"].tolist()], "left_day": left["day"], "right_day": right["day"], "right_id": right["id"]})

    return step


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The nearest right row of each left (entity, class, day), within tolerance days.

    left: (entity long, class string, day date); right: the same and right_id long. Gives one row (entity, class, day,
    right_day, right_id) per distinct left key that has a partner: fewest days between, then the earlier day, then the
    lowest id. Rows with nulls take no part, repeated rows count once, an empty side gives an empty result. Classes are
    few by their meaning; their names are collected.

    Both sides are reduced to distinct days per entity before the stream, so that no entity holds more rows than the
    calendar has days. The stream is run once for each slice of the days, in their order, over one checkpoint; a slice
    is written only when all before it are processed, so the order does not hang on times of files and the watermark
    needs no lag. A marker row with the last slice, dated after the end, brings the last pairs out.
    """
    spark = left.sparkSession
    as_day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    both = left.select("entity", "class", as_day("day").alias("day")).dropna().distinct().select("*", F.lit(_LEFT).alias("side"), F.lit(0).cast("bigint").alias("id")).unionByName(
        right.select("entity", "class", as_day("day").alias("day"), F.col("right_id").alias("id")).dropna().groupBy("entity", "class", "day").agg(F.min("id").alias("id")).withColumn("side", F.lit(_RIGHT))
    )
    log = materialize(both, "nearest-log")
    rows, entities, lo, hi, classes = log.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("entity", "class")), F.min("day"), F.max("day"), F.array_sort(F.collect_set("class"))).first()
    if lo is None:
        return spark.createDataFrame([], "entity bigint, class string, day date, right_day date, right_id bigint")
    slices = max(LEAST_SLICES, -(-rows // rows_per_slice))
    cuts = log.agg(F.percentile_approx("day", [i / slices for i in range(1, slices)], 10 * slices)).first()[0]
    edges = [lo, *sorted({c + 1 for c in cuts if lo < c + 1 <= hi}), hi + 1]
    feed, out, state = (shared_path(spark, f"nearest-{x}") for x in ("feed", "out", "state"))
    at_once = max(-(-rows // slices), rows * (2 * tolerance + 1) // (hi - lo + 1))
    parts = max(LEAST_PARTITIONS, at_once // ROWS_PER_PARTITION)
    share = F.pmod(F.xxhash64("entity", "class"), F.lit(max(parts, entities // ENTITIES_PER_STATE)))
    shift = lo - 1  # event time begins a day after the first watermark, 1970-01-01, so no day is late, however early
    number = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    fed = log.select("entity", F.try_element_at(number, "class").alias("class"), "day", "side", "id", share.alias("share"), F.timestamp_seconds((F.col("day") - shift).cast("bigint") * 86_400).alias("ts"))
    paired = (
        spark.readStream.schema(fed.schema).parquet(make_path(spark, feed))
        .withWatermark("ts", "0 days")
        .groupBy("share")
        .applyInPandasWithState(_step(tolerance, shift, classes), _OUT, "buffer binary", "append", GroupStateTimeout.EventTimeTimeout)
    )
    end = hi + tolerance + 2
    marker = spark.range(1).select(F.lit(-1).cast("bigint").alias("entity"), F.lit(0).alias("class"), F.lit(end).alias("day"), F.lit(_MARK).alias("side"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("share"), F.timestamp_seconds(F.lit((end - shift) * 86_400)).alias("ts"))
    spans = list(zip(edges, edges[1:]))
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # the stream takes it when it starts
    try:
        for a, b in spans:
            part = fed.where((F.col("day") >= a) & (F.col("day") < b))
            (part.unionByName(marker) if b == spans[-1][1] else part).write.mode("append").parquet(feed)
            paired.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    drop_path(spark, feed, state)
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    return spark.read.schema(_OUT).parquet(out).select("entity", "class", date("left_day").alias("day"), date("right_day").alias("right_day"), "right_id")
