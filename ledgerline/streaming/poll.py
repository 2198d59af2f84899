"""New filings as a stream, acknowledged only once their outputs are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import drop_path, path_exists, shared_path


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """Accessions done so far, none before the first write. A store that cannot be read is an error, not an empty one."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "accession_number string")
    return spark.read.schema("accession_number string").parquet(path)


def poll_filings(stream: DataFrame, process: Callable[[DataFrame], tuple[DataFrame, DataFrame]], completed: str, out: str, checkpoint: str) -> None:
    """Run the available input once. Each batch: drop accessions already completed, keep the first event of each, hand
    them to process, which gives (results, accessions done); results are written, then the acknowledgement.

    A batch may run again after a failure, so outputs are written per batch id and overwrite what that batch wrote
    before. Accessions that process does not report stay open and are offered again by a later call.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        one = df.where(F.col("accession_number").isNotNull()).groupBy("accession_number").agg(F.min_by(F.struct(*[c for c in df.columns if c != "accession_number"]), "event_id").alias("e"))
        new = one.join(read_completed(spark, completed), "accession_number", "left_anti").select("accession_number", "e.*")
        results, done = process(new)
        results.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written = spark.read.parquet(f"{out}/batch={batch_id}")
        done = done.join(written.select("accession_number").distinct(), "accession_number", "left_semi")
        done.select("accession_number").write.mode("append").parquet(completed)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A parquet table, of one file or a folder, as a stream. The path is written as a pattern, as a source must else
    be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def poll_events(spark: SparkSession, path: str) -> DataFrame:
    """First event of every accession in a parquet table, found by the polling stream."""
    source = stream_table(spark, path, 64)
    done, out, state = (shared_path(spark, f"poll-{x}") for x in ("done", "out", "state"))
    poll_filings(source, lambda new: (new, new), done, out, state)
    return spark.read.option("basePath", out).parquet(out).drop("batch")


def windowed_counts(stream: DataFrame, ts: str, size: str, *by: str, late: str = "1 day") -> DataFrame:
    """Counts per tumbling window. A time without zone becomes a timestamp first, as watermarks need one."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(F.window("_ts", size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


#: Far beyond any event, but not so far that adding a window to it leaves the range of timestamps.
END_OF_TIME = "9000-01-01 00:00:00"


def closed_windows(spark: SparkSession, path: str, ts: str, size: str, *by: str, late: str = "1 day") -> DataFrame:
    """(w, …by, n): every window of the parquet table at path, each written once, when the watermark has passed its end,
    and then dropped from the state. A row at the end of time, without a window in the result, closes the last ones.

    The table is read as one batch, so no row is late however the files are ordered; over a live source rows later than
    `late` would be left out, as the watermark says.
    """
    shape = spark.read.parquet(path).select(ts, *by)
    out, state, end = (shared_path(spark, f"windows-{x}") for x in ("out", "state", "end"))
    shape.limit(0).unionByName(spark.range(1).select(F.lit(END_OF_TIME).cast(shape.schema[ts].dataType).alias(ts), *[F.lit(None).cast(shape.schema[c].dataType).alias(c) for c in by])).write.parquet(end)
    both = stream_table(spark, path, 1_000_000_000).select(ts, *by).unionByName(spark.readStream.schema(shape.schema).parquet(end))
    counts = windowed_counts(both, ts, size, *by, late=late)
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    drop_path(spark, state, end)
    return spark.read.schema(counts.schema).parquet(out).where(F.col("w.start") < F.lit(END_OF_TIME).cast("timestamp"))
