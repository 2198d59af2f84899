"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    """A session for local work; a cluster supplies its own, with a shared spark.checkpoint.dir."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the folder of setCheckpointDir.

    A session that names neither gets a folder of this machine in local mode; on a cluster, whose executors would not
    see it, that is an error.
    """
    root = spark.conf.get(SHARED_DIR_CONF, None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else _local_root(spark)
        spark.conf.set(SHARED_DIR_CONF, root)
    return root.rstrip("/")


def _local_root(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"working tables need a folder that all executors of {master} share: set {SHARED_DIR_CONF}")
    return "file://" + tempfile.mkdtemp(prefix="ledgerline-")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_registered: set[str] = set()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's part of the shared folder, which is removed when the application ends."""
    own = f"{shared_root(spark)}/ledgerline/{spark.sparkContext.applicationId}"
    if own not in _registered:
        p, fs = _hadoop(spark, own)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _registered.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


#: Tables up to this size are dealt out where they come in fewer tasks than there are cores.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """For work that costs far more than reading: a small table of few files, which would be few tasks, dealt out over
    the cores. Any other is left as it is, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES or 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores)


def make_path(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at path; a storage that cannot be reached is an error, not an absence."""
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


#: Input bytes a shuffle partition is meant for where an operator fixes their number itself.
PARTITION_BYTES = 128 << 20


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions by the planner's size of df, at least as many as the session asks for. For scans and what
    narrows them; sizes the planner gives joins are products, so where it knows none the rows are counted."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.count() * UNKNOWN_ROW_BYTES
    return max(least, size // PARTITION_BYTES)


#: What a row is taken for where the planner knows no size.
UNKNOWN_ROW_BYTES = 1024


def drop_path(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p, fs = _hadoop(spark, path)
        fs.delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; they may not have its folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="ledgerline-"), "ledgerline_package")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(app)
