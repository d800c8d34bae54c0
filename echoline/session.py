"""Spark session helpers.

The library never hard-codes cluster settings; ``get_session`` only fills in
defaults that are unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Defaults for local runs and tests.  On a cluster these come from the
# submitting job and are left untouched (``setIfMissing`` semantics).
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE converts a join to broadcast only from *measured* shuffle sizes,
    # so the broadcast side always has a proven bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # small inputs still spread over all cores (cluster: leave at default)
    "spark.sql.files.openCostInBytes": "1048576",
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "echoline", **conf: str) -> SparkSession:
    """Return the active session or build one.  A key that the job was submitted
    with (``spark-submit``, its properties file, ``PYSPARK_SUBMIT_ARGS``) is kept;
    ``master``, ``conf`` and then the local defaults fill what is unset."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    wanted = {**LOCAL_DEFAULTS, **conf, "spark.app.name": app_name}
    wanted["spark.master"] = master or os.environ.get("SPARK_MASTER", f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    # The driver's memory must be known when its JVM starts; under spark-submit it runs already.
    launch = SparkConf().set("spark.driver.memory", conf.get("spark.driver.memory", "16g"))
    SparkContext._ensure_initialized(conf=launch)
    submitted = SparkConf()
    for key, value in wanted.items():
        submitted.setIfMissing(key, value)
    spark = SparkSession.builder.config(conf=submitted).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``, also set as Spark's own checkpoint folder.

    Where it is unset a local run (tests, bench) gets a scratch folder; a cluster job
    fails, since executors would write to disks of their own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="echoline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which a query's shuffle files go when it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in this block are removed when each has ended.  What else reads the
    same plan makes them anew."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared checkpoint folder and read back, and the path.

    Lineage is cut there, a column of few different values takes a byte or two a row, and the shuffle
    files of the plan that made the rows are removed once they are written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        # Row groups of 32 MB, as a task holds one while it writes.
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Remove what ``stored`` wrote, for rows that are read no more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
