"""Writers (K1-K12).  All are DataFrame writes; nothing passes the driver."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_columns(df: DataFrame, path: str, cols: list[str], mode: str = "errorifexists") -> None:
    """K1: chosen new + kept columns to Parquet."""
    df.select(*cols).write.mode(mode).parquet(path)


def write_index(index: DataFrame, path: str, num_partitions: int | None = None, mode: str = "overwrite") -> None:
    """K3: user index range-partitioned and sorted by key, so readers can
    merge-join or prune by ``user_id`` ranges; a Bloom filter a row group answers
    lookups of keys inside a range that are not there (``readers.lookup_users``)."""
    n = num_partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.repartitionByRange(n, "user_id").sortWithinPartitions("user_id").write.mode(mode) \
        .option("parquet.bloom.filter.enabled#user_id", "true").parquet(path)


def write_index_bucketed(index: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """K3 alternative: bucketed table on ``user_id`` so both enrichment joins
    read it without a shuffle of the index side."""
    index.write.mode(mode).bucketBy(buckets, "user_id").sortBy("user_id").saveAsTable(table)


def write_partial_index(index: DataFrame, path: str, load_id: str, mode: str = "append") -> None:
    """K2 (incremental): one partial index per load under ``load_id=...``.

    ``mode="overwrite_partition"`` replaces only this load's partition
    (dynamic partition overwrite), so re-running a load is idempotent."""
    w = index.withColumn("load_id", F.lit(load_id)).write.partitionBy("load_id")
    if mode == "overwrite_partition":
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode(mode)
    w.parquet(path)


def write_predictions(pred: DataFrame, path: str, batch_id: int | None = None) -> None:
    """K4: ``tweet_id, user_id, reply, retweet, retweet_comment, like``; no header; append.

    With ``batch_id`` (streaming) each batch replaces only its own
    ``batch_id=`` folder, so a batch replayed after a failure is idempotent."""
    out = pred.select("tweet_id", F.col("b_user_id").alias("user_id"),
                      *[F.col(f"score_{t}") for t in ("reply", "retweet", "retweet_comment", "like")])
    if batch_id is None:
        out.write.mode("append").option("header", "false").csv(path)
        return
    (out.withColumn("batch_id", F.lit(int(batch_id))).write.partitionBy("batch_id").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("header", "false").csv(path))


def append_run_log(spark: SparkSession, metrics_row: DataFrame, path: str, run_name: str | None = None) -> None:
    """K5: one row per run, named and timestamped, appended."""
    stamp = time.strftime("%Y-%m-%dT%H-%M-%S")
    name = f"{stamp}_{run_name}" if run_name else stamp
    metrics_row.select(F.lit(name).alias("method"), "*").coalesce(1).write.mode("append").option("header", "true").csv(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """K6: encoding statistics (reload with ``spark.read.parquet``)."""
    stats.write.mode("overwrite").parquet(path)


def write_manifest(spark: SparkSession, path: str, df: DataFrame, spec: dict) -> None:
    """K7: schema + spec as one JSON text row."""
    doc = json.dumps({"columns": df.columns, "schema": json.loads(df.schema.json()), "spec": spec})
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """K8: e.g. conditional probabilities."""
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)


def write_by_extension(df: DataFrame, path: str, extensions: dict[str, Column], **options: str) -> None:
    """One folder of delimited files, the rows of each condition in files of its extension (the first
    condition that holds counts; rows of none are left out).  The rows are computed and written once, into
    a hidden folder; then its files are moved by name, which moves no data on the driver."""
    kind = F.coalesce(*[F.when(rows, F.lit(k)) for k, rows in extensions.items()])
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    df.withColumn("_kind", kind).where("_kind IS NOT NULL").write.partitionBy("_kind").options(**options).csv(staged)
    spark, hadoop = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in extensions:
        folder = hadoop(f"{staged}/_kind={k}")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f.getPath().getName()
            if name.startswith("part-") and not fs.rename(f.getPath(), hadoop(f"{path}/{name.replace('.csv', f'.{k}', 1)}")):
                raise OSError(f"{name} could not be moved to {path}")
    fs.delete(hadoop(staged), True)


def versioned_path(base: str, version: str | None = None) -> str:
    """A fresh output location instead of moving old output away."""
    return f"{base}/v={version or time.strftime('%Y%m%dT%H%M%S')}"


class VersionedOutput:
    """A folder of output versions and one small pointer file that names the current one.

    ``publish`` writes a new version beside the old ones and then replaces the pointer by a rename,
    so readers see the old output until the new one is whole, and a failed write changes nothing.
    ``add_columns`` writes only columns that are not there yet; the pointer says which version has
    which columns, and ``read`` joins them on the row key.  Old versions stay as the archive
    (``versions``); files go through Hadoop's file system, so any store that Spark writes to will do."""

    POINTER = "current.json"

    def __init__(self, spark: SparkSession, base: str, key: str):
        self.spark, self.base, self.key = spark, base.rstrip("/"), key

    def _fs(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def current(self) -> list[dict]:
        """The current parts: ``path`` and ``columns`` of each; empty before the first ``publish``."""
        fs, p = self._fs(f"{self.base}/{self.POINTER}")
        if not fs.exists(p):
            return []
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.base}/{self.POINTER}").collect()))

    def versions(self) -> list[str]:
        """All versions that were written whole, oldest first."""
        fs, p = self._fs(self.base)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if n.startswith("v=") and self._whole(n))

    def _whole(self, name: str) -> bool:
        fs, p = self._fs(f"{self.base}/{name}/_SUCCESS")
        return fs.exists(p)

    def _write(self, df: DataFrame) -> str:
        name = f"v={time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.base}/{name}")
        return name

    def _point(self, parts: list[dict]) -> None:
        from pyspark.errors import PySparkRuntimeError
        fs, new = self._fs(f"{self.base}/next-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        try:
            context.rename(new, self._fs(f"{self.base}/{self.POINTER}")[1], options)
        except Exception as error:
            raise PySparkRuntimeError(f"the pointer of {self.base} could not be replaced; its old version stays current") from error

    def publish(self, df: DataFrame) -> None:
        """A new version of all columns; it becomes current once it is written."""
        self._point([{"path": self._write(df), "columns": [c for c in df.columns if c != self.key]}])

    def add_columns(self, df: DataFrame) -> list[str]:
        """Write the columns of ``df`` (with the key) that no part has yet; returns their names."""
        parts = self.current()
        have = {c for part in parts for c in part["columns"]}
        new = [c for c in df.columns if c != self.key and c not in have]
        if new:
            self._point([*parts, {"path": self._write(df.select(self.key, *new)), "columns": new}])
        return new

    def read(self, columns: list[str] | None = None) -> DataFrame:
        """The current columns (or some of them), joined on the key; only the parts that are needed are read."""
        parts = self.current()
        if not parts:
            raise FileNotFoundError(f"nothing was published below {self.base}")
        wanted = columns or [c for part in parts for c in part["columns"]]
        out = None
        for part in parts:
            names = [c for c in part["columns"] if c in wanted]
            if names:
                df = self.spark.read.parquet(f"{self.base}/{part['path']}").select(self.key, *names)
                out = df if out is None else out.join(df, self.key)
        return out.select(self.key, *wanted)


def missing_columns(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """Columns not yet stored (additive mode skips the rest)."""
    try:
        have = set(spark.read.parquet(path).columns)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        have = set()  # nothing stored yet
    return [c for c in wanted if c not in have]
