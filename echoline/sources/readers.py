"""Readers for interaction logs and side tables.

Logs are headerless, ``\\x01``-separated, unquoted, with ``\\t`` inside
multi-valued cells.  A directory of part files is one DataFrame; Spark
splits files into ``spark.sql.files.maxPartitionBytes`` blocks (S5) and
prunes unread columns (S3, S7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ALL_COLS, FEATURE_COLS, LABEL_COLS, USER_CENTRIC_COLS, schema_for

SEP = "\u0001"
#: Files of a log; Spark decompresses ``.gz`` by the name.
LOG_FILES = "*.{csv,tsv,csv.gz,tsv.gz}"


def read_interactions(spark: SparkSession, path: str, mode: str = "train", columns: list[str] | None = None,
                      glob: str | None = LOG_FILES, recursive: bool = False) -> DataFrame:
    """Typed scan of the delimited log (labelled unless ``mode='test'``).
    A malformed line fails the job: read as nulls it would count as "no engagement"."""
    reader = (spark.read.schema(schema_for(mode)).option("sep", SEP).option("header", "false")
              .option("quote", "").option("escape", "").option("mode", "FAILFAST"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def read_user_columns(spark: SparkSession, path: str, glob: str | None = LOG_FILES) -> DataFrame:
    """S3: the 16 user-centric columns only (pruned at the scan)."""
    return read_interactions(spark, path, "train", USER_CENTRIC_COLS, glob)


def read_lines(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Untyped line scan: strip, split on \\x01, every field a string."""
    names = names or ALL_COLS
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), SEP)
    return spark.read.text(path).select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S6/S7."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def lookup_users(spark: SparkSession, path: str, user_ids: list[str]) -> DataFrame:
    """rows of an index of ``sinks.write_index`` for literal hex ids.  The keys are literals in the
    filter, so Parquet skips files and row groups by their key range and Bloom filter."""
    keys = [int(u[-16:], 16) for u in user_ids]
    signed = [k - 2**64 if k >= 2**63 else k for k in keys]
    return spark.read.parquet(path).where(F.col("user_id").isin(signed) if len(signed) != 1 else F.col("user_id") == signed[0])


def with_source_file(df: DataFrame) -> DataFrame:
    """Attach the part-file name (``_metadata``) for file-level operators."""
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def with_file_position(df: DataFrame) -> DataFrame:
    """``source_file`` and ``row_in_file`` of each row of a Parquet scan: a position that does not depend on
    how the files are split into partitions."""
    return df.withColumns({"source_file": F.col("_metadata.file_name"), "row_in_file": F.col("_metadata.row_index")})


def file_order(df_with_file: DataFrame, seed: int | None = None) -> DataFrame:
    """Part files in name order, or a seeded random order (hash rank)."""
    files = df_with_file.select("source_file").distinct()
    key = F.col("source_file") if seed is None else F.xxhash64("source_file", F.lit(seed))
    from ..operators.ranking import global_row_index
    return global_row_index(files, [key, F.col("source_file")], "file_rank")


def with_batches(df: DataFrame, batch_size: int, order: list | None = None, whole_files: bool = False) -> DataFrame:
    """Batch id from a global row number (re-batching across file borders
    without moving rows through one task).  Rows go by ``order``, else by their file
    position (``with_file_position``), else by their place in the Spark partition.

    ``whole_files``: ``df`` has file positions and all rows of its files (checked: a missing row fails
    the job), so the rows before a file are counted and no row is moved.  ``row_in_batch`` is kept
    then, for ``with_minibatches``."""
    from ..operators.ranking import global_row_index
    if whole_files:
        numbered = _numbered_by_file(df).withColumn("batch_id", F.floor(F.col("_rn") / batch_size).cast("bigint"))
        return numbered.withColumn("row_in_batch", F.col("_rn") - F.col("batch_id") * batch_size).drop("_rn")
    if order is None:
        order = _position(df)
    if order is None:
        df = df.withColumn("_row_in_file", F.monotonically_increasing_id())
        order = ([F.col("source_file")] if "source_file" in df.columns else []) + [F.col("_row_in_file")]
    out = global_row_index(df, order, "_rn")
    return out.withColumn("batch_id", F.floor(F.col("_rn") / batch_size).cast("bigint")).drop("_rn", "_row_in_file")


def first_batches(df_batched: DataFrame, n: int) -> DataFrame:
    """Keep batches 0..n-1 (``n = -1``: all)."""
    return df_batched if n < 0 else df_batched.filter(F.col("batch_id") < n)


def _numbered_by_file(df: DataFrame) -> DataFrame:
    """``_rn``: rows of the files before (by name) plus ``row_in_file``; a row a file is broadcast."""
    files = df.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"), (F.max("row_in_file") + 1).alias("_end"))
    before = F.sum("_n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.when(F.col("_n") == F.col("_end"), F.coalesce(before, F.lit(0).cast("bigint")))
    files = files.select("source_file", whole.otherwise(F.raise_error(F.lit("whole_files: rows of a file are missing")).cast("bigint")).alias("_before"))
    return df.join(F.broadcast(files), "source_file").withColumn("_rn", F.col("_before") + F.col("row_in_file")).drop("_before")


def _position(df: DataFrame) -> list | None:
    return [F.col("source_file"), F.col("row_in_file")] if {"source_file", "row_in_file"} <= set(df.columns) else None


def with_minibatches(df_batched: DataFrame, size: int, order: list | None = None) -> DataFrame:
    """Second-level slice id inside each batch.  Rows go by ``order``, else by their file position
    (the same ids under any partitioning), else by their place in the Spark partition.  Rows with
    ``row_in_batch`` (``with_batches(..., whole_files=True)``) are not moved."""
    from ..operators.ranking import global_row_index
    if order is None and "row_in_batch" in df_batched.columns:
        return df_batched.withColumn("minibatch_id", F.floor(F.col("row_in_batch") / size).cast("bigint")).drop("row_in_batch")
    order = order or _position(df_batched) or [F.monotonically_increasing_id()]
    r = global_row_index(df_batched, [F.col("batch_id"), *order], "_rn")
    start = r.groupBy("batch_id").agg(F.min("_rn").alias("_start"))
    return r.join(start, "batch_id").withColumn("minibatch_id", F.floor((F.col("_rn") - F.col("_start")) / size).cast("bigint")) \
        .drop("_rn", "_start")


def coload(new: DataFrame, old: DataFrame, key: str = "idx") -> DataFrame:
    """Original and derived columns side by side by row id."""
    return new.join(old, key, "inner")


def read_dictionary(spark: SparkSession, path: str, code: str = "encode", value: str = "language_id") -> DataFrame:
    """``(code, value)`` CSV with header -> ``value, code``."""
    df = spark.read.option("header", "true").csv(path)
    return df.select(F.col(value).alias("value"), F.col(code).cast("bigint").alias("code"))


def read_results(spark: SparkSession, path: str, header: bool = False, schema: str | None = None) -> DataFrame:
    """Comma-separated predictions / run logs."""
    r = spark.read.option("header", str(header).lower())
    if schema:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", "true")
    return r.csv(path)


PREDICTION_SCHEMA = "tweet_id string, user_id string, reply double, retweet double, retweet_comment double, like double"

__all__ = ["read_interactions", "read_user_columns", "read_lines", "read_parquet", "with_source_file", "file_order",
           "with_batches", "first_batches", "with_minibatches", "coload", "read_dictionary", "read_results",
           "PREDICTION_SCHEMA", "FEATURE_COLS", "LABEL_COLS"]
