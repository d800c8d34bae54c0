"""Structured Streaming forms of the incremental loops.

T1: the user index maintained file by file becomes a streaming aggregation
over a file source; Spark keeps the running counts in its state store, and
the result equals the batch index over the same files.
T2: batch-wise scoring becomes ``foreachBatch``.
T3: day counts become event-time windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import user_index as ui
from ..schema import LABELLED_SCHEMA, PROFILE_FIELDS
from ..sources.readers import SEP


def interaction_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                       fmt: str = "csv") -> DataFrame:
    """File-source stream of interaction logs (delimited or Parquet)."""
    r = spark.readStream.schema(LABELLED_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        return r.option("sep", SEP).option("header", "false").option("quote", "").csv(path)
    return r.parquet(path)


def streaming_user_index(events: DataFrame, cutoff_ts: int | None = None) -> DataFrame:
    """Running index (profile + 40 typed counts) from a stream; same
    aggregate as ``build_user_index`` (combined counts are derived on read)."""
    src = ui.before_cutoff(events, cutoff_ts) if cutoff_ts is not None else events
    rows = ui.role_rows(src)
    return rows.groupBy("user_id").agg(F.min(F.struct("first_seen", *PROFILE_FIELDS)).alias("_p"), *ui._count_exprs())


def flatten_index(state: DataFrame, with_combined: bool = True) -> DataFrame:
    """Turn the streaming state rows into the batch index layout."""
    out = state.select("user_id", *[F.col(f"_p.{c}").alias(c) for c in PROFILE_FIELDS],
                       *[c for c in state.columns if c.startswith("n_")])
    return out.withColumns(ui.combined_counts()) if with_combined else out


def run_incremental_index(spark: SparkSession, src_path: str, out_path: str, checkpoint: str,
                          max_files_per_trigger: int | None = None, fmt: str = "csv",
                          cutoff_ts: int | None = None) -> None:
    """T1, scale form: each micro-batch (a set of new files) becomes a partial
    index appended under ``load_id = batch_id`` (K2).  No state store and
    nothing on the driver; the checkpoint makes a restarted job skip files it
    already indexed, and a re-run batch overwrites its own ``load_id``."""
    from ..sources.sinks import write_partial_index

    def _batch(df: DataFrame, batch_id: int) -> None:
        part = ui.build_user_index(df, cutoff_ts, with_combined=False, with_first_seen=True)
        write_partial_index(part, out_path, f"{batch_id:012d}", mode="overwrite_partition")

    q = (interaction_stream(spark, src_path, max_files_per_trigger, fmt).writeStream.foreachBatch(_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_incremental_index(spark: SparkSession, out_path: str, with_combined: bool = True) -> DataFrame:
    """A6 over all partial indexes: one ``groupBy(user_id)``; counts summed,
    profile of the earliest row (partials carry ``first_seen``)."""
    out = ui.merge_partials(spark.read.parquet(out_path), "load_id").drop("first_seen")
    return out.withColumns(ui.combined_counts()) if with_combined else out


def score_stream(events: DataFrame, score: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str):
    """Score every micro-batch and append predictions (``foreachBatch``)."""
    from ..sources.sinks import write_predictions

    def _batch(df: DataFrame, batch_id: int) -> None:
        write_predictions(score(df), out_path, batch_id)   # idempotent per batch

    return (events.writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def windowed_day_counts(events: DataFrame, ts_col: str = "ts", user_col: str = "user_id",
                        watermark: str = "2 days") -> DataFrame:
    """Per (user, UTC day) activity with a watermark for late events."""
    dtype = dict(events.dtypes)[ts_col]
    if dtype in ("bigint", "int"):
        secs = F.col(ts_col)
    elif dtype == "timestamp_ntz":   # wall-clock time read as UTC, zone free
        c = F.col(ts_col)
        secs = F.unix_date(F.to_date(c)).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))
    else:
        secs = F.unix_seconds(F.col(ts_col))
    return (events.withColumn("_event_time", F.timestamp_seconds(secs)).withWatermark("_event_time", watermark)
            .groupBy(F.col(user_col), F.window("_event_time", "1 day")).agg(F.count(F.lit(1)).alias("n"))
            .select(user_col, F.unix_seconds(F.col("window.start")).alias("day_start"), F.col("n").cast("bigint")))


def run_windowed_counts(spark: SparkSession, src_path: str, out_path: str, checkpoint: str, schema, ts_col: str = "ts",
                        user_col: str = "user_id", watermark: str = "2 days") -> None:
    """T3 on a stream: day windows over the files that have come in below ``src_path`` since the last run.

    The state store holds open windows only: a window is written once the watermark (the latest
    event time seen, less ``watermark``) has passed its end, and rows of windows that had closed
    before the run are late and dropped.  Call it again when more files have come: the checkpoint
    has the state and the watermark."""
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src_path)
    query = (windowed_day_counts(events, ts_col, user_col, watermark).writeStream.outputMode("append").format("parquet")
             .option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
