"""Queries that write the interactions (or what is derived from them) with the library's
sinks, below the shared checkpoint folder, and read them back with its readers."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, encoding, user_index
from ..schema import ALL_COLS, DEFAULT_SPLIT_TS, FEATURE_COLS, TARGETS
from ..session import ensure_checkpoint_dir
from ..sources import readers, sinks
from ..sources.fixtures import interactions, raw_interactions

BATCH, FIRST = 1000, 3
#: How logs are written: as the readers expect them, compressed (a file holds one task's rows).
LOG = {"sep": readers.SEP, "header": "false", "quote": "", "compression": "gzip"}
EXTENSION_PARTS = (["Retweet", "Quote"], ["Reply"], ["TopLevel"])


def _path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _log(spark: SparkSession, sf: str) -> str:
    path = _path(spark, "log")
    rows = interactions(spark, sf).select(*ALL_COLS)
    rows.write.options(**LOG).csv(path)
    return path


def log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The delimited log."""
    return readers.read_interactions(spark, _log(spark, sf))


def user_columns_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the user-centric columns of the delimited log."""
    return readers.read_user_columns(spark, _log(spark, sf))


def lines_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The log as untyped lines; a null field is an empty string."""
    return readers.read_lines(spark, _log(spark, sf)).select(*ALL_COLS)


def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The user index, range-partitioned and sorted."""
    from .catalog import _index_out
    path = _path(spark, "index")
    sinks.write_index(user_index.build_user_index(interactions(spark, sf)), path)
    return _index_out(readers.read_parquet(spark, path))


def predictions_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The predictions file."""
    path = _path(spark, "predictions")
    scored = interactions(spark, sf, with_score=True)
    sinks.write_predictions(scored.withColumns({f"score_{t}": F.col("score") for t in TARGETS}), path)
    return readers.read_results(spark, path, schema=readers.PREDICTION_SCHEMA)


def dictionary_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The language dictionary as a file with a header."""
    from .jobs import language_dictionary
    path = _path(spark, "dictionary")
    codes = language_dictionary(interactions(spark, sf))
    sinks.write_csv(codes.select(F.col("code").alias("encode"), F.col("value").alias("language_id")), path)
    return readers.read_dictionary(spark, path)


def stats_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the training rows, stored, reloaded and applied to validation rows."""
    path = _path(spark, "stats")
    ix = interactions(spark, sf).withColumn("y", F.col("like_ts").isNotNull())
    sinks.write_stats(encoding.group_stats(clean.train_split(ix, DEFAULT_SPLIT_TS), "type", "y"), path)
    rows = clean.val_split(ix, DEFAULT_SPLIT_TS).select("tweet_id", "b_user_id", "ts", "type")
    out = encoding.apply_group_encoding(rows, readers.read_parquet(spark, path), "type", "te")
    return out.withColumn("te", F.round("te", 6))


def first_batches_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first batches by global row order."""
    rows = interactions(spark, sf).select("tweet_id", "b_user_id", "ts", "type")
    batched = readers.with_batches(rows, BATCH, ["ts", "tweet_id", "b_user_id", "type"])
    return readers.first_batches(batched, FIRST)


LOOKUP = ("1", "12", "123")
MINI_BATCH, MINI = 4000, 256
ROW = ["ts", "tweet_id", "b_user_id", "type"]
VERSIONED = [*ROW, "a_follower_count", "tokens"]  # rows that tie have equal features
STREAM_MIDDLE, STREAM_LATE = "2024-01-16 00:00:00", 10


def lookup_ids() -> list[str]:
    """Ids of three consumers of the view, known without reading it."""
    return [hashlib.md5(k.encode()).hexdigest().upper() for k in LOOKUP]


def user_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """the index rows of literal users, read from the sorted index with its Bloom filters."""
    from .catalog import _index_out
    path = _path(spark, "index")
    sinks.write_index(user_index.build_user_index(interactions(spark, sf)), path)
    return _index_out(readers.lookup_users(spark, path, lookup_ids()))


def additive_features(spark: SparkSession, sf: str) -> DataFrame:
    """Log features published, then text features added as a version of their own, and read back together."""
    from ..functions import scalar as S
    from ..operators.ranking import global_row_index
    from .catalog import rnd
    rows, of = raw_interactions(spark, sf, VERSIONED, made=("ts",))
    df = global_row_index(rows, [of[c] for c in VERSIONED], "row_id", start=1)
    # Both versions come from one ranking; a lost block is computed anew.  Ids are kept as bytes.
    df = df.select("row_id", F.unhex(of["tweet_id"]).alias("tweet_id"), rnd(S.save_log(of["a_follower_count"])).alias("a_followers"),
                   rnd(S.token_len_log(of["tokens"])).alias("bert_token_len"), S.text_length(of["tokens"]).alias("token_chars")).persist()
    try:
        out = sinks.VersionedOutput(spark, _path(spark, "features"), "row_id")
        out.publish(df.select("row_id", "tweet_id", "a_followers"))
        out.add_columns(df.select("row_id", "tweet_id", "bert_token_len", "token_chars"))
    finally:
        df.unpersist()
    return out.read().withColumn("tweet_id", F.hex("tweet_id"))


def minibatch_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Batches and minibatches by file position of interactions that were written in order."""
    path = _path(spark, "ordered")
    df = interactions(spark, sf).select(*ROW)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *ROW).sortWithinPartitions(*ROW).write.parquet(path)
    rows = readers.with_batches(readers.with_file_position(spark.read.parquet(path)), MINI_BATCH, whole_files=True)
    return readers.with_minibatches(rows, MINI).select(*ROW, "batch_id", "minibatch_id")


def stream_day_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events come in as three folders (two by time, the last with late rows); one streaming run after each."""
    from ..streaming.index_stream import run_windowed_counts
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    middle = F.lit(STREAM_MIDDLE).cast(events.schema["ts"].dataType)
    late = F.pmod(F.col("event_id"), F.lit(STREAM_LATE)) == 0
    base = _path(spark, "t3")
    for k, rows in enumerate((~late & (F.col("ts") < middle), ~late & (F.col("ts") >= middle), late)):
        events.where(rows).select("user_id", "ts").write.parquet(f"{base}/in/part{k}")
        run_windowed_counts(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", events.select("user_id", "ts").schema)
    return spark.read.parquet(f"{base}/out")


def unlabelled_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A log without engagement columns, read as a submission reads it."""
    path = _path(spark, "unlabelled")
    rows = interactions(spark, sf).select(*FEATURE_COLS)
    rows.write.options(**LOG).csv(path)
    return readers.read_interactions(spark, path, "test")


def extension_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A folder with rows in ``.csv``, ``.tsv`` and ``.bak`` files; the last are not read."""
    path = _path(spark, "mixed")
    rows = interactions(spark, sf).select(*ALL_COLS)
    sinks.write_by_extension(rows, path, {kind: F.col("type").isin(part) for kind, part in zip(("csv", "tsv", "bak"), EXTENSION_PARTS)}, **LOG)
    return readers.read_interactions(spark, path)


def coloaded_features(spark: SparkSession, sf: str) -> DataFrame:
    """Derived columns dumped by row id without the rows they come from, and loaded beside them."""
    from ..functions import scalar as S
    from ..operators.ranking import global_row_index
    from .catalog import rnd
    old, new = _path(spark, "rows"), _path(spark, "derived")
    order = VERSIONED[:-1]  # no dumped column comes from the tokens, so rows that tie but for them are equal
    rows, of = raw_interactions(spark, sf, order, made=("ts",))
    rows = global_row_index(rows, [of[c] for c in order], "idx")
    # Both dumps come from one ranking; a lost block is computed anew.  Ids are kept as bytes.
    rows = rows.select("idx", *[F.unhex(of[c]).alias(c) for c in ("tweet_id", "b_user_id")], "ts", of["a_follower_count"].alias("a_follower_count")).persist()
    try:
        sinks.write_columns(rows, old, ["idx", "tweet_id", "b_user_id", "ts"])
        derived = rows.withColumns({"a_followers": rnd(S.save_log("a_follower_count")), "hour": S.hour_of_day("ts").cast("int"), "unused": F.lit(1)})
        sinks.write_columns(derived, new, ["idx", "a_followers", "hour"])
    finally:
        rows.unpersist()
    both = readers.coload(readers.read_parquet(spark, new), readers.read_parquet(spark, old))
    return both.withColumns({c: F.hex(c) for c in ("tweet_id", "b_user_id")})


def run_log_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """One logged run a target, appended to one log, read back and ordered by accuracy."""
    from ..operators.metrics import rank_runs
    from .catalog import balanced_accuracy
    scores, log = _path(spark, "scores"), _path(spark, "runs")
    sinks.write_columns(balanced_accuracy(spark, sf), scores, ["target", "accuracy", "precision"])
    rows = readers.read_parquet(spark, scores)
    for t in TARGETS:
        sinks.append_run_log(spark, rows.where(F.col("target") == t).drop("target"), log, run_name=t)
    back = readers.read_results(spark, log, header=True, schema="method string, accuracy double, precision double")
    return rank_runs(back.withColumn("method", F.regexp_replace("method", "^[^_]*_", "")), "accuracy")


def manifest_columns(spark: SparkSession, sf: str) -> DataFrame:
    """K7: the user index written with a manifest beside it; the index is read with the columns and types
    that the manifest names."""
    from pyspark.sql.types import StructType
    from .catalog import _index_out
    index, manifest = _path(spark, "index"), _path(spark, "manifest")
    df = user_index.build_user_index(interactions(spark, sf))
    sinks.write_index(df, index)
    sinks.write_manifest(spark, manifest, df, {"index_cutoff_ts": None})
    told = sinks.read_manifest(spark, manifest)
    return _index_out(spark.read.schema(StructType.fromJson(told["schema"])).parquet(index).select(*told["columns"]))


QUERIES = {f.__name__: f for f in (log_roundtrip, user_columns_roundtrip, lines_roundtrip, index_roundtrip,
                                   predictions_roundtrip, dictionary_roundtrip, stats_roundtrip, first_batches_rows,
                                   user_point_lookup, additive_features, minibatch_ids, stream_day_windows,
                                   unlabelled_roundtrip, extension_listing, coloaded_features, run_log_ranked, manifest_columns)}
