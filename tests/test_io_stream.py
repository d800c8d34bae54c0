"""File round trips (sources/sinks) and the streaming index."""

import os

from pyspark.sql import functions as F

from echoline.operators import user_index
from echoline.sources import readers, sinks
from echoline.streaming import index_stream

SEP = "\u0001"


def _write_log(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _line(i, labelled=True, empty_cells=False):
    hx = lambda n: format(n, "032X")
    cells = ["101\t4321\t102", "" if empty_cells else "AB\tCD", hx(1000 + i), "" if empty_cells else "Photo\tPhoto",
             "", "", "TopLevel" if i % 2 else "Quote", hx(7), str(1613692800 + i), hx(i % 3), "150", "20", "true",
             "1500000000", hx(10 + i % 4), "90", "30", "false", "1500000001", "true"]
    if labelled:
        cells += [str(1613692900 + i) if i % 2 else "", "", "", str(1613692999) if i % 3 == 0 else ""]
    return SEP.join(cells)


def test_delimited_scan_labelled_and_unlabelled(spark, scratch):
    _write_log(f"{scratch}/log/part-0.tsv", [_line(i) for i in range(6)] + [_line(9, empty_cells=True)])
    _write_log(f"{scratch}/log/ignored.txt", [_line(99)])
    df = readers.read_interactions(spark, f"{scratch}/log")
    assert df.count() == 7 and len(df.columns) == 24
    r = df.filter(F.col("tweet_id") == format(1001, "032X")).first()
    assert r.reply_ts == 1613692901 and r.like_ts is None and r.a_is_verified is True and r.ts == 1613692801
    _write_log(f"{scratch}/test/part-0.csv", [_line(i, labelled=False) for i in range(3)])
    assert len(readers.read_interactions(spark, f"{scratch}/test", mode="test").columns) == 20
    lines = readers.read_lines(spark, f"{scratch}/log/part-0.tsv")
    assert lines.count() == 7 and dict(lines.dtypes)["ts"] == "string"


def test_index_write_read_and_batches(spark, scratch):
    _write_log(f"{scratch}/log/part-0.csv", [_line(i) for i in range(10)])
    _write_log(f"{scratch}/log/part-1.csv", [_line(i) for i in range(10, 15)])
    df = readers.read_interactions(spark, f"{scratch}/log")
    idx = user_index.build_user_index(df)
    sinks.write_index(idx, f"{scratch}/idx")
    back = spark.read.parquet(f"{scratch}/idx")
    assert sorted(back.collect()) == sorted(idx.collect())
    b = readers.with_batches(readers.with_source_file(df), 4)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [3, 4, 4, 4]
    assert readers.first_batches(b, 2).count() == 8


def test_predictions_and_run_log(spark, scratch):
    pred = spark.createDataFrame([("t1", "u1", 0.1, 0.2, 0.3, 0.4)],
                                 "tweet_id string, b_user_id string, score_reply double, score_retweet double, "
                                 "score_retweet_comment double, score_like double")
    sinks.write_predictions(pred, f"{scratch}/pred")
    sinks.write_predictions(pred, f"{scratch}/pred")
    back = readers.read_results(spark, f"{scratch}/pred", schema=readers.PREDICTION_SCHEMA)
    assert back.count() == 2 and back.first().like == 0.4
    sinks.append_run_log(spark, spark.createDataFrame([(1.5, 0.2)], "TOTAL_reply_rce double, TOTAL_reply_avg_prec double"),
                         f"{scratch}/log", "run1")
    log = readers.read_results(spark, f"{scratch}/log", header=True)
    assert log.first().method.endswith("_run1")


def test_manifest_and_stats(spark, scratch):
    df = spark.createDataFrame([("a", 2, 0.5, 0.4)], "cat string, count long, mean double, total_mean double")
    sinks.write_stats(df, f"{scratch}/stats")
    assert spark.read.parquet(f"{scratch}/stats").collect() == df.collect()
    sinks.write_manifest(spark, f"{scratch}/manifest", df, {"smoothing": 20})
    m = sinks.read_manifest(spark, f"{scratch}/manifest")
    assert m["columns"] == df.columns and m["spec"]["smoothing"] == 20
    assert sinks.missing_columns(spark, f"{scratch}/stats", ["cat", "new_col"]) == ["new_col"]


def test_streaming_index_equals_batch(spark, scratch):
    for p in range(3):
        _write_log(f"{scratch}/stream/part-{p}.csv", [_line(i) for i in range(p * 5, p * 5 + 5)])
    q = (index_stream.streaming_user_index(index_stream.interaction_stream(spark, f"{scratch}/stream", 1))
         .writeStream.outputMode("complete").format("memory").queryName("t1_test")
         .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = index_stream.flatten_index(spark.table("t1_test"))
    batch = user_index.build_user_index(readers.read_interactions(spark, f"{scratch}/stream"))
    cols = batch.columns
    assert sorted(streamed.select(*cols).collect()) == sorted(batch.collect())


def test_windowed_day_counts(spark, scratch):
    rows = [(1, 86400 * 3 + 5), (1, 86400 * 3 + 99), (2, 86400 * 4)]
    df = spark.createDataFrame(rows, "user_id long, ts long")
    out = index_stream.windowed_day_counts(df).collect()
    assert sorted((r.user_id, r.n) for r in out) == [(1, 2), (2, 1)]


def test_foreach_batch_scoring(spark, scratch):
    for p in range(2):
        _write_log(f"{scratch}/in/part-{p}.csv", [_line(i) for i in range(p * 4, p * 4 + 4)])
    ev = index_stream.interaction_stream(spark, f"{scratch}/in", max_files_per_trigger=1)

    def score(df):
        return df.withColumns({f"score_{t}": F.lit(0.5) for t in ("reply", "retweet", "retweet_comment", "like")})

    q = index_stream.score_stream(ev, score, f"{scratch}/pred", f"{scratch}/ck")
    q.awaitTermination()
    out = readers.read_results(spark, f"{scratch}/pred", schema=readers.PREDICTION_SCHEMA)
    assert out.count() == 8 and out.first().reply == 0.5
    # replaying a batch (as after a failure) rewrites its own folder only
    sinks.write_predictions(score(readers.read_interactions(spark, f"{scratch}/in/part-0.csv", glob=None)), f"{scratch}/pred", 0)
    assert readers.read_results(spark, f"{scratch}/pred", schema=readers.PREDICTION_SCHEMA).count() == 8


def test_column_dump_and_partial_index(spark, scratch):
    _write_log(f"{scratch}/log/part-0.csv", [_line(i) for i in range(6)])
    df = readers.read_interactions(spark, f"{scratch}/log")
    sinks.write_columns(df, f"{scratch}/cols", ["tweet_id", "ts"])
    assert spark.read.parquet(f"{scratch}/cols").columns == ["tweet_id", "ts"]
    idx = user_index.build_user_index(df, with_combined=False)
    sinks.write_partial_index(idx, f"{scratch}/parts", "load1")
    sinks.write_partial_index(idx, f"{scratch}/parts", "load2")
    parts = spark.read.parquet(f"{scratch}/parts")
    merged = user_index.merge_indexes(parts.filter("load_id = 'load1'").drop("load_id"),
                                      parts.filter("load_id = 'load2'").drop("load_id"))
    one = {r.user_id: r.n_present_a_Quote for r in idx.collect()}
    two = {r.user_id: r.n_present_a_Quote for r in merged.collect()}
    assert two == {k: 2 * v for k, v in one.items()}
    assert sinks.versioned_path("/x", "7") == "/x/v=7"


def test_incremental_index_equals_batch(spark, scratch):
    for p in range(3):
        _write_log(f"{scratch}/src/part-{p}.csv", [_line(i) for i in range(p * 5, p * 5 + 5)])
    index_stream.run_incremental_index(spark, f"{scratch}/src", f"{scratch}/parts", f"{scratch}/ck", max_files_per_trigger=1)
    # a new file arrives; the restarted stream only indexes the new file
    _write_log(f"{scratch}/src/part-9.csv", [_line(i) for i in range(40, 44)])
    index_stream.run_incremental_index(spark, f"{scratch}/src", f"{scratch}/parts", f"{scratch}/ck", max_files_per_trigger=1)
    assert spark.read.parquet(f"{scratch}/parts").select("load_id").distinct().count() == 4
    merged = index_stream.read_incremental_index(spark, f"{scratch}/parts")
    batch = user_index.build_user_index(readers.read_interactions(spark, f"{scratch}/src"))
    assert sorted(merged.select(*batch.columns).collect()) == sorted(batch.collect())
