"""Plan properties: pushdown, pruning, no Python in built-in paths, no
unpartitioned windows or cartesian products over row-level data."""

import __spark_entry__ as E
from echoline.operators import clean
from echoline.schema import DEFAULT_SPLIT_TS
from echoline.sources.fixtures import interactions

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_predicates_reach_parquet_scan(spark, scratch):
    interactions(spark, SF).write.parquet(f"{scratch}/ix")
    df = clean.train_split(spark.read.parquet(f"{scratch}/ix"), DEFAULT_SPLIT_TS).select("tweet_id", "ts")
    plan = _plan(df)
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    pushed = scan.split("PushedFilters: [", 1)[1]
    assert "LessThan(ts," in pushed and "Or(LessThan(reply_ts," in pushed and "IsNull(reply_ts)" in pushed
    read_cols = scan.split("FileScan parquet [", 1)[1].split("]", 1)[0]
    assert "tokens" not in read_cols and "hashtags" not in read_cols  # pruned scan


def test_no_python_and_no_cartesian_in_builtin_queries(spark):
    names = ["user_index", "enriched_interactions", "ap_by_bin", "te_group_language", "training_table", "row_ids",
             "hashtags_encoded", "follower_quintiles"]
    for n in names:
        plan = _plan(E.queries()[n](spark, SF))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, n
        assert "CartesianProduct" not in plan, n


def test_row_level_windows_are_partitioned(spark):
    plan = _plan(E.queries()["ap_by_bin"](spark, SF))
    # the running sum over (score-tied) rows is partitioned by Spark partition and group
    row_windows = [line for line in plan.splitlines() if "Window [" in line and "score" in line]
    assert row_windows
    for line in row_windows:
        by = line.split("windowspecdefinition(", 1)[1].split(" ASC", 1)[0].split(" DESC", 1)[0]
        assert "_pid" in by, line
    # ranks: the only unpartitioned window runs over per-partition sizes
    plan = _plan(E.queries()["row_ids"](spark, SF))
    for line in plan.splitlines():
        if "Window [" in line and ", []," in line:
            assert "_size" in line


def test_ranks_share_one_exchange(spark):
    """Rows and their counts must see the same range partitions."""
    from echoline.operators.ranking import global_row_index, prefix_sums
    df = spark.range(1000).selectExpr("id % 3 AS g", "id * 7 % 1000 AS x", "id AS v")
    for out in (global_row_index(df, ["x"]), prefix_sums(df, ["g"], "x", ["v"])):
        out.collect()
        text = out._jdf.queryExecution().executedPlan().toString()
        final = text.split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final and final.count("Exchange rangepartitioning") - final.count("ReusedExchange") <= 1, text
        assert "InMemoryTableScan" not in text


def test_submitted_settings_win(tmp_path):
    import os
    import subprocess
    import sys
    code = ("from echoline.session import get_session\n"
            "s = get_session(master='local[3]', **{'spark.sql.shuffle.partitions': '5'})\n"
            "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.adaptive.enabled'))")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=77 pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "GOT local[2] 77 true" in out.stdout, out.stderr[-800:]
