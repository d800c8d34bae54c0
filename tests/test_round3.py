"""Rows are written, numbered and joined without being moved or computed again; results as by the plain forms."""

import math

from pyspark.sql import functions as F

from echoline.functions import scalar as S
from echoline.operators import regularize
from echoline.operators.dictionary import encode_column
from echoline.sources import readers, sinks



def test_extensions_are_written_in_one_job(spark, scratch):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("d", 5)], "k string, n int")
    counted = rows.withColumn("n", F.udf(count, "int").asNondeterministic()("n"))
    kinds = {"csv": F.col("k") == "a", "tsv": F.col("k").isin("b", "d"), "bak": F.col("k") == "c"}
    sinks.write_by_extension(counted, f"{scratch}/x", kinds, compression="gzip")
    assert seen.value <= 5
    found = {e: sorted(r.n for r in spark.read.schema("k string, n int").option("pathGlobFilter", f"*.{e}.gz").csv(f"{scratch}/x").collect())
             for e in kinds}
    assert found == {"csv": [1], "tsv": [2, 5], "bak": [3]}


def test_whole_files_are_numbered_where_they_are(spark, scratch):
    spark.range(0, 1000, 1, 7).write.parquet(f"{scratch}/f")
    rows = readers.with_file_position(spark.read.parquet(f"{scratch}/f"))
    ids = readers.with_minibatches(readers.with_batches(rows, 90, whole_files=True), 20)
    assert "Exchange rangepartitioning" not in ids._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.batch_id, r.minibatch_id) for r in ids.collect()) == [(i, i // 90, i % 90 // 20) for i in range(1000)]


def test_whole_files_with_missing_rows_fail(spark, scratch):
    import pytest
    spark.range(0, 100, 1, 2).write.parquet(f"{scratch}/f")
    rows = readers.with_file_position(spark.read.parquet(f"{scratch}/f")).where("id % 3 <> 0")
    with pytest.raises(Exception, match="rows of a file are missing"):
        readers.with_batches(rows, 10, whole_files=True).collect()


def test_round_half_up_is_round(spark):
    values = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.0000005, 2.5000015, -2.5000015, 1e300, -1e300, 1e12, 123456.1234565, 0.1 + 0.2, 1 / 3, float("nan"), float("inf"), None]
    values += [k * 0.37e-6 - 3 for k in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for a, b in df.select(F.round("x", 6), S.round_half_up("x")).collect():
        assert repr(a) == repr(b)


def test_noise_array_is_the_blocks_normals(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, n int")
    one = [c for b in range(3) for c in regularize.counter_normals(["k", "n"], b, 5)]
    for a, b in df.select(F.array(*one), regularize.counter_normal_array(["k", "n"], 10, 5)).collect():
        assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b, strict=True))


def test_rows_of_near_codes_are_not_moved(spark, monkeypatch):
    from echoline.operators import dictionary
    df = spark.createDataFrame([(x, i) for i, x in enumerate(["a", "b", "c", "d", None, "a", "zz"])], "v string, i int")
    codes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "value string, code long")
    want = [0, 1, 2, 3, None, 0, None]
    for near in (2**16, 2):
        monkeypatch.setattr(dictionary, "NEAR_CODES", near)
        out = encode_column(df, "v", "c", codes, null_code=None)
        assert [r.c for r in sorted(out.collect(), key=lambda r: r.i)] == want
        assert out.columns == ["v", "i", "c"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, path: str) -> str:
    """Orders with line items that tie in all but the tokens, a supplier and a customer with the same key, keys that repeat or are null."""
    spark.sql("SELECT * FROM VALUES (1L, 1L, 7L, 3), (1L, 1L, 7L, 1), (1L, 1L, 7L, 2), (1L, 2L, 8L, 1), (2L, 1L, NULL, 1), (3L, 2L, 9L, 4), (3L, 2L, 9L, 4), (NULL, 1L, 7L, 1) "
              "AS t(l_orderkey, l_partkey, l_suppkey, l_linenumber)").selectExpr(
        "*", "1.0D AS l_quantity", "0.0D AS l_tax", "0.0D AS l_discount", "'F' AS l_linestatus").write.parquet(f"{path}/lineitem.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 7L, '2-HIGH'), (2L, 5L, '1-URGENT'), (3L, 7L, NULL), (3L, 5L, '4-LOW') AS t(o_orderkey, o_custkey, o_orderpriority)").selectExpr(
        "*", "TIMESTAMP_NTZ'2024-01-15 03:04:05' AS o_orderdate").write.parquet(f"{path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (7L, 1.0D, 1), (5L, 2.0D, NULL) AS t(c_custkey, c_acctbal, c_nationkey)").write.parquet(f"{path}/customer.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 'red blue', 1, 'b'), (2L, NULL, 2, 'b') AS t(p_partkey, p_name, p_size, p_brand)").write.parquet(f"{path}/part.parquet")
    return path


def test_raw_interactions_make_the_same_columns(spark, scratch):
    from echoline.sources.fixtures import INTERACTION_COLS, interactions, raw_interactions
    sf = _tables(spark, scratch)
    rows, of = raw_interactions(spark, sf, INTERACTION_COLS, made=("ts", "type"))
    rows = rows.select(*[of[c].alias(c) for c in INTERACTION_COLS])
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, interactions(spark, sf).collect()))


def test_ranking_moves_no_ids(spark, scratch, monkeypatch):
    """Versions and dumps are ranked by raw columns, ties in the order of their tokens, and read back with ids as written before."""
    import itertools
    from echoline.operators import ranking
    from echoline.plans import roundtrips
    from echoline.sources.fixtures import interactions
    seen, index = [], ranking.global_row_index

    def ranked(df, *args, **kwargs):
        seen.append(df.dtypes)
        return index(df, *args, **kwargs)

    sf = _tables(spark, scratch)
    rows = interactions(spark, sf).select(*roundtrips.VERSIONED).collect()
    least = lambda v: (v is not None, v if v is not None else 0)
    rows.sort(key=lambda r: [least(v) for v in r])
    monkeypatch.setattr(ranking, "global_row_index", ranked)
    made = sorted(map(tuple, roundtrips.additive_features(spark, sf).collect()))
    assert [(r[0], r[1], r[4]) for r in made] == [(k, r.tweet_id, None if r.tokens is None else len(r.tokens)) for k, r in zip(itertools.count(1), rows)]
    dumped = sorted(roundtrips.coloaded_features(spark, sf).select("idx", "tweet_id", "b_user_id", "ts").collect())
    assert [tuple(r) for r in dumped] == [(k, r.tweet_id, r.b_user_id, r.ts) for k, r in enumerate(rows)]
    assert len(seen) == 2 and not any({"tweet_id", "b_user_id", "tokens"} & dict(d).keys() for d in seen)


def test_sizes_of_ranges_need_no_sort(spark):
    from echoline.operators.ranking import global_row_index
    df = spark.range(0, 1000, 1, 5).selectExpr("id % 7 AS a", "id")
    out = global_row_index(df, ["a"], "rn")
    assert _plan(out).split("== Initial Plan ==")[0].count(" Sort [a") <= 1
    assert sorted((r.rn, r.a) for r in out.collect()) == list(enumerate(sorted(i % 7 for i in range(1000))))


def test_distinct_users_group_raw_keys(spark, scratch):
    from echoline.operators import profiling
    from echoline.plans.catalog import dict_users
    from echoline.sources.fixtures import interactions
    sf = _tables(spark, scratch)
    ix = interactions(spark, sf)
    want = sorted({x for r in ix.select("a_user_id", "b_user_id").collect() for x in r if x is not None})
    assert sorted(r.user_id for r in profiling.distinct_users(ix).where("user_id IS NOT NULL").collect()) == want
    out = dict_users(spark, sf)
    assert sorted((r.code, r.value) for r in out.collect()) == list(enumerate(want))
    assert "HashAggregate(keys=[_role" in _plan(out)
