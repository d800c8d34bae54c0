"""Trees that train on, weighted nets, reproducible noise, packed profiles, bucketed joins, lookups, versions, streams."""


import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from echoline.operators import boosting, dictionary, enrich, models, regularize, user_index
from echoline.plans import catalog, jobs
from echoline.schema import LABELLED_SCHEMA
from echoline.sources import readers, sinks
from echoline.streaming.index_stream import run_windowed_counts

SF = "/root/testdata/sf0.001"


def rows_for_boosting(spark, n=2000):
    x = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("int").alias("z"))
    chance = F.when(F.col("x") > 60, 0.8).when(F.col("z") < 2, 0.5).otherwise(0.1)
    return x.withColumn("has_like", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000.0 < chance)


def log_loss(df, model):
    from echoline.operators.metrics import log_loss_expr
    return df.agg(F.avg(log_loss_expr(F.col("has_like").cast("double"), model.score()))).first()[0]


# ---------------------------------------------------------------- L3

def test_five_and_five_rounds_are_ten(spark, scratch):
    df = rows_for_boosting(spark)
    ten = boosting.BoostedTrees(["x", "z"], "has_like").fit(df, 10)
    five = boosting.BoostedTrees(["x", "z"], "has_like").fit(df, 5)
    again = boosting.BoostedTrees.from_json(five.to_json()).fit(df, 5)
    a, b = ([r[0] for r in df.orderBy("id").select(m.margin()).collect()] for m in (ten, again))
    assert len(ten.trees) == len(again.trees) == 10
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-9


def test_first_leaf_is_the_newton_step(spark):
    df = spark.createDataFrame([(0.0, True), (0.0, False), (0.0, False), (1.0, True), (1.0, True), (1.0, False)], "x double, has_like boolean")
    m = boosting.BoostedTrees(["x"], "has_like", depth=1).fit(df, 1)
    tree = m.trees[0]
    assert m.start == pytest.approx(0.0) and tree["feature"] == "x"
    # gradient: sum(p - y); curvature: sum(p (1 - p)); p = 1/2
    assert tree["low"] == pytest.approx(-(3 * 0.5 - 1) / (3 * 0.25))
    assert tree["high"] == pytest.approx(-(3 * 0.5 - 2) / (3 * 0.25))


def test_loss_falls_from_batch_to_batch_and_after_reload(spark, scratch):
    df = rows_for_boosting(spark, 4000)
    held = df.where("id % 4 = 0")
    batches = [df.where(f"id % 4 = {k}") for k in (1, 2, 3)]
    m = boosting.ContinuedModels(["x", "z"], ["like"], {"step": 0.2, "depth": 3})
    losses = []
    for b in batches:
        m.fit([b], rounds_per_batch=5)
        losses.append(log_loss(held, m.models["like"]))
    assert losses[0] > losses[1] > losses[2]
    m.save(spark, scratch + "/m")
    loaded = boosting.ContinuedModels.load(spark, scratch + "/m")
    assert loaded.models == m.models
    assert loaded.transform(held).select("id", "score_like").orderBy("id").collect() == m.transform(held).select("id", "score_like").orderBy("id").collect()
    m.fit(batches[:1], 2, resume=False)
    assert len(m.models["like"].trees) == 2


def test_boosting_without_rows_or_one_class(spark):
    df = rows_for_boosting(spark, 50)
    m = boosting.BoostedTrees(["x", "z"], "has_like").fit(df.limit(0), 3)
    assert m.trees == [] and m.start is None
    m.fit(df.withColumn("has_like", F.lit(False)), 2)
    assert all(s < 1e-3 for (s,) in df.select(m.score()).collect())


# ---------------------------------------------------------------- L8, L9, R3, R6

def test_replicas_follow_the_weight(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0.25).otherwise(2.6).alias("w"))
    got = {r[0]: r[1] for r in regularize.replicate_by_weight(df, "w", ["id"]).groupBy("w").count().collect()}
    assert got[0.25] == pytest.approx(2500, rel=0.05) and got[2.6] == pytest.approx(26_000, rel=0.02)
    odd = spark.createDataFrame([(1, None), (2, -1.0), (3, 0.0), (4, 3.0)], "id long, w double")
    assert [r.id for r in regularize.replicate_by_weight(odd, "w", ["id"]).collect()] == [4, 4, 4]
    assert regularize.replicate_by_weight(df.repartition(7), "w", ["id"]).exceptAll(regularize.replicate_by_weight(df, "w", ["id"])).count() == 0


def test_weighted_net_moves_as_the_weights_say(spark):
    """With a constant feature the best score is the weighted share of positives."""
    df = spark.range(4000).select(F.col("id").alias("tweet_id"), F.col("id").alias("b_user_id"), (F.lit(1.0) + F.col("id") % 2 * 0).alias("x"),
                                  (F.col("id") % 5 == 0).alias("has_like"))
    params = {"layers": [1, 2], "maxIter": 60}
    plain = models.TargetModels(["x"], "mlp", ["like"], params).fit(df).transform(df.limit(1)).first().score_like
    balanced = models.TargetModels(["x"], "mlp", ["like"], {**params, "weighted": "balanced", "copies": 4.0}).fit(df).transform(df.limit(1)).first().score_like
    assert plain == pytest.approx(0.2, abs=0.02)
    assert balanced == pytest.approx(0.5, abs=0.03)


def test_balanced_forest_weights(spark):
    df = spark.range(10).select((F.col("id") < 2).alias("has_like"), F.lit(True).alias("has_reply"))
    r = models.balanced_weights(df, ["like", "reply"]).first()
    assert (r.w_like_1, r.w_like_0, r.w_reply_1, r.w_reply_0) == (10 / 4, 10 / 16, 0.5, None)
    w = {r[0]: r[1] for r in models.with_balanced_weights(df, "like").select("has_like", "weight").distinct().collect()}
    assert w == {True: 2.5, False: 0.625}


def test_keyed_noise_is_normal_and_reproducible(spark):
    df = spark.range(20_000).select("id", *[F.lit(0.0).alias(f"c{i}") for i in range(6)])
    a = regularize.gaussian_noise(df, [f"c{i}" for i in range(6)], 0.5, 4, ["id"])
    b = regularize.gaussian_noise(df.repartition(11), [f"c{i}" for i in range(6)], 0.5, 4, ["id"])
    assert a.exceptAll(b).count() == 0
    stats = a.agg(*[F.avg(f"c{i}") for i in range(6)], *[F.stddev(f"c{i}") for i in range(6)], F.corr("c0", "c1"), F.corr("c0", "c4")).first()
    assert all(abs(m) < 0.02 for m in stats[:6]) and all(abs(s - 0.5) < 0.02 for s in stats[6:12]) and all(abs(c) < 0.03 for c in stats[12:])
    u = regularize.random_scores(df.select("id"), ["reply", "like"], 1, ["id"]).agg(F.avg("score_reply"), F.min("score_like"), F.max("score_like")).first()
    assert abs(u[0] - 0.5) < 0.02 and 0 < u[1] and u[2] < 1


# ---------------------------------------------------------------- A3, A5, A6

def test_packed_profile_orders_like_the_struct(spark):
    top = user_index.PACKED_COUNTS - 2
    rows = [(1, t, a, b, v, c) for t in (0, 5, 3_299_999_998) for a in (None, 0, top) for b in (None, 0, top) for v in (None, False, True) for c in (None, 0, top)]
    df = spark.createDataFrame(rows, "user_id long, first_seen long, follower_count long, following_count long, verified boolean, account_creation long")
    names = ["first_seen", "follower_count", "following_count", "verified", "account_creation"]
    packed = df.select(F.struct(*names).alias("s"), user_index.pack_profile().alias("_p"))
    back = packed.select("s", *[user_index.unpack_profile("_p")[c].alias(c) for c in names]).select("s", F.struct(*names).alias("t"))
    assert back.where("s IS DISTINCT FROM t").count() == 0
    assert [r.s for r in packed.orderBy("_p").collect()] == [r.s for r in packed.orderBy("s").collect()]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1, 1, 2**31, 0, True, 0)], df.schema).select(user_index.pack_profile()).collect()


@pytest.mark.parametrize("name", ["user_index", "user_index_active_only", "index_merge"])
def test_index_needs_no_sort(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_struct_profile_gives_the_same_index(spark):
    ix = catalog._ix(spark, SF)
    a, b = (user_index.build_user_index(ix, profile=p, with_first_seen=True) for p in ("packed", "struct"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_index_takes_profiles_of_any_size(spark):
    """Creation times past 2**31 failed the job; nulls, ties and negatives order like the struct."""
    far = 631152000 + 400_000 * 86400
    rows = [(None, None, f"T{k}", None, None, None, "TopLevel", "L", t, "0" * 31 + "A", n, g, v, c, "0" * 31 + "B", n, g, v, c, False, None, None, None, None)
            for k, (t, n, g, v, c) in enumerate((t, n, g, v, c) for t in (None, 5, 7) for n in (None, -1, 2**40) for g in (None, 2**35, 3) for v in (None, False, True) for c in (None, far, 2**31))]
    ix = spark.createDataFrame(rows, LABELLED_SCHEMA).cache()
    for keep in ("true", "ts >= 5", "ts > 5 AND a_is_verified AND a_follower_count > 0 AND a_account_creation IS NOT NULL"):
        a, b = (user_index.build_user_index(ix.where(keep), profile=p, with_first_seen=True, types=["TopLevel"], with_combined=False) for p in ("grouped", "struct"))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    parts = [user_index.build_user_index(ix.where(f"a_account_creation {op} 2147483648"), with_first_seen=True, with_combined=False, types=["TopLevel"]) for op in ("<=", ">")]
    whole = user_index.build_user_index(ix.where("a_account_creation IS NOT NULL"), profile="struct", with_first_seen=True, with_combined=False, types=["TopLevel"])
    assert user_index.merge_indexes(*parts).exceptAll(whole).count() == 0
    ix.unpersist()


def _plan_unbroadcast(spark, df):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_and_missing_keys_are_dealt_out(spark):
    """The optimizer dropped the salt from the join, so all hot rows and rows without a key met in one task."""
    from echoline.operators import encoding
    big = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"),
                                   (F.col("id") % 2).alias("y"))
    small = big.where("k IS NOT NULL").groupBy("k").agg(F.max("id").alias("v"))
    hot = spark.createDataFrame([("hot",)], "k string")
    for df in (lambda: enrich.skew_split_left_join(big, small, "k", hot), lambda: encoding.group_target_encoding(big, "k", "y", "te"),
               lambda: encoding.out_of_fold_encoding(big, "k", "y", ["id"], "te")):
        assert "hashpartitioning(_cold" in (plan := _plan_unbroadcast(spark, df)) and "_salt" in plan.split("hashpartitioning(_cold", 1)[1][:20]
    got, want = enrich.skew_split_left_join(big, small, "k", hot), big.join(small, "k", "left").select(*big.columns, "v")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_group_encoding_matches_no_null_category(spark):
    """F16: the split join keeps the fill for null and unseen categories, of one or more columns."""
    from echoline.operators import encoding
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"c{i % 3}", None if i % 7 == 0 else i % 2, i % 4 == 0) for i in range(200)], "id int, a string, b int, y boolean")
    for cats in ("a", ["a", "b"]):
        names = [cats] if isinstance(cats, str) else cats
        got = encoding.group_target_encoding(rows, cats, "y", "te")
        assert got.columns == [*names, *[c for c in rows.columns if c not in names], "te"]
        assert got.where(" OR ".join(f"{c} IS NULL" for c in names)).where("te <> -1").count() == 0
        assert got.where(" AND ".join(f"{c} IS NOT NULL" for c in names)).where("te = -1").count() == 0 and got.count() == 200


# ---------------------------------------------------------------- J1, J2, J12, F14, S12, K11, K12, T3, F21

def test_bucketed_index_is_not_moved(spark, scratch):
    ix = catalog._ix(spark, SF)
    enrich.write_encodings(user_index.build_user_index(ix), "te_plan_test", scratch + "/te")
    ix.select("tweet_id", "a_user_id", "b_user_id", "ts").write.parquet(scratch + "/ix")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        out = enrich.enrich_from_table(spark.read.parquet(scratch + "/ix"), "te_plan_test")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE te_plan_test")
    # Only the interactions are moved, once for each join; the table is scanned by bucket.
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("hashpartitioning(_a_key") == plan.count("hashpartitioning(_b_key") == 1


def test_hot_lists_and_no_list_as_key(spark):
    rows = [(k, "a\tb\ta" if k % 3 else f"b\tq{k}\t\ta") for k in range(300)] + [(900, None), (901, ""), (902, "zz")]
    df = spark.createDataFrame(rows, "id long, l string")
    d = spark.createDataFrame([("a", 0), ("b", 1)], "value string, code long")
    out = dictionary.map_list_column(df, "l", "codes", d)
    got = {r.id: r.codes for r in out.collect()}
    assert got[1] == [0, 1, 0] and got[3] == [1, 0] and got[900] == got[901] == got[902] == [] and len(got) == 303
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l#" not in plan and "hashpartitioning(_list#" not in plan


def test_lookup_reads_few_row_groups(spark, scratch):
    index = spark.range(40_000).select(F.xxhash64("id").alias("user_id"), F.col("id").alias("n"))
    sinks.write_index(index, scratch + "/i", num_partitions=8)
    key = index.where("n = 77").first().user_id
    df = readers.lookup_users(spark, scratch + "/i", [f"{key % 2**64:032X}"])
    assert [r.n for r in df.collect()] == [77]
    plan = df._jdf.queryExecution().executedPlan()
    assert f"EqualTo(user_id,{key})" in plan.toString()
    scanned = next(line for line in [plan.collectLeaves().apply(0)]).metrics().apply("numOutputRows").value()
    assert scanned <= 5_000 + 500      # one of eight files
    assert readers.lookup_users(spark, scratch + "/i", ["0" * 16, "F" * 16]).count() == 0


def test_minibatches_do_not_depend_on_partitions(spark, scratch):
    spark.range(5000).select("id", F.lit("x").alias("t")).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(scratch + "/r")
    found = []
    for size in ("2k", "100m"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.with_batches(readers.with_file_position(spark.read.parquet(scratch + "/r")), 1000)
            out = readers.with_minibatches(rows, 128).select("id", "batch_id", "minibatch_id").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        found.append(sorted(out))
    assert found[0] == found[1] == [(k, k // 1000, k % 1000 // 128) for k in range(5000)]


def test_versions(spark, scratch):
    out = sinks.VersionedOutput(spark, scratch + "/v", "id")
    assert out.current() == [] and out.versions() == []
    with pytest.raises(FileNotFoundError):
        out.read()
    one = spark.range(10).select("id", (F.col("id") * 2).alias("a"))
    out.publish(one)
    assert out.add_columns(one.withColumn("b", F.col("id") + 1)) == ["b"]
    assert out.add_columns(one.withColumn("b", F.lit(0))) == []
    assert sorted(map(tuple, out.read().collect())) == [(k, 2 * k, k + 1) for k in range(10)]
    assert out.read(["b"]).columns == ["id", "b"]
    before = out.current()
    broken = one.withColumn("a", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(PySparkException):
        out.publish(broken)
    assert out.current() == before and out.read().count() == 10 and len(out.versions()) == 2
    out.publish(one.select("id", F.lit(1).alias("a")))
    assert out.read().columns == ["id", "a"] and len(out.versions()) == 3


def test_stream_drops_late_rows(spark, scratch):
    day = 86400
    schema = "user_id long, ts long"
    def arrive(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{scratch}/in/{k}")
        run_windowed_counts(spark, scratch + "/in", scratch + "/out", scratch + "/ckpt", spark.createDataFrame([], schema).schema)
        return sorted(map(tuple, spark.read.parquet(scratch + "/out").select("user_id", "day_start", "n").collect()))
    assert arrive(0, [(1, 10), (1, 20), (1, day + 5), (2, 4 * day)]) == [(1, 0, 2), (1, day, 1)]
    # days 0 and 1 have closed (latest event less two days); day 2 is open still
    assert arrive(1, [(1, 30), (1, 2 * day + 1), (3, day + 7)]) == [(1, 0, 2), (1, day, 1)]
    assert arrive(2, [(2, 9 * day)]) == [(1, 0, 2), (1, day, 1), (1, 2 * day, 1), (2, 4 * day, 1)]


def test_named_feature_sets():
    class T:
        columns = ["tweet_id", "b_user_id", "like_ts", "has_like", "bin", "a_followers", "n_like_a_A", "TE_like_A"]
    assert jobs.feature_columns(T) == ["a_followers", "n_like_a_A", "TE_like_A"]
    assert jobs.feature_columns(T, "plain") == ["a_followers"]
    assert jobs.feature_columns(T, "encodings") == ["TE_like_A"]
    assert jobs.feature_columns(T, "no_encodings") == ["a_followers", "n_like_a_A"]
    with pytest.raises(ValueError):
        jobs.feature_columns(T, "some")


# ---------------------------------------------------------------- logs, assemblies

def test_logs_are_compressed_and_read_by_extension(spark, scratch):
    """Logs are written as gzip; a ``.bak.gz`` is still not read."""
    from pathlib import Path
    from echoline.plans import roundtrips
    found = roundtrips.extension_listing(spark, SF)
    kept = catalog._ix(spark, SF).where(F.col("type") != "TopLevel").select(*found.columns)
    assert found.exceptAll(kept).count() == 0 and kept.exceptAll(found).count() == 0
    path = roundtrips._log(spark, SF)
    files = [p for p in Path(path).iterdir() if p.name.startswith("part-")]
    assert files and all(p.name.endswith(".csv.gz") for p in files)


def test_scoring_assembles_once(spark):
    """features were assembled for every target."""
    df = rows_for_boosting(spark, 300).withColumn("has_reply", F.col("z") > 3)
    model = models.TargetModels(["x", "z"], "tree", ["like", "reply"], {"maxDepth": 2}).fit(df)
    scored = model.transform(df)
    assert scored.columns == [*df.columns, "score_like", "score_reply"]
    plan = scored._jdf.queryExecution().analyzed().toString()
    assert plan.count("AS features#") == 1
    assert scored.where("score_like IS NULL OR score_reply IS NULL").count() == 0
