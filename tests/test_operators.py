"""Hand-made frames for the quirks and edge cases (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from echoline.functions import scalar as S
from echoline.functions.registry import LabelLeakError, FeatureSpec, apply_registry, label_derived
from echoline.operators import clean, encoding, enrich, metrics, ranking, regularize, user_index
from echoline.schema import LABELLED_SCHEMA

T0 = 1_000_000


def _row(a, b, ts, typ="TopLevel", reply=None, retweet=None, rc=None, like=None, afc=10, bfc=20):
    return (None, None, f"T{a}{b}{ts}", None, None, None, typ, "L", ts, a, afc, 5, False, 100, b, bfc, 7, True, 200, False,
            reply, retweet, rc, like)


def frame(spark, rows):
    return spark.createDataFrame(rows, LABELLED_SCHEMA)


HEX_A = "0" * 31 + "A"
HEX_B = "0" * 31 + "B"
HEX_C = "0" * 31 + "C"
HEX_D = "F" * 32


def test_divisions(spark):
    df = spark.createDataFrame([(1, 2), (5, 0), (0, 0), (0, 3)], "n long, d long")
    out = df.select(S.safe_ratio("n", "d").alias("r")).collect()
    assert [r.r for r in out] == [0.5, 1e7, None, 0.0]
    filled = clean.sentinel_fill(df.select(S.safe_ratio("n", "d").alias("r")))
    assert [r.r for r in filled.collect()] == [0.5, 1e7, -10.0, 0.0]


def test_media_counts(spark):
    df = spark.createDataFrame([(None,), ("",), ("Photo",), ("Photo\tPhoto",), ("Sticker",)], "m string")
    got = [r.p for r in df.select(S.media_count_log("m", "Photo").alias("p")).collect()]
    assert got[:2] == [-1.0, -1.0]
    assert got[2] == pytest.approx(math.log(2)) and got[3] == pytest.approx(math.log(3)) and got[4] == 0.0


def test_bins_thresholds(spark):
    vals = [92, 93, 216, 217, 441, 442, 1063, 1064, 0, 10**9]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    got = [r.b for r in df.select(S.follower_bin("x").alias("b")).collect()]
    assert got == [1, 2, 2, 3, 3, 4, 4, 5, 1, 5]
    early = [r.b for r in df.select(S.follower_bin("x", (421, 1353, 4945, 30774)).alias("b")).collect()]
    assert early[:2] == [1, 1]


def test_logs_differ_at_one(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (5,)], "x long")
    r = df.select(S.symlog("x").alias("s"), S.signed_log1p("x").alias("e")).collect()
    assert r[0].s == 0 and r[0].e == pytest.approx(-math.log(2))
    assert r[2].s == 0 and r[2].e == pytest.approx(math.log(2))
    assert r[3].s == pytest.approx(math.log(5))


def test_hex_fold(spark):
    df = spark.createDataFrame([("0" * 32,), ("F" * 32,), ("abcdef0123456789ABCDEF0123456789",)], "h string")
    r = df.select(S.id_fold64("h").alias("u"), S.key64_to_unsigned(S.id_key64("h")).alias("k"),
                  S.id_hash32("h").alias("h32")).collect()
    assert r[0].u == "0" and r[1].u == "18446744073709551615" and r[1].k == "18446744073709551615"
    assert r[2].u == str(int("abcdef0123456789ABCDEF0123456789", 16) % 2**64) == r[2].k
    assert r[2].h32 == int("abcdef0123456789ABCDEF0123456789", 16) % 2**32


def test_splits_disjoint_and_straddlers(spark):
    rows = [_row(HEX_A, HEX_B, 10), _row(HEX_A, HEX_B, 10, reply=50), _row(HEX_A, HEX_B, 10, like=150),
            _row(HEX_A, HEX_B, 120), _row(HEX_A, HEX_B, 130, retweet=140), _row(HEX_A, HEX_B, 99, rc=100)]
    df = frame(spark, rows)
    tr, va, lo = clean.train_split(df, 100), clean.val_split(df, 100), clean.split_leftovers(df, 100)
    assert tr.count() == 2 and va.count() == 2 and lo.count() == 2
    assert tr.join(va, "tweet_id").count() == 0


def _users(spark):
    # author A; consumer B engaged; consumer C silent; D both roles; a Reply row
    rows = [
        _row(HEX_A, HEX_B, T0, "TopLevel", like=T0 + 5),
        _row(HEX_A, HEX_C, T0 + 1, "Retweet"),
        _row(HEX_D, HEX_B, T0 + 2, "Quote", reply=T0 + 9),
        _row(HEX_A, HEX_D, T0 + 3, "Reply", retweet=T0 + 4),
        _row(HEX_D, HEX_C, T0 + 4, "TopLevel"),
    ]
    return frame(spark, rows)


def _by_user(df):
    return {r.user_id: r for r in df.withColumn("user_id", S.key64_to_unsigned("user_id")).collect()}


def test_user_index_counts_and_quirks(spark):
    idx = _by_user(user_index.build_user_index(_users(spark)))
    a, b, c, d = (str(int(h, 16) % 2**64) for h in (HEX_A, HEX_B, HEX_C, HEX_D))
    assert idx[a].n_present_a_TopLevel == 1 and idx[a].n_present_a_Reply == 1 and idx[a].n_like_a_TopLevel == 1
    # combined counts exclude Reply (Q4)
    assert idx[a].n_present_a == 2 and idx[d].n_present_b == 0 and idx[d].n_retweet_b == 0
    assert idx[d].n_retweet_b_Reply == 1 and idx[d].n_present_a == 2
    assert idx[b].n_like_b == 1 and idx[b].n_reply_b == 1
    # silent consumer kept by default, dropped with require_activity="global" (Q1)
    assert c in idx
    active = _by_user(user_index.build_user_index(_users(spark), require_activity="global"))
    assert c not in active and b in active and a in active


def test_merge_equals_one_shot(spark):
    df = _users(spark)
    full = user_index.build_user_index(df, with_combined=False)
    parts = [df.filter(F.col("ts") < T0 + 2), df.filter(F.col("ts") == T0 + 2), df.filter(F.col("ts") > T0 + 2)]
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        merged = user_index.merge_indexes(*[user_index.build_user_index(parts[i], with_combined=False) for i in order])
        counts = [c for c in full.columns if c.startswith("n_")]
        assert sorted(merged.select("user_id", *counts).collect()) == sorted(full.select("user_id", *counts).collect())


def test_te_between_prior_and_rate(spark):
    idx = user_index.build_user_index(_users(spark))
    pri = encoding.priors(idx).first().asDict()
    te = encoding.user_target_encodings(idx).collect()
    for r in te:
        v = r["TE_like_b"]
        assert v is not None and 0 <= v <= 1
    # a user with n_present = 0 in a slot gets exactly the prior (Q6)
    zero = [r for r in te if r.user_id == idx.filter("n_present_b = 0").first().user_id][0]
    assert zero["TE_like_b"] == pytest.approx(pri["prior_like_b"])


def test_enrich_unknown_users_get_sentinel(spark):
    df = _users(spark)
    idx = user_index.build_user_index(df.filter(F.col("ts") < T0 + 2))
    out = enrich.enrich(df, idx, keep_counts=False)
    row = out.filter(F.col("b_user_id") == HEX_D).first()
    assert row["TE_like_b_B"] == -10.0
    assert out.count() == df.count()


def test_noise_std_zero_is_identity(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "TE_x double")
    assert regularize.gaussian_noise(df, ["TE_x"], 0.0).collect() == df.collect()


def test_average_precision_with_ties(spark):
    import numpy as np
    scores = [0.9, 0.8, 0.8, 0.5, 0.3, 0.3]
    ys = [1, 0, 1, 1, 0, 0]
    df = spark.createDataFrame([("g", s, y) for s, y in zip(scores, ys)] + [("empty", 0.5, 0)], "grp string, score double, y int")
    ap = {r.grp: r.ap for r in metrics.average_precision(df, ["grp"], num_partitions=3).collect()}
    # brute force over distinct thresholds
    s, y = np.array(scores), np.array(ys)
    exp = 0.0
    for t in sorted(set(scores), reverse=True):
        sel = s >= t
        tp_new = ((s == t) & (y == 1)).sum()
        exp += tp_new / y.sum() * (y[sel].sum() / sel.sum())
    assert ap["g"] == pytest.approx(exp)
    assert ap["empty"] is None


def test_ap_invariant_under_monotone_map(spark):
    rows = [(float(i % 7) / 7 + 0.01, int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "score double, y int").withColumn("g", F.lit(1))
    a1 = metrics.average_precision(df, ["g"]).first().ap
    a2 = metrics.average_precision(df.withColumn("score", F.col("score") * 3 + 1), ["g"]).first().ap
    assert a1 == pytest.approx(a2)


def test_prior_rce_is_zero(spark):
    rows = [(0.25, int(i % 4 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "score double, y int").withColumn("g", F.lit(1))
    assert metrics.rce(df, ["g"]).first().rce == pytest.approx(0.0, abs=1e-9)


def test_global_row_index_contiguous(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    out = ranking.global_row_index(df, ["k"], "rn", num_partitions=7).collect()
    pairs = sorted((r.k, r.rn) for r in out)
    assert [p[1] for p in pairs] == list(range(1000))


def test_prefix_sums_match_window(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), (F.col("id") * 13 % 500).cast("double").alias("x"),
                                    F.lit(1.0).alias("v"))
    out = ranking.prefix_sums(df, ["g"], "x", ["v"], descending=True, num_partitions=5).collect()
    for r in out:
        # rank from the top within group g
        assert r.cum_v == sum(1 for q in out if q.g == r.g and q.x >= r.x)


def test_leak_guard(spark):
    reg = {"has_like": FeatureSpec(("like_ts",), lambda: F.col("like_ts") > 0, "boolean"),
           "like_x2": FeatureSpec(("has_like",), lambda: F.col("has_like").cast("int") * 2, "int"),
           "a_log": FeatureSpec(("a_follower_count",), lambda: S.save_log("a_follower_count"))}
    assert label_derived(reg) == {"has_like", "like_x2"}
    df = _users(spark)
    out = apply_registry(df, reg, "train")
    assert {"has_like", "like_x2", "a_log"} <= set(out.columns)
    with pytest.raises(LabelLeakError):
        apply_registry(df, reg, "test")


def test_list_dictionary_keeps_order(spark):
    from echoline.operators.dictionary import encode_list_column
    d = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "value string, code long")
    df = spark.createDataFrame([(1, "z\tx\tz"), (2, ""), (3, "y\tq")], "id long, h string")
    out = {r.id: r.codes for r in encode_list_column(df, "h", "codes", d, ["id"], unknown_code=-1).collect()}
    assert out[1] == [2, 0, 2] and out[2] == [] and out[3] == [1, -1]


def test_group_te_unseen_category(spark):
    tr = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "cat string, y int")
    te = spark.createDataFrame([("a",), ("c",)], "cat string")
    stats = encoding.group_stats(tr, "cat", "y")
    out = {r.cat: r.enc for r in encoding.apply_group_encoding(te, stats, "cat", "enc").collect()}
    total = 2 / 3
    assert out["a"] == pytest.approx((2 * 0.5 + 20 * total) / 22) and out["c"] == -1.0


def test_plans_have_no_python_udf_or_cartesian(spark):
    df = _users(spark)
    idx = user_index.build_user_index(df)
    plan = enrich.enrich(df, idx)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_python_feature_matches_builtin(spark):
    import numpy as np
    from echoline.functions.registry import python_feature
    from echoline.functions.udf import batch_map
    df = _users(spark)
    reg = {"a_log_py": python_feature("a_follower_count", lambda s: np.log1p(np.abs(s.astype("float64")))),
           "a_log": FeatureSpec(("a_follower_count",), lambda: S.save_log("a_follower_count"))}
    out = apply_registry(df, reg).select("a_log_py", "a_log").collect()
    assert all(r.a_log_py == pytest.approx(r.a_log) for r in out)
    doubled = batch_map(df.select("ts"), lambda p: p.assign(ts2=p.ts * 2), "ts long, ts2 long")
    assert all(r.ts2 == 2 * r.ts for r in doubled.collect())


def test_rank_runs(spark):
    log = spark.createDataFrame([("a", 1.5), ("b", 9.0), ("c", None), ("d", 9.0)], "method string, TOTAL_like_rce double")
    ranked = {r.method: r["rank"] for r in metrics.rank_runs(log, "TOTAL_like_rce").collect()}
    assert ranked == {"b": 1, "d": 2, "a": 3, "c": 4}


def test_sources_small_helpers(spark, scratch):
    from echoline.sources import readers
    with open(f"{scratch}/lang.csv", "w") as f:
        f.write("encode,language_id\n0,AA\n1,BB\n")
    d = readers.read_dictionary(spark, f"{scratch}/lang.csv")
    assert sorted((r.value, r.code) for r in d.collect()) == [("AA", 0), ("BB", 1)]
    df = spark.range(0, 23).withColumn("source_file", F.when(F.col("id") < 10, "p0").otherwise("p1"))
    order = readers.file_order(df, seed=3).collect()
    assert sorted(r.file_rank for r in order) == [0, 1]
    b = readers.with_minibatches(readers.with_batches(df, 10), 4)
    counts = sorted((r.batch_id, r.minibatch_id, r["count"]) for r in b.groupBy("batch_id", "minibatch_id").count().collect())
    assert counts == [(0, 0, 4), (0, 1, 4), (0, 2, 2), (1, 0, 4), (1, 1, 4), (1, 2, 2), (2, 0, 3)]
    parts = clean.split_features_labels(_users(spark).withColumns({"has_like": F.lit(True), "bin": F.lit(1)}))
    assert "has_like" in parts["labels"].columns and "has_like" not in parts["features"].columns


def test_mlp_per_target(spark):
    from echoline.operators.models import TargetModels
    rows = [(float(i % 5), float(i % 3), i % 2 == 0, i % 3 == 0, i % 4 == 0, i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, has_reply boolean, has_retweet boolean, "
                                     "has_retweet_comment boolean, has_like boolean")
    m = TargetModels(["x", "y"], "mlp", params={"layers": [2, 4, 2], "maxIter": 5}).fit(df)
    out = m.transform(df).select("score_like").collect()
    assert len(out) == 60 and all(0 <= r.score_like <= 1 for r in out)


def test_hot_author_both_join_paths_agree(spark):
    # one author holds a third of all rows
    rows = []
    for i in range(90):
        a = HEX_A if i % 3 == 0 else format(1000 + i % 7, "032X")
        b = format(5000 + i % 11, "032X")
        rows.append(_row(a, b, T0 + i, ["TopLevel", "Retweet", "Quote", "Reply"][i % 4],
                         like=T0 + i + 1 if i % 2 else None))
    df = frame(spark, rows)
    idx = user_index.build_user_index(df.filter(F.col("ts") < T0 + 60))
    hot = enrich.hot_keys(df.withColumn("k", S.id_key64("a_user_id")), "k", 0.2).collect()
    assert [r.k for r in hot] == [int(HEX_A[-16:], 16)]
    cols = ["tweet_id", "TE_like_a_A", "TE_like_b_B", "n_present_a_A"]
    aqe = sorted(enrich.enrich(df, idx, skew="aqe").select(*cols).collect())
    split = sorted(enrich.enrich(df, idx, skew="split").select(*cols).collect())
    assert aqe == split and len(aqe) == 90


def test_row_index_with_hot_order_value(spark):
    df = spark.range(0, 300).withColumn("k", F.when(F.col("id") < 100, F.lit(0)).otherwise(F.col("id")))
    out = ranking.global_row_index(df, ["k"], "rn", num_partitions=6).collect()
    assert sorted(r.rn for r in out) == list(range(300))
    assert max(r.rn for r in out if r.k == 0) == 99


def test_out_of_fold_excludes_own_fold(spark):
    rows = [(i, "a" if i % 2 else "b", int(i % 3 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, cat string, y int")
    out = encoding.out_of_fold_encoding(df, "cat", "y", ["id"], "enc", k=4, weight=0.0).collect()
    from echoline.operators.regularize import unit_hash
    folds = {r.id: r.f for r in df.select("id", F.floor(unit_hash("id", salt="fold") * 4).alias("f")).collect()}
    for r in out:
        others = [q for q in rows if q[1] == r.cat and folds[q[0]] != folds[r.id]]
        assert r.enc == pytest.approx(sum(q[2] for q in others) / len(others))


def test_noise_reaches_sentinel_values(spark):
    df = _users(spark)
    idx = user_index.build_user_index(df.filter(F.col("ts") < T0 + 2))
    out = enrich.enrich(df, idx, keep_counts=False, noise_std=0.05, noise_seed=3)
    v = out.filter(F.col("b_user_id") == HEX_D).first()["TE_like_b_B"]
    assert v != -10.0 and abs(v + 10.0) < 0.5


def test_small_cleaning_helpers(spark):
    from echoline.sources.readers import coload
    df = _users(spark)
    wide = clean.widen_unsigned(df, ["a_follower_count"], bits=64)
    assert dict(wide.dtypes)["a_follower_count"] == "decimal(20,0)"
    assert "tokens" not in clean.drop_features(df, ["tokens"]).columns
    assert clean.drop_null_label(df, "like_ts").count() == 1
    assert not any(c.startswith("n_") for c in clean.drop_prefixed(user_index.build_user_index(df)).columns)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "idx long, new string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "idx long, old string")
    assert [(r.idx, r.new, r.old) for r in coload(a, b).collect()] == [(1, "x", "p")]


def test_index_with_day_counts(spark):
    df = _users(spark)
    idx = user_index.build_user_index(df, with_day_counts=True)
    assert sum(c.startswith("n_day_") for c in idx.columns) == 366
    day = 1 + (T0 // 86400) % 365  # T0 is in January 1970, so day of year = days since epoch + 1
    by = _by_user(idx)
    a = str(int(HEX_A, 16) % 2**64)
    assert by[a][f"n_day_{day}"] == 3          # three posts by A on that day
    assert "n_day_1" not in user_index.drop_day_counts(idx).columns


def test_ranks_fail_on_other_partitions(spark):
    """Counts of other partitions than the rows' end the job; the same counts pass."""
    rows = spark.createDataFrame([(p, i, "g", float(i)) for p in range(3) for i in range(4)], "_pid int, _local long, g string, v double")
    good = spark.createDataFrame([(p, 4, 4 * p) for p in range(3)], "_pid int, _size long, _off long")
    bad = spark.createDataFrame([(0, 3, 0), (1, 5, 3), (2, 4, 8)], "_pid int, _size long, _off long")
    assert sorted(r.n for r in ranking._number(rows, good, "n", 1).collect()) == list(range(1, 13))
    with pytest.raises(Exception, match="different partitions"):
        ranking._number(rows, bad, "n", 1).collect()
    offsets = [(p, size, "g", 6.0 * p) for p, size in enumerate((4, 4, 4))]
    shape = "_p int, _size long, _g_g string, _o_v double"
    run = ranking._running(rows.drop("_local"), spark.createDataFrame(offsets, shape), ["g"], F.col("v"), ["v"]).collect()
    assert sorted(r.cum_v for r in run) == sorted(6.0 * p + s for p in range(3) for s in (0, 1, 3, 6))
    for other in ([(0, 3, "g", 0.0), (1, 5, "g", 3.0), (2, 4, "g", 13.0)], offsets[:2]):
        with pytest.raises(Exception, match="different partitions"):
            ranking._running(rows.drop("_local"), spark.createDataFrame(other, shape), ["g"], F.col("v"), ["v"]).collect()
