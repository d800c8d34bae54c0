"""End-to-end jobs: loader -> models -> metrics row -> submission file."""

import pytest
from pyspark.sql import functions as F

from echoline.operators.models import TargetModels
from echoline.plans import jobs as P
from echoline.schema import DEFAULT_SPLIT_TS, LABEL_COLS, TARGETS
from echoline.sources.fixtures import interactions
from echoline.sources.readers import PREDICTION_SCHEMA, read_results

SF = "/root/testdata/sf0.001"


def _spec(**kw):
    base = dict(split_ts=DEFAULT_SPLIT_TS, index_cutoff_ts=DEFAULT_SPLIT_TS, model_params={"maxDepth": 2, "maxIter": 2})
    base.update(kw)
    return P.PipelineSpec(**base)


def test_training_table_has_90_features(spark):
    ix = interactions(spark, SF)
    tab = P.build_training_table(ix, _spec(), "train")
    feats = P.feature_columns(tab)
    assert len(feats) == 90, feats
    assert sum(c.startswith("TE_") for c in feats) == 64
    # no nulls left anywhere in the feature columns
    nulls = tab.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in feats]).first().asDict()
    assert not any(nulls.values())


def test_train_evaluate_submit(spark, scratch):
    ix = interactions(spark, SF)
    spec = _spec()
    tr, va = P.build_training_table(ix, spec, "train"), P.build_training_table(ix, spec, "val")
    model = P.train(tr, spec)
    row = P.evaluate(model.transform(va)).first().asDict()
    assert {f"TOTAL_{t}_rce" for t in TARGETS} <= set(row)
    model.save(f"{scratch}/models")
    again = TargetModels.load(f"{scratch}/models", P.feature_columns(tr))
    from echoline.operators.user_index import build_user_index
    test_rows = ix.drop(*LABEL_COLS)
    index, languages = build_user_index(ix, DEFAULT_SPLIT_TS), P.language_dictionary(ix)
    with pytest.raises(ValueError):
        P.submission(spark, test_rows, again, spec, f"{scratch}/none", index=index)
    P.submission(spark, test_rows, again, spec, f"{scratch}/pred", index=index, language_dict=languages)
    pred = read_results(spark, f"{scratch}/pred", schema=PREDICTION_SCHEMA)
    assert pred.count() == ix.count()
    assert pred.filter((F.col("like") < 0) | (F.col("like") > 1)).count() == 0


def test_prior_model_rce_near_zero_on_training_rows(spark):
    from echoline.operators import metrics, profiling
    from echoline.operators.models import prior_scores
    ix = interactions(spark, SF)
    tab = P.build_training_table(ix, _spec(use_index=False), "train")
    scored = prior_scores(tab, profiling.prior_model(tab))
    rows = metrics.unpivot_targets(scored, [], {t: f"score_{t}" for t in TARGETS})
    for r in metrics.rce(rows, ["target"]).collect():
        assert abs(r.rce) < 1e-6


def test_ablation_runs_log(spark, scratch):
    ix = interactions(spark, SF)
    specs = {"no_index": _spec(use_index=False, model_params={"maxDepth": 2, "maxIter": 1}),
             "index": _spec(model_params={"maxDepth": 2, "maxIter": 1})}
    rows = P.ablation_runs(spark, ix, specs, f"{scratch}/runs").collect()
    assert sorted(r.run for r in rows) == ["index", "no_index"]
    log = read_results(spark, f"{scratch}/runs", header=True)
    assert log.count() == 2


def test_language_codes_of_a_subset(spark):
    ix = interactions(spark, SF)
    languages = P.language_dictionary(ix)
    spec = _spec(use_index=False)
    last = [r.value for r in languages.orderBy(F.desc("code")).limit(2).collect()]
    few = P.build_training_table(ix.filter(F.col("language").isin(last)), spec, "test", language_dict=languages)
    codes = {r.code for r in languages.filter(F.col("value").isin(last)).collect()}
    assert {r.language_encoding for r in few.select("language_encoding").distinct().collect()} == codes


def test_noise_reaches_training_rows_only(spark):
    ix = interactions(spark, SF)
    plain, noisy = _spec(), _spec(noise_std=0.05, keep_user_percent=0.5)
    te = "TE_like_a_A"
    for mode, same in (("val", True), ("train", False)):
        a, b = (sorted(r[0] for r in P.build_training_table(ix, s, mode).select(F.round(te, 9)).collect()) for s in (plain, noisy))
        assert (a == b) == same


def test_unweighted_trees_are_calibrated(spark):
    from echoline.operators import metrics
    ix = interactions(spark, SF)
    spec = _spec(use_index=False, model_params={"maxDepth": 3, "maxIter": 12, "stepSize": 0.3})
    tr = P.build_training_table(ix, spec, "train")
    scored = P.train(tr, spec).transform(tr)
    rows = metrics.unpivot_targets(scored, ["bin"], {t: f"score_{t}" for t in TARGETS})
    for r in metrics.rce(rows, ["target"]).collect():
        assert r.rce > 0, r
    for r in rows.groupBy("target").agg(F.avg("score").alias("s"), F.avg("y").alias("y")).collect():
        assert abs(r.s - r.y) < 0.05, r
