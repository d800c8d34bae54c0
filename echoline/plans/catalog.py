"""Named queries over the ``interactions`` view: each is ``(spark, sf_dir) -> DataFrame``.

Floating results are rounded to 6 digits and counts cast to BIGINT so the
DuckDB oracle (``plans/oracle.py``) compares equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..operators import clean, encoding, enrich, user_index
from ..schema import DEFAULT_SPLIT_TS, LABEL_COLS, TARGETS
from . import roundtrips
from ..session import drop_stored, stored
from ..sources.fixtures import interactions

R = 6


def rnd(c, digits: int = R):
    return S.round_half_up(c if not isinstance(c, str) else F.col(c), digits)


def _ix(spark, sf, score=False):
    return interactions(spark, sf, with_score=score)


#: Up to 100 columns Spark compiles a projection into one method; with more doubles than this it is too large for the JVM to compile.
MANY_DOUBLES = 24


def _round_doubles(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if len(doubles) > MANY_DOUBLES and len(df.columns) <= 100:
        at = {c: i for i, c in enumerate(doubles)}
        rounded = df.withColumn("_rounded", F.transform(F.array(*[F.col(c).cast("double") for c in doubles]), lambda x: rnd(x)))
        return rounded.select(*[F.col("_rounded")[at[c]].alias(c) if c in at else F.col(c) for c in df.columns])
    return df.select(*[rnd(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


# ------------------------------------------------------------------ step 1

def positive_rate_by_bin(spark: SparkSession, sf: str) -> DataFrame:
    """E16 + E17 + M2: engagement rate per follower bin and target."""
    df = _ix(spark, sf).select(S.follower_bin("a_follower_count").alias("bin"),
                               *[S.has_label(c).alias(f"has_{t}") for t, c in zip(TARGETS, LABEL_COLS)])
    return df.groupBy("bin").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                 *[rnd(F.avg(F.col(f"has_{t}").cast("double"))).alias(f"ctr_{t}") for t in TARGETS])


def null_audit(spark, sf):
    return clean.null_audit(_ix(spark, sf))


def _ids(df):
    return [F.col("tweet_id"), F.col("a_user_id"), F.col("b_user_id"), F.col("ts")]


def train_split(spark, sf):
    return clean.train_split(_ix(spark, sf), DEFAULT_SPLIT_TS).select(*_ids(None), *LABEL_COLS)


def val_split(spark, sf):
    return clean.val_split(_ix(spark, sf), DEFAULT_SPLIT_TS).select(*_ids(None), *LABEL_COLS)


def split_leftovers(spark, sf):
    return clean.split_leftovers(_ix(spark, sf), DEFAULT_SPLIT_TS).select(*_ids(None), *LABEL_COLS)


def features_log(spark, sf):
    df = _ix(spark, sf)
    d = S.creation_deltas()
    return df.select(*_ids(df),
                     rnd(S.save_log("a_follower_count")).alias("a_followers"),
                     rnd(S.save_log("a_following_count")).alias("a_following"),
                     rnd(S.save_log("b_follower_count")).alias("b_followers"),
                     rnd(S.save_log("b_following_count")).alias("b_following"),
                     *[rnd(v).alias(k) for k, v in d.items()],
                     rnd(S.symlog(F.col("a_account_creation") - F.col("b_account_creation"))).alias("a_b_creation_symlog"))


def features_ratio(spark, sf):
    df = _ix(spark, sf).select(*_ids(None), *[v.alias(k) for k, v in S.follow_ratios().items()])
    df = clean.sentinel_fill(df, subset=list(S.follow_ratios()))
    return _round_doubles(df)


def features_media(spark, sf):
    df = _ix(spark, sf)
    return df.select(*_ids(df), *[rnd(S.media_count_log("medias", k)).alias(n) for n, k in
                                  {"photo_count": "Photo", "video_count": "Video", "gif_count": "GIF"}.items()],
                     S.media_combo("medias").alias("media_combo"))


def features_text_len(spark, sf):
    df = _ix(spark, sf)
    return df.select(*_ids(df), rnd(S.token_len_log("tokens")).alias("bert_token_len"),
                     S.text_length("tokens").alias("token_chars"))


def features_calendar(spark, sf):
    df = _ix(spark, sf)
    return df.select(*_ids(df), S.day_of_week("ts").alias("day_of_week"), S.hour_of_day("ts").alias("hour_of_day"),
                     S.day_of_year("ts").alias("day_of_year"), S.readable_time("ts").alias("readable_ts"))


def features_codes(spark, sf):
    from ..operators.dictionary import encode_column
    df = _ix(spark, sf)
    out = encode_column(df.select(*_ids(df), "type", "language"), "language", "language_encoding")
    return out.select("tweet_id", "a_user_id", "b_user_id", "ts",
                      S.type_encoding("type").alias("type_encoding"), "language_encoding")


def engagement_latency(spark, sf):
    df = _ix(spark, sf)
    return df.select(*_ids(df), *[S.engagement_latency(c).alias(f"{t}_latency") for t, c in zip(TARGETS, LABEL_COLS)])


def id_fold64(spark, sf):
    df = _ix(spark, sf)
    return df.select("tweet_id", S.id_fold64("a_user_id").alias("a_uid64"), S.id_fold64("b_user_id").alias("b_uid64"),
                     S.key64_to_unsigned(S.id_key64("b_user_id")).alias("b_uid64_from_key"))


def id_hash32(spark, sf):
    df = _ix(spark, sf)
    return df.select("tweet_id", S.id_hash32("tweet_id").alias("tweet_hash"), S.id_hash32("a_user_id").alias("a_hash"),
                     S.id_hash32("b_user_id").alias("b_hash"))


# ------------------------------------------------------------------ step 2: user index

def _uid(c="user_id"):
    return S.key64_to_unsigned(F.col(c)).alias("user_id")


def action_unpivot(spark, sf):
    rows = user_index.action_rows(_ix(spark, sf))
    return rows.select(_uid(), "role", "action", "type", "event_ts", "day", "action_type")


def user_action_counts(spark, sf):
    return user_index.user_action_counts(_ix(spark, sf)).select(_uid(), "action_type", F.col("n").cast("bigint"))


def _index_out(idx):
    return idx.select(_uid(), *[c for c in idx.columns if c != "user_id"])


def user_index_q(spark, sf):
    return _index_out(user_index.build_user_index(_ix(spark, sf)))


def user_index_active_only(spark, sf):
    return _index_out(user_index.build_user_index(_ix(spark, sf), require_activity="global"))


def user_day_counts(spark, sf):
    return user_index.user_day_counts(_ix(spark, sf)).select(_uid(), "day", F.col("n").cast("bigint"))


def index_merge(spark, sf):
    """Index of three time slices merged == index of all rows."""
    ix = _ix(spark, sf)
    t1, t2 = 757382400, 820454400  # 1994-01-01, 1996-01-01 (UTC)
    parts = [ix.filter(F.col("ts") < t1), ix.filter((F.col("ts") >= t1) & (F.col("ts") < t2)), ix.filter(F.col("ts") >= t2)]
    partials = [user_index.build_user_index(p, with_combined=False, with_first_seen=True) for p in parts]
    return _index_out(user_index.merge_indexes(*partials).drop("first_seen"))


# ------------------------------------------------------------------ step 3: encodings + enrichment

def _train_index(spark, sf):
    ix = _ix(spark, sf)
    return ix, user_index.build_user_index(ix, cutoff_ts=DEFAULT_SPLIT_TS)


def te_priors_zero(spark, sf):
    _, idx = _train_index(spark, sf)
    return _round_doubles(encoding.priors(idx, "zero"))


def te_priors_skip(spark, sf):
    _, idx = _train_index(spark, sf)
    return _round_doubles(encoding.priors(idx, "skip"))


def te_user(spark, sf):
    _, idx = _train_index(spark, sf)
    te = encoding.user_target_encodings(idx)
    return _round_doubles(te.select(_uid(), *[c for c in te.columns if c != "user_id"]))


def enriched_interactions(spark, sf):
    """Validation rows enriched with the train-only index."""
    ix, idx = _train_index(spark, sf)
    val = clean.val_split(ix, DEFAULT_SPLIT_TS).select(*_ids(None))
    out = enrich.enrich(val, idx, keep_counts=True)
    return _round_doubles(out)


def enriched_sampled_users(spark, sf):
    """50 % of index users kept (deterministic uid64 rule)."""
    ix, idx = _train_index(spark, sf)
    idx = user_index.sample_users(idx, 0.5)
    val = clean.val_split(ix, DEFAULT_SPLIT_TS).select(*_ids(None))
    out = enrich.enrich(val, idx, keep_counts=False)
    return _round_doubles(out)


# ------------------------------------------------------------------ step 6: group encodings

def _labelled(spark, sf, score=False):
    df = _ix(spark, sf, score)
    return df.withColumns({f"has_{t}": S.has_label(c) for t, c in zip(TARGETS, LABEL_COLS)})


def te_group_type(spark, sf):
    df = _labelled(spark, sf).select(*_ids(None), "type", "has_like")
    out = encoding.group_target_encoding(df, "type", "has_like", "TE_type_like")
    return _round_doubles(out.select(*_ids(None), "type", "TE_type_like"))


def te_group_language(spark, sf):
    df = _labelled(spark, sf).select(*_ids(None), "language", "has_reply")
    out = encoding.group_target_encoding(df, "language", "has_reply", "TE_language_reply")
    return _round_doubles(out.select(*_ids(None), "language", "TE_language_reply"))


def te_apply_val(spark, sf):
    """Statistics fit on train rows (per language x type), applied to validation rows."""
    df = _labelled(spark, sf)
    tr, va = clean.train_split(df, DEFAULT_SPLIT_TS), clean.val_split(df, DEFAULT_SPLIT_TS)
    stats = encoding.group_stats(tr, ["language", "type"], "has_retweet")
    out = encoding.apply_group_encoding(va.select(*_ids(None), "language", "type"), stats, ["language", "type"], "TE_lang_type_retweet")
    return _round_doubles(out.select(*_ids(None), "language", "type", "TE_lang_type_retweet"))


def te_group_oof(spark, sf):
    """Q9 option: out-of-fold group TE of language on like (5 md5 folds)."""
    df = _labelled(spark, sf).select(*_ids(None), "language", "has_like")
    out = encoding.out_of_fold_encoding(df, "language", "has_like", ["tweet_id", "b_user_id", "ts"], "TE_language_like_oof")
    return _round_doubles(out.select(*_ids(None), "language", "TE_language_like_oof"))


def cond_prob(spark, sf):
    df = _labelled(spark, sf).withColumn("bin", S.follower_bin("a_follower_count"))
    return _round_doubles(encoding.conditional_probability(df, ["has_reply", "has_like"], ["type", "bin"]))


# ------------------------------------------------------------------ step 8: dictionaries, profiling

def dict_language(spark, sf):
    from ..operators.dictionary import build_dictionary
    return build_dictionary(_ix(spark, sf), "language", null_code=None)


def dict_users(spark, sf):
    from ..operators import profiling
    from ..operators.dictionary import build_dictionary
    from ..sources.fixtures import raw_interactions
    rows, of = raw_interactions(spark, sf, ["a_user_id", "b_user_id"])
    return build_dictionary(profiling.distinct_users(rows, {"l_suppkey": of["a_user_id"], "o_custkey": of["b_user_id"]}), "user_id", null_code=None)


def distinct_hashtags(spark, sf):
    from ..operators import profiling
    return profiling.distinct_list_items(_ix(spark, sf), "hashtags")


def hashtags_encoded(spark, sf):
    """J12 on every interaction; null lists give no codes."""
    from ..operators import profiling
    from ..operators.dictionary import map_list_column
    ix = _ix(spark, sf)
    d = dense_dict(profiling.distinct_list_items(ix, "hashtags"), "value")
    out = map_list_column(ix.select("tweet_id", "b_user_id", "ts", "hashtags"), "hashtags", "codes", d)
    return out.withColumn("codes", F.array_join(F.col("codes").cast("array<string>"), ","))


def dense_dict(values: DataFrame, col: str) -> DataFrame:
    from ..operators.ranking import dense_codes
    return dense_codes(values, col, "code", None).withColumnRenamed(col, "value")


def tokens_decoded(spark, sf):
    """J12 then E32 on every interaction: tokens -> ids through a learned vocabulary -> text again."""
    from ..operators import profiling
    from ..operators.dictionary import decode_tokens, map_list_column
    ix = _ix(spark, sf)
    vocab = dense_dict(profiling.distinct_list_items(ix, "tokens"), "value")
    ids = map_list_column(ix.select("tweet_id", "b_user_id", "ts", "tokens"), "tokens", "ids", vocab)
    ids = ids.withColumn("token_ids", F.array_join(F.col("ids").cast("array<string>"), "\t")).drop("ids")
    v = vocab.select(F.col("code").alias("token_id"), F.col("value").alias("token"))
    return decode_tokens(ids, "token_ids", v, "text")


def combo_media_codes(spark, sf):
    from ..operators.dictionary import build_dictionary
    ix = _ix(spark, sf).select(S.media_combo("medias").alias("media_combo"))
    return build_dictionary(ix, "media_combo", null_code=None).withColumnRenamed("value", "media_combo")


def follower_quintiles(spark, sf):
    from ..operators import profiling
    st = profiling.author_follower_stats(_ix(spark, sf))
    return _round_doubles(profiling.quintile_groups(st))


def quintiles_by_part(spark, sf):
    from ..operators import profiling
    ix = _ix(spark, sf).withColumn("part", F.year(S.epoch_date("ts")))
    st = profiling.author_follower_stats(ix, part="part")
    return _round_doubles(profiling.quintiles_by_part(st, "part"))


def class_weights(spark, sf):
    from ..operators import profiling
    return _round_doubles(profiling.class_weights(_labelled(spark, sf)))


def dup_hashes(spark, sf):
    from ..operators import profiling
    return profiling.duplicate_count(_ix(spark, sf).select(S.id_hash32("b_user_id").alias("b_hash")), "b_hash")


def time_range(spark, sf):
    from ..operators import profiling
    t = profiling.time_range(_ix(spark, sf))
    return t.withColumns({"min_readable": S.readable_time("min_ts"), "max_readable": S.readable_time("max_ts")})


def longest_text(spark, sf):
    from ..operators import profiling
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return profiling.longest_text(docs, "text", "doc_id", ["lang"])


def _full_index(spark, sf):
    return user_index.build_user_index(_ix(spark, sf))


def bins_onehot(spark, sf):
    from ..operators import profiling
    oh = profiling.bins_onehot(_full_index(spark, sf))
    return oh.withColumn("user_id", S.key64_to_unsigned("user_id"))


def activity_distribution(spark, sf):
    from ..operators import profiling
    return _round_doubles(profiling.activity_distribution(profiling.bins_onehot(_full_index(spark, sf))))


def activity_histogram(spark, sf):
    from ..operators import profiling
    return profiling.activity_histogram(profiling.bins_onehot(_full_index(spark, sf)))


def topk_users(spark, sf):
    from ..operators import profiling
    idx = _full_index(spark, sf).select(S.key64_to_unsigned("user_id").alias("user_id"), "n_present_a", "n_present_b")
    return profiling.top_k(idx, "n_present_a", 10, "user_id")


def prior_model(spark, sf):
    """A32 + L6: train-row label means as constant predictions for validation rows."""
    from ..operators import profiling
    df = _labelled(spark, sf)
    pri = profiling.prior_model(clean.train_split(df, DEFAULT_SPLIT_TS))
    va = clean.val_split(df, DEFAULT_SPLIT_TS).select("tweet_id", "b_user_id")
    return _round_doubles(va.crossJoin(F.broadcast(pri)))


# ------------------------------------------------------------------ step 7: metrics on synthetic scores

def _metric_rows(spark, sf):
    from ..operators.metrics import unpivot_targets
    df = _labelled(spark, sf, score=True).withColumn("bin", S.follower_bin("a_follower_count"))
    return unpivot_targets(df, ["bin"], "score")


def rce_by_bin(spark, sf):
    from ..operators.metrics import rce
    return _round_doubles(rce(_metric_rows(spark, sf), ["bin", "target"]))


def ap_by_bin(spark, sf):
    from ..operators.metrics import average_precision
    return _round_doubles(average_precision(_metric_rows(spark, sf), ["bin", "target"]))


def metrics_macro(spark, sf):
    from ..operators.metrics import macro_mean, metrics_by_group
    per_bin = metrics_by_group(_metric_rows(spark, sf), ["bin", "target"])
    return _round_doubles(macro_mean(per_bin, ["target"], ["rce", "ap"]))


def metrics_overall(spark, sf):
    from ..operators.metrics import metrics_by_group
    m = metrics_by_group(_metric_rows(spark, sf), ["target"])
    return _round_doubles(m.select("target", "n", "ctr", "log_loss", "rce", "ap", "positives"))


def confusion(spark, sf):
    from ..operators.metrics import confusion as conf
    return conf(_metric_rows(spark, sf), ["target"])


def balanced_accuracy(spark, sf):
    from ..operators.metrics import classification_scores
    return _round_doubles(classification_scores(_metric_rows(spark, sf), ["target"]))


# ------------------------------------------------------------------ step 9: regularisation

_SCALE_COLS = ["a_follower_count", "b_follower_count", "a_following_count", "b_following_count"]


def minmax_scaled(spark, sf):
    from ..operators.regularize import apply_minmax, fit_minmax
    df = _ix(spark, sf)
    stats = fit_minmax(clean.train_split(df, DEFAULT_SPLIT_TS), _SCALE_COLS)
    va = clean.val_split(df, DEFAULT_SPLIT_TS).select(*_ids(None), *_SCALE_COLS)
    return _round_doubles(apply_minmax(va, stats, _SCALE_COLS))


def mask_columns(spark, sf):
    from ..operators.regularize import mask_columns as mask
    df = _ix(spark, sf).select(*_ids(None), *_SCALE_COLS)
    return mask(df, {"author": ["a_follower_count", "a_following_count"], "consumer": ["b_follower_count", "b_following_count"]},
                0.75, key=["tweet_id", "b_user_id", "ts"])


def hash_split(spark, sf):
    from ..operators.regularize import hash_split as hs
    return hs(_ix(spark, sf).select(*_ids(None)), ["tweet_id", "b_user_id", "ts"])


def row_ids(spark, sf):
    from ..operators.ranking import global_row_index
    df = _ix(spark, sf).select("tweet_id", "b_user_id", "ts", "type")
    return global_row_index(df, ["ts", "tweet_id", "b_user_id", "type"], "row_id", start=1)


# ------------------------------------------------------------------ step 9: models (rows-only checks)

def _spec(**kw):
    from .jobs import PipelineSpec
    base = dict(split_ts=DEFAULT_SPLIT_TS, index_cutoff_ts=DEFAULT_SPLIT_TS, model_params={"maxDepth": 3, "maxIter": 3})
    base.update(kw)
    return PipelineSpec(**base)


def _stored_index(ix, spec):
    """The user index as a table: made once for priors and joins, and its shuffle files are gone before these."""
    return stored(user_index.build_user_index(ix, spec.index_cutoff_ts), "index")[0]


def _tables(spark, sf, spec):
    from .jobs import build_training_table
    ix = _ix(spark, sf)
    idx = _stored_index(ix, spec)
    return build_training_table(ix, spec, "train", idx), build_training_table(ix, spec, "val", idx)


def gbt_scores(spark, sf):
    """L2 + L4 on the full loader table (train before the split time, score after)."""
    from .jobs import train
    spec = _spec()
    tr, va = _tables(spark, sf, spec)
    return train(tr, spec).transform(va).select("tweet_id", "b_user_id", "bin", *[f"score_{t}" for t in TARGETS])


def rf_importance(spark, sf):
    """L9 + M11: random-forest importances per target, sorted."""
    from ..operators.models import TargetModels
    from .jobs import feature_columns
    spec = _spec(model_kind="rf", model_params={"maxDepth": 5, "numTrees": 10})
    tr, _ = _tables(spark, sf, spec)
    m = TargetModels(feature_columns(tr), "rf", params=spec.model_params).fit(tr)
    return m.feature_importances(spark)


def stacked_scores(spark, sf):
    """Two base model sets -> stacked GBT fit on held-out rows (hash split)."""
    from ..operators.models import StackedModels, TargetModels
    from ..operators.regularize import hash_split
    from .jobs import feature_columns
    spec = _spec()
    tr, va = _tables(spark, sf, spec)
    feats = feature_columns(tr)
    # Both bases and the held-out rows read one table; the loader runs once.
    parts, path = stored(hash_split(tr, ["tweet_id", "b_user_id"], 0.7), "stacking-rows")
    fit_rows, held = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")
    bases = [TargetModels(feats, "gbt", params={"maxDepth": 2, "maxIter": 3}).fit(fit_rows, table=True),
             TargetModels(feats, "tree", params={"maxDepth": 4}).fit(fit_rows, table=True)]
    st = StackedModels(bases, params={"maxDepth": 2, "maxIter": 3}).fit(held)
    drop_stored(spark, path)
    return st.transform(va).select("tweet_id", "b_user_id", *[f"score_{t}" for t in TARGETS])


def noise_te(spark, sf):
    """Gaussian noise on every TE column of the training rows after the sentinel fill."""
    from .jobs import build_training_table
    spec = _spec(noise_std=0.05, remove_user_counts=True)
    ix = _ix(spark, sf)
    tr = build_training_table(ix, spec, "train", _stored_index(ix, spec))
    return _round_doubles(tr.select("tweet_id", "b_user_id", *[c for c in tr.columns if c.startswith("TE_")]))


def random_scores(spark, sf):
    """Uniform random baseline scores for validation rows."""
    from ..operators.regularize import random_scores as rs
    va = clean.val_split(_ix(spark, sf), DEFAULT_SPLIT_TS).select("tweet_id", "b_user_id")
    return _round_doubles(rs(va, TARGETS, seed=7, key=["tweet_id", "b_user_id"]))


def balanced_class_weights(spark, sf):
    """Class weights n / (2 n_c) of the training rows, one aggregate."""
    from ..operators.models import balanced_weights
    return _round_doubles(balanced_weights(clean.train_split(_labelled(spark, sf), DEFAULT_SPLIT_TS)))


def weight_replicas(spark, sf):
    """Training rows repeated by bin and class weight for the reply net: copies per bin and class."""
    from ..operators.models import with_weights
    from ..operators.regularize import replicate_by_weight
    df = clean.train_split(_labelled(spark, sf), DEFAULT_SPLIT_TS).withColumn("bin", S.follower_bin("a_follower_count"))
    rows = replicate_by_weight(with_weights(df, "reply"), "weight", ["tweet_id", "b_user_id", "ts"], scale=4.0, seed=3)
    return rows.groupBy("bin", "has_reply").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("tweet_id", "b_user_id", "ts").alias("n_rows"))


def boosting_steps(spark, sf):
    """L3: gradient and curvature sums per follower bin and target at the start margin, what the first tree is fit on."""
    from ..operators.boosting import curvature, gradient
    df = clean.train_split(_labelled(spark, sf), DEFAULT_SPLIT_TS).withColumn("bin", S.follower_bin("a_follower_count"))
    share = df.agg(*[F.avg(F.col(f"has_{t}").cast("double")).alias(f"s_{t}") for t in TARGETS])
    df = df.crossJoin(F.broadcast(share))  # one row
    out = []
    for t in TARGETS:
        m = F.log(F.col(f"s_{t}") / (1 - F.col(f"s_{t}")))
        out += [rnd(F.sum(gradient(F.col(f"has_{t}").cast("double"), m))).alias(f"g_{t}"), rnd(F.sum(curvature(m))).alias(f"h_{t}")]
    return df.groupBy("bin").agg(*out)


def continued_scores(spark, sf):
    """L3 + L4 + F21: trees on the plain features, trained on batch by batch over the training rows (two
    batches by hash), then validation rows scored."""
    from ..operators.boosting import ContinuedModels
    from ..operators.regularize import hash_split
    from .jobs import build_training_table, feature_columns, language_dictionary
    ix, spec = _ix(spark, sf), _spec(use_index=False)
    codes = language_dictionary(ix)
    tr, va = (build_training_table(ix, spec, mode, language_dict=codes) for mode in ("train", "val"))
    parts = hash_split(tr, ["tweet_id", "b_user_id"], 0.5)
    batches = [parts.filter(F.col("split") == s).drop("split") for s in ("train", "test")]
    models = ContinuedModels(feature_columns(tr, "plain"), params={"depth": 3, "step": 0.3}).fit(batches, rounds_per_batch=2)
    return models.transform(va).select("tweet_id", "b_user_id", *[f"score_{t}" for t in TARGETS])


def streaming_user_index(spark, sf):
    """The index maintained by Structured Streaming over the interaction
    files (written as Parquet parts into the checkpoint folder): each
    micro-batch appends a partial index, merged on read; equals the batch index."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming.index_stream import read_incremental_index, run_incremental_index
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/t1-{uuid.uuid4().hex}"
    ix = _ix(spark, sf)
    cols = ["a_user_id", "a_follower_count", "a_following_count", "a_is_verified", "a_account_creation",
            "b_user_id", "b_follower_count", "b_following_count", "b_is_verified", "b_account_creation",
            *LABEL_COLS, "ts", "type"]
    from ..schema import LABELLED_SCHEMA
    full = ix.select(*[F.col(f.name) if f.name in cols else F.lit(None).cast(f.dataType).alias(f.name) for f in LABELLED_SCHEMA.fields])
    full.write.mode("overwrite").parquet(f"{base}/src")
    run_incremental_index(spark, f"{base}/src", f"{base}/parts", f"{base}/ckpt", max_files_per_trigger=8, fmt="parquet")
    return _index_out(read_incremental_index(spark, f"{base}/parts"))


# ------------------------------------------------------------------ more coverage

def training_table(spark, sf):
    """2.14 flagship output: validation rows of the full loader (90 features,
    labels, ids, bin), index and priors from train rows only."""
    from .jobs import PipelineSpec, build_training_table
    spec = PipelineSpec(split_ts=DEFAULT_SPLIT_TS, index_cutoff_ts=DEFAULT_SPLIT_TS)
    return _round_doubles(build_training_table(_ix(spark, sf), spec, "val"))


def training_table_train(spark, sf):
    """The same for the training rows: what models are fit on."""
    from .jobs import PipelineSpec, build_training_table
    spec = PipelineSpec(split_ts=DEFAULT_SPLIT_TS, index_cutoff_ts=DEFAULT_SPLIT_TS)
    ix = _ix(spark, sf)
    return _round_doubles(build_training_table(ix, spec, "train", _stored_index(ix, spec)))


def training_table_no_index(spark, sf):
    """The loader without a user index and without named features, for rows with a like."""
    from .jobs import PipelineSpec, build_training_table
    spec = PipelineSpec(split_ts=DEFAULT_SPLIT_TS, use_index=False, drop_features=list(DROPPED_FEATURES))
    liked = clean.drop_null_label(_ix(spark, sf), "like_ts")
    return _round_doubles(build_training_table(liked, spec, "val", language_dict=_language_codes(spark, sf)))


def _language_codes(spark, sf):
    from .jobs import language_dictionary
    return language_dictionary(_ix(spark, sf))


DROPPED_FEATURES = ("gif_count", "a_follows_b", "hour_of_day")


def index_without_counts(spark, sf):
    """the wide index (with a column a day of the year) after dropping the day counts and, by prefix, the reply counts."""
    idx = user_index.build_user_index(_ix(spark, sf), with_day_counts=True)
    return _index_out(clean.drop_prefixed(user_index.drop_day_counts(idx), "n_reply"))


def label_safe_features(spark, sf):
    """A registry in which features come from labels, directly and through another feature; what is
    left without them is applied to unlabelled rows (the whole registry would be refused)."""
    from ..functions import registry as reg
    specs = {
        "a_followers": reg.default_features()["a_followers"],
        "day_of_week": reg.default_features()["day_of_week"],
        "bin": reg.default_features()["bin"],
        **reg.default_targets(),
        "liked_bin": reg.FeatureSpec(("bin", "has_like"), lambda: F.when(F.col("has_like"), F.col("bin")), "int"),
        "liked_bin_squared": reg.FeatureSpec(("liked_bin",), lambda: F.col("liked_bin") * F.col("liked_bin"), "int"),
        "bin_squared": reg.FeatureSpec(("bin",), lambda: F.col("bin") * F.col("bin"), "int"),
    }
    leaking = reg.label_derived(specs)
    rows = _ix(spark, sf).drop(*LABEL_COLS)
    safe = {k: v for k, v in specs.items() if k not in leaking}
    return _round_doubles(reg.apply_registry(rows, safe, "test").select("tweet_id", "b_user_id", "ts", *safe))


def widened_counts(spark, sf):
    """unsigned counts and ids that came as signed integers of their width, stored in the next wider type, and
    summed by language: no sum wraps around."""
    wide = clean.widen_unsigned(_ix(spark, sf).select("language", F.col("a_follower_count").cast("int"), F.col("b_follower_count").cast("int"),
                                                      F.col("ts")), ["a_follower_count", "b_follower_count"], 32)
    wide = clean.widen_unsigned(wide, ["ts"], 64)
    return wide.groupBy("language").agg(F.sum("a_follower_count").alias("a_total"), F.sum("b_follower_count").alias("b_total"),
                                        F.sum("ts").cast("string").alias("ts_total"))


def enriched_skew_split(spark, sf):
    """J1/J2 through the hot-key split join (must equal ``enriched_interactions``)."""
    ix, idx = _train_index(spark, sf)
    val = clean.val_split(ix, DEFAULT_SPLIT_TS).select(*_ids(None))
    return _round_doubles(enrich.enrich(val, idx, keep_counts=True, skew="split", materialize="checkpoint"))


def enriched_bucketed(spark, sf):
    """J1/J2 against the index encodings as a bucketed table (must equal ``enriched_interactions``)."""
    import uuid
    from ..session import ensure_checkpoint_dir
    ix, idx = _train_index(spark, sf)
    name = f"encodings_{uuid.uuid4().hex}"
    enrich.write_encodings(idx, name, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    val = clean.val_split(ix, DEFAULT_SPLIT_TS).select(*_ids(None))
    return _round_doubles(enrich.enrich_from_table(val, name))


def prior_baseline_metrics(spark, sf):
    """L6 + M5: the constant-prior model (train means) scored per bin on validation rows."""
    from ..operators import profiling
    from ..operators.metrics import metrics_by_group, unpivot_targets
    df = _labelled(spark, sf).withColumn("bin", S.follower_bin("a_follower_count"))
    pri = profiling.prior_model(clean.train_split(df, DEFAULT_SPLIT_TS))
    va = clean.val_split(df, DEFAULT_SPLIT_TS).crossJoin(F.broadcast(pri))
    rows = unpivot_targets(va, ["bin"], {t: f"prior_{t}" for t in TARGETS})
    return _round_doubles(metrics_by_group(rows, ["bin", "target"]))


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def events_day_windows(spark, sf):
    """T3 (batch form of the same plan): events per user and UTC day window."""
    from ..streaming.index_stream import windowed_day_counts
    return windowed_day_counts(_events(spark, sf).select("user_id", "ts"))


def _ntz_epoch(c):
    c = F.col(c)
    return F.unix_date(F.to_date(c)).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))


def events_calendar(spark, sf):
    """E12/E13 on the events table: counts per type, weekday and hour (UTC)."""
    ev = _events(spark, sf).withColumn("_s", _ntz_epoch("ts"))
    return ev.groupBy("event_type", S.day_of_week("_s").alias("day_of_week"), S.hour_of_day("_s").alias("hour_of_day")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"), rnd(F.sum("value")).alias("value_sum"))


def documents_token_len(spark, sf):
    """E6/E24 on whole documents: ln(1 + #space-separated tokens), character length."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", "lang", rnd(F.log1p(F.size(F.split("text", " ")).cast("double"))).alias("token_len_log"),
                    S.text_length("text").alias("n_chars"))


def labels_metrics(spark, sf):
    """M3/M4 on the second label set: quality/toxic labels scored by a
    length-based synthetic score, per language."""
    from ..operators.metrics import metrics_by_group, unpivot_targets
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    j = d.join(lab, "doc_id").select(
        "lang", F.round(1 / (1 + F.exp(5 - F.log1p(F.size(F.split("text", " ")).cast("double")))), 3).alias("score"),
        (F.col("quality") == 1).alias("has_quality"), (F.col("toxic") == 1).alias("has_toxic"))
    rows = unpivot_targets(j, ["lang"], "score", targets=["quality", "toxic"])
    return _round_doubles(metrics_by_group(rows, ["lang", "target"]))


def user_lookup(spark, sf):
    """all rows of the most active consumer (equality filter on the id)."""
    ix = _ix(spark, sf)
    top = ix.groupBy("b_user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("b_user_id")).limit(1)
    return ix.join(top.select("b_user_id"), "b_user_id", "left_semi").select(*_ids(None), "type", *LABEL_COLS)


def head_preview(spark, sf):
    """the first 10 rows in a stated order (the limit is the feature)."""
    return _ix(spark, sf).select("ts", "tweet_id", "b_user_id", "type").orderBy("ts", "tweet_id", "b_user_id", "type").limit(10)


def batch_sizes(spark, sf):
    """5000-row batches over the ordered rows; rows per batch."""
    from ..operators.profiling import batch_sizes as bs
    from ..sources.readers import with_batches
    df = _ix(spark, sf).select("ts", "tweet_id", "b_user_id", "type")
    return bs(with_batches(df, 5000, ["ts", "tweet_id", "b_user_id", "type"]))


def distinct_values(spark, sf):
    """Distinct values of type, language and media combination."""
    ix = _ix(spark, sf)
    parts = [ix.select(F.lit(c).alias("column_name"), F.col(c).alias("value")).distinct() for c in ("type", "language")]
    parts.append(ix.select(F.lit("media_combo").alias("column_name"), S.media_combo("medias").alias("value")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_summary(spark, sf):
    """Non-null count per column (one aggregate, then a narrow unpivot)."""
    ix = _ix(spark, sf)
    agg = ix.agg(*[F.count(c).cast("bigint").alias(c) for c in ix.columns])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_null")) for c in ix.columns])))


def score_transforms(spark, sf):
    """E25, E28-E31 on the synthetic score and counts."""
    df = _ix(spark, sf, score=True)
    return df.select(*_ids(None), rnd(S.inverse_log(S.save_log("a_follower_count"))).alias("followers_roundtrip"),
                     rnd(S.squeeze_probability("score")).alias("squeezed"), S.round_decision("score").alias("decision"),
                     S.nonzero("reply_ts").alias("nonzero_reply"),
                     rnd(S.nan_to_num(S.safe_ratio("a_following_count", "b_following_count"))).alias("ratio_or_zero"))


def row_weights(spark, sf):
    """E26 x E27: training-row weights per target (bin weight * class weight)."""
    df = _labelled(spark, sf).withColumn("bin", S.follower_bin("a_follower_count"))
    df = clean.train_split(df, DEFAULT_SPLIT_TS)
    return df.select(*_ids(None), "bin", *[rnd(S.bin_weight("bin") * S.class_weight(t)).alias(f"w_{t}") for t in TARGETS])


def index_diff(spark, sf):
    """Users only in the train index, only in the validation index, or in both."""
    ix = _ix(spark, sf)
    tr = user_index.build_user_index(clean.train_split(ix, DEFAULT_SPLIT_TS), with_combined=False).select("user_id")
    va = user_index.build_user_index(clean.val_split(ix, DEFAULT_SPLIT_TS), with_combined=False).select("user_id")
    parts = [user_index.index_key_diff(tr, va, how).withColumn("side", F.lit(how)) for how in ("left_only", "right_only", "both")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(_uid(), "side")


QUERIES = {
    "positive_rate_by_bin": positive_rate_by_bin,
    "null_audit": null_audit,
    "train_split": train_split,
    "val_split": val_split,
    "split_leftovers": split_leftovers,
    "features_log": features_log,
    "features_ratio": features_ratio,
    "features_media": features_media,
    "features_text_len": features_text_len,
    "features_calendar": features_calendar,
    "features_codes": features_codes,
    "engagement_latency": engagement_latency,
    "id_fold64": id_fold64,
    "id_hash32": id_hash32,
    "action_unpivot": action_unpivot,
    "user_action_counts": user_action_counts,
    "user_index": user_index_q,
    "user_index_active_only": user_index_active_only,
    "user_day_counts": user_day_counts,
    "index_merge": index_merge,
    "te_priors_zero": te_priors_zero,
    "te_priors_skip": te_priors_skip,
    "te_user": te_user,
    "enriched_interactions": enriched_interactions,
    "enriched_sampled_users": enriched_sampled_users,
    "te_group_type": te_group_type,
    "te_group_language": te_group_language,
    "te_apply_val": te_apply_val,
    "te_group_oof": te_group_oof,
    "cond_prob": cond_prob,
    "dict_language": dict_language,
    "dict_users": dict_users,
    "distinct_hashtags": distinct_hashtags,
    "hashtags_encoded": hashtags_encoded,
    "tokens_decoded": tokens_decoded,
    "combo_media_codes": combo_media_codes,
    "follower_quintiles": follower_quintiles,
    "quintiles_by_part": quintiles_by_part,
    "class_weights": class_weights,
    "dup_hashes": dup_hashes,
    "time_range": time_range,
    "longest_text": longest_text,
    "bins_onehot": bins_onehot,
    "activity_distribution": activity_distribution,
    "activity_histogram": activity_histogram,
    "topk_users": topk_users,
    "prior_model": prior_model,
    "rce_by_bin": rce_by_bin,
    "ap_by_bin": ap_by_bin,
    "metrics_macro": metrics_macro,
    "metrics_overall": metrics_overall,
    "confusion": confusion,
    "balanced_accuracy": balanced_accuracy,
    "minmax_scaled": minmax_scaled,
    "mask_columns": mask_columns,
    "hash_split": hash_split,
    "row_ids": row_ids,
    "streaming_user_index": streaming_user_index,
    "training_table": training_table,
    "training_table_train": training_table_train,
    "enriched_skew_split": enriched_skew_split,
    "prior_baseline_metrics": prior_baseline_metrics,
    "events_day_windows": events_day_windows,
    "events_calendar": events_calendar,
    "documents_token_len": documents_token_len,
    "labels_metrics": labels_metrics,
    "user_lookup": user_lookup,
    "head_preview": head_preview,
    "batch_sizes": batch_sizes,
    "distinct_values": distinct_values,
    "column_summary": column_summary,
    "score_transforms": score_transforms,
    "row_weights": row_weights,
    "index_diff": index_diff,
    "gbt_scores": gbt_scores,
    "rf_importance": rf_importance,
    "stacked_scores": stacked_scores,
    "noise_te": noise_te,
    "random_scores": random_scores,
    "balanced_class_weights": balanced_class_weights,
    "weight_replicas": weight_replicas,
    "boosting_steps": boosting_steps,
    "continued_scores": continued_scores,
    "enriched_bucketed": enriched_bucketed,
}
QUERIES.update(roundtrips.QUERIES)
QUERIES.update({f.__name__: f for f in (training_table_no_index, index_without_counts, label_safe_features, widened_counts)})
