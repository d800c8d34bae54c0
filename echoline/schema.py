"""Interaction data model: column names, types and fixed vocabularies.

One interaction row says "user *b* was shown a post of user *a*" plus the
times at which *b* engaged with it (null = no engagement).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the original pipeline's for equal results) ---
TARGETS = ["reply", "retweet", "retweet_comment", "like"]
ROLES = ["a", "b"]
POST_TYPES = ["TopLevel", "Retweet", "Quote", "Reply"]
# Types summed into the "combined" counts; Reply is deliberately not included.
COMBINED_TYPES = ["TopLevel", "Retweet", "Quote"]
TYPE_CODES = {"Retweet": 0, "Quote": 1, "Reply": 2, "TopLevel": 3}
MEDIA_KINDS = {"photo_count": "Photo", "video_count": "Video", "gif_count": "GIF"}
# Follower-bin thresholds (upper bounds of bins 1..4; bin 5 is the rest).
BIN_THRESHOLDS_FINAL = (93, 217, 442, 1064)
BIN_THRESHOLDS_EARLY = (421, 1353, 4945, 30774)
# Row weight per follower bin.
BIN_WEIGHTS = {
    1: 1 / 1.0130917460992925,
    2: 1 / 1.0303799771448288,
    3: 1 / 1.067847570684079,
    4: 1 / 1.1811149549578355,
    5: 1 / 2.3024519531001713,
}
# Class weight per target: (weight of negatives, weight of positives).
CLASS_WEIGHTS = {
    "reply": (0.02856209176374005, 0.97143790823626),
    "like": (0.39659210314819315, 0.6034078968518068),
    "retweet": (0.08755434847585154, 0.9124456515241485),
    "retweet_comment": (0.00695653848861754, 0.9930434615113825),
}
RATIO_INF = 1e7          # value of x/0 for x != 0 in follower/following ratios
SENTINEL = -10           # fill for every remaining null after enrichment
DEFAULT_SMOOTHING = 20   # target-encoding smoothing weight
DEFAULT_SPLIT_TS = 915148800  # 1999-01-01 UTC, default train/validation border
# --- end of fixed values ---

# Canonical column names.  ``timestamp`` and ``like`` are SQL keywords, so the
# post time is ``ts`` and the engagement times carry a ``_ts`` suffix.
TOKENS = "tokens"
TS = "ts"
LABEL_COLS = [f"{t}_ts" for t in TARGETS]
HAS_COLS = [f"has_{t}" for t in TARGETS]

FEATURE_FIELDS = [
    T.StructField("tokens", T.StringType()),
    T.StructField("hashtags", T.StringType()),
    T.StructField("tweet_id", T.StringType()),
    T.StructField("medias", T.StringType()),
    T.StructField("links", T.StringType()),
    T.StructField("domains", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("a_user_id", T.StringType()),
    T.StructField("a_follower_count", T.LongType()),
    T.StructField("a_following_count", T.LongType()),
    T.StructField("a_is_verified", T.BooleanType()),
    T.StructField("a_account_creation", T.LongType()),
    T.StructField("b_user_id", T.StringType()),
    T.StructField("b_follower_count", T.LongType()),
    T.StructField("b_following_count", T.LongType()),
    T.StructField("b_is_verified", T.BooleanType()),
    T.StructField("b_account_creation", T.LongType()),
    T.StructField("a_follows_b", T.BooleanType()),
]
LABEL_FIELDS = [T.StructField(c, T.LongType()) for c in LABEL_COLS]

UNLABELLED_SCHEMA = T.StructType(FEATURE_FIELDS)
LABELLED_SCHEMA = T.StructType(FEATURE_FIELDS + LABEL_FIELDS)
FEATURE_COLS = [f.name for f in FEATURE_FIELDS]
ALL_COLS = FEATURE_COLS + LABEL_COLS

# The 16 columns the user index needs (column-pruned scan).
USER_CENTRIC_COLS = [
    "a_user_id", "a_follower_count", "a_following_count", "a_is_verified", "a_account_creation",
    "b_user_id", "b_follower_count", "b_following_count", "b_is_verified", "b_account_creation",
    *LABEL_COLS, "ts", "type",
]

PROFILE_FIELDS = ["follower_count", "following_count", "verified", "account_creation"]
ACTIONS = ["present", *TARGETS]


def schema_for(mode: str) -> T.StructType:
    """Labelled schema for train/val, unlabelled (first 20 columns) for test."""
    return UNLABELLED_SCHEMA if mode == "test" else LABELLED_SCHEMA


def count_col(action: str, role: str, post_type: str | None = None) -> str:
    """Name of an index count column, e.g. ``n_like_b_Quote`` or ``n_present_a``."""
    return f"n_{action}_{role}" + (f"_{post_type}" if post_type else "")


def typed_count_cols(types=POST_TYPES) -> list[str]:
    return [count_col(a, r, t) for t in types for r in ROLES for a in ACTIONS]


def combined_count_cols() -> list[str]:
    return [count_col(a, r) for r in ROLES for a in ACTIONS]


def te_col(target: str, role: str, post_type: str | None, side: str) -> str:
    """Target-encoding column, e.g. ``TE_like_a_Quote_B`` or ``TE_reply_b_A``."""
    return f"TE_{target}_{role}" + (f"_{post_type}" if post_type else "") + f"_{side}"
