"""Exploratory statistics as aggregations.

Quantile-style cut points use exact global ranks (``ranking.global_row_index``)
rather than an unpartitioned window, so no single task sees every user.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import follower_bin
from ..schema import BIN_THRESHOLDS_FINAL, TARGETS
from .ranking import global_row_index


def author_follower_stats(df: DataFrame, user: str = "a_user_id", value: str = "a_follower_count",
                          part: str | None = None) -> DataFrame:
    """Mean of ``value`` and row count per user (and part)."""
    keys = ([part] if part else []) + [user]
    return df.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("mean"),
                                 F.count(F.lit(1)).cast("bigint").alias("count"))


def quintile_groups(stats: DataFrame, user: str = "a_user_id", part: str | None = None, k: int = 5) -> DataFrame:
    """Users sorted by mean (ties by user id) and cut at floor(j/k * n);
    per group j: ``upper_mean`` = max mean of the first floor(j/k * n) users,
    ``avg_count`` = mean row count inside the group, ``n_users``."""
    keys = [part] if part else []
    ranked = global_row_index(stats, [*(F.col(c) for c in keys), F.col("mean"), F.col(user)], "_pos")
    if part:
        # Windows over a part's rows or a join on it would put a part into one task.
        starts = ranked.groupBy(part).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
        ranked = ranked.join(starts, part).withColumn("_pos", F.col("_pos") - F.col("_start"))
    else:
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("_n"))))
    bounds = F.array(*[F.floor(F.lit(j / k) * F.col("_n")) for j in range(1, k + 1)])
    # group index = 1 + number of bounds <= position
    ranked = ranked.withColumn("quintile", (F.size(F.filter(bounds, lambda b: b <= F.col("_pos"))) + 1).cast("int"))
    per_group = ranked.groupBy(*keys, "quintile").agg(F.max("mean").alias("_gmax"), F.avg(F.col("count").cast("double")).alias("avg_count"),
                                                   F.count(F.lit(1)).cast("bigint").alias("n_users"))
    w = Window.partitionBy(*keys).orderBy("quintile").rowsBetween(Window.unboundedPreceding, 0)
    return per_group.withColumn("upper_mean", F.max("_gmax").over(w)).drop("_gmax")


def quintiles_by_part(stats: DataFrame, part: str, user: str = "a_user_id", k: int = 5) -> DataFrame:
    """Per-part quintile statistics averaged over parts."""
    g = quintile_groups(stats, user, part, k)
    return g.groupBy("quintile").agg(F.avg("upper_mean").alias("upper_mean"), F.avg("avg_count").alias("avg_count"),
                                  F.count(F.lit(1)).cast("bigint").alias("n_parts"))


def class_weights(df: DataFrame, targets=TARGETS) -> DataFrame:
    """A20/A21 (E27 source): positive rate and inverse-frequency weights that sum to 1."""
    rates = df.agg(*[F.avg(F.col(f"has_{t}").cast("double")).alias(t) for t in targets])
    long = rates.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("positive_rate")) for t in targets])))
    p = F.col("positive_rate")
    inv_neg, inv_pos = F.try_divide(F.lit(1.0), 1 - p), F.try_divide(F.lit(1.0), p)
    return long.select("target", "positive_rate",
                       (inv_neg / (inv_neg + inv_pos)).alias("weight_neg"),
                       (inv_pos / (inv_neg + inv_pos)).alias("weight_pos"))


def duplicate_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Rows - distinct values."""
    distinct = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), distinct.cast("bigint").alias("n_distinct")) \
        .withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def time_range(df: DataFrame, col: str = "ts") -> DataFrame:
    """A26."""
    return df.agg(F.min(col).alias("min_ts"), F.max(col).alias("max_ts"))


def longest_text(df: DataFrame, text: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Arg-max row by text length (ties: smallest key)."""
    by = by or []
    best = F.max_by(F.struct(F.col(key), F.length(text).alias("n")), F.struct(F.length(text), -F.col(key)))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{key}").alias(key),
                                                         F.col("_b.n").cast("bigint").alias("n_chars"))


def bins_onehot(index: DataFrame, thresholds=BIN_THRESHOLDS_FINAL, present: str = "n_present_a") -> DataFrame:
    """F13 + A28 + J13: active users with a one-hot follower bin (static pivot list)."""
    k = len(thresholds) + 1
    act = index.filter(F.col(present) > 0).withColumn("bin", follower_bin("follower_count", thresholds))
    return act.select("user_id", F.col(present).alias("n_present"), "bin",
                      *[(F.col("bin") == b).cast("int").alias(f"bin{b}") for b in range(1, k + 1)])


def activity_distribution(onehot: DataFrame, k: int = 5) -> DataFrame:
    """Per activity level, user count, bin shares and users per bin."""
    g = onehot.groupBy("n_present").agg(F.count(F.lit(1)).cast("bigint").alias("n_users"),
                                        *[F.avg(f"bin{b}").alias(f"share_bin{b}") for b in range(1, k + 1)])
    return g.withColumns({f"users_bin{b}": F.col(f"share_bin{b}") * F.col("n_users") for b in range(1, k + 1)})


def activity_histogram(onehot: DataFrame, n_buckets: int = 130) -> DataFrame:
    """Equal-width histogram of activity levels, stacked by bin."""
    mm = onehot.agg(F.min("n_present").alias("_lo"), F.max("n_present").alias("_hi"))
    x = onehot.crossJoin(F.broadcast(mm))
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("n_present") - F.col("_lo")) / F.when(width == 0, None).otherwise(width) * n_buckets) + 1,
                F.lit(n_buckets)))
    return x.groupBy(bucket.cast("int").alias("bucket"), "bin").agg(F.count(F.lit(1)).cast("bigint").alias("n_users"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A22."""
    return df.select(col).distinct()


def distinct_users(df: DataFrame, roles: dict[str, Column] | None = None) -> DataFrame:
    """Users over both roles, from one pass over the rows.

    ``roles``: integer columns that ids are made from, each with its id's expression; these are
    grouped in the ids' place, a fraction as wide, and only distinct ones are made ids."""
    if roles is None:
        return df.select(F.explode(F.array("a_user_id", "b_user_id")).alias("user_id")).distinct()
    pairs = [F.struct(F.lit(k).alias("_role"), F.col(c).cast("bigint").alias("_key")) for k, c in enumerate(roles)]
    keys = df.select(F.inline(F.array(*pairs))).distinct()
    # One frame a role: ids made from all keys at once would be grouped alone, without the keys' own grouping before.
    ids = [keys.where(F.col("_role") == k).select(F.col("_key").alias(c)).select(e.alias("user_id")) for k, (c, e) in enumerate(roles.items())]
    return functools.reduce(DataFrame.union, ids).distinct()


def distinct_list_items(df: DataFrame, col: str, sep: str = "\t") -> DataFrame:
    """Distinct elements of a multi-valued column (null/empty skipped)."""
    return (df.select(F.explode(F.split(F.col(col), sep)).alias("value"))
            .filter(F.col("value") != "").distinct())


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """O3: top-k by a column (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def prior_model(train: DataFrame, targets=TARGETS) -> DataFrame:
    """The constant predictor = mean of each label over the training rows."""
    return train.agg(*[F.avg(F.col(f"has_{t}").cast("double")).alias(f"prior_{t}") for t in targets])


def batch_sizes(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """A34."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
