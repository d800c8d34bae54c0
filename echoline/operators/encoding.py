"""Smoothed target encodings.

Index flavour: priors are one global aggregate (a single row, so a broadcast
cross join of it is bounded by construction); the 32 encodings come from a
user's counts, by index user (``user_target_encodings``) or behind the two key
joins that bring the counts to interactions (``enrich``), which move far less.

Group flavour: ``groupBy(category)`` statistics with a partial aggregate,
joined back on the category.  The statistics table has one row per distinct
category; it is broadcast only when AQE measures it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMBINED_TYPES, DEFAULT_SMOOTHING, ROLES, TARGETS, count_col


def te_slots(types=COMBINED_TYPES) -> list[tuple[str, str, str | None]]:
    """(target, role, type-or-None) for every encoding: 4 x 2 x (3 + 1) = 32."""
    out = []
    for t in TARGETS:
        for r in ROLES:
            for ty in [*types, None]:
                out.append((t, r, ty))
    return out


def _slot_name(t: str, r: str, ty: str | None) -> str:
    return f"{t}_{r}" + (f"_{ty}" if ty else "")


def _rate(t: str, r: str, ty: str | None, side: str = "") -> Column:
    return F.try_divide(F.col(count_col(t, r, ty) + side), F.col(count_col("present", r, ty) + side))


def slot_counts(types=COMBINED_TYPES) -> list[str]:
    """The count columns that the encodings come from."""
    return list(dict.fromkeys(count_col(a, r, ty) for t, r, ty in te_slots(types) for a in ("present", t)))


def priors(index: DataFrame, undefined: str = "zero", types=COMBINED_TYPES) -> DataFrame:
    """One row of 32 priors ``prior_{target}_{role}[_{type}]`` = mean over
    index users of n_target/n_present; users with n_present = 0 count as 0
    (``undefined="zero"``) or are skipped (``"skip"``)."""
    aggs = []
    for t, r, ty in te_slots(types):
        rate = _rate(t, r, ty)
        if undefined == "zero":
            rate = F.coalesce(rate, F.lit(0.0))
        elif undefined != "skip":
            raise ValueError(undefined)
        aggs.append(F.avg(rate).alias(f"prior_{_slot_name(t, r, ty)}"))
    return index.agg(*aggs)


def user_target_encodings(index: DataFrame, prior_row: DataFrame | None = None,
                          smoothing: dict[str, float] | float = DEFAULT_SMOOTHING,
                          undefined: str = "zero", keep: list[str] | None = None,
                          types=COMBINED_TYPES) -> DataFrame:
    """``TE = (n * r + s * prior) / (s + n)`` per index user and slot, with
    n = n_present, r = n_target / n_present (0 when undefined), s per target.

    Output: ``user_id``, the columns in ``keep`` and 32 ``TE_{slot}`` columns.
    """
    pr = prior_row if prior_row is not None else priors(index, undefined, types)
    joined = index.crossJoin(F.broadcast(pr))  # one-row side: bounded
    return joined.select("user_id", *(keep or []), *encoding_columns(smoothing, types))


def encoding_columns(smoothing: dict[str, float] | float = DEFAULT_SMOOTHING, types=COMBINED_TYPES, side: str = "") -> list[Column]:
    """``TE_{slot}{side}`` from count columns that end in ``side`` and the columns of ``priors``."""
    if not isinstance(smoothing, dict):
        smoothing = {t: smoothing for t in TARGETS}
    cols = []
    for t, r, ty in te_slots(types):
        n = F.col(count_col("present", r, ty) + side).cast("double")
        rate = F.coalesce(_rate(t, r, ty, side), F.lit(0.0))
        s = F.lit(float(smoothing[t]))
        prior = F.col(f"prior_{_slot_name(t, r, ty)}")
        cols.append(F.try_divide(n * rate + s * prior, s + n).alias(f"TE_{_slot_name(t, r, ty)}{side}"))
    return cols


# ---------------------------------------------------------------- group flavour

def group_stats(df: DataFrame, category: str | list[str], target: str) -> DataFrame:
    """A10 statistics: per category ``count``, ``mean`` of the target and the
    global ``total_mean`` (one-row aggregate of the categories' sums, cross-joined by
    broadcast): ``df`` is read once."""
    cats = [category] if isinstance(category, str) else list(category)
    y = F.col(target).cast("double")
    sums = df.groupBy(*cats).agg(F.count(F.lit(1)).cast("bigint").alias("count"), F.sum(y).alias("_s"), F.count(y).alias("_n"))
    total = sums.agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("total_mean"))  # A12
    stats = sums.select(*cats, "count", F.try_divide("_s", "_n").alias("mean"))
    return stats.crossJoin(F.broadcast(total))


def apply_group_encoding(df: DataFrame, stats: DataFrame, category: str | list[str],
                         name: str, weight: float = DEFAULT_SMOOTHING, fill: float = -1.0) -> DataFrame:
    """A10/A11 apply: ``(count * mean + w * total_mean) / (count + w)`` joined on
    the category (J8); unseen categories get ``fill`` in the new column only.

    The statistics have one row per category.  Those of hot categories (0.1 % of the counted
    rows, so 1000 at most) reach their rows by a bounded broadcast, the others by a shuffled
    join: no task gets all rows of a hot category."""
    cats = [category] if isinstance(category, str) else list(category)
    enc = stats.select(*cats, ((F.col("count") * F.col("mean") + F.lit(float(weight)) * F.col("total_mean"))
                               / (F.col("count") + F.lit(float(weight)))).alias(name))
    return _by_key(df, enc, stats, "count", cats).withColumn(name, F.coalesce(F.col(name), F.lit(fill)))


def _by_key(df: DataFrame, values: DataFrame, counted: DataFrame, count: str, keys: list[str], hot_share: float = 0.001) -> DataFrame:
    """Left join of ``values`` on ``keys`` (a null in one matches nothing).  Rows of keys with at least
    ``hot_share`` of all that ``counted`` counts meet them in a bounded broadcast and are not moved;
    the others, and rows without a key, go through the split join."""
    from .enrich import skew_split_left_join
    whole = F.lit(True)
    for c in keys:
        whole = whole & F.col(c).isNotNull()
    key = F.when(whole, F.struct(*keys)).alias("_key")
    added = [c for c in values.columns if c not in keys]
    total = counted.agg(F.sum(count).alias("_total"))
    hot = counted.crossJoin(F.broadcast(total)).where(F.col(count) >= F.col("_total") * F.lit(hot_share)).select(key).where("_key IS NOT NULL")
    keyed = values.select(key, *added).where("_key IS NOT NULL")
    near_values = keyed.join(F.broadcast(hot), "_key", "left_semi").select(F.col("_key").alias("_near"), F.struct(*added).alias("_values"))
    marked = df.select("*", key).join(F.broadcast(near_values), F.col("_key") == F.col("_near"), "left")
    near = marked.where("_near IS NOT NULL").select(*df.columns, *[F.col("_values")[c].alias(c) for c in added])
    far = skew_split_left_join(marked.where("_near IS NULL").select(*df.columns, "_key"), keyed, "_key", hot).drop("_key")
    return near.unionByName(far).select(*keys, *[c for c in df.columns if c not in keys], *added)


def group_target_encoding(df: DataFrame, category: str | list[str], target: str, name: str | None = None,
                          weight: float = DEFAULT_SMOOTHING, fill: float = -1.0) -> DataFrame:
    """A10: fit on ``df`` and apply to ``df`` (as the original does)."""
    name = name or f"TE_{category if isinstance(category, str) else '_'.join(category)}_{target}"
    return apply_group_encoding(df, group_stats(df, category, target), category, name, weight, fill)


def conditional_probability(df: DataFrame, labels: list[str], features: list[str]) -> DataFrame:
    """P(features | labels) = joint count / marginal count."""
    marg = df.groupBy(*labels).agg(F.count(F.lit(1)).alias("marginal"))
    joint = df.groupBy(*labels, *features).agg(F.count(F.lit(1)).alias("joint"))
    return (joint.join(marg, labels, "left")
            .select(*labels, *features, F.col("joint").cast("bigint").alias("joint"),
                    F.col("marginal").cast("bigint").alias("marginal"),
                    (F.col("joint") / F.col("marginal")).alias("probability")))


def out_of_fold_encoding(df: DataFrame, category: str | list[str], target: str, key: list[str], name: str,
                         k: int = 5, weight: float = DEFAULT_SMOOTHING, fill: float = -1.0) -> DataFrame:
    """Group TE without target leakage (our option for the original's
    fit-on-self behaviour): rows are split into ``k`` deterministic folds by
    an md5 hash of ``key``; each row is encoded with statistics of the other
    folds only.  Per (category, fold) partial sums are aggregated once and
    subtracted from the category totals, so there is no per-fold re-scan."""
    from .regularize import unit_hash
    cats = [category] if isinstance(category, str) else list(category)
    y = F.col(target).cast("double")
    rows = df.withColumn("_fold", F.floor(unit_hash(*key, salt="fold") * k).cast("int"))
    per = rows.groupBy(*cats, "_fold").agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"))
    tot = per.groupBy(*cats).agg(F.sum("_n").alias("_cat_n"), F.sum("_s").alias("_cat_s"))
    fold_tot = per.groupBy("_fold").agg(F.sum("_n").alias("_fn"), F.sum("_s").alias("_fs"))
    all_tot = fold_tot.agg(F.sum("_fn").alias("_an"), F.sum("_fs").alias("_as"))
    prior = fold_tot.crossJoin(F.broadcast(all_tot)).select(
        "_fold", F.try_divide(F.col("_as") - F.col("_fs"), F.col("_an") - F.col("_fn")).alias("_pm"))
    w = F.lit(float(weight))
    enc = (per.join(tot, cats).join(F.broadcast(prior), "_fold")
           .select(*cats, "_fold", F.try_divide((F.col("_cat_s") - F.col("_s")) + w * F.col("_pm"),
                                                (F.col("_cat_n") - F.col("_n")) + w).alias(name)))
    out = _by_key(rows, enc, per, "_n", [*cats, "_fold"])
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(fill))).drop("_fold")
