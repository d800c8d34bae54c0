"""Per-user activity index (counts by role, action and post type).

Plan shape at any scale: scan -> (cut-off filter, pushed to Parquet) ->
narrow explode to one row per (interaction, role) -> partial hash aggregate
by user and profile on the map side -> one shuffle on both -> final aggregate
-> the few profiles of a user are merged on (key, time) and on the key.
A user holding a third of all rows is fine here: the map-side partial
aggregate collapses it to a row per profile and input partition before the shuffle.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import day_of_year, id_key64
from ..schema import (ACTIONS, COMBINED_TYPES, LABEL_COLS, POST_TYPES, PROFILE_FIELDS, ROLES,
                      TARGETS, count_col)
from .clean import before_cutoff


#: What a packed profile can hold: times up to 2074, counts and creation times below 2**31.
PACKED_TIMES, PACKED_COUNTS = 3_300_000_000, 2**31


def pack_profile(verified: str = "verified") -> Column:
    """``(first_seen, *PROFILE_FIELDS)`` as one decimal that orders like the struct (nulls first).

    A minimum over it has a buffer of fixed width, so the aggregate stays a hash aggregate; a
    minimum over a struct sorts all rows first.  Fields out of range fail the job."""
    def part(name: str, limit: int) -> tuple[Column, Column]:
        c = F.col(name)
        return F.coalesce(c + 1, F.lit(0).cast("long")), c.isNull() | ((c >= 0) & (c < limit - 1))

    (seen, a), (followers, b), (following, c), (created, d) = (part("first_seen", PACKED_TIMES), *(part(x, PACKED_COUNTS) for x in ("follower_count", "following_count", "account_creation")))
    flag = F.when(F.col(verified).isNull(), 0).when(F.col(verified), 2).otherwise(1)
    high = (seen * PACKED_COUNTS + followers).cast("decimal(19,0)") * F.lit(Decimal(3 * 2**62))
    low = (following * 3 + flag).cast("decimal(11,0)") * F.lit(Decimal(PACKED_COUNTS)) + created.cast("decimal(10,0)")
    packed = (high + low).cast("decimal(38,0)")
    return F.when(a & b & c & d, packed).otherwise(F.raise_error(F.lit("a profile field is out of range: build the index with profile='struct'")).cast("decimal(38,0)"))


def unpack_profile(packed: str) -> dict[str, Column]:
    """The fields of ``pack_profile``."""
    high = F.expr(f"cast({packed} div cast({3 * 2**62} as decimal(20,0)) as bigint)")
    rest = f"({packed} - cast({packed} div cast({3 * 2**62} as decimal(20,0)) as decimal(19,0)) * cast({3 * 2**62} as decimal(20,0)))"
    middle, created = F.expr(f"{rest} div cast({PACKED_COUNTS} as decimal(10,0))"), F.expr(f"cast({rest} % cast({PACKED_COUNTS} as decimal(10,0)) as bigint)")
    value = lambda c: F.when(c > 0, c - 1)
    flag = F.pmod(middle, F.lit(3))
    return {"first_seen": value(F.shiftright(high, 31)), "follower_count": value(F.pmod(high, F.lit(PACKED_COUNTS))),
            "following_count": value(F.expr(f"({rest} div cast({PACKED_COUNTS} as decimal(10,0))) div 3")),
            "verified": F.when(flag == 2, F.lit(True)).when(flag == 1, F.lit(False)), "account_creation": value(created)}


def _earliest(profile: str) -> Column:
    if profile == "packed":
        return F.min(pack_profile()).alias("_p")
    if profile == "struct":
        return F.min(F.struct("first_seen", *PROFILE_FIELDS)).alias("_p")
    raise ValueError(f"profile must be 'grouped', 'packed' or 'struct', not {profile!r}")


#: Fields of a halved profile lie in -HALF..HALF-1, its codes below HALF_CODES (0: null).
HALF, HALF_CODES = 2**60, 2**61 + 1


def halve_profile() -> dict[str, Column]:
    """``(first_seen, *PROFILE_FIELDS)`` as two decimals ``_a`` (time, followers) and ``_b`` (the rest), which
    order like the struct (nulls first)."""
    def code(name: str) -> Column:
        c = F.col(name)
        found = F.when(c.isNull(), F.lit(0).cast("long")).when((c >= -HALF) & (c < HALF), c + (HALF + 1))
        return found.otherwise(F.raise_error(F.lit("a profile field is out of range: build the index with profile='struct'")).cast("long"))

    def pair(high: Column, low: Column) -> Column:
        return (high.cast("decimal(19,0)") * F.lit(Decimal(HALF_CODES)) + low.cast("decimal(19,0)")).cast("decimal(38,0)")

    flag = F.when(F.col("verified").isNull(), 0).when(F.col("verified"), 2).otherwise(1)
    return {"_a": pair(code("first_seen"), code("follower_count")), "_b": pair(code("following_count") * 3 + flag, code("account_creation"))}


def join_profile() -> dict[str, Column]:
    """The fields of ``halve_profile``."""
    def parts(c: str) -> tuple[Column, Column]:
        return F.expr(f"{c} div cast({HALF_CODES} as decimal(19,0))"), F.expr(f"cast({c} % cast({HALF_CODES} as decimal(19,0)) as bigint)")

    (seen, followers), (middle, created) = parts("_a"), parts("_b")
    value = lambda c: F.when(c > 0, c - (HALF + 1))
    flag = F.pmod(middle, F.lit(3))
    return {"first_seen": value(seen), "follower_count": value(followers), "following_count": value(F.expr(f"(_b div cast({HALF_CODES} as decimal(19,0))) div 3")),
            "verified": F.when(flag == 2, F.lit(True)).when(flag == 1, F.lit(False)), "account_creation": value(created)}


def _per_user(rows: DataFrame, aggs: list[Column], profile: str) -> DataFrame:
    """``aggs`` (sums and counts, named) and the earliest profile per user, as ``_p`` or (``"grouped"``)
    as ``_a, _b``.

    ``"grouped"`` aggregates by user and profile first.  The few profiles of a user are then
    compared by halves of fixed width: the least ``_b`` of each ``_a``, which leaves every ``_a``
    once, then that of the least ``_a``.  All three are hash aggregates, for values of any real size."""
    if profile != "grouped":
        return rows.groupBy("user_id").agg(_earliest(profile), *aggs)
    # A null time orders before all others in the struct; min() alone would skip it.
    seen = F.when(F.count_if(F.col("first_seen").isNull()) == 0, F.min("first_seen")).alias("first_seen")
    per = rows.groupBy("user_id", *PROFILE_FIELDS).agg(seen, *aggs)
    added = [c for c in per.columns if c not in ("user_id", "first_seen", *PROFILE_FIELDS)]
    sums = [F.sum(c).alias(c) for c in added]
    halves = per.select("user_id", *[c.alias(n) for n, c in halve_profile().items()], *added)
    once = halves.groupBy("user_id", "_a").agg(F.min("_b").alias("_b"), *sums)
    return once.groupBy("user_id").agg(F.min_by("_b", "_a").alias("_b"), F.min("_a").alias("_a"), *sums)


def _fields(profile: str, names: list[str]) -> list[Column]:
    found = join_profile() if profile == "grouped" else unpack_profile("_p") if profile == "packed" else {c: F.col(f"_p.{c}") for c in names}
    return [found[c].alias(c) for c in names]


def _role_struct(df_role: str) -> Column:
    """One struct per (interaction, role) carrying everything the counts need."""
    r = df_role
    return F.struct(
        id_key64(F.col(f"{r}_user_id")).alias("user_id"),
        F.lit(r).alias("role"),
        F.col("type").alias("type"),
        F.col(f"{r}_follower_count").alias("follower_count"),
        F.col(f"{r}_following_count").alias("following_count"),
        F.col(f"{r}_is_verified").alias("verified"),
        F.col(f"{r}_account_creation").alias("account_creation"),
        # earliest time at which this row shows the profile (post or engagement)
        F.least(F.col("ts"), *[F.col(c) for c in LABEL_COLS]).alias("first_seen"),
        *[F.col(c).isNotNull().alias(f"has_{t}") for t, c in zip(TARGETS, LABEL_COLS)],
    )


def role_rows(interactions: DataFrame) -> DataFrame:
    """Two rows per interaction: the author view and the exposed-user view."""
    return interactions.select(F.inline(F.array(_role_struct("a"), _role_struct("b"))))


def action_rows(interactions: DataFrame) -> DataFrame:
    """A1: the long unpivot -- 2 presence rows plus one row per engagement and
    role, with ``action_type = n_{action}_{role}_{type}``.  ``day`` (day of
    year, UTC) is set on author-presence rows and consumer-engagement rows.
    One pass: an ``explode`` of a struct array, nulls filtered; no unions.
    """
    structs = []
    for role in ROLES:
        uid = id_key64(F.col(f"{role}_user_id"))
        structs.append(F.struct(
            uid.alias("user_id"), F.lit(role).alias("role"), F.lit("present").alias("action"),
            F.col("type").alias("type"), F.col("ts").alias("event_ts"),
            (day_of_year("ts") if role == "a" else F.lit(None).cast("int")).alias("day")))
        for t, lab in zip(TARGETS, LABEL_COLS):
            s = F.struct(
                uid.alias("user_id"), F.lit(role).alias("role"), F.lit(t).alias("action"),
                F.col("type").alias("type"), F.col(lab).alias("event_ts"),
                (day_of_year(lab) if role == "b" else F.lit(None).cast("int")).alias("day"))
            structs.append(F.when(F.col(lab).isNotNull(), s))
    rows = interactions.select(F.inline(F.filter(F.array(*structs), lambda x: x.isNotNull())))
    return rows.withColumn(
        "action_type", F.concat_ws("_", F.lit("n"), "action", "role", "type"))


def user_action_counts(interactions: DataFrame) -> DataFrame:
    """A2: count per (user, action type), long form."""
    return action_rows(interactions).groupBy("user_id", "action_type").agg(F.count(F.lit(1)).alias("n"))


def _count_exprs(types=POST_TYPES) -> list[Column]:
    out = []
    for t in types:
        for role in ROLES:
            base = (F.col("role") == role) & (F.col("type") == t)
            for action in ACTIONS:
                cond = base if action == "present" else base & F.col(f"has_{action}")
                out.append(F.count_if(cond).cast("bigint").alias(count_col(action, role, t)))
    return out


def combined_counts(types=COMBINED_TYPES) -> dict[str, Column]:
    """``n_{action}_{role}`` summed over ``types`` (Reply excluded by default)."""
    return {count_col(a, r): reduce(add, [F.col(count_col(a, r, t)) for t in types])
            for r in ROLES for a in ACTIONS}


def build_user_index(interactions: DataFrame, cutoff_ts: int | None = None,
                     require_activity: str = "none", with_combined: bool = True,
                     types=POST_TYPES, with_first_seen: bool = False, with_day_counts: bool = False,
                     profile: str = "grouped") -> DataFrame:
    """One row per user with profile and 40 typed counts.

    ``require_activity``: ``"none"`` keeps every user (layout independent);
    ``"global"`` keeps only users that posted or engaged at least once, i.e.
    users with a day count (the inner day-join of the original acts as this
    semi-join).  Profile = values of the earliest row by (time, values);
    ``with_first_seen`` keeps that time so partial indexes merge exactly.
    ``profile``: how that row is found, ``"grouped"`` (by user and profile first; values up to
    ``HALF``), ``"packed"`` (``pack_profile``, one aggregate, smaller values) or ``"struct"`` (any
    values, at the price of a sort of all rows).
    """
    src = before_cutoff(interactions, cutoff_ts) if cutoff_ts is not None else interactions
    rows = role_rows(src)
    active = F.count_if((F.col("role") == "a") | F.col("has_reply") | F.col("has_retweet")
                        | F.col("has_retweet_comment") | F.col("has_like")).alias("_active")
    idx = _per_user(rows, [active, *_count_exprs(types)], profile)
    if require_activity == "global":
        idx = idx.filter(F.col("_active") > 0)
    elif require_activity != "none":
        raise ValueError(f"require_activity must be 'none' or 'global', not {require_activity!r}")
    idx = idx.select("user_id", *_fields(profile, [*(["first_seen"] if with_first_seen else []), *PROFILE_FIELDS]),
                     *[c for c in idx.columns if c.startswith("n_")])
    if with_combined:
        idx = idx.withColumns(combined_counts())
    if with_day_counts:
        # both sides are aggregates keyed by user_id, so the join reuses their
        # hash partitioning; users without day rows get 0 (Q1: no silent drop)
        days = user_day_counts(interactions, cutoff_ts, wide=True)
        idx = idx.join(days, "user_id", "left").na.fill(0, subset=[f"n_day_{d}" for d in range(1, 367)])
    return idx


def user_day_counts(interactions: DataFrame, cutoff_ts: int | None = None, wide: bool = False) -> DataFrame:
    """A4: activity per (user, day of year).  Long form ``(user_id, day, n)``
    by default; ``wide=True`` pivots to ``n_day_{d}`` over the static list
    1..366 (no extra job to discover values)."""
    src = before_cutoff(interactions, cutoff_ts) if cutoff_ts is not None else interactions
    rows = action_rows(src).filter(F.col("day").isNotNull())
    long = rows.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    if not wide:
        return long
    return (long.groupBy("user_id").pivot("day", list(range(1, 367))).agg(F.first("n"))
            .na.fill(0)
            .toDF("user_id", *[f"n_day_{d}" for d in range(1, 367)]))


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """Merge partial indexes.  Counts are summed for users present in
    several parts (missing count columns count as 0).  The profile is the
    one with the earliest ``first_seen`` when the parts carry it (exact for
    any file layout), else the one from the earliest part.  One shuffle on
    ``user_id``.
    """
    parts = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(indexes)]
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return merge_partials(union, "_part")


def merge_partials(union: DataFrame, part_col: str, profile: str = "grouped") -> DataFrame:
    """A6 over a long table of partial indexes tagged by ``part_col``."""
    counts = [c for c in union.columns if c.startswith("n_")]
    prof = [c for c in PROFILE_FIELDS if c in union.columns]
    has_seen = "first_seen" in union.columns
    aggs = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in counts]
    if prof == PROFILE_FIELDS and has_seen:
        out = _per_user(union, aggs, profile)
    else:
        profile = "struct"
        if prof and has_seen:
            aggs.insert(0, F.min(F.struct("first_seen", *prof)).alias("_p"))
        elif prof:
            aggs.insert(0, F.min_by(F.struct(*prof), F.col(part_col)).alias("_p"))
        out = union.groupBy("user_id").agg(*aggs)
    if prof:
        keep = (["first_seen"] if has_seen else []) + prof
        out = out.select("user_id", *_fields(profile if has_seen else "struct", keep), *counts)
    return out


def index_key_diff(left: DataFrame, right: DataFrame, how: str = "left_only") -> DataFrame:
    """Users only on the left, only on the right, or on both."""
    lk, rk = left.select("user_id"), right.select("user_id")
    if how == "left_only":
        return left.join(rk, "user_id", "left_anti")
    if how == "right_only":
        return right.join(lk, "user_id", "left_anti")
    if how == "both":
        return left.join(rk, "user_id", "left_semi")
    raise ValueError(how)


def drop_day_counts(index: DataFrame) -> DataFrame:
    """``remove_day_counts``: drop every ``n_day_*`` column."""
    return index.select([c for c in index.columns if "n_day_" not in c])


def unsigned_key_mod(key, m: int) -> Column:
    """(unsigned 64-bit user key) mod m, computed on the signed long form."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(k, F.lit(m)) + F.when(k < 0, F.lit(2**64 % m)).otherwise(F.lit(0)), F.lit(m))


def sample_users(index: DataFrame, fraction: float, seed: int = 0, deterministic: bool = True) -> DataFrame:
    """Keep a fraction of users; the rest become unknown (sentinel).

    Default is the deterministic ``uid64 mod 10000 < 10000*fraction`` (same
    sample when a lost executor recomputes a partition); ``deterministic=False``
    is Bernoulli sampling with ``seed``."""
    if fraction >= 1:
        return index
    if deterministic:
        return index.filter(unsigned_key_mod("user_id", 10000) < int(round(fraction * 10000)))
    return index.sample(fraction=fraction, seed=seed)
