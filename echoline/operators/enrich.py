"""Enrichment of interactions with both users' history.

Each interaction gets the index columns of its author (suffix ``_A``) and of
its exposed user (suffix ``_B``) through two left equi-joins on the 64-bit
user key.  The index side has one row per user, so:

* the index is shuffled once and its exchange is reused by both joins;
* what is moved is narrow: the index side carries its counts, packed to bytes, and the
  encodings are computed where both joins have ended; ids go as two longs;
* a hot key (an author holding a third of all rows) only skews the
  interaction side: AQE's skew-join splits that partition at run time, or
  ``skew="split"`` takes the rows of the few hot keys from a broadcast whose
  size is bounded by construction (at most ``1 / hot_share`` keys).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import id_key64
from ..schema import SENTINEL
from ..session import stored
from .clean import sentinel_fill
from .encoding import encoding_columns, priors, slot_counts, user_target_encodings


def hot_keys(df: DataFrame, key: str, hot_share: float = 0.01) -> DataFrame:
    """Keys holding at least ``hot_share`` of the rows: at most 1/hot_share of
    them exist, so the result has a proven size bound."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .filter(F.col("_n") >= F.col("_total") * F.lit(hot_share)).select(key))


def hot_key_sets(df: DataFrame, keys: list[str], hot_share: float = 0.01, materialize: str = "none") -> list[DataFrame]:
    """``hot_keys`` of several columns, found in one pass over ``df`` (and, with ``"checkpoint"``, once for all uses)."""
    narrow = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_of"), F.col(k).alias("_key")) for i, k in enumerate(keys)])))
    counts = narrow.groupBy("_of", "_key").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy("_of").agg(F.sum("_n").alias("_total"))
    hot = counts.join(F.broadcast(total), "_of").filter(F.col("_n") >= F.col("_total") * F.lit(hot_share)).select("_of", "_key")
    if materialize == "checkpoint":
        hot = stored(hot, "hot-keys")[0]
    return [hot.filter(F.col("_of") == i).select(F.col("_key").alias(k)) for i, k in enumerate(keys)]


def skew_split_left_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Exact left join on ``key`` that takes the rows of ``hot`` keys from a bounded
    broadcast and all others from the shuffled join, in one pass over ``big``.

    ``small`` is unique on ``key`` and ``hot`` has at most ``1 / hot_share`` rows.  For the
    shuffled join a hot key is replaced by null (which matches nothing) and a salt of the
    row's own columns, so hot rows, and rows without a key, spread over all tasks."""
    values = [c for c in small.columns if c != key]
    hot_small = small.join(F.broadcast(hot), key, "left_semi").select(F.col(key).alias("_hk"), F.struct(*values).alias("_hot"))
    flagged = big.join(F.broadcast(hot.select(F.col(key).alias("_flag"))), F.col(key) == F.col("_flag"), "left")
    salt = F.when(F.col("_flag").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*big.columns), F.lit(1 << 16)).cast("int"))
    flagged = flagged.withColumns({"_cold": F.when(F.col("_flag").isNull(), F.col(key)), "_salt": salt})
    # Zero, but no literal: against one the optimizer makes a filter of the salt's equation, and the
    # rows without a cold key would be dealt out by null alone, to one task.
    zero = F.pmod(F.hash(key), F.lit(1)).alias("_zero")
    cold = small.select(F.col(key).alias("_ck"), zero, F.struct(*values).alias("_val"))
    out = flagged.join(cold, (F.col("_cold") == F.col("_ck")) & (F.col("_salt") == F.col("_zero")), "left")
    out = out.join(F.broadcast(hot_small), F.col("_flag") == F.col("_hk"), "left")
    both = F.coalesce("_hot", "_val")
    return out.select(*big.columns, *[both[c].alias(c) for c in values])


def suffixed(index: DataFrame, side: str, key: str) -> DataFrame:
    """Index columns renamed ``col_{side}``; key renamed to ``key``."""
    return index.select(F.col("user_id").alias(key),
                        *[F.col(c).alias(f"{c}_{side}") for c in index.columns if c != "user_id"])


#: Columns that may hold an id of 32 hex digits.
ID_COLS = ["tweet_id", "a_user_id", "b_user_id"]
#: Counts below this go as two bytes.
NARROW = 1 << 16


def _digits(start: int, c: str) -> Column:
    """Sixteen hex digits of an id as a long."""
    return F.conv(F.substring(c, start, 16), 16, -10).cast("bigint")


def pack_ids(df: DataFrame, keys: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with its ids of 32 hex digits (upper case) as two longs, and its columns as they were, to be
    selected after the joins.  ``keys``: id -> column that holds its last sixteen digits already.  Other ids
    stay as they are, in a column that is null for packed ones."""
    ids = [c for c in ID_COLS if c in df.columns and df.schema[c].dataType == T.StringType()]
    moved, back = {}, {}
    for c in ids:
        whole = F.coalesce(F.col(c).rlike(r"\A[0-9A-F]{32}\z"), F.lit(False))
        moved[f"_{c}_high"] = F.when(whole, _digits(1, c))
        if c not in keys:
            moved[f"_{c}_low"] = F.when(whole, _digits(17, c))
        moved[f"_{c}_text"] = F.when(~whole, F.col(c))
        halves = [F.lpad(F.hex(x), 16, "0") for x in (f"_{c}_high", keys.get(c, f"_{c}_low"))]
        back[c] = F.when(F.col(f"_{c}_high").isNotNull(), F.concat(*halves)).otherwise(F.col(f"_{c}_text")).alias(c)
    return df.withColumns(moved).drop(*ids), [back.get(c, F.col(c)) for c in df.columns if c not in keys.values()]


def pack_counts(index: DataFrame, counts: list[str]) -> DataFrame:
    """``user_id`` and its counts, eight to a long: ``_p0`` .. have their low bytes, then their second bytes, which
    are mostly zeros and vanish in a compressed shuffle.  ``_wide`` has the counts themselves where one is null or
    doesn't fit, else null.  Counts that are no integers stay beside them."""
    whole = [c for c in counts if isinstance(index.schema[c].dataType, T.IntegralType)]
    longs = [F.col(c).cast("bigint") for c in whole]
    packed = [reduce(Column.bitwiseOR, [F.shiftleft(F.shiftright(x, shift).bitwiseAND(F.lit(255)), 8 * i) for i, x in enumerate(longs[at:at + 8])])
              for shift in (0, 8) for at in range(0, len(longs), 8)]
    out = [p.alias(f"_p{i}") for i, p in enumerate(packed)]
    if whole:
        fits = reduce(Column.__and__, [F.coalesce((x >= 0) & (x < NARROW), F.lit(False)) for x in longs])
        out.append(F.when(~fits, F.array(*longs)).alias("_wide"))
    return index.select("user_id", *out, *[c for c in counts if c not in whole])


def unpack_counts(index: DataFrame, counts: list[str], side: str) -> list[Column]:
    """The counts of ``pack_counts`` as ``{count}_{side}``, from its columns with the same ending; null for unknown users."""
    whole = [c for c in counts if isinstance(index.schema[c].dataType, T.IntegralType)]
    n, out = -(-len(whole) // 8), {}
    for k, c in enumerate(whole):
        low, high = (F.shiftright(F.col(f"_p{at + k // 8}_{side}"), 8 * (k % 8)).bitwiseAND(F.lit(255)) for at in (0, n))
        wide = F.col(f"_wide_{side}")
        out[c] = F.when(wide.isNotNull(), wide[k]).otherwise(low + F.shiftleft(high, 8)).cast(index.schema[c].dataType).alias(f"{c}_{side}")
    return [out.get(c, F.col(f"{c}_{side}")) for c in counts]


def join_index(df: DataFrame, index: DataFrame | None, skew: str = "aqe", hot_share: float = 0.01, materialize: str = "none") -> DataFrame:
    """J1 + J2 (+ J3: returns ``df`` untouched when there is no index): joins
    with AQE skew handling (and AQE's broadcast from measured bytes), or the
    explicit hot-key split."""
    if index is None:
        return df
    out = df.withColumns({"_a_key": id_key64(F.col("a_user_id")), "_b_key": id_key64(F.col("b_user_id"))})
    ia, ib = suffixed(index, "A", "_a_key"), suffixed(index, "B", "_b_key")
    hot = hot_key_sets(out, ["_a_key", "_b_key"], hot_share, materialize) if skew == "split" else []
    out, columns = pack_ids(out, {"a_user_id": "_a_key", "b_user_id": "_b_key"})
    if skew == "split":
        # Both hot sets come from the narrow key columns, before any join.
        out = skew_split_left_join(out, ia, "_a_key", hot[0])
        out = skew_split_left_join(out, ib, "_b_key", hot[1])
    else:
        out = out.join(ia, "_a_key", "left").join(ib, "_b_key", "left")
    return out.select(*columns, *[c for side in (ia, ib) for c in side.columns[1:]])


def enrich(interactions: DataFrame, index: DataFrame | None, smoothing=20, undefined: str = "zero",
           keep_counts: bool = True, sentinel: float = SENTINEL, skew: str = "aqe",
           noise_std: float = 0.0, noise_seed: int = 0, materialize: str = "none", noise_key: list[str] | None = None) -> DataFrame:
    """Interactions + ``n_*`` counts and 64 ``TE_*`` columns of both users.

    Users missing from the index get ``sentinel`` in every joined column.
    ``noise_std > 0`` adds Gaussian noise to every TE column after the fill
    (R3; also on sentinel values, as the original does), reproducible by row with ``noise_key``.
    ``materialize``: the index feeds the priors and the per-user encodings.
    ``"none"`` (default) leaves that to Spark's exchange reuse; ``"checkpoint"``
    writes the index (and the hot keys of the split join) to the shared checkpoint
    folder first, for an index that is dear to build: the shuffle files that made it
    are gone before rows are joined.  Nothing is persisted in executor storage.
    """
    if index is None:
        return interactions
    if materialize == "checkpoint":
        index = stored(index, "index")[0]
    counts = [c for c in index.columns if c.startswith("n_")]
    moved = counts if keep_counts else [c for c in counts if c in slot_counts()]
    pr = priors(index, undefined)
    out = join_index(interactions, pack_counts(index, moved), skew=skew, materialize=materialize).crossJoin(F.broadcast(pr))  # one row
    # The encodings of both users are computed from their counts here, not moved.
    out = out.select(*interactions.columns, *pr.columns, *[c for side in "AB" for c in unpack_counts(index, moved, side)])
    kept = {side: [f"{c}_{side}" for c in counts] if keep_counts else [] for side in "AB"}
    out = out.select(*interactions.columns, *[c for side in "AB" for c in (*kept[side], *encoding_columns(smoothing, side=f"_{side}"))])
    added = [c for c in out.columns if c.endswith(("_A", "_B"))]
    te, rest = [c for c in added if c.startswith("TE_")], [c for c in added if c.startswith("n_")]
    out = sentinel_fill(out, sentinel, subset=rest) if rest else out
    # Twice in its expression: Spark leaves an encoding's projection by itself then, and doesn't put its
    # formula into what reads it (noise, rounding), which is evaluated without generated code.
    out = out.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(float(sentinel))).otherwise(F.col(c)) for c in te})
    if noise_std > 0:
        from .regularize import gaussian_noise
        out = gaussian_noise(out, [c for c in out.columns if c.startswith("TE_")], noise_std, noise_seed, noise_key)
    return out


def write_encodings(index: DataFrame, table: str, path: str, buckets: int | None = None, smoothing=20,
                    undefined: str = "zero", keep_counts: bool = True) -> None:
    """J1/J2, index side: counts and encodings of every index user as a table bucketed and sorted by
    ``user_id``, computed and moved once.  ``buckets``: as many as shuffle partitions if left out, so
    that a join shuffles the interactions into the table's own buckets."""
    counts = [c for c in index.columns if c.startswith("n_")]
    te = user_target_encodings(index, priors(index, undefined), smoothing, keep=counts if keep_counts else [])
    n = buckets or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out by the bucket key first: one file a bucket, not one a task and bucket.
    te.repartition(n, "user_id").write.option("path", path).bucketBy(n, "user_id").sortBy("user_id").saveAsTable(table)


def enrich_from_table(interactions: DataFrame, table: str, sentinel: float = SENTINEL) -> DataFrame:
    """J1 + J2 against a table of ``write_encodings``: both joins read its buckets where they are, no
    exchange moves the index.  Users that the table lacks get ``sentinel``."""
    te = interactions.sparkSession.table(table)
    out = join_index(interactions, te)
    return sentinel_fill(out, sentinel, subset=[c for c in out.columns if c.endswith(("_A", "_B")) and c.startswith(("TE_", "n_"))])
