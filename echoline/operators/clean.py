"""Cleaning, null handling and null-aware temporal splits.

All functions are ``DataFrame -> DataFrame`` projections or filters; the
split predicates are plain comparisons so Catalyst pushes them into the
Parquet scan as ``Or(LessThan, IsNull)``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import HAS_COLS, LABEL_COLS, SENTINEL, TARGETS

LIST_COLS = ["medias", "hashtags", "links", "domains"]


def _split_predicate(cut: int, side: str, labels=LABEL_COLS) -> Column:
    if side == "train":
        conds = [F.col("ts") < cut] + [(F.col(c) < cut) | F.col(c).isNull() for c in labels]
    else:
        conds = [F.col("ts") >= cut] + [(F.col(c) >= cut) | F.col(c).isNull() for c in labels]
    return reduce(and_, conds)


def before_cutoff(df: DataFrame, cutoff_ts: int | None) -> DataFrame:
    """Post and every engagement strictly before ``cutoff_ts``; None = all."""
    if cutoff_ts is None:
        return df
    return df.filter(_split_predicate(cutoff_ts, "train"))


def train_split(df: DataFrame, split_ts: int | None) -> DataFrame:
    """F6."""
    return before_cutoff(df, split_ts)


def val_split(df: DataFrame, split_ts: int | None) -> DataFrame:
    """post and every engagement at or after ``split_ts``."""
    if split_ts is None:
        return df
    return df.filter(_split_predicate(split_ts, "val"))


def split_leftovers(df: DataFrame, split_ts: int) -> DataFrame:
    """Rows in neither split (they straddle the border)."""
    return df.filter(~_split_predicate(split_ts, "train") & ~_split_predicate(split_ts, "val"))


def fill_list_cols(df: DataFrame, cols=LIST_COLS) -> DataFrame:
    """null multi-value cells -> ''."""
    return df.na.fill("", subset=[c for c in cols if c in df.columns])


def fill_labels(df: DataFrame, labels=LABEL_COLS) -> DataFrame:
    """null engagement times -> 0."""
    return df.na.fill(0, subset=[c for c in labels if c in df.columns])


def add_has_labels(df: DataFrame) -> DataFrame:
    """E17 for all four targets (``label > 0`` after F4)."""
    return df.withColumns({h: F.coalesce(F.col(c), F.lit(0)) > 0 for h, c in zip(HAS_COLS, LABEL_COLS)})


def sentinel_fill(df: DataFrame, value: float = SENTINEL, subset: list[str] | None = None) -> DataFrame:
    """every remaining null or NaN numeric value -> ``value``."""
    cols = subset or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    exprs = {}
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            exprs[c] = F.coalesce(F.nanvl(F.col(c), F.lit(None).cast(dt)), F.lit(float(value)).cast(dt))
        else:
            exprs[c] = F.coalesce(F.col(c), F.lit(value).cast(dt))
    return df.withColumns(exprs) if exprs else df


def drop_prefixed(df: DataFrame, prefix: str = "n_") -> DataFrame:
    """F10 (``remove_user_counts``)."""
    return df.select([c for c in df.columns if not c.startswith(prefix)])


def drop_containing(df: DataFrame, part: str) -> DataFrame:
    """F10 (``remove_day_counts``)."""
    return df.select([c for c in df.columns if part not in c])


def drop_features(df: DataFrame, names: list[str]) -> DataFrame:
    """F9/F11."""
    return df.drop(*names)


def drop_null_label(df: DataFrame, label: str) -> DataFrame:
    """F12."""
    return df.na.drop(subset=[label])


def null_audit(df: DataFrame) -> DataFrame:
    """one row, the number of nulls per column (one aggregate pass)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in df.columns])


def widen_unsigned(df: DataFrame, cols: list[str], bits: int = 32) -> DataFrame:
    """unsigned integer columns stored as the next wider signed type."""
    target = "bigint" if bits <= 32 else "decimal(20,0)"
    return df.withColumns({c: F.col(c).cast(target) for c in cols})


def split_features_labels(df: DataFrame, mode: str = "train") -> dict[str, DataFrame]:
    """The feature, label, id and bin column groups of a table."""
    ids = [c for c in ("tweet_id", "b_user_id") if c in df.columns]
    labels = [c for c in HAS_COLS if c in df.columns]
    bin_col = [c for c in ("bin",) if c in df.columns]
    skip = set(ids) | set(labels) | set(bin_col) | set(LABEL_COLS)
    feats = [c for c in df.columns if c not in skip]
    out = {"features": df.select(feats), "ids": df.select(ids), "bin": df.select(bin_col)}
    if mode != "test":
        out["labels"] = df.select(labels)
    return out


__all__ = [n for n in dir() if not n.startswith("_")] + ["TARGETS"]
