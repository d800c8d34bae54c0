"""Declarative feature registry (F20) with a label-leak guard (F16).

A feature is ``name -> FeatureSpec(inputs, builder, type)``; builders return
built-in ``Column`` expressions, so applying the registry is one
``withColumns`` projection inside whole-stage codegen.  Features may use
earlier ones (registry order).  A feature whose inputs include a label, or a
label-derived feature, is itself label-derived, transitively, and is refused
for unlabelled data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL_COLS, TARGETS
from . import scalar as S


@dataclass(frozen=True)
class FeatureSpec:
    inputs: tuple[str, ...]
    build: Callable[[], Column]
    dtype: str = "double"


class LabelLeakError(ValueError):
    pass


def _spec(inputs, fn, dtype="double"):
    return FeatureSpec(tuple([inputs] if isinstance(inputs, str) else inputs), fn, dtype)


def default_features(thresholds=None) -> dict[str, FeatureSpec]:
    """The per-row features of the final pipeline (12 + quantile bin)."""
    from ..schema import BIN_THRESHOLDS_FINAL
    th = thresholds or BIN_THRESHOLDS_FINAL
    return {
        "bert_token_len": _spec("tokens", lambda: S.token_len_log("tokens"), "double"),
        "photo_count": _spec("medias", lambda: S.media_count_log("medias", "Photo"), "double"),
        "video_count": _spec("medias", lambda: S.media_count_log("medias", "Video"), "double"),
        "gif_count": _spec("medias", lambda: S.media_count_log("medias", "GIF"), "double"),
        "type_encoding": _spec("type", lambda: S.type_encoding("type"), "int"),
        "a_followers": _spec("a_follower_count", lambda: S.save_log("a_follower_count"), "double"),
        "a_following": _spec("a_following_count", lambda: S.save_log("a_following_count"), "double"),
        "b_followers": _spec("b_follower_count", lambda: S.save_log("b_follower_count"), "double"),
        "b_following": _spec("b_following_count", lambda: S.save_log("b_following_count"), "double"),
        "day_of_week": _spec("ts", lambda: S.day_of_week("ts"), "int"),
        "hour_of_day": _spec("ts", lambda: S.hour_of_day("ts"), "int"),
        "bin": _spec("a_follower_count", lambda: S.follower_bin("a_follower_count", th), "int"),
    }


def default_targets() -> dict[str, FeatureSpec]:
    return {f"has_{t}": _spec(c, (lambda c=c: S.has_label(c)), "boolean") for t, c in zip(TARGETS, LABEL_COLS)}


def label_derived(registry: dict[str, FeatureSpec], labels=LABEL_COLS) -> set[str]:
    """F16: names of label-derived features (transitive closure, registry order)."""
    tainted = set(labels)
    for name, spec in registry.items():
        if any(i in tainted for i in spec.inputs):
            tainted.add(name)
    return tainted - set(labels)


def apply_registry(df: DataFrame, registry: dict[str, FeatureSpec], mode: str = "train",
                   skip_existing: bool = False) -> DataFrame:
    """Add every registry feature in order (one projection per dependency level).

    ``mode="test"`` refuses label-derived features; ``skip_existing`` keeps
    columns already present (additive mode, K12)."""
    tainted = label_derived(registry)
    if mode == "test":
        bad = [n for n in registry if n in tainted]
        if bad:
            raise LabelLeakError(f"label-derived features on unlabelled data: {bad}")
    out, pending = df, {}
    for name, spec in registry.items():
        if skip_existing and name in out.columns:
            continue
        missing = [i for i in spec.inputs if i not in out.columns and i not in pending]
        if missing:
            raise KeyError(f"feature {name!r} needs unknown columns {missing}")
        if any(i in pending for i in spec.inputs):   # depends on a feature of this level
            out, pending = out.withColumns(pending), {}
        pending[name] = spec.build().cast(spec.dtype)
    return out.withColumns(pending) if pending else out


def python_feature(inputs, fn, dtype: str = "double") -> FeatureSpec:
    """Registry entry backed by an Arrow-batched pandas function (X1); use only
    when no built-in expression can express the feature."""
    from .udf import series_feature
    cols = tuple([inputs] if isinstance(inputs, str) else inputs)
    udf = series_feature(fn, dtype)
    return FeatureSpec(cols, lambda: udf(*[F.col(c) for c in cols]), dtype)


def add_row_features(df: DataFrame) -> DataFrame:
    """E4 deltas and E5 ratios (the vectorised 'prepro 3' step)."""
    return df.withColumns({**S.creation_deltas(), **S.follow_ratios()})


__all__ = ["FeatureSpec", "LabelLeakError", "apply_registry", "default_features", "default_targets",
           "label_derived", "add_row_features", "python_feature", "F"]
