"""Regularising transforms: masking, noise, scaling, splits, random scores.

Each has a seeded ``rand``/``randn`` form for real use and, where tests need
an oracle, a deterministic hash form: ``unit_hash`` maps row content to
[0, 1) with md5, so a recomputed partition (lost executor) gives the same
answer regardless of partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(*cols: str, salt: str = "") -> Column:
    """Deterministic uniform in [0, 1) from row content (md5, first 8 hex digits)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    h = F.md5(F.concat_ws("|", F.lit(salt), *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mask_columns(df: DataFrame, groups: dict[str, list[str]], share: float = 0.75, seed: int = 0,
                 key: list[str] | None = None, value: float = -1) -> DataFrame:
    """R2: per column group, set all its columns to ``value`` on a random
    ``share`` of rows (one draw per group and row).  With ``key`` the draw is
    the deterministic ``unit_hash(key, salt=group)``."""
    out = df
    for i, (name, cols) in enumerate(groups.items()):
        u = unit_hash(*key, salt=name) if key else F.rand(seed + i)
        out = out.withColumn(f"_m_{name}", u < share)
        out = out.withColumns({c: F.when(F.col(f"_m_{name}"), F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(c))
                               for c in cols})
        out = out.drop(f"_m_{name}")
    return out


def counter_uniforms(key: list[str], block: int, seed: int = 0) -> list[Column]:
    """Four uniforms in (0, 1) of a row: a counter-based generator whose counter is (seed, block, row
    key).  The same row gives the same numbers wherever and whenever it is computed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    h = F.md5(F.concat_ws("|", F.lit(f"u{seed}.{block}"), *parts))
    return [(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0) for i in range(4)]


def counter_normals(key: list[str], block: int, seed: int = 0) -> list[Column]:
    """Four standard normals of a row (Box-Muller on two pairs of ``counter_uniforms``)."""
    u = counter_uniforms(key, block, seed)
    out = []
    for a, b in ((u[0], u[1]), (u[2], u[3])):
        radius, angle = F.sqrt(F.lit(-2.0) * F.log(a)), F.lit(2 * math.pi) * b
        out += [radius * F.cos(angle), radius * F.sin(angle)]
    return out


def counter_normal_array(key: list[str], n: int, seed: int = 0) -> Column:
    """The normals of ``counter_normals`` for the first ``n`` columns (rounded up to whole blocks), as one array.

    A hash is taken once a block, its halves are read once each, and a pair's radius and angle serve
    both its normals.  An array also keeps many columns out of one generated method, which the JVM
    interprets where it is too large to compile."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    blocks = F.array(*[F.lit(f"u{seed}.{b}") for b in range(-(-n // 4))])
    half = lambda h, at: F.conv(F.substring(h, at, 16), 16, -10).cast("bigint")
    uniform = lambda w: (w.cast("double") + 0.5) / F.lit(4294967296.0)
    hashes = F.transform(blocks, lambda u: F.md5(F.concat_ws("|", u, *parts)))
    halves = F.flatten(F.transform(hashes, lambda h: F.array(half(h, 1), half(h, 17))))
    polar = F.transform(halves, lambda w: F.struct(
        F.sqrt(F.lit(-2.0) * F.log(uniform(F.shiftrightunsigned(w, 32)))).alias("r"),
        (F.lit(2 * math.pi) * uniform(w.bitwiseAND(F.lit(0xFFFFFFFF)))).alias("a")))
    return F.flatten(F.transform(polar, lambda p: F.array(p["r"] * F.cos(p["a"]), p["r"] * F.sin(p["a"]))))


def gaussian_noise(df: DataFrame, cols: list[str], std: float, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """``col + N(0, std)`` independently per column (std=0 is the identity).

    With ``key`` (columns that tell rows apart) the noise is that of ``counter_normals``, one
    hash for four columns; without, from ``randn`` by partition and position."""
    if std == 0:
        return df
    if key is None:
        return df.withColumns({c: F.col(c) + F.randn(seed + i) * F.lit(std) for i, c in enumerate(cols)})
    noisy = F.zip_with(F.array(*cols), F.slice(counter_normal_array(key, len(cols), seed), 1, len(cols)), lambda x, z: x + z * F.lit(std))
    return df.withColumn("_noisy", noisy).withColumns({c: F.col("_noisy")[i] for i, c in enumerate(cols)}).drop("_noisy")


def fit_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """R4 fit: one row with ``min_c``/``max_c`` per column (fit on train once)."""
    return df.agg(*[F.min(c).cast("double").alias(f"min_{c}") for c in cols],
                  *[F.max(c).cast("double").alias(f"max_{c}") for c in cols])


def apply_minmax(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """R4 apply: (x - min) / (max - min); a constant column maps to 0."""
    x = df.crossJoin(F.broadcast(stats))  # one-row side
    scaled = {}
    for c in cols:
        lo, hi = F.col(f"min_{c}"), F.col(f"max_{c}")
        scaled[c] = F.coalesce(F.try_divide(F.col(c).cast("double") - lo, hi - lo), F.lit(0.0))
    return x.withColumns(scaled).drop(*[f"min_{c}" for c in cols], *[f"max_{c}" for c in cols])


def hash_split(df: DataFrame, key: list[str], train_share: float = 0.85, salt: str = "split") -> DataFrame:
    """R5 (deterministic form): ``split`` = 'train' | 'test'."""
    return df.withColumn("split", F.when(unit_hash(*key, salt=salt) < train_share, "train").otherwise("test"))


def random_split(df: DataFrame, weights=(0.85, 0.15), seed: int = 0) -> list[DataFrame]:
    """R5 (random form)."""
    return df.randomSplit(list(weights), seed)


def random_scores(df: DataFrame, targets: list[str], seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """Uniform random score per target; with ``key`` reproducible by row (``counter_uniforms``)."""
    if key is not None:
        draws = {t: counter_uniforms(key, i // 4, seed)[i % 4] for i, t in enumerate(targets)}
        return df.withColumns({f"score_{t}": u for t, u in draws.items()})
    return df.withColumns({f"score_{t}": F.rand(seed + i) for i, t in enumerate(targets)})


def replicate_by_weight(df: DataFrame, weight: str, key: list[str], scale: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows repeated so that their expected number is ``weight * scale``, in one pass.

    A row of weight w stands ``floor(w)`` times and once more with probability ``w - floor(w)``,
    drawn from the row's key: a learner without row weights then minimises the weighted loss
    in expectation, and a recomputed partition repeats the same rows.  Null or negative
    weights are 0 (the row goes)."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.lit(float(scale))
    copies = (F.floor(w) + (counter_uniforms(key, 0, seed)[0] < w - F.floor(w)).cast("long")).cast("int")
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_copy")
