"""Per-row feature expressions as built-in ``Column`` builders.

Everything here compiles to JVM expressions inside whole-stage codegen; no
Python runs per row.  Calendar parts are computed from epoch seconds with
zone-free arithmetic (UTC), independent of the session time zone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BIN_THRESHOLDS_FINAL, BIN_WEIGHTS, CLASS_WEIGHTS, RATIO_INF, TYPE_CODES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def save_log(x) -> Column:
    """ln(|x| + 1)."""
    return F.log1p(F.abs(_c(x)).cast("double"))


def symlog(x) -> Column:
    """0 when |x| <= 1, else sign(x) * ln|x|."""
    c = _c(x).cast("double")
    return F.when(F.abs(c) <= 1, F.lit(0.0)).otherwise(F.signum(c) * F.log(F.abs(c)))


def signed_log1p(x) -> Column:
    """sign(x) * ln(|x| + 1)."""
    c = _c(x).cast("double")
    return F.signum(c) * F.log1p(F.abs(c))


def creation_deltas() -> dict[str, Column]:
    """Signed log of account-age differences."""
    return {
        "a_b_creation_delta": signed_log1p(F.col("a_account_creation") - F.col("b_account_creation")),
        "a_creation_delta": signed_log1p(F.col("ts") - F.col("a_account_creation")),
        "b_creation_delta": signed_log1p(F.col("ts") - F.col("b_account_creation")),
    }


def safe_ratio(num, den, inf_value: float = RATIO_INF) -> Column:
    """E5: num/den; x/0 -> ``inf_value``; 0/0 -> null (later sentinel-filled).

    Guarded so ANSI mode never sees a division by zero.
    """
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return (F.when(d == 0, F.when(n != 0, F.lit(inf_value)))
             .otherwise(n / F.when(d == 0, F.lit(None)).otherwise(d)))


def follow_ratios() -> dict[str, Column]:
    return {
        "a_b_follower_ratio": safe_ratio("a_follower_count", "b_follower_count"),
        "b_a_follower_ratio": safe_ratio("b_follower_count", "a_follower_count"),
        "a_b_following_ratio": safe_ratio("a_following_count", "b_following_count"),
        "b_a_following_ratio": safe_ratio("b_following_count", "a_following_count"),
    }


def split_list(x, sep: str = "\t") -> Column:
    """Multi-valued cell -> array (an empty string gives one empty item)."""
    return F.split(_c(x), sep)


def token_len_log(x="tokens") -> Column:
    """ln(1 + number of tab-separated tokens)."""
    return F.log1p(F.size(split_list(x)).cast("double"))


def media_count_log(x, kind: str) -> Column:
    """ln(1 + occurrences of ``kind``); -1 when the cell is null or empty."""
    c = _c(x)
    n = F.size(F.filter(split_list(c), lambda v: v == F.lit(kind)))
    return F.when(c.isNull() | (c == ""), F.lit(-1.0)).otherwise(F.log1p(n.cast("double")))


def media_combo(x="medias", k: int = 3) -> Column:
    """First ``k`` media joined by ``_``."""
    return F.array_join(F.slice(split_list(F.coalesce(_c(x), F.lit(""))), 1, k), "_")


def type_encoding(x="type", mapping: dict[str, int] = TYPE_CODES) -> Column:
    """Fixed map lookup; unknown -> null."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.try_element_at(m, _c(x)).cast("int")


def epoch_day(ts="ts") -> Column:
    """Days since 1970-01-01 (floor), zone free."""
    return F.floor(_c(ts) / 86400).cast("int")


def epoch_date(ts="ts") -> Column:
    return F.date_from_unix_date(epoch_day(ts))


def day_of_week(ts="ts") -> Column:
    """Monday = 0 (UTC)."""
    return F.weekday(epoch_date(ts))


def hour_of_day(ts="ts") -> Column:
    """E13 (UTC)."""
    return F.pmod(F.floor(_c(ts) / 3600), F.lit(24)).cast("int")


def day_of_year(ts="ts") -> Column:
    """E14 (UTC)."""
    return F.dayofyear(epoch_date(ts))


def readable_time(ts="ts", fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds -> text (UTC)."""
    secs = F.pmod(_c(ts), F.lit(86400))
    return F.concat_ws(
        " ",
        F.date_format(epoch_date(ts), fmt.split(" ")[0]),
        F.format_string("%02d:%02d:%02d", (secs / 3600).cast("int"), (secs % 3600 / 60).cast("int"), (secs % 60).cast("int")),
    )


def follower_bin(x="a_follower_count", thresholds: Iterable[int] = BIN_THRESHOLDS_FINAL) -> Column:
    """Bin 1..len(thresholds)+1 by upper bounds (strict ``<``)."""
    c = _c(x)
    th = list(thresholds)
    expr = F.lit(len(th) + 1)
    for i in reversed(range(len(th))):
        expr = F.when(c < th[i], F.lit(i + 1)).otherwise(expr)
    return expr.cast("int")


def has_label(x) -> Column:
    """Engagement indicator after the 0-fill of null labels."""
    return F.coalesce(_c(x), F.lit(0)) > 0


def engagement_latency(label, ts="ts") -> Column:
    """(label - ts) when engaged, else 0."""
    lab = _c(label)
    return F.when(has_label(lab), lab - _c(ts)).otherwise(F.lit(0)).cast("bigint")


def id_key64(x) -> Column:
    """E19 as a join key: int(hex,16) mod 2^64, stored as a signed 64-bit
    two's-complement long (a bijection with the unsigned value; fast joins)."""
    return F.conv(F.substring(_c(x), -16, 16), 16, -10).cast("bigint")


def key64_to_unsigned(k) -> Column:
    """Render a signed 64-bit key as the unsigned decimal string."""
    c = _c(k)
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(c < 0, c.cast("decimal(20,0)") + two64).otherwise(c.cast("decimal(20,0)")).cast("string")


def id_fold64(x) -> Column:
    """int(hex,16) mod 2^64 as an unsigned decimal string."""
    return F.conv(F.substring(_c(x), -16, 16), 16, 10)


def id_hash32(x) -> Column:
    """int(hex,16) mod 2^32."""
    return F.conv(F.substring(_c(x), -8, 8), 16, 10).cast("bigint")


def text_length(x) -> Column:
    """E24."""
    return F.length(_c(x)).cast("bigint")


def inverse_log(x) -> Column:
    """exp(x) - 1."""
    return F.expm1(_c(x).cast("double"))


def bin_weight(bin_col="bin", weights: dict[int, float] = BIN_WEIGHTS) -> Column:
    """Row weight by follower bin."""
    m = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    return F.try_element_at(m, _c(bin_col))


def class_weight(target: str, label=None) -> Column:
    """Class weight of a row for ``target``."""
    neg, pos = CLASS_WEIGHTS[target]
    lab = _c(label or f"has_{target}")
    return F.when(lab, F.lit(pos)).otherwise(F.lit(neg))


def squeeze_probability(p) -> Column:
    """(p - 0.5) * 0.999 + 0.5."""
    return (_c(p) - 0.5) * 0.999 + 0.5


def nan_to_num(x, value: float = 0.0) -> Column:
    """NaN or null -> ``value``."""
    c = _c(x).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(value))


def nonzero(x) -> Column:
    """E30."""
    return F.coalesce(_c(x), F.lit(0)) != 0


def round_half_up(x, digits: int = 6) -> Column:
    """``round`` of a double.  It makes two big decimals of each value; here a value that is no tie for sure
    goes by its nearest integer of ``10^digits`` parts, which gives the same double, and only the others
    (near a tie, large, NaN) by ``round``."""
    c, scale = _c(x).cast("double"), F.lit(float(10**digits))
    scaled = c * scale
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / scale).otherwise(F.round(c, digits))


def round_decision(p) -> Column:
    """Half-to-even rounding of a probability to 0/1."""
    return F.bround(_c(p), 0).cast("int")
