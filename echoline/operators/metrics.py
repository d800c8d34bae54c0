"""Evaluation metrics as aggregations.

Nothing is collected: RCE is one aggregate pass per (group, target); average
precision collapses tied scores first, then takes exact running sums through
``ranking.prefix_sums`` (range partitions + offsets), so even a group
holding a third of all rows is spread across many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TARGETS
from .ranking import prefix_sums

EPS = 1e-15


def unpivot_targets(df: DataFrame, keys: list[str], score_cols: dict[str, str] | str = "score",
                    label_cols: dict[str, str] | None = None, targets=TARGETS) -> DataFrame:
    """One row per (row, target): ``keys..., target, score, y`` (y is 0/1)."""
    if isinstance(score_cols, str):
        score_cols = {t: score_cols for t in targets}
    label_cols = label_cols or {t: f"has_{t}" for t in targets}
    structs = [F.struct(F.lit(t).alias("target"), F.col(score_cols[t]).cast("double").alias("score"),
                        F.col(label_cols[t]).cast("int").alias("y")) for t in targets]
    return df.select(*keys, F.inline(F.array(*structs)))


def _entropy(p: Column) -> Column:
    return -(p * F.log(p) + (1 - p) * F.log(1 - p))


def log_loss_expr(y: Column, p: Column) -> Column:
    """Per-row cross entropy with p clipped to [EPS, 1-EPS] (M1)."""
    pc = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -(y * F.log(pc) + (1 - y) * F.log(1 - pc))


def rce(df: DataFrame, group: list[str]) -> DataFrame:
    """M1-M3: ``ctr``, ``log_loss``, ``rce`` per group, one pass.

    RCE = (1 - CE / CE(constant ctr)) * 100; null when the group has no
    positives or no negatives (the constant predictor is then perfect)."""
    g = df.groupBy(*group).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                               F.avg(F.col("y").cast("double")).alias("ctr"),
                               F.avg(log_loss_expr(F.col("y").cast("double"), F.col("score"))).alias("log_loss"))
    straw = _entropy(F.col("ctr"))
    ok = (F.col("ctr") > 0) & (F.col("ctr") < 1)
    return g.withColumn("rce", F.when(ok, (1 - F.col("log_loss") / F.when(ok, straw)) * 100))


def average_precision(df: DataFrame, group: list[str], num_partitions: int | None = None) -> DataFrame:
    """M4: AP = sum over distinct thresholds (desc) of (R_k - R_{k-1}) * P_k."""
    ties = df.groupBy(*group, "score").agg(F.sum("y").cast("double").alias("tp"),
                                           F.count(F.lit(1)).cast("double").alias("cnt"))
    run = prefix_sums(ties, group, "score", ["tp", "cnt"], descending=True, num_partitions=num_partitions)
    return run.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_cnt")), F.sum("tp")).alias("ap"),
        F.sum("tp").cast("bigint").alias("positives"))


def metrics_by_group(df: DataFrame, group: list[str]) -> DataFrame:
    """M5/M7: RCE and AP per group."""
    return rce(df, group).join(average_precision(df, group), group, "full")


def macro_mean(per_bin: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """M6: unweighted mean over bins; bins with a null metric are skipped."""
    return per_bin.groupBy(*by).agg(*[F.avg(c).alias(f"macro_{c}") for c in cols],
                                    F.count_if(F.col(cols[0]).isNull()).cast("bigint").alias("undefined_bins"))


def confusion(df: DataFrame, group: list[str], threshold_round: bool = True) -> DataFrame:
    """Counts per (y, y_hat) with y_hat = half-even rounding of the score."""
    yhat = F.bround(F.col("score"), 0).cast("int") if threshold_round else F.col("y_hat")
    return df.groupBy(*group, F.col("y"), yhat.alias("y_hat")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def classification_scores(df: DataFrame, group: list[str]) -> DataFrame:
    """M8/M9: accuracy, balanced accuracy and precision from one aggregate."""
    yhat = F.bround(F.col("score"), 0).cast("int")
    y = F.col("y")
    g = df.groupBy(*group).agg(
        F.count_if((y == 1) & (yhat == 1)).alias("tp"), F.count_if((y == 0) & (yhat == 0)).alias("tn"),
        F.count_if((y == 0) & (yhat == 1)).alias("fp"), F.count_if((y == 1) & (yhat == 0)).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    return g.select(*group,
                    ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
                    ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
                    F.try_divide(tp, tp + fp).alias("precision"))


def rank_runs(run_log: DataFrame, metric: str, name_col: str = "method", descending: bool = True) -> DataFrame:
    """Order logged runs by one metric (ties by name); the log is one row per run."""
    from .ranking import global_row_index
    order = [F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last(), F.col(name_col)]
    return global_row_index(run_log.select(name_col, metric), order, "rank", start=1)
