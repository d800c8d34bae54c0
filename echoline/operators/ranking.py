"""Global ranks and prefix sums without a single-partition window.

An unpartitioned ``row_number() over (order by x)`` pulls every row into one
task.  Instead: range-partition on the order key, number rows inside each
partition, count rows per partition (a tiny table: one row per partition,
so its broadcast is bounded by the partition count), turn those counts into
offsets and add them back.  The range-partitioned frame feeds two branches
(sizes and rows).  Both must see the same partitions: all columns take part in
the partitioning, so both branches need the same exchange and Spark runs it
once (``spark.sql.exchange.reuse``, checked; nothing is persisted).

The result checks this itself.  Each row's number inside its partition must not
exceed the size that was counted for it: as both branches hold the same rows,
partitions that differ anywhere make one of them larger than its counted size, so
the job fails and never gives wrong ranks.  Equal sizes of sorted ranges mean equal
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIFFERENT = "ranks: rows and their counts saw different partitions (no exchange was reused)"


def _checked(value: Column, kind: str, number: Column, size: Column) -> Column:
    """``value`` of type ``kind``, or an error if a row's 1-based ``number`` exceeds the counted ``size`` (null: nothing counted)."""
    return F.when(number <= size, value).otherwise(F.raise_error(F.lit(DIFFERENT)).cast(kind))


def _ranges(df: DataFrame, order: list[Column | str], num_partitions: int | None) -> tuple[DataFrame, list[Column | str]]:
    """Range partition on ``order`` (returned with what was added to it) plus a deterministic row hash, so rows that
    tie on the order key (a hot value) still spread over partitions; the
    hash is a pure function of the row, so recomputation places rows alike."""
    if df.sparkSession.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        raise ValueError("ranks need spark.sql.exchange.reuse: rows and their counts share one exchange")
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    keyed = [*order, tie]
    return df.repartitionByRange(n, *keyed), keyed


def global_row_index(df: DataFrame, order: list[Column | str], name: str = "row_id",
                     start: int = 0, num_partitions: int | None = None) -> DataFrame:
    """``start``-based row number in ``order`` (ties broken by position)."""
    ranges, keyed = _ranges(df, order, num_partitions)
    sizes = ranges.groupBy(F.spark_partition_id().alias("_pid")).agg(F.count(F.lit(1)).alias("_size"))  # needs no order
    r = (ranges.sortWithinPartitions(*keyed)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    offs = sizes.select("_pid", "_size", (F.sum("_size").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    return _number(r, offs, name, start)


def _number(rows: DataFrame, offsets: DataFrame, name: str, start: int) -> DataFrame:
    """Rows with ``_pid`` and ``_local`` (from 0) get ``name`` by their partition's offset."""
    rank = (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + F.lit(start)).cast("bigint")
    out = rows.join(F.broadcast(offsets), "_pid", "left")
    return out.withColumn(name, _checked(rank, "bigint", F.col("_local") + 1, F.col("_size"))).drop("_pid", "_local", "_off", "_size")


def dense_codes(df: DataFrame, col: str, name: str = "code", null_code: int | None = -1,
                num_partitions: int | None = None) -> DataFrame:
    """Dictionary ``(value, code)`` with codes 0.. by sorted distinct value;
    null gets ``null_code``.  Distinct first (partial aggregate), then ranks."""
    vals = df.select(F.col(col)).filter(F.col(col).isNotNull()).distinct()
    coded = global_row_index(vals, [F.col(col)], name, 0, num_partitions)
    if null_code is not None:
        nulls = df.select(F.col(col)).filter(F.col(col).isNull()).limit(1) \
            .select(F.col(col), F.lit(null_code).cast("bigint").alias(name))
        coded = coded.unionByName(nulls)
    return coded


def prefix_sums(df: DataFrame, partition: list[str], key: str, cols: list[str], descending: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """Running sums of ``cols`` per ``partition`` in ``key`` order (inclusive of
    the current row).

    Rows are range-partitioned once on (partition, key), so a group of any size
    spreads over as many tasks as its share of the rows.  Sums per Spark partition
    and group (a row each) give the offsets; running sums stay inside a Spark
    partition.  Rows must be unique per (partition, key): aggregate ties first.
    """
    order = F.col(key).desc() if descending else F.col(key).asc()
    ranges, keyed = _ranges(df, [*[F.col(c) for c in partition], order], num_partitions)
    r = ranges.sortWithinPartitions(*keyed).withColumn("_pid", F.spark_partition_id())
    sums = r.groupBy("_pid", *partition).agg(F.count(F.lit(1)).alias("_size"), *[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*partition).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_pid").alias("_p"), "_size", *[F.col(c).alias(f"_g_{c}") for c in partition],
                          *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    return _running(r, offsets, partition, order, cols)


def _running(rows: DataFrame, offsets: DataFrame, partition: list[str], order: Column, cols: list[str]) -> DataFrame:
    """Running sums inside ``_pid`` and group, plus the group's sums in the partitions before."""
    on = F.col("_pid") == F.col("_p")
    for c in partition:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = rows.join(offsets, on, "left").drop("_p", *[f"_g_{c}" for c in partition])
    w = Window.partitionBy("_pid", *partition).orderBy(order)
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"_number": F.row_number().over(w), **{f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(inside) for c in cols}})
    kept = {f"cum_{c}": _checked(F.col(f"cum_{c}"), out.schema[f"cum_{c}"].dataType.simpleString(), F.col("_number"), F.col("_size")) for c in cols}
    return out.withColumns(kept).drop("_pid", "_size", "_number", *[f"_o_{c}" for c in cols])
