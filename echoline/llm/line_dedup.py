"""Exact line deduplication with levelled sorted runs of line hashes.

Documents are taken in batches of ascending ``doc_id``.  Every batch keeps one
row for each new line key (two 64-bit hashes and the smallest document that
holds it), after a merge anti join against the runs already stored, and adds
what is left as a run sorted by hash.  When a level holds ``fanout`` runs they
are merged into one run of the next level, so a batch meets at most
``fanout - 1`` runs a level.  A line then goes if the runs name a smaller
document for its key.

Only DataFrame functions are used; text is shuffled once, for the last join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import SPACE_CHARS, ascii_folded, store

LAST_ID = (1 << 63) - 1
KEY = ["ha", "hb"]
ROW = ["k", "ra", "rb"]


def _row_key() -> list[Column]:
    """What tells a row from all others but its copies: k (the doc_id; null counts as last) and two hashes of the text."""
    return [
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("k"), F.xxhash64("text").alias("ra"), F.xxhash64(F.lit(1), F.col("text")).alias("rb")
    ]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(k, ra, rb, pos, ha, hb): the lines whose key has at least ``min_chars`` code points.

    A line's key is the line without white space at its ends, A-Z lower-cased; it is hashed
    in its folded form (``ascii_folded``), where a code point is one byte that is no
    continuation byte.  k, ra and rb are the row's key.
    """
    folded = ascii_folded(F.coalesce("text", F.lit("")))
    keyed = (
        docs.select(*_row_key(), _lines(folded).alias("lines"))
        .select(*ROW, F.posexplode_outer("lines").alias("pos", "line"))
        .select(*ROW, "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("key"))
    )
    points = F.length(F.regexp_replace("key", "[\x80-\xBF]", ""))
    long_enough = (F.length("key") >= min_chars) & ((F.length("key") >= 4 * min_chars) | (points >= min_chars))
    return keyed.where(long_enough).select(
        *ROW, "pos", F.xxhash64("key").alias("ha"), F.xxhash64(F.lit(1), F.col("key")).alias("hb")
    )


class RunStore:
    """Levels of sorted runs: ``levels[i]`` holds disjoint runs of (ha, hb, first)."""

    def __init__(self, fanout: int = 2):
        self.fanout, self.levels = fanout, []

    def all_runs(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add_batch(self, occurrences: DataFrame) -> None:
        """Add the keys of a batch that no run has, with their smallest k."""
        new = occurrences.groupBy(*KEY).agg(F.min("k").alias("first"))
        for level in self.levels:
            for run in level:
                new = new.join(run, KEY, "left_anti")
        self._push(0, store(new.sortWithinPartitions(*KEY), "run"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._push(level + 1, store(merged.repartition(*KEY).sortWithinPartitions(*KEY), "run"))


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Upper doc_ids of all batches but the last, from approximate quantiles."""
    cuts = [i / batches for i in range(1, batches)]
    got = docs.agg(F.percentile_approx("doc_id", cuts, 1000).alias("q")).first()["q"]
    return sorted(set(got or []))


def build_runs(occurrences: DataFrame, bounds: list[int], fanout: int) -> RunStore:
    runs = RunStore(fanout)
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        batch = occurrences
        if low is not None:
            batch = batch.where(F.col("k") > low)
        if high is not None:
            batch = batch.where(F.col("k") <= high)
        runs.add_batch(batch)
    return runs


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, plus ``n_lines`` and ``n_dropped``.

    A line goes if its key (``line_occurrences``) has at least ``min_chars`` code points
    and a document with a smaller doc_id holds the same key.

    * Lines repeated inside the smallest document that holds them all stay.
    * Null text stays null and counts as one empty line; a document whose lines
      all go has empty text.
    * Rows with the same doc_id count as one document, whatever their texts: they
      don't take each other's lines.  Rows with a null doc_id count as one document
      after all others.  Each row loses its own lines only.
    * Extra columns are carried along; columns named like those added are replaced.
    * An empty table gives an empty table.
    """
    occurrences = store(line_occurrences(docs, min_chars), "lines")
    runs = build_runs(occurrences, batch_bounds(docs, batches), fanout).all_runs()
    dropped = (
        occurrences.join(runs, KEY)
        .where(F.col("first") < F.col("k"))
        .groupBy(*ROW)
        .agg(F.collect_set("pos").alias("__gone"))
        .withColumnsRenamed({c: f"__{c}" for c in ROW})
    )
    body = docs.drop("n_lines", "n_dropped").select("*", *[c.alias(f"__{name}") for c, name in zip(_row_key(), ROW)])
    joined = body.join(dropped, [f"__{c}" for c in ROW], "left").drop(*[f"__{c}" for c in ROW])
    lines = joined.withColumn("__lines", _lines(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.transform(places, lambda i: F.get(F.col("__lines"), i))
    out = lines.withColumn("n_lines", F.size("__lines").cast("long")).withColumn(
        "n_dropped", F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__lines") - F.size(places)).cast("long")
    )
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.withColumn("text", text).drop("__lines", "__gone")
