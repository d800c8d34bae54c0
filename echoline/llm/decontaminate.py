"""Benchmark decontamination by spaced seeds.

A seed looks at some of the words of a short span and skips the others, so a
substituted word that falls on a skipped place does not hide a match.  Hashes
of all seeds of the documents are joined with those of the benchmark; each hit
gives an alignment, and words are compared along it.  The two default masks hit
every 13-word window with up to two substitutions (tests try all of them).

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import ascii_folded, store, words_of

# Places that a seed looks at; pairs of neighbours, so that a pair's hash serves both masks.
MASKS = ((0, 1, 2, 3, 11, 12), (0, 1, 3, 4, 5, 6))
WINDOW, SUBSTITUTIONS = 13, 2


def _word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word, A-Z as a-z."""
    return F.transform(words_of(ascii_folded(text)), lambda w: F.xxhash64(w))


def seeds(hashed: DataFrame, key: str, masks=MASKS) -> DataFrame:
    """(key, seed, at): the hash of every mask at every place of the word hashes ``h``."""
    shifted = lambda c, at: F.slice(c, F.lit(at + 1), F.greatest(F.size("h"), F.lit(1)))
    df = hashed.select(key, "h")
    df = df.withColumn("p", F.zip_with("h", shifted("h", 1), lambda a, b: F.xxhash64(a, b)))
    for k, mask in enumerate(masks):
        if mask[::2] != tuple(x - 1 for x in mask[1::2]):
            raise ValueError("a mask is made of pairs of neighbouring places")
        last = "p"
        for n, at in enumerate(mask[2::2]):
            df = df.withColumn(f"m{k}_{n}", F.zip_with(last, shifted("p", at), lambda a, b: F.xxhash64(a, b)))
            last = f"m{k}_{n}"
        whole = F.slice(last, F.lit(1), F.greatest(F.size("h") - (mask[-1]), F.lit(0)))
        df = df.withColumn(f"s{k}", F.transform(whole, lambda x: F.xxhash64(x, F.lit(k))))
    each = df.select(key, F.explode_outer(F.array(*[f"s{k}" for k in range(len(masks))])).alias("s"))
    return each.select(key, F.posexplode_outer("s").alias("at", "seed"))


def short_runs(size: int, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> list[tuple[int, int]]:
    """(start, length) of the runs that an item of ``size`` words, fewer than ``window``, is cut into:
    one more than the substitutions that it allows, so that one run at least is free of them."""
    parts = size * substitutions // window + 1
    edges = [size * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def run_seeds(hashed: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, seed, at): the hash of every run of so many words of the word hashes ``h``."""
    df, arrays = hashed.select(key, "h").withColumn("r1", F.transform("h", lambda x: F.xxhash64(x, F.lit(-1)))), []
    for n in range(1, max(lengths) + 1):
        if n > 1:
            later = F.slice("h", F.lit(n), F.greatest(F.size("h"), F.lit(1)))
            df = df.withColumn(f"r{n}", F.zip_with(f"r{n - 1}", later, lambda a, b: F.xxhash64(a, b)))
        if n in lengths:
            arrays.append(F.slice(f"r{n}", F.lit(1), F.greatest(F.size("h") - (n - 1), F.lit(0))))
    each = df.select(key, F.explode(F.array(*arrays)).alias("s"))
    return each.select(key, F.posexplode("s").alias("at", "seed"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks=MASKS, max_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_same, doc_word): documents that overlap a benchmark item.

    A document overlaps an item if, laid over each other at some shift, ``window`` words in a
    row agree but for at most ``substitutions`` (words: runs of non-white-space, A-Z as a-z).
    n_same is the best window's number of equal words, doc_word where the first window with
    so many starts in the document.  An item of fewer words counts as one window, and allows as many
    fewer substitutions: one from 7 to 12 words, none below.  An item without words overlaps nothing.

    Null texts have no words; rows with a null doc_id or item_id can't be named and are left out.
    Repeated rows give one row.  Empty tables give an empty result.  Extra columns are not looked at.

    The benchmark's seeds are broadcast if they are at most ``max_broadcast``, else joined by a shuffle.
    """
    doc_h = docs.where("doc_id is not null").select("doc_id", _word_hashes(F.col("text")).alias("h"))
    items = benchmark.where("item_id is not null").select("item_id", _word_hashes(F.col("text")).alias("h")).distinct()
    items = store(items, "items")
    # At most window - 1 sizes; run lengths that no short item has cost the documents nothing.
    short = items.withColumn("size", F.size("h")).where((F.col("size") > 0) & (F.col("size") < window))
    runs = {r["size"]: short_runs(r["size"], window, substitutions) for r in short.select("size").distinct().collect()}
    item_seeds = seeds(items.where(F.size("h") >= window), "item_id", masks).withColumn("whole", F.lit(False))
    doc_seeds = seeds(doc_h, "doc_id", masks)
    if runs:
        lengths = sorted({n for parts in runs.values() for _, n in parts})
        wanted = F.array(*[F.struct(F.lit(size).alias("size"), F.lit(a).alias("at"), F.lit(n).alias("n"), F.lit(len(parts) == 1).alias("whole")) for size, parts in runs.items() for a, n in parts])
        cut = short.select("item_id", "h", "size", F.explode(wanted).alias("w")).where(F.col("w.size") == F.col("size"))
        first = F.xxhash64(F.get("h", F.col("w.at")), F.lit(-1))
        seed = F.aggregate(F.slice("h", F.col("w.at") + 2, F.col("w.n") - 1), first, lambda a, x: F.xxhash64(a, x))
        item_seeds = item_seeds.unionByName(cut.select("item_id", "w.at", seed.alias("seed"), "w.whole"))
        doc_seeds = doc_seeds.unionByName(run_seeds(doc_h, "doc_id", lengths))
    item_seeds = store(item_seeds.withColumnRenamed("at", "item_at"), "seeds")
    side = F.broadcast(item_seeds) if item_seeds.count() <= max_broadcast else item_seeds
    # Where the seed is the whole item all hits are alike, and the first in the document will do.
    hits = (
        doc_seeds.join(side, "seed")
        .select("doc_id", "item_id", "whole", (F.col("at") - F.col("item_at")).alias("shift"))
        .groupBy("doc_id", "item_id", F.when(~F.col("whole"), F.col("shift")).alias("each"))
        .agg(F.min("shift").alias("shift"))
        .drop("each")
    )
    hits = store(hits, "hits")
    found = (
        hits.join(items.withColumnRenamed("h", "item_h"), "item_id")
        .join(docs.select("doc_id", "text"), "doc_id")
        .select("doc_id", "item_id", "shift", "item_h", _word_hashes(F.col("text")).alias("doc_h"))
    )
    # Named twice, the hashes stay a column of their own; named once, Spark would work them out
    # anew for every word of the item.
    inside = lambda i: (i >= 0) & (i < F.size("doc_h"))
    same = F.transform(
        "item_h",
        lambda x, t: F.when(inside(F.col("shift") + t), F.get("doc_h", F.col("shift") + t) == x).otherwise(F.lit(False)).cast("int"),
    )
    found = found.select("doc_id", "item_id", "shift", same.alias("same"))
    size = F.least(F.size("same"), F.lit(window))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("same") - size),
        lambda s: F.struct(F.aggregate(F.slice("same", s + 1, size), F.lit(0), lambda a, x: a + x).alias("n"), (-s).alias("back")),
    )
    # Of all shifts the best window; the filter comes after the aggregate, as below it Spark
    # would write out all of the above once more.
    best = (
        found.select("doc_id", "item_id", "shift", size.alias("size"), F.array_max(sums).alias("w"))
        .select("doc_id", "item_id", "size", F.struct(F.col("w.n"), (F.col("w.back") - F.col("shift")).alias("back")).alias("w"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("w").alias("w"), F.max("size").alias("size"))
    )
    # A short item allows as many fewer substitutions.
    enough = F.col("w.n") >= F.col("size") - F.floor(F.col("size") * substitutions / window)
    return best.where(enough).select(
        "doc_id", "item_id", F.col("w.n").cast("long").alias("n_same"), F.greatest(-F.col("w.back"), F.lit(0)).cast("long").alias("doc_word")
    )


def remove_overlapping(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without documents that overlap a benchmark item.

    Each row is judged by its own text, whatever its doc_id: rows with a null doc_id go like others,
    and of rows with one doc_id and unlike texts only those that overlap.  Copies share a verdict.
    Null and empty texts stay.  Columns pass through as they are, whatever their names.
    """
    key = F.struct(F.xxhash64("text").alias("ra"), F.xxhash64(F.lit(1), F.col("text")).alias("rb"))
    found = find_overlaps(docs.select(key.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("_gone")).distinct()
    keyed = docs.withColumn("_text_key", key)
    return keyed.join(found, keyed["_text_key"] == found["_gone"], "left_anti").select(*docs.columns)
