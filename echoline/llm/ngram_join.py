"""Exact similarity join on word n-gram sets with PartEnum signatures.

Two sets whose Jaccard similarity reaches the threshold differ in at most k
elements, where k follows from their sizes.  The feature domain is cut into n1
parts; over all of them at most k elements differ, so in one part at most
k2 = 1 does.  That part is cut into n2 = 3 smaller ones, of which two must then
be equal.  A signature is a part's number and two of its three smaller parts:
similar sets share one, sets of texts that merely have words in common don't.  With
``spare`` parts more than that, similar sets share a signature in one part and in
as many others.  So each set may leave its ``spare`` most common signatures out:
of those that two similar sets share, the least common one stays with both.

Sizes are taken in bands: a signature belongs to the band of the larger set,
and a set is also entered in the next band if a larger partner can lie there.

What follows needs no list of all pairs.  Equal sets are one class.  In a
bucket (the classes with one signature) every class is compared with one pivot
only, and components of these links come next.  Pivots differ from bucket to
bucket (one of ``ORDERS`` orders of the classes gives them), and buckets that are
not one component yet get new ones in ``ROUNDS`` rounds: a class of a group of near
copies then misses its group only if it is unlike all of them.  What is apart even
so is compared with the other components of its bucket.  So groups of near copies
cost their size, and yet no link that could join two components is left out.  Before texts
are compared, a bit sketch discards pairs that differ too much: a bit flips for each
differing element, so it never discards a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.common import arrow_map, store
from echoline.llm.components import connected_components

GROWTH = 1.25
SKETCH_WORDS = 8
SKETCH = [f"w{k}" for k in range(SKETCH_WORDS)]
#: Orders of the classes that pivots are taken by in a round, and rounds.
ORDERS, ROUNDS = 4, 3
#: Documents whose sets are fetched by a broadcast of their ids; more are fetched by a shuffle.
MAX_BROADCAST = 1_000_000
LAST_ID = (1 << 63) - 1
#: One part in so many is spare.
SPARE = 8
#: The low bits of a signature are the number of its band.
BAND_BITS = 7
_SPLIT = bytes(range(9, 14)) + b" "


@dataclass(frozen=True)
class Similarity:
    """100 * intersection >= percent * union, over sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80

    def __post_init__(self):
        # A set is entered in its own band and the next: no partner may lie beyond that.
        if not 100 >= self.percent >= 100 / GROWTH or self.words < 1:
            raise ValueError(f"percent must lie between {100 / GROWTH:g} and 100 and words be 1 or more")

    def most_differing(self, total: int) -> int:
        """Most elements in which two sets with ``total`` elements together may differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def bands(self, largest: int) -> list[tuple[int, int]]:
        """Bands of set sizes from 1 up to one that holds ``largest``."""
        out, low = [], 1
        while True:
            high = max(low, int(low * GROWTH))
            out.append((low, high))
            if high >= largest:
                return out
            low = high + 1

    def parts(self, largest: int) -> tuple[int, int]:
        """How many parts sets of up to ``largest`` elements are cut into, and how many of these are spare."""
        needed = self.most_differing(2 * largest) // 2 + 1  # in so many parts two differing elements each would be too many
        spare = needed // SPARE
        return needed + spare, spare


_TABLE = bytes.maketrans(_SPLIT, b" " * len(_SPLIT))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text that has no white space but blanks: sums of mixed (place in the word, byte)."""
    text = np.frombuffer(words, np.uint8)
    inside = text != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.flatnonzero(begins[inside])
    if not len(first):
        return np.zeros(0, np.uint64)
    text = text[inside].astype(np.uint64)
    place = np.arange(len(text)) - np.repeat(first, np.diff(first, append=len(text)))
    return np.add.reduceat(_mix(text + (place.astype(np.uint64) + np.uint64(1) << np.uint64(8))), first)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles, A-Z as a-z; a text of fewer words is one shingle."""
    h = _word_hashes((text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE))
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, len(h) if n == len(h) else 0, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def set_hash(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray) -> np.ndarray:
    """512 bits; each element flips one."""
    bit = (s >> np.uint64(55)).astype(np.int64)
    odd = np.bincount(bit, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_sketches(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``sketch``, with as many bits as the set has elements (a power of two, 512 at least), and
    with half as many: of two sets of similar size one pair of these has equally many bits."""
    out = []
    power = max(9, int(len(s)).bit_length())
    for k in (power, max(9, power - 1)):
        odd = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
    return out[0], out[1]


def signatures(s: np.ndarray, how: Similarity) -> np.ndarray:
    """The signatures of a set in its band, and in the next one if it may have partners there.

    Two smaller parts that are both empty say nothing about a set.  All that the part has is
    then in the third one, where similar sets differ in one element at most: they share what
    is there, or that but for one element, and these are the signatures instead.
    """
    out = []
    size = len(s)
    bands = how.bands(size)
    low, high = bands[-1]
    entered = [(len(bands), high)]
    above = high + 1
    if 100 * size >= how.percent * above:
        entered.append((len(bands) + 1, max(above, int(above * GROWTH))))
    mixed = _mix(s)
    for band, largest in entered:
        n1, _ = how.parts(largest)
        place = ((s >> np.uint64(20)) % np.uint64(3 * n1)).astype(np.int64)
        # A smaller part's hash is the sum of its mixed elements.
        sums = np.zeros(3 * n1, np.uint64)
        np.add.at(sums, place, mixed)
        full = (np.bincount(place, minlength=3 * n1) > 0).reshape(n1, 3)
        sums = sums.reshape(n1, 3)
        tag = _mix(np.arange(n1, dtype=np.uint64) * np.uint64(8) + np.uint64(band << 40))
        made = []
        for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            told = full[:, a] | full[:, b]
            made.append(_mix(_mix(sums[told, a] + tag[told] + np.uint64(k)) + sums[told, b]))
        # At most one of the three is not empty: the part's whole content, and that without each element.
        sparse = full.sum(axis=1) <= 1
        whole = sums.sum(axis=1, dtype=np.uint64)
        made.append(_mix(whole[sparse] + tag[sparse] + np.uint64(3)))
        part = place // 3
        own = sparse[part]
        made.append(_mix(whole[part[own]] - mixed[own] + tag[part[own]] + np.uint64(3)))
        out.append(np.concatenate(made) >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.uint64(band))
    return np.unique(np.concatenate(out))


def _each_text(batches: Iterator[pa.RecordBatch], how: Similarity):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at in range(len(ids)):
            yield ids[at], shingle_set(batch.column(1)[at].as_py(), how.words)


def text_hashes() -> list[Column]:
    """What tells a text from others: ra and rb."""
    return [F.xxhash64("text").alias("ra"), F.xxhash64(F.lit(1), F.col("text")).alias("rb")]


def text_sets(docs: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, ra, rb, n_shingles, a, b, w0..): row key, size, 128-bit hash and sketch of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes, sketches = [], [], np.zeros((batch.num_rows, SKETCH_WORDS), np.int64)
            for k, text in enumerate(batch.column(3)):
                s = shingle_set(text.as_py(), how.words)
                sizes.append(len(s))
                hashes.append(set_hash(s) if len(s) else None)
                sketches[k] = sketch(s)
            a = [None if h is None else int.from_bytes(h[:8], "little", signed=True) for h in hashes]
            b = [None if h is None else int.from_bytes(h[8:], "little", signed=True) for h in hashes]
            columns = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(x)) for x in sketches.T], ["doc_id", "ra", "rb", "n_shingles", "a", "b", *SKETCH])

    return arrow_map(docs.select("doc_id", *text_hashes(), "text"), run, "doc_id long, ra long, rb long, n_shingles long, a long, b long, " + ", ".join(f"{w} long" for w in SKETCH))


def _signature_rows(docs: DataFrame, how: Similarity) -> DataFrame:
    """(sig, a): the signatures of every set; a task enters equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sigs: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], ["sig", "a"])
            sigs.clear()
            keys.clear()
            return batch

        for _, s in _each_text(batches, how):
            if not len(s) or (h := set_hash(s)) in seen:
                continue
            seen.add(h)
            sig = signatures(s, how)
            sigs.append(sig)
            keys.append(np.full(len(sig), int.from_bytes(h[:8], "little", signed=True), np.int64))
            held += len(sig)
            if held >= 200_000:
                yield flush()
                held = 0
        if sigs:
            yield flush()

    return arrow_map(docs.select("doc_id", "text"), run, "sig long, a long")


def _place(a: str, turn: int) -> Column:
    """A class's place in the order that its bucket (sig) goes by in a round."""
    return F.xxhash64(F.col(a), F.pmod(F.shiftright("sig", BAND_BITS), F.lit(ORDERS)) + ORDERS * turn)


def _buckets(rows: DataFrame) -> DataFrame:
    """(sig, first, a): the buckets with two classes or more; first: the pivot, first of the bucket in its order.
    Rows are dealt by signature and sorted, then read once in passing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig0 = first0 = last0 = None
        waiting = False  # the open bucket's first class has not been told yet
        for batch in batches:
            sig, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            if sig0 is None:
                sig0, first0, last0, waiting = sig[0], a[0], a[0], True
                fresh = np.concatenate(([False], (sig[1:] != sig[:-1]) | (a[1:] != a[:-1])))
            else:
                fresh = np.concatenate(([sig[0] != sig0 or a[0] != last0], (sig[1:] != sig[:-1]) | (a[1:] != a[:-1])))
            sig, a = sig[fresh], a[fresh]
            if not len(sig):
                continue
            # Put the open bucket's first class in front if it may still be needed.
            s = np.concatenate(([sig0], sig))
            x = np.concatenate(([first0], a))
            starts = np.concatenate(([True], s[1:] != s[:-1]))
            group = np.cumsum(starts) - 1
            sizes = np.bincount(group)
            first = x[starts][group]
            keep = sizes[group] > 1
            if not waiting:
                keep[0] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(first[keep]), pa.array(x[keep])], ["sig", "first", "a"])
            tail = group[-1]
            waiting = sizes[tail] == 1 and (tail > 0 or waiting)
            sig0, first0, last0 = s[-1], first[-1], x[-1]

    return arrow_map(rows.repartition("sig").sortWithinPartitions("sig", _place("a", 0), "a"), run, "sig long, first long, a long")


def _without_largest(buckets: DataFrame, how: Similarity) -> DataFrame:
    """The rows of ``buckets`` but for each class's ``spare`` largest buckets in a band.

    Sizes order all buckets alike (ties: by signature).  Two similar sets share more than ``spare`` of a
    band, so the smallest that they share is among the spare largest of neither."""
    spares = F.array(*[F.lit(how.parts(high)[1]) for _, high in how.bands(1 << 40)])
    band = F.col("sig").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
    sized = buckets.join(buckets.groupBy("sig").agg(F.count("*").alias("size")), "sig").withColumn("band", band)
    largest_first = Window.partitionBy("a", "band").orderBy(F.col("size").desc(), "sig")  # no more rows than the text has signatures
    return sized.withColumn("nth", F.row_number().over(largest_first)).where(F.col("nth") > F.element_at(spares, F.col("band"))).select("sig", "first", "a")


def _sets_of(docs: DataFrame, wanted: DataFrame, how: Similarity, wide: bool) -> DataFrame:
    """(a, s, t) of the wanted documents, by the set's hash: the set (and nothing), or its wide sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), how.words) for t in batch.column(0)]
            own = [int.from_bytes(set_hash(s)[:8], "little", signed=True) for s in sets]
            told = [wide_sketches(s) if wide else (s.view(np.int64), None) for s in sets]
            columns = [pa.array([x[k] for x in told], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *columns], ["a", "s", "t"])

    ids = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    few = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")
    return arrow_map(few, run, "a long, s array<long>, t array<long>")


def _may_link(how: Similarity) -> Column:
    """Sizes and sketches of x and y allow a link."""
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in SKETCH])
    n, m = F.col("x.n"), F.col("y.n")
    return (100 * F.least(n, m) >= how.percent * F.greatest(n, m)) & (differ * (100 + how.percent) <= (100 - how.percent) * (n + m))


def _with_sets(docs: DataFrame, pairs: DataFrame, brief: DataFrame, how: Similarity, wide: bool, name: str) -> DataFrame:
    """Pairs (a, b) with their sizes na, nb, and sets or wide sketches sa, ta, sb, tb."""
    members = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    wanted = store(brief.join(members, "a").select("doc_id").where("doc_id is not null").distinct(), name)
    sets = store(_sets_of(docs, wanted, how, wide).join(brief.select("a", "n"), "a"), name)
    one = sets.select("a", F.col("n").alias("na"), F.col("s").alias("sa"), F.col("t").alias("ta"))
    two = sets.select(F.col("a").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("t").alias("tb"))
    return pairs.join(one, "a").join(two, "b")


def _verified(docs: DataFrame, pairs: DataFrame, brief: DataFrame, how: Similarity, name: str) -> DataFrame:
    """(a, b) of those pairs whose sets are similar enough.  Wide sketches (a 64th of a set) go
    first; the sets are made for the documents of the pairs that are left."""
    pairs = store(pairs, name)
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    differ = (
        F.when(F.size("sa") == F.size("sb"), bits("sa", "sb"))
        .when(F.size("ta") == F.size("sb"), bits("ta", "sb"))
        .when(F.size("sa") == F.size("tb"), bits("sa", "tb"))
        .otherwise(F.lit(0))
    )
    sketched = _with_sets(docs, pairs, brief, how, True, name)
    left = store(sketched.where(differ * (100 + how.percent) <= (100 - how.percent) * (F.col("na") + F.col("nb"))).select("a", "b").distinct(), name)
    common = F.size(F.array_intersect("sa", "sb"))
    joined = _with_sets(docs, left, brief, how, False, name).drop("ta", "tb")
    found = joined.where(100 * common >= how.percent * (F.size("sa") + F.size("sb") - common))
    return store(found.select("a", "b").distinct(), name)


def similar_groups(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id reachable by links.

    * Documents with equal sets are linked; those without words (null or empty text) have an
      empty set and no link: they are their own component.
    * Rows with the same doc_id and equal sets count as one document.  If their texts differ, each row
      has the component of its own text.  Rows with a null doc_id have component null unless they are
      linked to a row with one.
    * Columns besides doc_id and text are not looked at.  An empty table gives an empty result.
    """
    return grouped_rows(docs, how).select("doc_id", "n_shingles", "component_id")


def grouped_rows(docs: DataFrame, how: Similarity) -> DataFrame:
    """As ``similar_groups``, and each row's key (doc_id, ra, rb) and its group's first row: first.k
    (the doc_id, null as ``LAST_ID``), first.ra, first.rb; null for rows without words."""
    rows = store(text_sets(docs, how), "sets")
    same = [F.max(w).alias(w) for w in SKETCH]
    classes = store(rows.where("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.min(_row()).alias("row"), F.max("n_shingles").alias("n"), *same), "classes")
    # Buckets know classes by half of the hash; should two have that half in common (64 bits), one stands for both.
    brief = classes.groupBy("a").agg(F.min("rep").alias("doc_id"), F.max("n").alias("n"), *same)
    buckets = store(_without_largest(store(_buckets(_signature_rows(docs, how)), "shared"), how), "buckets")

    pairs = buckets.where("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b")).distinct()
    may = pairs.join(brief.alias("x"), F.col("x.a") == pairs["a"]).join(brief.alias("y"), F.col("y.a") == pairs["b"])
    near = may.where(_may_link(how)).select(pairs["a"], pairs["b"])
    links = _verified(docs, near, brief, how, "near")

    roots = connected_components(links)
    for turn in range(1, ROUNDS + 1):
        labelled = buckets.join(roots, buckets["a"] == roots["node"], "left").select("sig", "a", F.coalesce("root", "a").alias("root"))
        heads = labelled.groupBy("sig").agg(F.min(F.struct(_place("a", turn), "a", "root")).alias("p"), F.min("root").alias("low"), F.max("root").alias("high"))
        # Buckets that are not one component yet.
        apart = heads.where("low < high").select("sig", F.col("p.a").alias("pivot"), F.col("p.root").alias("head"))
        members = store(labelled.join(apart, "sig").join(brief, "a").select("sig", "a", "root", "pivot", "head", "n", *SKETCH), "open")
        if turn == ROUNDS or members.isEmpty():
            break
        x = members.where("root <> head").alias("x")
        again = x.join(brief.alias("y"), (F.col("y.a") == F.col("x.pivot")) & _may_link(how)).select(F.col("x.pivot").alias("a"), F.col("x.a").alias("b")).distinct()
        links = store(links.unionByName(_verified(docs, again, brief, how, "again")), "links")
        roots = connected_components(links)
    # What hangs elsewhere than the pivot, against all other components of the bucket.
    x, y = members.where("root <> head").alias("x"), members.alias("y")
    once = (F.col("y.root") == F.col("y.head")) | (F.col("x.a") < F.col("y.a"))  # two that both hang elsewhere meet once
    cross = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & once & _may_link(how))
    cross = cross.select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()
    links = links.unionByName(_verified(docs, cross, brief, how, "cross"))

    roots = connected_components(links)
    linked = classes.join(roots, classes["a"] == roots["node"], "left").select("a", "b", "rep", "row", F.coalesce("root", "a").alias("root"))
    # A class that no link touches is its own group, by its whole hash.
    lone = F.when(F.col("root") == F.col("a"), F.col("b"))
    touched = roots.select("root").distinct().withColumnRenamed("root", "hub")
    linked = linked.join(touched, linked["root"] == touched["hub"], "left").withColumn("own", F.when(F.col("hub").isNull(), lone))
    groups = linked.groupBy("root", "own").agg(F.min("rep").alias("component_id"), F.min("row").alias("first"))
    named = linked.alias("l").join(groups.alias("g"), (F.col("l.root") == F.col("g.root")) & F.col("l.own").eqNullSafe(F.col("g.own"))).select("l.a", "l.b", "g.component_id", "g.first")
    names = ["doc_id", "ra", "rb", "n_shingles", "component_id", "first"]
    full = rows.where("n_shingles > 0").select("doc_id", "ra", "rb", "n_shingles", "a", "b").join(named, ["a", "b"]).select(*names)
    none = F.lit(None).cast(full.schema["first"].dataType).alias("first")
    empty = rows.where("n_shingles = 0").select("doc_id", "ra", "rb", "n_shingles", F.col("doc_id").alias("component_id"), none)
    return full.unionByName(empty)


def _row() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("k"), "ra", "rb")


def keep_one_of_each(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """``docs`` with the first document of each group, by doc_id (null: last) and then by its text's hash.

    Verdicts hold for rows, not for ids: of rows with one doc_id and unlike texts each is judged
    by its own text, and rows with a null doc_id are judged like others.  Rows that have the
    same doc_id and the same text are one document and stay or go together.  Documents without
    words stay.  Columns pass through as they are, whatever their names.
    """
    gone = grouped_rows(docs, how).select(_row().alias("_row"), "first").where("_row <> first").select(F.col("_row").alias("_gone")).distinct()
    keyed = docs.withColumn("_row", F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("k"), *text_hashes()))
    return keyed.join(gone, keyed["_row"] == gone["_gone"], "left_anti").select(*docs.columns)
