"""Language identification by interpolated Kneser-Ney character models.

Spark counts the character n-grams of a bounded sample of labelled documents
for each language.  From them come, one language at a time in a Spark task,
counts of the orders below the top (continuation counts), discounts and back-off
weights.  A language's model is sorted arrays of 64-bit hashes of its own n-grams
and contexts, so the models' size is the sum of what the languages have, and any
letter of any script is a symbol of its own.  A text goes to the language with the
lowest cross-entropy a character; it is rejected if that is far above what texts of
that language have, given its length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.common import map_texts, ship_package

ORDER = 4
UNKNOWN = "und"
#: Symbol 0 is any run of non-letters; a letter's symbol is its code point.
GAP = 0
SLICE = 1 << 19
#: A text is rejected so many standard deviations above its language's usual cross-entropy;
#: the deviation of texts counts as LEAST_SPREAD nats a symbol at least.
DEVIATIONS, LEAST_SPREAD = 10, 0.1

_TABLES: dict = {}


def _letter_table() -> np.ndarray:
    """Symbol of each code point, worked out once a process."""
    if "letters" not in _TABLES:
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _TABLES["letters"] = np.where(letter, points, np.uint32(GAP))
    return _TABLES["letters"]


def symbols(text: str) -> np.ndarray:
    """Symbols of a lower-cased text between two gaps; runs of gaps are one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    s = np.concatenate(([GAP], _letter_table()[points], [GAP])).astype(np.uint32)
    return s[np.concatenate(([True], (s[1:] != GAP) | (s[:-1] != GAP)))]


def padded(text: str) -> np.ndarray:
    """A text's symbols with gaps before them, so that its first letter ends an n-gram of the top order."""
    return np.concatenate((np.full(ORDER - 2, GAP, np.uint32), symbols(text)))


def chain(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its first n-1 symbols (one symbol: zeros) and its last symbol."""
    x = h + (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def hash_columns(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams whose k-th symbols are in the k-th array; no array: the empty context."""
    h = np.zeros(len(columns[0]) if columns else 1, np.uint64)
    for s in columns:
        h = chain(h, s)
    return h


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``keys``, and whether the asked key is there."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Tables:
    """One language: for order n, sorted n-grams with log probabilities, and sorted contexts of
    n-1 symbols with the log weight of the order below."""

    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    back: dict[int, np.ndarray] = field(default_factory=dict)

    def log_probabilities(self, grams: list[np.ndarray], contexts: list[np.ndarray], width: int) -> np.ndarray:
        """Of the last symbols, given hashes of the n-grams they end and of those n-grams' contexts
        (first order first): of the longest n-gram known, times the weights of the orders above it."""
        out = np.zeros(len(grams[0]))
        left = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            at, hit = _find(self.keys[n], grams[n - 1][left])
            out[left[hit]] += self.logp[n][at[hit]]
            left = left[~hit]
            at, known = _find(self.contexts[n], contexts[n - 1][left])
            out[left[known]] += self.back[n][at[known]]
        out[left] -= np.log(width)
        return out


def kneser_ney(columns: list[np.ndarray], counts: np.ndarray, width: int) -> Tables:
    """One language's tables from its distinct n-grams of the top order (an array for each of their
    symbols) and how often each occurs.  ``width`` symbols share what the lowest order leaves."""
    m = Tables()
    kept = {ORDER: (columns, counts.astype(np.float64))}
    for n in range(ORDER - 1, 0, -1):
        # Below the top an n-gram counts once for each distinct symbol found to its left.
        above = kept[n + 1][0][1:]
        _, first, times = np.unique(hash_columns(above), return_index=True, return_counts=True)
        kept[n] = ([x[first] for x in above], times.astype(np.float64))
    for n in range(1, ORDER + 1):
        own, c = kept[n]
        key = hash_columns(own)
        order = np.argsort(key)
        own, c, key = [x[order] for x in own], c[order], key[order]
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        context = hash_columns(own[:-1]) if n > 1 else np.zeros(len(key), np.uint64)
        m.contexts[n], at = np.unique(context, return_inverse=True)
        sums = np.bincount(at, weights=c)
        back = discount * np.bincount(at) / sums
        lower = np.exp(m.logp[n - 1][_find(m.keys[n - 1], hash_columns(own[1:]))[0]]) if n > 1 else 1 / width
        m.keys[n] = key
        m.logp[n] = np.log((c - discount) / sums[at] + back[at] * lower)
        m.back[n] = np.log(back)
    return m


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    tables: list[Tables] = field(default_factory=list)
    #: Letters of the sample, the gap and one for all letters not seen.
    width: int = 2
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a symbol and its variance for each text and language; number of symbols."""
        total = np.zeros((len(texts), len(self.languages)))
        squares, n = np.zeros_like(total), np.zeros(len(texts), np.int64)
        rows: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if parts:
                s = np.concatenate(parts)
                ends = np.cumsum([len(x) for x in parts])
                sizes = np.array([len(x) - ORDER + 1 for x in parts])
                # N-grams start anywhere but at the last places of a part; each distinct one is looked up once.
                starts = np.ones(len(s), bool)
                for k in range(1, ORDER):
                    starts[ends - k] = False
                starts = np.flatnonzero(starts)
                h = hash_columns([s[starts + k] for k in range(ORDER)])
                _, first, back = np.unique(h, return_index=True, return_inverse=True)
                some = [s[starts[first] + k] for k in range(ORDER)]
                grams = [hash_columns(some[ORDER - k :]) for k in range(1, ORDER + 1)]
                contexts = [np.zeros(len(first), np.uint64)] + [hash_columns(some[ORDER - k : -1]) for k in range(2, ORDER + 1)]
                cuts = np.cumsum([0, *sizes])[:-1]
                for x, own in enumerate(self.tables):
                    lp = own.log_probabilities(grams, contexts, self.width)[back]
                    np.add.at(total, (rows, x), -np.add.reduceat(lp, cuts))
                    np.add.at(squares, (rows, x), np.add.reduceat(lp * lp, cuts))
            rows.clear()
            parts.clear()
            held = 0

        for k, text in enumerate(texts):
            s = padded(text)
            if not s.any():
                continue
            n[k] = len(s) - ORDER + 1
            for at in range(0, int(n[k]), SLICE):
                piece = s[at : at + SLICE + ORDER - 1]
                rows.append(k)
                parts.append(piece)
                held += len(piece)
                if held >= SLICE:
                    flush()
        flush()
        some = np.maximum(n, 1)[:, None]
        mean = total / some
        return mean, np.maximum(squares / some - mean**2, 0), n

    def predict(self, texts: list[str]) -> pd.DataFrame:
        if not self.languages:
            none = len(texts)
            return pd.DataFrame({"lang_pred": [UNKNOWN] * none, "score": [0.0] * none, "entropy": [float("nan")] * none, "rejected": [True] * none})
        mean, _, n = self.entropies(texts)
        best = mean.argmin(axis=1)
        low = mean[np.arange(len(texts)), best]
        odds = np.exp(-(mean - low[:, None]) * self.temperature).sum(axis=1)
        limit = self.mean[best] + DEVIATIONS * np.sqrt(self.spread[best] ** 2 + self.noise[best] / np.maximum(n, 1))
        empty = n == 0
        return pd.DataFrame(
            {
                "lang_pred": np.where(empty, UNKNOWN, np.array(self.languages, dtype=object)[best]),
                "score": np.where(empty, 0.0, 1 / odds),
                "entropy": np.where(empty, np.nan, low),
                "rejected": empty | (low > limit),
            }
        )


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text leaves 1 modulo 3; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _ranked(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the hash that orders the rows that may be learned from, and its leading 16 bits."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return learn.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("slot", F.shiftright("h", 48))


def labelled_sample(docs: DataFrame, rows_per_language: int) -> DataFrame:
    """Text and label of at most so many documents a language, none of them held out: those
    with the smallest hash of doc_id (of equal ids with several texts or labels, one row).

    Rows are first counted by language and leading bits of the hash, which is pre-aggregated;
    ranks are then needed only for a language's rows up to the slot in which its sample
    ends, however many rows it has."""
    ranked = _ranked(docs)
    below = Window.partitionBy("lang").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = ranked.groupBy("lang", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    last = slots.where(F.col("before") < rows_per_language).groupBy(F.col("lang").alias("label")).agg(F.max("slot").alias("last"))
    few = ranked.join(F.broadcast(last), (F.col("lang") == F.col("label")) & (F.col("slot") <= F.col("last")))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = few.select("doc_id", "lang", "h").withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows_per_language)
    ids = ids.select("doc_id", F.col("lang").alias("label")).distinct()
    return docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").where(F.col("lang") == F.col("label")).select("doc_id", "text", "lang").dropDuplicates(["doc_id"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Top-order n-grams of each language in a batch: two symbols to a long."""
    for pdf in batches:
        for lang, own in pdf.groupby("lang"):
            parts = [x for t in own["text"] if (x := padded(t)).any()]
            if not parts:
                continue
            high = np.concatenate([x[:-3].astype(np.int64) << 32 | x[1:-2] for x in parts])
            low = np.concatenate([x[2:-1].astype(np.int64) << 32 | x[3:] for x in parts])
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            start = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
            yield pd.DataFrame({"lang": lang, "high": high[start], "low": low[start], "n": np.diff(np.append(start, len(high)))})


def _build(width: int):
    def build(own: pd.DataFrame) -> pd.DataFrame:
        high, low = own["high"].to_numpy(np.uint64), own["low"].to_numpy(np.uint64)
        columns = [(x >> np.uint64(shift) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for x in (high, low) for shift in (32, 0)]
        return pd.DataFrame({"lang": own["lang"].iloc[:1], "tables": [pickle.dumps(kneser_ney(columns, own["n"].to_numpy(), width))]})

    return build


def fit(docs: DataFrame, rows_per_language: int = 1500) -> Model:
    """Learn from a bounded sample of labelled rows (whole texts); a fifth of it calibrates.

    A task builds one language's tables from its distinct n-grams; the driver gets the
    finished tables.  Without labelled rows the model has no language and rejects everything.
    """
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, rows_per_language).withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(5)) == 0).persist()
    counts = sample.where("not tune").select("lang", "text").mapInPandas(_count, "lang string, high long, low long, n long")
    counts = counts.groupBy("lang", "high", "low").agg(F.sum("n").alias("n")).persist()
    try:
        letters = counts.select(F.col("low").bitwiseAND(0xFFFFFFFF).alias("s")).where(F.col("s") != GAP).distinct().count()
        width = letters + 2
        built = {r["lang"]: pickle.loads(r["tables"]) for r in counts.groupBy("lang").applyInPandas(_build(width), "lang string, tables binary").toLocalIterator()}
        if not built:
            return Model()
        model = Model(sorted(built), [built[x] for x in sorted(built)], width)
        packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = pickle.loads(packed.value)
            for pdf in batches:
                mean, variance, n = own.entropies(list(pdf["text"]))
                yield pd.DataFrame({"lang": pdf["lang"], "e": list(mean), "v": list(variance), "n": n})

        tune = sample.where("tune").select("lang", "text").mapInPandas(measure, "lang string, e array<double>, v array<double>, n long").toPandas()
    finally:
        counts.unpersist()
        sample.unpersist()
    return _calibrate(model, tune[tune["n"] > 0])


def _calibrate(model: Model, tune: pd.DataFrame) -> Model:
    """Temperature of the score, and what cross-entropy texts of each language have."""
    k = len(model.languages)
    model.mean, model.spread, model.noise = np.full(k, np.inf), np.ones(k), np.ones(k)
    if not len(tune):
        return model
    e, v, n = np.stack(tune["e"].to_numpy()), np.stack(tune["v"].to_numpy()), tune["n"].to_numpy()
    truth = tune["lang"].map({x: i for i, x in enumerate(model.languages)})
    known = truth.notna().to_numpy()
    y = truth[known].astype(int).to_numpy()

    def loss(t: float) -> float:
        z = -e[known] * t
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))

    model.temperature = min((2.0**i for i in range(-2, 10)), key=loss)
    best = e.argmin(axis=1)
    for x in range(k):
        own = best == x
        if own.any():
            low = e[own, x]
            model.mean[x], model.noise[x] = low.mean(), v[own, x].mean()
            # At least as wide as the sample is: its farthest text lies well within the limit.
            model.spread[x] = max(low.std(), (low.max() - low.mean()) / 5, LEAST_SPREAD)
    return model


def _predictor(docs: DataFrame, model: Model):
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make():
        own = pickle.loads(packed.value)
        return lambda texts: {c: v.tolist() for c, v in own.predict(texts).items()}

    return make


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1), entropy (nats a symbol), rejected.

    Null and empty texts and texts without a letter get ``und``, score 0, no entropy, and are
    rejected.  Only text decides; repeated rows are judged each, a null doc_id stays null.
    Whole texts are read, very long ones in slices.  Of languages with equal entropy the first
    by name is taken.  Other columns aren't looked at; an empty table gives an empty result.
    """
    make = _predictor(docs, model)
    asked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_texts(asked, "text", make, "lang_pred string, score double, entropy double, rejected boolean").withColumn("entropy", F.nanvl("entropy", F.lit(None).cast("double")))


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects.  Each row goes or stays by its own text,
    whatever its doc_id and those of other rows are.  All columns stay as they are, also those
    named like the operator's own."""
    make = _predictor(docs, model)

    def judge():
        predict = make()
        return lambda texts: {"__rejected": predict(texts)["rejected"]}

    return map_texts(docs, "text", judge, "__rejected boolean", keep=True).where("not __rejected").drop("__rejected")
