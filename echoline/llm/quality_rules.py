"""Quality rules: decision lists learned by sequential covering.

Labelled documents are cut into a grid: every statistic is binned at quantiles
of the labelled sample and Spark counts labels a cell.  Rules for the class
"bad" are grown one condition at a time on the growing part (greatest gain),
pruned on the pruning part, and accepted only at a high precision there; rows
that a rule covers are then taken out and the next rule is learned.  The list
is emitted as one ordered Spark conditional expression.

Only DataFrame functions touch documents; the driver sees cell counts of a
sample of at most ``max_rows`` labelled documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import WORD_PATTERN, words_of

COUNTED = {
    "n_symbols": "[#*$%&|<>]",
    "n_upper": "[A-Z]",
    "n_digits": "[0-9]",
    "n_marks": r"[!?;:\x22'()\[\]{}_=+~^/\x5C]",
}
FEATURES = ["symbol_ratio", "repeat_ratio", "dup_line_ratio", "mean_word", "upper_ratio", "digit_ratio", "mark_ratio", "distinct_ratio", "n_words"]


def _with_window_hashes(df: DataFrame, words: str, n: int, name: str) -> DataFrame:
    """Add a 64-bit hash of each n-word window, built by doubling: a window's hash is made of the
    hashes of two shorter windows, so each step is one pass over an array (and one column, as
    Spark would write a nested array expression out anew for each use)."""
    join = lambda a, b: F.xxhash64(a, b)
    df, have, parts = df.withColumn("__h1", F.transform(words, lambda w: F.xxhash64(w))), 1, [1]
    while have * 2 <= n:
        df = df.withColumn(f"__h{have * 2}", F.zip_with(f"__h{have}", _from(f"__h{have}", have), join))
        have *= 2
        parts.append(have)
    length, last = have, f"__h{have}"
    while length < n:
        step = max(k for k in parts if k <= n - length)
        df = df.withColumn(f"__to{length + step}", F.zip_with(last, _from(f"__h{step}", length), join))
        length, last = length + step, f"__to{length + step}"
    hashes = F.slice(last, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return df.withColumn(name, hashes).drop(*[c for c in df.columns if c.startswith(("__h", "__to"))])


def _from(array: str, at: int) -> Column:
    return F.slice(array, F.lit(at + 1), F.greatest(F.size(array), F.lit(1)))


def _same(a: Column, b: Column) -> Column:
    return (a == b).eqNullSafe(True)


def text_statistics(docs: DataFrame, *carried: str, window: int = 5) -> DataFrame:
    """(doc_id, carried columns, text statistics) of every row; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        *carried,
        text.alias("t"),
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_PATTERN)).alias("lines"),
    )
    counted = _with_window_hashes(base, "words", window, "grams").select(
        "doc_id",
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[F.regexp_count("t", F.lit(p)).cast("long").alias(c) for c, p in COUNTED.items()],
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "grams",
    )
    # Positions are sorted by window only where a window is found twice.
    tie = F.size(F.array_distinct("grams")) < F.size("grams")
    pairs = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = counted.withColumn("pairs", F.when(tie, pairs)).drop("grams")
    twice = F.filter(
        "pairs",
        lambda x, k: _same(F.get("pairs", k - 1)["h"], x["h"]) | _same(F.get("pairs", k + 1)["h"], x["h"]),
    )
    placed = found.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("pairs")
    # A window at i covers the words up to the next such window, at most its own length.
    covered = F.aggregate(
        F.transform("at", lambda i, k: F.least(F.lit(window), F.coalesce(F.get("at", k + 1) - i, F.lit(window)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def with_features(stats: DataFrame) -> DataFrame:
    """The ratios that rules test; 0 where the divisor is 0."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return stats.withColumns(
        {
            "symbol_ratio": over("n_symbols", "word_chars"),
            "repeat_ratio": over("n_repeat_words", "n_words"),
            "dup_line_ratio": over("n_dup_lines", "n_lines"),
            "mean_word": over("word_chars", "n_words"),
            "upper_ratio": over("n_upper", "word_chars"),
            "digit_ratio": over("n_digits", "word_chars"),
            "mark_ratio": over("n_marks", "word_chars"),
            "distinct_ratio": over("n_distinct", "n_words"),
        }
    )


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float
    bin: int

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def covers(self, cell: dict) -> bool:
        return (cell[self.feature] >= self.bin) == self.above

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


def _count(cells: list[dict], rule: list[Condition]) -> tuple[int, int]:
    bad = good = 0
    for c in cells:
        if all(x.covers(c) for x in rule):
            bad, good = bad + c["bad"], good + c["good"]
    return bad, good


def _best_condition(cells: list[dict], cuts: dict[str, list[float]], bad: int, good: int) -> Condition | None:
    """The condition with the greatest gain: one pass a feature sums its bins, then both sides of every cut are known."""
    before, best, top = math.log2(bad / (bad + good)), None, 1e-9
    for f, ts in cuts.items():
        sums = [[0, 0] for _ in range(len(ts) + 1)]
        for c in cells:
            x = sums[c[f]]
            x[0] += c["bad"]
            x[1] += c["good"]
        below = [0, 0]
        for k, t in enumerate(ts):
            below = [below[0] + sums[k][0], below[1] + sums[k][1]]
            for above, (b, g) in ((False, below), (True, (bad - below[0], good - below[1]))):
                gain = b * (math.log2(b / (b + g)) - before) if b else 0
                if gain > top:
                    best, top = Condition(f, above, t, k + 1), gain
    return best


def _grow(cells: list[dict], cuts: dict[str, list[float]], max_conditions: int) -> list[Condition]:
    """Add the condition with the greatest gain until no good document is covered."""
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        bad, good = _count(cells, [])
        best = _best_condition(cells, cuts, bad, good) if bad and good else None
        if best is None:
            break
        rule.append(best)
        cells = [c for c in cells if best.covers(c)]
    return rule


def _prune(cells: list[dict], rule: list[Condition]) -> list[Condition]:
    """The prefix of the rule with the best (bad - good) / (bad + good) on the pruning part; short ones win ties."""
    best, worth = rule, -2.0
    for n in range(1, len(rule) + 1):
        b, g = _count(cells, rule[:n])
        v = (b - g) / (b + g) if b + g else -1.0
        if v > worth:
            best, worth = rule[:n], v
    return best


def learn_rules(cells: list[dict], cuts: dict[str, list[float]], max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.97, min_bad: int = 5) -> list[list[Condition]]:
    """Ordered rules for "bad" from cells {feature: bin, part, bad, good}."""
    rules: list[list[Condition]] = []
    while len(rules) < max_rules:
        growing = [c for c in cells if c["part"] > 0]
        pruning = [c for c in cells if c["part"] == 0]
        rule = _prune(pruning, _grow(growing, cuts, max_conditions))
        bad, good = _count(cells, rule) if rule else (0, 0)
        if bad < min_bad or bad < min_precision * (bad + good):
            break
        rules.append(rule)
        cells = [c for c in cells if not all(x.covers(c) for x in rule)]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, bins: int = 16, **learn) -> list[list[Condition]]:
    """Learn from the ``max_rows`` labelled documents with the smallest hash of doc_id.

    Rows with a null doc_id or quality are not used; without labels of both kinds there are no rules.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    few = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Persisted before the filter: pushed below the statistics, it would write each of them out twice.
    kept = with_features(text_statistics(few, "quality")).persist()
    try:
        rows = kept.where(~base_failed()).select("doc_id", "quality", *FEATURES)
        at = [i / bins for i in range(bins + 1)]
        bad = rows.where("quality = 0")
        both = lambda df: df.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).first()
        q, qb = both(rows), both(bad)
        cuts = {f: sorted({float(v) for v in [*(q[f] or []), *(qb[f] or [])]}) for f in FEATURES}
        binned = rows.select(
            (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))).cast("int").alias("part"),
            *[sum(((F.col(f) >= F.lit(t)).cast("int") for t in ts), F.lit(0)).alias(f) for f, ts in cuts.items()],
            (F.col("quality") == 0).cast("long").alias("is_bad"),
        )
        cells = binned.groupBy("part", *FEATURES).agg(F.sum("is_bad").alias("bad"), (F.count("*") - F.sum("is_bad")).alias("good"))
        found = [r.asDict() for r in cells.collect()]
    finally:
        kept.unpersist()
    return learn_rules(found, cuts, **learn)


def rule_number(rules: list[list[Condition]]) -> Column:
    """The first rule that fits, from 1; null if none does."""
    out = None
    for n, rule in enumerate(rules, 1):
        fits = rule[0].column()
        for x in rule[1:]:
            fits = fits & x.column()
        out = F.when(fits, F.lit(n)) if out is None else out.when(fits, F.lit(n))
    return F.lit(None).cast("int") if out is None else out


def apply_rules(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Per row: doc_id, statistics, base_failed, rule (the list's first fitting rule) and kept.

    Null and empty texts have no words and fail the base rules; repeated rows are judged each.
    Columns besides doc_id and text are not looked at.  An empty table gives an empty result.
    """
    judged = with_features(text_statistics(docs)).withColumn("base_failed", base_failed())
    judged = judged.withColumn("rule", F.when(~F.col("base_failed"), rule_number(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
