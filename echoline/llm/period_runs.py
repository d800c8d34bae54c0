"""Periodic runs of words, from maximal pairs.

Words i and i + q that begin equal stretches of l words, with unequal words before
and after, are a maximal pair.  If 3 q <= l, the stretch of l + q words from i has
period q and exponent 4 or more and can't be extended: maximal pairs whose distance
fits their length are the runs themselves.  (A run of period q also shows at
multiples of q; the smallest counts.)

The texts of a batch are sorted by suffix together (words are coded by text, so no
two texts meet), by doubling prefixes, where only what still ties is sorted again.
Of the suffix order only the stretches that share five words or more can hold runs.
Their LCP-interval tree is merged bottom-up; each node has its places in order and
lists of them by the word to their left.  Places of a node of depth l that lie within
l / 3 of each other are spaced by the period of its string, and all but the first of
such a row have the same word to their left.  So a place pairs only with places of the
next one's list, or with the first place of the row it stands in.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from echoline.llm.common import map_texts

LEAST_EXPONENT, LEAST_WORDS = 4, 6
#: The shallowest pair of a run: period 1, six words.
LEAST_DEPTH = LEAST_WORDS - 1


def suffix_order(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places whose first four words occur again, in suffix order, and the ranks of all
    places by their first 1, 2, 4, ... words (as many as it takes until no two tie).

    ``codes``: a word's code, unlike between texts; ``ends``: where the place's text ends.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.flatnonzero(np.diff(codes[order], prepend=codes[order[0]] - 1))
    sizes = np.diff(new, append=n)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(new, sizes)
    ranks, tied = [rank], order[np.repeat(sizes > 1, sizes)]
    wanted = None
    width = 1
    while True:
        if width == 4:
            wanted = tied
        if not len(tied):
            break
        after = tied + width
        inside = after < ends[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = rank[tied].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        sizes = np.diff(new, append=len(key))
        base = rank[tied[new]]
        # The ties of one old rank stand together; a new rank adds the place inside them.
        old = np.flatnonzero(np.diff(base, prepend=-1))
        start = np.repeat(new[old], np.diff(old, append=len(base)))
        rank = rank.copy()
        rank[tied] = np.repeat(base + (new - start), sizes).astype(np.int32)
        ranks.append(rank)
        tied = tied[np.repeat(sizes > 1, sizes)]
        width *= 2
    if wanted is None or not len(wanted):
        return np.empty(0, np.int64), ranks
    return wanted[np.argsort(rank[wanted], kind="stable")], ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """How many words each place of ``order`` shares with the next."""
    a, b = order[:-1].copy(), order[1:].copy()
    stop_a, stop_b = ends[a], ends[b]
    lcp = np.zeros(len(a), np.int64)
    last = len(ranks[0]) - 1
    for level in range(len(ranks) - 1, -1, -1):
        rank, width = ranks[level], 1 << level
        same = (a < stop_a) & (b < stop_b) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
        lcp += same * width
        a += same * width
        b += same * width
    return lcp


def maximal_pairs(places: list[int], lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, depth): i < j of one stretch of the suffix order with equal ``depth`` words from i
    and j on, unlike words before and after, and 3 (j - i) <= depth."""
    before = dict(zip(places, left))
    out = []

    def merged(a, b, depth):
        if len(a[0]) < len(b[0]):
            a, b = b, a
        order, lists = a
        reach = depth // (LEAST_EXPONENT - 1)
        for word, mine in b[1].items():
            for i in mine:
                t = bisect_right(order, i)
                if t < len(order) and order[t] - i <= reach:
                    other_word = before[order[t]]
                    if other_word != word:
                        other = lists[other_word]
                        for u in range(bisect_left(other, order[t]), len(other)):
                            if other[u] - i > reach:
                                break
                            out.append((i, other[u], depth))
                if t and i - order[t - 1] <= reach:
                    first = order[bisect_left(order, i - reach)]
                    if before[first] != word:
                        out.append((first, i, depth))
        for word, mine in b[1].items():
            kept = lists.setdefault(word, [])
            for i in mine:
                insort(order, i)
                insort(kept, i)
        return a

    waiting: list[tuple] = []
    node = ([places[0]], {left[0]: [places[0]]})
    for place, word, depth in zip(places[1:], left[1:], lcp):
        while waiting and waiting[-1][1] >= depth:
            part, at = waiting.pop()
            node = merged(part, node, at)
        waiting.append((node, depth))
        node = ([place], {word: [place]})
    while waiting:
        part, at = waiting.pop()
        node = merged(part, node, at)
    return out


def runs_of(words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.  ``words`` are codes of all texts'
    words, ``starts`` the place of each text's first word and the end."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(starts[1:], sizes)
    codes = text.astype(np.int64) * (int(words.max()) + 1) + words
    order, ranks = suffix_order(codes, ends)
    if not len(order):
        return []
    lcp = common_prefixes(order, ranks, ends)
    del ranks
    deep = np.concatenate([[False], lcp >= LEAST_DEPTH, [False]])
    # Stretches of the suffix order that share LEAST_DEPTH words.
    begin = np.flatnonzero(~deep[:-1] & deep[1:])
    end = np.flatnonzero(deep[:-1] & ~deep[1:]) + 1
    if not len(begin):
        return []
    inside = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange((end - begin).sum())
    places, stretch = order[inside], np.repeat(np.arange(len(begin)), end - begin)
    # Where no two places are close enough for the longest shared prefix, there is no run.
    by = np.lexsort((places, stretch))
    gaps = np.diff(places[by], append=0)
    at = np.concatenate([[0], np.cumsum(end - begin)])
    gaps[at[1:] - 1] = n
    nearest = np.minimum.reduceat(gaps, at[:-1])
    shared = np.where(np.diff(stretch, append=-1) == 0, lcp[np.minimum(inside, len(lcp) - 1)], 0)
    deepest = np.maximum.reduceat(shared, at[:-1])
    left = np.where(places > starts[text[places]], words[places - 1], -1)
    best: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero((LEAST_EXPONENT - 1) * nearest <= deepest).tolist():
        a, b = at[k], at[k + 1]
        for i, j, depth in maximal_pairs(places[a:b].tolist(), shared[a : b - 1].tolist(), left[a:b].tolist()):
            if depth + j - i >= LEAST_WORDS:
                key = (i, depth + j - i)
                best[key] = min(j - i, best.get(key, j - i))
    return sorted(((i, length, period) for (i, length), period in best.items()), key=lambda r: (r[0], r[2]))


def _work(texts: list[str]) -> dict:
    split = [t.encode().split() for t in texts]  # of bytes: blank, \t, \n, \v, \f and \r only
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    found = runs_of(coded, starts)
    owner = np.searchsorted(starts, [r[0] for r in found], side="right") - 1 if found else []
    runs: list[list[dict]] = [[] for _ in texts]
    for k, (start, length, period) in zip(owner, found):
        runs[k].append({"start": start - int(starts[k]), "length": length, "period": period})
    collapsed = []
    for words, own in zip(split, runs):
        if own:
            steps = np.zeros(len(words) + 1, np.int64)
            for r in own:
                steps[r["start"] + r["period"]] += 1
                steps[r["start"] + r["length"]] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(words).decode())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return {"n_words": pa.array(sizes), "runs": pa.array(runs, kind), "collapsed": pa.array(collapsed, pa.string())}


def find_runs(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but text, and n_words, runs, collapsed.

    runs: (start, length, period) of every stretch of words with smallest period q that has
    max(6, 4 q) words or more and can't be extended, by start, then period.  collapsed: the
    words, joined by a blank, without those that stand in a run after its first q words.
    Null and empty texts have no words and no runs; texts of any length are taken whole, in
    memory that grows with the text; repeated rows each give a row; no rows give none.  Columns
    of ``docs`` that have one of these three names are replaced.
    """
    return map_texts(docs.drop("n_words", "runs", "collapsed"), "text", lambda: _work, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
