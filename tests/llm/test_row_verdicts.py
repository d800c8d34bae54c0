"""Filtering stages judge rows by their own text: null ids, ids that recur, clashing names; links in hot groups."""

import random

import pytest

import corpus_pipeline
import public_tokenizers
from echoline.llm import bpe_reuse, decontaminate, ngram_join
from tests.llm.test_small import brute_groups, prose

SCHEMA = "doc_id long, text string, n_lines long, n_dropped long, n_chars long, ra string, k string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 77, 88, 0, "r", "k") for k, t in rows], SCHEMA).repartition(3)


def test_near_copies_are_judged_by_row(spark):
    rng = random.Random(4)
    base, other, third = prose(rng, 90), prose(rng, 90), prose(rng, 90)
    near = base + " one more"
    rows = [(1, base), (2, near), (2, other), (None, base), (None, third), (None, None), (7, third), (8, "")]
    kept = ngram_join.keep_one_of_each(frame(spark, rows))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # 1 stays for base, near and the copy without an id; 7 for third; clean rows all stay
    assert got == sorted([(1, base), (2, other), (7, third), (None, None), (8, "")], key=str)
    assert all(r.n_lines == 77 and r.k == "k" for r in kept.collect())


def test_overlaps_are_judged_by_row(spark):
    rng = random.Random(6)
    item = prose(rng, 30)
    bad, clean = prose(rng, 20) + " " + item + " " + prose(rng, 20), prose(rng, 60)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, bad), (1, clean), (None, bad), (None, clean), (3, None), (4, bad), (4, bad)]
    got = sorted(((r.doc_id, r.text) for r in decontaminate.remove_overlapping(frame(spark, rows), bench).collect()), key=str)
    assert got == sorted([(1, clean), (None, clean), (3, None)], key=str)


def test_clashing_names(spark):
    docs = frame(spark, [(1, "a line of text\nown"), (2, "a line of text\nother")])
    out = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped, r.n_chars) for r in out.collect()} == {(1, "a line of text\nown", 77, 88, 18), (2, "other", 77, 88, 5)}
    named = docs.withColumnsRenamed({"n_lines": "n_tokens", "n_dropped": "ids"})
    r = bpe_reuse.encode_documents(named, public_tokenizers.path("byte_bpe_50k.json")).orderBy("doc_id").first()
    assert r.n_tokens == len(r.ids.split(",")) and r.decoded == "a line of text\nown"


def test_a_group_around_the_threshold_needs_few_comparisons(spark):
    """Copies whose similarity to each other lies on both sides of the threshold: all links are found."""
    rng = random.Random(9)
    words = prose(rng, 200).split()
    rows = []
    for k in range(60):
        w = list(words)
        for at in rng.sample(range(200), rng.randint(1, 5)):
            w[at] = f"x{k}.{at}"
        rows.append((k, " ".join(w)))
    want = brute_groups(rows, 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(frame(spark, rows)).collect()}
    assert got == want


def test_too_low_a_threshold_is_refused():
    with pytest.raises(ValueError):
        ngram_join.Similarity(words=5, percent=79)
