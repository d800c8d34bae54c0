"""The operators on small fixtures: nulls, empty and very long texts, ties, repeated rows,
empty tables, extra columns with clashing names, and brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from echoline.llm import bpe_reuse, decontaminate, html_text, id_coder, id_files, language_id, line_dedup, ngram_join, quality_rules, suffix_dedup, url_filter
from echoline.llm.common import ascii_folded, ascii_lower
from echoline.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, h long, words string, key string, a long, seed string"


def plain_lower(t):
    return (t or "").encode().lower().decode()


def prose(rng, n, words=None):
    words = words or ["the", "of", "ning", "erath", "oulin", "stre", "and", "Vera", "quid", "plom", "äther", "éclat"]
    return " ".join(rng.choice(words) + rng.choice(["", "s", "a", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["CHANGED"] + words[61:])
    far = " ".join(w if k % 9 else "x" + w for k, w in enumerate(words))
    out = [base, base, near, far, base.upper(), None, "", " \n\t", "one", "one two", "a\n\nb\n", "Common line of text\n" + prose(rng, 30)]
    out += ["  common LINE of text \n" + prose(rng, 30), "common line of text", "Is " * 400, prose(rng, 20_000), base + "\n" + prose(rng, 40), "😀 ümläut ÄÖ\u2003x\x85y\x1cz <|endoftext|> e\u0301"]
    out += [prose(rng, 30) + " " + " ".join(words[20:50]) + " " + prose(rng, 30) for _ in range(6)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", "fr"]
    rows = [(k, t, langs[k % 2], "s", 1, "x", "y", 2, "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """With a null doc_id and a repeated row."""
    rows = [(k, t, None, None, None, None, None, None, None) for k, t in enumerate(texts)]
    rows += [(None, texts[0], "en", None, None, None, None, None, None), rows[2]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_folding_is_exact(spark):
    cases = ["abc", "ABC", "É", "é", "Ã‰", "Ć", "ć", "ß", "ẞ", "K", "K", "k", "ÄA", "äA", "Äa", "ã\u0089", "Ð\u0090", "\U00010400", "\U00010428"]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", ascii_folded(F.col("t")).alias("f"), ascii_lower(F.col("t")).alias("l"))
    rows = df.collect()
    for x in rows:
        assert x.l == plain_lower(x.t)
        for y in rows:
            assert (x.f == y.f) == (plain_lower(x.t) == plain_lower(y.t))


# 10: line dedup
def brute_lines(pairs):
    key = lambda l: plain_lower(l.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for k, t in pairs:
        for l in (t or "").split("\n"):
            if len(key(l)) >= 10:
                first[key(l)] = min(first.get(key(l), k), k)
    out = {}
    for k, t in pairs:
        lines = (t or "").split("\n")
        kept = [l for l in lines if first.get(key(l), k) >= k]
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, texts):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(docs, batches=3).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    assert any(v[1] for v in got.values())


def test_line_dedup_odd(odd, empty, texts):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    assert [r.text for r in rows if r.doc_id is None] == [""]  # its only line is in document 0
    assert [r.text for r in rows if r.doc_id == 5] == [None]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_rows_lose_their_own_lines(spark):
    line = ["the first line of all", "the second line of all"]
    own = [f"a line of row {k} alone" for k in range(5)]
    rows = [(1, "\n".join(line)), (None, f"{line[0]}\n{own[0]}"), (None, f"{own[1]}\n{line[1]}"), (None, f"{own[2]}\n{own[2]}")]
    rows += [(7, f"{line[0]}\n{own[3]}"), (7, f"{own[4]}\n{line[0]}"), (7, f"{own[4]}\n{line[0]}"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(df).collect()))
    assert got == sorted([(0, 1, own[0]), (0, 1, own[1]), (0, 0, f"{own[2]}\n{own[2]}"), (1, 0, "\n".join(line)), (7, 0, ""), (7, 1, own[3]), (7, 1, own[4]), (7, 1, own[4])])


def test_runs_are_merged_by_level(docs):
    runs = line_dedup.build_runs(line_dedup.line_occurrences(docs), [4, 9, 14], 2)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    keys = runs.all_runs().select("ha", "hb")
    assert keys.count() == keys.distinct().count()


# 1: quality rules
def brute_statistics(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 500 else None
    lines = [l for l in (t or "").split("\n") if WORD.search(l)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), covered and len(covered)


def test_statistics(spark, docs, texts):
    got = {r.doc_id: r for r in quality_rules.text_statistics(docs).collect()}
    extra = ["a b c d e a b c d e f", "x x x x x x", "l 1\nl 1\n \n \nl 1", "#*$%&|<>#"]
    own = spark.createDataFrame([(k, t) for k, t in enumerate(extra)], "doc_id long, text string")
    more = {r.doc_id: r for r in quality_rules.text_statistics(own).collect()}
    for found, all_texts in ((got, texts), (more, extra)):
        for k, t in enumerate(all_texts):
            r, want = found[k], brute_statistics(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
            if want[4] is not None or len(WORD.findall(t or "")) < 500:
                assert r.n_repeat_words == (want[4] or 0)
    assert more[0].n_repeat_words == 10 and more[1].n_repeat_words == 6


def test_rules_are_learned(spark, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        t = prose(rng, rng.randint(30, 90))
        rows.append((k, " ".join(w + "###" for w in t.split()) if bad else t))
        labels.append((k, 0 if bad else 1))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    rules = quality_rules.fit_rules(docs, lab)
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs, rules).collect()}
    ok = [k for k, y in labels if not out[k].base_failed]
    assert all(out[k].kept == (k % 5 != 0) for k in ok)
    assert quality_rules.fit_rules(docs, lab.where("false")) == []
    assert quality_rules.apply_rules(empty, rules).count() == 0
    assert not quality_rules.apply_rules(spark.createDataFrame([(1, None)], "doc_id long, text string"), []).first().kept


def test_covering_prunes():
    cells = [{"x": b, "y": y, "part": p, "bad": 10 if b >= 2 else 0, "good": 0 if b >= 2 else 10} for b in range(4) for y in range(2) for p in range(3)]
    rules = quality_rules.learn_rules(cells, {"x": [1.0, 2.0, 3.0], "y": [1.0]})
    assert [[str(c) for c in r] for r in rules] == [["x >= 2"]]


# 2: BPE
def brute_bpe(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe(docs, odd, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, decoded = brute_bpe(texts, "byte_bpe_50k.json")
    got = {r.doc_id: r for r in bpe_reuse.encode_documents(docs.select("doc_id", "text"), path).collect()}
    for k in range(len(texts)):
        assert got[k].ids == ",".join(map(str, ids[k])) and got[k].n_tokens == len(ids[k]) and got[k].decoded == decoded[k]
    assert bpe_reuse.digest_documents(odd, path).count() == len(texts) + 2
    assert bpe_reuse.digest_documents(empty, path).count() == 0


def test_chunk_joins_at_any_cut(texts, monkeypatch):
    ids, _ = brute_bpe(texts, "byte_bpe_50k.json")
    for mean, least in ((2, 1), (5, 3), (40, 10)):
        monkeypatch.setattr(bpe_reuse.cut_points, "__defaults__", (mean, least))
        chunks = bpe_reuse.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), kept=50)
        for _ in range(2):
            for k, parts in enumerate(chunks.encode([t or "" for t in texts])):
                assert b"".join(p[1] for p in parts)[1:].decode() == ",".join(map(str, ids[k]))
    assert chunks.reused


# 3: similarity join
def brute_groups(pairs, n, percent):
    sets = {}
    for k, t in pairs:
        w = WORD.findall(plain_lower(t))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_similar_groups(docs, texts, words, percent):
    got = ngram_join.similar_groups(docs, ngram_join.Similarity(words, percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(list(enumerate(texts)), words, percent)


def test_chains_of_near_copies(spark):
    rng = random.Random(3)
    base = prose(rng, 100).split()
    rows, k = [], 0
    for start in range(4):
        words = base[start * 5 :] + base[: start * 5]
        for _ in range(25):
            words = list(words)
            for _ in range(rng.choice([1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            rows.append((k, " ".join(words)))
            k += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df, ngram_join.Similarity(3, 90)).collect()}
    assert got == brute_groups(rows, 3, 90)


def test_signatures_miss_nothing():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        how = ngram_join.Similarity(3, percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            lost = int(rng.integers(0, len(x) * (100 - percent) // 100 + 1))
            y = rng.permutation(x)[lost:]
            more = 0
            while 100 * len(y) >= percent * (len(x) + more + 1):
                more += 1
            y = np.unique(np.concatenate((y, rng.integers(0, 2**63, int(rng.integers(0, more + 1)), dtype=np.uint64))))
            common = len(np.intersect1d(x, y))
            if 100 * common >= percent * (len(x) + len(y) - common):
                shared = set(ngram_join.signatures(x, how)) & set(ngram_join.signatures(y, how))
                bands = how.bands(max(len(x), len(y)))
                own = [v for v in shared if int(v) & 127 == len(bands)]
                assert len(own) > how.parts(bands[-1][1])[1]
                bits = np.unpackbits((ngram_join.sketch(x) ^ ngram_join.sketch(y)).view(np.uint8)).sum()
                assert bits <= how.most_differing(len(x) + len(y))
                wide = [(p, q) for p in ngram_join.wide_sketches(x) for q in ngram_join.wide_sketches(y) if len(p) == len(q)]
                assert wide and all(np.unpackbits((p ^ q).view(np.uint8)).sum() <= how.most_differing(len(x) + len(y)) for p, q in wide)


def test_bands_fit_their_bits():
    for percent in (80, 90, 100):
        assert len(ngram_join.Similarity(3, percent).bands(1 << 40)) < 1 << ngram_join.BAND_BITS


def test_links_survive_common_passages(spark):
    """Texts made of a few passages fill the same buckets; those that are similar must still be found."""
    rng = np.random.default_rng(3)
    how = ngram_join.Similarity(3, 80)
    passages = [[f"p{k}w{i}" for i in rng.integers(0, 10**6, 130)] for k in range(4)]
    texts = {}
    for d in range(60):
        words = [w for k in rng.permutation(4)[:2] for w in passages[k]] + [f"d{d // 3}w{i}" for i in range(120)]
        for at in rng.integers(0, len(words), int(rng.integers(0, 13))):
            words[at] = f"new{d}x{at}"
        texts[d] = " ".join(words)
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in texts:
        for e in range(d):
            if 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                low, high = sorted((find(d), find(e)))
                root[high] = low
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    buckets = ngram_join._buckets(ngram_join._signature_rows(docs, how))
    assert 0 < ngram_join._without_largest(buckets, how).count() < buckets.count()
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs, how).collect()}
    assert got == {d: find(d) for d in texts} and 1 < len(set(got.values())) < 60


def test_similar_groups_odd(odd, empty, texts):
    rows = ngram_join.similar_groups(odd).collect()
    assert len(rows) == len(texts) + 2
    assert [r.component_id for r in rows if r.doc_id is None] == [0]
    assert [r.component_id for r in rows if r.doc_id == 5] == [5]
    assert ngram_join.similar_groups(empty).count() == 0
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2)").count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root if find(k) != k}


# 4: urls
def test_urls(spark):
    urls = {
        "https://www.a.net/x": ("block", "net/"), "http://Example.NET/en/1?q": ("allow", "example.net/en/"), "http://example.com/de/": ("block", "example.com/de/"),
        "http://x.org/fr/a#b": ("allow", "org/fr/"), "http://notexample.com/de/x": ("allow", None), "http://a.net": ("allow", None), None: ("allow", None), "": ("allow", None),
        "no scheme casino": ("block", None), "http://a.com/casinos/": ("allow", None), "http://a.com/my-CASINO/": ("block", None), "http://a.com/free": ("allow", None),
        "http://a.com/free/free": ("allow", None), "http://a.com/free/bonus": ("block", None), "http://a.com/x://b.net/": ("allow", None), "http://spam-farm.com": ("block", None),
    }
    df = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.url: (r.verdict, r.rule) for r in url_filter.judge_urls(df).collect()}
    assert got == urls
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    one = url_filter.judge_urls(df.where("page_id = 14")).first()
    assert (one.host, one.path) == ("a.com", "/x://b.net/")


# 5: repeated strings
def brute_repeats(pairs):
    first, out = {}, {}
    for k, t in sorted(pairs):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
    for k, t in pairs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k] = (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def test_repeats(docs, texts, monkeypatch):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_repeats_in_pieces(spark):
    rng = random.Random(8)
    shared = [prose(rng, rng.randint(8, 60)) for _ in range(12)] + ["=" * 300]
    rows = []
    for k in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else prose(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 6))]
        t = rng.choice(["\n", " ", ""]).join(parts)
        cut = rng.randint(0, 30)
        rows.append((k, t[cut:] if rng.random() < 0.5 else t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)


def test_segments_sample_alike():
    rng = random.Random(4)
    text = (prose(rng, 700) + "a" * 200 + prose(rng, 300)).encode()
    whole = next(suffix_dedup.slices(iter([(1, text)])))
    want = dict(zip(whole.pos.tolist(), zip(whole.gram.tolist(), whole.ranks().tolist())))
    got = {}
    for s in suffix_dedup.slices(iter([(1, text)]), size=500):
        got |= dict(zip(s.pos.tolist(), zip(s.gram.tolist(), s.ranks().tolist())))
    assert got == want


def test_repeats_odd(odd, empty, texts):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(texts) + 2
    assert [bytes(r.kept) for r in rows if r.doc_id is None] == [b""]
    twice = [(r.n_removed, bytes(r.kept)) for r in rows if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    shared, lone = prose(rng, 40), [prose(rng, 25) for _ in range(8)]
    rows = [(1, shared), (None, prose(rng, 300) + shared), (None, lone[0] + shared[:90]), (None, shared[20:150] + lone[1]), (None, lone[2]), (None, lone[2])]
    rows += [(5, lone[3] * 4 + shared), (5, lone[4]), (5, shared[:70] + lone[5]), (5, shared[:70] + lone[5]), (5, None), (9, lone[6] + lone[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = {None: 1 << 62}
    # One row at a time beside those of other documents: rows of one document don't meet.
    want = []
    for k, t in rows:
        others = [(key.get(d, d), x) for d, x in rows if d != k]
        firsts = {}
        for d, x in others:
            b = (x or "").encode()
            for i in range(len(b) - 49):
                firsts[b[i : i + 50]] = min(firsts.get(b[i : i + 50], d), d)
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if firsts.get(b[i : i + 50], 1 << 63) < key.get(k, k):
                gone[i : i + 50] = True
        want.append((k or 0, len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    for how in ({}, {"max_broadcast": 0}):
        got = [(r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, **how).collect()]
        assert sorted(got) == sorted(want)


# 6: decontamination
def test_masks_hit_every_window():
    import itertools

    for n in (0, 1, 2):
        for wrong in itertools.combinations(range(13), n):
            assert any(not any(at + p in wrong for p in m) for m in decontaminate.MASKS for at in range(13 - m[-1]))


def test_overlaps(spark, odd, empty):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(400)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(7, 40))] for _ in range(12)]
    rows = []
    for k in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            part = list(rng.choice(items))
            at = rng.randint(0, max(0, len(part) - 13))
            part = part[at : at + rng.randint(7, 30)]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "SUB"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in part]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame([*rows, (None, "x"), (500, None), rows[0]], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(None, "a b"), (50, None), (51, "")], "item_id long, text string")
    want = {}
    for k, t in rows:
        words = WORD.findall(plain_lower(t))
        for i, item in enumerate(items):
            n = min(13, len(item))
            best = max((sum(0 <= s + j < len(words) and words[s + j] == item[j] for j in range(a, a + n)) for s in range(-len(item), len(words)) for a in range(len(item) - n + 1)), default=0)
            if best >= n - n * 2 // 13:
                want[k, i] = best
    found = {(r.doc_id, r.item_id): r.n_same for r in decontaminate.find_overlaps(docs, bench).collect()}
    # Windows of 13 words are all found; of shorter items those that a mask fits in.
    assert {p: n for p, n in found.items()}.items() <= want.items()
    assert all(p in found for p in want if len(items[p[1]]) >= 13)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, bench, max_broadcast=0).collect()} == set(found)
    kept = decontaminate.remove_overlapping(docs.withColumn("seed", F.lit(1)), bench)
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in found} | {None, 500}
    assert decontaminate.find_overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_overlaps(empty, bench).count() == 0


def test_overlaps_of_short_items(spark):
    rows, want, k = [], {}, 0
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in range(1, 14)]
    for n, text in items:
        words, allowed = text.split(), n * 2 // 13
        spots = [()] + [(j,) for j in range(n)] + [(j, j2) for j in range(n) for j2 in range(j)]
        for wrong in spots:
            body = ["other" if j in wrong else w for j, w in enumerate(words)]
            rows.append((k, " ".join(["lead", *body, "tail"])))
            if len(wrong) <= allowed:
                want[k, n] = (n - len(wrong), 1)
            k += 1
        rows += [(k, " ".join(words[1:])), (k + 1, " ".join(words[:-1])), (k + 2, " ".join(["x", *words, "y", *words]).upper())]
        if allowed:
            want[k, n], want[k + 1, n] = (n - 1, 0), (n - 1, 0)
        want[k + 2, n] = (n, 1)
        k += 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([*items, (50, ""), (51, None)], "item_id long, text string")
    for most in (1_000_000, 0):
        out = decontaminate.find_overlaps(docs, bench, max_broadcast=most).collect()
        assert {(r.doc_id, r.item_id): (r.n_same, r.doc_word) for r in out} == want and len(out) == len(want)


# 7: html
def test_html(spark):
    nav = "<nav><ul><li><a href=/x>Menu</a></li><li><a href=/y>More</a></li></ul></nav>"
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>" + nav
    page += "<div class='ad'>Buy this, now.</div><article><h1>Head &amp; line</h1><p><b>First  one,\n with words.<br><p>Second &lt;one&gt;, it has more words.</p>"
    page += "<ul><li>A point, of some length.</li></ul></article><!-- <p>x</p> --><div class='comments'><p>I liked it, thanks a lot. Really.</p></div><footer>&copy; us</footer></body></html>"
    other = "<body><div class=sidebar><p>Some words, in a row. Yes.</p></div><div id=content><p>" + "The text goes on, and on. " * 20 + "</p></div><form><p>Your name, please.</p></form>"
    rows = [(k, "u", page.replace("First", f"First {k}"), "t") for k in range(60)] + [(100, None, other, "t"), (101, "", None, None), (102, "", "", None), (103, "", "<p>cut <b>off</b> here." + " The text goes on, and on." * 20 + "</p><p cla", None), (None, "n", page, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = html_text.fit(df)
    got = html_text.extract(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {r.page_id: r for r in got.collect()}
    assert by[7].text == "Head & line\n\nFirst 7 one, with words.\n\nSecond <one>, it has more words.\n\nA point, of some length."
    assert by[7].n_chars == len(by[7].text)
    assert by[100].text == ("The text goes on, and on. " * 20).strip()
    assert by[101].text == by[102].text == "" and by[103].text == "cut off here." + " The text goes on, and on." * 20
    assert html_text.extract(df.limit(0), model).count() == 0
    alone = html_text.fit(df.limit(0))
    assert "Menu" not in alone.text(page) and "Second" in alone.text(page)


def test_names_are_learned(spark):
    """Nonsense names, with text that looks alike on both sides: only pages that mark their article tell them apart."""
    rng = random.Random(10)

    def words():
        return prose(rng, 40) + ", and so on."

    def page(article, mark):
        junk = "".join(f"<div class={c}><p>{words()}</p></div>" for c in ("zrk", "plonk"))
        return f"<body>{junk}<{mark} class=qqx><div class=vuum><p>{article}</p></div></{mark}><div class='zrk wibb'><p>{words()}</p></div></body>"

    rows = [(k, "u", page(words(), "article")) for k in range(80)]
    texts = {k: " ".join(words().split()) for k in range(100, 120)}
    rows += [(k, "u", page(t, "div")) for k, t in texts.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df, html_text.fit(df)).collect()}
    assert all(got[k] == t for k, t in texts.items())
    untrained = html_text.model_of({})
    assert all(untrained.text(html) != texts[k] for k, _, html in rows if k in texts)


def test_pages_overrule_priors():
    """A name that the lists call boilerplate is the article's on these pages, and the other way round."""
    body = "Words go on, and on. " * 12
    text = "\n\n".join([body.strip()] * 3)
    marked = f"<body><div class=story><p>{body}</p></div><div class=teaser><article>{f'<p>{body}</p>' * 3}</article></div></body>"
    asked = f"<body><div class=story><p>Not this. {body}</p></div><div class=teaser>{f'<p>{body}</p>' * 3}</div></body>"
    counts = Counter()
    for _ in range(200):
        counts.update(html_text.count_labels(marked))
    assert html_text.model_of(counts).text(asked) == text
    assert html_text.model_of({}).text(asked) == f"Not this. {body}".strip()


def test_labels_do_not_follow_the_lists():
    page = html_text.parse("<body><div class=ad>x</div><article><p>a</p><div class=ad><p>b</p></div><form>c</form></article><div class=content>d</div></body>")
    labels = html_text.own_labels(page)
    by = [(n.tag, n.words, y) for n, y in zip(page.nodes, labels)]
    assert by[2:] == [("div", ("ad",), False), ("article", (), True), ("p", (), True), ("div", ("ad",), None), ("p", (), None), ("form", (), None), ("div", ("content",), False)]


def test_messages_equal_enumeration():
    import itertools

    page = html_text.parse("<main><div class=ad><p>a, b.</p></div><section><h2>t</h2><p>" + "words, and words. " * 9 + "</p></section></main>")
    model = html_text.model_of({("state", True): 5, ("state", False): 5, ("tag=p", True): 4, ("tag=p", False): 1})
    n, t = len(page.nodes), model.child
    total = np.zeros((n, 2))
    import math

    for states in itertools.product((0, 1), repeat=n):
        w = model.root if states[0] else 1 - model.root
        for k, x in enumerate(page.nodes):
            o = math.exp(sum(model.weights.get(f, 0.0) for f in html_text.features(x)))
            w *= o if states[k] else 1
            if k:
                w *= 0.5 if page.nodes[x.parent].tag in html_text.TOP else t[states[x.parent]][states[k]]
        for k, s in enumerate(states):
            total[k, s] += w
    want = total[:, 1] / total.sum(axis=1)
    assert np.allclose(model.marginals(page), want)


# 8: language
def test_language(spark, empty):
    rng = random.Random(6)
    kinds = {"en": ["the", "and", "with", "this", "ing", "would"], "de": ["der", "und", "nicht", "schön", "über", "ung"], "fr": ["les", "dans", "être", "où", "ça", "que"]}
    rows = [(k, prose(rng, rng.randint(20, 60), kinds[lang]), lang) for k in range(600) for lang in [rng.choice(list(kinds))]]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34 !!", "en"), (1003, "q" * 50 + "zxzx " * 60, None), (None, "the with this", None), rows[0]]
    df = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, lang string, score string")
    model = language_id.fit(df)
    out = language_id.identify(df, model).collect()
    assert len(out) == len(rows)
    truth = {k: lang for k, _, lang in rows}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert not any(r.rejected for r in out if r.doc_id is not None and r.doc_id < 1000)
    assert all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].rejected
    none = language_id.fit(empty)
    assert language_id.identify(df, none).where("not rejected").count() == 0
    assert language_id.identify(empty, model).count() == 0


def test_rejection_is_by_row(spark):
    rng = random.Random(7)
    kinds = {"en": ["the", "and", "with", "this"], "de": ["der", "und", "nicht", "über"]}
    rows = [(k, prose(rng, 40, kinds[lang]), lang) for k in range(300) for lang in [rng.choice(list(kinds))]]
    clean = [(None, rows[0][1], None), (None, rows[1][1], None), (500, rows[2][1], None)]
    df = spark.createDataFrame([(*r, "p") for r in [*rows, *clean, (None, "", None), (None, None, None), (500, "12 !!", None)]], "doc_id long, text string, lang string, rejected string")
    out = corpus_pipeline.identify_language(spark, df, "")
    assert out.columns == df.columns and {r.rejected for r in out.collect()} == {"p"}
    got = [(r.doc_id or 0, r.text) for r in out.where("doc_id is null or doc_id = 500").collect()]
    assert sorted(got) == sorted((k or 0, t) for k, t, _ in clean)


def brute_kneser_ney(texts, width):
    """Interpolated Kneser-Ney as in textbooks, with dictionaries: a function (context, symbol) -> probability."""
    top = Counter()
    for t in texts:
        s = [0, 0, *language_id.symbols(t).tolist()]
        top.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    by = {4: top}
    for n in (3, 2, 1):
        by[n] = Counter(g[1:] for g in by[n + 1])
    cut = {}
    for n, c in by.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        cut[n] = once / (once + 2 * twice) if once else 0.5

    def p(context, symbol):
        n = len(context) + 1
        lower = p(context[1:], symbol) if n > 1 else 1 / width
        after = [v for g, v in by[n].items() if g[:-1] == context]
        if not after:
            return lower
        c = by[n].get((*context, symbol), 0)
        return max(c - cut[n], 0) / sum(after) + cut[n] * len(after) / sum(after) * lower

    return p


def tables_of(texts, width):
    import pandas as pd

    pdf = pd.concat(language_id._count(iter([pd.DataFrame({"lang": "x", "text": texts})])))
    high, low = pdf["high"].to_numpy(np.uint64), pdf["low"].to_numpy(np.uint64)
    columns = [(x >> np.uint64(k) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for x in (high, low) for k in (32, 0)]
    return language_id.kneser_ney(columns, pdf["n"].to_numpy(), width)


def test_probabilities_against_brute_force():
    rng = random.Random(8)
    learned = ["".join(rng.choice("abcd 日本") for _ in range(150)) for _ in range(8)]
    letters = sorted({0} | {c for t in learned for c in language_id.symbols(t).tolist()})
    width = len(letters) + 1
    p = brute_kneser_ney(learned, width)
    m = language_id.Model(["x"], [tables_of(learned, width)], width)
    for text in [*learned[:2], "abba dacd", "日本日 ab 本", "zzz a", "é"]:
        s = [0, 0, *language_id.symbols(text).tolist()]
        want = [-np.log(p(tuple(s[i : i + 3]), s[i + 3])) for i in range(len(s) - 3)]
        mean, variance, n = m.entropies([text])
        assert n[0] == len(want) and np.isclose(mean[0, 0], np.mean(want)) and np.isclose(variance[0, 0], np.var(want))
    # One probability mass over all letters seen and one that stands for all others.
    for context in [(0, 0, 0), (ord("a"), ord("b"), 0), (ord("z"), ord("z"), ord("日"))]:
        assert abs(sum(p(context, c) for c in [*letters, ord("z")]) - 1) < 1e-9


def test_slices_add_up(monkeypatch):
    texts = ["the cat sat on the mat " * 40, "", "a", "x y " * 30]
    m = language_id.Model(["x"], [tables_of(texts, 20)], 20)
    whole = m.entropies(texts)
    monkeypatch.setattr(language_id, "SLICE", 7)
    assert all(np.allclose(a, b) for a, b in zip(whole, m.entropies(texts)))


def test_scripts_with_many_letters(spark):
    """Two languages over thousands of letters each, of which a third are shared: no letter is folded."""
    rng = random.Random(9)
    letters = {"zh": range(0x4E00, 0x4E00 + 3000), "ja": range(0x4E00 + 2000, 0x4E00 + 5000)}
    # Texts of single shared letters, told apart by which of them follow each other.
    shared = [chr(c) for c in range(0x4E00 + 2000, 0x4E00 + 3000)]

    def text(lang):
        pairs = [a + b for a, b in zip(shared, shared[1:] if lang == "zh" else shared[7:])]
        return "".join(rng.choice(pairs) if rng.random() < 0.8 else chr(rng.choice(letters[lang])) for _ in range(80))

    rows = [(k, text(lang), lang) for k in range(900) for lang in [rng.choice(["zh", "ja"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.width > 3000
    truth = {k: lang for k, _, lang in rows}
    held = [r for r in language_id.identify(df, model).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_sample_of_labelled_rows(spark):
    rows = [(k, f"text {k}", "en" if k % 3 else "de") for k in range(900)] + [(5, "again", "en"), (None, "no id", "en"), (901, "unlabelled", None), (902, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.labelled_sample(df, 40).collect()
    assert Counter(r.lang for r in got) == {"en": 40, "de": 40}
    ranked = language_id._ranked(df).select("doc_id", "lang", "h").distinct().collect()
    for lang in ("en", "de"):
        want = sorted((r.h, r.doc_id) for r in ranked if r.lang == lang)[:40]
        assert {r.doc_id for r in got if r.lang == lang} <= {k for _, k in want}


# 2 and 9: tokenizers
def test_tokenizers_are_checked(tmp_path):
    import json

    from echoline.llm import pieces

    byte, word = (json.load(open(public_tokenizers.path(f"{n}.json"))) for n in ("byte_bpe_50k", "word_bpe_49k"))

    def load(base, **changed):
        path = tmp_path / "t.json"
        path.write_text(json.dumps({**base, **changed}))
        return pieces.load_tokenizer(str(path))

    pieces.check_decoding(load(byte))
    pieces.check_lowering(load(word))
    level = byte["pre_tokenizer"]
    swallows = {"type": "Split", "pattern": {"Regex": r" ?[^\s\p{L}\p{N}]+[\r\n]*|\s+|\S+"}, "behavior": "Isolated", "invert": False}
    bad = [
        {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [swallows, {**level, "use_regex": False}]}},
        {"pre_tokenizer": {**level, "add_prefix_space": True}},
        {"pre_tokenizer": {**level, "use_regex": False}},
        {"pre_tokenizer": None},
        {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}},
        {"normalizer": word["normalizer"]},
        {"added_tokens": [{**byte["added_tokens"][0], "lstrip": True}]},
        {"added_tokens": [{**byte["added_tokens"][0], "content": "two words", "special": True}]},
        {"model": {**byte["model"], "dropout": 0.1}},
    ]
    for change in bad:
        with pytest.raises(pieces.UnknownTokenizer):
            load(byte, **change)
    with pytest.raises(pieces.UnknownTokenizer):
        pieces.check_decoding(load(word))
    with pytest.raises(pieces.UnknownTokenizer):
        pieces.check_lowering(load(byte))


# 9: id files
def test_id_files(spark, docs, odd, empty, texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, _ = brute_bpe(texts, "word_bpe_49k.json")
    id_files.write_ids(docs, path, f"{tmp_path}/a", block_ids=100, wave=8)
    start, want = 0, {}
    for k, x in enumerate(ids):
        x = [*x, 2]
        want[k] = (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in id_files.document_sums(spark, f"{tmp_path}/a").collect()}
    assert got == want
    id_files.write_ids(odd, path, f"{tmp_path}/b")
    rows = id_files.document_sums(spark, f"{tmp_path}/b").collect()
    assert len(rows) == len(texts) + 2 and [r.start for r in rows if r.doc_id is None] == [0]
    id_files.write_ids(empty, path, f"{tmp_path}/c")
    assert id_files.document_sums(spark, f"{tmp_path}/c").count() == 0


def test_id_files_keep_what_lowering_would_change(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = ["x <|ENDOFTEXT|> y", "x<|EndOfText|>Y <|endoftext|> <|STARTOFTEXT|>", "H\u0331 T\u0308 W\u030a Y\u030a J\u030c", "J\u0323\u030cA h\u0331A\u0301", "İI\u0307 ΑΣ ΑΣA \u212aK\u2003<|ENDOFTEXT|>\u2003T\u0308X", "A B\x1c<|ENDOFtext|> C"]
    ids, _ = brute_bpe(own, "word_bpe_49k.json")
    id_files.write_ids(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), path, f"{tmp_path}/d")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in id_files.document_sums(spark, f"{tmp_path}/d").collect()}
    assert got == {k: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for k, x in enumerate(ids)}


def test_blocks():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, int(rng.integers(0, 300))) % 49408 for _ in range(80)] + [np.tile([5, 7, 0, 1], 80), np.array([id_coder.MAX_ID, 0, 1, 65535, 65536]), np.zeros(0, np.int64)]
    coded = id_coder.encode_blocks(blocks)
    back = id_coder.decode_blocks(coded, [len(b) for b in blocks])
    assert all((x == y).all() for x, y in zip(blocks, back))
    alone = id_coder.decode_blocks([coded[80]], [320])
    assert (alone[0] == blocks[80]).all() and len(coded[80]) < 160
    pieces = np.array([(0, 7, 1, 1, 320)], id_files.PIECE)
    block = id_files.pack(pieces, 320, coded[80])
    assert id_files.unpack(block)[2] == coded[80]
    for at in (0, 5, 9, len(block) - 1):
        with pytest.raises(id_files.DamagedBlock):
            id_files.unpack(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])


def test_joined_crc():
    a, b = b"hello" * 7, b"world!" * 31
    assert id_files.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert id_files.crc_joined(0, zlib.crc32(b), len(b)) == zlib.crc32(b)
    assert hashlib.sha256(a).digest() != hashlib.sha256(b).digest()


def test_words_of_a_text_are_hashed_at_once():
    texts = ["", "  ", "ab", "ab ba  ab abab a\x00 a a\x00\x00 ", " " + " ".join(str(k) for k in range(5000)), "é é\x85 x" + "y" * 300]
    known = {}
    for text in texts:
        words = [w for w in text.encode().split(b" ") if w]
        hashes = ngram_join._word_hashes(text.encode()).tolist()
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_go_to_the_model(name):
    """What the model alone makes of a word, and of a word and its tail, is what the tokenizer makes of the piece."""
    from echoline.llm import pieces

    rng = random.Random(3)
    letters, tails = "aeinrstthouAEINR" + "ßàéêñöüÿÀÉÊÑÖÜÞ", pieces.TAIL
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(800)] + ["the", "s", "ll", "d", "re", "x" * 700, "É" * 300]
    made = [rng.choice(["", " "]) + w + "".join(rng.choice(tails) for _ in range(rng.choice([0, 0, 1, 3]))) for w in words]
    odd = ["don't", "a's.", "  a", "\na", "(a", "a1", "a,b", "éa", "İ", "ª", "×a", "a÷", "a'", ".", "", "<|endoftext|>", "a<|endoftext|>", " a "]
    encoder = pieces.PieceEncoder(public_tokenizers.path(name), lambda ids, _: [tuple(x) for x in ids], lambda parts: sum(parts, ()), 100)
    whole, seen = encoder._whole, set()
    encoder._whole = lambda part: seen.update(part) or whole(part)
    for _ in range(2):
        got = encoder.lookup({*made, *odd})
        for p in {*made, *odd}:
            assert got[p] == tuple(encoder.tokenizer.encode(p, add_special_tokens=False).ids), p
    direct = {p for p in made if not p.startswith(" ") or name.startswith("byte")}
    assert not seen & {p for p in direct if p[-1] not in tails} and len(direct) > 300
    assert len({p for p in seen - set(odd) if len(p) > 3} & direct) == 0


def test_added_tokens_of_letters_need_the_whole_tokenizer():
    from tokenizers import AddedToken

    from echoline.llm import pieces

    t = pieces.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.direct_pieces(t)
    t.add_tokens([AddedToken("hea", normalized=False)])
    assert pieces.direct_pieces(t) is None


def test_blocks_are_decoded_a_wave_at_a_time(spark, docs, texts, tmp_path):
    """However many blocks a batch of the files has, a task holds a wave's; sums are made where they are decoded."""
    path = public_tokenizers.path("word_bpe_49k.json")
    id_files.write_ids(docs, path, f"{tmp_path}/w", block_ids=50)
    want = {(r.part, r.number, r.block, r.at): (r.doc_id, r.n, r.last, zlib.crc32(r.ids)) for r in id_files.read_ids(spark, f"{tmp_path}/w").collect()}

    def make(ids):
        import inspect

        decoded = inspect.currentframe().f_back.f_back.f_locals["decoded"]
        assert len(decoded) <= 3
        return zlib.crc32(ids)

    got = id_files._read_pieces(spark, f"{tmp_path}/w", make, id_files.pa.int64(), "crc long", wave=3).collect()
    assert {(r.part, r.number, r.block, r.at): (r.doc_id, r.n, r.last, r.crc) for r in got} == want
    assert len(want) > 100
    plan = id_files.document_sums(spark, f"{tmp_path}/w")._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1
