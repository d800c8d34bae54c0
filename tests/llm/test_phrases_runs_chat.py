"""Chat formatting, periodic runs and collocations: brute-force versions and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from echoline.llm import chat_format, collocations, period_runs
from echoline.llm.double_array import DoubleArray
from echoline.llm.queries import BYTE_RANKS, QUERIES

SF = "/root/testdata/sf0.001"
FILES = (public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
TURNS = "conv_id long, turn long, role string, text string, ids string, piece long, whole string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- chat formatting


def test_escapes_are_reversible():
    t, rng = chat_format.Template(), random.Random(3)
    parts = [*t.controls, "<", "[", "\\", "/", "]", "INST]", "/s>", " x", "[\\", "<\\\\/s>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        escaped = t.escape(text)
        assert t.unescape(escaped) == text
        assert not any(c in escaped for c in t.controls)
    with pytest.raises(ValueError):
        chat_format.Template(roles=(("user", "[A]", "x[A]"),))


def formatted(spark, rows, tmp_path, parts, name):
    df = spark.createDataFrame(rows, TURNS).repartition(parts)
    out = str(tmp_path / name)
    chat_format.format_conversations(df, *FILES, out)
    return out, {r.conv_id: tuple(r)[1:] for r in chat_format.digest_conversations(spark, out, *FILES).collect()}


def brute_chat(rows):
    t, wanted = chat_format.Template(), {}
    around = {role: len(a + b) for role, a, b in t.roles}
    key = lambda r: [(x is not None, x or 0 if k < 2 else x or "") for k, x in enumerate(r[:4])]
    for conv, _, role, text in sorted((r[:4] for r in rows), key=key):
        role, text = role or "", text or ""
        w = wanted.setdefault(conv, [0, "", "", 0])
        w[0] += 1
        w[1] += f"{role}\n{text}\n"
        w[2] += text if role == "assistant" else ""
        w[3] += len(t.escape(text)) + (around[role] if role in around else len("".join(t.named)) + len(t.escape(role)))
    return {c: (n, sha(turns), len(loss), sha(loss), chars) for c, (n, turns, loss, chars) in wanted.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_chat_edge_cases(spark, tmp_path, parts):
    own = ("x", 1, "y")
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]", *own), (1, 1, "assistant", "a [\\INST] b <\\/s>", *own), (1, 1, "assistant", "a [\\INST] b <\\/s>", *own),
        (2, None, None, None, *own), (2, 0, "assistant", "", *own), (2, 3, "tool [ROLE]", "größer 😀\n", *own), (2, 4, "", "x", *own),
        (None, 0, "user", "no id", *own), (None, 1, "assistant", "none", *own),
        (3, 0, "assistant", " " * 30_000 + "x" * 40_000, *own), (4, 0, "system", "\x00 ", *own),
    ]
    _, got = formatted(spark, rows, tmp_path, parts, "odd")
    assert got == brute_chat(rows)
    _, none = formatted(spark, [], tmp_path, parts, "none")
    assert none == {}


def test_chat_long_conversation_is_dealt_out(spark, tmp_path):
    rng = random.Random(5)
    rows = [(9, k, rng.choice(["user", "assistant"]), " ".join(rng.choice(["word", "thing", "[INST]"]) for _ in range(400)), "", 0, "") for k in range(500)]
    rows += [(k, 0, "user", "hello", "", 0, "") for k in range(20, 60)]
    out, got = formatted(spark, rows, tmp_path, 6, "long")
    assert got == brute_chat(rows)
    pieces = chat_format.read_pieces(spark, out)
    assert pieces.where("conv_id = 9").count() > 3
    start = 0
    for r in pieces.where("conv_id = 9").orderBy("piece").collect():
        assert r.start == start and len(r.ids) == len(r.loss_mask) and not r.whole
        start += len(r.ids)


# ---------------------------------------------------------------- periodic runs


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_agree_with_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            k = rng.choice([1, 2, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 7))]
            texts.append(w[:10] + unit * rng.randint(0, 8) + unit[: rng.randint(0, len(unit))] + w[10:])
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        want = [(s + int(a), n, q) for a, t in zip(starts, texts) for s, n, q in brute_runs(t)]
        assert period_runs.runs_of(np.array([x for t in texts for x in t], np.int64), starts) == want


def test_runs_edge_cases(spark):
    texts = [None, "", " \n\t", "a " * 5, "a " * 6, "x y x y x y x y", ("a b c " * 4) + "a b", "Is " * 40_000, "a b c d " * 3, "z\x85z " * 9]
    rows = [(k, t, "r", 1, "c") for k, t in enumerate(texts)] + [(None, "a " * 7, "r", 1, "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long, collapsed string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in period_runs.find_runs(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = brute_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        want.append((k, len(w), runs, collapsed(w, runs)))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0))
    assert period_runs.find_runs(df.limit(0)).count() == 0


def test_run_query_against_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op12_period_runs"](spark, SF).collect()}
    planted = 0
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            planted += 1
        runs = brute_runs(words) if n < 3000 else period_runs.runs_of(np.unique(words, return_inverse=True)[1].astype(np.int64), np.array([0, n]))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = got.pop(doc_id)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (None if best is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(words, runs))
    assert not got and planted


# ---------------------------------------------------------------- collocations


def test_double_array_finds_all_keys():
    rng = np.random.default_rng(2)
    for most, words, size in ((5, 2, 12), (70, 3, 400), (5000, 2, 6000), (300, 4, 5000)):
        text = rng.integers(0, most + 1, 30_000, dtype=np.int64).astype(np.int32)
        text[rng.random(len(text)) < 0.5] = rng.integers(1, 4)
        grams = np.stack([text[i : len(text) - words + 1 + i] for i in range(words)], axis=1)
        keys = np.unique(grams[(grams > 0).all(axis=1)], axis=0)
        keys = keys[rng.permutation(len(keys))[:size]]
        at, found = DoubleArray.build(keys, most).walk(text)
        wanted = set(map(tuple, keys.tolist()))
        assert at.tolist() == [i for i, g in enumerate(grams.tolist()) if tuple(g) in wanted]
        trie = DoubleArray.build(keys, most)
        assert (trie.keys[found] == grams[at]).all()


def brute_phrases(rows, least):
    counts, totals = {}, Counter()
    for lang, text in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, 5):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in counts.items():
        good = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        longer = Counter()
        for p, f in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], f)
        for p, a in good.items():
            if 100 * longer[p] >= 80 * a and longer[p]:
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            out.add((lang, " ".join(p), a, left, right, totals[lang], score))
    return out


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(8)
    words = ["New", "york", "CITY", "äther", "x y", "the", "of", "a", "b\x85", "\x1c"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",\t", "\n"]) for _ in range(rng.randint(0, 80)))) for _ in range(60)]
    return rows + [("en", None), ("en", ""), ("de", "  \t\n.,"), ("en", "new york city " * 5000), *[("en", "the the the the the")] * 6]


@pytest.mark.parametrize("block", [None, 7])
def test_phrases_agree_with_brute_force(spark, phrase_rows, monkeypatch, block):
    if block:
        monkeypatch.setattr(collocations, "BLOCK", block)
        monkeypatch.setattr(collocations, "HELD", 10)
        monkeypatch.setattr(collocations, "WINDOW", 13)
    rows = phrase_rows if not block else [r for r in phrase_rows[:25] if r[1]]
    df = spark.createDataFrame([(k, *r, "f", 1) for k, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    got = collocations.mine_phrases(df, least=6).collect()
    assert {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute_phrases(rows, 6)
    assert len(got) == len(set(got))


def test_best_of_each_breaks_ties_by_bytes(spark):
    rows = [("en", p, 30, 40, 40, 9, 5) for p in ("b", "a", "é", "z", "a b")] + [("fr", "q", 31, 40, 40, 9, 5), ("en", "y", 31, 40, 40, 9, 5), ("en", "w", 30, 40, 40, 9, 6)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = sorted((r["rank"], r.phrase) for r in collocations.best_of_each(df, top=5).where("lang = 'en'").collect())
    assert got == [(1, "w"), (2, "y"), (3, "a"), (4, "a b"), (5, "b")]


def test_no_texts_no_phrases(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.best_of_each(collocations.mine_phrases(df)).count() == 0
    assert spark.createDataFrame([("x",)], "a string").select(F.lit(1)).count() == 1


def test_shards_hand_on_arrays(spark, monkeypatch):
    """What passes over the texts give off is a row an array, not one a shard and phrase."""
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcdefghijklmnop") for _ in range(400))) for _ in range(80)]
    made, arrow_map = {}, collocations.arrow_map

    def counting(df, fn, schema):
        seen = made.setdefault(schema, spark.sparkContext.accumulator(0))

        def run(batches):
            for batch in fn(batches):
                seen.add(batch.num_rows)
                yield batch

        return arrow_map(df, run, schema)

    monkeypatch.setattr(collocations, "arrow_map", counting)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 2000)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    got = collocations.mine_phrases(df, least=6, longest=2).collect()
    assert {r.phrase: r.a for r in got} == Counter(f"{a} {b}" for _, text in rows for a, b in zip(text.split(), text.split()[1:]))
    assert made["w1 int, w2 int"].value == 256 and made["w1 int, w2 int, f long"].value == 256  # each phrase once, though every shard has all
    assert not any(schema.endswith(", n long") and "w2" in schema for schema in made)
