"""The registered queries on the smallest tables, and the pipeline against a brute-force version."""

import hashlib
import os
import subprocess
import sys

import duckdb
import pytest

from echoline.llm import language_id
from echoline.llm.queries import QUERIES
from echoline.llm.sql import ORACLE_SQL
from tests.llm.test_small import WORD, brute_bpe, brute_groups, brute_lines, plain_lower

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def brute_overlapping(pairs, items):
    out = set()
    for k, t in pairs:
        words = WORD.findall(plain_lower(t))
        places = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        for item in items:
            n = min(13, len(item))
            shifts = {i - j for j, w in enumerate(item) for i in places.get(w, ())}
            for s in shifts:
                same = [0 <= s + j < len(words) and words[s + j] == w for j, w in enumerate(item)]
                if n and any(sum(same[a : a + n]) >= n - n * 2 // 13 for a in range(len(item) - n + 1)):
                    out.add(k)
                    break
    return out


def test_pipeline(spark):
    import corpus_pipeline

    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in language_id.identify(docs, language_id.fit(docs)).where("rejected").collect()}
    pairs = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    lines = brute_lines(pairs)
    pairs = [(k, lines[k][2]) for k, _ in pairs]
    groups = brute_groups(pairs, 5, 80)
    pairs = [(k, t) for k, t in pairs if groups[k][1] == k]
    items = [WORD.findall(plain_lower(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = brute_overlapping(pairs, items)
    pairs = [(k, t) for k, t in pairs if k not in bad]
    ids, _ = brute_bpe([t for _, t in pairs], "byte_bpe_50k.json")
    assert got == {k: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for (k, _), x in zip(pairs, ids)}
    assert bad and len(got) > 100


def test_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_rest_works_without_this_package():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('echoline.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print('LEFT', len(e.queries()), any(q.startswith('op') for q in e.queries()), 'pipeline' in e.oracle_sql())\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
    assert "LEFT 87 False False" in out.stdout, out.stdout + out.stderr[-500:]
