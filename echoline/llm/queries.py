"""The registered queries of this subpackage: thin callers of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.llm import bpe_reuse, chat_format, collocations, decontaminate, html_text, id_files, language_id, line_dedup, ngram_join
from echoline.llm import period_runs, quality_rules, suffix_dedup, url_filter
from echoline.llm.common import scratch_path, table, words_of

BYTE_BPE, WORD_BPE, BYTE_RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op2_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_reuse.digest_documents(docs, public_tokenizers.path(BYTE_BPE))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), ngram_join.Similarity(words=3, percent=90))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("url")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), path)
    return id_files.document_sums(spark, path)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations")
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string").coalesce(1)
    path, files = scratch_path(spark, "chat"), (public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    chat_format.format_conversations(turns.unionByName(added), *files, path)
    return chat_format.digest_conversations(spark, path, *files)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every tenth document (by crc32 of doc_id) recur with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(F.col("h") % 10 == 0, words_of(F.col("text"))).alias("w"))
    planted = planted.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    planted = planted.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i >= a, a + (i - a) % p, i) as int)]), ' ')")
    return planted.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


BEST_RUN = """get(array_sort(runs, (x, y) -> CASE
  WHEN x.length * y.period > y.length * x.period THEN -1 WHEN x.length * y.period < y.length * x.period THEN 1
  WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1
  WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END), 0)"""


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.find_runs(repeat_tails(table(spark, sf_dir, "documents"))).withColumn("best", F.expr(BEST_RUN))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = collocations.mine_phrases(table(spark, sf_dir, "documents"))
    return collocations.best_of_each(phrases).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe_reuse": op2_bpe_reuse,
    "op3_ngram_join": op3_ngram_join,
    "op4_url_filter": op4_url_filter,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_html_text": op7_html_text,
    "op8_language_id": op8_language_id,
    "op9_id_files": op9_id_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_period_runs": op12_period_runs,
    "op13_collocations": op13_collocations,
}
