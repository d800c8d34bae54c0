"""``interactions`` view over the driver's TPC-H-like tables.

Author *a* = supplier, exposed user *b* = customer, one row per lineitem.
The column expressions are plain SQL valid in Spark and DuckDB once the two
macros ``{EPOCH(..)}`` and the post time are substituted, so the Spark view
and the oracle CTE are defined by the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TS = "({epoch_orderdate} + l.l_partkey % 86400)"
_G = "o.o_custkey % 13 <> 0"

# --- fixed values: the fixture definition (column -> SQL expression) ---
_COLUMNS = [
    ("tokens", "replace(trim(repeat(concat(p.p_name, ' '), CAST(l.l_linenumber AS INT))), ' ', chr(9))"),
    ("hashtags", "CASE WHEN p.p_size % 3 = 0 THEN NULL ELSE replace(p.p_name, ' ', chr(9)) END"),
    ("tweet_id", "upper(md5(concat('t', CAST(l.l_suppkey AS STRING), '-', CAST(l.l_orderkey AS STRING))))"),
    ("medias", "CASE p.p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Photo' WHEN 2 THEN concat('Photo', chr(9), 'Photo') "
               "WHEN 3 THEN 'Video' ELSE concat('GIF', chr(9), 'Photo') END"),
    ("links", "CASE WHEN l.l_partkey % 4 = 0 THEN NULL ELSE upper(md5(CAST(l.l_partkey % 50 AS STRING))) END"),
    ("domains", "CASE WHEN l.l_partkey % 4 = 0 THEN NULL ELSE p.p_brand END"),
    ("type", "CASE substr(o.o_orderpriority, 1, 1) WHEN '2' THEN 'Retweet' WHEN '3' THEN 'Quote' "
             "WHEN '4' THEN 'Reply' ELSE 'TopLevel' END"),
    ("language", "upper(md5(CAST(c.c_nationkey AS STRING)))"),
    ("ts", "CAST({TS} AS BIGINT)"),
    ("a_user_id", "upper(md5(CAST(l.l_suppkey AS STRING)))"),
    ("a_follower_count", "CAST((l.l_suppkey * 137) % 1500 AS BIGINT)"),
    ("a_following_count", "CAST((l.l_suppkey % 7) * 100 AS BIGINT)"),
    ("a_is_verified", "l.l_suppkey % 5 = 0"),
    ("a_account_creation", "CAST(631152000 + l.l_suppkey * 86400 AS BIGINT)"),
    ("b_user_id", "upper(md5(CAST(o.o_custkey AS STRING)))"),
    ("b_follower_count", "CAST(floor(abs(c.c_acctbal)) AS BIGINT)"),
    ("b_following_count", "CAST((o.o_custkey % 11) * 50 AS BIGINT)"),
    ("b_is_verified", "o.o_custkey % 9 = 0"),
    ("b_account_creation", "CAST(631152000 + o.o_custkey * 3600 AS BIGINT)"),
    ("a_follows_b", "l.l_linestatus = 'F'"),
    ("reply_ts", "CAST(CASE WHEN {G} AND l.l_tax >= 0.07 THEN {TS} + CAST(l.l_quantity AS BIGINT) * 60 END AS BIGINT)"),
    ("retweet_ts", "CAST(CASE WHEN {G} AND l.l_discount >= 0.09 THEN {TS} + CAST(l.l_quantity AS BIGINT) * 86400 END AS BIGINT)"),
    ("retweet_comment_ts", "CAST(CASE WHEN {G} AND l.l_quantity <= 2 THEN {TS} + 7200 END AS BIGINT)"),
    ("like_ts", "CAST(CASE WHEN {G} AND l.l_quantity >= 30 THEN {TS} + 600 END AS BIGINT)"),
]
# Synthetic, tie-rich score for metric queries (never exactly 0 or 1).
_SCORE = "round(0.05 + 0.9 * ((l.l_partkey * 31 + l.l_suppkey * 17) % 97) / 97.0, 2)"
# --- end of fixed values ---

_FROM = (
    "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
    "JOIN customer c ON o.o_custkey = c.c_custkey "
    "JOIN part p ON l.l_partkey = p.p_partkey"
)

_EPOCH = {
    "spark": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o.o_orderdate)",
    "duckdb": "CAST(epoch(o.o_orderdate) AS BIGINT)",
    "spark_pre": "o.o_epoch",
}

INTERACTION_COLS = [name for name, _ in _COLUMNS]


def _render(expr: str, dialect: str) -> str:
    ts = _TS.format(epoch_orderdate=_EPOCH[dialect])
    out = expr.replace("{TS}", ts).replace("{G}", _G)
    if dialect == "spark_pre":
        out = out.replace("{epoch}", "o.o_epoch")
    if dialect == "duckdb":
        out = out.replace("AS STRING)", "AS VARCHAR)")
    return out


def select_list(dialect: str, with_score: bool = False) -> str:
    items = [f"{_render(e, dialect)} AS {n}" for n, e in _COLUMNS]
    if with_score:
        items.append(f"CAST({_SCORE} AS DOUBLE) AS score")
    return ",\n  ".join(items)


def interactions_sql(dialect: str = "duckdb", with_score: bool = False) -> str:
    """SELECT producing the interactions view over the base tables."""
    return f"SELECT\n  {select_list(dialect, with_score)}\nFROM {_FROM}"


def interactions_cte(with_score: bool = False) -> str:
    """``WITH interactions AS (...)`` prefix for DuckDB oracle queries."""
    return f"WITH interactions AS (\n{interactions_sql('duckdb', with_score)}\n)\n"


# Spark-side placement: what a single table decides is computed on its rows, narrow and before
# the joins (same values); ids of rows and users are hashed after them, so no join moves them.
_PLACED = {
    "l.l_tax >= 0.07": "l.l_replied",
    "l.l_discount >= 0.09": "l.l_retweeted",
    "l.l_linestatus = 'F'": "l.l_follows",
    "substr(o.o_orderpriority, 1, 1)": "o.o_first",
    "upper(md5(CAST(c.c_nationkey AS STRING)))": "c.c_lang",
    "upper(md5(CAST(l.l_partkey % 50 AS STRING)))": "p.p_links",
}


def _placed(expr: str) -> str:
    for old, new in _PLACED.items():
        expr = expr.replace(old, new)
    return _render(expr, "spark_pre")


def load_tables(spark: SparkSession, sf_dir: str, names=("lineitem", "orders", "customer", "part")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' columns side by side.  Joins are shuffled on their keys (or
    broadcast by AQE from measured sizes); unused columns are pruned at the
    Parquet scan because the projection below is declarative.  Orders meet
    customers before line items: line items are moved twice, by order and by part."""
    t = load_tables(spark, sf_dir)
    c = t["customer"].selectExpr("c_custkey", "c_acctbal", "upper(md5(CAST(c_nationkey AS STRING))) AS c_lang").alias("c")
    p = t["part"].selectExpr("p_partkey", "p_name", "p_size", "p_brand",
                             "upper(md5(CAST(p_partkey % 50 AS STRING))) AS p_links").alias("p")
    # post-time base per order, computed once per order (zone-free for NTZ)
    o = t["orders"].selectExpr("o_orderkey", "o_custkey", "substr(o_orderpriority, 1, 1) AS o_first",
                               "unix_date(to_date(o_orderdate)) * 86400 + hour(o_orderdate) * 3600 "
                               "+ minute(o_orderdate) * 60 + CAST(second(o_orderdate) AS BIGINT) AS o_epoch").alias("o")
    l = t["lineitem"].selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax >= 0.07 AS l_replied",
                                 "l_discount >= 0.09 AS l_retweeted", "l_linestatus = 'F' AS l_follows").alias("l")
    oc = o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey"))
    return (l.join(oc, F.col("l.l_orderkey") == F.col("o.o_orderkey"))
             .join(p, F.col("l.l_partkey") == F.col("p.p_partkey")))


def interactions(spark: SparkSession, sf_dir: str, with_score: bool = False) -> DataFrame:
    """The interactions DataFrame."""
    exprs = [f"{_placed(e)} AS {n}" for n, e in _COLUMNS]
    if with_score:
        exprs.append(f"CAST({_SCORE} AS DOUBLE) AS score")
    return _joined(spark, sf_dir).selectExpr(*exprs)


def raw_interactions(spark: SparkSession, sf_dir: str, names: list[str], made: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Column]]:
    """The interactions before their columns are made: the raw columns that ``names`` come from, and for each name
    its expression over them.  Columns in ``made`` are made already.  A query that moves, sorts or groups
    rows moves these instead of ids and token lists, which are several times as wide."""
    exprs = {n: re.sub(r"\b[locp]\.(?=[locp]_)", "", _placed(e)) for n, e in _COLUMNS if n in names}
    raw = sorted({c for n, e in exprs.items() if n not in made for c in re.findall(r"\b[locp]_\w+", e)})
    rows = _joined(spark, sf_dir).selectExpr(*[f"{exprs[n]} AS {n}" for n in exprs if n in made], *raw)
    return rows, {n: F.col(n) if n in made else F.expr(e) for n, e in exprs.items()}
