"""URL filter: allow and block rules for hosts, and a weighted vocabulary.

Rules are plain column expressions.  A url that no rule fits is judged by the
vocabulary: an Aho-Corasick automaton finds all terms in one pass; a hit counts
if no letter or digit touches it; a url is rejected if the weights of the
distinct terms found reach the threshold, which one strict term does alone and
soft terms only together.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import ascii_lower, ship_package

# The default vocabulary and host rules.
STRICT_TERMS = ("casino", "escort", "hentai", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT_TERMS = ("adult", "bet", "bonus", "cheap", "crack", "dating", "download", "free", "jackpot", "keygen", "loan", "nude", "pharmacy", "pills", "poker", "serial", "sex", "torrent", "win")
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SOFT_HITS = 2


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        a.add_word(t, (k, len(t)))
    a.make_automaton()
    return a


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def terms_found(url: str, terms: tuple[str, ...]) -> set[int]:
    """Numbers of the terms that occur in the url with no ASCII letter or digit on either side."""
    found = set()
    for end, (k, n) in _automaton(terms).iter(url):
        if (end == n - 1 or not _plain(url[end - n])) and (end + 1 == len(url) or not _plain(url[end + 1])):
            found.add(k)
    return found


def vocabulary_hits(url: Column, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS) -> Column:
    """struct(strict, soft): how many distinct terms of each kind a url holds; A-Z match a-z."""
    terms = (*strict, *soft) or ("\0",)

    @F.pandas_udf("strict int, soft int")
    def count(urls: pd.Series) -> pd.DataFrame:
        found = [terms_found(u, terms) if u else () for u in urls]
        first = [sum(k < len(strict) for k in x) for x in found]
        return pd.DataFrame({"strict": first, "soft": [len(x) - n for x, n in zip(found, first)]})

    return count(ascii_lower(url))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    safe = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(safe, pattern, 1)), F.regexp_extract(safe, pattern, 2)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none.  Of rules of one length the first wins."""
    name = verdict = None
    for rule, what in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Per row: page_id, url, host, path, rule, strict_hits, soft_hits, verdict (allow or block).

    Null, empty and malformed urls have an empty host and path, fit no rule and are allowed unless
    the vocabulary rejects their text.  Repeated rows are judged each; other columns aren't looked at.
    """
    ship_package(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"), vocabulary_hits(F.col("url"), strict, soft).alias("v"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    weight = F.col("v.strict") * soft_hits + F.col("v.soft")
    own = F.when(weight >= soft_hits, "block").otherwise("allow")
    return split.select(
        "page_id", "url", "host", "path", name.alias("rule"), F.col("v.strict").alias("strict_hits"), F.col("v.soft").alias("soft_hits"),
        F.coalesce(verdict, own).alias("verdict"),
    )
