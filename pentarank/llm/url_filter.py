"""URL filter: host and path rules first, then a weighted vocabulary.

The vocabulary is searched by one Aho-Corasick automaton per Python worker. A term counts
where neither neighbour is a letter or digit of ASCII. Each distinct term adds its weight
once; a url is blocked when the sum reaches ``LIMIT``. Strict terms weigh the whole limit,
soft ones half of it, so one strict or two distinct soft terms block.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentarank.llm.common import lower_ascii

LIMIT = 1.0
STRICT = 1.0
SOFT = 0.5
STRICT_TERMS = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "warez", "xxx")
SOFT_TERMS = (
    "ads", "bet", "bets", "bonus", "cheap", "click", "coupon", "dating", "deal", "free", "gambling",
    "hot", "jackpot", "loan", "nude", "pills", "poker", "promo", "sex", "slots", "spam", "torrent", "track", "win",
)
VOCABULARY = {**dict.fromkeys(STRICT_TERMS, STRICT), **dict.fromkeys(SOFT_TERMS, SOFT)}
ALNUM = frozenset(string.ascii_lowercase + string.digits)


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host_col: Column, path_col: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule; both NULL when none fits.

    ``rules`` are ``(verdict, "host/path")``. A rule fits its host and all subdomains when
    the url's path starts with the rule's path. Of equally long rules the first listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1]), reverse=True)[::-1]:
        name, _, rest = text.partition("/")
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def _hits(url: str, automaton: ahocorasick.Automaton) -> set[str]:
    terms = set()
    for end, term in automaton.iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in ALNUM) and (end + 1 == len(url) or url[end + 1] not in ALNUM):
            terms.add(term)
    return terms


def vocabulary_score(url: Column, vocabulary: dict[str, float] = VOCABULARY, limit: float = LIMIT) -> Column:
    """``struct(strict, soft, weight)``: distinct strict and soft terms of a url and their sum."""
    weights = {k.lower(): float(v) for k, v in vocabulary.items() if k}
    terms = tuple(sorted(weights))

    @F.pandas_udf("strict int, soft int, weight double")
    def score(urls: pd.Series) -> pd.DataFrame:
        rows = []
        automaton = _automaton(terms) if terms else None
        for u in urls:
            hit = _hits(u, automaton) if automaton and u else ()
            strict = sum(weights[t] >= limit for t in hit)
            rows.append((strict, len(hit) - strict, sum(weights[t] for t in hit)))
        return pd.DataFrame(rows, columns=["strict", "soft", "weight"])

    return score(lower_ascii(F.coalesce(url, F.lit(""))))


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]] = (),
    vocabulary: dict[str, float] = VOCABULARY,
    limit: float = LIMIT,
    url_col: str = "url",
) -> DataFrame:
    """Add ``host, path, rule, verdict, strict_hits, soft_hits, weight`` to ``pages``.

    Columns of these names are replaced. A NULL url, or one without ``://``, has an empty
    host and path; no term can block a NULL or empty url, so its verdict is ``allow``. Repeated
    rows are judged alike and each is returned. No shuffle; only the url goes to Python.
    """
    # The caller's columns travel in one struct, so their names meet no others.
    url = F.coalesce(F.col("_url"), F.lit(""))
    judged = pages.select(F.struct("*").alias("_row"), F.col(url_col).alias("_url")).select(
        "_row", host(url).alias("host"), path(url).alias("path"), vocabulary_score(F.col("_url"), vocabulary, limit).alias("_score")
    )
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("_score.weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    added = {
        "host": F.col("host"), "path": F.col("path"), "rule": rule, "verdict": F.coalesce(said, own),
        "strict_hits": F.col("_score.strict"), "soft_hits": F.col("_score.soft"), "weight": F.col("_score.weight"),
    }
    return judged.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c not in added], *[v.alias(k) for k, v in added.items()])
