"""URL filter by a weighted vocabulary and longest-match host rules.

An Aho-Corasick automaton over strict and soft terms counts, in each
lower-cased URL, the distinct terms that stand between non-alphanumeric
characters. One strict term or soft_needed distinct soft terms reject it. Rules
(host, path prefix) come first: a rule fits its host and all subdomains, if the
path starts with the rule's path; the longest wins.

A null URL, or one without "://", has an empty host and path, fits no rule and
is judged by its terms alone (null has none). Each row is judged by itself, so
ties, repeated rows and empty tables need nothing; a URL of any length is judged
whole. Columns other than page_id and url are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules in force, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms of which one rejects.
STRICT = (
    "porn", "porno", "pornhub", "xxx", "xvideos", "xhamster", "redtube", "youporn", "hentai", "milf", "gangbang", "cumshot", "upskirt", "sexcam", "livesex", "camgirls", "escorts",
    "warez", "keygen", "nulled", "torrent-cracks",
)
#: Terms of which several distinct ones reject.
SOFT = (
    "adult", "erotic", "fetish", "nude", "naked", "sex", "sexy", "hot", "dating", "hookup", "singles", "webcam", "escort",
    "casino", "gambling", "roulette", "blackjack", "bingo", "lottery", "poker", "slots", "jackpot", "bet", "betting", "sportsbook", "win", "bonus",
    "viagra", "cialis", "levitra", "xanax", "tramadol", "pills", "pharmacy", "loan", "loans", "payday", "cheap", "free", "replica", "rolex", "crack", "cracked", "torrent", "serial", "cheats",
)
SOFT_NEEDED = 2


def automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for weight, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            out.add_word(term, (weight, term))
    out.make_automaton()
    return out


def count_terms(url: str | None, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft terms of a URL, at word boundaries."""
    if not url:
        return 0, 0
    low = url.lower()
    alone = lambda i: not (0 <= i < len(low)) or not (low[i].isascii() and low[i].isalnum())
    hits = {hit for end, hit in terms.iter(low) if alone(end + 1) and alone(end - len(hit[1]))}
    strict = sum(w == "strict" for w, _ in hits)
    return strict, len(hits) - strict


def url_parts(url):
    """Host and path columns of a URL column."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    cut = F.instr(rest, "/")
    host = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    path = F.when(cut > 0, F.substring(rest, cut, F.length(rest))).otherwise("")
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def filter_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits."""

    @F.pandas_udf("strict int, soft int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = automaton(strict, soft)
        for urls in batches:
            yield pd.DataFrame([count_terms(u, terms) for u in urls], columns=["strict", "soft"])

    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), hits("url").alias("hits"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last that fits is the longest.
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    bad = (F.col("hits.strict") >= 1) | (F.col("hits.soft") >= soft_needed)
    judged = F.when(bad, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"))


def oracle(rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = SOFT_NEEDED) -> str:
    has = lambda t: f"coalesce(regexp_matches(lower(url), '(^|[^a-z0-9]){re.escape(t).replace(chr(92) + '-', '-')}([^a-z0-9]|$)'), false)::int"
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p) if i else v}'" for v, h, p in order) + " END"
    return rf"""
WITH a AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '/.*$', 0, 's') AS path,
  ({' + '.join(map(has, strict))})::int AS strict_hits, ({' + '.join(map(has, soft))})::int AS soft_hits FROM a)
SELECT page_id, host, path, {case(True)} AS rule,
  coalesce({case(False)}, CASE WHEN strict_hits >= 1 OR soft_hits >= {soft_needed} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits FROM b
"""
