"""URL filters: host and path rules, then a weighted vocabulary.

A rule fits its host and that host's subdomains where the path begins with the rule's path, and the
longest rule that fits decides.  Other urls are judged by vocabulary: an Aho-Corasick automaton
finds the terms in the lower-cased url, a hit counts where no letter or digit touches it, and one
strict term or ``SOFT_NEEDED`` different soft terms block the url.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.llm.support import ascii_lower
from incidara.shipping import shipped

#: Terms of which one is enough.
STRICT = (
    "adult", "casino", "casinos", "escort", "escorts", "gambling", "hentai", "malware", "milf", "nude", "nudes",
    "phishing", "porn", "porno", "pornography", "roulette", "sex", "sexcam", "sportsbook", "viagra", "warez", "xxx",
)
#: Terms of which several different ones are needed.
SOFT = (
    "ad", "ads", "affiliate", "banner", "bet", "bets", "betting", "bingo", "bonus", "cam", "cheap", "click", "coupon",
    "crack", "credit", "date", "dating", "deals", "discount", "download", "farm", "free", "girls", "hot", "jackpot",
    "keygen", "loan", "loans", "lottery", "pharmacy", "pill", "pills", "poker", "popup", "promo", "serial", "singles",
    "slot", "slots", "spam", "sponsor", "torrent", "track", "tracker", "win", "winner",
)
SOFT_NEEDED = 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name (host and path) and action of the longest of ``rules`` that fits; nulls if none does.

    ``rules`` has (action, host, path).  They are a short list of a person's making and become one
    expression; of two with the same length the one with the longer host is taken.
    """
    ranked = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, below in reversed(ranked):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        name, action = F.when(fits, F.lit(at + below)).otherwise(name), F.when(fits, F.lit(what)).otherwise(action)
    return name, action


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            machine.add_word(term, (kind, term))
    machine.make_automaton()
    return machine


def count_terms(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Hits of strict terms, and different soft terms, in one url."""
    text, strong, weak = url.lower(), 0, set()
    for end, (kind, term) in _automaton(strict, soft).iter(text):
        begin = end - len(term) + 1
        if (begin and text[begin - 1].isalnum()) or text[end + 1 : end + 2].isalnum():
            continue
        if kind == "strict":
            strong += 1
        else:
            weak.add(term)
    return strong, len(weak)


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_needed: int = SOFT_NEEDED
) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_hits, soft_terms`` of each row of ``pages``.

    A null url has empty parts, no hits and is allowed.  A null id stays null, and repeated rows are judged each for itself.
    Time is in proportion to the url, however long.  Other columns are ignored; no rows give none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_terms(url or "", strict, soft) for url in batch.column("url").to_pylist()]
            more = [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "strict_hits", "soft_terms"])

    kind = pages.select("page_id").schema[0].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    scanned = shipped(rows).mapInArrow(scan, f"page_id {kind}, url string, strict_hits int, soft_terms int")
    host, path = url_parts(F.col("url"))
    parts = scanned.select("page_id", host.alias("host"), path.alias("path"), "strict_hits", "soft_terms")
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    guess = F.when((F.col("strict_hits") > 0) | (F.col("soft_terms") >= soft_needed), F.lit("block")).otherwise(F.lit("allow"))
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, guess).alias("verdict"), "strict_hits", "soft_terms")
