"""URL filter: a weighted vocabulary of strict, soft and weak terms, counted by Aho-Corasick with boundary checks.

A term counts where it stands in the lower-cased URL without a letter or digit at either side; escapes of letters and
digits (``%63asino``) are undone first. A strict term weighs ``LIMIT``, a soft one half of it, a weak one a quarter;
each distinct term counts once; a URL whose weight reaches ``LIMIT`` is blocked: one strict hit, or two distinct soft
hits, or as much in weak ones. Host rules override the vocabulary; the longest fitting rule wins, of equally long ones
the last by code points.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; a null URL is
allowed, any other is judged by its terms. Repeated rows are judged one by one; a long URL is read whole; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4
#: English, German, French and Spanish terms as they stand in URLs.
STRICT = (
    "adult", "casino", "escort", "escorts", "gambling", "gluecksspiel", "hardcore", "hentai", "keygen", "malware", "milf",
    "phishing", "porn", "porno", "pornos", "viagra", "cialis", "warez", "xxx", "xvideos", "sexshop", "sexe", "putas", "onlinecasino",
    "tragaperras", "spielautomaten", "ransomware",
)
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "cheap", "crack", "cracked", "farm", "free", "jackpot", "loan", "loans", "nude", "nudes", "pill",
    "pills", "poker", "popup", "sexy", "slot", "slots", "spam", "track", "tracker", "win", "winner", "torrent", "wette", "wetten", "kredit",
    "gratis", "nackt", "pari", "paris-sportifs", "gratuit", "nue", "machines-a-sous", "apuesta", "apuestas", "desnuda", "prestamo", "premio",
    "gewinnspiel", "roulette", "blackjack", "lottery", "lotto", "clickbait", "doorway",
)
WEAK = ("affiliate", "banner", "click", "coupon", "deal", "deals", "discount", "angebot", "rabatt", "oferta", "promo", "popunder", "redirect", "sponsored", "utm-spam", "download-now", "hot", "dating", "singles")
#: Escapes of letters and digits, in lower case, in the order in which they are undone.
ESCAPES = tuple((f"%{code:02x}", chr(code).lower()) for code in (*range(48, 58), *range(65, 91), *range(97, 123)))
#: (host and path, verdict)
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def vocabulary(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, weak: tuple[str, ...] = WEAK, limit: int = LIMIT) -> dict[str, int]:
    return {t: limit // 4 for t in weak} | {t: limit // 2 for t in soft} | {t: limit for t in strict}


def url_weight(weights: dict[str, int]):
    """A pandas UDF: the summed weight of the distinct terms in each URL."""

    def word(c: str) -> bool:
        return "a" <= c <= "z" or "0" <= c <= "9"

    @F.pandas_udf("long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = ahocorasick.Automaton()
        for term, w in weights.items():
            machine.add_word(term, (term, w))
        machine.make_automaton()

        def one(url: str | None) -> int:
            if not url:
                return 0
            if "%" in url:
                for escape, plain in ESCAPES:
                    url = url.replace(escape, plain)
            hits = {}
            for end, (term, w) in machine.iter(url):
                start = end - len(term)
                if (start < 0 or not word(url[start])) and (end + 1 == len(url) or not word(url[end + 1])):
                    hits[term] = w
            return sum(hits.values())

        for urls in batches:
            yield urls.map(one).fillna(0).astype("int64")

    return weigh


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, weights: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, host, path, rule, verdict, weight) for each row."""
    df = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("u"))
    has = F.coalesce(F.col("u").contains("://"), F.lit(False))
    df = df.withColumn("r", F.when(has, F.substring_index(F.substring_index(F.expr("substring(u, locate('://', u) + 3)"), "?", 1), "#", 1)).otherwise(""))
    host = F.translate(F.substring_index("r", "/", 1), _UPPER, _LOWER)
    df = df.select("__id", "u", host.alias("host"), F.expr("substring(r, length(substring_index(r, '/', 1)) + 1)").alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda x: (len(x[0]), x[0])):  # a longer one overrides
        at, _, path = text.partition("/")
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    weight = url_weight(weights or vocabulary())(F.translate("u", _UPPER, _LOWER))
    df = df.select("__id", "host", "path", rule.alias("rule"), verdict.alias("said"), weight.alias("weight"))
    return df.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.when(F.col("weight") >= limit, "block").otherwise("allow")).alias("verdict"), "weight")


def judge_sql(rules: tuple[tuple[str, str], ...] = RULES, weights: dict[str, int] | None = None, limit: int = LIMIT) -> str:
    """The same rows in DuckDB SQL."""
    fits = lambda t: f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')"
    order = sorted(rules, key=lambda x: (len(x[0]), x[0]), reverse=True)
    low = f"translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}')"
    for escape, plain in ESCAPES:
        low = f"replace({low}, '{escape}', '{plain}')"
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in order) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for t, v in order) + " END"
    weight = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN {w} ELSE 0 END" for t, w in (weights or vocabulary()).items())
    return f"""
WITH cut AS (
  SELECT page_id, url, {low} AS low,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://([^?#]*)', 1) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/]*'), '{_UPPER}', '{_LOWER}') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
  FROM cut),
weighed AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM parts)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({said}, CASE WHEN weight >= {limit} THEN 'block' ELSE 'allow' END) AS verdict, weight
FROM weighed"""
