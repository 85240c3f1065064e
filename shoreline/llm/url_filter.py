"""URL filter with host and path rules and a weighted vocabulary.

One Aho-Corasick automaton holds strict and soft terms. A term counts where neither neighbour
in the URL is a letter or digit. A URL is blocked by one strict term or by ``soft_hits``
different soft terms. A rule that fits the URL decides before the vocabulary does.

Null, or text without ``://``: host and path are empty, no rule fits and no term is looked for
in null. Empty tables give empty results; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
STRICT = ("casino", "porn", "xxx", "escort", "spam-farm", "adult-x", "viagra", "warez")
SOFT = (
    "ad", "ads", "adult", "bet", "bets", "bonus", "casinos", "cheap", "farm", "free", "loan", "loans", "pills", "poker",
    "sex", "spam", "torrent", "torrents", "track", "tracker", "tracking", "win",
)

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "host string, path string, rule string, verdict string, strict_hits int, soft_terms int"


def automaton(strict: Iterable[str], soft: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def term_hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """(occurrences of strict terms, different soft terms), whole terms only."""
    if not len(terms):
        return 0, 0
    strict, soft = 0, set()
    for end, (term, weight) in terms.iter(url):
        start = end - len(term)
        if (start >= 0 and url[start] in _WORD) or (end + 1 < len(url) and url[end + 1] in _WORD):
            continue
        if weight == 2:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def best_rule(host: str, path: str, rules: Iterable[tuple[str, str, str]]) -> tuple[str | None, str | None]:
    """The longest rule that fits: its own host or a subdomain of it, and the path's start."""
    best: tuple[str | None, str | None] = (None, None)
    for rule_host, rule_path, verdict in rules:
        name = rule_host + rule_path
        fits = (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)
        if fits and (best[0] is None or len(name) > len(best[0])):
            best = (name, verdict)
    return best


def filter_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    *,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_hits: int = 2,
) -> DataFrame:
    """``key`` and SCHEMA for every row of ``pages``; no other column is read."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = automaton(strict, soft)
        for batch in batches:
            rows = []
            for value in batch["_url"]:
                # Null and text without :// have no host and no path.
                parts = _PARTS.search(value) if isinstance(value, str) else None
                host, path = (parts[1].translate(_UPPER), parts[2]) if parts else ("", "")
                hard, light = term_hits(value.translate(_UPPER), terms) if isinstance(value, str) else (0, 0)
                rule, verdict = best_rule(host, path, rules)
                verdict = verdict or ("block" if hard or light >= soft_hits else "allow")
                rows.append((host, path, rule, verdict, hard, light))
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "strict_hits", "soft_terms"])
            out.insert(0, key, batch["_key"].to_numpy())
            yield out

    kind = dict(pages.dtypes)[key]
    chosen = pages.select(pages[key].alias("_key"), pages[url].alias("_url"))
    return chosen.mapInPandas(judge, f"`{key}` {kind}, {SCHEMA}")


def _oracle() -> str:
    """The same verdicts in SQL: terms as regular expressions, rules as conditions."""

    def hits(terms: tuple[str, ...]) -> list[str]:
        return [f"regexp_matches(u, '(^|[^a-z0-9]){re.escape(t)}($|[^a-z0-9])')::INT" for t in terms]

    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in ordered)
    return rf"""
WITH a AS (
  SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS u,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
b AS (SELECT *, CASE {rule} END AS rule, {" + ".join(hits(STRICT))} AS hard, {" + ".join(hits(SOFT))} AS light FROM a)
SELECT page_id, host, path, rule, CASE {verdict} WHEN hard > 0 OR light >= 2 THEN 'block' ELSE 'allow' END AS verdict FROM b
"""


ORACLE = _oracle()
