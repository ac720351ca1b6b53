"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` with the literal tokens (whole runs of a-z, 0-9) that any match
must contain. One pass counts how often the rules' tokens occur in the URLs of the table; every rule is filed under its
rarest token. A URL is cut into tokens, which fetch the candidate rules, and only those run their expressions, so the
work per URL does not grow with the number of rules. URLs are judged where they lie: nothing is shuffled but counts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULES = 200_000  # the index is sent to every task; more rules need a join on the token instead
TOKEN = re.compile(r"[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; of several matching rules the one with the highest ``rank`` wins, then the first listed."""

    name: str
    verdict: str
    pattern: str
    tokens: frozenset = field(default_factory=frozenset)
    rank: int = 0
    listed: bool = True  # listed rules are named in the result; the others only give a verdict


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; longer rules outrank shorter ones."""
    cut = path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]  # the last token of a prefix may go on in the URL
    tokens = frozenset(TOKEN.findall(host)) | frozenset(TOKEN.findall(cut.translate(_LOWER)))
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, verdict, pattern, tokens, rank=1 + len(host + path))


def pattern_rule(verdict: str, name: str, pattern: str, tokens: Iterable[str]) -> Rule:
    return Rule(name, verdict, pattern, frozenset(tokens), rank=0, listed=False)


# The host and path rules of the crawl, and general patterns that judge what they leave open.
HOST_RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
PATTERN_RULES = (
    pattern_rule("block", "pills", r"(?:\A|[./-])cheap-pills(?:[./-]|\Z)", ("cheap", "pills")),
    pattern_rule("block", "casino", r"(?:\A|[./-])(?:online-)?casino(?:[./-]|\Z)", ("casino",)),
    pattern_rule("block", "adserver", r"\Aads?\.[^/]*/", ()),
    pattern_rule("block", "login", r"/(?:wp-)?login\.php(?:/|\Z)", ("login", "php")),
    pattern_rule("block", "cart", r"/cart/checkout(?:/|\Z)", ("cart", "checkout")),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``."""
    if not isinstance(url, str):
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = re.search(r"[/?#]", rest)
    host, rest = (rest, "") if end is None else (rest[: end.start()], rest[end.start():])
    return host.translate(_LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


def token_counts(urls: DataFrame, tokens: list[str], url: str = "url") -> dict[str, int]:
    """In how many URLs each of the given tokens occurs; at most one row per token reaches the driver."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in tokens], "token string")
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit("[a-z0-9]+"), F.lit(0)))
    seen = urls.select(F.explode(found).alias("token")).join(F.broadcast(wanted), "token")
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(token -> numbers of rules, numbers of rules without a token, which every URL tries)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be sent to the tasks")
    by_token: dict[str, list[int]] = defaultdict(list)
    always = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(k)
        else:
            always.append(k)
    return dict(by_token), always


class Matcher:
    """Judges (host, path); expressions are compiled when first run."""

    def __init__(self, rules: list[Rule], index: dict[str, list[int]], always: list[int]):
        self.rules, self.index, self.always = rules, index, always
        self.compiled: dict[int, re.Pattern] = {}
        self.runs = 0

    def _fits(self, k: int, subject: str) -> bool:
        self.runs += 1
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.rules[k].pattern)
        return self.compiled[k].search(subject) is not None

    def best(self, host: str, path: str) -> Rule | None:
        subject = host + path
        found = set(self.always)
        for token in set(TOKEN.findall(subject.translate(_LOWER))):
            found.update(self.index.get(token, ()))
        for k in sorted(found, key=lambda k: (-self.rules[k].rank, k)):  # the first that fits wins
            if self._fits(k, subject):
                return self.rules[k]
        return None


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """Verdict for every page's url.

    Returns page_id, host, path, rule (name of the listed rule that won, else null), verdict and pattern (name of the
    unlisted pattern rule that won, else null). A URL that no rule fits gets ``default``. Null URLs and URLs without
    ``://`` have empty host and path and are judged like that; repeated rows each get their row; an empty table gives
    no rows. Only page_id and url are read.
    """
    urls = pages.select("page_id", "url")
    rules = list(rules)
    index, always = index_rules(rules, token_counts(urls, sorted(set().union(*[r.tokens for r in rules], set()))))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(rules, index, always)
        for batch in batches:
            rows = []
            for url in batch["url"]:
                host, path = split_url(url)
                rule = matcher.best(host, path)
                listed = rule is not None and rule.listed
                rows.append((host, path, rule.name if listed else None, rule.verdict if rule else default,
                             rule.name if rule and not listed else None))
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "pattern"], dtype=object)
            out.insert(0, "page_id", batch["page_id"].to_numpy())
            yield out

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInPandas(judged, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
