"""URL filtering with rules that are looked up by their rarest literal token.

Every rule is a regular expression over ``host + path`` with tokens that its matches must contain (runs of letters
and digits between separators). A rule is filed under that token of it which the fewest URLs contain; the counts
come from one pass over all URLs. A URL then fetches only the rules filed under its own tokens, and only those
run. Rules without a certain token are tried on every URL. The rules come from the caller as a list and travel with
the tasks; the URLs are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, text_of

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """A rule. ``weight`` decides among those that fit; 0 for patterns, which only speak where no host rule does."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int


def host_rule(verdict: str, host: str, path: str) -> UrlRule:
    """For ``host`` and its subdomains, where the path starts with ``path``. The longest such rule decides."""
    whole = re.findall(TOKEN, host.lower())
    # The last word of a path may go on in the URL, so it is certain only with a separator after it.
    # A-Z is lower-cased in the tokens of rules and URLs alike.
    whole += re.findall(rf"{TOKEN}(?=[^a-z0-9])", path.lower())
    pattern = rf"(?:[^/]*\.)?{re.escape(host.lower())}\n{re.escape(path)}"
    return UrlRule(host + path, pattern, tuple(whole), verdict, len(host) + len(path))


def word_rule(word: str) -> UrlRule:
    """Blocks URLs that have ``word`` as a whole token of host or path."""
    w = re.escape(word)
    return UrlRule(f"*{word}*", rf"(?is)(?:.*[^a-z0-9])?{w}(?:[^a-z0-9].*)?\Z", (word,), "block", 0)


# Words of addresses that are blocked unless a host rule says otherwise.
BLOCKED_WORDS = ("adult", "casino", "escort", "gambling", "malware", "phishing", "porn", "sex", "warez", "xxx")
DEFAULT_PATTERNS = tuple(word_rule(word) for word in BLOCKED_WORDS)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(whole, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def split_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``__host`` and ``__path``."""
    with_url = pages.withColumn("__url", text_of(url))
    host, path = url_parts(F.col("__url"))
    return with_url.withColumn("__host", host).withColumn("__path", path).drop("__url")


def token_counts(urls: DataFrame, rules: Sequence[UrlRule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; as many numbers as the rules have tokens."""
    known = sorted({t for rule in rules for t in rule.tokens})
    if not known:
        return {}
    spark = urls.sparkSession
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat_ws("\n", "__host", "__path")), F.lit(TOKEN), 0))
    wanted = spark.createDataFrame(pd.DataFrame({"token": known}))
    counts = urls.select(F.explode(words).alias("token")).join(F.broadcast(wanted), "token").groupBy("token").count()
    return {row["token"]: row["count"] for row in counts.collect()}


class RuleIndex:
    """The rules, filed by token."""

    def __init__(self, rules: Sequence[UrlRule], counts: dict[str, int]):
        self.by_token: dict[str, list[UrlRule]] = {}
        self.always: list[UrlRule] = []
        for rule in rules:
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(rule)
            else:
                self.always.append(rule)

    def decide(self, host: str, path: str) -> tuple[str | None, str]:
        """Name of the host rule that decides, if one fits, and the verdict."""
        whole = f"{host}\n{path}"
        tokens = set(re.findall(TOKEN, _lower(whole)))
        fetched = [rule for t in tokens for rule in self.by_token.get(t, ())]
        fitting = [rule for rule in (*fetched, *self.always) if re.match(rule.pattern, whole)]
        if not fitting:
            return None, "allow"
        best = max(fitting, key=lambda r: (r.weight, r.verdict == "block", r.name))
        return (best.name if best.weight else None), best.verdict


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def filter_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    patterns: Sequence[UrlRule] = DEFAULT_PATTERNS,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rule`` is the host rule that decides, the longest that fits; of two of one length, block. Where none fits
    it is null, and the page is blocked if one of ``patterns`` fits, else allowed. Null URLs and those without
    ``://`` have an empty host and path, which no host rule fits. Repeated rows are judged each for itself.
    """
    parts = split_urls(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))).select(
        "page_id", "__host", "__path"
    )
    index = RuleIndex([*rules, *patterns], token_counts(parts, [*rules, *patterns]))

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            rows = [index.decide(h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(rows, columns=["rule", "verdict"], dtype=object)

    judged = parts.withColumn("__j", decide("__host", "__path"))
    return judged.select(
        F.col("page_id").alias(page_id),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        "__j.rule",
        "__j.verdict",
    )
