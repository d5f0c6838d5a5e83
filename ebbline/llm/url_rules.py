"""URL filtering with rules that are indexed by their rarest literal token.

Every rule is a regular expression over `host + path`. Its literal tokens (runs of
letters and digits that the expression demands in full) are counted over all URLs,
and the rule is filed under the one that the fewest URLs hold. A URL fetches the
rules filed under its own tokens, and only those run. Rules without a whole token
are filed under the empty token, which every URL looks up, so none is missed.

Everything is DataFrame operations. Distinct URLs are judged once; a URL that holds a
third of the pages is one row there, and what it got returns by a join on the URL, in
which adaptive execution splits a large partition.

Defined results: a null URL or one without `://` has empty host and path, matches
nothing and gets the default verdict. Repeated rows stay. An empty table gives an
empty result, and no rules give the default verdict. An input column named like a
result column is replaced. Of several fitting rules the one with the highest
`priority`, then the longest, then `block` before `allow`, then the smallest name wins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import ascii_lower, like_pattern, replace_columns, stage

RULE_SCHEMA = (
    "rule string, verdict string, pattern string, tokens array<string>, "
    "priority int, length int, listed boolean"
)


@dataclass(frozen=True)
class UrlRule:
    """`tokens` must occur as whole tokens in every matching `host + path`."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    priority: int
    length: int
    listed: bool


def host_rule(host: str, path: str, verdict: str, priority: int = 1) -> UrlRule:
    """A rule for a host with all its subdomains and a path prefix."""
    host = host.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))}))
    text = host + path
    # A token that ends the path prefix may go on in the URL: it cannot be looked up.
    whole = re.findall(r"[A-Za-z0-9]+(?![A-Za-z0-9]|$)", text)
    return UrlRule(
        text, verdict, rf"^(?:[^/]*\.)?{like_pattern(text)}",
        tuple(t.lower() for t in whole), priority, len(text), True,
    )


def token_rule(name: str, literal: str, verdict: str = "block", priority: int = 0) -> UrlRule:
    """A rule for a literal that stands between separators in the host."""
    literal = literal.lower()
    return UrlRule(
        name, verdict, rf"^(?:[^/]*[^a-z0-9/])?{like_pattern(literal)}(?:[^a-z0-9]|$)",
        tuple(re.findall(r"[a-z0-9]+", literal)), priority, len(literal), False,
    )


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add `host` (A-Z lower-cased) and `path`, both empty without `://`."""
    address = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)://(.*)$", 1)
    return replace_columns(pages, {
        "host": ascii_lower(F.regexp_extract(address, r"^([^/?#]*)", 1)),
        "path": F.regexp_extract(address, r"^[^/?#]*(/[^?#]*)", 1),
    })


def url_tokens(subject: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits, and the empty token."""
    return F.array_distinct(
        F.concat(F.split(ascii_lower(subject), "[^a-z0-9]+"), F.array(F.lit("")))
    )


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """File each rule under the token that the fewest URLs hold.

    `tokens` has one row per URL and token (`token`). Only tokens that occur in a rule
    are counted, partially before the shuffle.
    """
    # Written, so that the planner knows its size and need not shuffle frequent tokens.
    wanted = stage(rules.select("rule", F.explode("tokens").alias("token")), "rule-tokens")
    counts = (
        tokens.join(wanted.select("token").distinct(), "token", "left_semi")
        .groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    )
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("best"))
        .select("rule", F.col("best.token").alias("token"))
    )
    return (
        rules.join(rarest, "rule", "left")
        .withColumn("token", F.coalesce("token", F.lit("")))
        .drop("tokens")
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule] | DataFrame, url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Add host, path, rule, verdict, `listed` and `rules_run` to every page.

    `rule` is null where nothing fits. `listed` says whether the winner is a list rule
    or one of the method's own patterns. `rules_run` counts the expressions that were
    evaluated for the URL. `rules` may be a table of RULE_SCHEMA for large lists.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(
            [(r.name, r.verdict, r.pattern, list(r.tokens), r.priority, r.length, r.listed)
             for r in rules], RULE_SCHEMA)
    named = with_host_and_path(pages, url)
    subject = F.concat("host", "path")
    distinct = named.select(subject.alias("_subject")).distinct()
    tokens = distinct.select("_subject", F.explode(url_tokens(F.col("_subject"))).alias("token"))
    # The written index tells the planner its size, so it broadcasts small ones only.
    index = stage(rule_index(rules, tokens), "url-rules")
    tried = tokens.join(index, "token").withColumn("_fits", F.expr("_subject rlike pattern"))
    winner = F.struct(
        (-F.col("priority")).alias("priority"), (-F.col("length")).alias("length"),
        (F.col("verdict") != "block").alias("allows"), "rule", "verdict", "listed",
    )
    best = tried.groupBy("_subject").agg(
        F.count(F.lit(1)).alias("_run"), F.min(F.when(F.col("_fits"), winner)).alias("_win"))
    joined = named.withColumn("_subject", subject).join(best, "_subject", "left")
    return replace_columns(joined, {
        "rule": F.col("_win.rule"),
        "verdict": F.coalesce("_win.verdict", F.lit(default)),
        "listed": F.coalesce("_win.listed", F.lit(False)),
        "rules_run": F.coalesce("_run", F.lit(0)),
    }).drop("_subject", "_run", "_win")
