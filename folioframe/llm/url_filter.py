"""URL rules found through their rarest literal token, with DataFrame functions only.

A rule names a host (with its subdomains) and a path prefix; a pattern rule is a regular
expression over ``host + path`` with the literal tokens that any match must contain. Each
rule is filed under the one of its literal tokens that is rarest among the URLs. A URL's
own tokens fetch the candidate rules, and only those run their regular expressions. The
longest fitting rule wins. Pattern rules given apart judge the URLs that no rule of the
list fits, through the same index.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits
no rule; repeated rows are judged separately, and so are rows of one id with unlike URLs;
URLs of any length are read whole; among rules of equal length the last in code point order
wins; an empty table gives an empty result. Only the named columns are read; others may have
any names. Equal places are judged once, and rows without a place not at all, so hot URLs
are no hot keys. The rules are a bounded configuration table: more than
``MAX_RULES`` raise an error, which bounds what is broadcast; more rules can be passed as
a DataFrame with ``indexed_rules``' columns, which is then joined by shuffle.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for what ``regex`` matches; ``tokens`` are in every match as whole tokens."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A host with all its subdomains, and paths that start with ``path``."""
    whole = [p for p in path.split("/")[:-1] if p]  # the last segment may go on in the URL
    regex = "^(?:[^/]*\\.)?" + re.escape(host) + re.escape(path)
    return Rule(host + path, verdict, regex, tuple(dict.fromkeys([*host.split("."), *whole])))


def pattern_rule(verdict: str, name: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    """A regular expression over host and path, and the literal tokens that a match must hold."""
    if not tokens:
        raise ValueError("a pattern rule needs a literal token to be found by")
    return Rule(name, verdict, regex, tokens)


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct host labels and path segments."""
    parts = F.concat(F.split(host, r"\."), F.split(path, "/"))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; pass them as a DataFrame")
    listed = json.dumps([{"rule": r.name, "rule_verdict": r.verdict, "regex": r.regex, "rule_tokens": r.tokens} for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), _RULES)))


_RULES = "array<struct<rule string, rule_verdict string, regex string, rule_tokens array<string>>>"


def indexed_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under its literal token that the fewest URLs contain (ties: by code point)."""
    wanted = rules.select(F.explode("rule_tokens").alias("token")).distinct()
    seen = tokens.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    exploded = rules.withColumn("token", F.explode("rule_tokens"))
    return (
        exploded.join(F.broadcast(seen), "token", "left")
        .groupBy(*[c for c in rules.columns if c != "rule_tokens"])
        .agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    )


def judge_urls(
    pages: DataFrame,
    rules: list[Rule] | DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    patterns: list[Rule] | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row; ``default`` where no rule fits.

    ``patterns`` judge where no other rule fits; ``pattern`` then names the one that did.
    """
    listed = not isinstance(rules, DataFrame)
    table = (rules_table(pages.sparkSession, rules) if listed else rules).withColumn("first", F.lit(True))
    if patterns:
        table = table.unionByName(rules_table(pages.sparkSession, patterns).withColumn("first", F.lit(False)))
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    tokens = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    index = indexed_rules(table, tokens)
    by_token = index.groupBy("token").agg(F.collect_list(F.struct("rule", "rule_verdict", "regex", "first")).alias("candidates"))
    some = (F.col("host") != "") | (F.col("path") != "")
    places = urls.where(some).select("host", "path").distinct()  # equal places are judged once, so a hot URL is one row
    text = F.concat("host", "path")
    found = places.withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path"))))
    found = found.join(F.broadcast(by_token) if listed else by_token, "token")
    found = found.select("host", "path", F.inline("candidates")).where(F.rlike(text, F.col("regex")))
    best = F.max(F.struct("first", F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best")
    won = found.groupBy("host", "path").agg(best)
    judged = urls.where(some).join(won, ["host", "path"], "left")
    judged = judged.unionByName(urls.where(~some).withColumn("best", F.lit(None).cast(judged.schema["best"].dataType)))
    name = F.col("best.rule")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.first"), name).alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        *[F.when(~F.col("best.first"), name).alias("pattern")] * bool(patterns),
    )
