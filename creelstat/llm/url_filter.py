"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression over ``host + path`` and the literal tokens that any matching url must hold. The
tokens are counted over all urls, each rule is filed under the rarest of its own, and a url fetches the rules filed
under one of its tokens. Only these run their expression.

Distinct urls are judged, so a url that a third of all rows share costs one row. Rules are a few parameters or a table
of any size (:func:`site_rules` makes one of a list of hosts); whether they are broadcast is left to Spark's size check,
and the urls stand on the side that adaptive execution can split. A rule without tokens is run on every url.

Defined results: rules that are listed twice count once. A NULL expression or action makes no rule; NULL or empty tokens
are none. A site that is NULL leaves its rule to decide after the sites.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, literal_rows, pick

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A rule of the filter. The action is allow or block.

    Rules with a ``site`` decide before the others. ``tokens`` must all stand, as whole tokens, in each url that the
    expression can match; without any the rule is a candidate for every url.
    """

    expression: str
    tokens: tuple[str, ...]
    action: str
    site: str | None = None


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains where the path starts with the given one."""
    tail = re.sub(r"[a-z0-9]+$", "", path.lower())  # a token that goes on in the url isn't the rule's
    tokens = re.findall(TOKEN, host) + re.findall(TOKEN, tail)
    quoted = "".join(c if c.isalnum() or c == "/" else f"\\{c}" for c in path)
    expression = r"(?s)^(?:[^/]*\.)?" + host.replace(".", r"\.") + (quoted if path else "(?:/|$)")
    return Rule(expression, tuple(dict.fromkeys(tokens)), action, host + path)


def word_rule(word: str) -> Rule:
    """Blocks urls in whose host or path the word stands between delimiters."""
    return Rule(rf"(?i)(?:^|[./_-]){re.escape(word)}(?:[./_-]|$)", (word,), "block")


#: The rules of the query: hosts and paths.
SITES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)
#: What the method itself blocks where no site rule fits: advertising, tracking and the like.
WORDS = tuple(map(word_rule, (
    "ad", "ads", "adserver", "advert", "banner", "beacon", "casino", "click", "doubleclick", "pixel", "popup", "porn",
    "sponsor", "track", "tracker", "tracking", "xxx",
)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for NULL and for a url without ``://``."""
    part = [F.coalesce(F.regexp_extract(url, URL, i), F.lit("")) for i in (1, 2)]
    return F.translate(part[0], UPPER, LOWER), part[1]


def site_rules(sites: DataFrame) -> DataFrame:
    """Rules, as :func:`judge` takes them, for each row of (action, host, path); see :func:`site_rule`.

    Rows with a NULL are no rules. A path other than the empty one starts with a slash.
    """
    host = F.translate("host", UPPER, LOWER)
    quoted = F.regexp_replace("path", "([^A-Za-z0-9/])", r"\\$1")
    tail = F.regexp_replace(F.lower("path"), "[a-z0-9]+$", "")
    return pick(sites, "action", "host", "path").dropna().select(
        F.concat(
            F.lit(r"(?s)^(?:[^/]*\.)?"), F.regexp_replace(host, r"([^A-Za-z0-9])", r"\\$1"),
            F.when(F.col("path") != "", quoted).otherwise("(?:/|$)"),
        ).alias("expression"),
        "action", F.concat(host, "path").alias("site"),
        F.array_distinct(F.concat(*[F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)) for x in (host, tail)])).alias("tokens"),
    )


def _table(spark: SparkSession, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """Distinct rules (expression, action, site, tokens), with the empty token where there is none."""
    if not isinstance(rules, DataFrame):
        rules = literal_rows(
            spark, [(x.expression, x.action, x.site, x.tokens or ("",)) for x in rules],
            "expression string, action string, site string, tokens array<string>",
        )
    tokens = F.coalesce(F.array_compact("tokens"), F.array().cast("array<string>"))
    return pick(rules, "expression", "action", "site", "tokens").where(
        F.col("expression").isNotNull() & F.col("action").isNotNull()
    ).withColumn("tokens", F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))))


def _tokens(urls: DataFrame) -> DataFrame:
    """(url, place, token) of distinct urls (url, host, path), the empty token included."""
    place = F.concat("host", "path")
    return urls.select(
        "url", place.alias("place"),
        F.explode(F.array_distinct(F.concat(
            F.regexp_extract_all(F.lower(place), F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))
        ))).alias("token"),
    )


def candidates(spark: SparkSession, urls: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITES + WORDS) -> DataFrame:
    """(url, place, expression, action, site): the rules whose rarest token stands in each of the urls (url, host, path)."""
    tokens = _tokens(urls)
    entries = _table(spark, rules).withColumn("token", F.explode("tokens")).drop("tokens")
    counts = tokens.join(entries.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    index = (
        entries.join(counts, "token", "left")
        .groupBy("expression", "action", "site")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    return tokens.join(index, "token").drop("token")


def judge(spark: SparkSession, urls: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITES + WORDS) -> DataFrame:
    """(url, host, path, rule, verdict) for every distinct url of a column ``url``.

    rules are a few Rules or a DataFrame (expression, action, site, tokens) of any number.

    The longest site rule wins, block before allow and then by name among equals. Where none fits, the url is
    blocked if another rule blocks it, and allowed otherwise. NULL is a url of its own with empty host and path.
    """
    host, path = split_url(F.col("url"))
    distinct = pick(urls, "url").distinct().select("url", host.alias("host"), path.alias("path"))
    fits = candidates(spark, distinct, rules).where(F.expr("regexp_like(place, expression)"))
    best = fits.groupBy("url").agg(
        F.max(F.when(F.col("site").isNotNull(), F.struct(
            F.length("site").alias("size"), (F.col("action") == "block").alias("block"), "site", "action",
        ))).alias("site"),
        F.max(F.col("site").isNull() & (F.col("action") == "block")).alias("blocked"),
    )
    known = distinct.where(F.col("url").isNotNull()).join(best, "url", "left")
    verdict = F.coalesce("site.action", F.when(F.col("blocked"), "block").otherwise("allow"))
    none = distinct.where(F.col("url").isNull())
    return known.select("url", "host", "path", F.col("site.site").alias("rule"), verdict.alias("verdict")).unionByName(
        none.select("url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    )


def filter_urls(
    spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITES + WORDS
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of (page_id, url); repeated rows stay repeated."""
    return (
        pick(pages, "page_id", "url").alias("p")
        .join(judge(spark, pages, rules).alias("j"), F.col("p.url").eqNullSafe(F.col("j.url")), "left")
        .select("p.page_id", "j.host", "j.path", "j.rule", "j.verdict")
    )
