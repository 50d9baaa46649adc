"""URL filter: rules indexed by their rarest literal token (DataFrame functions only).

Rules are regular expressions with the literal tokens that every match must contain. Tokens are counted over all URLs; a
rule is filed under the rarest of its own. The tokens of a URL fetch candidate rules, and only those run their expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

ANY = ""  # the token under which rules without a literal are filed; every URL has it


@dataclass(frozen=True)
class UrlRule:
    """name: as reported; pattern: searched in the lower-cased host + path as it stands; tokens: runs of [a-z0-9] that each match has as whole tokens."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    ordered: bool = False  # a host and path rule: these win over patterns, the longest first


def host_rule(verdict: str, rule: str) -> UrlRule:
    """`host/path`: fits that host and its subdomains where the path starts with /path."""
    host, slash, rest = rule.partition("/")
    literal = lambda s: re.sub(r"([^A-Za-z0-9/_-])", r"[\1]", s)
    whole = re.findall(r"(?<![^\W_])[a-z0-9]+(?=[^a-z0-9])", f"/{rest}") if re.fullmatch(r"[\x00-\x7f]*", rest) and rest == rest.lower() else []
    return UrlRule(rule, verdict, f"^([^/]*[.])?{literal(host)}{literal(slash + rest)}", (*re.findall(r"[a-z0-9]+", host), *whole), True)


# The rules of the query.
SITE_RULES = (
    host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"), host_rule("block", "net/fr/"),
)
PATTERN_RULES = tuple(
    UrlRule(f"{word} host", "block", f"^([^/]*[.-])?{word}[.-]", (word,))
    for word in ("spam", "casino", "poker", "porn", "xxx", "phishing", "malware", "warez", "torrents")
) + (
    UrlRule("login page", "block", r"/wp-login[.]php$", ("wp", "login", "php")),
    UrlRule("advert server", "block", r"^ads?(server)?[0-9]*[.]", ()),
    UrlRule("program file", "block", r"/[^/]*[.]exe$", ("exe",)),
)


def parts(url):
    """(host, path) columns of a URL column; both empty for null or without "://"."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(subject):
    return F.array_union(F.array(F.lit(ANY)), F.split(F.lower(subject), "[^a-z0-9]+"))


def rule_index(spark: SparkSession, counts: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """token, rule_no, pattern, name, verdict, ordered: each rule under its rarest token; ties by token.

    counts (token, n) covers all URLs. Repeated rules are allowed: the first wins."""
    listed = spark.createDataFrame(
        [(k, r.name, r.verdict, r.pattern, r.ordered, list(r.tokens) or [ANY]) for k, r in enumerate(rules)],
        "rule_no int, name string, verdict string, pattern string, ordered boolean, tokens array<string>")
    rated = listed.withColumn("token", F.explode("tokens")).join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    filed = rated.groupBy("rule_no", "name", "verdict", "pattern", "ordered").agg(F.min(F.struct("n", "token")).alias("rarest"))
    return filed.select(F.col("rarest.token").alias("token"), "rule_no", "name", "verdict", "pattern", "ordered")


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = SITE_RULES + PATTERN_RULES, otherwise: str = "allow") -> DataFrame:
    """The rows of pages with __host, __path, __rule (name of the winning host rule, else null), __pattern (of the winning
    pattern rule where no host rule fits) and __verdict.

    Each distinct URL is judged once. Null, empty and odd URLs have empty parts and the verdict `otherwise`, unless a rule
    fits the empty text. Host and path rules win over patterns, longer names over shorter, earlier over later. Repeated rows
    are judged alike; other columns are kept, only those of these five names are replaced."""
    spark = pages.sparkSession
    host, path = parts(F.col("__url"))
    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("__url")).distinct().select("__url", F.concat(host, path).alias("subject"))
    tokens = urls.withColumn("token", F.explode(_tokens(F.col("subject"))))
    index = rule_index(spark, tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), rules)
    fits = tokens.join(index, "token").filter(F.expr("subject RLIKE pattern"))
    # one number orders the rules, so that the best is found by a combinable maximum
    order = F.col("ordered").cast("long") * 10**12 + F.length("name") * 10**6 + (10**6 - 1 - F.col("rule_no"))
    best = fits.groupBy("__url").agg(F.max(order).alias("order")).withColumn("rule_no", (10**6 - 1 - F.col("order") % 10**6).cast("int"))
    names = spark.createDataFrame([(k, r.name, r.verdict, r.ordered) for k, r in enumerate(rules)],
                                  "rule_no int, __name string, __verdict string, __ordered boolean")
    judged = best.join(names, "rule_no").select("__url", "__name", "__verdict", "__ordered")
    host, path = parts(F.col("row")[url])
    rows = pages.select(F.struct(*pages.columns).alias("row"), F.coalesce(F.col(url), F.lit("")).alias("__url")).join(judged, "__url", "left")
    found = {
        "__host": host, "__path": path, "__rule": F.when(F.col("__ordered"), F.col("__name")), "__pattern": F.when(~F.col("__ordered"), F.col("__name")),
        "__verdict": F.coalesce("__verdict", F.lit(otherwise))}
    return rows.select(*[F.col("row")[c].alias(c) for c in pages.columns if c not in found], *[v.alias(c) for c, v in found.items()])
