"""URL filter rules indexed by their rarest literal token."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

# The default rules, a host and a path that starts with what is given.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokens_of(rule: str) -> list[str]:
    """Literal tokens every URL that fits the rule must have: the labels of its host (`h:`) and its whole path segments (`p:`)."""
    host, _, path = rule.partition("/")
    whole = ("/" + path).split("/")[1:-1]
    return list(dict.fromkeys([f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in whole if x]))


def index_rules(rules: list[tuple[str, str]]) -> dict[str, list[dict]]:
    """token -> the rules filed under it. Each rule is filed once, under the token that the fewest rules have, ties to the longest
    token and then the first in order. A rule with no token is filed under the empty one, which every URL has."""
    count = Counter(t for _, r in rules for t in tokens_of(r))
    index: dict[str, list[dict]] = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {verdict} {rule}")
        host, _, path = rule.partition("/")
        token = min(tokens_of(rule), key=lambda t: (count[t], -len(t), t), default="")
        # the host or a subdomain of it, then a path with that start
        pattern = (rf"(?s)^(?:[^/]*\.)?{java_quote(host.lower())}" if host else r"(?s)^[^/]*") + java_quote("/" + path)
        index.setdefault(token, []).append({"rule": rule, "verdict": verdict, "pattern": pattern})
    return index


def by_bucket(index: dict[str, list[dict]]) -> list[list[dict]]:
    """The index as a hash table: the rules of a token lie in bucket crc32(token) mod the number of buckets, which is that of the tokens."""
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(index)))]
    for token, rules in index.items():
        buckets[zlib.crc32(token.encode()) % len(buckets)] += [{"token": token} | r for r in rules]
    return buckets


def java_quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-/])", r"\\\1", text) if text else ""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: the host from the first :// up to / ? # or the end, A-Z lower-cased, the path from there up
    to ? # or the end. Both are empty for a null and where there is no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return ascii_lower(host), path


def filter_urls(df: DataFrame, url: str = "url", rules: list[tuple[str, str]] | None = None, otherwise: str = "allow") -> DataFrame:
    """df with the columns host, path, rule and verdict for its URLs.

    The tokens of a URL fetch candidate rules from the index; only those run their regular expression. Of the rules
    that fit, the longest wins, ties to block and then to the rule first in order. Without one, rule is null and the verdict
    `otherwise`. Null and malformed URLs have an empty host and path and fit no rule with a host. Columns of df with
    one of these names are replaced, others kept; repeated rows are judged each. No shuffle and no Python: one projection.
    The index is a literal of the size of the rule list, whatever the table's size.
    """
    kept = df.select(*[c for c in df.columns if c not in ("host", "path", "rule", "verdict")])
    index = index_rules(RULES if rules is None else rules)
    kind = "array<struct<token:string,rule:string,verdict:string,pattern:string>>"
    filed = F.from_json(F.lit(json.dumps(buckets := by_bucket(index))), f"array<{kind}>")
    host, path = url_parts(F.col(url))
    marked = lambda parts, mark: F.transform(parts, lambda x: F.concat(F.lit(mark), x))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), marked(F.split("host", r"\."), "h:"), marked(F.split("path", "/"), "p:")))
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(F.get(filed, (F.crc32(t) % len(buckets)).cast("int")), lambda r: r["token"] == t)))
    subject = F.concat("host", "path")
    fits = F.filter("_candidates", lambda r: F.regexp_like(subject, r["pattern"]))
    # the largest of (length, block before allow, earlier rule)
    ranked = F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("n"), F.when(r["verdict"] == "block", 0).otherwise(1).alias("v"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return (
        kept.withColumns({"host": host, "path": path})
        .withColumn("_candidates", fetched)
        .withColumn("_best", F.array_min(ranked))
        .select(*kept.columns, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))
    )
