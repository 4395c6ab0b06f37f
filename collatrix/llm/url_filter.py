"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

The trie is broadcast. It holds the rules alone, so its size is that of the rule
list; ``filter_urls`` refuses a list beyond ``max_rules``, and ``join_urls``
takes its place there: each url meets the rules on (host, path) equality of its
host suffixes, by a join.

A rule fits its host and all subdomains if the url's path starts with the rule's
path. Of the rules that fit, the one with the most host labels wins, then the
longest path, then block over allow. Urls that no rule fits get ``default``.

Defined cases: a null url, or one without ``://``, has an empty host and path,
which no rule fits; empty labels are kept as they are; rows that repeat are
judged each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.llm.store import read

#: (verdict, rule): the production list.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
MAX_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    return host.translate(_ASCII_LOWER), slash + path


class UrlTrie:
    """Nodes are dicts: host labels from the top domain down, then whole path segments.

    At a path node, key ``""`` holds the outcomes of rules that end inside the next
    segment, longest first: (start of the segment, verdict, rule).
    """

    PATH = 0  # no label or segment is an int

    def __init__(self, rules: Iterable[tuple[str, str]] = ()):
        self.root: dict = {}
        for verdict, rule in rules:
            self.add(verdict, rule)

    def add(self, verdict: str, rule: str) -> None:
        host, path = split_rule(rule)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(self.PATH, {})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.setdefault(segment + "/", {})
        ends = [x for x in node.get("", []) if x[0] != rest or (x[1] == "block" and verdict != "block")]
        if not any(x[0] == rest for x in ends):
            ends.append((rest, verdict, host + path))
        node[""] = sorted(ends, key=lambda x: -len(x[0]))

    @staticmethod
    def _longest_path(node: dict, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while node is not None:
            for start, verdict, rule in node.get("", ()):
                if path.startswith(start, at):
                    best = (verdict, rule)
                    break
            end = path.find("/", at)
            if end < 0:
                break
            node, at = node.get(path[at : end + 1]), end + 1
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the rule that wins, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if self.PATH in node:
                best = self._longest_path(node[self.PATH], path) or best
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path of a url."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_ASCII_LOWER), slash + path


def filter_urls(urls: DataFrame, rules: Iterable[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Per row its key, host, path, rule (null if none fits) and verdict."""
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; more than {max_rules} go through join_urls")
    trie = urls.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for batch in batches:
            out = []
            for x in batch:
                host, path = split_url(x)
                verdict, rule = match(host, path) or (default, None)
                out.append((host, path, rule, verdict))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])

    judged = urls.select(F.col(key).alias("key"), judge(F.col(url)).alias("x"))
    return judged.select(F.col("key").alias(key), "x.host", "x.path", "x.rule", "x.verdict")


def _host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def join_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """What ``filter_urls`` returns, for rule lists of any size: rules is (verdict, rule), and nothing is broadcast by force.

    Each distinct host meets the rules of its suffixes in an equality join; the longest path that fits is kept by an aggregate.
    """
    host, path = _host_path(F.col(url))
    rows = urls.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    parts = rules.select("verdict", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("rule_host"), "rule")
    parts = parts.withColumn("rule_path", F.expr("substring(rule, length(rule_host) + 1)"))
    labels = F.split("host", r"\.")
    suffixes = rows.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fits = suffixes.join(parts, "rule_host").where(F.expr("startswith(path, rule_path)"))
    order = F.struct(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("n"), "verdict")
    best = fits.groupBy("row").agg(F.max(F.struct(order.alias("o"), F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    return rows.join(best, "row", "left").select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.o.verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
    ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host) * 10000 + length(rule_path)) AS rule,
    arg_max(verdict, length(rule_host) * 10000 + length(rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT split.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
"""

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE = {"op10_url_filter": OP10_SQL}
