"""URL filters: a trie over reversed host labels, then path segments.

A rule is (action, host, path). The trie is built once on the driver from the rule list, which must stay within
``MAX_RULES`` (a rule file, not data), and is sent with the function; no page is shuffled. A URL walks down its reversed
labels; at every host node that ends a rule host, it walks its path segments, the last one by prefix. The longest
match wins: more host labels first, then a longer path, and block before allow where both are the same rule.

Null URLs, and URLs without ``://``, have an empty host and path, fit no rule and get the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(_LOWER), path[:end]


class HostPathTrie:
    """Nodes are dicts: host labels under ``h``, and under ``p`` the path trie of a rule host.

    A path node has its whole next segments under ``s`` and the rules that end inside the next segment under ``e``,
    as {prefix: (action, name)}.
    """

    def __init__(self, rules: tuple[tuple[str, str, str], ...]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; the trie is sent to every executor and holds at most {MAX_RULES}")
        self.root: dict = {"h": {}}
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node["h"].setdefault(label, {"h": {}})
            place = node.setdefault("p", {"s": {}, "e": {}})
            *whole, last = path.split("/")
            for segment in whole:
                place = place["s"].setdefault(segment, {"s": {}, "e": {}})
            if place["e"].get(last, ("allow",))[0] != "block":
                place["e"][last] = (action, host + path)

    @staticmethod
    def _path(place: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            ends = place["e"]
            if ends:
                for k in range(min(len(segment), max(map(len, ends))), -1, -1):
                    if segment[:k] in ends:
                        best = ends[segment[:k]]
                        break
            place = place["s"].get(segment) if i + 1 < len(segments) else None
            if place is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node["h"].get(label)
            if node is None:
                break
            if "p" in node:
                best = self._path(node["p"], path) or best
        return best


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict in the place of columns of those names."""
    trie = HostPathTrie(tuple(rules))

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = []
            for one in urls:
                host, path = split_url(one)
                action, rule = trie.match(host, path) or (default, None)
                rows.append((host, path, rule, action))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    judge = F.pandas_udf(judged, "host string, path string, rule string, verdict string")
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.select(*keep, judge(F.col(url)).alias("_judged")).select(*keep, "_judged.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


SQL = r"""
WITH cut AS (SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(action, h, p)),
fits AS (SELECT rid, arg_max(h || p, length(h) * 100000 + length(p)) AS rule, arg_max(action, length(h) * 100000 + length(p)) AS action
         FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits USING (rid)
"""
