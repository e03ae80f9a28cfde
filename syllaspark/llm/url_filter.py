"""URL filter: a trie over reversed host labels and then path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: The size up to which a rule set is broadcast, in rules and in characters.
MAX_RULES, MAX_CHARS = 1_000_000, 64_000_000
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """host: fits it and its subdomains. path: fits if the url's path starts with it. verdict: allow or block."""

    host: str
    path: str
    verdict: str


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    segments: dict[str, _Node] = field(default_factory=dict)
    #: Rules whose path ends inside the segment that would come next: (begin of that segment, rule), longest first.
    ends: list[tuple[str, str, str]] = field(default_factory=list)


class Trie:
    """Rules by host labels from the right, then by whole path segments; what a rule has after its path's last slash is compared as the begin of the next segment."""

    def __init__(self, rules: list[Rule]) -> None:
        if len(rules) > MAX_RULES or sum(len(r.host) + len(r.path) for r in rules) > MAX_CHARS:
            raise ValueError("too many rules to broadcast; split the rule set by top-level label and apply the parts to their urls")
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.labels.setdefault(label, _Node())
            *segments, rest = rule.path.split("/")
            for s in segments:
                node = node.segments.setdefault(s, _Node())
            node.ends.append((rest, rule.host + rule.path, rule.verdict))
            node.ends.sort(key=lambda e: (-len(e[0]), e[2] != "block"))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that fits and is longest: most host labels, then longest path; block before allow if the same rule is given as both."""
        hosts, node = [self.root], self.root
        for label in reversed(host.split(".")) if host else ():
            if (node := node.labels.get(label)) is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in reversed(hosts):
            best, at = None, 0
            while node is not None:
                for rest, rule, verdict in node.ends:
                    if segments[at].startswith(rest):
                        best = rule, verdict
                        break
                node = node.segments.get(segments[at]) if at + 1 < len(segments) else None
                at += 1
            if best:
                return best
        return None


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`. Query and fragment belong to neither."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_UPPER), slash + path


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; without a fitting rule, rule is null and the verdict is `default`.

    Only the two columns are read. A null or empty url has empty host and path. Repeated rows are judged alike.
    One narrow pass, no shuffle: a hot host costs no more than others.
    """
    spark = pages.sparkSession
    ship(spark)
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for urls in parts:
            rows = []
            for u in urls:
                host, path = split_url(u)
                rows.append((host, path, *(find(host, path) or (None, default))))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return pages.select(F.col(page_id).alias("page_id"), judged(F.col(url)).alias("_j")).select("page_id", "_j.*")


RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, max_by(rverdict, length(rhost) * 1000 + length(rpath)) AS rverdict
  FROM p, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
