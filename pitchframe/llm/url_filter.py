"""Allow and block rules for urls: a trie over reversed host labels and path segments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import LOWER, UPPER, table

# The trie is broadcast, so the rules have a checked size.
MAX_RULE_BYTES = 32 << 20


@dataclass
class Node:
    """One host label or path segment: the nodes below it, the node where its paths begin, rules that end in it."""

    below: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    ends: list[tuple[str, str, str]] = field(default_factory=list)  # last piece of the path, rule, verdict


def build_trie(rules: list[tuple[str, str, str]]) -> Node:
    """`rules` holds (verdict, host, path). The last piece of a rule's path may end inside a segment of the url."""
    if sum(len(v) + len(h) + len(p) for v, h, p in rules) > MAX_RULE_BYTES:
        raise ValueError(f"the rules take more than {MAX_RULE_BYTES} bytes; raise MAX_RULE_BYTES if every executor can hold them")
    root = Node()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
            node = node.below.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment, Node())
        # Block goes first, so it wins over an allow rule of the same host and path.
        node.ends.append((last, host + path, verdict))
        node.ends.sort(key=lambda e: (-len(e[0]), e[2] != "block"))
    return root


def longest_match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the entry with the most host labels, then the longest path."""
    found, node, pieces = None, root, path.split("/")
    for label in reversed(host.split(".")):
        node = node.below.get(label)
        if node is None:
            break
        at, k = node.paths, 0
        while at is not None:
            hit = next((e for e in at.ends if pieces[k].startswith(e[0])), None)
            if hit:
                found = hit
            at, k = (at.below.get(pieces[k]) if k + 1 < len(pieces) else None), k + 1
    return found and (found[1], found[2])


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Each row of `df` with host, path, rule and verdict; columns of these names are replaced.

    Urls without `://` and NULL have empty host and path and get the default, as do all urls no rule fits. A repeated
    row is judged each time. An empty table gives an empty table. No rules: all rows get the default.
    """
    spark = df.sparkSession
    trie = spark.sparkContext.broadcast(build_trie(rules))
    names = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(*[F.col(f"`{c}`") for c in names], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))

    @F.pandas_udf("rule string, verdict string")
    def judge(host, path):
        import pandas as pd

        hits = [longest_match(trie.value, h, p) or (None, default) for h, p in zip(host, path)]
        return pd.DataFrame(hits, columns=["rule", "verdict"])

    judged = parts.withColumn("_judged", judge("host", "path"))
    return judged.select(*[F.col(f"`{c}`") for c in names], "host", "path", "_judged.rule", "_judged.verdict")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
    for i, (v, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2]))
)
OP9_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE {_FITS.format(*[h + p for _, h, p in RULES])} END AS rule,
  CASE {_FITS.format(*[v for v, _, _ in RULES])} ELSE 'allow' END AS verdict
FROM parts"""
