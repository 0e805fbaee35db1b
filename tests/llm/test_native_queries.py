"""Queries that SQL can express, and their edge cases."""

import duckdb
import pytest

from checks.compare import TABLES, bag
from pitchframe.llm import source_mix
from pitchframe.llm.exact_dedup import exact_dedup
from pitchframe.llm.license_scan import scan_licenses
from pitchframe.llm.registry import QUERIES, SQL
from pitchframe.llm.source_mix import mix_sources, taken_words
from pitchframe.llm.url_filter import RULES, judge_urls

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag([d[0] for d in cur.description], cur.fetchall())


def test_exact_dedup_edges(spark):
    df = spark.createDataFrame([(1, "Ab", 0), (2, "aB", 0), (3, "É", 0), (4, "é", 0), (5, None, 0), (6, "", 0), (None, "ab", 0)], "doc_id bigint, text string, n int")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), None: (2, 3, False), 3: (3, 1, True), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True)}
    assert exact_dedup(df.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://A.example.NET/en/x", "http://example.net/en", "https://net/", "http://x.net", "http://x.com/de/", "http://example.com/de/a?b", "http://x.org/fr/", None, "no", ""]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = [(r.rule, r.verdict) for r in judge_urls(df, RULES).orderBy("page_id").collect()]
    assert got == [("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), (None, "allow"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow")]


def test_licenses_inherit_from_the_nearest(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("a/COPYING", "Licensed under CC BY 4.0."), ("a/b/x", "code"), ("c/y", None), ("a/b/z", "q\nLicensed under the Apache License, Version 2.0.\n" + "w " * 99), (None, "t")]
    got = {r.path: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"LICENSE": ("MIT", "own"), "a/COPYING": ("CC-BY-4.0", "own"), "a/b/x": ("CC-BY-4.0", "inherited"), "c/y": ("MIT", "inherited"), "a/b/z": ("Apache-2.0", "own"), None: (None, None)}


def test_mix_edges(spark):
    rows = [(i, None if i % 3 == 0 else f"s{i % 2}", "w " * (i % 40)) for i in range(200)] + [(None, "s0", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    told = taken_words(df).collect()
    assert len(told) == 201 and all(0 <= r.taken <= 3 * r.size for r in told)
    for target, taken in {(r.target, sum(x.taken for x in told if x.target == r.target)) for r in told}:
        assert abs(target - taken) <= 20
    mixed = mix_sources(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.taken // r.size for r in told if r.taken}
    assert taken_words(df.limit(0)).count() == 0


def test_mix_draws_come_from_the_tree(spark, monkeypatch):
    """Every draw of every source stands in one shard, shards have even sizes, and nothing is taken that no shard draws."""
    monkeypatch.setattr(source_mix, "BLOCK_WORDS", 50)
    monkeypatch.setattr(source_mix, "SHARD_BLOCKS", 3)
    monkeypatch.setattr(source_mix, "SOURCE_GROUPS", 2)
    df = spark.createDataFrame([(i, f"s{i % 5}", "w " * (i % 9)) for i in range(300)], "doc_id bigint, source string, text string")
    told = taken_words(df).collect()
    assert {tuple(r.shards) for r in taken_words(df).collect()} == {tuple(r.shards) for r in told}
    assert all(r.taken == r.size * len(r.shards) and r.shards == sorted(r.shards) for r in told)
    rows = source_mix._sized(df, "doc_id", "source", "text").select("_s", "_size", "_h")
    _, draws = source_mix.mix_plan(rows)
    draws = draws.collect()
    assert len({(d._s, d._block, d.epoch) for d in draws}) == len(draws)
    per_shard = [sum(d.shard == k for d in draws) for k in range(max(d.shard for d in draws) + 1)]
    assert len(per_shard) > 4 and max(per_shard) - min(per_shard) <= 1
    # A tree that deals nothing leaves nothing to take.
    tree = source_mix.split_tree
    monkeypatch.setattr(source_mix, "split_tree", lambda *a: tree(*a).where("shard = 0"))
    assert 0 < sum(bool(r.shards) for r in taken_words(df).collect()) < sum(bool(r.shards) for r in told)


def test_split_tree_is_hypergeometric(spark):
    """Quotas are kept, a source's runs follow each other, and its share of a shard has the right mean."""
    quotas = spark.createDataFrame([("sa", 700), ("sb", 200), ("sc", 100)], "_s string, q bigint")
    means = []
    for seed in range(3):
        got = source_mix.split_tree(quotas, 1000, 7, seed).collect()
        for s, q in (("sa", 700), ("sb", 200), ("sc", 100)):
            mine = sorted((r.shard, r.start, r.quota) for r in got if r._s == s)
            assert sum(m[2] for m in mine) == q
            assert [m[1] for m in mine] == [sum(x[2] for x in mine[:k]) for k in range(len(mine))]
        assert {sum(r.quota for r in got if r.shard == k) for k in range(7)} <= {142, 143}
        means += [r.quota / 143 for r in got if r._s == "sa"]
    assert abs(sum(means) / len(means) - 0.7) < 0.02 and max(means) - min(means) > 0.02
    with pytest.raises(ValueError):
        source_mix.split_tree(quotas, 10**9, 7)


def test_targets_fill_like_vessels(spark):
    """Against sharing anew until no target is above its cap."""
    sizes = [("~", 40, 1), *[(f"s{k:02}", n, 1) for k, n in enumerate([1, 0, 5, 3000, 9, 10, 2, 800, 0, 77])]]
    got = {r._s: r.target for r in source_mix.targets(spark.createDataFrame(sizes, "_s string, source_size bigint, docs bigint")).collect()}
    weight = {s: k % 3 + 1 for k, (s, _, _) in enumerate(sorted(sizes))}
    cap, want, left = {s: 3 * n for s, n, _ in sizes}, {}, float(sum(n for _, n, _ in sizes))
    while rest := [s for s in cap if s not in want]:
        level = left / sum(weight[s] for s in rest)
        full = [s for s in rest if level * weight[s] >= cap[s]]
        want.update({s: cap[s] for s in full} or {s: level * weight[s] for s in rest})
        left -= sum(cap[s] for s in full)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(3944)
