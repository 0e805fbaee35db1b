"""Ranked search against plain scoring of all documents, odd rows, and what the trees leave out."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pitchframe.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id bigint, text string, terms string, n int, item string", "item_id bigint, text string, block string"


def words(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(docs, items, top=20):
    cut = [(d[0], Counter(words(d[1]))) for d in docs]
    cut = [(i, c) for i, c in cut if c]
    n_docs, n_terms = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in {(i[0], i[1]) for i in items}:
        asked, scores = words(text), []
        for doc, c in cut:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            parts = (math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            scores.append((-sum(parts), doc is None, doc or 0, doc))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:top], 1)]
    return sorted(out, key=str)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"{rnd.choice('Wwé')}{int(vocabulary * rnd.random() ** 3)}" + rnd.choice(["", ",", ".\n", "\0"]) for _ in range(n))


@pytest.mark.parametrize("seed,tree,leaf,block", [(1, 16_384, 128, 1 << 19), (2, 60, 7, 1 << 19), (3, 100, 3, 300)])
def test_equals_plain_scoring(spark, monkeypatch, seed, tree, leaf, block):
    for name, value in (("TREE", tree), ("LEAF", leaf), ("QUERY_BYTES", block)):
        monkeypatch.setattr(ls, name, value)
    rnd = random.Random(seed)
    docs = [(i, prose(rnd, rnd.randrange(1, 60)), "x", 1, "y") for i in range(300)]
    docs += [(i + 300, docs[0][1], "x", 1, "y") for i in range(100)]
    items = [(i, prose(rnd, rnd.randrange(1, 30)), "z") for i in range(12)] + [(20, docs[0][1], "z")]
    got = ls.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n!?"), (4, "a b"), (4, "a b"), (4, "A"), (None, "a b"), (5, "ÀÉ é"), (6, "b " * 300_000), (7, "a_b-c"), (8, "q" * 100_000)]
    docs = [(*d, "x", 1, "y") for d in docs]
    items = [(1, "a"), (1, "a"), (1, "b b"), (None, "a b"), (2, None), (3, "..."), (4, "zz"), (5, "é à"), (6, "ÀÉ"), (7, "q" * 100_000)]
    items = [(*i, "z") for i in items]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, ls.ranked_search(d, i).collect()), key=str) == plain(docs, items)
    assert ls.ranked_search(d.limit(0), i).count() == 0 and ls.ranked_search(d, i.limit(0)).count() == 0


def test_bounds_hold_and_save_work():
    rnd, vocabulary, n = random.Random(5), 300, 2000
    topics = [rnd.sample(range(vocabulary), 12) for _ in range(16)]
    lists = [sorted(topics[k % 16]) for k in range(n)]
    ends = np.cumsum([0] + [len(x) for x in lists])
    vectors = ls.Vectors(list(range(n)), ends, np.concatenate(lists), np.array([rnd.randrange(600_000, 650_000) for _ in range(ends[-1])]))
    weights = np.array([rnd.randrange(500, 9000) for _ in range(vocabulary)])
    tree, work = ls.BallTree(vectors, weights), 0
    for topic in topics:
        asked, counts = np.array(sorted(topic)), np.ones(12, dtype=np.int64)
        dense = np.zeros(vocabulary, dtype=np.int64)
        dense[asked] = weights[asked]
        scores, bounds = tree.rows.dot(dense), tree.bounds(asked, counts)
        assert all(scores[a:b].max() <= bounds[k] for k, (a, b, _) in enumerate(tree.spans))
        best = ls.Best()
        work += tree.search(asked, counts, dense, best)
        assert best.rows == sorted((-int(s), i) for s, i in zip(scores, tree.rows.ids) if s > 0)[:20]
    assert work < 0.5 * n * len(topics)
