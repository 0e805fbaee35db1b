import random
import re

import numpy as np
import pytest
import xxhash

from pitchframe.llm import simhash as sh


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    """Root (smallest number) of each by plain search over all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def cluster(rnd, n, centres, flips):
    base = [rnd.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rnd.choice(base)
        for _ in range(rnd.randrange(flips)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


def gray(x):
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> k
    return x


@pytest.mark.parametrize("n,centres,flips", [(1, 1, 2), (2, 1, 2), (37, 3, 5), (400, 20, 9), (500, 2, 6)])
def test_link_against_brute_force(n, centres, flips):
    fps = sorted(cluster(random.Random(n), n, centres, flips), key=gray)
    a = np.array(fps, dtype=np.uint64)
    assert sh.link(a, None).tolist() == brute_components(fps)
    cut = n // 3
    if cut:
        ab = sh.link(a[:cut], a[cut:])
        aa, bb = sh.link(a[:cut], None), sh.link(a[cut:], None) + cut
        labels = np.arange(n)
        for part in (ab, np.concatenate([aa, bb])):
            sh.union(labels, np.arange(n), part)
        assert labels.tolist() == brute_components(fps)


@pytest.mark.parametrize("run", [8, 50, 1 << 15])
def test_edges_and_components(spark, run):
    fps = cluster(random.Random(run), 300, 25, 7) + [0]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    got = {r.u: r.root for r in sh.components(sh.near_edges(df, run=run)).collect()}
    want = brute_components(fps)
    groups = {}
    for x, root in zip(fps, want):
        groups.setdefault(got.get(x - (1 << 64) if x >> 63 else x, ("alone", x)), set()).add(root)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_groups_of_odd_texts(spark, rows):
    rnd = random.Random(9)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(80)) for _ in range(12)]
    texts = [None, "", " \t\n", "One", "ONE", "one two", "É é", "a b c", *base]
    for b in base:
        words = b.split()
        for _ in range(4):
            words[rnd.randrange(80)] = rnd.choice(["x", "Y", "zz"])
            texts.append("\n".join(words).upper() if rnd.random() < 0.5 else " ".join(words))
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, None), (None, "One"), (None, "nobody else")]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, fp string").repartition(3)
    fps = [brute_fingerprint(t) for _, t in docs]
    root = brute_components(fps)
    least = {}
    for (k, _), r in zip(docs, root):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    got = sh.simhash_groups(df, run=16).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted([(r.key, r.fp % (1 << 64), r.component) for r in got], key=key) == sorted([(k, f, least.get(r)) for (k, _), f, r in zip(docs, fps, root)], key=key)
    kept = sh.keep_first(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([*set(least.values()), None], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sh.simhash_groups(df).count() == 0 and sh.keep_first(df).count() == 0
