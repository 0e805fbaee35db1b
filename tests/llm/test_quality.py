import math
import random
from collections import Counter, defaultdict

import pytest

from pitchframe.llm import quality as q


def padded(text, order):
    data = b"\0" * (order - 1) + (text or "").encode() + b"\0"
    return [data[i : i + order] for i in range(len(data) - order + 1)]


def kneser_ney(texts, order):
    """p(last byte | bytes before) by the textbook recursion over dictionaries."""
    counts = {order: Counter(g for t in texts for g in padded(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, by_context = {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
        value = lambda j: j / 2 if y is None or not n[j] else min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.05), j)
        discount[k] = {j: value(j) for j in (1, 2, 3)}
        by_context[k] = defaultdict(dict)
        for g, m in c.items():
            by_context[k][g[:-1]][g] = m

    def p(g):
        if not g:
            return 1 / 256
        below, seen = p(g[1:]), by_context[len(g)].get(g[:-1])
        if not seen:
            return below
        d, total = discount[len(g)], sum(seen.values())
        own = max(seen[g] - d[min(seen[g], 3)], 0) if g in seen else 0
        return own / total + sum(d[min(m, 3)] for m in seen.values()) / total * below

    return p


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = ["the", "of", "tion", "der", "ä", "on"]
    return [(i, rnd.choice(["en", "de", None]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(30)))) for i in range(60)]


@pytest.mark.parametrize("order", [2, 4])
def test_loss_against_brute_force(spark, corpus, order):
    docs = corpus + [(100, "en", None), (101, "en", "QQ zz!!"), (None, "de", "der der"), (7, "en", corpus[7][2])]
    df = spark.createDataFrame([(k, t, la, "x") for k, la, t in docs], "doc_id bigint, text string, lang string, block string").repartition(4)
    training = [k for k, _, _ in corpus if k % 3]
    keys = spark.createDataFrame([(k,) for k in training], "key bigint")
    got = q.score_documents(df, keys, order=order).collect()
    assert len(got) == len(docs)
    for lang in ("en", "de", ""):
        p = kneser_ney([t for k, la, t in docs if k in training and (la or "") == lang], order)
        want = sorted((str(k), round(-sum(math.log(p(g)) for g in padded(t, order)), 6)) for k, la, t in docs if (la or "") == lang)
        assert sorted((str(r.key), round(r.loss, 6)) for r in got if r.lang == lang) == want


def test_keeps_clean_and_rejects_junk(spark):
    """Held-out accuracy on the given labels."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = q.classify_quality(docs, q.trusted_keys(labels)).join(labels.where("toxic = 0"), "doc_id").toPandas()
    assert len(judged) == labels.where("toxic = 0").count()
    assert judged[judged.quality == 1].kept.mean() > 0.98
    assert judged[judged.quality == 0].kept.mean() < 0.4


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "en"), (None, None, None)], "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint")
    assert [r.kept for r in q.classify_quality(df, none).collect()] == [True, True]
    assert q.classify_quality(df.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert q.keep_quality(df, labels).columns == df.columns


def test_grams():
    packed, lengths = q.grams([b"ab", b""], 3)
    assert lengths.tolist() == [3, 1]
    assert [int(g).to_bytes(3, "big") for g in packed] == [b"\0\0a", b"\0ab", b"ab\0", b"\0\0\0"]
