import hashlib
import random

import numpy as np
import pytest

from pitchframe.llm import repeats as rp


def brute(docs, length, keep):
    """Covered bytes by a dictionary of all windows."""
    where = {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    for i in order:
        data = (docs[i][1] or "").encode()
        for a in range(len(data) - length + 1):
            where.setdefault(data[a : a + length], []).append((i, a))
    out = []
    for i, (key, text) in enumerate(docs):
        data, gone = (text or "").encode(), set()
        for a in range(len(data) - length + 1):
            places = where[data[a : a + length]]
            if len(places) > 1 and (keep == "none" or places[0] != (i, a)):
                gone.update(range(a, a + length))
        rest = bytes(b for k, b in enumerate(data) if k not in gone)
        runs = sum(1 for k in gone if k - 1 not in gone)
        out.append((key, len(data), len(gone), runs, hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=str)


def corpus(seed, length):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("abcdé") for _ in range(n))
    passages = [make(rnd.randrange(length // 2, length * 2)) for _ in range(6)]
    docs = []
    for i in range(40):
        text = make(rnd.randrange(length))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 2)
            if rnd.random() < 0.4:  # one letter differs
                k = rnd.randrange(len(p))
                p = p[:k] + "z" + p[k + 1 :]
            text += p[a:] + make(rnd.randrange(length // 2))
        docs.append((i * 2 + 5, text))
    docs += [(1, None), (2, ""), (3, make(length - 1)), (900, "x" * (length * 3)), (901, "xy" * length), (902, docs[3][1]), (903, docs[3][1])]
    docs += [(None, docs[5][1] + "!"), (904, "q" * length), (905, "q" * (length - 1))]
    return docs


@pytest.mark.parametrize("seed,length,gram,group_rows", [(1, 40, 8, 1 << 14), (2, 40, 8, 3), (3, 24, 16, 1 << 14), (4, 64, 8, 1)])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_against_brute_force(spark, seed, length, gram, group_rows, keep):
    docs = corpus(seed, length)
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, digest string").repartition(3)
    got = rp.cut_repeats(df, keep=keep, length=length, gram=gram, group_rows=group_rows).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got]
    assert sorted(got, key=str) == brute(docs, length, keep)


def test_planted_passages_of_over_50_words(spark, tmp_path):
    """The limit is 400 bytes, whatever the words: 60 words of 399 bytes stay, 400 bytes go, the size tells neither."""
    rnd = random.Random(5)
    make = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    short = " ".join(make(5) for _ in range(59)) + " " + make(45)
    longer, clean = " ".join(make(5) for _ in range(66)) + " abcd", make(900)
    assert (len(short), len(short.split()), len(longer), len(longer.split())) == (399, 60, 400, 67)
    docs = [(1, f"{make(90)}1{short}2{make(90)}"), (2, f"{make(40)}3{short}4{make(9)}"), (3, f"{make(90)}5{longer}6{make(90)}")]
    docs += [(4, f"{make(7)}7{longer}8"), (5, clean), (6, make(300)), (7, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rp.op8_repeats(spark, str(tmp_path)).collect()]
    want = [r[:5] for r in brute(docs, 400, "none")]
    assert sorted(got) == sorted(want)
    assert {r[0]: r[2] for r in got} == {1: 0, 2: 0, 3: 400, 4: 400, 5: 0, 6: 0, 7: 0}


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(rp, "PORTION", 1000)
    text = "".join(random.Random(1).choice("ab") for _ in range(5000)).encode()
    windows = []
    for at, part in rp._slices(text, 40):
        (h, pos, first, last), = rp.anchors([part], 40, 8)
        windows += [at + i for a, b in zip(first, last) for i in range(a, b + 1)]
        assert all(0 <= p - b and p - a <= 32 for p, a, b in zip(pos, first, last))
    assert windows == list(range(5000 - 39))


def test_rolling_and_minimum():
    rnd = np.random.default_rng(0)
    flat = rnd.integers(0, 3, 500, dtype=np.uint8)
    h = rp.rolling(flat, 6)
    names = {}
    for i in range(495):
        assert names.setdefault(bytes(flat[i : i + 6]), h[i]) == h[i]
    assert len(set(names.values())) == len(names)
    for w in (1, 7, 495):
        assert rp.sliding_min(h, w).tolist() == [h[i : i + w].min() for i in range(495 - w + 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert rp.cut_repeats(df).count() == 0


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_joins_split(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split_joins(df):
    """Joins on a hot key that the finished plan deals out to several tasks."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "skew=true" in x]


def test_join_on_a_name_in_very_many_texts_is_split(spark, small_joins_split):
    rows = [(7, b"hot %d" % i, i) for i in range(8000)] + [(i + 100, b"%d" % i, i) for i in range(2000)] + [(9, b"copy", 5)] * 2
    out = rp.repeated_anchors(spark.createDataFrame(rows, "h bigint, digest binary, pos bigint").repartition(8))
    assert sorted(r.pos for r in out.collect()) == list(range(8000))
    assert split_joins(out)


def test_join_on_a_window_in_very_many_texts_is_split(spark, small_joins_split):
    passage = "".join(random.Random(3).choice("abcdefgh") for _ in range(40))
    docs = spark.createDataFrame([(i, f"{i:09d}{passage}{i:09d}") for i in range(4000)], "id bigint, text string").repartition(8)
    rows = docs.selectExpr("id", "text", "unhex(sha2(text, 256)) AS digest")
    digests = rows.selectExpr("digest", "id AS first")
    _, spans = rp.repeated_intervals(rows, digests, 40, 8, False, 16)
    assert sum((r.start, r.stop) == (9, 49) for r in spans.collect()) == 4000
    assert any("w1" in x and "Inner" in x for x in split_joins(spans))
