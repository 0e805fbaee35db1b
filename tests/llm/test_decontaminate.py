import random
import re

import pytest

from pitchframe.llm import decontaminate as dc


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def naive_tiles(item, text, least):
    """Mark the longest unmarked common run, first by place, until none is long enough."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and not {i + n} & used_i and not {t + n} & used_t:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, t, n)
        if best is None:
            return out
        used_i |= set(range(best[0], best[0] + best[2]))
        used_t |= set(range(best[1], best[1] + best[2]))
        out.append(best)


@pytest.mark.parametrize("seed", range(30))
def test_tiles_against_naive(seed):
    rnd = random.Random(seed)
    item = [rnd.randrange(6 if seed % 3 else 50) for _ in range(rnd.randrange(3, 40))]
    text = []
    for _ in range(3):
        a = rnd.randrange(len(item))
        text += item[a : a + rnd.randrange(3, 20)] + [rnd.randrange(60) for _ in range(rnd.randrange(4))]
    got, want = dc.tiles(item, text, 3), naive_tiles(item, text, 3)
    if seed % 3 == 0:  # few repeated words: ties don't matter
        assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
    assert all(item[i : i + n] == text[t : t + n] and n >= 3 for i, t, n in got)
    for side in (0, 1):
        marks = [x for tile in got for x in range(tile[side], tile[side] + tile[2])]
        assert len(marks) == len(set(marks))
    # Nothing long enough is left.
    left_i = [None if any(i <= k < i + n for i, _, n in got) else w for k, w in enumerate(item)]
    left_t = [None if any(t <= k < t + n for _, t, n in got) else w for k, w in enumerate(text)]
    runs = {tuple(left_i[k : k + 3]) for k in range(len(item) - 2) if None not in left_i[k : k + 3]}
    assert not runs & {tuple(left_t[k : k + 3]) for k in range(len(text) - 2) if None not in left_t[k : k + 3]}


def test_words_of_texts():
    texts = ["The  cat, É é", "", "!!", "a", "THE the"]
    names, counts = dc.words_of(texts)
    assert counts.tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(names.tolist())) == len(set(flat)) and len(dict(zip(flat, names.tolist()))) == len(set(flat))
    assert [names[0], names[-1]] == [names[-2], names[-2]]


def test_pairs_against_brute_force(spark, rows):
    rnd = random.Random(2)
    vocabulary = ["w%d" % i for i in range(40)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [make(rnd.randrange(4, 40)) for _ in range(25)] + [["one"], []]
    docs = []
    for i in range(60):
        text = make(rnd.randrange(60))
        item = rnd.choice(items[:25])
        if i % 3 == 0:  # reordered halves, upper case, other blanks
            half = len(item) // 2
            text = text[:10] + item[half:] + text[10:20] + item[:half] + text[20:]
        docs.append((i, (" ," if i % 2 else "\n").join(text).upper()))
    docs += [(100, None), (101, ""), (None, docs[0][1]), (3, docs[3][1]), (200, " ".join(items[3]) + " q" * 100_000)]
    want = []
    for k, t in docs[:-1]:
        for j, item in enumerate(items):
            if len(item) >= 5:
                covered = sum(n for _, _, n in naive_tiles(item, words(t), 5))
                if covered >= 0.5 * len(item):
                    want.append((k, j, covered))
    want.append((200, 3, len(items[3])))
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, item string").repartition(3)
    b = spark.createDataFrame([(j, " ".join(i), 1) for j, i in enumerate(items)] + [(99, None, 1)], "item_id bigint, text string, doc_id int")
    got = [(r.doc_id, r.item_id, r.covered) for r in dc.find_contamination(d, b).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 10
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([k for k, t in docs if k not in {w[0] for w in want}], key=str)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert dc.find_contamination(d.limit(0), b).count() == 0
    assert dc.find_contamination(d, b.limit(0)).count() == 0
    assert dc.find_contamination(d, b).count() == 1


def test_common_phrases_make_no_pairs(spark):
    """A phrase that all documents and all items share is left out of the join; no contaminated document is lost."""
    phrase = "which of these is right"
    items = [(j, f"{phrase} " + " ".join(f"i{j}w{k}" for k in range(30))) for j in range(20)] + [(50, phrase), (50, phrase + " x"), (None, phrase)]
    docs = [(i, f"d{i} {phrase} e{i}") for i in range(80)] + [(90, "a " + items[4][1]), (91, " ".join(items[5][1].split()[-17:])), (92, " ".join(items[5][1].split()[-18:]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted({(r.doc_id, r.item_id) for r in dc.find_contamination(d, b).collect() if r.item_id is not None})
    assert got == sorted([(i, 50) for i in [*range(80), 90]] + [(90, 4), (92, 5)])
    hot = spark.createDataFrame([(j, 10, s, 1) for j in range(5) for s in (1, 2 + j, 10 + j)], "item bigint, n_words bigint, seed bigint, times bigint")
    asked = spark.createDataFrame([(1,)] * 90 + [(s,) for s in range(2, 15)], "seed bigint")
    assert {r.seed for r in dc.rare_seeds(hot, asked, 5, 0.6).collect()} == set(range(2, 15)) - {7, 8, 9}
    assert 1 in {r.seed for r in dc.rare_seeds(hot, asked, 5, 0.5).collect()}


def test_filter_grows_with_the_seeds(spark, monkeypatch):
    monkeypatch.setattr(dc, "FILTER_BITS", 15)
    seeds = spark.range(5000).selectExpr("xxhash64(id) AS seed")
    for most, size in ((27, 1 << 14), (15, 1 << 12)):
        bits = dc.seed_filter(seeds, most)
        assert len(bits) == size
        assert all(bits[(r.seed % (size * 8)) // 8] >> (r.seed % 8) & 1 for r in seeds.limit(300).collect())
