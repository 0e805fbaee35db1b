"""Quality rules: counts against plain Python, odd rows, distances."""

import math
import random
import re

from pyspark.sql import functions as F

from pitchframe.llm.quality_rules import COMMON, WINDOW, judge, js_distance, measure


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + WINDOW)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h x", "w " * 300, "x\n\nx\n \n \nx\r\nx", "\x1fé 😀\x0b#$ ||",
    " ".join("abcdefgh"[i % 3] for i in range(40)), "the of and\n" * 90, " ".join(f"w{i % 50}" for i in range(120)), "q" * 200_000, "Ab9 ü, " * 4000,
]


def test_counts_equal_plain_counts(spark):
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(TEXTS[:12])] + [(3, "a", None, "x", "y"), (None, "b b", "", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, words string, t string")
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in measure(df).collect())
    assert got == sorted((str(r[0]), *plain(r[1])) for r in rows)


def test_long_texts_and_classes(spark):
    df = spark.createDataFrame([(12, TEXTS[12], "en"), (13, TEXTS[13], "xx")], "doc_id bigint, text string, lang string")
    one, many = measure(df).orderBy("doc_id").collect()
    assert (one.n_words, one.word_chars, one.n_repeat_words, one.classes) == (1, 200_000, 0, [200_000, 0, 0, 0, 0, 0, 0])
    # lower, space, wide, mark, upper, digit, other
    assert (many.n_words, many.n_repeat_words, many.classes) == (8000, 8000, [4000, 8000, 4000, 4000, 4000, 4000, 0])


def test_distance_equals_formula(spark):
    p, q = [3, 0, 5, 2], [100, 7, 0, 900]
    got = spark.range(1).select(js_distance(F.lit(p), F.lit(q)).alias("d"), js_distance(F.lit(p), F.lit(p)).alias("s"), js_distance(F.lit(p), F.lit([0] * 4)).alias("n")).first()
    x, y = [v / sum(p) for v in p], [v / sum(q) for v in q]
    kl = lambda a, b: sum(u * math.log2(2 * u / (u + v)) for u, v in zip(a, b) if u)
    assert abs(got.d - math.sqrt((kl(x, y) + kl(y, x)) / 2)) < 1e-8 and got.s == 0 and got.n is None


def test_verdicts(spark):
    words = COMMON["en"].split()

    def prose(k):
        rnd = random.Random(k)
        return " ".join(rnd.choice(words) if rnd.random() < 0.4 else "".join(rnd.choices("abcdefgh", k=5)) for _ in range(300))

    rows = [(i, prose(i), "en") for i in range(40)]
    rows += [(100, "#$ %& " * 60, "en"), (101, " ".join(f"tab{chr(97 + i % 26)}{chr(97 + i // 3)}" for i in range(70)), "en"), (102, "too short", "en")]
    # Nothing to compare with in this language; a text below 50 words is judged by the base rules alone.
    rows += [(103, " ".join(f"#{i}" for i in range(60)), "zz"), (104, " ".join(f"#{i}" for i in range(30)), "en"), (105, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in judge(df).collect()}
    assert all(got[i] == (False, True) for i in range(40))
    assert got[100] == (True, False) and got[101] == (False, False) and got[102] == (True, False)
    assert got[103] == got[104] == (False, True) and got[105] == (True, False)
    assert judge(df.limit(0)).count() == 0
