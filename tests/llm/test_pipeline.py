"""The corpus pipeline, stage by stage against plain Python, on a small corpus with odd rows."""

from collections import Counter

import pandas as pd
import pytest

import corpus_pipeline as cp
from pitchframe.llm import decontaminate as dc
from pitchframe.llm.quality import classify_quality, trusted_keys
from pitchframe.llm.source_mix import taken_words
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_token_planes import brute

GIVEN = "/root/testdata/sf0.001"
# Columns of the caller that are named like working columns.
EXTRA = ["_row", "_digest", "fp", "key", "_size", "digest"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The given documents, of which some are copied under new ids, with NULL and empty texts, languages and sources."""
    path = tmp_path_factory.mktemp("corpus")
    docs = pd.read_parquet(f"{GIVEN}/documents.parquet")
    bench = pd.read_parquet(f"{GIVEN}/benchmark.parquet")
    more = docs.head(15).assign(doc_id=range(10_000, 10_015))
    odd = pd.DataFrame(
        {
            "doc_id": [20_000, 20_001, 20_002, 20_003, 20_004],
            "text": [None, "", " \n", bench["text"].iloc[0], "a b c"],
            "lang": ["en", None, "", "en", "xx"],
            "source": [None, "src0", "", "src1", "only"],
            "n_chars": [0, 0, 2, len(bench["text"].iloc[0]), 5],
        }
    )
    docs = pd.concat([docs, more, odd], ignore_index=True)
    docs.assign(**dict.fromkeys(EXTRA, "mine")).to_parquet(path / "documents.parquet")
    bench.to_parquet(path / "benchmark.parquet")
    pd.read_parquet(f"{GIVEN}/labels.parquet").to_parquet(path / "labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The documents, then what each stage made of the rows before."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(cp.staged(stage(spark, out[-1], folder)))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(steps):
    assert [name for name, _ in cp.STAGES] == ["quality", "near duplicates", "decontamination", "mixing", "token ids"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
        assert {tuple(r) for r in df.select(*EXTRA).distinct().collect()} == {("mine",) * len(EXTRA)}


def test_quality_drops_what_the_classifier_rejects(spark, steps, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = {r.doc_id: r.kept for r in classify_quality(steps[0], trusted_keys(labels)).collect()}
    kept = {d for d, _ in texts(steps[1])}
    assert kept == {d for d, k in judged.items() if k} and len(kept) < len(judged)
    # A bad model would throw out good text: clean labelled documents stay.
    good = {r.doc_id for r in trusted_keys(labels).collect()}
    assert len(good & kept) >= 0.97 * len(good & set(judged))


def test_near_duplicates_keep_the_first_of_each_group(steps):
    before = sorted(texts(steps[1]))
    roots = brute_components([brute_fingerprint(t) for _, t in before])
    assert sorted(texts(steps[2])) == [row for i, row in enumerate(before) if roots[i] == i]


def test_decontamination_drops_covered_items(spark, steps, folder):
    number = {}
    numbered = lambda text: [number.setdefault(w, len(number)) for w in words(text)]
    items = [numbered(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def dirty(text):
        own = numbered(text)
        return any(2 * sum(n for _, _, n in dc.tiles(item, own, 5)) >= len(item) for item in items if len(item) >= 5)

    before = texts(steps[2])
    assert sorted(texts(steps[3])) == sorted(row for row in before if not dirty(row[1]))
    assert len(before) > steps[3].count()


def test_mixing_takes_what_the_plan_says(steps):
    plan = {r.doc_id: r for r in taken_words(steps[3]).collect()}
    taken = Counter(d for d, _ in texts(steps[4]))
    assert taken == {d: r.taken // r["size"] for d, r in plan.items() if r.taken}
    assert all(n <= 3 for n in taken.values())


def test_tokens_equal_whole_text_encoding(steps):
    want = Counter((k, n, crc) for k, _, n, crc in brute(texts(steps[4])))
    rows = steps[5].collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_run_gives_the_same(spark, steps, folder):
    get = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert get(cp.run(spark, folder)) == get(steps[5])


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
