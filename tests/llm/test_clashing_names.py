"""Extra columns named like the operators' working columns come through unchanged."""

import pytest

from pitchframe.llm.decontaminate import drop_contaminated
from pitchframe.llm.quality import keep_quality
from pitchframe.llm.simhash import keep_first
from pitchframe.llm.source_mix import mix_sources

EXTRA = ("_digest", "_key", "_lang", "_s", "_size", "_h", "_id", "_row", "_block", "shard", "epoch", "n_blocks", "cut_h", "key", "digest", "words")


@pytest.mark.parametrize("stage", ["quality", "simhash", "decontamination", "mixing"])
def test_extra_columns_stay(spark, stage):
    rows = [(i, f"word{i} and some other word{i * 7} here", "en", f"s{i % 2}", *[f"{c}{i}" for c in EXTRA]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this stands in any of them")], "item_id bigint, text string")
    work = {"quality": lambda: keep_quality(docs, labels), "simhash": lambda: keep_first(docs), "decontamination": lambda: drop_contaminated(docs, bench), "mixing": lambda: mix_sources(docs).drop("_shard", "_place")}
    got = work[stage]()
    assert got.columns == docs.columns
    told = {tuple(r) for r in got.collect()}
    assert told and told <= set(rows)
