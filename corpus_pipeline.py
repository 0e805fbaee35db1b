"""From raw documents to files of token ids, in five stages that each write a table and read the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchframe.llm.common import table
from pitchframe.llm.decontaminate import drop_contaminated
from pitchframe.llm.files import new_folder
from pitchframe.llm.quality import keep_quality
from pitchframe.llm.simhash import keep_first
from pitchframe.llm.source_mix import mix_sources
from pitchframe.llm.token_planes import read_digests, write_tokens
from pitchframe.plans.session import staged, tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not too high for their language."""
    return keep_quality(docs, table(tune(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    tune(spark)
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_contaminated(docs, table(tune(spark), sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    tune(spark)
    return mix_sources(docs).drop("_shard", "_place")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents in files; a row for each document, read back from them."""
    import public_tokenizers

    tune(spark)
    return read_digests(write_tokens(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", token_ids),
]

# A language model, components of a graph and a tokenizer are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
