"""Exact duplicates found by digest and full content, in three combining steps that no hot group can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import LOWER, UPPER, lower_ascii, table
from pitchframe.plans.session import staged, tune

SALTS = 32


def _normal(text: str) -> Column:
    return lower_ascii(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def dedup_winners(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text: digest, normal (the text), keep_id, group_size.

    Grouping by digest and salt, with the text itself among the keys, merges equal texts inside each task before the
    shuffle and again in each salt; the last grouping merges one winner of each salt. All three steps compare whole
    texts, so two texts of one digest stay apart. The salt is the number of the input partition: a group that holds a
    third of all rows arrives as one row from each task, spread over the salts.
    """
    marked = df.select(
        F.col(f"`{key}`").alias("id"), _normal(text).alias("normal"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    ).withColumn("digest", F.sha2(F.col("normal").cast("binary"), 256))
    salted = marked.groupBy("digest", "salt", "normal").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "normal").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's `key`, keep_id, group_size, kept and text_sha256. Extra columns play no part.

    Texts are equal if identical after A-Z are lower-cased; NULL counts as empty. Of equal texts the row with the
    largest key stays; rows without a key lose to any row that has one. Rows that repeat the winning key with the same
    text are the same document and are all marked kept. An empty table gives an empty table.
    """
    winners = dedup_winners(df, key, text)
    # The text comes back only for digests that several texts share; elsewhere the digest stands for its one text.
    groups = staged(
        winners.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        )
    )
    rows = df.select(F.col(f"`{key}`").alias("id"), _normal(text).alias("normal"))
    rows = rows.withColumn("digest", F.sha2(F.col("normal").cast("binary"), 256))
    single = rows.drop("normal").join(groups.where("texts = 1").drop("texts"), "digest")
    shared = rows.join(groups.where("texts > 1").select("digest"), "digest", "left_semi")
    apart = shared.groupBy("digest", "normal").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    collided = shared.join(apart, ["digest", "normal"]).drop("normal")
    return single.unionByName(collided).select(
        F.col("id").alias(key),
        "keep_id",
        F.col("group_size").cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return exact_dedup(table(spark, folder, "documents"))


OP5_SQL = f"""
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM normal JOIN groups USING (t)"""
