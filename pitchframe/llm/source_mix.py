"""Mixing of sources to target weights: exact block quotas, split among shards by a hypergeometric tree."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import table, whole_row
from pitchframe.plans.ranking import position_by_sort
from pitchframe.plans.session import staged, tune

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
# A block holds about so many words and documents, a shard so many blocks.
BLOCK_WORDS, BLOCK_DOCS, SHARD_BLOCKS = 1 << 17, 1 << 15, 16
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
# Groups that the sources of a node are dealt to; draws below which numpy's draw is exact.
SOURCE_GROUPS, MAX_DRAWS = 1024, 10**9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *[F.coalesce(F.col(p).cast("string"), F.lit("~")) for p in parts]).cast("binary"))


def _sized(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """_row (all of a row), _id, _s (the source as a key that is never NULL), _size (words), _h (hash of the id)."""
    name = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("~"))
    rows = df.select(whole_row(df), F.col(f"`{key}`").alias("_id"), name.alias("_s"), word_count(F.col(f"`{text}`")).alias("_size"))
    return rows.withColumn("_h", _hash("_id"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """_s, source_size, docs, target, n_blocks of each source.

    The sources fill up like vessels: those whose share by weight reaches their cap are full, the rest share what is
    left by weight, until no more fill up. A round is one sum over the sources, so no task orders them all.
    """
    # NULL is "~", which follows every "s..." in code point order.
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_n", F.lit(len(weights))) + 1).cast("int"))
    named = staged(position_by_sort(sizes, ["_s"], "_n").select("_s", "source_size", "docs", w.alias("_w"), (F.col("source_size") * repeats).cast("double").alias("_cap")))
    total, level, before = named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, held, rest = named.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        if n == before or not rest:
            break
        before, level = n, (total - held) / rest
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS), F.ceil(F.col("docs") / BLOCK_DOCS))
    target = F.when(full, F.col("_cap")).otherwise(F.lit(level) * F.col("_w"))
    return named.select("_s", "source_size", "docs", target.alias("target"), blocks.cast("bigint").alias("n_blocks"))


def _block() -> Column:
    return F.pmod(F.conv(F.substring("_h", 1, 12), 16, 10).cast("bigint"), F.col("n_blocks")).alias("_block")


def _half(seed: int, parts: str):
    """For applyInPandas: how many of a node's draws go to its left half, part by part, picked without replacement."""

    def split(node: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        node = node.sort_values(parts)
        mark = int.from_bytes(hashlib.blake2b(f"{parts}|{node['_g'].iloc[0]}".encode(), digest_size=8).digest(), "big")
        rng = np.random.default_rng([seed, int(node["lo"].iloc[0]), int(node["hi"].iloc[0]), mark])
        return node.assign(left=rng.multivariate_hypergeometric(node["q"].to_numpy(), int(node["take"].iloc[0]), method="marginals"))

    return split


def split_tree(quotas: DataFrame, total: int, shards: int, seed: int = SEED) -> DataFrame:
    """(_s, shard, start, quota): the draws of each source that each shard takes, and how many of the source's draws
    lie in shards before it; `quotas` has _s and q, which sum to `total`.

    A node stands for a range of shards and holds the draws of all sources for it. Its left half takes an even share
    of the draws, picked without replacement: one multivariate hypergeometric draw, first among groups of sources by
    hash, then among the sources of each group, so that no task holds all sources of a node. Sums stay exact at every
    node, and a draw depends on the seed, the node and the group alone, so a lost task gives the same again.
    """
    if total >= MAX_DRAWS:
        raise ValueError(f"{total} draws of blocks, but the hypergeometric draw is exact below {MAX_DRAWS}; use larger blocks")
    ends = {"lo": 0, "hi": shards, "first": 0, "last": total, "start": 0}
    group = F.pmod(F.xxhash64("_s"), F.lit(SOURCE_GROUPS)).alias("_g")
    nodes = quotas.select("_s", group, F.col("q").cast("bigint").alias("q"), *[F.lit(v).cast("bigint").alias(c) for c, v in ends.items()])
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        middle = F.col("first") + F.floor((F.col("last") - F.col("first")) * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        done = nodes.where("hi - lo = 1")
        open_ = staged(nodes.where("hi - lo > 1").withColumns({"mid": mid, "middle": middle}))
        groups = open_.groupBy("lo", "hi", "_g", (F.col("middle") - F.col("first")).alias("take")).agg(F.sum("q").alias("q"))
        # All groups of a node meet in one task: SOURCE_GROUPS rows at most.
        shares = groups.select("lo", "hi", F.col("_g").alias("_part"), F.lit(0).cast("bigint").alias("_g"), "take", "q").groupBy("lo", "hi").applyInPandas(
            _half(seed, "_part"), "lo bigint, hi bigint, _part bigint, _g bigint, take bigint, q bigint, left bigint"
        )
        asked = open_.join(shares.select("lo", "hi", F.col("_part").alias("_g"), F.col("left").alias("take")), ["lo", "hi", "_g"])
        names = "lo bigint, hi bigint, _g bigint, _s string, q bigint, first bigint, last bigint, start bigint, mid bigint, middle bigint, take bigint"
        told = asked.select("lo", "hi", "_g", "_s", "q", "first", "last", "start", "mid", "middle", "take")
        told = staged(told.groupBy("lo", "hi", "_g").applyInPandas(_half(seed, "_s"), names + ", left bigint"))
        left = told.select("_s", "_g", F.col("left").alias("q"), "lo", F.col("mid").alias("hi"), "first", F.col("middle").alias("last"), "start")
        right = told.select("_s", "_g", (F.col("q") - F.col("left")).alias("q"), F.col("mid").alias("lo"), "hi", F.col("middle").alias("first"), "last", (F.col("start") + F.col("left")).alias("start"))
        nodes = done.unionByName(left).unionByName(right).where("q > 0")
    return nodes.where("q > 0").select("_s", F.col("lo").alias("shard"), "start", F.col("q").alias("quota"))


def _ordered(blocks: DataFrame) -> DataFrame:
    """`blocks` with place (0 on) and before (words ahead) in the permuted order of their source's blocks.

    Blocks are ordered inside ranges of the hash, and range sums inside a source: 65,536 of them at most.
    """
    keyed = blocks.withColumn("_k", _hash("_s", "_block")).withColumn("_r", F.substring("_k", 1, 4))
    upto = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy("_s", "_r").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("_s", "_r", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_{c}0") for c in ("w", "n")])
    inside = Window.partitionBy("_s", "_r").orderBy("_k", "_block")
    ahead = F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keyed = keyed.withColumns({"_w": ahead, "_n": F.row_number().over(inside) - 1}).join(ranges, ["_s", "_r"])
    return keyed.withColumns({"before": F.col("_w") + F.col("_w0"), "place": F.col("_n") + F.col("_n0")}).drop("_k", "_r", "_w", "_n", "_w0", "_n0")


def mix_plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with _s, _size, _h: the sources (with their targets) and the draws (_s, _block, epoch, shard, cut_h).

    Whole passes over a source draw each block once, in a permuted order; the pass that is not whole ends with the block
    in which the target is reached, and of that only documents up to hash cut_h are taken. How many draws a source needs
    is its quota. The tree splits the quotas among the shards; a shard's quota is a run of the source's permuted draws,
    and the runs of all shards, which are disjoint, are the draws. A row for each source and a row for each draw of a
    block are small beside the documents and written once, so Spark knows their size in later joins.
    """
    sources = staged(targets(rows.groupBy("_s").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("docs"))))
    blocks = rows.join(sources, "_s").select("_s", "_size", "_h", _block()).groupBy("_s", "_block").agg(F.sum("_size").alias("words"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    blocks = blocks.join(sources, "_s").withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    blocks = staged(_ordered(blocks))
    # The block that the target ends in: its documents by hash, up to the one that comes nearest the target.
    ends = blocks.where("before < need AND before + words > need").select("_s", "_block", (F.col("need") - F.col("before")).alias("room"))
    inside = rows.join(sources, "_s").select("_s", "_size", "_h", _block()).join(ends, ["_s", "_block"])
    inside = inside.groupBy("_s", "_block", "room", "_h").agg(F.sum("_size").alias("words"))
    by_hash = Window.partitionBy("_s", "_block").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("words").over(by_hash), F.lit(0)))
    # A block whose first document is already too much is drawn with nothing taken: no hash is below the empty text.
    cuts = inside.groupBy("_s", "_block").agg(F.coalesce(F.max(F.when(F.expr("before + words / 2 <= room"), F.col("_h"))), F.lit("")).alias("last_h"))
    per_source = F.count(F.lit(1)).alias("blocks"), F.max("whole").alias("whole"), F.count_if(F.col("before") < F.col("need")).alias("part")
    needed = staged(blocks.groupBy("_s").agg(*per_source).withColumn("q", F.expr("whole * blocks + part")))
    total = int(needed.agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0])
    dealt = split_tree(needed.where("q > 0").select("_s", "q"), total, max(1, math.ceil(total / SHARD_BLOCKS)))
    runs = dealt.join(needed, "_s").select("_s", "shard", "blocks", "whole", F.expr("explode(sequence(start, start + quota - 1))").alias("seq"))
    runs = runs.select("_s", "shard", "whole", F.expr("CAST(seq DIV blocks AS INT)").alias("epoch"), F.expr("seq % blocks").alias("place"))
    draws = runs.join(blocks.select("_s", "_block", "place"), ["_s", "place"]).join(cuts, ["_s", "_block"], "left")
    draws = draws.withColumn("cut_h", F.when(F.col("epoch") == F.col("whole"), F.col("last_h")))
    return sources, staged(draws.select("_s", "_block", "epoch", "shard", "cut_h"))


def mix_sources(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed rows: all columns of `df`, a row for each time the mix takes it, with _shard and _place last.
    Columns of these two names are replaced.

    Rows of a shard go to one partition, in hash order. NULL texts have no words. NULL is a source of its own, after
    all others. Rows with equal ids share a hash, so they are taken or left together. Reruns give the same rows. An
    empty table, or one without words, gives no rows.
    """
    rows = _sized(df, key, source, text)
    sources, draws = mix_plan(rows.select("_s", "_size", "_h"))
    placed = rows.join(sources.select("_s", "n_blocks"), "_s").withColumn("_block", _block()).join(draws, ["_s", "_block"])
    placed = placed.where("_size > 0 AND (cut_h IS NULL OR _h <= cut_h)")
    own = [F.col(f"_row.`{c}`") for c in df.columns if c not in ("_shard", "_place")]
    placed = placed.select(*own, F.col("shard").alias("_shard"), _hash("_h", "epoch", "shard").alias("_place"))
    return placed.repartition("_shard").sortWithinPartitions("_shard", "_place")


def taken_words(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """`key`, size, source_size, target, taken and shards (those that draw the row, once for each draw, in order) of
    every row, those the mix leaves out included.

    NULL texts have no words, NULL is a source of its own, repeated rows count each. A row without words, and every row
    of a table without words, has no shards. An empty table gives no rows. Extra columns play no part.
    """
    # Only numbers and hashes are kept of a text, so it is split into words once.
    rows = staged(_sized(df, key, source, text).select("_id", "_s", "_size", "_h"))
    sources, draws = mix_plan(rows)
    # Each block's draws in one row (MAX_REPEATS at most), so a document meets one row however often it is taken.
    dealt = draws.groupBy("_s", "_block").agg(F.sort_array(F.collect_list(F.struct("shard", "cut_h"))).alias("dealt"))
    told = rows.join(sources, "_s").withColumn("_block", _block()).join(dealt, ["_s", "_block"], "left")
    mine = F.filter("dealt", lambda d: (F.col("_size") > 0) & (d["cut_h"].isNull() | (F.col("_h") <= d["cut_h"])))
    told = told.withColumn("shards", F.coalesce(F.transform(mine, lambda d: d["shard"]), F.array().cast("array<bigint>")))
    taken = (F.col("_size") * F.size("shards")).cast("bigint")
    return told.select(F.col("_id").alias(key), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), "shards")


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return taken_words(table(spark, folder, "documents")).drop("shards")


OP3_SQL = rf"""
WITH r AS (SELECT doc_id, coalesce('s' || source, '~') AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~')) AS h FROM documents),
sizes AS (SELECT s, sum(size)::BIGINT AS source_size, count(*) AS docs FROM r GROUP BY s),
named AS (SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY s) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * {MAX_REPEATS}::DOUBLE AS cap FROM sizes),
lev AS (SELECT *, row_number() OVER o AS pos, ((SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM named) - coalesce(sum(w) OVER b, 0)) AS level
  FROM named WINDOW o AS (ORDER BY cap / w, s), b AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src AS (SELECT s, source_size, CASE WHEN level * w >= cap THEN cap ELSE w * (SELECT level FROM lev WHERE level * w < cap ORDER BY pos LIMIT 1) END AS target,
  greatest(1, ceil(source_size / {BLOCK_WORDS}), ceil(docs / {BLOCK_DOCS}))::BIGINT AS n_blocks FROM lev),
d AS (SELECT r.*, source_size, target, ('0x' || substr(h, 1, 12))::BIGINT % n_blocks AS block,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM r JOIN src USING (s)),
b AS (SELECT s, block, sum(size) AS words, any_value(target - whole * source_size) AS need FROM d GROUP BY s, block),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY s ORDER BY md5('{SEED}|' || s || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
u AS (SELECT s, block, h, sum(size) AS words FROM d GROUP BY ALL),
v AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY s, block ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inner_before FROM u)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN before >= need THEN 0 WHEN before + c.words <= need THEN 1
  WHEN inner_before + v.words / 2 <= need - before THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN c USING (s, block) JOIN v USING (s, block, h)"""
