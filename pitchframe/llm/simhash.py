"""SimHash near-duplicates: fingerprints, a hierarchical index in Gray order, connected components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import table, text_batches, text_key, whole_row
from pitchframe.plans.ranking import position_by_sort
from pitchframe.plans.session import staged, tune

SHINGLE, MAX_BITS, SEED = 3, 3, 42
# Fingerprints in a run (a leaf of the index that Spark sees), and log2 of the children of a node above the runs.
RUN, FAN_BITS = 1 << 15, 4
# Inside a run: children of a node, pairs of nodes expanded at once.
FAN, PAIRS = 4, 1 << 14


# ---- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: bit k is set if over half of the shingles' XXH64 have it set. Only A-Z are lower-cased."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and blanks are 20 and 09-0D
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(len(words) - shingle + 1, 1)
    starts, stops = (ends - lengths)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        some = zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])
        h = np.array([digest(whole[a:b], seed) for a, b in some], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (signed), digest of each row; the whole text is read, NULL as empty."""
    text_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            digests = [hashlib.sha256(t).digest()[:16] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fps), pa.array(digests, pa.binary())], names=["key", "fp", "digest"])

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "key bigint, fp bigint, digest binary")


# ---- the index inside runs


def levels_of(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """AND and OR of the fingerprints below each node, leaves first: the bits where both agree are shared by all."""
    out = [(fps, fps)]
    while len(out[-1][0]) > 1:
        cuts = np.arange(0, len(out[-1][0]), FAN)
        out.append((np.bitwise_and.reduceat(out[-1][0], cuts), np.bitwise_or.reduceat(out[-1][1], cuts)))
    return out


def union(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the sets of u and v in place; a label is the smallest member's number."""
    while True:
        a, b = labels[u], labels[v]
        if (a == b).all():
            return
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def spread(labels: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest label below each node."""
    out = [(labels, labels)]
    for _ in range(depth):
        cuts = np.arange(0, len(out[-1][0]), FAN)
        out.append((np.minimum.reduceat(out[-1][0], cuts), np.maximum.reduceat(out[-1][1], cuts)))
    return out


def link(a: np.ndarray, b: np.ndarray | None, bits: int = MAX_BITS) -> np.ndarray:
    """Labels of the fingerprints in Gray order of one run, or of two (those of `b` are numbered on).

    Pairs of nodes are compared from the roots down. Bits that all below one node share and that differ from what all
    below the other share are differences of every pair below: over `bits` of them and both groups are left out. So
    are groups that are already one set. Pairs wait on a stack and are expanded some at a time.
    """
    same = b is None
    b = a if same else b
    ta, tb = levels_of(a), levels_of(b)
    labels = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    sa, sb, dirty = None, None, True
    stack = [(len(ta) - 1, len(tb) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        if dirty:
            sa, sb, dirty = spread(labels[: len(a)], len(ta) - 1), spread(labels[shift:], len(tb) - 1), False
        # Groups that are one set already have nothing to add.
        open_ = (sa[la][0][i] != sa[la][1][i]) | (sb[lb][0][j] != sb[lb][1][j]) | (sa[la][0][i] != sb[lb][0][j])
        i, j = i[open_], j[open_]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            union(labels, i, j + shift)
            dirty = True
            continue
        # Children of both, or of the higher one.
        if la >= lb:
            la, i, j = la - 1, (i[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(j, FAN)
            ok = i < len(ta[la][0])
            i, j = i[ok], j[ok]
        if lb > la:
            lb, i, j = lb - 1, np.repeat(i, FAN), (j[:, None] * FAN + np.arange(FAN)).ravel()
            ok = j < len(tb[lb][0])
            i, j = i[ok], j[ok]
        if same and la == lb:
            ok = i <= j
            i, j = i[ok], j[ok]
        (and_a, or_a), (and_b, or_b) = ta[la], tb[lb]
        apart = (and_a[i] & ~or_b[j]) | (and_b[j] & ~or_a[i])
        near = np.bitwise_count(apart) <= bits
        i, j = i[near], j[near]
        stack += [(la, lb, i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
    return labels


def link_runs(bits: int):
    """For mapInArrow over pairs of runs (a, b, left, right): edges from a fingerprint to the smallest of its set."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("a")[k].as_py() == batch.column("b")[k].as_py()
                left, right = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in ("left", "right"))
                labels = link(left, None if same else right, bits)
                names = (left if same else np.concatenate([left, right])).view(np.int64)
                moved = labels != np.arange(len(labels))
                yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[labels[moved]])], names=["u", "v"])

    return run


# ---- the index above the runs, in Spark


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit number in the Gray sequence, as a long that sorts like the unsigned rank."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def near_edges(fps: DataFrame, bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """(u, v): links that join all of the distinct fingerprints `fp` within `bits` differing bits into the same sets.

    Sorted by Gray rank and cut into runs, neighbours share most bits. A node holds the AND and OR of all below it;
    pairs of nodes are followed from the root to the runs through joins on the parent, and a pair whose shared bits
    differ too often is dropped with everything below. Each join meets 16 children at most on either side. Only pairs
    of runs that survive are compared, each in a task of its own, with the same index inside.
    """
    placed = position_by_sort(fps.select("fp", gray_rank(F.col("fp")).alias("rank")), ["rank"])
    placed = placed.withColumn("run", F.expr(f"position div {run}"))
    runs = placed.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("rank", "fp"))).alias("members"))
    runs = staged(runs.select("run", F.col("members.fp").alias("fps")))
    shared = "aggregate(fps, {0}, (x, y) -> x {1} y)"
    nodes = runs.select(F.col("run").alias("id"), F.expr(shared.format("CAST(-1 AS BIGINT)", "&")).alias("ones"), F.expr(shared.format("CAST(0 AS BIGINT)", "|")).alias("some"))
    levels, n = [staged(nodes)], runs.count()
    while n > 1:
        above = levels[-1].groupBy(F.shiftright("id", FAN_BITS).alias("id")).agg(F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))
        levels.append(staged(above))
        n = -(-n // (1 << FAN_BITS))
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        left = level.select(F.col("id").alias("a1"), F.col("ones").alias("ones_a"), F.col("some").alias("some_a"), F.shiftright("id", FAN_BITS).alias("a"))
        right = level.select(F.col("id").alias("b1"), F.col("ones").alias("ones_b"), F.col("some").alias("some_b"), F.shiftright("id", FAN_BITS).alias("b"))
        apart = F.bit_count(F.expr("(ones_a & ~some_b) | (ones_b & ~some_a)"))
        pairs = pairs.join(left, "a").join(right, "b").where((F.col("a1") <= F.col("b1")) & (apart <= bits)).select(F.col("a1").alias("a"), F.col("b1").alias("b"))
    pairs = staged(pairs)
    met = pairs.join(runs.select(F.col("run").alias("a"), F.col("fps").alias("left")), "a").join(runs.select(F.col("run").alias("b"), F.col("fps").alias("right")), "b")
    return met.repartition(F.col("a"), F.col("b")).mapInArrow(link_runs(bits), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of `edges` (u, v): root is the smallest node that u reaches.

    Large stars and small stars in turn: nodes hang onto the smallest neighbour until nothing moves. Each round is
    written to the shared folder, so a lost executor repeats one round at most; a hub only meets its own minimum.
    """
    now = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v").unionByName(least.withColumnRenamed("m", "v"))
        now = staged(small.distinct())
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def simhash_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS, run: int = RUN
) -> DataFrame:
    """key, fp, digest, component of each row: the smallest key that links of `bits` or fewer differing bits reach.

    Texts without words (NULL, empty) have fingerprint zero and link like others; texts of fewer words than a shingle
    hash as a whole. Rows without a key belong to the component of their text, whose id is NULL if no row has a key.
    Repeated rows are repeated in the result. An empty table gives an empty table. Extra columns play no part.
    """
    rows = staged(fingerprints(df, key, text, shingle))
    nodes = staged(rows.groupBy("fp").agg(F.min("key").alias("least")))
    rooted = staged(components(near_edges(nodes.select("fp"), bits, run)).withColumnRenamed("u", "fp"))
    names = rooted.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(names, "root").select("fp", "component")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(named, "fp").select("key", "fp", "digest", "component")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, that with the smallest key, with all columns of `docs`.

    A group without any key keeps one row for each of its texts. Rows that repeat key and text count as one.
    """
    groups = staged(simhash_groups(docs, key, text))
    stays = groups.where(F.col("key").eqNullSafe(F.col("component")))
    # Rows of one key with several texts in one group: the text first by digest stays.
    stays = staged(stays.groupBy("key", "component", "fp").agg(F.min("digest").alias("digest"), F.count(F.lit(1)).alias("n")))
    one = stays.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("digest", "n")).alias("s"), F.count(F.lit(1)).alias("texts"))
    kept = one.select("key", "s.digest", ((F.col("s.n") > 1) | (F.col("texts") > 1)).alias("again"))
    none = stays.where("key IS NULL").select("key", "digest", (F.col("n") > 1).alias("again"))
    kept = staged(kept.unionByName(none))
    digest = text_key(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    marked = docs.select(whole_row(docs), digest.alias("_digest"), F.col(f"`{key}`").cast("bigint").alias("_key"))
    kept = kept.select(F.col("key").alias("_kept"), F.col("digest").alias("_of"), F.col("again").alias("_again"))
    found = marked.join(kept, F.col("_key").eqNullSafe(F.col("_kept")) & (F.col("_digest") == F.col("_of")))
    # Few rows repeat a key, so only they are compared.
    single, again = found.where("NOT _again"), found.where("_again").dropDuplicates(["_key", "_digest"])
    return single.select("_row.*").union(again.select("_row.*"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    groups = simhash_groups(table(spark, folder, "documents"))
    return groups.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
