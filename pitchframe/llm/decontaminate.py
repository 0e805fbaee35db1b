"""Benchmark passages in documents, found by greedy string tiling of word sequences."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import table, text_batches, text_key, whole_row
from pitchframe.plans.session import staged, tune

# Words of a seed, which is also the shortest tile; share of a test item's words that tiles must cover.
SEED_WORDS, COVERAGE = 5, 0.5
# Bits (as a power of two) of the filter that tells which documents' seeds are worth a join: 16 for each seed, between one
# and 16 megabytes. With more seeds more documents pass it, and no result changes.
FILTER_BITS, MOST_FILTER_BITS = 23, 27
PORTION = 1 << 20
M64 = (1 << 64) - 1
BASE, STEP, MIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9


# ---- words as 64-bit numbers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def _byte_values() -> np.ndarray:
    """A number for each byte of a word, zero for bytes between words (all but a-z, 0-9 and those above 127)."""
    values = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    word = np.zeros(256, dtype=bool)
    word[ord("a") : ord("z") + 1] = word[ord("0") : ord("9") + 1] = word[128:] = True
    return np.where(word, values, np.uint64(0))


VALUES = _byte_values()
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of `base` modulo 2^64, kept for the next call."""
    if len(_powers.get(base, ())) <= n:
        table_ = np.full(n + 1, base, dtype=np.uint64)
        table_[0] = 1
        _powers[base] = np.cumprod(table_, dtype=np.uint64)
    return _powers[base]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the lower-cased texts, and how many words each text has."""
    data = [t.lower().encode() for t in texts]
    flat = np.frombuffer(b" ".join([*data, b""]), dtype=np.uint8)
    values = VALUES[flat]
    inside = np.concatenate([[False], values != 0])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    powers, inverse = _power_table(BASE, len(flat)), _power_table(pow(BASE, -1, 1 << 64), len(flat))
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(flat)], dtype=np.uint64, out=sums[1:])
    # A prefix hash, moved to the word's own start.
    names = _mixed((sums[ends] - sums[starts]) * inverse[starts])
    cuts = np.cumsum([len(d) + 1 for d in data])
    return names, np.diff(np.searchsorted(starts, cuts, side="left"), prepend=0)


def seeds_of(words: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """A number for each run of n words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(STEP) + words[k : len(words) - n + 1 + k]
    return _mixed(out)


# ---- greedy string tiling


def _windows(words: list[int], marked: bytearray, n: int):
    """(hash, start) of each run of n unmarked words, by a rolling hash."""
    lead = pow(STEP, n, 1 << 64)
    h, free = 0, 0
    for i, w in enumerate(words):
        if marked[i]:
            h = free = 0
            continue
        h, free = (h * STEP + w) & M64, free + 1
        if free > n:
            h = (h - lead * words[i - n]) & M64
        if free >= n:
            yield h, i - n + 1


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words) of non-overlapping common runs, longest first, down to `least` words.

    The search length starts high and halves. At each length the runs of `text` go into a table by rolling hash, those
    of `item` are looked up, compared word by word and extended. A match of more than twice the length sends the
    search back up to it; else all matches are marked from the longest on, unless something marked lies in them.
    """
    marks_i, marks_t = bytearray(len(item)), bytearray(len(text))
    out, length = [], max(min(len(item), len(text)) // 2, least)
    while min(len(item), len(text)) >= least:
        at: dict[int, list[int]] = {}
        for h, t in _windows(text, marks_t, length):
            at.setdefault(h, []).append(t)
        found, longest = [], 0
        for h, i in _windows(item, marks_i, length):
            for t in at.get(h, ()):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and not marks_i[i + n] and not marks_t[t + n]:
                    n += 1
                if n >= length:
                    found.append((-n, i, t))
                    longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        for n, i, t in sorted(found):
            n = -n
            if not any(marks_i[i : i + n]) and not any(marks_t[t : t + n]):
                marks_i[i : i + n] = marks_t[t : t + n] = b"\1" * n
                out.append((i, t, n))
        if length == least:
            # Marks may have cut a match whose rest is still long enough; look until nothing is found.
            if not found:
                return out
        else:
            length = max(length // 2, least)
    return out


# ---- Spark


def bench_items(items: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """item, words (8 bytes each), seeds and how often each stands in the text, of each benchmark row."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, counts = words_of(texts)
            parts = np.split(names, np.cumsum(counts)[:-1])
            seeds = [np.unique(seeds_of(p, n), return_counts=True) for p in parts]
            held = [pa.array(c, pa.list_(pa.int64())) for c in ([s.view(np.int64) for s, _ in seeds], [c for _, c in seeds])]
            cols = [batch.column("item"), pa.array([p.tobytes() for p in parts], pa.binary()), *held]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "words", "seeds", "times"])

    rows = items.select(F.col(f"`{key}`").cast("bigint").alias("item"), F.col(f"`{text}`").alias("text"))
    return staged(rows.mapInArrow(run, "item bigint, words binary, seeds array<bigint>, times array<bigint>"))


def seed_filter(seeds: DataFrame, most: int = MOST_FILTER_BITS) -> bytes:
    """One bit for each value of a seed's low bits: at most 4,096 rows of 4 KB reach the driver, however many seeds."""
    bits = min(most, max(FILTER_BITS, (16 * seeds.count()).bit_length()))
    bit = F.col("seed").bitwiseAND((1 << bits) - 1) + 1
    rows = seeds.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = bytearray(1 << (bits - 3))
    for r in rows.collect():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    return bytes(out)


def find_stretches(shared, n: int):
    """For mapInArrow over key, text: key, digest, stretches of documents with seeds that pass the filter.

    Each tile's seeds all pass, so it lies within a run of passing seeds; only those runs of words go on.
    """
    held = []

    def stretches(words: np.ndarray) -> list[bytes]:
        seeds = seeds_of(words, n)
        hit = held[0][(seeds & np.uint64(len(held[0]) - 1)).astype(np.int64)]
        edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        return [words[a : b + n - 1].tobytes() for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]

    def run(batches):
        if not held:
            held.append(np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little").astype(bool))
        for batch in batches:
            texts, out = [t or "" for t in batch.column("text").to_pylist()], []
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PORTION):
                    size += len(texts[stop])
                    stop += 1
                names, counts = words_of(texts[at:stop])
                for i, words in enumerate(np.split(names, np.cumsum(counts)[:-1]), at):
                    if len(words) >= n and (found := stretches(words)):
                        out.append((batch.column("key")[i].as_py(), hashlib.sha256(texts[i].encode()).digest()[:16], found))
                at = stop
            if out:
                keys, digests, found = zip(*out)
                cols = [pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "digest", "stretches"])

    return run


def _stretch_seeds(n: int):
    def run(batches):
        for batch in batches:
            found = [[np.unique(np.concatenate([seeds_of(np.frombuffer(s, dtype=np.uint64), n) for s in row])).view(np.int64)] for row in batch.column("stretches").to_pylist()]
            sizes = [len(f[0]) for f in found]
            digests = batch.column("digest").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([digests, pa.array(np.concatenate([f[0] for f in found]))], names=["digest", "seed"])

    return run


def rare_seeds(seeds: DataFrame, asked: DataFrame, n: int, coverage: float) -> DataFrame:
    """(item, seed): of each item's seeds the rarest in documents, as many as a contaminated document must share one of.

    Every word under a tile lies in a shared seed, so seeds that stand in an item k times in all cover n * k words at most.
    The seeds that most documents hold are left out as long as they alone can't cover what is asked: a document that
    shares no other seed stays below `coverage`. So no pair is lost, and phrases common to many documents and many items
    make no pairs. `seeds` has item, n_words, seed, times; `asked` the seeds of each text, counted before the shuffle.
    """
    held = asked.groupBy("seed").agg(F.count(F.lit(1)).alias("texts"))
    # An item's seeds are no more than its words.
    common = Window.partitionBy("item").orderBy(F.desc("texts"), "seed")
    told = seeds.join(held, "seed").withColumn("covers", n * F.sum("times").over(common))
    return told.where(F.col("covers") > coverage * F.col("n_words") - 1e-6).select("item", "seed")


def _tile_pairs(n: int):
    """For mapInArrow over digest, item, words, stretches: the words that tiles cover, the item's words, the tiles."""

    def run(batches):
        for batch in batches:
            covered, words, counts = [], [], []
            for item, parts in zip(batch.column("words").to_pylist(), batch.column("stretches").to_pylist()):
                item = np.frombuffer(item, dtype=np.uint64).tolist()
                # Stretches are joined by marks that equal no word, each a different one.
                text: list[int] = []
                for k, p in enumerate(parts):
                    text += [-k - 1, *np.frombuffer(p, dtype=np.uint64).tolist()]
                got = tiles(item, text, n)
                covered.append(sum(t[2] for t in got))
                words.append(len(item))
                counts.append(len(got))
            cols = [batch.column("digest"), batch.column("item"), pa.array(covered, pa.int64()), pa.array(words, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["digest", "item", "covered", "words", "tiles"])

    return run


def find_contamination(
    docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = SEED_WORDS, coverage: float = COVERAGE,
) -> DataFrame:
    """key, digest, item, coverage, covered, words, tiles: each pair in which tiles of the document cover at least
    `coverage` of the item's words, wherever and in whatever order they stand.

    Words are runs of letters, digits and characters beyond ASCII in the lower-cased whole text, by 64-bit hash. Items
    of fewer than n words, NULL and empty texts match nothing. Rows that repeat a text get the same pairs each; equal
    items are reported each. An empty table of either kind gives an empty result. Extra columns play no part.
    """
    spark = docs.sparkSession
    text_batches(spark)
    items = bench_items(bench, item, item_text, n)
    seeds = items.select("item", (F.octet_length("words") / 8).alias("n_words"), F.explode(F.arrays_zip("seeds", "times")).alias("s"))
    seeds = seeds.select("item", "n_words", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    shared = spark.sparkContext.broadcast(seed_filter(seeds))
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = staged(rows.mapInArrow(find_stretches(shared, n), "key bigint, digest binary, stretches array<binary>"))
    # Copies of a text are compared once.
    once = staged(rows.groupBy("digest").agg(F.min("stretches").alias("stretches")))
    asked = once.select("digest", "stretches").mapInArrow(_stretch_seeds(n), "digest binary, seed bigint")
    rare = staged(rare_seeds(seeds, asked, n, coverage))
    hits = asked.join(rare, "seed").select("digest", "item").distinct()
    pairs = hits.join(items.select("item", "words"), "item").join(once, "digest")
    told = pairs.select("digest", "item", "words", "stretches").mapInArrow(_tile_pairs(n), "digest binary, item bigint, covered bigint, words bigint, tiles bigint")
    told = told.withColumn("coverage", F.col("covered") / F.col("words")).where(F.col("coverage") >= coverage)
    return rows.select("key", "digest").join(told, "digest").select(F.col("key").alias(key), "digest", F.col("item").alias(item), "coverage", "covered", "words", "tiles")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of `docs` that cover no benchmark item, with all their columns."""
    bad = staged(find_contamination(docs, bench).select(F.col("digest").alias("_digest")).distinct())
    marked = docs.select(whole_row(docs), text_key(F.coalesce("text", F.lit(""))).alias("_digest"))
    return marked.join(bad, "_digest", "left_anti").select("_row.*")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("digest")
