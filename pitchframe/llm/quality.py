"""Quality by perplexity: an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Counts, probabilities and documents meet in joins sharded by n-gram and by block; no table of n-grams is broadcast.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import table, text_batches, text_key, total_bytes, whole_row
from pitchframe.plans.session import staged, tune

ORDER = 4
# Bytes of text in a block, bytes packed into one row on the way to the blocks.
BLOCK_BYTES, PACK_BYTES = 64 << 20, 16 << 20
# One in HELD trusted documents sets the thresholds, the others train the model.
HELD = 5
QUANTILE, MARGIN, PRIOR_TOKENS = 0.99, 1.15, 64


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte and at the end mark of each text, packed in whole numbers, and how many each
    text has. Texts are padded with zero bytes in front; the end mark is a zero byte."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    pad = b"\0" * (order - 1)
    flat = np.frombuffer(b"".join([x for t in texts for x in (pad, t, b"\0")]), dtype=np.uint8).astype(np.int64)
    packed = np.zeros(len(flat), dtype=np.int64)
    for k in range(order):
        packed[order - 1 :] |= flat[order - 1 - k : len(flat) - k] << (8 * k)
    ends = np.cumsum(lengths + order - 1)
    inside = np.ones(len(flat), dtype=bool)
    for k in range(order - 1):
        inside[ends - lengths - (order - 1) + k] = False
    return packed[inside], lengths


# ---- blocks of documents

PACKED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])
PACKED_SQL = "block bigint, kind int, keys array<bigint>, langs array<string>, sizes array<bigint>, blob binary"


def pack(batches):
    """Texts that go to one block travel as one compressed row."""
    press = zstandard.ZstdCompressor(level=1)

    def rows(held):
        blocks = pa.concat_arrays([b.column("block") for b in held]).to_numpy()
        keys, langs, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in ("key", "lang", "text"))
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        out = []
        for part in np.split(order, cuts):
            at = pa.array(part)
            data = [t.encode() for t in texts.take(at).to_pylist()]
            out.append((int(blocks[part[0]]), 1, keys.take(at).to_pylist(), langs.take(at).to_pylist(), list(map(len, data)), press.compress(b"".join(data))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PACKED)], schema=PACKED)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield rows(held)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield rows(held)


def _block(key: Column, text: Column, n: int) -> Column:
    """Rows with a key meet its label; rows without one can't and are spread by text."""
    return F.pmod(F.xxhash64(F.coalesce(key, F.xxhash64(text))), F.lit(n)).alias("block")


def _packed_rows(rows: DataFrame, n: int) -> DataFrame:
    """`rows` holds key, lang, text."""
    return rows.select("key", "lang", "text", _block(F.col("key"), F.col("text"), n)).mapInArrow(pack, PACKED_SQL)


def _key_rows(keys: DataFrame, n: int) -> DataFrame:
    """Keys of training documents on the way to their blocks."""
    named = keys.groupBy(_block(F.col("key"), F.lit(""), n)).agg(F.collect_list("key").alias("keys"))
    empty = {"kind": F.lit(0), "langs": F.lit(None).cast("array<string>"), "sizes": F.lit(None).cast("array<bigint>"), "blob": F.lit(None).cast("binary")}
    return named.select("block", empty["kind"].alias("kind"), "keys", *[empty[c].alias(c) for c in ("langs", "sizes", "blob")])


def unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Keys, languages and texts of one packed row."""
    blob = zstandard.ZstdDecompressor().decompress(batch.column("blob")[i].as_py())
    sizes = np.array(batch.column("sizes")[i].as_py(), dtype=np.int64)
    ends = np.cumsum(sizes)
    keys = np.array(batch.column("keys")[i].as_py(), dtype=object)
    langs = np.array(batch.column("langs")[i].as_py(), dtype=object)
    return keys, langs, [blob[e - s : e] for s, e in zip(sizes, ends)]


def portions(texts: list[bytes], limit: int = 2 << 20):
    """Runs of texts of about `limit` bytes, so that arrays over n-grams stay small. A longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def count_grams(order: int):
    """For mapInArrow over rows sorted by block and kind: block, lang, gram and its count in training documents."""

    def run(batches):
        block, trusted, counts = None, set(), {}

        def rows():
            for lang, parts in counts.items():
                merged = pd.concat(parts).groupby(level=0).sum()
                cols = [pa.array(np.full(len(merged), block)), pa.array([lang] * len(merged), pa.string())]
                cols += [pa.array(merged.index.to_numpy()), pa.array(merged.to_numpy())]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "lang", "gram", "train"])

        for batch in batches:
            for i, (b, kind) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist())):
                if b != block:
                    yield from rows()
                    block, trusted, counts = b, set(), {}
                if kind == 0:
                    trusted.update(batch.column("keys")[i].as_py())
                    continue
                keys, langs, texts = unpacked(batch, i)
                train = np.array([k in trusted for k in keys])
                for lang in set(langs):
                    of = np.flatnonzero(langs == lang)
                    mine = [texts[j] for j in of]
                    for run_ in portions(mine):
                        packed, lengths = grams(mine[run_], order)
                        codes, names = pd.factorize(packed)
                        n = np.bincount(codes, weights=np.repeat(train[of[run_]], lengths), minlength=len(names))
                        counts.setdefault(lang, []).append(pd.Series(n.astype(np.int64), index=names))
                        if len(counts[lang]) > 8:
                            counts[lang] = [pd.concat(counts[lang]).groupby(level=0).sum()]
        yield from rows()

    return run


# ---- probabilities


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of modified Kneser-Ney from the counts of counts; 0.5, 1 and 1.5 where those are missing."""
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = "n1 / (nullif(n1, 0) + 2D * n2)"
    d = [f"coalesce(least(greatest({k}D - {k + 1} * {y} * n{k + 1} / nullif(n{k}, 0), 0.05D), {k}D), {k} * 0.5D) AS d{k}" for k in (1, 2, 3)]
    return staged(level.groupBy("lang").agg(*n).selectExpr("lang", *d))


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """lang, gram, logp for all n-grams of `counts` (lang, gram, c); c is the count in training text and may be zero.

    Lower orders count the different bytes that precede; each order mixes with the one below, the lowest with 1/256.
    Every join is on a language and an n-gram or its context, so each key has 256 rows at most.
    """
    levels = {order: counts.where("c > 0").select("lang", F.col("gram").alias("g"), "c")}
    asked = {order: counts.select("lang", F.col("gram").alias("g"))}
    for k in range(order - 1, 0, -1):
        shorter = F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")
        levels[k] = staged(levels[k + 1].select("lang", shorter).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("c")))
        asked[k] = asked[k + 1].select("lang", shorter).distinct()
    below = None
    for k in range(1, order + 1):
        context = F.shiftright("g", 8).alias("h")
        tally = [F.sum("c").alias("total")] + [F.sum(F.when(F.col("c") == n if n < 3 else F.col("c") >= 3, 1).otherwise(0)).alias(f"k{n}") for n in (1, 2, 3)]
        contexts = levels[k].select("lang", context, "c").groupBy("lang", "h").agg(*tally)
        contexts = contexts.join(_discounts(levels[k]), "lang")
        joined = asked[k].withColumn("h", F.shiftright("g", 8)).join(levels[k], ["lang", "g"], "left").join(contexts, ["lang", "h"], "left")
        if below is None:
            joined = joined.withColumn("lower", F.lit(1 / 256))
        else:
            joined = joined.withColumn("s", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1))
            joined = joined.join(below.select("lang", F.col("g").alias("s"), F.col("p").alias("lower")), ["lang", "s"])
        own = F.expr("coalesce(CASE c WHEN 1 THEN 1 - d1 WHEN 2 THEN 2 - d2 ELSE c - d3 END, 0) / total")
        rest = F.expr("(d1 * k1 + d2 * k2 + d3 * k3) / total")
        mixed = F.when(F.col("total").isNull(), F.col("lower")).otherwise(own + rest * F.col("lower"))
        below = joined.select("lang", "g", mixed.alias("p"))
        if k < order:
            below = staged(below)
    return below.select("lang", F.col("g").alias("gram"), F.log("p").alias("logp"))


def score(order: int):
    """For mapInArrow over rows sorted by block, kind, lang and gram: first the log probabilities a block needs, then
    its documents; gives the loss of each document."""

    def tables_of(batch, parts):
        langs = batch.column("lang").dictionary_encode()
        codes, names, logp = langs.indices.to_numpy(), batch.column("gram").to_numpy(), batch.column("logp").to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            parts.setdefault(lang, []).append((names[codes == k], logp[codes == k]))

    def run(batches):
        block, parts, tables = None, {}, {}
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(blocks)]):
                if blocks[start] != block:
                    block, parts, tables = blocks[start], {}, {}
                if kinds[start] == 0:
                    tables_of(batch.slice(start, stop - start), parts)
                    continue
                for i in range(start, stop):
                    keys, langs, texts = unpacked(batch, i)
                    loss, tokens = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
                    for lang in set(langs):
                        if lang not in tables:
                            tables[lang] = tuple(np.concatenate(x) for x in zip(*parts.pop(lang)))
                        names, logp = tables[lang]
                        of = np.flatnonzero(langs == lang)
                        mine = [texts[j] for j in of]
                        for run_ in portions(mine):
                            packed, lengths = grams(mine[run_], order)
                            codes, found = pd.factorize(packed)
                            values = logp[np.searchsorted(names, found)][codes]
                            loss[of[run_]] = -np.add.reduceat(values, np.cumsum(lengths) - lengths)
                            tokens[of[run_]] = lengths
                    digests = [hashlib.sha256(t).digest()[:16] for t in texts]
                    cols = [pa.array(list(keys), pa.int64()), pa.array(digests), pa.array(list(langs), pa.string()), pa.array(tokens), pa.array(loss)]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "digest", "lang", "tokens", "loss"])

    return run


def score_documents(
    docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER
) -> DataFrame:
    """key, digest (of the text), lang, tokens, loss of each row of `docs`; `training` holds, as key, the rows to learn from.

    tokens counts the bytes and the end mark, loss is the sum of negative log probabilities. The table is written once.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    _, size = total_bytes(rows, "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BLOCK_BYTES))
    counted = _packed_rows(rows, n).unionByName(_key_rows(training, n)).repartition(n, "block").sortWithinPartitions("block", "kind")
    counted = staged(counted.mapInArrow(count_grams(order), "block bigint, lang string, gram bigint, train bigint"))
    counts = staged(counted.groupBy("lang", "gram").agg(F.sum("train").alias("c")))
    logp = staged(probabilities(counts, order))
    # A row for each n-gram of a block, as many as the blocks have, however many tasks they come from.
    tables = counted.select("block", F.lit(0).alias("kind"), "lang", "gram").join(logp, ["lang", "gram"])
    met = _packed_rows(rows, n).unionByName(tables, allowMissingColumns=True)
    met = met.repartition(n, "block").sortWithinPartitions("block", "kind", "lang", "gram")
    return staged(met.mapInArrow(score(order), "key bigint, digest binary, lang string, tokens bigint, loss double"))


def classify_quality(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN,
) -> DataFrame:
    """key, digest, lang, tokens, perplexity, adjusted, threshold, kept of each row.

    The model of a language learns from its trusted documents but for one in five, whose adjusted perplexities set the
    language's threshold: their quantile times the margin. The adjusted value adds 64 tokens of the held-out mean, so
    a short text needs strong evidence. Rows above the threshold are not kept. A language (NULL is one, as is empty)
    without held-out documents has no threshold and keeps all. NULL and empty texts are an end mark alone and are
    judged like others. Equal rows are judged alike, rows without a key are never trusted. An empty table gives an
    empty table. Extra columns play no part.
    """
    known = trusted.select(F.col(f"`{key}`").cast("bigint").alias("key")).where("key IS NOT NULL").distinct()
    fold = F.pmod(F.xxhash64("key"), F.lit(HELD))
    scored = score_documents(docs, known.where(fold != 0), key, text, lang, order)
    held = scored.join(known.where(fold == 0), "key", "left_semi")
    means = held.groupBy("lang").agg((F.sum("loss") / F.sum("tokens")).alias("mean"))
    means = staged(means.withColumn("mean", F.round("mean", 9)))
    adjusted = F.round(F.exp((F.col("loss") + PRIOR_TOKENS * F.col("mean")) / (F.col("tokens") + PRIOR_TOKENS)), 3)
    # Values of three digits: the quantile is exact over a table of bounded size.
    values = held.join(means, "lang").groupBy("lang", adjusted.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    limits = values.groupBy("lang").agg((F.percentile("v", quantile, F.col("n")) * margin).alias("threshold"))
    limits = staged(limits.join(means, "lang"))
    told = scored.join(limits, "lang", "left").withColumn("adjusted", adjusted)
    return told.select(
        F.col("key").alias(key), "digest", "lang", "tokens", F.exp(F.col("loss") / F.col("tokens")).alias("perplexity"), "adjusted", "threshold",
        F.coalesce(F.col("adjusted") <= F.col("threshold"), F.lit(True)).alias("kept"),
    )


def trusted_keys(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with all their columns."""
    judged = classify_quality(docs, trusted_keys(labels))
    bad = judged.where(~F.col("kept")).select(F.col("lang").alias("_lang"), F.col("digest").alias("_digest")).distinct()
    marked = docs.select(whole_row(docs), F.coalesce("lang", F.lit("")).alias("_lang"), text_key(F.coalesce("text", F.lit(""))).alias("_digest"))
    return marked.join(staged(bad), ["_lang", "_digest"], "left_anti").select("_row.*")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return classify_quality(table(spark, folder, "documents"), trusted_keys(table(spark, folder, "labels"))).drop("digest")
