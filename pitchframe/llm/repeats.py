"""Long repeated byte strings, found by previous and next occurrences in suffix order, and cut out."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import table, text_batches
from pitchframe.plans.session import staged, tune

# Bytes of a repeat, bytes of the gram that a window is known by.
LENGTH, GRAM = 400, 64
# Bytes hashed at once; rows of one batch of groups; rows above which a group is compared by hash, window by window.
PORTION, BATCH_ROWS, GROUP_ROWS = 1 << 21, 1 << 13, 1 << 14
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = 0xBF58476D1CE4E5B9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) <= n:
        powers = np.full(n + 1, base, dtype=np.uint64)
        powers[0] = 1
        _powers[base] = np.cumprod(powers, dtype=np.uint64)
    return _powers[base]


def rolling(flat: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of the n bytes that start at each place, from one running sum modulo 2^64."""
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(VALUES[flat] * _power_table(base, len(flat))[: len(flat)], dtype=np.uint64, out=sums[1:])
    out = (sums[n:] - sums[:-n]) * _power_table(pow(base, -1, 1 << 64), len(flat))[: len(flat) - n + 1]
    return _mixed(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: prefix and suffix minima of blocks of w."""
    rows = -(-len(x) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(parts: list[bytes], length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """For each part: hash and place of the anchors, first and last window start that each stands for.

    The anchor of a window is the gram in it with the smallest hash, the first of equals. It depends on the window's
    bytes alone, so equal windows have equal anchors at equal offsets.
    """
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    hashes = rolling(flat, gram)
    low = np.uint64((1 << 24) - 1)
    best = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    at = (best & low).astype(np.int64)
    out = []
    for begin, size in zip(begins, sizes):
        mine = at[begin : begin + size - length + 1]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        last = np.append(first[1:], len(mine)) - 1
        out.append((hashes[mine[first]], mine[first] - begin, first, last))
    return out


def _slices(text: bytes, length: int):
    """(offset, bytes) of overlapping slices, so that each window lies in one of them."""
    for at in range(0, max(len(text) - length + 1, 0), PORTION):
        yield at, text[at : at + PORTION + length - 1]


def find_anchors(length: int, gram: int):
    """For mapInArrow over digest, text: a row (h, digest, pos, lo, hi) for each anchor; its windows start lo to hi
    bytes before it."""

    def rows(held):
        found = anchors([p for _, _, p in held], length, gram)
        h, pos, lo, hi = [], [], [], []
        for (_, at, _), (names, place, first, last) in zip(held, found):
            h.append(names.view(np.int64))
            pos.append(place + at)
            lo.append(place - last)
            hi.append(place - first)
        digests = pa.array([d for d, _, _ in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), [len(x) for x in h])))
        cols = [pa.array(np.concatenate(x)) for x in (h, pos, lo, hi)]
        return pa.RecordBatch.from_arrays([cols[0], digests, *cols[1:]], names=["h", "digest", "pos", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                for at, part in _slices(text.encode(), length):
                    held.append((digest, at, part))
                    size += len(part)
                    if size >= PORTION:
                        yield rows(held)
                        held, size = [], 0
        if held:
            yield rows(held)

    return run


def cut_contexts(length: int):
    """For mapInArrow over digest, first, text and the anchors of a text: the bytes that each anchor's windows cover."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py().encode()
                found = batch.column("anchors")[k].values
                h, pos, lo, hi = (found.field(c).to_numpy() for c in ("h", "pos", "lo", "hi"))
                digest, first = batch.column("digest")[k].as_py(), batch.column("first")[k].as_py()
                for a in range(0, len(pos), 4096):
                    part = slice(a, a + 4096)
                    context = [text[p - y : p - x + length] for p, x, y in zip(pos[part].tolist(), lo[part].tolist(), hi[part].tolist())]
                    n = len(context)
                    cols = [pa.array(c[part]) for c in (h, pos, lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [cols[0], pa.array([first] * n, pa.int64()), pa.array([digest] * n, pa.binary()), *cols[1:], pa.array(context, pa.binary())],
                        names=["h", "first", "digest", "pos", "lo", "hi", "context"],
                    )

    return run


def _order(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of byte rows inside groups, and the common prefix of each with the one before (-1: another group)."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort([*words.T[::-1], groups])
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common[groups[order[1:]] != groups[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def repeated_windows(groups: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes], length: int, first: bool) -> np.ndarray:
    """Marks (row, offset): the window that starts `offset` bytes before the row's anchor occurs in another row too.

    Rows come in order of text position inside each group of one anchor. What follows the anchors is brought into
    suffix order, as is what precedes them read backwards, each with the longest common prefixes of neighbours. At one
    offset, rows that lie between no two neighbours of too short a prefix in either order hold equal windows. Among
    them, in order of position, the row before is the previous smaller position and the row after the next one: a
    row with one before it has a longest previous factor of at least `length`. `first` keeps rows that have none.
    """
    n, width = len(groups), int(hi.max()) + 1
    left, right = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8), np.zeros((n, -(-length // 8) * 8), dtype=np.uint8)
    for k, (c, h) in enumerate(zip(contexts, hi.tolist())):
        b = np.frombuffer(c, dtype=np.uint8)
        left[k, :h] = b[:h][::-1]
        part = b[h : h + length]
        right[k, : len(part)] = part
    left_order, left_common = _order(left, groups)
    right_order, right_common = _order(right, groups)
    marks = np.zeros((n, width), dtype=bool)
    before, after = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(int(lo.min()), width):
        rows = np.flatnonzero((lo <= d) & (d <= hi))
        if len(rows) < 2:
            continue
        before[left_order] = np.cumsum(left_common < d)
        after[right_order] = np.cumsum(right_common < length - d)
        same = before[rows] * (n + 1) + after[rows]
        order = np.argsort(same, kind="stable")
        equal = same[order[1:]] == same[order[:-1]]
        marks[rows[order[1:][equal]], d] = True
        if not first:
            marks[rows[order[:-1][equal]], d] = True
    return marks


def _intervals(marks: np.ndarray, pos: np.ndarray, digests: list[bytes], length: int) -> pa.RecordBatch:
    """Bytes that marked windows cover, a row for each run of offsets."""
    edges = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    _, stop = np.nonzero(edges == -1)
    cols = [pa.array([digests[r] for r in row], pa.binary()), pa.array(pos[row] - stop + 1), pa.array(pos[row] - start + length)]
    return pa.RecordBatch.from_arrays(cols, names=["digest", "start", "stop"])


def mark_groups(length: int, first: bool):
    """For mapInArrow over rows sorted by h, first, digest, pos: the covered intervals of each text."""

    def work(held):
        data = pa.Table.from_batches(held)
        h, pos, lo, hi = (data.column(c).to_numpy() for c in ("h", "pos", "lo", "hi"))
        digests, contexts = data.column("digest").to_pylist(), data.column("context").to_pylist()
        # A row that came twice (a document given twice) is one place; one anchor may stand for two runs of windows.
        twice = [k for k in range(1, len(h)) if (h[k], pos[k], lo[k]) == (h[k - 1], pos[k - 1], lo[k - 1]) and digests[k] == digests[k - 1]]
        keep = np.setdiff1d(np.arange(len(h)), twice)
        sizes = np.diff(np.append(np.flatnonzero(np.diff(h[keep], prepend=h[keep[0]] - 1)), len(keep)))
        keep = keep[np.repeat(sizes, sizes) > 1]
        if not len(keep):
            return None
        marks = repeated_windows(h[keep], lo[keep], hi[keep], [contexts[k] for k in keep], length, first)
        return _intervals(marks, pos[keep], [digests[k] for k in keep], length)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BATCH_ROWS:
                continue
            # Whole groups only: the last one waits for its other rows.
            data = pa.Table.from_batches(held).combine_chunks()
            h = data.column("h").to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if cut:
                if (out := work(data.slice(0, cut).to_batches())) is not None:
                    yield out
                held = data.slice(cut).combine_chunks().to_batches()
                size -= cut
        if size and (out := work(held)) is not None:
            yield out

    return run


def window_hashes(length: int):
    """For mapInArrow over contexts of crowded groups: a row for each window, with 128 bits of its hash."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                flat = np.frombuffer(batch.column("context")[k].as_py(), dtype=np.uint8)
                a, b = (rolling(flat, length, base).view(np.int64) for base in BASES)
                pick = pa.array(np.zeros(len(a), dtype=np.int64))
                same = [batch.column(c).slice(k, 1).take(pick) for c in ("h", "first", "digest", "pos")]
                offset = int(batch.column("hi")[k].as_py()) - np.arange(len(a))
                yield pa.RecordBatch.from_arrays([*same, pa.array(offset), pa.array(a), pa.array(b)], names=["h", "first", "digest", "pos", "d", "w1", "w2"])

    return run


def repeated_anchors(found: DataFrame) -> DataFrame:
    """Rows of the anchors that stand in two places; copies of one text have the same places.

    The names of those anchors are written first: a join of two plain tables is split where one name is in very many
    texts, one that follows an aggregate is not.
    """
    place = F.xxhash64("digest", "pos")
    shared = found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("h")
    return found.join(staged(shared), "h")


def repeated_intervals(df: DataFrame, digests: DataFrame, length: int, gram: int, first: bool, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Texts that share an anchor (digest, first, text), and the intervals of them that repeats cover.

    `digests` has digest, first (the smallest id) of each distinct text. Each text goes through once.
    """
    texts = df.where(F.octet_length("text") >= length)
    found = staged(texts.select("digest", "text").mapInArrow(find_anchors(length, gram), "h bigint, digest binary, pos bigint, lo bigint, hi bigint"))
    mine = repeated_anchors(found).groupBy("digest").agg(F.collect_set(F.struct("h", "pos", "lo", "hi")).alias("anchors"))
    asked = mine.join(digests.select("digest", F.col("first").alias("id"), "first"), "digest")
    same = F.col("t.digest").eqNullSafe(F.col("a.digest")) & F.col("t.id").eqNullSafe(F.col("a.id"))
    involved = texts.alias("t").join(asked.alias("a"), same).select("t.digest", "a.first", "t.text", "a.anchors")
    involved = staged(involved)
    contexts = staged(involved.mapInArrow(cut_contexts(length), "h bigint, first bigint, digest binary, pos bigint, lo bigint, hi bigint, context binary"))
    crowded = staged(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("h"))
    small = contexts.join(crowded, "h", "left_anti").repartition("h").sortWithinPartitions("h", F.col("first").asc_nulls_first(), "digest", "pos", "lo")
    spans = small.mapInArrow(mark_groups(length, first), "digest binary, start bigint, stop bigint")
    # Groups too large for a task: equal windows meet by hash, counts are merged before the shuffle.
    windows = contexts.join(crowded, "h", "left_semi").mapInArrow(
        window_hashes(length), "h bigint, first bigint, digest binary, pos bigint, d bigint, w1 bigint, w2 bigint"
    )
    keys = ["h", "d", "w1", "w2"]
    # Text that sorts like (first, digest, pos), NULL first: a minimum of text and long is merged before the shuffle.
    signed = F.lpad(F.hex(F.col("first").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0")
    rank = F.concat(F.coalesce(signed, F.lit("!" * 16)), F.hex("digest"), F.lpad(F.hex("pos"), 16, "0"))
    windows = windows.withColumn("rank", F.concat(rank, F.lpad(F.hex("d"), 4, "0")))
    ends = windows.groupBy(*keys).agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low != high")
    # Written for the same reason as the names of anchors: one window may be in very many texts.
    hit = windows.join(staged(ends.select(*keys, "low")), keys).where(F.lit(not first) | (F.col("rank") != F.col("low")))
    spans = spans.unionByName(hit.select("digest", (F.col("pos") - F.col("d")).alias("start"), (F.col("pos") - F.col("d") + length).alias("stop")).distinct())
    return involved.select("digest", "first", "text"), spans


def cut_spans(batches):
    """For mapInArrow over digest, text, spans: what is left of each text, its hash, and the sizes of what went."""
    for batch in batches:
        out = []
        for digest, text, spans in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "spans"))):
            data, left, at, removed, runs, end = text.encode(), [], 0, 0, 0, -1
            for s in sorted((x["start"], x["stop"]) for x in spans):
                if s[0] > end:
                    runs += 1
                    left.append(data[at : s[0]])
                    end, at = s[1], s[1]
                    removed += s[1] - s[0]
                elif s[1] > end:
                    removed += s[1] - end
                    end = at = s[1]
            left.append(data[at:])
            rest = b"".join(left)
            out.append((digest, removed, runs, hashlib.sha256(rest).hexdigest(), rest))
        if out:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["digest", "n_removed", "n_spans", "kept_sha256", "kept"])


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def cut_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "none", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS,
    with_text: bool = True,
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row of `df`.

    Every byte goes that lies in a string of `length` bytes which also starts elsewhere, in the same text or another,
    as given; with keep="first" the occurrence first by key and place stays. NULL counts as empty. Shorter texts stay
    whole. Rows that repeat a text are copies of each other, whatever their keys: with keep="first" the row with the
    smallest key (NULL before all) counts as the first, and rows that repeat that key as well stay with it. An empty
    table gives an empty table. Extra columns play no part.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spark, first = df.sparkSession, keep == "first"
    text_batches(spark)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    narrow = staged(rows.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")))
    ids = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id"))["id"]
    digests = staged(narrow.groupBy("digest").agg(ids.alias("first"), F.count(F.lit(1)).alias("copies")))
    involved, spans = repeated_intervals(rows, digests, length, gram, first, group_rows)
    spans = spans.groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    # Of several copies nothing stays (keep none), so only the texts of single ones are cut.
    alone = digests if first else digests.where("copies = 1")
    cut = involved.select("digest", "text").dropDuplicates(["digest"]).join(spans, "digest").join(alone.select("digest"), "digest", "left_semi")
    cut = cut.mapInArrow(cut_spans, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    cut = staged(cut if with_text else cut.drop("kept"))
    told = narrow.join(digests, "digest").join(cut if not with_text else cut.drop("kept"), "digest", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    if first:
        gone = gone & ~F.col("id").eqNullSafe(F.col("first"))
    told = told.select(
        F.col("id"), "digest", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    if not with_text:
        return told.drop("digest").withColumnRenamed("id", key)
    whole = rows.select("digest", "text").dropDuplicates(["digest"]).join(cut.select("digest", "kept"), "digest", "left")
    whole = whole.select("digest", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))
    out = told.join(whole, "digest").withColumn("kept", F.when((F.col("n_bytes") > 0) & (F.col("n_removed") == F.col("n_bytes")), F.lit(b"")).otherwise(F.col("kept")))
    return out.drop("digest").withColumnRenamed("id", key)


def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return cut_repeats(table(spark, folder, "documents"), with_text=False)
