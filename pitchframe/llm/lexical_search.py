"""Ranked lexical search: the highest-scoring documents of each query, found exactly in ball trees.

A document is a sparse vector over the queries' terms, a query one of term weights, a score their inner product. Tasks
arrange their documents in trees whose nodes know a centre and a radius; no document of a node can score above the
centre's score plus radius times the query's norm, so nodes are opened best first until none can reach the best scores
found. Bounds are floating-point numbers rounded upwards, scores whole numbers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import table, text_batches, total_bytes
from pitchframe.plans.session import staged, tune

TOP = 20
# Documents of a tree, and of a leaf at most.
TREE, LEAF = 16_384, 128
# Queries go to tasks in blocks of about so many bytes of text; each block scans the documents once.
QUERY_BYTES = 512 << 10
# Fixed values of the score: scale of a term's part, tf's factor, length's factor, share of length in percent.
UNIT, TF, LENGTH, SHARE = 1_000_000_000, 1000, 12, 25
# Every byte that is no term character becomes a space, A-Z become a-z. Characters beyond ASCII are terms' in UTF-8 too.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---- inside a task


class Queries:
    """Term numbers and weights of a block of queries, ready to be broadcast."""

    def __init__(self, texts: list[bytes | None]):
        self.number: dict[bytes, int] = {}
        self.asked = []
        for text in texts:
            seen: dict[int, int] = {}
            for t in terms(text):
                k = self.number.setdefault(t, len(self.number))
                seen[k] = seen.get(k, 0) + 1
            self.asked.append((np.fromiter(seen, dtype=np.int64, count=len(seen)), np.fromiter(seen.values(), dtype=np.int64, count=len(seen))))
        self.weights = np.zeros(len(self.number), dtype=np.int64)

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        self.weights = np.array([weight(n_docs, df.get(k, 0)) for k in range(len(self.number))], dtype=np.int64)


class Vectors:
    """Sparse rows: row i has terms[ends[i] : ends[i + 1]] with the scaled frequencies `values`."""

    def __init__(self, ids: list, ends: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.ids, self.ends, self.terms, self.values = ids, ends, terms, values

    def take(self, rows: np.ndarray) -> Vectors:
        sizes = np.diff(self.ends)[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes)
        return Vectors([self.ids[r] for r in rows], ends, self.terms[at], self.values[at])

    def dot(self, dense: np.ndarray, first: int = 0, last: int | None = None, values: np.ndarray | None = None) -> np.ndarray:
        """Products of the rows first to last (exclusive) with a dense vector; every row has a term."""
        ends = self.ends[first : (len(self.ends) - 1 if last is None else last) + 1]
        part = slice(ends[0], ends[-1])
        return np.add.reduceat(dense[self.terms[part]] * (self.values if values is None else values)[part], ends[:-1] - ends[0])


class BallTree:
    """Rows are halved, again and again, by which of two far ones they are nearer to.

    Distances are taken after each term is stretched by the root of its weight, which leaves inner products as they are
    and lets rare terms count for more than frequent ones.
    """

    def __init__(self, vectors: Vectors, weights: np.ndarray):
        n, self.stretch = len(vectors.ids), np.sqrt(weights.astype(np.float64))
        order, spans = self._halve(vectors, n)
        self.rows = vectors.take(order)
        self.spans = spans  # (first, last, left child or -1); the right child follows the left one
        self._measure()

    def _halve(self, v: Vectors, n: int) -> tuple[np.ndarray, list[list[int]]]:
        values = v.values * self.stretch[v.terms]
        sizes = np.add.reduceat(values * values, v.ends[:-1])
        order, spans, k = np.arange(n), [[0, n, -1]], 0

        def away(rows: np.ndarray, point: int) -> np.ndarray:
            dense = np.zeros(len(self.stretch))
            mine = slice(v.ends[point], v.ends[point + 1])
            dense[v.terms[mine]] = values[mine]
            some = v.take(rows)
            return sizes[rows] + sizes[point] - 2 * some.dot(dense, values=some.values * self.stretch[some.terms])

        while k < len(spans):
            first, last, _ = spans[k]
            if last - first > LEAF:
                rows = order[first:last]
                a = rows[np.argmax(away(rows, rows[0]))]
                from_a = away(rows, a)
                b = rows[np.argmax(from_a)]
                cut = (last - first) // 2
                order[first:last] = rows[np.argsort(from_a - away(rows, b), kind="stable")]
                spans[k][2] = len(spans)
                spans += [[first, first + cut, -1], [first + cut, last, -1]]
            k += 1
        return order, spans

    def _measure(self) -> None:
        v, n = self.rows, len(self.spans)
        values = v.values * self.stretch[v.terms]
        sizes = np.add.reduceat(values * values, v.ends[:-1])
        # Centres are rounded to single precision first; the radius is that around the rounded centre.
        self.centres, self.radii = np.zeros((n, len(self.stretch)), dtype=np.float32), np.zeros(n)
        for k, (first, last, _) in enumerate(self.spans):
            part = slice(v.ends[first], v.ends[last])
            centre = np.bincount(v.terms[part], values[part], len(self.stretch)) / (last - first)
            self.centres[k] = centre
            centre = self.centres[k].astype(np.float64)
            own = float(centre @ centre)
            square = sizes[first:last] + own - 2 * v.dot(centre, first, last, values)
            self.radii[k] = math.sqrt(max(float((square + 1e-9 * (sizes[first:last] + own)).max()), 0.0)) * (1 + 1e-9)

    def bounds(self, asked: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What no row of each node can score more than."""
        q = counts * self.stretch[asked]
        inner = self.centres[:, asked].astype(np.float64) @ q
        return inner + np.abs(inner) * 1e-9 + math.sqrt(float(q @ q)) * (1 + 1e-9) * self.radii + 1

    def search(self, asked: np.ndarray, counts: np.ndarray, dense: np.ndarray, best: Best) -> int:
        """Offer rows to `best` until no node can beat it; returns the number of rows scored."""
        bounds, work = self.bounds(asked, counts), 0
        heap = [(-bounds[0], 0)]
        while heap:
            bound, k = heapq.heappop(heap)
            # A row that ties with the last of the best may still come first by its id.
            if -bound < best.floor:
                break
            first, last, left = self.spans[k]
            if left >= 0:
                for child in (left, left + 1):
                    heapq.heappush(heap, (max(bound, -bounds[child]), child))
                continue
            scores = self.rows.dot(dense, first, last)
            work += last - first
            good = np.flatnonzero((scores > 0) & (scores >= best.floor))
            if len(good):
                best.offer([(-int(scores[g]), self.rows.ids[first + g]) for g in good])
        return work


class Best:
    """The first rows by higher score, then smaller id; rows without an id come last."""

    def __init__(self, n: int = TOP):
        self.n, self.floor, self.rows = n, 0, []

    def offer(self, rows: list[tuple[int, int | None]]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))[: self.n]
        if len(self.rows) == self.n:
            self.floor = -self.rows[-1][0]


def scaled(ids: list, lengths: list[int], ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> Vectors:
    """Frequencies of documents as the whole numbers that the weights are multiplied with."""
    m = np.array([100 - SHARE + SHARE * n * n_docs // n_terms for n in lengths], dtype=np.int64)
    return Vectors(ids, ends, terms, UNIT * tf // (TF * tf + LENGTH * np.repeat(m, np.diff(ends))))


# ---- Spark

COUNTED = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])


def _count_terms(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc, n (all terms), terms and tf (those some query asks for) of each document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.number)

    def count(batches):
        known = shared.value.get
        for batch in batches:
            found, sizes, lengths = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                hits = [h for h in map(known, words) if h is not None]
                found.append(np.array(hits, dtype=np.int64))
                lengths.append(len(words))
                sizes.append(len(hits))
            row = np.repeat(np.arange(len(lengths)), sizes)
            many = max(len(shared.value), 1)
            codes, tf = np.unique(row * many + np.concatenate(found), return_counts=True) if found else ([], [])
            lengths = np.array(lengths, dtype=np.int64)
            keep = np.flatnonzero(lengths)
            ends = np.concatenate([[0], np.cumsum(np.bincount(codes // many, minlength=len(lengths))[keep])]).astype(np.int32)
            columns = [batch.column("doc").take(pa.array(keep)), pa.array(lengths[keep]), pa.ListArray.from_arrays(ends, pa.array(codes % many, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=COUNTED)

    return docs.mapInArrow(count, "doc bigint, n bigint, terms array<int>, tf array<bigint>")


def _search(counted: DataFrame, queries: Queries, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """query (number), doc, score: the best rows of each task."""
    shared = counted.sparkSession.sparkContext.broadcast(queries)

    def search(batches):
        q = shared.value
        best = [Best(top) for _ in q.asked]
        dense = np.zeros(len(q.weights), dtype=np.int64)

        def work(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, lengths = rows.column("doc").to_pylist(), rows.column("n").to_pylist()
            lists = [rows.column(c).combine_chunks() for c in ("terms", "tf")]
            ends = lists[0].offsets.to_numpy().astype(np.int64)
            flat = [x.flatten().to_numpy().astype(np.int64) for x in lists]
            tree = BallTree(scaled(ids, lengths, ends - ends[0], *flat, n_docs, n_terms), q.weights)
            for (asked, counts), b in zip(q.asked, best):
                if len(asked):
                    dense[asked] = counts * q.weights[asked]
                    tree.search(asked, counts, dense, b)
                    dense[asked] = 0

        held, n = [], 0
        for batch in batches:
            # A batch may hold more rows than a tree.
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                if n + part.num_rows > TREE:
                    work(held)
                    held, n = [], 0
                held, n = [*held, part], n + part.num_rows
        if n:
            work(held)
        out = [(k, i, -s) for k, b in enumerate(best) for s, i in b.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query", "doc", "score"])

    hit = counted.filter(F.size("terms") > 0).select("doc", "n", "terms", "tf")
    return hit.mapInArrow(search, "query bigint, doc bigint, score bigint")


def ranked_search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """item_id, rank, doc_id, score (under the names of the keys): the `top` documents of each item with score above 0.

    Equal scores go by smaller document key, rows without a key last. NULL texts have no terms; documents without a term
    count for nothing and items without one get no rows. Rows of `docs` that share a key are documents of their own;
    rows of `items` that repeat wholly are one item, others of one key are ranked one by one. Empty tables give no rows.
    Extra columns are left out. Terms are looked up by their bytes, whole texts are read.

    Queries are sent to tasks in blocks of bounded size; each task gives back `top` rows for a query at most.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))
    asked = staged(items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").cast("binary").alias("text")).distinct())
    _, size = total_bytes(asked, "text")
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        found = _block(rows, asked.filter(F.col("block") == block).drop("block"), item_key, key, top)
        out = found if out is None else out.unionByName(found)
    return out


def _block(rows: DataFrame, asked: DataFrame, item_key: str, key: str, top: int) -> DataFrame:
    spark, listed = rows.sparkSession, asked.orderBy("item", "text").collect()
    queries = Queries([bytes(r.text) if r.text is not None else None for r in listed])
    counted = staged(_count_terms(rows, queries))
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    # One row for each term of this block of queries.
    queries.weigh(n_docs, {r["term"]: r["count"] for r in df.collect()})
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    found = _search(counted, queries, n_docs, max(n_terms, 1), top)
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, r.item) for k, r in enumerate(listed)], f"query bigint, item {dict(asked.dtypes)['item']}")
    joined = found.join(names, "query")
    return joined.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('text')} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM cut WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
asked AS (
  SELECT q, item_id, term, count(*) AS c
  FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS.format('text')}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY q, item_id, term),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM cut)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
parts AS (
  SELECT term, r, doc_id, ({UNIT} * tf) // ({TF} * tf + {LENGTH} * ({100 - SHARE} + ({SHARE} * n * n_docs) // n_terms)) AS x
  FROM tf JOIN docs USING (r), total),
scores AS (
  SELECT q, item_id, r, doc_id, sum(c * w * x)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= {TOP}"""
