"""Hard negatives: rows of other labels that score below an anchor's positives, but not far below.

Anchors form spanning trees of short edges. By the Cauchy-Schwarz inequality the score of a row at an anchor differs
from its score at the anchor's parent by the length of the edge times the row's norm at most, so a walk down a tree
knows bounds of all scores before it computes any, and computes those only whose bounds meet what the anchor looks
for. Scores are whole numbers; bounds are rounded outwards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import table
from pitchframe.plans.ranking import position_by_sort
from pitchframe.plans.session import staged, tune

POSITIVES, NEGATIVES = 5, 3
# A negative has 50 to 95 hundredths of the positive's score.
LEAST, MOST = 50, 95
# Anchors in a tree, its largest depth, distinct vectors of a chunk; a task holds one tree and one chunk.
TREE, DEPTH, CHUNK = 2048, 8, 8192
# Anchors that draw near ones into the same tree; they only affect speed, and their number is bounded.
PIVOTS = 4096
# Rows scored first at an anchor, those with the highest bounds.
FIRST = 64


# ---- inside a task


def matrix(vectors: pd.Series, width: int, exact: bool) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros; doubles where those hold every product exactly."""
    out = np.zeros((len(vectors), max(width, 1)), dtype=np.float64 if exact else np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 for the root) of each row and length of the edge, rounded up: the nearest row reached so far of less
    than full depth, taken in the order of shortest edges."""
    n, points = len(points), points.astype(np.float64)
    parent, edge, depth = np.full(n, -1), np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    sizes, todo, at = (points * points).sum(1), np.ones(n, dtype=bool), 0
    todo[0] = False
    for _ in range(n - 1):
        if depth[at] < DEPTH:
            away = np.maximum(sizes + sizes[at] - 2 * (points @ points[at]), 0)
            closer = todo & (away < edge)
            edge[closer], parent[closer] = away[closer], at
        at = int(np.argmin(np.where(todo, edge, np.inf)))
        todo[at], depth[at] = False, depth[parent[at]] + 1
    edge[0] = 0
    # The fast product loses digits, so the lengths are taken from the coordinates.
    exact = np.sqrt(((points - points[np.maximum(parent, 0)]) ** 2).sum(1)) * (1 + 1e-9)
    return parent, np.where(parent < 0, 0.0, exact)


def walk(rows: np.ndarray, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, choose) -> int:
    """Go down a tree. `choose(anchor, low, high, score)` sees bounds of all scores at an anchor and calls
    `score(numbers)` for the rows it needs exactly. Returns how many scores were computed."""
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    below: dict[int, list[int]] = {}
    for k, p in enumerate(parent):
        below.setdefault(int(p), []).append(k)
    work = 0
    # The bounds of a node live as long as one of its children waits, so as many are held as the tree is deep.
    stack = [(k, None, None) for k in below.get(-1, [])]
    while stack:
        k, middle, reach = stack.pop()
        if middle is None:
            middle, reach = (rows @ anchors[k]).astype(np.float64), np.zeros(len(rows))
            work += len(rows)
        else:
            middle, reach = middle.copy(), reach + edge[k] * norms
        slack = np.where(reach > 0, reach * (1 + 1e-9) + 1 + np.abs(middle) * 1e-12, 0.0)

        def score(numbers: np.ndarray) -> np.ndarray:
            nonlocal work
            work += len(numbers)
            # Most rows: one product over all is faster than a copy of them.
            found = (rows @ anchors[k])[numbers] if 4 * len(numbers) > len(rows) else rows[numbers] @ anchors[k]
            middle[numbers], reach[numbers] = found, 0.0
            return found.astype(np.int64)

        choose(k, middle - slack, middle + slack, score)
        stack.extend((c, middle, reach) for c in below.get(k, []))
    return work


def _highest(numbers: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n numbers of highest key, and the others."""
    if len(numbers) <= n:
        return numbers, numbers[:0]
    cut = np.argpartition(-key[numbers], n - 1)
    return numbers[cut[:n]], numbers[cut[n:]]


def _nth(scores: np.ndarray, counts: np.ndarray, n: int) -> float:
    """The n-th highest score, where each is had by `counts` rows; minus infinity if there are fewer."""
    order = np.argsort(-scores, kind="stable")
    k = int(np.searchsorted(np.cumsum(counts[order]), n))
    return float(scores[order[k]]) if k < len(order) else -np.inf


def _rows_of(numbers: np.ndarray, scores: np.ndarray, ids: list, n: int) -> list[tuple[int, int, int]]:
    """(score, id, number) of the first n rows: higher scores, then smaller ids."""
    flat = [(-int(s), int(i), int(k)) for k, s in zip(numbers, scores) for i in ids[k]]
    return [(-s, i, k) for s, i, k in sorted(flat)[:n]]


def best_positives(tree: pd.DataFrame, rows: pd.DataFrame, width: int, exact: bool) -> pd.DataFrame:
    """aid, id, score, twin: the first six rows of the anchor's label in one chunk; twin: equal to the anchor's vector."""
    points, anchors = matrix(rows["v"], width, exact), matrix(tree["v"], width, exact)
    ids, labels, mine, keep = rows["ids"].tolist(), rows["label"].to_numpy(), tree["label"].to_numpy(), POSITIVES + 1
    counts = np.array([len(i) for i in ids])
    of_label = {x: np.flatnonzero(labels == x) for x in set(mine)}
    out = []

    def choose(k, low, high, score):
        first, rest = _highest(of_label[mine[k]], high, FIRST)
        scores = score(first)
        rest = rest[high[rest] >= _nth(scores, counts[first], keep)]
        found, scores = np.concatenate([first, rest]), np.concatenate([scores, score(rest)])
        best = scores >= _nth(scores, counts[found], keep)
        for s, i, n in _rows_of(found[best], scores[best], ids, keep):
            out.append((tree["aid"].iat[k], i, s, bool((points[n] == anchors[k]).all())))

    walk(points, anchors, tree["parent"].to_numpy(), tree["edge"].to_numpy(), choose)
    return pd.DataFrame(out, columns=["aid", "id", "score", "twin"])


def best_negatives(tree: pd.DataFrame, rows: pd.DataFrame, width: int, exact: bool) -> pd.DataFrame:
    """aid, positive_score, id, score: the first three rows of other labels in the window of each positive score."""
    points, anchors = matrix(rows["v"], width, exact), matrix(tree["v"], width, exact)
    ids, labels, mine = rows["ids"].tolist(), rows["label"].to_numpy(), tree["label"].to_numpy()
    counts = np.array([len(i) for i in ids])
    others = {x: np.flatnonzero(labels != x) for x in set(mine)}
    windows = [[(int(p), -(-LEAST * int(p) // 100), MOST * int(p) // 100) for p in scores] for scores in tree["scores"]]
    out = []

    def choose(k, low, high, score):
        # Bounds shrink to points as scores become known.
        low, high, known = low.copy(), high.copy(), low == high
        for p, least, most in windows[k]:
            near = others[mine[k]]
            near = near[(high[near] >= least) & (low[near] <= most)]
            for n in (FIRST, len(near)):
                inside = near[known[near] & (low[near] >= least) & (low[near] <= most)]
                floor = max(least, _nth(low[inside], counts[inside], NEGATIVES))
                open_ = near[~known[near] & (high[near] >= floor) & (low[near] <= most)]
                some, _ = _highest(open_, np.minimum(high, most), n) if n else (open_, open_)
                if len(some):
                    found = score(some)
                    low[some], high[some], known[some] = found, found, True
            inside = near[known[near] & (low[near] >= least) & (low[near] <= most)]
            best = inside[low[inside] >= _nth(low[inside], counts[inside], NEGATIVES)]
            out.extend((tree["aid"].iat[k], p, i, s) for s, i, _ in _rows_of(best, low[best], ids, NEGATIVES))

    walk(points, anchors, tree["parent"].to_numpy(), tree["edge"].to_numpy(), choose)
    return pd.DataFrame(out, columns=["aid", "positive_score", "id", "score"])


# ---- Spark


def whole_vectors(df: DataFrame, key: str, vec: str, label: Column) -> DataFrame:
    """id, label, v: rows that take part, with components floor(256 * x). Rows that repeat wholly count once."""
    x = F.col(f"`{vec}`").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("x"), finite.alias("ok"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND ok")
    # Beyond 2^53 a double is whole anyway, and floor() of Spark would be cut off at 2^63.
    v = F.transform("x", lambda e: F.floor(F.greatest(F.least(256 * e, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    return rows.select("id", "label", v.alias("v")).distinct()


def _pairs_of_blocks(trees: DataFrame, points: DataFrame, n_trees: int, n_chunks: int, kernel, schema: str) -> DataFrame:
    """`kernel(tree, chunk)` for each tree and chunk. Rows are copied to the trees, anchors to the chunks."""
    t = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    c = points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(tree, chunk):
        return kernel(tree.sort_values("place"), chunk) if len(tree) and len(chunk) else pd.DataFrame(columns=names)

    return t.groupBy("tree", "chunk").cogroup(c.groupBy("tree", "chunk")).applyInPandas(run, schema)


def _nearest_pivot(anchors: DataFrame, width: int) -> DataFrame:
    """Adds pivot: the number of the nearest of a bounded number of anchors, so that near anchors meet in a tree."""
    many = min(PIVOTS, math.ceil(anchors.count() / TREE))
    if many < 2:
        return anchors.withColumn("pivot", F.lit(0))
    chosen = anchors.orderBy(F.xxhash64("aid"), "aid").limit(many).select("v").toPandas()["v"]
    pivots = anchors.sparkSession.sparkContext.broadcast(matrix(chosen, width, True))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        p = pivots.value
        return pd.Series(np.argmin((p * p).sum(1) - 2 * (matrix(v, width, True) @ p.T), axis=1))

    return anchors.withColumn("pivot", nearest("v"))


def hard_negatives(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: Column | None = None, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key is divisible by `every`; a row's score is its inner product with the anchor. An
    anchor's positives are its first five other rows of the same label; negatives are the first three rows of other
    labels with 50 to 95 hundredths of the positive's score. Higher scores come first, equal ones by smaller key.

    Rows with a NULL key, label or vector, or a NULL or non-finite component, take no part. Shorter vectors are filled
    up with zeros. Rows that repeat wholly count once; several different rows of one key are several rows, and an anchor
    leaves out itself alone. A positive without a negative gives no row; nor does a positive of negative score, which
    has an empty window. An empty table gives no rows. Extra columns are left out. Vectors so long that products could
    pass 2^62 are an error.

    Equal vectors of one label are scored once and lend six keys at most. Distinct vectors meet the trees block against
    block, and a pair of blocks gives back a few rows for each anchor.
    """
    rows = staged(whole_vectors(df, key, vec, F.col("label") if label is None else label))
    first = Window.partitionBy("label", "v").orderBy("id")
    lent = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= POSITIVES + 1)
    points = lent.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    longest = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    n, width, square = rows.groupBy("label", "v").count().agg(F.count(F.lit(1)), F.max(F.size("v")), longest).first()
    n_chunks, width, square = math.ceil(max(n, 1) / CHUNK), int(width or 0), float(square or 0)
    if square >= 2.0**62:
        raise ValueError("inner products of these vectors may not fit into 64 bits; scale the vectors down")
    exact = square < 2.0**52
    points = staged(points.withColumn("chunk", F.pmod(F.xxhash64("label", "v"), F.lit(n_chunks)).cast("int")))

    members = rows.filter(F.col("id") % every == 0)
    anchors = staged(members.groupBy("label", "v").agg(F.min("id").alias("aid")))
    # Two labels may hold one key, so anchors are named by their place.
    placed = position_by_sort(_nearest_pivot(anchors, width), ["pivot", "aid", "label", "v"])
    placed = placed.withColumn("tree", F.floor(F.col("position") / TREE).cast("int")).drop("pivot", "aid")
    n_trees = math.ceil(max(anchors.count(), 1) / TREE)

    def grow(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("position").reset_index(drop=True)
        parent, edge = spanning_tree(matrix(tree["v"], width, exact))
        return tree.rename(columns={"position": "aid"}).assign(place=np.arange(len(tree)), parent=parent, edge=edge)

    schema = "aid bigint, label bigint, v array<bigint>, tree int, place int, parent int, edge double"
    trees = staged(placed.select("position", "label", "v", "tree").groupBy("tree").applyInPandas(grow, schema))

    blocks = (n_trees, n_chunks)
    near = _pairs_of_blocks(trees, points, *blocks, lambda t, c: best_positives(t, c, width, exact), "aid bigint, id bigint, score bigint, twin boolean")
    best = Window.partitionBy("aid").orderBy(F.desc("score"), "id", "twin")
    near = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= POSITIVES + 1)
    found = F.sort_array(F.collect_list(F.struct("n", "id", "score", "twin")))
    tops = staged(near.groupBy("aid").agg(found.alias("found"), F.collect_set("score").alias("scores")))

    asked = trees.join(tops.select("aid", "scores"), "aid", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<bigint>")))
    far = _pairs_of_blocks(asked, points, *blocks, lambda t, c: best_negatives(t, c, width, exact), "aid bigint, positive_score bigint, id bigint, score bigint")
    best = Window.partitionBy("aid", "positive_score").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)
    negatives = far.groupBy("aid").agg(F.collect_list(F.struct("positive_score", "rank", "id", "score")).alias("negatives"))

    lists = trees.select("aid", "label", "v").join(tops.select("aid", "found"), "aid").join(negatives, "aid")
    mine = members.select(F.col("id").alias("anchor_id"), "label", "v").join(lists, ["label", "v"])
    others = F.filter("found", lambda f: ~(f["twin"] & (f["id"] == F.col("anchor_id"))))
    return (
        mine.select("anchor_id", F.explode(F.slice(others, 1, POSITIVES)).alias("p"), "negatives")
        .select("anchor_id", "p", F.explode(F.filter("negatives", lambda x: x["positive_score"] == F.col("p.score"))).alias("x"))
        .select(
            "anchor_id",
            F.col("p.id").alias("positive_id"),
            F.col("x.rank").alias("rank"),
            F.col("x.id").alias("negative_id"),
            F.col("p.score").alias("positive_score"),
            F.col("x.score").alias("negative_score"),
        )
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), label=label)


OP12_SQL = f"""
WITH base AS (
  SELECT DISTINCT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, r.id AS id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM base a JOIN base r ON a.id % 50 = 0 AND (r.label <> a.label OR r.id <> a.id)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
found AS (
  SELECT p.*, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND {LEAST} * positive_score <= 100 * n.score AND 100 * n.score <= {MOST} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= {NEGATIVES}"""
