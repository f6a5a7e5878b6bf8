"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Unit vectors are projected by a fixed Gaussian (2-stable) matrix. One kd-tree over the projections, cut from a bounded
sample, gives every vector its leaf; the leaves' boxes are then taken from all vectors. A query visits the leaves in order
of their distance from its projection, a round of leaves at a time, and every vector of a visited leaf is verified with its
true cosine. For a vector at true distance d, (projected distance / d)^2 is chi-square distributed, so a query leaves out a
leaf, and stops, once a vector at the distance of its present k-th neighbour would lie nearer than that leaf with
probability 1 - MISS.

Vectors are shuffled once to find equal ones and once a round to their leaves; queries travel to the leaves they visit. A
leaf's vectors are held in parts of bounded size while queries stream past them. All vectors are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import freed, materialize, small_batches, table

K, DIMS, MISS = 5, 8, 0.02
#: Vectors of a leaf that the tree aims at, of a part of a leaf at most, greatest depth, vectors expected in the sample it is cut from.
LEAF_ROWS, PART_ROWS, DEPTH, SAMPLE_ROWS = 2_048, 16_384, 12, 16_384
#: Leaves that a query visits in the first round, and how many times as many in each further one.
FIRST, MORE = 4, 8


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom (a finite sum)."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def units(vectors) -> np.ndarray:
    v = np.stack(vectors)
    v = v / np.abs(v).max(1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def project(unit: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The same stable projection for all vectors of one length."""
    return unit @ np.random.default_rng((20, unit.shape[1])).normal(size=(unit.shape[1], dims))


class Tree:
    """kd-tree of 2**depth leaves, cut at medians of the widest dimension of a sample's points."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.value = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
        own = {0: points}
        for node in range(2**depth - 1):
            p = own.pop(node)
            if len(p):
                d = int((p.max(0) - p.min(0)).argmax())
                self.dim[node], self.value[node] = d, np.median(p[:, d])
            right = p[:, self.dim[node]] > self.value[node]
            own[2 * node + 1], own[2 * node + 2] = p[~right], p[right]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] > self.value[node])
        return node - (2**self.depth - 1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector is not null, empty or zero and has only finite components."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def by_length(frame: pd.DataFrame):
    """(length, rows) of the vectors of each length; only these are compared."""
    return frame.groupby(frame["v"].map(len), sort=True)


def indexed(rows: DataFrame, k: int, leaf_rows: int) -> DataFrame:
    """A written table of the distinct vectors: h, v, ids (the k + 1 smallest of theirs), dim, leaf, p (projection)."""
    # a frequent vector's ids are ranked and cut in each task before they meet
    names = rows.select("h", "g", "vec_id").distinct()
    first = names.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = first.groupBy("h", "g").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    held = rows.groupBy("h", "g").agg(F.first("v").alias("v")).join(ids, ["h", "g"]).select("h", "v", "ids")
    n = rows.count()

    def projections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, own in by_length(b):
                yield pd.DataFrame({"h": own["h"], "p": list(project(units(own["v"])))})

    # each sampled vector once, and only its projection reaches the driver
    near = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 30)) < min(1 << 30, SAMPLE_ROWS * (1 << 30) // max(1, n) + 1)
    sample = rows.where(near).groupBy("h", "g").agg(F.first("v").alias("v")).mapInPandas(freed(projections), "h long, p array<double>").collect()
    points = np.array([r["p"] for r in sorted(sample)]).reshape(-1, DIMS)
    tree = Tree(points, min(DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / leaf_rows))))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, own in by_length(b):
                p = project(units(own["v"]))
                yield own.assign(dim=dim, leaf=tree.leaf(p), p=list(p))

    return materialize(held.mapInPandas(freed(place), "h long, v array<double>, ids array<long>, dim int, leaf int, p array<double>"), "index")


class Boxes:
    """Leaves of one vector length: their numbers, box corners and numbers of parts."""

    def __init__(self, rows: list):
        self.leaf = np.array([r["leaf"] for r in rows])
        self.parts = np.array([-(-r["n"] // PART_ROWS) for r in rows])
        self.low, self.high = (np.array([[r[f"{c}{i}"] for i in range(DIMS)] for r in rows]) for c in ("a", "b"))

    def reach(self, points: np.ndarray) -> np.ndarray:
        """(points, leaves) squared distances of the boxes from the points."""
        out = np.zeros((len(points), len(self.leaf)))
        for d in range(DIMS):
            out += np.square(np.maximum(0, np.maximum(self.low[None, :, d] - points[:, d, None], points[:, d, None] - self.high[None, :, d])))
        return out


def boxes_of(index: DataFrame) -> dict[int, Boxes]:
    """From all vectors: at most 2**DEPTH rows for each vector length reach the driver."""
    corner = [f(F.col("p")[i]).alias(f"{c}{i}") for c, f in (("a", F.min), ("b", F.max)) for i in range(DIMS)]
    rows = index.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n"), *corner).orderBy("dim", "leaf").collect()
    return {dim: Boxes([r for r in rows if r["dim"] == dim]) for dim in {r["dim"] for r in rows}}


def visits(boxes: dict[int, Boxes], since: int, until: int, miss: float):
    """Rows that send each query to the leaves from its `since`-th to its `until`-th nearest that the test leaves in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, own in by_length(b):
                box = boxes[dim]
                for at in range(0, len(own), 512):
                    part = own.iloc[at : at + 512]
                    reach = box.reach(project(units(part["v"])))
                    order = np.argsort(reach, axis=1, kind="stable")[:, since:until]
                    reach = np.take_along_axis(reach, order, 1)
                    far = np.maximum(0, 2 - 2 * part["kth"].to_numpy(float))[:, None]  # squared distance of the k-th; nan while there are fewer
                    with np.errstate(divide="ignore", invalid="ignore"):
                        seen = np.where(far > 0, chi_square_cdf(reach / far, DIMS), (reach > 0) * 1.0)
                    q, nth = np.nonzero(np.isnan(far) | (seen < 1 - miss))
                    leaf = order[q, nth]
                    times = box.parts[leaf]
                    q, leaf = np.repeat(q, times), np.repeat(leaf, times)
                    piece = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                    yield pd.DataFrame({"dim": np.int32(dim), "leaf": box.leaf[leaf].astype(np.int32), "part": piece.astype(np.int32), "query_id": part["query_id"].to_numpy()[q], "h": part["h"].to_numpy()[q], "v": part["v"].to_numpy()[q], "ids": None})

    return run


CELL = "dim int, leaf int, part int, query_id long, h long, v array<double>, ids array<long>"


def verified(k: int):
    """Streams cells sorted so that vectors (with ids) come before queries: the k nearest of a cell for each of its queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, base, ids = None, [], None, []
        for b in batches:
            for key, own in b.groupby(["dim", "leaf", "part"], sort=False):
                if key != cell:
                    cell, held, base = key, [], None
                query = own["ids"].isna()
                if not query.all():
                    held.append(own.loc[~query, ["v", "ids"]])
                asked = own[query]
                if not len(asked) or not held:
                    continue
                if base is None:
                    rows = pd.concat(held)
                    base, ids = units(rows["v"]), rows["ids"].tolist()
                for at in range(0, len(asked), 256):
                    yield nearest_of(base, ids, asked.iloc[at : at + 256], k)

    return run


def nearest_of(base: np.ndarray, ids: list, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """k nearest ids of base for each query, not its own; ties to the smaller id."""
    unit, out = units(asked["v"]), []
    rough = unit @ base.T
    least = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if len(base) > k + 1 else np.full(len(unit), -2.0)
    for q, qid, h in zip(range(len(unit)), asked["query_id"].tolist(), asked["h"].tolist(), strict=True):
        near = np.flatnonzero(rough[q] >= least[q] - 1e-9)
        score = np.einsum("d,ld->l", unit[q], base[near])  # the same sum for equal vectors, wherever they stand
        found = sorted((-s, int(i)) for p, s in zip(near.tolist(), score.tolist(), strict=True) for i in ids[p] if i != qid)
        out += [(qid, h, i, -s) for s, i in found[:k]]
    return pd.DataFrame(out, columns=["query_id", "h", "vec_id", "score"])


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, leaf_rows: int = LEAF_ROWS, miss: float = MISS) -> DataFrame:
    """For each query row, its k nearest other rows by cosine: query_id, rank, vec_id, score; ties to the smaller id.

    is_query: Column -> Column over the id. Unusable vectors (see `usable`) and null ids take no part; only vectors of
    equal length are compared; equal vectors are indexed once with the k + 1 smallest of their ids, which loses nothing.
    Repeated rows count once; an id with several vectors is found, and asks, with the best score of any of them. Fewer
    than k candidates: all of them. Other columns are not looked at; an empty table gives no rows.
    """
    rows = usable(small_batches(df), id_col, vec_col).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64("v", F.lit(7))})
    index = indexed(rows, k, leaf_rows)
    boxes = boxes_of(index)
    asked = materialize(rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "h", "v").dropDuplicates(["query_id", "h"]), "asked")
    parts = {(dim, leaf): n for dim, box in boxes.items() for leaf, n in zip(box.leaf.tolist(), box.parts.tolist(), strict=True)}
    cells = max(1, sum(parts.values()))
    split = [(d, x, n) for (d, x), n in parts.items() if n > 1]
    vectors = index.withColumn("parts", F.lit(1))
    if split:  # at most one row for each leaf
        vectors = index.join(F.broadcast(df.sparkSession.createDataFrame(split, "dim int, leaf int, parts int")), ["dim", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    vectors = vectors.select("dim", "leaf", F.pmod(F.xxhash64("h", F.lit(2)), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("long").alias("query_id"), "h", "v", "ids")
    best = None
    since, until = 0, FIRST
    most = max((len(box.leaf) for box in boxes.values()), default=0)
    while since < most:
        live = asked.withColumn("kth", F.lit(None).cast("double"))
        if best is not None:
            kth = best.groupBy("query_id", "h").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            live = asked.join(kth, ["query_id", "h"], "left")
        sent = live.mapInPandas(freed(visits(boxes, since, until, miss)), CELL)
        if best is not None:
            sent = materialize(sent, "visits")
            if sent.isEmpty():
                break
            used = sent.select("dim", "leaf").distinct()  # at most one row for each leaf
            vectors_now = vectors.join(F.broadcast(used), ["dim", "leaf"], "left_semi")
        else:
            vectors_now = vectors
        order = [F.col("dim"), F.col("leaf"), F.col("part"), F.col("ids").isNull()]
        met = vectors_now.unionByName(sent).repartition(min(cells, 100_000), "dim", "leaf", "part").sortWithinPartitions(*order)
        hits = met.mapInPandas(freed(verified(k)), "query_id long, h long, vec_id long, score double")
        if best is not None:
            hits = hits.unionByName(best)
        hits = hits.groupBy("query_id", "h", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors
        rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
        best = materialize(hits.withColumn("r", rank).where(F.col("r") <= k).drop("r"), "best")
        since, until = until, until + (until - since) * MORE
    if best is None:
        best = asked.select("query_id", "h", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("score")).where("1 = 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


QUERIES = {"op7_neighbours": op7_neighbours}
ORACLES: dict[str, str] = {}
