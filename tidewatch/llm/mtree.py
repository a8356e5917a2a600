"""Exact top-k search by inner product with an M-tree of paged metric nodes.

Vectors of whole numbers get one more coordinate so that all have the same
length; the inner product with a query then falls as the Euclidean distance
grows, and the search is one for nearest neighbours in a metric space. Vectors
go to the nearest of a bounded number of pivots; what belongs to one pivot is
cut into pages, and a page is a small tree: routing objects with covering
radii, and for every entry its distance to its routing object. A query first
searches the page it lives in, which bounds its k-th score. Pages whose ball
can't hold a better vector are left out; in the others routing objects are
visited best first, and stored distances spare computations by the triangle
inequality. Bounds are rounded in favour of visiting, scores are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordering import smallest_per_group
from tidewatch.session import materialise

PIVOTS = 512  # most pivots: with 64 numbers each they are 0.3 MB
PAGE = 2_048  # vectors a page
NODE = 32  # entries a routing object, about
BLOCK = 1_024  # queries handled together
_SLACK = 0.5  # scores are whole numbers, so bounds may be off by less than one


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.values.slice(column.offset * dims).to_numpy(zero_copy_only=False)[: len(column) * dims].reshape(-1, dims).astype(np.float64)


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Append the coordinate that makes every vector as long as the longest one."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(1)))])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x - c) ** 2).sum(-1)))


class Page:
    """A page of the tree: entries sorted by routing object, with all stored distances."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], longest: float):
        self.vectors, self.ids = vectors, ids
        x = _lift(vectors, longest)
        self.centre = x.mean(0)
        self.radius = float(_distances(x, self.centre).max())
        # Routing objects are entries spread over the page.
        k = max(1, len(x) // NODE)
        objects = x[np.linspace(0, len(x) - 1, k).astype(int)]
        squares = (x * x).sum(1)[:, None] - 2 * x @ objects.T + (objects * objects).sum(1)
        owner = squares.argmin(1)
        order = np.argsort(owner, kind="stable")
        self.vectors, self.ids, owner, x = vectors[order], [ids[i] for i in order], owner[order], x[order]
        used, self.begin = np.unique(owner, return_index=True)
        self.end = np.append(self.begin[1:], len(x))
        self.objects = objects[used]
        self.to_parent = _distances(self.objects, self.centre)  # of routing objects to the page
        self.to_object = _distances(x, objects[owner])  # of entries to their routing object
        self.covering = np.maximum.reduceat(self.to_object, self.begin)

    def search(self, query: np.ndarray, k: int, longest: float, floor: float) -> list[tuple[int, int]]:
        """The ``k`` best ``(-score, id)`` with scores of at least ``floor``, best first."""
        whole = float(query @ query) + longest
        q = np.append(query, 0.0)

        def score_within(distance: np.ndarray) -> np.ndarray:
            """The highest score that a vector at this distance or beyond can have."""
            return (whole - np.maximum(0.0, distance) ** 2) / 2 + _SLACK

        far = float(_distances(q, self.centre))
        best: list[tuple[int, int]] = []
        # By the parent's stored distances first: nothing is computed for objects that these rule out.
        live = np.flatnonzero(score_within(np.abs(far - self.to_parent) - self.covering) >= floor)
        if not len(live):
            return best
        near = _distances(self.objects[live], q)
        bounds = score_within(near - self.covering[live])
        queue = [(-b, i) for i, b in enumerate(bounds.tolist()) if b >= floor]
        heapq.heapify(queue)
        while queue:
            bound, i = heapq.heappop(queue)
            if -bound < floor:
                break
            a, b = self.begin[live[i]], self.end[live[i]]
            some = np.flatnonzero(score_within(np.abs(near[i] - self.to_object[a:b])) >= floor) + a
            scores = self.vectors[some] @ query
            for at in np.flatnonzero(scores >= floor).tolist():
                score = int(scores[at])
                best += [(-score, j) for j in self.ids[some[at]]]
            if len(best) >= k:
                best = heapq.nsmallest(k, best)
                floor = max(floor, float(-best[-1][0])) if len(best) == k else floor
        return sorted(best)[:k]


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, in double; null if one is missing or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other rows of every query row.

    Score is the integer inner product of ``floor(scale * x)``; ties go to the
    smaller key; a query with fewer other rows gets them all. Vectors that are
    missing, empty or hold missing or non-finite components take no part, nor
    do rows without a key; rows that repeat a key and vector count once.
    Vectors of different lengths are not compared. Equal vectors are searched
    once and keep their ``k + 1`` smallest keys, which is all that a result can
    hold. Scores must stay below 2 ** 53. An empty table gives no rows; other
    columns are not used.
    """
    spark = vectors.sparkSession
    given = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), whole_numbers(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    given = materialise(given.where("v IS NOT NULL").withColumn("dims", F.size("v")))
    asked = given.groupBy("v").agg(F.max("q").alias("q"))
    # Rank limits apply before the shuffle, so a very common vector sends k + 1 rows a task.
    classes = smallest_per_group(given.select("v", "id").distinct(), ["v"], "id", k + 1)
    classes = materialise(classes.join(asked, "v").select("v", F.col("id").alias("ids"), F.element_at("id", 1).alias("cid"), "q", F.size("v").alias("dims")))
    squares = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    sizes = classes.groupBy("dims").agg(F.max(squares).alias("longest"), F.count(F.lit(1)).alias("n")).orderBy("dims").collect()
    found: DataFrame | None = None
    for size in sizes:  # one tree per vector length
        part = _search(classes.where(F.col("dims") == size["dims"]), size["dims"], size["longest"], size["n"], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    owners = given.where("q").select("v", F.col("id").alias("query_id")).distinct().join(classes.select("v", "cid"), "v")
    mine = owners.join(found, "cid").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(classes: DataFrame, dims: int, longest: float, n: int, k: int) -> DataFrame:
    """``(cid, vec_id, score)``: the ``k + 1`` best keys of every class that is asked for."""
    spark = classes.sparkSession
    more = k + 1
    count = max(1, min(PIVOTS, n // PAGE))
    drawn = classes.orderBy(F.xxhash64("cid"), "cid").limit(count).select("v").toArrow()
    pivots = _lift(np.array(drawn.column("v").to_pylist(), np.float64), longest)
    sent = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            x = _lift(_rows(batch.column("v"), dims), longest)
            node = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
            yield batch.append_column("node", pa.array(node.astype(np.int32)))

    placed = materialise(classes.select("cid", "v", "ids", "q").mapInArrow(nearest, "cid bigint, v array<bigint>, ids array<bigint>, q boolean, node int"))
    # A pivot with many vectors is cut into several pages by a hash.
    cut = placed.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PAGE).alias("cuts"))
    paged = placed.join(cut, "node").withColumn("page", F.concat_ws("-", "node", F.pmod(F.xxhash64("cid"), "cuts")))

    def tree_of(rows: pa.Table | pd.DataFrame) -> Page:
        return Page(np.array(rows["v"].tolist(), np.float64), [list(map(int, x)) for x in rows["ids"]], longest)

    def home(rows: pd.DataFrame) -> pd.DataFrame:
        """The ball of a page, and what its own queries find in it."""
        tree = tree_of(rows)
        asked = rows[rows["q"]]
        out = [(rows["page"].iloc[0], tree.centre.tolist(), tree.radius, None, None, None)]
        for cid, v in zip(asked["cid"], asked["v"], strict=True):
            best = tree.search(np.asarray(v, np.float64), more, longest, -np.inf)
            out.append((rows["page"].iloc[0], None, None, int(cid), list(map(int, v)), float(-best[-1][0]) if len(best) == more else -np.inf))
        return pd.DataFrame(out, columns=["page", "centre", "radius", "cid", "v", "floor"])

    first = paged.groupBy("page").applyInPandas(home, "page string, centre array<double>, radius double, cid bigint, v array<bigint>, floor double")
    first = materialise(first)
    balls = first.where("centre IS NOT NULL").select("page", "centre", "radius")
    queries = first.where("cid IS NOT NULL").select("cid", "v", "floor")
    blocks = max(1, queries.count() // BLOCK)
    # The stated queries against all pages, in blocks: balls decide which pages a query needs.
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int"))
    every = balls.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grouped = every.groupBy("block").cogroup(dealt.groupBy("block"))

    def needed(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pages) or not len(asked):
            return pd.DataFrame({"page": [], "cid": [], "v": [], "floor": []})
        q = np.column_stack([np.array(asked["v"].tolist(), np.float64), np.zeros(len(asked))])
        whole = (q * q).sum(1) + longest
        parts = []
        for page, centre, radius in zip(pages["page"], pages["centre"], pages["radius"], strict=True):
            near = np.maximum(0.0, _distances(q, np.asarray(centre)) - radius)
            some = asked[(whole - near**2) / 2 + _SLACK >= asked["floor"]]
            parts.append(some[["cid", "v", "floor"]].assign(page=page))
        return pd.concat(parts)[["page", "cid", "v", "floor"]]

    wanted = grouped.applyInPandas(needed, "page string, cid bigint, v array<bigint>, floor double")

    def visit(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            tree = tree_of(rows)
            for cid, v, floor in zip(asked["cid"], asked["v"], asked["floor"], strict=True):
                out += [(int(cid), j, -s) for s, j in tree.search(np.asarray(v, np.float64), more, longest, floor)]
        return pd.DataFrame(out, columns=["cid", "vec_id", "score"]).astype("int64")

    visited = paged.groupBy("page").cogroup(wanted.groupBy("page")).applyInPandas(visit, "cid bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    return visited.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= more).drop("_rank")
