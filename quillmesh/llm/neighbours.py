"""Approximate nearest neighbours by cosine: probed lists with an adaptive dimension scan.

* Equal vectors become one; of each its smallest ids are kept, as many as an answer can need.
* Centroids from a bounded sample (SAMPLE distinct vectors with the smallest hashes) cut the
  vectors into lists. How many lists a query probes is the least number that covers COVER of the
  true neighbours of CALIBRATE query vectors, which are compared with every vector.
* Vectors are scaled to length 1, rotated by one random orthogonal matrix, and cut into column
  blocks. Within each probed list, in blocks of at most BLOCK vectors and QUERIES queries, the
  distance over the first dimensions, scaled up, is tested against the best distances so far:
  a candidate that is farther than the test allows for is abandoned, the rest goes on to the
  next column block. Survivors are scored on the original vectors in double precision. The k + 1
  best of those first looked at are never abandoned, and a query goes on to further lists until
  those that it probes hold k + 1 vectors, so none gets fewer rows than there are candidates.

Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no
part. Vectors of different length are never compared; each length is searched by itself. Equal (id, vector) rows count once. Equal scores go
to the smaller id. A query with fewer candidates than k gets them all. No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

SAMPLE, LISTS, PER_LIST = 16384, 1024, 256
CALIBRATE, COVER = 64, 0.985
COLUMNS, EPSILON = 16, 2.4
BLOCK, QUERIES = 2048, 512
SEED = 53
RESULT = "query_id long, rank int, id long, score double"


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit rows; an emptied list starts again at a row."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), x[rng.integers(0, len(x), lists)])
    return c


def scan(v: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """For each rotated unit query the rows of v that the tests leave, nearest ones among them. Both have their columns in blocks."""
    dims = v.shape[1]
    if len(v) <= 2 * k:
        return [np.arange(len(v))] * len(q)
    first = min(COLUMNS, dims)
    part = (v[:, :first] ** 2).sum(1)[None, :] + (q[:, :first] ** 2).sum(1)[:, None] - 2 * (q[:, :first] @ v[:, :first].T)
    seedlings = np.argpartition(part, 2 * k, axis=1)[:, : 2 * k]
    out = []
    for i, row in enumerate(q):
        near = ((v[seedlings[i]] - row) ** 2).sum(1)
        first_best = np.argpartition(near, k - 1)[:k]
        bound = np.sqrt(near[first_best].max())
        alive, partial, d = np.arange(len(v)), np.maximum(part[i], 0), first
        while d < dims:
            keep = np.sqrt(partial * dims / d) <= bound * (1 + EPSILON / np.sqrt(d))
            alive, partial = alive[keep], partial[keep]
            to = min(d + COLUMNS, dims)
            partial = partial + ((v[alive, d:to] - row[d:to]) ** 2).sum(1)
            d = to
        out.append(np.union1d(alive[partial <= bound * bound + 1e-9], seedlings[i][first_best]))
    return out


def exact(v: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (v * row).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((row * row).sum()))


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return good.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that is_query (a condition on the column id) the k nearest other ids found."""
    every = written(usable(rows, id_col, vector_col), "vectors")
    lengths = sorted(r["n"] for r in every.select(F.size("v").alias("n")).distinct().collect())  # a number for each length of vector
    out = None
    for n in lengths:
        found = search_equal(every.where(F.size("v") == n) if len(lengths) > 1 else every, is_query, k)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], RESULT) if out is None else out


def search_equal(all_rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """search() over usable rows (id, v) whose vectors are equally long."""
    # row_number with a bound is cut on the map side first, so hot copies don't meet in one task
    order = Window.partitionBy("v").orderBy("id")
    members = all_rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    members = written(members.select("v", "id", "n"), "members")
    classes = members.where("n = 1").select(F.col("id").alias("c"), "v")
    total = classes.count()
    sample = classes.orderBy(F.xxhash64(F.lit(SEED), "c"), "c").limit(SAMPLE).toPandas().sort_values("c")
    x = unit(matrix(sample["v"]))
    center = centroids(x, max(1, min(LISTS, total // PER_LIST, len(x) // 8)))
    turn = rotation(x.shape[1])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(list=(unit(matrix(b["v"])) @ center.T).argmax(1))

    placed = written(classes.mapInPandas(place, "c long, v array<double>, list int"), "placed")
    asked = all_rows.where(is_query).distinct()
    queries = written(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")
    probes = probe_count(placed, queries, center, k)
    held = np.zeros(len(center), dtype=np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list
        held[r["list"]] = r["count"]

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-(unit(matrix(b["v"])) @ center.T), axis=1, kind="stable").astype(np.int32)
                need = 1 + (np.cumsum(held[near], axis=1) < k + 1).sum(1)
                yield pd.DataFrame({"q": b["q"], "v": b["v"], "list": [row[: max(probes, n)] for row, n in zip(near, need, strict=True)]})

    wanted = queries.mapInPandas(lists, "q long, v array<double>, list array<int>").select("q", "v", F.explode("list").alias("list"))
    wanted = written(wanted, "wanted")
    blocks = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = blocks(placed, BLOCK, "vs").join(blocks(wanted, QUERIES, "qs"), "list")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(sizes, "list").withColumn("vb", F.pmod(F.xxhash64("c"), "vs").cast("int")).withColumn("qb", every("qs")).select("list", "vb", "qb", "c", "v")
    right = wanted.join(sizes, "list").withColumn("qb", F.pmod(F.xxhash64("q"), "qs").cast("int")).withColumn("vb", every("vs")).select("list", "vb", "qb", "q", "v")

    def compare(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or asked.empty:
            return pd.DataFrame({"q": [], "c": [], "score": []})
        v, q, ids = matrix(vectors["v"]), matrix(asked["v"]), vectors["c"].to_numpy()
        found = []
        for i, alive in enumerate(scan(unit(v) @ turn, unit(q) @ turn, k + 1)):
            score = exact(v[alive], q[i])
            top = best(ids[alive], score, k + 1)
            found.append(pd.DataFrame({"q": asked["q"].iloc[i], "c": ids[alive][top], "score": score[top]}))
        return pd.concat(found)

    key = ["list", "vb", "qb"]
    scored = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "q long, c long, score double")
    near = scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("n") <= k + 1).select("q", "c", "score")
    named = members.join(members.where("n = 1").select("v", F.col("id").alias("c")), "v").select("c", "id")
    rows_of = near.join(named, "c").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    each = asked.select(F.col("id").alias("query_id"), "v").join(queries, "v").select("query_id", "q")
    out = each.join(rows_of.select("q", "id", "score"), "q").where("id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "id", "score")


def probe_count(placed: DataFrame, queries: DataFrame, center: np.ndarray, k: int) -> int:
    """The lists that a query must probe so that COVER of the true neighbours of CALIBRATE queries lie in them."""
    sample = queries.orderBy(F.xxhash64(F.lit(SEED + 1), "q"), "q").limit(CALIBRATE).toPandas()
    if sample.empty or len(center) == 1:
        return 1
    q = unit(matrix(sample["v"]))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cos = q @ unit(matrix(b["v"])).T
                top = np.argsort(-cos, axis=1, kind="stable")[:, : k + 1]
                yield pd.DataFrame({"i": np.repeat(np.arange(len(q)), top.shape[1]), "c": b["c"].to_numpy()[top].ravel(), "list": b["list"].to_numpy()[top].ravel(), "cos": np.take_along_axis(cos, top, 1).ravel()})

    found = placed.mapInPandas(nearest, "i int, c long, list int, cos double")
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cos"), "c"))).where(F.col("n") <= k + 1).collect()  # CALIBRATE x (k + 1) rows
    order = np.argsort(np.argsort(-(q @ center.T), axis=1, kind="stable"), axis=1)
    need = np.sort([order[r["i"], r["list"]] + 1 for r in first])
    return int(need[min(len(need) - 1, int(np.ceil(COVER * len(need))) - 1)])


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
