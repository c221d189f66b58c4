"""Exact neighbours in blocks, the k-distance curve, density clusters with noise, and a neighbour graph's clusters.

Rows are dealt into blocks by a hash, and each pair of blocks is one task's work. What leaves a task
is a number, a place or a link for each of its rows, never the pairs themselves. Squared distances come
from matrix products, tile by tile; pairs that these can't settle are computed from the differences.
Distances are rounded to DIGITS, so that a radius taken from the distances themselves includes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import cut
from .ranks import running

DIGITS = 9
#: A block asked has up to 8 times, a block of others 32 times BLOCK rows; a small table is asked in up to SPREAD blocks of BLOCK rows.
BLOCK, SPREAD = 2048, 16
TALL, WIDE, PAIRS = 128, 1024, 16384  # a tile of distances within a pair of blocks, small enough for a core's cache, and the pairs of one step of gaps
FEW = 64  # groups whose sums come from products


def matrix(column: pd.Series) -> np.ndarray:
    return np.concatenate(column.to_list()).astype(np.float64).reshape(len(column), len(column.iloc[0]))


def gaps(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of the pairs (x[i], y[j]), a bounded number at a time."""
    parts = [np.sqrt(((x[i[k : k + PAIRS]] - y[j[k : k + PAIRS]]) ** 2).sum(1)) for k in range(0, len(i), PAIRS)]
    return np.round(np.concatenate(parts), DIGITS) if parts else np.zeros(0)


def tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
    """(rows, others, squared distances, their error at most) of all pairs, by matrix products: the squares of the lengths are two columns more."""
    center = y.mean(0)
    if np.isfinite(center).all():  # the smaller the numbers, the smaller the error
        x, y = x - center, y - center
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    error = 1e-15 * (x.shape[1] + 4) * float(np.nanmax(xx, initial=0) + np.nanmax(yy, initial=0))
    x = np.column_stack((x, xx, np.ones(len(x))))
    y = np.ascontiguousarray(np.column_stack((-2 * y, np.ones(len(y)), yy)).T)
    for i in range(0, len(x), TALL):
        for j in range(0, y.shape[1], WIDE):
            at, to = slice(i, i + TALL), slice(j, j + WIDE)
            yield at, to, x[at] @ y[:, to], error


def found(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is set; faster than nonzero of two dimensions."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def reach(distance: np.ndarray | float, error: float) -> np.ndarray | float:
    """The square that no pair of this rounded distance is beyond."""
    return (distance + 10.0**-DIGITS) ** 2 + error


def linked(x: np.ndarray, y: np.ndarray, at: slice, to: slice, square: np.ndarray, error: float, eps: float) -> np.ndarray:
    """Whether the pairs of a tile are within eps; what the squares leave open is settled by the differences."""
    inner = max(0.0, eps - 10.0**-DIGITS) ** 2 - error
    sure = square < inner
    i, j = found(~(square > reach(eps, error)) & ~sure)
    sure[i, j] = gaps(x[at], y[to], i, j) <= eps
    return sure


def closest(a: pd.DataFrame, b: pd.DataFrame, m: int, most: float = np.inf) -> pd.DataFrame:
    """(key, other, distance): of each row of a the m nearest rows of b that are within most, itself before others, then by key."""
    x, y, own, ids = matrix(a["v"]), matrix(b["v"]), a["key"].to_numpy(), b["key"].to_numpy()
    parts, row, other, d, limit, fresh, waiting, seen = [], np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), [], 0, 0
    for at, to, square, error in tiles(x, y):
        if to.start == 0:
            row, other, d, limit, seen = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.full(len(square), reach(most, error)), 0
            if square.shape[1] > m:
                top = np.sqrt(np.maximum(np.partition(square, m - 1, 1)[:, m - 1] + error, 0))
                limit = np.fmin(limit, reach(top + 10.0**-DIGITS, error))
        i, j = found(~(square > limit[:, None]))
        if len(i):
            fresh.append((i, j + to.start, gaps(x[at], y[to], i, j)))
        seen, waiting, last = seen + 1, waiting + len(i), to.stop >= len(y)
        if fresh and (last or seen & (seen - 1) == 0 or waiting > 4 * m * len(square)):  # sorted after 1, 2, 4, 8 ... tiles, as limits fall slower and slower
            row, other, d = (np.concatenate(c) for c in zip((row, other, d), *fresh, strict=True))
            fresh, waiting = [], 0
            order = np.lexsort((ids[other], ids[other] != own[at][row], d, row))
            row, other, d = row[order], other[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, other, d, place = (c[place < m] for c in (row, other, d, place))
            full = place == m - 1
            limit[row[full]] = np.fmin(limit[row[full]], reach(d[full], error))
        if last:
            keep = (d <= most) | np.isinf(most)
            parts.append(pd.DataFrame({"key": own[at][row[keep]], "other": ids[other[keep]], "distance": d[keep]}))
    return pd.concat(parts)


def by_blocks(asked: DataFrame, others: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(rows asked, other rows) for every pair of blocks of two tables (key, v, ...)."""
    blocks = lambda rows: F.ceil(F.count("*") / rows)
    asked_in = F.greatest(F.lit(1), blocks(8 * BLOCK), F.least(F.lit(SPREAD), blocks(BLOCK)))
    others = others.toDF(*others.columns)  # a table may be asked about itself
    sizes = F.broadcast(asked.agg(asked_in.cast("int").alias("qs")).crossJoin(others.agg(F.greatest(F.lit(1), blocks(32 * BLOCK)).cast("int").alias("cs"))))  # one row
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    left = asked.crossJoin(sizes).withColumn("qb", deal("qs")).withColumn("cb", every("cs")).drop("qs", "cs")
    right = others.crossJoin(sizes).withColumn("cb", deal("cs")).withColumn("qb", every("qs")).drop("qs", "cs")
    empty = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
    both = lambda a, b: work(a.reset_index(drop=True), b.reset_index(drop=True)) if len(a) and len(b) else empty
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(both, schema)


def keyed(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(key, v, ...) of the rows that have both; keys are whole numbers without repeats, vectors equally long. Vectors of floats stay so until they are compared."""
    v = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    return df.select(F.col(key).cast("long").alias("key"), v.alias("v"), *more).where("key IS NOT NULL AND v IS NOT NULL")


def nearest(df: DataFrame, key: str, vector: str, m: int) -> DataFrame:
    """(key, place, other, distance): the m nearest rows of each row, itself at place 1; ties to the smaller key, all rows if fewer."""
    rows = keyed(df, key, vector)
    found = by_blocks(rows, rows, lambda a, b: closest(a, b, m), "key long, other long, distance double")
    place = F.row_number().over(Window.partitionBy("key").orderBy("distance", F.col("other") != F.col("key"), "other"))
    return found.withColumn("place", place).where(F.col("place") <= m).select("key", "place", "other", "distance")


def k_distances(df: DataFrame, key: str, vector: str, m: int, near: DataFrame | None = None) -> DataFrame:
    """(key, distance, place, rows): the distance of each row to its m-th nearest, itself counted, in ascending order; with fewer rows, to the farthest. near: nearest for at least m, if it is known."""
    last = (nearest(df, key, vector, m) if near is None else near.where(F.col("place") <= m)).groupBy("key").agg(F.max("distance").alias("distance"))
    return running(last, F.struct("distance", "key"), {"place": F.lit(1)}, totals=True).withColumnRenamed("place_all", "rows")


def radius(curve: DataFrame) -> DataFrame:
    """(eps), one row: the distance at which the curve (place, distance) is farthest from the line between its ends, the first such place."""
    ends = curve.agg(F.min("place").alias("x0"), F.max("place").alias("x1"), F.min_by("distance", "place").alias("y0"), F.max_by("distance", "place").alias("y1"))
    x, y = F.col("place"), F.col("distance")
    off = F.abs((F.col("y1") - F.col("y0")) * x - (F.col("x1") - F.col("x0")) * y + F.col("x1") * F.col("y0") - F.col("y1") * F.col("x0"))
    return curve.crossJoin(F.broadcast(ends)).agg(F.max_by("distance", F.struct(F.round(off, DIGITS), -x)).alias("eps"))  # ends is one row


def thinned(curve: DataFrame, points: int) -> DataFrame:
    """Every n-th row of the curve, so that about points are left."""
    step = F.greatest(F.lit(1), F.floor(F.col("rows") / points))
    return curve.where((F.col("place") - 1) % step == 0)


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (u, v) with the smallest node that it is joined with.

    Of each node's smaller neighbours only the smallest stays linked with it, and the others are
    linked with that one, until each node has one: a pointer. Pointers are then doubled until all
    lead to a root. Each round is written down; rows never grow in number.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        low = now.withColumn("low", F.min("v").over(Window.partitionBy("u")))
        kept = F.col("v") == F.col("low")
        now = cut(low.select(F.when(kept, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"), (~kept).alias("open")).groupBy("u", "v").agg(F.max("open").alias("open")))
        if not now.agg(F.max("open")).first()[0]:
            break
        now = now.select("u", "v")
    while True:
        up = now.select(F.col("u").alias("v"), F.col("v").alias("top"))
        now = cut(now.select("u", "v").join(up, "v", "left").select("u", F.coalesce("top", "v").alias("v"), F.col("top").isNotNull().alias("open")))
        if not now.agg(F.max("open")).first()[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(a: pd.DataFrame, b: pd.DataFrame, eps: float) -> pd.DataFrame:
    """(u, v): a link of every row with the smallest of its group, for the groups that links within eps of a's and b's rows make."""
    x, y, keys = matrix(a["v"]), matrix(b["v"]), np.concatenate((a["key"].to_numpy(), b["key"].to_numpy()))
    up = np.arange(len(keys))
    for at, to, square, error in tiles(x, y):
        u, v = np.nonzero(linked(x, y, at, to, square, error, eps))
        u, v = u + at.start, v + to.start + len(x)
        while len(u):
            u, v = up[u], up[v]
            u, v = np.minimum(u, v), np.maximum(u, v)
            apart = u < v
            u, v = u[apart], v[apart]
            up[v] = u
            while (up[up] != up).any():
                up = up[up]
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, up, keys)
    return pd.DataFrame({"u": keys, "v": least[up]})[keys != least[up]]


def density(df: DataFrame, key: str, vector: str, eps: float, least: int, near: DataFrame | None = None) -> DataFrame:
    """(key, cluster, core): density clusters; a row with at least least rows within eps, itself counted, is a core.

    Cores within eps of each other share a cluster, named after its smallest core. Any other row
    goes with its nearest core within eps, of equally near ones with the smallest, or is noise: -1.
    near: k_distances for least, if they are known; else rows are counted.
    """
    rows = keyed(df, key, vector)

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, n = matrix(a["v"]), matrix(b["v"]), np.zeros(len(a), int)
        for at, to, square, error in tiles(x, y):
            n[at] += linked(x, y, at, to, square, error, eps).sum(1)
        return pd.DataFrame({"key": a["key"], "near": n})

    if near is None:
        dense = by_blocks(rows, rows, count, "key long, near long").groupBy("key").agg((F.sum("near") >= least).alias("core"))
    else:
        dense = near.select("key", ((F.col("distance") <= eps) & (F.col("rows") >= least)).alias("core"))
    marked = cut(rows.join(dense, "key"))
    cores, rest = marked.where("core").select("key", "v"), marked.where("NOT core").select("key", "v")
    named = components(by_blocks(cores, cores, lambda a, b: joined(a, b, eps), "u long, v long")).select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    inner = cores.select("key").join(named, "key", "left").select("key", F.coalesce("cluster", "key").alias("cluster"), F.lit(True).alias("core"))
    border = by_blocks(rest, cores, lambda a, b: closest(a, b, 1, eps), "key long, other long, distance double")
    edge = border.groupBy("key").agg(F.min(F.struct("distance", "other")).alias("at")).select("key", F.col("at.other").alias("by"))
    outer = rest.select("key").join(edge, "key", "left").join(inner.select(F.col("key").alias("by"), "cluster"), "by", "left")
    return inner.unionByName(outer.select("key", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), F.lit(False).alias("core")))


def spread_out(y: DataFrame, k: int) -> DataFrame:
    """y (key, y array of k) with its k columns made orthonormal; the k x k sums of products are all that the driver sees."""
    at = [(i, j) for i in range(k) for j in range(i, k)]
    one = y.agg(*[F.expr(f"sum(get(y, {i}) * get(y, {j})) AS g{i}_{j}") for i, j in at]).first()
    gram = np.zeros((k, k))
    for i, j in at:
        gram[i, j] = gram[j, i] = one[f"g{i}_{j}"]
    turn = np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * np.trace(gram) * np.eye(k))).T
    column = lambda j: " + ".join(f"get(y, {i}) * double('{float(turn[i, j])!r}')" for i in range(k))
    return y.selectExpr("key", f"array({', '.join(column(j) for j in range(k))}) AS y")


def graph_clusters(df: DataFrame, key: str, vector: str, k: int, m: int = 10, rounds: int = 15, seed: int = 7, near: DataFrame | None = None) -> DataFrame:
    """(key, cluster): k-means on the leading k eigenvectors of the neighbour graph.

    Each row is linked with its m nearest (the row counted) with weight 1 where both name each other,
    else 0.5, divided by the roots of both degrees. The eigenvectors come from a block power iteration:
    each round sends the k numbers of every row twice along the links, by a join and a sum, and makes
    the block orthonormal. near: nearest for at least m, if it is known.
    """
    near = (nearest(df, key, vector, m) if near is None else near.where(F.col("place") <= m)).where("key <> other").select(F.col("key").alias("u"), F.col("other").alias("v"))
    both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u", "v").agg((F.count("*") / 2).alias("w"))
    degree = both.groupBy("u").agg(F.sum("w").alias("d"))
    links = cut(both.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v").select("u", "v", (F.col("w") / F.sqrt(F.col("d") * F.col("dv"))).alias("w")))
    start = degree.select(F.col("u").alias("key"), F.array(*[F.xxhash64(F.lit(seed), F.lit(i), "u") / F.lit(2.0**63) for i in range(k)]).alias("y"))
    y = spread_out(cut(start), k)

    def sent(t: DataFrame) -> DataFrame:
        cell = t.select(F.col("key").alias("v"), "y").join(links, "v").selectExpr("u AS key", *[f"w * get(y, {i}) AS y{i}" for i in range(k)])
        return cell.groupBy("key").agg(F.expr(f"array({', '.join(f'sum(y{i})' for i in range(k))}) AS y"))

    for _ in range(rounds):
        y = spread_out(cut(sent(sent(y))), k)  # what is made of the written sums is one projection
    length = F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x))
    flat = y.select("key", array_to_vector(F.transform("y", lambda x: x / F.greatest(length, F.lit(1e-12)))).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=30).fit(flat).transform(flat).select("key", F.col("prediction").cast("long").alias("cluster"))


def sorted_groups(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the columns that have a group, group by group, where each group starts among them); at: a column's group, -1 for none."""
    order = np.argsort(at, kind="stable")
    order = order[at[order] >= 0]
    return order, np.flatnonzero(np.diff(at[order], prepend=-1))


def by_group(d: np.ndarray, at: np.ndarray, n: int, dealt: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The sums of the columns of d for each of n groups. dealt: sorted_groups(at), if it is known."""
    order, starts = dealt or sorted_groups(at)
    out = np.zeros((len(d), n))
    if len(order):
        out[:, at[order][starts]] = np.add.reduceat(d[:, order], starts, 1)
    return out


def group_sums(at: list[np.ndarray], sizes: list[int], finite: bool) -> Callable[[np.ndarray, slice], list[np.ndarray]]:
    """A function of some columns of distances that gives their sums by group for each partition. Partitions of few groups share one product, if all distances are finite."""
    few, width = [], 0
    for k, n in enumerate(sizes):
        if finite and width + n <= FEW:
            few, width = [*few, k], width + n
    ones = np.concatenate([np.concatenate((np.eye(sizes[k]), np.zeros((1, sizes[k]))))[at[k]] for k in few], 1) if few else None
    ends, known = np.cumsum([sizes[k] for k in few])[:-1], {}

    def sums(d: np.ndarray, to: slice) -> list[np.ndarray]:
        quick = dict(zip(few, np.split(d @ ones[to], ends, 1), strict=True)) if few else {}
        if to.start not in known:
            known[to.start] = {k: sorted_groups(at[k][to]) for k in range(len(sizes)) if k not in quick}
        return [quick[k] if k in quick else by_group(d, at[k][to], n, known[to.start][k]) for k, n in enumerate(sizes)]

    return sums


def silhouettes(df: DataFrame, key: str, vector: str, label: str, noise: int | None = None) -> DataFrame:
    """(label, n, silhouette): the mean silhouette of each group by plain distances, and over all rows with label null.

    Rows of the noise label take no part. A group of one gives 0; fewer than two groups give nulls.
    """
    return silhouettes_of(df, key, vector, [label], noise).drop("of")


def silhouettes_of(df: DataFrame, key: str, vector: str, labels: list[str], noise: int | None = None) -> DataFrame:
    """(of, label, n, silhouette): silhouettes of several partitions of the same rows, each distance computed once for all. A row without a label takes no part in that partition."""
    one = lambda c: F.when(F.col(c).cast("long") != F.lit(noise), F.col(c).cast("long")) if noise is not None else F.col(c).cast("long")
    rows = keyed(df, key, vector, F.array(*[one(c) for c in labels]).alias("groups")).where(F.exists("groups", lambda g: g.isNotNull()))

    def far(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, own, at, groups = matrix(a["v"]), matrix(b["v"]), [], [], []
        for k in range(len(labels)):
            mine, theirs = (pd.Series([g[k] for g in t["groups"]], dtype="Int64") for t in (a, b))
            known = theirs.notna().to_numpy()
            values, place = np.unique(theirs[known].to_numpy(np.int64), return_inverse=True)
            index = np.full(len(b), -1)
            index[known] = place
            own, at, groups = [*own, mine], [*at, index], [*groups, values]
        total = [np.zeros((len(a), len(g))) for g in groups]
        sums = group_sums(at, [len(g) for g in groups], bool(np.isfinite(x).all() and np.isfinite(y).all() and max(np.abs(x).max(), np.abs(y).max()) < 1e100))
        for i, j, square, error in tiles(x, y):
            least = (error * 10.0**DIGITS) ** 2 + error  # closer ones would be off by more than the rounding
            if square.min() > least:
                d = np.sqrt(square, out=square)
            else:
                p, q = found(~(square > least))
                d = np.sqrt(np.maximum(square, 0, out=square), out=square)
                d[p, q] = gaps(x[i], y[j], p, q)
            for t, part in zip(total, sums(d, j), strict=True):
                t[i] += part
        parts = []
        for k, g in enumerate(groups):
            has = own[k].notna().to_numpy()
            n = int(has.sum())
            parts.append(pd.DataFrame({"key": np.repeat(a["key"].to_numpy()[has], len(g)), "of": k, "own": np.repeat(own[k][has].to_numpy(np.int64), len(g)), "other": np.tile(g, n), "total": total[k][has].ravel()}))
        return pd.concat(parts)

    total = by_blocks(rows, rows, far, "key long, of int, own long, other long, total double").groupBy("key", "of", "own", "other").agg(F.sum("total").alias("total"))
    size = F.broadcast(rows.select(F.posexplode("groups").alias("of", "other")).where("other IS NOT NULL").groupBy("of", "other").agg(F.count("*").alias("n")))  # a row for each group
    mean = total.join(size, ["of", "other"]).groupBy("key", "of", "own").agg(F.max(F.when(F.col("own") == F.col("other"), F.struct("n", "total"))).alias("mine"), F.min(F.when(F.col("own") != F.col("other"), F.col("total") / F.col("n"))).alias("b"))
    a = F.col("mine.total") / F.nullif(F.col("mine.n") - 1, F.lit(0))
    each = F.when(F.col("b").isNull(), None).when(F.col("mine.n") == 1, 0.0).otherwise(F.coalesce((F.col("b") - a) / F.nullif(F.greatest("b", a), F.lit(0.0)), F.lit(0.0)))
    out = mean.select(F.get(F.array(*[F.lit(c) for c in labels]), "of").alias("of"), F.col("own").alias("label"), each.alias("s")).groupBy("of", "label").agg(F.count("*").alias("n"), F.sum("s").alias("t"), F.count("s").alias("m"))
    whole = F.lit(None).cast("long")
    out = out.select("of", F.explode(F.array(F.col("label"), whole)).alias("label"), "n", "t", "m").groupBy("of", "label").agg(*[F.sum(c).alias(c) for c in ("n", "t", "m")])  # both from one pass over the pairs
    out = out.select("of", "label", "n", F.round(F.col("t") / F.nullif("m", F.lit(0)), 6).alias("silhouette"))
    if len(labels) == 1:  # also without rows
        none = df.sparkSession.range(1).select(F.lit(labels[0]).alias("of"), whole.alias("label"))
        out = none.join(out, (out["of"] == none["of"]) & out["label"].eqNullSafe(none["label"]), "full").select(F.coalesce(out["of"], none["of"]).alias("of"), out["label"], F.coalesce("n", F.lit(0).cast("long")).alias("n"), "silhouette")
    return out
