"""Segments: spending scores, scaling, validity metrics, partitions, and Spark ML entrants."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import percentile_rank


def spending_score(df: DataFrame, conversion: Column, responses: Column) -> DataFrame:
    """Half the rank of conversion and half that of responses, ranked again, 1 to 100."""
    rows = df.withColumns({"score_a": F.round(conversion, 12), "score_b": responses})
    rows = percentile_rank(percentile_rank(rows, "score_a", "rank_a"), "score_b", "rank_b")
    rows = percentile_rank(rows.withColumn("score_c", F.round(0.5 * F.col("rank_a") + 0.5 * F.col("rank_b"), 12)), "score_c", "rank_c")
    return rows.withColumn("spending_score", F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.col("rank_c") * 100))).drop("score_a", "score_b", "score_c", "rank_a", "rank_b", "rank_c")


def interactions(df: DataFrame) -> DataFrame:
    """Four ratios and products of the base attributes, with guards against zero."""
    s = F.col("spending_score")
    return df.withColumns({"discretionary_ratio": F.col("income_k") / (s + 1), "monetary_velocity": F.col("total_spend") / (F.col("recency_days") + 1), "digital_engagement": F.col("web_visits") * (s / 100), "deal_affinity": F.col("discount_sensitivity") * (1 - s / 100)})


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by population deviation, fitted in one aggregation; a constant column is 0."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}|m"), F.stddev_pop(c).alias(f"{c}|s"))])
    z = lambda c: F.when(F.col(f"`{c}|s`") > 0, (F.col(c) - F.col(f"`{c}|m`")) / F.col(f"`{c}|s`")).otherwise(0.0)
    return df.crossJoin(F.broadcast(stats)).select(*[c for c in df.columns if c not in columns], *[z(c).alias(c) for c in columns])  # stats is one row


def long(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    return df.select(key, *more, F.posexplode(vector).alias("dim", "x"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, size, center, spread): mean vector of each group and the mean distance to it."""
    cells = df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("m"))
    center = cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("center"))
    spread = df.join(center, label).groupBy(label).agg(F.count("*").alias("size"), F.avg(distance(F.col(vector), F.col("center"))).alias("spread"), F.sum(F.pow(distance(F.col(vector), F.col("center")), 2)).alias("within"))
    return center.join(spread, label)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def validity(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: Davies-Bouldin and Calinski-Harabasz from the groups' centers and spreads; fewer than two groups give nulls."""
    c = centroids(df, label, vector).persist()
    pairs = c.alias("a").join(c.alias("b"), F.col(f"a.{label}") != F.col(f"b.{label}"))
    worst = pairs.groupBy(F.col(f"a.{label}")).agg(F.max((F.col("a.spread") + F.col("b.spread")) / distance(F.col("a.center"), F.col("b.center"))).alias("r"))
    whole = df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
    parts = c.crossJoin(F.broadcast(whole)).agg(F.count("*").alias("k"), F.sum("size").alias("n"), F.sum("within").alias("within"), F.sum(F.col("size") * F.pow(distance(F.col("center"), F.col("mean")), 2)).alias("between"))  # one row
    ch = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return parts.crossJoin(worst.agg(F.avg("r").alias("db"))).select("k", "n", F.when(F.col("k") > 1, F.round("db", 5)).alias("davies_bouldin"), F.when(F.col("k") > 1, F.round(ch, 5)).alias("calinski_harabasz"))


def nearest(df: DataFrame, centers: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, distance, share): the nearest center and its inverse-distance share. centers is one row for each group and is sent to all tasks as one array."""
    table = centers.agg(F.array_sort(F.collect_list(F.struct(label, "center"))).alias("centers"))
    d = F.transform("centers", lambda c: F.struct(F.round(distance(F.col(vector), c["center"]), 9).alias("d"), c[label].alias("label")))
    rows = df.crossJoin(F.broadcast(table)).select(key, d.alias("d"))
    total = F.aggregate("d", F.lit(0.0), lambda s, x: s + 1 / (x["d"] + 1e-5))
    best = F.array_min("d")
    return rows.select(key, best["label"].alias(label), F.round(best["d"], 6).alias("distance"), F.round((1 / (best["d"] + 1e-5)) / total, 6).alias("share"))


def co_assignment(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the share of row pairs on which two partitions agree, from contingency counts."""
    pairs = lambda n: n * (n - 1) / 2
    cell = df.groupBy(a, b).agg(F.count("*").alias("n"))
    side = lambda c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"s_{c}"))
    one = cell.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("rows")).crossJoin(side(a)).crossJoin(side(b))
    every = pairs(F.col("rows"))
    return one.select("rows", F.round((every - F.col(f"s_{a}") - F.col(f"s_{b}") + 2 * F.col("both")) / every, 6).alias("agreement"))


def shares(df: DataFrame, label: str, least: float = 0.01) -> DataFrame:
    """(label, n, share, enough) of each group."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.select(label, "n", F.round(share, 6).alias("share"), (share >= least).alias("enough"))


def best_of(v: DataFrame, k: int, seeds: range) -> DataFrame:
    """v with the clusters of the k-means restart whose squares are least, of equal ones the first."""
    fits = [KMeans(k=k, seed=s, maxIter=20, predictionCol="cluster").fit(v) for s in seeds]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(v)


def entrants(df: DataFrame, vector: str, k: int, seed: int = 7, restarts: int = 5) -> dict[str, DataFrame]:
    """Partitions by Spark ML families, each with a column cluster."""
    v = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).persist()
    flat = PCA(k=2, inputCol="features", outputCol="flat").fit(v).transform(v)  # full covariances need few dimensions
    out = {"kmeans": best_of(v, k, range(seed, seed + restarts))}
    models = {"bisecting": BisectingKMeans(k=k, seed=seed), "mixture": GaussianMixture(k=k, seed=seed, maxIter=10, featuresCol="flat")}
    out |= {n: m.setPredictionCol("cluster").fit(flat).transform(flat) for n, m in models.items()}
    return {n: p.select(*df.columns, "cluster") for n, p in out.items()}


def leaderboard(scores: DataFrame) -> DataFrame:
    """(entrant, silhouette, ...) with place and champion: the largest silhouette first, undefined ones last and never champion; a row for each entrant."""
    place = F.rank().over(Window.orderBy(F.col("silhouette").desc_nulls_last()))
    return scores.withColumn("place", place).withColumn("champion", (F.col("place") == 1) & F.col("silhouette").isNotNull())


def knee(df: DataFrame, x: str, y: str) -> DataFrame:
    """The row of a curve farthest from the line between its ends, both axes scaled to 0..1. The curve is a short table."""
    w = Window.partitionBy(F.lit(1))
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))
    s = df.withColumns({"kx": scale(x), "ky": scale(y)})
    ends = s.agg(F.min_by("ky", x).alias("y0"), F.max_by("ky", x).alias("y1"))
    s = s.crossJoin(F.broadcast(ends)).withColumn("gap", F.round(F.abs(F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("kx") - F.col("ky")), 9))  # one row
    return s.orderBy(F.desc("gap"), x).limit(1).select(x, y, "gap")




def silhouettes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, n, silhouette): the mean silhouette of each group by squared distances; fewer than two groups give nulls, a group of one gives 0.

    The mean squared distance of a row to a group follows from the group's size, sum vector and sum
    of squares, so no two rows are paired. One entry for each group is sent to all tasks.
    """
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    cells = df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.sum("x").alias("t"))
    total = cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "t"))), lambda s: s["t"]).alias("t"))
    size = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(squares).alias("q"))
    groups = total.join(size, label).agg(F.collect_list(F.struct(F.col(label).alias("g"), "n", "q", "t")).alias("groups"))
    dot = lambda t: F.aggregate(F.zip_with(vector, t, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    far = F.transform("groups", lambda g: F.struct(g["g"].alias("g"), g["n"].alias("n"), F.greatest(F.lit(0.0), g["n"] * squares + g["q"] - 2 * dot(g["t"])).alias("d")))
    rows = df.crossJoin(F.broadcast(groups)).select(label, far.alias("far"))
    own = F.get(F.filter("far", lambda g: g["g"] == F.col(label)), 0)
    other = F.array_min(F.transform(F.filter("far", lambda g: g["g"] != F.col(label)), lambda g: g["d"] / g["n"]))
    rows = rows.select(label, own["n"].alias("n"), (own["d"] / F.nullif(own["n"] - 1, F.lit(0))).alias("a"), other.alias("b"))
    each = F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(each), 5).alias("silhouette"))


def positions(df: DataFrame, label: str, axes: list[str]) -> DataFrame:
    """(label, axis, mean, position): the mean of each group, and the share of all rows below it, rows equal to it counted half. One entry for each group and axis is sent to all tasks."""
    long = df.select(label, *[F.col(a).cast("double").alias(a) for a in axes]).unpivot([label], axes, "axis", "x").where("x IS NOT NULL")
    means = long.groupBy(label, "axis").agg(F.avg("x").alias("mean"))
    table = means.groupBy("axis").agg(F.collect_list(F.struct(F.col(label).alias("g"), "mean")).alias("means"))
    seen = long.groupBy("axis", "x").agg(F.count("*").alias("w")).join(F.broadcast(table), "axis")
    cell = seen.select("axis", "w", "x", F.inline("means"))
    half = F.when(F.col("x") < F.col("mean"), 1.0).when(F.col("x") == F.col("mean"), 0.5).otherwise(0.0)
    return cell.groupBy(F.col("g").alias(label), "axis").agg(F.first("mean").alias("mean"), (F.sum(half * F.col("w")) / F.sum("w")).alias("position"))


def radar(means: Column, largest: Column, floor: float = 0.05) -> Column:
    """A mean over the fixed largest value of its axis, from the floor to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(floor), means / largest))


def persona_fit(places: DataFrame, label: str, personas: DataFrame) -> DataFrame:
    """(label, persona, distance, contradicted, quality, weak) of each group with each persona.

    places: (label, axis, position); personas: (persona, axis, target, signature), a short table.
    The distance is the root mean square of the gaps. A signature axis claims high (target 0.65 or
    more; contradicted below 0.6), low (0.35 or less; above 0.4) or average (outside 0.35 to 0.65).
    """
    p, t = F.col("position"), F.col("target")
    against = F.when(t >= 0.65, p < 0.6).when(t <= 0.35, p > 0.4).otherwise((p < 0.35) | (p > 0.65))
    cell = places.join(F.broadcast(personas), "axis").groupBy(label, "persona")
    out = cell.agg(F.sqrt(F.avg((p - t) * (p - t))).alias("distance"), F.count_if(F.col("signature") & against).alias("contradicted"))
    return out.withColumns({"quality": 1 - F.col("distance"), "weak": 1 - F.col("distance") < 0.55})


def matched(fit: DataFrame, label: str) -> DataFrame:
    """(label, persona): one persona for each group, none twice, at the least total distance; a pair with a contradiction costs 1000 more. Equal totals: the first in alphabetical order.

    Every way to deal the personas is built a group at a time, by as many joins with the short cost
    table as there are groups. Meant for a handful of groups; more groups than personas give no rows.
    """
    cost = fit.select(label, "persona", (F.round("distance", 9) + F.when(F.col("contradicted") > 0, 1000.0).otherwise(0.0)).alias("cost"))
    spark, kinds = cost.sparkSession, cost.schema
    cost = spark.createDataFrame(cost.collect(), kinds)  # a row for each group and persona, as the joins below read it once for each group
    groups = [r[0] for r in cost.select(label).distinct().orderBy(label).collect()]  # a handful
    ways = spark.range(1).select(F.array().cast("array<string>").alias("got"), F.lit(0.0).alias("total"))
    for g in groups:
        ways = ways.join(F.broadcast(cost.where(F.col(label).eqNullSafe(F.lit(g)))), ~F.array_contains("got", F.col("persona"))).select(F.concat("got", F.array("persona")).alias("got"), (F.col("total") + F.col("cost")).alias("total"))
    best = ways.orderBy(F.round("total", 6), "got").limit(1)
    return best.select(F.explode(F.arrays_zip(F.array(*[F.lit(g) for g in groups]).alias(label), F.col("got").alias("persona"))).alias("x")).select("x.*")


def traits(places: DataFrame, label: str, most: int) -> DataFrame:
    """(label, place, axis, side): the axes on which a group stands outside 0.35 to 0.65, the farthest from the middle first."""
    far = places.where((F.col("position") < 0.35) | (F.col("position") > 0.65))
    order = Window.partitionBy(label).orderBy(F.desc(F.round(F.abs(F.col("position") - 0.5), 9)), "axis")
    return far.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(label, "place", "axis", F.when(F.col("position") > 0.5, "high").otherwise("low").alias("side"))


def projection(df: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """df with a column place (array of k), and (axis, variance, share): the principal axes of the centred vectors, fitted once.

    Spark's PCA doesn't centre what it transforms, so the mean's projection is taken off. Of each
    axis the sign is that with the largest component positive; share is of the whole variance.
    """
    v = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="features", outputCol="turned").fit(v)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    turned = model.transform(v).withColumn("turned", vector_to_array("turned"))
    center = turned.agg(*[F.avg(F.get("turned", F.lit(j))).alias(f"m{j}") for j in range(k)])  # one row
    out = turned.crossJoin(F.broadcast(center)).withColumn("place", F.array(*[F.lit(signs[j]) * (F.get("turned", F.lit(j)) - F.col(f"m{j}")) for j in range(k)]))
    spread = out.agg(*[F.var_samp(F.get("place", F.lit(j))).alias(f"v{j}") for j in range(k)])
    cells = F.array(*[F.struct(F.lit(j + 1).alias("axis"), F.col(f"v{j}").alias("variance"), F.lit(float(model.explainedVariance[j])).alias("share")) for j in range(k)])
    return out.drop("features", "turned", *[f"m{j}" for j in range(k)]), spread.select(F.inline(cells))
