"""Customers and vectors: derived attributes, scores, partitions and their validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import ratio
from ..operators import cluster as ops
from ..plans import views
from ..sources.tables import parquet
from .registry import query

RANK = lambda x: f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2) / count(*) OVER ()"
PREPARED = f"""WITH {views.CUSTOMERS_SQL}, cap AS (SELECT quantile_cont(income, 0.995) AS c FROM customers WHERE income IS NOT NULL AND purchases > 0),
b AS (SELECT customer_id, segment, income / 1000 AS income_k, purchases, campaigns, web_visits, total_spend, recency_days::double AS recency_days, greatest(0, least(1, deals / nullif(purchases, 0))) AS discount_sensitivity, (1 + (segment IN ('BUILDING', 'HOUSEHOLD'))::int + kids + teens)::bigint AS household_size FROM customers, cap WHERE income <= c AND purchases > 0),
r AS (SELECT *, round(purchases / (web_visits + 1.0::double), 12) AS a FROM b), q AS (SELECT *, round(0.5 * {RANK('a')} + 0.5 * {RANK('campaigns')}, 12) AS c FROM r), p AS (SELECT *, greatest(1.0, least(100.0, {RANK('c')} * 100)) AS spending_score FROM q)"""


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.customers(spark, sf_dir).where("income IS NOT NULL AND purchases > 0")
    cap = c.agg(F.percentile("income", F.lit(0.995)).alias("cap"))  # one row
    b = c.crossJoin(F.broadcast(cap)).where("income <= cap").withColumns({
        "income_k": F.col("income") / 1000, "recency_days": F.col("recency_days").cast("double"), "discount_sensitivity": F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(F.col("deals"), F.col("purchases")))),
        "household_size": 1 + F.col("segment").isin("BUILDING", "HOUSEHOLD").cast("int") + F.col("kids") + F.col("teens"),
    })
    return ops.spending_score(b, F.col("purchases") / (F.col("web_visits") + 1.0), F.col("campaigns"))


@query(f"{PREPARED} SELECT customer_id, round(income_k, 6) AS income_k, recency_days, round(discount_sensitivity, 6) AS discount_sensitivity, household_size, round(spending_score, 6) AS spending_score FROM p")
def customers_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("customer_id", F.round("income_k", 6).alias("income_k"), "recency_days", F.round("discount_sensitivity", 6).alias("discount_sensitivity"), "household_size", F.round("spending_score", 6).alias("spending_score"))


INTER = f"{PREPARED}, i AS (SELECT *, income_k / (spending_score + 1) AS discretionary_ratio, total_spend / (recency_days + 1) AS monetary_velocity, web_visits * (spending_score / 100) AS digital_engagement, discount_sensitivity * (1 - spending_score / 100) AS deal_affinity FROM p)"
FOUR = ("discretionary_ratio", "monetary_velocity", "digital_engagement", "deal_affinity")


@query(f"{INTER} SELECT customer_id, {', '.join(f'round({c}, 7) AS {c}' for c in FOUR)} FROM i")
def customers_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.interactions(prepared(spark, sf_dir)).select("customer_id", *[F.round(c, 7).alias(c) for c in FOUR])


@query(f"{INTER}, m AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in FOUR)} FROM i) SELECT customer_id, {', '.join(f'round(CASE WHEN {c}_s > 0 THEN ({c} - {c}_m) / {c}_s ELSE 0 END, 5) AS {c}' for c in FOUR)} FROM i, m")
def customers_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = ops.scaled(ops.interactions(prepared(spark, sf_dir)).select("customer_id", *FOUR), list(FOUR))
    return z.select("customer_id", *[F.round(c, 5).alias(c) for c in FOUR])


@query(f"{PREPARED}, k AS (SELECT {RANK('total_spend')} AS a, {RANK('spending_score')} AS b FROM p) SELECT round(corr(a, b), 6) AS spearman FROM k")
def customers_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return ops.percentile_rank(ops.percentile_rank(p, "total_spend", "a"), "spending_score", "b").agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@query(f"{PREPARED} SELECT segment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(income_k), 6) AS income_k, round(avg(total_spend), 3) AS total_spend, round(avg(spending_score), 5) AS spending_score FROM p GROUP BY segment")
def customers_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    g = prepared(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg("income_k"), 6).alias("income_k"), F.round(F.avg("total_spend"), 3).alias("total_spend"), F.round(F.avg("spending_score"), 5).alias("spending_score"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


AXES = ("income_k", "spending_score", "total_spend", "web_visits", "discount_sensitivity", "recency_days", "household_size")
LARGEST = {"income_k": 10.0, "spending_score": 100.0, "total_spend": 5000000.0, "web_visits": 12.0, "recency_days": 2500.0}
# Personas as targets on the axes, 0.5 the median of all customers; a star marks what the persona is named for.
PERSONAS = {
    "big spenders": {"total_spend": (0.9, True), "spending_score": (0.8, True), "income_k": (0.6, False)},
    "bargain hunters": {"discount_sensitivity": (0.85, True), "total_spend": (0.4, False)},
    "lapsing": {"recency_days": (0.85, True), "spending_score": (0.3, False)},
    "middle ground": {"income_k": (0.5, True), "total_spend": (0.5, True), "household_size": (0.5, False)},
    "online families": {"web_visits": (0.8, True), "household_size": (0.8, True)},
}
PLACES = f"""{PREPARED}, u AS (UNPIVOT (SELECT segment, {', '.join(f'{a}::double AS {a}' for a in AXES)} FROM p) ON {', '.join(AXES)} INTO NAME axis VALUE x), m AS (SELECT segment, axis, avg(x) AS mean FROM u GROUP BY ALL),
pos AS (SELECT m.segment, m.axis, any_value(mean) AS mean, avg(CASE WHEN u.x < mean THEN 1.0 WHEN u.x = mean THEN 0.5 ELSE 0 END) AS position FROM m JOIN u ON u.axis = m.axis GROUP BY ALL)"""
TARGETS = ", ".join(f"('{n}', '{a}', {t}, {s})" for n, p in PERSONAS.items() for a, (t, s) in p.items())


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.positions(prepared(spark, sf_dir).select("segment", *AXES), "segment", list(AXES))


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, a, t, s) for n, p in PERSONAS.items() for a, (t, s) in p.items()], "persona string, axis string, target double, signature boolean")


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.persona_fit(places(spark, sf_dir), "segment", personas(spark))


@query(f"{PLACES} SELECT segment, axis, round(position, 6) AS position FROM pos")
def customers_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the mean of each segment stands among all customers, by axis."""
    return places(spark, sf_dir).select("segment", "axis", F.round("position", 6).alias("position"))


FIT = f"{PLACES}, t(persona, axis, target, signature) AS (VALUES {TARGETS}), f AS (SELECT segment, persona, sqrt(avg((position - target) ^ 2)) AS distance, count(*) FILTER (WHERE signature AND CASE WHEN target >= 0.65 THEN position < 0.6 WHEN target <= 0.35 THEN position > 0.4 ELSE position < 0.35 OR position > 0.65 END) AS contradicted FROM pos JOIN t USING (axis) GROUP BY ALL)"


@query(f"{FIT} SELECT segment, persona, round(distance, 6) AS distance, contradicted, 1 - distance < 0.55 AS weak FROM f")
def customers_persona_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits(spark, sf_dir).select("segment", "persona", F.round("distance", 6).alias("distance"), "contradicted", "weak")


@query(f"""{FIT}, c AS (SELECT segment, persona, round(distance, 9) + 1000 * (contradicted > 0)::int AS cost FROM f), g AS (SELECT a.segment AS s1, b.segment AS s2, c.segment AS s3, d.segment AS s4, e.segment AS s5, [a.persona, b.persona, c.persona, d.persona, e.persona] AS got, a.cost + b.cost + c.cost + d.cost + e.cost AS cost
FROM c a JOIN c b ON b.segment > a.segment AND b.persona <> a.persona JOIN c ON c.segment > b.segment AND c.persona NOT IN (a.persona, b.persona) JOIN c d ON d.segment > c.segment AND d.persona NOT IN (a.persona, b.persona, c.persona) JOIN c e ON e.segment > d.segment AND e.persona NOT IN (a.persona, b.persona, c.persona, d.persona)),
o AS (SELECT * FROM g ORDER BY round(cost, 6), got LIMIT 1), z AS (SELECT unnest([s1, s2, s3, s4, s5]) AS segment, unnest(got) AS persona FROM o) SELECT z.segment, z.persona, round(1 - distance, 6) AS quality, contradicted FROM z JOIN f ON f.segment = z.segment AND f.persona = z.persona""")
def customers_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One persona for each segment, none twice, at the least total distance."""
    f = fits(spark, sf_dir)
    return ops.matched(f, "segment").join(f, ["segment", "persona"]).select("segment", "persona", F.round("quality", 6).alias("quality"), "contradicted")


@query(f"""{PLACES}, far AS (SELECT segment, axis, position, row_number() OVER (PARTITION BY segment ORDER BY round(abs(position - 0.5), 9) DESC, axis) AS k FROM pos WHERE position < 0.35 OR position > 0.65)
SELECT segment, k::int AS place, axis, CASE WHEN position > 0.5 THEN 'high' ELSE 'low' END AS side FROM far WHERE k <= 3""")
def customers_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three axes on which a segment stands outside the average band, the most extreme first."""
    return ops.traits(places(spark, sf_dir), "segment", 3)


@query(f"{PLACES} SELECT segment, axis, round(least(1.0, greatest(0.05, mean / CASE axis {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {v}' for a, v in LARGEST.items())} END)), 6) AS value FROM pos WHERE axis IN ({', '.join(repr(a) for a in LARGEST)})")
def customers_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    largest = F.create_map(*[F.lit(x) for pair in LARGEST.items() for x in pair])[F.col("axis")]
    return places(spark, sf_dir).where(F.col("axis").isin(*LARGEST)).select("segment", "axis", F.round(ops.radar(F.col("mean"), largest), 6).alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]).withColumn("v", F.col("embedding").cast("array<double>")).drop("embedding")


CELLS = """e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e), c AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY ALL),
d AS (SELECT x.vec_id, x.label AS own, c.label AS label, sqrt(sum((x.x - c.m) ^ 2)) AS d FROM x JOIN c USING (dim) GROUP BY ALL)"""


@query(f"WITH {CELLS}, r AS (SELECT vec_id, arg_min(label, (round(d, 9), label)) AS label, min(round(d, 9)) AS d, sum(1 / (round(d, 9) + 1e-5)) AS t FROM d GROUP BY vec_id) SELECT vec_id, label, round(d, 6) AS distance, round((1 / (d + 1e-5)) / t, 6) AS share FROM r")
def vectors_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ops.nearest(v, ops.centroids(v, "label", "v"), "vec_id", "v", "label")


@query(f"""WITH {CELLS}, s AS (SELECT label, count(*) AS size, avg(d) AS spread, sum(d ^ 2) AS within FROM d WHERE own = label GROUP BY label), g AS (SELECT dim, avg(x) AS m FROM x GROUP BY dim), b AS (SELECT label, sum((c.m - g.m) ^ 2) AS b FROM c JOIN g USING (dim) GROUP BY label),
p AS (SELECT a.label AS l, b.label AS k, sqrt(sum((a.m - b.m) ^ 2)) AS gap FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL), w AS (SELECT l, max((x.spread + y.spread) / gap) AS r FROM p JOIN s x ON x.label = l JOIN s y ON y.label = k GROUP BY l), t AS (SELECT count(*) AS k, sum(size)::bigint AS n, sum(within) AS within, sum(size * b) AS between FROM s JOIN b USING (label))
SELECT k, n, round((SELECT avg(r) FROM w), 5) AS davies_bouldin, round((between / (k - 1)) / (within / (n - k)), 5) AS calinski_harabasz FROM t""")
def vectors_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.validity(vectors(spark, sf_dir), "label", "v")


@query("""WITH e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS g, sum(list_distance(a.v, b.v) ^ 2) AS d, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, label, max(d / n) FILTER (WHERE g = label) AS a, min(d / n) FILTER (WHERE g <> label) AS b FROM d GROUP BY ALL) SELECT label, count(*) AS n, round(avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s GROUP BY label""")
def vectors_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette of each label by squared distances."""
    return ops.silhouettes(vectors(spark, sf_dir), "label", "v")


@query("WITH p AS (SELECT label AS a, (vec_id % 4)::int AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS shared FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM p GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*) AS n FROM p GROUP BY b)) SELECT n::bigint AS rows, round((n * (n - 1) / 2 - x.s - y.s + 2 * shared) / (n * (n - 1) / 2), 6) AS agreement FROM t, x, y")
def vectors_co_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.co_assignment(vectors(spark, sf_dir).select(F.col("label").alias("a"), (F.col("vec_id") % 4).cast("int").alias("b")), "a", "b")


@query("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () >= 0.01 AS enough FROM embeddings GROUP BY label")
def vectors_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shares(vectors(spark, sf_dir), "label")


@query()
def vectors_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five families on one table, by plain silhouette; noise takes no part in an entrant's scores, and one with fewer than two clusters has none."""
    from functools import reduce

    from ..operators import density
    from ..sources.stored import cut

    v = parquet(spark, sf_dir, "embeddings", ["vec_id", "label", "embedding"]).withColumnRenamed("embedding", "v")
    close = cut(density.nearest(v, "vec_id", "v", 16))  # for the curve, the cores and the graph
    near = cut(density.k_distances(v, "vec_id", "v", 16, close))
    eps = float(density.radius(near).first()["eps"])  # one number
    named = lambda found: found.select(F.col("key").alias("vec_id"), "cluster")
    every = ops.entrants(v, "v", 5) | {"density": named(density.density(v, "vec_id", "v", eps, 16, near)), "graph": named(density.graph_clusters(v, "vec_id", "v", 5, near=close))}
    found = reduce(DataFrame.unionByName, [p.select("vec_id", F.col("cluster").cast("long").alias("cluster"), F.lit(n).alias("entrant")) for n, p in every.items()])
    wide = found.groupBy("vec_id").agg(*[F.max(F.when(F.col("entrant") == n, F.col("cluster"))).alias(n) for n in every])
    wide = cut(v.join(wide, "vec_id"))  # read by every score
    whole = density.silhouettes_of(wide, "vec_id", "v", list(every), -1).where("label IS NULL").select(F.col("of").alias("entrant"), "silhouette")
    rows = []
    for name in every:
        p = wide.select("v", F.col(name).alias("cluster"))
        noise = p.agg(F.round(F.avg((F.col("cluster") == -1).cast("int")), 6).alias("noise_ratio"))
        rows.append(ops.validity(p.where("cluster <> -1"), "cluster", "v").crossJoin(noise).withColumn("entrant", F.lit(name)))  # one row each
    return ops.leaderboard(reduce(DataFrame.unionByName, rows).join(F.broadcast(whole), "entrant", "left").select("k", "n", "davies_bouldin", "calinski_harabasz", "silhouette", "noise_ratio", "entrant"))  # whole: a row for each entrant


@query()
def vectors_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knee of the within-cluster squares for k from 2 to 9."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, sf_dir).select(array_to_vector("v").alias("features")).persist()
    curve = [(k, float(KMeans(k=k, seed=7, maxIter=10).fit(v).summary.trainingCost)) for k in range(2, 10)]
    return ops.knee(spark.createDataFrame(curve, "k int, wcss double"), "k", "wcss")


@query()
def vectors_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors on their first two principal axes."""
    at, _ = ops.projection(vectors(spark, sf_dir), "v")
    return at.select("vec_id", "label", *[F.round(F.get("place", F.lit(j)), 6).alias(n) for j, n in enumerate("xy")])


@query()
def vectors_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variance along the first two principal axes, and their shares of all variance."""
    return ops.projection(vectors(spark, sf_dir), "v")[1].select("axis", F.round("variance", 9).alias("variance"), F.round("share", 9).alias("share"))
