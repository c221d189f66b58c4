"""Neighbour distances, density clusters and the graph's clusters of the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density as ops
from ..sources.stored import cut
from ..sources.tables import parquet
from .registry import query

M = 16  # rows within the radius that make a core, the row itself counted
PAIRS = "e AS (SELECT vec_id AS key, embedding::double[] AS v, label FROM embeddings), d AS (SELECT a.key, b.key AS other, a.label AS own, b.label AS theirs, round(list_distance(a.v, b.v), 9) AS distance FROM e a, e b)"
CURVE = f"{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, other <> key, other) AS place FROM d), k AS (SELECT key, max(distance) AS distance FROM r WHERE place <= {M} GROUP BY key), c AS (SELECT *, row_number() OVER (ORDER BY distance, key) AS place, count(*) OVER () AS rows FROM k)"
EPS = f"{CURVE}, z AS (SELECT min(place) AS x0, max(place) AS x1, arg_min(distance, place) AS y0, arg_max(distance, place) AS y1 FROM c), o AS (SELECT distance AS eps FROM c, z ORDER BY round(abs((y1 - y0) * place - (x1 - x0) * distance + x1 * y0 - y1 * x0), 9) DESC, place LIMIT 1)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.k_distances(vectors(spark, sf_dir), "vec_id", "embedding", M)


@query(f"WITH {CURVE} SELECT place, distance FROM c WHERE (place - 1) % greatest(1, rows // 300) = 0")
def vectors_k_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted distances to the 16th nearest vector, about 300 points of the curve."""
    return ops.thinned(curve(spark, sf_dir), 300).select("place", "distance")


@query(f"WITH {EPS} SELECT eps FROM o")
def vectors_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.radius(curve(spark, sf_dir))


@query(f"""WITH RECURSIVE {EPS}, near AS (SELECT key, count(*) FILTER (WHERE distance <= eps) AS n FROM d, o GROUP BY key), core AS (SELECT key FROM near WHERE n >= {M}),
g AS (SELECT d.key, d.other FROM d, o WHERE distance <= eps AND d.key IN (FROM core) AND d.other IN (FROM core)), t AS (SELECT key, key AS root FROM core UNION SELECT g.other, t.root FROM t JOIN g ON g.key = t.key), m AS (SELECT key, min(root) AS cluster FROM t GROUP BY key),
b AS (SELECT d.key, arg_min(d.other, (distance, d.other)) AS core FROM d, o WHERE distance <= eps AND d.other IN (FROM core) AND d.key NOT IN (FROM core) GROUP BY d.key)
SELECT e.key AS vec_id, coalesce(m.cluster, mb.cluster, -1) AS cluster, m.key IS NOT NULL AS core FROM e LEFT JOIN m USING (key) LEFT JOIN b USING (key) LEFT JOIN m mb ON mb.key = b.core""")
def vectors_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters with noise, the radius from the knee of the k-distance curve."""
    near = cut(curve(spark, sf_dir))
    eps = float(ops.radius(near).first()["eps"])  # one number, which the next step is told
    return ops.density(vectors(spark, sf_dir), "vec_id", "embedding", eps, M, near).withColumnRenamed("key", "vec_id")


@query(f"""WITH {PAIRS}, g AS (SELECT theirs, key, own, sum(distance) AS t, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT key, own, max(t / nullif(n - 1, 0)) FILTER (WHERE own = theirs) AS a, max(n) FILTER (WHERE own = theirs) AS n, min(t / n) FILTER (WHERE own <> theirs) AS b FROM g GROUP BY ALL),
w AS (SELECT own AS label, CASE WHEN b IS NULL THEN NULL WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM s) SELECT label::bigint AS label, count(*) AS n, round(avg(s), 6) AS silhouette FROM w GROUP BY label UNION ALL SELECT NULL, count(*), round(avg(s), 6) FROM w""")
def vectors_plain_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette of each label, and of all vectors, by plain distances."""
    return ops.silhouettes(vectors(spark, sf_dir), "vec_id", "embedding", "label")
