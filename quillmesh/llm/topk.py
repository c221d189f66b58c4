"""Exact top-k by inner product: a three-phase uniform threshold over lists of local scores.

The columns of the vectors are cut into LISTS blocks; the inner product of a query and a candidate
is the sum of their local scores, one from each list. A list is spread over tasks, each with a
block of at most ROWS candidates and QUERIES queries.

1. Gather: each list gives the GATHER best local scores of every query. The candidates named there
   are scored exactly, and the (k + 1)-th best score is the query's cutoff, which the true answer
   can't be below.
2. The cutoff goes back to all tasks, as a column of the queries. A candidate that scores below
   cutoff / LISTS in every list is below the cutoff in total, so each list sends the entries at or
   above that uniform threshold; an entry is left out if its local score and the most that the
   other columns can add (the product of their lengths) stay below the cutoff.
3. Candidates that were sent by any list, and whose known local scores with the threshold for the
   unknown ones reach the cutoff, are resolved exactly from the whole vectors.

Scores are inner products of the integers floor(scale * x). Local scores are doubles and only
decide what is resolved, with SLACK for their rounding; the answer's scores are integers, exact
where they fit in a long, else the nearest long.

Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take
no part. Vectors of different length are never compared; each length is searched by itself. Equal
vectors are one class that is scored once, and of which only the smallest ids can be in an answer.
A repeated row counts once; an id with several vectors asks with each and is ranked by its best
score. Equal scores go to the smaller id; fewer candidates than k are all given; no rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

LISTS, GATHER = 2, 16
ROWS, QUERIES = 4096, 1024
SLACK = 1e-9
MOST = 2**63 - 1


def integers(rows: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the distinct rows that take part, components as floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    return good.select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v")).distinct()


def product(a: str, b: str) -> Column:
    """The inner product of two arrays of longs: exact if it can't leave the long range, else by decimals, the nearest long."""
    large = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    plain = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, z: s + z)
    wide = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)")), F.lit(0).cast("decimal(38,0)"), lambda s, z: (s + z).cast("decimal(38,0)"))
    clipped = F.greatest(F.lit(-MOST - 1).cast("decimal(38,0)"), F.least(F.lit(MOST).cast("decimal(38,0)"), wide)).cast("long")
    return F.when((large(F.col(a)) < 2.0**62) & (large(F.col(b)) < 2.0**62), plain).otherwise(clipped)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def cuts(dims: int, lists: int) -> list[slice]:
    edge = [round(i * dims / lists) for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edge, edge[1:], strict=False) if b > a]


def dealt(classes: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with (n, rb, qb): each block of candidates once for every block of queries of the same length, and the other way round."""
    blocks = lambda df, size, name: df.groupBy("n").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(classes, ROWS, "rs").join(blocks(queries, QUERIES, "qs"), "n"))  # a row for each length of vector
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = classes.join(sizes, "n").withColumn("rb", F.pmod(F.xxhash64("c"), "rs").cast("int")).withColumn("qb", every("qs")).drop("rs", "qs")
    right = queries.join(sizes, "n").withColumn("qb", F.pmod(F.xxhash64("q"), "qs").cast("int")).withColumn("rb", every("rs")).drop("rs", "qs")
    return left, right


def gather(v: pd.DataFrame, q: pd.DataFrame, lists: int) -> pd.DataFrame:
    """The best local scores of each query and list, among the candidates of one block."""
    out = []
    if len(v) and len(q):
        x, y, ids = matrix(v["v"]), matrix(q["v"]), v["c"].to_numpy()
        for j, cut in enumerate(cuts(x.shape[1], lists)):
            local, keep = y[:, cut] @ x[:, cut].T, min(GATHER, len(x))
            top = np.argpartition(-local, keep - 1, axis=1)[:, :keep]
            out.append(pd.DataFrame({"q": np.repeat(q["q"].to_numpy(), keep), "list": j, "c": ids[top].ravel(), "local": np.take_along_axis(local, top, 1).ravel()}))
    return pd.concat(out) if out else pd.DataFrame({"q": [], "list": [], "c": [], "local": []})


def collect(v: pd.DataFrame, q: pd.DataFrame, lists: int) -> pd.DataFrame:
    """The entries of each list at or above the uniform threshold, among the candidates of one block."""
    out = []
    if len(v) and len(q):
        x, y, ids, asked = matrix(v["v"]), matrix(q["v"]), v["c"].to_numpy(), q["q"].to_numpy()
        cut_at = q["cutoff"].astype(float).fillna(-np.inf).to_numpy()  # none if fewer than k + 1 were gathered
        length = lambda m: np.sqrt((m * m).sum(1))
        lx, ly, parts = length(x), length(y), cuts(x.shape[1], lists)
        for j, cut in enumerate(parts):
            rest_x, rest_y = (np.sqrt(np.maximum(a * a - length(m[:, cut]) ** 2, 0)) for a, m in ((lx, x), (ly, y)))
            local = y[:, cut] @ x[:, cut].T
            slack = SLACK * (1 + ly[:, None] * lx[None, :])
            sent = (local + slack >= cut_at[:, None] / len(parts)) & (local + rest_y[:, None] * rest_x[None, :] + slack >= cut_at[:, None])
            i, k = np.nonzero(sent)
            out.append(pd.DataFrame({"q": asked[i], "list": j, "c": ids[k], "local": local[i, k]}))
    return pd.concat(out) if out else pd.DataFrame({"q": [], "list": [], "c": [], "local": []})


def search(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS) -> DataFrame:
    """(query_id, rank, id, score): for each row that is_query (a condition on the column id) the k other ids with the largest inner products."""
    every = written(integers(rows, scale, id_col, vector_col), "integers")
    few = every.withColumn("m", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("m") <= k + 1)  # cut on the map side first
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    classes = written(classes.select(F.monotonically_increasing_id().alias("c"), F.size("v").alias("n"), "v", "ids"), "classes")
    asked = every.where(is_query).join(classes.select("v", "c"), "v").select(F.col("id").alias("query_id"), F.col("c").alias("q"))
    asked = written(asked, "asked")
    queries = classes.join(asked.select(F.col("q").alias("c")).distinct(), "c").select(F.col("c").alias("q"), "n", "v")
    queries = written(queries, "queries")
    key, entry = ["n", "rb", "qb"], "q long, list int, c long, local double"

    def scored(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(queries.select("q", F.col("v").alias("a")), "q").join(classes.select("c", "ids", F.col("v").alias("b")), "c")
        return ends.select("q", "c", "ids", product("a", "b").alias("score"))

    # 1: the best of each list, scored exactly, give a cutoff
    left, right = dealt(classes.select("c", "n", "v"), queries)
    first = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda v, q: gather(v, q, lists), entry)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("local"), "c"))).where(F.col("r") <= GATHER)
    known = scored(best.select("q", "c").distinct())
    near = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    cutoff = known.withColumn("r", F.row_number().over(near)).where(F.col("r") == k + 1).select("q", F.col("score").alias("cutoff"))
    queries = written(queries.join(cutoff, "q", "left"), "cutoffs")

    # 2: every list sends what reaches its share of the cutoff
    left, right = dealt(classes.select("c", "n", "v"), queries)
    entries = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda v, q: collect(v, q, lists), entry)

    # 3: what can still reach the cutoff is resolved from the whole vectors
    met = entries.groupBy("q", "c").agg(F.sum("local").alias("known"), F.count("*").alias("sent"))
    parts = F.least(F.col("n"), F.lit(lists))
    bound = F.col("known") + (parts - F.col("sent")) * F.col("cutoff") / parts
    reaches = F.col("cutoff").isNull() | (bound + SLACK * F.abs(bound) + 1e-3 >= F.col("cutoff"))
    may = met.join(queries.select("q", "n", "cutoff"), "q").where(reaches)
    final = scored(may.select("q", "c")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.get("ids", 0)))).where(F.col("r") <= k + 1)
    each = asked.join(final.select("q", F.explode("ids").alias("id"), "score"), "q").where("id <> query_id")
    each = each.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    out = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if isfinite(x)]) = len(embedding)),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum([p[1] * p[2] for p in list_zip(a.e, b.e)])::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
