"""Categorical association, ranking metrics, splits and supervised models on the tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cleaning, scoring
from ..operators import trips as trip_ops
from ..sources.stored import cut
from ..sources.tables import parquet
from . import trips
from .registry import query

FEATURES = ("l_linestatus", "size_band", "o_orderpriority", "o_orderstatus", "brand")
CAT = "WITH cat AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus, CASE WHEN l_quantity < 17 THEN 'small' WHEN l_quantity < 34 THEN 'middle' ELSE 'large' END AS size_band, o_orderpriority, o_orderstatus, p_brand AS brand, (l_returnflag = 'R')::int AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = parquet(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_quantity", "l_returnflag"])  # noqa: E741
    o = parquet(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    p = parquet(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    band = F.when(F.col("l_quantity") < 17, "small").when(F.col("l_quantity") < 34, "middle").otherwise("large")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(p, l["l_partkey"] == p["p_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", band.alias("size_band"), "o_orderpriority", "o_orderstatus", F.col("p_brand").alias("brand"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def contingency(df: DataFrame, features: tuple[str, ...], label: str) -> DataFrame:
    """(feature, value, label, n) of all features, one aggregation."""
    return df.unpivot([label], list(features), "feature", "value").groupBy("feature", "value", label).agg(F.count("*").alias("n"))


LONG = f"{CAT}, k AS ({' UNION ALL '.join(f'SELECT $${c}$$ AS feature, {c} AS value, label, count(*) AS n FROM cat GROUP BY ALL' for c in FEATURES)})"


@query(f"{LONG} SELECT feature, value, label, n FROM k")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contingency(categories(spark, sf_dir), FEATURES, "label")


@query(f"""{LONG}, v AS (SELECT feature, value, sum(n) AS r FROM k GROUP BY ALL), c AS (SELECT feature, label, sum(n) AS c FROM k GROUP BY ALL), t AS (SELECT feature, sum(n) AS t FROM k GROUP BY 1), e AS (SELECT v.feature, coalesce(n, 0) AS n, r * c / t AS e, t FROM v JOIN c USING (feature) JOIN t USING (feature) LEFT JOIN k ON k.feature = v.feature AND k.value = v.value AND k.label = c.label),
x AS (SELECT feature, sum((n - e) ^ 2 / e) AS chi2, any_value(t) AS t FROM e GROUP BY 1), d AS (SELECT feature, count(DISTINCT value) AS a, count(DISTINCT label) AS b FROM k GROUP BY 1) SELECT feature, round(chi2, 5) AS chi2, ((a - 1) * (b - 1))::bigint AS dof, round(sqrt(chi2 / (t * (least(a, b) - 1))), 6) AS cramers_v FROM x JOIN d USING (feature)""")
def category_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square without correction, degrees of freedom, Cramer's V."""
    k = contingency(categories(spark, sf_dir), FEATURES, "label").persist()
    total = lambda by, name: k.groupBy(*by).agg(F.sum("n").alias(name))
    cell = total(["feature", "value"], "r").join(total(["feature", "label"], "c"), "feature").join(total(["feature"], "t"), "feature").join(k, ["feature", "value", "label"], "left").na.fill(0, ["n"])
    e = F.col("r") * F.col("c") / F.col("t")
    x = cell.groupBy("feature").agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("chi2"), F.first("t").alias("t"), F.count_distinct("value").alias("a"), F.count_distinct("label").alias("b"))
    return x.select("feature", F.round("chi2", 5).alias("chi2"), ((F.col("a") - 1) * (F.col("b") - 1)).alias("dof"), F.round(F.sqrt(F.col("chi2") / (F.col("t") * (F.least("a", "b") - 1))), 6).alias("cramers_v"))


@query(f"""{LONG}, t AS (SELECT label, count(*) AS n FROM cat GROUP BY 1), m AS (SELECT feature, count(DISTINCT value) AS m FROM k GROUP BY 1), g AS (SELECT feature, value, t.label, t.n AS total FROM (SELECT DISTINCT feature, value FROM k) CROSS JOIN t), p AS (SELECT g.feature, g.value, g.label, ln((coalesce(k.n, 0) + 1) / (total + m)) AS lp FROM g JOIN m USING (feature) LEFT JOIN k ON k.feature = g.feature AND k.value = g.value AND k.label = g.label),
s AS (SELECT DISTINCT {', '.join(FEATURES)} FROM cat), f AS (SELECT s.*, t.label, ln(t.n / (SELECT sum(n) FROM t)) AS prior FROM s CROSS JOIN t), q AS (SELECT f.*, prior + {' + '.join(f'p{i}.lp' for i in range(5))} AS lp FROM f {' '.join(f"JOIN p p{i} ON p{i}.feature = '{c}' AND p{i}.value = f.{c} AND p{i}.label = f.label" for i, c in enumerate(FEATURES))}) SELECT {', '.join(FEATURES)}, arg_max(label, round(lp, 9)) AS predicted, round(max(lp), 6) AS log_score FROM q GROUP BY {', '.join(FEATURES)}""")
def category_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical naive Bayes with Laplace smoothing; every distinct profile scored by joins on its values."""
    df = categories(spark, sf_dir).groupBy(*FEATURES, "label").agg(F.count("*").alias("n")).persist()  # a row for each profile and class
    k = df.unpivot(["label", "n"], list(FEATURES), "feature", "value").groupBy("feature", "value", "label").agg(F.sum("n").alias("n")).persist()
    t = df.groupBy("label").agg(F.sum("n").alias("total")).withColumn("prior", F.log(F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1)))))
    m = k.groupBy("feature").agg(F.count_distinct("value").alias("m"))
    grid = k.select("feature", "value").distinct().join(m, "feature").crossJoin(F.broadcast(t))  # one row for each class
    p = grid.join(k, ["feature", "value", "label"], "left").select("feature", "value", "label", "prior", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("m"))).alias("lp"))
    profiles = df.select(*FEATURES).distinct()
    scored = profiles.withColumn("profile", F.struct(*FEATURES)).unpivot(["profile"], list(FEATURES), "feature", "value").join(p, ["feature", "value"])
    by = scored.groupBy("profile", "label").agg((F.sum("lp") + F.first("prior")).alias("lp"))
    best = by.groupBy("profile").agg(F.max_by("label", F.round("lp", 9)).alias("predicted"), F.round(F.max("lp"), 6).alias("log_score"))
    return best.select("profile.*", "predicted", "log_score")


@query(f"{CAT} SELECT label, count(*) AS n, round((SELECT count(*) FROM cat) / (2.0 * count(*)), 6) AS weight, count(*) = max(count(*)) OVER () AS majority FROM cat GROUP BY label")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = categories(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    return n.select("label", "n", F.round(F.sum("n").over(w) / (2.0 * F.col("n")), 6).alias("weight"), (F.col("n") == F.max("n").over(w)).alias("majority"))


RANKED = "WITH s AS (SELECT doc_id, toxic AS label, round(1 / (1 + exp(-(n_chars % 997 - 400) / 150.0::double)), 3) AS score FROM labels JOIN documents USING (doc_id))"
CUTS = f"{RANKED}, g AS (SELECT score, sum(label) AS hit, count(*) AS n FROM s GROUP BY 1), c AS (SELECT score, (sum(hit) OVER w)::bigint AS tp, (sum(n - hit) OVER w)::bigint AS fp, sum(hit) OVER () AS p, sum(n - hit) OVER () AS q FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), m AS (SELECT score, tp, fp, tp / (tp + fp) AS precision, tp / p AS recall, fp / q AS fpr, 2 * tp / (tp + fp + p) AS f1 FROM c)"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parquet(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    score = F.round(1 / (1 + F.exp(-(F.col("n_chars") % 997 - 400) / 150.0)), 3)
    return parquet(spark, sf_dir, "labels", ["doc_id", "toxic"]).join(d, "doc_id").select("doc_id", F.col("toxic").alias("label"), score.alias("score"))


@query(f"{CUTS} SELECT score, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1 FROM m")
def ranking_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cutoffs(ranked(spark, sf_dir), "score", "label").select("score", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr", "f1")])


@query(f"{CUTS}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC) - 1 AS place, count(*) OVER () AS n FROM m) SELECT score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM k WHERE n <= 50 OR place IN (SELECT floor(i * (n - 1) / 49::double + 0.5)::bigint FROM range(50) g(i), (SELECT max(n) AS n FROM k))")
def ranking_curve_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 points of the curve, evenly spaced by place, its ends among them."""
    curve = scoring.cutoffs(ranked(spark, sf_dir), "score", "label").select("score", "precision", "recall")
    return scoring.thinned(curve, F.struct(-F.col("score")), 50).select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""SELECT count(*) AS rows, round(avg((l_returnflag = 'R')::int), 6) AS positive_rate, round(avg((l_quantity IS NULL)::int), 6) AS quantity_missing, round(median(l_quantity), 6) AS quantity_median, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem""")
def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = parquet(spark, sf_dir, "lineitem", ["l_quantity", "l_extendedprice", "l_returnflag"])  # noqa: E741
    rows = l.select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return cleaning.profile_facts(rows, "label", ["quantity"], ("quantity", "price"))


@query(f"{CUTS}, l AS (SELECT *, lag(recall, 1, 0) OVER (ORDER BY score DESC) AS r0, lag(fpr, 1, 0) OVER (ORDER BY score DESC) AS f0 FROM m) SELECT round(sum((fpr - f0) * (recall + r0) / 2), 6) AS auc, round(sum((recall - r0) * precision), 6) AS average_precision FROM l")
def ranking_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ranked(spark, sf_dir)
    return scoring.roc_auc(s, "score", "label").crossJoin(scoring.average_precision(s, "score", "label"))


@query(f"{CUTS} SELECT score, round(f1, 6) AS f1 FROM m ORDER BY round(m.f1, 9) DESC, m.score DESC LIMIT 1")
def ranking_best_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cutoffs(ranked(spark, sf_dir), "score", "label").orderBy(F.desc(F.round("f1", 9)), F.desc("score")).limit(1).select("score", F.round("f1", 6).alias("f1"))


@query(f"{RANKED}, t AS (SELECT unnest([0.3, 0.5, 0.7])::double AS cutoff), c AS (SELECT cutoff, count(*) FILTER (WHERE label = 0 AND score < cutoff) AS tn, count(*) FILTER (WHERE label = 0 AND score >= cutoff) AS fp, count(*) FILTER (WHERE label = 1 AND score < cutoff) AS fn, count(*) FILTER (WHERE label = 1 AND score >= cutoff) AS tp FROM s, t GROUP BY cutoff) SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def ranking_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ranked(spark, sf_dir).withColumn("cutoff", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    return scoring.rates(s.groupBy("cutoff").agg(*scoring.confusion(F.col("label"), F.col("score") >= F.col("cutoff"))))


RATES = [0.0001 * 500 ** (i / 59) for i in range(60)]


@query(f"{RANKED}, q AS (SELECT quantile_cont(score, [{', '.join(repr(1 - r) for r in RATES)}]) AS q FROM s), c AS (SELECT unnest(range(60))::int AS i, round(unnest(q), 9) AS cut FROM q) SELECT i, round(cut, 6) AS cut, round(avg((score >= cut)::int), 6) AS flagged FROM s, c GROUP BY i, cut")
def ranking_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score cutoffs for 60 log-spaced review rates, and the share each flags."""
    s = ranked(spark, sf_dir)
    cuts = s.agg(F.percentile("score", F.array(*[F.lit(1 - r) for r in RATES])).alias("q")).select(F.posexplode("q").alias("i", "cut")).select("i", F.round("cut", 9).alias("cut"))
    flagged = s.groupBy("score").agg(F.count("*").alias("n")).crossJoin(F.broadcast(cuts))  # 60 rows
    return flagged.groupBy("i", F.round("cut", 6).alias("cut")).agg(F.round(F.sum(F.when(F.col("score") >= F.col("cut"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("flagged"))


ONE_RULE = " UNION ALL ".join(f"SELECT '{c}' AS feature, l_orderkey % 5 AS fold, {c} AS value, label, count(*) AS n FROM cat GROUP BY ALL" for c in FEATURES)


@query(f"""{CAT}, k AS (SELECT l_orderkey % 5 AS fold, label, count(*) AS n FROM cat GROUP BY ALL), g AS (SELECT DISTINCT fold FROM k), r AS (SELECT g.fold, arg_max(label, t * 10 - label) AS majority FROM g JOIN (SELECT g.fold, label, sum(n) AS t FROM g JOIN k ON k.fold <> g.fold GROUP BY ALL) x ON x.fold = g.fold GROUP BY g.fold)
SELECT r.fold, majority, sum(n)::bigint AS rows, round(coalesce(sum(n) FILTER (WHERE label = majority), 0) / sum(n), 6) AS accuracy FROM r JOIN k ON k.fold = r.fold GROUP BY ALL""")
def category_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline: each fold's rows get the most frequent label of the other folds (equal counts: the smaller)."""
    k = categories(spark, sf_dir).groupBy((F.col("l_orderkey") % 5).alias("fold"), "label").agg(F.count("*").alias("n"))
    rest = k.select(F.col("fold").alias("of"), F.col("label").alias("l"), F.col("n").alias("m"))
    totals = k.select("fold").distinct().join(rest, F.col("fold") != F.col("of")).groupBy("fold", "l").agg(F.sum("m").alias("t"))  # a row for each fold and label
    best = totals.groupBy("fold").agg(F.max_by("l", F.struct("t", -F.col("l"))).alias("majority"))
    out = k.join(best, "fold").groupBy("fold", "majority").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("label") == F.col("majority"), F.col("n")).otherwise(0)).alias("hit"))
    return out.select("fold", "majority", "rows", F.round(F.col("hit") / F.col("rows"), 6).alias("accuracy"))


@query(f"""{CAT}, k AS ({ONE_RULE}), f AS (SELECT DISTINCT fold FROM k), t AS (SELECT feature, f.fold, value, label, sum(n) AS n FROM k JOIN f ON k.fold <> f.fold GROUP BY ALL), m AS (SELECT feature, fold, value, arg_max(label, n * 10 - label) AS guess FROM t GROUP BY ALL),
a AS (SELECT k.feature, k.fold, sum(n) FILTER (WHERE label = coalesce(guess, 0)) / sum(n) AS accuracy FROM k LEFT JOIN m ON m.feature = k.feature AND m.fold = k.fold AND m.value = k.value GROUP BY ALL)
SELECT feature, count(*) AS folds, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS deviation, round(min(accuracy), 6) AS worst FROM a GROUP BY feature""")
def category_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds by order: the rule of each single feature, learned on the other folds, and how its accuracy varies."""
    df = categories(spark, sf_dir).withColumn("fold", F.col("l_orderkey") % 5)
    k = df.unpivot(["fold", "label"], list(FEATURES), "feature", "value").groupBy("feature", "fold", "value", "label").agg(F.count("*").alias("n"))
    every = k.groupBy("feature", "value", "label").agg(F.sum("n").alias("total"))
    grid = k.select("feature", "fold", "value").distinct().join(every, ["feature", "value"]).join(k, ["feature", "fold", "value", "label"], "left").na.fill(0, ["n"])
    rest = grid.withColumn("m", F.col("total") - F.col("n"))
    best = rest.groupBy("feature", "fold", "value").agg(F.max_by("label", F.struct(F.col("m") > 0, "m", -F.col("label"))).alias("guess"), F.sum("m").alias("seen"))
    hit = k.join(best, ["feature", "fold", "value"]).withColumn("guess", F.when(F.col("seen") > 0, F.col("guess")).otherwise(0))
    each = hit.groupBy("feature", "fold").agg((F.sum(F.when(F.col("label") == F.col("guess"), F.col("n"))) / F.sum("n")).alias("accuracy"))
    return each.groupBy("feature").agg(F.count("*").alias("folds"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_pop("accuracy"), 6).alias("deviation"), F.round(F.min("accuracy"), 6).alias("worst"))


ORDER = "row_number() OVER (PARTITION BY toxic ORDER BY md5('{}|' || doc_id::varchar), doc_id) - 1"


@query(f"SELECT doc_id, toxic, CASE WHEN ({ORDER.format('split')}) / count(*) OVER (PARTITION BY toxic) < 0.55 THEN 'fit' WHEN ({ORDER.format('split')}) / count(*) OVER (PARTITION BY toxic) < 0.7 THEN 'tune' ELSE 'test' END AS part FROM labels")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.stratified(parquet(spark, sf_dir, "labels", ["doc_id", "toxic"]), "toxic", "doc_id", [("fit", 0.55), ("tune", 0.15), ("test", 0.30)], "split")


@query(f"SELECT doc_id, toxic, (({ORDER.format('fold')}) % 5)::int AS fold FROM labels")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.folds(parquet(spark, sf_dir, "labels", ["doc_id", "toxic"]), "toxic", "doc_id", 5, "fold")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, the features, part, qty) of each line; part: 0 of orders that are held out."""
    return categories(spark, sf_dir).select("label", *FEATURES, F.pmod(F.xxhash64("l_orderkey"), F.lit(5)).cast("int").alias("part"), F.col("l_partkey").cast("double").alias("qty"))


def sources(df: DataFrame) -> list[str]:
    """The source feature of each place in the vector of prepared lines."""
    places = [x for kind in df.schema["features"].metadata["ml_attr"]["attrs"].values() for x in kind]
    return [next((c for c in FEATURES if x["name"].startswith(f"{c}_v")), "qty") for x in sorted(places, key=lambda x: x["idx"])]


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows to learn from and held-out orders, by one fitted preparation, and the source feature of each place in the vector.

    The tables are joined once: what the joins give is kept in columns (catalog.clearCache lets go), and
    each pass of the preparation and the models makes its vectors from there.
    """
    df = lines(spark, sf_dir).persist()
    share = df.agg(F.avg("label")).first()[0] or 0.5
    df = df.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    stages = [StringIndexer(inputCols=list(FEATURES), outputCols=[f"{c}_i" for c in FEATURES], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in FEATURES], outputCols=[f"{c}_v" for c in FEATURES]), Imputer(inputCols=["qty"], outputCols=["qty_f"], strategy="median"), VectorAssembler(inputCols=[*[f"{c}_v" for c in FEATURES], "qty_f"], outputCol="features")]
    train, test = df.where("part > 0"), df.where("part = 0")
    prep = Pipeline(stages=stages).fit(train)
    a, b = (prep.transform(t).select("features", "label", "weight") for t in (train, test))
    return a, b, sources(a)


def classifiers() -> dict:
    return {"logistic": LogisticRegression(maxIter=30), "logistic_weighted": LogisticRegression(maxIter=30, weightCol="weight"), "tree": DecisionTreeClassifier(maxDepth=5, seed=1), "forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=1), "boosted": GBTClassifier(maxIter=10, maxDepth=3, seed=1)}


@query()
def model_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic (plain and weighted), tree, forest and boosting on one prepared table: metrics on held-out orders."""
    a, b, _ = encoded(spark, sf_dir)
    out = None
    for name, m in classifiers().items():
        p = m.fit(a).transform(b).groupBy("label", F.round(F.get(vector_to_array("probability"), 1), 6).alias("score")).agg(F.count("*").alias("rows_"))
        p = cut(p)  # each row is predicted once for all metrics
        row = scoring.rates(p.agg(*scoring.confusion(F.col("label"), F.col("score") >= 0.5, "rows_"))).crossJoin(scoring.roc_auc(p, "score", "label", "rows_")).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def weights(spark: SparkSession, sf_dir: str, of: tuple[str, ...] = ("logistic", "tree", "forest")) -> DataFrame:
    """(model, place, feature, weight): coefficients and importances of fitted models, one row for each place of the vector."""
    a, _, names = encoded(spark, sf_dir)
    rows = []
    for name in of:
        m = classifiers()[name].fit(a)
        values = m.coefficients if name == "logistic" else m.featureImportances
        rows += [(name, i, f, float(x)) for i, (f, x) in enumerate(zip(names, values.toArray(), strict=True))]
    return spark.createDataFrame(rows, "model string, place int, feature string, weight double")


@query()
def model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each source feature by model, its share in percent and its place."""
    return scoring.importances(weights(spark, sf_dir))


@query()
def model_top_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 encoded columns with the largest coefficients of the logistic model, by absolute value."""
    return weights(spark, sf_dir, ("logistic",)).orderBy(F.desc(F.abs("weight")), "place").limit(15).select("place", "feature", "weight")


@query()
def model_rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which models a feature is among the three most important."""
    return scoring.agreement(scoring.importances(weights(spark, sf_dir)), ["logistic", "tree", "forest"], 3)


@query()
def model_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge, forest and boosting with early stopping on trip features: metrics in seconds on the validation role."""
    df = trips.featured(spark, sf_dir).withColumn("y", F.log1p("trip_duration"))
    df = VectorAssembler(inputCols=trip_ops.FEATURES, outputCol="features").transform(df).withColumn("stop", F.col("split") == "calibration").select("features", "y", "trip_duration", "split", "stop").persist()
    n = df.where("split = 'fit'").count()
    models = {"ridge": LinearRegression(labelCol="y", regParam=1.0 / max(1, n), elasticNetParam=0.0), "forest": RandomForestRegressor(labelCol="y", numTrees=20, maxDepth=8, subsamplingRate=0.5, minInstancesPerNode=5, seed=1), "boosted": GBTRegressor(labelCol="y", maxIter=20, maxDepth=4, stepSize=0.2, validationIndicatorCol="stop", seed=1)}
    out = None
    for name, m in models.items():
        rows = df.where("split IN ('fit', 'calibration')") if name == "boosted" else df.where("split = 'fit'")
        p = m.fit(rows).transform(df.where("split = 'validation'"))
        row = p.agg(*scoring.regression_metrics(F.col("trip_duration"), F.expm1("prediction"))).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
