"""Models under evaluation: folds of fitted models, readable tree rules, ablations, learning curves, and a gated search."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import cut
from . import scoring
from .ranks import running

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counted(df: DataFrame) -> DataFrame:
    """The distinct rows of df with the number of each, rows_, written down."""
    some = df.groupBy(*df.columns).agg(F.count("*").alias("rows_"))
    return cut(some.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns))


def every_row(df: DataFrame) -> DataFrame:
    """Each row of df rows_ times."""
    step = 10000
    some = df.withColumn("from_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows_") - 1, F.lit(step).cast("long"))))
    return some.withColumn("rows_", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(step), F.col("rows_") - F.col("from_")).cast("int")))).drop("rows_", "from_")


def by_frequency(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """The values of each column of counted rows, the most frequent first, equally frequent ones by alphabet: what a StringIndexer learns from every row."""
    n = df.unpivot(["rows_"], columns, "column", "value").where("value IS NOT NULL").groupBy("column", "value").agg(F.sum("rows_").alias("n")).collect()
    return [[r["value"] for r in sorted((r for r in n if r["column"] == c), key=lambda r: (-r["n"], r["value"]))] for c in columns]


def bin_edges(df: DataFrame, column: str, bins: int = 32) -> list[float]:
    """At most bins - 1 rising numbers that part the rows into bins of nearly equal size, each halfway between two values; with no more values than bins each has its own.

    A forest sees a number only through such bins (maxBins), whose bounds it takes from some 10,000 rows;
    these are from all rows. Values are counted first and their running sums go by ranges.
    """
    n = running(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n")), F.struct("x"), {"up": F.col("n")}, totals=True)
    if len(few := n.select("x").limit(bins + 1).collect()) <= bins:
        x = sorted(r["x"] for r in few)
        return [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)]
    off = lambda i: F.struct(F.abs(F.col("up") - F.col("up_all") * (i / bins)), -F.col("x"))
    low = sorted(set(n.agg(*[F.min_by("x", off(i)) for i in range(1, bins)]).first()))  # a number for each edge
    high = n.agg(*[F.min(F.when(F.col("x") > x, F.col("x"))) for x in low]).first()
    return [(a + b) / 2 for a, b in zip(low, high, strict=True) if b is not None]


def binned(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """df with the column's numbers replaced by how many edges lie below them."""
    if not edges:
        return df.withColumn(column, F.lit(0.0))
    splits = [-math.inf, *[math.nextafter(e, math.inf) for e in edges], math.inf]  # a number at an edge stays below it, as in a tree
    return Bucketizer(splits=splits, inputCol=column, outputCol="bin_").transform(df).withColumn(column, F.col("bin_").alias(column, metadata={})).drop("bin_")  # a number, no category


def weighable(m: Estimator) -> bool:
    """Whether m learns the same from distinct rows with weights: it takes weights, none are set, and it draws no rows by chance."""
    return m.hasParam("weightCol") and not m.isDefined("weightCol") and not m.hasParam("subsamplingRate")


def bagging(m: Estimator) -> bool:
    """Whether m is a forest whose trees each draw rows with replacement, with no weights and no least number of rows in a leaf."""
    return isinstance(m, RandomForestClassifier) and m.getBootstrap() and m.getNumTrees() > 1 and m.getMinInstancesPerNode() == 1 and not m.isDefined("weightCol")


def drawn(df: DataFrame, forest: RandomForestClassifier) -> DataFrame:
    """Counted rows with drawn_: how often each tree of the forest draws the equal rows that each stands for.

    A forest draws every row Poisson(rate) times for each tree. Such draws of n rows sum to Poisson(n * rate),
    so one draw for each distinct row is the same bootstrap. It depends on the seed and the row's values only.
    """
    trees, rate, seed = forest.getNumTrees(), forest.getSubsamplingRate(), forest.getSeed() % 2**63

    @F.pandas_udf("array<double>")
    def draw(key: pd.Series, n: pd.Series) -> pd.Series:
        bits = np.random.Philox(key=(0, seed))
        rng, start, out = np.random.Generator(bits), bits.state, np.empty((len(key), trees))
        for i, (k, mean) in enumerate(zip(key.to_numpy(np.int64).view(np.uint64), rate * n.to_numpy(), strict=True)):
            start["state"]["key"][0] = k  # each row has its own stream
            bits.state = start
            out[i] = rng.poisson(mean, trees)
        return pd.Series(list(out))

    return df.withColumn("drawn_", draw(F.xxhash64(*[c for c in df.columns if c != "rows_"]), "rows_"))


def forest_trees(train: DataFrame, forest: RandomForestClassifier) -> list[Model]:
    """The trees of a forest, each fitted on its own draws: train has drawn_. Several are fitted at once, as their jobs are small."""
    every = {"auto": "sqrt"}.get(forest.getFeatureSubsetStrategy(), forest.getFeatureSubsetStrategy())
    one = {forest.numTrees: 1, forest.bootstrap: False, forest.subsamplingRate: 1.0, forest.featureSubsetStrategy: every, forest.weightCol: "times_"}

    def fit(t: int) -> Model:
        rows = train.select(forest.getFeaturesCol(), forest.getLabelCol(), F.get("drawn_", F.lit(t)).alias("times_")).where("times_ > 0")
        return forest.copy({**one, forest.seed: forest.getSeed() + t}).fit(rows)

    with ThreadPool(min(8, forest.getNumTrees())) as pool:
        return pool.map(inheritable_thread_target(train.sparkSession)(fit), range(forest.getNumTrees()))


def scored(m: Estimator, train: DataFrame, held: DataFrame, counted: bool = False) -> DataFrame:
    """held with score, the probability of class 1 by m fitted on train. counted: each row of train stands for rows_ equal ones; with drawn_ the trees of a forest learn from their draws."""
    if counted and "drawn_" in train.columns and bagging(m):
        trees = forest_trees(train, m)
        for t, one in enumerate(trees):  # a forest's probability is the mean of its trees'
            held = one.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"p{t}_").transform(held)
        mean = sum(F.get(vector_to_array(f"p{t}_"), 1) for t in range(len(trees))) / len(trees)
        return held.withColumn("score", F.round(mean, 6)).drop(*[f"p{t}_" for t in range(len(trees))])
    if not counted:
        fitted = m.fit(train)
    elif weighable(m):
        fitted = m.copy({m.weightCol: "rows_"}).fit(train)
    else:
        every = every_row(train).persist()
        fitted = m.fit(every)
        every.unpersist()
    return fitted.transform(held).withColumn("score", F.round(F.get(vector_to_array("probability"), 1), 6))


def fold_counts(df: DataFrame, fold: str, folds: int, prepare: Callable[[DataFrame], Transformer], models: dict[str, Estimator], label: str = "label") -> DataFrame:
    """(model, fold, label, score, rows_): how many rows of a fold and label have a score by the models that were fitted without that fold.

    Equal rows are counted and written down once, for all folds and models, and each is scored once. Models
    that take weights learn from the counts, forests from as many draws, others from every row. prepare is
    given the counted rows that the models learn from, so no fold is encoded with what it holds.
    """
    parts, each = [], counted(df)
    for k in range(folds):
        train, test = each.where(F.col(fold) != k), each.where(F.col(fold) == k)
        ready = prepare(train)
        some, held = ready.transform(train).persist(), ready.transform(test)
        for name, m in models.items():
            own = drawn(some, m).persist() if bagging(m) else some
            p = scored(m, own, held, True)
            parts.append(p.select(F.lit(name).alias("model"), F.lit(k).alias("fold"), F.col(label).cast("int").alias("label"), "score", "rows_"))
            own.unpersist()
        some.unpersist()
    return cut(stacked(parts).groupBy("model", "fold", "label", "score").agg(F.sum("rows_").alias("rows_")))


def fold_predictions(df: DataFrame, fold: str, folds: int, prepare: Callable[[DataFrame], Transformer], models: dict[str, Estimator], label: str = "label") -> DataFrame:
    """(model, fold, label, score) of every row by the models that were fitted without its fold: fold_counts, each row by itself."""
    return every_row(fold_counts(df, fold, folds, prepare, models, label))


def grouped_auc(df: DataFrame, by: list[str], score: str, label: str, rows: str | None = None) -> DataFrame:
    """(by, roc_auc) of each group, exact with ties. Rows are counted by score first: with scores rounded to six digits a group's window has 10^6 rows at most. rows: the column that says for how many rows each one stands."""
    n = F.lit(1) if rows is None else F.col(rows)
    each = df.groupBy(*by, score).agg(F.sum(n * F.col(label)).alias("hit"), F.sum(n * (1 - F.col(label))).alias("miss"))
    above = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    area = each.select(*by, "hit", "miss", (F.col("miss") * (F.coalesce(F.sum("hit").over(above), F.lit(0)) + F.col("hit") / 2)).alias("won"))
    return area.groupBy(*by).agg((F.sum("won") / F.nullif(F.sum("hit") * F.sum("miss"), F.lit(0))).alias("roc_auc"))


def fold_metrics(predictions: DataFrame, rows: str | None = None) -> DataFrame:
    """(model, fold, the five metrics), a row for each model and fold; a score of 0.5 or more is flagged. rows: the column that says for how many rows each one stands."""
    by = ["model", "fold"]
    counts = predictions.groupBy(*by).agg(*scoring.confusion(F.col("label"), F.col("score") >= 0.5, rows))
    return scoring.rates(counts, 9).join(grouped_auc(predictions, by, "score", "label", rows), by).select(*by, *METRICS)


def cross_validation(predictions: DataFrame, rows: str | None = None) -> DataFrame:
    """(model, NAME_mean, NAME_std): mean and population deviation over the folds of each metric. rows: the column that says for how many rows each one stands."""
    cells = [c for n in METRICS for c in (F.round(F.avg(n), 6).alias(f"{n}_mean"), F.round(F.stddev_pop(n), 6).alias(f"{n}_std"))]
    return fold_metrics(predictions, rows).groupBy("model").agg(*cells)


@dataclass
class Rule:
    """A leaf of a tree: the conditions on the way there, as text and as a column over an array of features."""

    conditions: list[str]
    holds: Callable[[Column], Column]
    predicted: float
    counts: list[float] = field(default_factory=list)


def tree_rules(model: Model, names: list[str]) -> list[Rule]:
    """The leaves of a fitted decision tree, left before right. Features are continuous or have been made 0 or 1."""
    found: list[Rule] = []

    def walk(node, conditions: list[str], tests: list[tuple[int, float, bool]]) -> None:
        if node.subtreeDepth() == 0:
            holds = lambda x: F.lit(True) if not tests else _all([(F.get(x, F.lit(i)) <= t) if low else (F.get(x, F.lit(i)) > t) for i, t, low in tests])
            found.append(Rule(conditions, holds, float(node.prediction()), [float(c) for c in node.impurityStats().stats()]))
            return
        split = node.split()
        i = split.featureIndex()
        if hasattr(split, "threshold") and "ContinuousSplit" in split.getClass().getName():
            t = float(split.threshold())
            walk(node.leftChild(), [*conditions, f"{names[i]} <= {t:g}"], [*tests, (i, t, True)])
            walk(node.rightChild(), [*conditions, f"{names[i]} > {t:g}"], [*tests, (i, t, False)])
        else:  # a feature of two values, known as a category: 0 on one side
            zero_left = 0.0 in [float(c) for c in split.leftCategories()]
            sides = ((node.leftChild(), zero_left), (node.rightChild(), not zero_left))
            for child, low in sides:
                walk(child, [*conditions, f"{names[i]} = {0 if low else 1}"], [*tests, (i, 0.5, low)])

    walk(model._java_obj.rootNode(), [], [])
    return found


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule, depth, conditions, predicted, support, share): a row for each leaf; share is that of the predicted class."""
    rows = [(i, len(r.conditions), " AND ".join(r.conditions) or "always", r.predicted, sum(r.counts), r.counts[int(r.predicted)] / max(1e-12, sum(r.counts))) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, depth int, conditions string, predicted double, support double, share double")


def by_rules(features: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(number, prediction) of the rule that holds; features is an array of numbers."""
    number, value = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i, r in enumerate(rules):
        number, value = F.when(r.holds(features), i).otherwise(number), F.when(r.holds(features), r.predicted).otherwise(value)
    return number, value


def ablations(train: DataFrame, test: DataFrame, names: list[str], subsets: dict[str, list[str]], model: Estimator, label: str = "label", counted: bool = False) -> DataFrame:
    """(subset, features, the five metrics): the model fitted on some source features only, their places cut from the prepared vector. names: the feature of each place. counted: rows stand for rows_ equal ones; a forest's subsets share their draws."""
    parts = []
    if counted and bagging(model):
        train = drawn(train, model).persist()
    for name, keep in subsets.items():
        slicer = VectorSlicer(inputCol="features", outputCol="kept", indices=[i for i, n in enumerate(names) if n in keep])
        p = scored(model.copy({model.featuresCol: "kept"}), slicer.transform(train), slicer.transform(test), counted)
        parts.append(p.select(F.lit(name).alias("model"), F.lit(len(keep)).alias("fold"), F.col(label).cast("int").alias("label"), "score", (F.col("rows_") if counted else F.lit(1)).alias("rows_")))
    counts = cut(stacked(parts).groupBy("model", "fold", "label", "score").agg(F.sum("rows_").alias("rows_")))  # each row is predicted once for all metrics
    if counted:
        train.unpersist()
    return fold_metrics(counts, "rows_").withColumnsRenamed({"model": "subset", "fold": "features"})


def learning_curve(model: Model, roles: dict[str, DataFrame], loss: str = "squared") -> DataFrame:
    """(trees, one column for each role, best): the loss of a boosted regression after each tree; best marks the least loss of the last role, the earliest of equal ones."""
    values = {n: [float(x) for x in model.evaluateEachIteration(df, loss)] for n, df in roles.items()}
    last = values[list(values)[-1]]
    rows = [(i + 1, *[v[i] for v in values.values()], i == last.index(min(last))) for i in range(len(last))]
    spark = next(iter(roles.values())).sparkSession
    return spark.createDataFrame(rows, f"trees int, {', '.join(f'{n} double' for n in values)}, best boolean")


def passes(candidate: float, incumbent: float, epsilon: float) -> bool:
    """A candidate is taken only if it is better by more than epsilon."""
    return incumbent - candidate > epsilon


TRIALS = "step int, phase string, component string, score double, incumbent_before double, incumbent_after double, gain double, decision string, features int"


def gated_search(
    rows: DataFrame, base: list[str], models: dict[str, Callable[[dict], Estimator]], climber: str, params: dict, candidates: dict[str, str], overrides: dict[str, dict],
    partner: str | None = None, weights: list[float] | None = None, epsilon: float = 1e-4, label: str = "y", role: str = "split", score: Callable[[DataFrame], float] | None = None,
) -> DataFrame:
    """The trials of a hill climb on the validation role, each gated by epsilon; smaller scores are better.

    1. Every model is fitted on the base features (benchmarks); the climb starts from the climber's own score.
    2. Each candidate, a column expression as text, is added; 3. each override changes parameters;
    4. the climber is mixed with the partner, fitted on the features by then, in each weight.
    A rejected step leaves nothing behind. Only the roles fit and validation are read, once: candidate
    columns are computed with them and kept. rows has one row for each key; label is in log space.
    """
    error = score or (lambda p: float(p.agg(F.sqrt(F.avg((F.col("prediction") - F.col(label)) ** 2)).alias("e")).first()["e"]))
    kept = rows.where(F.col(role).isin("fit", "validation")).select("*", *[F.expr(e).cast("double").alias(n) for n, e in candidates.items()]).persist()
    fit, held = kept.where(F.col(role) == "fit"), kept.where(F.col(role) == "validation")
    trials: list[tuple] = []

    def predicted(name: str, own: dict, features: list[str], on: DataFrame, into: str = "prediction") -> DataFrame:
        ready = VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="keep")
        model = models[name](own).setFeaturesCol("vector").setLabelCol(label).setPredictionCol(into).fit(ready.transform(fit))
        return model.transform(ready.transform(on)).drop("vector")

    def step(phase: str, component: str, value: float, before: float | None, features: list[str]) -> bool:
        taken = before is not None and passes(value, before, epsilon)
        decision = "BENCHMARK" if before is None else "ACCEPTED" if taken else "REJECTED"
        trials.append((len(trials) + 1, phase, component, value, before, value if taken else before, None if before is None else before - value, decision, len(features)))
        return taken

    first = {}
    for name in models:
        first[name] = error(predicted(name, params if name == climber else {}, base, held))
        step("backbone", name, first[name], None, base)
    best, features, own = first[climber], list(base), dict(params)
    for name in candidates:
        value = error(predicted(climber, own, [*features, name], held))
        if step("feature", name, value, best, [*features, name]):
            best, features = value, [*features, name]
    for name, change in overrides.items():
        value = error(predicted(climber, {**own, **change}, features, held))
        if step("parameter", name, value, best, features):
            best, own = value, {**own, **change}
    if partner:
        both = predicted(partner, {}, features, predicted(climber, own, features, held, "climbed"), "other").persist()
        for w in weights or []:
            value = error(both.withColumn("prediction", w * F.col("climbed") + (1 - w) * F.col("other")))
            if step("blend", f"{w:g}", value, best, features):
                best = value
        both.unpersist()
    kept.unpersist()
    return rows.sparkSession.createDataFrame(trials, TRIALS)


def yeo_johnson(x: Column, power: float) -> Column:
    """The power transform of a number, negative ones included."""
    up = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def power_likelihoods(df: DataFrame, columns: list[str], grid: list[float]) -> DataFrame:
    """(column, power, likelihood, best) for each column and power of the grid, all in one aggregation over the rows; nulls are left out, a constant column has no likelihoods. best: the largest, the smaller power of equal ones."""
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        sign = F.sum(F.signum(x) * F.log1p(F.abs(x)))
        for p in grid:
            spread = F.var_pop(yeo_johnson(x, p))
            cells.append(F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("power"), F.round(F.when(spread > 0, -F.count(x) / 2 * F.log(spread) + (p - 1) * sign), 6).alias("likelihood")))
    out = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    order = Window.partitionBy("column").orderBy(F.desc_nulls_last("likelihood"), "power")  # the grid of one column
    return out.withColumn("best", (F.row_number().over(order) == 1) & F.col("likelihood").isNotNull())


def probability(log_odds: Column) -> Column:
    """The probability of log-odds, without overflow for large ones of either sign."""
    e = F.exp(-F.abs(log_odds))
    return F.when(log_odds >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


