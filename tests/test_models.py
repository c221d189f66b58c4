"""Folds of fitted models, tree rules, ablations, learning curves, the gated search and power transforms, against plain versions."""

import math
import random
from itertools import groupby

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from quillmesh.operators import models


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), float(rng.randrange(4)), float(rng.random() < 0.4)) for i in range(300)]
    return spark.createDataFrame([(i, x, c, f, int(x + 0.3 * f + 0.2 * rng.random() > 0.7)) for i, x, c, f in rows], "id long, x double, c double, f double, label int").repartition(3, "id")


def ready(train):
    return VectorAssembler(inputCols=["x", "c", "f"], outputCol="features")


def test_cross_validation_is_the_plain_one(spark, points):
    df = points.withColumn("fold", (F.col("id") % 3).cast("int"))
    p = models.fold_predictions(df, "fold", 3, ready, {"tree": DecisionTreeClassifier(maxDepth=2, seed=1), "line": LogisticRegression(maxIter=5)})
    rows = sorted((r.model, r.fold, r.label, r.score) for r in p.collect())
    assert len(rows) == 600
    want = {}
    for (m, _), g in groupby(rows, key=lambda r: r[:2]):
        g = list(g)
        tp, fp, fn = (sum(1 for r in g if (r[2], r[3] >= 0.5) == k) for k in ((1, True), (0, True), (1, False)))
        won = [(a[3] > b[3]) + (a[3] == b[3]) / 2 for a in g if a[2] for b in g if not b[2]]
        prec, rec = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0
        want.setdefault(m, []).append((sum((r[3] >= 0.5) == r[2] for r in g) / len(g), prec, rec, 2 * prec * rec / (prec + rec) if prec + rec else 0, sum(won) / len(won)))
    for r in models.cross_validation(p).collect():
        for i, name in enumerate(models.METRICS):
            values = [w[i] for w in want[r.model]]
            mean = sum(values) / 3
            assert r[f"{name}_mean"] == pytest.approx(mean, abs=2e-6) and r[f"{name}_std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / 3), abs=2e-6)


def test_rules_reproduce_the_tree(spark, points):
    train = ready(None).transform(points)
    model = DecisionTreeClassifier(maxDepth=4, seed=1).fit(train)
    rules = models.tree_rules(model, ["x", "c", "f"])
    number, value = models.by_rules(F.col("v"), rules)
    out = model.transform(train).withColumn("v", vector_to_array("features")).select("prediction", number.alias("n"), value.alias("p"), *[r.holds(F.col("v")).cast("int").alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    assert all(r.prediction == r.p and sum(r[f"r{i}"] for i in range(len(rules))) == 1 for r in out)
    table = {r.rule: r for r in models.rule_table(spark, rules).collect()}
    assert all(table[i].support == sum(1 for r in out if r.n == i) for i in table) and table[0].depth <= 4 and "x" in table[0].conditions
    alone = DecisionTreeClassifier(maxDepth=0, seed=1).fit(train)
    assert [r.conditions for r in models.rule_table(spark, models.tree_rules(alone, ["x", "c", "f"])).collect()] == ["always"]


def test_ablation_fits_on_the_kept_features(spark, points):
    train = ready(None).transform(points)
    model = DecisionTreeClassifier(maxDepth=3, seed=1)
    got = {r.subset: r for r in models.ablations(train, train, ["x", "c", "f"], {"all": ["x", "c", "f"], "no x": ["c", "f"]}, model).collect()}
    own = model.fit(VectorAssembler(inputCols=["c", "f"], outputCol="features").transform(points))
    right = own.transform(VectorAssembler(inputCols=["c", "f"], outputCol="features").transform(points)).where("(prediction = 1) = (label = 1)").count()
    assert got["no x"].accuracy == pytest.approx(right / 300, abs=1e-6) and got["all"].accuracy > got["no x"].accuracy and got["no x"].features == 2


def test_learning_curve_marks_the_least_loss(spark, points):
    df = ready(None).transform(points.withColumn("label", F.col("x") * 2 + F.col("f")))
    a, b = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    model = GBTRegressor(maxIter=6, maxDepth=2, seed=1).fit(a)
    got = models.learning_curve(model, {"fit": a, "stop": b}).orderBy("trees").collect()
    assert [r.trees for r in got] == list(range(1, 7)) and [r.best for r in got].count(True) == 1
    assert min(r.stop for r in got) == next(r.stop for r in got if r.best)
    last = model.transform(b).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    assert got[-1].stop == pytest.approx(last)


def test_gate_needs_more_than_epsilon():
    assert models.passes(0.3000, 0.3002, 1e-4) and not models.passes(0.30005, 0.3001, 1e-4) and not models.passes(0.31, 0.30, 1e-4)


def test_search_undoes_rejected_steps_and_never_reads_the_test_role(spark):
    rng = random.Random(5)
    rows = [(i, ["fit", "validation", "test"][i % 3], rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, split string, a double, b double").withColumn("y", F.col("a") + F.col("b") * F.col("b"))
    guarded = df.withColumn("y", F.when(F.col("split") == "test", F.raise_error(F.lit("test role was read")).cast("double")).otherwise(F.col("y")))
    line = lambda p: LinearRegression(**{"regParam": 0.0, **p})
    tree = lambda p: GBTRegressor(maxIter=2, maxDepth=1, seed=1, **p)
    found = models.gated_search(guarded, ["a"], {"line": line, "tree": tree}, "line", {"regParam": 0.5}, {"copy": "a * 1.0", "square": "b * b", "again": "b * b * 1.0"}, {"free": {"regParam": 0.0}, "tight": {"regParam": 5.0}}, "tree", [0.5])
    t = found.orderBy("step").collect()
    assert [r.decision for r in t[:2]] == ["BENCHMARK"] * 2 and [r.component for r in t] == ["line", "tree", "copy", "square", "again", "free", "tight", "0.5"]
    best = t[0].score
    for r in t[2:]:  # replay of the gate
        assert r.incumbent_before == best and r.decision == ("ACCEPTED" if best - r.score > 1e-4 else "REJECTED")
        best = r.score if r.decision == "ACCEPTED" else best
        assert r.incumbent_after == best and r.gain == pytest.approx(r.incumbent_before - r.score)
    by = {r.component: r for r in t}
    assert by["square"].decision == by["free"].decision == "ACCEPTED" and by["tight"].decision == by["0.5"].decision == "REJECTED"
    kept = 1 + sum(by[n].decision == "ACCEPTED" for n in ("copy", "square", "again"))
    assert by["free"].features == by["0.5"].features == kept and by["free"].score < 1e-6


def test_power_grid_is_the_plain_one(spark):
    x = [-2.0, -0.5, 0.0, 0.3, 1.0, 4.0, 9.0, 30.0, None]
    df = spark.createDataFrame([(v, 5.0) for v in x], "x double, same double")
    got = {(r.column, r.power): r for r in models.power_likelihoods(df, ["x", "same"], [-1.0, 0.0, 0.5, 1.0, 2.0]).collect()}

    def plain(p):
        f = lambda v: (math.log(v + 1) if p == 0 else ((v + 1) ** p - 1) / p) if v >= 0 else (-math.log(1 - v) if p == 2 else -((1 - v) ** (2 - p) - 1) / (2 - p))
        y = [f(v) for v in x if v is not None]
        m = sum(y) / len(y)
        return -len(y) / 2 * math.log(sum((a - m) ** 2 for a in y) / len(y)) + (p - 1) * sum(math.copysign(math.log(abs(v) + 1), v) for v in x if v)

    want = {p: plain(p) for p in (-1.0, 0.0, 0.5, 1.0, 2.0)}
    assert all(got["x", p].likelihood == pytest.approx(w, abs=1e-5) for p, w in want.items())
    assert [p for p in want if got["x", p].best] == [max(want, key=want.get)] and not any(got["same", p].best for p in want)


def test_probability_of_large_log_odds(spark):
    got = [r.p for r in spark.createDataFrame([(0.0,), (800.0,), (-800.0,), (math.log(3),)], "z double").select(models.probability(F.col("z")).alias("p")).collect()]
    assert got[:3] == [0.5, 1.0, 0.0] and got[3] == pytest.approx(0.75)


def test_stratified_edges_are_the_decimal_ones(spark):
    from quillmesh.operators import cleaning

    df = spark.range(100).withColumn("y", F.lit(1))
    got = cleaning.stratified(df, "y", "id", [("fit", 0.55), ("tune", 0.15), ("test", 0.30)], "split").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in got} == {"fit": 55, "tune": 15, "test": 30}
