"""Forests that learn from counted rows draw as often as from every row, and numbers are cut into the bins that a forest sees."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillmesh.operators import cleaning, models
from quillmesh.queries import models as queries


def ready(train):
    return VectorAssembler(inputCols=["a", "b"], outputCol="features")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(i % 2, float(rng.randrange(4)), float(rng.random() < 0.5)) for i in range(2000)]
    return spark.createDataFrame([(f, a, b, int(rng.random() < 0.2 + 0.15 * a + 0.1 * b)) for f, a, b in made], "fold int, a double, b double, label int")


def test_draws_of_equal_rows_are_those_of_each(spark):
    forest = RandomForestClassifier(numTrees=20, subsamplingRate=0.5, seed=4)
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("a"), (F.col("id") % 4 * 100 + 1).alias("rows_"))
    got = models.drawn(df, forest).collect()
    d, mean = np.array([r.drawn_ for r in got]), np.array([0.5 * r.rows_ for r in got])[:, None]
    z = (d - mean) / np.sqrt(mean)
    assert abs(z.mean()) < 0.05 and abs(z.var() - 1) < 0.06 and abs(np.corrcoef(z.T) - np.eye(20)).max() < 0.25
    again = {r.a: r.drawn_ for r in models.drawn(df.repartition(3, "a").sortWithinPartitions(F.desc("a")), forest).collect()}
    assert again == {r.a: r.drawn_ for r in got}


def test_trees_of_a_forest_see_their_draws_once(spark, rows):
    forest = RandomForestClassifier(numTrees=6, maxDepth=3, seed=2)
    train = models.drawn(ready(None).transform(models.counted(rows)), forest).persist()
    want = train.groupBy("label").agg(*[F.sum(F.get("drawn_", F.lit(t))).alias(f"t{t}") for t in range(6)]).orderBy("label").collect()
    for t, m in enumerate(models.forest_trees(train, forest)):
        assert [float(x) for x in m.trees[0]._java_obj.rootNode().impurityStats().stats()] == [r[f"t{t}"] for r in want]
    train.unpersist()


def test_folds_of_a_forest_learn_from_counts_alone(spark, rows, monkeypatch):
    forest = RandomForestClassifier(numTrees=30, maxDepth=4, seed=1)
    every, whole = models.every_row, []
    monkeypatch.setattr(models, "every_row", lambda df: whole.append(df) or every(df))
    got = {(r.fold, r.label, r.score): r.rows_ for r in models.fold_counts(rows, "fold", 2, ready, {"forest": forest}).collect()}
    assert not whole and sum(got.values()) == 2000
    scores = {}
    for k in (0, 1):
        p = forest.fit(ready(None).transform(rows.where(F.col("fold") != k))).transform(ready(None).transform(rows.where(F.col("fold") == k)))
        scores[k] = p.agg(F.avg(F.get(vector_to_array("probability"), 1)), F.stddev(F.get(vector_to_array("probability"), 1))).first()
    for k, (mean, spread) in scores.items():
        mine = np.repeat([s for f, _, s in got if f == k], [n for (f, _, _), n in got.items() if f == k])
        assert mine.mean() == pytest.approx(mean, abs=0.02) and mine.std() == pytest.approx(spread, abs=0.03)
    assert len(models.fold_predictions(rows, "fold", 2, ready, {"forest": forest}).collect()) == 2000


def test_a_thousand_million_equal_rows_are_folded_and_ablated(spark):
    each = spark.sql("SELECT inline(array((0, 0D, 1D, 800000000L), (1, 0D, 1D, 200000000L), (0, 1D, 0D, 300000000L), (1, 1D, 0D, 700000000L))) AS (label, a, b, rows_)")
    some = ready(None).transform(each)
    got = {r.subset: r for r in models.ablations(some, some, ["a", "b"], {"all": ["a", "b"], "a": ["a"]}, RandomForestClassifier(numTrees=5, maxDepth=2, seed=1), counted=True).collect()}
    assert got["all"].accuracy == got["a"].accuracy == 0.75 and got["a"].recall == pytest.approx(7 / 9)


def test_labels_by_counts_are_those_of_every_row(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.choice("abcde"), rng.choice(["x", "y", None])) for _ in range(300)], "p string, q string")
    want = StringIndexer(inputCols=["p", "q"], outputCols=["pi", "qi"], handleInvalid="keep").fit(df).labelsArray
    assert models.by_frequency(models.counted(df), ["p", "q"]) == [list(x) for x in want]


def test_bins_are_those_that_a_tree_splits_at(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(float(x := int(rng.expovariate(0.02))), int(x % 7 < 3)) for _ in range(3000)], "a double, label int")
    edges = models.bin_edges(df, "a", 32)
    assert len(edges) == 31 and edges == sorted(set(edges))
    sizes = [r["count"] for r in models.binned(df, "a", edges).groupBy("a").count().collect()]
    assert len(sizes) == 32 and sum(sizes) == 3000
    assemble = lambda t: VectorAssembler(inputCols=["a"], outputCol="features").transform(t)
    tree = DecisionTreeClassifier(maxDepth=5, maxBins=32, seed=1)
    raw = tree.fit(assemble(df)).transform(assemble(df)).groupBy("label", F.round(F.get(vector_to_array("probability"), 1), 9).alias("p")).count()
    cut = assemble(models.binned(df, "a", edges))
    assert all("ominal" not in str(f.metadata) for f in cut.schema.fields)  # a number, no category
    own = tree.fit(cut).transform(cut).groupBy("label", F.round(F.get(vector_to_array("probability"), 1), 9).alias("p")).count()
    assert sorted(raw.collect()) == sorted(own.collect())
    few = df.select((F.col("a") % 3).alias("a"))
    assert models.bin_edges(few, "a") == [0.5, 1.5] and models.bin_edges(few.where("a = 1"), "a") == []
    assert [r.a for r in models.binned(spark.createDataFrame([(0.5,), (0.6,), (9.0,)], "a double"), "a", [0.5, 1.5]).collect()] == [0.0, 1.0, 2.0]


def test_ablations_of_the_lines_count_equal_rows(spark, monkeypatch):
    seen = []
    plain = models.ablations
    monkeypatch.setattr(models, "ablations", lambda a, b, *more, **kind: seen.append((a, b)) or plain(a, b, *more, **kind))
    out = queries.model_ablations(spark, "/root/testdata/sf0.001").collect()
    (a, b), lines = seen[0], spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert len(out) == 7 and a.agg(F.sum("rows_")).first()[0] + b.agg(F.sum("rows_")).first()[0] == lines
    spark.catalog.clearCache()


def test_folds_sort_no_row_with_all_others(spark):
    df = spark.range(500).select(F.when(F.col("id") < 490, F.concat(F.lit("k"), "id")).alias("k"), (F.col("id") % 2).alias("y"))
    got = cleaning.folds(df, "y", "k", 5, "fold")
    assert "RangePartitioning" not in got._jdf.queryExecution().toString() and "rangepartitioning" not in got._jdf.queryExecution().toString()
    rows = sorted(((r.y, r.k is None, hashlib.md5(f"fold|{r.k}".encode()).hexdigest(), r.k or "", r.fold) for r in got.collect()))
    for y in (0, 1):
        mine = [r for r in rows if r[0] == y]
        assert [r[4] for r in mine if not r[1]] == [i % 5 for i in range(245)] and sorted(r[4] for r in mine if r[1]) == [0, 1, 2, 3, 4]
    spark.catalog.clearCache()
