"""Models that learn from counted rows learn what they learn from every row."""

import random

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillmesh.operators import cleaning, models


def test_equal_rows_are_counted_and_each_is_predicted(spark):
    rng = random.Random(8)
    rows = [(i % 2, float(rng.randrange(3)), float(rng.random() < 0.5), int(rng.random() < 0.3)) for i in range(800)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, label int")
    each = models.counted(df)
    assert each.count() <= 24 and sorted(map(tuple, models.every_row(each).collect())) == sorted(rows)
    assert sorted(models.every_row(spark.sql("SELECT 1 AS x, 25001L AS rows_")).groupBy("x").count().collect()) == [(1, 25001)]
    ready = lambda train: VectorAssembler(inputCols=["a", "b"], outputCol="features")
    tree = DecisionTreeClassifier(maxDepth=3, seed=1)
    assert models.weighable(tree) and models.weighable(LogisticRegression()) and not models.weighable(RandomForestClassifier())
    got = sorted((r.fold, r.label, r.score) for r in models.fold_predictions(df, "fold", 2, ready, {"tree": tree}).collect())
    want = []
    for k in (0, 1):
        p = tree.fit(ready(None).transform(df.where(F.col("fold") != k))).transform(ready(None).transform(df.where(F.col("fold") == k)))
        want += [(r.fold, r.label, round(float(r.probability[1]), 6)) for r in p.collect()]
    assert got == sorted(want)


def test_folds_meet_no_label_in_one_task(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 3).cast("int")))
    got = cleaning.folds(df, "y", "id", 5, "fold")
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = {}
    for r in sorted(df.select("id", "y", cleaning.md5_order(F.col("id"), "fold").alias("o")).collect(), key=lambda r: (r.o, r.id)):
        plain.setdefault(r.y, []).append(r.id)
    assert {r.id: r.fold for r in got.collect()} == {k: i % 5 for ids in plain.values() for i, k in enumerate(ids)}


def test_metrics_of_counted_predictions_are_those_of_every_row(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("a" if i % 2 else "b", 1, int(rng.random() < 0.4), round(rng.randrange(12) / 11, 6)) for i in range(500)], "model string, fold int, label int, score double")
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("rows_"))
    assert sorted(models.fold_metrics(counts, "rows_").collect()) == sorted(models.fold_metrics(df).collect())
    assert models.scoring.roc_auc(counts, "score", "label", "rows_").first() == models.scoring.roc_auc(df, "score", "label").first()


def test_tables_are_joined_once_for_all_passes_of_the_models(spark):
    from quillmesh.queries import labelled

    a, b, names = labelled.encoded(spark, "/root/testdata/sf0.001")
    for df in (a, b):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")
        assert "Join" not in plan[0] and len(plan) == 2  # what stands behind is kept
    assert set(names) == {*labelled.FEATURES, "qty"}
    spark.catalog.clearCache()
