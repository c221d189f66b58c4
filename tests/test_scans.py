"""Scans, sinks and checks; nested records; epochs; projections; tags."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import cleaning, cluster, corpus, tasks
from quillmesh.sources import tables


def test_tsv_with_required_columns(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ID\tIncome\tNA\n1\t\tNA\n2\t3.5\tnull\n")
    df = tables.required(tables.csv_strings(spark, str(tmp_path / "a.tsv"), ["ID", "Income", "NA"], "\t"), ["ID", "Income"])
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("1", None, "NA"), ("2", "3.5", "null")]
    with pytest.raises(ValueError, match="Response"):
        tables.required(df, ["ID", "Response"])
    with pytest.raises(ValueError, match="wanted"):
        tables.ordered(df, ["Income", "ID", "NA"])
    assert tables.ordered(df, ["ID", "Income", "NA"]) is df


def test_csv_with_times_is_pruned_at_the_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,at,x\na,2016-03-14 17:24:55,1\nb,2016-01-01 00:00:00,2\n")
    df = tables.csv_typed(spark, str(tmp_path / "t.csv"), "id string, at timestamp, x int", ["id", "at"])
    assert [(r.id, str(r.at)) for r in df.orderBy("id").collect()] == [("a", "2016-03-14 17:24:55"), ("b", "2016-01-01 00:00:00")]
    assert "ReadSchema: struct<id:string,at:timestamp>" in df._jdf.queryExecution().executedPlan().toString()


def test_star_of_csv_files(spark, tmp_path):
    for name, text in {"lines": "order_id,product_id\n1,10\n1,11\n2,12\n", "products": "product_id,name,aisle_id\n10,tea,5\n11,jam,6\n", "aisles": "aisle_id,aisle\n5,drinks\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    schemas = {"lines": "order_id int, product_id int", "products": "product_id int, name string, aisle_id int", "aisles": "aisle_id int, aisle string"}
    df = tables.star(spark, str(tmp_path), "lines", {"products": ("product_id", "product_id"), "aisles": ("aisle_id", "aisle_id")}, schemas)
    assert sorted(((r.order_id, r.name, r.aisle) for r in df.collect()), key=str) == [(1, "jam", None), (1, "tea", "drinks"), (2, None, None)]


def test_parts_are_stacked_by_name_and_heads_taken_by_group(spark):
    a, b = spark.createDataFrame([(1, "x")], " a int, b string".replace(" a", "`a `")), spark.createDataFrame([("y", 2)], "b string, a int")
    assert sorted((r.a, r.b) for r in tables.stacked(a, b).collect()) == [(1, "x"), (2, "y")]
    df = spark.createDataFrame([(g, i) for g in (3, 1, 2) for i in range(4)], "g int, i int")
    assert {r.g for r in tables.head_groups(df, "g", 2).collect()} == {1, 2} and tables.head_groups(df, "g", 2).count() == 8


def test_reports_and_mixed_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], True, "a")], "n int, xs array<int>, ok boolean, s string")
    out = tables.stringified(df)
    assert dict(out.dtypes) == {"n": "int", "xs": "string", "ok": "boolean", "s": "string"} and out.first().xs == "[1, 2]"
    tables.write_report(df.select("n", F.struct("s", "ok").alias("inner")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().inner.s == "a"


def test_values_outside_a_domain(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,), ("z",)], "v string")
    assert {(r.value, r.rows) for r in cleaning.outside_domain(df, "v", ["a", "b"]).collect()} == {("z", 2), (None, 1)}


def test_records_keep_what_they_cannot_read(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "m": [{"r": "u", "t": "x"}, {"r": "v", "t": null}]}'), (2, "{broken"), (3, '{"a": "text"}'), (4, None), (5, "{}")], "id int, raw string")
    got = {r.id: r for r in tables.records_of(rows, "raw", "a int, m array<struct<r: string, t: string>>").collect()}
    assert got[1].a == 1 and [tuple(x) for x in got[1].m] == [("u", "x"), ("v", None)] and got[1].corrupt is None
    assert got[2].corrupt == "{broken" and got[3].corrupt is not None and got[4].corrupt is None and got[5].a is None


def test_folding_is_undone_by_unfolding(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "v", None), (2, 5, None, "c"), (2, 3, "u", "b")]
    df = spark.createDataFrame(rows, "c int, turn int, role string, text string")
    got = corpus.unfolded(corpus.folded(df, "c", ["turn"], ["role", "text"]), "c").orderBy("c", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "u", "a"), (1, 1, "v", None), (2, 0, "u", "b"), (2, 1, None, "c")]
    empty = spark.createDataFrame([(1, []), (2, None)], "c int, messages array<struct<role: string>>")
    assert corpus.unfolded(empty, "c").count() == 0


def test_epochs_repeat_small_and_draw_anew(spark):
    df = spark.range(2000).withColumn("big", F.col("id") >= 20)
    got = corpus.epochs(df, "id", F.when(F.col("big"), 0.3).otherwise(2.0), 3, "s").collect()
    by = {e: {(r.id, r["pass"]) for r in got if r.epoch == e} for e in range(3)}
    assert all({(i, p) for i in range(20) for p in (1, 2)} <= by[e] and 450 < len(by[e]) - 40 < 750 for e in by)
    assert len(by[0] & by[1]) - 40 < 350 and len(got) == sum(map(len, by.values()))


def test_repetition_is_the_plain_count(spark):
    from collections import Counter

    texts = ["ab" * 40, "é" * 30 + "xyz", "short", "no repeats here at all, truly", "\U0001f600 loop " * 9, None]
    got = {r.i: r for r in corpus.repetition(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", F.col("t")).collect()}
    for i, t in enumerate(texts):
        if t and len(t) >= 12:
            c = Counter(t[j : j + 12] for j in range(len(t) - 11))
            assert (got[i].grams, got[i].most, got[i].looping) == (sum(c.values()), max(c.values()), max(c.values()) >= 3) and got[i].distinct_ratio == pytest.approx(len(c) / sum(c.values()), abs=1e-6)
        else:
            assert i not in got


def test_projection_is_that_of_the_covariance(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 7
    at, spread = cluster.projection(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>"), "v")
    values, axes = np.linalg.eigh(np.cov(x.T))
    top = axes[:, ::-1][:, :2]
    top = top * np.where(top[abs(top).argmax(0), [0, 1]] >= 0, 1, -1)
    want = (x - x.mean(0)) @ top
    got = np.array([r.place for r in at.orderBy("id").collect()])
    assert np.allclose(got, want) and np.allclose(got.mean(0), 0)
    s = spread.orderBy("axis").collect()
    assert np.allclose([r.variance for r in s], values[::-1][:2]) and np.allclose([r.share for r in s], values[::-1][:2] / values.sum())


def test_tags_are_found_or_made(spark):
    have = spark.createDataFrame([(3, "Work"), (9, "home")], "id long, name string")
    got = tasks.get_or_create(have, spark.createDataFrame([(" work ",), ("Errand",), ("errand",), ("",), ("art",)], "name string"))
    assert {tuple(r) for r in got.collect()} == {(3, "Work", False), (10, "art", True), (11, "Errand", True)}
    assert {tuple(r) for r in tasks.get_or_create(have.limit(0), have.select("name")).collect()} == {(1, "home", True), (2, "Work", True)}


def test_task_rules(spark):
    fields = "id int, title string, priority string, status string, due_date string, category_id int, estimated_minutes string, time_spent_minutes string"
    good = ("x", "low", "todo", "2024-02-29", None, None, "5")
    rows = [(1, *good), (2, " ", *good[1:]), (3, "y" * 501, *good[1:]), (4, "x", None, "nope", "2023-02-29", 7, "1.5", "-1"), (5, *good[:3], "2024-2-9", 1, "100001", ""), (6, *good[:3], "", 1, "100000", None)]
    df = tasks.with_known(spark.createDataFrame(rows, fields), spark.createDataFrame([(1,)], "id int"))
    got = {(r.id, r.field, r.reason) for r in cleaning.violations(df, "id", tasks.task_checks(df)).collect()}
    minutes = "not a whole number of minutes"
    assert got == {(2, "title", "required"), (3, "title", "too long"), (4, "priority", "invalid"), (4, "status", "invalid"), (4, "due_date", "not YYYY-MM-DD"), (4, "estimated_minutes", minutes), (4, "time_spent_minutes", minutes), (4, "category_id", "does not exist"), (5, "due_date", "not YYYY-MM-DD"), (5, "estimated_minutes", minutes)}


def test_appended_rows_are_all_kept(spark):
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    assert sorted(tuple(r) for r in tables.stacked(one, one).collect()) == [(1, "a"), (1, "a")]
