"""Distances by matrix products: the same as by differences, in a number of blocks that is bounded for its table."""

import numpy as np
import pandas as pd
import pytest

from quillmesh.operators import density


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(900, 5)), rng.integers(0, 3, (300, 5)).astype(float), np.ones((700, 5)))) + 1e4  # ties, copies, far from 0
    return pd.DataFrame({"key": rng.permutation(len(x)), "v": list(x), "label": rng.integers(0, 4, len(x))})


def plain(rows):
    x = np.array(rows["v"].to_list())
    return np.array([np.round(np.sqrt(((x - r) ** 2).sum(1)), density.DIGITS) for r in x])


def test_nearest_and_links_by_products_are_those_by_differences(rows, monkeypatch):
    monkeypatch.setattr(density, "TALL", 100)
    monkeypatch.setattr(density, "WIDE", 150)
    d, keys = plain(rows), rows["key"].to_numpy()
    got = density.closest(rows, rows, 4).groupby("key").agg(list)
    for i, k in enumerate(keys):
        order = np.lexsort((keys, keys != k, d[i]))[:4]
        assert got.loc[k, "other"] == list(keys[order]) and got.loc[k, "distance"] == list(d[i][order])
    eps = float(np.sort(d[0])[40])  # a distance of the table
    x = density.matrix(rows["v"])
    for at, to, square, error in density.tiles(x, x):
        assert (density.linked(x, x, at, to, square, error, eps) == (d[at, to] <= eps)).all()
    one = density.closest(rows, rows[::2].reset_index(drop=True), 1, 1.0)
    assert len(one) == int((d[:, ::2].min(1) <= 1.0).sum())


def test_a_table_of_40000_rows_makes_few_blocks(spark):
    df = spark.range(40000).select(density.F.col("id").alias("key"), density.F.array(density.F.col("id").cast("double")).alias("v"))
    done = density.by_blocks(df, df, lambda a, b: pd.DataFrame({"n": [len(a)], "m": [len(b)]}), "n long, m long").collect()
    assert len(done) <= 16 and sum(r.n * r.m for r in done) == 40000**2


def test_silhouettes_of_copies_are_those_of_plain_distances(spark, rows):
    d, labels = plain(rows), rows["label"].to_numpy()
    s = []
    for i, own in enumerate(labels):
        a = d[i][labels == own].sum() / ((labels == own).sum() - 1)
        b = min(d[i][labels == g].mean() for g in set(labels) - {own})
        s.append((b - a) / max(a, b))
    df = spark.createDataFrame([(int(k), [float(t) for t in v], int(g)) for k, v, g in rows.itertuples(index=False)], "id long, v array<double>, g int")
    got = {r.label: r.silhouette for r in density.silhouettes(df, "id", "v", "g").collect()}
    assert got[None] == pytest.approx(np.mean(s), abs=1e-6) and all(got[g] == pytest.approx(np.mean(np.array(s)[labels == g]), abs=1e-6) for g in set(labels))


def test_several_partitions_share_the_distances(spark, rows):
    rows = rows.sample(300, random_state=1)
    df = spark.createDataFrame([(int(k), [float(t) for t in v], int(g), int(k) % 90, -1 if k % 3 == 0 else int(k) % 2) for k, v, g in rows.itertuples(index=False)], "id long, v array<double>, g int, many int, some int")
    together = density.silhouettes_of(df, "id", "v", ["g", "many", "some"], -1).collect()
    for c in ("g", "many", "some"):
        one = {r.label: (r.n, r.silhouette) for r in density.silhouettes(df.where(f"{c} <> -1"), "id", "v", c).collect()}
        assert {r.label: (r.n, r.silhouette) for r in together if r.of == c} == one
    assert {r.label for r in together if r.of == "some"} == {None, 0, 1}
    d, labels, s = plain(rows), (rows["key"] % 90).to_numpy(), []
    for i, own in enumerate(labels):
        a, b = d[i][labels == own].sum() / max(1, (labels == own).sum() - 1), min(d[i][labels == g].mean() for g in set(labels) - {own})
        s.append(0.0 if (labels == own).sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    assert next(r.silhouette for r in together if r.of == "many" and r.label is None) == pytest.approx(np.mean(s), abs=1e-6)


def test_known_neighbours_give_the_curve_and_the_graph(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in (0, 20)])
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, v array<double>")
    near = density.nearest(df, "id", "v", 12)
    assert sorted(density.k_distances(df, "id", "v", 8, near).collect()) == sorted(density.k_distances(df, "id", "v", 8).collect())
    assert sorted(density.graph_clusters(df, "id", "v", 2, near=near).collect()) == sorted(density.graph_clusters(df, "id", "v", 2).collect())


def test_pairs_are_gone_through_once_for_groups_and_the_whole(spark, rows, monkeypatch):
    made, plan = [], density.by_blocks
    monkeypatch.setattr(density, "by_blocks", lambda *a: made.append(plan(*a)) or made[-1])
    rows = rows.sample(60, random_state=2)
    df = spark.createDataFrame([(int(k), [float(t) for t in v], int(g)) for k, v, g in rows.itertuples(index=False)], "id long, v array<double>, g int")
    text = density.silhouettes(df, "id", "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and text.count("FlatMapCoGroupsInPandas") == 1


def test_sums_of_many_groups_are_those_of_few(rows):
    d, rng = plain(rows)[:50], np.random.default_rng(1)
    at = [rng.integers(-1, n, len(rows)) for n in (5, 70, 3, 64)]
    sums = density.group_sums(at, [5, 70, 3, 64], True)
    for _ in range(2):
        got = sums(d[:, 100:900], slice(100, 900))
        for k, n in enumerate((5, 70, 3, 64)):
            want = np.stack([d[:, 100:900][:, at[k][100:900] == g].sum(1) for g in range(n)], 1)
            assert np.allclose(got[k], want, rtol=1e-12)


def test_nearest_of_many_tiles_with_late_and_equal_rows(monkeypatch):
    monkeypatch.setattr(density, "TALL", 7)
    monkeypatch.setattr(density, "WIDE", 20)
    x = np.concatenate((np.linspace(9, 1, 300), np.ones(200)))[:, None]  # ever nearer ones, then copies
    t = pd.DataFrame({"key": np.arange(500)[::-1].copy(), "v": list(x)})
    d, keys = plain(t), t["key"].to_numpy()
    got = density.closest(t, t, 5).groupby("key").agg(list)
    for i, k in enumerate(keys):
        order = np.lexsort((keys, keys != k, d[i]))[:5]
        assert got.loc[k, "other"] == list(keys[order]) and got.loc[k, "distance"] == list(d[i][order])
