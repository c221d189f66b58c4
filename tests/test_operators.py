"""Hand-checkable cases and invariants."""

import datetime as dt
import math

from pyspark.sql import functions as F

from quillmesh.functions import arith, capture, geo
from quillmesh.functions import text as tx
from quillmesh.operators import baskets, cleaning, cluster, corpus, profile, ranks, retail, scoring, tasks
from quillmesh.plans import views
from quillmesh.queries.tasks import task_log
from quillmesh.sources import tables
from quillmesh.streaming import tasks as stream
from tests.conftest import DATA


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_geometry(spark):
    one = lambda x: F.lit(float(x))
    assert math.isclose(value(spark, geo.great_circle(one(0), one(0), one(0), one(1))), 111.195, abs_tol=0.01)
    assert value(spark, geo.great_circle(one(40.7), one(-74), one(40.7), one(-74))) == 0
    assert math.isclose(value(spark, geo.bearing(one(0), one(0), one(0), one(1))), 90)
    assert math.isclose(value(spark, geo.bearing(one(0), one(0), one(-1), one(0))), 180)


def test_rounding_and_normal(spark):
    assert [value(spark, arith.half_up(F.lit(x))) for x in (0.5, 1.5, 2.49)] == [1, 2, 2]
    assert value(spark, arith.percent(F.lit(1), F.lit(0))) == 0
    assert math.isclose(value(spark, arith.normal_cdf(F.lit(1.959963984540054))), 0.975, abs_tol=2e-7)
    assert value(spark, arith.clock_text(F.lit(65.0))) == "1m 05s"


def test_ledger_counts_null_as_failure(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50), (4, -1)], "id int, x int")
    rules = [("low", "", F.col("x") >= 0), ("high", "", F.col("x") <= 10)]
    assert [(r.rule, r.before, r.removed, r.after) for r in cleaning.ledger(df, rules).orderBy("step").collect()] == [("low", 4, 2, 2), ("high", 2, 1, 1)]
    assert [r.id for r in cleaning.survivors(df, rules).collect()] == [1]
    assert [r.after for r in cleaning.ledger(df.limit(0), rules).collect()] == [0, 0]


def test_splits_ignore_row_order(spark):
    df = spark.range(2000).withColumn("y", F.col("id") % 3)
    a = {r.id: r.b for r in df.select("id", cleaning.md5_bucket(F.col("id"), "s").alias("b")).collect()}
    b = {r.id: r.b for r in df.orderBy(F.desc("id")).select("id", cleaning.md5_bucket(F.col("id"), "s").alias("b")).collect()}
    assert a == b and min(a.values()) >= 0 and max(a.values()) < 1000
    parts = cleaning.stratified(df, "y", "id", [("a", 0.5), ("b", 0.5)], "q").groupBy("y", "part").count().collect()
    assert all(abs(r["count"] - 333) <= 1 for r in parts)


def test_violations(spark):
    df = spark.createDataFrame([(1, None), (2, 9)], "id int, x int")
    found = cleaning.violations(df, "id", [("x", "missing", F.col("x").isNull()), ("x", "large", F.col("x") > 5)])
    assert sorted((r.id, r.reason) for r in found.collect()) == [(1, "missing"), (2, "large")]


def test_profile_and_spellings(spark):
    df = spark.createDataFrame([("UK", 1.0), ("uk", 2.0), ("UK", None), (None, 100.0)], "c string, x double")
    p = {r["column"]: r for r in profile.profile(df, {"x": F.col("x") > 50}).collect()}
    assert (p["x"].nulls, p["x"].invalid, p["c"].distinct) == (1, 1, 2)
    assert [(r.surface, r.preferred, r.n) for r in profile.other_spellings(df, "c").collect()] == [("uk", "UK", 1)]


def test_mining_agrees_on_a_hand_checked_case(spark):
    lines = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 3)], "order_id long, item long")
    found = {tuple(r["items"]): r.cnt for r in baskets.itemsets(lines, 5, 0.4).collect()}
    assert found == {(1,): 3, (2,): 2, (1, 2): 2}
    assert found == {tuple(r["items"]): r.cnt for r in baskets.tid_itemsets(lines, 5, 0.4).collect()}
    r = baskets.rules(baskets.itemsets(lines, 5, 0.4), 0.5, 1.0).collect()
    assert [(x.antecedent, x.consequent) for x in r] == [([2], [1]), ([1], [2])]
    assert math.isclose(r[0].lift, 0.4 / (0.6 * 0.4)) and math.isclose(r[0].confidence, 1.0)


def test_gate_keeps_the_earlier_of_ties(spark):
    t = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, None), (5, 1.5)], "trial int, v double")
    assert [r.accepted for r in baskets.gate(t, "v", F.lit(True), 0.0).orderBy("trial").collect()] == [True, False, True, False, False]


def test_scores(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    assert scoring.roc_auc(df, "s", "y").first().auc == 0.75
    assert scoring.average_precision(df, "s", "y").first().average_precision == round((1 + 2 / 3) / 2, 6)


def test_capture(spark):
    today = F.lit("2024-01-03").cast("date")
    got = value(spark, capture.capture(F.lit("Mail a@b.com about C# !crit #Home #home ~1.5h @fri, soon"), today))
    assert (got.title, got.priority, got.tags, got.minutes, got.due) == ("Mail a@b.com about C# , soon", "urgent", ["home"], 90, dt.date(2024, 1, 5))
    assert value(spark, capture.due(F.lit("wednesday"), today)) == dt.date(2024, 1, 10)
    assert value(spark, capture.due(F.lit("2024-02-30"), today)) is None


def test_encode_round_trip(spark):
    text = "Hello, world!\n\tÄ €"
    assert value(spark, tx.decoded(tx.encoded(F.lit(text)))) == "Hello, world!\n\t   "


def test_windows_hold_each_character_once(spark):
    df = spark.createDataFrame([(1, 10), (2, 448), (3, 449), (4, 5000)], "id int, n int")
    for r in corpus.chunks(df, "id", F.col("n"), 512, 64, 64).groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("c"), F.max("stop").alias("m")).collect():
        assert r.c == r.m == {1: 10, 2: 448, 3: 449, 4: 5000}[r.id]


def test_streak_and_replay(spark):
    d = spark.createDataFrame([(1, dt.date(2024, 1, 29), True), (1, dt.date(2024, 1, 28), True), (2, dt.date(2024, 1, 30), True), (3, dt.date(2024, 1, 1), False)], "u int, day date, hit boolean")
    assert {r.u: r.streak for r in tasks.streaks(d, "u", "day", "hit", "2024-01-30", 30).collect()} == {1: 2, 2: 1, 3: 0}


def test_stream_gives_the_batch_result(spark, tmp_path):
    e = tables.parquet(spark, DATA, "events")
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = stream.current_state(task_log(s)).writeStream.format("memory").queryName("state").outputMode("update").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.task_id: (r.status, r.flag, r.completed_seq, r.changes) for r in spark.sql("SELECT * FROM state").collect()}
    assert got == {r.task_id: (r.status, r.flag, r.completed_seq, r.changes) for r in tasks.replay(task_log(e)).collect()}


def test_partitions(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 1)], "a int, b int")
    assert cluster.co_assignment(df, "a", "b").first().agreement == round((6 - 2 - 3 + 2 * 1) / 6, 6)


def test_sources_round_trip(spark, tmp_path):
    df = views.tasks(spark, DATA).select("id", "title", (F.col("id") % 2).cast("string").alias("split")).limit(50)
    tables.write_roles(df, str(tmp_path / "roles"))
    assert tables.read_role(spark, str(tmp_path / "roles"), "1", "id").where("id % 2 = 0").count() == 0
    tables.write_csv(df, str(tmp_path / "csv"))
    back = tables.csv_strings(spark, str(tmp_path / "csv"), ["id", "title", "split"])
    assert back.count() == 50 and dict(back.dtypes) == {"id": "string", "title": "string", "split": "string"}
    (tmp_path / "r.txt").write_text("Words: a\nStory: b<|end|>nothing<|end|>Words: c\nStory: d")
    parsed, counts = tables.records(spark, str(tmp_path / "r.txt"), "<|end|>", {"words": "Words: (.*)", "story": "Story: (.*)"})
    assert parsed.count() == 2 and counts.first().skipped == 1


def test_two_proportions_without_variance(spark):
    r = retail.two_proportions(spark.createDataFrame([(10, 0, 10, 0)], "n0 long, x0 long, n1 long, x1 long")).first()
    assert (r.z, r.p_value, r.power, r.unreliable) == (0.0, 1.0, 0.0, True)


def test_turn_windows_hold_the_budget(spark):
    import random

    from quillmesh.operators.corpus import turn_windows

    rng = random.Random(4)
    rows = [(0, 0, "user", 60), (0, 1, "assistant", 60), (0, 2, "user", 60), (1, 0, "system", 90), (1, 1, "user", 5), (1, 2, "assistant", 4), (2, 0, "assistant", 5)]
    for c in range(3, 40):
        turn = 0
        if c % 2:
            rows.append((c, 0, "system", rng.randrange(0, 40)))
            turn = 1
        for _ in range(rng.randrange(1, 9)):
            rows += [(c, turn, "user", rng.randrange(0, 60)), (c, turn + 1, "assistant", rng.choice([5, 30, 300]))]
            turn += 2
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, n long")
    out = turn_windows(d, "conv_id", "turn", "role", F.col("n"), 100, 10).collect()
    first = {c: min((t for k, t, r, _ in rows if k == c and r == "user"), default=None) for c, *_ in rows}
    opening = {c: sum(n for k, t, _, n in rows if k == c and (f is None or t < f)) for c, f in first.items()}
    load, opened = {}, {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.exchange)):
        end = min((o.first_turn for o in out if o.conv_id == r.conv_id and o.exchange == r.exchange + 1), default=1 << 40)
        mine = [(role, n) for k, t, role, n in rows if k == r.conv_id and r.first_turn <= t < end]
        ask, reply = sum(n for role, n in mine if role == "user"), sum(n for role, n in mine if role != "user")
        room = 100 - opening[r.conv_id] - ask
        if r.kind == "packed":
            key = (r.conv_id, r.window)
            load[key] = load.get(key, opening[r.conv_id]) + ask + reply
            assert load[key] <= 100 and r.window <= opened.get(r.conv_id, 0)
        elif r.kind == "chunked":  # the pieces hold the reply once, and no piece is spare
            assert room + (r.pieces - 1) * (room - 10) >= reply > room + (r.pieces - 2) * (room - 10) and r.window == opened.get(r.conv_id, 0)
        else:
            assert room <= 10 and r.pieces == 0 and r.window is None
        opened[r.conv_id] = max(opened.get(r.conv_id, 0), (r.window or 0) + r.pieces) if r.pieces else opened.get(r.conv_id, 0)
    assert {r.kind for r in out} == {"packed", "chunked", "dropped"} and [r.window for r in out if r.conv_id == 0] == [0, 1] or len(out) > 3
    assert 2 not in {r.conv_id for r in out}


def test_cohort_matrix_has_every_period(spark):
    from quillmesh.operators.retail import cohort_matrix, cohorts

    rows = [(c, f"{2020 + (c % 3 + m) // 12}-{(c % 3 + m) % 12 + 1:02d}-05") for c in range(9) for m in (0, 1, 19)]
    long = cohorts(spark.createDataFrame(rows, "customer string, d string").select("customer", F.col("d").cast("timestamp").alias("d")), "customer", "d")
    wide = cohort_matrix(long)
    assert wide.columns == ["cohort", *[f"p{i}" for i in range(22)]]
    assert sorted(r.p19 for r in wide.collect()) == [100.0] * 3


def test_changes_of_tasks(spark):
    from quillmesh.operators import tasks as ops

    t = spark.createDataFrame([(1, "a", None, 3, "todo", 1, None), (2, "b", "low", None, "completed", 2, "2020-01-01"), (3, "c", "low", 3, "todo", 3, None)], "id long, title string, priority string, category_id int, status string, order_index int, completed_on string").withColumn("completed_on", F.col("completed_on").cast("date"))
    assert [r.category_id for r in ops.without_categories(t, t.where("id = 1").select("category_id")).orderBy("id").collect()] == [None] * 3
    change = spark.createDataFrame([(1, None, "high"), (2, "B", None)], "id long, title string, priority string")
    assert [(r.title, r.priority) for r in ops.patched(t, change, ["title", "priority"]).orderBy("id").collect()] == [("a", "high"), ("B", "low"), ("c", "low")]
    assert [(r.title, r.priority) for r in ops.patched(t, change, ["title", "priority"], True).orderBy("id").collect()] == [(None, "high"), ("B", None), ("c", "low")]
    moves = spark.createDataFrame([(1, "completed", 9), (2, "todo", None)], "id long, column string, place int")
    got = [(r.status, r.order_index, str(r.completed_on)) for r in ops.moved_rows(t, moves, F.lit("2021-02-03").cast("date")).orderBy("id").collect()]
    assert got == [("completed", 9, "2021-02-03"), ("todo", 2, "None"), ("todo", 3, "None")]
    none = ops.nested(t, spark.createDataFrame([], "task_id long, position int, id long, completed boolean"), spark.createDataFrame([], "task_id long, name string")).collect()
    assert all(r.subtasks == [] and r.tags == [] and r.subtasks_total == 0 for r in none)


def test_places_and_running_sums_go_by_ranges(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 37 % 1000).alias("x"))
    got = [(r.x, r.id, r.a, r.b) for r in ranks.placed(df, "id", {"a": F.struct("x", "id"), "b": F.struct(-F.col("id"))}).collect()]
    want = sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r[2] for r in want] == list(range(1, 5001)) and all(r[3] == 5000 - r[1] for r in got)
    s = [(r.v, r.up_to) for r in ranks.running(spark.range(300).select((F.col("id") + 1).alias("v")), F.struct("v"), {"up_to": F.col("v")}).collect()]
    assert all(t == v * (v + 1) // 2 for v, t in s) and len(s) == 300
    assert ranks.running(spark.range(0), F.struct("id"), {"n": F.lit(1)}).count() == 0


def test_percentile_rank_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 9), (5, None)], "i int, v int")
    assert {r.i: r.p for r in ranks.percentile_rank(df, "v", "p").collect()} == {3: 0.3, 5: 0.3, 1: 0.7, 2: 0.7, 4: 1.0}


def test_areas_of_one_class_and_none(spark):
    one = spark.createDataFrame([(0.5, 1), (0.5, 1)], "s double, y int")
    assert scoring.roc_auc(one, "s", "y").first().auc == 0.0 and scoring.average_precision(one, "s", "y").first().average_precision == 1.0
    assert scoring.roc_auc(one.where("false"), "s", "y").first().auc is None


def test_importances(spark):
    w = spark.createDataFrame([("m", "a", -3.0), ("m", "a", 1.0), ("m", "b", 6.0), ("n", "b", 0.0), ("n", "a", 0.0)], "model string, feature string, weight double")
    got = scoring.importances(w)
    assert {(r.model, r.feature): (r.importance, r.share_pct, r.place) for r in got.collect()} == {("m", "b"): (6.0, 60.0, 1), ("m", "a"): (4.0, 40.0, 2), ("n", "a"): (0.0, 0.0, 1), ("n", "b"): (0.0, 0.0, 2)}
    assert {r.feature: (r.m, r.n, r.in_top) for r in scoring.agreement(got, ["m", "n"], 1).collect()} == {"a": (None, 1, 1), "b": (1, None, 1)}


def test_silhouettes_of_few_rows(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [0.0, 2.0]), ("b", [10.0, 0.0])], "g string, v array<double>")
    got = {r.g: (r.n, r.silhouette) for r in cluster.silhouettes(df, "g", "v").collect()}
    assert got == {"a": (2, round(((100 - 4) / 100 + (104 - 4) / 104) / 2, 5)), "b": (1, 0.0)}
    assert [r.silhouette for r in cluster.silhouettes(df.where("g = 'a'"), "g", "v").collect()] == [None]


def test_no_persona_twice(spark):
    f = spark.createDataFrame([(1, "x", 0.1, 0), (1, "y", 0.2, 0), (2, "x", 0.1, 0), (2, "y", 0.5, 0), (3, "x", 0.0, 0), (3, "y", 0.0, 0), (3, "z", 0.0, 1), (1, "z", 0.4, 0), (2, "z", 0.9, 1)], "g int, persona string, distance double, contradicted long")
    assert {r.g: r.persona for r in cluster.matched(f, "g").collect()} == {1: "z", 2: "x", 3: "y"}


def test_defaults_and_ranges(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0), (4, float("nan")), (5, float("inf"))], "id int, x double")
    filled, checks = cleaning.defaulted(df, {"x": (0, 10, 7)})
    assert {r["id"]: r["x"] for r in filled.where("id < 4").collect()} == {1: 5.0, 2: 7.0, 3: 50.0}
    assert {(r["id"], r["reason"]) for r in cleaning.violations(df, "id", checks).collect()} == {(3, "out of range"), (4, "not finite"), (5, "not finite")}


def test_markers_and_constant_columns(spark):
    df = spark.createDataFrame([("?", "a", 1, None), ("b", "?", 1, None), ("?", "c", 1, None)], "x string, y string, n int, e string")
    assert [tuple(r) for r in cleaning.stray_marker(df, "?", "x").collect()] == [("y", 1)]
    assert [r["x"] for r in cleaning.relabelled(df, "x", "?").collect()].count("missing") == 2
    assert cleaning.constant_columns(df) == ["n", "e"]
    assert cleaning.constant_columns(spark.createDataFrame([(1,), (None,)], "n int")) == []


def test_preview_derived_and_facts(spark):
    df = spark.createDataFrame([(2, 1.23456, 1), (1, None, 0), (3, 2.0, 1)], "id int, x double, y int")
    assert [tuple(r) for r in cleaning.preview(df, 2, "id").collect()] == [("1", "missing", "0"), ("2", "1.2346", "1")]
    made = cleaning.derived(df, {"a": lambda d: d["id"] * 2, "b": lambda d: d["a"] + 1})
    assert sorted(r["b"] for r in made.collect()) == [3, 5, 7]
    f = cleaning.profile_facts(df, "y", ["x"], ("id", "y")).first()
    assert (f["rows"], f["x_missing"], f["x_min"], f["x_max"]) == (3, 0.333333, 1.23456, 2.0) and math.isclose(f["positive_rate"], 0.666667)


def test_thinned_curve_keeps_its_ends(spark):
    df = spark.range(101).select(F.col("id").alias("x"))
    assert sorted(r["x"] for r in scoring.thinned(df, F.struct("x"), 11).collect()) == list(range(0, 101, 10))
    assert scoring.thinned(df.where("x < 5"), F.struct("x"), 11).count() == 5


def plain_density(points, eps, least):
    """Textbook DBSCAN; a border point goes to its nearest core."""
    import math

    near = {a: [b for b in points if round(math.dist(points[a], points[b]), 9) <= eps] for a in points}
    core, name = {a for a in points if len(near[a]) >= least}, {}
    for a in sorted(core):
        if a in name:
            continue
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in name:
                name[x] = a
                todo += [b for b in near[x] if b in core]
    for a in points:
        if a not in core:
            by = [(round(math.dist(points[a], points[b]), 9), b) for b in near[a] if b in core]
            name[a] = name[min(by)[1]] if by else -1
    return {a: (name[a], a in core) for a in points}


def test_density_clusters_chains_borders_and_noise(spark, monkeypatch):
    import random

    from quillmesh.operators import density

    rng = random.Random(4)
    spots = [(i * 0.5, 0.0) for i in range(40)] + [(30 + rng.random(), 30 + rng.random()) for _ in range(60)] + [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(30)]
    spots += [(20.0, 0.0), (20.5, 0.0), (100.0, 0.0), (101.0, 0.0), (102.0, 0.0), (101.0, 0.0)]  # a chain's end, two equal rows
    points = dict(enumerate(spots))
    df = spark.createDataFrame([(k, list(v)) for k, v in points.items()], "id long, v array<double>")
    for block in (2048, 32):
        monkeypatch.setattr(density, "BLOCK", block)
        got = {r.key: (r.cluster, r.core) for r in density.density(df, "id", "v", 1.0, 3).collect()}
        assert got == plain_density(points, 1.0, 3)
    assert density.density(df.limit(0), "id", "v", 1.0, 3).count() == 0
    near = {(r.key, r.place): (r.other, r.distance) for r in density.nearest(df, "id", "v", 3).collect()}
    assert all(near[k, 1] == (k, 0.0) for k in points) and len(near) == 3 * len(points)
    curve = [r.distance for r in density.k_distances(df, "id", "v", 3).orderBy("place").collect()]
    assert curve == sorted(near[k, 3][1] for k in points)
    gap = [abs((curve[-1] - curve[0]) * (i + 1) - (len(curve) - 1) * y + len(curve) * curve[0] - curve[-1]) for i, y in enumerate(curve)]
    assert density.radius(density.k_distances(df, "id", "v", 3)).first().eps == curve[max(range(len(gap)), key=lambda i: (round(gap[i], 9), -i))]


def test_components_of_chains_and_hubs(spark):
    from quillmesh.operators import density

    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in density.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}


def test_graph_clusters_find_two_rings(spark):
    import math

    from quillmesh.operators import density

    ring = lambda n, r, at: [(at + i, [r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)]) for i in range(n)]
    df = spark.createDataFrame(ring(16, 1.0, 0) + ring(40, 6.0, 100), "id long, v array<double>")
    got = {r.key: r.cluster for r in density.graph_clusters(df, "id", "v", 2, 9).collect()}
    assert len({got[i] for i in range(16)}) == 1 and len({got[100 + i] for i in range(40)}) == 1 and got[0] != got[100]


def test_leaderboard_has_one_champion_and_undefined_entrants_last(spark):
    rows = [("a", 0.2), ("b", None), ("c", 0.5), ("d", 0.2)]
    got = {r.entrant: (r.place, r.champion) for r in cluster.leaderboard(spark.createDataFrame(rows, "entrant string, silhouette double")).collect()}
    assert got == {"c": (1, True), "a": (2, False), "d": (2, False), "b": (4, False)}
    none = cluster.leaderboard(spark.createDataFrame([("x", None)], "entrant string, silhouette double")).first()
    assert none.place == 1 and not none.champion
