"""Quartiles of a profile by running sums."""

import random

from quillmesh.operators import profile


def test_profile_meets_no_column_in_one_group_and_has_exact_quartiles(spark):
    rng = random.Random(5)
    rows = [(i % 9 or None, rng.choice([None, *range(20), 500]), rng.choice([-0.5, rng.random(), 90.0]) if i % 7 else None, rng.choice("abc")) for i in range(501)]
    df = spark.createDataFrame(rows, "k long, a int, b double, t string").repartition(5)
    found = profile.profile(df, {"a": df["a"] > 10}, ("k",))
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["column"]: r for r in found.collect()}
    for i, c in enumerate("kabt"):
        have = [r[i] for r in rows if r[i] is not None]
        assert (got[c]["rows"], got[c]["nulls"], got[c]["distinct"]) == (501, 501 - len(have), len(set(have)))
        if c in "ab":
            have.sort()
            at = lambda p: have[int(p)] + (have[min(int(p) + 1, len(have) - 1)] - have[int(p)]) * (p - int(p))  # noqa: B023, E731
            low, high = at(0.25 * (len(have) - 1)), at(0.75 * (len(have) - 1))
            assert got[c]["outliers"] == sum(x < low - 3 * (high - low) or x > high + 3 * (high - low) for x in have)
    assert got["a"]["invalid"] == sum(r[1] is not None and r[1] > 10 for r in rows) and got["t"]["min"] == "a" and got["k"]["min"] == "1" and got["k"]["outliers"] == 0
