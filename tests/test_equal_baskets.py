"""Orders with equal baskets are one row that counts for all of them."""

from itertools import combinations

from quillmesh.operators import baskets


def test_miners_count_equal_baskets_once(spark):
    kinds = {(1, 2, 3): 50, (2, 3): 30, (1, 4): 7, (5,): 13}
    lines, order = [], 100
    for items, n in kinds.items():
        for _ in range(n):
            lines += [(order, i) for i in items]
            order += 1
    df = spark.createDataFrame(lines, "order_id long, item long")
    equal = baskets.equal_baskets(df)
    assert sorted((tuple(r["all"]), r.orders, r.first) for r in equal.collect()) == [((1, 2, 3), 50, 100), ((1, 4), 7, 180), ((2, 3), 30, 150), ((5,), 13, 187)]
    want = {}
    for items, n in kinds.items():
        for size in (1, 2, 3):
            for s in combinations(items, size):
                want[s] = want.get(s, 0) + n
    want = {s: n for s, n in want.items() if n >= 10}
    for found in (baskets.itemsets(df, 100, 0.1), baskets.tid_itemsets(df, 100, 0.1), baskets.itemsets(df, 100, 0.1, equal=equal), baskets.tid_itemsets(df, 100, 0.1, blocks=2, equal=equal)):
        assert {tuple(r["items"]): r.cnt for r in found.collect()} == want
